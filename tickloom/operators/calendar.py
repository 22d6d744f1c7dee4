"""Trading calendar of New York sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col

# Full-day market holidays.
HOLIDAYS = [
    "2024-01-01", "2024-01-15", "2024-02-19", "2024-03-29", "2024-05-27", "2024-06-19", "2024-07-04", "2024-09-02", "2024-11-28", "2024-12-25",
    "2025-01-01", "2025-01-20", "2025-02-17", "2025-04-18", "2025-05-26", "2025-06-19", "2025-07-04", "2025-09-01", "2025-11-27", "2025-12-25",
    "2026-01-01", "2026-01-19", "2026-02-16", "2026-04-03", "2026-05-25", "2026-06-19", "2026-07-03", "2026-09-07", "2026-11-26", "2026-12-25",
]
ZONE = "America/New_York"


def is_trading_day(day):
    return (F.weekday(day) < 5) & ~F.date_format(day, "yyyy-MM-dd").isin(HOLIDAYS)


def market_open(df: DataFrame, ts: str = "ts", extended: bool = False) -> DataFrame:
    """Regular hours are 9:30 <= t < 16:00; extended hours 4:00 <= t <= 20:00. Times are UTC."""
    local = F.from_utc_timestamp(C(ts), ZONE)
    sec = F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)
    hours = (sec >= 4 * 3600) & (sec <= 20 * 3600) if extended else (sec >= 34200) & (sec < 57600)
    return df.withColumn("is_open", is_trading_day(F.to_date(local)) & hours)


def trading_days(spark: SparkSession, start: str, end: str) -> DataFrame:
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))
    return days.where(is_trading_day(C("day")))


def next_sessions(df: DataFrame, ts: str = "ts", within: int = 10, extended: bool = False) -> DataFrame:
    """Next open and next close (UTC) after each time and the seconds until then.

    The first trading day is looked for among the next ``within`` days. ``extended`` sessions last from 4:00 to 20:00.
    """
    local = F.from_utc_timestamp(C(ts), ZONE)
    days = F.filter(F.sequence(F.to_date(local), F.date_add(F.to_date(local), within)), lambda d: is_trading_day(d))
    at = lambda h, m: F.transform(days, lambda d: F.to_utc_timestamp(d.cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(h), F.lit(m)), ZONE))
    first = lambda times: F.try_element_at(F.filter(times, lambda t: t > C(ts)), F.lit(1))
    d = df.withColumns({"next_open": first(at(4, 0) if extended else at(9, 30)), "next_close": first(at(20, 0) if extended else at(16, 0))})
    until = lambda c: F.unix_timestamp(c) - F.unix_timestamp(C(ts))
    return d.withColumns({"until_open": until("next_open"), "until_close": until("next_close")})


def session_schedule(days: DataFrame, day: str = "day") -> DataFrame:
    at = lambda h, m: F.to_utc_timestamp(C(day).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(h), F.lit(m)), ZONE)
    return days.withColumns({"trading": is_trading_day(C(day)), "pre_open": at(4, 0), "open": at(9, 30), "close": at(16, 0), "after_close": at(20, 0)})
