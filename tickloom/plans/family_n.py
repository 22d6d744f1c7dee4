"""Trading calendar."""

from pyspark.sql import functions as F

from ..operators import calendar as K
from .inputs import EVENTS, events
from .registry import query

LOCAL = EVENTS + """, hol AS (SELECT unnest([""" + ", ".join(f"DATE '{h}'" for h in K.HOLIDAYS) + """]) AS h),
lt AS (SELECT seq, ts, timezone('America/New_York', timezone('UTC', ts)) AS t FROM ev)"""
DAYS = LOCAL + """,
cal AS (SELECT CAST(d AS DATE) AS day FROM (SELECT unnest(generate_series((SELECT min(CAST(t AS DATE)) FROM lt)::TIMESTAMP, (SELECT max(CAST(t AS DATE)) + 11 FROM lt)::TIMESTAMP, INTERVAL 1 DAY)) AS d)
  WHERE isodow(d) < 6 AND CAST(d AS DATE) NOT IN (SELECT h FROM hol))"""


@query("n01_market_open", "seq# is_open extended", LOCAL + """, result AS (
  SELECT seq, isodow(t) < 6 AND CAST(t AS DATE) NOT IN (SELECT h FROM hol) AND t::TIME >= TIME '09:30' AND t::TIME < TIME '16:00' AS is_open,
  isodow(t) < 6 AND CAST(t AS DATE) NOT IN (SELECT h FROM hol) AND date_trunc('second', t)::TIME >= TIME '04:00' AND date_trunc('second', t)::TIME <= TIME '20:00' AS extended FROM lt)""")
def n01(spark, d):
    e = K.market_open(events(spark, d), extended=True).withColumnRenamed("is_open", "extended")
    return K.market_open(e)


@query("n02_trading_days", "day! events#", DAYS + """, r AS (SELECT day FROM cal WHERE day <= (SELECT max(CAST(ts AS DATE)) FROM ev) AND day >= (SELECT min(CAST(ts AS DATE)) FROM ev)),
result AS (SELECT day, count(seq) AS events FROM r LEFT JOIN ev ON CAST(ev.ts AS DATE) = day GROUP BY day)""")
def n02(spark, d):
    e = events(spark, d)
    span = e.agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("day")).where(K.is_trading_day(F.col("day")))
    n = e.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("events"))
    return days.join(n, "day", "left").fillna(0, ["events"])


NEXT = DAYS + """,
o AS (SELECT timezone('UTC', timezone('America/New_York', day + TIME '09:30')) AS o, timezone('UTC', timezone('America/New_York', day + TIME '16:00')) AS c FROM cal),
a AS (SELECT seq, o AS next_open FROM ev ASOF LEFT JOIN o ON ev.ts < o.o), b AS (SELECT seq, c AS next_close FROM ev ASOF LEFT JOIN o ON ev.ts < o.c),
result AS (SELECT * FROM a JOIN b USING (seq))"""


@query("n03_next_sessions", "seq# next_open@ next_close@", NEXT)
def n03(spark, d):
    return K.next_sessions(events(spark, d))


@query("n03_next_extended", "seq# next_open@ next_close@", NEXT.replace("TIME '09:30'", "TIME '04:00'").replace("TIME '16:00'", "TIME '20:00'"))
def n03b(spark, d):
    return K.next_sessions(events(spark, d), extended=True)


@query("n04_session_schedule", "day! trading open@ close@", LOCAL + """, dd AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM ev),
result AS (SELECT day, isodow(day) < 6 AND day NOT IN (SELECT h FROM hol) AS trading, timezone('UTC', timezone('America/New_York', day + TIME '09:30')) AS open,
  timezone('UTC', timezone('America/New_York', day + TIME '16:00')) AS close FROM dd)""")
def n04(spark, d):
    return K.session_schedule(events(spark, d).select(F.to_date("ts").alias("day")).distinct())
