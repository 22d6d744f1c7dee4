"""Streaming operators, driven to completion over the event table as a file stream."""

from pyspark.sql import functions as F

from ..session import scratch_folder
from ..streaming import streams as S
from .family_d import BOOK, W, WS
from .inputs import EVENTS, events
from .registry import query

C = F.col


def stream(spark, d, days: float = 6.52, jitter: int = 0):
    """The event table as files of ``days`` days that arrive one after the other, a micro-batch each.

    With ``jitter`` the even events of a file's last seconds are in the next one, so they arrive late.
    """
    raw, files = spark.read.parquet(f"{d}/events.parquet"), scratch_folder(spark, "events")
    at = F.unix_timestamp(C("ts").cast("timestamp")) + F.when(C("event_id") % 2 == 0, jitter).otherwise(0)
    part = F.floor(at / int(days * 86400))
    for n in [r[0] for r in raw.select(part.alias("n")).distinct().orderBy("n").collect()]:  # one number a file
        raw.where(part == n).coalesce(1).write.mode("append").parquet(files)
    schema = raw.schema.simpleString()[7:-1].replace(":", " ")
    e = S.tick_stream(spark, files, schema, glob="*.parquet", files_per_trigger=1).withColumn("ts", C("ts").cast("timestamp"))
    return e.select(C("event_type").alias("symbol"), "ts", C("event_id").alias("seq"), C("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("volume"), "user_id")


def finish(spark, s, name, mode="append"):
    out = scratch_folder(spark, name)
    S.run_available(s, out, out + "-checkpoint", mode)
    return spark.read.parquet(out)


# the last windows stay open below the watermark: an append stream emits windows that ended ten minutes before the newest tick
@query("p01_stream_bars", "symbol bar@ open:4 high:4 low:4 close:4 volume:2 trades#", EVENTS + """, b AS (SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS bar, arg_min(price, seq) AS open, max(price) AS high,
  min(price) AS low, arg_max(price, seq) AS close, sum(volume) AS volume, count(*) AS trades FROM ev GROUP BY 1, 2),
result AS (SELECT * FROM b WHERE bar + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM ev))""")
def p01(spark, d):
    return finish(spark, S.bars(stream(spark, d, jitter=300), "1 hour"), "bars")


@query("p02_stream_book", "symbol side price:2 size:2", BOOK + ", result AS (SELECT * FROM book)")
def p02(spark, d):
    bid = C("user_id") % 2 == 0
    u = stream(spark, d, jitter=300).select(F.lit(0).alias("session"), F.concat(F.lit("S"), (C("user_id") % 5).cast("string")).alias("symbol"), F.when(bid, "bid").otherwise("ask").alias("side"),
                                F.when(bid, 100 - F.floor(C("price") / 10)).otherwise(101 + F.floor(C("price") / 10)).cast("double").alias("price"),
                                F.when(C("volume") % 7 == 0, 0.0).otherwise(C("volume")).alias("size"), "ts", "seq")
    out = scratch_folder(spark, "book")
    S.run_batches(S.book_levels(u), lambda b, i: b.withColumn("epoch", F.lit(i)).write.mode("append").parquet(out), out + "-checkpoint", "update")
    last = spark.read.parquet(out).groupBy("symbol", "side", "price").agg(F.max_by("size", "epoch").alias("size"))
    return last.where("size > 0")


@query("p03_stream_quotes", "symbol seq# spread:6 spread_bps:4 mid:6", EVENTS + """, q AS (SELECT symbol, seq, price + 1 AS bid, price + 1 + volume / 100 AS ask FROM ev),
result AS (SELECT symbol, seq, ask - bid AS spread, (ask - bid) / bid * 1e4 AS spread_bps, (bid + ask) / 2 AS mid FROM q)""")
def p03(spark, d):
    q = stream(spark, d).select("symbol", "seq", (C("price") + 1).alias("bid"), (C("price") + 1 + C("volume") / 100).alias("ask"))
    return finish(spark, S.quotes(q), "quotes")


@query("p04_stream_fan_out", "sink rows#", EVENTS + ", result AS (SELECT 'trades' AS sink, count(*) AS rows FROM ev UNION ALL SELECT 'large', count(*) FROM ev WHERE volume > 50)")
def p04(spark, d):
    out = scratch_folder(spark, "fan")

    def broken(b, i):
        raise RuntimeError("this sink is down")

    sinks = {"trades": lambda b, i: b.write.mode("append").parquet(out + "/sink=trades"), "broken": broken,
             "large": lambda b, i: b.where("volume > 50").write.mode("append").parquet(out + "/sink=large")}
    S.run_batches(stream(spark, d, jitter=300), S.fan_out(sinks), out + "-checkpoint")
    return spark.read.parquet(out).groupBy("sink").agg(F.count("*").alias("rows"))


NOW = "TIMESTAMP '2024-01-30 23:45:00'"
HEALTH = EVENTS + f""", h AS (SELECT 'u' || user_id AS feed, max(ts) AS last_ts, CAST(epoch(date_trunc('second', {NOW})) - epoch(date_trunc('second', max(ts))) AS BIGINT) AS age FROM ev GROUP BY 1),
hs AS (SELECT *, CASE WHEN age < 3600 THEN 'healthy' WHEN age < 40000 THEN 'degraded' ELSE 'unhealthy' END AS status FROM h)"""


def health(spark, d):
    e = events(spark, d).select(F.concat(F.lit("u"), C("user_id").cast("string")).alias("feed"), "ts")
    return S.feed_health(e, F.lit("2024-01-30 23:45:00").cast("timestamp"), healthy=3600, degraded=40000)


@query("p05_feed_health", "feed last_ts@ age# status", HEALTH + ", result AS (SELECT * FROM hs)")
def p05(spark, d):
    return health(spark, d)


@query("p06_overall_health", "status feeds#", HEALTH + """, result AS (SELECT CASE WHEN bool_or(status = 'unhealthy') THEN 'unhealthy' WHEN bool_or(status = 'degraded') THEN 'degraded'
  WHEN bool_or(status = 'healthy') THEN 'healthy' ELSE 'unknown' END AS status, count(*) AS feeds FROM hs)""")
def p06(spark, d):
    return S.overall_health(health(spark, d))


@query("p07_stream_tick_jumps", "symbol seq# prev_price:4 move:6", EVENTS + f""", m AS (SELECT symbol, seq, price, lag(price) OVER ({WS}) AS prev_price FROM ev),
result AS (SELECT symbol, seq, prev_price, price / prev_price - 1 AS move FROM m WHERE abs(price / prev_price - 1) > 0.01)""")
def p07(spark, d):
    return finish(spark, S.tick_jumps(stream(spark, d)), "jumps")


@query("a16_stream_to_store", "symbol ts! open:4 high:4 low:4 close:4 volume:2", EVENTS + """, result AS (SELECT symbol, CAST(ts AS DATE) AS ts, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, seq) AS close, sum(volume) AS volume FROM ev GROUP BY 1, 2)""")
def a16(spark, d):
    from ..sources.store import BarStore
    out = scratch_folder(spark, "store")
    store = BarStore(spark, out)
    S.run_batches(stream(spark, d, days=7), S.bar_sink(store), out + "-checkpoint")
    return store.load()
