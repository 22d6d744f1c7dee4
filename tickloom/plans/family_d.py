"""Ticks, quotes and books."""

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import ticks as T
from .inputs import BARS, EVENTS, bars, events, ticks
from .registry import query

W = "PARTITION BY symbol ORDER BY ts"
WS = "PARTITION BY symbol ORDER BY ts, seq"

BOOK = EVENTS + """,
upd AS (SELECT 'S' || (user_id % 5) AS symbol, CASE WHEN user_id % 2 = 0 THEN 'bid' ELSE 'ask' END AS side,
  CASE WHEN user_id % 2 = 0 THEN 100 - floor(price / 10) ELSE 101 + floor(price / 10) END AS price,
  CASE WHEN volume % 7 = 0 THEN 0 ELSE volume END AS size, ts, seq FROM ev),
book AS (SELECT symbol, side, price, arg_max(size, seq) AS size FROM upd GROUP BY symbol, side, price HAVING arg_max(size, seq) > 0)"""


def book_updates(spark, d):
    e = events(spark, d)
    bid = F.col("user_id") % 2 == 0
    return e.select(
        F.concat(F.lit("S"), (F.col("user_id") % 5).cast("string")).alias("symbol"),
        F.when(bid, "bid").otherwise("ask").alias("side"),
        F.when(bid, 100 - F.floor(F.col("price") / 10)).otherwise(101 + F.floor(F.col("price") / 10)).cast("double").alias("price"),
        F.when(F.col("volume") % 7 == 0, 0.0).otherwise(F.col("volume")).alias("size"), "ts", "seq")


@query("d01_time_bars", "symbol bar@ open:4 high:4 low:4 close:4 volume:2 trades#", EVENTS + """, result AS (
  SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS bar, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, seq) AS close, sum(volume) AS volume, count(*) AS trades FROM ev GROUP BY 1, 2)""")
def d01(spark, d):
    return T.time_bars(events(spark, d), "1 hour")


@query("d01_daily_bars", "symbol ts! open:8 high:8 low:8 close:8 volume:2", BARS + ", result AS (SELECT * FROM bars)")
def d01b(spark, d):
    return bars(spark, d)


@query("d02_volume_bars", "symbol bar# ts@ open:4 high:4 low:4 close:4 volume:2", "RECURSIVE " + EVENTS + """,
n AS MATERIALIZED (SELECT symbol, ts, price::DOUBLE AS price, volume::DOUBLE AS volume, volume::DOUBLE AS m, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS i FROM ev),
f AS (SELECT symbol, 0::BIGINT AS i, 0::BIGINT AS bar, NULL::TIMESTAMP AS ts, 0.0::DOUBLE AS open, 0.0::DOUBLE AS high, 0.0::DOUBLE AS low, 0.0::DOUBLE AS close, 0.0::DOUBLE AS volume, 0.0::DOUBLE AS m, true AS fresh FROM (SELECT DISTINCT symbol FROM n)
  UNION ALL
  SELECT n.symbol, n.i, f.bar + CASE WHEN fresh AND f.i > 0 THEN 1 ELSE 0 END, CASE WHEN fresh THEN n.ts ELSE f.ts END, CASE WHEN fresh THEN n.price ELSE f.open END,
    CASE WHEN fresh THEN n.price ELSE greatest(f.high, n.price) END, CASE WHEN fresh THEN n.price ELSE least(f.low, n.price) END, n.price,
    CASE WHEN fresh THEN 0.0 ELSE f.volume END + n.volume, CASE WHEN fresh THEN 0.0 ELSE f.m END + n.m, CASE WHEN fresh THEN 0.0 ELSE f.m END + n.m >= 2000
  FROM f JOIN n ON n.symbol = f.symbol AND n.i = f.i + 1),
result AS (SELECT symbol, bar, ts, open, high, low, close, volume FROM f WHERE i > 0 AND fresh)""")
def d02(spark, d):
    return T.threshold_bars(events(spark, d), 2000.0)


@query("d03_dollar_bars", "symbol bar# ts@ open:4 high:4 low:4 close:4 volume:2", "RECURSIVE " + EVENTS + """,
n AS MATERIALIZED (SELECT symbol, ts, price::DOUBLE AS price, volume::DOUBLE AS volume, (price * volume)::DOUBLE AS m, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS i FROM ev),
f AS (SELECT symbol, 0::BIGINT AS i, 0::BIGINT AS bar, NULL::TIMESTAMP AS ts, 0.0::DOUBLE AS open, 0.0::DOUBLE AS high, 0.0::DOUBLE AS low, 0.0::DOUBLE AS close, 0.0::DOUBLE AS volume, 0.0::DOUBLE AS m, true AS fresh FROM (SELECT DISTINCT symbol FROM n)
  UNION ALL
  SELECT n.symbol, n.i, f.bar + CASE WHEN fresh AND f.i > 0 THEN 1 ELSE 0 END, CASE WHEN fresh THEN n.ts ELSE f.ts END, CASE WHEN fresh THEN n.price ELSE f.open END,
    CASE WHEN fresh THEN n.price ELSE greatest(f.high, n.price) END, CASE WHEN fresh THEN n.price ELSE least(f.low, n.price) END, n.price,
    CASE WHEN fresh THEN 0.0 ELSE f.volume END + n.volume, CASE WHEN fresh THEN 0.0 ELSE f.m END + n.m, CASE WHEN fresh THEN 0.0 ELSE f.m END + n.m >= 100000
  FROM f JOIN n ON n.symbol = f.symbol AND n.i = f.i + 1),
result AS (SELECT symbol, bar, ts, open, high, low, close, volume FROM f WHERE i > 0 AND fresh)""")
def d03(spark, d):
    return T.threshold_bars(events(spark, d), 100000.0, "dollar")


@query("d04_floor_volume_bars", "symbol bar# ts@ open:4 high:4 low:4 close:4 volume:2", EVENTS + f""",
c AS (SELECT *, floor((sum(volume) OVER ({WS}) - volume) / 2000.0) AS bar FROM ev),
result AS (SELECT symbol, bar, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close,
  sum(volume) AS volume, min(ts) AS ts FROM c GROUP BY symbol, bar)""")
def d04(spark, d):
    return T.floor_volume_bars(events(spark, d), 2000.0)


@query("d05_vwap", "symbol ts! vwap:4", BARS + f""", result AS (
  SELECT symbol, ts, sum((high + low + close) / 3 * volume) OVER ({W}) / sum(volume) OVER ({W}) AS vwap FROM bars)""")
def d05(spark, d):
    return T.cumulative_vwap(bars(spark, d))


@query("d06_order_imbalance", "symbol seq# imbalance:2", EVENTS + f""", result AS (
  SELECT symbol, seq, sum(CASE WHEN user_id % 2 = 0 THEN volume ELSE -volume END) OVER ({WS}) AS imbalance FROM ev)""")
def d06(spark, d):
    e = events(spark, d).withColumn("side", F.when(F.col("user_id") % 2 == 0, "buy").otherwise("sell"))
    return T.order_imbalance(e)


@query("d07_spread_metrics", "symbol seq# spread:6 spread_bps:4 mid:6", EVENTS + """,
q AS (SELECT symbol, seq, price + 1 AS bid, price + 1 + volume / 100 AS ask FROM ev),
result AS (SELECT symbol, seq, ask - bid AS spread, (ask - bid) / bid * 1e4 AS spread_bps, (bid + ask) / 2 AS mid FROM q)""")
def d07(spark, d):
    q = events(spark, d).select("symbol", "seq", (F.col("price") + 1).alias("bid"), (F.col("price") + 1 + F.col("volume") / 100).alias("ask"))
    return T.spread_metrics(q)


@query("d08_market_impact", "symbol ts! qty:2 impact_bps:4", BARS + f""",
v AS (SELECT symbol, ts, volume AS day_volume, abs(close / lag(close) OVER ({W}) - 1) AS volatility FROM bars),
q AS (SELECT symbol, ts, sum(volume) * 0.05 AS qty FROM ticks GROUP BY symbol, ts),
result AS (SELECT symbol, ts, qty, volatility * sqrt(qty / day_volume) * 0.1 * 1e4 AS impact_bps FROM q JOIN v USING (symbol, ts))""")
def d08(spark, d):
    b = M.simple_return(bars(spark, d))
    daily = b.select("symbol", "ts", F.abs("ret").alias("volatility"), F.col("volume").alias("day_volume"))
    orders = ticks(spark, d).groupBy("symbol", "ts").agg((F.sum("volume") * 0.05).alias("qty"))
    return T.market_impact(orders, daily)


@query("d09_book_snapshot", "symbol side price:2 size:2", BOOK + ", result AS (SELECT * FROM book)")
def d09(spark, d):
    return T.book_snapshot(book_updates(spark, d))


@query("d10_best_quotes", "symbol best_bid:2 best_ask:2 spread:2", BOOK + """, result AS (
  SELECT symbol, max(CASE WHEN side = 'bid' THEN price END) AS best_bid, min(CASE WHEN side = 'ask' THEN price END) AS best_ask,
  best_ask - best_bid AS spread FROM book GROUP BY symbol)""")
def d10(spark, d):
    return T.best_quotes(T.book_snapshot(book_updates(spark, d)))


@query("d11_depth_imbalance", "symbol bid_depth:2 ask_depth:2 imbalance:8", BOOK + """,
r AS (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END) AS rn FROM book),
a AS (SELECT symbol, sum(CASE WHEN side = 'bid' THEN size ELSE 0 END) AS bid_depth, sum(CASE WHEN side = 'ask' THEN size ELSE 0 END) AS ask_depth
  FROM r WHERE rn <= 5 GROUP BY symbol),
result AS (SELECT *, (bid_depth - ask_depth) / (bid_depth + ask_depth) AS imbalance FROM a)""")
def d11(spark, d):
    return T.depth_imbalance(T.book_snapshot(book_updates(spark, d)))


@query("d12_tick_jumps", "symbol seq# prev_price:4 move:6", EVENTS + f""",
m AS (SELECT symbol, seq, price, lag(price) OVER ({WS}) AS prev_price FROM ev),
result AS (SELECT symbol, seq, prev_price, price / prev_price - 1 AS move FROM m WHERE abs(price / prev_price - 1) > 0.01)""")
def d12(spark, d):
    return T.tick_jumps(events(spark, d))


@query("d13_multi_interval_bars", "symbol width bar@ open:4 high:4 low:4 close:4 volume:2", EVENTS + """,
x AS (SELECT *, '1 hour' AS width, time_bucket(INTERVAL '1 hour', ts) AS bar FROM ev
  UNION ALL SELECT *, '6 hours' AS width, time_bucket(INTERVAL '6 hours', ts) AS bar FROM ev
  UNION ALL SELECT *, '1 day' AS width, time_bucket(INTERVAL '1 day', ts) AS bar FROM ev),
result AS (SELECT symbol, width, bar, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close,
  sum(volume) AS volume FROM x GROUP BY symbol, width, bar)""")
def d13(spark, d):
    return T.multi_interval_bars(events(spark, d), ["1 hour", "6 hours", "1 day"])
