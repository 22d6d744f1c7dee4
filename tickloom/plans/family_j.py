"""Strategy signals."""

from pyspark.sql import functions as F

from ..operators import strategies as S
from .family_e import W, ema_sql, roll
from .inputs import BARS, bars
from .registry import query

PAIR = BARS + """,
pr AS (SELECT 'p' AS pair, a.ts, a.close AS close_a, b.close AS close_b, a.close AS y, b.close AS x, ln(a.close) - ln(b.close) AS spread
  FROM bars a JOIN bars b ON a.ts = b.ts AND CAST(substr(a.symbol, 7) AS INT) + 1 = CAST(substr(b.symbol, 7) AS INT)),
pairs AS (SELECT a.symbol || '-' || b.symbol AS pair, a.ts, a.close AS close_a, b.close AS close_b, ln(a.close) AS y, ln(b.close) AS x, ln(a.close) - ln(b.close) AS spread
  FROM bars a JOIN bars b ON a.ts = b.ts AND CAST(substr(a.symbol, 7) AS INT) + 1 = CAST(substr(b.symbol, 7) AS INT))"""
WP = "PARTITION BY pair ORDER BY ts"


def pairs(spark, d):
    """Each brand with the next one, on common dates."""
    b = bars(spark, d).select("symbol", "ts", "close").withColumn("k", F.substring("symbol", 7, 9).cast("int"))
    a = b.select(F.col("symbol").alias("sa"), "ts", F.col("close").alias("close_a"), (F.col("k") + 1).alias("k"))
    j = a.join(b.select(F.col("symbol").alias("sb"), "ts", F.col("close").alias("close_b"), "k"), ["ts", "k"])
    return j.select(F.concat_ws("-", "sa", "sb").alias("pair"), "ts", "close_a", "close_b", F.log("close_a").alias("y"), F.log("close_b").alias("x"),
                    (F.log("close_a") - F.log("close_b")).alias("spread"))


MOMENTUM = f"""s0 AS (SELECT symbol, ts, open, close, ({roll('avg(close)', 20)} - {roll('avg(close)', 50)}) / {roll('avg(close)', 50)} AS sp FROM bars),
sig AS (SELECT *, CASE WHEN sp > 0 THEN 1.0 WHEN sp < 0 THEN -1.0 ELSE 0.0 END AS signal, least(abs(sp), 1.0) AS confidence FROM s0)"""


@query("j01_momentum", "symbol ts! signal:1 confidence:8", BARS + f", {MOMENTUM}, result AS (SELECT symbol, ts, signal, CASE WHEN sp IS NOT NULL THEN confidence END AS confidence FROM sig)")
def j01(spark, d):
    return S.momentum(bars(spark, d))


@query("j01_momentum_ema", "symbol ts! signal:1 confidence:7", BARS + ",\n" + ema_sql("bars", "close", 12, "a") + ",\n" + ema_sql("bars", "close", 26, "b") + """,
s AS (SELECT symbol, ts, (a - b) / b AS sp, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM a JOIN b USING (symbol, ts)),
result AS (SELECT symbol, ts, CASE WHEN sp > 0.001 THEN 1.0 WHEN sp < -0.001 THEN -1.0 ELSE 0.0 END AS signal, least(abs(sp), 1.0) AS confidence FROM s)""")
def j01b(spark, d):
    return S.momentum(bars(spark, d), 12, 26, "ema", 0.001)


@query("j02_mean_reversion", "symbol ts! signal:1 confidence:7", BARS + f""",
z AS (SELECT symbol, ts, (close - {roll('avg(close)', 20)}) / {roll('stddev_samp(close)', 20)} AS z FROM bars),
result AS (SELECT symbol, ts, CASE WHEN z > -0.5 AND z < 0.5 THEN 0.0 WHEN z >= 2 THEN -1.0 WHEN z <= -2 THEN 1.0 ELSE 0.0 END AS signal,
  CASE WHEN z IS NOT NULL THEN least(greatest(abs(z) / 4, 0.0), 1.0) END AS confidence FROM z)""")
def j02(spark, d):
    return S.mean_reversion(bars(spark, d))


def rollp(e, n):
    return roll(e, n).replace("PARTITION BY symbol", "PARTITION BY pair")


@query("j03_ratio_stat_arb", "pair ts! signal:1 confidence:7", PAIR + f""",
r AS (SELECT pair, ts, close_a / close_b AS r FROM pairs), z AS (SELECT pair, ts, (r - {rollp('avg(r)', 60)}) / {rollp('stddev_samp(r)', 60)} AS z FROM r),
result AS (SELECT pair, ts, CASE WHEN abs(z) <= 0.5 THEN 0.0 WHEN z >= 2 THEN -1.0 WHEN z <= -2 THEN 1.0 ELSE 0.0 END AS signal,
  CASE WHEN z IS NOT NULL THEN least(abs(z) / 2, 1.0) END AS confidence FROM z)""")
def j03(spark, d):
    return S.ratio_stat_arb(pairs(spark, d))


@query("j04_market_making", "symbol ts! signal:1 confidence:7", BARS + f""",
a AS (SELECT symbol, ts, close, close / lag(close) OVER ({W}) - 1 AS r, {roll('avg(close)', 5)} AS ma FROM bars),
b AS (SELECT *, {roll('stddev_samp(r)', 20, 'r')} AS v, (close - ma) / ma AS dev FROM a),
c AS (SELECT *, v / {roll('avg(v)', 100, 'v')} AS vr FROM b),
result AS (SELECT symbol, ts, CASE WHEN dev > 0.001 THEN -0.5 WHEN dev < -0.001 THEN 0.5 ELSE 0.0 END AS signal,
  CASE WHEN vr IS NOT NULL THEN least(1 / greatest(vr, 0.5), 1.0) END AS confidence FROM c)""")
def j04(spark, d):
    return S.market_making(bars(spark, d))


@query("j05_quote_prices", "symbol ts! bid:8 ask:8 spread_bps:6", BARS + """,
m AS (SELECT symbol, ts, ln(close) AS mid, volume / 1000 AS v FROM bars),
h AS (SELECT *, mid * 0.001 / 2 * CASE WHEN v > 0 THEN greatest(1.0, v * 100) ELSE 1.0 END AS h FROM m),
result AS (SELECT symbol, ts, mid - h AS bid, mid + h AS ask, h * 2 / mid * 10000 AS spread_bps FROM h)""")
def j05(spark, d):
    b = bars(spark, d).select("symbol", "ts", F.log("close").alias("mid"), (F.col("volume") / 1000).alias("volatility"))
    return S.quote_prices(b)


@query("j06_pair_signal", "pair ts! z:6 signal:1", "RECURSIVE " + PAIR + f""",
zs AS (SELECT pair, ts, (spread - {rollp('avg(spread)', 20)}) / nullif({rollp('stddev_samp(spread)', 20)}, 0) AS z FROM pairs),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY ts) AS i FROM zs),
f AS (SELECT pair, 0::BIGINT AS i, 0.0::DOUBLE AS signal FROM (SELECT DISTINCT pair FROM n)
  UNION ALL
  SELECT n.pair, n.i, CASE WHEN z IS NULL THEN f.signal WHEN f.signal = 0 THEN CASE WHEN z > 2 THEN -1.0 WHEN z < -2 THEN 1.0 ELSE 0.0 END
    WHEN f.signal > 0 THEN CASE WHEN z > -0.5 THEN 0.0 ELSE 1.0 END ELSE CASE WHEN z < 0.5 THEN 0.0 ELSE -1.0 END END
  FROM f JOIN n ON n.pair = f.pair AND n.i = f.i + 1),
result AS (SELECT pair, ts, z, signal FROM f JOIN n USING (pair, i))""")
def j06(spark, d):
    return S.pair_signal(pairs(spark, d))


@query("j07_hold_until_flat", "pair ts! signal:1", PAIR + f""",
z AS (SELECT pair, ts, (spread - {rollp('avg(spread)', 20)}) / ({rollp('stddev_samp(spread)', 20)} + 1e-8) AS z FROM pairs),
r AS (SELECT pair, ts, CASE WHEN abs(z) < 0.5 THEN NULL WHEN z < -2 THEN 1.0 WHEN z > 2 THEN -1.0 END AS s FROM z),
result AS (SELECT pair, ts, coalesce(last_value(s IGNORE NULLS) OVER ({WP} ROWS UNBOUNDED PRECEDING), 0.0) AS signal FROM r)""")
def j07(spark, d):
    return S.hold_until_flat(pairs(spark, d), keys=["pair"])


@query("j08_rolling_hedge", "pair ts! hedge:6 spread:6", PAIR + f""",
h AS (SELECT pair, ts, y, x, count(*) OVER f AS n, covar_samp(y, x) OVER f / var_pop(x) OVER f AS hedge FROM pairs
  WINDOW f AS ({WP} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
result AS (SELECT pair, ts, CASE WHEN n >= 60 THEN hedge END AS hedge, CASE WHEN n >= 60 THEN y - hedge * x END AS spread FROM h)""")
def j08(spark, d):
    return S.rolling_hedge(pairs(spark, d))


@query("j09_signal_blend", "symbol ts! signal:7", BARS + f""", {MOMENTUM},
s AS (SELECT symbol, ts, least(abs(sp), 1.0) * signal AS t, least(greatest((close - open) / open, -1.0), 1.0) AS e FROM sig WHERE sp IS NOT NULL),
result AS (SELECT symbol, ts, least(greatest(t * 0.6 + e * 0.4, -1.0), 1.0) AS signal FROM s WHERE t IS NOT NULL)""")
def j09(spark, d):
    m = S.momentum(bars(spark, d)).where("confidence is not null")
    m = m.withColumns({"t": F.col("confidence") * F.col("signal"), "e": S.clip((F.col("close") - F.col("open")) / F.col("open"), -1.0, 1.0)})
    return S.blend(m, "t", "e")


@query("j10_parameter_sweep", "symbol ts! run signal:1 confidence:6")
def j10(spark, d):
    return S.sweep(bars(spark, d), [("momentum", {"short": 10, "long": 30}), ("momentum", {"short": 20, "long": 50}), ("mean_reversion", {"n": 20})])
