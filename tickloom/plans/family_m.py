"""Risk, stops and limits."""

from pyspark.sql import functions as F

from ..operators import indicators as I
from ..operators import risk as R
from ..session import durable
from .family_e import TR, W, roll
from .inputs import BARS, EVENTS, RETURNS, bars, events, returns, table
from .registry import query

EQ = BARS + ", eq AS (SELECT symbol AS portfolio, ts, close AS equity FROM bars)"


def equity(spark, d):
    return bars(spark, d).select(F.col("symbol").alias("portfolio"), "ts", F.col("close").alias("equity"))


@query("m01_drawdown_check", "portfolio drawdown:8 ok", EQ + """,
x AS (SELECT portfolio, ts, (max(equity) OVER (PARTITION BY portfolio ORDER BY ts) - equity) / max(equity) OVER (PARTITION BY portfolio ORDER BY ts) AS dd FROM eq),
result AS (SELECT portfolio, arg_max(dd, ts) AS drawdown, arg_max(dd, ts) <= 0.5 AS ok FROM x GROUP BY portfolio)""")
def m01(spark, d):
    return R.drawdown_check(equity(spark, d), 0.5)


HOLD = """hold AS (SELECT 'C' || (o_custkey % 50) AS portfolio, p_brand AS symbol, sum(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
pv AS (SELECT *, sum(value) OVER (PARTITION BY portfolio) AS portfolio_value FROM hold)"""


def holdings(spark, d):
    l, o, p = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "part")
    x = l.join(o, l.l_orderkey == o.o_orderkey).join(p, l.l_partkey == p.p_partkey)
    h = x.groupBy(F.concat(F.lit("C"), (F.col("o_custkey") % 50).cast("string")).alias("portfolio"), F.col("p_brand").alias("symbol")).agg(
        F.sum(F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice"))).alias("value"))
    return h.join(h.groupBy("portfolio").agg(F.sum("value").alias("portfolio_value")), "portfolio")


@query("m02_exposure_check", "portfolio exposure:6 ok", HOLD + """, result AS (
  SELECT portfolio, sum(abs(value)) / max(portfolio_value) AS exposure, sum(abs(value)) / max(portfolio_value) <= 1.1 AS ok FROM pv GROUP BY portfolio)""")
def m02(spark, d):
    return R.exposure_check(holdings(spark, d), 1.1)


@query("m03_circuit_breaker", "portfolio ts! drawdown:8 halted", EQ + """,
x AS (SELECT portfolio, ts, (max(equity) OVER (PARTITION BY portfolio ORDER BY ts) - equity) / max(equity) OVER (PARTITION BY portfolio ORDER BY ts) AS drawdown FROM eq),
result AS (SELECT *, max(CASE WHEN drawdown >= 0.9 THEN 1 ELSE 0 END) OVER (PARTITION BY portfolio ORDER BY ts) = 1 AS halted FROM x)""")
def m03(spark, d):
    return R.circuit_breaker(equity(spark, d), 0.9)


@query("m04_value_at_risk", "symbol historical:8 parametric:6", RETURNS + """, result AS (SELECT symbol, quantile_cont(ret, 0.05) AS historical,
  avg(ret) - 1.6448536269514722 * stddev_samp(ret) AS parametric FROM rets GROUP BY symbol)""")
def m04(spark, d):
    r = returns(spark, d)
    return R.value_at_risk(r).withColumnRenamed("var", "historical").join(R.value_at_risk(r, method="parametric").withColumnRenamed("var", "parametric"), "symbol")


@query("m05_expected_shortfall", "symbol var:8 es:8", RETURNS + """, v AS (SELECT symbol, quantile_cont(ret, 0.05) AS var FROM rets GROUP BY symbol),
result AS (SELECT symbol, any_value(var) AS var, avg(ret) AS es FROM rets JOIN v USING (symbol) WHERE ret <= var GROUP BY symbol)""")
def m05(spark, d):
    return R.expected_shortfall(returns(spark, d))


@query("m06_concentration", "portfolio hhi:8 max_weight:8 top5:8 positions#", HOLD + """,
w AS (SELECT *, abs(value) / sum(abs(value)) OVER (PARTITION BY portfolio) AS w FROM hold),
r AS (SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY w DESC, symbol) AS rn FROM w),
result AS (SELECT portfolio, sum(w * w) AS hhi, max(w) AS max_weight, sum(CASE WHEN rn <= 5 THEN w END) AS top5, count(*) AS positions FROM r GROUP BY portfolio)""")
def m06(spark, d):
    return R.concentration(holdings(spark, d))


@query("m07_position_sizing", "c_custkey# size:9 vol_size:9 kelly:8 rejected", """
c AS (SELECT c_custkey, c_acctbal AS equity, (c_nationkey + 1) / 100.0::DOUBLE AS risk_pct, c_custkey % 7 AS stop, c_nationkey / 25.0::DOUBLE AS wr, 1 + c_custkey % 3 AS ratio FROM customer),
result AS (SELECT c_custkey, CASE WHEN equity > 0 AND stop > 0 THEN equity * risk_pct / stop END AS size, CASE WHEN equity > 0 AND stop > 0 THEN equity * risk_pct / (stop * 2) END AS vol_size,
  least(greatest((wr * ratio - (1 - wr)) / ratio * 0.5, 0), 1) AS kelly, NOT (equity > 0 AND stop > 0) AS rejected FROM c)""")
def m07(spark, d):
    c = table(spark, d, "customer").select(
        "c_custkey", F.col("c_acctbal").alias("equity"), ((F.col("c_nationkey") + 1) / F.lit(100.0)).alias("risk_pct"),
        (F.col("c_custkey") % 7).cast("double").alias("stop_distance"), (F.col("c_nationkey") / F.lit(25.0)).alias("win_rate"),
        (1 + F.col("c_custkey") % 3).cast("double").alias("win_loss_ratio"))
    k = R.kelly(c).drop("rejected").withColumn("atr", F.col("stop_distance"))
    v = R.volatility_size(k).withColumnRenamed("size", "vol_size").drop("rejected")
    return R.fixed_fractional(v)


STOPS = BARS + f""",
{TR}, atx AS (SELECT symbol, ts, {roll('avg(tr)', 14)} AS atr FROM t1),
ps AS (SELECT symbol || '/' || ts AS id, symbol, ts AS entry_ts, close AS entry_price, CASE WHEN volume % 2 = 0 THEN 'long' ELSE 'short' END AS side,
  CAST(ts + INTERVAL 90 DAY AS DATE) AS horizon FROM bars),
pt AS (SELECT id, p.symbol, side, entry_price, b.ts, b.close, atr, max(b.close) OVER f AS hi, min(b.close) OVER f AS lo, row_number() OVER f AS held
  FROM ps p JOIN bars b ON p.symbol = b.symbol AND b.ts > entry_ts AND b.ts <= horizon JOIN atx a ON a.symbol = b.symbol AND a.ts = b.ts
  WINDOW f AS (PARTITION BY id ORDER BY b.ts)),
pb AS (SELECT *, CASE WHEN side = 'long' THEN greatest(entry_price, hi) ELSE least(entry_price, lo) END AS best, CASE WHEN side = 'long' THEN 1 ELSE -1 END AS s FROM pt),
lv AS (SELECT *, entry_price - s * entry_price * 0.05 AS fs, best - s * best * 0.1 AS trs, best - s * atr * 2.0 AS ats FROM pb),
ht AS (SELECT *, s * (close - fs) <= 0 AS hf, s * (close - trs) <= 0 AS htr, s * (close - ats) <= 0 AS ha, held >= 20 AS hti FROM lv)"""


def exits(spark, d, rules=R.RULES):
    b = durable(I.atr(bars(spark, d)).select("symbol", "ts", "close", "volume", "atr"))
    p = b.select(
        F.concat_ws("/", "symbol", F.col("ts").cast("string")).alias("id"), "symbol", F.col("ts").alias("entry_ts"), F.col("close").alias("entry_price"),
        F.when(F.col("volume") % 2 == 0, "long").otherwise("short").alias("side"), F.date_add("ts", 90).alias("horizon"))
    return R.stop_exits(p, b.drop("volume"), rules=rules)


for _rule, _flag, _n in (("fixed", "hf", "m08_fixed_stop"), ("trailing", "htr", "m09_trailing_stop"), ("atr", "ha", "m10_atr_stop"), ("time", "hti", "m11_time_stop")):
    query(_n, "id exit_ts! exit_price:8", STOPS + f", result AS (SELECT id, min(ts) AS exit_ts, arg_min(close, ts) AS exit_price FROM ht WHERE {_flag} GROUP BY id)")(
        lambda spark, d, r=_rule: exits(spark, d, [r]).drop("rule"))


@query("m12_combined_stops", "id exit_ts! exit_price:8 rule", STOPS + """,
r AS (SELECT *, CASE WHEN hf THEN 'fixed' WHEN htr THEN 'trailing' WHEN ha THEN 'atr' WHEN hti THEN 'time' END AS rule FROM ht),
result AS (SELECT id, min(ts) AS exit_ts, arg_min(close, ts) AS exit_price, arg_min(rule, ts) AS rule FROM r WHERE rule IS NOT NULL GROUP BY id)""")
def m12(spark, d):
    return R.first_exit(exits(spark, d))


OD = """od AS (SELECT o_orderkey AS id, 'S' || (o_custkey % 10) AS symbol, CASE WHEN o_orderkey % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, 1 + o_custkey % 500 AS qty,
  CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_totalprice / 1000 END AS price, CASE WHEN o_orderpriority = '1-URGENT' THEN 50.0 END AS limit_price,
  o_custkey % 300 - 100 AS held_qty, o_totalprice AS total_value, 1000 - o_custkey AS daily_pnl, o_totalprice * 2 AS portfolio_value, o_orderdate AS ts FROM orders)"""


def order_table(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("S"), (F.col("o_custkey") % 10).cast("string")).alias("symbol"),
        F.when(F.col("o_orderkey") % 2 == 0, "buy").otherwise("sell").alias("side"), (1 + F.col("o_custkey") % 500).alias("qty"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice") / 1000).alias("price"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 50.0).alias("limit_price"), (F.col("o_custkey") % 300 - 100).alias("held_qty"),
        F.col("o_totalprice").alias("total_value"), (1000 - F.col("o_custkey")).alias("daily_pnl"), (F.col("o_totalprice") * 2).alias("portfolio_value"),
        F.col("o_orderdate").alias("ts"))


@query("m13_pre_trade_limits", "id# ok reason", OD + """, r AS (SELECT id, CASE WHEN qty > 400 THEN 'order_size' WHEN abs(held_qty + CASE WHEN side = 'buy' THEN qty ELSE -qty END) > 350 THEN 'position_size'
  WHEN total_value + qty * price > 400000 THEN 'total_value' WHEN daily_pnl < -300 THEN 'daily_loss' END AS reason FROM od),
result AS (SELECT id, reason IS NULL AS ok, reason FROM r)""")
def m13(spark, d):
    return R.pre_trade(order_table(spark, d), 400, 350, 400000, 300)


@query("m14_position_share", "id# share:8 ok", OD + """, s AS (SELECT id, abs(held_qty + CASE WHEN side = 'buy' THEN qty ELSE -qty END) * coalesce(price, limit_price, 100.0) / portfolio_value AS share FROM od),
result AS (SELECT *, share <= 0.25 AS ok FROM s)""")
def m14(spark, d):
    return R.position_share(order_table(spark, d))


@query("m15_whitelist", "id# symbol ok", OD + ", result AS (SELECT id, symbol, symbol IN ('S1', 'S3', 'S5') AS ok FROM od)")
def m15(spark, d):
    allowed = table(spark, d, "nation").where("n_nationkey in (1, 3, 5)").select(F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("symbol"))
    return R.whitelist(order_table(spark, d), allowed)


@query("m16_trading_hours", "seq# ok", EVENTS + """, l AS (SELECT seq, timezone('America/New_York', timezone('UTC', ts)) AS t FROM ev),
result AS (SELECT seq, isodow(t) < 6 AND strftime(t, '%Y-%m-%d') NOT IN ('2024-01-01', '2024-01-15') AND t::TIME >= TIME '09:30' AND t::TIME < TIME '16:00' AS ok FROM l)""")
def m16(spark, d):
    return R.trading_hours(events(spark, d))
