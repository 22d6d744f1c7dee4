"""Backtests and rebalancing."""

from pyspark.sql import functions as F

from ..operators import backtest as B
from ..operators import strategies as S
from ..session import durable
from .family_h import PANEL, panel
from .family_j import MOMENTUM, pairs
from .inputs import BARS, RETURNS, bars, returns
from .registry import query

W = "PARTITION BY symbol ORDER BY ts"


def backtest_sql(part: str = "symbol", src: str = "sig") -> str:
    w = f"PARTITION BY {part} ORDER BY ts"
    return f"""b1 AS (SELECT *, coalesce(last_value(CASE WHEN signal > 0 THEN 1 WHEN signal < 0 THEN 0 END IGNORE NULLS) OVER ({w} ROWS UNBOUNDED PRECEDING), 0) AS want FROM {src}),
b2 AS (SELECT *, coalesce(lag(want) OVER ({w}), 0) AS held, coalesce(lag(want, 2) OVER ({w}), 0) AS was,
  greatest(1, floor(10000.0 / lag(close) OVER ({w}))) AS size FROM b1),
b3 AS (SELECT *, last_value(CASE WHEN held = 1 AND was = 0 THEN size END IGNORE NULLS) OVER ({w} ROWS UNBOUNDED PRECEDING) AS lot FROM b2),
b4 AS (SELECT *, CASE WHEN held = 1 AND was = 0 THEN lot WHEN held = 0 AND was = 1 THEN -lot END AS fill_qty FROM b3),
b5 AS (SELECT *, CASE WHEN fill_qty > 0 THEN open * 1.0005 WHEN fill_qty < 0 THEN open * 0.9995 END AS fill_price FROM b4),
b6 AS (SELECT *, CASE WHEN fill_qty IS NOT NULL THEN 1 + fill_price * abs(fill_qty) * 0.001 END AS fee FROM b5),
pos AS (SELECT *, sum(coalesce(-fill_qty * fill_price - fee, 0)) OVER ({w} ROWS UNBOUNDED PRECEDING) + CASE WHEN held = 1 THEN lot ELSE 0 END * close AS profit FROM b6)"""


BT = BARS + f", {MOMENTUM},\n{backtest_sql()}"
EQ = f"""dl AS (SELECT ts, profit - coalesce(lag(profit) OVER ({W}), 0) AS d FROM pos),
eq AS (SELECT ts, 100000 + sum(sum(d)) OVER (ORDER BY ts) AS equity FROM dl GROUP BY ts)"""
COSTS = {"slippage": (0.0, 0.0005), "fees": (1.0, 0.0, 0.001)}


def positions(spark, d):
    return durable(B.positions(S.momentum(bars(spark, d)).select("symbol", "ts", "open", "close", "signal"), **COSTS))


@query("k01_signal_backtest", "ts! growth:7", BT + f", {EQ}, result AS (SELECT ts, ln(equity / 100000) AS growth FROM eq)")
def k01(spark, d):
    return B.equity(positions(spark, d)).withColumn("growth", F.log(F.col("equity") / 100000))


@query("k02_fills_and_costs", "symbol ts! side qty:1 fill_price:8 fee:7", BT + """, result AS (SELECT symbol, ts, CASE WHEN fill_qty > 0 THEN 'buy' ELSE 'sell' END AS side,
  abs(fill_qty) AS qty, ln(fill_price) AS fill_price, ln(fee) AS fee FROM pos WHERE fill_qty IS NOT NULL)""")
def k02(spark, d):
    return B.fills(positions(spark, d)).withColumns({"qty": F.abs("fill_qty"), "fill_price": F.log("fill_price"), "fee": F.log("fee")})


ORDERS = BARS + """,
od AS (SELECT row_number() OVER (ORDER BY symbol, ts) AS rid, symbol || '/' || ts AS id, symbol, ts, close, CAST(volume AS BIGINT) AS v FROM bars),
orders_ AS (SELECT id, symbol, ts, CASE WHEN v % 2 = 0 THEN 'buy' ELSE 'sell' END AS side,
  CASE WHEN v % 3 = 0 THEN 'market' WHEN v % 3 = 1 THEN 'limit' ELSE 'stop' END AS kind,
  close * CASE WHEN v % 3 = 1 THEN CASE WHEN v % 2 = 0 THEN 0.2 ELSE 5 END ELSE CASE WHEN v % 2 = 0 THEN 5 ELSE 0.2 END END AS price FROM od)"""


FILLS = """,
h AS (SELECT o.id, o.symbol, b.ts, CASE WHEN kind = 'market' THEN open WHEN kind = 'limit' THEN CASE WHEN side = 'buy' THEN least(open, price) ELSE greatest(open, price) END
  ELSE CASE WHEN side = 'buy' THEN greatest(open, price) ELSE least(open, price) END END AS px
  FROM orders_ o JOIN bars b ON o.symbol = b.symbol AND b.ts > o.ts
  AND (kind = 'market' OR (kind = 'limit' AND CASE WHEN side = 'buy' THEN low <= price ELSE high >= price END)
    OR (kind = 'stop' AND CASE WHEN side = 'buy' THEN high >= price ELSE low <= price END))),
result AS (SELECT id, any_value(symbol) AS symbol, min(ts) AS fill_ts, ln(arg_min(px, ts)) AS fill_price FROM h GROUP BY id)"""


@query("k03_order_fills", "id symbol fill_ts! fill_price:8", ORDERS + FILLS)
def k03(spark, d):
    b = bars(spark, d)
    v = F.col("volume").cast("long")
    buy = v % 2 == 0
    o = b.select(
        F.concat_ws("/", "symbol", F.col("ts").cast("string")).alias("id"), "symbol", "ts", F.when(buy, "buy").otherwise("sell").alias("side"),
        F.when(v % 3 == 0, "market").when(v % 3 == 1, "limit").otherwise("stop").alias("kind"),
        (F.col("close") * F.when(v % 3 == 1, F.when(buy, 0.2).otherwise(5.0)).otherwise(F.when(buy, 5.0).otherwise(0.2))).alias("price"))
    return B.order_fills(o, b).withColumn("fill_price", F.log("fill_price"))


def metrics_sql(group: str) -> str:
    g = f"{group}, " if group else ""
    by = f"GROUP BY {group}" if group else ""
    part = f"PARTITION BY {group} " if group else ""
    key = group or "symbol"
    join = f"LEFT JOIN tm USING ({group})" if group else "CROSS JOIN tm"
    return f"""er AS (SELECT *, equity / lag(equity) OVER ({part}ORDER BY ts) - 1 AS r, (equity - max(equity) OVER ({part}ORDER BY ts)) / max(equity) OVER ({part}ORDER BY ts) AS dd FROM eq),
em AS (SELECT {g}arg_max(equity, ts) / 100000 - 1 AS total_return, pow(1 + avg(r), 252) - 1 AS annual_return, stddev_samp(r) * sqrt(252) AS annual_vol,
  CASE WHEN stddev_samp(r) > 0 THEN avg(r - 0.05 / 252) / stddev_samp(r) * sqrt(252) ELSE 0 END AS sharpe, min(dd) AS max_drawdown FROM er {by}),
fl AS (SELECT *, CASE WHEN fill_qty < 0 THEN fill_price * -fill_qty - fee END AS pr,
  CASE WHEN fill_qty < 0 THEN (fill_price - lag(fill_price) OVER (PARTITION BY {key} ORDER BY ts)) * -fill_qty END AS gain FROM pos WHERE fill_qty IS NOT NULL),
tm AS (SELECT {g}count(*) AS trades, coalesce(avg(CASE WHEN pr > 0 THEN 1.0 WHEN pr IS NOT NULL THEN 0.0 END), 0) AS win_rate,
  avg(CASE WHEN gain > 0 THEN 1.0 WHEN gain IS NOT NULL THEN 0.0 END) AS realised_win_rate FROM fl {by}),
result AS (SELECT * FROM em {join})"""


@query("k04_backtest_metrics", "total_return:7 annual_vol:7 sharpe:6 max_drawdown:7 win_rate:6 realised_win_rate:6 trades#", BT + f", {EQ}, {metrics_sql('')}")
def k04(spark, d):
    p = positions(spark, d)
    return B.metrics(durable(B.equity(p)), p)


@query("k05_walk_forward", "symbol split# role total_return:7 annual_vol:6 max_drawdown:7 trades#", BARS + f""", {MOMENTUM},
n AS (SELECT *, row_number() OVER ({W}) - 1 AS p, CAST(floor(count(*) OVER (PARTITION BY symbol) / 5) AS BIGINT) AS wsize FROM sig),
sp0 AS (SELECT *, p // wsize + 1 AS split FROM n WHERE p // wsize < 5),
sp AS (SELECT *, CASE WHEN p - (split - 1) * wsize < floor(wsize * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS role FROM sp0 WHERE wsize >= 20),
{backtest_sql('symbol, split, role', 'sp').replace('open * 1.0005', 'open').replace('open * 0.9995', 'open').replace('1 + fill_price * abs(fill_qty) * 0.001', '0')},
eq AS (SELECT symbol, split, role, ts, 100000 + profit AS equity FROM pos), {metrics_sql('symbol, split, role')}""")
def k05(spark, d):
    return B.walk_forward(durable(S.momentum(bars(spark, d)).select("symbol", "ts", "open", "close", "signal")))


@query("k06_pair_backtest", "pair total_return:6 sharpe:6 max_drawdown:6 win_rate:6")
def k06(spark, d):
    p = durable(pairs(spark, d).select("pair", "ts", "y", "x"))
    return B.pair_performance(durable(B.pair_backtest(p)))


@query("k07_pair_portfolio", "total_return:6 sharpe:6 max_drawdown:6 win_rate:6")
def k07(spark, d):
    p = durable(pairs(spark, d).select("pair", "ts", "y", "x"))
    net = durable(B.pair_portfolio(B.pair_backtest(p)))
    return B.pair_performance(net, [])


@query("k07_pair_ranking", "pair sharpe:6")
def k07b(spark, d):
    p = durable(pairs(spark, d).select("pair", "ts", "y", "x"))
    return B.pair_performance(durable(B.pair_backtest(p))).orderBy(F.desc("sharpe"), "pair")


LS = PANEL + """, pv AS (SELECT * FROM panel WHERE factor IS NOT NULL),
t AS (SELECT quantile_cont(factor, 0.8) AS hi, quantile_cont(factor, 0.2) AS lo FROM pv),
sg AS (SELECT symbol, ts, fwd_1, CASE WHEN factor >= hi THEN 1 ELSE 0 END - CASE WHEN factor <= lo THEN 1 ELSE 0 END AS signal FROM pv, t)"""


@query("k08_long_short_signal", "symbol ts! signal#", LS + ", result AS (SELECT * FROM sg)")
def k08(spark, d):
    p = panel(spark, d).where("factor is not null")
    return B.long_short(p, "factor")


@query("k08_long_short_backtest", "total_return:4 mean_return:6 std_return:6 sharpe:6 hit_rate:8 trades#", LS + """, x AS (SELECT *, signal * fwd_1 AS x FROM sg),
result AS (SELECT sum(x) AS total_return, avg(x) AS mean_return, stddev_samp(x) AS std_return, avg(x) / stddev_samp(x) AS sharpe,
  avg(CASE WHEN x > 0 THEN 1.0 WHEN x IS NOT NULL THEN 0.0 END) AS hit_rate, count(CASE WHEN signal <> 0 THEN 1 END) AS trades FROM x)""")
def k08b(spark, d):
    p = durable(panel(spark, d).where("factor is not null"))
    return B.long_short_backtest(B.long_short(p, "factor"), "fwd_1")


WEIGHTS = BARS + """,
pw AS (SELECT 'P' || (o_custkey % 5) AS portfolio, p_brand AS symbol, sum(l_quantity) AS q, sum(l_quantity * l_discount) AS qd FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
cur AS (SELECT portfolio, symbol, q / sum(q) OVER (PARTITION BY portfolio) AS w FROM pw WHERE symbol <> 'Brand#3'),
tgt AS (SELECT portfolio, symbol, qd / sum(qd) OVER (PARTITION BY portfolio) AS w FROM pw WHERE symbol <> 'Brand#7'),
px AS (SELECT symbol, arg_max(close, ts) AS price FROM bars GROUP BY symbol),
tr AS (SELECT portfolio, symbol, coalesce(t.w, 0) - coalesce(c.w, 0) AS diff, price, (coalesce(t.w, 0) - coalesce(c.w, 0)) * 1e6 AS trade_value
  FROM cur c FULL JOIN tgt t USING (portfolio, symbol) JOIN px USING (symbol) WHERE abs(coalesce(t.w, 0) - coalesce(c.w, 0)) >= 1e-6)"""


def weights(spark, d):
    """Current and target weights per portfolio from traded quantities."""
    from .inputs import table
    l, o, p = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "part")
    x = l.join(o, l.l_orderkey == o.o_orderkey).join(p, l.l_partkey == p.p_partkey)
    x = x.groupBy(F.concat(F.lit("P"), (F.col("o_custkey") % 5).cast("string")).alias("portfolio"), F.col("p_brand").alias("symbol")).agg(
        F.sum("l_quantity").alias("q"), F.sum(F.col("l_quantity") * F.col("l_discount")).alias("qd"))
    norm = lambda f, c: f.join(f.groupBy("portfolio").agg(F.sum(c).alias("t")), "portfolio").select("portfolio", "symbol", (F.col(c) / F.col("t")).alias("w"))
    return norm(x.where("symbol <> 'Brand#3'"), "q"), norm(x.where("symbol <> 'Brand#7'"), "qd")


def trades(spark, d):
    cur, tgt = weights(spark, d)
    px = bars(spark, d).groupBy("symbol").agg(F.max_by("close", "ts").alias("price"))
    return B.rebalance_trades(cur, tgt, px, 1e6)


@query("k09_rebalance_trades", "portfolio symbol side diff:8 trade_value:4 qty:6", WEIGHTS + """, result AS (SELECT *, CASE WHEN diff > 0 THEN 'buy' ELSE 'sell' END AS side,
  abs(trade_value) / price AS qty FROM tr)""")
def k09(spark, d):
    return trades(spark, d)


COST = "CASE WHEN trade_value = 0 THEN 0 ELSE greatest(abs(trade_value) * 0.001 + 2, 5) + abs(trade_value) * 0.0005 END"


@query("k10_transaction_costs", "portfolio symbol cost:6", WEIGHTS + f", result AS (SELECT portfolio, symbol, {COST} AS cost FROM tr)")
def k10(spark, d):
    return trades(spark, d).withColumn("cost", B.trade_cost(F.col("trade_value"), fixed=2.0, least=5.0))


@query("k11_cost_aware_rebalance", "portfolio cost:5 benefit:4 net_benefit:8 rebalance", WEIGHTS + f""",
g AS (SELECT portfolio, sum({COST}) AS cost, sum(abs(diff)) * 1e6 AS benefit FROM tr GROUP BY portfolio),
result AS (SELECT *, (benefit - cost) / 1e6 AS net_benefit, (benefit - cost) / 1e6 > 0.001 AS rebalance FROM g)""")
def k11(spark, d):
    return B.cost_aware(trades(spark, d), 1e6, fixed=2.0, least=5.0)


@query("k12_rebalance_schedule", "kind ts!", BARS + """, dt AS (SELECT DISTINCT ts FROM bars), p AS (SELECT ts, lag(ts) OVER (ORDER BY ts) AS p FROM dt),
result AS (SELECT 'monthly' AS kind, ts FROM p WHERE date_trunc('month', ts) <> date_trunc('month', p)
  UNION ALL SELECT 'quarterly', ts FROM p WHERE date_trunc('quarter', ts) <> date_trunc('quarter', p)
  UNION ALL SELECT 'annual', ts FROM p WHERE date_trunc('year', ts) <> date_trunc('year', p))""")
def k12(spark, d):
    dates = bars(spark, d).select("ts").distinct()
    out = [B.schedule(dates, k).withColumn("kind", F.lit(k)) for k in ("monthly", "quarterly", "annual")]
    return out[0].unionByName(out[1]).unionByName(out[2])


def book(spark, d):
    return weights(spark, d)[1].where("portfolio = 'P0'").select("symbol", "w")


@query("k13_rebalance_backtest", "kind ts! growth:6", RETURNS + """,
pw AS (SELECT p_brand AS symbol, sum(l_quantity * l_discount) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  WHERE o_custkey % 5 = 0 AND p_brand <> 'Brand#7' GROUP BY 1), wt AS (SELECT symbol, q / sum(q) OVER () AS w FROM pw),
g AS (SELECT d.ts, wt.symbol, w, coalesce(ret, 0) AS ret, k.kind, date_trunc(k.unit, d.ts) AS seg
  FROM (SELECT DISTINCT ts FROM rets WHERE symbol IN (SELECT symbol FROM wt)) d CROSS JOIN wt CROSS JOIN (VALUES ('monthly', 'month'), ('quarterly', 'quarter')) k(kind, unit)
  LEFT JOIN rets r ON r.ts = d.ts AND r.symbol = wt.symbol),
c AS (SELECT *, product(1 + ret) OVER (PARTITION BY kind, symbol, seg ORDER BY ts) AS g FROM g),
p AS (SELECT kind, seg, ts, sum(w * g) AS growth FROM c GROUP BY ALL),
l AS (SELECT kind, seg, max(ts) AS ts FROM p GROUP BY kind, seg),
e AS (SELECT c.kind, c.seg, any_value(growth) * (1 - 0.001 * sum(abs(w * g / growth - w))) AS mult FROM c JOIN l USING (kind, seg, ts) JOIN p USING (kind, seg, ts) GROUP BY c.kind, c.seg),
s AS (SELECT kind, seg, coalesce(sum(ln(mult)) OVER (PARTITION BY kind ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM e),
result AS (SELECT kind, ts, start + ln(growth) AS growth FROM p JOIN s USING (kind, seg))""")
def k13(spark, d):
    r = durable(returns(spark, d))
    w = durable(book(spark, d))
    out = [B.rebalance_backtest(r, w, k).select(F.lit(k).alias("kind"), "ts", F.log(F.col("value") / 100000).alias("growth")) for k in ("monthly", "quarterly")]
    return out[0].unionByName(out[1])


@query("k13_threshold_rebalance", "portfolio ts! value:2 rebalanced")
def k13b(spark, d):
    return B.threshold_rebalance_backtest(returns(spark, d).withColumn("ret", F.tanh("ret") * 0.05), weights(spark, d)[1])
