"""Ledger and orders."""

from pyspark.sql import functions as F

from ..operators import ledger as L
from .inputs import BARS, EVENTS, bars, events, table, ticks
from .registry import query

TRADES = EVENTS + """,
tr AS (SELECT symbol, ts, seq, CASE WHEN user_id % 3 = 0 THEN 'sell' ELSE 'buy' END AS side, volume AS qty, price, price * 0.001 AS commission, 'st' || (user_id % 4) AS strategy, user_id FROM ev)"""


def trades(spark, d):
    return events(spark, d).select("symbol", "ts", "seq", F.when(F.col("user_id") % 3 == 0, "sell").otherwise("buy").alias("side"), F.col("volume").alias("qty"), "price",
                                   (F.col("price") * 0.001).alias("commission"), F.concat(F.lit("st"), (F.col("user_id") % 4).cast("string")).alias("strategy"), "user_id")


@query("o01_average_cost", "symbol seq# position:2 avg_cost:6 realised:5 oversold", "RECURSIVE " + TRADES + """,
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS i FROM tr),
f AS (SELECT symbol, 0::BIGINT AS i, NULL::BIGINT AS seq, 0.0::DOUBLE AS position, 0.0::DOUBLE AS avg_cost, 0.0::DOUBLE AS realised FROM (SELECT DISTINCT symbol FROM n)
  UNION ALL
  SELECT n.symbol, n.i, n.seq, f.position + CASE WHEN side = 'buy' THEN qty ELSE -qty END,
    CASE WHEN side = 'buy' AND f.position + qty <> 0 THEN f.position / (f.position + qty) * avg_cost + price * qty / (f.position + qty) ELSE avg_cost END,
    CASE WHEN side = 'buy' THEN 0.0 ELSE (price - avg_cost) * qty - commission END
  FROM f JOIN n ON n.symbol = f.symbol AND n.i = f.i + 1),
result AS (SELECT symbol, seq, position, avg_cost, realised, position < 0 AS oversold FROM f WHERE i > 0)""")
def o01(spark, d):
    return L.average_cost(trades(spark, d), bin="day")


SNAP = BARS + """,
ps AS (SELECT 'C' || (o_custkey % 20) AS portfolio, p_brand AS symbol, CAST(o_orderdate AS DATE) AS ts, sum(l_quantity) AS qty, avg(l_extendedprice / l_quantity) AS avg_cost
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
mk AS (SELECT p.*, b.close AS price FROM ps p ASOF LEFT JOIN bars b ON p.symbol = b.symbol AND p.ts >= b.ts)"""


def position_rows(spark, d):
    l, o, p = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "part")
    x = l.join(o, l.l_orderkey == o.o_orderkey).join(p, l.l_partkey == p.p_partkey)
    return x.groupBy(F.concat(F.lit("C"), (F.col("o_custkey") % 20).cast("string")).alias("portfolio"), F.col("p_brand").alias("symbol"), F.to_date("o_orderdate").alias("ts")).agg(
        F.sum("l_quantity").alias("qty"), F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("avg_cost"))


@query("o02_equity_snapshots", "portfolio ts! market_value:3 unrealised:3", SNAP + """, g AS (
  SELECT portfolio, ts, sum(qty * price) AS mv, sum(qty * (price - avg_cost)) AS un FROM mk GROUP BY portfolio, ts),
result AS (SELECT portfolio, ts, ln(mv) AS market_value, un / mv AS unrealised FROM g)""")
def o02(spark, d):
    prices = bars(spark, d).select("symbol", "ts", F.col("close").alias("price"))
    e = L.equity_snapshots(position_rows(spark, d), prices)
    return e.withColumns({"unrealised": F.col("unrealised") / F.col("market_value"), "market_value": F.log("market_value")})


@query("o03_daily_pnl", "portfolio day! cumulative:6 daily:6", EVENTS + """,
l AS (SELECT symbol AS portfolio, CAST(ts AS DATE) AS day, arg_max(price, ts) AS cumulative FROM ev GROUP BY 1, 2),
result AS (SELECT *, cumulative - coalesce(lag(cumulative) OVER (PARTITION BY portfolio ORDER BY day), 0) AS daily FROM l)""")
def o03(spark, d):
    return L.daily_pnl(events(spark, d).select(F.col("symbol").alias("portfolio"), "ts", F.col("price").alias("total")))


PNL = """pn AS (SELECT p_brand AS symbol, 'st' || (l_suppkey % 4) AS strategy, l_extendedprice * (l_discount - 0.05) AS pnl, l_extendedprice AS cost_basis FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def pnl_rows(spark, d):
    l, p = table(spark, d, "lineitem"), table(spark, d, "part")
    return l.join(p, l.l_partkey == p.p_partkey).select(
        F.col("p_brand").alias("symbol"), F.concat(F.lit("st"), (F.col("l_suppkey") % 4).cast("string")).alias("strategy"),
        (F.col("l_extendedprice") * (F.col("l_discount") - 0.05)).alias("pnl"), F.col("l_extendedprice").alias("cost_basis"))


for _by, _n in (("strategy", "o04_attribution_by_strategy"), ("symbol", "o04_attribution_by_asset")):
    query(_n, f"{_by} pnl:2 return_pct:8", PNL + f", result AS (SELECT {_by}, sum(pnl) AS pnl, sum(pnl) / sum(cost_basis) * 100 AS return_pct FROM pn GROUP BY {_by})")(
        lambda spark, d, by=_by: L.attribution(pnl_rows(spark, d), by).orderBy(F.desc("pnl")))


@query("o05_performance_summary", "portfolio equity:2 unrealised:2 realised:2 total_pnl:2 return_pct:6 positions#", """
x AS (SELECT 'C' || (o_custkey % 20) AS portfolio, l_quantity AS qty, l_extendedprice / l_quantity AS price, l_extendedprice * (1 - l_discount) / l_quantity AS avg_cost, l_tax * l_extendedprice AS realised
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
g AS (SELECT portfolio, sum(qty * price) + 5000 AS equity, sum(qty * (price - avg_cost)) AS unrealised, sum(realised) AS realised, count(CASE WHEN qty <> 0 THEN 1 END) AS positions FROM x GROUP BY portfolio),
result AS (SELECT *, unrealised + realised AS total_pnl, (equity - 1000000) / 1000000 * 100 AS return_pct FROM g)""")
def o05(spark, d):
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    x = l.join(o, l.l_orderkey == o.o_orderkey).select(
        F.concat(F.lit("C"), (F.col("o_custkey") % 20).cast("string")).alias("portfolio"), F.col("l_quantity").alias("qty"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), (F.col("l_extendedprice") * (1 - F.col("l_discount")) / F.col("l_quantity")).alias("avg_cost"),
        (F.col("l_tax") * F.col("l_extendedprice")).alias("realised"))
    return L.performance_summary(x, 1_000_000.0, 5_000.0)


@query("o06_trade_filter", "symbol seq# side strategy qty:2 price:2", TRADES + """, result AS (SELECT * FROM tr
  WHERE symbol = 'click' AND strategy = 'st1' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20')""")
def o06(spark, d):
    return L.trade_filter(trades(spark, d), "click", "st1", "2024-01-05", "2024-01-20")


@query("o07_trade_summary", "strategy trades# buys# sells# volume:2 notional:2 mean_notional:4 commission:4 symbols# strategies#", TRADES + """, result AS (
  SELECT strategy, count(*) AS trades, count(CASE WHEN side = 'buy' THEN 1 END) AS buys, count(CASE WHEN side = 'sell' THEN 1 END) AS sells, sum(qty) AS volume, sum(qty * price) AS notional,
  avg(qty * price) AS mean_notional, sum(commission) AS commission, count(DISTINCT symbol) AS symbols, count(DISTINCT strategy) AS strategies FROM tr GROUP BY strategy)""")
def o07(spark, d):
    return L.trade_summary(trades(spark, d), ["strategy"])


@query("o08_reconcile", "symbol expected:2 actual:2 difference:2", TRADES + """,
e AS (SELECT symbol, sum(CASE WHEN side = 'buy' THEN qty ELSE -qty END) AS expected FROM tr WHERE symbol <> 'view' GROUP BY symbol),
a AS (SELECT symbol, sum(qty) AS actual FROM tr WHERE symbol <> 'error' GROUP BY symbol),
result AS (SELECT symbol, coalesce(expected, 0) AS expected, coalesce(actual, 0) AS actual, coalesce(actual, 0) - coalesce(expected, 0) AS difference FROM e FULL JOIN a USING (symbol)
  WHERE coalesce(actual, 0) <> coalesce(expected, 0))""")
def o08(spark, d):
    t = trades(spark, d)
    return L.reconcile(t.where("symbol <> 'view'"), t.where("symbol <> 'error'").groupBy("symbol").agg(F.sum("qty").alias("qty")))


@query("o09_order_stats", "priority orders# pending# filled# cancelled# fill_rate:8", """
o AS (SELECT o_orderpriority AS priority, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'pending' ELSE 'cancelled' END AS status FROM orders),
result AS (SELECT priority, count(*) AS orders, count(CASE WHEN status = 'pending' THEN 1 END) AS pending, count(CASE WHEN status = 'filled' THEN 1 END) AS filled,
  count(CASE WHEN status = 'cancelled' THEN 1 END) AS cancelled, avg(CASE WHEN status = 'filled' THEN 1.0 ELSE 0.0 END) AS fill_rate FROM o GROUP BY priority)""")
def o09(spark, d):
    s = F.when(F.col("o_orderstatus") == "F", "filled").when(F.col("o_orderstatus") == "O", "pending").otherwise("cancelled")
    return L.order_stats(table(spark, d, "orders").select(F.col("o_orderpriority").alias("priority"), s.alias("status")), ["priority"])


@query("o10_order_history", "order_id# symbol ts@ status", EVENTS + """,
u AS (SELECT user_id AS order_id, symbol, ts, seq, CASE CAST(volume AS BIGINT) % 3 WHEN 0 THEN 'filled' WHEN 1 THEN 'pending' ELSE 'cancelled' END AS status FROM ev),
result AS (SELECT order_id, arg_max(symbol, seq) AS symbol, max(ts) AS ts, arg_max(status, seq) AS status FROM u GROUP BY order_id)""")
def o10(spark, d):
    k = F.col("volume").cast("long") % 3
    return L.order_history(events(spark, d).select(F.col("user_id").alias("order_id"), "symbol", "ts", "seq",
                                                   F.when(k == 0, "filled").when(k == 1, "pending").otherwise("cancelled").alias("status")))
