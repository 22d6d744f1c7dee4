"""Positions, profit and loss, and order tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core.asof import asof
from ..core.slices import affine_run, over_rows, spread
from ..session import durable

C = F.col


def average_cost(trades: DataFrame, keys: Sequence[str] = ("symbol",), bin="month") -> DataFrame:
    """Position, average cost and realised profit after each trade (symbol, ts, seq, side, qty, price, commission).

    A buy moves the average: avg = avg * q_prev / q + price * dq / q; a sale keeps it. That is an
    affine recursion, run in parallel over chunks. A sale beyond the position is flagged.
    """
    buy = C("side") == "buy"
    signed = F.when(buy, C("qty")).otherwise(-C("qty"))
    d = spread(trades, keys=keys, order=["ts", "seq"], bin=bin).run(position=("sum", signed)).done()
    d = durable(d.withColumn("_before", C("position") - signed))
    a = F.when(buy & (C("position") != 0), F.when(C("_before") == 0, 0.0).otherwise(C("_before") / C("position"))).otherwise(1.0)
    b = F.when(buy & (C("position") != 0), C("price") * C("qty") / C("position")).otherwise(0.0)
    d = affine_run(d, a, b, "avg_cost", keys, ("ts", "seq"), bin)
    d = d.withColumn("realised", F.when(~buy, (C("price") - C("avg_cost")) * C("qty") - C("commission")).otherwise(0.0))
    return d.withColumn("oversold", C("position") < 0).drop("_before")


def equity_snapshots(positions: DataFrame, prices: DataFrame, cash: float = 0.0) -> DataFrame:
    """Equity and unrealised profit per (portfolio, ts): positions (portfolio, symbol, ts, qty, avg_cost) marked
    at the latest price at or before their time."""
    d = asof(positions, prices, ["symbol"], "ts", ["price"])
    g = d.groupBy("portfolio", "ts").agg(F.sum(C("qty") * C("price")).alias("market_value"), F.sum(C("qty") * (C("price") - C("avg_cost"))).alias("unrealised"))
    return g.withColumn("equity", C("market_value") + cash)


def daily_pnl(snapshots: DataFrame, total: str = "total", by: Sequence[str] = ("portfolio",)) -> DataFrame:
    """Last snapshot per day and its first difference (the first day counts whole)."""
    by = list(by)
    d = snapshots.groupBy(*by, F.to_date("ts").alias("day")).agg(F.max_by(total, "ts").alias("cumulative"))
    f = lambda x, w: x.withColumn("daily", C("cumulative") - F.coalesce(F.lag("cumulative").over(w), F.lit(0.0)))
    return over_rows(d, f, back=1, keys=by, order=["day"])


def attribution(positions: DataFrame, by: str) -> DataFrame:
    g = positions.groupBy(by).agg(F.sum("pnl").alias("pnl"), F.sum("cost_basis").alias("cost_basis"))
    return g.withColumn("return_pct", F.when(C("cost_basis") > 0, C("pnl") / C("cost_basis") * 100).otherwise(0.0))


def performance_summary(positions: DataFrame, initial: float, cash: float) -> DataFrame:
    """One row per portfolio from (portfolio, qty, avg_cost, price, realised)."""
    g = positions.groupBy("portfolio").agg(F.sum(C("qty") * C("price")).alias("_mv"), F.sum(C("qty") * (C("price") - C("avg_cost"))).alias("unrealised"),
                                           F.sum("realised").alias("realised"), F.count(F.when(C("qty") != 0, 1)).alias("positions"))
    g = g.withColumns({"initial": F.lit(initial), "cash": F.lit(cash), "equity": C("_mv") + cash, "total_pnl": C("unrealised") + C("realised")})
    return g.withColumn("return_pct", (C("equity") - initial) / initial * 100).drop("_mv")


def trade_filter(trades: DataFrame, symbol: str | None = None, strategy: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    d = trades
    for cond in (symbol and C("symbol") == symbol, strategy and C("strategy") == strategy, start and C("ts") >= F.lit(start).cast("timestamp"),
                 end and C("ts") <= F.lit(end).cast("timestamp")):
        if cond is not None and not isinstance(cond, str):
            d = d.where(cond)
    return d


def trade_summary(trades: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    n = C("qty") * C("price")
    return trades.groupBy(*by).agg(
        F.count("*").alias("trades"), F.count_if(C("side") == "buy").alias("buys"), F.count_if(C("side") == "sell").alias("sells"),
        F.sum("qty").alias("volume"), F.sum(n).alias("notional"), F.avg(n).alias("mean_notional"), F.sum("commission").alias("commission"),
        F.countDistinct("symbol").alias("symbols"), F.countDistinct("strategy").alias("strategies"))


def reconcile(filled: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected (signed filled) against actual quantity per symbol; only differences are kept."""
    e = filled.groupBy("symbol").agg(F.sum(F.when(C("side") == "buy", C("qty")).otherwise(-C("qty"))).alias("expected"))
    d = e.join(actual.select("symbol", C("qty").alias("actual")), "symbol", "full").fillna(0, ["expected", "actual"])
    return d.withColumn("difference", C("actual") - C("expected")).where("difference <> 0")


def order_stats(orders: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    s = {k: F.count_if(C("status") == k).alias(k) for k in ("pending", "filled", "cancelled")}
    return orders.groupBy(*by).agg(F.count("*").alias("orders"), *s.values(), F.avg(F.when(C("status") == "filled", 1.0).otherwise(0.0)).alias("fill_rate"))


def order_history(updates: DataFrame, symbol: str | None = None) -> DataFrame:
    """Latest state per order id, newest first. The order comes from (ts, seq)."""
    d = updates if symbol is None else updates.where(C("symbol") == symbol)
    cols = [c for c in d.columns if c != "order_id"]
    last = d.groupBy("order_id").agg(F.max_by(F.struct(*cols), F.struct("ts", "seq")).alias("s"))
    return last.select("order_id", *[C(f"s.{c}").alias(c) for c in cols]).orderBy(F.desc("ts"), "order_id")


def pending(history: DataFrame) -> DataFrame:
    return history.where("status = 'pending'")
