"""Backtests and rebalancing as table operators."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core.asof import asof
from ..core.crossing import first_crossing
from ..core.folds import fold_sorted
from ..core.ranking import quantiles
from ..core.slices import match, over_rows, spread
from ..session import durable
from . import strategies as S

C = F.col


def slip(price: Column, side_buy: Column, fixed: float = 0.0, pct: float = 0.0) -> Column:
    """Buyers pay the slippage, sellers give it up."""
    s = F.lit(fixed) + price * pct
    return F.when(side_buy, price + s).otherwise(price - s)


def commission(price: Column, qty: Column, flat: float = 0.0, per_share: float = 0.0, pct: float = 0.0) -> Column:
    return F.lit(flat) + qty * per_share + price * qty * pct


def positions(signals: DataFrame, keys: Sequence[str] = ("symbol",), capital: float = 100_000.0, slippage: tuple = (0.0, 0.0),
              fees: tuple = (0.0, 0.0, 0.0)) -> DataFrame:
    """Long/flat positions, fills at the next open and the running profit of each key.

    An order follows the signal of the bar before: buy a tenth of the capital (at least one share,
    sized at that bar's close) when flat, sell everything when long.
    """
    s = spread(signals, back=3, keys=keys)
    s = s.run(_want=("last", F.when(C("signal") > 0, 1).when(C("signal") < 0, 0)))
    w = s.w
    s = s.roll(lambda d, w: d.withColumns({
        "held": F.coalesce(F.lag("_want", 1).over(w), F.lit(0)), "_was": F.coalesce(F.lag("_want", 2).over(w), F.lit(0)),
        "_size": F.greatest(F.lit(1), F.floor(F.lit(capital * 0.1) / F.lag("close", 1).over(w))).cast("double")}))
    s = s.col(_buy=(C("held") == 1) & (C("_was") == 0), _sell=(C("held") == 0) & (C("_was") == 1))
    # each running aggregate reads its input twice: cut the lineage between them
    s = s._with(durable(s.df)).run(_lot=("last", F.when(C("_buy"), C("_size"))))
    price = slip(C("open"), C("_buy"), *slippage)
    s = s.col(fill_qty=F.when(C("_buy"), C("_lot")).when(C("_sell"), -C("_lot")), fill_price=F.when(C("_buy") | C("_sell"), price))
    s = s.col(fee=F.when(C("fill_qty").isNotNull(), commission(C("fill_price"), F.abs("fill_qty"), *fees)))
    s = s.run(_cash=("sum", F.coalesce(-C("fill_qty") * C("fill_price") - C("fee"), F.lit(0.0))))
    s = s.col(qty=F.when(C("held") == 1, C("_lot")).otherwise(0.0))
    s = s.col(profit=C("_cash") + C("qty") * C("close"))
    return s.done("_want", "_was", "_size", "_buy", "_sell", "_lot", "held", "_cash")


def fills(pos: DataFrame) -> DataFrame:
    return pos.where("fill_qty is not null").withColumn("side", F.when(C("fill_qty") > 0, "buy").otherwise("sell"))


def equity(pos: DataFrame, keys: Sequence[str] = ("symbol",), group: Sequence[str] = (), capital: float = 100_000.0) -> DataFrame:
    """Capital plus the summed profit per date; a key without a bar keeps its last profit."""
    step = over_rows(pos, lambda d, w: d.withColumn("_d", C("profit") - F.coalesce(F.lag("profit").over(w), F.lit(0.0))), back=1, keys=keys)
    per = step.groupBy(*group, "ts").agg(F.sum("_d").alias("_d"))
    return spread(per, keys=list(group)).run(_e=("sum", C("_d"))).col(equity=C("_e") + capital).done("_e", "_d")


def metrics(eq: DataFrame, pos: DataFrame, group: Sequence[str] = (), keys: Sequence[str] = ("symbol",), risk_free: float = 0.05,
            capital: float = 100_000.0) -> DataFrame:
    """Performance of an equity curve.

    win_rate and profit_factor use sale proceeds; realised_win_rate uses realised profit.
    """
    group = list(group)
    s = spread(eq, back=1, keys=group).run(_peak=("max", C("equity")))
    d = s.roll(lambda x, w: x.withColumn("_r", C("equity") / F.lag("equity").over(w) - 1)).done()
    ex = C("_r") - risk_free / 252
    m = d.groupBy(*group).agg(
        (F.max_by("equity", "ts") / capital - 1).alias("total_return"), (F.pow(1 + F.avg("_r"), F.lit(252.0)) - 1).alias("annual_return"),
        (F.stddev_samp("_r") * F.sqrt(F.lit(252.0))).alias("annual_vol"),
        F.when(F.stddev_samp(ex) > 0, F.avg(ex) / F.stddev_samp(ex) * F.sqrt(F.lit(252.0))).otherwise(0.0).alias("sharpe"),
        F.min((C("equity") - C("_peak")) / C("_peak")).alias("max_drawdown"))
    f = fills(pos)
    f = spread(f, back=1, keys=keys).roll(lambda x, w: x.withColumn("_entry", F.lag("fill_price").over(w))).done()
    sell = C("side") == "sell"
    proceeds = F.when(sell, C("fill_price") * -C("fill_qty") - C("fee"))
    gain = F.when(sell, (C("fill_price") - C("_entry")) * -C("fill_qty"))
    t = f.groupBy(*group).agg(
        F.count("*").alias("trades"), F.coalesce(F.avg(F.when(proceeds > 0, 1.0).when(proceeds.isNotNull(), 0.0)), F.lit(0.0)).alias("win_rate"),
        F.sum(F.when(proceeds > 0, proceeds)).alias("_w"), F.sum(F.when(proceeds < 0, -proceeds)).alias("_l"),
        F.avg(F.when(gain > 0, 1.0).when(gain.isNotNull(), 0.0)).alias("realised_win_rate"), F.sum(gain).alias("realised_pnl"))
    t = t.withColumn("profit_factor", F.when(C("_l") > 0, C("_w") / C("_l")).otherwise(F.lit(float("inf")))).drop("_w", "_l")
    return m.join(t, group, "left") if group else m.join(t)


def walk_forward_splits(bars: DataFrame, splits: int = 5, train: float = 0.7) -> DataFrame:
    """Row windows per symbol cut into train and test; short windows are skipped."""
    n = bars.groupBy("symbol").agg(F.count("*").alias("_n"))
    d = spread(bars).position("_pos").done().join(n, "symbol")
    d = d.withColumn("_size", F.floor(C("_n") / splits)).where("_size > 0")
    d = d.withColumn("split", (F.floor(C("_pos") / C("_size")) + 1).cast("long")).where(C("split") <= splits)
    cut = F.floor(C("_size") * F.lit(train))
    d = d.withColumn("role", F.when(C("_pos") - (C("split") - 1) * C("_size") < cut, "train").otherwise("test"))
    return d.where((C("_size") >= 20) & (cut >= 10) & (C("_size") - cut >= 5)).drop("_pos", "_n", "_size")


def walk_forward(signals: DataFrame, splits: int = 5, train: float = 0.7) -> DataFrame:
    """Metrics of the signal backtest on every (symbol, split, role)."""
    d = durable(walk_forward_splits(signals, splits, train))
    g = ["symbol", "split", "role"]
    pos = durable(positions(d, g))
    return metrics(durable(equity(pos, g, g)), pos, g, g)


def order_fills(orders: DataFrame, bars: DataFrame) -> DataFrame:
    """First later bar that fills each order (id, symbol, ts, side, kind, price); bars are unique per symbol and ts.

    Market orders take the next bar. A limit or stop order is a search for the first later bar whose low or high
    reaches its price: two block lookups however far away that bar is.
    """
    b = durable(spread(bars.select("symbol", "ts", "open", "high", "low")).position("pos").done())
    o = asof(orders.select("id", "symbol", "ts", "side", "kind", C("price").cast("double")), b.select("symbol", "ts", "pos"), ["symbol"], "ts", ["pos"])
    o = durable(o.withColumn("_start", F.coalesce(C("pos") + 1, F.lit(0).cast("long"))).drop("pos", "ts"))
    buy, market, limit = C("side") == "buy", C("kind") == "market", C("kind") == "limit"
    falls = (limit & buy) | (~limit & ~buy)
    low = first_crossing(b, o.where(~market & falls), ["symbol"], "low", "price", "_start", "_pos", up=False)
    high = first_crossing(b, o.where(~market & ~falls), ["symbol"], "high", "price", "_start", "_pos")
    hit = low.unionByName(high).unionByName(o.where(market).withColumn("_pos", C("_start"))).where("_pos is not null")
    hit = match(hit, b.select("symbol", C("pos").alias("_pos"), C("ts").alias("fill_ts"), "open"), ["symbol", "_pos"], "inner")
    better_low, worse_high = F.least("open", "price"), F.greatest("open", "price")
    px = F.when(market, C("open")).when(limit, F.when(buy, better_low).otherwise(worse_high)).otherwise(F.when(buy, worse_high).otherwise(better_low))
    return hit.select("id", "symbol", "fill_ts", px.alias("fill_price"))


def pair_backtest(pairs: DataFrame, cost: float = 0.001, entry: float = 2.0, exit: float = 0.5, n: int = 20, least: int = 100) -> DataFrame:
    """Per-row net returns of pairs (pair, ts, y, x): hedge from the first 60 % of rows, traded on the rest."""
    cnt = pairs.groupBy("pair").agg(F.count("*").alias("_n")).where(C("_n") >= least)
    d = spread(pairs.join(cnt, "pair"), keys=["pair"]).position("_pos").done()
    d = d.withColumn("_in", C("_pos") < F.floor(C("_n") * 0.6))
    h = d.where("_in").groupBy("pair").agg(F.regr_slope("y", "x").alias("hedge"))
    out = d.where("not _in").join(h, "pair").withColumn("spread", C("y") - C("hedge") * C("x")).drop("_pos", "_n", "_in")
    sig = S.pair_signal(out, entry, exit, n)

    def f(x, w):
        x = x.withColumns({"_ry": C("y") / F.lag("y").over(w) - 1, "_rx": C("x") / F.lag("x").over(w) - 1,
                           "_prev": F.lag("signal").over(w)})
        return x.withColumn("net", C("_prev") * (C("_ry") - C("hedge") * C("_rx")) - F.abs(C("signal") - C("_prev")) * cost)
    return over_rows(sig, f, back=1, keys=["pair"]).drop("_ry", "_rx", "_prev")


def pair_performance(net: DataFrame, keys: Sequence[str] = ("pair",)) -> DataFrame:
    keys = list(keys)
    d = net.where("net is not null")
    s = spread(d, keys=keys).run(_cum=("product", 1 + C("net"))).run(_peak=("max", C("_cum")))
    d = s.done()
    return d.groupBy(*keys).agg(
        (F.max_by("_cum", "ts") - 1).alias("total_return"),
        F.when(F.stddev_samp("net") > 0, F.avg("net") / F.stddev_samp("net") * F.sqrt(F.lit(252.0))).otherwise(0.0).alias("sharpe"),
        F.min((C("_cum") - C("_peak")) / C("_peak")).alias("max_drawdown"),
        F.avg(F.when(C("net") > 0, 1.0).otherwise(0.0)).alias("win_rate"))


def pair_portfolio(net: DataFrame) -> DataFrame:
    """Mean net return of the pairs per date."""
    return net.where("net is not null").groupBy("ts").agg(F.avg("net").alias("net"), F.count("*").alias("pairs"))


def long_short(pred: DataFrame, value: str = "prediction", top: float = 0.2, bottom: float = 0.2, by: Sequence[str] = ()) -> DataFrame:
    """+1 / -1 / 0 by quantile thresholds, over the whole sample or per group."""
    by = list(by)
    q = quantiles(pred, by, value, [1 - top, bottom], "_q").select(*by, C("_q")[0].alias("_hi"), C("_q")[1].alias("_lo"))
    d = match(pred, q, by) if by else pred.join(F.broadcast(q), F.lit(True), "left")  # one row or none without groups
    sig = F.when(C(value) >= C("_hi"), 1).otherwise(0) - F.when(C(value) <= C("_lo"), 1).otherwise(0)
    return d.withColumn("signal", F.when(C(value).isNotNull(), sig).otherwise(0)).drop("_hi", "_lo")


def long_short_backtest(signals: DataFrame, ret: str) -> DataFrame:
    x = C("signal") * C(ret)
    return signals.agg(
        F.sum(x).alias("total_return"), F.avg(x).alias("mean_return"), F.stddev_samp(x).alias("std_return"),
        F.when(F.stddev_samp(x) > 0, F.avg(x) / F.stddev_samp(x)).otherwise(0.0).alias("sharpe"),
        F.avg(F.when(x > 0, 1.0).when(x.isNotNull(), 0.0)).alias("hit_rate"), F.count(F.when(C("signal") != 0, 1)).alias("trades"))


def rebalance_trades(current: DataFrame, target: DataFrame, prices: DataFrame, value: float, least: float = 0.0, by: Sequence[str] = ("portfolio",)) -> DataFrame:
    keys = [*by, "symbol"]
    d = current.withColumnRenamed("w", "w0").join(target.withColumnRenamed("w", "w1"), keys, "full").fillna(0.0, ["w0", "w1"])
    d = d.withColumn("diff", C("w1") - C("w0")).where(F.abs("diff") >= 1e-6)
    d = d.join(prices, "symbol").withColumn("trade_value", C("diff") * value).where(F.abs("trade_value") >= least)
    return d.withColumns({"side": F.when(C("diff") > 0, "buy").otherwise("sell"), "qty": F.abs("trade_value") / C("price")})


def trade_cost(value: Column, pct: float = 0.001, fixed: float = 0.0, slippage: float = 0.0005, least: float = 0.0) -> Column:
    v = F.abs(value)
    return F.when(v == 0, 0.0).otherwise(F.greatest(v * pct + fixed, F.lit(least)) + v * slippage)


def cost_aware(trades: DataFrame, value: float, threshold: float = 0.001, by: Sequence[str] = ("portfolio",), **cost) -> DataFrame:
    g = trades.groupBy(*by).agg(F.sum(trade_cost(C("trade_value"), **cost)).alias("cost"), (F.sum(F.abs("diff")) * value).alias("benefit"))
    net = (C("benefit") - C("cost")) / value
    return g.withColumns({"net_benefit": net, "rebalance": net > threshold})


def schedule(dates: DataFrame, kind: str = "monthly") -> DataFrame:
    """First row of each new period (the first row of all is no rebalance)."""
    unit = {"monthly": "month", "quarterly": "quarter", "annual": "year"}[kind]
    d = over_rows(dates.withColumn("_k", F.lit(0)), lambda x, w: x.withColumn("_p", F.lag("ts").over(w)), back=1, keys=["_k"])
    new = F.date_trunc(unit, C("ts")) != F.date_trunc(unit, C("_p"))
    return d.where(new).select("ts")


def rebalance_backtest(returns: DataFrame, weights: DataFrame, kind: str = "monthly", value: float = 100_000.0, pct: float = 0.001) -> DataFrame:
    """Value path of a calendar-rebalanced portfolio (symbol, w) with proportional costs.

    Weights drift with returns between rebalances; a missing return counts as zero. A day's growth is
    the weighted sum of its returns, not a product over assets.
    """
    unit = {"monthly": "month", "quarterly": "quarter", "annual": "year"}[kind]
    held = returns.join(weights.select("symbol"), "symbol", "left_semi")
    # the dates x assets matrix of the portfolio, as the definition needs it
    grid = held.select("ts").distinct().join(weights).join(held.select("symbol", "ts", "ret"), ["symbol", "ts"], "left").fillna(0.0, ["ret"])
    grid = grid.withColumn("_seg", F.date_trunc(unit, "ts"))
    s = spread(grid, keys=["symbol", "_seg"]).run(_g=("product", 1 + C("ret")))
    d = s.done()
    per = d.groupBy("_seg", "ts").agg(F.sum(C("w") * C("_g")).alias("_growth"), F.sum("w").alias("_w"))
    # turnover back to target at the end of each segment, paid at the start of the next
    last = d.groupBy("_seg").agg(F.max("ts").alias("ts"))
    end = d.join(last, ["_seg", "ts"]).join(per, ["_seg", "ts"])
    turn = end.groupBy("_seg").agg(F.sum(F.abs(C("w") * C("_g") / C("_growth") - C("w") / C("_w"))).alias("_turn"),
                                   F.first("_growth").alias("_end"), F.first("_w").alias("_w0"))
    ws = Window.orderBy("_seg")  # one row per calendar period
    turn = turn.withColumn("_mult", (C("_end") / C("_w0")) * (1 - C("_turn") * pct))
    turn = turn.withColumn("_start", F.coalesce(F.product("_mult").over(ws.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0)))
    return per.join(turn.select("_seg", "_start"), "_seg").select("ts", (F.lit(value) * C("_start") * C("_growth") / C("_w")).alias("value"))


def threshold_rebalance_backtest(returns: DataFrame, weights: DataFrame, threshold: float = 0.05, value: float = 100_000.0, pct: float = 0.001) -> DataFrame:
    """Rebalance once any weight is ``threshold`` away from target: path dependent, so a streamed fold
    per portfolio over one row per date."""
    r = returns.join(weights.select("portfolio", "symbol", "w"), "symbol")
    names = weights.groupBy("portfolio").agg(F.sort_array(F.collect_list(F.struct("symbol", "w"))).alias("_t"))
    day = r.groupBy("portfolio", "ts").agg(F.map_from_entries(F.collect_list(F.struct("symbol", "ret"))).alias("_r"))
    day = day.join(names, "portfolio").select("portfolio", "ts", F.transform("_t", lambda e: e["w"]).alias("target"),
                                              F.transform("_t", lambda e: F.coalesce(F.try_element_at("_r", e["symbol"]), F.lit(0.0))).alias("rets"))

    def make():
        state: dict = {}

        def step(row):
            t, x = np.asarray(row.target, float), np.asarray(row.rets, float)
            h = state.get("h", t * value)
            h = h * (1 + x)
            total = h.sum()
            w = h / total
            turned = np.abs(w - t / t.sum()).max() > threshold
            if turned:
                total -= pct * np.abs(w - t / t.sum()).sum() * total
                h = total * t / t.sum()
            state["h"] = h
            return (row.portfolio, row.ts, float(total), bool(turned))

        return step

    return fold_sorted(day, ["portfolio"], ["ts"], make, f"portfolio string, ts {day.schema['ts'].dataType.simpleString()}, value double, rebalanced boolean")
