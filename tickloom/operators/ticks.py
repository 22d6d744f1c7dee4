"""Ticks to bars, order-book and quote operators."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import slices
from ..core.crossing import first_crossing
from ..core.slices import match, over_rows, spread
from ..session import durable


def bars_by(ticks: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """OHLCV per group: one partial aggregate, ties broken by ``seq``."""
    return ticks.groupBy(*keys).agg(
        F.min_by("price", seq).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", seq).alias("close"), F.sum("volume").alias("volume"))


def time_bars(ticks: DataFrame, width: str) -> DataFrame:
    """Bars of a fixed width; empty intervals give no bar."""
    d = ticks.withColumn("bar", F.window("ts", width)["start"])
    o = F.struct("ts", "seq")
    return d.groupBy("symbol", "bar").agg(
        F.min_by("price", o).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", o).alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("trades"))


def multi_interval_bars(ticks: DataFrame, widths: Sequence[str]) -> DataFrame:
    """The same ticks at several widths in one pass (each tick is exploded to its windows)."""
    secs = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
    d = ticks
    for i, w in enumerate(widths):
        n, u = w.split()
        size = int(n) * secs[u.rstrip('s')]
        d = d.withColumn(f"_b{i}", F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / size) * size))
    starts = F.array(*[F.struct(F.lit(w).alias("width"), F.col(f"_b{i}").alias("bar")) for i, w in enumerate(widths)])
    d = d.select("symbol", "ts", "seq", "price", "volume", F.inline(starts))
    o = F.struct("ts", "seq")
    return d.groupBy("symbol", "width", "bar").agg(
        F.min_by("price", o).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", o).alias("close"), F.sum("volume").alias("volume"))


def _next_starts(p: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """For a bar that starts at each row, the row after its last one; len(p) + 1 where it does not close in these rows."""
    return np.searchsorted(p, p - m + threshold, "left") + 1


def _ends_of(jump: np.ndarray) -> np.ndarray:
    """The last start of the chain from each row that lies in these rows, by doubling."""
    at = np.where(jump < len(jump), jump, np.arange(len(jump)))
    while True:
        further = at[at]
        if (further == at).all():
            return at
        at = further


def _sorted_block(block: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    block = block.sort_by("_pos")
    return block, np.asarray(block.column("_p")), np.asarray(block.column("_m"))


def _last_starts(threshold: float):
    """The bars that may be open at the end of a block: the row each starts at, and the running measure that closes it."""
    def solve(block: pa.Table) -> pa.Table:
        block, p, m = _sorted_block(block)
        pos = np.asarray(block.column("_pos"))
        ends = _ends_of(_next_starts(p, m, threshold))
        x = ends[:1] if pos[0] == 0 else np.unique(ends)
        return pa.table({"symbol": block.column("symbol").take(pa.array(x)), "_x": pos[x], "_target": p[x] - m[x] + threshold})

    return solve


def _followed(threshold: float):
    """For starts within a block, the bar that is open at its end."""
    def solve(starts: pa.Table, block: pa.Table) -> pa.Table:
        if not block.num_rows:
            return pa.table({"symbol": starts.column("symbol"), "_x": starts.column("_x"), "_to": pa.nulls(starts.num_rows, pa.int64())})
        block, p, m = _sorted_block(block)
        pos = np.asarray(block.column("_pos"))
        y = np.asarray(starts.column("_y")) - pos[0]
        to = pos[_ends_of(_next_starts(p, m, threshold))[np.minimum(y, len(pos) - 1)]]
        return pa.table({"symbol": starts.column("symbol"), "_x": starts.column("_x"), "_to": pa.array(to, mask=y >= len(pos))})  # none after the last row

    return solve


def _members(threshold: float):
    """Rows of a block with the start of their bar, from the bar that is open at its begin and the first start in it."""
    def solve(block: pa.Table, entry: pa.Table) -> pa.Table:
        names = ["symbol", "ts", "price", "volume", "_pos"]
        if not entry.num_rows or not block.num_rows:
            return block.select(names).slice(0, 0).append_column("_start", pa.array([], pa.int64()))
        block, p, m = _sorted_block(block)
        pos, n = np.asarray(block.column("_pos")), block.num_rows
        begun, first = entry.column("_open")[0].as_py(), entry.column("_first")[0].as_py()
        at = n if first is None else min(first - int(pos[0]), n)
        jump = np.append(np.minimum(_next_starts(p, m, threshold), n), n)
        starts = np.array([at])
        while starts[-1] < n:  # twice as many starts each time
            starts, jump = np.concatenate((starts, jump[starts])), jump[jump]
        starts = np.unique(starts[starts < n])
        of = np.searchsorted(starts, np.arange(n), "right")
        start = np.concatenate(([-1 if begun is None else begun], pos[starts]))[of]
        return block.select(names).append_column("_start", pa.array(start, pa.int64()))

    return solve


def threshold_bars(ticks: DataFrame, threshold: float, measure: str = "volume", bin: str = "day") -> DataFrame:
    """Bars that close once ``measure`` (volume or dollar) since the bar's start reaches the threshold.

    The overshoot is dropped and an open last bar is not emitted, so each boundary depends on the one
    before. A running sum tells every row where a bar that starts there would close, by binary search; pointers are
    followed by doubling inside blocks of ``ROWS_PER_SLICE`` rows, and across blocks for the few bars that can be open at the end of one.
    Measures are not negative; they add up exactly while they are whole numbers below 2**53.
    """
    rows = max(2, slices.ROWS_PER_SLICE)
    m = (F.col("price") * F.col("volume") if measure == "dollar" else F.col("volume")).cast("double")
    d = ticks.select("symbol", "ts", "seq", F.col("price").cast("double"), F.col("volume").cast("double"), F.coalesce(m, F.lit(0.0)).alias("_m"))
    d = spread(d, order=["ts", "seq"], bin=bin).run(_p=("sum", F.col("_m"))).position("_pos").done("seq")
    d = durable(d.withColumn("_block", F.floor(F.col("_pos") / rows)))
    sym = f"symbol {d.schema['symbol'].dataType.simpleString()}"
    nodes = d.groupBy("symbol", "_block").applyInArrow(_last_starts(threshold), f"{sym}, _x long, _target double")
    nodes = durable(first_crossing(d, nodes, ["symbol"], "_p", "_target", "_x", "_hit", pos="_pos").withColumn("_y", F.col("_hit") + 1))
    reach = durable(nodes.where(F.col("_x") < rows).select("symbol", "_x"))  # of the first block there is one
    blocks = (d.agg(F.max("_block")).first()[0] or 0) + 1
    if blocks > 1:
        to = nodes.where("_hit is not null").withColumn("_block", F.floor(F.col("_y") / rows))
        jump = durable(to.groupBy("symbol", "_block").cogroup(d.groupBy("symbol", "_block")).applyInArrow(_followed(threshold), f"{sym}, _x long, _to long").where("_to is not null"))
        done = 1
        while done < blocks:
            reach = durable(reach.union(match(reach, jump, ["symbol", "_x"], "inner").select("symbol", F.col("_to").alias("_x"))))
            ahead = jump.select("symbol", F.col("_x").alias("_to"), F.col("_to").alias("_next"))
            jump, done = durable(match(jump, ahead, ["symbol", "_to"], "inner").select("symbol", "_x", F.col("_next").alias("_to"))), 2 * done
    real = match(nodes, reach.distinct(), ["symbol", "_x"], "left_semi")
    at = lambda c: F.floor(F.col(c) / rows)
    later = real.where("_hit is not null").withColumn("_block", F.explode(F.sequence(at("_x") + 1, F.greatest(at("_y"), at("_x") + 1))))
    entries = later.select("symbol", "_block", F.col("_x").alias("_open"), F.when(F.col("_block") >= at("_hit"), F.col("_y")).alias("_first"))
    entries = entries.unionByName(d.where("_pos = 0").select("symbol", "_block", F.lit(None).cast("long").alias("_open"), F.lit(0).cast("long").alias("_first")))
    kind = ", ".join(f"{c} {d.schema[c].dataType.simpleString()}" for c in ("symbol", "ts", "price", "volume", "_pos")) + ", _start long"
    member = d.groupBy("symbol", "_block").cogroup(entries.groupBy("symbol", "_block")).applyInArrow(_members(threshold), kind).where("_start >= 0")
    bars = member.groupBy("symbol", "_start").agg(
        F.min_by("ts", "_pos").alias("ts"), F.min_by("price", "_pos").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "_pos").alias("close"), F.sum("volume").alias("volume"))
    closed = match(bars, real.where("_hit is null").select("symbol", F.col("_x").alias("_start")), ["symbol", "_start"], "left_anti")
    numbered = spread(closed, order=["_start"], bin=F.floor(F.col("_start") / (1 << 20))).position("bar").done()
    return numbered.select("symbol", "bar", "ts", "open", "high", "low", "close", "volume")


def floor_volume_bars(ticks: DataFrame, threshold: float, bin: str = "day") -> DataFrame:
    """Bar id = floor(volume before the tick / threshold): no reset on overshoot."""
    s = spread(ticks, order=["ts", "seq"], bin=bin).run(_cum=("sum", F.col("volume")))
    d = s.done().withColumn("bar", F.floor((F.col("_cum") - F.col("volume")) / threshold).cast("long"))
    o = F.struct("ts", "seq")
    return d.groupBy("symbol", "bar").agg(
        F.min_by("price", o).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", o).alias("close"), F.sum("volume").alias("volume"), F.min("ts").alias("ts"))


def cumulative_vwap(bars: DataFrame) -> DataFrame:
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    s = spread(bars).run(_pv=("sum", typical * F.col("volume")), _v=("sum", F.col("volume")))
    return s.col(vwap=F.col("_pv") / F.col("_v")).done("_pv", "_v")


def order_imbalance(trades: DataFrame, side: str = "side", bin: str = "day") -> DataFrame:
    """Cumulative volume signed by the aggressor side."""
    signed = F.when(F.col(side) == "buy", F.col("volume")).otherwise(-F.col("volume"))
    return spread(trades, order=["ts", "seq"], bin=bin).run(imbalance=("sum", signed)).done()


def spread_metrics(quotes: DataFrame) -> DataFrame:
    s = F.col("ask") - F.col("bid")
    return quotes.withColumns({"spread": s, "spread_bps": s / F.col("bid") * 1e4, "mid": (F.col("bid") + F.col("ask")) / 2})


def market_impact(orders: DataFrame, daily: DataFrame, participation: float = 0.1) -> DataFrame:
    """Square-root impact in basis points: vol * sqrt(q / V) * participation * 1e4."""
    d = orders.join(daily.select("symbol", "ts", "volatility", "day_volume"), ["symbol", "ts"])
    return d.withColumn("impact_bps", F.col("volatility") * F.sqrt(F.col("qty") / F.col("day_volume")) * participation * 1e4)


def book_snapshot(updates: DataFrame, as_of: str | Column | None = None) -> DataFrame:
    """Latest size per (symbol, side, price); size 0 removes the level."""
    d = updates if as_of is None else updates.where(F.col("ts") <= (F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of))
    last = d.groupBy("symbol", "side", "price").agg(F.max_by("size", F.struct("ts", "seq")).alias("size"))
    return last.where("size > 0")


def best_quotes(book: DataFrame) -> DataFrame:
    d = book.groupBy("symbol").agg(
        F.max(F.when(F.col("side") == "bid", F.col("price"))).alias("best_bid"),
        F.min(F.when(F.col("side") == "ask", F.col("price"))).alias("best_ask"))
    return d.withColumn("spread", F.col("best_ask") - F.col("best_bid"))


def depth_imbalance(book: DataFrame, levels: int = 5) -> DataFrame:
    """(bid - ask) / (bid + ask) sizes over the best ``levels`` levels of each side, 0 if none."""
    from pyspark.sql import Window
    better = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    # a per-group top-k: Spark keeps only the best rows of each partition before the shuffle
    rn = F.row_number().over(Window.partitionBy("symbol", "side").orderBy(better))
    top = book.withColumn("_rn", rn).where(F.col("_rn") <= levels)
    d = top.groupBy("symbol").agg(
        F.sum(F.when(F.col("side") == "bid", F.col("size")).otherwise(0)).alias("bid_depth"),
        F.sum(F.when(F.col("side") == "ask", F.col("size")).otherwise(0)).alias("ask_depth"))
    tot = F.col("bid_depth") + F.col("ask_depth")
    return d.withColumn("imbalance", F.when(tot == 0, 0.0).otherwise((F.col("bid_depth") - F.col("ask_depth")) / tot))


def tick_jumps(ticks: DataFrame, limit: float = 0.01, bin: str = "day") -> DataFrame:
    def f(d, w):
        prev = F.lag("price").over(w)
        # a price after 0 is an infinite move (0 after 0: NaN, which is above every limit); the division itself would end the query
        ratio = F.when(F.col("prev_price") != 0, F.col("price") / F.col("prev_price")).otherwise(F.col("price") * F.pow("prev_price", F.lit(-1.0)))
        return d.withColumn("prev_price", prev).withColumn("move", ratio - 1)
    return over_rows(ticks, f, back=1, order=["ts", "seq"], bin=bin).where(F.abs("move") > limit)
