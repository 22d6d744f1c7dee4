"""The first row of a long series that reaches a level, for any number of searches.

A series is numbered and cut into blocks of exactly ``ROWS_PER_SLICE`` rows. A search looks first into the rest of its own
block. What is not found there looks for the first later block whose extreme reaches the level; the extremes
of the blocks are a series of their own, so that step is the same search on a table that is smaller by the size of a
block. Then it looks into that one block. So a search meets two blocks a level however far away its answer is,
and inside a block a pyramid of extremes leads to the row in logarithmically many steps.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from . import slices
from .slices import match

SEARCHES = 500_000  #: searches that share one copy of a block; more are dealt to several tasks


def first_at_least(v: np.ndarray, start: np.ndarray, level: np.ndarray) -> np.ndarray:
    """For every search the first index from ``start`` on with v >= level, or len(v)."""
    tree = [v]
    while len(tree[-1]) > 1:
        x = tree[-1]
        if len(x) % 2:
            x = tree[-1] = np.append(x, -np.inf)
        tree.append(np.maximum(x[::2], x[1::2]))
    size = np.array([len(x) for x in tree])
    first, flat = np.concatenate(([0], np.cumsum(size)))[:-1], np.concatenate(tree)
    height, at = np.zeros(len(start), np.int64), start.astype(np.int64)
    found = np.zeros(len(start), bool)
    on = np.flatnonzero(~np.isnan(level) & (at < len(v)))
    while len(on):  # to the right and up until a node holds the level
        on = on[at[on] < size[height[on]]]
        hit = flat[first[height[on]] + at[on]] >= level[on]
        found[on[hit]] = True
        on = on[~hit]
        at[on] += 1
        up = on[(at[on] % 2 == 0) & (height[on] < len(tree) - 1)]
        at[up] //= 2
        height[up] += 1
    on = np.flatnonzero(found)
    while len(on):  # and down to the first row below it
        on = on[height[on] > 0]
        height[on] -= 1
        at[on] *= 2
        at[on] += flat[first[height[on]] + at[on]] < level[on]
    return np.where(found, at, len(v))


def _in_block(rows: int, out: str):
    def solve(searches: pa.Table, block: pa.Table) -> pa.Table:
        at, level = np.asarray(searches.column("_at")), np.asarray(searches.column("_level").to_numpy(zero_copy_only=False), float)
        hit = np.full(len(at), -1)
        if block.num_rows and len(at):
            pos = np.asarray(block.column("_pos"))
            base = int(pos[0]) // rows * rows
            v = np.full(int(pos.max()) - base + 1, -np.inf)
            v[pos - base] = np.asarray(block.column("_value").to_numpy(zero_copy_only=False), float)
            v[np.isnan(v)] = -np.inf
            i = first_at_least(v, np.maximum(at - base, 0), level)
            hit = np.where(i < len(v), i + base, -1)
        keep = [c for c in searches.column_names if c not in ("_block", "_share")]
        return searches.select(keep).append_column("_hit", pa.array(hit, mask=hit < 0))

    return solve


def _look(series: DataFrame, searches: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """``searches`` with ``_hit``, the first row of their own ``_block`` from ``_at`` on that reaches ``_level``."""
    per = searches.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_many"))
    shares = per.withColumn("_share", F.explode(F.sequence(F.lit(0), F.floor((F.col("_many") - 1) / SEARCHES).cast("int"))))
    s = match(series.withColumn("_block", F.floor(F.col("_pos") / rows)), shares.select(*keys, "_block", "_share"), keys + ["_block"], "inner")
    s = s.select(*[F.col(c).alias(c) for c in s.columns])  # searches are often made of the series itself
    q = match(searches, per.where(F.col("_many") > SEARCHES), keys + ["_block"])
    several = F.floor((F.col("_many") - 1) / SEARCHES).cast("int") + 1
    q = q.withColumn("_share", F.coalesce(F.pmod(F.xxhash64(*searches.columns), several).cast("int"), F.lit(0))).drop("_many")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in searches.schema if f.name != "_block") + ", _hit long"
    by = [*keys, "_block", "_share"]
    return q.groupBy(*by).cogroup(s.groupBy(*by)).applyInArrow(_in_block(rows, "_hit"), kind)


def _search(series: DataFrame, searches: DataFrame, keys: list[str], longest: int, rows: int, depth: int = 0) -> DataFrame:
    near = _look(series, searches.withColumn("_block", F.floor(F.col("_at") / rows)), keys, rows)
    if longest <= rows:
        return near
    near = durable(near)  # read three times below, so each level is computed once
    blocks = series.groupBy(*keys, F.floor(F.col("_pos") / rows).alias("_pos")).agg(F.max("_value").alias("_value"))
    begin = f"_from{depth}"
    open_ = near.where(F.col("_hit").isNull()).drop("_hit").withColumnRenamed("_at", begin)
    far = durable(_search(blocks, open_.withColumn("_at", F.floor(F.col(begin) / rows) + 1), keys, -(-longest // rows), rows, depth + 1))
    gone = far.where(F.col("_hit").isNull()).drop("_at").withColumnRenamed(begin, "_at")
    there = far.where(F.col("_hit").isNotNull()).withColumn("_at", F.col("_hit") * rows).withColumnRenamed("_hit", "_block")
    got = _look(series, there, keys, rows).drop("_at").withColumnRenamed(begin, "_at")
    cols = near.columns
    return near.where(F.col("_hit").isNotNull()).unionByName(gone.select(cols)).unionByName(got.select(cols))


def first_crossing(series: DataFrame, searches: DataFrame, keys: Sequence[str], value: str | Column, level: str | Column, start: str | Column,
                   out: str, up: bool = True, pos: str = "pos") -> DataFrame:
    """``searches`` with ``out``: the first ``pos`` from ``start`` on where ``value`` >= ``level`` (``up`` false: <=), null if there is none.

    ``series`` holds (keys, pos, value), pos counting the rows of a key from 0. A null or NaN value reaches nothing, and
    a null level is reached by nothing. Searches keep all their columns (none named _at, _level, _block, _share, _hit or _from); several may be equal.
    """
    keys, rows = list(keys), max(2, slices.ROWS_PER_SLICE)
    sign = 1.0 if up else -1.0
    c = lambda x: F.col(x) if isinstance(x, str) else x
    s = series.select(*keys, F.col(pos).cast("long").alias("_pos"), (c(value).cast("double") * sign).alias("_value"))
    number = lambda x: F.coalesce(F.nanvl(x, F.lit(float("-inf"))), F.lit(float("-inf")))
    s = s.withColumn("_value", number(F.col("_value")))
    q = searches.withColumn("_at", F.coalesce(c(start).cast("long"), F.lit(0))).withColumn("_level", F.when(c(start).isNotNull(), c(level).cast("double") * sign))
    longest = s.agg(F.max("_pos")).first()[0]
    if longest is None:
        return searches.withColumn(out, F.lit(None).cast("long"))
    return _search(s, q, keys, longest + 1, rows).drop("_at", "_level").withColumnRenamed("_hit", out)
