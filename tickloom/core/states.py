"""Small state machines over series of any length.

Each row is a map over a few states; maps compose, so chunks are composed in parallel, the chunk
maps are composed next, and each row applies its map to the state its chunk starts from.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .slices import chunks_of, match, spread


def _compose(df: DataFrame, m: str, w, reach: int) -> DataFrame:
    k = 1
    while k < reach:
        prev = F.lag(m, k).over(w)
        df = df.withColumn("_prev", prev)
        df = df.withColumn(m, F.when(F.col("_prev").isNull(), F.col(m)).otherwise(
            F.transform("_prev", lambda s: F.element_at(F.col(m), s)))).drop("_prev")
        k *= 2
    return df


def state_run(df: DataFrame, step: Column, out: str, start: int = 1, keys: Sequence[str] = ("symbol",), order=("ts",),
              bin="month", chunk: int = 1024) -> DataFrame:
    """``step`` is an array<int>: the state after the row for each state (1-based) before it."""
    keys = list(keys)
    chunks = chunks_of(df, keys, chunk)
    d = spread(df.withColumn("_m", step), keys=keys, order=order, bin=bin).position("_pos").done()
    d = d.withColumn("_chunk", F.floor(F.col("_pos") / F.lit(chunk)).cast("long"))
    d = _compose(d, "_m", Window.partitionBy(*keys, "_chunk").orderBy("_pos"), chunk)
    tail = d.groupBy(*keys, "_chunk").agg(F.max_by("_m", "_pos").alias("_t"))
    ws = Window.partitionBy(*keys).orderBy("_chunk")
    tail = _compose(tail, "_t", ws, chunks)
    carry = tail.select(*keys, "_chunk", F.coalesce(F.element_at(F.lag("_t").over(ws), start), F.lit(start)).alias("_s0"))
    d = match(d, carry, keys + ["_chunk"])
    return d.withColumn(out, F.element_at("_m", F.col("_s0"))).drop("_m", "_s0", "_chunk", "_pos")
