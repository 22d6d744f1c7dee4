"""Pairwise moments of many series as a blocked matrix product.

Series are hashed into blocks; a task gets two blocks of series over one stretch of time and
multiplies them with NumPy, so no date ever emits its pairs one by one and no task sees all series.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


SERIES_PER_BLOCK = 128


def block_count(panel: DataFrame, size: int = SERIES_PER_BLOCK) -> int:
    """Blocks for the counted series of a panel, at least four so that small panels use several tasks."""
    return max(4, -(-panel.select("symbol").distinct().count() // size))


def pair_moments(panel: DataFrame, value: str, blocks: int | None = None, chunk: str | Column = "year", diagonal: bool = True, per_chunk: bool = False) -> DataFrame:
    """(a, b, n, sx, sy, sxx, syy, sxy) over the dates both series have, a <= b by name.

    ``per_chunk`` keeps the moments of each stretch of time apart, with its name in ``chunk``. Without
    ``blocks`` the series are counted first.
    """
    blocks = blocks or block_count(panel)
    ch = F.date_trunc(chunk, F.col("ts")) if isinstance(chunk, str) else chunk
    d = panel.where(F.col(value).isNotNull()).select(
        "symbol", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col(value).cast("double").alias("v"),
        ch.cast("string").alias("chunk"), F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int").alias("blk"))
    others = F.array(*[F.lit(i) for i in range(blocks)])
    d = d.withColumn("o", F.explode(others)).select(
        "symbol", "t", "v", "chunk", "blk", F.least("blk", "o").alias("bi"), F.greatest("blk", "o").alias("bj"))

    moments = ["n", "sx", "sy", "sxx", "syy", "sxy"]

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j, when = pdf["bi"].iat[0], pdf["bj"].iat[0], pdf["chunk"].iat[0]
        wide = pdf.pivot(index="t", columns="symbol", values="v").sort_index()
        left = sorted(pdf.loc[pdf["blk"] == i, "symbol"].unique())
        right = sorted(pdf.loc[pdf["blk"] == j, "symbol"].unique())
        if not left or not right:
            return pd.DataFrame(columns=["chunk", "a", "b", *moments])
        x, y = wide[left].to_numpy(), wide[right].to_numpy()
        mx, my = (~np.isnan(x)).astype(float), (~np.isnan(y)).astype(float)
        x, y = np.nan_to_num(x), np.nan_to_num(y)
        parts = [mx.T @ my, x.T @ my, mx.T @ y, (x * x).T @ my, mx.T @ (y * y), x.T @ y]
        la, lb = np.repeat(left, len(right)), np.tile(right, len(left))
        out = pd.DataFrame({"chunk": when, "a": la, "b": lb, **{k: p.ravel() for k, p in zip(moments, parts)}})
        out = out[out["n"] > 0]
        if i == j:
            return out[out["a"] <= out["b"]]
        swap = out["a"] > out["b"]
        out.loc[swap, ["a", "b", "sx", "sy", "sxx", "syy"]] = out.loc[swap, ["b", "a", "sy", "sx", "syy", "sxx"]].to_numpy()
        return out

    parts = d.groupBy("bi", "bj", "chunk").applyInPandas(
        multiply, "chunk string, a string, b string, n double, sx double, sy double, sxx double, syy double, sxy double")
    if not diagonal:
        parts = parts.where("a < b")
    return parts.groupBy(*(["chunk"] if per_chunk else []), "a", "b").agg(*[F.sum(c).alias(c) for c in moments])
