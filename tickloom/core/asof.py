"""As-of join by union and running last value, split by slices like any other series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .slices import spread


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], on: str, take: Sequence[str],
         bin: str | Column = "month", forward: bool = False) -> DataFrame:
    """The latest right row at or before each left row (``forward``: first at or after).

    Right rows must be unique per (keys, on); unmatched left rows keep nulls.
    """
    keys = list(keys)
    names = [c for c in left.columns]
    l = left.select(*keys, F.col(on).alias("_on"), F.struct(*names).alias("_l"), F.lit(None).cast(
        right.select(F.struct(*take)).schema[0].dataType).alias("_r"), F.lit(1).alias("_side"))
    r = right.select(*keys, F.col(on).alias("_on"), F.lit(None).cast(
        left.select(F.struct(*names)).schema[0].dataType).alias("_l"), F.struct(*take).alias("_r"), F.lit(0).alias("_side"))
    u = l.unionByName(r)
    if forward:
        u = u.withColumn("_o", -F.unix_micros(F.col("_on").cast("timestamp")))
        unit = {"hour": 3600, "day": 86400, "month": 2592000, "year": 31536000}[bin if isinstance(bin, str) else "month"]
        b = F.floor(F.col("_o") / F.lit(unit * 1000000))
        s = spread(u, keys=keys, order=["_o", "_side"], bin=b)
    else:
        s = spread(u, keys=keys, order=["_on", "_side"], bin=bin)
    d = s.run(_hit=("last", F.col("_r"))).done()
    return d.where("_side = 1").select(*[F.col(f"_l.{c}").alias(c) for c in names], *[F.col(f"_hit.{c}").alias(c) for c in take])
