"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import held


def _large(e: DataFrame) -> DataFrame:
    both = e.union(e.select("v", "u")).toDF("u", "v")
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    j = e.join(low, "u")
    return j.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(low.select("u", "m")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(u, v) links -> (node, component): the smallest node reachable. Nodes without a link are not listed.

    A round is two stars; the number of rounds grows with the logarithm of the longest chain.
    Every round is a checkpoint. A centre with very many leaves is summed before it is shuffled
    and joined with one row.
    """
    e = held(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(e)
    while before[0]:
        e = held(_small(_large(e)))
        now = mark(e)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
