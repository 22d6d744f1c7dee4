"""Exact ranks and quantiles of groups of any size and any distribution.

Values are put in monotone bins and counted (partial aggregate); bins that hold too many different
values are cut and counted again. A rank is the offset of a bin plus the rank inside it, so no
task sorts a whole group. Equal values are never sorted: a bin of one value has its ranks from the counts alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import slices
from .slices import NULL_BIN, Series, _place, bin_map, fitted, match, value_bin


def rank_average(df: DataFrame, by: Sequence[str], value: str, out: str, pct: bool = False) -> DataFrame:
    """Rank with ties averaged (1-based); rows with a null value get a null rank."""
    by, rows = list(by), slices.ROWS_PER_SLICE
    d = df.withColumn("_rv", F.col(value).cast("double")).withColumn("_bin", F.coalesce(value_bin("_rv"), F.lit(NULL_BIN)))
    d, counts = fitted(d, by, ["_rv"], rows)
    m = bin_map(d, by, rows, counts=counts)
    one = match(counts.where((F.col("_n") > rows) & F.col("_by").isNull()).select(*by, "_bin", "_n"), m, by + ["_bin"], "inner").select(
        *by, "_bin", "_begin", "_total", "_n")
    scale = F.col("_total") if pct else F.lit(1)
    flat = not one.isEmpty()  # bins of one value, or of nulls, with more rows than a slice
    rest = match(d, one.select(*by, "_bin"), by + ["_bin"], "left_anti") if flat else d
    s = Series(_place(rest, m, by), by, [F.asc_nulls_last("_rv")], m, False).position("_pos")
    rank = F.avg("_pos").over(Window.partitionBy(*by, "_slice", "_rv")) + 1.0
    done = s.col(**{out: F.when(F.col("_rv").isNotNull(), rank / scale)}).done("_pos", "_rv")
    if not flat:
        return done
    same = match(d, one, by + ["_bin"], "inner").withColumn(out, F.when(F.col("_rv").isNotNull(), (F.col("_begin") + (F.col("_n") + 1) / 2) / scale))
    return done.unionByName(same.drop("_rv", "_bin", "_begin", "_total", "_n"))


def quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], out: str = "q") -> DataFrame:
    """Linear-interpolated quantiles per group as ``array<double>`` in the order of ``probs``.

    Only bins holding a wanted rank are cut further and looked into, and there equal values are counted
    first, so what is sorted are the different values of one bin; the rest of the rows are merely counted.
    """
    by, rows = list(by), slices.ROWS_PER_SLICE
    d = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v")).withColumn("_bin", value_bin("_v"))
    p = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("p")) for i, q in enumerate(probs)])

    def wanted(counts: DataFrame) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("_bin")
        c = counts.withColumn("_begin", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        c = c.withColumn("_total", F.sum("_n").over(Window.partitionBy(*by)))
        q = c.withColumn("_q", F.explode(p)).withColumn("_h", (F.col("_total") - 1) * F.col("_q.p"))
        q = q.withColumn("_k", F.explode(F.array_distinct(F.array(F.floor("_h"), F.ceil("_h")))))
        return q.where((F.col("_k") >= F.col("_begin")) & (F.col("_k") < F.col("_begin") + F.col("_n")))

    d, counts = fitted(d, by, ["_v"], rows, lambda c: wanted(c).select(*c.columns).distinct())
    want = wanted(counts)
    hit = want.groupBy(*by, "_bin").agg(F.first("_begin").alias("_begin"), F.collect_set("_k").alias("_ks"))
    same = match(d, hit.select(*by, "_bin"), by + ["_bin"], "left_semi").groupBy(*by, "_bin", "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*by, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    run = match(same, hit, by + ["_bin"], "inner").withColumn("_to", F.col("_begin") + upto).withColumn("_from", F.col("_to") - F.col("_c"))
    rows = run.withColumn("_k", F.explode(F.filter("_ks", lambda k: (k >= F.col("_from")) & (k < F.col("_to")))))
    got = match(want.select(*by, "_k", "_h", F.col("_q.i").alias("_i")), rows.select(*by, "_k", "_v"), by + ["_k"], "inner")
    lo, hi = F.min("_v"), F.max("_v")
    per = got.groupBy(*by, "_i").agg((lo + (hi - lo) * (F.first("_h") - F.floor(F.first("_h")))).alias("_x"))
    return per.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda e: e["_x"]).alias(out))


def qcut(df: DataFrame, by: Sequence[str], value: str, q: int, out: str) -> DataFrame:
    """Quantile bin 1..q, right-closed, duplicate edges dropped."""
    by = list(by)
    edges = quantiles(df, by, value, [i / q for i in range(q + 1)], "_edges")
    edges = edges.withColumn("_edges", F.array_distinct("_edges"))
    j = match(df, edges, by) if by else df.join(F.broadcast(edges), F.lit(True), "left")  # one row or none when there is no group
    inner = F.slice(F.col("_edges"), 2, F.greatest(F.size("_edges") - 2, F.lit(0)))
    code = F.size(F.filter(inner, lambda e: e < F.col(value))) + 1
    return j.withColumn(out, F.when(F.col(value).isNotNull() & F.col("_edges").isNotNull() & (F.size("_edges") > 1), code).cast("long")).drop("_edges")
