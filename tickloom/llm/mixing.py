"""Mixing sources to target weights by Pareto order sampling (native).

Every source gets a target in words. A document's expected number of copies is proportional to
its measure, capped; the whole part is certain, and the fraction is its inclusion probability
in a sample that Pareto order sampling draws: documents are ranked by the odds of a hashed
uniform number over their inclusion odds, and the lowest ranks are taken until the sample has
the words that are still missing. Rounding to whole documents leaves at most half a document.

No group is sorted whole: ranks are put into bins, bins are summed, and only the one bin of
each source in which the sample ends is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm.common import held, n_words

BINS = 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """Target words of each source from (source, source_size), one row a source.

    Sources in code-point order, null last, weigh ``weights`` in turn. The targets share all words
    by weight; one above ``cap`` times its source's size stops there and the excess is shared again.
    The closed form of that resharing: with sources by size over weight, the first one that
    the common rate does not fill sets the rate. One row a source, so one task is enough.
    """
    every = W.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("_i", (F.row_number().over(every) - 1) % len(weights))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("_i") + 1).cast("long"))
    by_room = W.orderBy((F.col("source_size").cast("double") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    s = s.withColumn("_before", F.coalesce(F.sum("source_size").over(by_room.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) * cap)
    s = s.withColumn("_left", F.sum("weight").over(by_room.rowsBetween(0, W.unboundedFollowing)))
    s = s.withColumn("_total", F.sum("source_size").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    rest = F.col("_total") - F.col("_before")
    s = s.withColumn("_open", rest * F.col("weight") < cap * F.col("source_size") * F.col("_left"))
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("_rest", F.max(F.when(F.col("_open"), rest)).over(everything))  # both are largest at the first open source
    s = s.withColumn("_weights", F.max(F.when(F.col("_open"), F.col("_left"))).over(everything))
    capped = (F.col("source_size") * cap).cast("double")
    shared = (F.col("weight") * F.col("_rest")).cast("double") / F.col("_weights")
    return s.select("source", "source_size", "weight", F.least(capped, F.coalesce(shared, capped)).alias("target"))


def _copies(groups: DataFrame, cap: int) -> DataFrame:
    """(source, measure, words, target) -> expected copies of a document, so that the words come to the target."""
    down = W.partitionBy("source").orderBy(F.col("measure").desc())
    g = groups.withColumn("_above", F.coalesce(F.sum("words").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    g = g.withColumn("_mass", F.sum(F.col("measure") * F.col("words")).over(down.rowsBetween(0, W.unboundedFollowing)))
    rate = (F.col("target") - cap * F.col("_above")) / F.col("_mass")
    g = g.withColumn("_rate", F.max(F.when((F.col("_mass") > 0) & (rate * F.col("measure") < cap), F.struct(F.col("measure"), rate.alias("r"))))
                     .over(W.partitionBy("source"))["r"])
    e = F.least(F.lit(float(cap)), F.coalesce(F.col("_rate") * F.col("measure"), F.lit(float(cap))))
    return g.withColumn("_e", e).select("source", "measure", "words", "target", F.floor("_e").alias("whole"), (F.col("_e") - F.floor("_e")).alias("odds"))


def pareto_rank(key: Column, odds: Column, seed: int) -> Column:
    """Odds of a uniform number hashed from ``key`` over the inclusion odds; null where nothing is to be sampled."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double")
    u = (h + 0.5) / float(1 << 52)
    return F.when(odds > 0, (u * (1 - odds)) / ((1 - u) * odds))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 7,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", measure: Column | None = None) -> DataFrame:
    """All columns of ``docs`` plus size, source_size, target, copies (0 to ``cap``) and taken (copies times size).

    ``measure``: a whole number per row, of which expected copies are a multiple; by default the
    root of the size, so that longer documents are likelier. Documents without words count 0.
    Defined cases: a null source is a source of its own (last in order); a null text has no
    words; rows of one id share their random number and are taken together if their odds are
    equal; an empty table gives an empty result; columns of ``docs`` named like a result column
    are replaced.
    """
    new = ["size", "source_size", "target", "copies", "taken"]
    key, source = F.col(id_col), F.col(source_col)
    size = n_words(F.col(text_col))
    level = F.floor(F.sqrt(size.cast("double"))).cast("long") if measure is None else F.greatest(F.coalesce(measure.cast("long"), F.lit(0)), F.lit(0))
    rows = docs.withColumns({"__source": source, "__key": key, "__size": size, "__measure": F.when(size > 0, level).otherwise(0)})
    slim = held(rows.select(F.col("__source").alias("source"), F.col("__key").alias("key"), F.col("__size").alias("size"), F.col("__measure").alias("measure")))
    groups = slim.groupBy("source", "measure").agg(F.sum("size").alias("words"))
    targets = source_targets(groups.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap)
    copies = held(_copies(groups.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), cap)
                  .join(targets.select(F.col("source").alias("_s"), "source_size"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"))
    missing = copies.groupBy("source").agg((F.max("target") - F.sum(F.col("whole") * F.col("words"))).alias("missing"))

    c = copies.select(F.col("source").alias("_s"), F.col("measure").alias("_m"), "whole", "odds", "target", "source_size")
    ranked = slim.join(c, F.col("source").eqNullSafe(F.col("_s")) & (F.col("measure") == F.col("_m"))).where("odds > 0")
    ranked = ranked.withColumn("rank", pareto_rank(F.col("key"), F.col("odds"), seed))
    ranked = ranked.withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * BINS)).select("source", "size", "rank", "bin")
    bins = ranked.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    bins = bins.withColumn("before", F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    m = missing.withColumnRenamed("source", "_s")
    last = (bins.join(m, F.col("source").eqNullSafe(F.col("_s"))).where(F.col("before") <= F.col("missing"))
            .groupBy("source").agg(F.max_by(F.struct("bin", "before", "missing"), "bin").alias("x")).select(F.col("source").alias("_s"), "x.*"))
    inside = ranked.join(last.withColumnRenamed("bin", "_b"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("bin") == F.col("_b")))
    inside = inside.groupBy("source", "rank").agg(F.sum("size").alias("size"), F.max("before").alias("before"), F.max("missing").alias("missing"))
    upto = F.sum("size").over(W.partitionBy("source").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    cut = (inside.withColumn("upto", upto).where((F.col("before") + F.col("upto")) * 2 - F.col("size") <= F.col("missing") * 2)
           .groupBy("source").agg(F.max("rank").alias("cut")).select(F.col("source").alias("_c"), "cut"))
    ends = last.join(cut, F.col("_s").eqNullSafe(F.col("_c")), "left").select(F.col("_s").alias("_t"), F.col("bin").alias("end_bin"), "cut")
    plan = held(c.join(ends, F.col("_s").eqNullSafe(F.col("_t")), "left").select(
        F.col("_s").alias("__s"), F.col("_m").alias("__m"), F.col("whole").alias("__whole"), F.col("odds").alias("__odds"), F.col("target").alias("__target"),
        F.col("source_size").alias("__source_size"), F.col("end_bin").alias("__end"), F.col("cut").alias("__cut")))

    out = rows.join(plan, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__measure") == F.col("__m")))
    rank = pareto_rank(F.col("__key"), F.col("__odds"), seed)
    out = out.withColumn("__rank", rank)
    at = F.floor(F.col("__rank") / (1 + F.col("__rank")) * BINS)
    drawn = F.coalesce((at < F.col("__end")) | ((at == F.col("__end")) & (F.col("__rank") <= F.col("__cut"))), F.lit(False))
    n = F.col("__whole") + drawn.cast("long")
    return out.select(*[c for c in docs.columns if c not in new], F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
                      F.col("__target").alias("target"), n.alias("copies"), (n * F.col("__size")).alias("taken"))
