"""Benchmark decontamination by SimHash over item-sized windows (native).

1. A window of a document with any similarity to an item holds one of its k-word shingles. Where a
   document has an item's shingle, a window of the item's size is laid so that the shingle has the
   item's offset (moved inside the document's ends). One map-side pass finds these places.
2. Every window and every item gets a fingerprint of BITS bits: the SimHash of its words.
3. Multi-index search: fingerprints are cut into BLOCKS blocks. If two differ in at most RADIUS = 2 * BLOCKS - 1
   bits, some block differs in at most one, so items are listed under each block value and its
   one-bit neighbours, and windows look their blocks up among the items of their size. All pairs within the radius are found.
4. Similar pairs may lie beyond the radius, since words with changed neighbours cost more bits than shingles. Of an item's
   shingles a similar window lacks at most (100 - percent) %, so it holds one of any set of more; the item is listed under its
   rarest such set, and windows look their shingles up among the items of their size. No similar pair is left out.
5. Candidates of both searches are checked exactly: weighted Jaccard similarity of the shingles with their multiplicities.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm.common import GAP, LOWER, UPPER, held

BITS, LANE = 63, 21
BLOCKS = (11, 11, 11, 10, 10, 10)
RADIUS = 2 * len(BLOCKS) - 1
SMALL = 1_000_000  #: rows of item shingles up to which they are broadcast (about 16 MB); beyond, they are shuffled


def _words(text: Column) -> Column:
    t = F.btrim(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, GAP))


def _shingle_rows(df: DataFrame, k: int, keep: list[str]) -> DataFrame:
    """One row per k-word shingle of ``w``: its place and its words w0 .. w(k-1)."""
    n = F.size("w")
    parts = [F.slice("w", i + 1, F.greatest(n - (k - 1), F.lit(0))).alias(f"w{i}") for i in range(k)]
    return df.select(*keep, F.posexplode(F.arrays_zip(*parts)).alias("p", "s")).select(*keep, "p", *[F.col(f"s.w{i}").alias(f"w{i}") for i in range(k)])


def simhash(rows: DataFrame, keys: list[str], word: str = "word") -> DataFrame:
    """Fingerprint of every group of words. LANE sums hold three bit counters each, in lanes of LANE bits."""
    h = F.xxhash64(word)
    lanes = (1 << 2 * LANE) | (1 << LANE) | 1
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(lanes))).alias(f"_c{j}") for j in range(LANE)])
    bits = [F.when(F.shiftrightunsigned(F.col(f"_c{j}"), LANE * x).bitwiseAND(F.lit((1 << LANE) - 1)) * 2 > F.col("_n"), F.lit(1 << (LANE * x + j))).otherwise(F.lit(0))
            for x in range(BITS // LANE) for j in range(LANE)]
    return sums.select(*keys, reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long").alias("fp"))


def _block_values(fp: Column) -> list[Column]:
    out, at = [], 0
    for b in BLOCKS:
        out.append(F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << b) - 1)).cast("int"))
        at += b
    return out


def _listed(fp: Column) -> Column:
    """(block, value) pairs an item is found under."""
    near = [F.struct(F.lit(i).alias("block"), v.bitwiseXOR(F.lit(flip)).alias("value"))
            for i, (v, b) in enumerate(zip(_block_values(fp), BLOCKS, strict=True)) for flip in (0, *[1 << x for x in range(b)])]
    return F.array(*near)


def _rarest(counted: DataFrame, sh: list[str], percent: int) -> DataFrame:
    """Of every item the rarest shingles that a window of similarity ``percent`` cannot all lack, with copies counted."""
    df = counted.groupBy(*sh).agg(F.count(F.lit(1)).alias("df"))
    mine = W.partitionBy("item_id")
    before = F.sum("c2").over(mine.orderBy("df", *sh).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("c2")
    ranked = counted.join(df, sh).withColumns({"before": before, "there": F.sum("c2").over(mine)})
    return ranked.where(F.col("before") * 100 <= F.col("there") * (100 - percent))


def contaminated(docs: DataFrame, bench: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity): documents that hold an item, with the best window of each pair.

    ``start`` counts words. A pair is reported if 100 * shared >= percent * (all - shared) over shingles with multiplicity. Defined
    cases: items and documents of fewer than ``k`` words have no shingle and are in no pair; null
    texts count as empty; null ids are in no pair; repeated rows of an id count once each and merge into one pair;
    empty tables give an empty result; a document shorter than an item is compared whole; other columns are not read.
    """
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    d = texts.select("doc_id", _words(F.col("text")).alias("w"))
    items = held(bench.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), _words(F.col(item_text)).alias("w")).where(F.size("w") >= k).distinct())
    sh = [f"w{i}" for i in range(k)]
    key = F.xxhash64(*sh)
    places = held(_shingle_rows(items.withColumn("n", F.size("w")), k, ["n"]).select(key.alias("shingle"), F.col("p").alias("q"), "n").distinct())
    found = _shingle_rows(d.withColumn("len", F.size("w")), k, ["doc_id", "len"]).select("doc_id", "len", "p", key.alias("shingle"))
    small = places.count() <= SMALL
    hits = found.join(F.broadcast(places) if small else places, "shingle")
    start = F.greatest(F.lit(0), F.least(F.col("p") - F.col("q"), F.col("len") - F.col("n")))
    spots = held(hits.select("doc_id", start.alias("start"), F.col("n").alias("size")).distinct())

    lists = spots.groupBy("doc_id").agg(F.collect_set(F.struct("start", "size")).alias("spots"))
    wins = texts.join(lists, "doc_id").select("doc_id", _words(F.col("text")).alias("w"), F.explode("spots").alias("s")).select(
        "doc_id", F.col("s.start").alias("start"), F.col("s.size").alias("size"), F.slice("w", F.col("s.start") + 1, F.col("s.size")).alias("w"))
    wins = held(wins.distinct())
    at = ["doc_id", "start", "size"]
    marks = simhash(wins.select(*at, F.explode("w").alias("word")), at)
    own = simhash(items.select("item_id", F.size("w").alias("size"), F.explode("w").alias("word")), ["item_id", "size"])
    listed = own.select("item_id", "size", F.col("fp").alias("item_fp"), F.explode(_listed(F.col("fp"))).alias("b")).select("item_id", "size", "item_fp", "b.block", "b.value")
    asked = marks.select(*at, "fp", F.posexplode(F.array(*_block_values(F.col("fp")))).alias("block", "value"))
    near = asked.join(listed, ["size", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    right = _shingle_rows(items, k, ["item_id"]).groupBy("item_id", *sh).agg(F.count(F.lit(1)).alias("c2"))
    sizes = items.select("item_id", F.size("w").alias("size")).distinct()
    rare = held(_rarest(right, sh, percent).join(sizes, "item_id").select("size", key.alias("shingle"), "item_id"))
    looked = _shingle_rows(wins, k, at).select(*at, key.alias("shingle"))
    beyond = looked.join(F.broadcast(rare) if rare.count() <= SMALL else rare, ["size", "shingle"])
    near = held(near.select(*at, "item_id").union(beyond.select(*at, "item_id")).distinct())

    left = _shingle_rows(wins.join(near, at, "left_semi"), k, at).groupBy(*at, *sh).agg(F.count(F.lit(1)).alias("c"))
    shared = near.join(left, at).join(right, ["item_id", *sh]).groupBy(*at, "item_id").agg(F.sum(F.least("c", "c2")).alias("both"))
    here = left.groupBy(*at).agg(F.sum("c").alias("here"))
    there = right.groupBy("item_id").agg(F.sum("c2").alias("there"))
    scored = shared.join(here, at).join(there, "item_id").withColumn("all", F.col("here") + F.col("there") - F.col("both"))
    scored = scored.where(F.col("both") * 100 >= F.col("all") * percent).withColumn("similarity", F.col("both") / F.col("all"))
    best = W.partitionBy("doc_id", "item_id").orderBy(F.col("similarity").desc(), "start")
    return scored.withColumn("r", F.row_number().over(best)).where("r = 1").select(
        F.col("doc_id").alias(id_col), F.col("item_id").alias(item_col), "start", F.col("size").alias("n_words"), "similarity")


def keep_clean(docs: DataFrame, bench: DataFrame, **how) -> DataFrame:
    """Rows of ``docs``, all columns, that hold no benchmark item; rows with a null id stay."""
    key = how.get("id_col", "doc_id")
    return docs.join(contaminated(docs, bench, **how).select(key).distinct(), key, "left_anti").select(*docs.columns)
