"""A corpus pipeline of five stages, each on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the docs of
the next. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import decontamination, jaccard, mixing, suffix_array, toxicity
from tickloom.llm.queries import grades
from tickloom.llm.registry import QUERIES, table
from tickloom.session import scratch_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity stays below the limit; the model learns from the labelled ones among them."""
    return toxicity.keep_clean(docs, toxicity.train(docs, grades(table(spark, sf_dir, "labels"))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked documents that with the smallest id."""
    found = jaccard.near_duplicates(docs)
    return docs.join(found.where("component_id < doc_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes and more that occur earlier, cut at whole characters. A text of which nothing is left goes."""
    cut = suffix_array.dedup(docs, keep_columns=True, whole_characters=True)
    text = F.col("kept").cast("string")
    out = cut.where("kept is null or n_units = 0 or octet_length(kept) > 0").withColumn("text", text)
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with their number of copies, near the target of each source."""
    return mixing.mix(docs).where("copies > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

ORACLE_SQL = None  #: two stages train or hash in ways that SQL does not state; tests hold run() against a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order on ``documents``; what each keeps is a table in the shared folder."""
    docs, folder = table(spark, sf_dir, "documents"), scratch_folder(spark, "corpus")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES["pipeline"] = run
