"""The driver's tables as market-data panels, and the same panels as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ticks as T


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    for f in df.schema.fields:
        if f.dataType.simpleString() == "timestamp_ntz":
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return df


def ticks(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    return l.join(p, l.l_partkey == p.p_partkey).select(
        F.col("p_brand").alias("symbol"), F.to_date("l_shipdate").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("volume"),
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10000000 + F.col("l_partkey")).alias("seq"))


def bars(spark: SparkSession, d: str) -> DataFrame:
    """One bar per brand and day."""
    return T.bars_by(ticks(spark, d), ["symbol", "ts"])


def returns(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import metrics
    return metrics.simple_return(bars(spark, d)).select("symbol", "ts", "ret").where("ret is not null")


def events(spark: SparkSession, d: str) -> DataFrame:
    """Event ticks: symbol = event type, price = value, volume = k of the JSON props."""
    e = table(spark, d, "events")
    return e.select(
        F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("volume"), "user_id")


TICKS = """
ticks AS (SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS ts, l_extendedprice / l_quantity AS price,
  l_quantity AS volume, (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey AS seq FROM lineitem JOIN part ON l_partkey = p_partkey)"""
BARS = TICKS + """,
bars AS (SELECT symbol, ts, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, seq) AS close, sum(volume) AS volume FROM ticks GROUP BY symbol, ts)"""
RETURNS = BARS + """,
rets AS (SELECT * FROM (SELECT symbol, ts, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM bars)
  WHERE ret IS NOT NULL)"""
EVENTS = """
ev AS (SELECT event_type AS symbol, ts, event_id AS seq, value AS price,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume, user_id FROM events)"""
