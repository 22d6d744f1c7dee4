"""Trade logs as CSV and JSON. Log rows: ts, symbol, side, qty, price, commission, slippage, strategy, metadata map."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ["ts", "symbol", "side", "qty", "price", "commission", "slippage", "strategy"]
MOMENT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"  #: keeps microseconds and the zone
SCHEMA = ("ts timestamp, symbol string, side string, qty double, price double, commission double, slippage double, strategy string, metadata map<string,string>")


def metadata_columns(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The map as one ``metadata_<key>`` column per named key."""
    return log.select(*FIELDS, *[F.try_element_at("metadata", F.lit(k)).alias(f"metadata_{k}") for k in keys])


def fold_metadata(flat: DataFrame) -> DataFrame:
    """``metadata_*`` columns back to a map without the empty ones."""
    keys = [c for c in flat.columns if c.startswith("metadata_")]
    if not keys:
        return flat.select(*FIELDS, F.create_map().cast("map<string,string>").alias("metadata"))
    m = F.map_from_arrays(F.array(*[F.lit(k[len("metadata_"):]) for k in keys]), F.array(*[F.col(k).cast("string") for k in keys]))
    return flat.select(*FIELDS, F.map_filter(m, lambda k, v: v.isNotNull()).alias("metadata"))


def first_keys(log: DataFrame) -> list[str]:
    """Metadata keys of the first record, the ones a CSV export carries."""
    row = log.orderBy("ts").select(F.map_keys("metadata")).limit(1).collect()
    return sorted(row[0][0] or []) if row else []


def write_csv(log: DataFrame, path: str, keys: Sequence[str] | None = None) -> None:
    metadata_columns(log, first_keys(log) if keys is None else keys).write.mode("overwrite").csv(path, header=True, timestampFormat=MOMENT, escape='"', emptyValue='""')


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a CSV log; missing metadata stays out of the map, and text may hold quotes and line ends."""
    d = spark.read.csv(path, header=True, multiLine=True, escape='"')
    types = dict(f.strip().split(" ") for f in SCHEMA.split(", ")[:8])
    return fold_metadata(d.withColumns({c: F.col(c).cast(types[c]) for c in FIELDS}))


def write_json(log: DataFrame, path: str) -> None:
    log.select(*FIELDS, "metadata").write.mode("overwrite").json(path, timestampFormat=MOMENT)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path, timestampFormat=MOMENT)
