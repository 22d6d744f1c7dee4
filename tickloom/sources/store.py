"""Bar tables: scans, upserts, catalog and files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core.slices import over_rows

C = F.col
KEY = ("symbol", "ts", "interval")


def scan(bars: DataFrame, symbol: str | None = None, start: str | None = None, end: str | None = None, interval: str | None = None) -> DataFrame:
    """Plain predicates, so partitions are pruned and the rest is pushed to the files. Full timestamps are kept."""
    d = bars
    if symbol is not None:
        d = d.where(C("symbol") == symbol)
    if interval is not None:
        d = d.where(C("interval") == interval)
    if start is not None:
        d = d.where(C("ts") >= F.lit(start).cast(bars.schema["ts"].dataType))
    if end is not None:
        d = d.where(C("ts") <= F.lit(end).cast(bars.schema["ts"].dataType))
    return d


def upsert(existing: DataFrame, incoming: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Union keyed by ``key``; the incoming row wins. One combinable aggregate instead of a sort."""
    cols = [c for c in existing.columns if c not in key]
    u = existing.withColumn("_batch", F.lit(0)).unionByName(incoming.withColumn("_batch", F.lit(1)))
    g = u.groupBy(*key).agg(F.max_by(F.struct(*cols), "_batch").alias("s"))
    return g.select(*key, *[C(f"s.{c}").alias(c) for c in cols])


def append_keep_last(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(existing, incoming, ("symbol", "ts"))


def clear(bars: DataFrame, symbol: str | None = None) -> DataFrame:
    return bars.where(F.lit(False)) if symbol is None else bars.where(C("symbol") != symbol)


def catalog(bars: DataFrame, source: str = "unknown", frequency: str = "1d") -> DataFrame:
    g = bars.groupBy("symbol").agg(F.count("*").alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return g.withColumns({"source": F.lit(source), "frequency": F.lit(frequency)})


def infer_frequency(bars: DataFrame) -> DataFrame:
    """Most common gap in days per symbol (the smallest among equals)."""
    d = over_rows(bars, lambda x, w: x.withColumn("gap", F.date_diff("ts", F.lag("ts").over(w))), back=1).where("gap is not null")
    n = d.groupBy("symbol", "gap").agg(F.count("*").alias("_n"))
    return n.groupBy("symbol").agg(F.max_by("gap", F.struct("_n", -C("gap"))).alias("gap_days"))


def wide_to_panel(wide: DataFrame, symbols: Sequence[str], fields: Sequence[str] = ("open", "high", "low", "close", "volume"), sep: str = "_") -> DataFrame:
    """Vendor frames (ts, open_A, high_A, ..., open_B, ...) to (symbol, ts, open, ...)."""
    rows = F.array(*[F.struct(F.lit(s).alias("symbol"), *[C(f"`{f}{sep}{s}`").alias(f) for f in fields]) for s in symbols])
    return wide.select("ts", F.inline(rows)).where(C(fields[3] if len(fields) > 3 else fields[0]).isNotNull())


class BarStore:
    """Bars under one folder, partitioned by interval and symbol; writes replace only touched partitions."""

    def __init__(self, spark: SparkSession, path: str, format: str = "parquet"):
        self.spark, self.path, self.format = spark, path, format

    def _write(self, df: DataFrame) -> None:
        (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("interval", "symbol").format(self.format).save(self.path))

    def exists(self) -> bool:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(root)

    def save(self, bars: DataFrame) -> None:
        self._write(bars)

    def replace(self, bars: DataFrame) -> None:
        """Write the partitions named in ``bars``, which may itself read them."""
        from ..session import durable
        self._write(durable(bars))

    def load(self, symbol: str | None = None, start: str | None = None, end: str | None = None, interval: str | None = None) -> DataFrame:
        found = self.spark.read.format(self.format).load(self.path).schema
        # partition values stay text: "1d" would otherwise be read as a number
        typed = T.StructType([T.StructField(f.name, T.StringType()) if f.name in ("interval", "symbol") else f for f in found.fields])
        return scan(self.spark.read.schema(typed).format(self.format).load(self.path), symbol, start, end, interval)

    def put(self, bars: DataFrame) -> None:
        """Upsert: only partitions named in the batch are read and rewritten."""
        from ..session import durable
        touched = bars.select("interval", "symbol").distinct()
        if not self.exists():
            self._write(bars)
            return
        old = self.load().join(touched, ["interval", "symbol"], "left_semi").select(*bars.columns)
        self._write(durable(upsert(old, bars)))

    def symbols(self) -> DataFrame:
        return self.load().select("symbol").distinct()

    def save_described(self, bars: DataFrame, source: str = "unknown", frequency: str = "1d") -> None:
        """Save ``bars`` and, beside them, what :meth:`described` lists of every symbol saved; other symbols keep their rows and entries."""
        from ..session import durable
        self._write(bars.withColumn("interval", F.lit(frequency)))
        saved = self.load(interval=frequency).join(bars.select("symbol").distinct(), "symbol", "left_semi")
        fresh = catalog(saved, source, frequency).withColumn("last_updated", F.current_timestamp())
        if BarStore(self.spark, self._entries).exists():
            fresh = upsert(self.described(), fresh, ("symbol", "frequency"))
        durable(fresh).write.mode("overwrite").parquet(self._entries)

    @property
    def _entries(self) -> str:
        return self.path.rstrip("/") + "-described"

    def described(self) -> DataFrame:
        """symbol, rows, first_ts, last_ts, source, frequency and last_updated of what was saved."""
        return self.spark.read.parquet(self._entries).select("symbol", "rows", "first_ts", "last_ts", "source", "frequency", "last_updated")

    def load_regular(self, symbol: str | None = None, start: str | None = None, end: str | None = None, interval: str | None = None) -> DataFrame:
        """Bars of the range with ``gap_days``, the symbol's most common gap within it (null for a single bar)."""
        d = self.load(symbol, start, end, interval)
        return d.join(infer_frequency(d), "symbol", "left")

    def metadata(self, source: str = "unknown", frequency: str = "1d") -> DataFrame:
        return catalog(self.load(), source, frequency)

    def delete(self, symbol: str) -> None:
        """Drop one symbol's partitions through the file system Spark itself uses."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        name = "symbol=" + jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(symbol)
        for st in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/interval=*")) or []:
            fs.delete(jvm.org.apache.hadoop.fs.Path(st.getPath(), name), True)

    def migrate(self, path: str, format: str) -> "BarStore":
        other = BarStore(self.spark, path, format)
        other.save(self.load())
        return other
