"""Structured Streaming operators: bars, books, quotes, anomalies, fan-out and health."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

C = F.col


def tick_stream(spark: SparkSession, path: str, schema: str, format: str = "parquet", glob: str | None = None, files_per_trigger: int = 16) -> DataFrame:
    r = spark.readStream.schema(schema).format(format).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path)


def bars(stream: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    """OHLCV per symbol and event-time window; a tick later than the watermark is left out, an empty window gives nothing.

    The window sums are built on the map side of every micro-batch, so a busy symbol is combined before it is shuffled.
    """
    o = F.struct("ts", "seq")
    g = stream.withWatermark("ts", late).groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.min("ts").alias("first_trade"), F.min_by("price", o).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", o).alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("trades"))
    return g.select("symbol", C("w.start").alias("bar"), "first_trade", "open", "high", "low", "close", "volume", "trades")


def book_levels(stream: DataFrame) -> DataFrame:
    """Current size per (session, symbol, side, price) in update mode; size 0 deletes the level.

    A reconnect starts a new ``session`` and with it an empty book. State is one small row per level,
    so a busy symbol's book is spread over many tasks.
    """
    g = stream.groupBy("session", "symbol", "side", "price").agg(F.max_by("size", F.struct("ts", "seq")).alias("size"), F.max("seq").alias("seq"))
    return g.withColumn("deleted", C("size") <= 0)


def quotes(stream: DataFrame) -> DataFrame:
    from ..operators.ticks import spread_metrics
    return spread_metrics(stream)


def tick_jumps(stream: DataFrame, limit: float = 0.01) -> DataFrame:
    """Trades more than ``limit`` away from the previous trade of their symbol; the state is one price per symbol.

    Rows of a symbol arrive in batches and are sorted by (ts, seq) inside each micro-batch.
    """
    out = "symbol string, ts timestamp, seq long, price double, prev_price double, move double"

    def step(key, frames, state: GroupState):
        last = state.get[0] if state.exists else None
        found = []
        pdf = pd.concat(list(frames)).sort_values(["ts", "seq"])
        prev = pdf["price"].shift(1)
        if last is not None and len(prev):
            prev.iloc[0] = last
        move = pdf["price"] / prev - 1
        hit = move.abs() > limit
        state.update((float(pdf["price"].iloc[-1]),))
        yield pd.DataFrame({"symbol": key[0], "ts": pdf["ts"], "seq": pdf["seq"], "price": pdf["price"], "prev_price": prev, "move": move})[hit]

    return stream.select("symbol", "ts", "seq", "price").groupBy("symbol").applyInPandasWithState(step, out, "price double", "append", GroupStateTimeout.NoTimeout)


def fan_out(sinks: Mapping[str, Callable[[DataFrame, int], None]], failures: list | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that hands every micro-batch to several sinks; one failing sink does not stop the others.

    ``failures`` collects (sink, epoch, error).
    """
    def run(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            for name, sink in sinks.items():
                try:
                    sink(batch, epoch)
                except Exception as e:  # the other sinks still get the batch
                    if failures is not None:
                        failures.append((name, epoch, repr(e)))
        finally:
            batch.unpersist()
    return run


def bar_sink(store) -> Callable[[DataFrame, int], None]:
    """Micro-batches of trades merged into the daily bars of a :class:`sources.store.BarStore`.

    A bar split over micro-batches is completed, not replaced: open and close follow the trade
    number, volumes add up. The newest epoch is kept with each bar, so a replayed batch changes nothing.
    """
    def run(batch: DataFrame, epoch: int) -> None:
        b = batch.groupBy("symbol", F.to_date("ts").alias("ts")).agg(
            F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"),
            F.sum("volume").alias("volume"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
        b = b.withColumns({"interval": F.lit("1d"), "epoch": F.lit(epoch).cast("long")})
        if b.isEmpty():
            return
        if store.exists():
            old = store.load().join(b.select("symbol", "interval").distinct(), ["symbol", "interval"], "left_semi").select(*b.columns)
            done = old.where(C("epoch") >= epoch).select("symbol", "interval", "ts")
            u = old.unionByName(b.join(done, ["symbol", "interval", "ts"], "left_anti"))
            b = u.groupBy("symbol", "interval", "ts").agg(
                F.min_by("open", "first_seq").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "last_seq").alias("close"),
                F.sum("volume").alias("volume"), F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"), F.max("epoch").alias("epoch"))
        store.replace(b)
    return run


def feed_health(events: DataFrame, now, feed: str = "feed", healthy: int = 60, degraded: int = 300) -> DataFrame:
    """Age of the newest event per feed: healthy below 60 s, degraded below 300 s, else unhealthy."""
    g = events.groupBy(feed).agg(F.max("ts").alias("last_ts"))
    age = F.unix_timestamp(now) - F.unix_timestamp("last_ts")
    return g.withColumn("age", age).withColumn("status", F.when(C("age") < healthy, "healthy").when(C("age") < degraded, "degraded").otherwise("unhealthy"))


def overall_health(health: DataFrame) -> DataFrame:
    """unhealthy before degraded before healthy; unknown without any feed."""
    any_of = lambda s: F.bool_or(C("status") == s)
    return health.agg(F.when(any_of("unhealthy"), "unhealthy").when(any_of("degraded"), "degraded").when(any_of("healthy"), "healthy").otherwise("unknown").alias("status"), F.count("*").alias("feeds"))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything that is there and stop."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def run_batches(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    q = stream.writeStream.foreachBatch(fn).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
