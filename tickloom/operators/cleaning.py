"""Cleaning and preparation of price panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core.ranking import quantiles
from ..core.slices import match, over_rows, spread
from ..session import durable
from .indicators import change, mean, std

C = F.col
PRICES = ("open", "high", "low", "close")


def _bfill(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """After a forward fill only leading nulls are left: the first value of the series fills them."""
    first = df.groupBy(*keys).agg(*[F.min_by(c, F.when(C(c).isNotNull(), C("ts"))).alias(f"_f_{c}") for c in columns])
    return match(df, first, list(keys)).withColumns({c: F.coalesce(c, f"_f_{c}") for c in columns}).drop(*[f"_f_{c}" for c in columns])


def fill_forward(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    s = spread(df, keys=keys).run(**{f"_r_{c}": ("last", C(c)) for c in columns})
    d = s.done().withColumns({c: C(f"_r_{c}") for c in columns}).drop(*[f"_r_{c}" for c in columns])
    return _bfill(d, columns, keys)


def interpolate(df: DataFrame, column: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Linear in elapsed time; trailing nulls take the last value, leading ones the first."""
    at = F.unix_micros(C("ts").cast("timestamp"))
    known = F.when(C(column).isNotNull(), F.struct(at.alias("t"), C(column).alias("v")))
    d = durable(spread(df, keys=keys).run(_p=("last", known)).done().withColumn("_neg", -at))
    month = 2_592_000 * 1_000_000
    d = spread(d, keys=keys, order=["_neg"], bin=F.floor(C("_neg") / month)).run(_n=("last", known)).done()
    slope = (C("_n.v") - C("_p.v")) / (C("_n.t") - C("_p.t"))
    v = F.coalesce(C(column), C("_p.v") + slope * (at - C("_p.t")), C("_p.v"), C("_n.v"))
    return d.withColumn(column, v).drop("_p", "_n", "_neg")


def drop_missing(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def clip_outliers(df: DataFrame, k: float = 5.0) -> DataFrame:
    """Clip returns at mean +- k std; a symbol with any outlier gets its closes rebuilt from the clipped returns."""
    r = over_rows(df, lambda d, w: d.withColumn("_r", change("close", 1, w)), back=1)
    stats = r.groupBy("symbol").agg(F.avg("_r").alias("_m"), F.stddev_samp("_r").alias("_s"), F.max("_r").alias("_hi"),
                                    F.min("_r").alias("_lo"), F.min_by("close", "ts").alias("_c0"))
    stats = stats.withColumns({"_a": C("_m") - k * C("_s"), "_b": C("_m") + k * C("_s")})
    stats = stats.withColumn("_any", F.coalesce((C("_s") > 0) & ((C("_hi") > C("_b")) | (C("_lo") < C("_a"))), F.lit(False)))
    d = match(r, stats.drop("_m", "_s", "_hi", "_lo"), ["symbol"])
    factor = 1 + F.least(F.greatest("_r", "_a"), C("_b"))
    d = spread(d).run(_g=("product", F.when(C("_r").isNotNull(), factor))).done()
    rebuilt = F.when(C("_any") & C("_r").isNotNull(), C("_c0") * C("_g")).otherwise(C("close"))
    return d.withColumn("close", rebuilt).drop("_r", "_a", "_b", "_c0", "_any", "_g")


def validate(df: DataFrame) -> DataFrame:
    """Prices and volume at least zero; high and low swapped into order where they are crossed."""
    d = df.withColumns({c: F.greatest(C(c), F.lit(0.0)) for c in PRICES})
    return d.withColumns({"high": F.greatest("high", "low"), "low": F.least("high", "low"), "volume": F.greatest(C("volume"), F.lit(0.0))})


def preprocess(df: DataFrame, fill: str = "ffill", outliers: bool = True, k: float = 5.0) -> DataFrame:
    cols = [*PRICES, "volume"]
    if fill == "drop":
        d = drop_missing(df)
    elif fill == "interpolate":
        d = df
        for c in cols:
            d = interpolate(d, c)
    else:
        d = fill_forward(df, cols)
    return validate(clip_outliers(durable(d), k) if outliers else d)


def adjust_splits(df: DataFrame, splits: DataFrame) -> DataFrame:
    """Rows before a split date: prices / ratio, volume * ratio; ratios 0 and 1 are ignored."""
    s = splits.where("ratio not in (0, 1)").groupBy("symbol").agg(F.collect_list(F.struct("date", "ratio")).alias("_s"))
    d = df.join(s, "symbol", "left")
    factor = F.aggregate(F.filter(F.coalesce("_s", F.array().cast(s.schema["_s"].dataType)), lambda e: C("ts") < e["date"]), F.lit(1.0), lambda a, e: a * e["ratio"])
    d = d.withColumn("_f", factor)
    return d.withColumns({**{c: C(c) / C("_f") for c in PRICES}, "volume": C("volume") * C("_f")}).drop("_s", "_f")


def quality_report(df: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Completeness and missing share of the cells, covered days, median day gap and rows."""
    keys = list(keys)
    cells = [c for c in df.columns if c not in (*keys, "ts")]
    day = lambda c: F.floor(F.unix_timestamp(C(c).cast("timestamp")) / 86400)
    d = durable(over_rows(df, lambda x, w: x.withColumn("_gap", (day("ts") - F.lag(day("ts")).over(w)).cast("double")), back=1, keys=keys))
    filled = sum([F.count(c) for c in cells[1:]], F.count(cells[0]))
    g = d.groupBy(*keys).agg((filled / (F.count("*") * len(cells)) * 100).alias("completeness"), F.count("*").alias("rows"),
                             (day_span := F.max(day("ts")) - F.min(day("ts"))).alias("coverage_days"))
    gap = quantiles(d, keys, "_gap", [0.5], "_q").select(*keys, C("_q")[0].alias("median_gap"))
    return g.withColumn("missing_pct", 100 - C("completeness")).join(gap, keys, "left")


def technical_report(df: DataFrame) -> DataFrame:
    """Size estimate, rows, columns, numeric columns and bytes per row (JSON length of the rows)."""
    numeric = sum(f.dataType.simpleString() in ("double", "float", "int", "bigint", "smallint", "tinyint") for f in df.schema.fields)
    g = df.agg(F.sum(F.length(F.to_json(F.struct(*df.columns)))).alias("bytes"), F.count("*").alias("rows"))
    return g.withColumns({"columns": F.lit(len(df.columns)), "numeric_columns": F.lit(numeric),
                          "bytes_per_row": F.when(C("rows") > 0, C("bytes") / C("rows")).otherwise(0.0)})


def training_windows(df: DataFrame, value: str | Sequence[str], target: str, lookback: int) -> DataFrame:
    """x = the previous ``lookback`` values (structs for several features), y = the current target."""
    def f(d, w):
        item = C(value) if isinstance(value, str) else F.struct(*value)
        return d.withColumn("x", F.collect_list(item).over(w.rowsBetween(-lookback, -1)))
    return over_rows(df, f, back=lookback).where(F.size("x") == lookback).withColumn("y", C(target))


def window_images(df: DataFrame, window: int = 20, indicators: Sequence[str] = ()) -> DataFrame:
    """Per row and window: OHLC over the first close, log volume over its maximum, then indicator rows."""
    def f(d, w):
        fr = w.rowsBetween(-(window - 1), 0)
        return d.withColumns({f"_{c}": F.collect_list(c).over(fr) for c in [*PRICES, "volume", *indicators]})
    d = over_rows(df, f, back=window).where(F.size("_close") == window)
    first = F.element_at("_close", 1)
    scaled = [F.transform(f"_{c}", lambda v: v / first) for c in PRICES]
    logs = F.transform("_volume", lambda v: F.log1p(v))
    peak = F.array_max(logs)
    vol = F.transform(logs, lambda v: F.when(peak > 0, v / peak).otherwise(0.0))
    return d.select("symbol", "ts", F.array(*scaled, vol, *[C(f"_{c}") for c in indicators]).alias("image"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    g = df.groupBy(label).agg(F.count("*").alias("n"))
    t = g.agg(F.sum("n").alias("_t"), F.count("*").alias("_k"))
    return g.join(t).select(label, "n", (C("_t") / (C("_k") * C("n"))).alias("weight"))  # one-row total


def feature_frame(df: DataFrame, windows: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """Returns, log returns, rolling volatility, means, price-to-mean ratios and volume ratio."""
    def f(d, w):
        d = d.withColumns({"ret": change("close", 1, w), "log_ret": F.log(C("close") / F.lag("close").over(w))})
        for n in windows:
            d = d.withColumns({f"vol_{n}": std("ret", n, w), f"sma_{n}": mean("close", n, w)})
            d = d.withColumn(f"ratio_{n}", C("close") / C(f"sma_{n}"))
        return d.withColumn("volume_ratio", C("volume") / mean("volume", 20, w))
    return over_rows(df, f, back=max([*windows, 20]) + 1)
