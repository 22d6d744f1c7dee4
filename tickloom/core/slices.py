"""Ordered series cut into bounded slices.

A plain ``Window.partitionBy(symbol).orderBy(ts)`` hands a whole series to one task. Here a
series is cut along its order into slices of about ``rows`` rows, so one hot key is spread
over many tasks:

1. count rows per (key, coarse bin of the order column): a partial aggregate, a few bytes per bin;
2. prefix-sum the counts: the global offset of each bin, hence the slice it belongs to and the
   neighbouring slices that must also see it (the halo, for frames reaching ``back`` / ``ahead`` rows);
3. join the bin map to the rows (Spark broadcasts it only while it is small), copy halo bins to
   their neighbours, and shuffle once by (key, slice).

Frames of at most ``back`` / ``ahead`` rows are then exact inside a slice. Unbounded running
aggregates add one more partial aggregate per bin and a prefix over bins.

A bin that holds more than ``rows`` rows is cut again by :func:`fitted` before step 2, at splitters that a
quantile sketch of that bin alone gives, and its pieces are counted, until every piece fits. What remains
whole are rows that are equal in all order columns.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import durable

ROWS_PER_SLICE = 250_000

_INTERNAL = ("_bin", "_begin", "_slice", "_own", "_total")
FAN = 64  #: splitters of a bin that is cut again, at most
SKETCH = 2_000  #: accuracy of the quantile sketch: a piece is off by at most 1 / SKETCH of its bin


def time_bin(unit: str, column: str) -> Column:
    return F.date_trunc(unit, F.col(column))


def value_bin(column: str | Column) -> Column:
    """A monotone bin of a number with a relative width of about two per cent."""
    c = (F.col(column) if isinstance(column, str) else column).cast("double")
    # asinh of the absolute value: the formula loses all digits for large negative numbers
    return F.floor(F.signum(c) * F.asinh(F.abs(c) * F.lit(1e6)) * F.lit(50.0))


def match(df: DataFrame, side: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """``df`` joined with ``side`` on ``keys``, where null equals null; the keys come from ``df``."""
    other = side.withColumnsRenamed({k: f"_m_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_m_{k}")) for k in keys]
    return df.join(other, same, how).drop(*[f"_m_{k}" for k in keys])


class Series:
    """A keyed, ordered frame spread over slices. Built by :func:`spread`."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence, bins: DataFrame, halo: bool, rolled: bool = False):
        self.df = df
        self.keys = list(keys)
        self.order = [F.col(c) if isinstance(c, str) else c for c in order]
        self.bins, self.halo, self.rolled = bins, halo, rolled

    @property
    def w(self):
        return Window.partitionBy(*self.keys, "_slice").orderBy(*self.order)

    def rows(self, first: int, last: int = 0):
        return self.w.rowsBetween(first, last)

    def _with(self, df: DataFrame, rolled: bool | None = None) -> "Series":
        return Series(df, self.keys, self.order, self.bins, self.halo, self.rolled if rolled is None else rolled)

    def _fresh(self) -> "Series":
        """Hand the rows out again, so that halo rows carry the values their own slice computed."""
        own = self.df.where("_own").drop("_begin", "_slice", "_own", "_total")
        return self._with(_place(own, self.bins, self.keys), False)

    def roll(self, fn: Callable[[DataFrame, "Window"], DataFrame]) -> "Series":
        """Apply ``fn(frame, window)``; frames must stay inside the declared back/ahead."""
        return self._with(fn(self.df, self.w), True)

    def col(self, **cols: Column) -> "Series":
        df = self.df
        for name, c in cols.items():
            df = df.withColumn(name, c)
        return self._with(df)

    def position(self, name: str = "pos") -> "Series":
        """Zero-based global row number of the series."""
        return self.col(**{name: F.first("_begin").over(self.w) + F.row_number().over(self.w).cast("long") - 1})

    def run(self, **specs: tuple[str, Column]) -> "Series":
        """Running aggregates from the start of the series to the current row.

        Each spec is (kind, column), kind one of sum, count, max, min, product, last, first. After a
        roll the first halo rows hold values of incomplete frames, so the rows are handed out again.
        """
        if self.halo and self.rolled:
            return self._fresh().run(**specs)
        own = self.df.where("_own")
        seq = F.struct(*self.order)

        def total(kind: str, c: Column) -> Column:
            if kind == "last":
                return F.max_by(c, F.when(c.isNotNull(), seq))
            if kind == "first":
                return F.min_by(c, F.when(c.isNotNull(), seq))
            return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min, "product": F.product}[kind](c)

        def running(kind: str, c: Column, frame) -> Column:
            if kind == "last":
                return F.last(c, ignorenulls=True).over(frame)
            if kind == "first":
                return F.first(c, ignorenulls=True).over(frame)
            return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min, "product": F.product}[kind](c).over(frame)

        totals = own.groupBy(*self.keys, "_bin").agg(*[total(k, c).alias(f"_t_{n}") for n, (k, c) in specs.items()])
        before = Window.partitionBy(*self.keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        carry_kind = {"count": "sum"}
        carry = totals.select(
            *self.keys,
            "_bin",
            *[running(carry_kind.get(k, k), F.col(f"_t_{n}"), before).alias(f"_c_{n}") for n, (k, c) in specs.items()],
        )
        df = match(self.df, carry, self.keys + ["_bin"])
        frame = self.rows(Window.unboundedPreceding, 0)
        for n, (k, c) in specs.items():
            local = running(k, c, frame)
            # the carry of the first row of the slice is everything before the slice
            into = F.first(F.struct(F.col(f"_c_{n}").alias("v"))).over(frame)["v"]
            if k in ("sum", "count"):
                out = F.when(local.isNull() & into.isNull(), None).otherwise(
                    F.coalesce(local, F.lit(0)) + F.coalesce(into, F.lit(0)))
            elif k == "product":
                out = F.when(local.isNull() & into.isNull(), None).otherwise(
                    F.coalesce(local, F.lit(1.0)) * F.coalesce(into, F.lit(1.0)))
            elif k == "max":
                out = F.greatest(local, into)
            elif k == "min":
                out = F.least(local, into)
            elif k == "last":
                out = F.coalesce(local, into)
            else:
                out = F.coalesce(into, local)
            df = df.withColumn(n, out)
        return self._with(df.drop(*[f"_c_{n}" for n in specs]))

    def done(self, *drop: str) -> DataFrame:
        return self.df.where("_own").drop(*_INTERNAL, *drop)


NULL_BIN = 1 << 62


def _sortable(df: DataFrame, order: Sequence) -> list[str]:
    """The leading order columns that a quantile sketch takes."""
    out = []
    for c in order:
        if not isinstance(c, str) or not isinstance(df.schema[c].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            break
        out.append(c)
    return out


def _counts(df: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Rows of every bin, and the first order column that differs inside it (none: all rows are equal)."""
    ends = [f(n).alias(f"_{k}{i}") for i, n in enumerate(names) for k, f in (("lo", F.min), ("hi", F.max), ("c", F.count))]
    g = df.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n"), *ends)
    some = [F.when((F.col(f"_lo{i}") < F.col(f"_hi{i}")) | ((F.col(f"_c{i}") > 0) & (F.col(f"_c{i}") < F.col("_n"))), i) for i in range(len(names))]
    return g.select(*keys, "_bin", "_n", F.coalesce(*some, F.lit(None).cast("int")).alias("_by"))


def fitted(df: DataFrame, keys: Sequence[str], order: Sequence, rows: int, only: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``_bin`` cut until no bin holds more than ``rows`` rows of different order, and (keys, _bin, _n, _by).

    Every round counts the pieces of the last one and cuts those that are too large at up to FAN splitters; values
    equal to a splitter are a piece of their own. The number of rounds follows the logarithm of the largest bin,
    whatever its values; without a large bin there is only the count that :func:`bin_map` needs anyway. The counts are a
    checkpoint of one short row per bin. ``only`` picks the bins that matter (of the counts); others stay as they are.
    """
    keys, names = list(keys), _sortable(df, order)
    pick = only or (lambda c: c)
    counts = durable(_counts(df, keys, names))
    if not names:
        return df, counts
    while True:
        large = pick(counts).where((F.col("_n") > rows) & F.col("_by").isNotNull()).select(*keys, "_bin", "_by")
        if large.isEmpty():
            return df, counts
        probs = [i / FAN for i in range(1, FAN)]
        sketch = [F.percentile_approx(F.when(F.col("_by") == i, F.col(n)), probs, SKETCH).alias(f"_cut{i}") for i, n in enumerate(names)]
        cuts = durable(match(df, large, keys + ["_bin"], "inner").groupBy(*keys, "_bin").agg(*sketch))
        df = match(df, cuts, keys + ["_bin"])
        side = [F.when(F.col(f"_cut{i}").isNotNull(), F.coalesce(_place_among(f"_cut{i}", n), F.lit(-1))) for i, n in enumerate(names)]
        df = df.withColumn("_now", F.coalesce(*side).isNotNull()).withColumn("_bin", F.struct(F.col("_bin").alias("b"), F.coalesce(*side, F.lit(0)).alias("s")))
        df = df.drop(*[f"_cut{i}" for i in range(len(names))])
        kept = match(counts, large.select(*keys, "_bin"), keys + ["_bin"], "left_anti")
        kept = kept.withColumn("_bin", F.struct(F.col("_bin").alias("b"), F.lit(0).alias("s")))
        counts = durable(kept.select(*keys, "_bin", "_n", "_by").unionByName(_counts(df.where("_now"), keys, names)))
        df = df.drop("_now")


def _place_among(cuts: str, value: str) -> Column:
    """Twice the number of splitters below ``value``, plus one where it equals a splitter."""
    return F.aggregate(F.array_distinct(cuts), F.lit(0), lambda n, c: n + F.when(c < F.col(value), 2).when(c == F.col(value), 1).otherwise(0))


def bin_map(df: DataFrame, keys: Sequence[str], rows: int, back: int = 0, ahead: int = 0, counts: DataFrame | None = None) -> DataFrame:
    """(keys, _bin) -> _begin, the slices that need the bin and the rows of the key outside the
    null bin. ``df`` carries ``_bin``; ``counts`` are its (keys, _bin, _n) where they are known."""
    keys = list(keys)
    counts = df.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n")) if counts is None else counts.select(*keys, "_bin", "_n")
    w = Window.partitionBy(*keys).orderBy("_bin")
    m = counts.withColumn(
        "_begin", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    m = m.withColumn("_slice", F.floor(F.col("_begin") / F.lit(rows)).cast("long"))
    own = F.struct(F.col("_slice"), F.lit(True).alias("_own"))
    if not back and not ahead:
        first = "_bin"  # the bin before it was cut again
        kind = df.schema["_bin"].dataType
        while isinstance(kind, T.StructType):
            first, kind = first + ".b", kind["b"].dataType
        total = F.sum(F.when(F.col(first) == F.lit(NULL_BIN), 0).otherwise(F.col("_n"))).over(Window.partitionBy(*keys))
        if not isinstance(kind, T.LongType):
            total = F.sum("_n").over(Window.partitionBy(*keys))
        return m.select(*keys, "_bin", "_begin", total.alias("_total"), F.array(own).alias("_to"))
    ws = Window.partitionBy(*keys, "_slice")
    m = m.withColumn("_s0", F.min("_begin").over(ws)).withColumn("_s1", F.max(F.col("_begin") + F.col("_n")).over(ws))
    m = m.withColumn("_d", F.dense_rank().over(Window.partitionBy(*keys).orderBy("_slice")))
    wd = Window.partitionBy(*keys).orderBy("_d")
    targets = [own]
    end = F.col("_begin") + F.col("_n")
    for step in (1, 2):
        if back:
            m = m.withColumn(f"_n{step}", F.first(F.struct("_slice", "_s0", "_s1")).over(wd.rangeBetween(step, step)))
            near = F.col(f"_n{step}._s0") - F.lit(back) < end
            targets.append(F.when(near, F.struct(F.col(f"_n{step}._slice").alias("_slice"), F.lit(False).alias("_own"))))
        if ahead:
            m = m.withColumn(f"_p{step}", F.first(F.struct("_slice", "_s0", "_s1")).over(wd.rangeBetween(-step, -step)))
            near = F.col(f"_p{step}._s1") + F.lit(ahead) > F.col("_begin")
            targets.append(F.when(near, F.struct(F.col(f"_p{step}._slice").alias("_slice"), F.lit(False).alias("_own"))))
    return m.select(*keys, "_bin", "_begin", F.filter(F.array(*targets), lambda t: t.isNotNull()).alias("_to"))


def spread(
    df: DataFrame,
    back: int = 0,
    ahead: int = 0,
    keys: Sequence[str] = ("symbol",),
    order: Sequence = ("ts",),
    bin: str | Column = "month",
    rows: int | None = None,
) -> Series:
    """Cut each series of ``df`` into slices; ``bin`` is a date_trunc unit of the first order
    column or any column that never decreases along the order. Bins of more rows than a slice are cut again.
    A series ordered by a date alone has one row a day and is spared the count: a month of it is small by definition."""
    rows = max(rows or ROWS_PER_SLICE, back, ahead, 1)
    b = time_bin(bin, order[0]) if isinstance(bin, str) else bin
    daily = isinstance(bin, str) and len(order) == 1 and isinstance(df.schema[order[0]].dataType, T.DateType)
    df, counts = (df.withColumn("_bin", b), None) if daily else fitted(df.withColumn("_bin", b), keys, order, rows)
    m = bin_map(df, keys, rows, back, ahead, counts)
    return Series(_place(df, m, keys), keys, order, m, bool(back or ahead))


def _place(df: DataFrame, bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    j = match(df, bins, list(keys) + ["_bin"], "inner").withColumn("_to", F.explode("_to"))
    return j.withColumns({"_slice": F.col("_to._slice"), "_own": F.col("_to._own")}).drop("_to")


def over_rows(df: DataFrame, fn, back: int = 0, ahead: int = 0, **kw) -> DataFrame:
    """``spread`` + one ``roll`` + ``done``."""
    return spread(df, back, ahead, **kw).roll(fn).done()


def decay_rows(alpha: float, floor: float = 1e-17) -> int:
    """Rows after which the weight (1-alpha)^k of an exponential mean is below ``floor``."""
    return max(1, math.ceil(math.log(floor) / math.log(1 - alpha)))


def affine(df: DataFrame, a: Column, b: Column, w, reach: int, out: str) -> DataFrame:
    """y[t] = a[t]*y[t-1] + b[t] over the window by doubling; a = 0 restarts the recursion.

    ``reach`` is how many rows back a value can still matter (the whole slice if a does not decay).
    """
    df = df.withColumn("_a", a).withColumn("_b", b)
    k = 1
    while k < reach:
        df = df.withColumns({
            "_b": F.col("_a") * F.coalesce(F.lag("_b", k).over(w), F.lit(0.0)) + F.col("_b"),
            "_a": F.col("_a") * F.coalesce(F.lag("_a", k).over(w), F.lit(1.0)),
        })
        k *= 2
    return df.withColumn(out, F.col("_b")).drop("_a", "_b")


def emas(df: DataFrame, w, specs: Sequence[tuple[str, float, str]]) -> DataFrame:
    """Exponential means seeded with the first value (adjust=False): (value, alpha, out) each.

    y[t] = sum of (1-alpha)^j * b[t-j] with b = alpha*x, or x on the first row of the window, so
    one lag per doubling round is enough; all means advance in the same round and share the sort.
    The halo must hold :func:`decay_rows` rows, beyond which weights vanish in double precision.
    """
    first = F.row_number().over(w) == 1
    df = df.withColumn("_first", first)
    df = df.withColumns({o: F.when(F.col("_first"), F.col(v).cast("double")).otherwise(F.lit(a) * F.col(v)) for v, a, o in specs})
    k = 1
    reach = {o: decay_rows(a) + 1 for _, a, o in specs}
    while any(k < r for r in reach.values()):
        df = df.withColumns({o: F.col(o) + F.lit((1 - a) ** k) * F.coalesce(F.lag(o, k).over(w), F.lit(0.0))
                             for _, a, o in specs if k < reach[o]})
        k *= 2
    return df.drop("_first")


def decayed_sums(df: DataFrame, w, specs: Sequence[tuple[str, float, str]], floor: float = 1e-17) -> DataFrame:
    """sum over earlier rows of decay^age * value: (value, decay, out) each, nulls adding nothing."""
    df = df.withColumns({o: F.coalesce(F.col(v).cast("double"), F.lit(0.0)) for v, _, o in specs})
    reach = {o: decay_rows(1 - l, floor) for _, l, o in specs}
    k = 1
    while any(k < r for r in reach.values()):
        df = df.withColumns({o: F.col(o) + F.lit(l ** k) * F.coalesce(F.lag(o, k).over(w), F.lit(0.0)) for _, l, o in specs if k < reach[o]})
        k *= 2
    return df


def span(n: float) -> float:
    return 2.0 / (n + 1)


def ema_back(*spans: float) -> int:
    """Halo rows for exponential means applied one after the other."""
    return sum(decay_rows(span(n)) + 1 for n in spans)


def chunks_of(df: DataFrame, keys: Sequence[str], chunk: int) -> int:
    """Chunks of ``chunk`` rows in the longest series: one count a key, one number to the driver."""
    longest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    return max(1, -(-longest // chunk))


def affine_run(df: DataFrame, a: Column, b: Column, out: str, keys=("symbol",), order=("ts",),
               bin: str | Column = "month", chunk: int = 4096) -> DataFrame:
    """Exact affine recursion over whole series, for coefficients that need not decay.

    Rows are numbered, cut into chunks of exactly ``chunk`` rows and scanned in parallel; the
    composed maps of the chunks (one row each) are scanned next; the carry is applied last. The
    depth of that second scan comes from the longest series.
    """
    keys = list(keys)
    chunks = chunks_of(df, keys, chunk)
    s = spread(df.withColumn("_a", a).withColumn("_b", b), keys=keys, order=order, bin=bin).position("_pos")
    d = s.done().withColumn("_chunk", F.floor(F.col("_pos") / F.lit(chunk)).cast("long"))
    d = _double(d, "_a", "_b", Window.partitionBy(*keys, "_chunk").orderBy("_pos"), chunk)
    tail = d.groupBy(*keys, "_chunk").agg(F.max_by("_a", "_pos").alias("_ta"), F.max_by("_b", "_pos").alias("_tb"))
    ws = Window.partitionBy(*keys).orderBy("_chunk")
    tail = _double(tail, "_ta", "_tb", ws, chunks)
    carry = tail.select(*keys, "_chunk", F.lag("_tb", 1).over(ws).alias("_in"))
    d = match(d, carry, keys + ["_chunk"])
    return d.withColumn(out, F.col("_a") * F.coalesce("_in", F.lit(0.0)) + F.col("_b")).drop("_a", "_b", "_in", "_pos", "_chunk")


def _double(df: DataFrame, a: str, b: str, w, reach: int) -> DataFrame:
    k = 1
    while k < reach:
        df = df.withColumns({
            b: F.col(a) * F.coalesce(F.lag(b, k).over(w), F.lit(0.0)) + F.col(b),
            a: F.col(a) * F.coalesce(F.lag(a, k).over(w), F.lit(1.0)),
        })
        k *= 2
    return df
