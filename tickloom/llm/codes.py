"""Product codes of vectors: whole-number codebooks trained by rounds, nearest entries by equal-average search.

Vectors are cut into parts, and every part position has its own codebook. A round is one pass over the table: each
task finds the nearest entry of every part, adds the parts up by entry, and sends one row per codebook number; the new
codebooks (entries x width numbers) are all that comes to the driver. Nothing but those sums is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LARGEST = 2**31  #: components of this size and more (after scaling) have no exact code
LONG = 2**63 - 1


@dataclass(frozen=True)
class Codebooks:
    """``books[part][entry]`` holds the components of an entry; ``width`` is the length of the vectors."""

    books: tuple[np.ndarray, ...]
    width: int
    scale: int

    @property
    def edges(self) -> list[int]:
        return [self.width * i // len(self.books) for i in range(len(self.books) + 1)]

    def sha256(self) -> str:
        """Digest of all components in decimal by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(int(c)) for b in self.books for c in b.ravel()).encode()).hexdigest()


def usable(vector: Column) -> Column:
    """Whether a vector is there and has neither null nor non-finite components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(False))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (ties to the lower) and the squared distance, for each row of ``x``.

    Entries are sorted by the sum of their components. From a row's own sum the search goes outward, the
    closer side first; the squared gap of the sums over the width is a lower bound of the distance, so
    it ends once that bound strictly exceeds the best distance found.
    """
    wide = book.shape[1]
    total = book.sum(axis=1)
    order = np.argsort(total, kind="stable")
    total = total[order]
    own = x.sum(axis=1)
    above = np.searchsorted(total, own)
    below = above - 1
    label, best = np.full(len(x), -1), own * 0
    far = 2**62
    on = np.arange(len(x))
    while len(on):
        lo, hi = below[on], above[on]
        down = np.where(lo >= 0, own[on] - total[np.maximum(lo, 0)], far)
        up = np.where(hi < len(book), total[np.minimum(hi, len(book) - 1)] - own[on], far)
        rise = up < down
        gap = np.where(rise, up, down)
        open_ = (gap < far) & ((label[on] < 0) | (gap * gap <= best[on] * wide))
        on, rise = on[open_], rise[open_]
        entry = order[np.where(rise, above[on], below[on])]
        off = x[on] - book[entry]
        dist = (off * off).sum(axis=1)
        win = (label[on] < 0) | (dist < best[on]) | ((dist == best[on]) & (entry < label[on]))
        label[on[win]], best[on[win]] = entry[win], dist[win]
        above[on[rise]] += 1
        below[on[~rise]] -= 1
    return label, best


def _whole(column: pa.Array, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the codebooks' width with every component within range, and their components floor(scale * x)."""
    n = np.asarray(column.value_lengths())
    fit = np.flatnonzero(n == books.width)
    if not len(fit) or not books.width:
        return fit, np.zeros((len(fit), books.width), np.int64)
    x = np.floor(np.asarray(column.take(pa.array(fit)).flatten()).astype(np.float64).reshape(len(fit), books.width) * books.scale)
    inside = (np.abs(x) < LARGEST).all(axis=1)
    return fit[inside], x[inside].astype(np.int64)


def _assigned(x: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of every part (rows x parts). Components too large for 64-bit squares are taken as Python integers."""
    largest = max(int(np.abs(x).max(initial=0)), *(int(np.abs(b).max(initial=0)) for b in books.books))
    exact = 2 * largest * max(books.width, 1) < 2**31
    e = books.edges
    found = [nearest(x[:, e[i]:e[i + 1]] if exact else x[:, e[i]:e[i + 1]].astype(object), b if exact else b.astype(object)) for i, b in enumerate(books.books)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _sums(batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[pa.RecordBatch]:
    """One row per codebook number that a task has parts for: its place, the count and the sum."""
    size, e = len(books.books[0]), books.edges
    count = np.zeros((len(books.books), size), np.int64)
    total = np.zeros((size, books.width), np.int64)
    for batch in batches:
        _, x = _whole(batch.column("v"), books)
        if len(x):
            label, _ = _assigned(x, books)
            for i in range(len(books.books)):
                count[i] += np.bincount(label[:, i], minlength=size)
                np.add.at(total[:, e[i]:e[i + 1]], label[:, i], x[:, e[i]:e[i + 1]])
    part = np.repeat(np.arange(len(books.books)), np.diff(e))
    n = count[part].T
    entry, place = np.nonzero(n)
    if len(entry):
        yield pa.RecordBatch.from_arrays([pa.array(entry.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(n[entry, place]), pa.array(total[entry, place])],
                                         names=["entry", "place", "n", "total"])


def _vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return vectors.where(usable(F.col(vector_col))).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))


def train(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> Codebooks | None:
    """Codebooks of ``vectors``, or None where no vector is usable.

    Components become floor(scale * x). A codebook starts as its part of the ``entries`` smallest ids
    (null ids last, equal ids by their components); each round gives every part to the nearest entry and replaces an
    entry by floor(sum / count) of its parts; entries without a part stay. Defined cases: vectors null
    or with a null or non-finite component take no part; neither do those of another length than the first,
    or with a component of ``LARGEST`` and more after scaling; fewer vectors than ``entries`` give smaller
    codebooks; a width that ``parts`` does not divide is cut at width * i // parts; repeated rows count each.
    """
    rows = _vectors(vectors, id_col, vector_col)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        return None
    width = len(first[0]["v"])
    fit = [np.floor(np.array(r["v"], float) * scale) for r in first if len(r["v"]) == width]
    start = np.array(fit).reshape(len(fit), width)
    start = start[(np.abs(start) < LARGEST).all(axis=1)].astype(np.int64)
    if not len(start):
        return None
    e = [width * i // parts for i in range(parts + 1)]
    books = Codebooks(tuple(start[:, e[i]:e[i + 1]] for i in range(parts)), width, scale)
    for _ in range(rounds):
        sums = rows.mapInArrow(lambda b, now=books: _sums(b, now), "entry int, place int, n long, total long")
        new = np.concatenate(books.books, axis=1)
        for r in sums.groupBy("entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
            new[r["entry"], r["place"]] = r["total"] // r["n"]
        books = Codebooks(tuple(new[:, e[i]:e[i + 1]] for i in range(parts)), width, scale)
    return books


def _coded(batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, at = batch.num_rows, batch.schema.get_field_index("v")
        fit, x = _whole(batch.column("v"), books)
        codes, error = [None] * n, [None] * n
        if len(fit):
            label, dist = _assigned(x, books)
            for i, c, d in zip(fit.tolist(), label.tolist(), dist.sum(axis=1).tolist(), strict=True):
                codes[i], error[i] = c, d if d <= LONG else None
        kept = [batch.column(i) for i in range(batch.num_columns) if i != at]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(codes, pa.list_(pa.int32())), pa.array(error, pa.int64())],
                                         names=[*(f.name for i, f in enumerate(batch.schema) if i != at), "codes", "error"])


def encode(vectors: DataFrame, books: Codebooks | None, id_col: str = "vec_id", vector_col: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, ``keep`` columns, codes array<int>, error long) of every usable vector: the nearest entries and the summed squared distances.

    Vectors null or with null or non-finite components are left out. A vector of another length than the codebooks', or
    with a component out of range, has null codes and a null error; an error beyond a long is null.
    """
    rows = vectors.where(usable(F.col(vector_col))).select(id_col, *keep, F.col(vector_col).cast("array<double>").alias("v"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "v") + ", codes array<int>, error long"
    if books is None:
        return rows.select(id_col, *keep, F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("long").alias("error"))
    return rows.mapInArrow(lambda b: _coded(b, books), schema)


def decode(coded: DataFrame, books: Codebooks, code_col: str = "codes") -> DataFrame:
    """``coded`` with the vector that its codes stand for, as ``decoded``."""
    entry = F.array(*[F.array(*[F.array(*[F.lit(int(c) / books.scale) for c in e]) for e in b]) for b in books.books])
    return coded.withColumn("decoded", F.flatten(F.transform(F.col(code_col), lambda c, i: F.get(F.get(entry, i), c))))
