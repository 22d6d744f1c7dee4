"""Words and n-grams counted inside a document's own row, before anything is shuffled.

Spark cuts the texts into words; a task numbers the words of a few rows at a time and counts (row, gram) pairs as sorted integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

C = F.col
WORDS = 400_000  #: words numbered at once; a longer text is taken whole


def slices(words: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, last row) of runs of rows that hold up to WORDS words together."""
    lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    first = 0
    while first < len(lengths):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + WORDS, side="right")))
        yield first, last
        first = last


def numbered(words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row of every word, its number, the words by number) of a list array."""
    lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    flat = words.flatten().dictionary_encode()
    return np.repeat(np.arange(len(words)), lengths), flat.indices.to_numpy(zero_copy_only=False).astype("int64"), flat.dictionary


def grams(words: pa.Array, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """Per length of gram: (row, gram number, count) of every gram of a row, and the grams by number."""
    row, code, names = numbered(words)
    prefix, spelled = code, names
    for n in range(1, high + 1):
        if n > 1:
            prefix, row_n = prefix[:-1] * len(names) + code[n - 1:], row[n - 1:]
            inside = row_n == row[:len(row_n)]  # all of the gram lies in one row
        else:
            row_n, inside = row, np.ones(len(row), bool)
        if not len(prefix):
            return
        # numbers stay below words * different words, far from what 64 bits hold
        known, prefix = np.unique(prefix, return_inverse=True)
        spelled = names.take(pa.array(known)) if n == 1 else pc.binary_join_element_wise(spelled.take(pa.array(known // len(names))), names.take(pa.array(known % len(names))), " ")
        if n >= low:
            pair, count = np.unique(row_n[inside] * len(known) + prefix[inside], return_counts=True)
            yield pair // len(known), pair % len(known), count, spelled


def _batches(df: DataFrame, make: Callable, schema: str) -> DataFrame:
    """``make`` of every run of rows of (key, list of words), both Arrow arrays."""

    def run(batches):
        for batch in batches:
            words = batch.column(1)
            for first, last in slices(words):
                yield from make(batch.column(0).slice(first, last - first), words.slice(first, last - first))

    return df.mapInArrow(run, schema)


def row_counts(df: DataFrame, key: str, words: str, low: int = 1, high: int = 1, only: list[str] | None = None, but: list[str] | None = None) -> DataFrame:
    """(key, term, n) of every row by itself: a key that repeats has a count for each of its rows. ``only`` or ``but`` is a bounded list of terms to keep or to leave out."""
    kind = df.schema[key].dataType.simpleString()
    listed = only if only is not None else but
    wanted = None if listed is None else pa.array(sorted(listed), pa.string())

    def make(keys, lists):
        for row, gram, count, spelled in grams(lists, low, high):
            if wanted is not None:
                keep = pc.is_in(spelled.cast(pa.string()), wanted).to_numpy(zero_copy_only=False)[gram] == (only is not None)
                row, gram, count = row[keep], gram[keep], count[keep]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(row)), spelled.take(pa.array(gram)).cast(pa.string()), pa.array(count, pa.int64())], [key, "term", "n"])

    return _batches(df.select(key, words), make, f"`{key}` {kind}, term string, n long")


def term_totals(df: DataFrame, key: str, words: str, low: int = 1, high: int = 1) -> DataFrame:
    """(term, total, df): occurrences and rows of every gram."""

    def make(keys, lists):
        for _, gram, count, spelled in grams(lists, low, high):
            total, rows = np.bincount(gram, count, len(spelled)).astype("int64"), np.bincount(gram, minlength=len(spelled))
            held = np.flatnonzero(rows)
            yield pa.RecordBatch.from_arrays([spelled.take(pa.array(held)).cast(pa.string()), pa.array(total[held]), pa.array(rows[held].astype("int64"))], ["term", "total", "df"])

    return _batches(df.select(key, words), make, "term string, total long, df long").groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))


def weight_rows(df: DataFrame, key: str, words: str, idf: dict[str, float], low: int = 1, high: int = 1) -> DataFrame:
    """(key, term, weight) of every row by itself: count * idf over the known terms, scaled to unit length."""
    kind = df.schema[key].dataType.simpleString()
    names = pa.array(list(idf), pa.string())
    factor = np.array(list(idf.values()), float)

    def make(keys, lists):
        rows, terms, values = [], [], []
        for row, gram, count, spelled in grams(lists, low, high):
            at = pc.fill_null(pc.index_in(spelled.cast(pa.string()), names), -1).to_numpy(zero_copy_only=False)[gram]
            keep = at >= 0
            rows.append(row[keep])
            terms.append(at[keep])
            values.append(count[keep] * factor[at[keep]])
        row, term, value = (np.concatenate(x) if x else np.zeros(0, "int64") for x in (rows, terms, values))
        length = np.sqrt(np.bincount(row, value * value, len(keys)))
        order = np.argsort(row, kind="stable")
        row, term, value = row[order], term[order], value[order]
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(row)), names.take(pa.array(term)), pa.array(value / length[row], pa.float64())], [key, "term", "weight"])

    return _batches(df.select(key, words), make, f"`{key}` {kind}, term string, weight double")


def vector_sums(df: DataFrame, key: str, words: str, names: list[str], table: np.ndarray, known: np.ndarray, times: np.ndarray) -> DataFrame:
    """(key, _t, _s, _q) of every row with a known word: occurrences, their summed vectors and how many of them have a value there.

    ``table`` holds the summed vectors of a word, ``known`` how many of them have a value per component, ``times`` how many there are.
    """
    kind = df.schema[key].dataType.simpleString()
    listed = pa.array(names, pa.string())
    gaps = bool((known < times[:, None]).any())

    def make(keys, lists):
        for row, gram, count, spelled in grams(lists, 1, 1):
            at = pc.fill_null(pc.index_in(spelled.cast(pa.string()), listed), -1).to_numpy(zero_copy_only=False)[gram]
            keep = at >= 0
            row, at, count = row[keep], at[keep], count[keep]
            if not len(row):
                continue
            held, begin = np.unique(row, return_index=True)
            ends = np.append(begin[1:], len(row))
            sums, some = np.empty((len(held), table.shape[1])), np.ones((len(held), table.shape[1]))
            for i, (b, e) in enumerate(zip(begin, ends)):  # a row's words at a time: no table of all pairs by dimension
                sums[i] = count[b:e] @ table[at[b:e]] if len(at[b:e]) else 0.0
                if gaps:
                    some[i] = count[b:e] @ known[at[b:e]]
            total = np.add.reduceat(count * times[at], begin)
            lists_of = lambda x: pa.array(list(x), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(held)), pa.array(total.astype("int64")), lists_of(sums), lists_of(some)], [key, "_t", "_s", "_q"])

    return _batches(df.select(key, words), make, f"`{key}` {kind}, _t long, _s array<double>, _q array<double>")
