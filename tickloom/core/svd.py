"""Truncated singular value decomposition of a sparse table of rows, with both sides kept.

Rows stay where they are: a round multiplies each of them with a block of a few column vectors and sums the way back per
partition. The column side, terms by block width, is what a vocabulary of bounded size makes it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable

C = F.col
MOST_COLUMNS = 100_000
MOST_BLOCKS = 8  # blocks of column vectors kept between rounds
CELLS = 32_768  # cells multiplied at once: the scratch space is this times the block width


def _slices(pdf: pd.DataFrame):
    """(row numbers of the batch, starts, columns, values) of some whole rows at a time."""
    lengths = pdf["at"].str.len().to_numpy()
    first, held = 0, 0
    for i, n in enumerate(lengths):
        held += n
        if held >= CELLS or i == len(lengths) - 1:
            rows = slice(first, i + 1)
            starts = np.concatenate([[0], np.cumsum(lengths[rows])[:-1]]).astype(int)
            yield rows, starts, np.concatenate(pdf["at"].to_numpy()[rows]), np.concatenate(pdf["cell"].to_numpy()[rows])
            first, held = i + 1, 0


def _gram_product(w: np.ndarray):
    """A'(A w) of a partition's rows, one output row per column it touches."""

    def run(batches):
        total, touched = np.zeros_like(w), np.zeros(len(w), bool)
        for pdf in batches:
            for _, starts, at, cell in _slices(pdf):
                image = np.add.reduceat(cell[:, None] * w[at], starts, axis=0)
                back = cell[:, None] * np.repeat(image, np.diff(np.append(starts, len(at))), axis=0)
                order = np.argsort(at, kind="stable")
                columns, begin = np.unique(at[order], return_index=True)
                total[columns] += np.add.reduceat(back[order], begin, axis=0)
                touched[columns] = True
        columns = np.flatnonzero(touched)
        yield pd.DataFrame({"i": columns.astype("int32"), "y": list(total[columns])})

    return run


def _coordinates(v: np.ndarray, key: str):
    def run(batches):
        for pdf in batches:
            parts = [np.add.reduceat(cell[:, None] * v[at], starts, axis=0) for _, starts, at, cell in _slices(pdf)]
            yield pd.DataFrame({key: pdf[key], "weights": list(np.concatenate(parts)) if parts else []})

    return run


def truncated_svd(cells: DataFrame, key: str, k: int, column: str = "term", value: str = "weight", spare: int = 24, tol: float = 1e-6, rounds: int = 100):
    """(values, columns, rows) of the k largest singular values of (key, column, value).

    ``values`` is (component, value), ``columns`` (component, column, weight) with vectors of length one whose largest entry is
    positive, ``rows`` (key, component, weight) the coordinates of every row that has a cell. Cells that are null, or whose key or
    column is null, take no part; a cell may not repeat. At most ``MOST_COLUMNS`` columns; rounds end at a residual
    of ``tol`` times the largest eigenvalue of A'A.
    """
    cells = durable(cells.where(C(value).isNotNull() & C(key).isNotNull() & C(column).isNotNull()).select(key, column, C(value).cast("double").alias(value)))
    names = [r[0] for r in cells.select(column).distinct().limit(MOST_COLUMNS + 1).collect()]  # bounded, and refused beyond
    names.sort()
    return decompose(packed(cells, key, names, column, value), key, names, k, column, cells.schema[column].dataType.simpleString(), spare, tol, rounds)


def packed(cells: DataFrame, key: str, names: list, column: str = "term", value: str = "weight") -> DataFrame:
    """(key, at, cell): a row's column numbers in ``names`` and its values, written once. Cells must be without nulls and not repeat."""
    if len(names) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} columns: choose a vocabulary first")
    index = cells.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], f"`{column}` {cells.schema[column].dataType.simpleString()}, _i int")
    both = F.array_sort(F.collect_list(F.struct("_i", C(value).cast("double").alias("_v"))))  # a row has at most as many cells as there are columns
    return durable(cells.join(F.broadcast(index), column).groupBy(key).agg(both.alias("_c")).select(key, C("_c._i").alias("at"), C("_c._v").alias("cell")))


def decompose(rows: DataFrame, key: str, names: list, k: int, column: str = "term", kind_of_column: str = "string", spare: int = 24, tol: float = 1e-6, rounds: int = 100):
    """:func:`truncated_svd` of rows that :func:`packed` made of cells with the columns ``names``."""
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    width = min(k + spare, len(names))
    k = min(k, width)
    w = np.linalg.qr(np.random.default_rng(3).normal(size=(len(names), width)))[0] if names else np.zeros((0, 0))
    value_, v = np.zeros(0), np.zeros((len(names), 0))
    held, images = np.zeros((len(names), 0)), np.zeros((len(names), 0))
    for _ in range(rounds if names else 0):
        parts = rows.select("at", "cell").mapInPandas(_gram_product(w), "i int, y array<double>")
        sums = parts.groupBy("i").agg(F.array(*[F.sum(C("y")[j]) for j in range(w.shape[1])]).alias("y")).collect()  # columns by width
        y = np.zeros_like(w)
        for r in sums:
            y[r["i"]] = r["y"]
        held, images = np.hstack([held, w]), np.hstack([images, y])
        s = held.T @ images
        lam, u = np.linalg.eigh((s + s.T) / 2)
        order = np.argsort(-lam, kind="stable")[:width]
        lam, u = lam[order], u[:, order]
        image, v = images @ u, held @ u
        rest = image - v * lam
        off = np.linalg.norm(rest[:, :k], axis=0).max(initial=0.0)
        value_ = np.sqrt(np.maximum(lam[:k], 0.0))
        # the next block is what the images have outside of all blocks so far: far fewer rounds than with the last block alone
        if held.shape[1] + width > MOST_BLOCKS * width:
            held, images = v, image
        for _ in range(2):
            rest = rest - held @ (held.T @ rest)
        left, size, _ = np.linalg.svd(rest, full_matrices=False)
        w = left[:, size > 1e-12 * max(lam[0], 1e-300)]
        v = v[:, :k]
        if off <= tol * max(lam[0], 1e-300) or not w.shape[1]:
            break
    else:
        if names:
            raise ArithmeticError(f"singular values: residual {off:.1e} after {rounds} rounds")
    if names:
        sign = np.sign(v[np.abs(v).argmax(axis=0), range(k)])
        v = v * np.where(sign == 0, 1.0, sign)
    values = spark.createDataFrame([(i, float(s)) for i, s in enumerate(value_)], "component int, value double")
    entries = [(n, [float(x) for x in v[i]]) for i, n in enumerate(names)]
    sides = spark.createDataFrame(entries, f"`{column}` {kind_of_column}, weights array<double>")
    place = rows.mapInPandas(_coordinates(v, key), f"`{key}` {kind}, weights array<double>") if names else rows.select(key, C("cell").alias("weights"))
    long = lambda d, c: d.select(c, F.posexplode("weights").alias("component", "weight"))
    return values, long(sides, column), long(place, key)
