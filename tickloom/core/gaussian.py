"""Linear filters with a data-dependent covariance as an associative scan.

A row is an element (A, b, C, eta, J): given a Gaussian state before it, it tells the state after it and the likelihood of
the state before. Elements combine associatively, so a block of rows is one element, the states at the begin of
all blocks are a scan over one row per block, and inside a block a prefix scan by doubling gives every row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from . import slices
from .slices import spread

Element = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def observations(h: np.ndarray, y: np.ndarray, q: float, r: float) -> Element:
    """Elements of y = h . state + noise(r) after a random walk of the state with variance q in every component; a NaN only walks."""
    n, k = h.shape
    seen = ~(np.isnan(y) | np.isnan(h).any(axis=1))
    h, y = np.where(seen[:, None], h, 0.0), np.where(seen, y, 0.0)
    s = q * (h * h).sum(axis=1) + r
    gain = q * h / s[:, None]
    a = np.eye(k) - gain[:, :, None] * h[:, None, :]
    return a, gain * y[:, None], q * a, h * (y / s)[:, None], h[:, :, None] * h[:, None, :] / s[:, None, None]


def combine(x: Element, y: Element) -> Element:
    """The element of ``x`` and then ``y``, row by row."""
    a, b, c, e, j = x
    a2, b2, c2, e2, j2 = y
    dot = lambda m, v: (m @ v[:, :, None])[:, :, 0]
    turn = lambda m: m.transpose(0, 2, 1)
    eye = np.eye(a.shape[1])
    d = a2 @ np.linalg.inv(eye + c @ j2)
    g = turn(a) @ np.linalg.inv(eye + j2 @ c)
    return d @ a, dot(d, b + dot(c, e2)) + b2, d @ c @ turn(a2) + c2, dot(g, e2 - dot(j2, b)) + e, g @ j2 @ a + j


def prefixes(x: Element) -> Element:
    """The element of all rows up to each row, by doubling."""
    step = 1
    while step < len(x[0]):
        late = combine(tuple(v[:-step] for v in x), tuple(v[step:] for v in x))
        x = tuple(np.concatenate((v[:step], w)) for v, w in zip(x, late, strict=True))
        step *= 2
    return x


def whole(x: Element) -> Element:
    """The element of all rows together, by halving."""
    while len(x[0]) > 1:
        n = len(x[0]) // 2 * 2
        pairs = combine(tuple(v[0:n:2] for v in x), tuple(v[1:n:2] for v in x))
        x = tuple(np.concatenate((p, v[n:])) for p, v in zip(pairs, x, strict=True))
    return x


def after(state: np.ndarray, cov: np.ndarray, x: Element) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance after each element of ``x`` from one state before them."""
    n, k = len(x[0]), len(state)
    start = (np.zeros((n, k, k)), np.broadcast_to(state, (n, k)), np.broadcast_to(cov, (n, k, k)), np.zeros((n, k)), np.zeros((n, k, k)))
    _, b, c, _, _ = combine(start, x)
    return b, c


def _columns(block: pa.Table, inputs: list[str], q: float, r: float) -> tuple[pa.Table, np.ndarray, np.ndarray, Element]:
    block = block.sort_by("_pos")
    number = lambda c: np.asarray(block.column(c).to_numpy(zero_copy_only=False), float)
    h = np.stack([number(c) for c in inputs], axis=1)
    y = number("_y")
    return block, h, y, observations(h, y, q, r)


def random_walk_regression(df: DataFrame, keys: list[str], order: list[str], y: str, inputs: list[str], q: float, r: float, out: list[str], error: str) -> DataFrame:
    """(keys, order, ``out`` states, ``error``): the filtered coefficients of ``y`` on ``inputs`` and a constant, from 0 with variance 1.

    ``error`` is the innovation. A row with a null or NaN number leaves the coefficients and has a null error. A block of
    ``ROWS_PER_SLICE`` rows is one task however long its series; a series is scanned over one row for each of its blocks.
    """
    rows, k = max(2, slices.ROWS_PER_SLICE), len(inputs) + 1
    names = [*[f"_h{i}" for i in range(k - 1)], "_one"]
    d = df.select(*keys, *order, F.col(y).cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"_h{i}") for i, c in enumerate(inputs)], F.lit(1.0).alias("_one"))
    d = spread(d, keys=keys, order=order).position("_pos").done()
    d = durable(d.withColumn("_block", F.floor(F.col("_pos") / rows)))
    kind = ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in keys)

    def reduced(block: pa.Table) -> pa.Table:
        block, _, _, x = _columns(block, names, q, r)
        return block.select([*keys, "_block"]).slice(0, 1).append_column("_element", pa.array([np.concatenate([v.ravel() for v in whole(x)]).tolist()]))

    sizes = np.cumsum([k * k, k, k * k, k])
    shapes = [(1, k, k), (1, k), (1, k, k), (1, k), (1, k, k)]

    def entered(blocks: pa.Table) -> pa.Table:
        blocks = blocks.sort_by("_block")
        state, cov, out_ = np.zeros(k), np.eye(k), []
        for flat in blocks.column("_element").to_pylist():  # one of ROWS_PER_SLICE rows
            out_.append(np.concatenate((state, cov.ravel())).tolist())
            x = tuple(v.reshape(s) for v, s in zip(np.split(np.array(flat), sizes), shapes, strict=True))
            b, c = after(state, cov, x)
            state, cov = b[0], c[0]
        return blocks.select([*keys, "_block"]).append_column("_state", pa.array(out_, pa.list_(pa.float64())))

    def filtered(block: pa.Table, entry: pa.Table) -> pa.Table:
        block, h, seen, x = _columns(block, names, q, r)
        if not block.num_rows or not entry.num_rows:
            return pa.table({c: block.column(c).slice(0, 0) for c in [*keys, *order]} | {c: pa.array([], pa.float64()) for c in [*out, error]})
        flat = np.array(entry.column("_state")[0].as_py())
        mean, _ = after(flat[:k], flat[k:].reshape(k, k), prefixes(x))
        off = seen - (h * np.concatenate((flat[None, :k], mean[:-1]))).sum(axis=1)
        res = block.select([*keys, *order])
        for i, c in enumerate(out):
            res = res.append_column(c, pa.array(mean[:, i]))
        return res.append_column(error, pa.array(off, mask=np.isnan(off)))

    blocks = d.groupBy(*keys, "_block").applyInArrow(reduced, f"{kind}, _block long, _element array<double>")
    entries = blocks.groupBy(*keys).applyInArrow(entered, f"{kind}, _block long, _state array<double>")
    more = ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in order)
    return d.groupBy(*keys, "_block").cogroup(entries.groupBy(*keys, "_block")).applyInArrow(filtered, f"{kind}, {more}, " + ", ".join(f"{c} double" for c in [*out, error]))
