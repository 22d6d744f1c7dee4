"""Neighbour counts, links and nearest cores of points within a radius, by pairs of blocks.

Points meet in blocks of about ``BLOCK`` rows of neighbouring grid cells. A task compares two blocks tile by tile as a matrix product and hands
on sums, a forest or minima, never the pairs themselves: memory is bounded by the tile, and results by the rows of the blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable

C = F.col
BLOCK = 8_192  #: rows of a block: twice as many halve what is shuffled and take four times the bits of adjacency
TILE = 512  #: rows of a block compared at once
EXACT = 16_384  #: pairs whose distance is taken term by term at once


def blocked(points: DataFrame, key: str, vector: str, eps: float, cells: int) -> tuple[DataFrame, DataFrame]:
    """(rows, pairs): (_r, key, _x, _block) of every point whose components are all finite, and the block pairs (_i, _j), _i <= _j, that can hold neighbours.

    Cells are eps wide on the first ``cells`` components. Only vectors of one length meet.
    """
    sound = points.where(C(vector).isNotNull() & (F.size(vector) >= cells) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    cell = F.array(F.size(vector).cast("long"), *[F.floor(C(vector)[i] / eps).cast("long") for i in range(cells)])
    rows = durable(sound.select(key, C(vector).alias("_x"), cell.alias("_cell"), F.monotonically_increasing_id().alias("_r")))
    sizes = rows.groupBy("_cell").agg(F.ceil(F.count("*") / BLOCK).alias("_parts"))
    blocks = durable(sizes.select("_cell", "_parts", F.explode(F.sequence(F.lit(0).cast("long"), C("_parts") - 1)).alias("_part")).withColumn("_block", F.monotonically_increasing_id()))
    rows = rows.join(sizes, "_cell").withColumn("_part", F.pmod(F.xxhash64("_r"), "_parts")).join(blocks.drop("_parts"), ["_cell", "_part"])
    near = blocks.select("_cell", C("_block").alias("_i"))
    for i in range(1, cells + 1):
        near = near.withColumn("_cell", F.explode(F.array(*[F.concat(F.slice("_cell", 1, i), F.array(C("_cell")[i] + s), F.slice("_cell", i + 2, cells)) for s in (-1, 0, 1)])))
    pairs = near.join(blocks.select("_cell", C("_block").alias("_j")), "_cell").where("_i <= _j").select("_i", "_j")
    return durable(rows.select("_r", key, "_x", "_block")), durable(pairs)


def _meet(rows: DataFrame, pairs: DataFrame, *extra: str) -> DataFrame:
    """The rows of both blocks of every pair, once where a block meets itself."""
    left = pairs.join(rows, C("_i") == C("_block")).select("_i", "_j", F.lit(0).alias("_side"), "_r", "_x", *extra)
    right = pairs.where("_i < _j").join(rows, C("_j") == C("_block")).select("_i", "_j", F.lit(1).alias("_side"), "_r", "_x", *extra)
    return left.unionByName(right).groupBy("_i", "_j")


def _distances(a, b, i, j) -> np.ndarray:
    """Distances of pairs, summed in the order of the components, differences in the type of the vectors."""
    out = np.empty(len(i))
    for s in range(0, len(i), EXACT):
        d = (a[i[s:s + EXACT]] - b[j[s:s + EXACT]]).astype(float)
        out[s:s + EXACT] = np.sqrt(np.add.accumulate(d * d, axis=1)[:, -1])
    return out


def _tiles(a, b):
    """(first row, squared distances, how far they can be off) of some rows of ``a`` and all of ``b``."""
    bd = b.astype(float)
    nb = (bd * bd).sum(axis=1)
    for s in range(0, len(a), TILE):
        ad = a[s:s + TILE].astype(float)
        na = (ad * ad).sum(axis=1)
        q = na[:, None] + nb - 2.0 * (ad @ bd.T)
        yield s, q, 1e-6 * np.abs(q) + 1e-12 * (na[:, None] + nb)


def _near(a, b, eps: float):
    """(first row, which pairs are within eps); pairs too close to call are measured term by term."""
    for s, q, off in _tiles(a, b):
        near = q <= eps * eps
        i, j = np.nonzero(np.abs(q - eps * eps) <= off)
        near[i, j] = _distances(a, b, i + s, j) <= eps
        yield s, near


def _sides(pdf: pd.DataFrame):
    one = pdf["_side"].to_numpy() == 0
    x, r = np.stack(pdf["_x"].to_numpy()) if len(pdf) else np.zeros((0, 0)), pdf["_r"].to_numpy()
    alone = pdf["_i"].iloc[0] == pdf["_j"].iloc[0]
    return (x[one], r[one], x[one], r[one], True) if alone else (x[one], r[one], x[~one], r[~one], False)


def neighbour_counts(rows: DataFrame, pairs: DataFrame, eps: float) -> DataFrame:
    """(_r, _n): rows within eps, itself included."""

    def run(pdf):
        a, ra, b, rb, alone = _sides(pdf)
        na, nb = np.zeros(len(ra), int), np.zeros(len(rb), int)
        for s, near in _near(a, b, eps) if len(a) and len(b) else ():
            na[s:s + len(near)] += near.sum(axis=1)
            nb += near.sum(axis=0)
        return pd.DataFrame({"_r": ra, "_n": na}) if alone else pd.DataFrame({"_r": np.concatenate([ra, rb]), "_n": np.concatenate([na, nb])})

    return _meet(rows, pairs).applyInPandas(run, "_r long, _n long").where("_n > 0").groupBy("_r").agg(F.sum("_n").alias("_n"))


def links(rows: DataFrame, pairs: DataFrame, eps: float) -> DataFrame:
    """(_u, _v) that join whatever pairs within eps join: of every two blocks a forest, not all pairs."""

    def run(pdf):
        a, ra, b, rb, _ = _sides(pdf)
        u, v = [], []
        if len(a) and len(b):
            near = np.concatenate([n for _, n in _near(a, b, eps)])
            left_a, left_b = np.ones(len(a), bool), np.ones(len(b), bool)
            for first in range(len(a)):
                front = np.array([first]) if left_a[first] else np.zeros(0, int)
                left_a[front] = False
                while len(front):
                    reached = np.flatnonzero(near[front].any(axis=0) & left_b)
                    left_b[reached] = False
                    front = np.flatnonzero(near[:, reached].any(axis=1) & left_a) if len(reached) else reached
                    left_a[front] = False
                    v += [rb[reached], ra[front]]
                    u += [np.full(len(reached) + len(front), ra[first])]
        return pd.DataFrame({"_u": np.concatenate(u) if u else np.zeros(0, int), "_v": np.concatenate(v) if v else np.zeros(0, int)})

    return _meet(rows, pairs).applyInPandas(run, "_u long, _v long").where("_u <> _v")


def nearest_cores(rows: DataFrame, pairs: DataFrame, eps: float) -> DataFrame:
    """(_r, _o): of every row without ``_core`` the core within eps that is nearest, the smallest ``_core`` of equal ones."""

    def best(a, ra, b, names):
        r, dist, core = [], [], []
        for s, q, off in _tiles(a, b) if len(a) and len(b) else ():
            low = (q + off).min(axis=1, keepdims=True)
            i, j = np.nonzero((q - off <= low) & (q - off <= eps * eps))
            d = _distances(a, b, i + s, j)
            i, j, d = i[d <= eps], j[d <= eps], d[d <= eps]
            order = np.lexsort((names[j], d, i))
            take = order[np.unique(i[order], return_index=True)[1]]
            r.append(ra[i[take] + s])
            dist.append(d[take])
            core.append(names[j[take]])
        return r, dist, core

    def run(pdf):
        core = pdf["_core"].notna().to_numpy()
        one = pdf["_side"].to_numpy() == 0
        x, r = np.stack(pdf["_x"].to_numpy()), pdf["_r"].to_numpy()
        alone = pdf["_i"].iloc[0] == pdf["_j"].iloc[0]
        out = ([], [], [])
        for mine, other in ((one, one),) if alone else ((one, ~one), (~one, one)):
            names = np.array([int(n) for n in pdf["_core"][other & core]], dtype="int64")
            for into, part in zip(out, best(x[mine & ~core], r[mine & ~core], x[other & core], names)):
                into.extend(part)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return pd.DataFrame({"_r": join(out[0], "int64"), "_d": join(out[1], float), "_o": join(out[2], "int64")})

    named = rows.withColumn("_core", C("_core").cast("string"))  # a long beside nulls would become a double
    found = _meet(named, pairs, "_core").applyInPandas(run, "_r long, _d double, _o long")
    return found.groupBy("_r").agg(F.min(F.struct("_d", "_o")).alias("_m")).select("_r", C("_m._d").alias("_d"), C("_m._o").alias("_o"))
