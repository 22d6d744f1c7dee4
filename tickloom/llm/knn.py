"""Exact top-k search by inner product as a Voronoi join.

Pivots cut the space into cells. A summary of every cell (rows, radius, the rows nearest to the pivot)
bounds the k-th best score of every query from below. Queries are grouped by their nearest
pivot; a row goes to a group only if its largest possible score with any query of the group
reaches the lowest of the group's bounds. Groups are solved locally, in shares, and the
shares' best are merged.

All bounds use q.x <= p.x + |q - p| |x| and q.x >= q.p - |q| |x - p| with a small allowance for rounding, so results are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm.common import held

PIVOTS = 32  #: pivots, also the number of query groups; the sample they come from has as many rows
SHARE = 20000  #: rows of a group that one task meets at once
SLACK = 1e-9
FULL = 1 << 45  #: products beyond this are not exact in floating point
NEVER = -(1 << 62)


def quantized(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id and v = floor(scale * x) as whole numbers; vectors that are null or hold a null or non-finite component go."""
    x = F.col(vector_col)
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    return df.where(x.isNotNull() & fine & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * float(scale)).cast("double")).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column; shorter ones are filled with zeros, which add nothing to a product."""
    size = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten(), np.float64)
    if len(size) and (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out[row, at] = flat
    return out


def _cells(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot and the distance to it."""
    d = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T
    cell = d.argmin(1)
    return cell, np.sqrt(np.maximum(((x - pivots[cell]) ** 2).sum(1), 0))


def _summaries(batches, pivots: np.ndarray, keep: int):
    near: list[np.ndarray] = [np.zeros(0)] * len(pivots)
    for batch in batches:
        cell, d = _cells(_matrix(batch.column("v"), pivots.shape[1]), pivots)
        for c in np.unique(cell):
            near[c] = np.sort(np.concatenate((near[c], d[cell == c])))[:keep]
    cell = np.repeat(np.arange(len(pivots)), [len(x) for x in near])
    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(np.concatenate(near))], names=["cell", "distance"])


def _bounded(batches, pivots, near, k):
    """Group, radius and bound of every query; ``near``: for every cell the distances of its nearest rows."""
    cells = np.repeat(np.arange(len(pivots)), [len(x) for x in near])
    dist = np.concatenate(near) if near else np.zeros(0)
    for batch in batches:
        q = _matrix(batch.column("v"), pivots.shape[1])
        cell, d = _cells(q, pivots)
        norm = np.sqrt((q * q).sum(1))
        bound = np.full(len(q), -np.inf)
        if len(dist) > k:  # the query's own row may be among them: one more is needed
            for i in range(0, len(q), 1024):
                s = slice(i, i + 1024)
                low = (q[s] @ pivots.T)[:, cells] - norm[s, None] * dist[None]
                bound[s] = -np.partition(-low, k, axis=1)[:, k]
        bound -= SLACK * (1 + np.abs(bound)) + SLACK * norm * (1 + np.abs(pivots).max())
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cell.astype(np.int32)), pa.array(d), pa.array(bound), batch.column("v")],
                                         names=["vec_id", "cell", "radius", "bound", "v"])


def _routed(batches, pivots, groups, radius, bound):
    """Rows with every group that may need them, and a share of it."""
    for batch in batches:
        x = _matrix(batch.column("v"), pivots.shape[1])
        best = x @ pivots[groups].T + radius[None] * np.sqrt((x * x).sum(1))[:, None]
        row, g = np.nonzero(best * (1 + SLACK * np.sign(best)) + SLACK >= bound[None])
        yield pa.RecordBatch.from_arrays([pa.array(groups[g].astype(np.int32)), batch.column("vec_id").take(pa.array(row)), batch.column("v").take(pa.array(row))],
                                         names=["cell", "vec_id", "v"])


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(q.shape[1], 1) < FULL:
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    head = np.concatenate(([True], query[1:] != query[:-1])) if len(query) else np.zeros(0, bool)
    rank = np.arange(len(query)) - np.flatnonzero(head)[np.cumsum(head) - 1] if len(query) else query
    return query[rank < k], ids[rank < k], score[rank < k]


def _local(k: int, width: int):
    def solve(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 3]
        if queries.num_rows and rows.num_rows:
            x, ids = _matrix(rows.column("v").combine_chunks(), width), np.asarray(rows.column("vec_id"))
            own, q = np.asarray(queries.column("vec_id")), _matrix(queries.column("v").combine_chunks(), width)
            for i in range(0, len(q), 256):
                score = _scores(q[i:i + 256], x)
                score[own[i:i + 256, None] == ids[None]] = NEVER
                n = min(k, score.shape[1])
                edge = -np.partition(-score, n - 1, axis=1)[:, n - 1]
                a, b = np.nonzero((score >= edge[:, None]) & (score > NEVER))
                out.append(_best(own[i + a], ids[b], score[a, b], k))
        a, b, c = (np.concatenate(v) for v in zip(*out, strict=True))
        return pa.table({"query_id": a, "vec_id": b, "score": c})

    return solve


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the ``k`` rows of highest whole inner product, ties to the smaller id.

    Components become floor(scale * x). A row is no candidate for a query of its own id. Defined
    cases: vectors null or with a null or non-finite component, and rows with a null id, take no part; fewer than
    ``k`` candidates are all returned; shorter vectors count as filled with zeros; repeated rows of one id are one
    candidate; an empty table gives an empty result. The pivots are the PIVOTS rows of lowest hash; what
    goes through the driver is PIVOTS numbers and k + 1 distances of each.
    """
    spark = vectors.sparkSession
    empty = "query_id long, rank int, vec_id long, score long"
    data, asked = quantized(vectors, id_col, vector_col, scale).dropDuplicates(["vec_id", "v"]), quantized(queries, id_col, vector_col, scale).dropDuplicates(["vec_id", "v"])
    width = data.agg(F.max(F.size("v"))).first()[0]
    if not width:
        return spark.createDataFrame([], empty)
    width = max(width, asked.agg(F.max(F.size("v"))).first()[0] or 0)
    picked = data.orderBy(F.xxhash64("v"), "vec_id").select("v").limit(PIVOTS).collect()
    pivots = np.unique(np.array([r["v"] + [0.0] * (width - len(r["v"])) for r in picked]), axis=0)
    rows = data.mapInArrow(lambda b: _summaries(b, pivots, k + 1), "cell int, distance double")
    first = F.row_number().over(W.partitionBy("cell").orderBy("distance"))
    near: list[list[float]] = [[] for _ in pivots]
    for r in rows.withColumn("i", first).where(F.col("i") <= k + 1).collect():  # at most PIVOTS * (k + 1) numbers
        near[r["cell"]].append(r["distance"])
    near = [np.array(x) for x in near]
    q = held(asked.mapInArrow(lambda b: _bounded(b, pivots, near, k), "vec_id long, cell int, radius double, bound double, v array<double>"))
    groups = q.groupBy("cell").agg(F.max("radius").alias("radius"), F.min("bound").alias("bound")).orderBy("cell").collect()
    if not groups:
        return spark.createDataFrame([], empty)
    g, radius, bound = (np.array([r[i] for r in groups]) for i in range(3))
    routed = data.mapInArrow(lambda b: _routed(b, pivots, g, radius, bound), "cell int, vec_id long, v array<double>")
    n = data.count()
    shares = max(1, -(-n // SHARE))
    routed = routed.withColumn("share", F.pmod(F.xxhash64("vec_id"), F.lit(shares)).cast("int"))
    spread = q.select("cell", "vec_id", "v").withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    found = spread.groupBy("cell", "share").cogroup(routed.groupBy("cell", "share")).applyInArrow(_local(k, width), "query_id long, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
