"""Toxicity by cumulative-link ordinal regression.

A document is the set of its distinct words (runs of letters, A-Z in lower case), hashed into SIZE cells. One weight vector
is shared by all grades; ordered thresholds cut its score: P(grade > j) = logistic(w.x - threshold_j).
The expected severity is the sum of these probabilities. Weights are fitted by follow-the-regularised-leader with
elastic net, so that words without evidence weigh nothing, on at most SAMPLE labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.sparse import Ftrl, bucket
from tickloom.llm.textops import pieces, word_hashes

SIZE = 1 << 20
SAMPLE = 20000  #: labelled rows that the model is fitted on, at most; those of lowest hash
LETTER_RUNS = np.full(256, 32, np.uint8)
LETTER_RUNS[97:123] = np.arange(97, 123)
LETTER_RUNS[65:91] = np.arange(97, 123)
LETTER_RUNS[128:] = np.arange(128, 256)


@dataclass
class Model:
    cells: np.ndarray  # with weight, sorted
    weights: np.ndarray
    thresholds: np.ndarray


def _features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, at = word_hashes(LETTER_RUNS[data], off)
    return bucket(h, SIZE), at


def _vectors(batches):
    for batch in batches:
        cells = []
        for _, _, data, off in pieces(batch.column("text")):
            f, at = _features(data, off)
            cells += [np.unique(f[a:b]).astype(np.int32).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("grade"), batch.column("order"), pa.array(cells, pa.binary())], names=["grade", "order", "cells"])


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: list[tuple[int, np.ndarray]], epochs: int = 3, alpha: float = 1.0, l1: float = 4.0, l2: float = 0.1, rate: float = 0.1) -> Model:
    """``rows``: (grade from 0, sorted cells). Thresholds are those between the grades that occur."""
    grades = np.unique([g for g, _ in rows])
    rank = {g: i for i, g in enumerate(grades.tolist())}
    k = len(grades)
    ftrl = Ftrl((SIZE,), alpha, l1, l2)
    share = np.cumsum([sum(g == x for g, _ in rows) for x in grades])[:-1] / max(len(rows), 1)
    cut = np.log(share / (1 - share))
    for _ in range(epochs if k > 1 else 0):
        for g, x in rows:
            y = rank[g]
            w = ftrl.weights(x)
            s = float(w.sum())
            above, below = (_logistic(s - cut[y - 1]) if y else 1.0), (_logistic(s - cut[y]) if y < k - 1 else 0.0)
            ftrl.step(x, w, np.full(len(x), above + below - 1))
            p = max(above - below, 1e-9)
            if y:
                cut[y - 1] -= rate * above * (1 - above) / p
            if y < k - 1:
                cut[y] += rate * below * (1 - below) / p
            cut = np.maximum.accumulate(cut + np.arange(k - 1) * 1e-6)
    w = ftrl.weights()
    cells = np.flatnonzero(w)
    shift = np.diff(np.concatenate(([0], grades)))[1:] if k > 1 else np.zeros(0)  # grades that do not occur have no threshold of their own
    return Model(cells, w[cells], np.repeat(cut, shift.astype(int)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade") -> Model:
    """A model from ``docs`` and graded ids; of several grades of an id the highest counts, null ids and grades do not."""
    graded = labels.where(F.col(id_col).isNotNull() & F.col(grade_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(grade_col).cast("int")).alias("grade"))
    graded = graded.withColumn("order", F.xxhash64("_id"))
    sample = graded.orderBy("order").limit(2 * SAMPLE)  # graded ids without a document leave room
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(sample), "_id")
    got = rows.select("grade", "order", "text").mapInArrow(_vectors, "grade int, order long, cells binary").orderBy("order").limit(SAMPLE).collect()
    return fit([(r["grade"], np.frombuffer(r["cells"], np.int32)) for r in got])


def _scorer(model: Model):
    table = np.zeros(SIZE)
    table[model.cells] = model.weights

    def run(batches):
        for batch in batches:
            out = []
            for _, _, data, off in pieces(batch.column("text")):
                f, at = _features(data, off)
                hit = np.flatnonzero(table[f])
                pair = np.unique((np.searchsorted(at, hit, "right") - 1) * SIZE + f[hit])
                out.append(np.bincount(pair // SIZE, table[pair % SIZE], minlength=len(off) - 1))
            score = np.concatenate(out) if out else np.zeros(0)
            severity = _logistic(score[:, None] - model.thresholds[None]).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_n"), pa.array(severity)], names=["_id", "_n", "severity"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", reject: float = 0.3) -> DataFrame:
    """(id, severity, grade, toxic) for every row: expected severity, the nearest grade, and whether severity reaches ``reject``.

    Defined cases: a null or empty text has no words and gets the severity of none; a model from no rows or one grade
    gives severity 0; an empty table gives an empty result; repeated rows fare alike; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.lit(0).alias("_n"), F.col(text_col).alias("text"))
    kind = rows.schema["_id"].dataType.simpleString()
    out = rows.mapInArrow(_scorer(model), f"_id {kind}, _n int, severity double")
    return out.select(F.col("_id").alias(id_col), "severity", F.round("severity").cast("int").alias("grade"), (F.col("severity") >= reject).alias("toxic"))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", reject: float = 0.3) -> DataFrame:
    """Rows of ``docs``, all columns, whose severity is below ``reject``."""
    table = np.zeros(SIZE)
    table[model.cells] = model.weights

    def run(batches):
        for batch in batches:
            keep = []
            for _, _, data, off in pieces(batch.column(text_col)):
                f, at = _features(data, off)
                hit = np.flatnonzero(table[f])
                pair = np.unique((np.searchsorted(at, hit, "right") - 1) * SIZE + f[hit])
                s = np.bincount(pair // SIZE, table[pair % SIZE], minlength=len(off) - 1)
                keep.append(_logistic(s[:, None] - model.thresholds[None]).sum(1) < reject)
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)
