"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the character 1- to 3-grams of the words with a space on either side, in lower case, hashed
into SIZE cells. Term frequency is relative to the n-grams of the text; document frequency is counted over all
training texts. The model is fitted by follow-the-regularised-leader with elastic net on at most SAMPLE
labelled rows, its temperature on those of them that were held back. As the score is linear, a text's
score is the mean over its words of what each distinct word of a batch adds once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.sparse import LETTERS, Ftrl, bucket, code_points
from tickloom.llm.textops import STEP, U, mix, pieces, word_hashes, word_spans

SIZE = 1 << 15
SAMPLE = 4000  #: labelled rows that the classifier is fitted on, at most; those of lowest hash
ORDERS = (1, 2, 3)
UNKNOWN = "und"


@dataclass
class Words:
    """The distinct words of a piece: ids of their n-grams, where each word's begin, and each text's words."""

    grams: np.ndarray
    begin: np.ndarray
    which: np.ndarray
    at: np.ndarray
    letters: np.ndarray


def words_of(data: np.ndarray, off: np.ndarray) -> Words:
    h, at = word_hashes(data, off)
    start, end, _ = word_spans(data, off)
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    none = np.zeros(0, np.int64)
    if not len(first):
        return Words(none, np.zeros(1, np.int64), none, at, np.zeros(0, bool))
    joined = b" " + b"  ".join(data[s:e].tobytes() for s, e in zip(start[first].tolist(), end[first].tolist(), strict=True)) + b" "
    points = code_points(joined.decode("utf-8", "replace").lower().encode())
    gap = points == 32
    word = np.cumsum(gap & np.concatenate(([True], gap[:-1]))) - 1  # every word begins with a space of its own
    ids, owner = [], []
    mixed = mix(points.astype(np.uint64) + U(1))
    for n in ORDERS:
        m = len(points) - n + 1
        if m <= 0:
            continue
        g, bad = np.full(m, U(n)), np.zeros(m, bool)
        for i in range(n):
            g = g * STEP + mixed[i:i + m]
        bad = word[:m] != word[n - 1:n - 1 + m]
        if n == 1:
            bad |= gap[:m]
        ids.append(bucket(mix(g[~bad]), SIZE))
        owner.append(word[:m][~bad])
    ids, owner = np.concatenate(ids), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    begin = np.searchsorted(owner[order], np.arange(len(first) + 1))
    letters = np.bincount(word, LETTERS[points], minlength=len(first)) > 0
    return Words(ids[order], begin, which.astype(np.int64), at, letters)


def _frequencies(batches):
    """Number of texts that hold each n-gram, and of texts at all (cell -1)."""
    df, rows = np.zeros(SIZE, np.int64), 0
    for batch in batches:
        for _, _, data, off in pieces(batch.column("text")):
            w = words_of(data, off)
            for a, b in zip(w.at[:-1], w.at[1:], strict=True):
                rows += 1
                if b > a:
                    seen = np.zeros(SIZE, bool)
                    u = np.unique(w.which[a:b])
                    seen[w.grams[_ranges(w.begin[u], w.begin[u + 1])]] = True
                    df += seen
    cell = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(cell, -1)), pa.array(np.append(df[cell], rows))], names=["cell", "n"])


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - start
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)


def _vectors(batches):
    """Counts of the n-grams of labelled texts, packed."""
    for batch in batches:
        cells, counts = [], []
        for _, _, data, off in pieces(batch.column("text")):
            w = words_of(data, off)
            for a, b in zip(w.at[:-1], w.at[1:], strict=True):
                u, n = np.unique(w.which[a:b], return_counts=True)
                size = w.begin[u + 1] - w.begin[u]
                c = np.bincount(w.grams[_ranges(w.begin[u], w.begin[u + 1])], np.repeat(n, size), minlength=SIZE) if b > a else np.zeros(SIZE)
                at = np.flatnonzero(c)
                cells.append(at.astype(np.int32).tobytes())
                counts.append(c[at].astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("order"), pa.array(cells, pa.binary()), pa.array(counts, pa.binary())],
                                         names=["label", "order", "cells", "counts"])


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # SIZE x languages, with the inverse document frequency in it
    bias: np.ndarray
    temperature: float


def fit(rows: list, idf: np.ndarray, languages: list[str], epochs: int = 3, alpha: float = 0.5, l1: float = 1e-4, l2: float = 1e-4) -> Model:
    """``rows``: (label, cells, counts). Every fifth row is held back for the temperature."""
    k = len(languages)
    ftrl, bias = Ftrl((SIZE, k), alpha, l1, l2), np.zeros(k)
    code = {x: i for i, x in enumerate(languages)}
    data = [(code[y], np.asarray(c, np.int64), np.asarray(v, np.float64)) for y, c, v in rows if len(c)]
    data = [(y, c, v / v.sum() * idf[c] * 10) for y, c, v in data]
    held_back = data[::5] if len(data) >= 20 else data
    train = [d for i, d in enumerate(data) if i % 5] if len(data) >= 20 else data
    for _ in range(epochs):
        for y, c, v in train:
            w = ftrl.weights(c)
            s = v @ w + bias
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            ftrl.step(c, w, v[:, None] * p[None])
            bias -= 0.01 * p
    w = ftrl.weights()
    scores = np.array([v @ w[c] + bias for _, c, v in held_back]).reshape(len(held_back), k)
    y = np.array([d[0] for d in held_back], int)
    doubt = 1 / (len(y) + 2)  # a label counts as true to this extent less, or a model without errors would be cold

    def loss(t):
        s = scores / t
        top = s.max(1, keepdims=True)
        right = (1 - doubt) * s[np.arange(len(y)), y] + doubt * s.mean(1)
        return float(np.mean(np.log(np.exp(s - top).sum(1)) + top[:, 0] - right))

    grid = np.geomspace(0.02, 50, 200)
    t = float(grid[int(np.argmin([loss(t) for t in grid]))]) if len(y) else 1.0
    return Model(languages, w * idf[:, None] * 10, bias, t)


def _predictor(model: Model):
    def run(batches):
        for batch in batches:
            names, score = [], []
            for _, _, data, off in pieces(batch.column("text")):
                w = words_of(data, off)
                n = np.diff(w.begin)
                sums = np.zeros((len(n) + 1, len(model.bias)))
                np.cumsum(np.add.reduceat(np.vstack((model.weights[w.grams], np.zeros((1, len(model.bias))))), np.minimum(w.begin[:-1], len(w.grams)), axis=0) * (n > 0)[:, None], axis=0, out=sums[1:]) if len(n) else None
                each = np.diff(sums, axis=0)
                for a, b in zip(w.at[:-1], w.at[1:], strict=True):
                    u = w.which[a:b]
                    if b == a or not w.letters[u].any() or not len(model.languages):
                        names.append(UNKNOWN)
                        score.append(0.0)
                        continue
                    s = (each[u].sum(0) / max(n[u].sum(), 1) + model.bias) / model.temperature
                    p = np.exp(s - s.max())
                    p /= p.sum()
                    names.append(model.languages[int(p.argmax())])
                    score.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", order_col: str = "doc_id") -> Model:
    """A model from labelled texts; rows without text or label are left out. Labels in code-point order."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"), F.xxhash64(order_col).alias("order")).where("text is not null and label is not null")
    idf = np.zeros(SIZE)
    df = rows.select("text").mapInArrow(_frequencies, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # at most SIZE + 1 rows
    total = next((r["n"] for r in df if r["cell"] < 0), 0)
    for r in df:
        if r["cell"] >= 0:
            idf[r["cell"]] = np.log((1 + total) / (1 + r["n"])) + 1
    share = min(1.0, 1.5 * SAMPLE / max(total, 1))
    low = rows.where(F.pmod(F.col("order"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    sample = low.mapInArrow(_vectors, "label string, order long, cells binary, counts binary").orderBy("order").limit(SAMPLE).collect()
    unpacked = [(r["label"], np.frombuffer(r["cells"], np.int32), np.frombuffer(r["counts"], np.float32)) for r in sample]
    return fit(unpacked, idf, sorted({r["label"] for r in sample}))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row.

    Defined cases: a null text, one without letters, or a model without labels gives ``und`` with score 0; an empty
    table gives an empty result; repeated rows fare alike; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_predictor(model), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
