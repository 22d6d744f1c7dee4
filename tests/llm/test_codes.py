"""Product codes against plain loops of integers."""

import hashlib
import math

import numpy as np
import pytest

import __spark_entry__ as entry
from tickloom.llm import codes
from tickloom.llm.registry import table

SF = "/root/testdata/sf0.001"


def plain(rows, parts=8, entries=16, rounds=6):
    """{id: (codes, error)} and all codebook numbers, with Python integers and a full search."""
    kept = {i: [math.floor(4096 * x) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    ids = sorted(kept)
    d = len(kept[ids[0]]) // parts
    cut = {i: [v[p * d:(p + 1) * d] for p in range(parts)] for i, v in kept.items()}
    books = [[cut[i][p] for i in ids[:entries]] for p in range(parts)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    near = lambda x, book: min((far(x, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        got = [[[] for _ in b] for b in books]
        for i in ids:
            for p in range(parts):
                got[p][near(cut[i][p], books[p])[1]].append(cut[i][p])
        books = [[[sum(c) // len(g) for c in zip(*g, strict=True)] if g else e for g, e in zip(got[p], books[p], strict=True)] for p in range(parts)]
    best = {i: [near(cut[i][p], books[p]) for p in range(parts)] for i in ids}
    return {i: ([k for _, k in b], sum(e for e, _ in b)) for i, b in best.items()}, [c for b in books for e in b for c in e]


def test_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, SF, "embeddings").collect()]
    labels = {r["vec_id"]: r["label"] for r in table(spark, SF, "embeddings").collect()}
    want, numbers = plain(rows)
    sums = {}
    for i, (_, e) in want.items():
        sums[labels[i]] = sums.get(labels[i], 0) + e
    sha = hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()
    got = {tuple(r) for r in entry.queries()["op11_vector_codes"](spark, SF).collect()}
    assert got == {(i, "".join(f"{k:02x}" for k in c), e, sums[labels[i]], sha) for i, (c, e) in want.items()}


@pytest.mark.parametrize("kind", [np.int64, object])
@pytest.mark.parametrize("width", [0, 1, 3, 8])
def test_nearest(kind, width):
    rng = np.random.default_rng(width)
    for spread in (2, 50, 10_000):
        book = rng.integers(-spread, spread + 1, (16, width)).astype(kind)
        x = rng.integers(-spread, spread + 1, (300, width)).astype(kind)
        dist = np.array([[int(((a - b) ** 2).sum()) for b in book] for a in x], dtype=np.int64)
        label, best = codes.nearest(x, book)
        assert label.tolist() == dist.argmin(axis=1).tolist() and best.astype(np.int64).tolist() == dist.min(axis=1).tolist()


def test_edges(spark):
    rows = [(1, [0.5] * 8, "a"), (None, [0.1] * 8, None), (2, None, "a"), (3, [0.1, None] * 4, "a"), (4, [float("nan")] * 8, "a"), (5, [float("inf")] + [0.0] * 7, "a"),
            (6, [0.5] * 8, "b"), (6, [0.5] * 8, "b"), (7, [0.25] * 9, "a"), (8, [1e30] * 8, "a"), (9, [400_000.0] * 8, None), (10, [], "a")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label string, v int, codes string")
    books = codes.train(df)
    out = codes.encode(df, books, keep=("label",)).collect()
    by = {}
    for r in out:
        by.setdefault(r["vec_id"], []).append(r)
    assert sorted(by, key=str) == sorted([1, None, 6, 7, 8, 9, 10], key=str) and len(by[6]) == 2
    assert by[1][0]["codes"] == by[6][0]["codes"] and by[1][0]["error"] == 0 and by[None][0]["error"] == 0
    assert all(by[i][0]["codes"] is None and by[i][0]["error"] is None for i in (7, 8, 10))
    assert by[9][0]["codes"] is not None and by[9][0]["error"] == 0  # an entry of its own, beyond 64-bit squares
    assert codes.decode(codes.encode(df.where("vec_id = 1"), books), books).first()["decoded"] == [0.5] * 8
    none = df.where("vec_id = 2")
    assert codes.train(none) is None and codes.encode(none, None).count() == 0
    empty = codes.train(df.where("vec_id = 10"))
    assert codes.encode(df.where("vec_id = 10"), empty).first()["error"] == 0


def test_partitions_do_not_matter(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, rng.normal(size=19).tolist()) for i in range(300)], "vec_id long, embedding array<double>")
    assert codes.train(df.repartition(1)).sha256() == codes.train(df.repartition(7)).sha256()
