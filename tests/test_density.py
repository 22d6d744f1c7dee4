"""Density clusters by blocks against all pairs in numpy."""

import numpy as np
import pytest

from tickloom.core import density
from tickloom.models import learning


def brute(x, eps, least):
    d = np.sqrt(((x[:, None].astype(float) - x[None].astype(float)) ** 2).sum(axis=2))
    near = d <= eps
    core = near.sum(axis=1) >= least
    label = np.where(core, np.arange(len(x)), -1)
    while True:
        now = np.array([min(label[near[i] & core]) if core[i] else -1 for i in range(len(x))])
        if (now == label).all():
            break
        label = now
    for i in np.flatnonzero(~core & (near & core).any(axis=1)):
        label[i] = label[min(np.flatnonzero(near[i] & core), key=lambda j: (d[i, j], j))]
    return label.tolist()


@pytest.mark.parametrize("cells", [1, 3])
def test_blocks_equal_all_pairs(spark, monkeypatch, cells):
    monkeypatch.setattr(density, "BLOCK", 40)
    monkeypatch.setattr(density, "TILE", 16)
    monkeypatch.setattr(density, "EXACT", 33)
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(size=(70, 3)) * 0.3 + c for c in r.normal(size=(3, 3)) * 2] + [r.normal(size=(30, 3)) * 3])
    rows = [(i, p.tolist()) for i, p in enumerate(x)] + [(900, None), (901, [None, 1.0, 1.0]), (902, [float("nan"), 0.0, 0.0])]
    d = spark.createDataFrame(rows, "vec_id long, x array<double>")
    got = {a.vec_id: a.cluster for a in learning.dbscan(d, 0.4, 5, cells=cells).collect()}
    want = brute(x, 0.4, 5)
    assert [got[i] for i in range(len(x))] == want and len(set(want)) > 2 and [got[i] for i in (900, 901, 902)] == [-1] * 3


def test_a_dense_group_gives_no_row_per_pair(spark):
    d = spark.range(400).selectExpr("id as vec_id", "array(id / 1000D, 0D) as x")
    rows, pairs = density.blocked(d, "vec_id", "x", 1.0, 1)
    assert [r._n for r in density.neighbour_counts(rows, pairs, 1.0).collect()] == [400] * 400
    assert density.links(rows, pairs, 1.0).count() <= 800
    assert {r.cluster for r in learning.dbscan(d, 1.0, 5).collect()} == {0}
