"""The hedge filter as a scan against a plain loop over rows."""

import numpy as np
import pandas as pd
import pytest

from tickloom.core import gaussian, slices
from tickloom.operators.filters import dynamic_hedge


def plain(y, x, delta=1e-5, r=1e-3):
    b, p, q, out = np.zeros(2), np.eye(2), delta / (1 - delta) * np.eye(2), []
    for yt, xt in zip(y, x, strict=True):
        p = p + q
        if yt is None or xt is None:
            out.append((*b, None))
            continue
        h = np.array([xt, 1.0])
        e = yt - h @ b
        k = p @ h / (h @ p @ h + r)
        b, p = b + k * e, p - np.outer(k, h @ p)
        out.append((*b, e))
    return out


@pytest.mark.parametrize("rows", [7, 64, 1000])
def test_hedge_over_blocks(spark, monkeypatch, rows):
    """A pair over many blocks, one of a single row, a null pair and null prices."""
    monkeypatch.setattr(slices, "ROWS_PER_SLICE", rows)
    rng, data = np.random.default_rng(0), []
    for pair, n in (("hot", 400), ("one", 1), (None, 50)):
        x = 4 + rng.normal(0, 0.02, n).cumsum()
        y = 0.5 + 1.5 * x + rng.normal(0, 0.01, n)
        for i, t in enumerate(pd.date_range("2020-01-01", periods=n)):
            data.append((pair, t.date(), None if i % 40 == 5 else float(y[i]), None if i % 60 == 7 else float(x[i])))
    got = {}
    for r in dynamic_hedge(spark.createDataFrame(data, "pair string, ts date, y double, x double").repartition(4)).collect():
        got.setdefault(r["pair"], []).append(tuple(r)[1:])
    for pair in ("hot", "one", None):
        mine = [d for d in data if d[0] == pair]
        want = plain([d[2] for d in mine], [d[3] for d in mine])
        have = [v[1:] for v in sorted(got[pair])]
        assert len(have) == len(want)
        for a, b in zip(have, want, strict=True):
            assert (a[2] is None) == (b[2] is None)
            np.testing.assert_allclose([v or 0.0 for v in a], [v or 0.0 for v in b], rtol=1e-8, atol=1e-9)


def test_elements_are_associative():
    rng = np.random.default_rng(1)
    x = gaussian.observations(rng.normal(size=(3, 2)), rng.normal(size=3), 0.1, 0.5)
    a, b, c = (tuple(v[i:i + 1] for v in x) for i in range(3))
    for u, v in zip(gaussian.combine(gaussian.combine(a, b), c), gaussian.combine(a, gaussian.combine(b, c)), strict=True):
        np.testing.assert_allclose(u, v, rtol=1e-10, atol=1e-12)
    for u, v in zip(gaussian.whole(x), gaussian.prefixes(x), strict=True):
        np.testing.assert_allclose(u[0], v[-1], rtol=1e-10, atol=1e-12)
