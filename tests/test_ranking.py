"""Ranks, quantiles and slices of distributions that fixed bins do not part."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.core import slices
from tickloom.core.ranking import qcut, quantiles, rank_average
from tickloom.core.slices import spread

ROWS = 200


@pytest.fixture(scope="module")
def groups(spark):
    """Ten slices of values in 100..101, all-equal values, half equal and half next to it, minute and huge values, few whole numbers, nulls."""
    rng, n = np.random.default_rng(0), 10 * ROWS
    values = {"near": 100 + rng.random(n), "same": np.full(n, 7.0), "mix": np.where(rng.random(n) < 0.5, 3.0, 3 + rng.random(n) * 1e-9),
              "tiny": 10.0 ** rng.uniform(-300, -100, n), "wide": rng.normal(0, 1e6, n), "whole": rng.integers(0, 3, n).astype(float)}
    rows = [(k, i, None if k != "same" and i % 50 == 0 else float(x)) for k, v in values.items() for i, x in enumerate(v)]
    rows += [("none", i, None) for i in range(2 * ROWS)] + [(None, i, float(i)) for i in range(2 * ROWS)]
    return spark.createDataFrame(rows, "g string, i int, v double").repartition(5).cache(), pd.DataFrame(rows, columns=["g", "i", "v"])


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(slices, "ROWS_PER_SLICE", ROWS)


@pytest.mark.parametrize("pct", [False, True])
def test_rank(groups, pct):
    df, pdf = groups
    got = rank_average(df, ["g"], "v", "r", pct).toPandas()
    want = pdf.assign(w=pdf.groupby("g", dropna=False)["v"].rank(pct=pct))
    m = got.merge(want, on=["g", "i"], how="outer")
    assert len(m) == len(pdf) and np.allclose(m["r"].astype(float), m["w"], equal_nan=True, rtol=1e-12)


def test_quantiles(groups):
    df, pdf = groups
    probs = [0, 0.05, 0.25, 0.5, 0.9, 0.99, 1]
    got = {r["g"]: r["q"] for r in quantiles(df, ["g"], "v", probs).collect()}
    want = {None if pd.isna(g) else g: np.quantile(x.v.dropna(), probs) for g, x in pdf.groupby("g", dropna=False) if x.v.notna().any()}
    assert set(got) == set(want)
    for g, w in want.items():
        np.testing.assert_allclose(got[g], w, rtol=1e-12)


def test_qcut(groups):
    df, pdf = groups
    got = qcut(df.where("g in ('near', 'wide')"), ["g"], "v", 5, "b").toPandas().set_index(["g", "i"])["b"]
    for g in ("near", "wide"):
        want = pd.qcut(pdf[pdf.g == g].set_index("i")["v"], 5, labels=False) + 1
        assert (got[g].sort_index().astype(float).fillna(-1) == want.sort_index().fillna(-1)).all()


def test_hot_month(spark):
    """Three thousand ticks of one month, most seconds shared by several, in slices of two hundred at most twice over."""
    rng = np.random.default_rng(3)
    start = pd.Timestamp("2024-01-01")
    rows = [("hot", (start + pd.Timedelta(seconds=int(x))).to_pydatetime(), j, float(y)) for j, (x, y) in enumerate(zip(rng.integers(0, 300, 3000), rng.normal(size=3000)))]
    rows += [("hot", None, 3000 + j, 1.0) for j in range(3)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, seq int, x double").repartition(5)
    s = spread(df, back=5, order=["ts", "seq"]).roll(lambda d, w: d.withColumn("m", F.sum("x").over(w.rowsBetween(-5, 0)))).run(c=("sum", F.col("x"))).position("p")
    assert s.df.where("_own").groupBy("symbol", "_slice").count().agg(F.max("count")).first()[0] <= 2 * ROWS
    got = s.done().toPandas().sort_values(["ts", "seq"], na_position="first")
    want = pd.DataFrame(rows, columns=["symbol", "ts", "seq", "x"]).sort_values(["ts", "seq"], na_position="first")
    assert len(got) == len(want) and (got["p"].to_numpy() == np.arange(len(want))).all()
    np.testing.assert_allclose(got["m"], want["x"].rolling(6, min_periods=1).sum(), atol=1e-9)
    np.testing.assert_allclose(got["c"], want["x"].cumsum(), atol=1e-9)


def test_equal_seconds_are_cut_by_the_next_column(spark):
    df = spark.range(2000).selectExpr("'a' AS symbol", "timestamp'2024-01-01' AS ts", "id AS seq", "1L AS x")
    s = spread(df, order=["ts", "seq"]).run(n=("sum", F.col("x")))
    assert s.df.groupBy("_slice").count().agg(F.max("count")).first()[0] <= 2 * ROWS
    assert s.done().where("n <> seq + 1").count() == 0


def test_no_task_sorts_more_than_two_slices(groups):
    """What is shuffled to the windows of a rank, by slice; bins of one value take no part in it."""
    df, _ = groups
    seen = []
    real = slices.Series.position

    def watched(self, name="pos"):
        seen.append(self.df.groupBy("g", "_slice").count().agg(F.max("count")).first()[0])
        return real(self, name)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(slices.Series, "position", watched)
        rank_average(df, ["g"], "v", "r")
    assert seen and max(seen) <= 2 * ROWS
