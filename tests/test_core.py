"""Core pieces against pandas and NumPy on small frames cut into many slices."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.core import slices
from tickloom.core.asof import asof
from tickloom.core.distributions import f_sf, t_sf
from tickloom.core.pairs import pair_moments
from tickloom.core.ranking import qcut, quantiles, rank_average
from tickloom.core.regress import ols
from tickloom.core.slices import affine_run, emas, ema_back, over_rows, span, spread
from tickloom.core.states import state_run


@pytest.fixture(scope="module")
def panel(spark):
    """One symbol holds most rows; two symbols have interleaved days; one has a single row."""
    rng = np.random.default_rng(1)
    rows = []
    for sym, n in (("hot", 900), ("b", 150), ("c", 151), ("one", 1)):
        days = pd.date_range("2020-01-01", periods=n, freq="D")
        v = rng.normal(0, 1, n).cumsum() + 50
        for i, (t, x) in enumerate(zip(days, v)):
            rows.append((sym, t.date(), float(x), None if i % 17 == 3 else float(round(x))))
    pdf = pd.DataFrame(rows, columns=["symbol", "ts", "x", "gap"])
    return spark.createDataFrame(rows, "symbol string, ts date, x double, gap double").cache(), pdf


def _sorted(df):
    return df.toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)


def test_rolling_is_exact_over_slices(panel):
    df, pdf = panel
    f = lambda d, w: d.withColumns({"m": F.avg("x").over(w.rowsBetween(-9, 0)), "l": F.lag("x", 3).over(w), "n": F.lead("x", 2).over(w)})
    got = _sorted(over_rows(df, f, back=10, ahead=2, rows=60))
    want = pdf.sort_values(["symbol", "ts"]).reset_index(drop=True)
    g = want.groupby("symbol")["x"]
    assert len(got) == len(want)
    np.testing.assert_allclose(got["m"], g.transform(lambda s: s.rolling(10, min_periods=1).mean()), rtol=1e-12)
    np.testing.assert_allclose(got["l"].astype(float), g.shift(3), rtol=0)
    np.testing.assert_allclose(got["n"].astype(float), g.shift(-2), rtol=0)


def test_hot_key_is_split(panel):
    df, _ = panel
    s = spread(df, rows=60)
    assert s.df.where("symbol = 'hot' and _own").select("_slice").distinct().count() > 8
    assert s.df.where("_own").groupBy("symbol", "_slice").count().agg(F.max("count")).first()[0] <= 60 + 31


def test_running_aggregates(panel):
    df, pdf = panel
    s = spread(df, rows=60).run(total=("sum", F.col("gap")), top=("max", F.col("x")), seen=("last", F.col("gap")), n=("count", F.col("gap")), p=("product", 1 + F.col("x") / 1e4))
    got = _sorted(s.position("pos").done())
    want = pdf.sort_values(["symbol", "ts"]).reset_index(drop=True)
    g = want.groupby("symbol")
    np.testing.assert_allclose(got["total"].astype(float), g["gap"].cumsum().groupby(want["symbol"]).ffill())
    np.testing.assert_allclose(got["top"], g["x"].cummax())
    np.testing.assert_allclose(got["seen"].astype(float), g["gap"].ffill())
    np.testing.assert_allclose(got["p"], (1 + want["x"] / 1e4).groupby(want["symbol"]).cumprod(), rtol=1e-12)
    assert (got["pos"] == g.cumcount()).all()


def test_ema_matches_pandas(panel):
    df, pdf = panel
    got = _sorted(over_rows(df, lambda d, w: emas(d, w, [("x", span(12), "a"), ("x", span(5), "b")]), back=ema_back(12), rows=100))
    want = pdf.sort_values(["symbol", "ts"]).groupby("symbol")["x"]
    np.testing.assert_allclose(got["a"], want.transform(lambda s: s.ewm(span=12, adjust=False).mean()), rtol=1e-11)
    np.testing.assert_allclose(got["b"], want.transform(lambda s: s.ewm(span=5, adjust=False).mean()), rtol=1e-11)


def test_affine_run(panel):
    df, pdf = panel
    a, b = F.when(F.col("gap").isNull(), 0.0).otherwise(1.0), F.col("x")
    got = _sorted(affine_run(df, a, b, "y", chunk=16))
    for sym, part in got.groupby("symbol"):
        y = 0.0
        for r in part.itertuples():
            y = (0.0 if pd.isna(r.gap) else y) + r.x
            assert abs(r.y - y) < 1e-6


def test_rank_quantiles_qcut(panel):
    df, pdf = panel
    r = _sorted(rank_average(df, ["symbol"], "gap", "r", pct=True))
    want = pdf.sort_values(["symbol", "ts"]).reset_index(drop=True).groupby("symbol")["gap"].rank(pct=True)
    np.testing.assert_allclose(r["r"].astype(float), want)
    q = quantiles(df, ["symbol"], "x", [0.05, 0.5, 0.9], "q").toPandas().set_index("symbol")["q"]
    for sym, part in pdf.groupby("symbol"):
        np.testing.assert_allclose(q[sym], part["x"].quantile([0.05, 0.5, 0.9]), rtol=1e-12)
    b = _sorted(qcut(df.where("symbol in ('hot', 'b')"), ["symbol"], "gap", 5, "bin"))
    for sym, part in b.groupby("symbol"):
        want = pd.qcut(part["gap"].astype(float), 5, labels=False, duplicates="drop") + 1
        np.testing.assert_allclose(part["bin"].astype(float), want)


def test_asof(spark):
    l = spark.createDataFrame([("a", "2020-01-05"), ("a", "2020-03-01"), ("b", "2020-01-01")], "symbol string, ts string").withColumn("ts", F.to_date("ts"))
    r = spark.createDataFrame([("a", "2020-01-01", 1.0), ("a", "2020-03-01", 2.0), ("c", "2020-01-01", 9.0)], "symbol string, ts string, v double").withColumn("ts", F.to_date("ts"))
    got = {(x.symbol, str(x.ts)): x.v for x in asof(l, r, ["symbol"], "ts", ["v"]).collect()}
    assert got == {("a", "2020-01-05"): 1.0, ("a", "2020-03-01"): 2.0, ("b", "2020-01-01"): None}
    fwd = {(x.symbol, str(x.ts)): x.v for x in asof(l, r, ["symbol"], "ts", ["v"], forward=True).collect()}
    assert fwd == {("a", "2020-01-05"): 2.0, ("a", "2020-03-01"): 2.0, ("b", "2020-01-01"): None}


def test_ols_and_tails(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 2))
    y = 1 + x @ [2.0, -1.0] + rng.normal(size=80) * 0.3
    d = spark.createDataFrame([("g", float(b), float(c), float(a)) for (b, c), a in zip(x, y)], "k string, u double, v double, y double")
    r = ols(d, ["k"], "y", ["u", "v"]).first()
    X = np.column_stack([np.ones(80), x])
    beta = np.linalg.lstsq(X, y, rcond=None)[0]
    np.testing.assert_allclose(r.coef, beta, rtol=1e-9)
    rss = ((y - X @ beta) ** 2).sum()
    assert abs(r.mse - rss / 77) < 1e-9 and abs(r.r2 - (1 - rss / ((y - y.mean()) ** 2).sum())) < 1e-9
    assert abs(2 * t_sf(2.0, 10) - 0.07338803) < 1e-7 and abs(f_sf(3.0, 2, 20) - 1.3 ** -10) < 1e-12


def test_pair_moments(panel):
    df, pdf = panel
    got = pair_moments(df.where("symbol <> 'one'"), "x", blocks=3).toPandas().set_index(["a", "b"])
    w = pdf.pivot(index="ts", columns="symbol", values="x")
    both = w[["b", "hot"]].dropna()
    assert len(got) == 6 and got.loc[("b", "hot"), "n"] == len(both)
    np.testing.assert_allclose(got.loc[("b", "hot"), "sxy"], (both["b"] * both["hot"]).sum())
    np.testing.assert_allclose(got.loc[("b", "hot"), "sx"], both["b"].sum())


def test_null_keys_and_orders_are_kept(spark):
    rows = [("a", "2020-01-01", 1.0), (None, "2020-01-01", 2.0), (None, "2020-02-01", 3.0), ("a", None, 4.0)]
    df = spark.createDataFrame(rows, "symbol string, ts string, x double").withColumn("ts", F.to_date("ts"))
    got = over_rows(df, lambda d, w: d.withColumn("p", F.lag("x").over(w)), back=1).collect()
    assert {(r.symbol, r.x, r.p) for r in got} == {("a", 4.0, None), ("a", 1.0, 4.0), (None, 2.0, None), (None, 3.0, 2.0)}
    run = spread(df).run(t=("sum", F.col("x"))).done().collect()
    assert {(r.symbol, r.x, r.t) for r in run} == {("a", 4.0, 4.0), ("a", 1.0, 5.0), (None, 2.0, 2.0), (None, 3.0, 5.0)}


def test_groups_without_values_stay(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None), (None, 5.0)], "g string, v double")
    assert qcut(df, ["g"], "v", 2, "bin").count() == 4
    assert qcut(df.where("v is null"), [], "v", 2, "bin").count() == 1


def test_state_and_affine_depth_follow_the_data(spark):
    df = spark.range(40).select(F.lit("s").alias("symbol"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("ts"), "id")
    step = F.when(F.col("id") == 0, F.array(F.lit(2), F.lit(2))).otherwise(F.array(F.lit(1), F.lit(2)))
    assert {r.s for r in state_run(df, step, "s", chunk=1).collect()} == {2}
    last = affine_run(df, F.lit(1.0), F.lit(1.0), "y", chunk=1).agg(F.max("y")).first()[0]
    assert last == 40.0
