"""Operators without a plain SQL form against short loops, and file round trips."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.core import slices
from tickloom.operators import filters, ledger, strategies, ticks
from tickloom.models import learning
from tickloom.sources import filings, logs
from tickloom.sources.store import BarStore
from tickloom.text import documents as D
from tickloom.text import terms as T


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(5)
    pdf = pd.concat([pd.DataFrame({"symbol": s, "ts": pd.date_range("2020-01-01", periods=n), "z": rng.normal(size=n).cumsum() * 0.1 + 3}) for s, n in (("a", 400), ("b", 131))])
    return spark.createDataFrame(pdf).withColumn("ts", F.to_date("ts")).cache(), pdf


def _level(z, q=1e-5, r=1e-2):
    x, p, xs, ps = 0.0, 1.0, [], []
    for v in z:
        pred = p + q
        k = pred / (pred + r)
        x, p = x + k * (v - x), (1 - k) * pred
        xs.append(x)
        ps.append(p)
    return np.array(xs), np.array(ps)


def test_kalman(series):
    df, pdf = series
    lev = filters.kalman_level(df, "z").toPandas().sort_values(["symbol", "ts"])
    smo = filters.kalman_smooth(df, "z").toPandas().sort_values(["symbol", "ts"])
    for s, part in pdf.groupby("symbol"):
        x, p = _level(part["z"])
        np.testing.assert_allclose(lev[lev.symbol == s]["level"], x, rtol=1e-10)
        out = x.copy()
        for t in range(len(x) - 2, -1, -1):
            out[t] = x[t] + p[t] / (p[t] + 1e-5) * (out[t + 1] - x[t])
        np.testing.assert_allclose(smo[smo.symbol == s]["trend"], out, rtol=1e-9)


def test_wavelet_parts_add_up(series):
    df, _ = series
    w = filters.wavelet_components(df, "z", 3).toPandas()
    assert len(w) == 531
    np.testing.assert_allclose(w[["trend", "detail_1", "detail_2", "detail_3"]].sum(axis=1), w["x"], atol=1e-9)


def test_pair_signal_is_the_state_machine(series):
    df, pdf = series
    d = df.select(F.col("symbol").alias("pair"), "ts", F.col("z").alias("spread"))
    got = strategies.pair_signal(d, 1.0, 0.3, 10).toPandas().sort_values(["pair", "ts"])
    for s, part in got.groupby("pair"):
        pos = 0
        for z, sig in zip(part["z"], part["signal"]):
            if not pd.isna(z):
                if pos == 0:
                    pos = -1 if z > 1.0 else 1 if z < -1.0 else 0
                elif pos == 1:
                    pos = 0 if z > -0.3 else 1
                else:
                    pos = 0 if z < 0.3 else -1
            assert sig == pos


def test_average_cost(spark):
    rows = [("a", 1, "buy", 10.0, 100.0, 1.0), ("a", 2, "buy", 10.0, 110.0, 1.0), ("a", 3, "sell", 5.0, 120.0, 2.0), ("a", 4, "sell", 15.0, 90.0, 0.0),
            ("a", 5, "buy", 4.0, 50.0, 0.0), ("b", 1, "buy", 1.0, 7.0, 0.0), ("b", 2, "sell", 2.0, 8.0, 0.0)]
    d = spark.createDataFrame(rows, "symbol string, seq int, side string, qty double, price double, commission double").withColumn("ts", F.lit("2024-01-01").cast("date"))
    got = {(r.symbol, r.seq): r for r in ledger.average_cost(d).collect()}
    assert [got[("a", i)].avg_cost for i in (1, 2, 3)] == [100.0, 105.0, 105.0]
    assert got[("a", 3)].realised == 73.0 and got[("a", 4)].realised == -225.0 and got[("a", 5)].avg_cost == 50.0
    assert got[("b", 2)].oversold and not got[("b", 1)].oversold


def test_volume_bars_drop_the_overshoot(spark):
    rows = [("a", i, float(p), float(v)) for i, (p, v) in enumerate([(10, 60), (11, 60), (9, 30), (12, 80), (8, 10)])]
    d = spark.createDataFrame(rows, "symbol string, seq int, price double, volume double").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    got = sorted((r.bar, r.open, r.high, r.low, r.close, r.volume) for r in ticks.threshold_bars(d, 100.0).collect())
    assert got == [(0, 10.0, 11.0, 10.0, 11.0, 120.0), (1, 9.0, 12.0, 9.0, 12.0, 110.0)]


def test_dbscan(spark):
    pts = [(i, [0.1 * i, 0.0]) for i in range(6)] + [(10 + i, [5.0, 0.1 * i]) for i in range(5)] + [(99, [50.0, 50.0])]
    d = spark.createDataFrame(pts, "vec_id long, x array<double>")
    got = {r.vec_id: r.cluster for r in learning.dbscan(d, 0.15, 3, cells=2).collect()}
    assert {got[i] for i in range(6)} == {got[0]} and {got[10 + i] for i in range(5)} == {got[10]} and got[0] != got[10] and got[99] == -1


def test_store_round_trip(spark, tmp_path):
    b = spark.createDataFrame([("A#1", "1d", "2024-01-01", 1.0), ("A#1", "1d", "2024-01-02", 2.0), ("B", "1d", "2024-01-01", 3.0)], "symbol string, interval string, ts string, close double")
    st = BarStore(spark, str(tmp_path / "bars"))
    st.put(b)
    st.put(spark.createDataFrame([("A#1", "1d", "2024-01-02", 9.0), ("A#1", "1d", "2024-01-03", 4.0)], b.schema))
    got = sorted((r.symbol, r.ts, r.close) for r in st.load().collect())
    assert got == [("A#1", "2024-01-01", 1.0), ("A#1", "2024-01-02", 9.0), ("A#1", "2024-01-03", 4.0), ("B", "2024-01-01", 3.0)]
    assert st.migrate(str(tmp_path / "orc"), "orc").load("A#1").count() == 3
    st.delete("A#1")
    assert [r.symbol for r in st.symbols().collect()] == ["B"]


def test_log_files(spark, tmp_path):
    d = spark.createDataFrame([("A", "buy", 1.0, 2.0, 0.1, 0.0, "s", {"k": "1"}), ("B", "sell", 3.0, 4.0, 0.1, 0.0, "s", {})],
                              "symbol string, side string, qty double, price double, commission double, slippage double, strategy string, metadata map<string,string>")
    d = d.withColumn("ts", F.lit("2024-01-02 03:04:05").cast("timestamp"))
    logs.write_csv(d, str(tmp_path / "csv"), ["k"])
    logs.write_json(d, str(tmp_path / "json"))
    for back in (logs.read_csv(spark, str(tmp_path / "csv")), logs.read_json(spark, str(tmp_path / "json"))):
        got = {r.symbol: (r.qty, r.price, dict(r.metadata or {}), str(r.ts)) for r in back.collect()}
        assert got == {"A": (1.0, 2.0, {"k": "1"}, "2024-01-02 03:04:05"), "B": (3.0, 4.0, {}, "2024-01-02 03:04:05")}


def test_html_tables(spark):
    html = "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>é</td></tr><tr><td>x</td></tr></table><table><tr><td>q</td></tr><tr><td>2</td></tr></table>"
    got = sorted((r.table_no, r.row_no, dict(r.cells)) for r in filings.html_tables(spark.createDataFrame([(1, html)], "page_id long, html string")).collect())
    assert got == [(0, 0, {"a": "1", "b": "é"}), (1, 0, {"q": "2"})]


def test_text(spark):
    d = spark.createDataFrame([(1, "Strong growth, weak Überraschung. Revenue was $1,250.5 million!"), (2, "")], "doc_id long, text string")
    r = d.select("doc_id", D.tokens("text").alias("t"), D.sentences("text").alias("s"), D.section_sentiment("text").alias("x"), D.transcript_metrics("text").alias("m")).orderBy("doc_id").collect()
    assert r[0].t[:4] == ["strong", "growth", "weak", "überraschung"] and len(r[0].s) == 3 and abs(r[0].x - 1 / 3) < 1e-12
    assert r[0].m[0].value == 1250.5 and r[0].m[0].unit == "million" and r[1].t == [] and r[1].x == 0.0
    j = spark.createDataFrame([('{"s": 1}',), ('well {"s": 2} ok',), ("none",)], "t string").select(D.salvage_json("t", "s int")["s"].alias("s")).collect()
    assert [x.s for x in j] == [1, 2, None]


def test_vector_file_skips_bad_lines(spark, tmp_path):
    (tmp_path / "v.txt").write_text("king 1.0 2.0\nbad 1.0 x\nqueen 3 4\n")
    got = {r.word: list(r.vector) for r in T.read_vectors(spark, str(tmp_path / "v.txt")).collect()}
    assert got == {"king": [1.0, 2.0], "queen": [3.0, 4.0]}


def test_tick_jumps_after_a_zero_price(spark):
    df = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 1, 1, 0.0), ("a", 2, 2, 0.0), ("a", 3, 3, 2.0), ("a", 4, 4, 2.01), ("b", 0, 5, None), ("b", 1, 6, 3.0)], "symbol string, t long, seq long, price double")
    d = ticks.tick_jumps(df.withColumn("ts", F.timestamp_seconds("t"))).orderBy("seq").toPandas()
    assert d.seq.tolist() == [1, 2, 3] and d.prev_price.tolist() == [1.0, 0.0, 0.0]  # 2.01 is less than 1 % above 2
    assert d.move[0] == -1.0 and np.isnan(d.move[1]) and d.move[2] == np.inf
