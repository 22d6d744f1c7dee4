"""First crossings, threshold bars, stops and fills against plain loops, on series cut into many small blocks."""

import numpy as np
import pandas as pd
import pytest

from tickloom.core import crossing, slices
from tickloom.operators import backtest, risk, ticks


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(slices, "ROWS_PER_SLICE", 40)
    monkeypatch.setattr(crossing, "SEARCHES", 30)


def test_first_at_least():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        v = rng.integers(0, 8, n).astype(float)
        v[rng.random(n) < 0.1] = -np.inf
        start, level = rng.integers(0, n + 2, 40), rng.integers(0, 10, 40).astype(float)
        level[:3] = np.nan
        want = [next((i for i in range(a, n) if v[i] >= x), n) for a, x in zip(start, level, strict=True)]
        assert crossing.first_at_least(v, start, level).tolist() == want


@pytest.mark.parametrize("up", [True, False])
def test_first_crossing(spark, up):
    """Two levels of blocks, gaps, null levels and starts, starts past the end, a key without rows and a null key."""
    rng = np.random.default_rng(1)
    rows = [(k, i, None if rng.random() < 0.1 else float(rng.integers(0, 30) + (i // 40) * 3)) for k, n in (("a", 500), ("b", 3), (None, 90)) for i in range(n)]
    asks = [(j, k, int(rng.integers(0, 520)) if rng.random() > 0.05 else None, float(rng.integers(-1, 80)) if rng.random() > 0.05 else None) for j, k in enumerate(rng.choice(["a", "b", "c", None], 200).tolist())]
    s = spark.createDataFrame(rows, "k string, pos long, v double").repartition(4)
    q = spark.createDataFrame(asks, "id int, k string, st long, lv double")
    got = {r["id"]: r["hit"] for r in crossing.first_crossing(s, q, ["k"], "v", "lv", "st", "hit", up).collect()}
    values = {(k, i): v for k, i, v in rows if v is not None}
    for j, k, st, lv in asks:
        want = None if st is None or lv is None else next((i for i in range(st, 520) if (k, i) in values and (values[k, i] >= lv if up else values[k, i] <= lv)), None)
        assert got[j] == want


def plain_bars(rows, threshold):
    out, by = [], {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    for sym, rs in by.items():
        bar, k = None, 0
        for _, ts, _, price, volume in rs:
            bar = bar or [ts, price, price, price, 0.0]
            bar = [*bar[:2], max(bar[2], price), min(bar[3], price), bar[4] + volume]
            if bar[4] >= threshold:
                out.append((sym, k, bar[0], bar[1], bar[2], bar[3], price, bar[4]))
                bar, k = None, k + 1
    return sorted(out, key=str)


@pytest.mark.parametrize("threshold", [30.0, 900.0])
def test_threshold_bars_over_many_blocks(spark, threshold):
    """Bars shorter and far longer than a block; one closes on the last tick, some ticks have no volume."""
    rng, start = np.random.default_rng(2), pd.Timestamp("2024-01-01")
    rows = [(sym, (start + pd.Timedelta(minutes=i // 3)).to_pydatetime(), i, float(rng.integers(1, 50)), float(rng.integers(0, 20)))
            for sym, n in (("hot", 700), ("b", 40), ("c", 81), ("one", 1), (None, 30)) for i in range(n)]
    rows.append((None, rows[-1][1], 30, 5.0, 2000.0))
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, seq long, price double, volume double").repartition(4)
    assert sorted((tuple(r) for r in ticks.threshold_bars(df, threshold).collect()), key=str) == plain_bars(rows, threshold)


@pytest.fixture(scope="module")
def market(spark):
    rng = np.random.default_rng(4)
    days = pd.date_range("2020-01-01", periods=300, freq="D").date
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 300)))
    rows = [("a", d, float(c * 0.999), float(c * 1.01), float(c * 0.99), float(c), None if i < 14 else 1.5) for i, (d, c) in enumerate(zip(days, close, strict=True))]
    return rows, spark.createDataFrame(rows, "symbol string, ts date, open double, high double, low double, close double, atr double").repartition(3)


def test_stop_exits(spark, market):
    rows, bars = market
    rng = np.random.default_rng(5)
    asks = []
    for j in range(80):
        i = int(rng.integers(0, 300))
        entry = rows[i][1] if j % 7 else rows[0][1] - pd.Timedelta(days=3).to_pytimedelta()
        asks.append((j, "a" if j else "zz", entry, rows[i][5] * float(rng.uniform(0.97, 1.03)), "long" if j % 2 else "short", entry + pd.Timedelta(days=int(rng.integers(1, 200))).to_pytimedelta()))
    p = spark.createDataFrame(asks, "id int, symbol string, entry_ts date, entry_price double, side string, horizon date")
    want = set()
    for j, sym, entry, price, side, horizon in asks:
        best, s, fired, held = price, 1 if side == "long" else -1, set(), 0
        for _, ts, _, _, _, close, atr in rows if sym == "a" else []:
            if entry < ts <= horizon:
                best, held = (max if s > 0 else min)(best, close), held + 1
                hits = {"fixed": s * (close - (price - s * price * 0.05)) <= 0, "trailing": s * (close - (best - s * best * 0.1)) <= 0,
                        "atr": atr is not None and s * (close - (best - s * atr * 2.0)) <= 0, "time": held >= 20}
                for rule, hit in hits.items():
                    if hit and rule not in fired:
                        fired.add(rule)
                        want.add((j, rule, ts, close))
    exits = risk.stop_exits(p, bars)
    got = {tuple(r) for r in exits.collect()}
    assert got == want
    first = {}
    for j, rule, ts, close in sorted(want, key=lambda x: (x[2], risk.RULES.index(x[1]))):
        first.setdefault(j, (j, ts, close, rule))
    assert {tuple(r) for r in risk.first_exit(exits).collect()} == set(first.values())
    assert {tuple(r) for r in risk.stop_exits(p, bars, rules=["fixed"]).collect()} == {x for x in want if x[1] == "fixed"}


def test_order_fills(spark, market):
    rows, bars = market
    rng = np.random.default_rng(6)
    asks = [(j, "a", rows[int(rng.integers(0, 300))][1], ["buy", "sell"][j % 2], ["market", "limit", "stop"][j % 3], float(rng.uniform(70, 140))) for j in range(90)]
    o = spark.createDataFrame(asks, "id int, symbol string, ts date, side string, kind string, price double")
    want = set()
    for j, _, ts, side, kind, price in asks:
        buy = side == "buy"
        for _, day, open_, high, low, _, _ in rows:
            falls = (kind == "limit") == buy
            if day > ts and (kind == "market" or (low <= price if falls else high >= price)):
                want.add((j, "a", day, open_ if kind == "market" else min(open_, price) if falls == buy and buy or not buy and falls else max(open_, price)))
                break
    assert {tuple(r) for r in backtest.order_fills(o, bars).collect()} == want
