"""Logs and bar stores as files that are written and read again."""

import datetime as dt

import pytest

from tickloom.sources import logs
from tickloom.sources.store import BarStore


@pytest.fixture
def log(spark):
    moment = dt.datetime(2024, 3, 1, 9, 30, 0, 123456)
    rows = [(moment, "A", "buy", 1.5, 10.25, 0.1, 0.0, 'says "go",\nthen stops', {"user": "7", "note": "a,b"}), (moment, "B", "sell", 2.0, None, None, 0.0, None, {"user": "8"}),
            (None, "C", "buy", 3.0, 1.0, 0.0, 0.0, "s", {})]
    return spark.createDataFrame(rows, logs.SCHEMA)


def as_set(df):
    return {(r["ts"], r["symbol"], r["side"], r["qty"], r["price"], r["commission"], r["strategy"], tuple(sorted((r["metadata"] or {}).items()))) for r in df.collect()}


def test_csv_files(spark, log, tmp_path):
    path = f"{tmp_path}/log"
    logs.write_csv(log, path, ["user", "note"])
    assert as_set(logs.read_csv(spark, path)) == as_set(log)


def test_json_files(spark, log, tmp_path):
    path = f"{tmp_path}/log"
    logs.write_json(log, path)
    assert as_set(logs.read_json(spark, path)) == as_set(log)


def test_described_store(spark, tmp_path):
    """A second batch replaces the entries and bars of its symbols and leaves the others."""
    day = lambda i: dt.date(2024, 1, i)
    bars = lambda rows: spark.createDataFrame(rows, "symbol string, ts date, open double, high double, low double, close double, volume double")
    store = BarStore(spark, f"{tmp_path}/bars")
    store.save_described(bars([(s, day(i), 1.0, 2.0, 0.5, 1.5, 10.0) for s in "AB" for i in (1, 2, 4, 6)]), "first")
    before = {r["symbol"]: r for r in store.described().collect()}
    store.save_described(bars([("B", day(i), 1.0, 2.0, 0.5, 9.0, 1.0) for i in (3, 4, 5)]), "second")
    after = {r["symbol"]: r for r in store.described().collect()}
    assert after["A"] == before["A"] and (after["B"]["rows"], after["B"]["first_ts"], after["B"]["source"]) == (3, day(3), "second")
    assert after["B"]["last_updated"] > before["B"]["last_updated"]
    got = {(r["symbol"], r["ts"], r["gap_days"]) for r in store.load_regular(start="2024-01-02", end="2024-01-05").collect()}
    assert got == {("A", day(2), 2), ("A", day(4), 2), ("B", day(3), 1), ("B", day(4), 1), ("B", day(5), 1)}
