"""Registered queries against their oracle SQL on the smallest tables, and plan checks."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tickloom.core import slices

SF = "/root/testdata/sf0.001"
SAMPLE = ["a02_bar_upsert", "b01_fill_forward", "b07_adjust_splits", "c06_drawdown", "c13_rolling_metrics", "d04_floor_volume_bars", "e03_bollinger", "e06_macd", "e11_obv", "f07_point_in_time",
          "g01_rank", "h03_quantile_factor_returns", "j02_mean_reversion", "k03_order_fills", "l01_covariance", "m09_trailing_stop", "n03_next_sessions", "o03_daily_pnl", "p02_stream_book",
          "q08_fama_macbeth", "r04_time_folds", "s06_tfidf", "s28_vocabulary_change", "s40_topic_shifts"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    def cell(v):
        return None if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>") else (round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
    return sorted(tuple(str(cell(v)) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, duck, monkeypatch, name):
    monkeypatch.setattr(slices, "ROWS_PER_SLICE", 64)
    got = entry.queries()[name](spark, SF).toPandas()
    want = duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert sum(x != y for x, y in zip(a, b)) == 0


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["e15_all_indicators", "k01_signal_backtest", "s08_rule_sentiment", "h02_forward_returns"])
def test_native_plans_stay_in_the_jvm(spark, name):
    p = plan(entry.queries()[name](spark, SF))
    assert "Python" not in p and "Pandas" not in p


def test_indicators_share_one_sort_of_the_bars(spark):
    p = plan(entry.queries()["e05_rsi"](spark, SF))
    assert p.count("_slice#") and "CartesianProduct" not in p


def test_scan_is_pruned(spark):
    from tickloom.plans.inputs import table
    d = table(spark, SF, "lineitem").where("l_quantity > 10").select("l_partkey")
    p = plan(d)
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in p and "l_extendedprice" not in p
