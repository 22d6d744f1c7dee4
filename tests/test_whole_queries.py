"""Queries over all brands, bars, names and language pairs against their oracle SQL."""

import pytest
from pyspark.sql import functions as F
from test_queries import SF, duck  # noqa: F401  duck is a fixture

import __spark_entry__ as entry
from tickloom.plans import family_s

WHOLE = {"a12_wide_to_panel": "count(distinct symbol) = 25", "g10_wide_to_long": "count(distinct symbol) = 25", "k03_order_fills": "count(distinct symbol) = 25",
         "f05_all_factors_value": "count(pe_ratio) > 0", "s42_topic_similarity": "count(distinct lang_a, lang_b) = 6"} | {
    n: "count(distinct id) > 0" for n in ("m08_fixed_stop", "m09_trailing_stop", "m10_atr_stop", "m11_time_stop", "m12_combined_stops")}


def rows(df):
    """Cells to 5 decimals and 12 digits: a ratio over a sum near zero is beyond the digits of a double."""
    def cell(v):
        return "-" if v is None or v != v else f"{round(float(v), 5) + 0.0:.12g}" if isinstance(v, (int, float)) else str(v)
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", WHOLE)
def test_whole_query_matches_oracle(spark, duck, name):  # noqa: F811
    out = entry.queries()[name](spark, SF).cache()
    assert out.agg(F.expr(WHOLE[name])).first()[0]
    assert rows(out.toPandas()) == rows(duck.sql(entry.oracle_sql()[name]).df())


def test_participants_are_not_filtered(spark, monkeypatch):
    text = "Ann Lee - CEO: hello\nBob Ray - CFO: thanks\nOperator: next"
    monkeypatch.setattr(family_s, "transcripts", lambda spark, d: spark.createDataFrame([(1, text)], "conv_id long, text string"))
    assert entry.queries()["s22_participants"](spark, SF).first()["names"] == "Ann Lee|Bob Ray"
