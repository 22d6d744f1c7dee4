"""Every dealt operator on nulls, empty and long texts, ties, repeated rows, empty tables and columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from tickloom.llm import decontamination, fm_index, jaccard, knn, langid, mixing, pitman_yor, preference, suffix_array, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, units string, w string, token long, marks string, copies string"
LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(60_000))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, 7, "u", "w", 1, "m", "c") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """A null id, null, empty and blank texts, one very long text, copies, a repeated row and a null source."""
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, LONG, "b"), (5, "one two three", "b"), (6, "one two three", None), (7, "ONE two\tthree", "a"),
            (8, LONG, "b"), (8, LONG, "b"), (None, "one two three", "a"), (9, "é" * 300 + " ñandú", "a"), (10, "!!! ???", "b")]
    return docs(spark, rows).cache()


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


def ids(df, col="doc_id"):
    return sorted((r[0] for r in df.select(col).collect()), key=lambda x: (x is None, x))


def test_mixing(odd, none):
    out = mixing.mix(odd).cache()
    assert out.count() == odd.count() and mixing.mix(none).count() == 0
    assert set(out.columns) == set(odd.columns) | {"source_size", "target", "taken"}
    assert {r["doc_id"]: r["size"] for r in out.collect() if r["doc_id"] in (1, 2, 3, 4)} == {1: 0, 2: 0, 3: 0, 4: 60_000}
    assert out.where("taken > 3 * size or taken < 0").count() == 0
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, mixing.mix(odd).collect()), key=str)


def test_near_duplicates(odd, none):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(odd).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (5, 1, 5), (6, 1, 5), (7, 1, 5)} <= got
    assert {c for d, _, c in got if d in (4, 8)} == {4} and {c for d, _, c in got if d is None} == {None}
    assert jaccard.near_duplicates(odd).count() == odd.count() and jaccard.near_duplicates(none).count() == 0


@pytest.mark.parametrize("op", [suffix_array, fm_index])
def test_repeats(odd, none, op):
    out = op.dedup(odd, keep_columns=True)
    rows = out.collect()
    assert len(rows) == odd.count() and op.dedup(none).count() == 0
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["n_units"] == 0 and by[1][0]["kept"] is None and bytes(by[2][0]["kept"]) == b""
    assert 0 <= by[4][0]["n_removed"] < by[4][0]["n_units"] and (op is fm_index or len(by[4][0]["kept"]) == by[4][0]["n_units"] - by[4][0]["n_removed"])
    assert [r["n_removed"] == r["n_units"] for r in by[8]] == [True, True]
    assert by[None][0]["n_removed"] == 0 and by[4][0]["marks"] == "m" and by[4][0]["units"] == "u"


def test_decontamination(spark, odd, none):
    items = spark.createDataFrame([(1, "w0x0 w1x1 w2x2 w3x3 w4x4 w5x5"), (1, "w0x0 w1x1 w2x2 w3x3 w4x4 w5x5"), (2, None), (3, "short one"), (None, "w1x1 w2x2 w3x3 w4x4 w5x5")],
                                  "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["start"], r["similarity"]) for r in decontamination.contaminated(odd, items).collect()}
    assert got == {(4, 1, 0, 1.0), (8, 1, 0, 1.0)}
    assert decontamination.contaminated(none, items).count() == 0 and decontamination.contaminated(odd, items.limit(0)).count() == 0
    clean = decontamination.keep_clean(odd, items)
    assert clean.columns == odd.columns and clean.count() == odd.count() - 3


def test_preference(spark):
    rows = [(1, s, i, r, t) for s in ("chosen", "rejected") for i, r, t in ((0, "user", "hi"), (1, "assistant", "a" if s == "chosen" else "b"))]
    rows += [rows[0], (2, "chosen", None, None, None), (3, "rejected", 0, "user", "x"), (None, "chosen", 0, "user", "y"), (4, "chosen", 0, "user", LONG), (4, "rejected", 0, "user", LONG)]
    df = spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string").withColumn("prompt", F.lit(1)).withColumn("n_shared", F.lit(2))
    got = {r["pair_id"]: r for r in preference.format_pairs(df).collect()}
    assert len(got) == 5
    one = got[1]
    assert one["n_shared"] == 1 and one["prompt"] == "<|user|>\nhi<|end|>\n" and one["chosen"] == "<|assistant|>\na<|end|>\n" and one["rejected"] == "<|assistant|>\nb<|end|>\n"
    s = one["chosen_spans"][0]
    assert one["chosen"][s["start"]:s["end"]] == "a<|end|>"
    assert got[3]["chosen"] == "" and got[3]["prompt"] == "" and got[4]["chosen"] == "" and LONG in got[4]["prompt"]
    assert preference.format_pairs(df.limit(0)).count() == 0


def test_knn(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [0.5]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [-1.0, 0.0]), (1, [1.0, 2.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cell", F.lit("x")).withColumn("score", F.lit("y"))
    got = [tuple(r) for r in knn.top_k(df, df.where("vec_id % 100 = 0")).orderBy("rank").collect()]
    m = 1024 * 1024
    assert got == [(0, 1, 1, 5 * m), (0, 2, 2, m // 2), (0, 3, 7, -m)]
    assert knn.top_k(df.limit(0), df).count() == 0 and knn.top_k(df, df.limit(0)).count() == 0


def test_language_model(odd, none):
    out = {r["doc_id"]: r for r in pitman_yor.score_texts(odd.withColumn("held_out", F.col("doc_id") == 4).withColumn("score", F.lit("x"))).collect()}
    assert set(out) == {None, *range(1, 11)} and out[1]["n_tokens"] == 1 and out[4]["n_tokens"] == 60_001
    assert all(r["score"] < 0 and r["base_score"] < 0 for r in out.values())
    assert pitman_yor.score_texts(none.withColumn("held_out", F.lit(False))).count() == 0
    dark = pitman_yor.score_texts(odd.withColumn("held_out", F.lit(True))).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in dark)


def test_language_id(spark, odd, none):
    model = langid.train(odd.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "b").when(F.col("doc_id") != 9, "a")))
    got = langid.identify(odd, model).collect()
    assert len(got) == odd.count() and {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3, 10)} == {"und"} and all(0 <= r["score"] <= 1 for r in got)
    assert langid.identify(none, model).count() == 0
    blind = langid.train(none)
    assert {r["lang_pred"] for r in langid.identify(odd, blind).collect()} == {"und"}


def test_toxicity(spark, odd, none):
    labels = spark.createDataFrame([(5, 1), (5, None), (4, 0), (99, 2), (None, 1)], "doc_id long, grade int").withColumn("text", F.lit("x"))
    model = toxicity.train(odd, labels)
    assert toxicity.score(odd, model).count() == odd.count() and toxicity.score(none, model).count() == 0
    empty = toxicity.train(odd, labels.limit(0))
    assert {r["severity"] for r in toxicity.score(odd, empty).collect()} == {0.0}
    assert toxicity.keep_clean(odd, empty).count() == odd.count()
