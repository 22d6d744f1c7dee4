"""The dealt operators against plain versions on small data."""

import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tickloom.llm import fm_index, jaccard, langid, pitman_yor, repeats, suffix_array, toxicity
from tickloom.llm.queries import grades
from tickloom.llm.registry import table
from tickloom.llm.textops import U

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").orderBy("doc_id").collect()]


def got(spark, name):
    return {r[0]: tuple(r)[1:] for r in entry.queries()[name](spark, SF).collect()}


def repeated(spark):
    """One passage in a hundred texts, whole and in part, at several places of some."""
    rng = np.random.default_rng(5)
    word = lambda n: " ".join(f"{'abcdefgh'[x % 8]}{x}" for x in rng.integers(0, 5000, n))
    passage = word(70).split()
    out = []
    for i in range(100):
        a, b = int(rng.integers(0, 12)), int(rng.integers(58, 71))
        out.append((i, " ".join([word(int(rng.integers(0, 40))), *passage[a:b], word(int(rng.integers(0, 40))), *(passage[:60] if i % 9 == 0 else [])])))
    return out, spark.createDataFrame(out, "doc_id long, text string").repartition(4)


def test_suffix_dedup(spark, rows):
    assert got(spark, "op7_suffix_dedup") == brute.suffix_dedup(rows)


def test_substring_dedup(spark, rows):
    assert got(spark, "op8_substring_dedup") == brute.substring_dedup(rows)


@pytest.mark.parametrize("op,plain", [(suffix_array, brute.suffix_dedup), (fm_index, brute.substring_dedup)])
@pytest.mark.parametrize("hot", [4096, 8])
def test_repeated_passage(spark, op, plain, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    out, df = repeated(spark)
    want = {d: (v[0], v[1], v[-1]) for d, v in plain(out).items()}
    res = op.dedup(df).select("doc_id", "n_units", "n_removed", F.sha2("kept", 256))
    assert {r[0]: tuple(r)[1:] for r in res.collect()} == want


def test_whole_characters(spark):
    a, b = "é" * 80 + " tail one", "è" + "é" * 79 + " tail two"
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    kept = {r["doc_id"]: bytes(r["kept"]) for r in suffix_array.dedup(df, whole_characters=True).collect()}
    kept[2].decode()
    assert kept[1].decode() != ""


def test_jaccard_blocks(spark, monkeypatch):
    """A large group of near copies in many small blocks, beside chains and strangers."""
    rng = np.random.default_rng(3)
    word = lambda n: [f"t{x}" for x in rng.integers(0, 10**6, n)]
    base, out = word(120), []
    for i in range(150):
        w = list(base)
        w[int(rng.integers(0, 120))] = f"v{i}"
        out.append((i, " ".join(w[: int(rng.integers(100, 121))])))
    chain = word(60)
    for i in range(12):
        chain = chain[1:] + word(1)
        out.append((200 + i, " ".join(chain)))
    out += [(300 + i, " ".join(word(50))) for i in range(20)]
    df = spark.createDataFrame(out, "doc_id long, text string")
    sets = {d: frozenset(tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)) for d, t in out}
    label = {d: d for d in sets}
    for _ in range(200):
        before = dict(label)
        for x in sets:
            for y in sets:
                if 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                    label[x] = min(label[x], label[y])
        if before == label:
            break
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 16)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(df).collect()} == label


def test_signature_tree_misses_nothing():
    rng = np.random.default_rng(1)
    sets = []
    for _ in range(40):
        s = rng.integers(0, 2**63, int(rng.integers(5, 200))).astype(np.uint64)
        sets += [np.unique(s), np.unique(np.concatenate((s[1:], s[:1] + U(1))))]
    tree, found = jaccard.SignatureTree(sets), set()
    for a, b in tree.pairs(80):
        found |= set(zip(a.tolist(), b.tolist(), strict=True))
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j])):
                assert (i, j) in found


def test_suffix_array_and_index():
    rng = np.random.default_rng(2)
    text = np.concatenate((rng.integers(1, 4, 300), [0]))
    order = fm_index.suffix_array(text)
    assert order.tolist() == sorted(range(301), key=lambda i: text[i:].tolist())
    m = fm_index.WaveletMatrix(text, 4)
    at = np.arange(301)
    for c in range(4):
        assert (m.rank(np.full(301, c), at) == np.cumsum(np.concatenate(([0], text == c)))[:301]).all()


def test_language_model(spark, rows):
    held_out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    want = brute.add_one(rows, held_out)
    res = entry.queries()["op6_pitman_yor"](spark, SF).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["n_known"], r["train_tokens"]) for r in res} == {d: v[:3] for d, v in want.items()}
    assert all(abs(r["base_score"] - want[r["doc_id"]][3]) < 1e-6 and r["held_out"] == held_out(r["doc_id"]) for r in res)
    out = [r for r in res if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_language_model_buckets(spark, monkeypatch):
    """Buckets, and words split between them, change the sampling only."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").withColumn("held_out", F.col("doc_id") % 5 == 0)
    one = docs.sparkSession.createDataFrame(pitman_yor.score_texts(docs).toPandas())
    monkeypatch.setattr(pitman_yor, "BUCKET_BYTES", 300_000)
    many = pitman_yor.score_texts(docs).select("doc_id", F.col("score").alias("s"), F.col("base_score").alias("b"), F.col("n_known").alias("k"))
    j = one.join(many, "doc_id").agg(F.sum("score"), F.sum("s"), F.max(F.abs(F.col("base_score") - F.col("b"))), F.max(F.abs(F.col("n_known") - F.col("k"))), F.count("s")).first()
    assert abs(j[0] / j[1] - 1) < 0.01 and j[2] < 1e-6 and j[3] == 0 and j[4] == 1000


def test_language_id_held_out(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    res = entry.queries()["op9_language_id"](spark, "/root/testdata/sf0.01").collect()
    out = [r for r in res if r["held_out"]]
    assert len(res) == 1000 and sum(r["lang_pred"] == lang[r["doc_id"]] for r in out) >= 0.97 * len(out)


def test_toxicity_held_out(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), grades(table(spark, "/root/testdata/sf0.1", "labels"))
    model = toxicity.train(docs, labels.where("doc_id % 4 != 0"))
    assert (np.diff(model.thresholds) >= 0).all()
    rest = toxicity.score(docs, model).drop("grade").join(labels.where("doc_id % 4 = 0"), "doc_id").collect()
    bad, fine = [r for r in rest if r["grade"] > 0], [r for r in rest if r["grade"] == 0]
    assert sum(r["toxic"] for r in bad) > 0.7 * len(bad) and sum(r["toxic"] for r in fine) < 0.01 * len(fine)


def test_ordinal_gradient_orders_grades():
    rng = np.random.default_rng(0)
    data = []
    for _ in range(2000):
        g = int(rng.integers(0, 3))
        data.append((g, np.unique(np.concatenate((rng.integers(1000, 5000, 20), [1] * (g > 0), [2] * (g > 1))).astype(np.int64))))
    m = toxicity.fit(data, l1=1.0)
    w = dict(zip(m.cells.tolist(), m.weights.tolist(), strict=True))
    assert m.thresholds[0] < w.get(1, 0) and m.thresholds[1] < w.get(1, 0) + w.get(2, 0) and len(m.thresholds) == 2


def test_temperature_is_finite(spark):
    model = langid.train(table(spark, "/root/testdata/sf0.01", "documents"))
    assert 0.02 < model.temperature < 50 and len(model.languages) == 4
