"""The pipeline's stages against plain versions, on a copy of the small tables with planted cases."""

import brute
import pytest

import corpus_pipeline as P
from tickloom.llm import toxicity
from tickloom.llm.queries import grades
from tickloom.llm.registry import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """Rows that every stage keeps, by name, each on what the one before it kept."""
    docs, out = table(spark, SF, "documents"), []
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.orderBy("doc_id").collect()]


def test_columns(spark, kept):
    for before, after in kept[:-1]:
        assert after.columns == table(spark, SF, "documents").columns and after.count() > 0


def test_toxic_documents_go(spark, kept):
    before, after = kept[0]
    model = toxicity.train(before, grades(table(spark, SF, "labels")))
    assert {r[0] for r in after.select("doc_id").collect()} == {r["doc_id"] for r in toxicity.score(before, model).where("not toxic").collect()}


def test_one_of_a_group_stays(kept):
    before, after = kept[1]
    want = brute.components(texts(before))
    assert {r[0] for r in after.select("doc_id").collect()} == {d for d, c in want.items() if d == c}


def test_repeated_passages_go(kept):
    before, after = kept[2]
    want = {d: t for d, t in brute.cut_whole_characters(texts(before)).items() if t or dict(texts(before))[d] in ("", None)}
    assert dict(texts(after)) == want
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect() if r["text"] != dict(texts(before))[r["doc_id"]])


def test_leaks_go(spark, kept):
    before, after = kept[3]
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    bad = {d for d, _ in brute.leaks(texts(before), items)}
    assert {r[0] for r in after.select("doc_id").collect()} == {r[0] for r in before.select("doc_id").collect()} - bad


def test_mix(kept):
    before, after = kept[4]
    rows = after.collect()
    assert rows and all(1 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in rows)
    most = max(len(brute.lower_words(t)) for _, t in texts(before))
    by = {}
    for r in rows:
        by.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
    assert all(abs(taken - target) <= most for target, taken in by.values())


def test_run(spark, kept):
    assert sorted(map(tuple, P.run(spark, SF).collect()), key=str) == sorted(map(tuple, kept[-1][1].collect()), key=str)


def test_planted(spark, tmp_path):
    """A copy, a near copy, a leak and a long passage in two documents are caught; the others stay."""
    import random
    rnd = random.Random(1)
    word = lambda n: [f"q{rnd.randrange(10**6)}" for _ in range(n)]
    base, passage = word(80), word(60)
    item = [r["text"] for r in table(spark, SF, "benchmark").orderBy("item_id").collect()][1]
    rows = [(10**6 + i, " ".join(w)) for i, w in enumerate([base, base, base[:40] + ["zz"] + base[40:], word(30) + passage + word(9), word(20) + passage + word(20), word(30) + item.split() + word(30), word(90)])]
    df = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in rows], table(spark, SF, "documents").schema)
    docs = table(spark, SF, "documents").unionByName(df)
    for i, (_, stage) in enumerate(P.STAGES[1:4]):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
    left = {r["doc_id"] - 10**6: r["text"] for r in docs.where("doc_id >= 1000000").collect()}
    assert set(left) == {0, 3, 4, 6} and left[3] == rows[3][1] and left[6] == rows[6][1]
    assert passage[30] in left[3] and passage[30] not in left[4] and left[4].split()[0] == rows[4][1].split()[0]
