"""Copies of benchmark items with changed ends, at a similarity just above the limit."""

import random

import pytest

from tickloom.llm import decontamination

LENGTHS = [13, 17, 22, 31, 40, 49, 58, 76, 94, 121, 157, 193, 229, 265, 301]


@pytest.fixture(scope="module")
def copies(spark):
    """Items of many lengths and, for each, documents with the first, the last or some of both words replaced: one word fewer than is too many."""
    rnd, items, docs, want = random.Random(5), [], [], {}
    for n in LENGTHS:
        for x in range(4):
            item = [f"a{rnd.randrange(10**9)}" for _ in range(n)]
            item_id, r = len(items), (n - 4) // 9
            items.append((item_id, " ".join(item)))
            for first in (0, r // 2, r):
                for spare in (0, 1):
                    last = r - first + spare
                    copy = [f"b{rnd.randrange(10**9)}" for _ in range(first)] + item[first:n - last] + [f"c{rnd.randrange(10**9)}" for _ in range(last)]
                    around = [f"d{rnd.randrange(10**9)}" for _ in range(7)]
                    if spare == 0:
                        want[len(docs), item_id] = (7, n, (n - 4 - r) / (n - 4 + r))
                    docs.append((len(docs), " ".join(around + copy + around)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), want


def test_every_copy_above_the_limit_is_found(copies):
    docs, items, want = copies
    got = {(r["doc_id"], r["item_id"]): (r["start"], r["n_words"], r["similarity"]) for r in decontamination.contaminated(docs, items).collect()}
    assert want.keys() - got.keys() == set()
    assert got == want


def test_repeated_shingles_count_with_their_multiplicity(spark):
    """An item of one repeated phrase: what its rarest shingles hold is counted with copies."""
    item = "x y z " * 12 + "p q r s t u v"
    docs = [(1, "x y z " * 12 + "p q r s t u k"), (2, "x y z " * 12 + "g h i j k l m"), (3, "x y z " * 6 + "p q r s t u v")]
    got = {r["doc_id"]: r["similarity"] for r in decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: 38 / 40}


def test_texts_of_one_item_merge(spark):
    """Two rows of one id are one item of all their shingles, looked for at both sizes."""
    a, b = [f"m{i}" for i in range(40)], [f"m{i}" for i in range(38)]
    items = spark.createDataFrame([(1, " ".join(a)), (1, " ".join(b))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(a + a)), (2, " ".join(b))], "doc_id long, text string")
    assert decontamination.contaminated(docs, items, percent=45).count() == 2
