"""Packing: pieces and sequences rebuild every document's ids exactly."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from tickloom.llm import packing
from tickloom.llm.registry import table

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(texts):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [e.ids + [1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def held_against(pieces, want, size):
    """Every document whole and in order, sequences gapless and full but the last."""
    docs, seqs = {}, {}
    for p in pieces:
        docs.setdefault(p["doc_id"], []).append(p)
        seqs.setdefault(p["sequence_id"], []).append(p)
    assert set(docs) == set(want)
    for d, ps in docs.items():
        ps.sort(key=lambda p: p["start"])
        assert [p["start"] for p in ps] == np.cumsum([0] + [p["length"] for p in ps[:-1]]).tolist()
        assert {p["doc_tokens"] for p in ps} == {len(want[d])} and all(p["length"] > 0 for p in ps)
        assert b"".join(bytes(p["ids"]) for p in ps) == np.array(want[d], "<u4").tobytes()
    assert sorted(seqs) == list(range(len(seqs)))
    for s, ps in seqs.items():
        ps.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in ps] == np.cumsum([0] + [p["length"] for p in ps[:-1]]).tolist()
        assert s == len(seqs) - 1 or sum(p["length"] for p in ps) == size
    assert sum(p["length"] for p in seqs[len(seqs) - 1]) <= size


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    want = dict(zip(docs, ids_of(docs.values()), strict=True))
    rows = entry.queries()["op12_packing"](spark, SF).collect()
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(want[r["doc_id"]][r["start"]:r["start"] + r["length"]], "<u4").tobytes())
    held_against(packing.pack(table(spark, SF, "documents"), PATH).collect(), want, 2048)


@pytest.mark.parametrize("size", [1, 7, 64, 2048])
def test_edges(spark, size):
    texts = [None, "", " \t\n", "One two, 3four!", "ﬁ é é İstanbul ΣΑΣ K ñ…", "a b　c\x1cd\u0085e", "<|endoftext|> it's 'tis don't ('s)", "x" * 3000, "word " * 3000, "日本語 текст", "dup", "dup"]
    rows = [(i, t, "s", 1, "n") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part string, first int, n string").repartition(5)
    pieces = packing.pack(df, PATH, size=size)
    held_against(pieces.collect(), dict(enumerate(ids_of(texts))), size)
    full = {r["sequence_id"]: r for r in packing.sequences(pieces, size, pad=9).collect()}
    for r in full.values():
        n = r["length"]
        assert len(r["ids"]) == 4 * (n if n & (n - 1) == 0 else size) and set(np.frombuffer(bytes(r["ids"]), "<u4")[n:].tolist()) <= {9}
    none = df.where("doc_id < 0")
    assert packing.pack(none, PATH).count() == 0 and packing.sequences(packing.pack(none, PATH)).count() == 0


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    rows = packing.pack(df, PATH, size=4).collect()
    assert sum(r["length"] for r in rows) == 8 and {r["sequence_id"] for r in rows} == {0, 1}


def test_words_one_by_one():
    rng = random.Random(2)
    some = "aZé'0 ,́ßİ…-\t κ<|>sldłŉǅ"
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(60))) for _ in range(500)]
    encoder = packing.Encoder(PATH)
    assert encoder.plain.fullmatch("Łódź,")
    for t, want in zip(texts, ids_of(texts), strict=True):
        assert b"".join(encoder.table([w for w in t.replace("\t", " ").split(" ")])) == np.array(want[:-1], "<u4").tobytes()


def test_refuses_tokenizers_that_keep_spaces():
    with pytest.raises(ValueError, match="white space"):
        packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
