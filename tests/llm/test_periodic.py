"""Runs of repeated words against a loop over all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from tickloom.llm import periodic
from tickloom.llm.registry import table

SF = "/root/testdata/sf0.001"


def plain(w, least=24, repeats=3):
    """(start, length, period) of every run, by start and period."""
    n, out = len(w), {}
    for q in range(1, n // repeats + 1):
        x = 0
        while x < n - q:
            if w[x] != w[x + q]:
                x += 1
                continue
            y = x
            while y < n - q and w[y] == w[y + q]:
                y += 1
            if y + q - x >= max(least, repeats * q):
                out.setdefault((x, y + q), q)
            x = y + 1
    return sorted((x, y - x, q) for (x, y), q in out.items())


def made(rng):
    kind, n = rng.randrange(6), rng.randrange(400)
    if kind == 0:
        return [rng.randrange(2) for _ in range(n)]
    if kind == 1:
        return [rng.randrange(1000) for _ in range(n)]
    if kind == 2:
        w = []
        while len(w) < n:
            w += ([rng.randrange(3) for _ in range(rng.randrange(1, 40))] * rng.randrange(1, 8))[:rng.randrange(1, 300)]
        return w
    if kind == 3:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    if kind == 4:
        w = (([rng.randrange(2) for _ in range(rng.randrange(1, 6))] * rng.randrange(1, 20) + [5] * rng.randrange(3)) * 20)[:n]
        for _ in range(rng.randrange(3) if w else 0):
            w[rng.randrange(len(w))] = 7
        return w
    p = [rng.randrange(5) for _ in range(rng.randrange(30, 140))]
    return [9] * rng.randrange(30) + (p * 4)[:3 * len(p) + rng.randrange(10)] + [rng.randrange(5) for _ in range(10)]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("least,repeats", [(24, 3), (3, 3), (10, 4)])
def test_runs(seed, least, repeats):
    rng = random.Random(seed)
    for _ in range(12):
        docs = [made(rng) for _ in range(rng.randrange(1, 8))]
        off = np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype(np.int64)
        s, e, q = periodic.find_runs(np.array([x for d in docs for x in d], np.int64), off, least, repeats)
        want = [(x + int(off[k]), n, p) for k, d in enumerate(docs) for x, n, p in plain(d, least, repeats)]
        assert list(zip(s.tolist(), (e - s).tolist(), q.tolist(), strict=True)) == want


def test_query(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for r in table(spark, SF, "documents").collect():
        w = [x for x in (r["text"] or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain(w)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None, None, None))
        want.add((r["doc_id"], len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)),
                  sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    assert {tuple(r) for r in entry.queries()["op13_periodic_runs"](spark, SF).collect()} == want


def test_edges(spark):
    block = " ".join(f"w{i % 8}" for i in range(24))
    long = " ".join(["one"] * 40_000 + [f"x{i % 5000}" for i in range(15_000)])
    rows = [(1, None), (2, ""), (3, " \n "), (4, "a " * 24), (5, "a " * 23), (6, block), (6, block), (None, block), (7, "\tÀ b\x0bÀ\x0cb\r" * 6 + "c"), (8, long)]
    df = spark.createDataFrame([(i, t, 5, "k", "r") for i, t in rows], "doc_id long, text string, n_words int, kept string, runs string")
    out = periodic.collapse(df).collect()
    assert len(out) == len(rows) and periodic.collapse(df.where("doc_id < 0")).count() == 0
    by = {r["doc_id"]: (r["n_words"], [tuple(x) for x in r["runs"]], None if r["kept"] is None else bytes(r["kept"]).decode()) for r in out}
    assert by[1] == (0, [], None) and by[2] == by[3] == (0, [], "")
    assert by[4] == (24, [(0, 24, 1)], "a") and by[5] == (23, [], " ".join("a" * 23))
    assert by[6] == by[None] == (24, [(0, 24, 8)], " ".join(f"w{i}" for i in range(8)))
    assert by[7] == (25, [(0, 24, 2)], "À b c")
    assert by[8] == (55_000, [(0, 40_000, 1), (40_000, 15_000, 5000)], " ".join(["one"] + [f"x{i}" for i in range(5000)]))
    with pytest.raises(ValueError):
        periodic.collapse(df, repeats=2)


def test_words_are_split_like_the_contract(spark):
    text = "".join(chr(c) for c in range(1, 0x250)) + "  x　y z "
    import re
    want = re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = periodic.collapse(df).first()
    assert r["n_words"] == len(want) and bytes(r["kept"]) == b" ".join(want)
