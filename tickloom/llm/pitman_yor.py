"""Hierarchical Pitman-Yor language model of word pairs.

Every word is a restaurant whose customers are the words that follow it; all restaurants share one parent, the
restaurant of single words, whose base is uniform over the vocabulary and one unknown word. Seating (how many tables serve a word
in a restaurant) is sampled by Gibbs sweeps; predictive probabilities are averaged over the sweeps kept.

Tokens are dealt by the word before them, so a restaurant and all that is asked of it meet in one bucket. A word that
precedes very many tokens is dealt to several buckets by the word that follows. Three jobs:

1. buckets seat their customers against a parent of their own customers' tables (approximate distributed Gibbs);
2. shards of the vocabulary add up tokens and tables of every word and seat the parent;
3. buckets seat again against the common parent and score all tokens of all texts.

Within a job arrays travel packed in binary columns. Words are known by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import held
from tickloom.llm.textops import STEP, U, mix, pieces, word_hashes

BUCKET_BYTES = 12 << 20  #: text a bucket scores
BUCKETS_PER_SHARD = 16
START, END = U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)
BURN, KEEP = 2, 3
STEPS = 64  #: customers of a dish that are seated one by one; beyond, in blocks that double
NO_ID = -(2**63)


def pack(a: np.ndarray) -> bytes:
    """Whole numbers in the narrowest unsigned type that holds their range, behind its size and the least of them."""
    low = int(a.min()) if len(a) else 0
    span = int(a.max()) - low if len(a) else 0
    size = 1 if span < 1 << 8 else 2 if span < 1 << 16 else 4 if span < 1 << 32 else 8
    return bytes([size]) + np.int64(low).tobytes() + (a.astype(np.int64).view(np.uint64) - np.int64(low).view(np.uint64)).astype(f"u{size}").tobytes()


def unpack(x: pa.Scalar) -> np.ndarray:
    b = x.as_py()
    return (np.frombuffer(b, f"u{b[0]}", offset=9).astype(np.uint64) + np.frombuffer(b, np.uint64, 1, 1)).view(np.int64)


def shard_cuts(words: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard begins in sorted words; shards are equal ranges of hashes."""
    edges = np.array([(i << 64) // shards for i in range(shards)], np.uint64)
    return np.append(np.searchsorted(words, edges), len(words))


def _tokens(data, off):
    """Words with an end behind each text, the word before each, and the text of each."""
    h, at = word_hashes(data, off, lower=True)
    n = np.diff(at) + 1
    last = np.cumsum(n) - 1
    w = np.insert(h, at[1:], END)
    u = np.empty_like(w)
    u[1:] = w[:-1]
    u[last - n + 1] = START
    return u, w, np.repeat(np.arange(len(n)), n)


def _frequent(batches):
    """Words before tokens, with counts, of the batches."""
    seen: dict[int, int] = {}
    for batch in batches:
        for _, _, data, off in pieces(batch.column("text")):
            for x, n in zip(*(v.tolist() for v in np.unique(_tokens(data, off)[0], return_counts=True)), strict=True):
                seen[x] = seen.get(x, 0) + n
    total = sum(seen.values())
    top = sorted(seen.items(), key=lambda x: -x[1])[:20000]
    yield pa.RecordBatch.from_arrays([pa.array(np.array([x for x, _ in top] + [0], np.uint64).view(np.int64)), pa.array([n for _, n in top] + [total], pa.int64()),
                                      pa.array([False] * len(top) + [True])], names=["word", "n", "total"])


def _runs(batch, least: int = 2_000_000):
    """Tokens of some texts at a time, as (word before, word, row)."""
    us, ws, ds, n = [], [], [], 0
    for i, j, data, off in pieces(batch.column("text")):
        u, w, d = _tokens(data, off)
        us.append(u), ws.append(w), ds.append((i + d).astype(np.int32))
        n += len(u)
        if n >= least or j == batch.num_rows:
            yield np.concatenate(us), np.concatenate(ws), np.concatenate(ds)
            us, ws, ds, n = [], [], [], 0


OCCURRENCES = "bucket int, docs binary, heldout binary, u binary, un binary, w binary, ow binary, od binary"


def _deal(batches, buckets: int, hot: np.ndarray, parts: np.ndarray):
    names = [x.split()[0] for x in OCCURRENCES.split(", ")]
    for batch in batches:
        ids, out = np.asarray(batch.column("doc_id")), np.asarray(batch.column("held_out").cast(pa.int8()))
        for u, w, d in _runs(batch):
            key = u
            if len(hot):
                p = np.minimum(np.searchsorted(hot, u), len(hot) - 1)
                split = np.where(hot[p] == u, parts[p], 1).astype(np.uint64)
                key = u ^ mix((w % split) * STEP)
            bucket = (mix(key) % U(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in range(buckets):
                o = order[cut[b]:cut[b + 1]]
                if not len(o):
                    continue
                bu, bw, bd = u[o], w[o], d[o]
                uu, un = np.unique(bu, return_inverse=True)
                by = np.argsort(un, kind="stable")
                wu, wi = np.unique(bw[by], return_inverse=True)
                du, di = np.unique(bd[by], return_inverse=True)
                row = [pack(ids[du]), pack(out[du]), uu.tobytes(), pack(np.bincount(un)), wu.tobytes(), pack(wi), pack(di)]
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *[pa.array([x], pa.binary()) for x in row]], names=names)


class Bucket:
    """The tokens of a bucket: pairs (word before, word) with their training counts, and where they occur."""

    def __init__(self, rows: pa.Table):
        docs, out, u, w, du, dn = [], [], [], [], [], 0
        for r in range(rows.num_rows):
            get = lambda c, r=r: rows.column(c)[r]
            ids = unpack(get("docs"))
            docs.append(ids)
            out.append(unpack(get("heldout")))
            u.append(np.repeat(np.frombuffer(get("u").as_py(), np.uint64), unpack(get("un"))))
            w.append(np.frombuffer(get("w").as_py(), np.uint64)[unpack(get("ow"))])
            du.append((unpack(get("od")) + dn).astype(np.int32))
            dn += len(ids)
        self.docs, out, self.doc = np.concatenate(docs), np.concatenate(out).astype(bool), np.concatenate(du)
        self.contexts, u = np.unique(np.concatenate(u), return_inverse=True)
        self.words, w = np.unique(np.concatenate(w), return_inverse=True)
        pair = u * np.int64(len(self.words)) + w
        del u, w, du
        pairs, pair = np.unique(pair, return_inverse=True)
        self.pair = pair.astype(np.int32)
        self.u, self.w = (pairs // len(self.words)).astype(np.int32), (pairs % len(self.words)).astype(np.int32)
        self.c = np.bincount(self.pair[~out[self.doc]], minlength=len(pairs))
        self.totals = np.bincount(self.u, self.c, minlength=len(self.contexts))


def discount(c: np.ndarray) -> float:
    n1, n2 = int(np.count_nonzero(c == 1)), int(np.count_nonzero(c == 2))
    return min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5


def seat(c: np.ndarray, new: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of every dish with ``c`` customers, who open one with odds ``new`` against (customers - d * tables)."""
    t = (c > 0).astype(np.int64)
    live, j = np.flatnonzero(c > 1), 1
    while len(live):
        block = 1 if j < STEPS else j
        m = np.minimum(block, c[live] - j)
        p = new[live] / (new[live] + np.maximum(j - d * t[live], 1e-9))
        t[live] += (rng.random(len(live)) < p) if block == 1 else rng.binomial(m, p)
        j += block
        live = live[c[live] > j]
    return t


def _sweeps(b: Bucket, parent, theta: float, d: float, rng, sweeps: int, scale: np.ndarray, fixed: np.ndarray):
    """Yields (tables of every pair, tables of every restaurant) after each sweep. ``parent(t)``: probability of every word."""
    seen = np.flatnonzero(b.c)
    t = (b.c > 0).astype(np.int64)
    for _ in range(sweeps):
        full = np.where(np.isnan(fixed), np.bincount(b.u, t, minlength=len(b.contexts)) * scale, fixed)
        new = (theta + d * full[b.u[seen]]) * parent(t)[b.w[seen]]
        t[seen] = seat(b.c[seen], new, d, rng)
        yield t, np.where(np.isnan(fixed), np.bincount(b.u, t, minlength=len(b.contexts)) * scale, fixed)


SEATED = "bucket int, shard int, w binary, c binary, t binary, n1 long, n2 long, hu binary, hc binary, ht binary"


def _hot_scale(b: Bucket, hot, parts):
    p = np.minimum(np.searchsorted(hot, b.contexts), max(len(hot) - 1, 0))
    is_hot = hot[p] == b.contexts if len(hot) else np.zeros(len(b.contexts), bool)
    return is_hot, np.where(is_hot, parts[p] if len(hot) else 1, 1).astype(float)


def _seat_buckets(shards, hot, parts, theta, seed):
    def run(key, rows):
        k = key[0].as_py()
        b, rng = Bucket(rows), np.random.default_rng([seed, 1, k])
        d = discount(b.c)
        is_hot, scale = _hot_scale(b, hot, parts)

        def parent(t):
            n = np.bincount(b.w, t, minlength=len(b.words)) + 0.5
            return n / n.sum()

        for t, _ in _sweeps(b, parent, theta, d, rng, BURN, scale, np.full(len(b.contexts), np.nan)):
            last = t
        c, t = np.bincount(b.w, b.c, minlength=len(b.words)).astype(np.int64), np.bincount(b.w, last, minlength=len(b.words)).astype(np.int64)
        tu = np.bincount(b.u, last, minlength=len(b.contexts))
        cut = shard_cuts(b.words, shards)
        h = np.flatnonzero(is_hot)
        out = []
        for s in range(shards):
            x = slice(cut[s], cut[s + 1])
            out.append((k, s, b.words[x].tobytes(), pack(c[x]), pack(t[x]), int((b.c == 1).sum()) if s == 0 else 0, int((b.c == 2).sum()) if s == 0 else 0,
                        *((b.contexts[h].tobytes(), pack(b.totals[h].astype(np.int64)), pack(tu[h].astype(np.int64))) if s == 0 else (b"", pack(h[:0]), pack(h[:0])))))
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table({n.split()[0]: pa.array(v, kind) for n, v, kind in zip(SEATED.split(", "), zip(*out, strict=True), kinds, strict=True)})

    return run


PARENT = "bucket int, shard int, c binary, t binary, t0 binary, n long, v long, tables long, tables0 long, p1 long, p2 long"


def _seat_parent(shards, theta, seed):
    def run(key, rows):
        s = key[0].as_py()
        rng = np.random.default_rng([seed, 2, s])
        words = [np.frombuffer(x.as_py(), np.uint64) for x in rows.column("w")]
        every, at = np.unique(np.concatenate(words), return_inverse=True)
        c = np.bincount(at, np.concatenate([unpack(x) for x in rows.column("c")]), minlength=len(every)).astype(np.int64)
        t = np.bincount(at, np.concatenate([unpack(x) for x in rows.column("t")]), minlength=len(every)).astype(np.int64)
        v, d, t0 = int((c > 0).sum()), discount(t), (t > 0).astype(np.int64)
        for _ in range(BURN):
            t0 = seat(t, np.full(len(t), (theta + d * t0.sum() * shards) / (v * shards + 1)), d, rng)
        cut = np.cumsum([0, *map(len, words)])
        cols = {"bucket": rows.column("bucket").combine_chunks(), "shard": rows.column("shard").combine_chunks()}
        for name, x in (("c", c), ("t", t), ("t0", t0)):
            cols[name] = pa.array([pack(x[at[cut[i]:cut[i + 1]]]) for i in range(len(words))], pa.binary())
        for name, x in (("n", c.sum()), ("v", v), ("tables", t.sum()), ("tables0", t0.sum()), ("p1", (t == 1).sum()), ("p2", (t == 2).sum())):
            cols[name] = pa.array([int(x)] + [0] * (len(words) - 1), pa.int64())
        return pa.table(cols)

    return run


PARTS = "part int, docs binary, known binary, tokens binary, base binary, score binary"


def _score_buckets(shards, hot, parts, hot_stats, totals, d, theta, seed, parts_out):
    n, v, tables, tables0, d0 = totals

    def run(key, rows, replies):
        k = key[0].as_py()
        b, rng = Bucket(rows), np.random.default_rng([seed, 3, k])
        replies = replies.sort_by("shard")
        c, t, t0 = (np.concatenate([unpack(x) for x in replies.column(name)]) for name in ("c", "t", "t0"))
        p = (t - d0 * t0 + (theta + d0 * tables0) / (v + 1)) / (theta + tables)
        is_hot, scale = _hot_scale(b, hot, parts)
        fixed, totals_u = np.full(len(b.contexts), np.nan), b.totals.astype(float)
        for i in np.flatnonzero(is_hot):
            totals_u[i], fixed[i] = hot_stats[int(b.contexts[i])]
        mean = np.zeros(len(b.c))
        for i, (seated, full) in enumerate(_sweeps(b, lambda _: p, theta, d, rng, BURN + KEEP, scale, fixed)):
            if i >= BURN:
                mean += (np.maximum(b.c - d * seated, 0) + (theta + d * full[b.u]) * p[b.w]) / (theta + totals_u[b.u])
        pair_score, base = np.log10(mean / KEEP), np.log10((c + 1) / (n + v + 1))
        w = b.w[b.pair]
        ids, at = np.unique(b.docs, return_inverse=True)
        doc = at[b.doc]
        cols = [np.bincount(doc, x, minlength=len(ids)) for x in ((c > 0)[w], None, base[w], pair_score[b.pair])]
        part = (mix(ids.view(np.uint64)) % U(parts_out)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(parts_out + 1))
        out = []
        for x in range(parts_out):
            o = order[cut[x]:cut[x + 1]]
            if len(o):
                out.append((x, pack(ids[o]), pack(cols[0][o].astype(np.int64)), pack(cols[1][o].astype(np.int64)), cols[2][o].tobytes(), cols[3][o].astype(np.float32).tobytes()))
        return pa.table({f.split()[0]: pa.array(val, pa.int32() if i == 0 else pa.binary()) for i, (f, val) in enumerate(zip(PARTS.split(", "), zip(*out, strict=True), strict=True))})

    return run


def _add_up(rows: pa.Table) -> pa.Table:
    ids, at = np.unique(np.concatenate([unpack(x) for x in rows.column("docs")]), return_inverse=True)
    whole = [np.bincount(at, np.concatenate([unpack(x) for x in rows.column(c)]), minlength=len(ids)).astype(np.int64) for c in ("tokens", "known")]
    real = [np.bincount(at, np.concatenate([np.frombuffer(x.as_py(), k) for x in rows.column(c)]), minlength=len(ids)) for c, k in (("base", np.float64), ("score", np.float32))]
    return pa.table({"doc_id": ids, "n_tokens": whole[0], "n_known": whole[1], "base_score": real[0], "score": real[1]})


def score_texts(docs: DataFrame, held_out: str = "held_out", id_col: str = "doc_id", text_col: str = "text", theta: float = 1.0, seed: int = 11) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score): log10 probabilities of all texts by a model of those not held out.

    Tokens are the words, A-Z in lower case, and one end. base_score is add-one single words, score the model. Perplexity is 10 ** (-score / n_tokens).
    Defined cases: a null or empty text is one end; a null ``held_out`` counts as held out; rows of one id are one
    document with one result; rows with a null id are likewise one; without training rows every word has the
    probability of the unknown one; an empty table gives an empty result; other columns are not read.
    """
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(held_out), F.lit(True)).alias("held_out"))
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    shards = max(1, -(-buckets // BUCKETS_PER_SHARD))
    light = d.where(F.pmod(F.xxhash64("doc_id"), F.lit(64)) == 0).select("text")  # which words to split between buckets: balance only
    common = light.mapInArrow(_frequent, "word long, n long, total boolean").groupBy("total", "word").agg(F.sum("n").alias("n"))
    common = held(common)
    total = common.where("total").agg(F.sum("n")).first()[0] or 0
    rows = common.where(~F.col("total") & (F.col("n") * buckets > total)).orderBy("word").collect()  # fewer than ``buckets`` rows
    by = sorted((r["word"] % 2**64, min(buckets, -(-2 * r["n"] * buckets // max(total, 1)))) for r in rows)
    hot, parts = np.array([x for x, _ in by], np.uint64), np.array([x for _, x in by], np.int64)

    dealt = d.mapInArrow(lambda b: _deal(b, buckets, hot, parts), OCCURRENCES)
    seated = held(dealt.groupBy("bucket").applyInArrow(_seat_buckets(shards, hot, parts, theta, seed), SEATED))
    one = seated.where("shard = 0").select("n1", "n2", "hu", "hc", "ht").collect()  # a bucket has less than ``buckets`` split words
    n1, n2 = sum(r["n1"] for r in one), sum(r["n2"] for r in one)
    stats: dict[int, tuple[int, int]] = {}
    for r in one:
        for x, c, t in zip(np.frombuffer(r["hu"], np.uint64).tolist(), unpack(pa.scalar(bytes(r["hc"]))).tolist(), unpack(pa.scalar(bytes(r["ht"]))).tolist(), strict=True):
            a = stats.get(x, (0, 0))
            stats[x] = (a[0] + c, a[1] + t)
    replies = held(seated.select("bucket", "shard", "w", "c", "t").groupBy("shard").applyInArrow(_seat_parent(shards, theta, seed), PARENT))
    s = replies.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "v", "tables", "tables0", "p1", "p2")]).first()
    rate = lambda a, b: min(0.95, max(0.05, a / (a + 2 * b))) if a + b else 0.5
    totals = (s[0], s[1], s[2], s[3], rate(s[4], s[5]))
    solve = _score_buckets(shards, hot, parts, stats, totals, rate(n1, n2), theta, seed, buckets)
    scored = dealt.groupBy("bucket").cogroup(replies.select("bucket", "shard", "c", "t", "t0").groupBy("bucket")).applyInArrow(solve, PARTS)
    sums = scored.groupBy("part").applyInArrow(_add_up, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    flags = d.groupBy("doc_id").agg(F.max("held_out").alias("held_out"))
    return sums.join(flags, "doc_id").select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias(id_col), "held_out", "n_tokens", "n_known",
                                             F.lit(s[0]).cast("long").alias("train_tokens"), "base_score", "score")
