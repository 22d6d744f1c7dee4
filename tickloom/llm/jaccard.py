"""N-gram Jaccard join of documents with signature trees.

1. Every document is its set of k-word shingles. Documents with equal sets are copies; one of them
   stands for all.
2. In any fixed order of the tokens, two sets that are similar enough share a token of their prefixes. Take
   the tokens that one set alone holds first. A set with enough of them has a prefix that it shares with none,
   so it has no link. Counting the quarter of the tokens with low hashes already settles most sets; all
   tokens are counted for the rest, and only sets with too few tokens of their own go on.
3. Those that share a prefix token (shared tokens by rarity), directly or through others, form a cluster; no
   link leaves a cluster. Clusters, or pairs of blocks of large clusters, are the units that tasks solve.
   In a unit a signature tree holds OR-combined bitmaps of the shingles and the range of set sizes in every node.
   A dual traversal drops node pairs whose largest possible overlap is too small; the document
   pairs that are left are checked exactly, unless links already found connect them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm.common import held
from tickloom.llm.components import components
from tickloom.llm.textops import U, mix, pieces, shingle_sets, word_hashes

LOW = U(1 << 62)  #: tokens below are counted first, a quarter of all; it decides speed, not results
FANOUT = 8
BLOCK_DOCS, BLOCK_TOKENS = 1500, 1 << 21  #: largest unit of work: documents, shingles


def _sets(batches, k: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """(batch, row, set) for every row of batches with the columns doc_id and text."""
    for batch in batches:
        for i, _, data, off in pieces(batch.column("text")):
            h, at = word_hashes(data, off, lower=True)
            for r, s in enumerate(shingle_sets(h, at, k)):
                yield batch, i + r, s


def _key(s: np.ndarray) -> np.ndarray:
    """128 bits that equal sets share."""
    if not len(s):
        return np.zeros(2, np.uint64)
    return np.array([np.bitwise_xor.reduce(mix(s + U(1))), s.sum(dtype=np.uint64)], np.uint64)


def _signatures(batches, k):
    for batch in batches:
        n, low, key = [], [], [np.zeros((0, 2), np.uint64)]
        for _, _, s in _sets([batch], k):
            n.append(len(s))
            low.append(int(np.searchsorted(s, LOW)))
            key.append(_key(s)[None])
        a, b = np.concatenate(key).view(np.int64).T
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(low, pa.int64()), pa.array(a.copy()), pa.array(b.copy())],
                                         names=["doc_id", "n_shingles", "n_low", "sig_a", "sig_b"])


def _low_tokens(batches, k):
    for batch in batches:
        tokens, keys = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for _, _, s in _sets([batch], k):
            t = s[:np.searchsorted(s, LOW)]
            a, b = _key(s)
            tokens.append(t)
            keys.append(np.full(len(t), a ^ b))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(keys).view(np.int64))], names=["token", "key"])


def _member_sets(batches, k):
    for batch in batches:
        ids, rows, sets, size = np.asarray(batch.column("doc_id")), [], [], 0
        for _, r, s in _sets([batch], k):
            rows.append(r)
            sets.append(s.tobytes())
            size += s.nbytes
            if size > 1 << 23:
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(sets, pa.binary())], names=["doc_id", "tokens"])
                rows, sets, size = [], [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(sets, pa.binary())], names=["doc_id", "tokens"])


def _exploded(batches):
    for batch in batches:
        ids, sets = np.asarray(batch.column("doc_id")), [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("tokens")]
        size = [len(x) for x in sets]
        for i in range(0, len(sets), 500):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets[i:i + 500])), pa.array(np.repeat(ids[i:i + 500], size[i:i + 500]))], names=["token", "doc_id"])


def _overlap_needed(n, m, percent):
    """Smallest whole intersection x with 100 * x >= percent * (n + m - x)."""
    return -((-percent * (n + m)) // (100 + percent))


class SignatureTree:
    """Nodes by level, leaves (documents) first; a node covers FANOUT neighbours of the level below."""

    def __init__(self, sets: list[np.ndarray]):
        size = np.array([len(s) for s in sets], np.int64)
        bits = 256
        while bits < 65536 and bits < 4 * np.median(size):
            bits *= 2
        maps = np.zeros((len(sets), bits // 64), np.uint64)
        for i, s in enumerate(sets):
            at = (s >> U(20)) & U(bits - 1)
            np.bitwise_or.at(maps[i], (at >> U(6)).astype(np.int64), U(1) << (at & U(63)))
        slack = size - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)  # shingles that share a bit
        self.levels = [(maps, size, size, slack)]
        while len(self.levels[-1][1]) > 1:
            maps, low, high, slack = self.levels[-1]
            cut = np.arange(0, len(low), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(maps, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(slack, cut)))

    def may_link(self, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        maps, low, high, slack = self.levels[level]
        keep = (100 * high[a] >= percent * low[b]) & (100 * high[b] >= percent * low[a])
        keep[keep] = self._enough(maps, low, slack, a[keep], b[keep], percent)
        return keep

    @staticmethod
    def _enough(maps, low, slack, a, b, percent):
        most = np.bitwise_count(maps[a] & maps[b]).sum(axis=1, dtype=np.int64) + np.minimum(slack[a], slack[b])
        return most >= _overlap_needed(low[a], low[b], percent)

    def pairs(self, percent: int, limit: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Dual traversal: document pairs a < b that the bounds leave, in runs."""
        top = len(self.levels) - 1
        work = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while work:
            level, a, b = work.pop()
            if len(a) > limit:
                work += [(level, a[limit:], b[limit:]), (level, a[:limit], b[:limit])]
                continue
            keep = self.may_link(level, a, b, percent)
            a, b = a[keep], b[keep]
            if level == 0:
                off = a < b
                if off.any():
                    yield a[off], b[off]
            elif len(a):
                n = len(self.levels[level - 1][1])
                x = (a[:, None] * FANOUT + np.repeat(np.arange(FANOUT), FANOUT)).ravel()
                y = (b[:, None] * FANOUT + np.tile(np.arange(FANOUT), FANOUT)).ravel()
                ok = (x < n) & (y < n) & (x <= y)
                work.append((level - 1, x[ok], y[ok]))


def solve_unit(ids: np.ndarray, sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what the linked pairs of a unit connect. ``side``: only pairs across its values count."""
    first = np.array([s[0] if len(s) else U(0) for s in sets], np.uint64)
    order = np.lexsort((first, np.floor(np.log2(np.array([len(s) for s in sets]) + 1) * 2)))
    sets, ids = [sets[i] for i in order], ids[order]
    side = None if side is None else side[order]
    root = np.arange(len(sets))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    for a, b in SignatureTree(sets).pairs(percent):
        if side is not None:
            across = side[a] != side[b]
            a, b = a[across], b[across]
        apart = root[a] != root[b]
        for x, y in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
            rx, ry = find(x), find(y)
            if rx == ry:
                continue
            n, m = len(sets[x]), len(sets[y])
            both = np.concatenate((sets[x], sets[y]))
            both.sort()
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            if 100 * common >= percent * (n + m - common):
                root[max(rx, ry)] = min(rx, ry)
                links.append((int(ids[x]), int(ids[y])))
        while (root[root] != root).any():
            root = root[root]
    return links


def _unit_solver(percent):
    def solve(table: pa.Table) -> pa.Table:
        ids, sides = np.asarray(table.column("doc_id")), np.asarray(table.column("side"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("tokens")]
        links = solve_unit(ids, sets, percent, sides if len(set(sides.tolist())) > 1 else None)
        return pa.table({"u": pa.array([x for x, _ in links], pa.int64()), "v": pa.array([y for _, y in links], pa.int64())})

    return solve


def _block_pairs(blocks: DataFrame) -> DataFrame:
    """All pairs of blocks of a cluster whose size bands touch, as (cluster, band, block, other_band, other_block), itself included."""
    o = blocks.select("cluster", F.col("band").alias("other_band"), F.col("k").alias("other_k"))
    near = blocks.join(o, "cluster").where("other_band = band or other_band = band + 1")
    near = near.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumn("other_block", F.explode(F.sequence(F.lit(0), F.col("other_k") - 1)))
    return near.where("other_band > band or other_block >= block").drop("k", "other_k")


def _solve(sets: DataFrame, members: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Links found in the units ``pairs``; every member's set goes to each of its units."""
    unit = F.xxhash64("cluster", "band", "block", "other_band", "other_block")
    one = pairs.select("cluster", "band", "block", unit.alias("unit"), F.lit(0).alias("side"))
    two = pairs.where("band != other_band or block != other_block").select("cluster", F.col("other_band").alias("band"), F.col("other_block").alias("block"), unit.alias("unit"), F.lit(1).alias("side"))
    units = members.join(one.union(two), ["cluster", "band", "block"]).groupBy("doc_id").agg(F.collect_list(F.struct("unit", "side")).alias("units"))
    rows = sets.join(units, "doc_id").select("doc_id", "tokens", F.explode("units").alias("x")).select("x.unit", "x.side", "doc_id", "tokens")
    return rows.groupBy("unit").applyInArrow(_unit_solver(percent), "u long, v long")


def _needed(n, percent):
    """Length of a prefix: so many tokens of a set that a similar one holds one of them."""
    return n - F.ceil(n * percent / F.lit(100)) + 1


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, copy_of (smallest id with the same set), component_id, for every row of ``docs``.

    Two documents link when 100 * intersection >= percent * union of their shingle sets.
    component_id is the smallest id that links reach. Defined cases: a null or empty text has no
    shingles and no links; fewer than ``k`` words are one shingle; a null id gives a null component;
    rows of one id are one document (of different texts the set that is last in byte order counts); an empty table gives an
    empty result; other columns of ``docs`` are not read.

    Clusters of more than BLOCK_DOCS documents or BLOCK_TOKENS shingles are cut into blocks within bands
    of set size. Blocks are solved alone and with the first block of their own and the next band;
    after that only pairs of blocks that those links have not joined into one component are left.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = d.where("doc_id is not null")
    sig = held(d.mapInArrow(lambda b: _signatures(b, k), "doc_id long, n_shingles long, n_low long, sig_a long, sig_b long"))
    same = sig.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "n_low", "sig_a", "sig_b").agg(F.min("doc_id").alias("copy_of"), F.count(F.lit(1)).alias("times"))
    same = held(same)
    copies = held(sig.join(same, ["n_shingles", "n_low", "sig_a", "sig_b"], "left").select(
        "doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("copy_of")).otherwise(F.col("doc_id")).alias("copy_of")))

    tokens = known.mapInArrow(lambda b: _low_tokens(b, k), "token long, key long")
    shared = tokens.groupBy("token").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("token")
    held_by = held(tokens.join(shared, "token").groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    state = same.withColumn("key", F.expr("sig_a ^ sig_b")).join(held_by, "key", "left")
    own = F.col("n_low") - F.coalesce(F.col("n") / F.col("times"), F.lit(0))  # copies count their tokens once each
    open_ = held(state.where(own < _needed(F.col("n_shingles"), percent)).select(F.col("copy_of").alias("doc_id")).distinct())
    sets = known.join(open_, "doc_id").mapInArrow(lambda b: _member_sets(b, k), "doc_id long, tokens binary")
    sets = held(sets.groupBy("doc_id").agg(F.max("tokens").alias("tokens")))
    sizes = sets.select("doc_id", (F.octet_length("tokens") / 8).cast("long").alias("n"))

    every = sets.mapInArrow(_exploded, "token long, doc_id long")
    often = every.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    by_doc = W.partitionBy("doc_id")
    ranked = every.join(often, "token").withColumn("c", F.count(F.lit(1)).over(by_doc)).withColumn("r", F.row_number().over(by_doc.orderBy("df", "token")))
    ranked = ranked.join(sizes, "doc_id").where(F.col("r") <= _needed(F.col("n"), percent) - (F.col("n") - F.col("c")))
    prefix = held(ranked.select("token", "doc_id"))
    least = prefix.groupBy("token").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("token", "low")
    clusters = components(prefix.join(least, "token").where("doc_id > low").select(F.col("doc_id").alias("u"), F.col("low").alias("v")))

    m = clusters.join(sizes, F.col("node") == F.col("doc_id")).select(
        "doc_id", "n", F.col("component").alias("cluster"), F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent) + 0.01)).cast("int").alias("band"))
    m = held(m)  # sizes of a link are less than one band apart
    load = m.groupBy("cluster", "band").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    whole = load.groupBy("cluster").agg(F.sum("c").alias("cc"), F.sum("s").alias("ss")).where("cc > 1")
    small = (F.col("cc") <= BLOCK_DOCS) & (F.col("ss") <= BLOCK_TOKENS)
    blocks = load.join(whole, "cluster").select(
        "cluster", F.when(small, -1).otherwise(F.col("band")).alias("band"),
        F.when(small, 1).otherwise(F.ceil(F.greatest(F.col("c") / BLOCK_DOCS, F.col("s") / BLOCK_TOKENS))).cast("int").alias("k")).distinct()
    keyed = m.join(whole, "cluster").select("doc_id", "cluster", F.when(small, -1).otherwise(F.col("band")).alias("band"))
    keyed = held(keyed.join(blocks, ["cluster", "band"]).select("doc_id", "cluster", "band", F.pmod(F.xxhash64("doc_id"), F.col("k").cast("long")).cast("int").alias("block")))
    pairs = _block_pairs(blocks)
    near = "other_band = band and other_block = block or block = 0 and other_block = 0 or other_band = band and block = 0"
    links = held(_solve(sets, keyed, pairs.where(near), percent))
    rest = pairs.where(f"not ({near})")
    if not rest.isEmpty():
        label = keyed.join(components(links), F.col("doc_id") == F.col("node"), "left").withColumn("c", F.coalesce("component", "doc_id"))
        state = held(label.groupBy("cluster", "band", "block").agg(F.min("c").alias("low"), F.max("c").alias("high")))
        other = state.select("cluster", F.col("band").alias("other_band"), F.col("block").alias("other_block"), F.col("low").alias("low2"), F.col("high").alias("high2"))
        rest = rest.join(state, ["cluster", "band", "block"]).join(other, ["cluster", "other_band", "other_block"])
        rest = held(rest.where("not (low = high and low2 = high2 and low = low2)").select("cluster", "band", "block", "other_band", "other_block"))
        if not rest.isEmpty():
            links = held(links.union(_solve(sets, keyed, rest, percent)))
    found = components(links).select(F.col("node"), "component")
    return copies.join(found, F.col("copy_of") == F.col("node"), "left").select(
        "doc_id", "n_shingles", "copy_of", F.coalesce("component", "copy_of").alias("component_id"))
