"""What suffix-array and substring dedup share: finding the places where long repeats can be, and cutting repeats out.

A window is ``length`` consecutive units (bytes or words) of one text. The anchor of a window is its
run of ``gram`` units with the lowest hash, the first of equals. Equal windows have equal anchors at
the same offset, so a window whose anchor occurs once in the corpus has no equal. What is left is
grouped by anchor; the windows of one anchor in one text are a context, shipped once with its units.
Texts that equal a text with a smaller id are repeats as a whole and take no further part.

Anchors with more than HOT contexts are dealt to several tasks by text. Each finds the repeats within its
share; the windows that are first there meet by their content afterwards, where a key has
one row a share at most.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import held
from tickloom.llm.textops import STEP, U, byte_hashes, mix, pieces, sequence_hashes, slice_hashes, word_hashes, word_spans

HOT = 4096
PLACE = (1 << 26) - 1  #: low bits that hold a place within a piece; longer texts than this many units are refused
WHOLE = 2**31 - 1
CHUNK = 1 << 19  #: units of contexts that a task solves at once


@dataclass(frozen=True)
class Unit:
    """Bytes (width 1) or words (width 8, by their hash)."""

    name: str
    length: int
    gram: int

    def prepare(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Units, text boundaries, hash of the gram at every unit."""
        if self.name == "word":
            h, at = word_hashes(data, off)
            return h, at, sequence_hashes(h, self.gram)
        n = len(data) - self.gram + 1
        if n <= 0:
            return data, off, np.zeros(0, np.uint64)
        start = np.arange(n)
        return data, off, mix(slice_hashes(byte_hashes(data), start, start + self.gram))

    def body(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, np.uint64 if self.name == "word" else np.uint8)


def _lowest(c: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours."""
    n = len(c) - w + 1
    pad = np.full(-len(c) % w + w, np.iinfo(np.uint64).max, np.uint64)
    blocks = np.concatenate((c, pad)).reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1:w - 1 + n])


def contexts(grams: np.ndarray, off: np.ndarray, unit: Unit) -> tuple[np.ndarray, ...]:
    """For every anchor of a piece: text, place of the anchor, first and last window start that it is the anchor of."""
    w = unit.length - unit.gram + 1
    n = len(grams) - w + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4
    if len(grams) > PLACE:
        raise ValueError(f"a text of more than {PLACE} units")
    at = (_lowest((mix(grams) & ~U(PLACE)) | np.arange(len(grams), dtype=np.uint64), w) & U(PLACE)).astype(np.int64)
    long = np.diff(off) >= unit.length
    inside = np.zeros(n + 1, np.int64)
    np.add.at(inside, off[:-1][long], 1)
    np.add.at(inside, off[1:][long] - unit.length + 1, -1)
    v = np.flatnonzero(np.cumsum(inside)[:n])
    if not len(v):
        return (np.zeros(0, np.int64),) * 4
    new = np.empty(len(v), bool)
    new[0] = True
    new[1:] = (at[v[1:]] != at[v[:-1]]) | (v[1:] != v[:-1] + 1)
    cut = np.flatnonzero(new)
    first, last = v[cut], v[np.append(cut[1:], len(v)) - 1]
    return np.searchsorted(off, first, "right") - 1, at[first], first, last


def _anchors(batches, unit: Unit):
    for batch in batches:
        ids, sig = np.asarray(batch.column("doc_id")), np.asarray(batch.column("sig"))
        for i, _, data, off in pieces(batch.column("text")):
            _, at, grams = unit.prepare(data, off)
            text, a, _, _ = contexts(grams, at, unit)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(grams[a].view(np.int64)), pa.array(ids[i + text]), pa.array(sig[i + text]), pa.array((a - at[text]).astype(np.int32))],
                                                 names=["anchor", "doc_id", "sig", "place"])


CONTEXT = "anchor long, salt int, hot boolean, doc_id long, sig long, first int, lead int, n int, body binary"


def _bodies(batches, unit: Unit):
    names = [x.split()[0] for x in CONTEXT.split(", ")]
    for batch in batches:
        ids, sig, marks = np.asarray(batch.column("doc_id")), np.asarray(batch.column("sig")), batch.column("marks")
        for i, _, data, off in pieces(batch.column("text")):
            seq, at, grams = unit.prepare(data, off)
            text, a, lo, hi = contexts(grams, at, unit)
            salts = np.zeros(len(a), np.int64)
            edge = np.searchsorted(text, np.arange(len(off)))
            for t in range(len(off) - 1):
                m = marks[i + t].values
                have, of = a[edge[t]:edge[t + 1]] - at[t], np.asarray(m.field("place"))
                order = np.argsort(of)
                p = np.minimum(np.searchsorted(of, have, sorter=order), len(of) - 1)
                hit = of[order[p]] == have
                salts[edge[t]:edge[t + 1]] = np.where(hit, np.asarray(m.field("salts"))[order[p]], 0)
            keep = np.flatnonzero(salts)
            text, a, lo, hi, salts = text[keep], a[keep], lo[keep], hi[keep], salts[keep]
            who = i + text
            salt = (mix(ids[who].view(np.uint64) ^ sig[who].view(np.uint64)) % salts.astype(np.uint64)).astype(np.int32)
            size = seq.itemsize
            raw = memoryview(np.ascontiguousarray(seq)).cast("B")
            for x in range(0, len(a), 20000):
                s = slice(x, x + 20000)
                body = [bytes(raw[p * size:(q + unit.length) * size]) for p, q in zip(lo[s].tolist(), hi[s].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(grams[a[s]].view(np.int64)), pa.array(salt[s]), pa.array(salts[s] > 1), pa.array(ids[who[s]]), pa.array(sig[who[s]]),
                    pa.array((lo - at[text])[s].astype(np.int32)), pa.array((a - lo)[s].astype(np.int32)), pa.array((hi - lo + 1)[s].astype(np.int32)), pa.array(body, pa.binary())], names=names)


@dataclass
class Contexts:
    """Contexts of whole anchor groups, joined: context i has the units units[begin[i]:begin[i + 1]] and n[i] windows."""

    units: np.ndarray
    begin: np.ndarray
    group: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    lead: np.ndarray
    n: np.ndarray

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Context of every window, and its number in the context."""
        c = np.repeat(np.arange(len(self.n)), self.n)
        return c, np.arange(len(c)) - np.repeat(np.cumsum(self.n) - self.n, self.n)


REPEAT = "doc_id long, sig long, start int, end int, key_a long, key_b long"


def _emit(rows: pa.Table, unit: Unit, solve):
    col = {c: np.asarray(rows.column(c).combine_chunks()) for c in ("anchor", "salt", "doc_id", "sig", "first", "lead", "n")}
    hot = np.asarray(rows.column("hot").to_numpy())
    body = [unit.body(x.as_buffer()) for x in rows.column("body")]
    begin = np.concatenate(([0], np.cumsum([len(x) for x in body])))
    group = np.cumsum(np.concatenate(([0], (col["anchor"][1:] != col["anchor"][:-1]) | (col["salt"][1:] != col["salt"][:-1]))))
    x = Contexts(np.concatenate(body), begin, group, col["doc_id"], col["first"].astype(np.int64), col["lead"].astype(np.int64), col["n"].astype(np.int64))
    removed = solve(x, unit)
    c, j = x.windows()
    r = np.flatnonzero(removed)
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1] + 1) | (c[r[1:]] != c[r[:-1]])
    cut = np.flatnonzero(new)
    last = r[np.append(cut[1:], len(r)) - 1] if len(r) else r
    head, s = r[cut], np.flatnonzero(~removed & hot[c])
    none = np.zeros(len(head), bool)
    who, start = np.concatenate((c[head], c[s])), np.concatenate((j[head], j[s]))
    stop = np.concatenate((j[last], j[s]))
    key = window_keys(x, unit, c[s], j[s])
    blank = np.concatenate((~none, np.zeros(len(s), bool)))
    keys = [pa.array(np.concatenate((np.zeros(len(head), np.int64), k.view(np.int64))), mask=blank) for k in key]
    yield pa.RecordBatch.from_arrays([pa.array(x.doc[who]), pa.array(col["sig"][who]), pa.array((x.first[who] + start).astype(np.int32)),
                                      pa.array((x.first[who] + stop + unit.length).astype(np.int32)), *keys], names=["doc_id", "sig", "start", "end", "key_a", "key_b"])


def window_keys(x: Contexts, unit: Unit, c: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the content of windows."""
    at = x.begin[c] + j
    a, b = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for i in range(unit.length):
        v = x.units[at + i].astype(np.uint64) + U(1)
        a, b = a * STEP + v, mix(b + v)
    return mix(a), b


def _solver(unit: Unit, solve):
    """Solves groups of equal (anchor, salt) of sorted batches, some groups at a time."""

    def run(batches):
        waiting, size = [], 0
        for batch in batches:
            waiting.append(batch)
            size += batch.column("body").nbytes // (8 if unit.name == "word" else 1)
            if size >= CHUNK:
                rows = pa.Table.from_batches(waiting).combine_chunks()
                key = np.asarray(rows.column("anchor")), np.asarray(rows.column("salt"))
                cut = np.flatnonzero((key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]))
                if len(cut):
                    yield from _emit(rows.slice(0, int(cut[-1]) + 1), unit, solve)
                    waiting = rows.slice(int(cut[-1]) + 1).to_batches()
                    size = 0
        if waiting:
            rows = pa.Table.from_batches(waiting).combine_chunks()
            if rows.num_rows:
                yield from _emit(rows, unit, solve)

    return run


def find_repeats(docs: DataFrame, unit: Unit, solve: Callable[[Contexts, Unit], np.ndarray], same_text: bool) -> DataFrame:
    """(doc_id, sig, marks): the intervals of units that repeats cover, one row for each text that has some.

    ``docs``: doc_id, text, sig. ``same_text``: a window may also repeat an earlier one of its own text.
    """
    known = docs.where("doc_id is not null")
    ids = held(known.select("doc_id", "sig", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("digest")))
    low = ids.groupBy("digest").agg(F.min("doc_id").alias("low"))
    copies = ids.join(low, "digest").where("doc_id > low").select("doc_id", "sig").distinct()
    anchors = known.mapInArrow(lambda b: _anchors(b, unit), "anchor long, doc_id long, sig long, place int")
    which = F.xxhash64("sig", "place") if same_text else F.col("sig")
    shared = held(anchors.groupBy("anchor").agg(F.min(which).alias("x"), F.max(which).alias("y"), F.count(F.lit(1)).alias("n")).where("x < y")
                  .select("anchor", F.ceil(F.col("n") / HOT).cast("int").alias("salts")))  # a table of its own, so that the join can split frequent anchors
    places = anchors.join(shared, "anchor").select("doc_id", "sig", "place", "salts").join(copies, ["doc_id", "sig"], "left_anti")
    marks = held(places.groupBy("doc_id", "sig").agg(F.collect_list(F.struct("place", "salts")).alias("marks")))
    rows = known.join(marks, ["doc_id", "sig"]).mapInArrow(lambda b: _bodies(b, unit), CONTEXT)
    found = held(rows.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt").mapInArrow(_solver(unit, solve), REPEAT))
    own = F.struct("doc_id", "start") if same_text else F.struct("doc_id")
    open_ = found.where("key_a is not null").withColumn("own", own)
    least = open_.groupBy("key_a", "key_b").agg(F.min("own").alias("least"))
    later = open_.join(least, ["key_a", "key_b"]).where("own > least")
    pick = ["doc_id", "sig", "start", "end"]
    every = found.where("key_a is null").select(*pick).union(later.select(*pick)).union(copies.select("doc_id", "sig", F.lit(0), F.lit(WHOLE)))
    return every.groupBy("doc_id", "sig").agg(F.collect_list(F.struct("start", "end")).alias("marks"))


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted, disjoint intervals that cover the same; touching ones become one."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    cut = np.flatnonzero(new)
    return start[cut], reach[np.append(cut[1:], len(start)) - 1]


CUT = "n_units long, n_removed long, spans array<struct<start:int,end:int>>, kept binary"


def _whole(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals of UTF-8 bytes without the characters that they hold a part of."""
    inner = np.append((data & 0xC0) == 0x80, False)  # not the first byte of a character
    for _ in range(3):
        a = a + (inner[a] & (a < b))
        b = b - (inner[b] & (a < b))
    return a[a < b], b[a < b]


def _cutter(unit: Unit, columns: list[str], whole_characters: bool):
    def run(batches):
        for batch in batches:
            marks, out = batch.column("marks"), []
            for i, _, data, off in pieces(batch.column("text")):
                s, e, at = word_spans(data, off) if unit.name == "word" else (None, None, off)
                for t in range(len(off) - 1):
                    n = int(at[t + 1] - at[t])
                    m = marks[i + t].values if marks[i + t].is_valid else None
                    a = b = np.zeros(0, np.int64)
                    if m is not None and n >= unit.length:
                        a, b = merged(np.asarray(m.field("start")).astype(np.int64), np.minimum(np.asarray(m.field("end")).astype(np.int64), n))
                    if whole_characters and len(a):
                        a, b = _whole(data[off[t]:off[t + 1]], a, b)
                    keep = np.ones(n, bool)
                    for p, q in zip(a.tolist(), b.tolist(), strict=True):
                        keep[p:q] = False
                    if unit.name == "word":
                        w = np.flatnonzero(keep) + at[t]
                        kept = b" ".join(data[p:q].tobytes() for p, q in zip(s[w].tolist(), e[w].tolist(), strict=True))
                    else:
                        kept = data[off[t]:off[t + 1]][keep].tobytes()
                    out.append((n, int(n - keep.sum()), [{"start": p, "end": q} for p, q in zip(a.tolist(), b.tolist(), strict=True)], kept if batch.column("text")[i + t].is_valid else None))
            n, gone, spans, kept = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                                              pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())],
                                             names=[*columns, "n_units", "n_removed", "spans", "kept"])

    return run


def cut_repeats(docs: DataFrame, unit: Unit, solve, same_text: bool, id_col: str, text_col: str, keep_columns: bool,
                whole_characters: bool = False) -> DataFrame:
    """Rows of ``docs``, the text replaced by n_units, n_removed, spans (maximal removed runs) and kept (bytes, null for null)."""
    new = ("n_units", "n_removed", "spans", "kept")
    extra = [c for c in docs.columns if keep_columns and c not in (id_col, text_col, *new)]
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("sig"),
                       *[F.col(c).alias(f"x_{c}") for c in extra])
    marks = find_repeats(base.select("doc_id", "text", "sig"), unit, solve, same_text)
    cols = ["doc_id", *[f"x_{c}" for c in extra]]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields if f.name in cols)
    out = base.join(marks, ["doc_id", "sig"], "left").select(*cols, "text", "marks").mapInArrow(_cutter(unit, cols, whole_characters), f"{kinds}, {CUT}")
    return out.withColumnsRenamed({f"x_{c}": c for c in extra}).withColumnRenamed("doc_id", id_col)
