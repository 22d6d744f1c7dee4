"""Runs of repeated word sequences in texts, found through string synchronising sets.

A run is a longest stretch of words with smallest period q and at least ``repeats`` * q words. Periods below
2 * LEAST are found by comparing neighbours. For every scale t = LEAST, 2 * LEAST, ... the synchronising set holds the
places i where the lowest hash of t words among those starting in i .. i + t is the first or the last of them; starts of
t words with a period of t / 3 or less are left out. Whether i belongs to the set depends on the 2 * t words from i on
alone, so a run of period q repeats its places every q words. Equal contexts of 2 * t words lie more than t / 3 words apart, as
closer ones would make the region highly periodic, so a place has a bounded number of equal partners
within 4 * t words. Partners 2 * t .. 4 * t apart propose their distance as a period, and comparing words finds how far
it holds. A run of period q in that range of 3 * q words and more has such a pair: were all of its stretches left out,
they would share a period of t / 3 or less with the whole run. The highly periodic regions are runs themselves, of smaller
periods, and known from the scales before.

Words are numbered exactly within a task; windows are compared by 64-bit hashes of those numbers to propose
periods, words to confirm where a run ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.textops import STEP, U, mix, pieces

LEAST = 4  #: the smallest scale; periods up to 7 are compared directly
NONE = np.iinfo(np.uint64).max
BLOCK = 1 << 20  #: words compared at once


def _doubled(h: np.ndarray, t: int) -> np.ndarray:
    """Hashes of 2 * t words from those of t words; at the end of the array they hash what is left."""
    out = h * STEP
    out[:-t] += h[t:]
    return mix(out)


def _lowest(c: np.ndarray, t: int) -> np.ndarray:
    """Minimum of c[i] .. c[i + t] for a power of two t, cut at the end of the array."""
    m, k = c.copy(), 1
    while k < t:
        m[:-k] = np.minimum(m[:-k], m[k:])
        k *= 2
    m[:-1] = np.minimum(m[:-1], m[1:])
    return m


def _stretches(hit: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the stretches of at least ``least`` consecutive numbers in the sorted ``hit``."""
    cut = np.flatnonzero(np.diff(hit) != 1)
    first, last = np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(hit) - 1]))
    if not len(hit):
        return hit, hit
    long = last - first + 1 >= least
    return hit[first[long]], hit[last[long]] + 1


def _starts_within(lo: np.ndarray, hi: np.ndarray, t: int, n: int) -> np.ndarray:
    """Flags of the places whose next t words lie in one of the regions [lo, hi)."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi - t + 1, -1)
    return np.cumsum(edge[:n]) > 0


def _pairs(place: np.ndarray, context: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of equal contexts 2 * t up to 4 * t - 1 apart, sorted by distance and place."""
    order = np.argsort(context, kind="stable")
    p, c = place[order], context[order]
    found, gaps, k = [], [], 1
    while k < len(p):
        near = np.flatnonzero((c[k:] == c[:-k]) & (p[k:] - p[:-k] < 4 * t))
        if not len(near):
            break
        gap = p[near + k] - p[near]
        far = gap >= 2 * t
        found.append(p[near[far]])
        gaps.append(gap[far])
        k += 1
    if not found:
        return place[:0], place[:0]
    i, q = np.concatenate(found), np.concatenate(gaps)
    order = np.lexsort((i, q))
    return i[order], q[order]


def _chained(i: np.ndarray, q: np.ndarray, h2: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of one distance whose confirmed words adjoin, as (start, end, distance): words start .. end - 1 equal those q further on."""
    reach = i + 2 * t
    at = np.minimum(reach[:-1] + q[:-1], len(h2) - 1)
    step = np.diff(i)
    same = (np.diff(q) == 0) & ((step <= 2 * t) | ((step <= 4 * t) & (h2[np.minimum(reach[:-1], len(h2) - 1)] == h2[at])))
    head = np.concatenate(([0], np.flatnonzero(~same) + 1))
    tail = np.concatenate((head[1:], [len(i)])) - 1
    return i[head], reach[tail], q[head]


def _edge(words: np.ndarray, h2: np.ndarray, at: np.ndarray, q: np.ndarray, t: int, step: int) -> np.ndarray:
    """How many words from ``at`` on (step 1) or before it (step -1) equal those q further on."""
    n, w = len(words), 2 * t
    done = np.zeros(len(at), np.int64)
    on = np.arange(len(at))
    while len(on):  # whole windows first
        here = at[on] + done[on] if step > 0 else at[on] - done[on] - w
        ok = (here >= 0) & (here + q[on] + w <= n)
        ok[ok] = h2[here[ok]] == h2[here[ok] + q[on][ok]]
        on = on[ok]
        done[on] += w
    reach = np.arange(w)
    for a in range(0, len(at), max(1, BLOCK // w)):
        b = slice(a, a + max(1, BLOCK // w))
        x = (at[b] + done[b])[:, None] + reach if step > 0 else (at[b] - done[b])[:, None] - 1 - reach
        y = x + q[b][:, None]
        bad = (x < 0) | (y >= n)
        bad |= words[np.clip(x, 0, n - 1)] != words[np.clip(y, 0, n - 1)]
        done[b] += np.where(bad.any(axis=1), bad.argmax(axis=1), w)
    return done


def find_runs(words: np.ndarray, off: np.ndarray, least: int = 24, repeats: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of numbered words; text k holds words off[k] .. off[k + 1] - 1. Sorted by start and period.

    ``repeats`` is 3 or more.
    """
    n_texts, sizes = len(off) - 1, np.diff(off)
    place = np.arange(len(words)) + np.repeat(np.arange(1, n_texts + 1), sizes)
    line = np.empty(len(words) + n_texts + 1, np.int64)  # texts with a number of their own before, between and after them
    line[off + np.arange(n_texts + 1)] = -np.arange(1, n_texts + 2)
    line[place] = words
    known = [np.zeros(0, np.int64)] * 3

    def add(start, end, q):
        """Takes runs in; of two on the same stretch that of the smaller period, which came first, stays."""
        nonlocal known
        both = [np.concatenate(x) for x in zip(known, (start, end, q), strict=True)]
        _, first = np.unique(both[0] * (len(line) + 1) + both[1], return_index=True)
        known = [x[np.sort(first)] for x in both]

    for q in range(1, 2 * LEAST):
        start, end = _stretches(np.flatnonzero(line[:-q] == line[q:]), (repeats - 1) * q)
        add(start, end + q, np.full(len(start), q))
    now, pos, h, t = line, np.arange(len(line)), mix(line.astype(np.uint64) * U(0x9E3779B97F4A7C15)), 1
    of = np.repeat(np.arange(n_texts + 1), np.concatenate(([1], sizes + 1)))  # 0 for the first mark, then the text with the mark after it
    while t < LEAST:
        h, t = _doubled(h, t), 2 * t
    longest = np.concatenate(([0], sizes))
    while longest.max() >= 2 * repeats * t:
        stay = longest[of] >= 2 * repeats * t
        if stay.mean() < 0.7:  # shorter texts hold no more runs
            stay[:-1] |= stay[1:] & (of[1:] != of[:-1])  # the mark before a text
            now, pos, h, of = now[stay], pos[stay], h[stay], of[stay]
        n = len(now)
        h2 = _doubled(h, t)
        lo = np.searchsorted(pos, known[0])
        inside = (known[2] <= t // 3) & (known[1] - known[0] >= t) & (lo < n)
        inside[inside] = pos[lo[inside]] == known[0][inside]
        lo = lo[inside]
        m = np.where(_starts_within(lo, lo + (known[1] - known[0])[inside], t, n), NONE, h)
        low = _lowest(m, t)
        chosen = np.flatnonzero((low[:n - t] != NONE) & ((low[:n - t] == m[:n - t]) | (low[:n - t] == m[t:]))) if n > t else np.zeros(0, np.int64)
        i, q = _pairs(chosen, h2[chosen], t)
        if len(i):
            start, end, q = _chained(i, q, h2, t)
            start = start - _edge(now, h2, start, q, t, -1)
            end = end + _edge(now, h2, end, q, t, 1)
            long = end - start >= (repeats - 1) * q
            start, end, q = pos[start[long]], pos[end[long] - 1] + 1 + q[long], q[long]
            add(start, end, q)
        h, t = h2, 2 * t
    start, end, q = known
    keep = end - start >= least
    start, end, q = start[keep], end[keep], q[keep]
    mark = np.searchsorted(off + np.arange(n_texts + 1), start)  # marks before the start
    order = np.lexsort((q, start))
    return (start - mark)[order], (end - mark)[order], q[order]


def kept_words(n: int, start: np.ndarray, end: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Flags of the words that no run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start + q, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge[:n]) == 0


def _collapsed(batches: Iterator[pa.RecordBatch], least: int, repeats: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        filled = pc.fill_null(batch.column("__text"), "")
        for i, j, _, _ in pieces(filled):
            n = j - i
            split = pc.ascii_split_whitespace(filled.slice(i, n))
            flat = split.flatten()
            real = np.asarray(pc.binary_length(flat)) > 0  # white space at an end of a text leaves an empty word
            off = np.concatenate(([0], np.cumsum(real)))[np.asarray(split.offsets) - split.offsets[0].as_py()]
            flat = flat.filter(pa.array(real))
            number = np.asarray(flat.dictionary_encode().indices).astype(np.int64)
            start, end, q = find_runs(number, off, least, repeats)
            text = np.searchsorted(off, start, "right") - 1
            keep = np.flatnonzero(kept_words(len(number), start, end, q))
            edges = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset:flat.offset + len(flat) + 1].astype(np.int64) if len(flat) else np.zeros(1, np.int64)
            data = np.frombuffer(flat.buffers()[2], np.uint8) if len(flat) else np.zeros(0, np.uint8)
            size = edges[keep + 1] - edges[keep] + 1  # with a space after each word
            upto = np.concatenate(([0], np.cumsum(size)))
            at = np.repeat(edges[keep] - upto[:-1], size) + np.arange(upto[-1])
            at[upto[1:] - 1] = len(data)
            out = np.append(data, np.uint8(32))[at]
            cut = upto[np.searchsorted(keep, off)]
            valid = np.asarray(batch.column("__text").slice(i, n).is_valid())
            body = out.tobytes()
            kept = pa.array([body[a:max(a, b - 1)] if v else None for a, b, v in zip(cut[:-1], cut[1:], valid, strict=True)], pa.binary())
            runs = pa.StructArray.from_arrays([pa.array(start - off[text]), pa.array(end - start), pa.array(q)], names=["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(n + 1)).astype(np.int32)), runs)
            part = batch.slice(i, n)
            at_text = batch.schema.get_field_index("__text")
            yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(part.columns) if k != at_text), pa.array(np.diff(off)), runs, kept],
                                             names=[*(f.name for k, f in enumerate(batch.schema) if k != at_text), "n_words", "runs", "kept"])


def collapse(docs: DataFrame, least: int = 24, repeats: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs array<struct<start, length, period>>, kept binary): the runs of every text and what is left of it.

    Words are separated by space and the bytes 9 to 13. ``runs`` holds every longest stretch of words of smallest period q, of
    ``least`` and ``repeats`` * q words at least, by start and period (both counted in words, from 0). ``kept`` are the words that
    no run holds after its first q words, joined by one space. Defined cases: a null text has no words and a null ``kept``; an
    empty one an empty ``kept``; repeated rows and null ids are texts of their own; an empty table gives an empty result; other columns
    are not read. Nothing is shuffled; a task holds about a megabyte of text, or one longer text, at a time.
    """
    if repeats < 3:
        raise ValueError("repeats is 3 or more")
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    kind = rows.schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, kept binary"
    return rows.mapInArrow(lambda b: _collapsed(b, least, repeats), schema)
