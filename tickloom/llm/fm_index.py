"""Substring dedup with a compressed FM-index for every shard.

A shard is what one task gets of the contexts that can repeat at all (see ``repeats``). Its words are indexed: the
suffix array of the joined contexts gives the Burrows-Wheeler transform, kept in a wavelet matrix of packed
bits, and the document of every suffix with range minima. The contexts are then streamed against the
index, all at once in numpy: backward search extends a match to the left while it still occurs in a
document with a smaller id, which is the matching statistic at its end; matches of the threshold
and more are reported.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tickloom.llm.repeats import Contexts, Unit, cut_repeats
from tickloom.llm.textops import U


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling."""
    n = len(text)
    rank, step = text.astype(np.int64), 1
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[:-step or n] = rank[step:] + 1
        key = rank * (n + 2) + nxt if step > 1 else rank * (int(rank.max()) + 2) + nxt
        order = np.argsort(key)
        new = np.zeros(n, np.int64)
        new[1:] = key[order[1:]] != key[order[:-1]]
        ranks = np.cumsum(new)
        rank = np.empty(n, np.int64)
        rank[order] = ranks
        if ranks[-1] == n - 1:
            return order
        step *= 2


class WaveletMatrix:
    """Rank of any symbol in a sequence; one packed bit a level and entry, with a count every 64 bits."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.ones, self.zeros = [], [], []
        cur = seq.astype(np.int64)
        n = len(cur)
        for level in range(self.levels - 1, -1, -1):
            b = (cur >> level) & 1
            packed = np.packbits(np.concatenate((b, np.zeros(-n % 64 + 64, np.int64))).astype(np.uint8), bitorder="little").view(np.uint64)
            self.bits.append(packed)
            self.ones.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)))[:-1])
            self.zeros.append(int(n - b.sum()))
            cur = np.concatenate((cur[b == 0], cur[b == 1]))
        symbols = np.arange(sigma)
        self.first = self._down(symbols, np.zeros(sigma, np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            word = i >> 6
            one = self.ones[k][word] + np.bitwise_count(self.bits[k][word] & ((U(1) << (i & 63).astype(np.uint64)) - U(1)))
            i = np.where((symbol >> (self.levels - 1 - k)) & 1, self.zeros[k] + one, i - one)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before ``i``."""
        return self._down(symbol, i) - self.first[symbol]


class FMIndex:
    """Contexts joined with one end each, the lowest symbols; ``who`` is the rank of the document of every entry."""

    def __init__(self, text: np.ndarray, sigma: int, who: np.ndarray):
        sa = suffix_array(text)
        self.bwt = WaveletMatrix(text[sa - 1], sigma)
        self.start = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))[:-1]
        self.least = [who[sa].astype(np.int32)]
        while 2 << (len(self.least) - 1) <= len(sa):
            a, s = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(a[:-s], a[s:]))

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that start with ``symbol`` and go on as one in [lo, hi)."""
        both = self.bwt.rank(np.concatenate((symbol, symbol)), np.concatenate((lo, hi)))
        base = self.start[symbol]
        return base + both[:len(lo)], base + both[len(lo):]

    def first_document(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Lowest document rank in [lo, hi), not empty."""
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.least[k][lo[at]], self.least[k][hi[at] - (1 << int(k))])
        return out


def _index(x: Contexts) -> tuple[FMIndex, np.ndarray, np.ndarray, np.ndarray]:
    """The index, the symbols of the contexts, where each begins, and the rank of each one's document."""
    ids = np.unique(x.units, return_inverse=True)[1].astype(np.int64)
    n, size = len(x.n), np.diff(x.begin)
    symbols = ids + n  # the ends are 0 .. n - 1, all different
    rank = np.unique(x.doc, return_inverse=True)[1].astype(np.int64)
    text = np.insert(symbols, x.begin[1:], np.arange(n))
    return FMIndex(text, int(symbols.max()) + 1, np.repeat(rank, size + 1)), symbols, x.begin[:-1], rank


def earlier_windows(x: Contexts, unit: Unit) -> np.ndarray:
    """For every window whether its words also occur in a document with a smaller id.

    A search ends at the left end of its context or at the word that breaks the match. Windows that
    hold the break need no search of their own: a short probe from the break finds how little of
    its right side suffices to break again, and the next search ends before that.
    """
    index, symbols, begin, rank = _index(x)
    length, total = unit.length, len(index.least[0])
    removed = np.zeros(int(x.n.sum()), bool)
    offset = np.cumsum(x.n) - x.n
    size = x.n + length - 1
    c = np.flatnonzero(rank > 0)  # running searches: context, end, place, interval; a probe keeps the search it serves
    end = size[c].copy()
    place, lo, hi = end.copy(), np.zeros(len(c), np.int64), np.full(len(c), total)
    left, span, goal = np.full(len(c), -1), np.zeros(len(c), np.int64), end.copy()  # break, width of the probe, end of the search
    while len(c):
        sym = symbols[begin[c] + place - 1]
        a, b = index.extend(sym, lo, hi)
        ok = a < b
        ok[ok] = index.first_document(a[ok], b[ok]) < rank[c[ok]]
        lo, hi = np.where(ok, a, lo), np.where(ok, b, hi)
        place = place - ok
        probing = left >= 0
        done = ok & ~probing & (place == 0)
        for i in np.flatnonzero((~ok | done) & ~probing & (end - place >= length)):
            removed[offset[c[i]] + place[i]:offset[c[i]] + end[i] - length + 1] = True
        broke = ~ok & ~probing  # place - 1 breaks the match [place, end)
        left = np.where(broke, place - 1, left)
        goal = np.where(broke, end, goal)
        held = probing & ok & (place == left)  # the probe got through: a wider one, halfway to the known break at most
        width = goal - left
        wider = np.where(span * 3 < width, span * 3, (span + width + 1) // 2)
        gone = (held & (span + 1 >= width)) | (broke & (width <= 2))
        span = np.where(broke, 2, np.where(held, wider, span))
        failed = probing & ~ok  # [place - 1, end) occurs nowhere: the next search ends before its end
        nxt = np.where(failed, end - 1, goal - 1)
        fresh = failed | gone
        probe = (broke | held) & ~gone
        probe_end = np.minimum(left + span, goal)
        end = np.where(fresh, nxt, np.where(probe, probe_end, end))
        left = np.where(fresh, -1, left)
        goal = np.where(fresh, end, goal)
        again = fresh | probe
        place, lo, hi = np.where(again, end, place), np.where(again, 0, lo), np.where(again, total, hi)
        live = ~done & ((left >= 0) | (end >= length))
        c, end, place, lo, hi, left, span, goal = (v[live] for v in (c, end, place, lo, hi, left, span, goal))
    return removed


def dedup(docs: DataFrame, length: int = 50, gram: int = 8, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """Texts as words without those that a repeated window of ``length`` words covers.

    A word goes if a window covering it also occurs in a document with a smaller id. Returns the id (and, on
    demand, all other columns but the text), n_units (words), n_removed, spans (maximal removed runs of words) and kept
    (words joined by one space, as bytes). Defined cases: null has no words (kept is null); fewer than ``length``
    words are kept; of equal texts that with the smallest id stays; rows of one id and
    text fare alike; a null id neither loses nor causes anything; an empty table gives an empty result.
    """
    return cut_repeats(docs, Unit("word", length, min(gram, length)), earlier_windows, False, id_col, text_col, keep_columns)
