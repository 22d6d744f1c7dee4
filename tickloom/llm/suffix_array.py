"""Suffix-array dedup by a depth-limited radix sort.

Suffixes are ordered only through the threshold: most-significant-digit passes of DIGIT bytes deal the suffixes
of every group by their next digit, and groups of one leave. The groups after the last pass are
exactly the repeated windows; all but the first of each are removed. The sort runs per shard of the
suffixes that can repeat at all (see ``repeats``), dealt by Spark.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tickloom.llm.repeats import Contexts, Unit, cut_repeats
from tickloom.llm.textops import INVERSE, STEP, U, byte_hashes, mix, powers

DIGIT = 25


def radix_groups(x: Contexts, unit: Unit) -> np.ndarray:
    """For every window whether an equal one has a smaller (document, start)."""
    c, j = x.windows()
    at = x.begin[c] + j
    h, inv = byte_hashes(x.units), powers(INVERSE, len(x.units) + 1)
    group = mix(x.group[c].astype(np.uint64) * U(1 << 20) + (x.lead[c] - j).astype(np.uint64))  # anchor and its offset: the digit of the shuffle
    live = np.arange(len(c))
    for depth in range(0, unit.length, DIGIT):
        s, e = at[live] + depth, at[live] + min(depth + DIGIT, unit.length)
        group = mix(group * STEP + (h[e] - h[s]) * inv[s])
        order = np.argsort(group)
        ranked = group[order]
        twin = np.zeros(len(live), bool)
        equal = ranked[1:] == ranked[:-1]
        twin[1:] |= equal
        twin[:-1] |= equal
        keep = order[twin]
        live, group = live[keep], group[keep]  # stays in the order of the groups
    removed = np.zeros(len(c), bool)
    if len(live):
        doc, start = x.doc[c[live]], x.first[c[live]] + j[live]
        order = np.lexsort((start, doc, group))
        live, group, doc, start = live[order], group[order], doc[order], start[order]
        head = np.concatenate(([True], group[1:] != group[:-1]))
        at_head = np.flatnonzero(head)[np.cumsum(head) - 1]
        removed[live] = (doc != doc[at_head]) | (start != start[at_head])
    return removed


def dedup(docs: DataFrame, length: int = 100, gram: int = 32, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False,
          whole_characters: bool = False) -> DataFrame:
    """Texts as UTF-8 bytes without the bytes that a repeated ``length``-byte string covers.

    A byte goes if a string covering it also starts earlier (smaller id, or same text and earlier start). Returns
    the id (and, on demand, all other columns but the text), n_units (bytes), n_removed, spans (maximal removed
    runs) and kept. ``whole_characters`` spares characters of which only a part is repeated. Defined cases: null is empty (kept is null); a text shorter than ``length`` is kept whole; of equal
    texts that with the smallest id stays; rows of one id and text are one document and fare
    alike; a null id neither loses nor causes anything; an empty table gives an empty result.
    """
    return cut_repeats(docs, Unit("byte", length, min(gram, length)), radix_groups, True, id_col, text_col, keep_columns, whole_characters)
