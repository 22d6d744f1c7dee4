"""Packing of documents into token sequences of one size by concatenate and cut.

The first pass turns texts into token ids, once, and writes them with their place in their partition. The
totals of the partitions, one row each, give by a prefix sum where every partition starts in one long line of tokens.
The second pass cuts every document at the multiples of the sequence size. No row is moved between tasks.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm.textops import pieces
from tickloom.session import scratch_folder

WORDS_HELD = 800_000  #: encoded words that a Python worker remembers
PROBE = "a b,c  It's (x) 'tis 3d\n\tend."
LETTERS = [c for c in map(chr, [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250)]) if c.isalpha()]  #: of Latin script, none of which joins the one before it
MARKS = "!-&(-/:-@\\[-`{-~"  #: ASCII marks other than the apostrophe, as a class of a pattern
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of words by a tokenizer that drops white space, with the last words remembered.

    Such a tokenizer gives a text the ids of its words one after another, so a text of any length needs no more memory than its
    ids, and a frequent word is encoded once. Special tokens' strings in a text are ordinary text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        whole.encode_special_tokens = True
        self.model, self.normalizer, self.splitter = whole.model, whole.normalizer, whole.pre_tokenizer
        spelt = {c: self._parts(c) for c in LETTERS}
        spelt = {c: p[0] for c, p in spelt.items() if len(p) == 1 and self._parts(f"x{c}x") == [f"x{p[0]}x"]}
        self.spelling = str.maketrans(spelt)  # of letters by the splitter's own alphabet
        self.plain = re.compile(f"([{''.join(spelt)}]+)([{MARKS}]*)") if spelt else re.compile("(?!)()()")
        if any(self._parts(w) != [p for p in (m[1].translate(self.spelling), m[2]) if p] for w in ("Word", "word.,", "aB$$%", "x-") for m in [self.plain.fullmatch(w)] if m):
            self.plain = re.compile("(?!)()()")  # letters and marks do not part: no short cut
        self.known: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {"": b""}
        if b"".join(map(self.encode, PROBE.split())) != np.array(whole.encode(PROBE, add_special_tokens=False).ids, "<u4").tobytes():
            raise ValueError("the tokenizer looks across white space")

    def _parts(self, word: str) -> list[str]:
        word = self.normalizer.normalize_str(word) if self.normalizer else word
        return [p for p, _ in self.splitter.pre_tokenize_str(word)] if self.splitter else [word]

    def _piece(self, part: str) -> bytes:
        ids = self.pieces.get(part)
        if ids is None:
            ids = array("I", [t.id for t in self.model.tokenize(part)]).tobytes()
            if len(part) < 64:
                self.pieces[part] = ids
        return ids

    def encode(self, word: str) -> bytes:
        """The ids of a word, 32 bits each, little-endian. Letters with marks after them take a short cut past normalizer and splitter."""
        m = self.plain.fullmatch(word)
        if m:
            return self._piece(m[1].translate(self.spelling)) + self._piece(m[2])
        return b"".join(map(self._piece, self._parts(word)))

    def table(self, words: list[str]) -> list[bytes]:
        if len(self.known) + len(self.pieces) > WORDS_HELD:
            self.known, self.pieces = {"": b""}, {"": b""}
        known, out = self.known, []
        for w in words:
            ids = known.get(w)
            if ids is None:
                ids = self.encode(w)
                if len(w) < 64:
                    known[w] = ids
            out.append(ids)
        return out


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _ids(texts: pa.Array, encoder: Encoder, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, each closed by ``end``, and where each text starts among them (one more entry than texts)."""
    split = pc.ascii_split_whitespace(texts)
    at = np.asarray(split.offsets)
    code = split.flatten().dictionary_encode()
    blobs = encoder.table(code.dictionary.to_pylist())
    flat = np.frombuffer(b"".join(blobs), "<u4")
    size = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
    first = np.cumsum(size) - size
    word = np.asarray(code.indices)
    n = size[word] if len(word) else np.zeros(0, np.int64)
    upto = np.concatenate(([0], np.cumsum(n)))
    ids = flat[np.repeat(first[word] - upto[:-1], n) + np.arange(upto[-1])] if len(word) else flat[:0]
    stop = upto[at - at[0]][1:]
    return np.insert(ids, stop, end), np.concatenate(([0], stop + np.arange(1, len(texts) + 1)))


def _tokens(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    encoder, part, before = _encoder(path), TaskContext.get().partitionId(), 0
    for batch in batches:
        texts = pc.fill_null(batch.column("text"), "")
        for i, j, _, _ in pieces(texts):
            ids, at = _ids(texts.slice(i, j - i), encoder, end)
            n = j - i
            body = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((at * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, n), pa.array(np.full(n, part, np.int64)), pa.array(before + at[:-1]), pa.array(np.diff(at)), body],
                                             names=["doc_id", "part", "first", "n", "ids"])
            before += int(at[-1])


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: the id, start (ids of the document before it), length, ids (binary, 32 bits little-endian each), doc_tokens, sequence_id and offset.

    ``tokenizer`` is a file of the ``tokenizers`` library that every executor has; its tokenizer must drop white space.
    A document is its ids and then ``end``. Documents are laid one after another by partition and place in it and cut at the
    multiples of ``size``, so only the last sequence can be shorter. Defined cases: a null or empty text is the one id
    ``end``; repeated rows and rows with a null id are documents of their own; an empty table has no piece; other columns
    are not read. The order follows the partitions of ``docs``, so reruns on the same files agree.
    The ids are written to the shared folder; what is broadcast is one number for each partition of ``docs``.
    """
    spark, path = docs.sparkSession, scratch_folder(docs.sparkSession, "tokens")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    texts.mapInArrow(lambda b: _tokens(b, tokenizer, end), f"doc_id {kind}, part long, first long, n long, ids binary").write.parquet(path)
    rows = spark.read.parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n").alias("n"))
    starts = totals.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))
    placed = rows.join(F.broadcast(starts), "part").withColumn("at", F.col("base") + F.col("first"))
    at, n = F.col("at"), F.col("n")
    whole = lambda x: F.floor(x / F.lit(size)).cast("long") if size & (size - 1) else F.shiftright(x, size.bit_length() - 1)

    def piece(k):
        start = F.greatest(k * size - at, F.lit(0).cast("long"))
        length = F.least((k + 1) * size - at, n) - start
        ids = F.substring("ids", (start * 4 + 1).cast("int"), (length * 4).cast("int"))
        return F.struct(start.alias("start"), length.alias("length"), ids.alias("ids"), k.alias("sequence_id"), (at + start - k * size).alias("offset"))

    cut = F.transform(F.sequence(whole(at), whole(at + n - 1)), piece)
    return placed.select("doc_id", n.alias("doc_tokens"), F.inline(cut)).select(
        F.col("doc_id").alias(id_col), "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


def sequences(packed: DataFrame, size: int = 2048, pad: int = 0) -> DataFrame:
    """(sequence_id, length, ids): the pieces joined by offset, filled with ``pad`` up to ``size`` except where the length is a power of two."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    power = F.col("length").bitwiseAND(F.col("length") - 1) == 0
    filled = F.rpad(joined, F.lit(4 * size), F.lit(int(pad).to_bytes(4, "little")))
    return rows.select("sequence_id", "length", F.when(power, joined).otherwise(filled).alias("ids"))
