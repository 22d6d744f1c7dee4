"""Chat formatting of preference pairs (native).

A pair is two conversations, one chosen and one rejected. Their longest common prefix of turns
(same role, same text, in turn order) is rendered once as the prompt; the rest of either side is
a completion with the character spans a loss may see: the assistant's turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEMPLATE = ("<|", "|>\n", "<|end|>\n")


def _render(turn: Column) -> Column:
    a, b, end = map(F.lit, TEMPLATE)
    return F.concat(a, F.coalesce(turn["role"], F.lit("")), b, F.coalesce(turn["text"], F.lit("")), end)


def _completion(turns: Column, trained: str) -> tuple[Column, Column]:
    """Rendered text of the turns, and the spans [start, end) of it that are trained on, as an array of structs."""
    text = F.array_join(F.transform(turns, _render), "")
    a, b, end = TEMPLATE
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc, t):
        body = acc["at"] + len(a) + F.length(F.coalesce(t["role"], F.lit(""))) + len(b)
        stop = body + F.length(F.coalesce(t["text"], F.lit(""))) + len(end) - 1
        grown = F.concat(acc["spans"], F.array(F.struct(body.cast("int").alias("start"), stop.cast("int").alias("end"))))
        return F.struct((stop + 1).cast("int").alias("at"), F.when(t["role"] == trained, grown).otherwise(acc["spans"]).alias("spans"))

    return text, F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_pairs(turns: DataFrame, trained: str = "assistant", pair_col: str = "pair_id") -> DataFrame:
    """One row a pair: prompt, chosen, rejected, their trained spans, and how many turns are shared.

    ``turns``: pair_id, side ('chosen' or 'rejected'), turn, role, text. Defined cases: repeated
    rows count once; turns of one number go by role, then text, null first; a null turn number
    comes first; a null role or text renders as empty; a side without turns has an empty
    completion; two equal sides give empty completions; a null pair id is a pair of its own;
    an empty table gives an empty result. A conversation is one output row, so its turns meet in one place.
    """
    one = F.struct(F.col("turn"), F.col("role"), F.col("text"))
    sides = turns.select(pair_col, "side", "turn", "role", "text").groupBy(pair_col).agg(
        *[F.array_sort(F.collect_set(F.when(F.col("side") == s, one))).alias(s) for s in ("chosen", "rejected")])
    same = F.zip_with("chosen", "rejected", lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]) & x.isNotNull() & y.isNotNull())
    first = F.array_position(same, F.lit(False))
    df = sides.withColumn("n_shared", F.when(first > 0, first - 1).otherwise(F.size("chosen")).cast("int"))
    cut = lambda s: F.slice(F.col(s), F.col("n_shared") + 1, F.size(s) + 1)
    chosen, rejected = _completion(cut("chosen"), trained), _completion(cut("rejected"), trained)
    return df.select(
        pair_col, "n_shared", F.array_join(F.transform(F.slice("chosen", 1, F.col("n_shared")), _render), "").alias("prompt"),
        chosen[0].alias("chosen"), rejected[0].alias("rejected"), chosen[1].alias("chosen_spans"), rejected[1].alias("rejected_spans"))


def pairs_from_answers(conversations: DataFrame) -> DataFrame:
    """Preference pairs out of single conversations: chosen is the conversation up to its last assistant
    turn, rejected the same with the assistant turn before it in place of that answer.

    Only conversations with two assistant turns or more make a pair. Returns what ``format_pairs`` takes.
    """
    said = F.col("role") == "assistant"
    rows = conversations.select("conv_id", "turn", "role", "text").where("conv_id is not null and turn is not null").distinct()
    answers = rows.where(said).groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"), F.count_distinct("turn").alias("n")).where("n > 1")
    j = rows.join(answers, "conv_id")
    before = j.where(said & (F.col("turn") < F.col("last.turn"))).groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("other"))
    shared = j.where(F.col("turn") < F.col("last.turn")).select("conv_id", "turn", "role", "text", F.explode(F.array(F.lit("chosen"), F.lit("rejected"))).alias("side"))
    good = answers.select("conv_id", F.col("last.turn").alias("turn"), F.lit("assistant").alias("role"), F.col("last.text").alias("text"), F.lit("chosen").alias("side"))
    bad = answers.join(before, "conv_id").select("conv_id", F.col("last.turn").alias("turn"), F.lit("assistant").alias("role"), F.col("other.text").alias("text"), F.lit("rejected").alias("side"))
    return shared.unionByName(good).unionByName(bad).withColumnRenamed("conv_id", "pair_id")
