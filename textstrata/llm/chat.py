"""Operator 7, preference formatting of chats.

A pair has a chosen and a rejected conversation. Their longest common prefix of
turns (equal role and text) is rendered once as the prompt; each rest is
rendered as a completion with the character spans that count in the loss: the
assistant's texts with their end mark. Plain DataFrame functions; the only
shuffle gathers the turns of a pair, as its texts are one row of the result: a
pair must fit in a row, as a document must.

Pairing for the query: conversations 2k and 2k + 1 form pair k, the even one is
chosen. The key has two conversations at most, so a first turn that many
conversations share makes no group.

Defined results: a null role is ``unknown``, a null text is empty; turns sort by
turn (nulls first), role and text, and repeated rows are repeated turns; a
conversation without partner gives a pair whose missing side is empty and whose
``status`` says so; a row without conversation id is a conversation of its own,
the chosen side of a pair without key, so that however many there are they are
never gathered; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound, running

OPEN, MID, END = "<|", "|>\n", "<|end|>\n"


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(MID), turn["text"], F.lit(END))


def common_turns(a: Column, b: Column) -> Column:
    """Number of leading elements that two arrays share."""
    both = F.least(F.size(a), F.size(b))
    differs = F.zip_with(F.slice(a, 1, both), F.slice(b, 1, both), lambda x, y: ~x.eqNullSafe(y))
    at = F.array_position(differs, True)
    return F.when(at == 0, both).otherwise((at - 1).cast("int"))


def _completion(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _mask(turns: Column) -> Column:
    """Spans [start, end) of the completion that count in the loss. The work grows with the number of turns, not with its square."""
    head = lambda t: F.length(t["role"]) + len(OPEN) + len(MID)
    sizes = F.transform(turns, lambda t: head(t) + F.length(t["text"]) + len(END))

    def spans(starts: Column) -> Column:
        each = F.transform(turns, lambda t, i: F.when(t["role"] == "assistant", F.struct((F.get(starts, i) + head(t)).alias("start"), F.get(starts, i + 1).alias("end"))))
        return F.filter(each, lambda s: s.isNotNull())

    return bound(running(sizes, lambda a, b: a + b), spans)


def format_preferences(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """``pairs``: key, chosen and rejected (array<struct<role,text>>). One row per pair with prompt, completions and masks."""
    n = common_turns(F.col("chosen"), F.col("rejected"))
    rest = lambda c: F.slice(F.col(c), F.col("n_prompt_turns") + 1, F.size(c))
    cut = pairs.withColumn("n_prompt_turns", n)
    cut = cut.select(key, "n_prompt_turns", F.slice("chosen", F.lit(1), F.col("n_prompt_turns")).alias("_p"), rest("chosen").alias("_c"), rest("rejected").alias("_r"), F.size("chosen").alias("_nc"), F.size("rejected").alias("_nr"))
    status = F.when(F.col("_nr") == 0, "no rejected").when(F.col("_nc") == 0, "no chosen").when((F.size("_c") == 0) & (F.size("_r") == 0), "equal").otherwise("pair")
    return cut.select(
        key, "n_prompt_turns", status.alias("status"), _completion(F.col("_p")).alias("prompt"),
        _completion(F.col("_c")).alias("chosen"), _mask(F.col("_c")).alias("chosen_mask"),
        _completion(F.col("_r")).alias("rejected"), _mask(F.col("_r")).alias("rejected_mask"),
    )


def paired(turns: DataFrame) -> DataFrame:
    """Pairs of conversations 2k (chosen) and 2k + 1 (rejected) from rows (conv_id, turn, role, text)."""
    said = [F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")]
    rows = turns.filter("conv_id IS NOT NULL").select(
        F.shiftright(F.col("conv_id").cast("long"), 1).alias("pair_id"), F.struct(F.pmod(F.col("conv_id"), F.lit(2)).cast("int").alias("side"), F.col("turn").alias("turn"), *said).alias("t")
    )
    both = rows.groupBy("pair_id").agg(F.array_sort(F.collect_list("t")).alias("all"))
    side = lambda k: F.transform(F.filter("all", lambda t: t["side"] == k), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    lone = turns.filter("conv_id IS NULL").select(F.lit(None).cast("long").alias("pair_id"), F.array(F.struct(*said)).alias("chosen"), F.array().cast("array<struct<role:string,text:string>>").alias("rejected"))
    return both.select("pair_id", side(0).alias("chosen"), side(1).alias("rejected")).unionAll(lone)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = paired(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    out = format_preferences(pairs)
    flat = lambda m: F.array_join(F.transform(m, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return out.select("pair_id", "n_prompt_turns", "status", "prompt", "chosen", flat("chosen_mask").alias("chosen_mask"), "rejected", flat("rejected_mask").alias("rejected_mask"))


SQL = r"""
WITH t AS (SELECT (conv_id - (conv_id % 2 + 2) % 2) // 2 AS pair_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone, coalesce((conv_id % 2 + 2) % 2, 0) AS side, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY pair_id, lone, side ORDER BY turn NULLS FIRST, role, text) AS i FROM t),
eq AS (SELECT a.pair_id, a.lone, a.i, bool_and(a.role = b.role AND a.text = b.text) OVER (PARTITION BY a.pair_id, a.lone ORDER BY a.i) AS same
       FROM n a JOIN n b ON a.pair_id IS NOT DISTINCT FROM b.pair_id AND a.lone IS NOT DISTINCT FROM b.lone AND a.i = b.i AND a.side = 0 AND b.side = 1),
p AS (SELECT pair_id, count(*) FILTER (same) AS n FROM eq GROUP BY pair_id, lone),
r AS (SELECT n.*, coalesce(p.n, 0) AS k, '<|' || role || '|>' || chr(10) AS h, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS s FROM n LEFT JOIN p USING (pair_id)),
o AS (SELECT *, coalesce(sum(length(s)) FILTER (i > k) OVER (PARTITION BY pair_id, lone, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM r)
SELECT pair_id, max(k)::INT AS n_prompt_turns,
  CASE WHEN count(*) FILTER (side = 1) = 0 THEN 'no rejected' WHEN count(*) FILTER (side = 0) = 0 THEN 'no chosen' WHEN count(*) FILTER (i > k) = 0 THEN 'equal' ELSE 'pair' END AS status,
  coalesce(string_agg(s, '' ORDER BY i) FILTER (side = 0 AND i <= k), '') AS prompt,
  coalesce(string_agg(s, '' ORDER BY i) FILTER (side = 0 AND i > k), '') AS chosen,
  coalesce(string_agg((pos + length(h)) || ':' || (pos + length(s)), ',' ORDER BY i) FILTER (side = 0 AND i > k AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(s, '' ORDER BY i) FILTER (side = 1 AND i > k), '') AS rejected,
  coalesce(string_agg((pos + length(h)) || ':' || (pos + length(s)), ',' ORDER BY i) FILTER (side = 1 AND i > k AND role = 'assistant'), '') AS rejected_mask
FROM o GROUP BY pair_id, lone"""
