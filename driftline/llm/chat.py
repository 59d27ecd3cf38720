"""Preference pairs: the longest common turn prefix once as prompt, the rest as two masked completions.

DataFrame functions only. A conversation is an array of (role, text) turns in one row; it is rendered as one string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a turn is written. Only what an assistant says, with its end mark, is trained on.
END, TRAINED = "<|end|>\n", "assistant"


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(END))), "")


def _segments(turns: Column) -> Column:
    """'mask:length' for the head and the body of each turn, in characters, joined by commas."""
    one = lambda t: F.concat(
        F.lit("0:"), F.length(_head(t)).cast("string"), F.when(t["role"] == TRAINED, F.lit(",1:")).otherwise(F.lit(",0:")), (F.length(t["text"]) + len(END)).cast("string")
    )
    return F.array_join(F.transform(turns, one), ",")


def _trained(turns: Column) -> Column:
    return F.aggregate(F.filter(turns, lambda t: t["role"] == TRAINED), F.lit(0).cast("long"), lambda a, t: a + F.length(t["text"]) + len(END))


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the distinct turns of each conversation in order of (turn, role, text). A null role is
    'unknown', a null text empty; a null turn number comes first; rows of a null conv_id are one conversation."""
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_set(one)).alias("turns"))


def reply_pairs(turns: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected): the conversation up to its last reply, and the same context with the last reply of
    its partner (2k and 2k + 1 are partners). A side is null where there is no such reply."""
    convs = conversations(turns)
    last = F.size("turns") - F.array_position(F.reverse(F.transform("turns", lambda t: t["role"] == TRAINED)), True).cast("int") + 1
    convs = convs.withColumn("last", F.when(F.exists("turns", lambda t: t["role"] == TRAINED), last))
    bare = lambda col: F.transform(col, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    convs = convs.select("conv_id", bare(F.col("turns")).alias("turns"), "last")
    replies = convs.where(F.col("last").isNotNull()).select(F.col("conv_id").bitwiseXOR(F.lit(1).cast("long")).alias("conv_id"), F.get(F.col("turns"), F.col("last") - 1).alias("reply"))
    context = F.when(F.col("last").isNotNull(), F.slice("turns", 1, F.greatest(F.col("last") - 1, F.lit(0)))).otherwise(F.col("turns"))
    joined = convs.join(replies, "conv_id", "left").withColumn("context", context)
    return joined.select(
        F.col("conv_id").alias("pair_id"),
        F.when(F.col("last").isNotNull(), F.slice("turns", 1, F.col("last"))).otherwise(F.col("context")).alias("chosen"),
        F.when(F.col("reply").isNotNull(), F.concat("context", F.array("reply"))).otherwise(F.col("context")).alias("rejected"),
    )


def preference_format(pairs: DataFrame) -> DataFrame:
    """A row per row of pairs(pair_id, chosen, rejected), both arrays of (role, text); a null array counts as empty.

    prompt is the longest common turn prefix, prefix_turns its length. *_segments masks each completion: runs of
    'mask:characters' over its string. status: 'paired' where both completions are trained on, 'identical' where
    nothing is left of either, else 'one_sided'. Other columns are ignored; no rows give no rows.
    """
    empty = F.array().cast("array<struct<role:string,text:string>>")
    both = pairs.select("pair_id", F.coalesce("chosen", empty).alias("c"), F.coalesce("rejected", empty).alias("r"))
    differs = F.array_position(F.zip_with("c", "r", lambda a, b: a.eqNullSafe(b)), False)
    both = both.withColumn("n", F.when(differs > 0, differs - 1).otherwise(F.size("c")).cast("int"))
    both = both.select("pair_id", "n", "c", *(F.slice(x, F.col("n") + 1, F.size(x)).alias(y) for x, y in (("c", "chosen"), ("r", "rejected"))))
    trained = {x: _trained(F.col(x)) for x in ("chosen", "rejected")}
    return both.select(
        "pair_id",
        F.col("n").cast("long").alias("prefix_turns"),
        _rendered(F.slice("c", 1, F.col("n"))).alias("prompt"),
        *(y for x in ("chosen", "rejected") for y in (_rendered(F.col(x)).alias(x), _segments(F.col(x)).alias(f"{x}_segments"), trained[x].alias(f"{x}_trained"))),
        F.when((F.size("chosen") == 0) & (F.size("rejected") == 0), "identical").when((trained["chosen"] > 0) & (trained["rejected"] > 0), "paired").otherwise("one_sided").alias("status"),
    )


_RENDER = "array_to_string(list_transform({0}, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), '')"
_SEGMENTS = "array_to_string(list_transform({0}, lambda t: '0:' || (length(t.role) + 5) || CASE WHEN t.role = 'assistant' THEN ',1:' ELSE ',0:' END || (length(t.text) + 8)), ',')"
_TRAINED = "coalesce(list_sum(list_transform(list_filter({0}, lambda t: t.role = 'assistant'), lambda t: length(t.text) + 8)), 0)::BIGINT"

ORACLE_SQL = f"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), convs AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn, role, text) AS turns FROM t GROUP BY conv_id
), ended AS (
  SELECT *, list_max([CASE WHEN turns[i].role = 'assistant' THEN i END FOR i IN range(1, len(turns) + 1)]) AS last FROM convs
), sides AS (
  SELECT e.conv_id, CASE WHEN e.last IS NULL THEN e.turns ELSE e.turns[1:e.last - 1] END AS context,
    CASE WHEN e.last IS NULL THEN e.turns ELSE e.turns[1:e.last] END AS c, p.turns[p.last] AS reply
  FROM ended e LEFT JOIN ended p ON p.conv_id = xor(e.conv_id, 1) AND p.last IS NOT NULL
), pairs AS (
  SELECT conv_id AS pair_id, c, CASE WHEN reply IS NULL THEN context ELSE list_append(context, reply) END AS r FROM sides
), cut AS (
  SELECT *, coalesce(list_min([CASE WHEN c[i] IS DISTINCT FROM r[i] THEN i END FOR i IN range(1, greatest(len(c), len(r)) + 1)]) - 1, len(c)) AS n FROM pairs
), split AS (
  SELECT pair_id, n, c[1:n] AS p, c[n + 1:] AS chosen, r[n + 1:] AS rejected FROM cut
)
SELECT pair_id, n::BIGINT AS prefix_turns, {_RENDER.format("p")} AS prompt,
  {_RENDER.format("chosen")} AS chosen, {_SEGMENTS.format("chosen")} AS chosen_segments, {_TRAINED.format("chosen")} AS chosen_trained,
  {_RENDER.format("rejected")} AS rejected, {_SEGMENTS.format("rejected")} AS rejected_segments, {_TRAINED.format("rejected")} AS rejected_trained,
  CASE WHEN len(chosen) = 0 AND len(rejected) = 0 THEN 'identical'
    WHEN {_TRAINED.format("chosen")} > 0 AND {_TRAINED.format("rejected")} > 0 THEN 'paired' ELSE 'one_sided' END AS status
FROM split
"""
