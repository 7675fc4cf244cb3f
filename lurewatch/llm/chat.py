"""Preference formatting, in DataFrame operations only.

A pair is two conversations, chosen and rejected. Their longest common prefix of turns (same role and text) is rendered
once as the prompt; what follows in each is rendered as its completion, with a mask of runs "0x21 1x340 0x1": so many
characters without and with loss. Loss falls on the text and end mark of assistant turns, never on headers or other
roles.

Turns are ordered by turn, then role, then text; null turns come first, a null role is "user", a null text is empty.
Repeated rows are turns of their own. Equal conversations give a prompt and two empty completions; a missing side is
an empty conversation. Rows without a pair id belong to no conversation and give nothing. One conversation is one record:
its turns meet in one row, as the rendered text must.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.llm.common import table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _same(a: Column, b: Column) -> Column:
    return a.isNotNull() & b.isNotNull() & (a.role == b.role) & (a.text == b.text)


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t.role, F.lit("\n"), t.text, F.lit(CLOSE + "\n"))), "")


def _mask(turns: Column) -> Column:
    def runs(t):
        head, body = F.length(t.role) + len(OPEN) + 1, F.length(t.text) + len(CLOSE)
        return F.when(t.role == "assistant", F.concat(F.lit("0x"), head.cast("string"), F.lit(" 1x"), body.cast("string"), F.lit(" 0x1"))).otherwise(
            F.concat(F.lit("0x"), (head + body + 1).cast("string")))
    return F.array_join(F.transform(turns, runs), " ")


def preference_pairs(turns: DataFrame) -> DataFrame:
    """(pair_id, n_prefix, prompt, chosen, chosen_mask, rejected, rejected_mask) from (pair_id, side, turn, role, text),
    where side is "chosen" or "rejected"."""
    turn = F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.where("pair_id IS NOT NULL").select("pair_id", "side", turn.alias("t"))
    df = rows.groupBy("pair_id").agg(*[F.sort_array(F.collect_list(F.when(F.col("side") == s, F.col("t")))).alias(s) for s in ("chosen", "rejected")])
    same = F.transform(F.arrays_zip("chosen", "rejected"), lambda z: _same(z.chosen, z.rejected))
    off = F.array_position(same, False)
    df = df.withColumn("n_prefix", F.when(off > 0, off - 1).otherwise(F.size("chosen")).cast("int"))
    rest = {s: F.slice(s, F.col("n_prefix") + 1, F.greatest(F.size(s) - F.col("n_prefix"), F.lit(0))) for s in ("chosen", "rejected")}
    df = df.select("pair_id", "n_prefix", _rendered(F.slice("chosen", F.lit(1), F.col("n_prefix"))).alias("prompt"), rest["chosen"].alias("c"), rest["rejected"].alias("r"))
    return df.select("pair_id", F.col("n_prefix").cast("long").alias("n_prefix"), "prompt", _rendered(F.col("c")).alias("chosen"), _mask(F.col("c")).alias("chosen_mask"),
                     _rendered(F.col("r")).alias("rejected"), _mask(F.col("r")).alias("rejected_mask"))


def neighbour_answers(conversations: DataFrame) -> DataFrame:
    """Preference turns from plain conversations: a conversation as it is, against the same with its last assistant turn
    answered by its neighbour's last answer (conv_id with the lowest bit flipped; without one that turn is left out)."""
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("pair_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    last = turns.where("role = 'assistant'").groupBy("pair_id").agg(F.max(F.struct(F.coalesce("turn", F.lit(-1 << 62)).alias("at"), F.coalesce("text", F.lit("")).alias("answer"))).alias("l"))
    own = last.select("pair_id", F.col("l.at").alias("at"))
    other = last.select(F.col("pair_id").bitwiseXOR(F.lit(1).cast("long")).alias("pair_id"), F.col("l.answer").alias("answer"))
    answers = own.join(other, "pair_id", "left")
    df = turns.join(answers, "pair_id", "left")
    swapped = (F.col("role") == "assistant") & (F.coalesce("turn", F.lit(-1 << 62)) == F.col("at"))
    sides = F.array(F.struct(F.lit("chosen").alias("side"), F.col("text").alias("text"), F.lit(True).alias("keep")),
                    F.struct(F.lit("rejected").alias("side"), F.when(swapped, F.col("answer")).otherwise(F.col("text")).alias("text"),
                             F.coalesce(~swapped | F.col("answer").isNotNull(), F.lit(True)).alias("keep")))
    df = df.select("pair_id", "turn", "role", F.explode(sides).alias("s"))
    return df.where("s.keep").select("pair_id", "s.side", "turn", "role", "s.text")


def op8(spark, d: str) -> DataFrame:
    return preference_pairs(neighbour_answers(table(d, "conversations", spark)))


OP8_SQL = """
WITH turns AS (SELECT conv_id AS pair_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
last AS (SELECT pair_id, max({'at': coalesce(turn, -4611686018427387904), 'answer': coalesce(text, '')}) AS l FROM turns WHERE role = 'assistant' GROUP BY pair_id),
answers AS (SELECT a.pair_id, a.l.at AS at, b.l.answer AS answer FROM last a LEFT JOIN last b ON b.pair_id = xor(a.pair_id, 1)),
marked AS (
  SELECT t.*, a.answer, coalesce(t.role = 'assistant' AND coalesce(t.turn, -4611686018427387904) = a.at, false) AS swapped
  FROM turns t LEFT JOIN answers a USING (pair_id)),
sides AS (
  SELECT pair_id, 'c' AS side, turn, role, text FROM marked
  UNION ALL
  SELECT pair_id, 'r', turn, role, CASE WHEN swapped THEN answer ELSE text END FROM marked WHERE NOT swapped OR answer IS NOT NULL),
placed AS (
  SELECT pair_id, side, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) AS pos
  FROM sides),
differ AS (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.pos, r.pos) AS pos,
         coalesce(c.role = r.role AND c.text = r.text, false) AS same
  FROM (SELECT * FROM placed WHERE side = 'c') c FULL JOIN (SELECT * FROM placed WHERE side = 'r') r ON c.pair_id = r.pair_id AND c.pos = r.pos),
prefix AS (
  SELECT pair_id, coalesce(min(pos) FILTER (NOT same) - 1, max(pos)) AS n_prefix FROM differ GROUP BY pair_id),
drawn AS (
  SELECT p.*, n_prefix, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS shown,
         CASE WHEN role = 'assistant' THEN '0x' || (length(role) + 13) || ' 1x' || (length(text) + 10) || ' 0x1'
              ELSE '0x' || (length(role) + length(text) + 24) END AS mask
  FROM placed p JOIN prefix USING (pair_id))
SELECT pair_id, n_prefix,
       coalesce(string_agg(shown, '' ORDER BY pos) FILTER (side = 'c' AND pos <= n_prefix), '') AS prompt,
       coalesce(string_agg(shown, '' ORDER BY pos) FILTER (side = 'c' AND pos > n_prefix), '') AS chosen,
       coalesce(string_agg(mask, ' ' ORDER BY pos) FILTER (side = 'c' AND pos > n_prefix), '') AS chosen_mask,
       coalesce(string_agg(shown, '' ORDER BY pos) FILTER (side = 'r' AND pos > n_prefix), '') AS rejected,
       coalesce(string_agg(mask, ' ' ORDER BY pos) FILTER (side = 'r' AND pos > n_prefix), '') AS rejected_mask
FROM drawn GROUP BY pair_id, n_prefix
"""
