"""Preference formatting of chat conversations: one prompt, two masked completions.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The template of a turn. Marks inside a text are broken by a space, so that no text can forge a turn.
_HEAD = "concat('<|', coalesce(t.role, ''), '|>\\n')"
_BODY = "concat(replace(coalesce(t.text, ''), '<|', '< |'), '<|end|>\\n')"


def _rendered(turns: str) -> Column:
    return F.expr(f"array_join(transform({turns}, t -> concat({_HEAD}, {_BODY})), '')")


def _mask(turns: str, role: str) -> Column:
    """Spans [start, end) of the characters that a model is to learn: the turns of `role`, without their heads."""
    span = f"named_struct('start', s.at + length({_HEAD}), 'end', s.at + length({_HEAD}) + length({_BODY}))"
    step = f"named_struct('at', s.at + length({_HEAD}) + length({_BODY}), 'spans', if(t.role <=> '{role}', concat(s.spans, array({span})), s.spans))"
    zero = "named_struct('at', 0, 'spans', cast(array() as array<struct<start:int,end:int>>))"
    return F.expr(f"aggregate({turns}, {zero}, (s, t) -> {step}, s -> s.spans)")


def preference_format(turns: DataFrame, pair: Column, chosen: Column, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = "assistant") -> DataFrame:
    """One row for each pair of conversations: pair_id, chosen_id, rejected_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask.

    turns has a row a turn; `pair` names the pair that its conversation belongs to and `chosen` says
    whether it is the one preferred. A conversation's turns are ordered by number, then role and text.
    The longest run of equal first turns (role and text) is the prompt, rendered once; what follows it
    in each conversation is a completion. Masks are spans of characters of the completions: the texts
    and end marks of turns by `learn`; other turns of a completion are context.

    One shuffle, by pair; a conversation is gathered because it becomes one string.
    Null roles and texts count as empty, but differ from an empty string when turns are compared. Rows
    with a null pair belong to no pair and are left out. Rows repeated in full count once. A pair of
    one conversation has a null id, an empty completion and no prompt on the other side. Equal
    conversations have two empty completions. Very long texts are rendered whole. Other columns are not read.
    """
    rows = turns.select(pair.alias("pair_id"), F.col(conv_col).alias("conv"), chosen.alias("good"), F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")).alias("t")).filter("pair_id is not null")
    side = lambda good: F.array_sort(F.array_distinct(F.collect_list(F.when(F.col("good") == good, F.col("t")))))
    both = rows.groupBy("pair_id").agg(F.min(F.when(F.col("good"), F.col("conv"))).alias("chosen_id"), F.min(F.when(~F.col("good"), F.col("conv"))).alias("rejected_id"), side(True).alias("a"), side(False).alias("b"))
    both = both.withColumn("m", F.least(F.size("a"), F.size("b")))
    unlike = "transform(slice(a, 1, m), (t, i) -> NOT (t.role <=> b[i].role AND t.text <=> b[i].text))"
    both = both.withColumn("n_common", F.expr(f"CASE WHEN array_position({unlike}, true) > 0 THEN cast(array_position({unlike}, true) as int) - 1 ELSE m END"))
    both = both.withColumn("head", F.expr("slice(a, 1, n_common)"))
    for x in ("a", "b"):
        both = both.withColumn(x, F.expr(f"slice({x}, n_common + 1, size({x}))"))
    return both.select("pair_id", "chosen_id", "rejected_id", "n_common", _rendered("head").alias("prompt"), _rendered("a").alias("chosen"), _rendered("b").alias("rejected"), _mask("a", learn).alias("chosen_mask"), _mask("b", learn).alias("rejected_mask"))


def op7_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k and 2k + 1 are a pair, the even one chosen; masks as text."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    odd = F.pmod(F.col("conv_id"), F.lit(2))
    found = preference_format(turns, F.expr("(conv_id - pmod(conv_id, 2)) div 2"), odd == 0)
    as_text = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return found.withColumns({c: as_text(c) for c in ("chosen_mask", "rejected_mask")})


OP7_SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, (conv_id - (conv_id % 2 + 2) % 2) // 2 AS pair_id, (conv_id % 2 + 2) % 2 = 0 AS good, role, text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i,
             '<|' || coalesce(role, '') || '|>' || chr(10) AS head,
             replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10) AS body FROM t),
pairs AS (SELECT pair_id, min(conv_id) FILTER (good) AS chosen_id, min(conv_id) FILTER (NOT good) AS rejected_id,
                 least(count(*) FILTER (good), count(*) FILTER (NOT good)) AS m FROM o GROUP BY pair_id),
diff AS (SELECT a.pair_id, min(a.i) AS first FROM o a JOIN o b ON a.pair_id = b.pair_id AND a.good AND NOT b.good AND a.i = b.i
         WHERE a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text GROUP BY a.pair_id),
n AS (SELECT p.*, CAST(coalesce(d.first - 1, p.m) AS INTEGER) AS n_common FROM pairs p LEFT JOIN diff d USING (pair_id)),
r AS (SELECT o.*, n.n_common, o.i <= n.n_common AS common,
             coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, o.i <= n.n_common ORDER BY o.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
      FROM o JOIN n USING (pair_id)),
s AS (SELECT pair_id,
        string_agg(head || body, '' ORDER BY i) FILTER (good AND common) AS prompt,
        string_agg(head || body, '' ORDER BY i) FILTER (good AND NOT common) AS chosen,
        string_agg(head || body, '' ORDER BY i) FILTER (NOT good AND NOT common) AS rejected,
        string_agg(CAST(pos + length(head) AS BIGINT) || '-' || CAST(pos + length(head) + length(body) AS BIGINT), ',' ORDER BY i) FILTER (good AND NOT common AND role = 'assistant') AS chosen_mask,
        string_agg(CAST(pos + length(head) AS BIGINT) || '-' || CAST(pos + length(head) + length(body) AS BIGINT), ',' ORDER BY i) FILTER (NOT good AND NOT common AND role = 'assistant') AS rejected_mask
      FROM r GROUP BY pair_id)
SELECT n.pair_id, n.chosen_id, n.rejected_id, n.n_common, coalesce(prompt, '') AS prompt, coalesce(chosen, '') AS chosen,
       coalesce(rejected, '') AS rejected, coalesce(chosen_mask, '') AS chosen_mask, coalesce(rejected_mask, '') AS rejected_mask
FROM n JOIN s USING (pair_id)
"""
