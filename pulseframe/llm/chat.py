"""Preference formatting of conversations.

A pair holds the turns of a chosen and a rejected conversation.  Their longest
common prefix of turns (same role and text) is rendered once as the prompt; what
follows in each becomes its completion, with the spans that training may learn
from: the texts and end marks of assistant turns, as code-point offsets in the
completion.

Turns are ordered by turn, role and text, so repeated turns have a place.  Edge
cases: a null text is empty, a null role is "unknown"; a pair without one side
has an empty prompt and an empty completion there; if one conversation is a
prefix of the other its completion is empty; a null pair id is a pair like others;
empty tables give empty results; only the five columns named are read, so others
cannot clash.  Work is in proportion to the turns, however many a conversation has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import running_sums

END = "<|end|>\n"


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit(END))), "")


def _learned(turns: Column) -> Column:
    """start:end of what the assistant says, comma-joined."""
    size = lambda t: F.length(t["role"]) + F.length(t["text"]) + 5 + len(END)
    ends = running_sums(F.transform(turns, size))
    said = F.filter(F.transform(F.arrays_zip(turns.alias("t"), ends.alias("end")), lambda x: F.struct(x["t"]["role"].alias("role"), (x["end"] - size(x["t"]) + F.length(x["t"]["role"]) + 5).alias("start"), x["end"].alias("end"))), lambda x: x["role"] == "assistant")
    return F.array_join(F.transform(said, lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")


def format_preferences(turns: DataFrame) -> DataFrame:
    """pair_id, side ('chosen' or 'rejected'), turn, role, text -> one row a pair.

    A conversation has to fit into a row, as its rendered text does.
    """
    t = turns.select("pair_id", "side", F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    sides = t.groupBy("pair_id").agg(*[F.sort_array(F.collect_list(F.when(F.col("side") == s, F.col("t")))).alias(s) for s in ("chosen", "rejected")])
    same = F.zip_with("chosen", "rejected", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    p = sides.withColumn("__differs", F.array_position(same, False)).withColumn("__n", F.when(F.col("__differs") > 0, F.col("__differs") - 1).otherwise(F.array_size("chosen")).cast("int"))
    rest = {s: F.slice(s, F.col("__n") + 1, F.greatest(F.array_size(s), F.lit(1))) for s in ("chosen", "rejected")}
    return p.select(
        "pair_id", F.col("__n").cast("long").alias("n_prefix"), *[F.array_size(s).cast("long").alias(f"n_{s}") for s in rest],
        _render(F.slice("chosen", F.lit(1), F.col("__n"))).alias("prompt"),
        *[_render(c).alias(s) for s, c in rest.items()], *[_learned(c).alias(f"{s}_learned") for s, c in rest.items()],
    )


def paired_by_parity(conversations: DataFrame) -> DataFrame:
    """Where a table names no pairs: conversations 2k (chosen) and 2k + 1 (rejected); a null id has no pair."""
    c = conversations.where(F.col("conv_id").isNotNull())
    return c.select(F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"), F.when(F.col("conv_id") % 2 == 0, "chosen").otherwise("rejected").alias("side"), "turn", "role", "text")


ORACLE = """
WITH t AS (
  SELECT CAST(floor(conv_id / 2) AS BIGINT) AS pair_id, conv_id % 2 = 0 AS is_chosen, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY pair_id, is_chosen ORDER BY turn NULLS FIRST, role, text) AS i FROM t),
p AS (SELECT pair_id, count(*) FILTER (is_chosen) AS n_chosen, count(*) FILTER (NOT is_chosen) AS n_rejected FROM t GROUP BY pair_id),
m AS (SELECT c.pair_id, c.i FROM (SELECT * FROM k WHERE is_chosen) c JOIN (SELECT * FROM k WHERE NOT is_chosen) r
      ON c.pair_id = r.pair_id AND c.i = r.i WHERE c.role <> r.role OR c.text <> r.text),
d AS (SELECT pair_id, min(i) - 1 AS same FROM m GROUP BY pair_id),
n AS (SELECT p.*, CAST(coalesce(d.same, least(n_chosen, n_rejected)) AS BIGINT) AS n_prefix FROM p LEFT JOIN d USING (pair_id)),
x AS (SELECT k.*, n.n_prefix, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS s FROM k JOIN n USING (pair_id)),
y AS (SELECT *, coalesce(sum(length(s)) FILTER (i > n_prefix) OVER (PARTITION BY pair_id, is_chosen ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM x),
z AS (SELECT *, CAST(pos + length(role) + 5 AS VARCHAR) || ':' || CAST(pos + length(s) AS VARCHAR) AS span FROM y)
SELECT n.pair_id, any_value(n.n_prefix) AS n_prefix, any_value(n.n_chosen) AS n_chosen, any_value(n.n_rejected) AS n_rejected,
  coalesce(string_agg(s, '' ORDER BY i) FILTER (is_chosen AND i <= z.n_prefix), '') AS prompt,
  coalesce(string_agg(s, '' ORDER BY i) FILTER (is_chosen AND i > z.n_prefix), '') AS chosen,
  coalesce(string_agg(s, '' ORDER BY i) FILTER (NOT is_chosen AND i > z.n_prefix), '') AS rejected,
  coalesce(string_agg(span, ',' ORDER BY i) FILTER (is_chosen AND i > z.n_prefix AND role = 'assistant'), '') AS chosen_learned,
  coalesce(string_agg(span, ',' ORDER BY i) FILTER (NOT is_chosen AND i > z.n_prefix AND role = 'assistant'), '') AS rejected_learned
FROM n JOIN z USING (pair_id) GROUP BY n.pair_id
"""
