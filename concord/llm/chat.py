"""Chat formatting by relational means: sorted turn structs, runs merged by array functions, one string per conversation.

Template.  A run of adjacent turns of one role is one block ``<|role|>\\ntext<|end|>\\n``; the texts of the run stand in
it divided by ``<|and|>``, so that the turns can be read back.  Inside roles and texts ``&``, ``<``, ``[``, ``|`` are written as
``&amp;``, ``&lt;``, ``&#91;``, ``&#124;``: no control string of this template, nor of the common bracketed ones, survives in a
text, and ``unescaped`` restores it exactly.  The loss mask covers the texts of assistant turns: in each block of role
``assistant`` what stands between the opening line and ``<|end|>``, without ``<|and|>``.

Order: by turn, nulls first; equal turns by role, then text, so repeated rows stand side by side and all stay.

Edge cases: a null text is empty, a null role is the empty role; a null conv_id is a conversation of its own; an empty
table gives an empty table; other columns of the input are not used.  A conversation is one string, so its rows meet in
one task by definition; everything before that is combined per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Escapes in the order in which they are applied.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("|", "&#124;"))
END, AND = "<|end|>\n", "<|and|>"


def escaped(c: Column) -> Column:
    for plain, safe in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def unescaped(c: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        c = F.replace(c, F.lit(safe), F.lit(plain))
    return c


def formatted(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted (the whole conversation by the template)."""
    clean = lambda c: escaped(F.coalesce(F.col(c), F.lit("")))
    one = df.select(F.col(conv_id).alias("conv_id"), F.struct(F.col(turn).alias("turn"), clean(role).alias("role"), clean(text).alias("text")).alias("t"))
    got = one.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    # each turn beside the role before it and the role after it: a block opens where the role changes and ends likewise
    none, roles, n = F.array(F.lit(None).cast("string")), F.col("turns.role"), F.size("turns")
    beside = F.arrays_zip(F.col("turns").alias("t"), F.concat(none, F.slice(roles, F.lit(1), n - 1)).alias("prior"), F.concat(F.slice(roles, F.lit(2), n - 1), none).alias("next"))

    def piece(x: Column) -> Column:
        t = x["t"]
        opens, ends = ~x["prior"].eqNullSafe(t["role"]), ~x["next"].eqNullSafe(t["role"])
        return F.concat(F.when(opens, F.concat(F.lit("<|"), t["role"], F.lit("|>\n"))).otherwise(AND), t["text"], F.when(ends, F.lit(END)).otherwise(""))

    return got.select("conv_id", F.array_join(F.transform(beside, piece), "").alias("formatted"))


def turns(formatted: Column) -> Column:
    """Read back: array of (role, text), unescaped, one per turn."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda b: b != "")

    def of(block: Column) -> Column:
        role = F.substring_index(F.substring(block, 3, 1 << 30), "|>\n", 1)
        body = F.substring(block, F.length(role) + 6, F.lit(1 << 30))
        return F.transform(F.split(body, r"<\|and\|>"), lambda x: F.struct(unescaped(role).alias("role"), unescaped(x).alias("text")))

    return F.flatten(F.transform(blocks, of))


SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *, replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), '|', '&#124;') AS r,
    replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), '|', '&#124;') AS t FROM c),
o AS (
  SELECT *, lag(r) OVER w IS DISTINCT FROM r AS opens, lead(r) OVER w IS DISTINCT FROM r AS ends, row_number() OVER w AS i
  FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, t)),
p AS (
  SELECT *, (CASE WHEN opens THEN '<|' || r || '|>' || chr(10) ELSE '<|and|>' END) || t || (CASE WHEN ends THEN '<|end|>' || chr(10) ELSE '' END) AS piece FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(len(piece)) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""
