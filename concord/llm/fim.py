"""Fill-in-middle transformation by a sparse scan of events.

A text is a row of units: white space (space, tab to carriage return) and the run of other characters after it, or the
white space at its end.  One Aho-Corasick automaton holds the characters that change the class of what follows, the six
of white space, and the three sentinels; its single pass over a text gives the places of these events and nothing else.
The gaps between neighbouring white-space events tell the units by arithmetic: a gap of one or more characters is a run
of others, so a unit ends where the next event is.  The ends in order are all that is needed to look up the character
at which unit number k ends; the text is never split into units.  Any sentinel among the events leaves the text plain.

Only two places per text come back from the scan; prefix, middle and suffix are cut and laid out by Spark.  Draws
depend on the seed and the doc_id alone, so the output does not hang on partitions or retries.

Edge cases: a null text is taken as empty, an empty text has no unit and stays plain; a null doc_id draws as the seed
with nothing after it; rows that repeat give repeated outputs; whole texts of any length are read (one text, its events
and its output are held in a task); white space other than the six characters belongs to a unit's run; an empty table
gives an empty table; columns of the input named like the added ones are replaced, all others are kept.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.common import text_or_empty

# The marks of the three parts and the characters that part units.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
WHITE = " \t\n\x0b\x0c\r"
CUTS = "struct<n:bigint,marked:boolean,first:bigint,second:bigint>"


@cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for c in WHITE:
        found.add_word(c, 1)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        found.add_word(mark, -1)
    found.make_automaton()
    return found


def events(text: str) -> np.ndarray:
    """Places of the events in order, as one number each: the place of a white character, or -1 for a sentinel."""
    return np.fromiter((at if kind > 0 else -1 for at, kind in _automaton().iter(text)), np.int64)


def unit_ends(text: str) -> tuple[np.ndarray, bool]:
    """Code points at which the units of ``text`` end, and whether it holds a sentinel."""
    at = events(text)
    marked = bool((at < 0).any())
    if marked:
        at = at[at >= 0]
    size = len(text)
    around = np.concatenate(([-1], at, [size]))
    ends = around[1:][np.diff(around) > 1]
    if size and (not len(ends) or ends[-1] != size):  # white space at the end is a unit by itself
        ends = np.append(ends, size)
    return ends, marked


def cuts(text: str, a: int, b: int) -> tuple[int, bool, int, int]:
    """(units, whether a sentinel is there, end of the prefix, end of the middle) for the draws ``a`` and ``b``."""
    ends, marked = unit_ends(text)
    n = len(ends)
    first, second = sorted((a % (n + 1), b % (n + 1)))
    return n, marked, int(ends[first - 1]) if first else 0, int(ends[second - 1]) if second else 0


def _scan(texts: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
    names = ("n", "marked", "first", "second")
    rows = [cuts(t.as_py(), x, y) for t, x, y in zip(texts, a.to_pylist(), b.to_pylist(), strict=True)]
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64())
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], type=kind) for i, kind in enumerate(kinds)], names=list(names))


def draw(doc_id: Column, which: int, seed: int = 42) -> Column:
    """The draw number ``which`` (1 to 4) of a document: a group of eight hexadecimal digits of a SHA-256, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * which - 7, 8), 16, 10).cast("bigint")


def transformed(df: DataFrame, text: str = "text", doc_id: str = "doc_id", rate: int = 50, spm: int = 80, seed: int = 42) -> DataFrame:
    """``df`` with n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output.

    ``rate`` of 100 texts are rearranged, ``spm`` of 100 of these with the suffix first."""
    key, whole = F.col(doc_id), text_or_empty(text)
    out = df.withColumn("__cuts", F.arrow_udf(_scan, CUTS)(whole, draw(key, 1, seed), draw(key, 2, seed)))
    of = lambda name: F.col(f"__cuts.{name}")
    plain = (of("n") == 0) | of("marked") | (draw(key, 3, seed) % 100 >= rate)
    form = F.when(plain, "plain").when(draw(key, 4, seed) % 100 < spm, "spm").otherwise("psm")
    part = lambda a, length: F.substring(whole, (a + 1).cast("int"), length.cast("int"))
    prefix, middle = part(F.lit(0), of("first")), part(of("first"), of("second") - of("first"))
    suffix = F.substring(whole, (of("second") + 1).cast("int"), F.lit((1 << 31) - 1))
    laid = F.when(F.col("form") == "plain", whole)
    laid = laid.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    laid = laid.otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    added = {"n": of("n"), "prefix_chars": F.when(F.col("form") != "plain", of("first")), "middle_chars": F.when(F.col("form") != "plain", of("second") - of("first")), "output": laid}
    out = out.withColumn("form", form)
    return out.withColumns(added).drop("__cuts")


def restored(output: Column, form: Column) -> Column:
    """The text as it was, from the output and its form alone."""

    def between(start: Column, end: str) -> Column:
        return F.substring_index(start, end, 1)

    def after(mark: str) -> Column:
        return F.substring(output, F.instr(output, mark) + len(mark), F.lit((1 << 31) - 1))

    psm = F.concat(between(after(PREFIX), SUFFIX), after(MIDDLE), between(after(SUFFIX), MIDDLE))
    spm = F.concat(between(after(PREFIX), MIDDLE), after(MIDDLE), between(after(SUFFIX), PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
h AS (
  SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || d[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || d[9:16] AS BIGINT) % (len(u) + 1) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || d[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
      WHEN CAST('0x' || d[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (
  SELECT *, coalesce(array_to_string(u[1:least(a, b)], ''), '') AS p, coalesce(array_to_string(u[least(a, b) + 1:greatest(a, b)], ''), '') AS m,
    coalesce(array_to_string(u[greatest(a, b) + 1:n], ''), '') AS s FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN len(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN len(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
