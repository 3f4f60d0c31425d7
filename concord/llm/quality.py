"""Quality rules with host-level verdicts.

Each document is measured by itself (base rules and softer ones).  Failures are then counted per host, the host's rate
is shrunk towards the corpus by a beta prior fitted to the hosts' rates (method of moments), and the host's verdict is
joined back: in a condemned host a document that breaks any soft rule goes, a document without fault stays.

Edge cases: a null or empty text has no words, so it fails the base rules; a null host is a host of its own; with
fewer than two hosts, or rates that do not vary beyond chance, the prior falls back to one failure and one success;
repeated rows count each; an empty table gives an empty table; input columns named like the added ones are replaced.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import small, text_or_empty, written

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
SYMBOLS = "#*$%&|<>"
_WHITE = " \t\n\x0b\x0c\r"


def counts(text: str) -> tuple[int, ...]:
    """The values of ``COUNTS``.  Words are runs without white space of ASCII; characters are code points."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    lines = [line for line in raw.split(b"\n") if line.strip(b" \t\n\x0b\x0c\r")]
    return n, len(text) - sum(map(text.count, _WHITE)), sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a three-word window which the text holds twice or more, the first one included."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=n)
    pairs = ids[:-1] * len(known) + ids[1:]
    pair_ids = np.unique(pairs, return_inverse=True)[1]
    _, which, times = np.unique(pair_ids[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
    twice = times[which] > 1
    covered = np.zeros(n, dtype=bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= twice
    return int(covered.sum())


def _measure(texts: pa.Array) -> pa.Array:
    rows = np.array([counts(x.as_py()) for x in texts], dtype=np.int64).reshape(-1, len(COUNTS))
    return pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(COUNTS))], names=list(COUNTS))


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the counts, ``base_failed`` and ``soft_failed`` (base rules or any softer one)."""
    kind = f"struct<{','.join(f'{c}:bigint' for c in COUNTS)}>"
    out = df.withColumn("__counts", F.arrow_udf(_measure, kind)(text_or_empty(text)))
    out = out.withColumns({c: F.col(f"__counts.{c}") for c in COUNTS}).drop("__counts")
    return judge(out)


def judge(df: DataFrame) -> DataFrame:
    """Verdicts of a document by itself, in whole numbers."""
    n = F.col("n_words")
    base = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    long_or_short = (F.col("word_chars") < 3 * n) | (F.col("word_chars") > 12 * n)
    soft = base | long_or_short | (10 * F.col("n_symbols") > n) | (10 * F.col("n_dup_lines") > 3 * F.col("n_lines")) | (5 * F.col("n_repeat_words") > n)
    return df.withColumn("base_failed", base).withColumn("soft_failed", soft)


def host_rates(measured: DataFrame, host: str = "source", condemn: float = 0.5) -> DataFrame:
    """One row per host: n_docs, n_failed, host_rate (shrunk), host_condemned.  Counts are combined before the shuffle."""
    each = measured.groupBy(F.col(host).alias("__host")).agg(F.count("*").alias("n_docs"), F.sum(F.col("soft_failed").cast("bigint")).alias("n_failed"))
    each = written(each, "hosts")
    r = F.col("n_failed") / F.col("n_docs")
    prior = each.agg(F.count("*").alias("h"), F.avg(r).alias("m"), F.var_samp(r).alias("v"), F.avg(1 / F.col("n_docs")).alias("i"))
    # variance between hosts less that of sampling; its ratio to m(1-m) gives the prior's weight
    spread = F.col("v") - F.col("m") * (1 - F.col("m")) * F.col("i")
    usable = (F.col("h") > 1) & (F.col("m") > 0) & (F.col("m") < 1) & (spread > 1e-9)
    weight = F.least(F.greatest(F.try_divide(F.col("m") * (1 - F.col("m")), spread) - 1, F.lit(2.0)), F.lit(1e6))
    prior = prior.select(F.when(usable, F.col("m") * weight).otherwise(1.0).alias("alpha"), F.when(usable, (1 - F.col("m")) * weight).otherwise(1.0).alias("beta"))
    rate = F.round((F.col("n_failed") + F.col("alpha")) / (F.col("n_docs") + F.col("alpha") + F.col("beta")), 6)
    return each.join(F.broadcast(prior)).select("__host", "n_docs", "n_failed", rate.alias("host_rate"), (rate > condemn).alias("host_condemned"))  # one row of prior


def with_verdicts(measured: DataFrame, host: str = "source", condemn: float = 0.5) -> DataFrame:
    """``measured`` with host_rate, host_condemned and ``kept``."""
    rates = written(host_rates(measured, host, condemn).drop("n_docs", "n_failed"), "rates")
    measured = measured.drop("host_rate", "host_condemned", "kept")
    out = measured.join(small(rates), measured[host].eqNullSafe(rates["__host"]), "left").drop("__host")
    return out.withColumn("kept", ~F.col("base_failed") & ~(F.col("host_condemned") & F.col("soft_failed")))


def keep_good(df: DataFrame, text: str = "text", host: str = "source", condemn: float = 0.5) -> DataFrame:
    """The rows of ``df`` that pass, with its columns.  Texts are measured twice rather than written again."""
    return with_verdicts(measure(df, text), host, condemn).where("kept").select(*df.columns)


SQL = """
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0b\\x0c\\r]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0b\\x0c\\r]')) AS ls
  FROM documents),
g AS (
  SELECT doc_id, i, CASE WHEN i <= len(ws) - 2 THEN ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] END AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
d AS (SELECT doc_id, i, win IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, win) > 1 AS twice FROM g),
c AS (
  SELECT doc_id, twice OR coalesce(lag(twice, 1) OVER p, false) OR coalesce(lag(twice, 2) OVER p, false) AS hit
  FROM d WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, CAST(count(*) FILTER (WHERE hit) AS BIGINT) AS n_repeat_words FROM c GROUP BY doc_id),
m AS (
  SELECT w.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(regexp_replace(t, '[ \\t\\n\\x0b\\x0c\\r]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
s AS (
  SELECT *, base_failed OR word_chars < 3 * n_words OR word_chars > 12 * n_words OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines
    OR 5 * n_repeat_words > n_words AS soft_failed FROM b),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE soft_failed) AS k FROM s GROUP BY source),
q AS (SELECT count(*) AS hosts, avg(k / n) AS m, var_samp(k / n) AS v, avg(1 / n) AS i FROM h),
z AS (SELECT *, v - m * (1 - m) * i AS spread FROM q),
y AS (SELECT *, hosts > 1 AND m > 0 AND m < 1 AND spread > 1e-9 AS usable, least(greatest(m * (1 - m) / nullif(spread, 0) - 1, 2.0), 1e6) AS wt FROM z),
p AS (SELECT CASE WHEN usable THEN m * wt ELSE 1.0 END AS alpha, CASE WHEN usable THEN (1 - m) * wt ELSE 1.0 END AS beta FROM y),
v AS (SELECT source, round((k + alpha) / (n + alpha + beta), 6) AS host_rate FROM h CROSS JOIN p)
SELECT s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rate,
  NOT base_failed AND NOT (host_rate > 0.5 AND soft_failed) AS kept
FROM s JOIN v ON s.source IS NOT DISTINCT FROM v.source
"""
