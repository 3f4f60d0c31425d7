"""Fill-in-middle: units against the pattern, the whole operator against a plain one, round trips, edges."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from concord.llm import fim, queries

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = st.lists(st.sampled_from(["a", "Bé", " ", "\n", "\t\t", "\x1c", "\x85", " ", "😀", "<P>", "<", "P>", "<S", "<M>", "."]), max_size=30).map("".join)


def slow(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
def test_cuts(text, a, b):
    units = UNIT.findall(text)
    n, marked, first, second = fim.cuts(text, a, b)
    low, high = sorted((a % (n + 1), b % (n + 1)))
    assert n == len(units) and marked == any(x in text for x in ("<P>", "<S>", "<M>"))
    assert first == len("".join(units[:low])) and second == len("".join(units[:high]))


def test_against_plain_form(spark):
    base = [None, "", " ", "a", " a", "a ", "é\tb\x1cc  😀\n", "<P> marked", "x <", "<<P x", "<S", "two words <M>", "word " * 40_000, "\n\n", "a<S b<M c< d"]
    rows = [(i, base[i % len(base)]) for i in range(900)] + [(None, "a b c"), (None, "a b c"), (-7, "one two  three")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit("clash"), "output": F.lit("clash"), "form": F.lit(1), "keep": F.lit(2)})
    out = fim.transformed(df).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    got = out.select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", "back", "keep").collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[2:7] == slow(r["doc_id"], r["text"]) and r["back"] == (r["text"] or "") and r["keep"] == 2
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fim.transformed(df.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = queries.op13_fill_in_middle(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        n, form, p, m, output = slow(r["doc_id"], texts[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"], r["restored_sha256"]) == (n, form, p, m, sha(output), sha(texts[r["doc_id"]] or ""))
