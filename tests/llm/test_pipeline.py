"""The pipeline against plain versions of its stages over the smallest tables, and its edges.

Quality is held against the operator's SQL, near copies against all pairs, decontamination from both sides (what holds half
of an item word for word goes, what shares no template with any stays), masking against the patterns alone, packing against
the texts that reached it.  Recall of near copies is measured on the next size of the tables."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from concord.llm import common, neardup, quality

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
WHITE = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\W\d_]+|[0-9]+(?:[.,][0-9]+)*|\d")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BASE = [re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]{6,})"), re.compile(r"(AKIA[A-Z0-9]{16,})"), re.compile(r"([0-9a-f]{24,})")]


def run_stages(spark, docs, sf=SF):
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(common.written(stage(spark, out[-1], sf), name))
    return out


def shingles(text):
    words = WHITE.findall(text.translate(UPPER))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def one_of_each(docs):
    """Ids that stay of {id: text}: the smallest of each component of pairs of similarity 0.8; and the number of pairs."""
    sets, root, pairs = {i: shingles(t) for i, t in docs.items()}, {i: i for i in docs}, 0

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)  # texts of similarity 0.8 share a shingle, or are both without one
    for i, s in sets.items():
        for x in s or {None}:
            by[x].append(i)
    met = {(a, b) for ids in by.values() for n, b in enumerate(ids) for a in ids[:n]}
    for a, b in met:
        x, y = sets[a], sets[b]
        if len(x & y) >= 0.8 * len(x | y):
            pairs += 1
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i for i in docs if root[i] == i}, pairs


def forms(text):
    """A text's words as they stand, and with numbers and capitalised words replaced by marks."""
    words = WORD.findall(text)
    return [w.lower() for w in words], ["#" if w[0].isdigit() else "@" if w[:1].isupper() and w[1:] == w[1:].lower() and len(w) > 1 else w.lower() for w in words]


def windows(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_against_plain_stages(spark):
    docs, good, single, clean, masked, packed = run_stages(spark, spark.read.parquet(f"{SF}/documents.parquet"))
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert set(texts(good)) == {r[0] for r in con.execute(f"SELECT doc_id FROM ({quality.SQL}) WHERE kept").fetchall()}
    assert set(texts(single)) == one_of_each(texts(good))[0]

    items = [forms(r["text"] or "") for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left, gone = texts(clean), set(texts(single)) - set(texts(clean))
    for i, text in texts(single).items():
        plain, marked = (windows(w) for w in forms(text))
        shares = [len(windows(a) & plain) / len(windows(a)) for a, _ in items if windows(a)]
        if max(shares) >= 0.5:
            assert i in gone
        elif not any(windows(a) & plain or windows(b) & marked for a, b in items):
            assert i in left

    after = texts(masked)
    assert set(after) == set(left)
    for i, text in left.items():
        found = [m for p in BASE for m in p.finditer(text)]
        assert not any(p.search(after[i]) for p in BASE) and (not found or after[i] != text)
        if not found and "=" not in text and ":" not in text:
            assert after[i] == text

    sizes = {i: len(WHITE.findall(t)) for i, t in after.items()}
    rows = packed.collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["begin"], r["n_words"]))
        bins[r["group"], r["bin"]].append(r)
    assert pieces.keys() == sizes.keys()
    for i, found in pieces.items():
        at = 0
        for begin, n in sorted(found):
            assert begin == at
            at += n
        assert at == sizes[i]
    for held in bins.values():
        assert sum(r["n_words"] for r in held) <= 2048 and max(Counter(r["source"] for r in held).values()) <= 2
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == {tuple(r) for r in rows}


def test_recall_of_near_copies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want, pairs = one_of_each({r["doc_id"]: r["text"] or "" for r in docs.collect()})
    got = {r["doc_id"] for r in neardup.one_of_each(docs).collect()}
    print(f"{pairs} pairs at 0.8 or more; {len(want)} groups, {len(got ^ want)} documents differ")
    assert got == want and pairs > 50


def test_edges(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    word = lambda n, s: " ".join(f"{s}{i}" for i in range(n))
    good = word(80, "alpha")
    rows = [(1, good, "en", "a", 1), (1, good, "en", "a", 1), (None, good, None, None, None), (2, None, "en", None, None), (3, "", "en", "a", 0), (4, word(60_000, "long"), "en", "a", 9), (None, word(90, "beta"), None, None, None)]
    rows += [(5, f"{word(70, 'gamma')} password = hunter2hunter2", "en", "a", 3)]
    docs = spark.createDataFrame(rows, kind)
    clash = docs.withColumns({c: F.lit("clash") for c in ("__h", "__id", "row", "sig", "t", "h", "root", "kept", "first", "size", "group", "findings", "n_words", "__many")})
    for df in (docs, clash):
        out = run_stages(spark, df)
        assert all(x.columns == df.columns for x in out[:-1])
        assert sorted(((r["doc_id"], len(r["text"])) for r in out[4].collect()), key=str) == sorted([(1, len(good)), (4, len(rows[5][1])), (5, len(word(70, "gamma")) + len(" [assign]")), (None, len(word(90, "beta")))], key=str)
        assert {r["doc_id"] for r in out[-1].collect()} == {1, 4, 5, None}
    empty = run_stages(spark, docs.limit(0))
    assert all(x.count() == 0 for x in empty) and all(x.columns == docs.columns for x in empty[:-1])


def test_texts_of_one_hash_all_stay(spark, monkeypatch):
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(7).cast("bigint"))
    df = spark.createDataFrame([(1, "one text of five words"), (2, "quite another text than that"), (3, "one text of five words")], "doc_id long, text string")
    assert {r["doc_id"] for r in neardup.one_of_each(df).collect()} == {1, 2, 3}
