"""Secrets, quality, chat, sharding: brute force, round trips and edge cases on small tables."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from concord.llm import chat, quality, queries, secrets, sharding

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, source string, n_chars long, findings string, size string, shard string"


def odd(spark):
    """Nulls, empty and long texts, repeated rows, columns that clash."""
    rows = [(1, None, None, None, None, "x", "y", "z"), (2, "", "en", "a", 0, None, None, None), (None, "word " * 3, "en", "a", 5, "x", "y", "z"), (4, "long " * 50_000, None, "b", 1, "x", "y", "z"), (5, "same", "en", "a", 4, "x", "y", "z"), (5, "same", "en", "a", 4, "x", "y", "z")]
    return spark.createDataFrame(rows, ODD)


def brute_base(text):
    """Base spans by the letter of the contract: every match in turn, failing ones dropped."""
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(x[2] for x in sorted(out))


PIECES = st.sampled_from(["token", "= ", "api_key", "APIKEY", ":", '"', "abc", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", " ", "secret", "=", "é", "\n", "ſecret", "passwd'", "+"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=14).map("".join))
def test_base_spans(text):
    assert ",".join(f"{kind}:{a}:{b}" for kind, a, b, *_ in secrets.findings(text) if kind != "lexed") == brute_base(text)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('part = "x9f2Kq81zzTopQ7"\ndb_pwd = part', ["x9f2Kq81zzTopQ7"]),
        ('dbCredential: "hunter2-Xy9!"', ["hunter2-Xy9!"]),
        ("PRIVATE_KEY := a1 + 'B2c3D4e5F6g7H8'", ["a1", "B2c3D4e5F6g7H8"]),
        ('auth_pass = "changeme"', []),
        ('colour = "x9f2Kq81zzTopQ7"', []),
        ("note: the session went on for a while", []),
        ("pwd = ${unknown}", []),
        ('password = "hunter2!$ecretTail#99x"', ["hunter2!$ecretTail#99x"]),
        ('db_password: "Zx8 qPw!!LongTail$$Key77"', ["Zx8 qPw!!LongTail$$Key77"]),
        ('pass_help: "Please enter 8 characters, or more!"', []),
        ("env: DB_PWD=Xyz123!longsecret", ["Xyz123!longsecret"]),
        ('pwd="correct horse battery staple 7!"', ["correct horse battery staple 7!"]),
        ('pwd="Use at least 8 letters, please"', []),
        ('client_key = "correct horse battery staple 7!"', []),
        ('{"api_key": ["Zx81kQm47TtpR", "Qw81kVb93LlsX"], "colour": ["Zx81kQm47TtpR"]}', ["Zx81kQm47TtpR", "Qw81kVb93LlsX"]),
        ('{"secret": {"value": "Zx81kQm47TtpR"}, "value": "Qw81kVb93LlsX"}', ["Zx81kQm47TtpR"]),
        ('{"app": {"tokens": [{"id": 7, "text": "Zx81kQm47TtpR"}], "note": "Qw81kVb93LlsX"}}', ["Zx81kQm47TtpR"]),
        ('colours = ["Zx81kQm47TtpR"]\nsizes: {"one": "Qw81kVb93LlsX"}', []),
        ("db_pwd:\n  Zx81kQm47TtpR\nport: 12\n", ["Zx81kQm47TtpR"]),
        ("passwords:\n  - Zx81kQm47TtpR\n  - 'Qw81kVb93LlsX'\nusers:\n  - Aa81kVb93Llsy\n", ["Zx81kQm47TtpR", "Qw81kVb93LlsX"]),
        ("the token:\n  see chapter 12 of the book\n", []),
        ("secrets = ]] } [ ', : = ", []),
    ],
)
def test_lexed(text, want):
    assert [text[a:b] for kind, a, b, *_ in secrets.findings(text) if kind == "lexed"] == want


SIGNS = st.sampled_from(["secret", "pwd", "keys", "x", '"Zx81kQm47TtpR"', "'", '"', "[", "]", "{", "}", ":", "=", ",", "\n", "  - ", "\\", " ", "9aQ7", "é"])


@settings(max_examples=300, deadline=None)
@given(st.lists(SIGNS, max_size=25).map("".join))
def test_lexed_spans_of_any_syntax(text):
    found = secrets.findings(text)
    spans = [(a, b) for kind, a, b, *_ in found if kind == "lexed"]
    assert all(0 <= a < b <= len(text) for a, b in spans) and len(set(spans)) == len(spans)
    assert found == sorted(found, key=lambda x: (x[1], secrets.KINDS.index(x[0]), x[2]))


def test_doubling_chains_and_many_spans():
    doubled = "a = 'x9f2Kq81ZmPw'\n" + "a = a + a\n" * 200 + "db_password = a\n"
    assert [(kind, doubled[a:b]) for kind, a, b, *_ in secrets.findings(doubled)] == [("lexed", "x9f2Kq81ZmPw")]
    many = "".join(f"token = 'abc{i:06d}XyZ'\nmy_pass = 'Qq7{i:06d}zX'\n" for i in range(5000))
    assert len(secrets.findings(many)) == 10000


def test_time_grows_with_the_text():
    chain = "my_pass0 = 'Qq7zX!'\n" + "".join(f"my_pass{i} = my_pass{i - 1} + 'x'\n" for i in range(1, 20_000))
    crossed = "p0 = 'Qq7zX!'\np1 = 'aB3'\n" + "".join(f"p{i} = p{i - 1} + p{i - 2}\n" for i in range(2, 20_000)) + "pwd = p19999\n"
    for text, least in ((chain, 19_000), (crossed, 2), ("token=" * 50_000, 0), ("pwd:" * 50_000, 0), ("a=1&pwd=" * 50_000, 0), ("pwd='" * 50_000, 0), ('pwd:["Zx81kQm47T",' * 20_000, 20_000), ("pwd:{" * 50_000, 0), ("pwd:\n" * 50_000, 0), ("pwd:\n - " * 50_000, 0)):
        began = time.perf_counter()
        assert len(secrets.findings(text)) >= least
        assert time.perf_counter() - began < 3


def test_masking_leaves_no_tail():
    text = 'x password = "hunter2!$ecretTail#99x" y'
    assert secrets.masked(text, secrets.findings(text)) == 'x [assign]" y'


def test_secret_edges(spark):
    got = secrets.scan_secrets(odd(spark)).collect()
    assert len(got) == 6 and all(r["findings"] == [] for r in got)
    df = spark.createDataFrame([(1, "é token=abcdef12 x"), (2, None)], "doc_id long, text string")
    assert [r["text"] for r in secrets.redact_secrets(df).orderBy("doc_id").collect()] == ["é [assign] x", None]
    assert secrets.redact_secrets(df.limit(0)).count() == 0


def test_secrets_of_the_table(spark):
    sf = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op1_secret_scan(spark, sf).collect()}
    for r in docs.collect():
        base = brute_base(r["text"] or "")
        kinds = Counter(x.split(":")[0] for x in base.split(",") if x)
        g = got[r["doc_id"]]
        assert g["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and (g["n_assign"], g["n_access"], g["n_hex"]) == (kinds["assign"], kinds["access"], kinds["hex"])
    assert sum(r["n_assign"] + r["n_access"] + r["n_hex"] for r in got.values()) > 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("ab c"), max_size=30).map("".join))
def test_repeated_words(text):
    words = text.encode().split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = {w for w, n in Counter(windows).items() if n > 1}
    hit = {i + k for i, w in enumerate(windows) if w in many for k in range(3)}
    assert quality.repeated_words(words) == len(hit)


def test_quality_hosts(spark):
    good, soft = " ".join(f"word{i} other{i}" for i in range(40)), " ".join(f"### w{i} word{i}" for i in range(40))
    rows = [(i, soft if i < 90 else good, "bad") for i in range(100)] + [(100 + i, soft if i < 2 else good, f"ok{i % 3}") for i in range(60)] + [(200, None, None), (201, good, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("kept", F.lit("clash"))
    got = {r["doc_id"]: r for r in quality.with_verdicts(quality.measure(df)).collect()}
    assert len(got) == 162 and not got[0]["kept"] and got[95]["kept"] and got[100]["kept"] and not got[200]["kept"] and got[201]["kept"]
    assert sorted(r["doc_id"] for r in quality.keep_good(df).collect()) == sorted(k for k, r in got.items() if r["kept"])
    assert quality.keep_good(df).columns == df.columns and quality.keep_good(df.limit(0)).count() == 0


def test_quality_edges(spark):
    assert quality.measure(odd(spark)).where("n_words is null").count() == 0


def duck(spark, name, **tables):
    con = duckdb.connect()
    for t, df in tables.items():
        con.register(t, df.toPandas())
    for t in ("documents", "conversations"):
        if t not in tables:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con.execute(queries.oracle_sql()[name])


@pytest.mark.parametrize("name", ["op6_quality_rules", "op8_chat_format"])
def test_sql(spark, name):
    said = duck(spark, name)
    names = [d[0] for d in said.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(str, said.fetchall()))


def test_chat_round_trip(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices([*"<>|&;[] ea/sINT\n", "<|end|>"], k=rng.randrange(20))) for _ in range(30)] + ["<|end|>\n", "<|and|>", "</s>[INST] x", "&lt;", "&amp;lt;", ""]
    rows = [(c, t, r, x) for c in range(3) for t, (r, x) in enumerate(zip(["user", "user", "assistant", "a|>\nb", None, "assistant"] * 6, texts, strict=True))] + [(None, None, "user", None), (9, 1, "user", "b"), (9, 1, "user", "b"), (9, None, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.formatted(df).select("conv_id", chat.turns(F.col("formatted")).alias("turns")).collect()}
    want = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda y: (y[0] is None, y[0] or 0, y[1] is not None, y[1] or 0)):
        want[c].append((r or "", x or ""))
    assert got == dict(want)
    body = chat.formatted(df.where("conv_id = 0")).first()["formatted"]
    assert "</s>" not in body and "[INST]" not in body and body.count("<|and|>") == 6
    assert chat.formatted(df.limit(0)).count() == 0


def check_shards(rows, n):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        text = (r["text"] or "").encode()
        assert r["size"] == len(text) + 16 and r["text_crc32"] == zlib.crc32(text)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(n))
    sizes = [len(slots[i]) for i in range(n)]
    assert max(sizes) - min(sizes) <= 1


def test_sharding(spark):
    df = odd(spark)
    check_shards(sharding.shuffled(df, 4).collect(), 4)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    runs = [sharding.shuffled(d, 7, seed=s, bucket_rows=16).orderBy("shard", "slot").collect() for d, s in ((docs, 3), (docs.repartition(5), 3), (docs, 4))]
    for rows in runs:
        check_shards(rows, 7)
        assert len(rows) == 200
    order = [[r["doc_id"] for r in rows] for rows in runs]
    assert order[0] == order[1] != order[2] and order[0] != sorted(order[0])
    assert sharding.shuffled(docs.limit(0), 4).count() == 0


def test_permutations_are_uniform(spark):
    rows = spark.range(6000).select(sharding.permutation(F.lit(3), F.col("id"), 1).alias("p")).collect()
    seen = Counter(tuple(r["p"]) for r in rows)
    assert len(seen) == 6 and max(seen.values()) < 1150 and min(seen.values()) > 850


def test_written_shards(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sharding.write_shards(docs, str(tmp_path / "s"), 5)
    assert spark.read.parquet(str(tmp_path / "s")).groupBy("shard").count().count() == 5
    back = sharding.read_shards(docs, str(tmp_path / "s"))
    check_shards(back.collect(), 5)
    assert sorted(map(str, back.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    for file in (tmp_path / "s").rglob("*.parquet"):
        slots = [r["slot"] for r in spark.read.parquet(str(file)).select("slot").collect()]
        assert slots == sorted(slots)
    df = odd(spark)
    sharding.write_shards(df, str(tmp_path / "o"), 3)
    check_shards(sharding.read_shards(df, str(tmp_path / "o")).collect(), 3)
    sharding.write_shards(df.limit(0), str(tmp_path / "none"), 3)
    assert sharding.read_shards(df, str(tmp_path / "none")).count() == 0


def plain_permutation(spark, n, bucket, seed):
    """Fisher-Yates on a list, with the same draws."""
    draws = {r["i"]: r["j"] for r in spark.range(1, n).select(F.col("id").cast("int").alias("i"), F.pmod(F.xxhash64(F.lit(seed), F.lit(bucket).cast("bigint"), F.col("id").cast("int")), F.col("id") + 1).alias("j")).collect()}
    out = list(range(n))
    for i in range(n - 1, 0, -1):
        out[i], out[draws[i]] = out[draws[i]], out[i]
    return out


def test_permutation_is_fisher_yates(spark):
    for n in (1, 2, 47, 48, 49, 97, 500):
        got = spark.range(1).select(sharding.permutation(F.lit(n), F.lit(7).cast("bigint"), 3).alias("p")).first()["p"]
        assert got == plain_permutation(spark, n, 7, 3)
