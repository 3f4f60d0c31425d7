"""Near-duplicates, decontamination, packing, token files, extraction, language model, pipeline: brute force and edges."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from concord.llm import common, decontam, html, lm, neardup, packing, queries, tokenids

SF = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(400)]


def roots(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def slow_print(text, width):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "é", "c\x1cd", "long"]), max_size=700).map(" ".join), st.integers(1, 5))
def test_fingerprint(text, width):
    assert neardup.fingerprint(text, width) == slow_print(text, width)


def test_shingles_are_whole():
    assert neardup.shingles("a  b\tc\nd e", 4) == [b"a b c d", b"b c d e"] and neardup.shingles("A b", 4) == [b"a b"] and neardup.shingles(" \n", 4) == []


@pytest.mark.parametrize(("radius", "short"), [(2, 16), (4, 16), (4, 0), (5, 0), (7, 0), (7, 3)])
def test_links_by_brute_force(spark, radius, short, monkeypatch):
    monkeypatch.setattr(neardup, "SHORT", short)
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 12, dtype=np.int64)
    prints = [int(b) for b in base] + [0, -1]
    for b in base:
        for _ in range(12):
            x = int(b)
            for bit in rng.choice(64, rng.integers(1, 9), replace=False):
                x ^= 1 << int(bit)
            prints.append(x - 2**64 if x >= 2**63 else x)
    prints = sorted(set(prints))
    want = roots(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= radius if (prints[i] ^ prints[j]) >= 0] + [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]) < 0 and ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() <= radius])
    got = {r["fp"]: r["root"] for r in neardup.links(spark.createDataFrame([(p,) for p in prints], "fp long"), radius).collect()}
    assert [got[p] for p in prints] == [prints[r] for r in want]


@pytest.mark.parametrize("radius", [3, 4, 5])
def test_pairs_meet_once(spark, radius, monkeypatch):
    monkeypatch.setattr(neardup, "SHORT", 2)
    rng = np.random.default_rng(radius)
    prints = {int(b) for b in rng.integers(0, 2**63, 5, dtype=np.int64)}
    prints |= {b ^ sum(1 << int(x) for x in rng.choice(63, rng.integers(1, 5), replace=False)) for b in sorted(prints) for _ in range(12)}
    df = spark.createDataFrame([(p, p) for p in prints], "fp long, root long")
    got = sorted((r["a"], r["b"]) for r in neardup.near_pairs(df, radius).collect())
    assert got == sorted((a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= radius)


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 540)]
    want = roots(600, edges)
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: want[x] for x in linked}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    ids = [r["doc_id"] for r in docs]
    fps = [slow_print(r["text"] or "", 4) for r in docs]
    want = roots(len(docs), [(i, j) for i in range(len(docs)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    smallest = defaultdict(lambda: 1 << 60)
    for i, r in enumerate(want):
        smallest[r] = min(smallest[r], ids[i])
    got = {r["doc_id"]: r for r in queries.op5_simhash(spark, SF).collect()}
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{f:016x}", smallest[w]) for i, f, w in zip(ids, fps, want, strict=True)}


def test_near_duplicate_edges(spark):
    df = spark.createDataFrame([(3, None), (1, ""), (None, " \n"), (7, "a b"), (7, "a b")], "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = sorted(map(tuple, neardup.near_duplicates(df).collect()), key=str)
    x = neardup.fingerprint("a b") - (2**64 if neardup.fingerprint("a b") >= 2**63 else 0)
    assert got == sorted([(3, 0, 1), (1, 0, 1), (None, 0, 1), (7, x, 7), (7, x, 7)], key=str)
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def edited(rng, words, n):
    out = list(words)
    for i in rng.choice(len(out), n, replace=False):
        out[i] = f"new{rng.integers(1 << 30)}"
    return " ".join(out)


def test_one_of_each(spark):
    rng = np.random.default_rng(5)
    rows, want = [], set()
    for g in range(12):
        words = [WORDS[i] for i in rng.integers(0, 400, 300)]
        first = 100 * g
        rows += [(first, " ".join(words)), (first + 1, " ".join(words)), (first + 2, edited(rng, words, 1)), (first + 3, edited(rng, words, 2)), (first + 4, edited(rng, words, 60))]
        want |= {first, first + 4}
    rows += [(5000, None), (5001, ""), (5002, "tiny"), (5002, "tiny"), (None, "tiny"), (None, "lone"), (None, "lone")]
    want |= {5000, 5002}
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("root", F.lit("clash"))
    got = neardup.one_of_each(df).collect()
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == sorted(want)
    assert [r["text"] for r in got if r["doc_id"] is None] == ["lone"] and {r["root"] for r in got} == {"clash"}
    assert neardup.one_of_each(df.limit(0)).count() == 0


def test_decontamination(spark):
    item = "Tom has 12 apples and buys 15 more apples at 3 dollars each so how many apples does Tom hold after paying 36 dollars in all"
    plain = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"
    far = " ".join(f"z{i}" for i in range(30))
    bench = spark.createDataFrame([(1, item), (2, plain), (3, None), (4, "")], "item_id long, text string")
    docs = [(10, f"{far} {item} {far}"), (11, f"{far}, {item.replace('12', '70').replace('15', '81').replace('36', '99')} {far}"), (12, far), (13, plain.upper() + "!!"), (14, None), (15, ""), (None, plain), (17, " ".join(plain.split()[:8]) + " " + far), (18, "the of and"), (13, plain.upper() + "!!")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("h", F.lit("clash"))
    got = sorted(map(tuple, decontam.contaminated(df, bench).select("doc_id", "item_id").collect()), key=str)
    assert got == sorted([(10, 1), (11, 1), (13, 2), (None, 2)], key=str)
    changed = {r["doc_id"]: r for r in decontam.contaminated(df, bench).collect()}
    assert changed[10]["n_changed"] == 0 and changed[11]["n_changed"] > 0
    assert sorted(r["doc_id"] for r in decontam.clean(df, bench).collect()) == [12, 14, 15, 17, 18]
    mixed = item.replace("12", "70", 1).replace("Tom hold", "Ann hold").replace("3 dollars", "5 dollars").replace("36 dollars", "8 dollars")
    odd = spark.createDataFrame([(1, " ".join(mixed if i % 2 else item for i in range(2)))], "doc_id long, text string")
    assert [r["item_id"] for r in decontam.contaminated(odd, bench).collect()] == [1]  # the unchanged one of two occurrences
    assert decontam.contaminated(df.limit(0), bench).count() == 0 and decontam.contaminated(df, bench.limit(0)).count() == 0


def test_decontamination_of_the_table(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    bench = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    norm = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    holds = {(d, b) for d, t in docs.items() for b, x in bench.items() if f" {norm(x)} " in f" {norm(t)} "}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op7_decontamination(spark, SF).collect()}
    assert holds and holds <= got
    for d, b in got - holds:  # near copies hold most of the item's words in order
        words = norm(bench[b]).split()
        assert sum(f" {' '.join(words[i : i + 5])} " in f" {norm(docs[d])} " for i in range(len(words) - 4)) >= 0.5 * (len(words) - 4)


def best_fit(pieces, capacity, per_source):
    """Residuals in plain lists: the tightest compatible bin, the oldest of equals."""
    bins, out = [], []
    for size, source, cluster in pieces:
        ok = [i for i, b in enumerate(bins) if b[0] >= size and b[1][source] < per_source and cluster not in b[2]]
        i = min(ok, key=lambda i: (bins[i][0], i), default=None)
        if i is None:
            i = len(bins)
            bins.append([capacity, Counter(), set()])
        bins[i][0] -= size
        bins[i][1][source] += 1
        bins[i][2].add(cluster)
        out.append(i)
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 3), st.integers(0, 9)), max_size=120), st.integers(1, 3))
def test_bins(pieces, per_source):
    bins = packing.Bins(20, per_source)
    assert [bins.put(size, source, 1 << cluster)[0] for size, source, cluster in pieces] == best_fit(pieces, 20, per_source)


def test_packing(spark):
    rows = [(1, None, "a"), (2, "", None), (3, "w " * 25, "a"), (4, "same x", "a"), (4, "same x", "a"), (None, "same x", "b"), (7, "w " * 10, None)] + [(100 + i, "w " * (i % 9), "hot") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("bin", F.lit("clash"))
    got = packing.packed(df, capacity=10, per_source=2, group_rows=20).collect()
    size = Counter()
    for r in got:
        size[r["group"], r["bin"]] += r["n_words"]
    assert max(size.values()) <= 10 and sum(size.values()) == sum(len((t or "").split()) for _, t, _ in rows)
    sources = Counter((r["group"], r["bin"], r["source"]) for r in got if r["piece"] == 0 or r["n_words"] < 10)
    assert max(sources.values()) <= 2
    assert sorted((r["piece"], r["begin"], r["n_words"]) for r in got if r["doc_id"] == 3) == [(0, 0, 10), (1, 10, 10), (2, 20, 5)]
    twins = [(r["group"], r["bin"]) for r in got if r["doc_id"] == 4]
    assert len(twins) == 2 and len(set(twins)) == 2
    assert len(got) == len(rows) + 2 and packing.packed(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=400), st.sampled_from([1, 3, 8]), st.sampled_from([1, 2, 5]))
def test_coder(ids, lanes, stride):
    ids = np.array(ids, dtype=np.uint32)
    table = tokenids.Table(tokenids.quantised(np.bincount(ids, minlength=301)))
    block = tokenids.encode(ids, table, lanes, stride)
    assert (tokenids.decode(block, table) == ids).all()
    for c in range(-(-(-(-len(ids) // lanes)) // stride)):
        assert (tokenids.decode(block, table, c) == ids[c * stride * lanes :]).all()


def test_damage_is_found():
    ids = np.arange(3000, dtype=np.uint32) % 50
    table = tokenids.Table(tokenids.quantised(np.bincount(ids)))
    block = bytearray(tokenids.encode(ids, table, 16))
    block[-40] ^= 1
    with pytest.raises(ValueError):
        tokenids.decode(bytes(block), table)
    with pytest.raises(ValueError):
        tokenids.decode(b"\0" * 24, table)


def test_rare_ids_keep_a_place():
    counts = np.ones(40_000, dtype=np.int64)
    counts[7] = 10**9
    freq = tokenids.quantised(counts)
    assert freq.sum() == 1 << tokenids.BITS and freq.min() == 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"aZ .,;:!?'\n\x1c\x85\xa09²#<|>", "<|endoftext|>", " Hello ", "World", " SECRET. ", "<| ", "don't", "İ", "ß", "e\u0301", "é", "Σ", "ﬁ", "\u212b", "ᄀ\u1161", "ª", "it's", "long", "»."]), max_size=25).map("".join), max_size=4))
def test_ids_by_word(texts):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    whole = [tokenids.tokenizer(path).encode(t, add_special_tokens=False).ids for t in texts]
    for known in (tokenids.KNOWN, 3):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(tokenids, "KNOWN", known)
            assert [x.tolist() for x in tokenids.ids_of(texts, path, True)] == whole


def test_token_files(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(5, "Hello, wörld!! it's ok...", "x"), (None, "a<|endoftext|>b <|ENDOFTEXT|>", "x"), (2, None, None), (3, "", "x"), (5, "again \x1c\xa0 é", "x"), (9, "many words " * 3000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, part string")
    got = tokenids.round_trip(df, path, end_id=1, by_word=True, vocabulary=49_408).orderBy("start").collect()
    coder = tokenids.tokenizer(path)
    want = {}
    for i, t, _ in rows:
        ids = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    start = 0
    for r in got:
        assert r["start"] == start and (r["n_tokens"], r["ids_crc32"]) in want[r["doc_id"]]
        start += r["n_tokens"]
    assert [r["doc_id"] for r in got] == [None, 2, 3, 5, 5, 9]
    assert tokenids.round_trip(df.limit(0), path, 1, True, 49_408).count() == 0


def test_page_text():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><header>top</header><nav><a href=x>menu</a></nav>
    <div class="cookie-notice">accept</div><div id="content"><article class="post"><header><h1>Head &amp; tail</h1></header><p>one<b>two</b> three<br>four<p>five &lt;six&gt;
    <script>var a = "</p>";</script><div class="ad">buy</div><form>send</form><ul><li>x<li>y</ul><footer>by me</footer></article><div class="comments">nice</div></div><aside>side</aside><footer>&copy;</footer>"""
    p = html.Page(page)
    assert p.taken([]) == p.taken([p.best()[0]]) == "Head & tail onetwo three four five <six> x y"
    assert html.Page("").taken([]) == "" and html.Page("plain <b>text").taken([]) == "plain text" and html.Page("a <div cl").taken([]) == "a"


def test_extraction(spark):
    page = "<body><div class='c{n}'><p>main text number {n} that is long enough</p></div><div class='x'><p>{x}</p></div></body>"
    rows = [(i, "http://h.example/1", page.format(n=i, x="short")) for i in range(5)] + [(9, "http://h.example/2", page.format(n=9, x="a box beside that for once is very much longer than the text")), (10, None, None), (11, "http://other/", "no markup")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("paths", F.lit("clash"))
    got = {r["page_id"]: r["text"] for r in html.extract(df.drop("paths")).collect()}
    assert got[9] == "main text number 9 that is long enough" and got[10] == "" and got[11] == "no markup" and len(got) == 8
    assert html.extract(df.drop("paths").limit(0)).count() == 0


def test_pages_of_the_table(spark):
    got = {r["page_id"]: r for r in queries.op9_html_extraction(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        text = got[r["page_id"]]["text"]
        assert got[r["page_id"]]["n_chars"] == len(text) > 0 and "track(" not in text and "©" not in text


def toy_words():
    top = [(b"a", 500), (b"b", 500), *((b"x%d" % i, 5) for i in range(900))]
    groups = defaultdict(lambda: [0, 0])
    for w, n in [*top[lm.HOT :], *((b"rare%d" % i, 1) for i in range(300))]:
        groups[lm.group_of(w)][0] += n
        groups[lm.group_of(w)][1] += 1
    return lm.Words(top, 50, {g: tuple(v) for g, v in groups.items()}), groups, top


def test_model_learns():
    words, _, _ = toy_words()
    texts = [words.coded(" ".join("ab"[(i + j) % 2] for i in range(60)))[0] for j in np.random.default_rng(0).integers(0, 2, 400)]
    model = lm.Model(words, 1)
    for seed in range(15):
        model.train(iter(texts), words, seed)
    p = np.exp(lm.Scorer(model, words).log_classes(np.array([1, 2]), np.array([2, 1])))
    assert p[0, 2] > 0.8 and p[1, 1] > 0.8


def test_word_probabilities_sum_to_one():
    words, groups, top = toy_words()
    model = lm.Model(words, 1)
    texts = [words.coded(f"a x{i} b x{i + 300} rare{i} b")[0] for i in range(600)]
    model.train(iter(texts), words, 3)
    scorer = lm.Scorer(model, words)
    rest = Counter(lm.group_of(b"rare%d" % i) for i in range(300))
    for before in ("a x600", "b a", "rare7 x3"):
        lead = words.coded(before)[0][:-1]
        one = lambda ids: 10 ** scorer.tokens(np.concatenate([lead, ids]).astype(np.int32))[0]
        total = sum(one(words.coded(w.decode())[0][:1]) for w, _ in top) + one(np.array([len(words.cls) - 1]))
        # a word outside the dictionary has c + 1 times its group's share, a word never seen one such share a group
        total += sum((2 * rest[g] + 1) * one(np.array([-g])) for g in range(1 + lm.HOT, lm.CLASSES))
        assert total == pytest.approx(1, abs=1e-4)


def test_scores_under_other_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "UNIT", 20_000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    runs = [{r["doc_id"]: r["score"] for r in lm.scores(docs.repartition(n)).collect()} for n in (2, 7)]
    assert runs[0].keys() == runs[1].keys() and all(runs[0][k] == pytest.approx(runs[1][k], rel=1e-5) for k in runs[0])


def test_pieces_of_long_texts(monkeypatch):
    words, _, _ = toy_words()
    scorer = lm.Scorer(lm.Model(words, 1), words)
    text = words.coded("a b x700 rare1 " * 50)[0]
    whole = np.zeros(1)
    lm._add(whole, [(0, np.concatenate([np.full(2, len(words.cls) - 1, np.int32), text]))], scorer)
    parts = np.zeros(1)
    lm._add(parts, [(0, np.concatenate([text[b - 2 : b] if b else np.full(2, len(words.cls) - 1, np.int32), text[b : b + 7]])) for b in range(0, len(text), 7)], scorer)
    assert parts[0] == pytest.approx(whole[0])
    got = list(lm.batches(iter([text]), 2, len(words.cls) - 1))
    assert sum(int(real.sum()) for _, real in got) == len(text) and np.concatenate([ids[real > 0] for ids, real in got]).tolist() == text.tolist()


def test_scores_of_the_table(spark):
    docs = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    seen = Counter(w for i, ws in docs.items() if not held[i] for w in [*ws, None])
    n, v = sum(seen.values()), len(seen)
    got = lm.scores(spark.read.parquet(f"{SF}/documents.parquet"), dictionary=700).collect()
    assert len(got) == len(docs)
    for r in got:
        ws = [*docs[r["doc_id"]], None]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), sum(seen[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_scores_word_by_word(spark, monkeypatch):
    """Each score is the sum over its words of class, slot and rest probabilities, all normalised one by one."""
    held = {}

    def kept(coded, words, *how):
        held["words"], held["model"] = words.value, trained(coded, words, *how)
        return held["model"]

    trained = lm.train
    monkeypatch.setattr(lm, "train", kept)
    table = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r["score"] for r in lm.scores(table, dictionary=700).collect()}
    docs = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in table.collect()}
    words, model = held["words"], held["model"]
    seen = Counter(w for i, ws in docs.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    r, t, slots, c = (x.astype(np.float64) for x in (model.r, model.t, model.slots, model.c))
    b = model.b.astype(np.float64)
    members, rest = defaultdict(list), Counter()
    for w, i in words.index.items():
        members[int(words.cls[i])].append(int(words.slot[i]))
    for w, n in seen.items():
        if w not in words.index:
            rest[lm.group_of(w)] += n + 1
    class_of = lambda w: int(words.cls[words.index[w]]) if w in words.index else lm.group_of(w)
    softmax = lambda s: np.exp(s - s.max()) / np.exp(s - s.max()).sum()
    for i, ws in docs.items():
        total, before = 0.0, [0, 0]
        for w in [*ws, None]:
            q = c[0] * r[before[1]] + c[1] * r[before[0]]
            cls = 0 if w is None else class_of(w)
            total += math.log10(softmax(t @ q + b)[cls])
            if cls > lm.HOT:
                of = [*members[cls], int(words.rest[cls])]
                slot = int(words.slot[words.index[w]]) if w in words.index else of[-1]
                total += math.log10(softmax(slots[of, :-1] @ q + slots[of, -1])[of.index(slot)])
                if w not in words.index:
                    total += math.log10((seen[w] + 1) / (rest[cls] + 1))
            before = [before[1], cls]
        assert got[i] == pytest.approx(total, rel=1e-4)


def test_score_edges(spark):
    df = spark.createDataFrame([(1, None, 1), (None, "", 2), (2, "a b", 3), (2, "a b", 3)], "doc_id long, text string, row int")
    got = lm.scores(df).collect()
    assert sorted(r["n_tokens"] for r in got) == [1, 1, 3, 3] and all(math.isfinite(r["score"]) for r in got)
    assert lm.scores(df.limit(0)).count() == 0


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, frame = [], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = frame
        frame = common.written(stage(spark, frame, SF), name)
        assert frame.columns == docs.columns and frame.count() <= before.count()
        names.append(name)
    texts = [r["text"] for r in frame.collect()]
    sets = [set(neardup.shingles(t, 5)) for t in texts]
    assert len(set(texts)) == len(texts)
    assert not any(len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    from concord.llm import quality, secrets

    assert not any(f[0] != "lexed" for t in texts for f in secrets.findings(t))
    assert all(quality.counts(t)[0] >= 45 for t in texts)
    assert decontam.contaminated(frame, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    packed = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in frame.select("doc_id").collect()}
    assert names == ["quality_rules", "near_dedup", "decontamination", "secret_scan"]


def test_words_are_looked_up_once(monkeypatch):
    """New words of a batch are learned in the order in which they come, each once, and serve all of its texts."""
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    words = [f"looked{i}" for i in range(60)]
    learned, learn = [], tokenids._learn
    monkeypatch.setattr(tokenids, "_learn", lambda fresh, *x: learned.extend(fresh) or learn(fresh, *x))
    monkeypatch.setattr(tokenids, "_known", {})
    texts = [" ".join(words + words[::-1]), " ".join(words[5:] + ["last"])]
    got = [x.tolist() for x in tokenids.ids_of(texts, path, True)]
    assert learned == [w.encode() for w in [*words, "last"]]
    assert got == [x.tolist() for x in tokenids.ids_of(texts, path, False)] == [x.tolist() for x in tokenids.ids_of(texts, path, True)]
    assert len(learned) == 61


def test_a_worker_keeps_its_scorer():
    words = lm.Words([(b"a", 3), (b"b", 2)], 2, {})
    model = lm.Model(words, 1)
    first = lm.scorer_of(model, words)
    assert lm.scorer_of(model, words) is first
    assert lm.scorer_of(lm.Model(words, 1), words) is not first


def test_groups_of_counted_words(spark):
    text = "a bc def ghij é äö xé longer-word"
    got = {bytes(r["w"]): (r["n"], r["g"]) for r in lm.count_words(spark.createDataFrame([(text,), ("a",)], "t string")).collect()}
    assert got == {w: (1 + (w == b"a"), lm.group_of(w)) for w in lm.split(text)}


def test_only_words_of_groups_are_asked_for(monkeypatch):
    """Scoring makes no queries for words that are classes by themselves; sums go by row, whatever the rows' range."""
    words = lm.Words([(b"a", 3), (b"b", 2)], 2, {lm.group_of(b"c"): (4, 2)})
    model = lm.Model(words, 1)
    ids = np.array([2, 2, 0, -lm.group_of(b"c"), 1, -lm.group_of(b"c"), 2], np.int32)
    scorer = lm.Scorer(model, words)
    monkeypatch.setattr(lm.Model, "queries", lambda *a: pytest.fail("queries of a whole sequence"))
    one = [scorer.tokens(ids[i : i + 3])[0] for i in range(5)]
    assert np.allclose(scorer.tokens(ids), one)
    for most in (700, 90_000):
        rows = np.random.default_rng(1).integers(0, most, 5000)
        met, sums = lm.summed(rows, np.ones((5000, 1)))
        assert np.array_equal(met, np.unique(rows)) and np.array_equal(sums[:, 0], np.unique(rows, return_counts=True)[1])
