"""Near copies whose lines repeat, and pairs just above the threshold: held against brute force."""

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.llm import common, neardup


def test_no_pair_above_the_threshold_is_lost(spark):
    rng = np.random.default_rng(8)
    texts = []
    for g in range(60):
        words = [f"w{i}" for i in rng.integers(0, 5000, 150)]
        line = [f"l{g}x{i}" for i in range(10)]
        if g < 30:
            texts += [" ".join(words + line * 10), " ".join(words + line)]
        else:
            other = list(words)
            for i in rng.choice(150, 2 + g % 2, replace=False):
                other[i] = f"new{g}x{i}"
            texts += [" ".join(words), " ".join(other)]
    sets = [set(neardup.shingles(t, 5)) for t in texts]
    near = {2 * g + 1 for g in range(60) if len(sets[2 * g] & sets[2 * g + 1]) >= 0.8 * len(sets[2 * g] | sets[2 * g + 1])}
    kept = {r["doc_id"] for r in neardup.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    lost = near & kept
    assert len(near) > 50 and kept | near == set(range(120)) and not lost, f"{len(lost)} of {len(near)} pairs lost"


def test_bound_drops_no_link(spark):
    """A group of near copies around the threshold, all of whose members share one bucket: every pair at 0.8 or more stays."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 5000, 120)]
    texts = []
    for g in range(120):
        words = list(base)
        for i in rng.choice(120, rng.integers(0, 7), replace=False):
            words[i] = f"n{rng.integers(0, 60)}"
        texts.append(" ".join(words[: 120 - 8 * (g % 3)]))
    texts = list(dict.fromkeys(texts)) + ["one two three four five six", "one"]
    hashed = [set(neardup.hashes(neardup.shingles(t, 5)).view(np.int64).tolist()) for t in texts]
    near = {(i, j) for i, x in enumerate(hashed) for j, y in enumerate(hashed) if i < j and len(x & y) >= 0.8 * len(x | y)}
    sets = spark.createDataFrame(list(enumerate(list(x) for x in hashed)), "h long, s array<bigint>")
    rows = spark.createDataFrame([(7, i, i) for i in range(len(texts))], "key long, h long, root long")
    for _ in range(3):
        rows = neardup.hopeful(rows, sets, 0.8)
    left = {r["h"] for r in rows.collect()}
    assert near and {i for pair in near for i in pair} <= left
    assert len(left) < len(texts)
    assert neardup.hopeful(rows.limit(0), sets, 0.8).count() == 0


def test_pairs_are_met_once(spark):
    rows = [(1, 10, 10), (1, 11, 11), (1, 12, 11), (2, 10, 10), (2, 11, 11), (3, 13, 13)]
    got = neardup.sharing_once(spark.createDataFrame(rows, "key long, h long, root long")).collect()
    assert sorted(tuple(r) for r in got) == [(10, 11), (10, 12)]


def test_bound_is_joined_once(spark, monkeypatch):
    """The rows that pass the bound are written before they are read from two sides."""
    plans = []
    was = neardup.written
    monkeypatch.setattr(neardup, "written", lambda df, name, **o: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or was(df, name, **o))
    sets = spark.createDataFrame([(i, [1, 2, 3, 4, i]) for i in range(10, 14)], "h long, s array<bigint>")
    rows = spark.createDataFrame([(7, i, i) for i in range(10, 14)], "key long, h long, root long")
    left = neardup.hopeful(rows, sets, 0.6)
    assert left.count() == 4
    assert max(len(re.findall(r"Join Inner.*>= ", p)) for p in plans) == 1


def test_discard_frees_what_the_driver_holds(spark):
    jvm = spark.sparkContext._jvm
    held = jvm.java.util.ArrayList()
    ref = jvm.java.lang.ref.WeakReference(held)
    del held
    time.sleep(3)  # until py4j has let it go
    common.discard(common.written(spark.range(3), "three"))
    assert ref.get() is None


def test_driver_builds_no_large_broadcast(spark):
    """A table of 10 MB as JSON is joined by shuffles."""
    rows = common.written(spark.range(90_000).select("id", F.lpad("id", 90, "x").alias("s")), "rows")
    assert "broadcast" not in common.small(rows)._jdf.queryExecution().analyzed().toString().lower()
    assert "broadcast" in common.small(rows.limit(10))._jdf.queryExecution().analyzed().toString().lower()


def broadcast_rows(spark, since):
    """Rows of each table that was broadcast in the runs from ``since`` on, as counted by Spark."""
    store = spark._jsparkSession.sharedState().statusStore()
    runs, found = store.executionsList(), []
    for run in (runs.apply(i).executionId() for i in range(runs.size())):
        nodes, counted = store.planGraph(run).allNodes(), store.executionMetrics(run)
        for node in (nodes.apply(i) for i in range(nodes.size()) if run >= since):
            metrics = node.metrics()
            ids = [metrics.apply(i).accumulatorId() for i in range(metrics.size()) if metrics.apply(i).name() == "number of output rows"]
            if node.name() == "BroadcastExchange" and counted.contains(ids[0]):
                found.append(int(counted.apply(ids[0]).replace(",", "")))
    return found


@pytest.fixture
def broadcast_at_1m(spark):
    """Spark broadcasts what it takes to be at most 1 MB; the number of runs so far."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "1m")
    yield spark._jsparkSession.sharedState().statusStore().executionsCount()
    left = spark.conf.get(name)
    spark.conf.set(name, before)
    assert left == "1m"


def test_index_is_not_broadcast(spark, broadcast_at_1m):
    """4,000 fingerprints have 196,000 rows of 24 bytes in the index, of which Spark knows their own 4,000 only."""
    prints = common.written(spark.range(4000).select(F.xxhash64("id").alias("fp")), "prints")
    assert neardup.links(prints, 4).count() == 4000
    assert max(broadcast_rows(spark, broadcast_at_1m), default=0) < 40_000


def test_classes_are_not_broadcast_by_estimate(spark):
    """The last join is the caller's to run, so it is a merge whatever Spark's estimate."""
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.hex("id").alias("text"))
    assert "Broadcast" not in neardup.near_duplicates(docs)._jdf.queryExecution().executedPlan().toString()


def test_bands_are_not_broadcast(spark, broadcast_at_1m):
    """4,000 texts have 128,000 rows of bands."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.hex(F.xxhash64("id", F.lit(i))) for i in range(9))).alias("text"))
    assert neardup.one_of_each(docs).count() == 4000
    assert max(broadcast_rows(spark, broadcast_at_1m), default=0) < 40_000


@pytest.mark.parametrize("own", [{}, {"spark.sql.autoBroadcastJoinThreshold": "256k"}, {"spark.sql.adaptive.autoBroadcastJoinThreshold": "1m"}])
def test_settings_are_put_back(spark, own):
    session = spark.newSession()
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name, value in own.items():
        session.conf.set(name, value)
    before = [session.conf.get(n, None) for n in names]
    with pytest.raises(ValueError), common.measured_broadcasts(session):
        assert [session.conf.get(n) for n in names] == ["-1", before[1] or before[0] or "10485760b"]
        raise ValueError
    assert [session.conf.get(n, None) for n in names] == before


def roots_of(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def edited(n, seed):
    """Copies of one text of 150 words, each with one to six words of its own."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for g in range(n):
        words = list(base)
        for i in rng.choice(150, 1 + g % 6, replace=False):
            words[i] = f"n{g}x{i}"
        texts.append(" ".join(words))
    return texts


def test_a_large_group_of_near_copies_is_not_all_pairs(spark, monkeypatch):
    """Texts just below the threshold from every copy in a group don't meet all of its copies, and no link is lost."""
    texts = edited(400, 5)
    sets = [set(neardup.shingles(t, 5)) for t in texts]
    root = roots_of(400, [(i, j) for j in range(400) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    compared = []
    was = neardup._similar
    monkeypatch.setattr(neardup, "_similar", lambda pairs, *a: compared.append(pairs.distinct().count()) or was(pairs, *a))
    kept = {r["doc_id"] for r in neardup.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == set(root) and 20 < len(kept) < 380
    assert sum(compared) < 20 * 400


def test_close_pairs_tie_all_similar_texts(spark):
    """Blocks of sizes mixed, around the threshold, with repeats of the edits: components are those of all pairs."""
    rng = np.random.default_rng(3)
    texts = [f"alone {i} " + " ".join(f"a{i}x{j}" for j in range(60)) for i in range(2)] + ["one two three four five six", "one", ""]
    for g, n in ((0, 150), (1, 2), (2, 12)):
        base = [f"g{g}w{i}" for i in range(120)]
        for k in range(n):
            words = list(base)
            for i in rng.choice(120, rng.integers(0, 7), replace=False):
                words[i] = f"n{rng.integers(0, 60)}"
            texts.append(" ".join(words[: 120 - 8 * (k % 3)]))
    texts = list(dict.fromkeys(texts))
    hashed = [set(neardup.hashes(neardup.shingles(t, 5)).view(np.int64).tolist()) for t in texts]
    n = len(texts)
    near = [(i, j) for j in range(n) for i in range(j) if len(hashed[i] & hashed[j]) >= 0.8 * len(hashed[i] | hashed[j])]
    sets = spark.createDataFrame(list(enumerate(list(x) for x in hashed)), "h long, s array<bigint>")
    start = roots_of(n, near[::7])
    for root in (list(range(n)), start):
        rows = spark.createDataFrame([(7, i, r) for i, r in enumerate(root)], "key long, h long, root long")
        got = [tuple(r) for r in neardup.close_pairs(rows, sets, 0.8).collect()]
        known = [(i, r) for i, r in enumerate(root) if i != r]
        assert roots_of(n, [p for p in got if p in set(near)] + known) == roots_of(n, near)
    assert neardup.close_pairs(rows.limit(0), sets, 0.8).count() == 0
