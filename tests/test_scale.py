"""What must hold on hot slices, hot units and wide vectors: blocked retrieval, ranks by pieces, closed forms."""

import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.functions import chance
from concord.functions import vectors as V
from concord.operators import blocked, cohort, panels, retrieval


@pytest.mark.parametrize("kind", ["cosine", "euclidean"])
def test_blocked_ranks_by_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(blocked, "VALUES", 64)  # eight vectors of eight components to a block
    monkeypatch.setattr(blocked, "GROUP", 2)
    rng = np.random.default_rng(1)
    slices, queries, gallery, positives = ["hot"] * 9 + ["cold", "lone"], [], [], []
    means = {(s, k): np.round(rng.normal(size=8), 1).tolist() for s in ("hot", "cold") for k in [f"k{i}" for i in range(90 if s == "hot" else 3)]}
    means["hot", "k5"], means["hot", "k6"] = means["hot", "k7"], [0.0] * 8  # a tie and a vector without a direction
    for i in range(150):
        s = slices[i % len(slices)]
        own = [f"k{i % 90}", f"k{(i + 1) % 90}"] if s == "hot" else ["k1"]
        queries.append((i, s, "Gene", [0.0] * 8 if i == 9 else np.round(rng.normal(size=8), 1).tolist()))
        positives += [(i, "Gene", k, means[s, k]) for k in own if (s, k) in means]
    gallery = [(s, "Gene", k, m) for (s, k), m in means.items()]
    df = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(5)
    got = retrieval.per_query(df(queries, "query_instance_id long, slice string, representation string, vec array<double>"), df(gallery, "slice string, representation string, key string, mean array<double>"), ["slice", "representation"], df(positives, "query_instance_id long, representation string, key string, mean array<double>"), kind)
    got = {r["query_instance_id"]: (r["gallery_size"], r["n_positive_keys"], r["rank_true"]) for r in got.collect()}

    def sim(x, y):
        x, y = np.array(x), np.array(y)
        if kind == "euclidean":
            return round(-math.sqrt(((x - y) ** 2).sum()), 9)
        n = math.sqrt((x * x).sum()) * math.sqrt((y * y).sum())
        return round(float(x @ y) / n, 9) if n else None

    want = {}
    for i, s, _, vec in queries:
        own = {k for q, _, k, _ in positives if q == i}
        entries = [(v, k) for (t, k), m in means.items() if t == s for v in [sim(vec, m)]]
        ranked = sorted((-v, k) for v, k in entries if v is not None)
        first = next((j for j, (_, k) in enumerate(ranked) if k in own), None)
        if first is not None:
            want[i] = (len(entries), len(own), 1 + first)
    assert got == want and len(want) > 100


def test_hot_slice_meets_in_pairs_of_groups(spark, monkeypatch):
    monkeypatch.setattr(blocked, "VALUES", 64)
    monkeypatch.setattr(blocked, "GROUP", 1)
    q = spark.range(200).select(F.col("id").alias("query_instance_id"), F.lit("s").alias("slice"), F.lit("Gene").alias("representation"), F.array(*[F.rand(i) for i in range(8)]).alias("vec"), F.lit(9.0).alias("beat"), F.lit("a").alias("best_key"), F.array(F.lit("a")).alias("own_keys"))
    g = spark.range(50).select(F.lit("s").alias("slice"), F.lit("Gene").alias("representation"), F.col("id").cast("string").alias("key"), F.array(*[F.rand(i) for i in range(8)]).alias("mean"))
    got = blocked.counts(q, g, ["slice", "representation"], "cosine").collect()
    assert len(got) == 200 and {(r["gallery_size"], r["n_ahead"]) for r in got} == {(50, 0)}


def test_unit_is_linear(spark):
    took = {}
    for dim in (256, 4096):
        df = spark.range(0, 50, 1, 1).select(F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: (F.col("id") + i) * 1.0).alias("vec")).select(V.total(V.unit("vec")).alias("x"))
        df.collect()
        began = time.perf_counter()
        df.agg(F.sum("x")).collect()
        took[dim] = time.perf_counter() - began
    assert took[4096] < 16 * 4 * took[256] + 2
    got = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "vec array<double>").select(V.unit("vec")).collect()
    assert [r[0] for r in got] == [[0.6, 0.8], None, None]


@pytest.mark.parametrize("piece", [100_000, 16, 1])
def test_ranks_by_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr(cohort, "PIECE", piece)
    rng = random.Random(piece)
    rows = [(i, "hot" if rng.random() < 0.9 else rng.choice(["a", "b", None])) for i in range(700)]
    df = spark.createDataFrame(rows, "instance_id long, u string").repartition(6)
    plain = df.selectExpr("*", "row_number() over (partition by u order by md5('619|' || instance_id), instance_id) as rn")
    want = {r["instance_id"]: r["rn"] for r in plain.collect()}
    got = cohort.ranked(df, ("u",))
    assert got.columns == ["instance_id", "u", "rn"] and {r["instance_id"]: r["rn"] for r in got.collect()} == want and got.count() == len(rows)
    for cap in (1, 7, 2000):
        assert {r["instance_id"]: r["rn"] for r in cohort.subsample(df, cap, ("u",)).collect()} == {i: n for i, n in want.items() if n <= cap}
    assert {r["instance_id"] for r in cohort.split_half(df, ("u",)).where("side = 'A'").collect()} == {i for i, n in want.items() if n % 2}
    assert cohort.ranked(df.limit(0), ("u",)).count() == 0


def test_chance_of_large_galleries(spark):
    sizes = [(g, k) for g in (19, 20, 21, 137, 5000) for k in (1, 2, 5, 19) if k <= g]
    for r in chance.expectation_columns(spark.createDataFrame([*sizes, (3, 0), (2, 3)], "gallery_size long, n_positive_keys long")).collect():
        g, k = r["gallery_size"], r["n_positive_keys"]
        if (g, k) not in sizes:
            assert r["e_mrr"] is None and r["e_hit1"] is None
            continue
        assert r["e_mrr"] == pytest.approx(chance.expected_mrr(g, k), rel=1e-12)
        for h in chance.HITS:
            assert r[f"e_hit{h}"] == pytest.approx(chance.expected_hit(g, k, h), rel=1e-12, abs=1e-15)


@pytest.mark.parametrize("n", [3, 5, 12])
def test_sign_flips_by_enumeration(spark, n):
    rng = random.Random(n)
    diffs = [round(rng.uniform(-1, 2), 2) for _ in range(n)]
    rows = [(f"u{i}", r, "m", (d if r == "Gene" else 0.0)) for i, d in enumerate(diffs) for r in ("Gene", "Pathway")] + [("alone", "Gene", "m", 9.0)]
    df = spark.createDataFrame(rows, "unit string, representation string, metric_name string, metric_value double")
    got = panels.significance(df, ["unit"], []).first()
    sums = [abs(round(sum(s * d for s, d in zip(signs, diffs, strict=True)), 9)) for signs in itertools.product((1, -1), repeat=n)]
    assert got["n_pairs"] == n and got["method"] == "exact" and got["p_value"] == sum(s >= abs(round(sum(diffs), 9)) for s in sums) / 2**n


def test_drawn_signs_do_not_hang_on_partitions(spark):
    rng = random.Random(9)
    rows = [(f"p{i % 2}", f"u{i}", r, "m", (rng.gauss(0.15 * (i % 2), 1) if r == "Gene" else 0.0)) for i in range(400) for r in ("Gene", "Pathway")]
    df = spark.createDataFrame(rows, "panel string, unit string, representation string, metric_name string, metric_value double")
    found = [{r["panel"]: (r["n_pairs"], r["method"], r["p_value"]) for r in panels.significance(df.repartition(k), ["unit"], ["panel"]).collect()} for k in (1, 7)]
    assert found[0] == found[1] and {v[:2] for v in found[0].values()} == {(200, "drawn")}
    for p in ("p0", "p1"):  # close to what a normal approximation gives
        d = np.array([v for q, _, r, _, v in rows if q == p and r == "Gene"])
        z = abs(d.sum()) / math.sqrt((d * d).sum())
        assert found[0][p][2] == pytest.approx(math.erfc(z / math.sqrt(2)), abs=0.05)
    assert panels.significance(df, ["unit"], ["panel"], draws=99, seed=1).count() == 2
