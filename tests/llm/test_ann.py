"""Nearest neighbours: codes and bounds, the exact order against brute force, recall, edges."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.llm import ann, common, queries


def brute(rows, every=20, k=20):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    asks = {}
    for i, v in ok:
        if i % every == 0 and (i not in asks or v.tolist() < asks[i].tolist()):
            asks[i] = v
    out = {}
    for q, x in asks.items():
        met = sorted((-sum(a * b for a, b in zip(x, v, strict=True)), i) for i, v in ok if i != q and len(v) == len(x))
        if met:
            out[q] = [(i, -s) for s, i in met[:k]]
    return out


def test_rotation_and_codes():
    for dim in (1, 5, 64, 100):
        p = ann.rotation(dim)
        assert np.allclose(p @ p.T, np.eye(dim))
        signs = np.random.default_rng(dim).random((7, dim)) > 0.5
        packed = ann.bits(signs)
        assert packed.shape == (7, -(-dim // 64)) and (np.bitwise_count(packed).sum(1) == signs.sum(1)).all()


@pytest.mark.parametrize("dim", [16, 64, 130])
def test_bounds_hold(dim):
    rng = np.random.default_rng(dim)
    v = rng.standard_normal((600, dim)) * rng.random((600, 1)) + 0.3
    q = ann.Asked(np.arange(50), rng.standard_normal((50, dim)), 10)
    centre, codes, scalars = ann.encoded(v)
    exact = q.vectors @ v.T
    estimate, upper = q.bounds(slice(0, 50), codes, centre, scalars, 4.0)
    assert (exact <= upper).mean() > 0.9999 and abs((estimate - exact).mean()) < 0.05 * exact.std()
    assert np.corrcoef(estimate.ravel(), exact.ravel())[0, 1] > 0.8
    _, tight = q.bounds(slice(0, 50), codes, centre, scalars, 1.0)
    assert (tight <= upper).all() and (exact <= tight).mean() > 0.7


def test_few_are_reranked_where_some_are_near():
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 256))
    v = base[rng.integers(0, 40, 4000)] + 0.3 * rng.standard_normal((4000, 256))
    asked = ann.Asked(np.arange(64) - 100, base[:20].repeat(4, 0)[:64], 10)
    n = asked.meet(np.arange(4000), v, *ann.encoded(v), 4.0)
    exact = asked.vectors @ v.T
    assert n < 0.2 * exact.size
    assert (np.sort(asked.products)[:, ::-1] == asked.products).all() and np.allclose(asked.products, -np.sort(-exact)[:, :10])


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 64)
    monkeypatch.setattr(ann, "QUERIES", 7)
    monkeypatch.setattr(ann, "GROUP", 2)
    rng = np.random.default_rng(2)
    base = rng.standard_normal((30, 24)).astype(np.float32)
    rows = [(i, (base[i % 30] + (0.2 * rng.standard_normal(24) if i % 3 else 0)).astype(np.float32).astype(float).tolist()) for i in range(700)]
    rows += [(700, None), (720, []), (740, [0.0] * 24), (760, [1.0, float("nan")]), (780, [1.0, None] * 12), (800, [float("inf")] * 24), (None, [1.0] * 24), (60, rows[60][1]), (61, rows[61][1]), (820, [1.0, 2.0]), (841, [3.0, 1.0]), (842, [-3.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"ids": F.lit("clash"), "v": F.lit(1), "block": F.lit(2)})
    for kind in ("double", "float"):
        got = {}
        for r in ann.neighbours(df.withColumn("embedding", F.col("embedding").cast(f"array<{kind}>"))).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        want = brute(rows)
        assert got.keys() == want.keys() and all([x[0] for x in got[q]] == [x[0] for x in want[q]] and np.allclose([x[1] for x in got[q]], [x[1] for x in want[q]]) for q in want)
    assert ann.neighbours(df.limit(0)).count() == 0


def test_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    want = {(q, i) for q, found in brute([tuple(r) for r in rows]).items() for i, _ in found}
    got = {(r["query_id"], r["vec_id"]) for r in queries.op11_nearest_neighbours(spark, sf).collect()}
    assert len(got & want) >= 0.99 * len(want) and len(got) == len(want)


def test_tasks_do_not_grow_with_every_block(spark, monkeypatch):
    """Ten blocks are coded in as many tasks as there are shuffle partitions, not in ten."""
    plans = {}
    was = ann.written
    monkeypatch.setattr(ann, "written", lambda df, name, **o: plans.update({name: df._jdf.queryExecution().optimizedPlan().toString()}) or was(df, name, **o))
    rows = spark.range(10 * ann.BLOCK).select(F.col("id").alias("vec_id"), F.array((F.col("id") + 1).cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    ann.neighbours(rows, every=20_000, k=2)
    assert int(re.search(r"Repartition (\d+)", plans["codes"])[1]) == 4


def test_copies_of_queries_are_not_broadcast(spark):
    """Blocks of queries are copied to the groups; Spark's estimate, that of one copy, does not make it broadcast them all."""
    block = F.lpad(F.lit("x"), 1 << 18, "x").cast("binary")
    queries = common.written(spark.range(8).select(F.col("id").alias("query_block"), block.alias("query_vectors")), "asking")
    stored = common.written(spark.range(64).select(F.col("id").alias("block")), "codes")
    met = common.met_in_groups(queries, stored, 8)
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    assert met.select("query_block", "block").distinct().count() == met.count() == 8 * 64
    few = common.met_in_groups(queries.limit(1), stored, 8)
    assert "Broadcast" in few._jdf.queryExecution().executedPlan().toString()
