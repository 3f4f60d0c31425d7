"""Algebra of the kernels, failure paths, audits, embedders, readers and sinks."""

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.config import first_existing, resolved, sequence_length, within
from concord.functions import canon, chance
from concord.functions import vectors as V
from concord.operators import audit, cohort, counts, embed, fmdelta, group, panels, retrieval
from concord.sources import sinks, tables


def test_e_distance_equals_all_pairs(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(5, 4)), rng.normal(size=(7, 4))
    rows = [("A", v.tolist()) for v in x] + [("B", v.tolist()) for v in y]
    df = spark.createDataFrame(rows, "side string, vec array<double>").withColumns({"u": F.lit("u"), "representation": F.lit("r")})
    got = group.concordance(df, ["u"]).first()
    d = lambda a, b: ((a[:, None] - b[None]) ** 2).sum(2)
    want = 2 * d(x, y).mean() - d(x, x).sum() / 20 - d(y, y).sum() / 42
    assert got["e_distance"] == pytest.approx(want, abs=1e-9)
    mx, my = x.mean(0), y.mean(0)
    assert got["cosine_centroid"] == pytest.approx(mx @ my / np.linalg.norm(mx) / np.linalg.norm(my))
    assert got["pcc_centroid"] == pytest.approx(np.corrcoef(mx, my)[0, 1])


def test_degenerate_vectors_give_null(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0, 1.0], [1.0, 2.0])], "x array<double>, y array<double>")
    got = df.select(V.cosine("x", "y").alias("c"), V.pearson("x", "y").alias("p")).collect()
    assert got[0]["c"] is None and got[0]["p"] is None and got[1]["p"] is None and got[1]["c"] is not None


def test_constant_vectors_have_no_correlation(spark):
    rng = np.random.default_rng(3)
    rows = [([c] * 64, rng.normal(size=64).tolist()) for c in (0.1, 1e-9, 7.3e8, 0.0)] + [(rng.normal(1000, 1, 64).tolist(), rng.normal(size=64).tolist())]
    got = [r["p"] for r in spark.createDataFrame(rows, "x array<double>, y array<double>").select(V.pearson("x", "y").alias("p")).collect()]
    assert got[:4] == [None] * 4 and got[4] == pytest.approx(np.corrcoef(*rows[4])[0, 1], abs=1e-6)


def test_planted_contract_violations(spark):
    rows = [("CRISPR", "a", f"c{i}", i, 2) for i in (1, 2)] + [("DRUG", "b", "c1", 1, 2)] + [("DRUG", "d", f"c{i}", i, i) for i in (1, 2)]
    pairs = spark.createDataFrame(rows, "dataset_side string, treated_cell_id string, control_cell_id string, control_rank long, n_controls_used long")
    assert sorted(r["treated_cell_id"] for r in fmdelta.contract_violations(pairs).collect()) == ["b", "d"]


def test_chunks_by_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["A", "B", None]), i) for i in rng.sample(range(10_000), 500)]
    got = counts.chunks(spark.createDataFrame(rows, "dataset_side string, cell_id long").repartition(7), "cell_id", 16).collect()
    want = {(side, c): i // 16 for side in ("A", "B", None) for i, c in enumerate(sorted(c for s, c in rows if s == side))}
    assert {(r["dataset_side"], r["cell_id"]): r["chunk"] for r in got} == want and len(got) == 500


def test_underpowered(spark):
    df = spark.createDataFrame([("A", [1.0, 2.0]), ("B", [1.0, 3.0]), ("B", [2.0, 3.0])], "side string, vec array<double>").withColumns({"u": F.lit("u"), "representation": F.lit("r")})
    got = group.concordance(df, ["u"]).first()
    assert got["underpowered_for_e_distance"] and got["e_distance"] is None


def test_capped_distance_uses_the_first_in_hash_order(spark):
    rows = [(i, "A" if i < 6 else "B", [float(i), float(i * i)]) for i in range(12)]
    df = spark.createDataFrame(rows, "instance_id long, side string, vec array<double>").withColumns({"u": F.lit("u"), "representation": F.lit("r")})
    got = group.concordance(df, ["u"], max_n=3).first()
    assert (got["n_a"], got["n_a_sub"], got["n_b_sub"]) == (6, 3, 3)


def test_chance_by_enumeration(spark):
    sizes = [(g, k) for g in range(1, 7) for k in range(1, g + 1)]
    df = spark.createDataFrame(sizes, "gallery_size long, n_positive_keys long")
    for r in chance.expectation_columns(df).collect():
        g, k = r["gallery_size"], r["n_positive_keys"]
        firsts = [min(c) + 1 for c in itertools.combinations(range(g), k)]
        assert r["e_mrr"] == pytest.approx(np.mean([1 / f for f in firsts])) == chance.expected_mrr(g, k)
        for h in chance.HITS:
            assert r[f"e_hit{h}"] == pytest.approx(np.mean([f <= h for f in firsts]))
            assert chance.expected_hit(g, k, h) == pytest.approx(r[f"e_hit{h}"])


def test_ratio_correction_is_null_where_chance_is_certain(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 0.5)], "raw double, e double")
    got = [r[0] for r in df.select(chance.corrected(F.col("raw"), F.col("e"), "ratio")).collect()]
    assert got == [None, 1.0]


def test_random_ranks_have_no_corrected_score(spark):
    random.seed(1)
    rows = [(random.randint(1, 10), 10, 1) for _ in range(4000)]
    got = retrieval.metrics(spark.createDataFrame(rows, "rank_true long, gallery_size long, n_positive_keys long")).agg(F.avg("mrr_corrected"), F.avg("hit3_corrected")).first()
    assert abs(got[0]) < 0.02 and abs(got[1]) < 0.03


def instances(spark, rows):
    full = [(i, d, c, t, g, v) for i, (d, c, t, g, v) in enumerate(rows)]
    return spark.createDataFrame(full, "instance_id long, dataset string, cell_line string, perturbation_type string, perturbation_gene string, vec array<double>").withColumn("representation", F.lit("Gene"))


def test_zero_query_and_lonely_units_are_excluded(spark):
    inst = instances(spark, [("D", "c", "genetic", "G1", [1.0, 0.0]), ("D", "c", "genetic", "G1", [1.0, 0.1]), ("D", "c", "genetic", "G1", [0.0, 0.0]), ("D", "c", "genetic", "G2", [0.0, 1.0])])
    got = {r["query_instance_id"]: r for r in retrieval.task1_internal(inst).collect()}
    assert set(got) == {0, 1} and got[0]["gallery_size"] == 1 and got[0]["rank_true"] == 1


def test_ties_go_by_key(spark):
    inst = instances(spark, [("D", "c", "chemical", "G2", [1.0, 0.0]), ("D", "c", "genetic", "G1", [2.0, 0.0]), ("D", "c", "genetic", "G2", [3.0, 0.0]), ("D", "c", "chemical", "G1", [0.5, 0.5])])
    got = {r["query_instance_id"]: r["rank_true"] for r in retrieval.task2(inst, "C2G").collect()}
    assert got == {0: 2, 3: 1}


def test_loo_leaves_the_member_out(spark):
    inst = instances(spark, [("D", "c", "genetic", "G1", [float(i), 1.0]) for i in range(4)])
    loo = retrieval.loo_centroids(inst)
    stats = V.moments(inst, [*cohort.UNIT1, "representation"]).select(*cohort.UNIT1, F.col("mean").alias("unit_mean"))
    assert audit.not_in_own_centroid(loo.join(stats, list(cohort.UNIT1))).count() == 0
    assert {r["instance_id"]: r["loo"][0] for r in loo.collect()}[0] == pytest.approx(2.0)


def test_euclidean_similarity_and_wide_gallery_scope(spark):
    inst = instances(spark, [("D", c, "genetic", g, [float(x), 1.0]) for c in "ab" for g, x in (("G1", 0), ("G1", 1), ("G2", 8), ("G2", 9))])
    got = retrieval.task1_internal(inst, kind="euclidean", scope=()).collect()
    assert {r["gallery_size"] for r in got} == {4} and len(got) == 8


def test_cleaning(spark):
    df = spark.createDataFrame([(None,), ("  ",), (" a ",)], "x string")
    assert [r[0] for r in df.select(canon.normalized("x")).collect()] == ["NA", "NA", "a"]
    assert [r[0] for r in df.select(canon.side("x")).collect()] == ["NAN", "", "A"]
    sets = spark.createDataFrame([("b|A| a|",), ("A|B",)], "x string").select(canon.target_set("x").alias("x"))
    assert [r[0] for r in sets.collect()] == ["A|B", "A|B"] == [r[0] for r in sets.select(canon.target_set("x")).collect()]
    assert canon.id_column(["cell_id", "Unnamed: 0"], "DRUG") == "Unnamed: 0"
    with pytest.raises(ValueError):
        canon.id_column(["x"], "DRUG")
    with pytest.raises(ValueError):
        canon.require(df, ["y"], "t")
    with pytest.raises(Exception):  # noqa: B017
        spark.createDataFrame([("x1",)], "x string").select(canon.strict_bigint("x")).collect()
    got = spark.createDataFrame([("CUDA error: memory",), ("cublas failed",), ("file missing",), (None,)], "m string").select(canon.out_of_memory("m"), canon.tail("m", 4)).collect()
    assert [r[0] for r in got] == [True, True, False, False] and got[2][1] == "sing"
    assert canon.with_defaults(df, ["cell_type"]).columns == ["x", "cell_type"]


def delta_inputs(spark, big=1.0):
    spine = spark.createDataFrame([(0, "t0", 2, "CRISPR"), (1, "t1", 1, "CRISPR"), (2, "t2", 1, "DRUG"), (3, "t3", 1, "DRUG"), (4, "t4", 1, "DRUG"), (5, "t5", 3, "DRUG")], "row_id long, treated_cell_id string, n_controls_used long, dataset_side string")
    pairs = spark.createDataFrame([("t0", "c0", 1, 2, "crispr"), ("t0", "c1", 2, 2, "crispr"), ("t1", "bad", 1, 1, "crispr"), ("t2", "c2", 1, 1, "drug"), ("t4", "c2", 1, 1, "drug"), ("t5", "c2", 1, 3, "drug")], "treated_cell_id string, control_cell_id string, control_rank long, n_controls_used long, dataset_side string")
    vecs = [("CRISPR", "t0", [3.0, 3.0]), ("CRISPR", "c0", [1.0, 1.0]), ("CRISPR", "c1", [2.0, 0.0]), ("CRISPR", "t1", [1.0, 1.0]), ("CRISPR", "bad", [float("nan"), 1.0]), ("DRUG", "c2", [1.0, 1.0]), ("DRUG", "t4", [big, 1.0])]
    return fmdelta.clean_spine(spine), fmdelta.clean_pairs(pairs), spark.createDataFrame(vecs, "dataset_side string, cell_id string, vec array<double>")


def test_every_reason_and_no_lost_row(spark):
    spine, pairs, vecs = delta_inputs(spark, 1e39)
    got = {r["row_id"]: r for r in fmdelta.deltas(spine, pairs, vecs).collect()}
    want = {0: "", 1: "control_embedding_missing_or_invalid", 2: "treated_embedding_missing_or_invalid", 3: "missing_pair_key", 4: "delta_non_finite", 5: "n_controls_mismatch"}
    assert {k: r["invalid_reason"] for k, r in got.items()} == want
    assert got[0]["delta"] == [1.5, 2.5] and all((r["delta"] is None) == (not r["valid_mask"]) for r in got.values())
    assert audit.rows_preserved(spine, fmdelta.deltas(spine, pairs, vecs)).ok


def test_fatal_and_recorded_audits(spark):
    spine, pairs, vecs = delta_inputs(spark)
    with pytest.raises(audit.AuditError) as e:
        audit.delta_run(spine, pairs, vecs)
    assert e.value.code == 10
    delta, done = audit.delta_run(spine.where("row_id < 5"), pairs.where("treated_cell_id <> 't5'"), vecs)
    assert {a.name: a.ok for a in done} == {"row_id_contiguous": True, "pair_group_contract": True, "delta_rows_have_pair_keys": False, "embedding_side": True, "embedding_dimension_consistent_across_sides": True, "rows_preserved": True, "delta_finite_or_null": True}
    assert json.dumps([a.record() for a in done]) and delta.count() == 5
    with pytest.raises(audit.AuditError) as e:
        audit.delta_run(spine.where("row_id <> 1"), pairs, vecs)
    assert e.value.code == 9
    assert not audit.seed(1).ok and audit.seed(619).ok
    assert audit.inputs_present(lambda p: p == "a", ["a", "b"]).counterexamples == ("b",)


def test_duplicates_in_reference_and_source(spark):
    cnt = spark.createDataFrame([("c1", "g1", 2.0), ("c1", "g2", 3.0), ("c2", "g1", 5.0)], "cell_id string, gene_symbol string, cnt double")
    genes = spark.createDataFrame([(0, "g1", "T"), (1, "g2", "T")], "src_pos long, gene_symbol string, target string")
    ref = spark.createDataFrame([(0, "T"), (3, "T")], "pos long, gene string")
    assert sorted(map(tuple, counts.align_last_wins(cnt, genes, ref).collect())) == [("c1", 3, 3.0)]  # c2's zero in g2 replaces its g1
    assert sorted(map(tuple, counts.align_sum(cnt, genes, ref).collect())) == [("c1", 3, 5.0), ("c2", 3, 5.0)]


@pytest.mark.parametrize(("mode", "want"), [("f2", [3, 4]), ("f0", [2, 4]), ("a1", [3, 4]), ("t4", [3, 5]), ("t0", [2, 4]), ("x", [2, 4]), ("tq", [2, 4])])
def test_token_modes(spark, mode, want):
    stats = spark.createDataFrame([(0.9, 2), (3.0, 3)], "row_sum double, row_nnz long")
    extra = {"f2": [1, 1], "f0": [0, 0], "a1": [1, 1], "t4": [1, 1], "t0": [0, 0], "x": [0, 0], "tq": [0, 0]}[mode]
    assert [r["pos_tokens"] for r in counts.positive_tokens(stats, mode).collect()] == [2 + extra[0], 3 + extra[1] + 1]


def test_mapping_retries_in_upper_case(spark):
    genes = spark.createDataFrame([("tp53",), ("MYC",), ("zz",), ("",), ("Mm1",)], "gene_symbol string")
    gmap = tables.symbol_map(spark.createDataFrame([("TP53", "ENSG1"), ("MYC", " ENSG2 "), ("Mm1", "ENSMUSG3"), (None, "ENSG9"), ("q", "")], "symbol string, ensembl_id string"))
    assert {tuple(r) for r in counts.mapped(genes, gmap).collect()} == {("tp53", "ENSG1"), ("MYC", "ENSG2")}
    assert {r[0] for r in counts.mapped(genes, gmap, retry_upper=False, prefix="").collect()} == {"MYC", "Mm1"}
    with pytest.raises(ValueError):
        counts.mapped(genes, gmap, minimum=counts.MIN_MAPPED_GENES)


def test_embedder_halves_and_bisects(spark):
    rows = [("CRISPR", str(i), [float(i)] * 8) for i in range(40)]
    cells = spark.createDataFrame(rows, "dataset_side string, cell_id string, vec array<double>")
    make = lambda: embed.StubEmbedder(dim=4, most=8, bad=frozenset({"7", "21"}))
    got = {r["cell_id"]: r for r in embed.embedded(cells, make, batch_size=32).collect()}
    assert len(got) == 40 and {k for k, r in got.items() if r["vec"] is None} == {"7", "21"}
    assert got["7"]["error"] == "cannot embed 7" and got["3"]["vec"] == [3.0] * 4
    whole = embed.embedded(cells.coalesce(1), make, chunk=20, split=False).collect()
    assert sum(r["vec"] is None for r in whole) == 40


def test_other_errors_are_not_retried():
    calls = []

    class Model:
        def embed(self, rows, batch_size):
            calls.append(batch_size)
            raise RuntimeError("broken" if len(calls) > 1 else "out of memory")

    with pytest.raises(RuntimeError, match="broken"):
        embed.with_halving(Model(), None, 8)
    assert calls == [8, 4]


def test_panels(spark):
    rows = [(f"u{i}", r, "m", float(i + (r == "Gene"))) for i in range(3) for r in ("Gene", "Pathway")] + [("u9", "Gene", "m", 5.0)]
    long = spark.createDataFrame(rows, "unit string, representation string, metric_name string, metric_value double")
    assert panels.paired(long, ["unit"], []).first().asDict() == {"metric_name": "m", "n_pairs": 3, "mean_gene": 2.0, "mean_pathway": 1.0, "mean_difference": 1.0}
    assert {r["representation"]: r["n_units"] for r in panels.shared_scoreboard(long, ["unit"]).collect()} == {"Gene": 3, "Pathway": 3}
    assert panels.enrichment(long, "unit", ["metric_name"]).count() == 0
    sig = spark.createDataFrame([("u1", 0.01)], "unit string, p double")
    assert panels.with_significance(long, sig, ["unit"]).count() == long.count()


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "genes.tsv").write_text("id\tgene_name\n1\ta\n2\tB\n")
    assert [tuple(r) for r in tables.gene_list(spark, str(tmp_path / "genes.tsv"), upper=True).orderBy("pos").collect()] == [(0, "A"), (1, "B")]
    (tmp_path / "meta.csv").write_text('row_id,treated_cell_id,extra\n0,"a,b",1\n')
    assert tables.csv(spark, str(tmp_path / "meta.csv"), tables.DELTA_META).first().asDict() == {"row_id": "0", "treated_cell_id": "a,b"}
    df = spark.createDataFrame([(1, [1.0, 2.0]), (0, None)], "row_id long, delta array<double>")
    sinks.write_matrix(df, str(tmp_path / "m"))
    assert [r["delta"] for r in spark.read.parquet(str(tmp_path / "m")).orderBy("row_id").collect()] == [None, [1.0, 2.0]]
    sinks.write_table(df.select("row_id"), str(tmp_path / "t"), sinks.manifest("t", "t", "group", "unit", ["row_id"], []), "csv")
    assert json.loads((tmp_path / "t.manifest.json").read_text())["primary_key_fields"] == ["row_id"]
    sinks.write_json(str(tmp_path / "f/manifest.json"), {})
    sinks.write_json(str(tmp_path / "f/policy.json"), sinks.delta_policy("stub", {"dim": 8}))
    assert json.loads((tmp_path / "f/policy.json").read_text())["row_alignment_contract"]["invalid_row_fill"] == "all_nan_and_valid_mask_false"
    got = sinks.file_manifest(spark, str(tmp_path / "f")).collect()
    assert [r["relative_path"] for r in got] == ["policy.json"] and got[0]["size_bytes"] == (tmp_path / "f/policy.json").stat().st_size
    assert tables.newest(spark, [f"{tmp_path}/f/*.json", f"{tmp_path}/none/*.npy"]).endswith(".json")
    assert sinks.run_manifest({}, [], [], {})["created_at"].endswith("+00:00")
    a = spark.createDataFrame([("a", [1.0])], "cell_id string, vec array<double>")
    with pytest.raises(ValueError):
        tables.cells(a.union(a), spark.createDataFrame([("a", "x")], "cell_id string, kind string"), "cell_id")


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"batch_size": 8, "seed": 1, "odd": 2}')
    got = resolved({"batch_size": 16, "seed": None}, str(tmp_path / "c.json"))
    assert (got.batch_size, got.seed, got.knobs) == (16, 1, {"odd": 2})
    assert sequence_length({}, {"max_length": 5}) == 5 and sequence_length({"max_length": 3}, {"max_seq_len": 9}) == 3 and sequence_length({}, {}) == 1200
    assert first_existing({"a": str(tmp_path / "x"), "b": str(tmp_path)})[0] == "b"
    assert within(str(tmp_path / "x"), [str(tmp_path)]) and not within("/etc", [str(tmp_path)])
