"""The registered concordance queries, each over the whole stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions import canon, chance
from concord.functions import vectors as V
from concord.operators import audit, cohort, counts, embed, fmdelta, group, panels, retrieval, summary
from concord.operators.group import rounded
from concord.plans import oracle
from concord.sources import fixtures as fx
from concord.sources import npy, scratch, sinks, stages, tables
from concord.sources.tables import positions, symbol_map, table

FOUND: dict = {}


def query(f):
    """Register a query; its doubles are rounded where it ends, so results do not hang on the order of summation."""

    def final(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(spark, sf_dir)
        return df.withColumns({n: rounded(F.col(n)) for n, kind in df.dtypes if kind == "double"})

    FOUND[f.__name__] = final
    return f


def _rep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.represented(fx.instances(spark, sf_dir))


# -- sources and cleaning ---------------------------------------------------------------------------------------------


@query
def scan_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.pair_list(spark, sf_dir).select("treated_cell_id", "control_cell_id", "control_rank", "n_controls_used", "dataset_side")


@query
def normalize_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = table(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment"])
    text = F.when(F.col("c_custkey") % 5 == 0, F.lit(None)).when(F.col("c_custkey") % 5 == 1, F.lit("   ")).otherwise(F.concat(F.lit("  "), "c_mktsegment", F.lit(" ")))
    return dirty.select("c_custkey", canon.normalized(text).alias("clean"))


@query
def side_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.instances(spark, sf_dir).select("instance_id", canon.side_of_class("perturbation_type").alias("dataset_side"))


@query
def strict_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = fx.delta_meta(spark, sf_dir).selectExpr("concat(' ', row_id) AS row_id", "CAST(n_controls_used AS STRING) AS n_controls_used")
    return meta.select(canon.strict_bigint(F.trim("row_id")).alias("row_id"), canon.strict_bigint("n_controls_used").alias("n_controls_used"))


@query
def double_or_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part", ["p_partkey", "p_brand"])
    text = F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.regexp_replace("p_brand", "Brand#", ""))
    return part.select("p_partkey", canon.double_or_zero(text).alias("value"))


@query
def canonical_target_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = fx.instances(spark, sf_dir).select("instance_id", F.concat(F.lit(" g9|"), F.lower("perturbation_gene"), F.lit("|G9 | a1")).alias("raw"))
    return dirty.select("instance_id", canon.target_set("raw").alias("perturbation_gene"))


# -- cohorts ----------------------------------------------------------------------------------------------------------


@query
def membership_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.membership(fx.instances(spark, sf_dir)).select("instance_id", "dataset", "cell_line", "perturbation_type", "perturbation_gene", "anchor_gene")


@query
def row_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.row_membership(fx.instances(spark, sf_dir)).select("instance_id", "dataset", "cell_line", "anchor_gene", "perturbation_type")


@query
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.coverage(cohort.membership(fx.instances(spark, sf_dir)))


@query
def lawful_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.lawful(coverage(spark, sf_dir))


@query
def data_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.inventory(fx.instances(spark, sf_dir))


@query
def representation_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.registry(_rep(spark, sf_dir))


@query
def registered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances in representations that a registry lists; here it lists Pathway for one dataset only."""
    rep = _rep(spark, sf_dir)
    listed = cohort.registry(rep).where("dataset = 'LINCS' OR representation = 'Gene'")
    return cohort.registered(rep, listed).select("instance_id", "dataset", "cell_line", "representation")


@query
def split_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.split_half(fx.instances(spark, sf_dir)).select("instance_id", *cohort.UNIT1, F.col("rn").cast("int").alias("rn"), "side")


@query
def subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.subsample(fx.instances(spark, sf_dir), 3).select("instance_id", *cohort.UNIT1, F.col("rn").cast("int").alias("rn"))


@query
def t1_cross_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.matched_units(fx.instances(spark, sf_dir))


@query
def t1_cross_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.alignment_proof(t1_cross_match(spark, sf_dir))


# -- group concordance ------------------------------------------------------------------------------------------------


@query
def centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = V.moments(_rep(spark, sf_dir), ["dataset", "cell_line", "perturbation_type", "perturbation_gene", "representation"])
    long = got.select("dataset", "cell_line", "perturbation_type", "perturbation_gene", "representation", "n", F.posexplode("mean").alias("dim", "mean"))
    return long.withColumn("mean", F.col("mean")).withColumn("n", F.col("n").cast("bigint"))


@query
def cosine_pcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group.task2_wide(_rep(spark, sf_dir)).select(*cohort.UNIT2, "representation", "cosine_centroid", "pcc_centroid")


@query
def e_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group.task2_wide(_rep(spark, sf_dir)).select(*cohort.UNIT2, "representation", "n_a", "n_b", "underpowered_for_e_distance", "e_distance")


@query
def t1_group_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group.task1_long(_rep(spark, sf_dir))


@query
def t2_group_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group.task2_long(_rep(spark, sf_dir))


@query
def t2_group_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group.task2_leaderboard(group.task2_wide(_rep(spark, sf_dir)))


# -- retrieval --------------------------------------------------------------------------------------------------------

RANKED = ["gallery_size", "n_positive_keys", "rank_true", *(f"{m}_{k}" for k in ("raw", "corrected") for m in retrieval.NAMES)]


@query
def loo_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = retrieval.loo_centroids(_rep(spark, sf_dir))
    return got.select("instance_id", "representation", F.posexplode("loo").alias("dim", "mean")).withColumn("mean", F.col("mean"))


@query
def t1_retrieval_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = retrieval.task1_internal(_rep(spark, sf_dir))
    return got.select("dataset", "perturbation_type", "representation", "query_instance_id", "cell_line", "perturbation_gene", *RANKED)


@query
def t1_cross_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = retrieval.task1_cross(_rep(spark, sf_dir))
    return got.select("perturbation_type", "representation", "query_instance_id", "cell_line", "perturbation_gene", *RANKED)


def _task2(spark: SparkSession, sf_dir: str, direction: str) -> DataFrame:
    got = retrieval.task2(_rep(spark, sf_dir), direction)
    return got.select("dataset", "cell_line", "direction", "representation", "query_instance_id", "anchor_gene", "perturbation_gene", *RANKED)


@query
def c2g_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _task2(spark, sf_dir, "C2G")


@query
def g2c_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _task2(spark, sf_dir, "G2C")


@query
def chance_expectation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For galleries as large as each unit has members, with one and two positives."""
    members = fx.instances(spark, sf_dir).groupBy(*cohort.UNIT1).agg(F.count("*").alias("gallery_size")).select("gallery_size").distinct()
    sizes = members.select("gallery_size", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(2).cast("bigint"), F.col("gallery_size")))).alias("n_positive_keys"))
    got = chance.expectation_columns(sizes)
    return got.select("gallery_size", "n_positive_keys", *(F.col(f"e_{m}").alias(f"e_{m}") for m in retrieval.NAMES))


T1_SLICE = ["dataset", "perturbation_type", "representation"]


@query
def t1_retrieval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rep = _rep(spark, sf_dir)
    totals = rep.groupBy(*T1_SLICE).agg(F.count("*").alias("n_total"))
    return summary.task1_summary(retrieval.task1_internal(rep), totals, T1_SLICE)


@query
def t1_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.leaderboard_long(retrieval.task1_internal(_rep(spark, sf_dir)), T1_SLICE)


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c2g_per_query(spark, sf_dir).unionByName(g2c_per_query(spark, sf_dir))


@query
def t2_retrieval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.task2_summary_long(_both(spark, sf_dir))


@query
def t2_retrieval_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.task2_leaderboard(_both(spark, sf_dir))


# -- synthesis --------------------------------------------------------------------------------------------------------


@query
def t2_benchmark_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.task2_benchmark(t2_group_leaderboard(spark, sf_dir), t2_retrieval_leaderboard(spark, sf_dir))


def _task1_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = group.task1_long(_rep(spark, sf_dir)).groupBy("representation", F.concat(F.lit("mean_"), "metric_name").alias("metric_name")).agg(F.avg("metric_value").alias("metric_value"))
    ranked = t1_leaderboard(spark, sf_dir).groupBy("representation", "metric_name").agg(F.avg("metric_value").alias("metric_value"))
    return grouped.withColumn("analysis_family", F.lit("group")).unionByName(ranked.withColumn("analysis_family", F.lit("retrieval")))


@query
def axis_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.axis_inputs(_task1_benchmark(spark, sf_dir), t2_benchmark_summary(spark, sf_dir))


@query
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.scorecard(axis_inputs(spark, sf_dir))


def _stages(spark: SparkSession, sf_dir: str) -> str:
    """Three stages over the tables at hand, run and committed; the folder of their runs."""
    root = f"{scratch.fresh(spark, 'run')}/runs"
    spine, pairs = fmdelta.clean_spine(fx.delta_meta(spark, sf_dir)), fmdelta.clean_pairs(fx.pair_list(spark, sf_dir))

    def run(task: str, name: str, table_: DataFrame, keys: list[str], *checks: audit.Assertion) -> None:
        stage = stages.Stage(spark, root, "r1", task, name, inputs=[f"{sf_dir}/embeddings.parquet"], allowed=[sf_dir])
        stage.table(table_, f"{name}_table", keys, [])
        for c in checks:
            stage.check(c)
        stage.commit()

    run("task1", "S1", spine, ["row_id"], audit.row_ids_contiguous(spine))
    run("task2", "S3", fmdelta.groups(pairs).drop("controls"), fmdelta.KEY, audit.none_of(fmdelta.missing_keys(spine, pairs).select("row_id", *fmdelta.KEY), "delta_rows_have_pair_keys"))
    run("task2", "S4", cohort.coverage(cohort.membership(fx.instances(spark, sf_dir))), list(cohort.UNIT2))
    return root


@query
def input_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages that may enter the synthesis, from the files they committed: no gate failed and no file changed since."""
    return stages.registry(spark, _stages(spark, sf_dir)).where("refused IS NULL").drop("refused")


@query
def stage_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every assertion that the stages put on record, by gate."""
    got = stages.assertions(spark, _stages(spark, sf_dir))
    return got.select("run_id", "stage_name", "gate", "name", "pass", F.size("counterexamples").alias("n_counterexamples"))


# -- panels -----------------------------------------------------------------------------------------------------------


@query
def panel_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.composition(fx.instances(spark, sf_dir), ["dataset", "cell_line", "perturbation_type"])


@query
def panel_scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    internal = group.long(group.task1_internal(_rep(spark, sf_dir)))
    return panels.shared_scoreboard(internal, ["dataset_or_direction", "cell_line", "perturbation_type", "perturbation_gene"])


@query
def panel_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.paired(t2_group_long(spark, sf_dir), list(cohort.UNIT2), ["dataset", "cell_line"])


@query
def panel_degradation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rep = _rep(spark, sf_dir)
    return panels.degradation(group.long(group.task1_internal(rep)), group.long(group.task1_cross(rep)))


@query
def panel_paired_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paired panel beside the p values of its differences."""
    long, unit, by = t2_group_long(spark, sf_dir), list(cohort.UNIT2), ["dataset", "cell_line"]
    tests = panels.significance(long, unit, by).drop("n_pairs")
    return panels.with_significance(panels.paired(long, unit, by), tests, [*by, "metric_name"]).select(*by, "metric_name", "n_pairs", "mean_difference", "p_value", "method")


@query
def panel_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.enrichment(t2_group_long(spark, sf_dir), "anchor_gene", ["representation", "metric_name"])


@query
def panel_enrichment_cell_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.enrichment(t2_group_long(spark, sf_dir), "cell_line", ["dataset", "representation", "metric_name"])


@query
def panel_enrichment_gene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.enrichment(group.long(group.task1_internal(_rep(spark, sf_dir))), "perturbation_gene", ["representation", "metric_name"])


@query
def panel_fm_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = t2_retrieval_summary(spark, sf_dir).select("dataset", "cell_line", "direction", "representation", "metric_name", "metric_value")
    return panels.local_models(board)


# -- deltas -----------------------------------------------------------------------------------------------------------


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmdelta.clean_pairs(fx.pair_list(spark, sf_dir))


def _spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmdelta.clean_spine(fx.delta_meta(spark, sf_dir))


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmdelta.deltas(_spine(spark, sf_dir), _pairs(spark, sf_dir), fx.cells(spark, sf_dir))


@query
def pair_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmdelta.groups(_pairs(spark, sf_dir)).select("dataset_side", "treated_cell_id", F.array_join("controls", ",").alias("controls"), "n_controls")


@query
def pair_contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmdelta.contract_violations(_pairs(spark, sf_dir))


@query
def missing_pair_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmdelta.missing_keys(_spine(spark, sf_dir), _pairs(spark, sf_dir)).select("row_id", "dataset_side", "treated_cell_id")


@query
def required_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmdelta.required_ids(_spine(spark, sf_dir), _pairs(spark, sf_dir))


@query
def required_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmdelta.presence(required_ids(spark, sf_dir), fx.cells(spark, sf_dir))


@query
def reindexed_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = fmdelta.reindexed(required_ids(spark, sf_dir), fx.cells(spark, sf_dir))
    return got.select("dataset_side", "cell_id", V.total(F.col("vec")).alias("total"))


@query
def first_of_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell twice, the second time with another vector."""
    cells = fx.cells(spark, sf_dir).withColumn("pos", F.col("cell_id").cast("bigint"))
    again = cells.withColumns({"vec": F.transform("vec", lambda v: v + 1), "pos": F.col("pos") + 1_000_000_000})
    got = fmdelta.first_of_duplicates(again.unionByName(cells))
    return got.select("dataset_side", "cell_id", V.total(F.col("vec")).alias("total"))


@query
def control_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = fmdelta.control_means(_pairs(spark, sf_dir), fx.cells(spark, sf_dir)).where("controls_ok")
    long = got.select("dataset_side", "treated_cell_id", "n_controls", F.posexplode("control_mean").alias("dim", "mean"))
    return long.withColumn("mean", F.col("mean"))


@query
def fm_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _deltas(spark, sf_dir)
    d = F.col("delta")
    return got.select("row_id", "treated_cell_id", "dataset_side", "n_controls_used", "valid_mask", "invalid_reason", V.total(d).alias("delta_sum"), F.sqrt(V.dot(d, d)).alias("delta_norm"), F.lit("stub").alias("model_name"), F.lit(619).alias("seed"))


@query
def invalid_reason_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmdelta.reason_counts(_deltas(spark, sf_dir))


@query
def row_id_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.row_ids(_spine(spark, sf_dir))


@query
def audit_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assertions as rows, each computed from the tables."""
    spine, pairs = _spine(spark, sf_dir), _pairs(spark, sf_dir)
    delta = _deltas(spark, sf_dir)
    ids = audit.row_ids(spine).select(F.lit("row_id_contiguous").alias("name"), F.col("contiguous").alias("pass"), F.lit(0).cast("bigint").alias("n_bad"))
    zero = lambda df, name: df.agg(F.count("*").alias("n_bad")).select(F.lit(name).alias("name"), (F.col("n_bad") == 0).alias("pass"), "n_bad")
    sound = delta.where((F.col("valid_mask") & ~V.finite("delta")) | (~F.col("valid_mask") & F.col("delta").isNotNull()))
    kept = spine.join(delta.select("row_id"), "row_id", "left_anti")
    return summary.stacked([ids, zero(fmdelta.contract_violations(pairs), "pair_group_contract"), zero(fmdelta.missing_keys(spine, pairs), "delta_rows_have_pair_keys"), zero(sound, "delta_finite_or_null"), zero(kept, "rows_preserved")])


# -- counts -----------------------------------------------------------------------------------------------------------


def _genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source columns in order, several to a target: the brand without its last digit."""
    brands = table(spark, sf_dir, "part", ["p_brand"]).distinct()
    n = F.regexp_replace("p_brand", "Brand#", "").cast("bigint")
    return brands.select(n.alias("src_pos"), F.col("p_brand").alias("gene_symbol"), F.expr("left(p_brand, 7)").alias("target"))


def _reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference order with a gene that occurs twice."""
    rows = [(i, f"Brand#{g}") for i, g in enumerate((3, 1, 2, 5, 1))]
    return spark.createDataFrame(rows, "pos bigint, gene string")


@query
def gene_map_ensembl(spark: SparkSession, sf_dir: str) -> DataFrame:
    genes = table(spark, sf_dir, "part", ["p_brand"]).select(F.col("p_brand").alias("gene_symbol"))
    return counts.mapped(genes, symbol_map(fx.gene_map(spark, sf_dir)))


@query
def gene_align_lastwins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.align_last_wins(fx.counts(spark, sf_dir), _genes(spark, sf_dir), _reference(spark, sf_dir))


@query
def gene_align_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.align_sum(fx.counts(spark, sf_dir), _genes(spark, sf_dir), _reference(spark, sf_dir))


def _mapped_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.counts(spark, sf_dir).join(gene_map_ensembl(spark, sf_dir).select("gene_symbol"), "gene_symbol", "left_semi")


@query
def libsize_log2(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = counts.log_normalised(_mapped_counts(spark, sf_dir))
    return got.select("cell_id", "gene_symbol", rounded(F.col("x")).alias("x"))


@query
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.tokens(libsize_log2(spark, sf_dir))


@query
def token_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences with their class token, as checksums over places."""
    genes = fx.gene_map(spark, sf_dir).where("ensembl_id LIKE 'ENSG%'").select(F.col("symbol").alias("at"), F.col("symbol").alias("gene"))
    where = positions(genes)
    got = counts.sequences(tokens(spark, sf_dir), where, where.count())
    places = F.aggregate(F.transform("sequence", lambda t, i: (t * (i + 1)).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return got.select("cell_id", "seq_len", "n_classes", F.get("sequence", F.col("seq_len") - 1).alias("class_token"), places.alias("checksum"))


@query
def filled_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part", ["p_partkey", "p_brand"])
    return part.select("p_partkey", canon.filled(F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand"))).alias("gene_symbol"))


@query
def token_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = counts.cell_stats(_mapped_counts(spark, sf_dir))
    return counts.runnable(counts.positive_tokens(stats, "a4"), 4)


@query
def zero_row_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.nonzero_cells(fx.counts(spark, sf_dir), gene_map_ensembl(spark, sf_dir)).select("cell_id", "n_genes")


@query
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.duplicates(table(spark, sf_dir, "orders", ["o_custkey"]), "o_custkey")


@query
def chunk_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fx.cells(spark, sf_dir).select("dataset_side", F.col("cell_id").cast("bigint").alias("cell_id"))
    return counts.chunks(cells, "cell_id", 64)


# -- files ----------------------------------------------------------------------------------------------------------------


@query
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delta metadata as a CSV whose ids need quotes, read back with a declared schema."""
    path = scratch.fresh(spark, "meta")
    quoted = F.concat(F.lit('say "'), "treated_cell_id", F.lit('", then'))
    sinks.write_csv(fx.delta_meta(spark, sf_dir).withColumn("treated_cell_id", quoted), path)
    back = tables.csv(spark, path, tables.DELTA_META)
    return back.select(canon.strict_bigint("row_id").alias("row_id"), "treated_cell_id", "dataset_side", canon.strict_bigint("n_controls_used").alias("n_controls_used"))


@query
def gene_list_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gene names of a TSV in upper case, by their place in the file."""
    path = scratch.fresh(spark, "genes")
    names = table(spark, sf_dir, "part", ["p_brand"]).distinct().select(F.lower("p_brand").alias("gene_name"), F.length("p_brand").alias("other"))
    names.coalesce(1).sortWithinPartitions("gene_name").select("other", "gene_name").write.option("header", True).option("sep", "\t").csv(path)
    return tables.gene_list(spark, path, upper=True)


@query
def cell_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell vectors kept as a matrix in numpy's form, the newest of two, beside their metadata by row number."""
    folder = scratch.fresh(spark, "cells")
    every = fx.instances(spark, sf_dir).select(F.col("instance_id").alias("pos"), "vec")
    npy.write_matrix(every.withColumn("vec", F.transform("vec", lambda v: -v)), f"{folder}/s_cell_embedding_a.npy", "pos", "vec")
    npy.write_matrix(every, f"{folder}/s_cell_embedding_b.npy", "pos", "vec")
    path = tables.newest(spark, [f"{folder}/s*cell_embedding*.npy", f"{folder}/s*.npy"])
    meta = fx.cells(spark, sf_dir).select(F.col("cell_id").alias(canon.id_column(["cell_id", "x"], "CRISPR")), "dataset_side", F.col("cell_id").cast("bigint").alias("pos"))
    got = npy.read_cells(spark, path, meta)
    return got.select("cell_id", "dataset_side", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("total"))


@query
def error_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long messages cut to their ends, and which of them speak of memory."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    kinds = F.array(F.lit(" CUDA error: no Memory"), F.lit(" Out Of Memory"), F.lit(" cuBLAS failed"), F.lit(" memory"), F.lit(" CUDA"))
    message = F.concat(canon.filled("text"), F.get(kinds, (F.col("doc_id") % 5).cast("int")))
    kept = canon.with_defaults(docs, ["cell_type"]).withColumn("tail", canon.tail(message))
    return kept.select("doc_id", F.length("tail").alias("n_chars"), F.md5("tail").alias("digest"), canon.out_of_memory(F.right("tail", F.lit(30))).alias("memory"), "cell_type")


@query
def leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members whose left-one-out centroid still holds them, per representation."""
    rep = _rep(spark, sf_dir)
    loo = retrieval.loo_centroids(rep)
    means = V.moments(rep, [*cohort.UNIT1, "representation"]).select(*cohort.UNIT1, "representation", F.col("mean").alias("unit_mean"))
    met = loo.join(means, [*cohort.UNIT1, "representation"])
    bad = audit.not_in_own_centroid(met).select("representation", F.lit(1).alias("bad"))
    each = met.select("representation", F.lit(0).alias("bad")).unionByName(bad).groupBy("representation")
    return each.agg(F.count_if(F.col("bad") == 0).alias("n_rows"), F.sum("bad").alias("n_leaks"))


@query
def stage_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifests of the tables that stages wrote."""
    kind = "table_name string, primary_key_fields array<string>, metric_columns array<string>, schema_version string"
    got = spark.read.option("multiLine", True).schema(kind).json(f"{_stages(spark, sf_dir)}/*/*/*.manifest.json")
    return got.select("table_name", F.array_join("primary_key_fields", ",").alias("keys"), F.size("metric_columns").alias("n_metrics"), "schema_version")


# -- embedders ------------------------------------------------------------------------------------------------------------


@query
def embed_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stub embedder over all cells with vectors: memory errors above 16 rows, two cells that always fail."""
    cells = fx.cells(spark, sf_dir).where("vec IS NOT NULL")
    return embed.embedded(cells, lambda: embed.StubEmbedder(bad=frozenset({"5", "10"})))


@query
def embed_run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fx.cells(spark, sf_dir).where("vec IS NOT NULL").select("dataset_side", F.col("cell_id").cast("bigint").alias("cell_id"))
    chunks = counts.chunks(cells, "cell_id", 64).withColumn("cell_id", F.col("cell_id").cast("string"))
    return embed.run_counts(embed_stub(spark, sf_dir), chunks)


@query
def embed_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 97th cell comes with half the dimensions: each side keeps the dimension of its first success and names the others."""
    cells = fx.cells(spark, sf_dir).where("vec IS NOT NULL")
    made = embed.embed_run(cells, lambda: embed.StubEmbedder(narrow=lambda c: int(c) % 97 == 0), order=F.col("cell_id").cast("bigint"))
    return made.select("dataset_side", "cell_id", F.when(F.col("vec").isNotNull(), F.size("vec")).alias("dim"), "error")


@query
def aligned_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs whose first id column is of no use: one side is found by its barcodes, in reverse order, one by position."""
    cells = fx.cells(spark, sf_dir).withColumn("pos", F.expr("CAST(cell_id AS BIGINT) DIV 2"))
    crispr = F.col("dataset_side") == "CRISPR"
    ids = {"cell_id": F.when(crispr, F.concat(F.lit("x"), "cell_id")), "barcode": F.when(crispr, F.col("cell_id")), "pos": F.when(crispr, 1_000_000_000 - F.col("pos")).otherwise(F.col("pos"))}
    got = fmdelta.aligned(cells.drop("vec"), cells.withColumns(ids))
    return got.select("dataset_side", "cell_id", V.total(F.col("vec")).alias("total"), "way")


@query
def npy_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deltas as one float32 matrix in numpy's form, read back by row number."""
    path = f"{scratch.fresh(spark, 'fm_delta')}.npy"
    npy.write_matrix(_deltas(spark, sf_dir), path)
    back = npy.read_matrix(spark, path).withColumn("valid", ~F.exists("vec", F.isnan))
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return back.select("row_id", "valid", F.when(F.col("valid"), total).alias("total"))


def queries() -> dict:
    return dict(FOUND)


def oracle_sql() -> dict[str, str]:
    return oracle.statements()
