"""Treated-minus-control deltas: pair groups, embeddings, the cascade of invalid reasons; no spine row is ever lost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.functions import canon
from concord.functions import vectors as V

#: Reasons in the order in which they are looked for.
REASONS = ("missing_pair_key", "n_controls_mismatch", "no_controls", "treated_embedding_missing_or_invalid", "control_embedding_missing_or_invalid", "delta_non_finite")
KEY = ["dataset_side", "treated_cell_id"]


def clean_pairs(pairs: DataFrame) -> DataFrame:
    return canon.with_side(pairs).select(
        "dataset_side", canon.normalized("treated_cell_id").alias("treated_cell_id"), canon.normalized("control_cell_id").alias("control_cell_id"),
        canon.strict_bigint("control_rank").alias("control_rank"), canon.strict_bigint("n_controls_used").alias("n_controls_used"),
    )


def clean_spine(meta: DataFrame) -> DataFrame:
    return canon.with_side(meta).select(
        canon.strict_bigint("row_id").alias("row_id"), canon.normalized("treated_cell_id").alias("treated_cell_id"), "dataset_side", canon.strict_bigint("n_controls_used").alias("n_controls_used")
    )


def groups(pairs: DataFrame) -> DataFrame:
    """Controls of each treated cell in rank order; equal ranks by id."""
    one = F.struct(F.col("control_rank").alias("rank"), F.col("control_cell_id").alias("id"))
    return pairs.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["id"]).alias("controls"), F.count("*").alias("n_controls"))


def contract_violations(pairs: DataFrame) -> DataFrame:
    """Groups whose stated number of controls varies or differs from their size."""
    each = pairs.groupBy(*KEY).agg(F.count("*").alias("n_controls"), F.count_distinct("n_controls_used").alias("n_stated"), F.max("n_controls_used").alias("stated"))
    return each.where("n_stated <> 1 OR n_controls <> stated")


def missing_keys(spine: DataFrame, pairs: DataFrame) -> DataFrame:
    return spine.join(pairs.select(*KEY).distinct(), KEY, "left_anti")


def required_ids(spine: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cells that have to be embedded per side: the spine's treated cells that have pairs, and their controls."""
    used = pairs.join(spine.select(*KEY).distinct(), KEY, "left_semi")
    treated = used.select("dataset_side", F.col("treated_cell_id").alias("cell_id"))
    return treated.union(used.select("dataset_side", F.col("control_cell_id").alias("cell_id"))).distinct()


def presence(required: DataFrame, cells: DataFrame) -> DataFrame:
    """Required cells by side, with those that the metadata has."""
    known = cells.select("dataset_side", "cell_id").distinct().withColumn("there", F.lit(True))
    joined = required.join(known, ["dataset_side", "cell_id"], "left")
    return joined.groupBy("dataset_side").agg(F.count("*").alias("n_required"), F.count_if(F.col("there")).alias("n_present"), F.count_if(F.col("there").isNull()).alias("n_missing"))


def first_of_duplicates(embeddings: DataFrame, position: str = "pos") -> DataFrame:
    """One vector per cell: the first by position."""
    return embeddings.groupBy("dataset_side", "cell_id").agg(F.min_by("vec", position).alias("vec"))


#: Columns that may hold a cell's id in an embedder's output, in the order in which they are tried.
OUTPUT_IDS = ("cell_id", "cell", "barcode", "obs_name", "obs_names", "Unnamed: 0")


def aligned(expected: DataFrame, outputs: DataFrame, pos: str = "pos") -> DataFrame:
    """Every expected cell with its vector from ``outputs``, and ``way``, how its side was aligned.

    All id columns of ``OUTPUT_IDS`` that ``outputs`` has are matched at once.  A side goes by the first that covers all its
    expected cells (``way`` is its name), else by the first that covers the most (``name:partial``, the rest stay without a
    vector).  Only where none covers any and both have as many rows is it by position, and else there is no vector
    (``none``).  Of outputs that share an id the first counts; a vector that is not finite is null.

    expected: dataset_side, cell_id, ``pos``; outputs: dataset_side, ``pos``, vec, id columns.  Positions are dense from 0."""
    names = [c for c in OUTPUT_IDS if c in outputs.columns]
    each = F.array(*(F.struct(F.lit(i).alias("rank"), F.col(f"`{c}`").cast("string").alias("id")) for i, c in enumerate(names))) if names else F.array().cast("array<struct<rank:int,id:string>>")
    ids = outputs.select("dataset_side", F.col(pos).alias("at"), F.inline(each)).where("id IS NOT NULL").groupBy("dataset_side", "rank", "id").agg(F.min("at").alias("at"))
    wanted = expected.select("dataset_side", "cell_id", F.col(pos).alias("own"))
    hits = wanted.select("dataset_side", "cell_id").distinct().join(ids.withColumnRenamed("id", "cell_id"), ["dataset_side", "cell_id"])
    cover = hits.groupBy("dataset_side", "rank").agg(F.count("*").alias("n"))
    sizes = wanted.groupBy("dataset_side").agg(F.count("*").alias("n_wanted"))
    given = outputs.groupBy("dataset_side").agg(F.count("*").alias("n_given"))
    best = cover.groupBy("dataset_side").agg(F.max(F.struct("n", (-F.col("rank")).alias("first"))).alias("best"))
    ways = sizes.join(given, "dataset_side", "left").join(best, "dataset_side", "left")
    rank = -F.col("best.first")
    label = F.get(F.array(*map(F.lit, names)), rank) if names else F.lit(None).cast("string")
    by_id = F.when(F.col("best.n") == F.col("n_wanted"), label).otherwise(F.concat(label, F.lit(":partial")))
    way = F.when(F.col("best").isNotNull(), by_id).when(F.col("n_given") == F.col("n_wanted"), "position").otherwise("none")
    ways = F.broadcast(ways.select("dataset_side", way.alias("way"), rank.alias("rank")))  # a row for each side
    placed = wanted.join(ways, "dataset_side").join(hits, ["dataset_side", "cell_id", "rank"], "left")
    placed = placed.withColumn("at", F.when(F.col("way") == "position", F.col("own")).otherwise(F.col("at")))
    vectors = outputs.select("dataset_side", F.col(pos).alias("at"), F.when(V.finite("vec"), F.col("vec")).alias("vec"))
    return placed.join(vectors, ["dataset_side", "at"], "left").select("dataset_side", "cell_id", "vec", "way")


def reindexed(expected: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Every expected cell; those without a vector have null."""
    return expected.join(embeddings, ["dataset_side", "cell_id"], "left")


def control_means(pairs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Per group: control_mean over finite control vectors, and whether all controls have one."""
    side = embeddings.select("dataset_side", F.col("cell_id").alias("control_cell_id"), "vec")
    met = pairs.select(*KEY, "control_cell_id").join(side, ["dataset_side", "control_cell_id"], "left").withColumn("ok", V.finite("vec"))
    sound = met.groupBy(*KEY).agg(F.bool_and("ok").alias("controls_ok"), F.count("*").alias("n_controls"))
    means = V.moments(met.where("ok"), KEY).select(*KEY, F.col("mean").alias("control_mean"))
    return sound.join(means, KEY, "left")


def deltas(spine: DataFrame, pairs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """row_id, treated_cell_id, dataset_side, n_controls_used, valid_mask, invalid_reason, delta (null if invalid)."""
    treated = embeddings.select("dataset_side", F.col("cell_id").alias("treated_cell_id"), F.col("vec").alias("treated"))
    full = spine.join(control_means(pairs, embeddings), KEY, "left").join(treated, KEY, "left")
    raw = F.zip_with("treated", "control_mean", lambda t, c: t - c)
    full = full.withColumn("raw", raw).withColumn("raw_ok", V.finite(F.transform("raw", lambda v: v.cast("float"))))
    n = F.col("n_controls")
    reason = (
        F.when(n.isNull(), REASONS[0])
        .when(n != F.col("n_controls_used"), REASONS[1])
        .when(F.col("n_controls_used") < 1, REASONS[2])
        .when(~V.finite("treated"), REASONS[3])
        .when(~F.col("controls_ok"), REASONS[4])
        .when(~F.col("raw_ok"), REASONS[5])
        .otherwise("")
    )
    full = full.withColumn("invalid_reason", reason).withColumn("valid_mask", F.col("invalid_reason") == "")
    return full.select("row_id", "treated_cell_id", "dataset_side", "n_controls_used", "valid_mask", "invalid_reason", F.when(F.col("valid_mask"), F.col("raw")).alias("delta"))


def meta(delta: DataFrame, model_name: str, seed: int = 619) -> DataFrame:
    return delta.drop("delta").withColumns({"model_name": F.lit(model_name), "seed": F.lit(seed)})


def reason_counts(delta: DataFrame, top: int = 10) -> DataFrame:
    """The most frequent invalid reasons, a top-k report."""
    return delta.where("invalid_reason <> ''").groupBy("invalid_reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "invalid_reason").limit(top)
