"""Centroid retrieval: the rank of a query's true centroid in a gallery, with chance-corrected metrics.

A query never meets the gallery in a sorted window: its best positive is found by an equi-join on the unit, and the
rank is one more than the number of gallery entries that come before it, counted by blocked matrix products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions import chance
from concord.functions import vectors as V
from concord.operators import blocked, cohort

NAMES = ("mrr", "hit1", "hit3", "hit5")


def prepared(df: DataFrame, vector: str, kind: str) -> DataFrame:
    """``df`` with its vectors as ``similarity`` takes them: for cosine of length one, null for a zero vector."""
    return df.withColumn(vector, V.unit(vector)) if kind == "cosine" else df


def similarity(q: Column, g: Column, kind: str) -> Column:
    """Of prepared vectors, rounded to nine digits, so that ties do not hang on the order of summation; null for a zero vector."""
    value = V.dot(q, g) if kind == "cosine" else -F.sqrt(V.distance2(q, g))
    return F.round(value, 9)


def per_query(queries: DataFrame, gallery: DataFrame, slice_: list[str], positives: DataFrame, kind: str = "cosine", correction: str = "difference") -> DataFrame:
    """Ranks and metrics, one row per query that has a positive with a similarity.

    queries: query_instance_id, ``slice_`` columns, vec and whatever else is carried.  gallery: ``slice_``, key, mean.
    positives: query_instance_id, representation, key, mean, the positive as this query must see it (left-one-out if need be)."""
    ids = ["query_instance_id", "representation"]
    queries, gallery, positives = prepared(queries, "vec", kind), prepared(gallery, "mean", kind), prepared(positives, "mean", kind)
    own = queries.select(*ids, "vec").join(positives, ids).withColumn("sim", similarity(F.col("vec"), F.col("mean"), kind))
    first = F.min(F.when(F.col("sim").isNotNull(), F.struct((-F.col("sim")).alias("low"), "key")))
    best = own.groupBy(*ids).agg(first.alias("best"), F.collect_set("key").alias("own_keys"), F.count("*").alias("n_positive_keys"))
    known = queries.join(best.where("best IS NOT NULL"), ids)
    asked = known.select("query_instance_id", *slice_, "vec", (-F.col("best.low")).alias("beat"), F.col("best.key").alias("best_key"), "own_keys")
    ranks = blocked.counts(asked, gallery.select(*slice_, "key", "mean"), slice_, kind).select(*ids, "gallery_size", (F.col("n_ahead") + 1).alias("rank_true"))
    return metrics(known.drop("vec", "own_keys", "best").join(ranks, ids), correction)


def metrics(df: DataFrame, correction: str = "difference") -> DataFrame:
    """Raw and chance-corrected metrics from rank_true, gallery_size and n_positive_keys."""
    rank = F.col("rank_true")
    raw = {"mrr": 1 / rank, **{f"hit{h}": (rank <= h).cast("double") for h in chance.HITS}}
    full = chance.expectation_columns(df).withColumns({f"{m}_raw": (c) for m, c in raw.items()})
    full = full.withColumns({f"{m}_corrected": chance.corrected(raw[m], F.col(f"e_{m}"), correction) for m in NAMES})
    return full.drop(*(f"e_{m}" for m in NAMES))


def centroids(df: DataFrame, keys: list[str], key: str) -> DataFrame:
    got = V.moments(df, [*keys, "representation"])
    return got.withColumnRenamed(key, "key") if key != "key" else got


def task1_internal(rep: DataFrame, kind: str = "cosine", correction: str = "difference", scope: tuple[str, ...] = ("cell_line",)) -> DataFrame:
    """Single instances against the unit centroids of their dataset, type and ``scope``; the own centroid leaves the query out."""
    slice_ = ["dataset", "perturbation_type", *scope, "representation"]
    unit = ["dataset", "perturbation_type", "cell_line"]
    stats = V.moments(rep, [*unit, "perturbation_gene", "representation"])
    # over several cell lines a gallery key must name its line
    key = F.col("perturbation_gene") if "cell_line" in scope else F.concat_ws("/", "cell_line", "perturbation_gene")
    queries = rep.withColumnRenamed("instance_id", "query_instance_id").withColumn("key", key)
    gallery = stats.withColumn("key", key).where("n >= 2")
    own = queries.join(gallery.select(*unit, "representation", "key", "n", "mean"), [*unit, "representation", "key"])
    left_out = F.zip_with("mean", "vec", lambda m, x: (m * F.col("n") - x) / (F.col("n") - 1))
    positives = own.select("query_instance_id", "representation", "key", left_out.alias("mean"))
    return per_query(queries.drop("key"), gallery, slice_, positives, kind, correction)


def task1_cross(rep: DataFrame, kind: str = "cosine", correction: str = "difference") -> DataFrame:
    """LINCS instances against scPerturb centroids over matched units of their cell line and type."""
    matched = cohort.matched_units(rep.where("representation = 'Gene'")).select(*cohort.CROSS)
    slice_ = ["perturbation_type", "cell_line", "representation"]
    members = rep.join(matched, list(cohort.CROSS), "left_semi")
    gallery = centroids(members.where("dataset = 'scPerturb'"), ["perturbation_type", "cell_line", "perturbation_gene"], "perturbation_gene")
    queries = members.where("dataset = 'LINCS'").withColumnRenamed("instance_id", "query_instance_id")
    own = queries.withColumn("key", F.col("perturbation_gene")).join(gallery, [*slice_, "key"])
    return per_query(queries, gallery, slice_, own.select("query_instance_id", "representation", "key", "mean"), kind, correction)


def task2(rep: DataFrame, direction: str, kind: str = "cosine", correction: str = "difference") -> DataFrame:
    """C2G: chemical instances against genetic centroids; G2C: genetic ones against chemical centroids; by anchor gene."""
    asks, answers = ("chemical", "genetic") if direction == "C2G" else ("genetic", "chemical")
    slice_ = ["dataset", "cell_line", "representation"]
    members = cohort.membership(rep)
    law = cohort.lawful(cohort.coverage(members.where("representation = 'Gene'"))).select(*cohort.UNIT2)
    members = members.join(law, list(cohort.UNIT2), "left_semi")
    gallery = centroids(members.where(F.col("perturbation_type") == answers), list(cohort.UNIT2), "anchor_gene")
    asking = members.where(F.col("perturbation_type") == asks).withColumnRenamed("instance_id", "query_instance_id")
    own = asking.withColumn("key", F.col("anchor_gene")).join(gallery, [*slice_, "key"]).select("query_instance_id", "representation", "key", "mean")
    anchors = asking.groupBy("query_instance_id", "representation").agg(F.array_join(F.array_sort(F.collect_set("anchor_gene")), "|").alias("anchor_gene"))
    queries = rep.where(F.col("perturbation_type") == asks).withColumnRenamed("instance_id", "query_instance_id").join(anchors, ["query_instance_id", "representation"])
    return per_query(queries, gallery, slice_, own, kind, correction).withColumn("direction", F.lit(direction))


def loo_centroids(rep: DataFrame, unit: tuple[str, ...] = cohort.UNIT1) -> DataFrame:
    """Every instance with the centroid of its unit without it, by (S - x)/(n - 1); units of one member have none."""
    stats = V.moments(rep, [*unit, "representation"]).where("n >= 2")
    joined = rep.join(stats, [*unit, "representation"])
    return joined.withColumn("loo", F.zip_with("mean", "vec", lambda m, x: (m * F.col("n") - x) / (F.col("n") - 1))).drop("mean", "spread")
