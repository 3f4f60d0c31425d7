"""Group concordance: centroids of two sides compared by cosine, Pearson and bias-corrected energy distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions import vectors as V
from concord.operators import cohort

METRICS = ("cosine_centroid", "pcc_centroid", "e_distance")


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded, and never negative zero, so results do not depend on the order of summation."""
    return F.round(c, digits) + F.lit(0.0)


def sides(df: DataFrame, unit: list[str], side: str = "side", labels: tuple[str, str] = ("A", "B"), max_n: int | None = None) -> DataFrame:
    """One row per unit and representation: counts, means and spreads of both sides (null where a side is absent).

    With ``max_n`` the distance uses the first ``max_n`` members of a side in hash order; means use all."""
    keys = [*unit, "representation"]
    got = V.moments(df, [*keys, side])
    sub = V.moments(cohort.subsample(df, max_n, tuple([*keys, side])), [*keys, side]).withColumnsRenamed({"n": "n_sub", "mean": "mean_sub", "spread": "spread_sub"}) if max_n else None
    got = got.join(sub, [*keys, side]) if sub else got.select("*", F.col("n").alias("n_sub"), F.col("mean").alias("mean_sub"), F.col("spread").alias("spread_sub"))
    pick = lambda c, s: F.any_value(F.when(F.col(side) == s, F.col(c)), ignoreNulls=True).alias(f"{c}_{s}")
    return got.groupBy(*keys).agg(*(pick(c, s) for s in labels for c in ("n", "mean", "n_sub", "mean_sub", "spread_sub")))


def concordance(df: DataFrame, unit: list[str], side: str = "side", labels: tuple[str, str] = ("A", "B"), max_n: int | None = None) -> DataFrame:
    """Wide metrics of units that have both sides; ``underpowered_for_e_distance`` where a side has one member."""
    a, b = labels
    both = sides(df, unit, side, labels, max_n).where(F.col(f"n_{a}").isNotNull() & F.col(f"n_{b}").isNotNull())
    c = lambda name, s: F.col(f"{name}_{s}")
    return both.select(
        *unit, "representation", c("n", a).alias("n_a"), c("n", b).alias("n_b"), c("n_sub", a).alias("n_a_sub"), c("n_sub", b).alias("n_b_sub"),
        (F.least(c("n_sub", a), c("n_sub", b)) < 2).alias("underpowered_for_e_distance"),
        V.cosine(c("mean", a), c("mean", b)).alias("cosine_centroid"), V.pearson(c("mean", a), c("mean", b)).alias("pcc_centroid"),
        V.e_distance(c("mean_sub", a), c("mean_sub", b), c("n_sub", a), c("n_sub", b), c("spread_sub", a), c("spread_sub", b)).alias("e_distance"),
    )


def long(wide: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """One row per metric."""
    ids = [c for c in wide.columns if c not in metrics]
    return wide.unpivot(ids, list(metrics), "metric_name", "metric_value")


def task1_internal(rep: DataFrame, max_n: int | None = None) -> DataFrame:
    """Split halves of every internal unit."""
    split = cohort.split_half(rep, (*cohort.UNIT1, "representation"))
    wide = concordance(split, list(cohort.UNIT1), max_n=max_n)
    return wide.withColumn("scope", F.lit("internal")).withColumnRenamed("dataset", "dataset_or_direction")


def task1_cross(rep: DataFrame, max_n: int | None = None) -> DataFrame:
    """Units present in both datasets, one dataset against the other."""
    wide = concordance(rep, list(cohort.CROSS), "dataset", ("LINCS", "scPerturb"), max_n)
    return wide.withColumn("scope", F.lit("cross")).withColumn("dataset_or_direction", F.lit("LINCS_to_scPerturb"))


def task1_long(rep: DataFrame, max_n: int | None = None) -> DataFrame:
    both = task1_internal(rep, max_n).unionByName(task1_cross(rep, max_n))
    n = {"n_instances_used": F.col("n_a") + F.col("n_b"), "n_instances_subsampled": F.col("n_a_sub") + F.col("n_b_sub")}
    both = both.withColumns(n).drop("n_a_sub", "n_b_sub").withColumnsRenamed({"n_a": "n_instances_split_a", "n_b": "n_instances_split_b"})
    return long(both)


def task2_wide(rep: DataFrame, max_n: int | None = None) -> DataFrame:
    """Chemical against genetic members of every lawful unit; the comparison itself needs both, so it tests lawfulness."""
    return concordance(cohort.membership(rep), list(cohort.UNIT2), "perturbation_type", ("chemical", "genetic"), max_n)


def task2_long(rep: DataFrame, max_n: int | None = None) -> DataFrame:
    names = {"n_a": "n_chem_instances_used", "n_b": "n_gen_instances_used", "n_a_sub": "n_chem_sub", "n_b_sub": "n_gen_sub"}
    return long(task2_wide(rep, max_n).withColumnsRenamed(names))


def task2_leaderboard(wide: DataFrame) -> DataFrame:
    return wide.groupBy("dataset", "cell_line", "representation").agg(*(F.avg(m).alias(f"mean_{m}") for m in METRICS))
