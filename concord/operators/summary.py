"""Summaries, leaderboards and the synthesis tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.operators import group
from concord.operators.retrieval import NAMES

CORRECTED = tuple(f"{m}_corrected" for m in NAMES)


def task1_summary(ranked: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Denominators per slice; ``totals`` is (keys, n_total), all queries asked, excluded ones too."""
    got = ranked.groupBy(*keys).agg(F.count("*").alias("n_valid"), F.avg("gallery_size").alias("gallery_size_mean"), F.max("gallery_size").alias("gallery_size_max"))
    both = totals.join(got, keys, "left").withColumn("n_valid", F.coalesce("n_valid", F.lit(0)))
    return both.select(*keys, "n_total", "n_valid", (F.col("n_total") - F.col("n_valid")).alias("n_excluded"), "gallery_size_mean", "gallery_size_max")


def leaderboard_long(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """Mean corrected metrics per slice, one row each."""
    means = ranked.groupBy(*keys).agg(*(F.avg(m).alias(f"mean_{m}") for m in CORRECTED))
    return means.unpivot(keys, [f"mean_{m}" for m in CORRECTED], "metric_name", "metric_value")


def task2_summary_long(ranked: DataFrame) -> DataFrame:
    keys = ["dataset", "cell_line", "direction", "representation"]
    names = [f"{m}_{k}" for k in ("raw", "corrected") for m in NAMES]
    over = ranked.groupBy(*keys).agg(
        F.count("*").alias("n_valid"), F.avg("gallery_size").alias("gallery_size_mean"), F.max("gallery_size").alias("gallery_size_max"),
        F.avg("n_positive_keys").alias("n_positive_keys_mean"), *(F.avg(m).alias(f"mean_{m}") for m in names),
    )
    ids = [*keys, "n_valid", "gallery_size_mean", "gallery_size_max", "n_positive_keys_mean"]
    return over.unpivot(ids, [f"mean_{m}" for m in names], "metric_name", "metric_value")


def task2_leaderboard(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy("dataset", "cell_line", "direction", "representation").agg(*(F.avg(m).alias(f"mean_{m}") for m in CORRECTED))


def task2_benchmark(group_board: DataFrame, retrieval_board: DataFrame) -> DataFrame:
    """Group and retrieval summaries in one long table, denominators untouched; group rows have no direction."""
    keys = ["dataset", "cell_line", "representation"]
    a = group_board.unpivot(keys, [f"mean_{m}" for m in group.METRICS], "metric_name", "metric_value").withColumns({"analysis_family": F.lit("group"), "direction": F.lit("NA")})
    b = retrieval_board.unpivot([*keys, "direction"], [f"mean_{m}" for m in CORRECTED], "metric_name", "metric_value").withColumn("analysis_family", F.lit("retrieval"))
    return a.unionByName(b).select("analysis_family", "dataset", "cell_line", "direction", "representation", "metric_name", "metric_value")


def axis_inputs(task1: DataFrame, task2: DataFrame) -> DataFrame:
    """Scorecard inputs: per task, family and representation the mean of the benchmark values that lie on one scale.

    Distances are unbounded, so they are reported but not scored."""
    t1 = task1.select(F.lit("task1").alias("task_axis"), "analysis_family", "representation", "metric_name", "metric_value")
    t2 = task2.select(F.lit("task2").alias("task_axis"), "analysis_family", "representation", "metric_name", "metric_value")
    scored = t1.unionByName(t2).where("metric_name <> 'mean_e_distance'")
    family = F.concat_ws(":", "analysis_family", "metric_name").alias("family_id")
    return scored.groupBy("task_axis", family, "representation").agg(F.avg("metric_value").alias("metric_value"))


def scorecard(inputs: DataFrame) -> DataFrame:
    """Per representation the mean of each axis's families and the mean of both axes."""
    axes = inputs.groupBy("representation").pivot("task_axis", ["task1", "task2"]).agg(F.avg("metric_value"))
    named = {"task1_axis_value_raw": F.col("task1"), "task2_axis_value_raw": F.col("task2"), "overall_axis_value_raw": ((F.col("task1") + F.col("task2")) / 2)}
    return axes.select("representation", *(c.alias(n) for n, c in named.items()))


def passed_inputs(registry: DataFrame, assertions: DataFrame) -> DataFrame:
    """Stages all of whose assertions passed."""
    bad = assertions.where("NOT pass").select("task", "stage_name", "run_id").distinct()
    return registry.join(bad, ["task", "stage_name", "run_id"], "left_anti")


def stacked(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
