"""Plot-ready panel tables; pairing, thresholds and ranks are made here, so a renderer computes nothing."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


MIN_PAIRS = 3
MIN_SUPPORT = 3


def composition(df: DataFrame, keys: list[str]) -> DataFrame:
    """Support by slice."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def shared_scoreboard(long: DataFrame, unit: list[str]) -> DataFrame:
    """Mean metric per representation over units that all representations have."""
    n = long.select("representation").distinct().agg(F.count("*").alias("reps"))
    valued = long.where("metric_value IS NOT NULL")
    full = valued.groupBy(*unit, "metric_name").agg(F.count_distinct("representation").alias("has")).join(F.broadcast(n), F.col("has") == F.col("reps"))  # one row
    kept = valued.join(full.select(*unit, "metric_name"), [*unit, "metric_name"], "left_semi")
    return kept.groupBy("representation", "metric_name").agg(F.count("*").alias("n_units"), F.avg("metric_value").alias("mean_value"))


def paired(long: DataFrame, unit: list[str], by: list[str], first: str = "Gene", second: str = "Pathway") -> DataFrame:
    """Paired differences between two representations; surfaces of fewer than three pairs are left out."""
    value = lambda r: F.any_value(F.when(F.col("representation") == r, F.col("metric_value")), ignoreNulls=True)
    each = long.groupBy(*dict.fromkeys([*unit, *by, "metric_name"])).agg(value(first).alias("a"), value(second).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    got = each.groupBy(*by, "metric_name").agg(F.count("*").alias("n_pairs"), F.avg("a").alias("mean_gene"), F.avg("b").alias("mean_pathway"), (F.avg(F.col("a") - F.col("b"))).alias("mean_difference"))
    return got.where(F.col("n_pairs") >= MIN_PAIRS)


def degradation(internal: DataFrame, cross: DataFrame) -> DataFrame:
    """Internal against cross values of matched units: the LINCS unit by itself, and the same unit across datasets."""
    keys = ["cell_line", "perturbation_type", "perturbation_gene", "representation", "metric_name"]
    a = internal.where("dataset_or_direction = 'LINCS' AND metric_value IS NOT NULL").select(*keys, F.col("metric_value").alias("a"))
    b = cross.where("metric_value IS NOT NULL").select(*keys, F.col("metric_value").alias("b"))
    both = a.join(b, keys)
    return both.groupBy("perturbation_type", "representation", "metric_name").agg(F.count("*").alias("n_units"), F.avg("a").alias("mean_internal"), F.avg("b").alias("mean_cross"), (F.avg(F.col("b") - F.col("a"))).alias("mean_change"))


def enrichment(long: DataFrame, entity: str, slice_: list[str]) -> DataFrame:
    """Entities by ``pair_mean_enrichment``: the mean of (value - mean of its slice), signed; at least three values."""
    valued = long.where("metric_value IS NOT NULL")
    means = valued.groupBy(*slice_).agg(F.avg("metric_value").alias("slice_mean"))
    keys = list(dict.fromkeys([*slice_, entity]))
    each = valued.groupBy(*keys).agg(F.sum("metric_value").alias("total"), F.count("*").alias("support_n")).join(means, slice_)
    got = each.where(F.col("support_n") >= MIN_SUPPORT).withColumn("pair_mean_enrichment", (F.col("total") / F.col("support_n") - F.col("slice_mean")))
    order = Window.partitionBy(*slice_).orderBy(F.round("pair_mean_enrichment", 9).desc(), entity)
    return got.withColumn("rank", F.row_number().over(order)).select(*keys, "support_n", "pair_mean_enrichment", "rank")


def local_models(board: DataFrame, dataset: str = "scPerturb", cell_line: str = "K562", baseline: str = "Gene") -> DataFrame:
    """Absolute values of one approved scope beside the baseline representation's."""
    own = board.where((F.col("dataset") == dataset) & (F.col("cell_line") == cell_line))
    base = own.where(F.col("representation") == baseline).select("direction", "metric_name", F.col("metric_value").alias("baseline_value"))
    return own.join(base, ["direction", "metric_name"], "left").select("direction", "representation", "metric_name", "metric_value", "baseline_value")


#: Pairs up to which all signs are tried.
EXACT = 12


def significance(long: DataFrame, unit: list[str], by: list[str], draws: int = 999, seed: int = 619, first: str = "Gene", second: str = "Pathway") -> DataFrame:
    """p_value of each panel's mean paired difference under random signs, two-sided; panels as ``paired`` has them.

    Up to ``EXACT`` pairs all signs are enumerated.  Above, ``draws`` sets of signs are hashes of (seed, unit, draw), so a
    unit's signs are its own wherever it lies; each row brings its signed difference for all draws at once, summed in one
    buffer per panel and task.  Sums count as equal if they are so to nine digits."""
    value = lambda r: F.any_value(F.when(F.col("representation") == r, F.col("metric_value")), ignoreNulls=True)
    names = [*dict.fromkeys([*unit, *by, "metric_name"])]
    panel = [*by, "metric_name"]
    each = long.groupBy(*names).agg(value(first).alias("a"), value(second).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").withColumn("d", F.col("a") - F.col("b"))
    sizes = each.groupBy(*panel).agg(F.count("*").alias("n_pairs"), F.sum("d").alias("total")).where(F.col("n_pairs") >= MIN_PAIRS)
    met = each.join(sizes, panel)
    far = lambda x, total: F.round(F.abs(x), 9) >= F.round(F.abs(total), 9)
    few = met.where(F.col("n_pairs") <= EXACT).groupBy(*panel).agg(F.first("n_pairs").alias("n_pairs"), F.first("total").alias("total"), F.array_sort(F.collect_list("d")).alias("ds"))
    signed = lambda j: F.aggregate(F.transform("ds", lambda d, i: F.when(F.getbit(j, i) == 1, -d).otherwise(d)), F.lit(0.0), lambda s, x: s + x)
    all_ = F.expr("shiftleft(1L, CAST(n_pairs AS INT))")
    hits = F.size(F.filter(F.transform(F.sequence(F.lit(0).cast("bigint"), all_ - 1), signed), lambda x: far(x, F.col("total"))))
    exact = few.select(*panel, "n_pairs", (hits / all_).alias("p_value"), F.lit("exact").alias("method"))
    key = F.concat_ws("\u001f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names))
    flips = F.transform(F.sequence(F.lit(1), F.lit(draws)), lambda j: F.when(F.xxhash64(F.lit(seed), F.col("__key"), j) % 2 == 0, F.col("d")).otherwise(-F.col("d")))
    many = met.where(F.col("n_pairs") > EXACT).withColumn("__key", key).withColumn("__v", array_to_vector(flips))
    sums = many.groupBy(*panel).agg(F.first("n_pairs").alias("n_pairs"), F.first("total").alias("total"), vector_to_array(Summarizer.sum(F.col("__v"))).alias("s"))
    hits = F.size(F.filter("s", lambda x: far(x, F.col("total"))))
    drawn = sums.select(*panel, "n_pairs", ((1 + hits) / F.lit(1 + draws)).alias("p_value"), F.lit("drawn").alias("method"))
    return exact.unionByName(drawn)


def with_significance(panel: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Panel rows beside test results made elsewhere; rows without one stay."""
    return panel.join(results, keys, "left")
