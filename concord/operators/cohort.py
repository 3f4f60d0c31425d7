"""Cohorts: membership, lawful units, splits, matching across datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concord.config import GLOBAL_SEED
from concord.functions import canon

UNIT1 = ("dataset", "cell_line", "perturbation_type", "perturbation_gene")
CROSS = ("cell_line", "perturbation_type", "perturbation_gene")
UNIT2 = ("dataset", "cell_line", "anchor_gene")


def membership(inst: DataFrame) -> DataFrame:
    """One row per instance and target gene; expansion happens here only."""
    return inst.withColumn("anchor_gene", F.explode(canon.targets("perturbation_gene")))


def coverage(members: DataFrame) -> DataFrame:
    """Members of each side per Task2 unit."""
    count = lambda kind: F.count_if(F.col("perturbation_type") == kind)
    return members.groupBy(*UNIT2).agg(count("chemical").alias("n_chem_instances"), count("genetic").alias("n_gen_instances"))


def lawful(covered: DataFrame) -> DataFrame:
    """Units with a chemical and a genetic member."""
    return covered.where("n_chem_instances >= 1 AND n_gen_instances >= 1")


def row_membership(inst: DataFrame) -> DataFrame:
    """Members of lawful Task2 units."""
    members = membership(inst)
    return members.join(lawful(coverage(members)).select(*UNIT2), list(UNIT2), "left_semi")


def hash_order(instance_id: str = "instance_id", seed: int = GLOBAL_SEED) -> list[Column]:
    """Deterministic order of members: by digest of seed and id, then by id."""
    return [F.md5(F.concat(F.lit(f"{seed}|"), F.col(instance_id).cast("string"))), F.col(instance_id)]


#: Rows of a unit that are ranked in one piece, and the caps up to which a unit's first members are found by pieces.
PIECE, CAP = 100_000, 1000


def ranked(inst: DataFrame, unit: tuple[str, ...] = UNIT1, seed: int = GLOBAL_SEED) -> DataFrame:
    """``rn`` 1.. within the unit in hash order, without a window over a whole unit.

    Digests are spread evenly, so their leading bits part a large unit into pieces of about ``PIECE`` rows that stand in
    hash order; a row's rank is its rank in its piece plus the rows of the pieces before."""
    sizes = inst.groupBy(*unit).agg(F.ceil(F.log2(F.count("*") / PIECE)).cast("int").alias("__bits")).where("__bits > 0")
    order = hash_order(seed=seed)
    lead = F.conv(F.substring(order[0], 1, 8), 16, 10).cast("bigint")
    large = sizes.select(*unit, F.least("__bits", F.lit(31)).alias("__bits")).alias("__s")
    base = inst.alias("__i")
    pieces = base.join(large, [F.col(f"__i.{c}").eqNullSafe(F.col(f"__s.{c}")) for c in unit], "left").select("__i.*", "__s.__bits")
    pieces = pieces.withColumn("__lead", lead).withColumn("__piece", F.when(F.col("__bits").isNotNull(), F.expr("shiftright(__lead, 32 - __bits)")).otherwise(F.lit(0).cast("bigint")))
    counts = pieces.where("__bits IS NOT NULL").groupBy(*unit, "__piece").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*unit).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*unit, "__piece", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inner = pieces.withColumn("rn", F.row_number().over(Window.partitionBy(*unit, "__piece").orderBy(*order))).alias("__i")
    met = inner.join(offsets.alias("__o"), [F.col(f"__i.{c}").eqNullSafe(F.col(f"__o.{c}")) for c in (*unit, "__piece")], "left")
    rn = (F.col("rn") + F.coalesce("__before", F.lit(0))).cast("bigint")
    return met.select(*(F.col(f"__i.{c}") for c in inst.columns if c != "rn"), rn.alias("rn"))


def split_half(inst: DataFrame, unit: tuple[str, ...] = UNIT1, seed: int = GLOBAL_SEED) -> DataFrame:
    """``side`` A or B, alternating in hash order within the unit."""
    return ranked(inst, unit, seed).withColumn("side", F.when(F.col("rn") % 2 == 1, "A").otherwise("B"))


def subsample(inst: DataFrame, cap: int, unit: tuple[str, ...] = UNIT1, seed: int = GLOBAL_SEED) -> DataFrame:
    """The first ``cap`` members of each unit in hash order; the sampling operator for capped distances.

    Up to ``CAP``, each unit is dealt over 64 pieces, only the first of every piece go on, and tasks limit both before they
    send; above that the ranks of ``ranked`` are compared."""
    if cap > CAP:
        return ranked(inst, unit, seed).where(F.col("rn") <= cap)
    order = hash_order(seed=seed)
    piece = F.pmod(F.xxhash64("instance_id"), F.lit(64))
    some = inst.withColumn("__piece", piece).withColumn("rn", F.row_number().over(Window.partitionBy(*unit, "__piece").orderBy(*order))).where(F.col("rn") <= cap)
    return some.drop("__piece").withColumn("rn", F.row_number().over(Window.partitionBy(*unit).orderBy(*order)).cast("bigint")).where(F.col("rn") <= cap)


def matched_units(inst: DataFrame, left: str = "LINCS", right: str = "scPerturb") -> DataFrame:
    """Units present in both datasets, with each side's members and the alignment key of its first."""
    n = lambda d: F.count_if(F.col("dataset") == d)
    first = lambda d: F.min(F.when(F.col("dataset") == d, F.col("instance_id")))
    sides = inst.groupBy(*CROSS).agg(n(left).alias("n_lincs"), n(right).alias("n_scperturb"), first(left).alias("global_idx_lincs"), first(right).alias("sc_delta_row_idx"))
    return sides.where("n_lincs > 0 AND n_scperturb > 0")


def alignment_proof(matched: DataFrame, direction: str = "LINCS_to_scPerturb") -> DataFrame:
    got = matched.groupBy("perturbation_type").agg(F.count("*").alias("n_matched_units"))
    keys = {"dataset_or_direction": F.lit(direction), "alignment_key_lincs": F.lit("global_idx_lincs"), "alignment_key_scperturb": F.lit("sc_delta_row_idx")}
    return got.withColumns(keys).select("dataset_or_direction", "perturbation_type", "alignment_key_lincs", "alignment_key_scperturb", "n_matched_units")


def registered(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows whose dataset, cell line and representation the registry lists."""
    return df.join(registry, ["dataset", "cell_line", "representation"], "left_semi")


def registry(rep: DataFrame) -> DataFrame:
    """Representations available per dataset and cell line, with the number of instances."""
    return rep.groupBy("dataset", "cell_line", "representation").agg(F.count("*").alias("n_instances"))


def inventory(inst: DataFrame) -> DataFrame:
    return inst.groupBy("dataset", "cell_line", "perturbation_type").agg(F.count("*").alias("n_instances"), F.count_distinct("perturbation_gene").alias("n_units"))
