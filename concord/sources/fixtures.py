"""Stand-in inputs over the test tables: instances, cells, pairs, counts, gene map, targets, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions import vectors as V
from concord.sources.tables import table


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id AS instance_id",
        "IF(vec_id % 2 = 0, 'LINCS', 'scPerturb') AS dataset",
        "IF((vec_id DIV 2) % 2 = 0, 'chemical', 'genetic') AS perturbation_type",
        "IF((vec_id DIV 4) % 3 = 0, 'A549', 'K562') AS cell_line",
        """CASE WHEN (vec_id DIV 2) % 2 = 1 OR (vec_id DIV 12) % 2 = 0 THEN concat('G', label)
                WHEN label = 9 THEN 'G0|G9' ELSE concat('G', label, '|G', label + 1) END AS perturbation_gene""",
        "CAST(24 * (1 + vec_id % 3) AS STRING) AS time",
        "CAST(vec_id % 5 AS STRING) AS dose",
        "label",
        "transform(embedding, x -> CAST(x AS DOUBLE)) AS vec",
    )


def represented(inst: DataFrame) -> DataFrame:
    """Each instance in both representations: Gene, and Pathway as means of eight components."""
    both = F.array(F.struct(F.lit("Gene").alias("representation"), F.col("vec").alias("vec")), F.struct(F.lit("Pathway").alias("representation"), V.pooled("vec", 8).alias("vec")))
    return inst.select(*(c for c in inst.columns if c != "vec"), F.inline(both))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr(
        "CAST(vec_id AS STRING) AS cell_id", "IF(vec_id % 2 = 0, 'CRISPR', 'DRUG') AS dataset_side", "IF(vec_id % 37 = 0, NULL, transform(embedding, x -> CAST(x AS DOUBLE))) AS vec"
    )


def delta_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    # vec_id is dense from zero and every tenth pair of ids is taken, so the row number needs no sort
    return table(spark, sf_dir, "embeddings", ["vec_id"]).where("vec_id % 10 IN (0, 1)").selectExpr(
        "2 * (vec_id DIV 10) + vec_id % 10 AS row_id", "CAST(vec_id AS STRING) AS treated_cell_id", "IF(vec_id % 2 = 0, 'CRISPR', 'DRUG') AS dataset_side",
        "1 + (vec_id DIV 10) % 4 + IF(vec_id % 130 = 0, 1, 0) AS n_controls_used",
    )


def pair_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "embeddings", ["vec_id"]).where("vec_id % 10 IN (0, 1) AND vec_id % 170 <> 0")
    ranked = base.selectExpr("vec_id", "explode(sequence(1L, 1 + (vec_id DIV 10) % 4)) AS control_rank")
    return ranked.selectExpr(
        "CAST(vec_id AS STRING) AS treated_cell_id", "CAST(vec_id + 2 * control_rank AS STRING) AS control_cell_id", "control_rank",
        "1 + (vec_id DIV 10) % 4 AS n_controls_used", "IF(vec_id % 2 = 0, ' crispr', 'Drug ') AS dataset_side",
    )


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_quantity"]), table(spark, sf_dir, "part", ["p_partkey", "p_brand"])
    joined = lines.join(parts, lines["l_partkey"] == parts["p_partkey"])
    return joined.groupBy(F.col("l_orderkey").cast("string").alias("cell_id"), F.col("p_brand").alias("gene_symbol")).agg(F.sum(F.col("l_quantity").cast("double")).alias("cnt"))


def gene_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.regexp_replace("p_brand", "Brand#", "")
    brands = table(spark, sf_dir, "part", ["p_brand"]).distinct().where(n.cast("int") % 5 != 0)
    return brands.select(F.col("p_brand").alias("symbol"), F.concat(F.when(n.cast("int") % 7 == 0, "ENSMUSG").otherwise("ENSG"), n).alias("ensembl_id"))
