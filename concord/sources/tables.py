"""Readers with declared schemas; nothing is inferred and only the named columns are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions.canon import require

PAIR_LIST = ("treated_cell_id", "control_cell_id", "control_rank", "n_controls_used", "dataset_side")
DELTA_META = "row_id string, treated_cell_id string, n_controls_used string, dataset_side string, perturbation_class string"


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def pair_list(spark: SparkSession, path: str) -> DataFrame:
    return require(spark.read.parquet(path), list(PAIR_LIST), "pair_list").select(*PAIR_LIST)


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header; columns are matched by name, those of ``schema`` that the file lacks are left out."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    wanted = [part.strip().split()[:2] for part in schema.split(",")]
    return raw.select(*(F.col(f"`{n}`").cast(t).alias(n) for n, t in wanted if n in raw.columns))


def gene_list(spark: SparkSession, path: str, upper: bool = False) -> DataFrame:
    """(pos, gene) of a TSV: its ``gene_name`` column, else the first column of a file with a header."""
    head = spark.read.option("header", True).option("sep", "\t").csv(path)
    name = F.trim(F.col("`gene_name`" if "gene_name" in head.columns else f"`{head.columns[0]}`"))
    genes = head.select(F.monotonically_increasing_id().alias("at"), (F.upper(name) if upper else name).alias("gene"))
    return positions(genes)


def positions(genes: DataFrame) -> DataFrame:
    """Dense places 0.. by ``at``; a gene list is a vocabulary, small by nature."""
    from pyspark.sql.window import Window

    return genes.select((F.row_number().over(Window.orderBy("at")) - 1).cast("bigint").alias("pos"), "gene")


def symbol_map(df: DataFrame) -> DataFrame:
    """(symbol, ensembl_id) without null or blank entries."""
    clean = df.select(F.trim("symbol").alias("symbol"), F.trim("ensembl_id").alias("ensembl_id"))
    return clean.where("symbol <> '' and ensembl_id <> ''")


def newest(spark: SparkSession, patterns: list[str]) -> str | None:
    """Path of the file that was changed last among those that match; None if none does.  Contents are not read."""
    found = None
    for pattern in patterns:
        folder, _, glob = pattern.rpartition("/")
        try:
            files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "modificationTime")
            row = files.agg(F.max_by("path", "modificationTime").alias("path"), F.max("modificationTime").alias("at")).first()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        if row["path"] is not None and (found is None or row["at"] > found[0]):
            found = row["at"], row["path"]
    return found and found[1]


def cells(vectors: DataFrame, meta: DataFrame, id_column: str) -> DataFrame:
    """Cell vectors joined to their metadata by id; every metadata row must have one vector and the reverse."""
    counts = [d.agg(F.count("*"), F.count_distinct(id_column)).first() for d in (vectors, meta)]
    if counts[0] != counts[1] or counts[0][0] != counts[0][1]:
        raise ValueError(f"rows and distinct ids differ: vectors {tuple(counts[0])}, metadata {tuple(counts[1])}")
    return meta.join(vectors, id_column)
