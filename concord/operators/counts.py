"""Counts of genes in cells, in long form (cell_id, gene_symbol, cnt): mapping, alignment, normalising, tokens, filters."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MIN_MAPPED_GENES = 500
SCALE = 1e4


def mapped(genes: DataFrame, gene_map: DataFrame, retry_upper: bool = True, prefix: str = "ENSG", minimum: int = 0) -> DataFrame:
    """(gene_symbol, ensembl_id): exact match first, then in upper case; a vocabulary, so the map goes by its own size."""
    sym = genes.select(F.trim("gene_symbol").alias("gene_symbol")).where("gene_symbol <> ''").distinct()
    exact = gene_map.select(F.col("symbol").alias("gene_symbol"), F.col("ensembl_id").alias("exact"))
    got = sym.join(exact, "gene_symbol", "left")
    if retry_upper:
        upper = gene_map.select(F.col("symbol").alias("up"), F.col("ensembl_id").alias("again"))
        got = got.join(upper, F.upper("gene_symbol") == F.col("up"), "left")
        found: Column = F.coalesce("exact", "again")
    else:
        found = F.col("exact")
    out = got.select("gene_symbol", F.trim(found).alias("ensembl_id")).where(F.col("ensembl_id").startswith(prefix))
    if minimum and (n := out.count()) < minimum:
        raise ValueError(f"too few genes mapped: {n} < {minimum}")
    return out


def _targets(genes: DataFrame, reference: DataFrame) -> DataFrame:
    """(src_pos, gene_symbol, tgt_pos); of a reference gene that occurs twice the last place counts."""
    last = reference.groupBy("gene").agg(F.max("pos").alias("tgt_pos"))
    return genes.join(last, genes["target"] == last["gene"]).select("src_pos", "gene_symbol", "tgt_pos")


def align_last_wins(counts: DataFrame, genes: DataFrame, reference: DataFrame) -> DataFrame:
    """(cell_id, tgt_pos, cnt): of several source genes with one target the last column replaces the others, zeros included.

    genes: src_pos, gene_symbol, target.  Zeros are left out of the long form."""
    winner = _targets(genes, reference).groupBy("tgt_pos").agg(F.max_by("gene_symbol", "src_pos").alias("gene_symbol"))
    return counts.join(winner, "gene_symbol").select("cell_id", "tgt_pos", "cnt").where("cnt <> 0")


def align_sum(counts: DataFrame, genes: DataFrame, reference: DataFrame) -> DataFrame:
    """The same with the counts of one target added up."""
    joined = counts.join(_targets(genes, reference), "gene_symbol")
    return joined.groupBy("cell_id", "tgt_pos").agg(F.sum("cnt").alias("cnt"))


def log_normalised(counts: DataFrame, gene: str = "gene_symbol") -> DataFrame:
    """log2(1 + x * 1e4 / total) with totals over the genes at hand; a total of zero scales by one."""
    total = F.sum("cnt").over(Window.partitionBy("cell_id"))
    scale = F.when(total > 0, F.lit(SCALE) / total).otherwise(1.0)
    return counts.select("cell_id", gene, F.log2(1 + F.col("cnt") * scale).alias("x"))


def tokens(normalised: DataFrame, gene: str = "gene_symbol", bins: int = 5) -> DataFrame:
    return normalised.select("cell_id", gene, F.least(F.greatest(F.floor("x"), F.lit(0)), F.lit(bins)).cast("int").alias("token"))


def sequences(tokens_: DataFrame, positions: DataFrame, n_genes: int, gene: str = "gene_symbol", bins: int = 5) -> DataFrame:
    """cell_id, sequence, seq_len, n_classes: a cell's tokens by gene position with zeros between, and a 0 for the class
    token at the end; ``n_genes`` + 1 places, bins + 2 classes.  positions: pos, gene; a vocabulary, as long as a sequence."""
    placed = tokens_.join(positions.select("pos", F.col("gene").alias(gene)), gene)
    held = placed.groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("pos").cast("int"), "token"))).alias("at"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(n_genes)), lambda i: F.coalesce(F.try_element_at("at", i), F.lit(0)))
    return held.select("cell_id", dense.alias("sequence"), F.lit(n_genes + 1).alias("seq_len"), F.lit(bins + 2).alias("n_classes"))


def cell_stats(counts: DataFrame) -> DataFrame:
    return counts.groupBy("cell_id").agg(F.sum("cnt").alias("row_sum"), F.count_if(F.col("cnt") != 0).alias("row_nnz"))


def positive_tokens(stats: DataFrame, high_res: str = "t4") -> DataFrame:
    """``pos_tokens``: nonzero genes, one more for a sum over 1, and one by the resolution mode f, a or t and its value."""
    text = high_res.strip()
    mode = text[:1].lower()
    try:
        value = float(text[1:] or "0")
    except ValueError:
        value = 0.0
    total = F.col("row_sum")
    if mode == "f":
        extra = (total > 1.0 / value).cast("int") if value > 0 else F.lit(0)
    elif mode == "a":
        extra = (total > 10.0**-value).cast("int")
    else:
        extra = F.lit(int(mode == "t" and value > 0))
    return stats.withColumn("pos_tokens", (F.col("row_nnz") + extra + (total > 1.0).cast("int")).cast("bigint"))


def runnable(stats: DataFrame, minimum: int = 2) -> DataFrame:
    return stats.where((F.col("row_sum") > 0) & (F.col("pos_tokens") >= minimum))


def nonzero_cells(counts: DataFrame, genes: DataFrame) -> DataFrame:
    """Cells that have a positive count among the given genes."""
    return counts.join(genes.select("gene_symbol"), "gene_symbol", "left_semi").groupBy("cell_id").agg(F.max("cnt").alias("top"), F.count("*").alias("n_genes")).where("top > 0")


def chunks(cells: DataFrame, key: str, size: int, group: str = "dataset_side") -> DataFrame:
    """``chunk``: consecutive runs of ``size`` cells per group in key order.

    Cells are laid out by ranges, numbered within each range, and moved by the number of cells in the ranges before, so no
    task has a whole group.  The layout is kept, as counts and numbers must see the same ranges."""
    ranged = cells.repartitionByRange(group, key).withColumn("__range", F.spark_partition_id()).persist(StorageLevel.DISK_ONLY)
    held = ranged.groupBy(group, "__range").agg(F.count("*").alias("n"))  # one row per range and group
    before = F.sum("n").over(Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = held.select(F.col(group).alias("__group"), F.col("__range").alias("__of"), F.coalesce(before, F.lit(0)).alias("__before"))
    numbered = ranged.withColumn("__number", F.row_number().over(Window.partitionBy("__range", group).orderBy(key)) - 1)
    met = numbered.join(F.broadcast(offsets), (F.col("__range") == F.col("__of")) & F.col(group).eqNullSafe(F.col("__group")))
    return met.withColumn("chunk", F.floor((F.col("__number") + F.col("__before")) / size).cast("bigint")).select(*cells.columns, "chunk")


def duplicates(df: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    got = df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return got.orderBy(key).limit(limit) if limit else got
