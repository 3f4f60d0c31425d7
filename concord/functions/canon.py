"""Cleaning of scalars, sides and target sets, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Id columns by side, in order of preference.
ID_COLUMNS = {"CRISPR": ("cell_barcode", "cell_id", "Unnamed: 0"), "DRUG": ("Unnamed: 0", "cell_id", "cell_barcode")}


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalized(x: str | Column) -> Column:
    """Trimmed text; null and blank become ``NA``."""
    return F.coalesce(F.nullif(F.trim(_c(x).cast("string")), F.lit("")), F.lit("NA"))


def side(x: str | Column) -> Column:
    """Upper-cased and trimmed; a null reads ``NAN``, as text conversion leaves it."""
    return F.upper(F.trim(F.coalesce(_c(x).cast("string"), F.lit("nan"))))


def side_of_class(perturbation_class: str | Column) -> Column:
    return F.when(F.lower(normalized(perturbation_class)) == "genetic", F.lit("CRISPR")).otherwise(F.lit("DRUG"))


def side_of_type(perturbation_type: str | Column) -> Column:
    return F.when(F.lower(normalized(perturbation_type)) == "genetic", F.lit("CRISPR")).when(F.lower(normalized(perturbation_type)) == "chemical", F.lit("DRUG"))


def with_side(df: DataFrame) -> DataFrame:
    """``dataset_side`` cleaned where present, else derived from ``perturbation_class``."""
    found = side("dataset_side") if "dataset_side" in df.columns else side_of_class("perturbation_class")
    return df.withColumn("dataset_side", found)


def strict_bigint(x: str | Column) -> Column:
    """A whole number, or the query fails: ANSI cast."""
    return _c(x).cast("bigint")


def double_or_zero(x: str | Column) -> Column:
    return F.coalesce(F.try_cast(_c(x), "double") if hasattr(F, "try_cast") else _c(x).try_cast("double"), F.lit(0.0))


def target_set(x: str | Column) -> Column:
    """Canonical target-set string: upper-case tokens, no duplicates, sorted, joined by ``|``; idempotent."""
    tokens = F.transform(F.split(_c(x), r"[|]"), lambda t: F.upper(F.trim(t)))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(tokens, lambda t: t != ""))), "|")


def targets(x: str | Column) -> Column:
    return F.split(_c(x), r"[|]")


def id_column(columns: list[str], dataset_side: str) -> str:
    """The column that identifies cells of a side."""
    for name in ID_COLUMNS[dataset_side]:
        if name in columns:
            return name
    raise ValueError(f"no id column for {dataset_side} among {columns}")


def with_defaults(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns that are missing, filled with ``NA``."""
    return df.withColumns({n: F.lit("NA") for n in names if n not in df.columns})


def filled(x: str | Column) -> Column:
    """The text, or an empty one where there is none."""
    return F.coalesce(_c(x).cast("string"), F.lit(""))


def tail(message: str | Column, n: int = 2000) -> Column:
    return F.right(_c(message), F.lit(n))


def out_of_memory(message: str | Column) -> Column:
    m = F.lower(F.coalesce(_c(message), F.lit("")))
    return m.contains("out of memory") | (m.contains("cuda") & m.contains("memory")) | m.contains("cublas")


def require(df: DataFrame, columns: list[str], table: str) -> DataFrame:
    """``df`` itself, or an error that lists the missing columns."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{table}: missing columns {missing}")
    return df
