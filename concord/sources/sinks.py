"""Sinks: result tables with their manifests, JSON policies, file manifests."""

from __future__ import annotations

import json
import subprocess
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def delta_policy(model_name: str, embedding_config: dict, seed: int = 619, reference: str = "k562/derived/delta_meta.csv") -> dict:
    """How deltas were made.  Fixed values: the names, the operator and the rules of the contract."""
    return {
        "model_name": model_name, "operator_type": "euclidean", "eps": 1e-12, "delta_definition": "treated_minus_mean_controls",
        "row_alignment_contract": {"reference_table": reference, "rule": "fm_delta[row_id] aligned to delta_meta.row_id with no row drops", "invalid_row_fill": "all_nan_and_valid_mask_false"},
        "seed": seed, "embedding_config": embedding_config,
    }


def write_json(path: str, value: dict | list) -> None:
    """Two-space indent, ASCII, a final newline."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, indent=2, ensure_ascii=True) + "\n")


def write_csv(df: DataFrame, path: str) -> None:
    """One file with a header, quoted only where needed, quotes doubled, nothing for empty texts; for tables of summaries."""
    df.coalesce(1).write.mode("overwrite").options(header=True, escape='"', emptyValue="").csv(path)


def write_table(df: DataFrame, path: str, manifest: dict, fmt: str = "parquet") -> None:
    """A result table and, beside it, its manifest."""
    write_csv(df, path) if fmt == "csv" else df.write.mode("overwrite").parquet(path)
    write_json(f"{path}.manifest.json", manifest)


def write_matrix(deltas: DataFrame, path: str) -> None:
    """(row_id, delta ARRAY<FLOAT>): a null row for an invalid one, in row order over range partitions."""
    rows = deltas.select("row_id", F.transform("delta", lambda v: v.cast("float")).alias("delta"))
    rows.repartitionByRange("row_id").sortWithinPartitions("row_id").write.mode("overwrite").parquet(path)


def manifest(name: str, path: str, family: str, level: str, keys: list[str], metrics: list[str], constants: dict | None = None, dynamic: list[str] | None = None, version: str = "1") -> dict:
    return {
        "table_name": name, "table_path": path, "result_family": family, "result_level": level, "primary_key_fields": keys,
        "dynamic_field_list": dynamic or [], "constant_fields": constants or {}, "metric_columns": metrics, "schema_version": version,
    }


def file_manifest(spark: SparkSession, folder: str, but: str = "manifest.json") -> DataFrame:
    """relative_path, size_bytes and sha256 of every file under a folder except the manifest; hashed where the files are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    relative: Column = F.element_at(F.split("path", f"{folder.rstrip('/')}/", 2), -1)
    return files.select(relative.alias("relative_path"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256")).where(F.col("relative_path") != but)


def run_manifest(config: dict, inputs: list[str], outputs: list[str], summary: dict) -> dict:
    git = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, check=False)
    now = datetime.now(UTC).replace(microsecond=0).isoformat()
    return {"config": config, "inputs": inputs, "outputs": outputs, "summary": summary, "git_head": git.stdout.strip() or None, "created_at": now}
