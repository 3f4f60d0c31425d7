"""Audited stage runs: a stage writes its tables into its own folder and commits what it did as JSON files; a later stage
reads these files as tables and admits only stages whose gates passed and whose files are as they were.

Layout: ``root/run_id/stage/`` with one Parquet folder and one manifest for each table, ``audit_assertions.json``
(assertions, grouped by gate), ``run_manifest.json`` and, written last, ``manifest.json``: size and SHA-256 of every other
file.  A folder without it is a run that did not end.  Files are written through Hadoop's file systems and hashed in the
tasks that read them, so any store will do."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.config import GLOBAL_SEED
from concord.operators import audit
from concord.sources import sinks

#: The gates an assertion belongs to.
GATES = ("input", "metric", "leakage")
RUN = "task string, stage_name string, run_id string, created_at string"
ASSERTIONS = "assertions array<struct<gate:string,name:string,pass:boolean,details:string,counterexamples:array<string>>>"
FILES = "stage string, files array<struct<relative_path:string,size_bytes:bigint,sha256:string>>"


def put(spark: SparkSession, path: str, value: dict | list) -> None:
    """JSON with two-space indent, ASCII, a final newline."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write((json.dumps(value, indent=2, ensure_ascii=True, default=str) + "\n").encode())
    out.close()


def plain(path: str) -> str:
    """A path without the scheme of local files and without dots on its way."""
    path = path[5:] if path.startswith("file:") else path
    head, sep, rest = path.partition("://")
    parts: list[str] = []
    for part in (rest if sep else path).split("/"):
        if part == "..":
            parts[-1:] = []
        elif part not in ("", "."):
            parts.append(part)
    return f"{head}://{'/'.join(parts)}" if sep else f"/{'/'.join(parts)}"


def under(path: str, roots: list[str]) -> bool:
    return any(f"{plain(path)}/".startswith(f"{plain(r)}/") for r in roots)


def isolated(root: str, expected: str) -> audit.Assertion:
    """The data root is the one that the contract names, not merely one like it."""
    return audit.Assertion("snapshot_isolation", plain(root) == plain(expected), f"{plain(root)}, expected {plain(expected)}", gate="leakage")


def routed(name: str, paths: list[str], roots: list[str], label: str) -> audit.Assertion:
    bad = tuple({label: p} for p in sorted(set(paths)) if not under(p, roots))
    return audit.Assertion(name, not bad, f"{len(bad)} of {len(set(paths))} outside {', '.join(roots)}", bad[: audit.EXAMPLES], gate="leakage")


@dataclass
class Stage:
    """One run of one stage.  ``inputs`` must lie under ``allowed``; ``data_root`` must be ``expected_root`` where both are given."""

    spark: SparkSession
    root: str
    run_id: str
    task: str
    name: str
    inputs: list[str] = field(default_factory=list)
    allowed: list[str] = field(default_factory=list)
    data_root: str | None = None
    expected_root: str | None = None
    seed: int = GLOBAL_SEED
    assertions: list[audit.Assertion] = field(default_factory=list)
    outputs: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.check(audit.fatal(audit.seed(self.seed), 3))
        if self.expected_root is not None:
            self.check(audit.fatal(isolated(self.data_root or "", self.expected_root), 4))

    @property
    def folder(self) -> str:
        return f"{self.root.rstrip('/')}/{self.run_id}/{self.name}"

    def check(self, assertion: audit.Assertion) -> audit.Assertion:
        self.assertions.append(assertion)
        return assertion

    def table(self, df: DataFrame, name: str, keys: list[str], metrics: list[str], family: str = "", level: str = "", path: str | None = None) -> DataFrame:
        """Write a result table and its manifest; read it back."""
        path = path or f"{self.folder}/{name}.parquet"
        df.write.mode("overwrite").parquet(path)
        put(self.spark, f"{path}.manifest.json", sinks.manifest(name, path, family, level, keys, metrics))
        self.outputs += [path, f"{path}.manifest.json"]
        return self.spark.read.schema(df.schema).parquet(path)

    def commit(self, config: dict | None = None, summary: dict | None = None) -> None:
        """Write assertions and manifests, the file manifest last.  What must not be is fatal only now, when it is on record."""
        own = self.check(routed("stage_output_routing", self.outputs, [self.folder], "bad_output"))
        isolation = self.check(routed("input_path_isolation", self.inputs, self.allowed, "bad_input"))
        records = [a.record() | {"gate": a.gate} for a in self.assertions]
        gates = {g: {"pass": all(a.ok for a in self.assertions if a.gate == g), "assertions": [a.name for a in self.assertions if a.gate == g]} for g in GATES}
        put(self.spark, f"{self.folder}/audit_assertions.json", {"gates": gates, "assertions": [{**r, "counterexamples": [json.dumps(c, default=str) for c in r["counterexamples"]]} for r in records]})
        now = datetime.now(UTC).replace(microsecond=0).isoformat()
        run = {"task": self.task, "stage_name": self.name, "run_id": self.run_id, "created_at": now, "seed": self.seed, "config": config or {}, "inputs": self.inputs, "outputs": self.outputs, "summary": summary or {}}
        put(self.spark, f"{self.folder}/run_manifest.json", run)
        files = hashed(self.spark, self.folder).orderBy("relative_path").collect()  # a row for each file of one stage
        put(self.spark, f"{self.folder}/manifest.json", {"stage": self.name, "files": [r.asDict() for r in files]})
        audit.fatal(own, 14)
        audit.fatal(isolation, 16)


def _inside(path: Column, folder: str) -> Column:
    """The part of a path after ``folder``."""
    whole = F.regexp_replace(F.regexp_replace(path, "^file:/+", "/"), "%20", " ")
    return F.substr(whole, F.lit(len(plain(folder)) + 2))


def hashed(spark: SparkSession, folder: str) -> DataFrame:
    """relative_path, size_bytes, sha256 of every file under a folder but its manifest and Spark's own marks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    rows = files.select(_inside(F.col("path"), folder).alias("relative_path"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
    return rows.where("relative_path <> 'manifest.json' AND NOT endswith(relative_path, '/_SUCCESS')")


def changed(spark: SparkSession, folder: str) -> DataFrame:
    """relative_path, what (missing, new, changed): where a folder differs from the manifest in it.  Also for data roots."""
    kept = spark.read.option("multiLine", True).schema(FILES).json(f"{folder}/manifest.json").select(F.inline("files"))
    now = hashed(spark, folder).select(F.col("relative_path").alias("path"), F.col("size_bytes").alias("size"), F.col("sha256").alias("digest"))
    both = kept.join(now, F.col("relative_path") == F.col("path"), "full")
    what = F.when(F.col("path").isNull(), "missing").when(F.col("relative_path").isNull(), "new").when((F.col("size") != F.col("size_bytes")) | (F.col("digest") != F.col("sha256")), "changed")
    return both.select(F.coalesce("relative_path", "path").alias("relative_path"), what.alias("what")).where("what IS NOT NULL")


def _read(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    got = spark.read.option("multiLine", True).schema(schema).json(f"{root}/*/*/{name}")
    inside = F.split(_inside(F.col("_metadata.file_path"), root), "/")
    return got.select("*", inside[0].alias("of_run"), inside[1].alias("of_stage"))


def assertions(spark: SparkSession, root: str) -> DataFrame:
    """run_id, stage_name and every assertion on record under ``root``."""
    return _read(spark, root, "audit_assertions.json", ASSERTIONS).select(F.col("of_run").alias("run_id"), F.col("of_stage").alias("stage_name"), F.inline("assertions"))


def registry(spark: SparkSession, root: str) -> DataFrame:
    """Every committed stage with its paths below the folder of ``root``, and ``refused``: why it may not be used, or null.

    A stage is refused by its first failed gate, else by the first file that is not as its manifest says."""
    runs = _read(spark, root, "run_manifest.json", RUN)
    runs = runs.where("run_id = of_run AND stage_name = of_stage").drop("of_run", "of_stage", "created_at")
    gate = F.element_at(F.create_map(*(F.lit(x) for g in enumerate(GATES) for x in reversed(g))), F.col("gate"))
    bad = assertions(spark, root).where("NOT pass").groupBy("run_id", "stage_name").agg(F.min_by(F.concat(F.lit("gate "), "gate", F.lit(": "), "name"), F.struct(gate, "name")).alias("failed"))
    kept = _read(spark, root, "manifest.json", FILES).select(F.col("of_run").alias("run_id"), F.col("of_stage").alias("stage_name"), F.inline("files"))
    now = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    parts = F.split(_inside(F.col("path"), root), "/", 3)
    now = now.select(parts[0].alias("run_id"), parts[1].alias("stage_name"), parts[2].alias("relative_path"), F.sha2("content", 256).alias("digest"))
    now = now.where("relative_path <> 'manifest.json' AND NOT endswith(relative_path, '/_SUCCESS')")
    odd = kept.join(now, ["run_id", "stage_name", "relative_path"], "full").where("NOT sha256 <=> digest")
    odd = odd.groupBy("run_id", "stage_name").agg(F.min("relative_path").alias("file"))
    done = kept.select("run_id", "stage_name").distinct()
    met = runs.join(done, ["run_id", "stage_name"], "left_semi").join(bad, ["run_id", "stage_name"], "left").join(odd, ["run_id", "stage_name"], "left")
    stage_dir = F.concat_ws("/", F.lit(plain(root).rsplit("/", 1)[-1]), "run_id", "stage_name")
    paths = {"stage_dir": stage_dir, "manifest_path": F.concat(stage_dir, F.lit("/manifest.json")), "audit_assertions_path": F.concat(stage_dir, F.lit("/audit_assertions.json"))}
    refused = F.coalesce("failed", F.concat(F.lit("file: "), "file"))
    return met.withColumns(paths).select("task", "stage_name", "run_id", *paths, refused.alias("refused"))


def required(spark: SparkSession, root: str, run_id: str, stages: list[str]) -> list[str]:
    """Folders of the stages that a later one builds on, or the error that names those it may not."""
    found = {r["stage_name"]: r["refused"] for r in registry(spark, root).where(F.col("run_id") == run_id).select("stage_name", "refused").collect()}  # a row for each stage of a run
    bad = {s: found.get(s, "not committed") for s in stages if s not in found or found[s]}
    audit.fatal(audit.Assertion("inputs_admitted", not bad, f"{bad}"), 5)
    return [f"{root.rstrip('/')}/{run_id}/{s}" for s in stages]
