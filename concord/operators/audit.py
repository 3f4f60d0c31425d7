"""Audits: assertions that can be falsified from rows and files, with at most five counterexamples each."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.config import GLOBAL_SEED
from concord.functions import vectors as V

EXAMPLES = 5


class AuditError(RuntimeError):
    """A fatal audit failed; ``code`` is the exit code that the contract gives it."""

    def __init__(self, name: str, code: int, details: str):
        super().__init__(f"{name}: {details}")
        self.code = code


@dataclass(frozen=True)
class Assertion:
    name: str
    ok: bool
    details: str = ""
    counterexamples: tuple = ()
    gate: str = "input"

    def record(self) -> dict:
        return {"name": self.name, "pass": self.ok, "details": self.details, "counterexamples": list(self.counterexamples)}


def none_of(bad: DataFrame, name: str, details: str = "", gate: str = "input") -> Assertion:
    """Passes if ``bad`` has no rows; its first rows are the counterexamples."""
    rows = [r.asDict() for r in bad.limit(EXAMPLES).collect()]
    return Assertion(name, not rows, details, tuple(rows), gate)


def fatal(a: Assertion, code: int) -> Assertion:
    if not a.ok:
        raise AuditError(a.name, code, f"{a.details} {a.counterexamples}")
    return a


def seed(value: int) -> Assertion:
    return Assertion("global_seed", value == GLOBAL_SEED, f"seed {value}, expected {GLOBAL_SEED}")


def inputs_present(exists: Callable[[str], bool], paths: list[str]) -> Assertion:
    missing = tuple(p for p in paths if not exists(p))
    return Assertion("inputs_present", not missing, f"{len(missing)} of {len(paths)} missing", missing[:EXAMPLES])


def row_ids(spine: DataFrame) -> DataFrame:
    """One row: whether row_id is exactly 0..N-1."""
    got = spine.agg(F.count("*").alias("n"), F.min("row_id").alias("lo"), F.max("row_id").alias("hi"), F.count_distinct("row_id").alias("n_distinct"))
    ok = (F.col("n") == 0) | ((F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & (F.col("n_distinct") == F.col("n")))
    return got.withColumn("contiguous", ok)


def row_ids_contiguous(spine: DataFrame) -> Assertion:
    r = row_ids(spine).first()
    return Assertion("row_id_contiguous", r["contiguous"], f"n {r['n']}, from {r['lo']} to {r['hi']}, {r['n_distinct']} distinct")


def rows_preserved(spine: DataFrame, delta: DataFrame) -> Assertion:
    a, b = spine.count(), delta.count()
    return Assertion("rows_preserved", a == b, f"{a} in, {b} out")


def delta_sound(delta: DataFrame) -> Assertion:
    """Valid rows finite, invalid rows null."""
    bad = delta.where((F.col("valid_mask") & ~V.finite("delta")) | (~F.col("valid_mask") & F.col("delta").isNotNull()))
    return none_of(bad.select("row_id", "invalid_reason"), "delta_finite_or_null")


def sides_embedded(embeddings: DataFrame) -> Assertion:
    """Every side has a vector."""
    rows = embeddings.groupBy("dataset_side").agg(F.count("vec").alias("n_vectors")).collect()  # a row for each side
    bad = tuple({"side": r["dataset_side"]} for r in rows if not r["n_vectors"])
    return Assertion("embedding_side", bool(rows) and not bad, f"{len(rows)} sides, {len(bad)} without a vector", bad[:EXAMPLES])


def one_dimension(embeddings: DataFrame) -> Assertion:
    """All vectors of all sides have one dimension; each side with another than the first counts against it."""
    rows = embeddings.groupBy("dataset_side").agg(F.min(F.when(F.col("vec").isNotNull(), F.size("vec"))).alias("lo"), F.max(F.when(F.col("vec").isNotNull(), F.size("vec"))).alias("hi"))
    sides = sorted(((r["dataset_side"] or "", r["lo"], r["hi"]) for r in rows.collect() if r["lo"] is not None), key=lambda r: r[0])
    bad = tuple({"side": s, "side_dim": hi if hi != sides[0][1] else lo} for s, lo, hi in sides if (lo, hi) != (sides[0][1], sides[0][1]))
    return Assertion("embedding_dimension_consistent_across_sides", not bad, f"dimensions {sorted({d for _, lo, hi in sides for d in (lo, hi)})}", bad[:EXAMPLES])


def not_in_own_centroid(loo: DataFrame) -> DataFrame:
    """Rows whose left-one-out centroid still holds the row: n-1 times it plus the row must give the unit's sum."""
    gap = V.total(F.zip_with(F.zip_with("loo", "vec", lambda m, x: m * (F.col("n") - 1) + x), F.transform("unit_mean", lambda m: m * F.col("n")), lambda a, b: F.abs(a - b)))
    return loo.where(gap > 1e-6)


def delta_run(spine: DataFrame, pairs: DataFrame, embeddings: DataFrame) -> tuple[DataFrame, list[Assertion]]:
    """Audited deltas: what must stop the run before embedding does; unmatched keys are recorded and do not."""
    from concord.operators import fmdelta

    done = [fatal(row_ids_contiguous(spine), 9), fatal(none_of(fmdelta.contract_violations(pairs), "pair_group_contract"), 10)]
    done.append(none_of(fmdelta.missing_keys(spine, pairs).select("row_id", *fmdelta.KEY), "delta_rows_have_pair_keys"))
    done += [fatal(sides_embedded(embeddings), 12), fatal(one_dimension(embeddings), 13)]
    delta = fmdelta.deltas(spine, pairs, embeddings)
    return delta, [*done, rows_preserved(spine, delta), delta_sound(delta)]
