"""One dimension a side, short outputs, sides without vectors, alignment of outputs to cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.operators import audit, embed, fmdelta

CELLS = "dataset_side string, cell_id string, vec array<double>"


def sized():
    """Made in a function, so that it travels to the tasks by value."""

    class Sized:
        """Three dimensions if a segment's first cell begins with b, else two; short by one if it holds an 's' cell."""

        def embed(self, rows, batch_size):
            dim = 3 if rows["cell_id"].iloc[0].startswith("b") else 2
            n = len(rows) - rows["cell_id"].str.contains("s").any()
            return np.full((n, dim), 1.0)

    return Sized


def test_two_chunks_with_two_dimensions_give_one(spark):
    rows = [("CRISPR", f"{c}{i}", [1.0]) for c in "ab" for i in range(5)] + [("DRUG", f"b{i}", [1.0]) for i in range(3)]
    cells = spark.createDataFrame(rows, CELLS)
    a, b = (cells.where(f"cell_id LIKE '{c}%'").coalesce(1) for c in "ab")
    done = {(r["dataset_side"], r["cell_id"]): r for r in embed.embed_run(a.union(b), sized(), chunk=5).collect()}
    assert len(done) == len(rows)
    assert all(len(done["CRISPR", f"a{i}"]["vec"]) == 2 and done["CRISPR", f"b{i}"]["vec"] is None and done["CRISPR", f"b{i}"]["error"] == "dimension 3, not 2" for i in range(5))
    assert all(len(done["DRUG", f"b{i}"]["vec"]) == 3 for i in range(3))
    # another order makes another success the first
    back = embed.embed_run(a.union(b), sized(), order=F.when(F.col("cell_id").startswith("b"), 0).otherwise(1), chunk=5)
    assert {r["cell_id"] for r in back.where("dataset_side = 'CRISPR' AND vec IS NOT NULL").collect()} == {f"b{i}" for i in range(5)}


def test_a_short_output_keeps_what_it_has(spark):
    cells = spark.createDataFrame([("DRUG", c, [1.0]) for c in ("a1", "a2", "as", "a4")], CELLS).coalesce(1)
    done = {r["cell_id"]: r for r in embed.embed_run(cells, sized()).collect()}
    assert [done[c]["vec"] for c in ("a1", "a2", "as")] == [[1.0, 1.0]] * 3
    assert done["a4"]["vec"] is None and done["a4"]["error"] == "short output: 3 vectors for 4 rows"


def test_sides_are_audited(spark):
    df = lambda *rows: spark.createDataFrame(rows, CELLS)
    fine = df(("CRISPR", "a", [1.0]), ("CRISPR", "b", None), ("DRUG", "c", [2.0]))
    assert audit.sides_embedded(fine).ok and audit.one_dimension(fine).ok
    empty = audit.sides_embedded(df(("CRISPR", "a", [1.0]), ("DRUG", "c", None)))
    assert not empty.ok and empty.counterexamples == ({"side": "DRUG"},)
    assert not audit.sides_embedded(fine.limit(0)).ok
    odd = audit.one_dimension(df(("CRISPR", "a", [1.0]), ("DRUG", "c", [2.0, 1.0])))
    assert not odd.ok and odd.counterexamples == ({"side": "DRUG", "side_dim": 2},)
    assert not audit.one_dimension(df(("CRISPR", "a", [1.0]), ("CRISPR", "c", [2.0, 1.0]))).ok


OUT = "dataset_side string, pos long, vec array<double>, cell_id string, barcode string, obs_name string"


def ways(spark, outputs, expected=(("S", "a", 0), ("S", "b", 1), ("S", "c", 2)), drop=()):
    want = spark.createDataFrame(list(expected), "dataset_side string, cell_id string, pos long")
    got = fmdelta.aligned(want, spark.createDataFrame(outputs, OUT).drop(*drop)).collect()
    return {r["way"] for r in got}, {r["cell_id"]: r["vec"] and r["vec"][0] for r in got}


@pytest.mark.parametrize(
    ("outputs", "way", "vectors"),
    [
        ([("S", 2, [1.0], "a", "z", None), ("S", 0, [2.0], "b", "z", None), ("S", 1, [3.0], "c", "z", None)], "cell_id", {"a": 1.0, "b": 2.0, "c": 3.0}),
        ([("S", 0, [1.0], "x", "c", "a"), ("S", 1, [2.0], "y", "b", "b"), ("S", 2, [3.0], "a", "a", "q")], "barcode", {"a": 3.0, "b": 2.0, "c": 1.0}),  # cell_id covers one, barcode all
        ([("S", 0, [1.0], "a", "a", "a"), ("S", 1, [2.0], "b", "b", "q"), ("S", 2, [3.0], "q", "q", "q")], "cell_id:partial", {"a": 1.0, "b": 2.0, "c": None}),
        ([("S", 0, [1.0], "x", None, None), ("S", 1, [2.0], "y", None, None), ("S", 2, [3.0], "z", None, None)], "position", {"a": 1.0, "b": 2.0, "c": 3.0}),
        ([("S", 0, [1.0], "x", None, None)], "none", {"a": None, "b": None, "c": None}),
        ([("S", 1, [9.0], "a", None, None), ("S", 0, [1.0], "a", None, None), ("S", 2, [2.0], "b", None, None), ("S", 3, [float("nan")], "c", None, None)], "cell_id", {"a": 1.0, "b": 2.0, "c": None}),  # duplicates, not finite
        ([("T", 0, [1.0], "a", None, None)], "none", {"a": None, "b": None, "c": None}),
    ],
)
def test_ways_of_alignment(spark, outputs, way, vectors):
    assert ways(spark, outputs) == ({way}, vectors)


def test_without_id_columns_and_by_side(spark):
    outputs = [("S", i, [float(i)], "x", "y", "z") for i in range(3)]
    assert ways(spark, outputs, drop=("cell_id", "barcode", "obs_name")) == ({"position"}, {"a": 0.0, "b": 1.0, "c": 2.0})
    both = [*outputs, ("T", 0, [7.0], "q", "d", "q")]
    assert ways(spark, both, [("S", "a", 0), ("S", "b", 1), ("S", "c", 2), ("T", "d", 0)]) == ({"position", "barcode"}, {"a": 0.0, "b": 1.0, "c": 2.0, "d": 7.0})
