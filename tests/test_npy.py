"""Matrices in numpy's form: bytes equal numpy's own, ranges, errors by name, repeated tasks, rows against metadata."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from concord.sources import npy


def test_bytes_equal_numpys(spark, tmp_path):
    rng = np.random.default_rng(1)
    m = rng.standard_normal((700, 5)).astype(np.float32)
    m[::9] = np.nan
    rows = [(i, None if np.isnan(v).all() else v.astype(float).tolist()) for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "row_id long, delta array<double>").repartition(7)
    npy.write_matrix(df, str(tmp_path / "d/x.npy"))
    np.save(tmp_path / "y.npy", m)
    assert (tmp_path / "d/x.npy").read_bytes() == (tmp_path / "y.npy").read_bytes()
    npy.write_matrix(df, f"file://{tmp_path}/d/x.npy")  # again over it
    assert [p.name for p in (tmp_path / "d").iterdir()] == ["x.npy"]
    got = npy.read_matrix(spark, str(tmp_path / "y.npy"), size=5 * 4 * 50)
    assert got.rdd.getNumPartitions() == 14 and got.dtypes == [("row_id", "bigint"), ("vec", "array<float>")]
    assert np.array_equal(np.array([r["vec"] for r in got.orderBy("row_id").collect()], np.float32), m, equal_nan=True)


@pytest.mark.parametrize("n", [0, 1])
def test_small(spark, tmp_path, n):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(n)], "row_id long, delta array<double>")
    npy.write_matrix(df, str(tmp_path / "x.npy"))
    np.save(tmp_path / "y.npy", np.array([[1, 2]] * n, np.float32).reshape(n, 2 if n else 0))
    assert (tmp_path / "x.npy").read_bytes() == (tmp_path / "y.npy").read_bytes() and npy.read_matrix(spark, str(tmp_path / "x.npy")).count() == n


def test_many_tasks_read_a_large_file(spark, tmp_path):
    np.save(tmp_path / "big.npy", np.arange(2_000_000, dtype=np.float64).reshape(1_000_000, 2))
    got = npy.read_matrix(spark, str(tmp_path / "big.npy"), size=1 << 20)
    assert got.rdd.getNumPartitions() == 16
    assert got.agg(F.count("*"), F.sum(F.get("vec", F.lit(1)) - 2 * F.col("row_id"))).first() == (1_000_000, 1_000_000.0)


def test_wrong_files_fail_by_name(spark, tmp_path):
    files = {"shape": np.zeros(4, np.float32), "dtype": np.zeros((2, 2), np.int64), "order": np.asfortranarray(np.zeros((3, 2), np.float32))}
    for what, m in files.items():
        np.save(tmp_path / f"{what}.npy", m)
        with pytest.raises(npy.NpyError) as e:
            npy.header(str(tmp_path / f"{what}.npy"))
        assert e.value.what == what
        with pytest.raises(Exception, match=f"npy {what}"):
            npy.read_matrix(spark, str(tmp_path / f"{what}.npy")).count()
    np.save(tmp_path / "cut.npy", np.zeros((3, 2), np.float32))
    (tmp_path / "cut.npy").write_bytes((tmp_path / "cut.npy").read_bytes()[:-1])
    (tmp_path / "text.npy").write_text("no matrix at all")
    for name, what in (("cut", "size"), ("text", "header")):
        with pytest.raises(npy.NpyError, match=what):
            npy.header(str(tmp_path / f"{name}.npy"))
    with pytest.raises(npy.NpyError, match="path"):
        npy.local("hdfs://host/x.npy")


@pytest.mark.parametrize("rows", [[0, 1, 3], [0, 1, 1], [1, 2, 3], [-1, 0, 1]])
def test_rows_must_tile(spark, tmp_path, rows):
    df = spark.createDataFrame([(i, [1.0]) for i in rows], "row_id long, delta array<double>")
    with pytest.raises(Exception, match="npy rows"):
        npy.write_matrix(df, str(tmp_path / "x.npy"))
    assert not (tmp_path / "x.npy").exists()


def test_a_repeated_task_changes_nothing(tmp_path):
    w = npy.NpyWriter(str(tmp_path / "x.npy"), 4, 2)
    batch = lambda ids: pa.RecordBatch.from_arrays([pa.array(ids), pa.array([[float(i), 0.5] if i != 2 else None for i in ids], pa.list_(pa.float32()))], names=["row_id", "vec"])
    a, again, b = w.write(iter([batch([0]), batch([1])])), w.write(iter([batch([0, 1])])), w.write(iter([batch([2, 3])]))
    assert a == again
    w.commit([b, a, None])
    assert np.array_equal(np.load(tmp_path / "x.npy"), np.array([[0, 0.5], [1, 0.5], [np.nan, np.nan], [3, 0.5]], np.float32), equal_nan=True)
    with pytest.raises(npy.NpyError, match="there twice"):
        v = npy.NpyWriter(str(tmp_path / "z.npy"), 4, 2)
        v.commit([npy.Written(0, 3), npy.Written(2, 4)])
    assert [p.name for p in tmp_path.iterdir()] == ["x.npy"]


def test_cells_by_key(spark, tmp_path):
    np.save(tmp_path / "m.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    meta = spark.createDataFrame([("b", 1), ("a", 0), ("c", 2)], "cell_id string, pos long")
    assert {r["cell_id"]: r["vec"] for r in npy.read_cells(spark, str(tmp_path / "m.npy"), meta).collect()} == {"a": [0, 1], "b": [2, 3], "c": [4, 5]}
    for bad in (meta.where("pos < 2"), meta.withColumn("pos", F.col("pos") + 1), meta.withColumn("pos", F.lit(0))):
        with pytest.raises(npy.NpyError, match="rows"):
            npy.read_cells(spark, str(tmp_path / "m.npy"), bad)
