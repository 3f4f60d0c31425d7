from datetime import datetime

from pyspark.sql import functions as F

from concord.operators import cohort
from concord.streaming import coverage


def test_running_coverage_equals_the_batch(spark, tmp_path):
    rows = [(i, "LINCS", "chemical" if i % 2 else "genetic", "K562", "G1|G2" if i % 3 else "G2", "24", "1", datetime(2024, 1, 1, i % 5)) for i in range(30)]
    df = spark.createDataFrame(rows, coverage.INSTANCE)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(coverage.INSTANCE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    coverage.to_table(coverage.running_coverage(stream), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).groupBy(*cohort.UNIT2).agg(F.max_by("n_chem_instances", "batch"), F.max_by("n_gen_instances", "batch"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, cohort.coverage(cohort.membership(df)).collect()))


def test_windows(spark, tmp_path):
    df = spark.createDataFrame([(i, "D", "genetic", "c", "G1", "", "", datetime(2024, 1, 1, i)) for i in range(4)], coverage.INSTANCE)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(coverage.INSTANCE).parquet(str(tmp_path / "in"))
    q = coverage.coverage_over_time(stream).writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("windows").agg(F.sum("n_instances")).first()[0] == 2  # the windows that the watermark has not passed are open
