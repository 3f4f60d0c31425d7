"""What the corpus operators share: scratch tables, checked broadcasts, connected components.

Scratch tables are ordinary Parquet tables in the folder named by ``spark.checkpoint.dir``, so every
executor can read them again after another executor is lost.  Only where the setting is absent and the master
is local (tests, notebooks) is a temporary folder of this machine used; a cluster must name a shared folder.
A table that nothing reads any more is deleted at once by ``discard``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast by hint only after it was measured to have no more rows and no more bytes (as JSON) than these.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 8 << 20

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only where a local session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="concord-")
    return _own_dir[app]


@contextmanager
def measured_broadcasts(spark: SparkSession) -> Iterator[None]:
    """What runs inside broadcasts by hint, or what a shuffle was measured to hold; the session's settings are put back after it.

    Spark's estimate of a table that was not shuffled is that of its files, with as many rows after an explode as before."""
    estimated, shuffled = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = {name: spark.conf.get(name, None) for name in (estimated, shuffled)}
    spark.conf.set(shuffled, before[shuffled] or spark.conf.get(estimated))
    spark.conf.set(estimated, "-1")
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with measured_broadcasts(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again; what was computed from them must have been written.

    What the driver still holds of the jobs so far (broadcast tables, map outputs, plans) is given up when its garbage is
    collected, which is asked for here: a chain of many short jobs fills its heap otherwise."""
    for table in tables:
        spark = table.sparkSession
        files = table.inputFiles()
        if files:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    if tables:
        spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it is measured to have at most ``rows`` rows of ``size`` bytes in all; else to be merged.

    Without a hint Spark would go by its own estimate, which is far too low where rows were exploded or compress well.
    ``df`` should be a written table or the like, as the measuring runs it."""
    if df.count() > rows:
        return df.hint("merge")
    return F.broadcast(df) if (df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0) <= size else df.hint("merge")


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python in batches of at most ``rows`` rows, where the session's setting allows more."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


@contextmanager
def rows_at_once(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside sends at most ``rows`` rows to Python in a batch; the session's setting is put back after it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def least_of(df: DataFrame, key: str, *aggregates: Column) -> DataFrame:
    """``key`` and the aggregates of each key, combined in every task before the shuffle, ready to be joined back.

    The key is computed anew, so that the join shuffles both of its sides by itself; only such joins does Spark split
    where one key holds a large part of the rows."""
    return df.groupBy(key).agg(*aggregates).withColumn(key, F.col(key).bitwiseXOR(F.lit(0)))


def met_in_groups(queries: DataFrame, stored: DataFrame, size: int) -> DataFrame:
    """Every block of ``queries`` beside every row of ``stored``, by an equi-join on groups of about ``size`` stored rows.

    ``stored`` is a written table with a number ``block`` that differs from row to row.  Its rows move once, to as many
    tasks as there are groups; blocks of queries are copied to the groups, by broadcast where the copies are measured small."""
    groups = max(1, -(-stored.count() // size))
    dealt = stored.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).repartition(groups, "group")
    each = queries.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return dealt.join(small(each), "group")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an edge table ``(a, b)`` of longs, by alternating large and small stars.

    Returns ``(node, root)`` for every node with at least one edge to another node; ``root`` is the smallest
    node of its component.  Each round is written to the shared folder, so neither lineage nor the driver
    grows with the graph.  Self-loops and nulls are ignored; an empty table gives an empty result.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        flipped = e.select(F.col("b").alias("a"), F.col("a").alias("b"))
        low = least_of(e.union(flipped) if large else e, "a", F.least("a", F.min("b")).alias("m"))
        far = (flipped if large else e).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return (far if large else far.union(low.select("a", F.col("m").alias("b")))).where("a <> b").distinct()

    down = lambda e: e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = written(down(edges.where("a <> b")).distinct(), "edges")
    digest = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = digest(now)
    while before[0]:
        last, now = now, written(star(down(star(now, True)), False), "edges")
        discard(last)
        after = digest(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
