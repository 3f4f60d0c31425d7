"""Retrieval counts by blocked matrix products.

Queries and gallery of a slice are packed into blocks of about ``VALUES`` vector components.  Groups of blocks meet by an
equi-join on (slice, group of queries, group of gallery), so a hot slice is dealt over as many tasks as it has pairs of
groups, and no task holds more than two blocks.  A block pair is one matrix product; only two counts for each query leave
it, and their sums are the answer.  Time is linear in the number of components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components of a block (8 bytes each), and blocks of a group.
VALUES, GROUP = 1 << 20, 8


def similarities(q: np.ndarray, g: np.ndarray, kind: str) -> np.ndarray:
    """Of every row of ``q`` with every row of ``g``, rounded to nine digits as elsewhere."""
    if kind == "cosine":
        return np.round(q @ g.T, 9)
    return np.round(-np.sqrt(np.stack([((g - x) ** 2).sum(1) for x in q])), 9)


def matrix(lists: pa.Array) -> np.ndarray:
    """The lists that are not null as rows of one matrix."""
    n = len(lists) - lists.null_count
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def ahead(asked: pa.StructArray, held: pa.StructArray, kind: str) -> np.ndarray:
    """For each query the number of gallery entries that come before its best positive, its own keys left out."""
    means = held.field("mean")
    keys = [k for k, ok in zip(held.field("key").to_pylist(), means.is_valid().to_pylist(), strict=True) if ok]
    if not keys:
        return np.zeros(len(asked), np.int64)
    sim = similarities(matrix(asked.field("vec")), matrix(means), kind)
    beat, best = asked.field("beat").to_numpy(), asked.field("best_key").to_pylist()
    before = sim > beat[:, None]
    for i, j in zip(*np.nonzero(sim == beat[:, None]), strict=True):
        before[i, j] = keys[j] < best[i]
    column = {k: j for j, k in enumerate(keys)}
    for i, own in enumerate(asked.field("own_keys").to_pylist()):
        for k in own:
            if k in column:
                before[i, column[k]] = False
    return before.sum(1)


def packed(df: DataFrame, slice_: list[str], number: Column, name: str, *columns: str) -> DataFrame:
    """Rows gathered by slice and block ``number``; ``name`` holds them as structs."""
    return df.withColumn("__block", number).groupBy(*slice_, "__block").agg(F.collect_list(F.struct(*columns)).alias(name))


def counts(queries: DataFrame, gallery: DataFrame, slice_: list[str], kind: str) -> DataFrame:
    """query_instance_id, representation, gallery_size, n_ahead of each query that has a gallery.

    queries: query_instance_id, ``slice_``, vec, beat, best_key, own_keys.  gallery: ``slice_``, key, mean (null if it has no direction)."""
    of = lambda df, d, n_q, n_g: df.select(*slice_, d.alias("d"), F.lit(n_q).alias("q"), F.lit(n_g).alias("g"))
    each = of(queries, F.size("vec"), 1, 0).unionByName(of(gallery, F.lit(1), 0, 1)).groupBy(*slice_).agg(F.max("d").alias("d"), F.sum("q").alias("q"), F.sum("g").alias("g"))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) * F.col("d") / VALUES)).cast("int")
    sizes = each.where("q > 0 and g > 0").select(*slice_, blocks("q").alias("q_blocks"), blocks("g").alias("g_blocks"))
    groups = lambda n: F.sequence(F.lit(0), F.floor((F.col(n) - 1) / GROUP).cast("int"))
    group_of = lambda block: F.floor(F.col(block) / GROUP).cast("int")
    by = [*slice_, "__block"]
    q = packed(queries.join(sizes, slice_), slice_, F.pmod(F.xxhash64("query_instance_id"), F.col("q_blocks")), "asked", "query_instance_id", "vec", "beat", "best_key", "own_keys")
    g = packed(gallery.join(sizes, slice_), slice_, F.pmod(F.xxhash64("key"), F.col("g_blocks")), "held", "key", "mean")
    q = q.join(sizes, slice_).select(*by, "asked", group_of("__block").alias("q_group"), F.explode(groups("g_blocks")).alias("g_group")).drop("__block")
    g = g.join(sizes, slice_).select(*by, "held", group_of("__block").alias("g_group"), F.explode(groups("q_blocks")).alias("q_group")).drop("__block")
    met = q.join(g, [*slice_, "q_group", "g_group"]).select("representation", "asked", "held")
    id_kind = queries.schema["query_instance_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                asked, held = batch.column("asked")[i].values, batch.column("held")[i].values
                n = len(asked)
                columns = [asked.field("query_instance_id"), pa.array([batch.column("representation")[i].as_py()] * n, pa.string()), pa.array(np.full(n, len(held))), pa.array(ahead(asked, held, kind))]
                yield pa.RecordBatch.from_arrays(columns, names=["query_instance_id", "representation", "n", "ahead"])

    parts = met.mapInArrow(run, f"query_instance_id {id_kind}, representation string, n bigint, ahead bigint")
    return parts.groupBy("query_instance_id", "representation").agg(F.sum("n").alias("gallery_size"), F.sum("ahead").alias("n_ahead"))
