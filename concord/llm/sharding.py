"""Two-pass external shuffle into shards, by DataFrame functions alone.

Pass one scatters rows over buckets of about ``bucket_rows`` rows by a seeded hash.  Pass two shuffles each bucket by
Fisher-Yates: a fold over the places of the bucket from the last to the second that swaps each with a place drawn by a
seeded hash.  The draws depend on seed, bucket and place alone, so a task that is run again after a lost executor gives
the same order.  Buckets laid end to end give every row its place in one shuffled sequence, which is cut into shards of
sizes at most one apart (law ``rows``); ``slot`` counts from zero in each shard.  ``write_shards`` writes each bucket's
rows from where they are, in the order of their slots, into the folders of their shards.

Rows are moved once, by bucket.  Only bucket sizes take part in the permutation; each bucket's is made in a task of its
own partition and meets the bucket's rows there.  A fold keeps the places in rows of ``WIDE``, so a swap copies two such
rows, not the bucket.

Edge cases: a null text has size 16 and the checksum of the empty text; null ids are scattered by the text's checksum;
repeated rows are kept, each in a slot of its own; fewer rows than shards leave the last shards short; an empty table
gives an empty table; input columns named like the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concord.llm.common import text_or_empty, written

#: Bytes that count for every record besides its text.
OVERHEAD = 16
#: Places in one row of the fold's table; about the root of a bucket's size.
WIDE = 48


def permutation(n: Column, bucket: Column, seed: int) -> Column:
    """A Fisher-Yates shuffle of 0 .. n-1 as an array; draws are hashes of seed, bucket and place."""
    row, column = lambda i: F.floor(i / WIDE).cast("int"), lambda i: i % WIDE
    put = lambda a, k, x: F.concat(F.slice(a, F.lit(1), k), F.array(x), F.slice(a, k + 2, F.size(a)))

    def with_value(table: Column, i: Column, x: Column) -> Column:
        return put(table, row(i), put(F.get(table, row(i)), column(i), x))

    def swapped(table: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(F.lit(seed), bucket, i), i + 1).cast("int")
        at = lambda k: F.get(F.get(table, row(k)), column(k))
        # the table with one value in place is bound to a name, for the second to be put into it
        once = F.transform(F.array(F.struct(with_value(table, i, at(j)).alias("t"), at(i).alias("x"), j.alias("j"))), lambda s: with_value(s["t"], s["j"], s["x"]))
        return F.when(i == j, table).otherwise(F.get(once, F.lit(0)))

    places = F.when(n > 1, F.sequence(n - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    start = F.transform(F.sequence(F.lit(0), row(n - 1)), lambda r: F.sequence(r * WIDE, F.least(r * WIDE + WIDE, n) - 1))
    return F.flatten(F.aggregate(places, start, swapped))


def keyed(df: DataFrame, text: str, doc_id: str) -> DataFrame:
    body = text_or_empty(text)
    return df.withColumn("size", (F.octet_length(body) + OVERHEAD).cast("bigint")).withColumn("text_crc32", F.crc32(body.cast("binary")))


def shuffled(df: DataFrame, n_shards: int, seed: int = 7, text: str = "text", doc_id: str = "doc_id", bucket_rows: int = 2048) -> DataFrame:
    """``df`` with size, text_crc32, shard and slot, law ``rows``.

    One count of the rows sets the number of buckets; a bucket's size is binomial, so far above ``bucket_rows`` it
    never gets unless rows repeat."""
    total = df.count()
    buckets = max(1, -(-total // bucket_rows))
    rows = keyed(df, text, doc_id)
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64(F.lit(seed), doc_id, "text_crc32"), F.lit(buckets)))
    sizes = written(rows.groupBy("__bucket").agg(F.count("*").cast("int").alias("n")), "buckets")
    before = F.sum("n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))  # one row per bucket
    sizes = written(sizes.select("__bucket", "n", F.coalesce(before, F.lit(0)).alias("__before")), "places")
    # the folds run where the rows of their buckets are; one row per bucket is joined
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = sizes.repartition(parts, "__bucket").select("__bucket", "__before", permutation(F.col("n"), F.col("__bucket"), seed).alias("__order"))
    rank = F.row_number().over(Window.partitionBy("__bucket").orderBy(doc_id, "text_crc32", "size")) - 1
    ranked = rows.repartition(parts, "__bucket").withColumn("__rank", rank)
    placed = ranked.join(order.hint("merge"), "__bucket").withColumn("__at", F.col("__before") + F.get("__order", F.col("__rank")))
    # shard s holds the places from s*total/n up to (s+1)*total/n, rounded down
    shard = F.expr(f"cast(((__at + 1) * {n_shards} - 1) div {max(1, total)} as int)")
    placed = placed.withColumn("__shard", shard).withColumn("__slot", F.col("__at") - F.expr(f"(cast(__shard as bigint) * {total}) div {n_shards}"))
    return placed.select(*(F.col(c) for c in rows.columns if c not in ("__bucket", "shard", "slot")), F.col("__shard").alias("shard"), F.col("__slot").alias("slot"))


def write_shards(df: DataFrame, path: str, n_shards: int, seed: int = 7, **names: str) -> None:
    """Write the shuffled rows under ``path``, one folder per shard, each file in slot order.

    Each task writes the buckets it shuffled; a bucket's slots follow each other, so it is in one shard or a few."""
    shuffled(df, n_shards, seed, **names).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def read_shards(df: DataFrame, path: str) -> DataFrame:
    """The rows of the shards of ``df`` under ``path``, with size, text_crc32, slot and shard."""
    added = {"size": "bigint", "text_crc32": "bigint", "slot": "bigint", "shard": "int"}
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in added)
    return df.sparkSession.read.schema(", ".join([kept, *(f"{c} {k}" for c, k in added.items())])).parquet(path)
