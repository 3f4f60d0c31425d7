"""Nearest neighbours by largest inner product over randomly rotated one-bit codes.

A vector o in a block with centre c is c + r u, u of length one.  A seeded orthogonal matrix turns u; its code is the sign
of each turned component, packed 64 to a word.  The code stands for a point x of length one, and <q, o> = <q, c> + r <q, u>
is estimated by <q, x> / <x, u> for <q, u>; r and <x, u> are the correction scalars kept beside the code.  A query is turned
too and cut into ``PLANES`` planes of bits, so <q, x> is a few ANDs and counts of bits.  What the planes leave out is bounded
exactly; the error of the code is a random direction's share, so it stays within ``sigmas`` standard deviations,
|q| sqrt(1 - <x, u>^2) / <x, u> / sqrt(D - 1) each.  A vector is reranked, by its exact inner product, if its estimate plus
both bounds reaches the k-th best exact product known so far; no number of candidates is set.

All vectors are coded, in blocks of ``BLOCK`` dealt round robin; blocks of queries meet blocks of vectors by an equi-join on
groups of these.  A task keeps the best of each query it works on, so a group sends k rows for a query, not k for a block.
The work is that of a set of queries against all rows: it grows with their product.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows without an id, take no part;
vectors meet queries of their own dimension only; rows that repeat an id are candidates each, and of queries that share an
id the least vector asks, against every row of another id; equal products go by the smaller id; k or fewer candidates are
all returned; products beyond the range of the estimate are reranked; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concord.llm.common import met_in_groups, written

BLOCK, QUERIES, GROUP = 4096, 1024, 8
PLANES, SEED = 6, 42
#: Queries of a block that are estimated at once, and blocks of queries whose best a task remembers.
TOGETHER, REMEMBERED = 64, 64
CODED = "block bigint, dim int, ids binary, vectors binary, centre binary, codes binary, scalars binary"
ASKED = "query_block bigint, query_dim int, query_ids binary, query_vectors binary"


@lru_cache(maxsize=4)
def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def bits(signs: np.ndarray) -> np.ndarray:
    """Rows of booleans packed into 64-bit words; the last word is filled up with zeros."""
    n, dim = signs.shape
    full = np.zeros((n, -(-dim // 64) * 64), np.uint8)
    full[:, :dim] = signs
    return np.packbits(full, axis=1).view(np.uint64)


def encoded(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, codes, scalars): scalars are r, <x, u> and the number of bits set, for each vector."""
    v = vectors.astype(np.float64)
    centre = v.mean(0)
    rest = v - centre
    r = np.sqrt((rest * rest).sum(1))
    u = (rest / np.where(r > 0, r, 1)[:, None]) @ rotation(v.shape[1])
    codes = bits(u > 0)
    align = np.abs(u).sum(1) / np.sqrt(v.shape[1])
    return centre, codes, np.stack((r, np.where(r > 0, align, 1), np.bitwise_count(codes).sum(1)))


class Asked:
    """A block of queries, turned and cut into planes, with the best found so far: ``k`` products and ids each."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors = ids, vectors.astype(np.float64)
        turned = self.vectors @ rotation(vectors.shape[1])
        self.low = turned.min(1)
        self.step = (turned.max(1) - self.low) / (2**PLANES - 1)
        whole = np.rint((turned - self.low[:, None]) / np.where(self.step > 0, self.step, 1)[:, None]).astype(np.int64)
        self.planes = [bits((whole >> p) & 1) for p in range(PLANES)]
        self.sum = turned.sum(1)
        self.off = np.abs(turned - self.low[:, None] - self.step[:, None] * whole).sum(1)
        self.norm = np.sqrt((self.vectors * self.vectors).sum(1))
        self.products, self.found = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
        self.n = np.zeros(len(ids), np.int64)

    def bounds(self, some: slice, codes: np.ndarray, centre: np.ndarray, scalars: np.ndarray, sigmas: float) -> tuple[np.ndarray, np.ndarray]:
        """(estimates, bounds from above) of the products of some queries with all vectors of a block."""
        dim = self.vectors.shape[1]
        r, align, ones = scalars
        met = np.zeros((some.stop - some.start, len(codes)), np.int32)
        for p, plane in enumerate(self.planes):
            for w in range(codes.shape[1]):
                met += np.bitwise_count(plane[some, w, None] & codes[None, :, w]).astype(np.int32) << p
        root, q = np.sqrt(dim), self.vectors[some]
        dot = (2 * (self.low[some, None] * ones + self.step[some, None] * met) - self.sum[some, None]) / root
        base = q @ centre
        estimate = base[:, None] + r * dot / align
        spread = sigmas * np.sqrt(np.maximum(1 - align * align, 0)) / align / np.sqrt(max(dim - 1, 1))
        bound = r * (self.off[some, None] / (root * align) + self.norm[some, None] * spread)
        bound += 1e-9 * self.norm[some, None] * (r + np.sqrt(centre @ centre))  # rounding
        return estimate, estimate + bound

    def meet(self, ids: np.ndarray, vectors: np.ndarray, centre: np.ndarray, codes: np.ndarray, scalars: np.ndarray, sigmas: float) -> int:
        """Take a block's vectors into the best found; the number of vectors reranked."""
        k, reranked = self.products.shape[1], 0
        vectors = vectors.astype(np.float64)
        slack = 1e-12 * self.norm * np.sqrt((vectors * vectors).sum(1).max())  # above what orders of summation differ by
        for begin in range(0, len(self.ids), TOGETHER):
            some = slice(begin, min(begin + TOGETHER, len(self.ids)))
            estimate, upper = self.bounds(some, codes, centre, scalars, sigmas)
            own = self.ids[some, None] == ids[None, :]
            least = np.where(self.n[some] == k, self.products[some, -1], -np.inf)
            if np.isinf(least).any() and len(ids) > k + 1:  # the most promising give a first threshold
                first = np.argpartition(np.where(own, -np.inf, estimate), -k, axis=1)[:, -k:]
                rows = np.repeat(np.arange(len(first)), k)
                exact = np.where(own[rows, first.ravel()], -np.inf, products(self.vectors[some], rows, vectors, first.ravel())).reshape(first.shape)
                least = np.maximum(least, exact.min(1))
            rows, cols = np.nonzero(~(upper < least[:, None]) & ~own)
            reranked += len(rows)
            # a first sum tells which are far enough to spare them the sum that counts
            near = ~(quick(self.vectors[some], rows, vectors, cols) < (least - slack[some])[rows])
            rows, cols = rows[near], cols[near]
            if len(rows):
                self.keep(rows + begin, ids[cols], products(self.vectors[some], rows, vectors, cols))
        return reranked

    def keep(self, rows: np.ndarray, ids: np.ndarray, exact: np.ndarray) -> None:
        k, of = self.products.shape[1], np.unique(rows)
        held = np.arange(k)[None, :] < self.n[of, None]
        rows = np.concatenate((rows, np.repeat(of, self.n[of])))
        ids, exact = np.concatenate((ids, self.found[of][held])), np.concatenate((exact, self.products[of][held]))
        by = np.lexsort((ids, -exact, rows))
        rows, ids, exact = rows[by], ids[by], exact[by]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        top = place < k
        self.products[rows[top], place[top]], self.found[rows[top], place[top]] = exact[top], ids[top]
        self.n[of] = np.minimum(np.bincount(rows, minlength=len(self.ids))[of], k)

    def best(self) -> pa.RecordBatch:
        held = np.arange(self.products.shape[1])[None, :] < self.n[:, None]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, self.n)), pa.array(self.found[held]), pa.array(self.products[held])], names=["query_id", "vec_id", "score"])


def quick(queries: np.ndarray, rows: np.ndarray, vectors: np.ndarray, cols: np.ndarray, at_once: int = 1 << 12) -> np.ndarray:
    """Inner products of pairs, summed in any order."""
    parts = [(queries[rows[a : a + at_once]] * vectors[cols[a : a + at_once]]).sum(1) for a in range(0, len(rows), at_once)]
    return np.concatenate(parts) if parts else np.zeros(0)


def products(queries: np.ndarray, rows: np.ndarray, vectors: np.ndarray, cols: np.ndarray, at_once: int = 1 << 14) -> np.ndarray:
    """Inner products of pairs, summed from the first component on, so equal vectors have equal products."""
    out = np.zeros(len(rows))
    for a in range(0, len(rows), at_once):
        terms = queries[rows[a : a + at_once]] * vectors[cols[a : a + at_once]]
        for term in np.ascontiguousarray(terms.T):
            out[a : a + at_once] += term
    return out


def sound(vector: str) -> Column:
    """Whether a vector takes part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _blocks(size: int, kind: str, coded: bool):
    """Rows (vec_id, vector) to blocks of one dimension each, coded or as they are."""

    def row(number: int, dim: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, v = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        values = [number, dim, ids.tobytes(), v.tobytes()]
        if coded:
            values += [x.tobytes() for x in encoded(v)]
        names = [c.split()[0] for c in (CODED if coded else ASKED).split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, [pa.int64(), pa.int32(), *[pa.binary()] * (len(values) - 2)], strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, open_ = TaskContext.get().partitionId() << 32, {}
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            flat, ends = lists.flatten().to_numpy().astype(kind), np.cumsum(lists.value_lengths().to_numpy())
            dims = lists.value_lengths().to_numpy()
            for dim in np.unique(dims).tolist():
                of = np.flatnonzero(dims == dim)
                v = flat[(ends[of] - dim)[:, None] + np.arange(dim)]
                while len(of):
                    held = open_.setdefault(dim, [])
                    room = size - sum(len(h[0]) for h in held)
                    held.append((ids[of[:room]], v[:room]))
                    of, v = of[room:], v[room:]
                    if sum(len(h[0]) for h in held) == size:
                        yield row(number, dim, open_.pop(dim))
                        number += 1
        for dim, held in open_.items():
            yield row(number, dim, held)
            number += 1

    return run


def neighbours(vectors: DataFrame, every: int = 20, k: int = 20, vector: str = "embedding", vec_id: str = "vec_id", sigmas: float = 4.0) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of each row whose id is divisible by ``every``, nearest first."""
    kind = "<f4" if dict(vectors.dtypes)[vector] == "array<float>" else "<f8"
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast(f"array<{'float' if kind == '<f4' else 'double'}>").alias("v")).where(F.col("vec_id").isNotNull() & sound("v"))
    asks = F.col("vec_id") % every == 0
    few = {"parquet.block.row.count.limit": str(GROUP)}  # a row group is written and read as a whole
    n, n_queries = rows.agg(F.count("*"), F.count_if(asks)).first()
    # a task to a block only while these are few: tasks, files and map outputs are kept by the driver
    parts = min(-(-n // BLOCK), max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // (GROUP * BLOCK))))
    stored = written(rows.repartition(max(1, parts)).mapInArrow(_blocks(BLOCK, kind, True), CODED), "codes", **few)
    asking = rows.where(asks).groupBy("vec_id").agg(F.min("v").alias("v")).repartition(max(1, -(-n_queries // QUERIES)))
    queries = written(asking.mapInArrow(_blocks(QUERIES, kind, False), ASKED), "asking", **few)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[int, Asked] = OrderedDict()
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                dim, number = r["dim"], r["query_block"]
                if number not in known:
                    if len(known) == REMEMBERED:
                        yield known.popitem(last=False)[1].best()
                    known[number] = Asked(np.frombuffer(r["query_ids"], np.int64), np.frombuffer(r["query_vectors"], kind).reshape(-1, dim), k)
                ids = np.frombuffer(r["ids"], np.int64)
                scalars = np.frombuffer(r["scalars"]).reshape(3, -1)
                known[number].meet(ids, np.frombuffer(r["vectors"], kind).reshape(-1, dim), np.frombuffer(r["centre"]), np.frombuffer(r["codes"], np.uint64).reshape(len(ids), -1), scalars, sigmas)
        for asked in known.values():
            yield asked.best()

    met = met_in_groups(queries, stored, GROUP).where("dim = query_dim")
    found = met.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
q AS (SELECT vec_id AS query_id, min(v) AS q FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id),
s AS (SELECT query_id, vec_id, list_inner_product(q, v) AS score FROM q JOIN v ON vec_id <> query_id AND len(q) = len(v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
