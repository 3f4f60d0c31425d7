"""Ranked lexical search by Block-Max WAND over compressed posting blocks.

Index.  Documents are taken as their partition holds them, in segments of at most ``DOCS`` documents or ``POSTINGS``
postings (one document more at most), so that nothing is shuffled.  A segment is one row: its documents in ascending
doc_id order with their length norms, its own dictionary of terms, and for each term its postings in blocks of ``BLOCK``.
A block is a run of variable-byte numbers, gap and occurrences in turn; beside it stand, uncompressed, its last document,
its greatest impact and its place.  Every term of every document is indexed.

Search.  Blocks of queries meet segments by an equi-join on groups of segments.  Within a segment each query runs
Block-Max WAND: the lists stand in order of their next document; the first place where the sum of the lists' greatest
impacts reaches what a document needs is the pivot.  Pointers to blocks, not to postings, are then moved to the pivot;
if the blocks' own maxima fall short, all lists jump past the nearest end of a block and nothing is decompressed.
Otherwise the blocks are opened, once per segment whatever the number of queries, and the pivot is scored.  A task that
searches many segments carries each query's threshold along.  The best of all segments are ranked in the end.

Scores are whole numbers: weight * ((10^9 tf) div (1000 tf + 8 m)) over the query's terms, repeats included.

Edge cases: null and empty texts and texts without a term are no documents of the collection; null ids rank last among
equal scores; rows that repeat are documents each, side by side in the ranking; whole texts of any length are read; items
without a known term, and an empty table on either side, give no row; queries that repeat id and text are one, those that
share an id but differ in text are ranked apart; no column but the two named ones is read, so extra ones don't matter.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concord.llm.common import discard, met_in_groups, rows_at_once, small, text_or_empty, written

BLOCK, DOCS, POSTINGS = 128, 1 << 14, 1 << 20
#: Queries that meet a segment together, and segments of a group.
QUERIES, GROUP = 256, 4
#: Segments in a row group of their table, which is written and read as a whole: a few MB each.
ROW_GROUP = 4
#: After the last document of a segment.
END = 1 << 30
SEGMENT = "block bigint, doc_ids array<bigint>, norms array<bigint>, terms array<string>, dfs array<int>, firsts array<int>, lasts array<int>, peaks array<int>, places array<int>, payload binary"
#: Letters and digits of ASCII stay, small, and all bytes beyond ASCII; the rest parts terms.
_TERMS = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TERMS).split()


# -- blocks ----------------------------------------------------------------------------------------------------------


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-byte code of numbers below 2**35, and where each number begins in it, with the end as the last."""
    size = 1 + sum((values >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    at = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(at[-1], np.uint8)
    for k in range(5):
        some = size > k
        if not some.any():
            break
        out[at[:-1][some] + k] = ((values[some] >> 7 * k) & 127) | np.where(size[some] > k + 1, 128, 0)
    return out, at


def unpacked(code: np.ndarray) -> np.ndarray:
    last = code < 128
    if last.all():
        return code.astype(np.int64)
    begins = np.concatenate(([0], np.flatnonzero(last)[:-1] + 1))
    sizes = np.diff(np.concatenate((begins, [len(code)])))
    step = np.arange(len(code)) - np.repeat(begins, sizes)
    return np.add.reduceat((code & 127).astype(np.int64) << (7 * step), begins)


class Segment:
    """Documents on their way into one segment."""

    def __init__(self):
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.sizes: list[int] = []
        self.known: dict[bytes, int] = {}
        self.codes: list[int] = []
        self.times: list[int] = []

    def add(self, doc_id: int | None, words: list[bytes]) -> None:
        known, found = self.known, Counter(words)
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        self.sizes.append(len(found))
        self.codes += [known.setdefault(w, len(known)) for w in found]
        self.times += found.values()

    def full(self) -> bool:
        return len(self.ids) >= DOCS or len(self.codes) >= POSTINGS

    def row(self, number: int, n_docs: int, n_terms: int) -> dict:
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        norms = np.array([25 + (75 * n * n_docs) // n_terms for n in self.lengths], np.int64)[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        code, doc, tf = np.array(self.codes, np.int64), np.repeat(rank, self.sizes), np.array(self.times, np.int64)
        by = np.argsort(code * len(order) + doc)
        code, doc, tf = code[by], doc[by], tf[by]
        dfs = np.bincount(code, minlength=len(self.known))
        begin = np.cumsum(dfs) - dfs  # of each term
        within = np.arange(len(code)) - begin[code]
        starts = np.flatnonzero(within % BLOCK == 0)
        gap = doc - np.where(within == 0, -1, np.concatenate(([0], doc[:-1])))
        payload, at = packed(np.stack((gap, tf), axis=1).ravel())
        impact = (10**9 * tf) // (1000 * tf + 8 * norms[doc])
        ends = np.concatenate((starts[1:], [len(code)]))
        firsts = np.concatenate(([0], np.cumsum(-(-dfs // BLOCK))))
        return {
            "block": number, "doc_ids": [self.ids[i] for i in order], "norms": norms, "terms": [w.decode("utf-8", "surrogatepass") for w in self.known], "dfs": dfs.astype(np.int32),
            "firsts": firsts.astype(np.int32), "lasts": doc[ends - 1].astype(np.int32), "peaks": np.maximum.reduceat(impact, starts).astype(np.int32), "places": at[2 * np.append(starts, len(code))].astype(np.int32), "payload": payload.tobytes(),
        }


_ARROW = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("norms", pa.list_(pa.int64())), ("terms", pa.list_(pa.string())), *((c, pa.list_(pa.int32())) for c in ("dfs", "firsts", "lasts", "peaks", "places")), ("payload", pa.binary())])


def _lengths(texts: pa.Array) -> pa.Array:
    return pa.array([len(terms(t.as_py())) for t in texts], pa.int64())


def collection(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Documents with a term, and all their terms."""
    n = docs.select(F.arrow_udf(_lengths, "bigint")(text_or_empty(text)).alias("n"))
    row = n.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    return row["docs"], row["terms"]


def index(docs: DataFrame, n_docs: int, n_terms: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Segments over all documents, one row each, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, segment = TaskContext.get().partitionId() << 32, Segment()
        for batch in batches:
            for key, whole in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if words := terms(whole.as_py()):
                    segment.add(key, words)
                if segment.full():
                    yield pa.RecordBatch.from_pylist([segment.row(number, n_docs, n_terms)], _ARROW)
                    number, segment = number + 1, Segment()
        if segment.ids:
            yield pa.RecordBatch.from_pylist([segment.row(number, n_docs, n_terms)], _ARROW)

    return written(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_or_empty(text).alias("t")).mapInArrow(run, SEGMENT), "segments", **{"parquet.block.row.count.limit": str(ROW_GROUP)})


# -- queries ---------------------------------------------------------------------------------------------------------


def _counted(texts: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("term", pa.string()), ("times", pa.int64())]))
    return pa.array([[{"term": w.decode("utf-8", "surrogatepass"), "times": k} for w, k in Counter(terms(t.as_py())).items()] for t in texts], kind)


def weighted(items: DataFrame, segments: DataFrame, n_docs: int, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """block, queries: the items in blocks, each with its known terms and their weights (times the repeats)."""
    asked = items.select(F.col(item_id).cast("bigint").alias("item_id"), text_or_empty(text).alias("t")).distinct().withColumn("item", F.xxhash64("item_id", "t"))
    each = asked.select("item_id", "item", F.xxhash64(F.reverse("t")).alias("other"), F.inline(F.arrow_udf(_counted, "array<struct<term:string,times:bigint>>")("t")))
    each = written(each, "asked")
    wanted = small(written(each.select("term").distinct(), "wanted"))
    df = segments.select(F.inline(F.arrays_zip("terms", "dfs"))).withColumnRenamed("terms", "term").join(wanted, "term").groupBy("term").agg(F.sum("dfs").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1))).cast("bigint")
    known = each.join(small(written(df.withColumn("w", weight), "weights")), "term").where("w > 0")
    one = known.groupBy("item_id", "item", "other").agg(F.collect_list("term").alias("terms"), F.collect_list(F.col("w") * F.col("times")).alias("weights"))
    one = written(one, "queries")
    blocks = -(-one.count() // QUERIES)
    return one.groupBy(F.pmod("item", F.lit(max(1, blocks))).alias("query_block")).agg(F.collect_list(F.struct("item_id", "item", "other", "terms", "weights")).alias("queries"))


class Lists:
    """The posting lists of one segment; blocks are opened once."""

    def __init__(self, row: dict, wanted: list[str]):
        self.payload = np.frombuffer(row["payload"], np.uint8)
        self.norms, self.firsts, self.lasts, self.peaks, self.places = (row[c].values.to_numpy() for c in ("norms", "firsts", "lasts", "peaks", "places"))
        at = pa.compute.index_in(pa.array(wanted, pa.string()), value_set=row["terms"].values)
        self.term = {w: i for w, i in zip(wanted, at.to_pylist(), strict=True) if i is not None}
        self.seen: dict[str, tuple] = {}
        self.opened: dict[int, tuple[list[int], list[int]]] = {}

    def of(self, term: str) -> tuple | None:
        """(greatest impact, first block, last document of each block, greatest impact of each block) of a term."""
        if term not in self.term:
            return None
        if term not in self.seen:
            a, b = self.firsts[self.term[term]], self.firsts[self.term[term] + 1]
            peaks = self.peaks[a:b].tolist()
            self.seen[term] = max(peaks), int(a), self.lasts[a:b].tolist(), peaks
        return self.seen[term]

    def open(self, block: int, before: int) -> tuple[list[int], list[int]]:
        """Documents and impacts of a block; ``before`` is the last document of the term's previous one, or -1."""
        if block not in self.opened:
            both = unpacked(self.payload[self.places[block] : self.places[block + 1]])
            docs, tf = before + np.cumsum(both[::2]), both[1::2]
            self.opened[block] = docs.tolist(), ((10**9 * tf) // (1000 * tf + 8 * self.norms[docs])).tolist()
        return self.opened[block]


def best(lists: Lists, terms_: list[str], weights: list[int], k: int, least: int = 1) -> list[tuple[int, int]]:
    """The ``k`` best (score, -document) of a segment with a score of ``least`` or more, equal scores by document; a heap."""
    ub, weight, base, lasts, peaks = [], [], [], [], []
    for term, w in zip(terms_, weights, strict=True):
        if found := lists.of(term):
            ub.append(w * found[0])
            weight.append(w)
            base.append(found[1])
            lasts.append(found[2])
            peaks.append(found[3])
    n = len(ub)
    cur, exact, shallow = [0] * n, [False] * n, [0] * n  # next document or one before it; whether it is that very one; its block
    at, held = [0] * n, [(-1, [], [])] * n  # place in the opened block; its number, documents and impacts
    top: list[tuple[int, int]] = []
    order = list(range(n))

    def deep(j: int, d: int) -> None:
        """Move list ``j`` to its first document from ``d`` on."""
        ends = lasts[j]
        b = bisect_left(ends, d, shallow[j])
        if b == len(ends):
            cur[j], exact[j] = END, True
            return
        shallow[j] = b
        if held[j][0] != b:
            held[j], at[j] = (b, *lists.open(base[j] + b, ends[b - 1] if b else -1)), 0
        docs = held[j][1]
        at[j] = i = bisect_left(docs, d, at[j])
        cur[j], exact[j] = docs[i], True

    while n:
        order.sort(key=cur.__getitem__)
        acc, p = 0, -1
        for i, j in enumerate(order):
            acc += ub[j]
            if acc >= least:
                p = i
                break
        if p < 0 or (d := cur[order[p]]) >= END:
            break
        while p + 1 < n and cur[order[p + 1]] == d:
            p += 1
        bound, turn = 0, END
        for j in order[: p + 1]:
            ends = lasts[j]
            b = shallow[j]
            if ends[b] < d:
                b = bisect_left(ends, d, b)
                if b == len(ends):
                    cur[j], exact[j] = END, True
                    continue
                shallow[j] = b
            bound += weight[j] * peaks[j][b]
            if ends[b] < turn:
                turn = ends[b]
        if bound < least:  # no document up to the nearest end of a block can do
            to = turn + 1
            if p + 1 < n and cur[order[p + 1]] < to:
                to = cur[order[p + 1]]
            for j in order[: p + 1]:
                if cur[j] < to:
                    cur[j], exact[j] = to, False
            continue
        for j in order[: p + 1]:
            if not exact[j] or cur[j] < d:
                deep(j, d)
                if cur[j] != d:
                    bound -= weight[j] * peaks[j][shallow[j]] if cur[j] < END else 0
                    if bound < least:
                        break
        if bound >= least:
            score = 0
            for j in order[: p + 1]:
                if cur[j] == d:
                    score += weight[j] * held[j][2][at[j]]
            if score >= least:
                if len(top) < k:
                    heappush(top, (score, -d))
                else:
                    heapreplace(top, (score, -d))
                if len(top) == k:
                    least = max(least, top[0][0] + 1)
        for j in order[: p + 1]:
            if cur[j] <= d:
                i = at[j] + 1
                if exact[j] and cur[j] == d and i < len(held[j][1]):
                    at[j], cur[j] = i, held[j][1][i]
                else:
                    cur[j], exact[j] = d + 1, False
    return top


def search(docs: DataFrame, items: DataFrame, k: int = 10, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item."""
    n_docs, n_terms = collection(docs, text)
    segments = index(docs, n_docs, n_terms, text, doc_id)
    queries = written(weighted(items, segments, n_docs, text, item_id), "query_blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                asked = row["queries"].as_py()
                lists = Lists(row | {"payload": row["payload"].as_py()}, list({t for q in asked for t in q["terms"]}))
                ids, out = row["doc_ids"].as_py(), []
                for q in asked:
                    so_far = least.setdefault((q["item"], q["other"]), [])
                    for score, d in sorted(best(lists, q["terms"], q["weights"], k, so_far[0] if len(so_far) == k else 1), reverse=True):
                        out.append((q["item_id"], q["item"], q["other"], ids[-d], score))
                        if len(so_far) < k:
                            heappush(so_far, score)
                        elif score > so_far[0]:
                            heapreplace(so_far, score)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 5)], names=["item_id", "item", "other", "doc_id", "score"])

    # segments go to Python one by one, however many a task holds; the best of each task are few
    with rows_at_once(docs.sparkSession, 1):
        found = written(met_in_groups(queries, segments, GROUP).mapInArrow(run, "item_id bigint, item bigint, other bigint, doc_id bigint, score bigint"), "found")
    discard(segments, queries)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "other").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))))
    return ranked.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SPLIT = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_PATTERN}')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT} AS ts FROM documents),
k AS (SELECT *, CAST(len(ts) AS BIGINT) AS n FROM d WHERE len(ts) > 0),
s AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM k),
q AS (SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark),
a AS (SELECT item_id, text, term, count(*) AS times FROM (SELECT item_id, text, unnest({_SPLIT}) AS term FROM q) GROUP BY ALL),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(ts) AS term FROM k) WHERE term IN (SELECT term FROM a) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(s.nd) + 2) / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, s GROUP BY term),
p AS (SELECT item_id, text, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * s.nd) // s.l)))) AS BIGINT) AS score
  FROM a JOIN w USING (term) JOIN tf USING (term), s GROUP BY ALL),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM p WHERE score > 0)
SELECT * FROM o WHERE rank <= 10
"""
