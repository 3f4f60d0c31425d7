"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words.

Rows are dealt by a seeded hash into groups of about ``group_rows``, each packed by itself, so a task's memory is
bounded by the group and a hot source or a large cluster of copies is spread over all groups.  In a group pieces go
largest first into the open bin with the smallest residual that still fits and does not conflict.  A bin carries a
bitmap of sources, ``per_source`` bits to a source, and a bitmap of duplicate clusters; a bin never holds two members of
a cluster, nor more than ``per_source`` documents of a source.  The successor search runs over the residuals in
ascending order, by a tree that holds for each range of residuals the bits common to all its bins, so ranges that
conflict throughout are passed over at once; it ends at the tightest compatible bin or opens a new one.

A document longer than a bin is cut into pieces of the capacity, each a full bin, and one remainder that is packed;
nothing is dropped or shortened.  A document without words has size zero and still takes its place in a bin.

Edge cases: a null text is empty; a null source or id is a value like any other; equal texts are one cluster, so
repeated rows land in different bins; an empty table gives an empty table; of other columns only the named ones are
carried.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import text_or_empty

PACKED = "group bigint, bin bigint, place int, piece int, begin bigint, n_words bigint"


class Bins:
    """Open bins by residual; leaves of the tree are residuals, values are AND of the bitmaps of their bins."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.leaves = 1 << capacity.bit_length()
        self.common: dict[int, int] = {}  # node to common bits; absent: no bin below
        self.at: dict[int, list[int]] = {}  # residual to ids of bins, ascending
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.held: list[int] = []

    def _refresh(self, residual: int) -> None:
        node = self.leaves + residual
        bins = self.at.get(residual)
        if bins:
            bits = -1
            for b in bins:
                bits &= self.sources[b]
            self.common[node] = bits
        else:
            self.common.pop(node, None)
        while node > 1:
            node >>= 1
            x, y = self.common.get(2 * node), self.common.get(2 * node + 1)
            bits = y if x is None else x if y is None else x & y
            if bits is None:
                self.common.pop(node, None)
            else:
                self.common[node] = bits

    def _next(self, residual: int, full: int) -> int | None:
        """The smallest residual at or above ``residual`` where not all bins have all bits of ``full``."""
        if residual > self.capacity:
            return None
        node = self.leaves + residual
        ok = lambda n: (c := self.common.get(n)) is not None and c & full != full
        if ok(node):
            return residual
        while node > 1:
            if not node & 1 and ok(node + 1):
                node += 1
                while node < self.leaves:
                    node = 2 * node if ok(2 * node) else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Place a piece; cluster: its bit, or 0 if it has no copies.  Returns bin and place in it."""
        width = self.per_source
        full = ((1 << width) - 1) << (source * width)
        residual, found = self._next(size, full), None
        while residual is not None and found is None:
            found = next((b for b in self.at[residual] if self.sources[b] & full != full and not self.clusters[b] & cluster), None)
            if found is None:
                residual = self._next(residual + 1, full)
        if found is None:
            found, residual = len(self.held), self.capacity
            self.sources.append(0)
            self.clusters.append(0)
            self.held.append(0)
        else:
            bins = self.at[residual]
            del bins[bisect_left(bins, found)]
            if not bins:
                del self.at[residual]
        taken = (self.sources[found] & full) >> (source * width)
        self.sources[found] |= 1 << (source * width + taken.bit_count())
        self.clusters[found] |= cluster
        self.held[found] += 1
        insort(self.at.setdefault(residual - size, []), found)
        if residual != residual - size:
            self._refresh(residual)
        self._refresh(residual - size)
        return found, self.held[found] - 1


def _pack(capacity: int, per_source: int):
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "cluster", "doc_id"], ascending=[False, True, True], kind="stable", na_position="first")
        bins = Bins(capacity, per_source)
        sources: dict = {}
        copies = rows["cluster"].value_counts()
        bits = {c: 1 << i for i, c in enumerate(copies.index[copies > 1])}
        packed, whole = [], []
        for i, size, source, cluster in zip(range(len(rows)), rows["size"], rows["source"], rows["cluster"], strict=True):
            n, rest = divmod(size, capacity)
            whole += [(i, piece) for piece in range(n)]
            if rest or not n:
                known = sources.setdefault(None if pd.isna(source) else source, len(sources))
                packed.append((i, *bins.put(rest, known, bits.get(cluster, 0)), n, n * capacity, rest))
        first = len(bins.held)
        packed += [(i, first + k, 0, piece, piece * capacity, capacity) for k, (i, piece) in enumerate(whole)]
        out = pd.DataFrame(packed, columns=["i", "bin", "place", "piece", "begin", "n_words"])
        kept = rows[["doc_id", "source"]].iloc[out["i"]].reset_index(drop=True)
        return pd.concat([kept, out.drop(columns="i")], axis=1).assign(group=key[0])

    return pack


def packed(df: DataFrame, capacity: int = 2048, per_source: int = 2, group_rows: int = 8192, seed: int = 5, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """doc_id, source, group, bin (within the group), place (in the bin), piece, begin (its first word), n_words.

    One count of the rows sets the number of groups; only ids, sources, sizes and clusters are shuffled.
    A group is dealt by hash of id and text."""
    body = text_or_empty(text)
    words = F.size(F.filter(F.split(F.trim(F.translate(body, "\t\n\x0b\x0c\r", " " * 5)), " "), lambda w: w != ""))
    groups = max(1, -(-df.count() // group_rows))
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words.cast("bigint").alias("size"), F.xxhash64(body).alias("cluster"))
    rows = rows.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "cluster"), F.lit(groups)).cast("bigint"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.groupBy("group").applyInPandas(_pack(capacity, per_source), f"doc_id {kinds['doc_id']}, source {kinds['source']}, {PACKED}").select("doc_id", "source", "group", "bin", "place", "piece", "begin", "n_words")
