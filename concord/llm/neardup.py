"""SimHash near-duplicates with deletion-variant signatures.

A fingerprint of 64 bits is cut into the fewest segments of which one must differ by at most one bit: fingerprints
within ``radius`` bits need ``radius // 2 + 1`` segments (three for 4 or 5 bits).  A segment that differs by no bit is
found under its own value, one that differs by a bit under its variant with that bit struck out.  Each fingerprint is
indexed under its segments and one-wildcard variants (``variants`` says how many), and an equality join of these with
a check of the distance finds every link.

Copies share a fingerprint and are joined first, by aggregation.  Before the join, each bucket is tied to its smallest
and its largest fingerprint wherever that lies within the radius: as many rows as the bucket has.  Only buckets that
then still hold fingerprints of different components go to the join, under keys lengthened by a block of the other
bits (``lengthened``), which emits verified links between components alone.  So a large group of near copies never
becomes all of its pairs, unrelated fingerprints seldom meet, yet every link counts.

Edge cases: a null or empty text has fingerprint zero and is linked like any other; fewer words than a shingle give
one shingle, the whole sequence; a null doc_id is carried along and never chosen as a component's id unless the
component has no other; repeated rows stay repeated; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.common import components, discard, least_of, small, text_or_empty, written

_LANES = np.uint64(0x0101010101010101)
#: MinHash: bands of so many rows; a pair at Jaccard 0.8 shares no band once in 300,000 times.
BANDS, BAND_ROWS = 32, 5
#: Classes of texts to a block in ``close_pairs`` at most.
CLASSES = 16
_ODD = np.random.default_rng(5).integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, width: int) -> list[bytes]:
    """Shingles of the lower-cased words (white space of ASCII between them), repeats included; as UTF-8."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    flat = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    return [flat[a : b - 1] for a, b in zip([0, *ends], ends[width - 1 :], strict=False)]


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the 64-bit hashes ``h``; zero for none."""
    if not len(h):
        return 0
    counts = np.zeros((8, 8), dtype=np.int64)  # [bit in byte, byte]
    for part in (h[i : i + 255] for i in range(0, len(h), 255)):  # eight counters of a byte to a word
        for bit in range(8):
            counts[bit] += ((part >> np.uint64(bit)) & _LANES).sum(dtype=np.uint64).reshape(1).view(np.uint8)
    over = 2 * counts > len(h)
    return sum(1 << (8 * byte + bit) for bit in range(8) for byte in range(8) if over[bit, byte])


def hashes(of: Iterable[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, 42) for s in of], dtype=np.uint64)


def fingerprint(text: str, width: int = 4) -> int:
    """Unsigned fingerprint: a bit is 1 if it is set in over half of the shingles' XXH64 (seed 42)."""
    return majority(hashes(shingles(text, width)))


def fingerprints(df: DataFrame, text: str = "text", width: int = 4) -> Column:
    """Column of fingerprints as signed longs."""

    def prints(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(x.as_py(), width) for x in texts], dtype=np.uint64).view(np.int64))

    return F.arrow_udf(prints, "bigint")(text_or_empty(text))


#: Buckets of more fingerprints than this go on under lengthened keys; in smaller ones all are compared.
SHORT = 256


def cuts(radius: int) -> list[int]:
    """Bounds of the ``radius // 2 + 1`` segments; the last one, where it is not struck out, is three bits shorter."""
    n = radius // 2 + 1
    last = round(64 / n) - 3 * (radius % 2 == 0)
    return [round((64 - last) * i / (n - 1)) for i in range(n)] + [64]


def variants(fp: Column, radius: int) -> Column:
    """Array of (key, bit): every whole segment, and one-wildcard variants of as many segments as are needed.

    Of ``n`` segments either one agrees in full (its key has no bit), or each differs; then at least ``2n - radius``
    differ in exactly one bit, so one of any ``radius - n + 1`` segments does: only the first so many are struck out, a
    bit at a time.  ``bit`` is the value of the struck bit, in which the two fingerprints must differ."""
    ends = cuts(radius)
    keys, n = [], len(ends) - 1
    for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
        segment = F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1))
        # 35 bits at most are left for a segment; above them the place of the struck bit, or 64 and the segment
        keys.append(F.struct((segment + F.lit((64 + i) << 40)).alias("key"), F.lit(None).cast("tinyint").alias("bit")))
        if i < radius - n + 1:
            keys += [F.struct((segment.bitwiseAND(F.lit(~(1 << (x - a)) & ((1 << (b - a)) - 1))) + F.lit(x << 40)).alias("key"), F.getbit(fp, F.lit(x)).alias("bit")) for x in range(a, b)]
    return F.array(*keys)


def lengthened(fp: Column, key: Column, radius: int) -> Column:
    """Array of keys, each ``key`` and a block of the bits outside its segment: two fingerprints within ``radius`` bits
    that share the key share a block too, as fewer bits differ outside than there are blocks."""
    ends = cuts(radius)
    place = F.shiftright(key, 40)
    out = None
    for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
        # the bits outside: those above the segment moved down onto those below it
        low = fp.bitwiseAND(F.lit((1 << a) - 1))
        rest = low if b == 64 else F.shiftleft(F.shiftrightunsigned(fp, b), a).bitwiseOR(low)
        wide = 64 - (b - a)
        cases = []
        for whole in (False, True):  # beside a struck bit that differs one bit less can differ outside
            blocks = radius + whole
            at = [round(wide * k / blocks) for k in range(blocks + 1)]
            parts = [F.shiftrightunsigned(rest, x).bitwiseAND(F.lit((1 << (y - x)) - 1)).bitwiseOR(F.lit(k << 58)) for k, (x, y) in enumerate(zip(at, at[1:], strict=False))]
            cases.append(F.array(*parts))
        here = F.when((place >= a) & (place < b), cases[0]).when(place == 64 + i, cases[1])
        out = here if out is None else F.coalesce(out, here)
    return out


def indexed(prints: DataFrame, radius: int, *carried: str) -> DataFrame:
    """key, bit, fp and the carried columns: one row per variant of each row's ``fp``."""
    return prints.select("fp", *carried, F.inline(variants(F.col("fp"), radius)))


def mixed(index: DataFrame, of: str, radius: int) -> DataFrame:
    """key, lo, hi, size: the smallest and the largest ``of`` of each bucket that can hold a link of two different ones.

    A bucket of two, as most chance meetings are, is judged here by the distance of the two."""
    ends = [F.min("fp").alias("__a"), F.max("fp").alias("__b")]
    found = least_of(index, "key", F.min(of).alias("lo"), F.max(of).alias("hi"), F.min("bit").alias("zero"), F.max("bit").alias("one"), F.count("*").alias("size"), *ends)
    near = F.bit_count(F.col("__a").bitwiseXOR(F.col("__b"))) <= radius
    return found.where(F.expr("lo < hi and coalesce(zero < one, true)") & ((F.col("size") > 2) | near)).select("key", "lo", "hi", "size")


def met_once(key: Column, block: Column, apart: Column, radius: int) -> Column:
    """Of all keys and blocks that two fingerprints share, one: the first whole segment that agrees, or if none does the
    first of those that differ in one bit, and the first block that agrees."""
    place, ends = F.shiftright(key, 40), cuts(radius)
    differ = [F.bit_count(F.shiftrightunsigned(apart, a).bitwiseAND(F.lit((1 << (b - a)) - 1))) for a, b in zip(ends, ends[1:], strict=False)]
    none = F.lit(True)
    cases = None
    for i, d in enumerate(differ):
        whole = (place == 64 + i) & none
        cases = whole if cases is None else cases | whole
        none = none & (d > 0)
    for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
        first = (place >= a) & (place < b) & none & (F.getbit(apart, place.bitwiseAND(F.lit(63)).cast("int")) == 1)
        for d in differ[:i]:
            first = first & (d > 1)
        cases = cases | first
    top = F.lit(15 << 58)
    agree = F.filter(lengthened(apart, key, radius), lambda x: x.bitwiseAND(top) == x)
    return cases & ((block < 0) | (block.bitwiseAND(top) == F.array_min(agree)))


def near_pairs(rooted: DataFrame, radius: int) -> DataFrame:
    """(a, b, ra, rb): pairs of fingerprints of different roots within ``radius`` bits, of ``rooted`` (fp, root), each once.

    Only rows of mixed buckets go on.  A bucket of more than ``SHORT`` rows is divided by a block of the other bits, so
    that chance meetings stay few however full buckets are."""
    index = indexed(rooted, radius, "root")
    open_ = written(index.drop("bit").join(mixed(index, "root", radius).select("key", "size"), "key"), "open")
    blocks = F.when(F.col("size") <= SHORT, F.array(F.lit(-1).cast("bigint"))).otherwise(lengthened(F.col("fp"), F.col("key"), radius))
    longer = open_.select("key", "fp", "root", F.explode(blocks).alias("block"))
    x, y = (longer.select("key", "block", F.col("fp").alias(n), F.col("root").alias(f"r{n}")) for n in "ab")
    apart = F.col("a").bitwiseXOR(F.col("b"))
    met = (x["key"] == y["key"]) & (x["block"] == y["block"]) & (F.col("ra") < F.col("rb")) & (F.bit_count(apart) <= radius)
    return x.join(y, met & met_once(x["key"], x["block"], apart, radius)).select("a", "b", "ra", "rb")


def tied(prints: DataFrame, radius: int) -> DataFrame:
    """(a, b): links of fingerprints to the smallest and the largest of each bucket; as many rows as the buckets have."""
    near = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= radius
    index = indexed(prints, radius)
    ends = index.drop("bit").join(mixed(index, "fp", radius), "key")
    ties = [ends.where(f"fp <> {end}").where(near("fp", end)).select(F.col("fp").alias("a"), F.col(end).alias("b")) for end in ("lo", "hi")]
    return ties[0].union(ties[1]).distinct()


def links(prints: DataFrame, radius: int) -> DataFrame:
    """Components of distinct fingerprints ``(fp)`` linked at ``radius`` or fewer differing bits: (fp, root) of all."""
    if radius < 2:
        raise ValueError("a radius of at least 2 is needed")
    stars = written(tied(prints, radius), "stars")
    first = small(components(stars).select(F.col("node").alias("fp"), "root"))
    rooted = written(prints.join(first, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "rooted")
    between = written(near_pairs(rooted, radius).select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "between")
    second = components(between)
    joined = rooted.join(small(second), rooted["root"] == second["node"], "left").select("fp", F.coalesce(second["root"], rooted["root"]).alias("root"))
    out = written(joined, "linked")
    discard(stars, rooted, between)
    return out


def classes(prints: DataFrame, radius: int) -> DataFrame:
    """Of rows ``(doc_id, fp)``: for each distinct fingerprint its component's smallest fingerprint and doc_id."""
    each = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "classes")
    linked = links(each.select("fp"), radius)
    both = each.join(linked, "fp")
    # only components of several fingerprints need their ids put together
    ids = small(written(both.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n")).where("n > 1").drop("n"), "ids"))
    out = written(both.join(ids, "root", "left").select("fp", "root", F.coalesce("component_id", "first").alias("component_id"), "copies"), "component")
    discard(each, linked, ids)
    return out


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 4, radius: int = 4) -> DataFrame:
    """One row per row of ``df``: doc_id, fp (signed long), component_id (smallest doc_id reachable, itself included)."""
    prints = written(df.select(F.col(doc_id).alias("doc_id"), fingerprints(df, text, width).alias("fp")), "prints")
    return prints.join(classes(prints, radius).select("fp", "component_id").hint("merge"), "fp").select("doc_id", "fp", "component_id")


# -- one document of each group --------------------------------------------------------------------------------------


def band_keys(h: np.ndarray) -> np.ndarray:
    """One key per band of minima over the hashes ``h`` of distinct shingles; none for none."""
    if not len(h):
        return h
    least = np.full(len(_ODD), ~np.uint64(0))
    for at in range(0, len(h), 512):
        x = h[at : at + 512, None] * _ODD
        np.minimum(least, (x ^ (x >> np.uint64(32))).min(0), out=least)
    rows = np.column_stack([np.arange(BANDS, dtype=np.uint64), least.reshape(BANDS, BAND_ROWS)])
    return np.array([xxhash.xxh3_64_intdigest(r.tobytes()) for r in rows], dtype=np.uint64)


def signatures(text: str, width: int) -> Column:
    """The fingerprint over distinct shingles and after it the band keys."""

    def prints(texts: pa.Array) -> pa.Array:
        found = (hashes(set(shingles(x.as_py(), width))) for x in texts)
        rows = [np.append(np.uint64(majority(h)), band_keys(h)).view(np.int64) for h in found]
        pa.default_memory_pool().release_unused()
        return pa.array(rows, pa.list_(pa.int64()))

    return F.arrow_udf(prints, "array<bigint>")(text_or_empty(text))


def shingle_sets(texts: DataFrame, width: int, most: int = 250_000) -> DataFrame:
    """(h, s): the hashes of each text's distinct shingles, of ``texts`` (h, t); about ``most`` leave a task at once."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bodies = batch.column("h"), batch.column("t")
            begin, held, n = 0, [], 0
            for i in range(batch.num_rows):
                held.append(hashes(set(shingles(bodies[i].as_py(), width))).view(np.int64))
                n += len(held[-1])
                if n >= most or i + 1 == batch.num_rows:
                    yield pa.record_batch([keys.slice(begin, len(held)), pa.array(held, pa.list_(pa.int64()))], names=["h", "s"])
                    begin, held, n = i + 1, [], 0
            del batch, keys, bodies
            pa.default_memory_pool().release_unused()

    return texts.select("h", "t").mapInArrow(sets, "h bigint, s array<bigint>")


def sets_of(wanted: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The written shingle sets (h, s) of the texts whose hashes ``wanted`` (h) holds; ``texts`` is (h, t) with repeats."""
    once = texts.join(small(wanted), "h", "left_semi").groupBy("h").agg(F.any_value("t").alias("t"))
    return written(shingle_sets(once, width), "sets")


def _similar(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those of the pairs ``(a, b)`` of text hashes whose shingle sets are similar; ``texts`` is (h, t) with repeats."""
    pairs = written(pairs.distinct(), "pairs")
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct(), "wanted")
    sets = sets_of(wanted, texts, width)
    x, y = sets.select(F.col("h").alias("a"), F.col("s").alias("x")), sets.select(F.col("h").alias("b"), F.col("s").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    either = F.size("x") + F.size("y") - both
    out = written(pairs.join(x, "a").join(y, "b").where(both >= similarity * either).select("a", "b"), "similar")
    discard(pairs, wanted, sets)
    return out


def _of_several(banded: DataFrame) -> DataFrame:
    """Rows of ``banded`` (key, h, root) in buckets that hold several roots."""
    several = least_of(banded, "key", F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    return banded.join(several, "key", "left_semi")


def hopeful(banded: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``banded`` (key, h, root) less rows that cannot be similar to any text of their bucket, and buckets left with one root.

    ``own`` shingles of a text are in no other text of ``banded``.  What it shares with a partner is at most the rest; both
    together hold its own shingles and the whole partner, which has at least ``similarity`` of its size, and no fewer than
    the smallest set of the bucket.  Texts left out lose no link, so the bound may be drawn again over those that stay."""
    there = written(banded.select("h").distinct(), "there")
    single = sets.join(small(there), "h", "left_semi").select("h", F.explode("s").alias("s")).groupBy("s").agg(F.count("*").alias("n"), F.min("h").alias("h")).where("n = 1")
    own = single.groupBy("h").agg(F.count("*").alias("own"))
    sizes = written(sets.select("h", F.size("s").alias("size")).join(own, "h", "left").select("h", "size", F.coalesce("own", F.lit(0)).alias("own")), "sizes")
    rows = banded.join(small(sizes), "h")
    met = rows.join(least_of(rows, "key", F.min("size").alias("fewest")), "key")
    least = similarity * (F.greatest(similarity * F.col("size"), "fewest") + F.col("own"))
    # written before it is read from two sides
    able = written(met.where(F.col("size") - F.col("own") + 1e-6 >= least).select("key", "h", "root"), "able")
    out = written(_of_several(able), "hopeful")
    discard(there, sizes, able)
    return out


def sharing_once(banded: DataFrame) -> DataFrame:
    """(a, b): pairs of different roots that share a key of ``banded`` (key, h, root), each once."""
    x, y = (banded.select("key", F.col("h").alias(n), F.col("root").alias(f"r{n}")) for n in "ab")
    met = (x["key"] == y["key"]) & (F.col("ra") < F.col("rb"))
    return x.join(y, met).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def blocks_of(banded: DataFrame) -> DataFrame:
    """(h, block): texts that share a key of ``banded`` (key, h, root), directly or by way of others, have one block."""
    ends = banded.join(least_of(banded, "key", F.min("h").alias("lo")), "key")
    return components(ends.select(F.col("h").alias("a"), F.col("lo").alias("b"))).select(F.col("node").alias("h"), F.col("root").alias("block"))


def close_pairs(banded: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs of texts of one block among which are links enough to tie all similar texts of ``banded`` (key, h, root).

    A block's core are the shingles of more than half of its texts, a text's ``d`` those in which it differs from the core.
    Two texts differ in as many shingles as their ``d`` hold together, less twice the common ones, so they are similar if
    and only if ``d`` and ``d`` have at least half of ``slack + slack`` in common, where slack is the size of ``d`` less
    (1 - similarity) / (1 + similarity) of the text's own.  Where that is no more than nothing, both are similar to the
    text of the least slack, to which they are tied: as many rows as texts.  All other pairs share one of the rarest
    elements of both (of ``n`` all but the last ``k - 1``, if ``k`` must be shared), under which they are met.  ``k`` hangs
    on the partner's slack, so texts are put under each class of partners apart."""
    share, bit = (1 - similarity) / (1 + similarity), 1e-6
    blocks = written(blocks_of(banded), "blocks")
    texts = written(banded.select("h", "root").distinct().join(small(blocks), "h").join(sets, "h"), "blocked")
    sizes = texts.groupBy("block").agg(F.count("*").alias("texts"))
    often = texts.select("block", F.explode("s").alias("s")).groupBy("block", "s").agg(F.count("*").alias("n")).join(sizes, "block").where("2 * n > texts")
    cores = written(often.groupBy("block").agg(F.collect_list("s").alias("core")), "cores")
    core = F.coalesce("core", F.array().cast("array<bigint>"))
    apart = texts.join(small(cores), "block", "left").withColumn("d", F.concat(F.array_except("s", core), F.array_except(core, "s")))
    apart = written(apart.select("block", "h", "root", "d", (F.size("d") - share * F.size("s")).alias("slack")), "apart")
    ends = apart.groupBy("block").agg(F.min(F.struct("slack", "h", "root")).alias("least"), F.max("slack").alias("most"), F.count("*").alias("texts"))
    ends = written(ends.select("block", "least.slack", F.col("least.h").alias("mid"), F.col("least.root").alias("lead"), "most", F.least(F.lit(CLASSES), F.ceil(F.sqrt("texts"))).alias("classes")).withColumnRenamed("slack", "fewest"), "ends")
    placed = apart.join(small(ends), "block").withColumn("c", F.coalesce(F.floor(F.expr("try_divide(slack - fewest, most - fewest)") * F.col("classes")), F.lit(0)).cast("int"))
    placed = written(placed.withColumn("beside", F.col("slack") + F.col("fewest")).drop("fewest", "most", "classes"), "placed")
    ties = placed.where((F.col("beside") <= bit) & (F.col("root") != F.col("lead"))).select(F.least("h", "mid").alias("a"), F.greatest("h", "mid").alias("b"))
    # roots that the ties join count as one
    sure = written(placed.where(F.col("beside") <= -bit).select("block", "root", F.lit(True).alias("sure")).distinct(), "sure")
    classes = placed.groupBy("block", "c").agg(F.min("slack").alias("low")).groupBy("block").agg(F.collect_list(F.struct("c", "low")).alias("classes"))
    classes = written(classes, "classes")
    each = placed.select("block", "h", F.explode("d").alias("s"))
    common = written(each.groupBy("block", "s").agg(F.count("*").alias("n")).where("n > 1"), "common")
    rarest = written(each.join(common, ["block", "s"]).groupBy("h").agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("rarest")), "rarest")
    whole = placed.drop("d", "mid").join(small(sure), ["block", "root"], "left").join(small(classes), "block").join(rarest, "h")
    under = whole.select("block", "h", F.when(F.col("sure"), F.col("lead")).otherwise(F.col("root")).alias("root"), "c", "slack", "rarest", F.explode("classes").alias("other"))
    shared = F.greatest(F.lit(1), F.ceil((F.col("slack") + F.col("other.low")) / 2 - bit)).cast("int")
    first = F.slice("rarest", F.lit(1), F.greatest(F.lit(0), F.size("rarest") - shared + 1))
    keyed = under.select("block", "h", "root", F.least("c", "other.c").alias("i"), F.greatest("c", "other.c").alias("j"), F.explode(first).alias("x"))
    keys = written(keyed.select(F.xxhash64("block", "i", "j", "x.s").alias("key"), "h", "root"), "keys")
    out = written(ties.union(sharing_once(written(_of_several(keys), "meeting"))), "close")
    discard(blocks, texts, cores, apart, ends, placed, sure, classes, common, rarest, keys)
    return out


def text_groups(texts: DataFrame, prints: DataFrame, width: int, radius: int, similarity: float) -> DataFrame:
    """(h, root) of all distinct texts: components of links between texts.

    ``texts`` is (h, t) with repeats, ``prints`` is (h, w0, bands), one row per text.  As in ``links``, each bucket is first
    tied to its smallest and its largest member; the joins that follow emit pairs of different components only, and of
    texts that share a band only those that ``hopeful`` leaves and ``close_pairs`` finds."""
    near = lambda found: found.select(F.col("a").alias("fp"), "b").join(by_print.withColumnRenamed("h", "a"), "fp").select("a", F.col("b").alias("fp")).join(by_print.withColumnRenamed("h", "b"), "fp").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # texts with one print are tied to the smallest of them, which stands for the print
    each = prints.select("h", F.col("w0").alias("fp"))
    by_print = written(each.groupBy("fp").agg(F.min("h").alias("h")), "by_print")
    alike = each.withColumnRenamed("h", "b").join(by_print, "fp").where("h <> b").select(F.col("h").alias("a"), "b")
    pairs = alike.union(near(written(tied(by_print.select("fp"), radius), "ties")))
    banded = prints.select("h", F.explode("bands").alias("key"))
    ends = banded.join(least_of(banded, "key", F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo < hi"), "key")
    for e in ("lo", "hi"):
        pairs = pairs.union(ends.where(f"h <> {e}").select(F.least("h", e).alias("a"), F.greatest("h", e).alias("b")))
    first = _similar(pairs, texts, width, similarity)
    linked = small(components(first))
    rooted = written(prints.join(linked, prints["h"] == linked["node"], "left").select("h", "w0", "bands", F.coalesce("root", "h").alias("root")), "rooted")
    lead = rooted.join(by_print, "h").select("fp", "root")
    banded = rooted.select("h", "root", F.explode("bands").alias("key"))
    open_ = written(_of_several(banded), "open")
    sets = sets_of(written(open_.select("h").distinct(), "wanted"), texts, width)
    last, open_ = open_, hopeful(open_, sets, similarity)
    sharing = close_pairs(open_, sets, similarity)
    discard(last, sets)
    second = _similar(near(near_pairs(lead, radius)).union(sharing), texts, width, similarity)
    linked = small(components(first.union(second)))
    out = written(rooted.join(linked, rooted["h"] == linked["node"], "left").select("h", F.coalesce(linked["root"], rooted["h"]).alias("root")), "grouped")
    discard(by_print, open_, rooted, first, sharing, second)
    return out


def one_of_each(df: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, radius: int = 4, similarity: float = 0.8) -> DataFrame:
    """``df`` less near copies: of each group the row with the smallest doc_id stays, with its columns and values.

    Groups are components of links; two texts are linked if the Jaccard similarity of their sets of ``width``-word
    shingles, over whole texts, is at least ``similarity``.  Candidates are the links of ``links`` between fingerprints of
    distinct shingles (within ``radius`` bits), and texts that share one of 32 MinHash bands of five rows, as a similarity
    of 0.8 does not put fingerprints within so few bits.  Equal texts are always linked.  Null ids come last; of rows that repeat id and text one stays.
    Texts are known by a 64-bit hash; where rows of one hash differ in length or CRC-32 all of them stay, so no text goes
    for one that it is not.  A row may hold all shingles of its text, however long; columns of the input may have any names.
    """
    body = text_or_empty(text)
    base = df.select(F.struct("*").alias("row"), F.xxhash64(body).alias("__h"), F.col(doc_id).alias("__id"), body.alias("t"), signatures(text, width).alias("sig"))
    other = F.crc32(F.encode("t", "utf-8")).bitwiseXOR(F.shiftleft(F.length("t").cast("bigint"), 32))
    rows = written(base.select("__id", "__h", other.alias("__h2"), "sig"), "prints")
    texts = rows.groupBy("__h").agg(F.min("__id").alias("first"), F.count("*").alias("copies"), F.count_if(F.col("__id").isNull()).alias("nulls"), F.any_value("sig").alias("sig"), (F.min("__h2") != F.max("__h2")).alias("mixed"))
    texts = written(texts, "texts")
    groups = text_groups(base.select(F.col("__h").alias("h"), "t"), texts.select(F.col("__h").alias("h"), F.get("sig", F.lit(0)).alias("w0"), F.slice("sig", 2, BANDS).alias("bands")), width, radius, similarity)
    known = texts.join(groups, texts["__h"] == groups["h"])
    order = F.struct(F.col("first").isNull(), "first", "__h")
    lead = known.groupBy("root").agg(F.min(order).alias("lead"))
    kept = written(known.join(lead, "root").where(F.col("__h") == F.col("lead.__h")).select("__h", "first", "copies", "mixed"), "kept")
    gone = written(texts.where("NOT mixed").join(kept, "__h", "left_anti").select("__h"), "gone")
    # of a kept text with several rows only those with the smallest id stay
    many = written(kept.where("copies > 1 AND NOT mixed").select("__h", F.col("first").alias("__first"), F.lit(True).alias("__many")), "many")
    left = base.select("row", "__h", "__id").join(small(gone), "__h", "left_anti").join(small(many), "__h", "left")
    left = left.where(F.col("__many").isNull() | F.col("__id").eqNullSafe(F.col("__first")))
    again = rows.join(small(many), "__h").where(F.col("__id").eqNullSafe(F.col("__first"))).groupBy("__h").count().where("count > 1")
    again = written(again.select("__h", F.lit(True).alias("__again")), "again")
    if not again.limit(1).count():
        return left.select("row.*")
    flagged = left.join(small(again), "__h", "left")
    once = flagged.where(F.col("__again")).groupBy("__h").agg(F.any_value("row").alias("row"))
    return flagged.where(F.col("__again").isNull()).select("row").unionByName(once.select("row")).select("row.*")
