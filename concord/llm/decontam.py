"""Benchmark decontamination by template canonicalisation, in DataFrame functions alone.

Texts become sequences of lower-cased words, in which numbers, units after numbers and names (capitalised words) can be
typed placeholders.  Each window of ``width`` words has up to three forms: as it stands, with numbers and units typed,
and with names typed too.  The forms of every window of every document are hash-joined to those of the benchmark.  So a
copy with other names and numbers meets the third form, a lower-cased, wrapped or embedded copy the second, and an item
made of numbers and names, whose typed forms say nothing, the first.  A document that holds enough of an item's windows
is then looked at again with places and slot values: each slot value of the item must meet one value throughout an
occurrence, whichever it is, so a re-parameterised question is caught, however many copies a document holds, while
texts that merely share a form are not.

A pair counts when one occurrence, or the document as a whole, has at least ``coverage`` of the item's windows, or
``run`` windows, and at least ``consistent`` of the item's slots agree.  A typed form is used where it has three literal
words or more; a window without such a form is met by its very words and values alone.  An item shorter than a window
is one window of its own length, met by its very words; an item of fewer than three words is not searched for, as its
words prove nothing.

Edge cases: null or empty texts hold no window; a row is known by doc_id and text together, so null ids work and rows
that repeat both count once in ``contaminated`` and are dropped together by ``clean``; whole texts are read; empty
tables on either side give no pair; extra columns are carried by ``clean`` and ignored by ``contaminated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concord.llm.common import small, text_or_empty, written

# Placeholders are one control character before the value they stand for.
NUM, UNIT, NAME = "\u0002", "\u0003", "\u0004"
UNITS = tuple("percent|km|kilometers|kilometres|miles|m|meters|metres|cm|mm|feet|ft|inches|kg|kilograms|grams|g|mg|pounds|lb|liters|litres|ml|l|hours|hour|h|minutes|minute|min|seconds|second|s|ms|days|day|weeks|week|months|month|years|year|dollars|cents|euros|usd|eur|mph|kmh|volts|watts|kw|degrees|gb|mb|kb|tb".split("|"))
#: Words: runs of letters, numbers with their points and commas, other digits one by one.
TOKEN = r"[\p{L}\p{M}]+|[0-9]+(?:[.,][0-9]+)*|\p{N}"
LITERALS = 3
#: The band that stands for a whole document.
WHOLE = -(1 << 31)


def number(x: Column) -> Column:
    return x < ":"  # of all that a word can begin with only digits are less


def typed(x: Column, before: Column) -> Column:
    """A word lower-cased, or the placeholder of a number or of a unit after one."""
    return F.when(number(x), NUM).when(number(before) & F.lower(x).isin(*UNITS), UNIT).otherwise(F.lower(x))


def named(x: Column, form: Column) -> Column:
    """``form``, the word ``x`` in its typed form, or the placeholder of a name."""
    return F.when((x != F.lower(x)) & (form == F.lower(x)) & (F.length(x) > 1) & (F.initcap(x) == x), NAME).otherwise(form)


def forms(df: DataFrame, key: list[str], hashes: bool) -> DataFrame:
    """``key``, v, b, a: the words of ``df.t`` as they stand, with numbers and units typed, and with names typed too.

    With ``hashes`` the arrays hold the words' hashes; then one projection makes all three from the words."""
    of = F.xxhash64 if hashes else lambda c: c
    out = df.select(*key, F.col("t").rlike("[0-9]").alias("d"), F.regexp_extract_all("t", F.lit(TOKEN), F.lit(0)).alias("k"))
    plain = F.transform("k", lambda x: of(F.lower(x)))
    before = lambda i: F.get("k", i - 1)
    # without a digit there are names alone to type
    b = F.when(F.col("d"), F.transform("k", lambda x, i: of(typed(x, before(i)))))
    a = F.when(F.col("d"), F.transform("k", lambda x, i: of(named(x, typed(x, before(i)))))).otherwise(F.transform("k", lambda x: of(named(x, F.lower(x)))))
    return out.select(*key, plain.alias("v"), b.alias("b"), a.alias("a")).withColumn("b", F.coalesce("b", "v"))


def windows(of: DataFrame, key: list[str], width: int, *arrays: str) -> DataFrame:
    """``key`` and elements 0 to width - 1 from each place on of each array (v: v0, v1, ...); null past the end.

    The shifted arrays are laid side by side and opened as rows, so what follows is generated code."""
    shifted = [F.slice(c, k + 1, F.size(c)).alias(f"{c}{k}") for c in arrays for k in range(width)]
    return of.select(*key, F.inline(F.arrays_zip(*shifted)))


def hashed(df: DataFrame, key: list[str], width: int, short: list[int]) -> DataFrame:
    """``key``, h: the forms of all windows of ``df.t``; windows of ``short`` widths as they stand."""
    of = lambda c, n: F.when(F.col(f"{c}{n - 1}").isNotNull(), F.xxhash64(*(f"{c}{k}" for k in range(n))))
    rows = windows(forms(df, key, True), key, width, "v", "b", "a").select(*key, *(of(c, width).alias(c) for c in "vba"), *(of("v", n).alias(f"s{n}") for n in short))
    other = lambda c: F.when(F.col(c) != F.col("b"), F.col(c))
    return rows.select(*key, F.explode(F.array("b", other("v"), other("a"), *(f"s{n}" for n in short))).alias("h")).where("h is not null")


def detailed(df: DataFrame, key: list[str], width: int, short: list[int]) -> DataFrame:
    """``key``, n (words of the text), at, h, w (words of the form) and v (as they stand) of each form of each window."""

    def row(c: str, n: int) -> Column:
        words = lambda x: [F.col(f"{x}{k}") for k in range(n)]
        return F.when(F.col(f"{c}{n - 1}").isNotNull(), F.struct(F.xxhash64(*map(F.xxhash64, words(c))).alias("h"), F.array(*words(c)).alias("w"), F.array(*words("v")).alias("v")))

    of = forms(df, key, False)
    of = of.select(*key, "v", "b", "a", F.size("v").alias("n"), F.when(F.size("v") == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size("v") - 1)).alias("at"))
    rows = windows(of, [*key, "n"], width, "v", "b", "a", "at").withColumnRenamed("at0", "at")
    found = F.array_distinct(F.array(*(row(c, width) for c in "vba"), *(row("v", n) for n in short)))
    return rows.select(*key, "n", "at", F.explode(found).alias("x")).where("x is not null").select(*key, "n", "at", "x.*")


def itemised(benchmark: DataFrame, width: int) -> DataFrame:
    """item, item_id, h, bat, bw, bv, bn: the forms by which each window of each distinct item is found."""
    bench = benchmark.select("item_id", text_or_empty("text").alias("t")).withColumn("item", F.xxhash64("item_id", "t")).dropDuplicates(["item"])
    rows = detailed(bench, ["item", "item_id"], width, list(range(LITERALS, width)))
    numbers = F.exists("w", lambda x: (x >= "0") & number(x))  # placeholders are less than "0"
    enough = ~numbers & (F.size(F.filter("w", lambda x: x > "\u0005")) >= LITERALS)
    whole = (F.col("n") >= width) & (F.size("w") == width)
    by_place = Window.partitionBy("item", "at")
    rows = rows.withColumn("enough", whole & enough).withColumn("said", F.max("enough").over(by_place))
    used = F.col("enough") | (whole & ~F.col("said") & numbers) | ((F.col("n") < width) & (F.size("w") == F.col("n")))
    return rows.where(used).select("item", "item_id", "h", F.col("at").alias("bat"), F.col("w").alias("bw"), F.col("v").alias("bv"), F.col("n").alias("bn"))


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, coverage: float = 0.5, run: int = 9, consistent: float = 0.8, slack: int = 8) -> DataFrame:
    """One row per pair of document and item: doc_id, text_hash, item_id, n_windows, n_matched, n_slots, n_changed."""
    items = written(itemised(benchmark, width), "items")
    short = [r["n"] for r in items.where(F.col("bn") < width).select(F.col("bn").alias("n")).distinct().collect()]  # two lengths at most
    index = small(written(items.select("item", "h", "bat"), "index"))
    sizes = small(written(items.groupBy("item").agg(F.any_value("item_id").alias("item_id"), F.count_distinct("bat").alias("n_windows")), "sizes"))
    base = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("t")).withColumn("text_hash", F.xxhash64("t"))
    hits = hashed(base, ["doc_id", "text_hash"], width, short).join(index, "h")
    counted = hits.groupBy("doc_id", "text_hash", "item").agg(F.count_distinct("bat").alias("n")).join(sizes, "item")
    enough = (F.col("n") >= coverage * F.col("n_windows")) | (F.col("n") >= run)
    pairs = written(counted.where(enough).drop("n").withColumn("pair", F.monotonically_increasing_id()), "pairs")
    # again, with places and values, for documents that passed
    some = small(written(pairs.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__h")).distinct(), "some"))
    seen = base.join(some, (F.col("text_hash") == F.col("__h")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    seen = detailed(seen.dropDuplicates(["doc_id", "text_hash"]), ["doc_id", "text_hash"], width, short)
    met = seen.drop("n").join(small(items.drop("item_id")), "h").where(F.col("w") == F.col("bw"))
    of = small(pairs.select("pair", F.col("doc_id").alias("__id"), F.col("text_hash").alias("__h"), F.col("item").alias("__item")))
    met = met.join(of, met["doc_id"].eqNullSafe(of["__id"]) & (met["text_hash"] == of["__h"]) & (met["item"] == of["__item"]))
    judged = occurrences(met, slack).join(small(pairs), "pair").where(enough)
    judged = judged.where((F.col("n_slots") == 0) | (F.col("n_same") >= consistent * F.col("n_slots")))
    names = ("doc_id", "text_hash", "item_id", "n_windows", "n", "n_slots", "n_changed")
    best = judged.groupBy("pair").agg(F.max_by(F.struct(*names), F.struct(F.col("band") == WHOLE, "n", -F.col("n_changed"), "band")).alias("x"))
    return best.select("x.*").withColumnRenamed("n", "n_matched")


def occurrences(met: DataFrame, slack: int) -> DataFrame:
    """pair, band, n, n_slots, n_same, n_changed: matched windows and slots of each whole document and of each band in it.

    An occurrence lies on a diagonal, the place in the document less that in the item, up to insertions of ``slack`` words
    (a quarter of the item at most, so that copies side by side are never in one band).  Bands are two such steps wide and
    overlap by one.  Where an item's slot is met more than once in a band, the diagonal with most windows counts."""
    step = F.greatest(F.lit(1), F.least(F.lit(slack), F.floor(F.col("bn") / 4))).cast("int")
    slots = F.filter(F.transform(F.arrays_zip("bw", "bv", "v"), lambda x, i: F.struct((F.col("bat") + i).alias("p"), x["bw"].alias("bw"), x["bv"].alias("bv"), x["v"].alias("v"))), lambda x: x["bw"] < "\u0005")
    slots = F.transform(slots, lambda x: F.struct(x["p"].alias("p"), x["bv"].alias("bv"), x["v"].alias("v")))
    lines = met.select("pair", step.alias("step"), (F.col("at") - F.col("bat")).alias("off"), "bat", slots.alias("slots"))
    lines = lines.groupBy("pair", "step", "off").agg(F.collect_set("bat").alias("ids"), F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots"))
    first = F.floor(F.col("off") / F.col("step")).cast("int")
    lines = written(lines.select("pair", "off", "ids", "slots", F.explode(F.array(first, first - 1, F.lit(WHOLE))).alias("band")), "lines")
    windows = lines.select("pair", "band", F.explode("ids").alias("id")).groupBy("pair", "band").agg(F.count_distinct("id").alias("n"))
    filled = lines.select("pair", "band", "off", F.size("ids").alias("support"), F.inline("slots"))
    # the whole document is judged by all that its slots meet
    once = filled.groupBy("pair", "band", "p", F.when(F.col("band") == WHOLE, F.col("off")).alias("of")).agg(F.max_by(F.struct("bv", "v"), F.struct("support", -F.col("off"))).alias("x"))
    each = once.select("pair", "band", "x.*").groupBy("pair", "band", "bv").agg(F.count_distinct("v").alias("n"), F.min("v").alias("v"))
    counts = each.groupBy("pair", "band").agg(F.count("*").alias("n_slots"), F.count_if(F.expr("n = 1")).alias("n_same"), F.count_if(F.expr("n > 1 or v <> bv")).alias("n_changed"))
    return windows.join(counts, ["pair", "band"], "left").fillna(0, ["n_slots", "n_same", "n_changed"])


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """``docs`` without the rows that hold an item; columns and values as they were."""
    bad = contaminated(docs, benchmark, text, doc_id, **how).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__h")).distinct()
    bad = small(written(bad, "bad"))
    on = (F.xxhash64(text_or_empty(docs[text])) == bad["__h"]) & docs[doc_id].eqNullSafe(bad["__id"])
    return docs.join(bad, on, "left_anti")
