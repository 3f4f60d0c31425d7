"""Decontamination: occurrences, names in any spelling, items of few literal words."""

import random

from pyspark.sql import functions as F

from concord.llm import decontam

ITEM = "Tom has 12 apples and buys 15 more apples at 3 dollars each so how many apples does Tom hold after paying 36 dollars in all"
FAR = " ".join(f"z{i}" for i in range(30))


def found(spark, items, docs, **how):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in decontam.contaminated(df, bench, **how).collect()}


def test_each_occurrence_is_judged(spark):
    one = ITEM.replace("12", "70").replace("15", "81").replace("36", "99")
    two = ITEM.replace("12", "40").replace("15", "22").replace("3 dollars", "5 dollars").replace("36", "55")
    wild = ITEM.replace("12", "70", 1).replace("Tom hold", "Ann hold").replace("3 dollars", "5 dollars").replace("36 dollars", "8 dollars")
    docs = [f"{ITEM} {wild}", f"{FAR} {one} {FAR} {two}", f"{one} {two}", f"{ITEM} {FAR} Ann has 99 apples and buys nothing", f"{FAR} {FAR}", one.replace("each so", "each well then so")]
    assert set(found(spark, [ITEM], docs)) == {(i, 0) for i in (0, 1, 2, 3, 5)}
    # one slot value that meets two within an occurrence is still no copy
    clash = "the first box holds 7 red balls while the second box holds 7 red balls in it"
    assert not found(spark, [clash], [clash.replace("7", "8", 1)])


def test_names_in_any_spelling(spark):
    item = "Maria and Jonas went from Lisbon to Porto with Clara because Hugo had lost the map of Madrid before the summer"
    start = "Name the capital of France"
    renamed = item.replace("Maria", "Olga").replace("Jonas", "Peter").replace("Lisbon", "Vienna").replace("Clara", "Sonja")
    docs = [item.lower(), item.upper(), item.replace(" ", "\n"), item.replace(" ", "  "), f"{FAR} please {start[0].lower()}{start[1:]} for me", f"{FAR} and {item[0].lower()}{item[1:]}", renamed, f"{renamed} {item.lower()}", FAR, "Name the river of Spain"]
    assert set(found(spark, [item, start], docs)) == {(0, 0), (1, 0), (2, 0), (3, 0), (4, 1), (5, 0), (6, 0), (7, 0)}


def test_items_of_few_literal_words(spark):
    items = ["What is 12 * 34?", "Compute 17 + 25 - 9 + 4", "7 3 9 1 4 8 2", "two words", "12"]
    docs = [f"{FAR} what is 12 x 34", f"so what is 12 34 then {FAR}", f"{FAR} compute 17 25 9 4 now", f"compute 1 2 3 4 {FAR}", "5 6 7 8 9 1 2 3", f"{FAR} 7 3 9 1 4 8 2 {FAR}", "two words 12"]
    assert set(found(spark, items, docs)) == {(1, 0), (2, 1), (5, 2)}


def test_random_parameters(spark):
    """Items with fresh numbers and names inserted whole into random texts are found, and nothing else is."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("bcdfgklmnprstvz", k=2) + rng.choices("aeiou") + rng.choices("lmnrst", k=2))
    shapes, items = [], []
    for _ in range(12):
        shapes.append([rng.choice(["#", "@"]) if rng.random() < 0.2 else word() for _ in range(rng.randrange(12, 30))])

    def filled(shape):
        values = iter(rng.sample(range(2, 5000), len(shape)))
        return " ".join(str(next(values)) if x == "#" else (word() + "x").capitalize() if x == "@" else x for x in shape)

    items = [filled(s) for s in shapes]
    docs, want = [], set()
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(20, 60)))]
        for j in rng.sample(range(12), rng.randrange(3)):
            parts += [filled(shapes[j]) if rng.random() < 0.6 else items[j], " ".join(word() for _ in range(20))]
            want.add((i, j))
        docs.append(" ".join(parts))
    assert set(found(spark, items, docs)) == want


def test_item_edges(spark):
    bench = spark.createDataFrame([(1, ITEM), (1, ITEM), (None, FAR), (2, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, ITEM), (2, FAR), (None, ITEM), (3, None)], "doc_id long, text string").withColumns({"item": F.lit("clash"), "w": F.lit("clash")})
    assert sorted(map(tuple, decontam.contaminated(docs, bench).select("doc_id", "item_id").collect()), key=str) == sorted([(1, 1), (2, None), (None, 1)], key=str)
    assert decontam.clean(docs, bench).columns == docs.columns
