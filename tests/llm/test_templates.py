"""Template windows: copies, re-parameterised questions, contradictory slots, clean documents."""

from __future__ import annotations

from evalframe.llm import templates
from evalframe.llm.queries import op3_template_windows

ITEM = ("A train leaves the old station with 12 wagons and rides 340 km to the north while Anna counts 12 bridges and waves at "
        "every single farmer on the road until evening")
SHORT = "two plus two is four"


def held(docs_of, spark, docs, items):
    items = spark.createDataFrame(items, "item_id long, text string, doc_id string, hash long")
    rows = templates.contaminated(docs_of(docs), "doc_id", "text", items, "item_id", "text").collect()
    return sorted((r["doc_id"], r["item_id"], r["copied"]) for r in rows)


def test_kinds_of_contamination(spark, docs_of):
    other = ITEM.replace("12", "57").replace("340", "99").replace("Anna", "Boris")
    torn = ITEM.replace("12 wagons", "57 wagons").replace("12 bridges", "58 bridges")
    docs = [
        (1, "Before this text. " + ITEM + ". And more text after it."), (2, ITEM.upper()), (3, "Words first. " + other),
        (4, torn), (5, " ".join(ITEM.split()[:11]) + " and nothing else of it"), (6, "A quite clean document about trains."),
        (7, None), (8, ""), (9, SHORT), (10, "it says " + SHORT), (None, ITEM), (1, "Before this text. " + ITEM), (11, " " * 50_000 + ITEM),
    ]
    items = [(100, ITEM, "x", 1), (101, SHORT, "x", 1), (102, None, "x", 1), (103, "", "x", 1), (None, ITEM, "x", 1)]
    got = held(docs_of, spark, docs, items)
    assert got == [(1, 100, True), (2, 100, True), (3, 100, False), (9, 101, True), (11, 100, True)]


def test_items_of_placeholders(spark, docs_of):
    sums, names = "12 + 30 = 42 and 7 + 8 = 15 or 9 + 1 = 10", "of Anna Berta Clara Dora Emma Frida Greta Hanna Ida Jutta"
    items = [(100, sums, "x", 1), (101, names, "x", 1), (102, "1234", "x", 1), (103, "1 2 3 4 5 6 7 8 9 10", "x", 1)]
    docs = [(1, "It says " + sums + " in the end"), (2, "It says " + names + " came in"), (3, "1234"), (4, "1235"),
            (5, "row 1 2 3 4 5 6 7 8 9 10 11"), (6, "row 9 8 7 6 5 4 3 2 1 0"), (7, "of Jutta Ida Hanna Greta Frida Emma Dora Clara")]
    assert held(docs_of, spark, docs, items) == [(1, 100, True), (2, 101, True), (3, 102, True), (5, 103, True)]


def test_short_items_inside_and_long_runs(spark, docs_of):
    long = " ".join(f"w{i}x{i * i}" for i in range(500)).replace("w", "word")
    part = " ".join(long.split()[100:300])
    docs = [(1, "it says " + SHORT + " and a lot more than that"), (2, SHORT), (3, "first " + part + " last"), (4, "a why b c"),
            (5, " ".join(long.split()[:31])), (6, "two plus two is five or so it says here"), (7, " ".join(long.split()[8:40]))]
    items = spark.createDataFrame(
        [(100, SHORT, "x", 1), (101, long, "x", 1), (102, "Why?", "x", 1)], "item_id long, text string, doc_id string, hash long")
    rows = templates.contaminated(docs_of(docs), "doc_id", "text", items, "item_id", "text", inside=True).collect()
    assert sorted((r["doc_id"], r["item_id"], r["n_matched"]) for r in rows) == [
        (1, 100, 1), (2, 100, 1), (3, 101, 193), (4, 102, 1), (7, 101, 25)]


def test_one_contradicted_value(spark, docs_of):
    tail = " then they all sat down beside the river and ate bread with cheese before the 88 wagons moved on to the next stop"
    edited = ITEM.replace("12 bridges", "13 bridges")
    torn = (ITEM + tail).replace("12 wagons", "57 wagons").replace("12 bridges", "58 bridges")
    docs = [(1, "First. " + edited), (2, "First. " + torn), (3, "First. " + ITEM + tail), (4, ITEM.replace("12 wagons", "57 wagons"))]
    got = held(docs_of, spark, docs, [(100, ITEM, "x", 1), (101, ITEM + tail, "x", 1)])
    assert got == [(1, 100, False), (2, 101, False), (3, 100, True), (3, 101, True), (4, 100, False)]


def test_empty_tables(spark, docs_of):
    assert held(docs_of, spark, [], [(1, ITEM, "x", 1)]) == []
    assert held(docs_of, spark, [(1, ITEM)], []) == []


def test_every_whole_copy_is_found(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = {(d, i) for d, text in docs.items() for i, item in items.items() if item.lower() in text.lower()}
    got = {(r["doc_id"], r["item_id"]) for r in op3_template_windows(spark, sf).collect()}
    words = {i: set(t.lower().split()) for i, t in items.items()}
    assert want and want <= got
    assert all(len(words[i] & set(docs[d].lower().split())) > 0.4 * len(words[i]) for d, i in got)
