"""Balanced building blocks against plain Python on small, skewed data."""

from __future__ import annotations

import difflib
import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from evalframe.operators import docsets, mapping, merge, resolve, sampling
from evalframe.operators.scale import global_rank, heavy_join, hot_keys, literal_rows, lowest_share, top_k


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"k{i % 50}", i, hashlib.sha256(str(rng.random()).encode()).hexdigest()) for i in range(6000)]
    return rows, spark.createDataFrame(rows, "key string, id int, p string").cache()


@pytest.mark.parametrize("k", [1, 7, 250])
def test_top_k(skewed, k):
    rows, frame = skewed
    got = {(r.key, r.id) for r in top_k(frame, ["key"], [F.col("p"), F.col("id")], k).collect()}
    want = set()
    for key, group in itertools.groupby(sorted(rows, key=lambda r: (r[0], r[2], r[1])), key=lambda r: r[0]):
        want |= {(key, r[1]) for r in list(group)[:k]}
    assert got == want


@pytest.mark.parametrize("size,expected", [
    ("ceil(0.3D * n)", lambda n: -(-3 * n // 10)),
    ("500", lambda n: min(n, 500)), ("0", lambda n: 0), ("n", lambda n: n),
])
def test_lowest_share(skewed, size, expected):
    rows, frame = skewed
    got = {(r.key, r.id) for r in lowest_share(frame, ["key"], "p", ["id"], F.expr(size)).collect()}
    want = set()
    for key, group in itertools.groupby(sorted(rows, key=lambda r: (r[0], r[2], r[1])), key=lambda r: r[0]):
        group = list(group)
        want |= {(key, r[1]) for r in group[: expected(len(group))]}
    assert got == want


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_heavy_join(spark, skewed, how):
    """A key with two thirds of the rows, NULL keys, keys of another type on the small side."""
    _, frame = skewed
    frame = frame.withColumn("n", F.when(F.col("id") % 3 > 0, F.lit(7)).when(F.col("id") % 2 == 0, F.col("id")))
    small = spark.createDataFrame([("hot", 7, 1), ("hot", 8, 2), ("k3", 3, 3), (None, 1, 4), ("hot", 7, 5)], "key string, n long, v int")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    for on in (["key"], ["n"], ["key", "n"]):
        right = small.select(*on, "v")
        assert rows(heavy_join(frame, right, on, how)) == rows(frame.join(right, on, how)), on
        counts = frame.groupBy(*on).agg(F.count("*").alias("rows"))
        assert rows(heavy_join(frame, right, on, how, heat=hot_keys(counts, on, "rows"))) == rows(frame.join(right, on, how)), on


def test_only_hot_keys_are_copied(spark):
    """A third of 60,000 rows is one key, the others are 40,000 different ones."""
    frame = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("key"), "id")
    for heat in (hot_keys(frame, ["key"]), hot_keys(frame.groupBy("key").agg(F.count("*").alias("rows")), ["key"], "rows")):
        hot = heat.first()._hot
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert list(hot.values()) == [-(-partitions // 3)]
    none = frame.where("id < 0")
    assert hot_keys(none, ["key"]).crossJoin(spark.range(1)).count() == 1
    assert heavy_join(none, frame.select("key"), ["key"], "left").count() == 0


def test_hot_keys_are_split(spark, monkeypatch):
    frame = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("key"), "id")
    spark.conf.set("spark.sql.shuffle.partitions", 60)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = heavy_join(frame, frame.groupBy("key").agg(F.max("id").alias("last")), ["key"])
        sizes = [r["count"] for r in joined.where("key = -1").groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 10_000 and max(sizes) < 3_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_global_rank(skewed):
    rows, frame = skewed
    got = [r.id for r in sorted(global_rank(frame, [F.col("key").desc(), F.col("id")]).collect(), key=lambda r: r.position)]
    assert got == [r[1] for r in sorted(sorted(rows, key=lambda r: r[1]), key=lambda r: r[0], reverse=True)]


def test_long_literal_lists(spark):
    rows = literal_rows([(f"x{i}",) for i in range(20_000)], [("a", "string")])
    assert spark.range(1).select(F.size(rows).alias("n")).first().n == 20_000


def test_capped_samples_with_odd_priorities(spark):
    rows = [("t", 1, None), ("t", 2, "zz"), ("t", 3, "0a1b"), ("t", 4, "ffff"), ("t", 5, "0a1b"), ("u", 6, None)]
    frame = spark.createDataFrame(rows, "task string, ord int, priority string")
    for cap in (1, 2, 4, 20_000):
        order = sorted((r for r in rows if r[0] == "t"), key=lambda r: (r[2] is not None, r[2] or "", r[1]))
        got = {r.ord for r in sampling.capped_samples(frame, cap).where("task = 't'").collect()}
        assert got == {r[1] for r in order[:cap]}


def _closure(edges, roots):
    below = {}
    for a, b in edges:
        below.setdefault(a, set()).add(b)
    out = set()
    for root in roots:
        seen, todo = set(), list(below.get(root, ()))
        while todo:
            node = todo.pop()
            if node not in seen:
                seen.add(node)
                todo += below.get(node, ())
        out |= {(root, n) for n in seen}
    return out


def test_deep_hierarchy(spark):
    edges = spark.range(10_000).select(F.concat(F.lit("g"), F.col("id").cast("string")).alias("parent"),
                                       F.concat(F.lit("g"), (F.col("id") + 1).cast("string")).alias("child"))
    got = mapping.group_descendants(edges, spark.createDataFrame([("g0",), ("g9990",)], "task string"))
    assert {(r.root, r.n) for r in got.groupBy("root").agg(F.count("*").alias("n")).collect()} == {("g0", 10_000), ("g9990", 10)}


@pytest.mark.parametrize("most", [64, 0])
def test_descendants_of_odd_graphs(spark, monkeypatch, most):
    """Cycles of several lengths, diamonds, self loops, a hub of many parents and children; with and without doubling."""
    monkeypatch.setattr(mapping, "MOST_PAIRS", most)
    edges = [(f"c{n}_{i}", f"c{n}_{(i + 1) % n}") for n in (1, 2, 3, 4, 5, 7) for i in range(n)]
    edges += [("c5_1", "c7_2"), ("c7_3", "d0"), ("d0", "d1"), ("d0", "d2"), ("d1", "d3"), ("d2", "d3"), ("d3", "d0")]
    edges += [(f"p{i}", "hub") for i in range(60)] + [("hub", f"q{i}") for i in range(60)] + [("q7", "e1"), ("e1", "e2"), ("e2", "p3")]
    roots = ["c1_0", "c2_0", "c4_1", "c5_0", "d1", "p3", "p4", "e2", "none"]
    got = mapping.group_descendants(
        spark.createDataFrame(edges, "parent string, child string"), spark.createDataFrame([(r,) for r in roots], "task string"))
    assert {(r.root, r.task) for r in got.collect()} == _closure(edges, roots)


def test_no_steps_through_tasks_of_many_parents_and_children(spark):
    """Of 200 parents and 200 children the step through a hub would be 40,000 pairs for 400 edges."""
    edges = spark.range(200).selectExpr("concat('p', id) AS parent", "'hub' AS child").unionByName(
        spark.range(200).selectExpr("'hub' AS parent", "concat('q', id) AS child")).unionByName(
        spark.createDataFrame([("a", "b"), ("b", "c")], "parent string, child string"))
    assert {(r.parent, r.child) for r in mapping._doubled(edges, []).collect()} == {("a", "c")}


def test_selectors(spark):
    results = spark.createDataFrame([("m", t) for t in (
        "suite_gen_0shot", "suite_de_gen_0shot", "suite_fr_gen_0shot", "mm", "mm_a", "mm_b", "agi", "only", "lone_x")], "model string, task string")
    groups = spark.createDataFrame([("m", "mm", "mm_a"), ("m", "mm_a", "deep"), ("n", "mm", "other")], "model string, parent string, child string")
    asked = spark.createDataFrame([("m", s) for s in ("suite", "mm", "only", "lone", "none", "suite_gen_0shot")], "model string, selector string")
    got = {(r.selector, r.aggregate, r.task, tuple(r.similar or ()), (r.error or "")[:9]) for r in
           mapping.select_aggregates(results, groups, asked).collect()}
    below = ["suite_de_gen_0shot", "suite_fr_gen_0shot"]
    assert got == {(s, "suite_gen_0shot", t, (), "") for s in ("suite", "suite_gen_0shot") for t in below} | {
        ("mm", "mm", "mm_a", (), ""), ("mm", "mm", "deep", (), ""), ("only", "only", None, (), "no task b"),
        ("lone", None, None, ("lone_x",), "no scored"), ("none", None, None, (), "no scored")}


def test_selectors_of_one_group_share_what_is_below(spark, monkeypatch):
    """60 members that lead back to their group have 61 tasks below each: 3,660 rows, of which no step may be a table."""
    members = [f"g_{i}" for i in range(60)]
    edges = [("g", m) for m in members] + [(m, "g") for m in members] + [
        ("to_leaf", "leaf"), ("self", "self"), ("two", "g"), ("two", "leaf"), ("no_task", None), ("up", "no_task")]
    names = [*members, "g", "to_leaf", "self", "two", "no_task", "up"]
    written, write = [], mapping.cut_lineage
    monkeypatch.setattr(mapping, "cut_lineage", lambda df, name: (written.append(write(df, name)), written[-1])[1])
    results = spark.createDataFrame([("m", n) for n in names], "model string, task string")
    groups = spark.createDataFrame([("m", *e) for e in edges], "model string, parent string, child string")
    found = mapping.select_aggregates(results, groups, results.withColumnRenamed("task", "selector"))
    got = [(r.selector, r.aggregate, r.task, r.similar, r.error) for r in found.collect()]
    circle = [*members, "g"]
    want = [(s, t) for s in circle for t in circle] + [("two", t) for t in [*circle, "leaf"]] + [
        ("to_leaf", "leaf"), ("self", "self"), ("no_task", None), ("up", "no_task"), ("up", None)]
    assert sorted(got, key=repr) == sorted([(s, s, t, None, None) for s, t in want], key=repr)
    assert max(df.count() for df in written) < 400


def test_substrings_of_many_patterns(spark, monkeypatch):
    monkeypatch.setattr(resolve, "AUTOMATON", 7)
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcé_") for _ in range(rng.randint(1, n)))
    texts, patterns = {f"k{i}": word(30) for i in range(60)}, {word(4) for _ in range(40)} | {"", "none"}
    got = resolve.substrings(
        spark.createDataFrame(list(texts.items()), "key string, text string"),
        spark.createDataFrame([(p,) for p in [*patterns, None, "none"]], "pattern string")).collect()
    assert sorted((r.key, r.pattern) for r in got) == sorted((k, p) for k, t in texts.items() for p in patterns if p in t)
    none = spark.createDataFrame([], "pattern string")
    assert resolve.substrings(spark.createDataFrame([("k", "t")], "key string, text string"), none).collect() == []


def test_requests_may_be_a_table(spark):
    rng = random.Random(6)
    keys = [f"{t}/{m}{f}" for t in ("gsm8k", "mmlu_pro", "mgsm_de", "code") for m in ("acc", "exact_match", "exact_match_mean_repeats", "acc_stderr")
            for f in ("", ",strict-match", ",none")]
    rows = [(f"m{i}", k, rng.random(), n) for i in range(8) for n, k in enumerate(rng.sample(keys, 15))]
    summary = spark.createDataFrame(rows, "model string, key string, score double, ord int")
    asked = ["gsm8k/exact_match", "GSM8K/acc,none", "mgsm/exact_match", "mmlu_pro/exact_match,strict-match", "code/pass", "code", "/acc"]
    kind = "model string, task string, repeats int, per_task_repeats map<string,int>, metric_tasks map<string,array<string>>, sampling_enabled boolean"
    protocols = spark.createDataFrame([("m1", "gsm8k", 3, {}, {}, True), ("m2", "mmlu_pro", 3, {}, {}, True)], kind)
    listed = resolve.resolve_metrics(summary, asked, protocols)
    table = resolve.resolve_metrics(summary, spark.createDataFrame([(a,) for a in asked + asked], "request string"), protocols)
    assert sorted(map(tuple, listed.collect())) == sorted(map(tuple, table.collect()))
    got = {(r.model, r.request): r.key for r in listed.collect()}
    held = {}
    for model, key, _, n in rows:
        held.setdefault(model, []).append((key, n))
    for model, mine in held.items():
        for request in asked:
            task, _, name = request.partition("/")
            metric, _, filter_name = name.partition(",")
            if request == "mgsm/exact_match":
                continue
            repeated = {"m1": "gsm8k", "m2": "mmlu_pro"}.get(model)
            mean = f"{task}/{metric}_mean_repeats" + (f",{filter_name}" if filter_name else "")
            tiers = [
                [k for k in mine if k[0].split("/")[0] == repeated and "/" in request and k[0] == mean],
                [k for k in mine if k[0].split("/")[0] == repeated and "/" in request and not filter_name and k[0].startswith(mean + ",")],
                [k for k in mine if k[0] == request],
                [k for k in mine if "stderr" not in k[0] and all(p.lower() in k[0].lower() for p in (task, metric, filter_name))]]
            best = next((t for t in tiers if t), [])
            order = lambda k: ("gsm8k" in task.lower() and "strict-match" not in k[0], len(k[0]), k[1])
            assert got.get((model, request)) == (min(best, key=order)[0] if best else None), (model, request)


def test_filtered_multilingual_request(spark):
    rows = [("m", "mgsm_de/exact_match", 0.2, 1), ("m", "mgsm_fr/exact_match", 0.4, 2), ("m", "mgsm/exact_match,flex", 0.9, 3)]
    summary = spark.createDataFrame(rows, "model string, key string, score double, ord int")
    got = resolve.resolve_metrics(summary, ["mgsm/exact_match,flex"]).collect()
    assert [round(r.score, 9) for r in got] == [0.3]


def test_candidate_pairs_lose_nothing(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcde _-") for _ in range(rng.randint(2, 24))) for _ in range(60)]
    damaged = []
    for word in words:
        letters = list(word)
        for _ in range(rng.randint(0, 3)):
            letters[rng.randrange(len(letters))] = rng.choice("xyz")
        damaged.append("".join(letters) + rng.choice(["", "q", "zz"]))
    names, files = sorted(set(words)), sorted(set(damaged) - set(words))
    left = spark.createDataFrame([("d", n) for n in names], "directory string, name string")
    right = spark.createDataFrame([("d", f) for f in files], "directory string, file string")
    met = docsets.candidate_pairs(left, right).withColumn("ratio", docsets.similarity("name", "file"))
    got = {(r.name, r.file): r.ratio for r in met.collect() if r.ratio >= docsets.SIMILARITY_FLOOR}
    want = {}
    for a in names:
        for b in files:
            ratio = difflib.SequenceMatcher(None, a, b).ratio()
            if ratio >= docsets.SIMILARITY_FLOOR:
                want[a, b] = ratio
    assert want and got == want
    chosen, used_names, used_files = set(), set(), set()
    for (a, b), _ in sorted(want.items(), key=lambda e: (-e[1], e[0])):
        if a not in used_names and b not in used_files:
            chosen.add((a, b))
            used_names.add(a)
            used_files.add(b)
    pairs = spark.createDataFrame([("d", a, b, r) for (a, b), r in want.items()], "directory string, name string, file string, ratio double")
    assert {(r.name, r.file) for r in docsets.greedy_pairs(pairs).collect()} == chosen


def test_candidates_meet_in_blocks(spark):
    rng = random.Random(6)
    names = sorted({"part no " + "".join(rng.choice("0123456789abcdef") for _ in range(24)) + ".txt" for _ in range(300)})
    files = sorted({n[:4] + "#~" + n[6:] for n in names[::7]} | {n[::-1] for n in names[::3]})
    left = spark.createDataFrame([("d", n) for n in names] + [("e", names[0]), (None, "x")], "directory string, name string")
    right = spark.createDataFrame([("d", f) for f in files] + [(None, "x")], "directory string, file string")
    met = docsets.candidate_pairs(left, right, block=50)
    got = [(r.directory, r.name, r.file) for r in met.collect()]
    want = {("d", a, b) for a in names for b in files if difflib.SequenceMatcher(None, a, b).ratio() >= docsets.SIMILARITY_FLOOR}
    assert len(set(got)) == len(got) and want and want <= set(got) and len(got) < 2 * len(want)


def test_names_are_paired_without_broadcast(spark):
    """A file of names is small beside the rows made of it: the driver must not hold them."""
    names = spark.createDataFrame([("d", "a.txt"), ("d", "some report.txt")], "directory string, name string")
    files = spark.createDataFrame([("d", "a.txt"), ("d", "some rep#rt.txt")], "directory string, name string")
    paired = docsets.pair_names(names, files)
    assert {(r.name, r.file) for r in paired.collect()} == {("a.txt", "a.txt"), ("some report.txt", "some rep#rt.txt")}
    for frame in (paired, docsets.unresolved_names(names, paired), docsets.candidate_pairs(
            names, files.withColumnRenamed("name", "file"))):
        assert "Broadcast" not in frame._jdf.queryExecution().executedPlan().toString()


def test_candidates_of_long_names_lose_nothing(spark):
    rng = random.Random(8)
    names = ["".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(18, 60))) + rng.choice([".txt", " report.txt", "aaaa"]) for _ in range(80)]
    damaged = []
    for name in names:
        letters = list(name)
        for _ in range(rng.randint(0, len(name) // 7)):
            kind, at = rng.choice("dis"), rng.randrange(len(letters))
            letters[at : at + (kind != "i")] = [] if kind == "d" else [rng.choice("0123abcz")]
        damaged.append("".join(letters))
    left = spark.createDataFrame([("d", n) for n in sorted(set(names))], "directory string, name string")
    right = spark.createDataFrame([("d", f) for f in sorted(set(damaged))], "directory string, file string")
    met = {(r.name, r.file) for r in docsets.candidate_pairs(left, right).collect()}
    want = {(a, b) for a in set(names) for b in set(damaged)
            if difflib.SequenceMatcher(None, a, b).ratio() >= docsets.SIMILARITY_FLOOR}
    assert want and want <= met and len(met) < 0.2 * len(set(names)) * len(set(damaged))


def test_descendants_with_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "parent string, child string")
    roots = spark.createDataFrame([("a",), ("x",)], "task string")
    got = {(r.root, r.task) for r in mapping.group_descendants(edges, roots).collect()}
    assert got == {("a", "b"), ("a", "c"), ("a", "a"), ("a", "d"), ("x", "y")}


def test_task_prefixes(spark):
    row = spark.range(1).select(merge.task_prefixes(F.lit("a_b/c_")).alias("p")).first()
    assert sorted(row.p) == ["a", "a_b", "a_b/c", "a_b/c_"]
