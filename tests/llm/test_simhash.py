"""Fingerprints and their components against plain versions."""

from __future__ import annotations

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from evalframe.llm import simhash
from evalframe.llm.queries import op11_simhash_trees


def fingerprint(text: str | None, width: int = 4) -> int:
    words = bytes(text or "", "utf-8").lower().split()
    if not words:
        return 0
    count = max(len(words) - width + 1, 1)
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(count)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > count)


def classes(prints: list[int], radius: int = 4) -> list[int]:
    """The place of the first print of each one's component."""
    home = list(range(len(prints)))
    values = np.array(prints, np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= radius).tolist():
            a, b = home[i], home[j]
            if a != b:
                home = [min(a, b) if h in (a, b) else h for h in home]
    return home


def plain(rows, width=4):
    prints = [fingerprint(t, width) for _, t in rows]
    home = classes(prints)
    least = {h: min((rows[i][0] for i in range(len(rows)) if home[i] == h and rows[i][0] is not None), default=None) for h in set(home)}
    return sorted(((i, f"{p:016x}", least[h]) for (i, _), p, h in zip(rows, prints, home)), key=repr)


def found(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "fingerprint", "component_id").collect()), key=repr)


def test_odd_rows(spark, docs_of, odd_rows):
    assert found(simhash.near_duplicates(docs_of(odd_rows), "doc_id", "text", 4)) == plain(odd_rows)


def test_spark_has_the_same_hash(spark):
    texts = ["", "a", "ein zwei drei vier", "é" * 50]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("h")).collect()
    assert {r.t: r.h % (1 << 64) for r in got} == {t: xxhash.xxh64_intdigest(t.encode(), 42) for t in texts}


def test_no_rows(spark, docs_of):
    assert simhash.near_duplicates(docs_of([]), "doc_id", "text", 4).collect() == []


def near(seed: int, count: int) -> list[int]:
    """Prints in dense groups, chains and alone."""
    pick = random.Random(seed)
    out = []
    for _ in range(count // 20):
        centre = pick.getrandbits(64)
        for _ in range(pick.choice([1, 5, 40])):
            flips = sum(1 << b for b in pick.sample(range(64), pick.randint(0, 9)))
            out.append(centre ^ flips)
    return sorted(set(out))


def test_trees_find_every_pair():
    prints = np.array(near(1, 600), np.uint64)
    buckets = np.sort(np.random.default_rng(1).integers(0, 3, len(prints)))
    buckets = np.unique(buckets, return_inverse=True)[1]
    trees = simhash.BKTrees(prints, buckets)
    a, b = trees.within(np.arange(len(prints)), 4)
    want = {(i, j) for i in range(len(prints)) for j in range(len(prints))
            if i != j and buckets[i] == buckets[j] and bin(int(prints[i]) ^ int(prints[j])).count("1") <= 4}
    assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want)


def test_dealing_and_shards_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(simhash, "STEPS", 500)
    monkeypatch.setattr(simhash, "TOGETHER", 50)
    prints = near(2, 900)
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fingerprint long").repartition(3)
    want = classes(prints)
    for leaf, depth in ((8192, 3), (16, 3), (16, 1), (6, 2)):
        pairs = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(frame, 4, leaf, depth).collect()]
        home = {p: p for p in prints}
        assert all(bin(a ^ b).count("1") <= 64 for a, b in pairs)
        for a, b in pairs:
            x, y = home[a], home[b]
            if x != y:
                home = {p: min(x, y) if h in (x, y) else h for p, h in home.items()}
        least = {}
        for p, w in zip(prints, want):
            assert least.setdefault(w, home[p]) == home[p], (leaf, depth)
        assert len(set(home.values())) == len(set(want)), (leaf, depth)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert found(op11_simhash_trees(spark, sf)) == plain(rows)
