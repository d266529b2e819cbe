"""Exact search against a full product."""

from __future__ import annotations

import math
import random


from evalframe.llm import topk
from evalframe.llm.queries import op7_exact_top_k

SCHEMA = "vec_id long, embedding array<float>, label int, id string, tile string"


def plain(rows, queries, k):
    vectors = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
               if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, own in sorted({(i, tuple(v)) for i, v in vectors if queries(i)}):
        best = sorted(((-sum(a * b for a, b in zip(own, v)), i) for i, v in vectors if i != q))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def search(spark, rows, queries, k):
    frame = spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA).repartition(3)
    vectors = topk.usable(frame, "vec_id", "embedding", 1024)
    got = topk.top_k(vectors.where(queries), vectors, k).collect()
    return sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in got)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.25]), (1, [0.5, -0.25]), (2, [0.5, -0.25]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, []), (8, [1.0]), (9, [0.5, -0.25, 9.0]), (None, [1.0, 1.0]), (10, [1e12, 1e3]), (11, [-1e12, 0.0]), (12, [1e-9, -1e-9])]
    small = [r for r in rows if r[0] not in (10, 11)]
    assert search(spark, small, "id % 2 = 0", 4) == plain(small, lambda i: i % 2 == 0, 4)
    big = [(0, [1e5, 2.0]), (1, [2e5, 3.0]), (2, [3e5, -1.0]), (3, [3e5, -1.0])]
    assert search(spark, big, "id = 0", 9) == plain(big, lambda i: i == 0, 9)


def test_many_ties_over_tiles(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 16)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    pick = random.Random(2)
    rows = [(i, [pick.choice([-1.0, 0.0, 1.0]) for _ in range(4)]) for i in range(300)]
    assert search(spark, rows, "id % 20 = 0", 10) == plain(rows, lambda i: i % 20 == 0, 10)


def test_no_vectors(spark):
    assert search(spark, [], "id % 2 = 0", 3) == []
    assert search(spark, [(1, [1.0])], "id = 1", 3) == []


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = sorted(tuple(r) for r in op7_exact_top_k(spark, sf).select("query_id", "rank", "vec_id", "score").collect())
    assert got == plain(rows, lambda i: i % 100 == 0, 10)
