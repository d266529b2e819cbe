"""Ranked search against plain scores of every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from evalframe.llm import bloom_search, words
from evalframe.llm.queries import op13_bloom_search

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return [bytes(t, "utf-8").lower().decode() for t in TERM.findall(text or "")]


def plain(docs, queries, k):
    counted = [(i, Counter(split(t))) for i, t in docs]
    n = [sum(c.values()) for _, c in counted]
    N, L = sum(x > 0 for x in n), sum(n)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for i, t in queries:
        if i is not None:
            asked.setdefault(i, Counter()).update(split(t))
    out = []
    for item, wanted in asked.items():
        scores = []
        for (i, c), size in zip(counted, n):
            m = 25 + (75 * size * N) // max(L, 1)
            score = sum(
                times * math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                for t, times in wanted.items() if c[t])
            if i is not None and score > 0:
                scores.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def found(frame, key="item_id"):
    return sorted(tuple(r) for r in frame.select(key, "rank", "doc_id", "score").collect())


def items(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in rows],
                                 "item_id long, text string, term string, `number` int, doc_id string, `rank` int")


@pytest.fixture(scope="module")
def odd_queries(odd_rows):
    return [(1, "word"), (2, None), (3, ""), (4, "the same again again"), (5, odd_rows[10][1]), (None, "word"), (6, "changed changed a"),
            (7, "nowhere"), (8, "a b c"), (9, "x" * 5000), (9, "again"), (10, "WÖRD Straße, \x00 end")]


def test_odd_rows(spark, docs_of, odd_rows, odd_queries):
    got = found(bloom_search.top_documents(docs_of(odd_rows), "doc_id", "text", items(spark, odd_queries), "item_id", "text", 5))
    assert got == plain(odd_rows, odd_queries, 5)


def test_blocks_and_ties(spark, docs_of, monkeypatch):
    monkeypatch.setattr(bloom_search, "BLOCK_DOCS", 9)
    monkeypatch.setattr(bloom_search, "QUERY_ROWS", 2)
    monkeypatch.setattr(bloom_search, "PART_ROWS", 7)
    monkeypatch.setattr(bloom_search, "ENTRY_BITS", 2)  # many false positives
    pick = random.Random(5)
    letters = "abcdefghijklmnop"
    docs = [(i, " ".join(pick.choice(letters) * pick.choice([1, 1, 2]) for _ in range(pick.choice([1, 3, 40])))) for i in range(300)]
    asked = [(100 + i, " ".join(pick.choice(letters) * pick.choice([1, 2]) for _ in range(pick.randint(1, 6)))) for i in range(9)]
    asked.append((200, "a a a"))
    got = found(bloom_search.top_documents(docs_of(docs), "doc_id", "text", items(spark, asked), "item_id", "text", 10))
    assert got == plain(docs, asked, 10)


def test_bounds_are_never_too_low():
    pick = random.Random(3)
    texts = [" ".join(pick.choice("abcdefgh") for _ in range(pick.choice([2, 30, 400]))) for _ in range(60)]
    data = "".join(texts).encode()
    offsets = np.cumsum([0] + [len(t) for t in texts])
    rows, hashes, times = bloom_search.terms(np.frombuffer(data, np.uint8), offsets)
    sizes = np.bincount(rows, times).astype(np.int64)
    steps = np.searchsorted(bloom_search.LEVELS, times, side="right")
    ids, size_bytes, bits, slices = bloom_search._signed(np.arange(60), sizes, 64, rows, hashes, steps)
    every = np.unique(hashes)
    query = {"number": np.arange(len(every)).tobytes(), "terms": every.tobytes(),
             "owners": (np.arange(len(every)) << 32 | np.arange(len(every))).tobytes(), "weights": np.full(len(every), 7).tobytes()}
    bound = bloom_search._bounds({"sizes": size_bytes, "slices": slices, "bits": bits}, bloom_search._Queries(query), 60, int(sizes.sum()))
    exact = np.zeros_like(bound)
    m = 25 + 75 * sizes * 60 // int(sizes.sum())
    exact[np.searchsorted(every, hashes), rows] = 7 * bloom_search._tf_part(times.astype(np.int64), m[rows])
    assert (bound >= exact).all() and (bound[exact > 0] < 1.6 * exact[exact > 0]).all()


def test_empty_tables(spark, docs_of):
    none, some = docs_of([]), docs_of([(1, "word"), (2, None)])
    ask = lambda d, q: bloom_search.top_documents(d, "doc_id", "text", items(spark, q), "item_id", "text", 3).collect()
    assert ask(none, [(1, "word")]) == [] and ask(some, []) == [] and ask(docs_of([(2, None)]), [(1, "word")]) == []


def test_terms_are_those_of_the_pattern():
    text = "Ünï-cødé don't A1b2 _x_ 你好,世界 \x7f\x80 tab\tend"
    data = np.frombuffer(text.encode(), np.uint8)
    rows, hashes, times = bloom_search.terms(data, np.array([0, len(data)]))
    want = split(text)
    whole = "\n".join(want).encode()
    starts = np.array([0] + [i + 1 for i, c in enumerate(whole) if c == 10])
    stops = np.append(starts[1:] - 1, len(whole))
    assert set(hashes.tolist()) == set(words.hash_spans(np.frombuffer(whole, np.uint8), starts, stops).tolist())
    assert times.sum() == len(want)


def test_query(spark, sf):
    read = lambda name, key: [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(key, "text").collect()]
    assert found(op13_bloom_search(spark, sf)) == plain(read("documents", "doc_id"), read("benchmark", "item_id"), 10)
