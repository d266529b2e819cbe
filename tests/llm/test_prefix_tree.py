"""The Jaccard join against plain set arithmetic over all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from evalframe.llm import prefix_tree
from evalframe.llm.queries import op8_prefix_tree_join

from .conftest import passage
from .test_words import plain_set


def plain(rows, width, p, q):
    sets = {}
    for key, text in rows:
        sets.setdefault(key, []).append(plain_set(text, width))
    up = {key: key for key in sets if key is not None}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    nodes = [(k, s) for k, some in sets.items() if k is not None for s in some if s]
    for at, (i, a) in enumerate(nodes):
        for j, b in nodes[:at]:
            if q * len(a & b) >= p * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return sorted(((k, len(plain_set(t, width)), None if k is None else find(k)) for k, t in rows), key=repr)


def joined(frame, *args, **kw):
    return sorted((tuple(r) for r in prefix_tree.near_duplicates(frame, "doc_id", "text", *args, **kw).collect()), key=repr)


@pytest.mark.parametrize("width, p, q", [(4, 85, 100), (5, 4, 5)])
def test_odd_documents(docs_of, odd_rows, width, p, q):
    assert joined(docs_of(odd_rows), width, p, q) == plain(odd_rows, width, p, q)


def test_clusters_larger_than_a_block(docs_of):
    """Families that share many keys without being one component, over several blocks, pivots and left-over documents."""
    pick, rows = random.Random(4), []
    base = [passage(70 + f, 60).split(" ") for f in range(3)]
    for i in range(90):
        words = list(base[i % 3])
        for _ in range(pick.choice([0, 0, 1, 2])):
            words[pick.randrange(60)] = f"w{i}"
        mixed = words[:40] + base[(i + 1) % 3][40:] if i % 7 == 0 else words
        rows.append((1000 - i, " ".join(mixed)))
    assert joined(docs_of(rows), 3, 7, 10, block=8) == plain(rows, 3, 7, 10)


def test_keys_of_one_component_or_block_are_not_written(docs_of, monkeypatch):
    pick, rows, seen = random.Random(4), [], {}
    base = [passage(70 + f, 60).split(" ") for f in range(2)]
    for i in range(60):
        words = list(base[i % 2])
        words[pick.randrange(60)] = f"w{i}"
        rows.append((i, " ".join(words[:30] + base[(i + 1) % 2][30:] if i % 6 == 0 else words)))
    write = prefix_tree.written
    monkeypatch.setattr(prefix_tree, "written", lambda df, name: seen.setdefault(name, write(df, name)))
    assert joined(docs_of(rows), 3, 7, 10, block=8) == plain(rows, 3, 7, 10)
    keys = {}
    for r in seen["open-keys"].collect():
        keys.setdefault(r.key, []).append(r)
    assert keys and all(len({r.component for r in k}) > 1 and len({r.block for r in k}) > 1 for k in keys.values())


def test_only_documents_that_may_link_are_sent_to_blocks(docs_of, monkeypatch):
    """Copies just below the similarity share keys, but their sketches tell them apart before their texts are sent."""
    pick, rows, seen = random.Random(5), [], {}
    base = passage(70, 300).split(" ")
    for i in range(60):
        words = list(base)
        for at in pick.sample(range(300), 18 if i % 10 else 1):
            words[at] = f"w{i}x{at}"
        rows.append((i, " ".join(words)))
    write = prefix_tree.written
    monkeypatch.setattr(prefix_tree, "written", lambda df, name: seen.setdefault(name, write(df, name)))
    monkeypatch.setattr(prefix_tree, "KEY_ROWS", 8)  # keys in several parts
    assert joined(docs_of(rows), 5, 4, 5, block=8) == plain(rows, 5, 4, 5)
    blocks = seen["cluster-texts"].select("block").distinct().count()
    keyed = {(r.doc_id, r.block) for r in seen["different-keys"].where("rest").collect()}
    assert blocks > 4 and len(keyed) > 30  # all of these asked nearly all blocks
    assert seen["asked"].count() < len(keyed)


def test_sketches_differ_in_no_more_bits_than_sets_in_members():
    pick = np.random.default_rng(6)
    for size in [1, 3, 60, 65, 130, 1000, 3 * prefix_tree.SKETCH_BITS]:
        for drop in [0, 1, size // 5, size - 1]:
            a = np.unique(pick.integers(0, 1 << 63, size).astype(np.uint64))
            b = np.unique(np.concatenate([a[drop:], pick.integers(0, 1 << 63, size // 7).astype(np.uint64)]))
            one, two = prefix_tree.sketch(a), prefix_tree.sketch(b)
            least = min(len(one), len(two))
            rows = prefix_tree.folded([one, two], least)
            bits = int(np.bitwise_count(rows[0] ^ rows[1]).sum())
            assert bits <= len(np.setxor1d(a, b)) and (drop or len(b) > len(a) or bits == 0)


def test_walks_find_all_links():
    pick = random.Random(1)
    for _ in range(150):
        members = pick.choice([5, 12, 40, 300])
        base = [pick.sample(range(members), pick.randint(0, members)) for _ in range(3)]
        sets = []
        for _ in range(pick.randint(0, 20)):
            own = set(pick.choice(base))
            for _ in range(pick.choice([0, 1, 2, 5])):
                own ^= {pick.randrange(members)}
            sets.append(np.array(sorted(own), np.uint64))
        p, q = pick.choice([(85, 100), (4, 5), (1, 2), (1, 1)])
        tree = prefix_tree.PrefixTree(sets)
        for i, a in enumerate(sets):
            want = [j for j, b in enumerate(sets) if len(a) and len(b) and
                    q * len(np.intersect1d(a, b)) >= p * len(np.union1d(a, b))]
            assert tree.walk(i, p, q).tolist() == want


def test_linked_sets_share_a_key():
    pick = np.random.default_rng(3)
    for size in [2, 5, 6, 7, 11, 13, 20, 40, 100, 400]:
        for _ in range(30):
            a = np.unique(pick.integers(0, 1 << 63, size).astype(np.uint64))
            drop = pick.integers(0, max(1, int(size * 0.16)) + 1)
            b = np.unique(np.concatenate([a[drop:], pick.integers(0, 1 << 63, pick.integers(0, 3)).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(b) == 0 or 100 * both < 85 * len(np.union1d(a, b)) or np.array_equal(a, b):
                continue
            bounds = np.array([0, len(a), len(a) + len(b)])
            keys, rows = prefix_tree.segment_keys(np.concatenate([a, b]), bounds, 85, 100)
            assert set(keys[rows == 0].tolist()) & set(keys[rows == 1].tolist())


def test_one_of_each(docs_of, odd_rows):
    docs = docs_of(odd_rows)
    kept = prefix_tree.one_of_each(docs, "doc_id", "text", 5, 4, 5)
    want = sorted({k for k, _, c in plain(odd_rows, 5, 4, 5) if k is not None and k == c})
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == want
    assert kept.where("doc_id IS NULL").count() == sum(1 for k, _ in odd_rows if k is None)


def test_empty_table(docs_of):
    assert joined(docs_of([]), 4, 85, 100) == []
    assert prefix_tree.one_of_each(docs_of([]), "doc_id", "text", 5, 4, 5).collect() == []


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in op8_prefix_tree_join(spark, sf).collect()), key=repr)
    assert got == plain(rows, 4, 85, 100)


def test_one_id_with_unlike_texts(docs_of):
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, one), (2, one + " end"), (2, two), (2, two), (3, two + " end"), (4, "a b c"), (4, "d e f"), (4, None), (None, one)]
    kept = prefix_tree.one_of_each(docs_of(rows), "doc_id", "text", 5, 4, 5)
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(
        [(1, one), (2, two), (4, "a b c"), (4, "d e f"), (4, None), (None, one)], key=repr)
    got = prefix_tree.near_duplicates(docs_of(rows[:5]), "doc_id", "text", 5, 4, 5).collect()
    assert {r["component_id"] for r in got} == {1}  # both texts of 2 have their links
    twin = prefix_tree.near_duplicates(docs_of([(1, one), (2, one), (2, two), (3, two + " end")]), "doc_id", "text", 5, 4, 5)
    assert {r["component_id"] for r in twin.collect()} == {1}
