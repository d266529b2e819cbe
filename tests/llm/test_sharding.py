"""Virtual slots: the law, the places, the edits of the map."""

from __future__ import annotations

import zlib
from collections import Counter

from evalframe.llm import sharding
from evalframe.llm.queries import op10_virtual_slots


def loads(slot_map):
    out = Counter()
    for r in slot_map.collect():
        out[r["shard"]] += r["bytes"]
    return out


def test_query(spark, sf):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op10_virtual_slots(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    places, sizes = {}, Counter()
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        places.setdefault(r["shard"], []).append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert set(places) <= set(range(40))
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    mean = sum(sizes.values()) / 40
    assert max(sizes.values()) <= mean + max(r["size"] for r in rows)


def test_odd_rows_and_edits(docs_of, odd_rows):
    placed = sharding.slotted(docs_of(odd_rows), "doc_id", "text", 64)
    sizes = sharding.slot_sizes(placed, 64)
    first = sharding.first_map(sizes, 4)
    second = sharding.rebalanced(first, 4)
    third = sharding.rebalanced(second, 5)  # one more shard
    fourth = sharding.rebalanced(third, 3)  # two fewer
    for slot_map, version, shards in ((first, 0, 4), (second, 1, 4), (third, 2, 5), (fourth, 3, 3)):
        rows = slot_map.collect()
        assert {r["version"] for r in rows} == {version} and sorted(r["virtual_slot"] for r in rows) == list(range(64))
        assert {r["shard"] for r in rows} <= set(range(shards))
        assigned = sharding.assigned(placed, slot_map).collect()
        assert Counter(r["key"] for r in assigned) == Counter(i for i, _ in odd_rows)
        by_shard = {}
        for r in assigned:
            by_shard.setdefault(r["shard"], []).append(r["place"])
        assert all(sorted(p) == list(range(len(p))) for p in by_shard.values())
    assert max(loads(second).values()) <= max(loads(first).values())
    moved = sum(a["shard"] != b["shard"] for a, b in zip(*(sorted(m.collect(), key=lambda r: r["virtual_slot"]) for m in (second, third))))
    assert 0 < moved < 64


def test_empty_table(docs_of):
    placed = sharding.slotted(docs_of([]), "doc_id", "text", 8)
    slot_map = sharding.rebalanced(sharding.first_map(sharding.slot_sizes(placed, 8), 3), 3)
    assert slot_map.count() == 8 and sharding.assigned(placed, slot_map).collect() == []
