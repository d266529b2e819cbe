"""Repeated passages against a plain version that keeps every window."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from evalframe.llm import suffix_dedup
from evalframe.llm.queries import op1_suffix_dedup

LAST = (1 << 63) - 1


def plain(rows):
    first = {}
    texts = [(LAST if i is None else i, i, (t or "").encode()) for i, t in rows]
    for doc, _, data in sorted(texts, key=lambda r: r[0]):
        for s in range(len(data) - 49):
            first.setdefault(data[s : s + 50], doc)
    out = []
    for doc, key, data in texts:
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - 49):
            if first[data[s : s + 50]] < doc:
                gone[s : s + 50] = True
        left = np.frombuffer(data, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((key, len(data), int(gone.sum()), runs, hashlib.sha256(left).hexdigest(), left))
    return sorted(out, key=repr)


def result(frame):
    return sorted((tuple(r)[:5] + (bytes(r["kept"]),) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("frequent", [1000, 2])
def test_odd_documents(docs_of, odd_rows, monkeypatch, frequent):
    monkeypatch.setattr(suffix_dedup, "FEW", frequent)
    monkeypatch.setattr(suffix_dedup, "FREQUENT", 0 if frequent == 2 else 16)
    assert result(suffix_dedup.deduplicated(docs_of(odd_rows), "doc_id", "text")) == plain(odd_rows)


def test_shared_lines_in_changing_surroundings(docs_of):
    pick = random.Random(7)
    lines = ["".join(pick.choice("abcd ") for _ in range(n)) for n in (30, 49, 50, 51, 70, 130)]
    rows = [(i, "".join(pick.choice(lines) + pick.choice(["", "-", "=="]) for _ in range(pick.randint(0, 9)))) for i in range(80)]
    assert result(suffix_dedup.deduplicated(docs_of(rows), "doc_id", "text")) == plain(rows)


def test_empty_table(docs_of):
    assert suffix_dedup.deduplicated(docs_of([]), "doc_id", "text").collect() == []


def test_suffix_order_of_windows():
    data = np.frombuffer(b"abracadabra" * 12 + b"x" * 60, np.uint8)
    at = np.arange(len(data) - 49)
    ranks = suffix_dedup.suffix_ranks(data)[at]
    plain_order = sorted({data[i : i + 50].tobytes() for i in at})
    assert ranks.argsort(kind="stable").tolist() == sorted(at, key=lambda i: (data[i : i + 50].tobytes(), i))
    assert len(set(ranks.tolist())) == len(plain_order)


def test_only_windows_of_several_documents_are_sorted(monkeypatch):
    """Segments around one string are compared though most share no window: 40 of 70 bytes, two with one window in common."""
    pick = random.Random(5)
    noise = lambda n: bytes(pick.randrange(97, 123) for _ in range(n))
    pieces = [noise(25) + b"twenty bytes of text" + noise(25) for _ in range(40)]
    pieces[30] = noise(10) + pieces[3][10:60] + noise(10)
    at = np.concatenate([np.arange(70 * i, 70 * i + 21) for i in range(40)])
    docs, sorted_at, ranks = np.repeat(np.arange(40), 21), [], suffix_dedup.suffix_ranks
    monkeypatch.setattr(suffix_dedup, "suffix_ranks", lambda *a: (sorted_at.append(len(ranks(*a))), ranks(*a))[1])
    found = suffix_dedup.covered_windows(np.frombuffer(b"".join(pieces), np.uint8), at, docs)
    assert at[found].tolist() == [30 * 70 + 10]
    assert sum(sorted_at) == 2


@pytest.mark.parametrize("limit", [60, 1000])
def test_open_segments_fetched_in_parts(docs_of, monkeypatch, limit):
    monkeypatch.setattr(suffix_dedup, "FETCH_BYTES", limit)
    pick = random.Random(11)
    lines = ["".join(pick.choice("abcdé ") for _ in range(n)) for n in (40, 55, 90)]
    rows = [(i // 2, "".join(pick.choice(lines) + pick.choice(["", "-", "=="]) for _ in range(pick.randint(0, 9)))) for i in range(60)]
    rows += [(None, lines[2]), (3, None), *rows[:5]]
    assert result(suffix_dedup.deduplicated(docs_of(rows), "doc_id", "text")) == plain(rows)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in op1_suffix_dedup(spark, sf).collect()), key=repr) == [r[:5] for r in plain(rows)]
