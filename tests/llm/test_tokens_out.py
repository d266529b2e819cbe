"""Token files and packing: every id in its place."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from evalframe.llm import packing, token_files
from evalframe.llm.queries import TOKENIZER, op5_cutting_stock, op6_token_files
from evalframe.llm.tokens import encoder


def ids_of(text, end):
    ids = encoder(TOKENIZER).tokenizer.encode(text, add_special_tokens=False).ids if text else []
    return np.array([*ids, end], "<u4")


def test_files_read_back(docs_of, odd_rows):
    files = token_files.write_tokens(docs_of(odd_rows), "doc_id", "text", TOKENIZER, end=2, length=16, rows=3)
    order = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    stream = [ids_of(t, 2) for _, t in order]
    got = sorted(token_files.read_digests(files).collect(), key=lambda r: r["start"])
    at = 0
    for row, (key, _), ids in zip(got, order, stream):
        assert tuple(row) == (key, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    whole, pick = np.concatenate(stream), random.Random(3)
    for row in files.collect():
        file = token_files.TokenFile(row["file"])
        for _ in range(20):
            a = pick.randrange(row["tokens"])
            n = pick.randint(0, min(200, row["tokens"] - a))
            assert file.tokens(a, n).tolist() == whole[row["start"] + a : row["start"] + a + n].tolist()
        with pytest.raises((ValueError, IndexError, OSError)):
            file.tokens(row["tokens"], 1)


def test_no_documents(docs_of):
    files = token_files.write_tokens(docs_of([]), "doc_id", "text", TOKENIZER, end=2)
    assert token_files.read_digests(files).collect() == []
    cut = packing.pieces(docs_of([]), "doc_id", "text", TOKENIZER, 0, 64)
    assert packing.packed(cut, 64).collect() == []


def test_files_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    want, at = [], 0
    for r in rows:
        ids = ids_of(r["text"], 2)
        want.append((r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in op6_token_files(spark, sf).collect()) == want


def check_packing(rows, texts, size, end=0):
    """Every id of every document in one piece, every sequence gapless; gives the share of padding."""
    ids = {}
    for key, text in texts:
        ids.setdefault(key, []).append(ids_of(text, end))
    by_sequence, pieces = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= size
    want = {k: sorted((s, len(d[s : s + size]), zlib.crc32(d[s : s + size].tobytes()), len(d)) for d in docs for s in range(0, len(d), size))
            for k, docs in ids.items()}
    assert {k: sorted(p) for k, p in pieces.items()} == want
    return 1 - sum(r["length"] for r in rows) / (size * len(by_sequence))


def test_odd_documents_are_packed(docs_of, odd_rows):
    rows = packing.packed(packing.pieces(docs_of(odd_rows), "doc_id", "text", TOKENIZER, 0, 64), 64).collect()
    check_packing(rows, odd_rows, 64)


def test_packing_query(spark, sf):
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert check_packing(op5_cutting_stock(spark, sf).collect(), texts, 1024) < 0.06


def test_plans_cover_the_histogram():
    pick = random.Random(5)
    for _ in range(40):
        room = pick.choice([1, 4, 16, 64])
        histogram = {pick.randint(1, room): pick.choice([0, 1, 3, 50, 20_000]) for _ in range(pick.randint(0, room))}
        made = {}
        plan = packing.plan(histogram, room)
        for pattern, times in plan:
            assert times > 0 and sum(c * n for c, n in pattern.items()) <= room
            for c, n in pattern.items():
                made[c] = made.get(c, 0) + n * times
        assert made == {c: n for c, n in histogram.items() if n}


def test_generated_columns_save_sequences():
    pick = random.Random(1)
    histogram = {c: pick.randint(100, 900) for c in range(1, 65)}
    first_fit = sum(times for _, times in packing.plan(histogram, 64, rounds=0))
    sequences = sum(times for _, times in packing.plan(histogram, 64))
    assert sequences <= first_fit and sequences <= 1.02 * sum(c * n for c, n in histogram.items()) / 64
