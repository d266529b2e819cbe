"""Aligned tokens against whole texts encoded on their own."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from evalframe.llm import alignment
from evalframe.llm.queries import op12_token_alignment

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
TEXTS = [
    None, "", " ", "  ", "\n", "\n\n", "a", " a", "a ", "a  ", "a\n", "two  blanks\n\n and\tmore \n", "naïve café 你好 😀🎉 𐍈𐍈", "x😀y z𐍈",
    "sp▁ecial", "a▁ b", "<s> [INST] </s> <|endoftext|> <0x41>", "don't they're", "　wide　blank  ", "é ́",
    "a" * 5000, "tab\tend\t", "nul\x00byte", "\x1c\x1d x\x85y", "ﬁ ½ Å", "if (x);\r\n  y();\r z\r", ";\r", "\r", "1234567 12.5 -- ...", "(a), b.c; d!? e!), 'f', g." , "x,\ny. ,z é,w", "mixed CaSe", "﻿bom", "🏳️‍🌈 flag",
]


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(public_tokenizers.path(A))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(B))


def plain(rows, both):
    a, b = both
    letters = alignment._byte_of_letter()
    found = []
    for _, text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            found.append(([], [], [], []))
            continue
        ends = [[sum(map(len, parts[: k + 1])) for k in range(len(parts))] for parts in (bytes_a, bytes_b)] if len(whole) < 9000 else None
        if ends is None:
            ends = []
            for parts in (bytes_a, bytes_b):
                ends.append([])
                for p in parts:
                    ends[-1].append((ends[-1][-1] if ends[-1] else 0) + len(p))
        at_a, at_b = dict(zip(ends[0], range(len(ids_a)))), dict(zip(ends[1], range(len(ids_b))))
        cuts = sorted(at_a.keys() & at_b.keys())
        groups, i, j = [], 0, 0
        for cut in cuts:
            groups.append((ids_a[i : at_a[cut] + 1], ids_b[j : at_b[cut] + 1]))
            i, j = at_a[cut] + 1, at_b[cut] + 1
        found.append((ids_a, ids_b, groups, [(ids_a[at_a[c]], ids_b[at_b[c]]) for c in cuts]))
    counts = Counter(link for row in found for link in row[3])
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    out = []
    for (key, _), (ids_a, ids_b, groups, links) in zip(rows, found):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((key, len(ids_a), len(ids_b), len(groups), len(links), sum(counts[x] == top[x[1]] for x in links),
                    sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if ids_a else ""))
    return sorted(out, key=repr)


def got(frame):
    return sorted((tuple(r) for r in frame.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr)


def test_odd_texts(spark, docs_of, both, odd_rows):
    rows = list(enumerate(TEXTS)) + odd_rows
    assert got(alignment.aligned_documents(docs_of(rows), "doc_id", "text", A, B)) == plain(rows, both)


def test_a_small_memory_changes_nothing(both, monkeypatch):
    monkeypatch.setattr(alignment, "MEMORY", 3)
    monkeypatch.setattr(alignment, "GROUP", 2)
    whole, warm = alignment.Aligner(A, B), alignment.Aligner(A, B)
    assert warm.before == b" \n,.;:!?)"
    whole.before = b""  # no cuts
    texts = [(t or "").encode() for t in TEXTS]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    for _ in range(2):
        assert warm.rows(data, offsets) == whole.rows(data, offsets)


def test_ends_come_from_offsets_and_bytes(both):
    by = alignment.Aligner(A, B)
    for text in (" é😀 𐍈x", " a b", " 😀😀"):
        enc = by.a.encode(text, add_special_tokens=False)
        want, end = [], 0
        for i in enc.ids:
            end += len(by.bytes_a[i])
            want.append(end)
        assert by._ends_a(text, np.array(enc.ids), enc.offsets).tolist() == want
        proto = by.b.encode(text[1:], return_type="proto").pieces
        want, end = [], 0
        for t in proto:
            end += len(by.bytes_b[t.id])
            want.append(end)
        assert by._ends_b(np.array([t.id for t in proto]), [t.end for t in proto]).tolist() == want


def test_no_rows(spark, docs_of):
    assert alignment.aligned_documents(docs_of([]), "doc_id", "text", A, B).collect() == []


def test_bound_on_pairs():
    by = alignment.Aligner(A, B)
    assert 10_000 < by.pair_bound() < 2_000_000


def test_query(spark, sf, both):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op12_token_alignment(spark, sf)) == plain(rows, both)
