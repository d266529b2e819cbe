"""Words, shingles and token ids against plain versions."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from evalframe.llm import tokens, words

TEXT = st.text(alphabet=st.sampled_from(list("aAbBéÉ .,\n\t\r\x0b\x0c\x1c\x85\xa0　'12 ")), max_size=60)


def plain_set(text: str | None, width: int) -> set[tuple[bytes, ...]]:
    found = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if len(found) < width:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + width]) for i in range(len(found) - width + 1)}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8), st.integers(1, 5))
def test_shingle_sets(texts, width):
    sizes, by_hash = [], {}
    for first, last, data, offsets in words.slices(pa.array(texts, pa.string()), 40):
        members, bounds = words.shingle_sets(data, offsets, width)
        for text, a, b in zip(texts[first:last], bounds, bounds[1:]):
            sizes.append(b - a)
            assert by_hash.setdefault(frozenset(members[a:b].tolist()), plain_set(text, width)) == plain_set(text, width)
            assert list(members[a:b]) == sorted(members[a:b])
    assert sizes == [len(plain_set(t, width)) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_token_ids_are_those_of_the_whole_text(texts):
    encode = tokens.encoder("byte_bpe_50k.json")
    texts = [*texts, "<|endoftext|> <|endoftext|>", "it's\nfine ", None]
    whole = [encode.tokenizer.encode(t, add_special_tokens=False).ids if t else [] for t in texts]
    assert [np.frombuffer(p, "<u4").tolist() for p in encode.encode(texts)] == whole


def test_remembered_pieces_are_forgotten(monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 5)
    encode = tokens.Encoder("byte_bpe_50k.json")
    for k in range(6):
        text = " ".join(f"word{i}" for i in range(k, k + 9))
        assert encode.encode([text])[0] == np.asarray(
            encode.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert len(encode.memory.young) < 40
