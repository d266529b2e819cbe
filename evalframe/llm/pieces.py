"""Texts cut into pieces that a tokenizer treats alike wherever they stand, and what is remembered of each piece.

A piece ends before a blank or a line feed that follows a character which is no white space, and between an ASCII letter and
one of a few marks. Pieces are found in the bytes of many texts at once and told apart by 64-bit hashes, so Python is spent
on the different pieces of a slice only.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from evalframe.llm import words

# The last bytes of white space in UTF-8, by the bytes before them.
_AFTER_C2 = [0x85, 0xA0]
_AFTER_E280 = [*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF]

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _ends_blank(data: np.ndarray) -> np.ndarray:
    """Which bytes are the last of a white space character."""
    out = _BLANK[data]
    if len(data) > 1 and (data == 0xC2).any():
        out[1:] |= (data[:-1] == 0xC2) & np.isin(data[1:], _AFTER_C2)
    if len(data) > 2 and ((data >= 0xE1) & (data <= 0xE3)).any():
        a, b, c = data[:-2], data[1:-1], data[2:]
        out[2:] |= (
            ((a == 0xE2) & (b == 0x80) & np.isin(c, _AFTER_E280)) | ((a == 0xE2) & (b == 0x81) & (c == 0x9F))
            | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80)))
    return out


_LAST_OF_BLANK = frozenset([9, 10, 11, 12, 13, 32, 0x80, 0x9F, *_AFTER_C2, *_AFTER_E280])


def may_end_blank(span: bytes) -> bool:
    """False when the last character is surely no white space."""
    return span[-1] in _LAST_OF_BLANK and span.decode()[-1].isspace()


BLANKS, MARKS = b" \n", b",.;:!?)"
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def cut(data: np.ndarray, offsets: np.ndarray, before: bytes = BLANKS + MARKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the pieces of each row begin and end, and their rows; pieces tile the rows. Cuts are before these bytes."""
    blank, mark = np.zeros(256, bool), np.zeros(256, bool)
    blank[[b for b in before if b in BLANKS]] = True
    mark[[b for b in before if b in MARKS]] = True
    begins = blank[data]
    begins[1:] &= ~_ends_blank(data)[:-1]
    begins[1:] |= mark[data[1:]] & _LETTER[data[:-1]]
    begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    starts = np.flatnonzero(begins)
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, np.append(starts[1:], len(data)), rows


def spread(values: list[bytes], which: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The chosen values one after another as numbers, and how many numbers each has."""
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // np.dtype(kind).itemsize
    flat = np.frombuffer(b"".join(values), kind)
    starts = np.cumsum(sizes) - sizes
    counts = sizes[which]
    ends = np.cumsum(counts)
    if not len(ends):
        return flat[:0], counts
    return flat[np.arange(ends[-1]) + np.repeat(starts[which] - (ends - counts), counts)], counts


class Memory:
    """What `make` gives for different pieces, in two generations of at most `size`; the older is forgotten first."""

    def __init__(self, make: Callable[[list[bytes]], list], size: int, longest: int = 100) -> None:
        self.make, self.size, self.longest = make, size, longest
        self.young: dict[int, object] = {}
        self.old: dict[int, object] = {}

    def values(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[list, np.ndarray]:
        """The values of the different pieces, and which of them each piece has."""
        hashes, first, which = np.unique(words.hash_spans(data, starts, stops), return_index=True, return_inverse=True)
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}
        young, old, keys = self.young, self.old, hashes.tolist()
        found: list = list(map(young.get, keys))
        unknown = []
        for i, value in enumerate(found):
            if value is None:
                value = old.get(keys[i])
                if value is None:
                    unknown.append(i)
                else:
                    found[i] = young[keys[i]] = value
        whole = data.tobytes() if unknown else b""
        spans = [whole[a:b] for a, b in zip(starts[first[unknown]].tolist(), stops[first[unknown]].tolist())] if unknown else []
        for i, span, value in zip(unknown, spans, self.make(spans) if spans else []):
            found[i] = value
            if len(span) <= self.longest:
                young[keys[i]] = value
        return found, which
