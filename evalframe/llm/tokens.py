"""Token ids of whole texts as packed bytes, by a public tokenizer file that the workers load themselves.

The text splitting of a byte-level vocabulary always starts a new piece at a blank or a line feed after a character that is
no white space, and at a mark after a letter, so ids never reach across these places. Texts are cut there; every different piece is encoded once by the
tokenizers library and remembered, and the ids of the pieces are put together for many texts at once. That gives the
library's own ids of the whole text in a fraction of the time. With another kind of vocabulary texts are encoded whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from evalframe.llm import words
from evalframe.llm.pieces import BLANKS, MARKS, Memory, cut, may_end_blank, spread

MEMORY = 400_000  # pieces in each of two generations
GROUP = 64  # pieces encoded as one text
TOGETHER = 64  # texts encoded in one call


def tokenizer_file(name: str) -> str:
    """A path as it is; the name of a public file is looked up where the worker runs."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """`encode(texts)` gives the ids of each text as little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, name: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file(name))
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.vocabulary = self.tokenizer.get_vocab_size()
        parts = ["a", "\nb", " c", *(p for m in MARKS.decode() for p in (m, " c"))]
        known = [self.tokenizer.encode(p, add_special_tokens=False).ids for p in parts]
        same = self.tokenizer.encode("".join(parts), add_special_tokens=False).ids == sum(known, [])
        self.before = BLANKS + MARKS if same else b""
        vocabulary = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)  # a letter of a byte-level token is a byte
        for token, i in vocabulary.items():
            self.sizes[i] = len(token)
        self.memory = Memory(self._encoded, MEMORY)

    def _encoded(self, spans: list[bytes]) -> list[bytes]:
        """The ids of each piece. Pieces that end with no white space are put together as one text and told apart by size."""
        out = [b""] * len(spans)
        free = [bool(self.before) and s[0] in BLANKS and not may_end_blank(s) for s in spans]
        joint, alone = [i for i, f in enumerate(free) if f], [i for i, f in enumerate(free) if not f]
        for at in range(0, len(joint), TOGETHER * GROUP):
            groups = [joint[a : a + GROUP] for a in range(at, min(at + TOGETHER * GROUP, len(joint)), GROUP)]
            texts = [b"".join([spans[i] for i in group]) for group in groups]
            for group, ids in zip(groups, self._batch(texts)):
                ends = np.cumsum([len(spans[i]) for i in group])
                reached = np.cumsum(self.sizes[ids])
                cuts = np.searchsorted(reached, ends)
                if not len(ids) or (reached[np.minimum(cuts, len(ids) - 1)] != ends).any():
                    alone += group
                    continue
                packed, begin = ids.tobytes(), 0
                for i, end in zip(group, (4 * (cuts + 1)).tolist()):
                    out[i], begin = packed[begin:end], end
        for at in range(0, len(alone), TOGETHER):
            some = alone[at : at + TOGETHER]
            for i, ids in zip(some, self._batch([spans[i] for i in some])):
                out[i] = ids.tobytes()
        return out

    def _batch(self, spans: list[bytes]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast([s.decode() for s in spans], add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in found]

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each text has."""
        starts, stops, rows = cut(data, offsets, self.before)
        found, which = self.memory.values(data, starts, stops)
        ids, counts = spread(found, which, "<u4")
        return ids, np.bincount(rows, counts, len(offsets) - 1).astype(np.int64)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for _, _, data, offsets in words.slices(pa.array(texts, pa.string())):
            ids, counts = self.ids(data, offsets)
            ends = np.cumsum(counts)
            out += [ids[a:b].tobytes() for a, b in zip(ends - counts, ends)]
        return out


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """The worker's encoder for a file, loaded once."""
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]
