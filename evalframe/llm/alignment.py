"""Alignment of the tokens of two tokenizers over the same bytes.

A is a byte-level vocabulary of the tokenizers library and reads a blank and the text; B is a sentencepiece model, which adds
that blank itself. Character offsets (A) and the spans of the proto (B, bytes) give where most tokens end; where several
tokens share a character, or a token is a byte of one that the vocabulary lacks, the decoded bytes of the tokens tell how
far each reaches. Byte offsets where tokens of both end part a text into groups; a token of A and one of B that end together
are a link.

A never reaches from a character that is no white space to a blank or a line feed, or from a letter to a mark, nor does B
unless a piece of its vocabulary holds such a place (checked when a model is loaded). So texts are cut there, and every different piece is encoded
and aligned once and remembered under its 64-bit hash; the groups of a text are those of its pieces in a row.

Of two tokens that end together the bytes of one are a suffix of the other's. The pairs of ids that can ever be linked are
therefore at most `pair_bound`: the sum, over all tokens of both, of the tokens of the other that are suffixes of them. That bounds
the table of counts, which goes to every task; counts and highest counts themselves are sums and maxima over all documents.

A text that is null or empty, or whose tokens do not give back a blank and the text (it holds U+2581, or white space that the
model drops), has no tokens: zeros and an empty digest. Strings of special tokens inside texts are ordinary text. Rows are
never joined by their id, so null and repeated ids are rows like others. Very long words are encoded whole but not
remembered. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evalframe.llm import words
from evalframe.llm.pieces import BLANKS, MARKS, Memory, cut, may_end_blank, spread
from evalframe.llm.shared import written
from evalframe.llm.tokens import tokenizer_file

MEMORY = 200_000  # pieces remembered in each of two generations
LONGEST = 100  # characters of a piece that is remembered
GROUP = 64  # pieces encoded as one text

# The white space of Unicode, at which byte-level vocabularies split.
_BLANKS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

_NONE = (0, 0, 0, b"", b"")
_WHOLE = (-1, 0, 0, b"", b"")  # a piece that only the whole text tells how B splits


def _byte_of_letter() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Encodes by both tokenizers and aligns; `rows` takes texts as bytes."""

    def __init__(self, name_a: str, name_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(tokenizer_file(name_a))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(name_b))
        letters = _byte_of_letter()
        tokens = {i: t for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        size = max(tokens, default=-1) + 1
        self.bytes_a = [bytes(letters[c] for c in tokens[i]) if i in tokens and all(c in letters for c in tokens[i]) else b""
                        for i in range(size)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.raw_b = np.array([self.b.is_byte(i) for i in range(len(pieces))], bool)
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.raw_b[i] else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        inside = "".join(p.replace("▁", " ") + "\0 \0" for i, p in enumerate(pieces)
                         if not self.raw_b[i] and not self.b.is_control(i) and not self.b.is_unknown(i))
        self.before = bytes(ord(c) for c in BLANKS.decode() if not re.search(f"[^{_BLANKS}\0]{c}", inside)) + bytes(
            ord(c) for c in MARKS.decode() if not re.search("[A-Za-z]" + re.escape(c), inside))
        self.codes = np.dtype("<u4" if len(self.bytes_a) * len(pieces) < 1 << 32 else "<u8")
        self.size_a, self.size_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        self.names_a, self.names_b = ([str(i) for i in range(len(x))] for x in (self.bytes_a, self.bytes_b))
        self.memory = Memory(self._packed, MEMORY, LONGEST)

    def pair_bound(self) -> int:
        """How many pairs of ids can be linked at most."""
        def suffixes(tokens: list[bytes], others: list[bytes]) -> int:
            known: dict[bytes, int] = {}
            for t in others:
                known[t] = known.get(t, 0) + 1
            return sum(known.get(t[i:], 0) for t in tokens for i in range(len(t)))

        return suffixes(self.bytes_a, self.bytes_b) + suffixes(self.bytes_b, self.bytes_a)

    def _ends_a(self, text: str, ids: np.ndarray, offsets: list[tuple[int, int]]) -> np.ndarray:
        """Where each token of A ends, in bytes: where its last character does, unless the next token shares that."""
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        at = np.zeros(len(points) + 1, np.int64)
        np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), out=at[1:])
        spans = np.array(offsets, np.int64).reshape(-1, 2)
        shared = np.append(spans[1:, 0] < spans[:-1, 1], False)[: len(ids)]
        return np.where(shared, np.cumsum(self.size_a[ids]), at[spans[:, 1]])

    def _ends_b(self, ids: np.ndarray, stops: list[int]) -> np.ndarray:
        """The same of B. Its spans do not count the blank that it puts before a text; a byte token is a byte."""
        return np.where(self.raw_b[ids], np.cumsum(self.size_b[ids]), np.array(stops, np.int64) + 1)

    def _aligned(self, text: str, bounds: list[int]) -> list[tuple] | None:
        """The alignment of the parts of a text that starts with a blank; None where a token reaches across a bound."""
        enc, found = self.a.encode(text, add_special_tokens=False), self.b.encode(text[1:], return_type="proto").pieces
        list_a, list_b = enc.ids, [t.id for t in found]
        if not list_b and text == " ":
            list_b = [self.b.piece_to_id("▁")]  # B puts its blank before some text only
        data, bytes_a, bytes_b = text.encode(), self.bytes_a, self.bytes_b
        if b"".join([bytes_a[i] for i in list_a]) != data or b"".join([bytes_b[i] for i in list_b]) != data:
            return [_NONE] if len(bounds) == 1 else None
        ids_a, ids_b = np.array(list_a, np.int64), np.array(list_b, np.int64)
        ends_a, ends_b = self._ends_a(text, ids_a, enc.offsets), self._ends_b(ids_b, [t.end for t in found] or [0])
        near = np.searchsorted(ends_b, ends_a)
        last_a = np.flatnonzero(ends_b[np.minimum(near, len(ends_b) - 1)] == ends_a)
        last_b = near[last_a]
        cuts = np.searchsorted(ends_a[last_a], bounds)
        if (ends_a[last_a][np.minimum(cuts, len(last_a) - 1)] != bounds).any():
            return None
        links = (ids_a[last_a] * len(bytes_b) + ids_b[last_b]).astype(self.codes)
        name_a, name_b = [self.names_a[i] for i in list_a], [self.names_b[i] for i in list_b]
        groups, a, b = [], 0, 0
        for x, y in zip((last_a + 1).tolist(), (last_b + 1).tolist()):
            if x - a == 1 and y - b == 1:
                groups.append(name_a[a] + "|" + name_b[b])
            else:
                groups.append(",".join(name_a[a:x]) + "|" + ",".join(name_b[b:y]))
            a, b = x, y
        out, from_a, from_b, begin = [], 0, 0, 0
        for end, to_a, to_b in zip((cuts + 1).tolist(), (last_a[cuts] + 1).tolist(), (last_b[cuts] + 1).tolist()):
            out.append((to_a - from_a, to_b - from_b, end - begin, ";".join(groups[begin:end]).encode(), links[begin:end].tobytes()))
            from_a, from_b, begin = to_a, to_b, end
        return out

    def _packed(self, spans: list[bytes]) -> list[bytes]:
        """Rows as one value each, which takes less memory: three counts, the links, the groups."""
        return [np.array(r[:3], "<i4").tobytes() + r[4] + r[3] for r in self._encoded(spans)]

    def _encoded(self, spans: list[bytes]) -> list[tuple]:
        """The alignment of each piece. Pieces that end with no white space are put together as one text, behind a word."""
        out: list[tuple] = [_WHOLE] * len(spans)
        free = [bool(self.before) and s[0] in BLANKS and not may_end_blank(s) for s in spans]
        joint, alone = [i for i, f in enumerate(free) if f], [i for i, f in enumerate(free) if not f]
        for at in range(0, len(joint), GROUP):
            group = joint[at : at + GROUP]
            parts = [b" a", *(spans[i] for i in group)]
            rows = self._aligned(b"".join(parts).decode(), np.cumsum([len(p) for p in parts]).tolist())
            if rows is None:
                alone += group
                continue
            for i, row in zip(group, rows[1:]):
                out[i] = row
        for i in alone:
            if spans[i][0] == 32:
                out[i] = self._aligned(spans[i].decode(), [len(spans[i])])[0]
            else:  # what B makes of a text without its blank is told behind a word
                rows = self._aligned(" a" + spans[i].decode(), [2, 2 + len(spans[i])])
                out[i] = _WHOLE if rows is None else rows[1]
        return out

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
        """n_a, n_b, n_groups, the groups as text and the links of each text."""
        filled = np.diff(offsets) > 0
        data = np.insert(data, offsets[:-1][filled], 32)
        offsets = offsets + np.concatenate([[0], np.cumsum(filled)])
        starts, stops, rows = cut(data, offsets, self.before)
        found, which = self.memory.values(data, starts, stops)
        numbers = np.frombuffer(b"".join([v[:12] for v in found]), "<i4").reshape(-1, 3).astype(np.int64)
        middle = (12 + self.codes.itemsize * numbers[:, 2]).tolist()
        groups = [v[m:] for v, m in zip(found, middle)].__getitem__
        links, counts = spread([v[12:m] for v, m in zip(found, middle)], which, self.codes.str)
        ends = np.cumsum(counts)
        heads = np.searchsorted(rows, np.arange(len(offsets)))
        out = []
        for row, (a, b) in enumerate(zip(heads, heads[1:])):
            mine = numbers[which[a:b]]
            if a == b:
                out.append(_NONE)
            elif (mine[:, 0] > 0).all():
                text = b";".join(map(groups, which[a:b].tolist()))
                out.append((*mine.sum(axis=0).tolist(), text, links[ends[a] - counts[a] : ends[b - 1]].tobytes()))
            elif (mine[:, 0] < 0).any():
                text = data[offsets[row] : offsets[row + 1]].tobytes()
                out.append(self._aligned(text.decode(), [len(text)])[0])
            else:
                out.append(_NONE)
        return out


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(name_a: str, name_b: str) -> Aligner:
    """The worker's aligner for two files, loaded once."""
    if (name_a, name_b) not in _aligners:
        _aligners[name_a, name_b] = Aligner(name_a, name_b)
    return _aligners[name_a, name_b]


def _rows(name_a: str, name_b: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = aligner(name_a, name_b)
        for batch in batches:
            for first, last, data, offsets in words.slices(batch.column("text")):
                found = by.rows(data, offsets)
                digests = [hashlib.sha256(r[3]).hexdigest() if r[0] else "" for r in found]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(first, last - first), *(pa.array([r[i] for r in found], pa.int64()) for i in range(3)),
                    pa.array(digests), pa.array([r[4] for r in found], pa.binary()),
                ], ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])

    return rows


def aligned(documents: DataFrame, key: str, text: str, name_a: str, name_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256 and `links` (the codes a * vocabulary of B + b, packed) of every row."""
    narrow = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(
        _rows(name_a, name_b), "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary")


def _counted(codes: str):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:  # what is kept is bounded by the pairs that can be linked
            links = np.frombuffer(b"".join(batch.column("links").to_pylist()), codes).astype(np.int64)
            new, count = np.unique(links, return_counts=True)
            keys, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
            sums = np.bincount(at, np.concatenate([sums, count]), len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], ["pair", "count"])

    return counted


def _scored(codes: str, pairs: np.ndarray, counts: np.ndarray, best: np.ndarray):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [b or b"" for b in batch.column("links").to_pylist()]
            sizes = np.array([len(b) for b in blobs], np.int64) // np.dtype(codes).itemsize
            at = np.searchsorted(pairs, np.frombuffer(b"".join(blobs), codes).astype(np.int64))
            rows = np.repeat(np.arange(len(blobs)), sizes)
            total, good = np.zeros(len(blobs), np.int64), np.zeros(len(blobs), np.int64)
            np.add.at(total, rows, counts[at])
            np.add.at(good, rows, best[at].astype(np.int64))
            rest = batch.drop_columns(["links"])
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array(sizes), pa.array(good), pa.array(total)], [*rest.schema.names, "n_links", "n_best", "count_sum"])

    return scored


def pair_counts(rows: DataFrame, name_a: str, name_b: str) -> DataFrame:
    """pair, a, b, count (links of all documents) and best (no link of that b counts more), of `aligned` rows."""
    by = aligner(name_a, name_b)
    size = len(by.bytes_b)
    counts = rows.select("links").mapInArrow(_counted(by.codes.str), "pair long, count long").groupBy("pair").agg(
        F.sum("count").alias("count")).withColumn("b", F.col("pair") % size)
    counts = written(counts, "pair-counts")
    top = counts.groupBy("b").agg(F.max("count").alias("_top"))
    return counts.join(top, "b").select(
        "pair", F.expr(f"pair div {size}").alias("a"), "b", "count", (F.col("count") == F.col("_top")).alias("best"))


def aligned_documents(documents: DataFrame, key: str, text: str, name_a: str, name_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    by = aligner(name_a, name_b)
    rows = written(aligned(documents, key, text, name_a, name_b), "aligned")
    table = pair_counts(rows, name_a, name_b).select("pair", "count", "best").orderBy("pair").toArrow()
    if table.num_rows > by.pair_bound():
        raise ValueError("more pairs of ids are linked than their bytes allow")
    columns = (table.column(c).to_numpy() for c in ("pair", "count", "best"))
    scored = rows.mapInArrow(
        _scored(by.codes.str, *columns), "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, "
        "n_best long, count_sum long")
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
