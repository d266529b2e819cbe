"""Removal of repeated passages: every byte covered by a string of WINDOW bytes that also starts in a smaller document.

A suffix array of the whole corpus would be one sorted table of all positions. Here the windows are first dealt to groups
that hold all equal ones: a window belongs to the smallest hash among its GRAM-byte strings, and a run of successive windows
with the same one is a segment, sent once. Three steps decide what is an earlier occurrence:

- Equal segments are one. In every task, and then in every group, the smallest document of equal segments stays and the
  others are covered at once, so copies of any number shrink to one before they meet.
- Segments of one group that differ may still share windows. For them the bytes are fetched. A window whose hash occurs in
  one document only has no equal elsewhere; the suffixes of the other windows are sorted by their next WINDOW bytes.
  Positions that agree that far are a class, and all but those of its smallest document are covered. No array of longest
  previous factors or of previous and next smaller positions is computed; such an array would reach WINDOW at the same positions.
- Groups whose smallest string is very frequent would gather segments without bound. A sketch of fixed size counts the
  strings of all documents; windows of frequent ones are groups of their own, by the hash of all their bytes.

Spans and kept bytes follow from the covered windows of a document. Equal segments are told by hashes alone: by 64 bits
among those that are sent together, and by 40 bits of the group and 40 of the content in a bucket. Among n segments two
different ones are taken for equal with a chance of about n^2 / 2^65 in the first place and n^2 / 2^81 in the second.

Nulls: a null text is empty; a null id counts as larger than any other. Rows are told apart by id and text together, and
rows of one id never cover each other. An empty table gives no rows. Other input columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evalframe.llm import words
from evalframe.llm.shared import written

WINDOW = 50
GRAM = 20
RUN = 64  # windows of a segment at most
PART_BYTES = 1 << 17  # bytes worked on together, whose hashes stay in a processor's cache
SEND_BYTES = 8 << 20  # bytes of text whose segments are sent together
SLOTS = 1 << 20
PARTS = 64
FREQUENT = 16  # times the mean count of a slot, and at least FEW, make its strings frequent
FEW = 1000
GROUP_BYTES = 16 << 20  # bytes of text for each group of segments, on average
OPEN_BYTES = 8 << 20  # bytes of open segments for each of their buckets, on average
FETCH_BYTES = 4 << 20  # bytes of open segments fetched together

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_LAST = (1 << 63) - 1
_FACTORS = [_U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93), _U(0xCA5A826395121157)]
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, _U), np.ones(1, _U))


def _power(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and their inverses modulo 2^64."""
    global _powers
    if len(_powers[0]) < count:
        back = _U(pow(int(_BASE), -1, 1 << 64))
        _powers = tuple(np.cumprod(np.concatenate([[_U(1)], np.full(count, b, _U)])) for b in (_BASE, back))
    return _powers


def _eights(data: np.ndarray, order: str = "<") -> np.ndarray:
    """The 8 bytes from every position on as a number; zeros follow the end."""
    n = len(data)
    turns = -(-n // 8)
    wide = np.zeros(8 * turns + 8, np.uint8)
    wide[:n] = data
    out = np.empty((turns, 8), _U)
    for i in range(8):
        out[:, i] = wide[i : i + 8 * turns].view(f"{order}u8")
    return out.reshape(-1)[:n]


def _grams(data: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM bytes from every position on (those that run over the end are not used)."""
    n = len(data)
    eight = _eights(np.concatenate([data, np.zeros(GRAM, np.uint8)]))
    out = eight[:n] * _FACTORS[0]
    out += eight[8 : n + 8] * _FACTORS[1]
    out += (eight[16 : n + 16] & _U(0xFFFFFFFF)) * _FACTORS[2]
    return words.mix(out)


def parts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of some rows at a time, their offsets, the rows and where in its row each begins.

    A long row comes in parts that overlap by WINDOW - 1 bytes, so that every window is in one.
    """
    data, offsets = words.binary(column)
    sizes = np.diff(offsets)
    count = np.maximum(1, -(-(sizes - WINDOW + 1) // PART_BYTES))
    rows = np.repeat(np.arange(len(sizes)), count)
    begin = (np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)) * PART_BYTES
    length = np.minimum(sizes[rows] - begin, PART_BYTES + WINDOW - 1)
    total = np.concatenate([[0], np.cumsum(length)])
    first = 0
    while first < len(rows):
        last = max(int(np.searchsorted(total, total[first] + PART_BYTES, side="right")) - 1, first + 1)
        some = slice(first, last)
        if rows[last - 1] - rows[first] == last - 1 - first:  # whole rows, which lie side by side
            yield data[offsets[rows[first]] + begin[first] : offsets[rows[last - 1]] + begin[last - 1] + length[last - 1]], \
                total[first : last + 1] - total[first], rows[some], begin[some]
        else:
            pieces = [data[offsets[r] + x : offsets[r] + x + n] for r, x, n in zip(rows[some], begin[some], length[some])]
            yield np.concatenate(pieces), total[first : last + 1] - total[first], rows[some], begin[some]
        first = last


def _runs(data: np.ndarray, offsets: np.ndarray):
    """Hashes of all strings, smallest hash of every window, start and end of the runs of windows with one smallest string."""
    n = len(data)
    if n < WINDOW:
        empty = np.zeros(0, np.int64)
        return empty.astype(_U), empty.astype(_U), empty, empty
    gram = _grams(data)
    span = WINDOW - GRAM + 1
    least, reach = gram, 1
    while 2 * reach <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < span:
        least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
    least = least[: n - WINDOW + 1]
    inside = np.zeros(n + 1, np.int8)
    fits = np.diff(offsets) >= WINDOW
    np.add.at(inside, offsets[:-1][fits], 1)
    np.add.at(inside, offsets[1:][fits] - WINDOW + 1, -1)
    inside = np.cumsum(inside, dtype=np.int8)[: n - WINDOW + 1] > 0
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (least[1:] != least[:-1])
    new[offsets[:-1][fits]] = True
    starts = np.flatnonzero(new)
    ends = np.flatnonzero(np.concatenate([inside[:-1] & (new[1:] | ~inside[1:]), inside[-1:]])) + 1
    return gram, least, starts, ends


def segments(data: np.ndarray, offsets: np.ndarray, frequent: np.ndarray | None = None):
    """group, content, start, windows and row of every segment: runs of windows with one smallest string.

    Windows of `frequent` strings (a bit for each slot) are segments of their own, their group is their content.
    """
    n, span = len(data), WINDOW - GRAM + 1
    gram, least, starts, ends = _runs(data, offsets)
    if not len(starts):
        empty = np.zeros(0, np.int64)
        return empty.astype(_U), empty.astype(_U), empty, empty, empty
    count = ends - starts
    limit = np.full(len(starts), RUN)
    alone = np.zeros(len(starts), bool)
    if frequent is not None:
        alone = frequent[(least[starts] % _U(SLOTS)).astype(np.int64)]
        limit[alone] = 1
    pieces = -(-count // limit)
    which = np.repeat(np.arange(len(starts)), pieces)
    turn = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = starts[which] + turn * limit[which]
    windows = np.minimum(limit[which], ends[which] - begin)
    group = least[begin]
    power, inverse = _power(n + 1)
    sums = np.concatenate([[_U(0)], np.cumsum(gram * power[:n])])
    content = words.mix((sums[begin + windows + span - 1] - sums[begin]) * inverse[begin] + windows.astype(_U))
    single = alone[which]
    group[single] = words.mix(content[single] ^ _U(0xA0761D6478BD642F))
    rows = np.searchsorted(offsets, begin, side="right") - 1
    return group, content, begin - offsets[rows], windows, rows


def _merge(
    rows: np.ndarray, starts: np.ndarray, ends: np.ndarray, ordered: bool = False
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of a row that touch or overlap, made one; `ordered` if those of a row lie side by side, by their starts."""
    if not len(rows):
        return rows, starts, ends
    if not ordered:
        order = np.lexsort((starts, rows))
        rows, starts, ends = rows[order], starts[order], ends[order]
    wide = np.int64(ends.max() + 1)
    base = np.cumsum(np.concatenate([[0], (rows[1:] != rows[:-1]).astype(np.int64)])) * wide
    reach = np.maximum.accumulate(ends + base)
    new = np.ones(len(rows), bool)
    new[1:] = starts[1:] + base[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(rows)]]) - 1
    return rows[first], starts[first], (reach - base)[last]


# --- frequent strings ---------------------------------------------------------------------------------------------

def _sketching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, slots, held, seen = np.zeros(SLOTS, np.int32), [np.zeros(0, np.int64)], 0, False
    for batch in batches:
        for data, offsets, _, _ in parts(batch.column("text")):
            _, least, starts, ends = _runs(data, offsets)
            slots.append(np.repeat((least[starts] % _U(SLOTS)).astype(np.int64), -(-(ends - starts) // RUN)))
            held, seen = held + len(slots[-1]), True
            if held >= SLOTS:
                counts += np.bincount(np.concatenate(slots), minlength=SLOTS).astype(np.int32)
                slots, held = [np.zeros(0, np.int64)], 0
    if seen:
        counts += np.bincount(np.concatenate(slots), minlength=SLOTS).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(PARTS), pa.int32()), pa.array([p.tobytes() for p in counts.reshape(PARTS, -1)], pa.binary())],
            ["part", "counts"])


def _summed(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b, np.int32).astype(np.int64) for b in group.column("counts").to_pylist())
    return pa.table({"part": group.column("part").slice(0, 1), "counts": [total.tobytes()]})


def frequent_slots(texts: DataFrame) -> np.ndarray:
    sums = texts.select("text").mapInArrow(_sketching, "part int, counts binary").groupBy("part").applyInArrow(
        _summed, "part int, counts binary").orderBy("part").collect()  # of fixed size
    if not sums:
        return np.zeros(SLOTS, bool)
    counts = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in sums])
    return counts > max(FEW, FREQUENT * counts.mean())


# --- equal segments -----------------------------------------------------------------------------------------------

def _first_of_equal(docs, *keys):
    """An order by the keys; which are of the smallest document of those with equal keys, in that order."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0])
    new = np.ones(len(order), bool)
    new[1:] = False
    for key in keys:
        key = key[order]
        new[1:] |= key[1:] != key[:-1]
    docs, first = docs[order], np.flatnonzero(new)
    return order, docs == np.minimum.reduceat(docs, first)[np.cumsum(new) - 1] if len(first) else new


# What is sent of the segments of one group of groups, as byte planes: low bytes of all values first, which packs well.
# Rows come as a list of (doc, row) and how many segments each has.
_SENT = {"group": 5, "content": 5, "start": 4, "windows": 1, "doc": 8, "row": 8, "count": 4}
_PASSED = ["c_row", "c_start", "c_end"]
_SEND = "bucket long, " + ", ".join(f"{c} binary" for c in [*_SENT, *_PASSED])


def _planes(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype(np.int64).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _values(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.reshape(-1).view(np.int64)


def _dealing(buckets: int, frequent: np.ndarray):
    packed = np.packbits(frequent).tobytes()

    def flush(found: list) -> pa.RecordBatch:
        group, content, doc, row, start, windows = (np.concatenate(x) for x in zip(*found))
        one = words.mix(group + content * _FACTORS[1])
        order, least = _first_of_equal(doc, one)
        first = np.zeros(len(one), bool)
        first[order[least]] = True
        gone, stays = np.flatnonzero(~first), np.flatnonzero(first)  # in the order of the rows again
        covered = _merge(row[gone], start[gone], start[gone] + windows[gone] + WINDOW - 1, ordered=True)
        home = ((group[stays] >> _U(40)) % _U(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
        by_home = np.argsort(home, kind="stable")
        cuts = np.searchsorted(home[by_home].astype(np.int64), np.arange(buckets + 1))
        stays = stays[by_home]
        group, content, doc, row, start, windows = (x[stays] for x in (group, content, doc, row, start, windows))
        share = np.linspace(0, len(covered[0]), buckets + 1).astype(np.int64)
        out = []
        for i, (s, e, x, y) in enumerate(zip(cuts, cuts[1:], share, share[1:])):
            if e > s or y > x:
                new = np.ones(e - s, bool)
                new[1:] = (row[s + 1 : e] != row[s : e - 1]) | (doc[s + 1 : e] != doc[s : e - 1])
                first = s + np.flatnonzero(new)
                values = {"group": group[s:e], "content": content[s:e], "start": start[s:e], "windows": windows[s:e],
                          "doc": doc[first], "row": row[first], "count": np.diff(np.concatenate([first, [e]]))}
                out.append((i, *(_planes(values[c], w) for c, w in _SENT.items()), *(c[x:y].tobytes() for c in covered)))
        kinds = [pa.int64()] + [pa.binary()] * (len(_SENT) + 3)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * len(kinds), kinds)], ["bucket", *_SENT, *_PASSED])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.unpackbits(np.frombuffer(packed, np.uint8)).view(bool)
        for batch in batches:
            docs, keys = (np.asarray(batch.column(c), dtype=np.int64) for c in ("doc", "row"))
            found, held = [], 0
            for data, offsets, rows, begin in parts(batch.column("text")):
                group, content, start, windows, part = segments(data, offsets, often)
                found.append((group, content, docs[rows[part]], keys[rows[part]], start + begin[part], windows))
                held += len(data)
                if held >= SEND_BYTES:
                    yield flush(found)
                    found, held = [], 0
            if found:
                yield flush(found)

    return deal


_SPANS = "row long, start long, end long, doc long, open boolean"


def _spans(row, start, end, doc=None, opened=False) -> pa.Table:
    n = len(row)
    return pa.table({"row": pa.array(row, pa.int64()), "start": pa.array(start, pa.int64()), "end": pa.array(end, pa.int64()),
                     "doc": pa.array(doc, pa.int64()) if doc is not None else pa.nulls(n, pa.int64()),
                     "open": pa.array(np.full(n, opened))})


def _decided(table: pa.Table) -> pa.Table:
    """Of one bucket: covered spans, and as `open` the segments that must be compared byte by byte."""
    passed = [np.concatenate([np.frombuffer(x, np.int64) for x in table.column(c).to_pylist()]) for c in _PASSED]
    sent = {c: np.concatenate([_values(x, w) for x in table.column(c).to_pylist()]) for c, w in _SENT.items()}
    doc, row = (np.repeat(sent[c], sent["count"]) for c in ("doc", "row"))
    group, content, start, windows = (sent[c] for c in ("group", "content", "start", "windows"))
    order, least = _first_of_equal(doc, group, content)
    gone = order[~least]
    merged = _merge(np.concatenate([passed[0], row[gone]]), np.concatenate([passed[1], start[gone]]),
                    np.concatenate([passed[2], start[gone] + windows[gone] + WINDOW - 1]))
    covered = _spans(*merged)
    # segments left in a group that have different contents and documents
    firsts = order[least]
    group, content, doc = group[firsts], content[firsts], doc[firsts]
    if not len(firsts):
        return covered
    head = np.ones(len(firsts), bool)
    head[1:] = group[1:] != group[:-1]
    begin = np.flatnonzero(head)
    member = np.cumsum(head) - 1
    mixed = np.maximum.reduceat(doc, begin) != np.minimum.reduceat(doc, begin)
    contents = np.add.reduceat(np.concatenate([[1], ((content[1:] != content[:-1]) | head[1:]).astype(np.int64)]), begin)
    ambiguous = (mixed & (contents > 1))[member]
    take = firsts[ambiguous]
    return pa.concat_tables([covered, _spans(row[take], start[take], start[take] + windows[take] + WINDOW - 1, doc[ambiguous], True)])


# --- longest previous factors -------------------------------------------------------------------------------------

def suffix_ranks(data: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Ranks of the positions `at` (all) by their next WINDOW bytes; only positions with so many bytes mean something."""
    at = np.arange(len(data)) if at is None else at
    words_of = _eights(np.concatenate([data, np.zeros(WINDOW, np.uint8)]), ">")
    keys = [words_of[at + i] for i in [*range(0, WINDOW - 8, 8), WINDOW - 8]]  # the last two may overlap
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(at), bool)
    for key in keys:
        key = key[order]
        new[1:] |= key[1:] != key[:-1]
    ranks = np.empty(len(at), np.int64)
    ranks[order] = np.cumsum(new)
    return ranks


def _elsewhere(data: np.ndarray, at: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The windows whose hash is also that of a window of another document, by number; all others have no equal there."""
    eight = _eights(data)
    value = np.zeros(len(at), _U)
    for i, k in enumerate([*range(0, WINDOW - 8, 8), WINDOW - 8]):
        value += eight[at + k] * (_FACTORS[i % 3] + _U(2 * i))
    value = words.mix(value)
    order = np.argsort(value)
    value = value[order]
    same = value[1:] == value[:-1]
    often = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    order, value = order[often], value[often]
    if not len(order):
        return order
    new = np.ones(len(order), bool)
    new[1:] = value[1:] != value[:-1]
    own, first = docs[order], np.flatnonzero(new)
    mixed = np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first)
    return order[mixed[np.cumsum(new) - 1]]


def covered_windows(data: np.ndarray, at: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Which windows, at positions `at` of `data`, have a longest previous factor of WINDOW bytes or more.

    Previous is what belongs to a smaller document. In suffix order the nearest smaller document before a suffix that
    agrees for WINDOW bytes exists exactly if its run of agreeing suffixes has a smaller one.
    """
    out = np.zeros(len(at), bool)
    some = _elsewhere(data, at, docs) if len(at) else np.zeros(0, np.int64)
    if len(some):
        ranks, own = suffix_ranks(data, at[some]), docs[some]
        least = np.full(int(ranks.max()) + 1, _LAST)
        np.minimum.at(least, ranks, own)
        out[some] = least[ranks] < own
    return out


# Open segments on the way to their bucket: one row for those of a bucket that are fetched together.
_FETCHED = {"row": np.int64, "start": np.int64, "doc": np.int64, "size": np.int32, "bytes": np.uint8}
_FETCH = "bucket long, " + ", ".join(f"{c} binary" for c in _FETCHED)


def _gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Spans of `data`, one after the other."""
    return data[np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)]


def _fetching(buckets: int):
    def packed(data, begin, size, row, start, doc) -> pa.RecordBatch:
        piece = _gathered(data, begin, size)
        bounds = np.cumsum(size) - size
        gram = _grams(piece)
        inside = np.ones(len(piece), bool)
        inside[(bounds + size)[:, None] - np.arange(1, GRAM)] = False  # strings that run over the end of their segment
        gram[~inside] = _U((1 << 64) - 1)
        bucket = (np.minimum.reduceat(gram, bounds) % _U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        piece = _gathered(piece, bounds[order], size[order])
        ends = np.concatenate([[0], np.cumsum(size[order])])
        bucket = bucket[order]
        values = [x[order].astype(t) for x, t in zip((row, start, doc, size), _FETCHED.values())]
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        last = np.concatenate([first[1:], [len(bucket)]])
        columns = [[x[s:e].tobytes() for s, e in zip(first, last)] for x in values]
        columns.append([piece[ends[s] : ends[e]].tobytes() for s, e in zip(first, last)])
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[first], pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], ["bucket", *_FETCHED])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of open segments, dealt by the group that they belong to."""
        for batch in batches:
            data, offsets = words.binary(batch.column("text"))
            opened = batch.column("opened")
            which = np.repeat(np.arange(len(opened)), np.asarray(opened.value_lengths(), dtype=np.int64))
            start, end, doc = (np.asarray(opened.flatten().field(i), dtype=np.int64) for i in range(3))
            row, size = np.asarray(batch.column("row"), dtype=np.int64)[which], end - start
            begin, total, first = offsets[which] + start, np.concatenate([[0], np.cumsum(size)]), 0
            while first < len(which):
                last = max(int(np.searchsorted(total, total[first] + FETCH_BYTES, side="right")) - 1, first + 1)
                yield packed(data, *(x[first:last] for x in (begin, size, row, start, doc)))
                first = last

    return fetch


def _compared(table: pa.Table) -> pa.Table:
    rows, starts, docs, sizes, data = (
        np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in _FETCHED.items())
    sizes = sizes.astype(np.int64)
    counts = sizes - WINDOW + 1
    which = np.repeat(np.arange(len(sizes)), counts)
    turn = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    found = covered_windows(data, (np.cumsum(sizes) - sizes)[which] + turn, docs[which])
    begin = starts[which[found]] + turn[found]
    return _spans(*_merge(rows[which[found]], begin, begin + WINDOW))


# --- the operator -------------------------------------------------------------------------------------------------

def _removing(keep_text: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = words.binary(batch.column("text"))
            lists = batch.column("starts")
            count = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
            which, a, b = _merge(np.repeat(np.arange(len(lists)), count), *(
                np.asarray(batch.column(c).flatten(), dtype=np.int64) for c in ("starts", "ends")))
            cuts = np.searchsorted(which, np.arange(len(lists) + 1)).tolist()
            inner = np.stack([offsets[which] + a, offsets[which] + b], axis=1).reshape(-1).tolist()
            raw, sizes, out = memoryview(data), np.diff(offsets).tolist(), []
            for i, (own, own_end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                edges = [own, *inner[2 * cuts[i] : 2 * cuts[i + 1]], own_end]
                left = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2]))
                out.append((sizes[i], sizes[i] - len(left), cuts[i + 1] - cuts[i], hashlib.sha256(left).hexdigest(),
                            left if keep_text else None))
            kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 5, kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), *columns], ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return remove


def deduplicated(documents: DataFrame, key: str, text: str, keep_text: bool = True) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that stay, if asked for) of every row."""
    spark = documents.sparkSession
    content = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    texts = documents.select(
        F.col(key).cast("long").alias("key"), F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("doc"),
        F.xxhash64(F.col(key), content).alias("row"), content.alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions, math.ceil(size / GROUP_BYTES))
    sent = texts.select("doc", "row", "text").mapInArrow(_dealing(buckets, frequent_slots(texts)), _SEND)
    decided = written(sent.groupBy("bucket").applyInArrow(_decided, _SPANS), "segments")
    opened = decided.where("open").groupBy("row").agg(F.collect_list(F.struct("start", "end", "doc")).alias("opened"))
    size = decided.where("open").agg(F.sum(F.col("end") - F.col("start"))).first()[0] or 0
    buckets = max(partitions, math.ceil(size / OPEN_BYTES))
    # the texts are dealt by row once, for this join and the last one
    texts = texts.select("key", "row", "text")
    fetched = texts.join(opened, "row").select("key", "row", "text", "opened").mapInArrow(
        _fetching(buckets), _FETCH)
    compared = fetched.groupBy("bucket").applyInArrow(_compared, _SPANS)
    spans = decided.where("NOT open").unionByName(compared).groupBy("row").agg(
        F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = texts.join(spans, "row", "left").select("key", "row", "text", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))
    return joined.mapInArrow(
        _removing(keep_text), "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
