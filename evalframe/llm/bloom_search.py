"""Ranked lexical search by bit-sliced Bloom signatures.

Terms are runs of ASCII letters and digits and of all bytes above 127, with A-Z lower-cased. One pass over the documents
makes blocks of signatures: documents of similar size side by side, a row of bits (a slice) for every position of their
Bloom filters, so the documents that may hold a term are the AND of a few slices. A filter holds every term and, for terms
that occur more often, one more entry for each step of LEVELS that their frequency reaches. So a signature gives an upper bound
of every term's frequency, never too low, and with the length of the document, which the block has, an upper bound of its
score: a sum of slices weighted by terms and steps. The pass also gives the counts of the whole corpus.

The documents with the highest bounds of each query are scored exactly first. The k-th best of these scores is a line that
the k-th best of all cannot lie below, so every document whose bound is lower is excluded; all others are scored exactly
from their texts, and the best k stay. Blocks of queries meet blocks of documents, one of each in a task at a time.

Terms are compared by 64-bit hashes; two different ones agree with a chance of about 2^-57. Documents with a null text have no
terms. Every row is a document; rows of one id are ranked one by one, in any order where scores are equal too. Documents with a
null id count in the statistics and are not returned. Rows of queries with one id are one query with the terms of all of
them; a null id is no query, and a query without terms has no results. Very long documents are signed whole, in a block of
few. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from evalframe.llm import words
from evalframe.llm.shared import written

LEVELS = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 128, 256, 512, 1024, 1 << 14, 1 << 20, 1 << 30], np.int64)
HASHES = 4  # bits of an entry
ENTRY_BITS = 12  # bits of a filter for each entry that it can hold
BLOCK_DOCS, BLOCK_ENTRIES = 2048, 1 << 19  # a block is full with so many documents or so many entries
QUERY_ROWS = 256
BITS = 1 << 23  # of the map of query terms
PART_ROWS = 4096  # documents scored by one task, on average

_U = np.uint64
_MAPPED = np.full(256, 32, np.uint8)
for _a, _b in ((48, 58), (97, 123), (128, 256)):
    _MAPPED[_a:_b] = np.arange(_a, _b)
_MAPPED[65:91] = np.arange(97, 123)


# --- terms --------------------------------------------------------------------------------------------------------

def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and frequency of each different term of every row, in order of rows and hashes."""
    data = _MAPPED[data]
    starts, stops, rows = words.split(data, offsets)
    hashes = words.hash_spans(data, starts, stops)
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(first)
    return rows[at], hashes[at], np.diff(np.append(at, len(rows)))


def _bit(hashes: np.ndarray) -> np.ndarray:
    return (hashes % _U(BITS)).astype(np.int64)


def _packed_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(BITS, bool)
    for batch in batches:
        bits[_bit(np.asarray(batch.column("term"), dtype=np.int64).view(_U))] = True
    parts = np.packbits(bits).reshape(64, -1)
    some = np.flatnonzero(parts.any(axis=1))
    yield pa.RecordBatch.from_arrays(
        [pa.array(some, pa.int32()), pa.array([parts[i].tobytes() for i in some], pa.binary())], ["part", "bits"])


def _merged_bits(group: pa.Table) -> pa.Table:
    bits = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in group.column("bits").to_pylist()])
    return pa.table({"part": group.column("part").slice(0, 1), "bits": [bits.tobytes()]})


def _term_map(asked: DataFrame) -> bytes:
    """A bit map of fixed size of the queries' terms."""
    rows = asked.select("term").mapInArrow(_packed_bits, "part int, bits binary").groupBy("part").applyInArrow(
        _merged_bits, "part int, bits binary").collect()
    out = np.zeros((64, BITS // 512), np.uint8)
    for row in rows:
        out[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return out.tobytes()


def _query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """_item, term, times of every query."""
    kind = dict(queries.dtypes)[key]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in words.slices(batch.column("text")):
                rows, hashes, times = terms(data, offsets)
                yield pa.RecordBatch.from_arrays([
                    batch.column("_item").slice(first, last - first).take(pa.array(rows)), pa.array(hashes.view(np.int64)),
                    pa.array(times, pa.int64())], ["_item", "term", "times"])

    narrow = queries.select(F.col(key).alias("_item"), F.col(text).cast("string").alias("text")).where("_item IS NOT NULL")
    return narrow.mapInArrow(found, f"_item {kind}, term long, times long").groupBy("_item", "term").agg(
        F.sum("times").alias("times"))


# --- signatures ---------------------------------------------------------------------------------------------------

def _positions(hashes: np.ndarray, levels: np.ndarray | int, size: int) -> np.ndarray:
    """Where the bits of the entries are: one row of HASHES places each."""
    seeds = words.mix(hashes + np.asarray(levels).astype(_U) * _U(0x9E3779B97F4A7C15) + _U(1))
    steps = words.mix(seeds) | _U(1)
    return ((seeds[:, None] + steps[:, None] * np.arange(HASHES, dtype=_U)) % _U(size)).astype(np.int64)


def _signed(ids: np.ndarray, sizes: np.ndarray, room: int, rows: np.ndarray, hashes: np.ndarray, steps: np.ndarray) -> tuple:
    """A block: its documents' ids and lengths, the bits of a filter, and the slices."""
    bits = room * ENTRY_BITS
    slices = np.zeros((bits, -(-len(ids) // 8) * 8), bool)
    for level in range(int(steps.max()) if len(steps) else 0):
        there = steps > level
        slices[_positions(hashes[there], level, bits).ravel(), np.repeat(rows[there], HASHES)] = True
    return ids.tobytes(), sizes.tobytes(), bits, np.packbits(slices, axis=1).tobytes()


_BLOCK = "kind int, ids binary, sizes binary, bits long, slices binary, n_docs long, n_terms long, terms binary, counts binary"
_BLOCK_TYPES = pa.schema([
    ("kind", pa.int32()), ("ids", pa.binary()), ("sizes", pa.binary()), ("bits", pa.int64()), ("slices", pa.binary()),
    ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("terms", pa.binary()), ("counts", pa.binary())])


def _blocks(term_map: bytes):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(np.frombuffer(term_map, np.uint8)).view(bool)
        held: dict[int, list] = {}  # by the room of a filter: ids, sizes, rows, hashes, steps of some documents each
        filled: dict[int, list[int]] = {}
        n_docs, n_terms = 0, 0
        asked, counts = np.zeros(0, _U), np.zeros(0, np.int64)

        def block(room: int) -> pa.RecordBatch:
            parts = held.pop(room)
            filled.pop(room)
            before = np.cumsum([0] + [len(p[0]) for p in parts[:-1]])
            rows = np.concatenate([p[2] + b for p, b in zip(parts, before)])
            made = _signed(*(np.concatenate([p[i] for p in parts]) for i in (0, 1)), room, rows,
                           *(np.concatenate([p[i] for p in parts]) for i in (3, 4)))
            return pa.RecordBatch.from_pylist([dict(zip(_BLOCK_TYPES.names, (1, *made, 0, 0, None, None)))], schema=_BLOCK_TYPES)

        for batch in batches:
            for first, last, data, offsets in words.slices(batch.column("text")):
                rows, hashes, times = terms(data, offsets)
                sizes = np.bincount(rows, times, last - first).astype(np.int64)
                n_docs, n_terms = n_docs + int((sizes > 0).sum()), n_terms + int(sizes.sum())
                new, count = np.unique(hashes[known[_bit(hashes)]], return_counts=True)
                asked, at = np.unique(np.concatenate([asked, new]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([counts, count]), len(asked)).astype(np.int64)
                ids = batch.column("doc_id").slice(first, last - first)
                named = np.asarray(ids.is_valid()) & (sizes > 0)
                ids = np.asarray(ids.fill_null(0), dtype=np.int64)
                steps = np.searchsorted(LEVELS, times, side="right")
                entries = np.bincount(rows, steps, last - first).astype(np.int64)
                room = np.where(named, 16 << np.ceil(np.log2(np.maximum(entries, 16) / 16)).astype(np.int64), 0)
                for one in np.unique(room[room > 0]).tolist():
                    docs = np.flatnonzero(room == one)
                    most = max(min(BLOCK_DOCS, BLOCK_ENTRIES // one), 1)
                    at = 0
                    while at < len(docs):
                        there = filled.setdefault(one, [0])
                        some = docs[at : at + most - there[0]]
                        place = np.full(last - first, -1)
                        place[some] = np.arange(len(some))
                        mine = place[rows] >= 0
                        held.setdefault(one, []).append(
                            (ids[some], sizes[some], place[rows[mine]], hashes[mine], steps[mine]))
                        there[0] += len(some)
                        at += len(some)
                        if there[0] >= most:
                            yield block(one)
        for room in list(held):
            yield block(room)
        yield pa.RecordBatch.from_pylist([dict(zip(_BLOCK_TYPES.names, (
            0, None, None, None, None, n_docs, n_terms, asked.tobytes(), counts.tobytes())))], schema=_BLOCK_TYPES)

    return blocks


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for hashes, counts in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist()):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(hashes, np.int64)), pa.array(np.frombuffer(counts, np.int64))], ["term", "df"])


# --- queries ------------------------------------------------------------------------------------------------------

_QUERY = "q_block long, number binary, terms binary, owners binary, weights binary"


def _query_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries packed: their numbers, all their terms, and for each (query, term) pair, by query, the weight times repeats."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for at in range(0, batch.num_rows, QUERY_ROWS):
            rows = batch.slice(at, QUERY_ROWS).to_pylist()
            lengths = [len(r["terms"]) for r in rows]
            pairs = [t for r in rows for t in r["terms"]]
            every, place = np.unique(np.array([t["term"] for t in pairs], np.int64).view(_U), return_inverse=True)
            yield pa.RecordBatch.from_arrays([
                pa.array([number]), *(pa.array([x.tobytes()], pa.binary()) for x in (
                    np.array([r["number"] for r in rows], np.int64), every, np.repeat(np.arange(len(rows)), lengths) << 32 | place,
                    np.array([t["weight"] for t in pairs], np.int64)))],
                ["q_block", "number", "terms", "owners", "weights"])
            number += 1


class _Queries:
    def __init__(self, row: dict) -> None:
        self.number = np.frombuffer(row["number"], np.int64)
        self.terms = np.frombuffer(row["terms"], _U)
        both = np.frombuffer(row["owners"], np.int64)
        self.owner, self.term = both >> 32, both & 0xFFFFFFFF
        self.weight = np.frombuffer(row["weights"], np.int64)


def _tf_part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _bounds(block: dict, queries: _Queries, n_docs: int, n_terms: int) -> np.ndarray:
    """An upper bound of the score of every query (row) and document (column) of the blocks; exact in doubles."""
    sizes = np.frombuffer(block["sizes"], np.int64)
    slices = np.frombuffer(block["slices"], np.uint8).reshape(block["bits"], -1)
    m = 25 + 75 * sizes * n_docs // n_terms
    out = np.zeros((len(queries.number), len(sizes)))
    there, hashes = np.arange(len(queries.terms)), queries.terms
    parts = np.zeros((len(hashes), len(sizes)))
    held, part_before = None, np.zeros(len(sizes), np.int64)
    for level in range(len(LEVELS) - 1):  # step by step: documents that reach a frequency gain what it can add
        found = np.bitwise_and.reduce(slices[_positions(hashes[there], level, block["bits"])], axis=1)
        held = found if held is None else held & found
        some = held.any(axis=1)
        there, held = there[some], held[some]
        if not len(there):
            break
        part = _tf_part(np.minimum(LEVELS[level + 1] - 1, sizes), m)
        parts[there] += np.unpackbits(held, axis=1)[:, : len(sizes)] * (part - part_before)
        part_before = part
    used = parts.any(axis=1)[queries.term]
    for query, term, weight in zip(*(x[used].tolist() for x in (queries.owner, queries.term, queries.weight))):
        out[query] += parts[term] * weight
    if out.size and out.max() >= 1 << 52:  # sums that doubles may have rounded down
        out *= 1 + 2.0 ** -40
    return out


def _candidates(k: int | None, n_docs: int, n_terms: int):
    """With `k` the documents with the highest bounds of each query in a block, else those that reach the query's line."""
    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):  # a row is a block of each
                row = batch.slice(at, 1).to_pylist()[0]
                queries, ids = _Queries(row), np.frombuffer(row["ids"], np.int64)
                bounds = _bounds(row, queries, n_docs, n_terms)
                if k is not None:
                    line = np.ones(len(bounds))
                    if bounds.shape[1] > k:
                        line = np.maximum(np.partition(bounds, -k, axis=1)[:, -k], 1)
                    q, d = np.nonzero(bounds >= line[:, None])
                    order = np.lexsort((ids[d], -bounds[q, d], q))
                    q, d = q[order], d[order]
                    rank = np.arange(len(q)) - np.searchsorted(q, q)
                    q, d = q[rank < k], d[rank < k]
                else:
                    q, d = np.nonzero(bounds >= np.frombuffer(row["lines"], np.int64)[:, None])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(q), row["q_block"])), pa.array(queries.number[q]), pa.array(ids[d]),
                    pa.array(bounds[q, d].astype(np.int64))], ["q_block", "number", "doc_id", "bound"])

    return candidates


_CANDIDATE = "q_block long, number long, doc_id long, bound long"


# --- exact scores -------------------------------------------------------------------------------------------------

def _counted(term_map: bytes):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The length of each text and its frequencies of terms that a query may have."""
        known = np.unpackbits(np.frombuffer(term_map, np.uint8)).view(bool)
        for batch in batches:
            for first, last, data, offsets in words.slices(batch.column("text")):
                rows, hashes, times = terms(data, offsets)
                sizes = np.bincount(rows, times, last - first).astype(np.int64)
                asked = known[_bit(hashes)]
                hashes, times = hashes[asked], times[asked].astype(np.int64)
                cuts = np.searchsorted(rows[asked], np.arange(last - first + 1))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(first, last - first), pa.array(sizes),
                    *(pa.array([x[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()) for x in (hashes, times))],
                    ["doc_id", "size", "terms", "times"])

    return counted


def _exact(k: int, n_docs: int, n_terms: int):
    names = ["q_block", "number", "doc_id", "score"]

    def exact(documents: pa.Table, queries: pa.Table) -> pa.Table:
        if not documents.num_rows or not queries.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        known = _Queries(queries.slice(0, 1).to_pylist()[0])
        place = {n: i for i, n in enumerate(known.number.tolist())}
        heads = np.searchsorted(known.owner, np.arange(len(known.number)))
        out: list[list] = [[], [], []]
        for row in documents.to_pylist():
            hashes, times = np.frombuffer(row["terms"], _U), np.frombuffer(row["times"], np.int64)
            at = np.searchsorted(known.terms, hashes)
            hit = known.terms[np.minimum(at, len(known.terms) - 1)] == hashes
            m = 25 + 75 * row["size"] * n_docs // n_terms
            parts = np.zeros(len(known.terms), np.int64)
            parts[at[hit]] = _tf_part(times[hit], np.int64(m))
            scores = np.add.reduceat(known.weight * parts[known.term], heads)
            asked = np.array([place[n] for n in row["numbers"]], np.int64)
            asked = asked[scores[asked] > 0]
            out[0].append(asked)
            out[1].append(np.full(len(asked), row["doc_id"]))
            out[2].append(scores[asked])
        query, ids, scores = (np.concatenate(x) for x in out)
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        best = np.arange(len(query)) - np.searchsorted(query, query) < k
        return pa.table({
            "q_block": np.full(int(best.sum()), queries.column("q_block")[0].as_py()), "number": known.number[query[best]],
            "doc_id": ids[best], "score": scores[best]})

    return exact


def top_documents(documents: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str, k: int) -> DataFrame:
    """The query's key, rank (from 1), the document's key and score: the k best documents with a score above 0."""
    narrow = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    asked = written(_query_terms(queries, query_key, query_text), "query-terms")
    term_map = _term_map(asked)  # of fixed size
    blocks = written(narrow.mapInArrow(_blocks(term_map), _BLOCK), "signatures")
    stats = blocks.where("kind = 0")
    n_docs, n_terms = stats.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = n_docs or 0, max(n_terms or 0, 1)
    df = stats.select("terms", "counts").mapInArrow(_document_frequencies, "term long, df long").groupBy("term").agg(
        F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0 * n_docs + 2)) / (2.0 * F.col("df") + 1))).cast("long")
    weighted = asked.join(df, "term").groupBy("_item").agg(
        F.collect_list(F.struct("term", (weight * F.col("times")).alias("weight"))).alias("terms"))  # of one query
    items = written(weighted.withColumn("number", F.monotonically_increasing_id()), "queries")
    packed = written(items.select("number", "terms").mapInArrow(_query_blocks, _QUERY), "query-blocks")
    slices = blocks.where("kind = 1").select("ids", "sizes", "bits", "slices")

    def scored(candidates: DataFrame) -> DataFrame:
        """Exact scores of (query, document) pairs; the best k of each part."""
        parts = written(
            candidates.groupBy("q_block").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("_parts")), "parts")
        rows = candidates.groupBy("q_block", "doc_id").agg(F.collect_set("number").alias("numbers"))  # at most a block of queries
        texts = narrow.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(
            _counted(term_map), "doc_id long, size long, terms binary, times binary")
        left = rows.join(parts, "q_block").join(texts, "doc_id").withColumn(
            "part", F.pmod(F.xxhash64("doc_id"), F.col("_parts")).cast("int"))
        right = packed.join(parts.select(F.col("q_block"), F.col("_parts").alias("_copies")), "q_block").withColumn(
            "part", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
        return left.groupBy("q_block", "part").cogroup(right.groupBy("q_block", "part")).applyInArrow(
            _exact(k, n_docs, n_terms), "q_block long, number long, doc_id long, score long")

    def first(rows: DataFrame, score: str) -> DataFrame:
        order = Window.partitionBy("number").orderBy(F.desc(score), "doc_id")
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    highest = slices.crossJoin(packed).mapInArrow(_candidates(k, n_docs, n_terms), _CANDIDATE)
    seeds = written(first(highest, "bound").select("q_block", "number", "doc_id"), "seeds")
    lines = written(first(scored(seeds), "score").groupBy("number").agg(
        F.when(F.max("rank") == k, F.min("score")).alias("line")), "lines")
    by_block = packed.mapInArrow(_numbers, "q_block long, number long, place int").join(lines, "number", "left").groupBy("q_block").agg(
        F.array_sort(F.collect_list(F.struct("place", F.coalesce("line", F.lit(1)).alias("line")))).alias("lines"))  # QUERY_ROWS at most
    with_lines = packed.join(by_block, "q_block").mapInArrow(_packed_lines, _QUERY + ", lines binary")
    open_pairs = written(slices.crossJoin(written(with_lines, "query-lines")).mapInArrow(
        _candidates(None, n_docs, n_terms), _CANDIDATE).select("q_block", "number", "doc_id"), "open-pairs")
    best = first(scored(open_pairs), "score")
    return best.join(items.select("number", "_item"), "number").select(
        F.col("_item").alias(query_key), F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            number = np.frombuffer(row["number"], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(number), row["q_block"])), pa.array(number), pa.array(np.arange(len(number), dtype=np.int32))],
                ["q_block", "number", "place"])


def _packed_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = [np.array([x["line"] for x in row], np.int64).tobytes() for row in batch.column("lines").to_pylist()]
        rest = batch.drop_columns(["lines"])
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(lines, pa.binary())], [*rest.schema.names, "lines"])
