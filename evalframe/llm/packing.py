"""Packing by cutting stock: patterns from a linear program over the histogram of piece lengths, dealt to ranked pieces.

Documents are cut into whole sequences and one rest. Lengths are rounded up to a grid, so the histogram has a fixed number
of classes however many documents there are. Column generation solves the covering program over it: the duals of the
current basis price classes, a knapsack over the grid finds the pattern that is worth most, and it enters the basis until
no pattern is worth more than a sequence. The solution is rounded down; what is left over (at most a pattern for each
class) is filled first-fit, longest first. Pieces are ranked in their class and every rank looks up its sequence in the
plan. Only the histogram and the plan, both of fixed size, pass the driver; ids never leave the task that made them.

Nulls: a null text has only its end id, a null document id is kept. Repeated rows are documents of their own. An empty
table gives no pieces. Other input columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from evalframe.llm import words
from evalframe.llm.shared import written
from evalframe.llm.tokens import encoder

GRID = 4
ROUNDS = 1000  # patterns that may enter the basis; further ones would only save padding
REFRESH = 50  # rounds after which the basis is inverted anew
BUCKETS = 256  # pieces of a class that are ranked on their own

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _cutting(tokenizer: str, end: int, size: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            texts, keys = batch.column("text"), batch.column("doc_id").to_pylist()
            for first, last, _, _ in words.slices(texts):
                rows = []
                for key, packed in zip(keys[first:last], encode.encode(texts.slice(first, last - first).to_pylist())):
                    packed += int(end).to_bytes(4, "little")
                    count = len(packed) // 4
                    for start in range(0, count, size):
                        piece = packed[4 * start : 4 * (start + size)]
                        rows.append((key, start, len(piece) // 4, zlib.crc32(piece), count))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, pa.int64()) for column in zip(*rows)],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return cut


def pieces(documents: DataFrame, key: str, text: str, tokenizer: str, end: int, size: int) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece of at most `size` ids, the end id included."""
    narrow = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(_cutting(tokenizer, end, size), _PIECES)


def _knapsack(values: np.ndarray, weights: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of items that fits into `room`, and how often it takes each."""
    best, taken = np.zeros(room + 1), np.full(room + 1, -1)
    for at in range(1, room + 1):
        best[at] = best[at - 1]
        fits = np.searchsorted(weights, at, side="right")
        if fits:
            options = best[at - weights[:fits]] + values[:fits]
            top = int(np.argmax(options))
            if options[top] > best[at] + 1e-12:
                best[at], taken[at] = options[top], top
    counts, at = np.zeros(len(values), np.int64), room
    while at > 0:
        if taken[at] < 0:
            at -= 1
        else:
            counts[taken[at]] += 1
            at -= weights[taken[at]]
    return float(best[room]), counts


def _first_fit(demand: np.ndarray, classes: np.ndarray, room: int) -> list[tuple[np.ndarray, int, np.ndarray]]:
    """Patterns filled longest first, each used while all of it is in demand; with the classes that it exhausts."""
    left, out = demand.copy(), []
    while left.any():
        pattern, free = np.zeros(len(classes), np.int64), room
        for i in range(len(classes) - 1, -1, -1):
            pattern[i] = min(left[i], free // classes[i])
            free -= pattern[i] * classes[i]
        often = int((left[pattern > 0] // pattern[pattern > 0]).min())
        before, left = left, left - often * pattern
        out.append((pattern, often, np.flatnonzero((before > 0) & (left == 0))))
    return out


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """A product without a threaded library, whose threads would wait for each other on a busy driver."""
    return (matrix * vector).sum(axis=1)


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """By elimination, rows exchanged for the largest pivot."""
    size = len(matrix)
    work = np.concatenate([matrix.astype(np.float64), np.eye(size)], axis=1)
    for i in range(size):
        top = i + int(np.argmax(np.abs(work[i:, i])))
        if top != i:
            work[[i, top]] = work[[top, i]]
        work[i] /= work[i, i]
        factor = work[:, i].copy()
        factor[i] = 0.0
        work -= factor[:, None] * work[i]
    return work[:, size:]


def plan(histogram: dict[int, int], room: int, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """(pattern, times): patterns of classes (class c takes c units of `room`) that cover the histogram exactly."""
    classes = np.array(sorted(c for c, n in histogram.items() if n), np.int64)
    if not len(classes):
        return []
    demand = np.array([histogram[int(c)] for c in classes], np.int64)
    # the first basis: a pattern that exhausts a class stands for it, a pattern of the class alone for any other
    columns, amounts = np.diag(room // classes), np.zeros(len(classes))
    for pattern, often, exhausted in _first_fit(demand, classes, room):
        if len(exhausted):
            columns[:, exhausted[0]], amounts[exhausted[0]] = pattern, often
    inverse = _inverse(columns)
    amounts = _times(inverse, demand)
    for turn in range(1, rounds + 1):
        worth, entering = _knapsack(inverse.sum(axis=0), classes, room)
        if worth <= 1 + 1e-7:
            break
        change = _times(inverse, entering)
        usable = change > 1e-7
        ratios = np.full(len(classes), np.inf)
        ratios[usable] = np.maximum(amounts[usable], 0) / change[usable]
        leaving = int(np.argmin(ratios))
        columns[:, leaving] = entering
        if turn % REFRESH:
            row = inverse[leaving] / change[leaving]
            inverse = inverse - change[:, None] * row
            inverse[leaving] = row
        else:  # the updates lose digits
            inverse = _inverse(columns)
        amounts = _times(inverse, demand)
    times = np.floor(np.maximum(_times(_inverse(columns), demand), 0) + 1e-6).astype(np.int64)
    left = demand - columns @ times
    for i in np.flatnonzero(left < 0):  # a pattern too many by the doubles
        for p in np.flatnonzero(columns[i] > 0):
            fewer = min(times[p], max(0, -(left[i] // columns[i, p])))
            times[p] -= fewer
            left = left + fewer * columns[:, p]
    chosen = [(columns[:, p], int(times[p])) for p in range(len(classes)) if times[p]]
    chosen += [(pattern, often) for pattern, often, _ in _first_fit(left, classes, room)]
    return [({int(c): int(n) for c, n in zip(classes, pattern) if n}, often) for pattern, often in chosen]


def packed(cut: DataFrame, size: int, grid: int = GRID) -> DataFrame:
    """The pieces (a written table) with sequence_id and offset."""
    spark = cut.sparkSession
    classed = cut.withColumn("_class", F.ceil(F.col("length") / grid).cast("int")).withColumn(
        "_bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(BUCKETS)).cast("int"))
    cells = written(classed.groupBy("_class", "_bucket").agg(F.count("*").alias("_n")), "piece-classes")
    histogram = {r["_class"]: r["n"] for r in cells.groupBy("_class").agg(F.sum("_n").alias("n")).collect()}
    slots, sequence, filled = [], 0, {}
    for pattern, times in plan(histogram, size // grid):
        for c, copies in pattern.items():
            begin = filled.get(c, 0)
            slots.append((c, begin, begin + copies * times, copies, sequence))
            filled[c] = begin + copies * times
        sequence += times
    lookup = spark.createDataFrame(
        slots, "_class int, _from long, _to long, _copies long, _sequence long").groupBy("_class").agg(
        F.sort_array(F.collect_list(F.struct("_from", "_copies", "_sequence"))).alias("_slots"))
    before = Window.partitionBy("_class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy("_class", "_bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = classed.withColumn("_place", F.row_number().over(within) - 1).join(offsets, ["_class", "_bucket"]).join(
        lookup, "_class").withColumn("_rank", F.col("_before") + F.col("_place"))
    slot = ranked.withColumn("_slot", F.element_at(F.filter("_slots", lambda s: s["_from"] <= F.col("_rank")), -1))
    placed = slot.withColumn("sequence_id", (F.col("_slot._sequence") + F.floor(
        (F.col("_rank") - F.col("_slot._from")) / F.col("_slot._copies"))).cast("long"))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "_rank").rowsBetween(
        Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long")).select(
        *cut.columns, "sequence_id", "offset")
