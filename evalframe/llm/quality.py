"""Quality selection by importance resampling of hashed n-grams.

Two generative models over hashed one- and two-token n-grams are counted: a raw one from all documents and a target one
from labelled good documents. A document's log weight is the sum, over its n-grams, of the log ratio of the two models;
n-grams whose counts do not differ by more than chance weigh nothing. N-grams are counted in the buckets of two tables, and the
weaker weight counts, so that a rare one seldom pays for what it shares a bucket with. Gumbel noise, seeded by the document id, is added to
the weights, and the k documents with the highest sums are the sample: sampling without replacement in proportion to a
power of the weights. k is the number of documents whose weight reaches the threshold that tells held-out labelled
documents apart best.

The counts are vectors of fixed size and cover all documents; at most `sample` good and as many other labelled documents
are used, the ones with the lowest hashes. Four fifths of the good ones fit the target model, the rest and the others
place the threshold.

Nulls: a null or empty text has weight 0; a null document id has the noise of 0; labels with nulls are not used. Repeated
rows are judged alike, so all of them stay or go, also beyond k. Without any usable label every document is kept. An empty
table gives an empty result. Other columns are passed on unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evalframe.llm import words
from evalframe.llm.shared import written

BITS = 20
BUCKETS = 1 << BITS  # of each of two tables
PARTS = 64
REACH = 4
STEM, OFTEN = 6, 3  # bytes of a word's beginning, and the times that a row has to use it for an n-gram
SAMPLE = 20_000  # labelled rows that fit the target model and place the threshold, at most, of each kind
PSEUDO = 1.0
CHANCE = 3.5  # standard deviations
TEMPERATURE = 0.1
BINS = 4096

_U = np.uint64
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = _IS_WORD[128:] = True


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of each row as buckets of two independent tables, one row for each table, and the rows.

    Tokens are runs of word bytes or of marks. Besides one and two successive tokens there are the first STEM bytes of words
    where a row uses them OFTEN times or more, and n-grams of equality alone: how large a share of a row's tokens repeats the
    one 1 to REACH tokens before, in eighths.
    """
    kind = np.where(words._IS_SPACE[data], 0, np.where(_IS_WORD[data], 1, 2)).astype(np.int8)
    change = np.ones(len(kind) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[offsets] = True
    edges = np.flatnonzero(change)
    starts, stops = edges[:-1], edges[1:]
    there = kind[starts] > 0 if len(starts) else np.zeros(0, bool)
    starts, stops = starts[there], stops[there]
    rows = np.searchsorted(offsets, starts, side="right") - 1
    ones = words.hash_spans(words.lower(data), starts, stops)
    same = rows[1:] == rows[:-1]
    found = [ones, words.mix(ones[:-1] * np.uint64(0x9E3779B97F4A7C15) + ones[1:])[same]]
    owners = [rows, rows[1:][same]]
    count = len(offsets) - 1
    tokens = np.bincount(rows, minlength=count)
    filled = np.flatnonzero(tokens)
    for back in range(1, REACH + 1):
        again = (ones[back:] == ones[:-back]) & (rows[back:] == rows[:-back])
        share = np.bincount(rows[back:][again], minlength=count)[filled] * 8 // tokens[filled]
        found.append(words.mix(share.astype(np.uint64) + np.uint64(1000 * back)))
        owners.append(filled)
    both = _U(2 * BITS)
    pack = lambda rows, hashes: np.sort((rows.astype(_U) << both) | (hashes >> (_U(64) - both)))
    # beginnings of words that a row uses often, whatever the words
    long = (kind[starts] == 1) & (stops - starts >= STEM)
    stems = pack(rows[long], words.hash_spans(words.lower(data), starts[long], starts[long] + STEM))
    heads = np.flatnonzero(np.append(True, stems[1:] != stems[:-1])) if len(stems) else np.zeros(0, np.int64)
    often = stems[heads[np.diff(np.append(heads, len(stems))) >= OFTEN]]
    found.append(words.mix((often & ((_U(1) << both) - _U(1))) + _U(7)))
    owners.append((often >> both).astype(np.int64))
    # distinct within the row: a document says once what a word in it says
    pairs = pack(np.concatenate(owners), np.concatenate(found))
    pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])] if len(pairs) else pairs
    one = pairs & _U(BUCKETS - 1)
    two = (pairs >> _U(BITS)) & _U(BUCKETS - 1)
    return np.stack([one, two + _U(BUCKETS)]).astype(np.int64), (pairs >> both).astype(np.int64)


def _counting(buckets: int = 2 * BUCKETS):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, rows_seen = np.zeros((2, buckets), np.int32), [0, 0]
        for batch in batches:
            target = np.asarray(batch.column("target").fill_null(False), dtype=bool)
            for first, last, data, offsets in words.slices(batch.column("text")):
                found, rows = ngrams(data, offsets)
                sums[0] += np.bincount(found.reshape(-1), minlength=buckets).astype(np.int32)
                sums[1] += np.bincount(found[:, target[first:last][rows]].reshape(-1), minlength=buckets).astype(np.int32)
            rows_seen[0] += batch.num_rows
            rows_seen[1] += int(target.sum())
        if rows_seen[0]:
            parts = sums.reshape(2, PARTS, -1)
            yield pa.RecordBatch.from_arrays([
                pa.array(range(PARTS), pa.int32()), *(pa.array([p.tobytes() for p in parts[i]], pa.binary()) for i in (0, 1)),
                *(pa.array([n] + [0] * (PARTS - 1), pa.int64()) for n in rows_seen),
            ], ["part", "raw", "target", "rows", "targets"])

    return count


_COUNTS = "part int, raw binary, target binary, rows long, targets long"


def _summed(group: pa.Table) -> pa.Table:
    def total(name: str) -> bytes:
        return sum(np.frombuffer(b, np.int32).astype(np.int64) for b in group.column(name).to_pylist()).tobytes()

    return pa.table({"part": group.column("part").slice(0, 1), "raw": [total("raw")], "target": [total("target")],
                     "rows": [sum(group.column("rows").to_pylist())], "targets": [sum(group.column("targets").to_pylist())]})


def log_ratios(raw: np.ndarray, target: np.ndarray, share: float) -> np.ndarray:
    """The weight of each bucket, from the numbers of raw and target documents that have it.

    Raw text is target text and some other, so the ratio of the models cannot lie above its value for n-grams that occur
    in target text alone; above 1 it is chance. Within chance of the expected count the weight is 0, too.
    """
    expected = raw * share
    ratio = np.log((target + PSEUDO) / (expected + PSEUDO))
    fewer = expected - target > CHANCE * np.sqrt(expected * (1 - share) + 0.25)
    return np.where(fewer, np.minimum(ratio, 0.0), 0.0).astype(np.float32)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    cutoff: tuple[float, int] | None  # the last place of the sample; None keeps everything
    places: DataFrame | None = None  # key, log_weight and place of every row that the model was fitted on

    def draw(self, k: int) -> DataFrame:
        """k of the rows without replacement (all, if fewer), by weight and noise; ties by key. Rows of equal weight, as all
        that hold nothing against them, are drawn alike, so below that number the noise alone decides."""
        last = last_place(self.places, k)
        return self.places if last is None else Model(self.weights, last, self.places).sample()

    def sample(self) -> DataFrame:
        """The places that are in the sample."""
        if self.cutoff is None:
            return self.places
        last, key = self.cutoff
        return self.places.where(
            (F.col("place") > last) | ((F.col("place") == last) & (F.coalesce("key", F.lit(0)) <= key)))


def _noise(keys: np.ndarray, seed: int) -> np.ndarray:
    u = (words.mix(keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) >> np.uint64(11)) + np.uint64(1)
    return -np.log(-np.log(u.astype(np.float64) / float((1 << 53) + 2)))


def _scores(batch: pa.RecordBatch, key: str, text: str, weights: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.zeros(0)]
    for first, last, data, offsets in words.slices(batch.column(text)):
        found, rows = ngrams(data, offsets)
        parts.append(np.bincount(rows, weights[found].max(axis=0), minlength=last - first))
    weight = np.round(np.concatenate(parts), 6) + 0.0
    keys = np.asarray(batch.column(key).cast(pa.int64()).fill_null(0), dtype=np.int64)
    return weight, weight + TEMPERATURE * _noise(keys, seed)


def scored(documents: DataFrame, key: str, text: str, weights: np.ndarray, seed: int = 0) -> DataFrame:
    """key, log_weight, place: the weight, and the weight with noise."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight, place = _scores(batch, key, text, weights, seed)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).cast(pa.int64()), pa.array(weight), pa.array(place)], ["key", "log_weight", "place"])

    narrow = documents.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))
    return narrow.mapInArrow(score, "key long, log_weight double, place double")


def kept(documents: DataFrame, key: str, text: str, model: Model, seed: int = 0) -> DataFrame:
    """The sample, all columns as they came: every row is judged by itself, nothing is joined or shuffled."""
    if model.cutoff is None:
        return documents
    weights, (last, last_key) = model.weights, model.cutoff

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, place = _scores(batch, key, text, weights, seed)
            keys = np.asarray(batch.column(key).cast(pa.int64()).fill_null(0), dtype=np.int64)
            yield batch.filter(pa.array((place > last) | ((place == last) & (keys <= last_key))))

    return documents.mapInArrow(keep, documents.schema)


def threshold(held_out: DataFrame, step: float = 0.25) -> float | None:
    """The weight that tells the rows of `held_out` (log_weight, good) apart with the least sum of both error rates.

    The levels are those that occur, however low: not more than there are held-out rows, which SAMPLE bounds.
    """
    level = F.floor(F.col("log_weight") / step).cast("long").alias("level")
    rows = held_out.groupBy(level).agg(
        F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).orderBy("level").collect()
    good, bad = np.array([r["good"] for r in rows], float), np.array([r["bad"] for r in rows], float)
    if not good.sum() or not bad.sum():
        return None
    lost, stays = np.cumsum(good) / good.sum(), np.cumsum(bad[::-1])[::-1] / bad.sum()
    errors = np.round(np.concatenate([[0], lost]) + np.concatenate([stays, [0]]), 9)
    best = int(np.argmin(errors))  # of equal ones the lowest, which loses the fewest good rows
    if best in (0, len(rows)):
        return (rows[0]["level"] if best == 0 else rows[-1]["level"] + 1) * step
    return (rows[best - 1]["level"] + 1 + rows[best]["level"]) / 2 * step  # in the middle of the gap


def last_place(places: DataFrame, k: int) -> tuple[float, int] | None:
    """place and key of the k-th row by falling place, then rising key; by histograms, so that no task sorts all rows."""
    if k <= 0:
        return float("inf"), 0
    low, high = places.agg(F.min("place"), F.max("place")).first()
    if low is None:
        return None
    left = k
    inside = places
    for _ in range(6):
        if high <= low:
            break
        width = (high - low) / BINS
        level = F.least(F.floor((F.col("place") - low) / width), F.lit(BINS - 1)).cast("int")
        counts = inside.groupBy(level.alias("level")).agg(
            F.count("*").alias("n"), F.min("place").alias("low"), F.max("place").alias("high")).orderBy(F.desc("level")).collect()
        for row in counts:
            if left <= row["n"]:
                low, high = row["low"], row["high"]
                break
            left -= row["n"]
        else:
            return None
        inside = places.where((F.col("place") >= low) & (F.col("place") <= high))
        if row["n"] <= BINS:
            break
    keys = F.coalesce("key", F.lit(0).cast("long")).alias("key")
    last = inside.select("place", keys).orderBy(F.desc("place"), "key").limit(left).agg(
        F.min(F.struct("place", (-F.col("key")).alias("minus")))).first()[0]
    return last["place"], -last["minus"]


def fit(documents: DataFrame, labels: DataFrame, key: str, text: str, good: str, sample: int = SAMPLE, seed: int = 0) -> Model:
    """Count both models, place the threshold and find the last place of the sample. `good` is a condition on labels."""
    usable = labels.select(F.col(key).cast("long").alias("_key"), F.expr(good).alias("good")).where(
        "_key IS NOT NULL AND good IS NOT NULL").groupBy("_key").agg(F.min("good").alias("good"))
    order = F.xxhash64("_key", F.lit(seed))
    chosen = written(usable.where("good").orderBy(order).limit(sample).unionByName(
        usable.where("NOT good").orderBy(order).limit(sample)), "labelled")
    held_out = F.pmod(F.xxhash64("_key", F.lit(seed + 1)), F.lit(5)) == 0
    fitting = chosen.where("good").where(~held_out).select("_key", F.lit(True).alias("target"))
    narrow = documents.select(F.col(key).cast("long").alias("_key"), F.col(text).cast("string").alias("text"))
    marked = narrow.join(F.broadcast(fitting), "_key", "left")  # at most `sample` rows
    counts = marked.select("text", "target").mapInArrow(_counting(), _COUNTS)
    sums = counts.groupBy("part").applyInArrow(_summed, _COUNTS).orderBy("part").collect()  # of fixed size
    if not sums or not sums[0]["targets"]:
        weights = np.zeros(2 * BUCKETS, np.float32)
        return Model(weights, None, written(scored(documents, key, text, weights, seed), "places"))
    raw, target = (np.concatenate([np.frombuffer(r[name], np.int64) for r in sums]) for name in ("raw", "target"))
    weights = log_ratios(raw, target, sums[0]["targets"] / sums[0]["rows"])
    places = written(scored(documents, key, text, weights, seed), "places")
    tested = places.join(F.broadcast(chosen.where(~F.col("good") | held_out)), places["key"] == F.col("_key"))
    line = threshold(tested)
    cutoff = None if line is None else last_place(places, places.where(F.col("log_weight") >= line).count())
    return Model(weights, cutoff, places)
