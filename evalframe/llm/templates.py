"""Benchmark decontamination by templates.

Texts become template tokens: words without marks at their ends, in lower case, with typed placeholders for numbers, names
and units. A number starts with a digit; a unit is a known unit word after a number; a name is a capitalised word that
does not open a sentence. Windows of template tokens are hashed, and a document's windows are joined to the benchmark's by
hash. The template of a window in which most tokens are placeholders says nothing: such a window is hashed with the values
in its slots and matches as exact text.

Matched windows are aligned by the distance of their positions. In an alignment a slot value of the item stands for one
value of the document throughout; then the item may have been re-parameterised, and if all values are equal it was copied.
Where it stands for several, the windows that hold one of these other values are dropped; windows in which it stands for
itself are text of the item and stay, as do all without it. A document holds an item when the windows left cover at least
`coverage` of the item's windows, or of its windows that match as templates (of a re-parameterised item no others can), or
when one of them holds `run` successive tokens of the item, whatever share of a long item that is.

A bit map of all benchmark hashes, of fixed size, keeps document windows that can match nothing out of the join. Documents
and items without words, and rows with a null text or id, match nothing; an item shorter than a window is one window of
its own length. With `inside`, document windows are cut at the lengths of the short items too, so that these are found
anywhere in a document; without it they match documents of exactly these tokens only. Repeated rows match once. Empty tables
give no rows. Other input columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from evalframe.llm import words
from evalframe.llm.shared import written

WIDTH = 8
COVERAGE = 0.5
RUN = 32  # tokens, four windows end to end
BITS = 1 << 23
PARTS = 64

# Unit words.
UNITS = """% $ € £ mm cm m km in inch inches ft foot feet yard yards mile miles g mg kg gram grams kilogram kilograms pound pounds
lb lbs oz ounce ounces ton tons l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr
hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent mph kmh degree degrees
hz khz mhz ghz w kw watt watts v volt volts j joule joules n newton newtons b kb mb gb tb byte bytes bit bits""".split()

_U = np.uint64
_IS_ALNUM = np.zeros(256, dtype=bool)
_IS_ALNUM[48:58] = _IS_ALNUM[65:91] = _IS_ALNUM[97:123] = _IS_ALNUM[128:] = True
_ENDS = np.zeros(256, dtype=bool)
_ENDS[list(b".!?:;\n")] = True
_NUMBER, _NAME, _UNIT = (_U(x) for x in (0x6E756D, 0x6E616D65, 0x756E6974))


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    starts, stops, _ = words.split(data, np.array([0, len(data)]))
    return np.sort(words.hash_spans(data, starts, stops))


def _lowered(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes in lower case, also the two-byte Latin letters, and which bytes end a capital letter."""
    upper = (data >= 65) & (data <= 90)
    wide = np.zeros(len(data), bool)
    wide[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    upper |= wide
    return data + np.uint8(32) * upper, upper


def template_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template hash, value hash, slot flag and row of every token."""
    starts, stops, rows = words.split(data, offsets)
    solid = np.flatnonzero(_IS_ALNUM[data])
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, stops)
    there = a < b
    ends_before = np.ones(len(starts), bool)
    ends_before[1:] = (rows[1:] != rows[:-1]) | _ENDS[data[stops[:-1] - 1]] | (data[starts[1:] - 1] == 10)
    starts, stops, rows, opens = solid[a[there]], solid[b[there] - 1] + 1, rows[there], ends_before[there]
    if not len(starts):
        empty = np.zeros(0, _U)
        return empty, empty, np.zeros(0, bool), np.zeros(0, np.int64)
    small, upper = _lowered(data)
    value = words.hash_spans(small, starts, stops)
    head = data[starts]
    number = (head >= 48) & (head <= 57)
    # a capital and then a small letter: words in capitals throughout are no names
    wide = head == 0xC3
    first = starts + wide
    second = np.minimum(first + 1, len(data) - 1)
    second = np.minimum(second + (data[second] == 0xC3), len(data) - 1)
    letter = ((data[second] >= 97) & (data[second] <= 122)) | (data[second] >= 128)
    name = upper[first] & letter & ~upper[second] & (first + 1 < stops) & ~opens
    after = np.zeros(len(starts), bool)
    after[1:] = number[:-1] & (rows[1:] == rows[:-1])
    unit = after & ~number & np.isin(value, _unit_hashes())
    name &= ~unit
    token = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, value)))
    return token, value, number | unit | name, rows


def _short(token: np.ndarray, per_row: np.ndarray, heads: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """hash, row and position of all windows of `length` tokens in longer rows; hashed like rows of that many tokens."""
    count = np.where(per_row > length, per_row - length + 1, 0)
    owners = np.repeat(np.arange(len(per_row)), count)
    position = np.arange(len(owners)) - (np.cumsum(count) - count)[owners]
    hashes = np.zeros(len(owners), _U)
    for k in range(length):
        hashes = words.mix(hashes * _U(0xD1342543DE82EF95) + token[heads[owners] + position + k] + _U(k + 1))
    return hashes, owners, position


def windows(data: np.ndarray, offsets: np.ndarray, width: int, lengths: Sequence[int] = ()) -> tuple[np.ndarray, ...]:
    """hash, row, position, first token, length and whether mostly literal of every window; and the tokens' values and slots."""
    count = len(offsets) - 1
    token, value, slot, rows = template_tokens(data, offsets)
    per_row = np.bincount(rows, minlength=count)
    heads = np.concatenate([[0], np.cumsum(per_row)])[:-1]
    hashes, owners = words.shingles(token, rows, count, width)
    windows_per_row = np.where(per_row >= width, per_row - width + 1, (per_row > 0).astype(np.int64))
    position = np.arange(len(owners)) - (np.cumsum(windows_per_row) - windows_per_row)[owners]
    length = np.minimum(per_row[owners], width)
    for shorter in lengths:
        more = _short(token, per_row, heads, shorter)
        hashes, owners, position = (np.concatenate(x) for x in zip((hashes, owners, position), more))
        length = np.concatenate([length, np.full(len(more[0]), shorter, length.dtype)])
    first = heads[owners] + position
    slots = np.concatenate([[0], np.cumsum(slot)])
    literal = 2 * (slots[first + length] - slots[first]) <= length
    exact = np.flatnonzero(~literal)
    for k in range(width):
        at = exact[(k < length[exact])]
        at = at[slot[first[at] + k]]
        hashes[at] = words.mix(hashes[at] * _U(0x9E3779B97F4A7C15) + value[first[at] + k])
    return hashes, owners, position, first, length, literal, value, slot


def _bit(hashes: np.ndarray) -> np.ndarray:
    return (hashes % _U(BITS)).astype(np.int64)


def _windowed(width: int, bitmap: bytes | None, lengths: Sequence[int]):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if bitmap is None else np.unpackbits(np.frombuffer(bitmap, np.uint8)).view(bool)
        for batch in batches:
            ids = batch.column("id")
            for one, last, data, offsets in words.slices(batch.column("text")):
                hashes, rows, position, first, length, literal, value, slot = windows(data, offsets, width, lengths)
                keep = np.ones(len(hashes), bool) if known is None else known[_bit(hashes)]
                hashes, rows, position, first, length, literal = (
                    x[keep] for x in (hashes, rows, position, first, length, literal))
                inside = first[:, None] + np.arange(width)
                taken = (np.arange(width) < length[:, None]) & slot[np.minimum(inside, max(len(slot) - 1, 0))] if len(first) else np.zeros((0, width), bool)
                bounds = np.concatenate([[0], np.cumsum(taken.sum(axis=1))]).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(bounds), pa.array(value[inside[taken]].view(np.int64)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(hashes.view(np.int64)), ids.slice(one, last - one).take(pa.array(rows)), pa.array(position), values,
                    pa.array(literal), pa.array(length),
                ], ["hash", "id", "position", "slots", "literal", "length"])

    return cut


_WINDOW = "hash long, id long, position long, slots array<long>, literal boolean, length long"


def _marking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(BITS, bool)
    for batch in batches:
        bits[_bit(np.asarray(batch.column("hash"), dtype=np.int64).view(_U))] = True
    if bits.any():
        parts = np.packbits(bits).reshape(PARTS, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(PARTS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "bits"])


def _merged(group: pa.Table) -> pa.Table:
    bits = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in group.column("bits").to_pylist()])
    return pa.table({"part": group.column("part").slice(0, 1), "bits": [bits.tobytes()]})


def template_windows(
    rows: DataFrame, key: str, text: str, width: int = WIDTH, bitmap: bytes | None = None, lengths: Sequence[int] = (),
) -> DataFrame:
    """hash, id, position, slots (hashes of the values in the window's slots, in order), literal (most tokens are), length."""
    narrow = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(_windowed(width, bitmap, lengths), _WINDOW)


def contaminated(
    documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, width: int = WIDTH,
    coverage: float = COVERAGE, run: int = RUN, inside: bool = False,
) -> DataFrame:
    """doc_id, item_id, n_windows (of the item), n_matched, copied (all slots equal): a row for each item that a document holds."""
    asked = written(template_windows(items, item_key, item_text, width).distinct(), "item-windows")
    marks = asked.mapInArrow(_marking, "part int, bits binary").groupBy("part").applyInArrow(
        _merged, "part int, bits binary").orderBy("part").collect()  # of fixed size
    bitmap = b"".join(bytes(r["bits"]) for r in marks) if marks else bytes(BITS // 8)
    sizes = asked.groupBy(F.col("id").alias("item_id")).agg(
        F.countDistinct("position").alias("n_windows"),
        F.countDistinct(F.when(F.col("literal"), F.col("position"))).alias("n_literal"))
    short = asked.where(F.col("length") < width).select("length").distinct().collect() if inside else []  # width - 1 at most
    own = template_windows(documents, key, text, width, bitmap, sorted(r["length"] for r in short)).select(
        "hash", F.col("id").alias("doc_id"), F.col("position").alias("_at"), F.col("slots").alias("_own"))
    met = own.join(asked.select("hash", F.col("id").alias("item_id"), "position", "slots", "literal"), "hash").where(
        F.size("slots") == F.size("_own")).withColumn("_shift", F.col("_at") - F.col("position"))
    met = written(met.select("doc_id", "item_id", "_shift", "position", "literal", F.arrays_zip("slots", "_own").alias("pairs")), "met-windows")
    # in an alignment each slot value of the item stands for one value of the document
    alignment = ["doc_id", "item_id", "_shift"]
    values = met.select(*alignment, F.explode("pairs").alias("p")).groupBy(*alignment, F.col("p.slots").alias("value")).agg(
        F.min("p._own").alias("low"), F.max("p._own").alias("high"))
    checked = values.groupBy(*alignment).agg(
        F.array_agg(F.when(F.col("low") != F.col("high"), F.col("value"))).alias("torn"),
        F.bool_and((F.col("low") == F.col("value")) & (F.col("high") == F.col("value"))).alias("equal"))
    contradicted = F.exists("pairs", lambda p: (p["slots"] != p["_own"]) & F.array_contains(F.col("torn"), p["slots"]))
    sound = met.join(checked, alignment, "left").where(~F.coalesce(contradicted, F.lit(False)))
    held = sound.groupBy("doc_id", "item_id").agg(
        F.countDistinct("position").alias("n_matched"),
        F.countDistinct(F.when(F.col("literal"), F.col("position"))).alias("_literal"), F.bool_and(F.coalesce("equal", F.lit(True))).alias("copied"))
    # the longest run of successive windows in one alignment

    def step(state: Column, position: Column) -> Column:
        now = F.when(position == state["last"] + 1, state["now"] + 1).otherwise(F.lit(1))
        return F.struct(position.alias("last"), now.alias("now"), F.greatest(state["best"], now).alias("best"))

    begin = F.struct(F.lit(-2).cast("long").alias("last"), F.lit(0).alias("now"), F.lit(0).alias("best"))
    runs = sound.groupBy(*alignment).agg(
        F.aggregate(F.sort_array(F.collect_set("position")), begin, step, lambda state: state["best"]).alias("_run")).groupBy(
        "doc_id", "item_id").agg(F.max("_run").alias("_run"))
    held = held.join(runs, ["doc_id", "item_id"])
    enough = (F.col("n_matched") >= F.col("n_windows") * coverage) | (
        (F.col("n_literal") > 0) & (F.col("_literal") >= F.col("n_literal") * coverage)) | (
        F.col("_run") >= max(run - width + 1, 1)) & (F.col("n_windows") > 1)
    return held.join(sizes, "item_id").where(enough).select(
        "doc_id", "item_id", "n_windows", "n_matched", "copied")
