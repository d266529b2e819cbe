"""SimHash near duplicates by BK-trees.

A fingerprint has 64 bits. Every `width` successive words of a text (repeats included; a shorter text gives one shingle of
all its words) are hashed by XXH64 with seed 42 over their UTF-8 bytes, joined by single spaces; a bit is set when more
than half of the hashes have it. A text without words has the fingerprint zero, which links like any other. Fingerprints
link when they differ in at most RADIUS bits.

Equal fingerprints are one from the start, so only different ones are searched. They are dealt to buckets: of RADIUS + 1
groups of bits two linked fingerprints have at least one alike, so every fingerprint goes to as many buckets and no link is
lost. A bucket of more than LEAF fingerprints is dealt again, by groups of its remaining bits, up to DEPTH times; one that is still
larger (all its members agree in most bits) is cut into shards, and each pair of shards is a bucket. A bucket's fingerprints
form a BK-tree: a child hangs at the integer Hamming distance to its parent, and a search follows only the edges whose
distance lies within RADIUS of the searched one's. A task builds and searches the trees of many buckets together, level by
level in numpy. Trees meet what is searched in them by a shuffle; a broadcast would need a bound on their number.

A bucket passes on one pair for each fingerprint (with the smallest that it reaches there), so hot groups cost no pairs. A
subtree that lies wholly in the searched fingerprint's component is left as well.

Every row is a node. Rows of one id with unlike texts are not linked by their id. Null and empty texts have no words. A row
with a null id has a fingerprint and links; the component is the smallest id in it that is not null, null if there is none.
An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evalframe.llm import words
from evalframe.llm.graph import components, forest
from evalframe.llm.shared import written
from evalframe.operators.scale import heavy_join

SEED = 42
RADIUS = 4
LEAF = 8192  # fingerprints in a bucket, after which it is dealt again
DEPTH = 3  # times that a bucket is dealt
TOGETHER = 100_000  # fingerprints in the trees that a task holds at once, and one bucket more at most
STEPS = 2_000_000  # searched fingerprints times the size of their buckets, in one go

_U = np.uint64


# --- fingerprints -------------------------------------------------------------------------------------------------

def _joined(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all rows with one blank after each, where each begins and ends there, and its row."""
    starts, stops, rows = words.split(data, offsets)
    lengths = stops - starts
    begins = np.zeros(len(starts), np.int64)
    np.cumsum(lengths[:-1] + 1, out=begins[1:])
    total = int(lengths.sum())
    source = np.arange(total, dtype=np.int64)
    shift = np.cumsum(lengths) - lengths
    out = np.full(total + len(starts), 32, np.uint8)
    out[source + np.repeat(begins - shift, lengths)] = words.lower(data[source + np.repeat(starts - shift, lengths)])
    return out.tobytes(), begins, begins + lengths, rows


def _shingle_spans(begins: np.ndarray, ends: np.ndarray, rows: np.ndarray, count: int, width: int):
    """Begin, end and row of every shingle, in order of the rows."""
    per_row = np.bincount(rows, minlength=count)
    first = np.cumsum(per_row) - per_row
    shingles = np.where(per_row >= width, per_row - width + 1, np.minimum(per_row, 1))
    owners = np.repeat(np.arange(count), shingles)
    at = np.arange(len(owners)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + first[owners]
    return begins[at], ends[at + np.minimum(per_row, width)[owners] - 1], owners


def text_fingerprints(data: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """The fingerprint of every row as an unsigned 64-bit integer."""
    from xxhash import xxh64_intdigest

    count = len(offsets) - 1
    out = np.zeros(count, _U)
    joined, begins, ends, rows = _joined(data, offsets)
    if not len(begins):
        return out
    begins, ends, owners = _shingle_spans(begins, ends, rows, count, width)
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(begins.tolist(), ends.tolist())), _U, len(begins))
    sizes = np.bincount(owners, minlength=count)
    filled = np.flatnonzero(sizes)
    heads = (np.cumsum(sizes) - sizes)[filled]
    for bit in range(64):
        ones = np.add.reduceat(((hashes >> _U(bit)) & _U(1)).astype(np.int32), heads)
        out[filled] |= (2 * ones > sizes[filled]).astype(_U) << _U(bit)
    return out


def _fingerprinted(width: int):
    def fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in words.slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first), pa.array(text_fingerprints(data, offsets, width).view(np.int64))],
                    ["doc_id", "fingerprint"])

    return fingerprinted


def fingerprints(documents: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """doc_id, fingerprint (the bits of a long) of every row."""
    narrow = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(_fingerprinted(width), "doc_id long, fingerprint long")


# --- trees --------------------------------------------------------------------------------------------------------

class BKTrees:
    """One BK-tree for each bucket. `prints` are different within a bucket; `buckets` are ascending numbers from 0.

    Every fingerprint is a node. A child is found by its parent and distance: `edges` has 128 * parent + distance in order.
    """

    def __init__(self, prints: np.ndarray, buckets: np.ndarray) -> None:
        self.prints = prints
        roots = np.searchsorted(buckets, np.arange(buckets[-1] + 1 if len(buckets) else 0))
        self.root_of = roots[buckets]
        waiting = np.flatnonzero(self.root_of != np.arange(len(prints)))
        above = self.root_of[waiting]
        edges, nodes = [], []
        while len(waiting):  # one level of all trees
            edge = above * 128 + np.bitwise_count(prints[waiting] ^ prints[above])
            order = np.argsort(edge, kind="stable")
            edge, waiting = edge[order], waiting[order]
            first = np.ones(len(edge), bool)
            first[1:] = edge[1:] != edge[:-1]
            edges.append(edge[first])
            nodes.append(waiting[first])
            above = waiting[first][np.cumsum(first) - 1][~first]
            waiting = waiting[~first]
        self.levels = list(zip(nodes, [e >> 7 for e in edges]))
        edges, nodes = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (edges, nodes))
        order = np.argsort(edges, kind="stable")
        self.edges, self.nodes = edges[order], nodes[order]

    def within(self, asked: np.ndarray, radius: int, labels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of an asked node and another of its tree at most `radius` away.

        With `labels`, subtrees whose nodes all have the asked node's label are left out.
        """
        if labels is not None:
            low, high = labels.copy(), labels.copy()
            for nodes, parents in reversed(self.levels):
                np.minimum.at(low, parents, low[nodes])
                np.maximum.at(high, parents, high[nodes])
        found = []
        node = self.root_of[asked]
        while len(asked):
            far = np.bitwise_count(self.prints[asked] ^ self.prints[node]).astype(np.int64)
            hit = (far <= radius) & (asked != node)
            found.append((asked[hit], node[hit]))
            start = np.searchsorted(self.edges, node * 128 + np.maximum(far - radius, 0))
            count = np.searchsorted(self.edges, node * 128 + np.minimum(far + radius, 127), side="right") - start
            asked = np.repeat(asked, count)
            node = self.nodes[np.arange(len(asked)) + np.repeat(start - (np.cumsum(count) - count), count)]
            if labels is not None:
                open_ = (low[node] != high[node]) | (low[node] != labels[asked])
                asked, node = asked[open_], node[open_]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def bucket_links(prints: np.ndarray, buckets: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint with the smallest that it is connected to by links within buckets, where that is another."""
    sizes = np.bincount(buckets) if len(buckets) else np.zeros(0, np.int64)
    several = sizes[buckets] > 1
    prints = prints[several]
    _, buckets = np.unique(buckets[several], return_inverse=True)
    trees = BKTrees(prints, buckets)
    cost = np.cumsum(np.bincount(buckets)[buckets]) if len(buckets) else np.zeros(0, np.int64)
    labels, at = None, 0
    one, two = np.zeros(0, np.int64), np.zeros(0, np.int64)
    while at < len(prints):
        done = cost[at - 1] if at else 0
        end = max(int(np.searchsorted(cost, done + STEPS, side="right")), at + 1)
        a, b = trees.within(np.arange(at, end), radius, labels)
        one, two = forest(np.concatenate([one, a]), np.concatenate([two, b]))
        labels = np.arange(len(prints))
        labels[one] = two
        at = end
    return forest(prints[one].view(np.int64), prints[two].view(np.int64))


def _linked(radius: int):
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of their buckets; a bucket is never parted."""
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush(last: bool):
            nonlocal held, size
            path, bits, pair, prints = (np.concatenate(x) for x in zip(*held))
            new = np.ones(len(path), bool)
            new[1:] = (path[1:] != path[:-1]) | (bits[1:] != bits[:-1]) | (pair[1:] != pair[:-1])
            end = len(path) if last else int(np.flatnonzero(new)[-1])
            a, b = bucket_links(prints[:end].view(_U), np.cumsum(new[:end]) - 1, radius)
            held, size = [(path[end:], bits[end:], pair[end:], prints[end:])], len(path) - end
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            held.append(tuple(np.asarray(batch.column(c), dtype=np.int64) for c in ("path", "bits", "pair", "fingerprint")))
            size += batch.num_rows
            if size >= TOGETHER:
                yield flush(False)
        if size:
            yield flush(True)

    return linked


# --- the join -----------------------------------------------------------------------------------------------------

def _bit_groups(free: list[int], count: int) -> list[list[int]]:
    """`count` runs of the free bits, as equal as can be; none is empty while there are enough bits."""
    cuts = [len(free) * i // count for i in range(count + 1)]
    return [free[a:b] for a, b in zip(cuts, cuts[1:])]


def _paths(depth: int, radius: int) -> dict[int, list[int]]:
    """The bits that are alike in the buckets of a path; a path is the groups' numbers, one digit for each time dealt."""
    paths: dict[int, list[int]] = {0: []}
    for _ in range(depth):
        paths = {
            path * (radius + 1) + i: used + group for path, used in paths.items()
            for i, group in enumerate(_bit_groups([b for b in range(64) if b not in used], radius + 1))}
    return paths


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def links(prints: DataFrame, radius: int = RADIUS, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """a, b: pairs that connect the different values of `fingerprint` as links of at most `radius` bits do."""
    parts = radius + 1
    rows = prints.select("fingerprint", F.lit(0).cast("long").alias("path"), F.lit(0).cast("long").alias("bits"))
    ready = []
    for level in range(1, depth + 1):
        masks = [_mask(bits) for _, bits in sorted(_paths(level, radius).items())]
        table = F.array(*(F.lit(m).cast("long") for m in masks))
        child = lambda i: F.col("path") * parts + F.lit(i)
        rows = rows.select("fingerprint", F.explode(F.array(*(
            F.struct(child(i).alias("path"), F.get(table, child(i).cast("int")).bitwiseAND(F.col("fingerprint")).alias("bits"))
            for i in range(parts)))).alias("to")).select("fingerprint", "to.*")
        rows = written(rows, f"dealt-{level}")
        large = written(rows.groupBy("path", "bits").agg(F.count("*").alias("size")).where(F.col("size") > leaf), "large-buckets")
        if large.isEmpty():
            ready.append(rows.withColumn("pair", F.lit(0).cast("long")))
            rows = None
            break
        ready.append(rows.join(large, ["path", "bits"], "left_anti").withColumn("pair", F.lit(0).cast("long")))
        rows = rows.join(large, ["path", "bits"])
        if level < depth:
            rows = rows.drop("size")
    if rows is not None:  # what agrees in most bits and is still large: all pairs of shards
        shards = F.ceil(F.col("size") / (leaf // 2)).cast("long")
        own = F.pmod(F.xxhash64("fingerprint"), F.col("_shards"))
        partner = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_shards") - 1))
        ready.append(rows.withColumn("_shards", shards).withColumn("_own", own).withColumn("_other", partner).select(
            "fingerprint", "path", "bits",
            (F.least("_own", "_other") * F.col("_shards") + F.greatest("_own", "_other")).alias("pair")))
    dealt = ready[0]
    for more in ready[1:]:
        dealt = dealt.unionByName(more)
    sorted_rows = dealt.repartition("path", "bits", "pair").sortWithinPartitions("path", "bits", "pair")
    return sorted_rows.select("path", "bits", "pair", "fingerprint").mapInArrow(_linked(radius), "a long, b long").distinct()


def near_duplicates(documents: DataFrame, key: str, text: str, width: int, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    rows = written(fingerprints(documents, key, text, width), "fingerprints")
    classes = written(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("_least")), "fingerprint-classes")
    groups = components(written(links(classes.select("fingerprint"), radius), "fingerprint-links"))
    labelled = classes.join(groups, classes["fingerprint"] == groups["node"], "left").select(
        "fingerprint", "_least", F.coalesce("component", "fingerprint").alias("_component"))
    # few components have several fingerprints, one of them may have very many
    least = labelled.groupBy("_component").agg(F.min("_least").alias("component_id"))
    known = written(heavy_join(labelled, least, ["_component"]).select("fingerprint", "component_id"), "fingerprint-components")
    return heavy_join(rows, known, ["fingerprint"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
