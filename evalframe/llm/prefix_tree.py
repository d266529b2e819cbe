"""N-gram Jaccard join by prefix trees.

A document's set is its distinct word n-grams as 64-bit hashes, in ascending order: one order for the whole corpus. Equal
sets are one from the start. Candidates meet by segments: for a range of set sizes the hash space is cut into more
intervals than two linked sets can have different members, so at least one interval is alike in both, and its members,
hashed, are a key that only near copies share. (Sets with more empty intervals than the cut allows for also exchange the
members of their ordered prefix.) Documents that share a key, directly or through others, form a cluster.

In a cluster the sets are stored in a prefix tree with runs of members in its nodes. The sets that are searched go down the
tree together and carry their overlaps along, so a shared prefix is counted once for all sets below it; a subtree is left by
those for which even its longest rest could not reach the similarity. A large cluster is cut into blocks. The
documents with the most links in their blocks meet all blocks first, which joins most copies of one text. What is then not
in the largest component of the cluster is compared with the documents of other components and blocks that have one of its
keys, by sketches first: a set's sketch has a bit for each residue of its members, set where their number is odd, so two
sets differ in at least as many members as their sketches do in bits. Where these are more than a link allows there is
none; a document meets the trees of the others in blocks again, so no link is missed.

Documents without words or with a null id link with nothing; the latter have no component. Rows with the same id are one
node. An empty table gives no rows. Other input columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from evalframe.llm import words
from evalframe.llm.graph import components, forest
from evalframe.llm.shared import written

BLOCK, BLOCK_MEMBERS = 1024, 1 << 18  # documents and members of their sets in a block of a cluster
PIVOTS = 4  # documents of a large cluster that meet all its blocks first
RUN = 64  # members in a node of the tree at most
TOGETHER, MARKS = 256, 32 << 20  # sets that go down a tree together; bytes that mark their members
BUCKET_KEYS = 100_000  # keys that one reducing task sorts, on average
SKETCH, SKETCH_BITS = 1, 1 << 15  # bits of a sketch for each member at least, and of a sketch at most
KEY_ROWS, BUCKET_ROWS = 4096, 20_000  # documents of a key, and rows of all keys, that one task compares, on average
COMPARED = 16 << 20  # bytes of sketches that are compared at once

_U = np.uint64


# --- candidates ---------------------------------------------------------------------------------------------------

class Ranges:
    """Ranges of set sizes for a similarity of p/q; a set links only within its range and the next."""

    def __init__(self, p: int, q: int, largest: int) -> None:
        lows = [1]
        while lows[-1] <= largest:
            lows.append(lows[-1] * q // p + 1)
        self.lows = np.array(lows, np.int64)
        tops = self.lows * q // p
        self.differing = tops * (q - p) // p  # members in one of two linked sets only, at most
        self.empty = 2 + self.differing // 50  # empty intervals that the cut allows for
        self.cuts = self.differing + 1 + self.empty

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lows, sizes, side="right") - 1


def segment_keys(members: np.ndarray, bounds: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and the rows (positions in `bounds`) that have them; linked rows with different sets share at least one."""
    sizes = np.diff(bounds)
    if not len(members):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    ranges = Ranges(p, q, int(sizes.max()))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(members)) - bounds[:-1][rows]
    mixed = words.mix(members)
    keys, owners = [], []
    for shift in (0, 1):  # as the smaller and as the larger set of a pair
        scheme = ranges.of(sizes) - shift
        takes = (sizes > 0) & (scheme >= 0)
        takes &= ranges.differing[np.maximum(scheme, 0)] > 0
        scheme = np.where(takes, scheme, 0)
        cuts = ranges.cuts[scheme]
        inside = takes[rows]
        part, owner = members[inside], rows[inside]
        if not len(part):
            continue
        interval = ((part >> _U(32)) * cuts[owner].astype(_U)) >> _U(32)
        first = np.ones(len(part), bool)
        first[1:] = (owner[1:] != owner[:-1]) | (interval[1:] != interval[:-1])
        starts = np.flatnonzero(first)
        content = np.add.reduceat(mixed[inside], starts)
        owner_of, interval = owner[starts], interval[starts]
        salt = scheme[owner_of].astype(_U) * _U(1 << 40) + interval
        keys.append(words.mix(content ^ words.mix(salt + _U(1))))
        owners.append(owner_of)
        filled = np.bincount(owner_of, minlength=len(sizes))
        sparse = takes & (cuts - filled > ranges.empty[scheme])
        prefix = sizes - -(-sizes * p // q) + 1
        chosen = sparse[rows] & (place < prefix[rows])
        keys.append(words.mix(mixed[chosen] ^ words.mix(scheme[rows[chosen]].astype(_U) + _U(1 << 63))))
        owners.append(rows[chosen])
    return (np.concatenate(keys), np.concatenate(owners)) if keys else (np.zeros(0, _U), np.zeros(0, np.int64))


def _set_sums(members: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums that stand for a whole set."""
    sizes = np.diff(bounds)
    filled = np.flatnonzero(sizes)
    out = np.zeros((2, len(sizes)), _U)
    for i in (0, 1):
        if len(filled):
            out[i, filled] = np.add.reduceat(words.mix(members + _U(i + 1)), bounds[:-1][filled])
    return out[0].view(np.int64), out[1].view(np.int64)


def _sets(width: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in words.slices(batch.column("text")):
                members, bounds = words.shingle_sets(data, offsets, width)
                one, two = _set_sums(members, bounds)
                head = np.zeros(len(bounds) - 1, _U)
                filled = np.flatnonzero(np.diff(bounds))
                head[filled] = members[bounds[:-1][filled]]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(first, last - first), pa.array(np.diff(bounds)), pa.array(one), pa.array(two),
                    pa.array(head.view(np.int64)),
                ], ["doc_id", "n", "sum1", "sum2", "head"])

    return sets


def _least_per_key(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each key with its smallest document, and what the others are connected to by their keys."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    least = docs[np.flatnonzero(first)]
    others = ~first
    return keys[first], least, *forest(docs[others], least[np.cumsum(first)[others] - 1])


def _keyed(width: int, p: int, q: int, buckets: int):
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, ids = [], np.asarray(batch.column("doc_id"), dtype=np.int64)
            for first, last, data, offsets in words.slices(batch.column("text")):
                keys, rows = segment_keys(*words.shingle_sets(data, offsets, width), p, q)
                found.append((keys, ids[first:last][rows]))
            if not found:
                continue
            keys, docs, a, b = _least_per_key(*(np.concatenate(x) for x in zip(*found)))
            home = (keys % _U(buckets)).astype(np.int64)
            order = np.argsort(home, kind="stable")
            cuts = np.searchsorted(home[order], np.arange(buckets + 1))
            share = np.linspace(0, len(a), buckets + 1).astype(np.int64)  # pairs found here are passed on
            rows = [(i, keys[order[s:e]].tobytes(), docs[order[s:e]].tobytes(), a[x:y].tobytes(), b[x:y].tobytes())
                    for i, (s, e, x, y) in enumerate(zip(cuts, cuts[1:], share, share[1:])) if e > s or y > x]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64()] + [pa.binary()] * 4)] if rows else
                [pa.array([], k) for k in [pa.int64()] + [pa.binary()] * 4], ["bucket", "keys", "docs", "a", "b"])

    return keyed


def _met(group: pa.Table) -> pa.Table:
    def joined(name: str, kind) -> np.ndarray:
        return np.concatenate([np.frombuffer(x, kind) for x in group.column(name).to_pylist()])

    _, _, a, b = _least_per_key(joined("keys", _U), joined("docs", np.int64))
    a, b = forest(np.concatenate([joined("a", np.int64), a]), np.concatenate([joined("b", np.int64), b]))
    return pa.table({"a": a, "b": b})


# --- the tree -----------------------------------------------------------------------------------------------------

class PrefixTree:
    """The tree of ordered sets as arrays, level by level; a run of members longer than RUN is a chain of nodes.

    `codes` holds the members' places in the order of all members of the tree, so a probe is a bit for each place.
    """

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets) if sets else np.zeros(0, _U)
        self.places, codes = np.unique(every, return_inverse=True)
        bounds = np.concatenate([[0], np.cumsum(self.sizes)])
        self.own = [codes[x:y] for x, y in zip(bounds, bounds[1:])]
        nodes = self._nodes()
        order = sorted(range(len(nodes)), key=lambda i: nodes[i][0])  # by level
        new = np.empty(len(nodes) + 1, np.int64)
        new[order] = np.arange(len(nodes))
        new[-1] = -1
        level = np.array([nodes[i][0] for i in order], np.int64)
        self.levels = np.searchsorted(level, np.arange((level[-1] if len(level) else -1) + 2))
        self.parent = np.array([new[nodes[i][1]] for i in order], np.int64)
        self.length = np.array([nodes[i][4] - nodes[i][3] for i in order], np.int64)
        self.depth = np.array([nodes[i][4] for i in order], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        runs = [self.own[nodes[i][2]][nodes[i][3] : nodes[i][4]] for i in order]
        self.codes = np.concatenate(runs) if runs else np.zeros(0, np.int64)
        self.last = np.array([r[-1] for r in runs], np.int64)
        self.end_of = new[self.ends]  # the node where each set ends
        self.shortest = np.full(len(nodes), np.iinfo(np.int64).max)
        self.longest = np.zeros(len(nodes), np.int64)
        filled = np.flatnonzero(self.sizes)
        np.minimum.at(self.shortest, self.end_of[filled], self.sizes[filled])
        np.maximum.at(self.longest, self.end_of[filled], self.sizes[filled])
        for x, y in zip(self.levels[-2:0:-1], self.levels[:0:-1]):  # from the deepest level up
            np.minimum.at(self.shortest, self.parent[x:y], self.shortest[x:y])
            np.maximum.at(self.longest, self.parent[x:y], self.longest[x:y])
        children = np.full(len(nodes) + 1, -1)
        np.maximum.at(children, self.parent, np.arange(len(nodes)))
        self.last_child = children[: len(nodes)].tolist()
        by_node = np.argsort(self.end_of, kind="stable")
        cuts = np.searchsorted(self.end_of[by_node], np.arange(len(nodes) + 1))
        self.ending = {i: by_node[x:y] for i, (x, y) in enumerate(zip(cuts, cuts[1:])) if y > x}

    def _nodes(self) -> list[tuple[int, int, int, int, int]]:
        """(level, parent, set, from, to) of each node: members from..to of a set, shared by the sets below."""
        order = sorted(range(len(self.own)), key=lambda i: self.own[i].astype(">u8").tobytes())
        shared = [0]
        for i, j in zip(order, order[1:]):
            both = min(len(self.own[i]), len(self.own[j]))
            differs = np.flatnonzero(self.own[i][:both] != self.own[j][:both])
            shared.append(int(differs[0]) if len(differs) else both)
        shared.append(0)
        nodes, path = [], []
        self.ends = np.full(len(self.own), -1, np.int64)
        for at, i in enumerate(order):
            size = len(self.own[i])
            while path and nodes[path[-1]][4] > shared[at]:
                path.pop()
            done = nodes[path[-1]][4] if path else 0
            cuts, after, part = {size, *range(done + RUN, size, RUN)}, at + 1, size
            while part > done:  # wherever the way parts for a later set a node begins
                part = min(part, shared[after])
                cuts.add(part)
                after += 1
            for cut in sorted(c for c in cuts if done < c):
                nodes.append((nodes[path[-1]][0] + 1 if path else 0, path[-1] if path else -1, i, done, cut))
                path.append(len(nodes) - 1)
                done = cut
            if size:
                self.ends[i] = path[-1]
        return nodes

    def links(self, probes: list[np.ndarray], p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a probe and a set of the tree that link. The probes go down the tree together: at a node the members of
        its run that each probe has are added to the overlap that it brings along, and only those go on whose overlap could
        still reach the similarity with what is left of them and of the longest set below."""
        size = np.array([len(s) for s in probes], np.int64)
        every = np.concatenate(probes) if probes else np.zeros(0, _U)
        mark = np.zeros((len(self.places) + 1, len(probes)), np.uint8)
        place = np.minimum(np.searchsorted(self.places, every), max(len(self.places) - 1, 0))
        if len(self.places):
            known = self.places[place] == every
            mark[place[known], np.repeat(np.arange(len(probes)), size)[known]] = 1
        # by node, as long as children are to come
        going: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        whole = (np.flatnonzero(size), np.zeros(int((size > 0).sum()), np.int32))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for node, (parent, begin, length) in enumerate(zip(self.parent.tolist(), self.begin.tolist(), self.length.tolist())):
            alive, overlap = whole if parent < 0 else going[parent] if self.last_child[parent] > node else going.pop(parent)
            if len(alive):
                run = self.codes[begin : begin + length]
                if 2 * len(alive) > len(probes):
                    overlap = overlap + mark[run].sum(axis=0, dtype=np.int32)[alive]
                else:
                    overlap = overlap + mark[run[:, None], alive].sum(axis=0, dtype=np.int32)
                own = size[alive]
                most = overlap.astype(np.int64) + np.minimum(own - overlap, self.longest[node] - self.depth[node])
                keep = most * (p + q) >= p * (own + self.shortest[node])
                alive, overlap = alive[keep], overlap[keep]
                for i in self.ending.get(node, ()) if len(alive) else ():
                    hit = alive[overlap.astype(np.int64) * (p + q) >= p * (size[alive] + self.sizes[i])]
                    found.append((hit, np.full(len(hit), i)))
            if self.last_child[node] >= 0:
                going[node] = (alive, overlap)
        return tuple(np.concatenate(x) for x in zip(*found))

    def walk(self, i: int, p: int, q: int) -> np.ndarray:
        """The sets that link with set `i`, itself among them."""
        return np.sort(self.links([self.places[self.own[i]]], p, q)[1])

    def batches(self, count: int) -> Iterator[tuple[int, int]]:
        """Runs of probes that go down together, a few first."""
        most = max(min(TOGETHER, MARKS // (len(self.places) + 1)), 1)
        at, some = 0, min(16, most)
        while at < count:
            yield at, min(at + some, count)
            at, some = at + some, most


def linked(sets: list[np.ndarray], p: int, q: int) -> tuple[list[int], list[int]]:
    """For each set the first set of its component, and how many links it was found to have.

    Two sets link when q times the overlap is at least p times the union.
    """
    tree = PrefixTree(sets)
    home, degree = np.arange(len(sets)), np.zeros(len(sets), np.int64)
    filled = np.flatnonzero(tree.sizes)
    for at, end in tree.batches(len(sets)):
        if len(filled) and (home[filled] == home[filled[0]]).all() and at:  # all that can be linked is one
            break
        a, b = tree.links(sets[at:end], p, q)
        degree += np.bincount(a + at, minlength=len(sets))
        moved, to = forest(np.concatenate([a + at, np.arange(len(sets))]), np.concatenate([b, home]))
        home = np.arange(len(sets))
        home[moved] = to
    return home.tolist(), degree.tolist()


def _members(texts: pa.ChunkedArray, width: int) -> list[np.ndarray]:
    out = []
    for chunk in texts.chunks:
        for _, _, data, offsets in words.slices(chunk):
            members, bounds = words.shingle_sets(data, offsets, width)
            out += [members[a:b] for a, b in zip(bounds, bounds[1:])]
    return out


def sketch(members: np.ndarray) -> bytes:
    """A bit for each residue of the members by a power of two, set where an odd number of them has it."""
    bits = min(max(1 << (SKETCH * len(members) - 1).bit_length(), 64), SKETCH_BITS) if len(members) else 64
    odd = np.bincount((members & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches of `size` bytes or more as rows of that size: a bit of the shorter one sums up those of the longer."""
    out = np.zeros((len(sketches), size // 8), _U)
    for i, one in enumerate(sketches):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(one, _U).reshape(-1, size // 8), axis=0)
    return out


def _block_links(width: int, p: int, q: int):
    def links(group: pa.Table) -> pa.Table:
        """a, b: each document and the first of its component in the block; `degree`: how many it links with there; the
        size of its set and its sketch."""
        group = group.sort_by("doc_id")
        docs = group.column("doc_id").to_pylist()
        sets = _members(group.column("text"), width)
        home, degree = linked(sets, p, q)
        return pa.table({
            "cluster": group.column("cluster"), "a": pa.array(docs, pa.int64()),
            "b": pa.array([docs[h] for h in home], pa.int64()), "degree": pa.array(degree, pa.int64()),
            "n": pa.array([len(s) for s in sets], pa.int64()), "sketch": pa.array([sketch(s) for s in sets], pa.binary())})

    return links


def _own_keys(width: int, p: int, q: int):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.drop_columns(["text"])
            for first, last, data, offsets in words.slices(batch.column("text")):
                found, rows = segment_keys(*words.shingle_sets(data, offsets, width), p, q)
                some = rest.slice(first, last - first).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), *some.columns], ["key", *some.schema.names])

    return keys


def _near(p: int, q: int):
    def near(group: pa.Table) -> pa.Table:
        """Pairs with a key in common, in different components and blocks, whose sizes and sketches allow a link: the
        document that asks, the other one and its block."""
        group = group.sort_by([("key", "ascending"), ("part", "ascending")])
        key, part, doc, block, component, n = (
            np.asarray(group.column(c), dtype=np.int64) for c in ("key", "part", "doc_id", "block", "component", "n"))
        rest, held = (np.asarray(group.column(c).combine_chunks()).astype(bool) for c in ("rest", "held"))
        sketches = group.column("sketch").to_pylist()
        size = np.array([len(x) for x in sketches], np.int64)
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1])
        others = np.flatnonzero(held)
        cuts = np.searchsorted(others, np.append(np.flatnonzero(new), len(key)))
        asks, of = np.flatnonzero(rest), np.cumsum(new)[rest] - 1
        begin, count = cuts[of], np.diff(cuts)[of]
        as_rows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for width in np.unique(size).tolist():
            fit = np.flatnonzero((size >= width) & (size * p <= 2 * q * width))  # no set of another size can link
            place = np.zeros(len(size), np.int64)
            place[fit] = np.arange(len(fit))
            as_rows[width] = place, folded([sketches[i] for i in fit], width)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        ends, at = np.cumsum(count), 0
        while at < len(asks):
            to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + COMPARED // 64, side="right")), at + 1)
            many = count[at:to]
            one = np.repeat(asks[at:to], many)
            two = others[np.arange(len(one)) + np.repeat(begin[at:to] - np.cumsum(many) + many, many)]
            keep = (component[one] != component[two]) & (block[one] != block[two])
            keep &= (np.maximum(n[one], n[two]) * p <= np.minimum(n[one], n[two]) * q) & (~rest[two] | (doc[one] < doc[two]))
            one, two = one[keep], two[keep]
            least = np.minimum(size[one], size[two])
            for width, (place, rows) in as_rows.items():
                a, b = one[least == width], two[least == width]
                for x in range(0, len(a), COMPARED // width):
                    c, d = a[x : x + COMPARED // width], b[x : x + COMPARED // width]
                    differ = np.bitwise_count(rows[place[c]] ^ rows[place[d]]).sum(axis=1, dtype=np.int64)
                    may = differ * (p + q) <= (n[c] + n[d]) * (q - p)
                    found.append((c[may], d[may]))
            at = to
        one, two = (np.concatenate(x) for x in zip(*found))
        return pa.table({"cluster": group.column("cluster").take(pa.array(one)), "doc_id": pa.array(doc[one]),
                         "other": pa.array(doc[two]), "block": pa.array(block[two].astype(np.int32))})

    return near


def _cross_links(width: int, p: int, q: int):
    def links(group: pa.Table) -> pa.Table:
        """What the asked documents link with in the block, as pairs that connect it."""
        asked = np.asarray(group.column("asked").combine_chunks()).astype(bool)
        docs = np.asarray(group.column("doc_id"), dtype=np.int64)
        sets = _members(group.column("text"), width)
        probes, held = np.flatnonzero(asked), np.flatnonzero(~asked)
        tree = PrefixTree([sets[i] for i in held])
        one, two = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at, end in tree.batches(len(probes)):
            a, b = tree.links([sets[i] for i in probes[at:end]], p, q)
            one, two = forest(np.concatenate([one, docs[probes[at:end][a]]]), np.concatenate([two, docs[held[b]]]))
        return pa.table({"a": one, "b": two})

    return links


# --- the join -----------------------------------------------------------------------------------------------------

def near_duplicates(documents: DataFrame, key: str, text: str, width: int, p: int, q: int, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; sets link at a Jaccard similarity of p/q or more."""
    spark = documents.sparkSession
    narrow = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sets = written(narrow.mapInArrow(_sets(width), "doc_id long, n long, sum1 long, sum2 long, head long"), "sets")
    known = narrow.where("doc_id IS NOT NULL")
    # equal sets are one: only the smallest document of each goes on
    equal = sets.where("doc_id IS NOT NULL AND n > 0").groupBy("n", "sum1", "sum2").agg(F.min("doc_id").alias("b"))
    same = sets.join(equal, ["n", "sum1", "sum2"]).select(F.col("doc_id").alias("a"), "b")
    total = sets.agg(F.sum("n")).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions, math.ceil(total * 2 * (q - p) / p / BUCKET_KEYS))
    keyed = known.mapInArrow(_keyed(width, p, q, buckets), "bucket long, keys binary, docs binary, a binary, b binary")
    met = keyed.groupBy("bucket").applyInArrow(_met, "a long, b long").distinct()
    twins = written(same.where("a <> b").distinct(), "equal-sets")
    # pairs between equal sets say nothing new; every document stands for its set, unless its id has several
    several = sets.where("doc_id IS NOT NULL").select("doc_id", "n", "sum1", "sum2").distinct().groupBy("doc_id").agg(
        F.count("*").alias("_n")).where("_n > 1").select(F.col("doc_id").alias("_doc"))
    stands = twins.select(F.col("a").alias("_doc"), F.col("b").alias("_for")).join(several, "_doc", "left_anti")
    pairs = met.join(stands, met["a"] == stands["_doc"], "left").select(F.coalesce("_for", "a").alias("a"), "b")
    pairs = pairs.join(stands, pairs["b"] == stands["_doc"], "left").select("a", F.coalesce("_for", "b").alias("b"))
    clusters = components(pairs)
    members = clusters.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))
    # a block is a part of the cluster's tree: sets with one first member, many of those by document
    heads = sets.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("head").alias("_head"), F.max("n").alias("_n"))
    members = written(members.join(heads, "doc_id"), "cluster-members")
    parts = F.ceil(F.greatest(F.count("*") / block, F.sum("_n") / BLOCK_MEMBERS))
    sizes = members.groupBy("cluster").agg(parts.alias("_heads"))
    placed = members.join(sizes, "cluster").select(
        "doc_id", "cluster", "_n", F.pmod(F.xxhash64("_head"), F.col("_heads")).alias("_branch"))
    whole = Window.partitionBy("cluster")
    before = whole.orderBy("_branch").rowsBetween(Window.unboundedPreceding, -1)
    branches = placed.groupBy("cluster", "_branch").agg(parts.alias("_subs")).select(
        "cluster", "_branch", "_subs", F.coalesce(F.sum("_subs").over(before), F.lit(0)).alias("_from"),
        F.sum("_subs").over(whole).cast("int").alias("blocks"))
    placed = placed.join(branches, ["cluster", "_branch"]).select(
        "doc_id", "cluster", "blocks", (F.col("_from") + F.pmod(F.xxhash64("doc_id"), F.col("_subs"))).cast("int").alias("block"))
    # by shuffle at every size: a broadcast would only last while few documents are in clusters
    found = written(known.join(placed.hint("shuffle_merge"), "doc_id").withColumn("_text", F.xxhash64("text")).dropDuplicates(
        ["doc_id", "_text"]).drop("_text"), "cluster-texts")
    first = written(found.select("cluster", "block", "doc_id", "text").groupBy("cluster", "block").applyInArrow(
        _block_links(width, p, q), "cluster long, a long, b long, degree long, n long, sketch binary"), "block-links")
    links = first.where("a <> b").select("a", "b")
    # of a cluster in several blocks, the documents with the most links meet all blocks
    large = found.where("blocks > 1").select("cluster", "blocks", "block", "doc_id", "text")
    order = Window.partitionBy("cluster").orderBy(F.desc("degree"), "a")
    pivots = first.join(large.select("cluster").distinct(), "cluster", "left_semi").withColumn(
        "_r", F.row_number().over(order)).where(F.col("_r") <= PIVOTS).select(F.col("a").alias("doc_id"))
    everywhere = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sent = large.join(pivots, "doc_id", "left_semi").withColumn("to", everywhere).where("to <> block").select(
        "cluster", F.col("to").alias("block"), "doc_id", "text", F.lit(True).alias("asked"))
    held = large.select("cluster", "block", "doc_id", "text", F.lit(False).alias("asked"))
    links = written(links.unionByName(sent.unionByName(held).groupBy("cluster", "block").applyInArrow(
        _cross_links(width, p, q), "a long, b long")), "pivot-links")
    # what is not in the largest component of its cluster now meets the documents of other components and blocks that have
    # one of its keys: nothing else can link with it
    parts = large.select("cluster", "doc_id").distinct().join(
        components(links).withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn(
        "component", F.coalesce("component", "doc_id"))
    largest = parts.groupBy("cluster", "component").agg(F.count("*").alias("_n")).groupBy("cluster").agg(
        F.max_by("component", F.struct("_n", "component")).alias("_largest"), F.count("*").alias("_parts"))
    open_parts = written(parts.join(largest.where("_parts > 1"), "cluster").select(
        "doc_id", "component", (F.col("component") != F.col("_largest")).alias("rest")), "open-components")
    keys = large.join(open_parts, "doc_id").select("text", "cluster", "block", "doc_id", "component", "rest").mapInArrow(
        _own_keys(width, p, q), "key long, cluster long, block int, doc_id long, component long, rest boolean")
    # a key of one component or of one block asks for nothing: it ends in the exchange that brings it together
    of_key = Window.partitionBy("key")
    ends = {f"_{m}_{c}": getattr(F, m)(c).over(of_key) for c in ("component", "block") for m in ("min", "max")}
    keys = written(keys.withColumns(ends).where("_min_component < _max_component AND _min_block < _max_block").drop(*ends), "open-keys")
    # keys of the same documents say the same: one of them is enough
    marks = keys.groupBy("key").agg(
        F.count("*").alias("_count"), F.sum(F.xxhash64("doc_id").cast("decimal(20,0)")).alias("_sum"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("_xor"))
    keys = written(keys.join(marks.groupBy("_count", "_sum", "_xor").agg(F.min("key").alias("key")).where("_count > 1"), "key", "left_semi"),
                   "different-keys")
    # documents that share a key meet by their sketches; many of one key in parts, to each of which all that ask are sent
    spread = keys.join(keys.groupBy("key").agg(F.ceil(F.count("*") / KEY_ROWS).cast("int").alias("_parts")), "key").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).withColumn(
        "held", F.pmod(F.xxhash64("doc_id"), F.col("_parts")) == F.col("part")).where("rest OR held").drop("_parts")
    buckets = max(partitions, math.ceil(keys.count() / BUCKET_ROWS))
    near = written(spread.join(first.select(F.col("a").alias("doc_id"), "n", "sketch"), "doc_id").withColumn(
        "bucket", F.pmod(F.xxhash64("key", "part"), F.lit(buckets))).groupBy("bucket").applyInArrow(
        _near(p, q), "cluster long, doc_id long, other long, block int").distinct(), "near")
    asked = written(near.select("cluster", "block", "doc_id").distinct(), "asked")
    others = near.select(F.col("other").alias("doc_id")).distinct()
    turns = asked.groupBy("cluster", "block").agg(F.ceil(F.count("*") / (4 * block)).cast("int").alias("_turns"))
    sent = asked.join(turns, ["cluster", "block"]).join(large.select("doc_id", "text"), "doc_id").select(
        "cluster", "block", F.pmod(F.xxhash64("doc_id"), F.col("_turns")).cast("int").alias("part"), "doc_id", "text",
        F.lit(True).alias("asked"))
    held = large.join(others, "doc_id", "left_semi").join(turns, ["cluster", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_turns") - 1))).select(
        "cluster", "block", "part", "doc_id", "text", F.lit(False).alias("asked"))
    cross = sent.unionByName(held).groupBy("cluster", "block", "part").applyInArrow(
        _cross_links(width, p, q), "a long, b long")
    groups = components(links.unionByName(cross).unionByName(twins))
    return sets.join(groups, sets["doc_id"] == groups["node"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(documents: DataFrame, key: str, text: str, width: int, p: int, q: int) -> DataFrame:
    """The rows of the smallest document of each component, one for each id and text; rows with a null id stay."""
    named, none = documents.where(F.col(key).isNotNull()), documents.where(F.col(key).isNull())
    texts = named.select(F.col(key).alias("id"), F.xxhash64(text).alias("text")).distinct()
    if texts.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        groups = near_duplicates(documents, key, text, width, p, q)
        first = groups.where("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
        kept = documents.join(first, key, "left_semi").dropDuplicates([key]).select(*documents.columns)
        return kept.unionByName(none)
    # ids with several texts: a document is an id with a text, the smallest that of the smallest id
    rows = named.select(F.xxhash64(key, text).alias("node"), F.struct("*").alias("came"))
    groups = near_duplicates(rows.select("node", F.col("came").getField(text).alias("text")), "node", "text", width, p, q)
    ids = rows.select("node", F.col("came").getField(key).alias("id")).distinct()
    first = groups.select(F.col("doc_id").alias("node"), "component_id").distinct().join(ids, "node").groupBy(
        "component_id").agg(F.min(F.struct("id", "node")).alias("least")).select("least.node")
    kept = rows.join(first, "node", "left_semi").dropDuplicates(["node"]).select(
        *(F.col("came").getField(c).alias(c) for c in documents.columns))
    return kept.unionByName(none)
