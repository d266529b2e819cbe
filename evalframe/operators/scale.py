"""Building blocks that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from evalframe.session import cut_lineage

# Bounds for the number of pieces a key is split into; see `pieces`.
MIN_PIECES, MAX_PIECES = 32, 256

# A key with more than one in HOT_KEYS of the rows is hot, so there are fewer hot keys than that; the sketch that finds them
# keeps TRACKED_KEYS counters, at least three quarters of them in use, and misses no key with that share.
HOT_KEYS, TRACKED_KEYS = 128, 4096

# Leading hex digits of a hash that name the histogram bucket when a large per-group selection is cut off.
RANK_DIGITS = 4


def pieces(spark: SparkSession) -> int:
    """Pieces of a group whose rows are reduced before they meet: the shuffle partitions as a power of two, within bounds."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(max(1 << (partitions - 1).bit_length(), MIN_PIECES), MAX_PIECES)


def hot_keys(df: DataFrame, on: Sequence[str], counts: str | None = None) -> DataFrame:
    """One row with `_hot`, a map from the hash of each hot key of `df` to the pieces it should be split into.

    The keys are found by a frequent-items sketch, which is merged over the partitions, so nothing is shuffled but
    sketches. `counts` names a column with the rows of each key where `df` has one row per key already; they are exact.
    A key gets as many pieces as it would fill shuffle partitions.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = df.select(F.xxhash64(*on).alias("item"), F.lit(1).alias("rows") if counts is None else F.col(counts).alias("rows"))
    if counts is None:
        found = hashed.agg(F.expr(f"approx_top_k(item, {HOT_KEYS}, {TRACKED_KEYS})").alias("top"), F.count("*").alias("n"))
    else:
        share = F.col("rows") * HOT_KEYS
        total = hashed.agg(F.sum("rows").alias("n"))
        hot = hashed.crossJoin(F.broadcast(total)).where(share > F.col("n"))  # a row; the rest is gone before the list
        found = hot.agg(
            F.collect_list(F.struct("item", F.col("rows").alias("count"))).alias("top"), F.max("n").alias("n"))
    large = F.filter("top", lambda x: (x["count"] * HOT_KEYS > F.col("n")) & (x["count"] > 1))
    entry = lambda x: F.struct(
        x["item"], F.least(F.ceil(x["count"] * partitions / F.col("n")), x["count"]).cast("int"))
    return found.select(F.map_from_entries(F.transform(large, entry)).alias("_hot"))


def heavy_join(
    big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", spread: Sequence[str] | None = None,
    heat: DataFrame | None = None,
) -> DataFrame:
    """Join `big` with a side that has one row (or few) per key; only hot keys of `big` are split, and copied in `small`.

    All copies together are at most the number of shuffle partitions and HOT_KEYS more. `heat` is what `hot_keys` gives, to
    be passed where it is known more cheaply than from the keys of `big`; it is one row, hence the broadcast. `spread` names
    the columns of `big` whose hash picks the piece; by default all of them. NULL keys can be hot and match nothing.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how!r}")
    heat = F.broadcast(hot_keys(big, on) if heat is None else heat)
    kinds = dict(big.dtypes)  # keys of another type have to be hashed as those of `big`
    pieces_of = F.coalesce(F.try_element_at("_hot", F.xxhash64(*(F.col(c).cast(kinds[c]) for c in on))), F.lit(1))
    row = F.xxhash64(*[F.col(f"`{c}`") for c in spread or _hashable(big)])
    split = big.crossJoin(heat).withColumn("_piece", F.pmod(row, pieces_of).cast("int")).drop("_hot")
    copies = small.crossJoin(heat).withColumn(
        "_piece", F.explode(F.sequence(F.lit(0), pieces_of - 1))).drop("_hot")
    return split.join(copies, [*on, "_piece"], how).drop("_piece")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first `k` rows per group in `order` (a total order), optionally keeping the rank.

    Spark limits each input partition to k rows per group before a shuffle. The groups are first reduced in pieces, so
    no task sorts more than the pieces' survivors.
    """
    name = rank or "_rank"
    within = Window.partitionBy(*keys, "_piece").orderBy(*order)
    df = (
        df.withColumn("_piece", _piece(_hashable(df), pieces(df.sparkSession)))
        .withColumn("_piece_rank", F.row_number().over(within))
        .where(F.col("_piece_rank") <= k)
        .drop("_piece", "_piece_rank")
    )
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    limited = ranked.where(F.col(name) <= k)
    return limited if rank else limited.drop(name)


def lowest_share(df: DataFrame, keys: Sequence[str], priority: str, tie: Sequence[str], size: Column) -> DataFrame:
    """Per group the `size` rows with the lowest hex-string `priority`, where `size` may depend on the group count `n`.

    The priorities are uniform hashes: a histogram over their first hex digits gives the bucket in which the cut falls,
    and only the rows of that one bucket are ranked to find the last row that is kept. The rows themselves are then
    filtered against one threshold per group, without being sorted or shuffled.
    """
    keys, tie = list(keys), list(tie)
    bucket = F.conv(F.substring(priority, 1, RANK_DIGITS), 16, 10).cast("int")
    # keys and hashes only: a small part of the rows, and whatever computed them runs once for all steps below
    narrow = cut_lineage(df.select(*keys, priority, *tie).withColumn("_bucket", bucket), "priorities")
    histogram = narrow.groupBy(*keys, "_bucket").agg(F.count("*").alias("_rows"))
    totals = histogram.groupBy(*keys).agg(F.sum("_rows").alias("n")).select(
        *keys, "n", size.cast("long").alias("_size")).where("_size > 0")
    running = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        histogram.withColumn("_below", F.coalesce(F.sum("_rows").over(running), F.lit(0)))
        .join(totals.where("n > _size"), keys)
        .where((F.col("_below") < F.col("_size")) & (F.col("_below") + F.col("_rows") >= F.col("_size")))
        .select(*keys, F.col("_bucket").alias("_cut"), (F.col("_size") - F.col("_below")).alias("_need"))
    )
    heat = hot_keys(totals, keys, "n")
    edge = heavy_join(narrow, cut, keys, spread=tie, heat=heat).where(F.col("_bucket") == F.col("_cut"))
    last = (
        edge.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(priority, *tie)))
        .where(F.col("_rank") == F.col("_need"))
        .select(*keys, F.struct(priority, *tie).alias("_last"))
    )
    whole = totals.where("n <= _size").select(*keys)
    thresholds = cut_lineage(last.unionByName(whole, allowMissingColumns=True), "thresholds")
    row = F.struct(priority, *tie)
    return heavy_join(df, thresholds, keys, spread=tie, heat=heat).where(
        F.col("_last").isNull() | (row <= F.col("_last"))
    ).select(*df.columns)


def global_rank(df: DataFrame, order: Sequence[Column], rank: str = "position") -> DataFrame:
    """A 1-based rank over the whole table without a single-task sort.

    `order` has to be a total order. Rows are range-partitioned and written once to the shared folder; each range is
    ranked on its own and shifted by the row count of the ranges before it.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(partitions, *order).withColumn("_range", F.spark_partition_id())
    ranged = cut_lineage(ranged, "ranges")
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = counts.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    return (
        ranged.withColumn("_local", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
        .join(offsets, "_range")
        .withColumn(rank, (F.col("_offset") + F.col("_local")).cast("long"))
        .drop("_range", "_local", "_offset")
    )


def literal_rows(rows: Sequence[tuple], schema: Sequence[tuple[str, str]]) -> Column:
    """A small driver-side list (requests, rules) as one array-of-struct literal."""
    # one JSON literal, folded into a constant by the optimizer: cheaper to build than a literal per cell
    names = [name for name, _ in schema]
    text = json.dumps([dict(zip(names, row)) for row in rows], ensure_ascii=False)
    return F.from_json(F.lit(text), "array<struct<" + ",".join(f"`{n}`:{t}" for n, t in schema) + ">>")


def _piece(columns: Sequence[str], count: int) -> Column:
    """The piece of a row by the hash of `columns`; never NULL, so that no filter has to compute it a second time."""
    if count & (count - 1):
        raise ValueError("the number of pieces has to be a power of two")
    return F.xxhash64(*[F.col(f"`{c}`") for c in columns]).bitwiseAND(F.lit(count - 1).cast("long"))


def _hashable(df: DataFrame) -> list[str]:
    """Columns that xxhash64 accepts (maps and variants are not hashable)."""
    return [f.name for f in df.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
