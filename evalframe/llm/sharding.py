"""Sharding over fixed virtual slots with a versioned slot-to-shard map.

A record's slot is a hash of its key modulo a fixed number of slots, whatever the number of shards. Bytes are aggregated
per slot; a map names the shard of every slot. Rebalancing edits the map, never the slots: it writes a new version in
which every shard keeps its largest slots up to an equal share of the bytes and hands the rest to the shards with the
least. Only sizes per slot, a table of fixed length, are ever gathered.

Nulls: a null key hashes its record's check sum instead, a null text has no bytes and the check sum 0. Repeated rows are
rows of their own. An empty table gives a map without bytes and no records. Input columns other than the key and the text
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SLOTS = 4096
OVERHEAD = 16  # bytes counted for a record besides its text
CELLS = 64  # pieces of a slot whose records are numbered on their own


def slotted(records: DataFrame, key: str, text: str, slots: int = SLOTS) -> DataFrame:
    """key, size, text_crc32, virtual_slot and cell (a piece of the slot) of every record; texts are read only here."""
    content = F.coalesce(F.col(text), F.lit(""))
    sized = records.select(
        F.col(key).alias("key"),
        (F.octet_length(content) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
    )
    hashed = F.xxhash64(F.coalesce(F.col("key").cast("string"), F.concat(F.lit("null "), F.col("text_crc32"))))
    return sized.withColumn("_hash", hashed).select(
        "key", "size", "text_crc32", F.pmod("_hash", F.lit(slots)).cast("int").alias("virtual_slot"),
        F.pmod(F.shiftright("_hash", 32), F.lit(CELLS)).cast("int").alias("cell"),
    )


def slot_sizes(placed: DataFrame, slots: int = SLOTS) -> DataFrame:
    """virtual_slot, bytes, records: one row for every slot, empty ones included."""
    spark = placed.sparkSession
    sums = placed.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("records"))
    every = spark.range(0, slots, 1, 1).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(sums, "virtual_slot", "left").fillna(0, ["bytes", "records"])


def first_map(sizes: DataFrame, shards: int) -> DataFrame:
    """Version 0: version, virtual_slot, shard, bytes, with slots dealt in turn."""
    return sizes.select(
        F.lit(0).alias("version"), "virtual_slot", (F.col("virtual_slot") % shards).cast("int").alias("shard"), "bytes")


def rebalanced(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version of a map for `shards` shards (0 to shards-1), near equal in bytes, with few slots moved.

    The largest slots of a shard stay while they fit into an equal share; the others, and those of shards that are no
    more, go one by one, largest first, to the shard that then has the least. The map has a fixed number of rows, so the
    edit is one expression over one array.
    """
    total = slot_map.agg(F.sum("bytes").alias("_total"))
    order = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
    filled = F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = slot_map.withColumn("_filled", filled).crossJoin(total).withColumn(
        "_stays", (F.col("shard") < shards) & (F.col("_filled") * shards <= F.col("_total")))
    loads = marked.where("_stays").groupBy("shard").agg(F.sum("bytes").alias("_load"))
    moved = F.sort_array(F.collect_list(F.when(~F.col("_stays"), F.struct(
        (-F.col("bytes")).alias("minus"), "virtual_slot"))))
    gathered = marked.agg(moved.alias("_moved"), F.max("version").alias("_version"))
    base = loads.agg(F.map_from_entries(F.collect_list(F.struct("shard", "_load"))).alias("_loads"))
    start = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(
        F.coalesce(F.element_at("_loads", s), F.lit(0).cast("long")).alias("load"), s.alias("shard")))

    def place(state: Column, slot: Column) -> Column:
        def onto(least: Column) -> Column:
            return F.struct(
                F.transform(state["loads"], lambda x: F.struct(
                    (x["load"] + F.when(x["shard"] == least["shard"], -slot["minus"]).otherwise(0)).alias("load"),
                    x["shard"].alias("shard"))).alias("loads"),
                F.concat(state["shards"], F.array(least["shard"])).alias("shards"),
            )

        return F.transform(F.array(F.array_min(state["loads"])), onto)[0]  # the least is found once per slot

    dealt = gathered.crossJoin(base).select("_version", "_moved", F.aggregate(
        "_moved", F.struct(start.alias("loads"), F.array().cast("array<int>").alias("shards")), place)["shards"].alias("_to"))
    news = dealt.select("_version", F.explode_outer(F.arrays_zip("_moved", "_to")).alias("_m")).select(
        (F.col("_version") + 1).alias("_next"), F.col("_m._moved.virtual_slot").alias("virtual_slot"), F.col("_m._to").alias("_to"))
    return slot_map.select("version", "virtual_slot", "shard", "bytes").join(
        news.select("virtual_slot", "_to"), "virtual_slot", "left").select(
        (F.col("version") + 1).alias("version"), "virtual_slot", F.coalesce("_to", "shard").alias("shard"), "bytes")


def assigned(placed: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Every record with its shard and its gapless place in the shard.

    Places are numbered inside cells, pieces of a slot, and shifted by the counts of the shard's cells before; the counts
    per cell are a table of fixed length.
    """
    shard_of = slot_map.select("virtual_slot", "shard")
    counts = placed.groupBy("virtual_slot", "cell").agg(F.count("*").alias("_n")).join(shard_of, "virtual_slot")
    before = Window.partitionBy("shard").orderBy("virtual_slot", "cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy("virtual_slot", "cell").orderBy("key", "text_crc32", "size")
    return placed.withColumn("_place", F.row_number().over(within)).join(offsets, ["virtual_slot", "cell"]).select(
        "key", "size", "text_crc32", "virtual_slot", "shard", (F.col("_before") + F.col("_place") - 1).cast("long").alias("place"))
