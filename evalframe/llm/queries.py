"""One query for each operator over its whole table, with the columns that its contract names."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from evalframe.llm import (
    alignment, bloom_search, chat, oracles, packing, prefix_tree, private_terms, quality, sharding, simhash, suffix_dedup, templates, token_files, topk,
)
from evalframe.llm.registry import query, table
from evalframe.llm.shared import written

SHARDS = 40


@query("op10_virtual_slots")
def op10_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `bytes`: version 1 of the map, made from version 0 by the bytes of the slots."""
    placed = written(sharding.slotted(table(spark, sf_dir, "documents"), "doc_id", "text"), "slots")
    first = sharding.first_map(sharding.slot_sizes(placed), SHARDS)
    slot_map = written(sharding.rebalanced(written(first, "slot-map-0"), SHARDS), "slot-map-1")
    return sharding.assigned(placed, slot_map).select(
        F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("place").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )


@query("op7_exact_top_k", oracles.TOP_K)
def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 1024)
    asked = vectors.where(F.col("id") % 100 == 0).groupBy("id").agg(F.min("vector").alias("vector"))
    return topk.top_k(asked, vectors, 10).select(
        "query_id", "rank", F.col("id").alias("vec_id"), "score")


TOKENIZER = "byte_bpe_50k.json"


@query("op6_token_files")
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_tokens(table(spark, sf_dir, "documents"), "doc_id", "text", TOKENIZER, end=2)
    return token_files.read_digests(files)


@query("op5_cutting_stock")
def op5_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"), "doc_id", "text", TOKENIZER, end=0, size=1024)
    return packing.packed(written(cut, "pieces"), 1024)


PROBE = "</s>[INST] ok [/INST]"


@query("op4_chat_format", oracles.CHAT)
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's rows come in the layout of turn rows, conversation -7 in that of messages."""
    fields = F.struct("conv_id", "turn", "role", "text")
    rows = table(spark, sf_dir, "conversations").select(F.to_json(fields, {"ignoreNullFields": "false"}).alias("record"))
    messages = [{"role": role, "content": PROBE} for role in ("user", "assistant")]
    probe = spark.createDataFrame([(json.dumps({"id": -7, "messages": messages}),)], "record string")
    turns = chat.canonical_turns(rows.unionByName(probe), "record").where("layout IS NOT NULL")
    return chat.read_back(written(chat.formatted(turns), "chat"))


GOOD = "quality = 1 AND toxic = 0"


@query("op9_importance_resampling")
def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the sample keeps."""
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "text", GOOD)
    return model.sample().select(F.col("key").alias("doc_id"), "log_weight", "place")


@query("op8_prefix_tree_join", oracles.JACCARD)
def op8_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_tree.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", 4, 85, 100)


@query("op3_template_windows")
def op3_template_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, with the item."""
    return templates.contaminated(
        table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text",
        inside=True)


@query("op2_private_terms")
def op2_private_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_terms.spans(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.deduplicated(table(spark, sf_dir, "documents"), "doc_id", "text", keep_text=False)
    return found.select(F.col("key").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op11_simhash_trees")
def op11_simhash_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", width=4)


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned_documents(
        table(spark, sf_dir, "documents"), "doc_id", "text", "byte_bpe_50k.json", "piece_bpe_32k.model")


@query("op13_bloom_search", oracles.SEARCH)
def op13_bloom_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_search.top_documents(
        table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text", 10)
