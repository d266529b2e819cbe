"""The corpus pipeline: stages over the documents, each on what the one before kept, written as Parquet in between.

Rows with nulls, empty and repeated texts go through every stage by the rules of its operator. Documents that the quality
sample leaves out go; of each group of near duplicates (five words, similarity 0.8) the document with the smallest id
stays; documents that hold a benchmark item go; personal data and the terms that reveal it are replaced in the texts that
are left; and these are packed into sequences. All stages but the last return the columns that they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evalframe.llm import packing, prefix_tree, private_terms, quality, templates
from evalframe.llm.shared import written

GOOD = "quality = 1 AND toxic = 0"
WORDS, SIMILARITY = 5, (4, 5)
TOKENIZER, END, SEQUENCE = "byte_bpe_50k.json", 0, 1024


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, "doc_id", "text", GOOD)
    return quality.kept(docs, "doc_id", "text", model)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return prefix_tree.one_of_each(docs, "doc_id", "text", WORDS, *SIMILARITY)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    held = templates.contaminated(docs, "doc_id", "text", items, "item_id", "text", inside=True)
    return docs.join(held.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = private_terms.sanitised(docs, "doc_id", "text")
    if "n_chars" in clean.columns:
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = written(packing.pieces(docs, "doc_id", "text", TOKENIZER, END, SEQUENCE), "pieces")
    return packing.packed(cut, SEQUENCE)


STAGES = [
    ("quality", keep_good),
    ("near-duplicates", keep_one_of_each),
    ("decontamination", drop_benchmark),
    ("private", sanitise),
    ("packing", pack),
]

ORACLE_SQL = None  # the stages cannot be written in SQL; tests/llm compares them with plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the table of documents; what the last returns is the result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
