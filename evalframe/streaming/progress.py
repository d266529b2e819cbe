"""Progress of a running evaluation from its growing review files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evalframe import schemas
from evalframe.sources.growing import growing_lines

# Fixed value: seconds between two progress reports.
INTERVAL_SECONDS = 120


def review_scores(lines: DataFrame, key: Column) -> DataFrame:
    """(key, passed, failed) per scored review line; a half-written last line has no score and is skipped.

    Passed: the first metric is 1. Failed: the scoring itself did not succeed. A wrong answer is neither.
    """
    score = F.from_json("value", schemas.REVIEW)["sample_score"]["score"]
    values = F.map_values(score["value"])
    return lines.select(
        key.alias("key"), score.isNotNull().alias("_scored"),
        F.coalesce(F.get(values, F.lit(0)) == 1, F.lit(False)).alias("passed"),
        (F.coalesce(score["status"], F.lit("success")) != "success").alias("failed"),
    ).where("_scored").drop("_scored")


def progress(reviews: DataFrame) -> DataFrame:
    """Running done, passed and failed per review file."""
    return reviews.groupBy("key").agg(
        F.count("*").alias("done"), F.count_if("passed").alias("passed"), F.count_if("failed").alias("failed")
    )


def file_key(path: Column) -> Column:
    """`model/dataset_subset` of a review file; segments of a growing file lie in a directory of that name."""
    inner = F.regexp_extract(path, r"reviews/([^/]+/[^/]+)", 1)
    return F.regexp_replace(inner, r"\.jsonl.*$", "")


def read_review_stream(
    spark: SparkSession, root: str, since: float | None = None, idle: float = INTERVAL_SECONDS
) -> DataFrame:
    """A stream of the review lines below `root`, of files changed at or after `since` (epoch seconds).

    Files may grow in place or arrive as segments; a last line without a line feed counts when its file is left alone for
    `idle` seconds.
    """
    lines = growing_lines(spark, root, pattern=r"reviews/[^/]+/.*\.jsonl", since=since or 0, idle=idle)
    return review_scores(lines, file_key(F.col("path")))


def start_progress(
    spark: SparkSession, root: str, sink: str, checkpoint: str, once: bool = False, since: float | None = None,
    idle: float = INTERVAL_SECONDS,
):
    """Follow the reviews below `root`: every trigger adds to `sink` one row for each file that has new lines.

    A trigger writes what came in, never what was known before, to a path of its own that a repeated trigger overwrites. So
    no counts are kept as state, and there is none to expire.
    """
    def add(batch: DataFrame, number: int) -> None:
        progress(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = read_review_stream(spark, root, since, idle).writeStream.option("checkpointLocation", checkpoint).foreachBatch(add)
    trigger = {"availableNow": True} if once else {"processingTime": f"{INTERVAL_SECONDS} seconds"}
    return writer.trigger(**trigger).start()


def latest_progress(spark: SparkSession, sink: str) -> DataFrame:
    """The counts of all triggers together."""
    return spark.read.schema("key string, done long, passed long, failed long").parquet(sink).groupBy("key").agg(
        *(F.sum(c).alias(c) for c in ("done", "passed", "failed")))
