"""From raw result fields to a long metric table.

Raw results have the columns model, task, key, raw (STRING); more key columns such as a run are carried along.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from evalframe.functions import scores

ID = ("model", "task")


def parse_metrics(raw: DataFrame) -> DataFrame:
    """Readable scores of the raw fields: adds metric, filter and score."""
    return (
        raw.withColumn("score", scores.parse_score(F.col("key"), F.col("raw")))
        .where(F.col("score").isNotNull())
        .withColumn("metric", scores.metric_of(F.col("key")))
        .withColumn("filter", scores.filter_of(F.col("key")))
        .drop("raw")
    )


def unreadable_fields(raw: DataFrame) -> DataFrame:
    """The fields `parse_metrics` had to skip although they are no known metadata."""
    return raw.where(scores.is_unreadable(F.col("key"), F.col("raw")))


def promote_single_filter(metrics: DataFrame, by: Sequence[str] = ID) -> DataFrame:
    """Metric names as they are stored: `metric` without a filter, `metric,filter` with one.

    A base name that a task has under exactly one filter is stored under its bare name as well.
    """
    named = metrics.withColumn("name", F.when(F.col("filter") == "none", F.col("metric")).otherwise(F.col("key")))
    single = (
        metrics.where(F.col("filter") != "none")
        .groupBy(*by, "metric")
        .agg(F.count("*").alias("_filters"), F.max("score").alias("score"))
        .where("_filters = 1")
        .select(*by, F.col("metric").alias("name"), "score")
    )
    return named.select(*by, "name", "score").unionByName(single)


def flatten_metrics(named: DataFrame, order: str, by: Sequence[str] = ("model",)) -> DataFrame:
    """`task/metric` keys per model; of duplicate keys the last one in `order` wins."""
    keyed = named.withColumn("key", F.concat_ws("/", "task", "name"))
    return keyed.groupBy(*by, "key").agg(F.max_by("score", order).alias("score"))


def numeric_metrics(raw: DataFrame) -> DataFrame:
    """Fields an export may publish. `json_type` has to hold the JSON type of the field."""
    return raw.withColumn("score", F.col("raw").try_cast("double")).where(
        scores.is_exportable(F.col("key"), F.col("json_type"), F.col("score"))
    )


def has_scores(cells: DataFrame) -> DataFrame:
    """Models with at least one score."""
    return cells.groupBy("model").agg(F.max("score").alias("_best")).where(F.col("_best").isNotNull()).select("model")
