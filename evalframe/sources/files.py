"""Evaluation files as (path, value) tables: where files lie, not what they hold."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return pafs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", uri))


def text_files(spark: SparkSession, root: str, pattern: str, whole: bool = True) -> DataFrame:
    """(path, value) of the files below `root` whose name matches: whole documents or single lines."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return reader.text(root, wholetext=whole).select(F.col("_metadata.file_path").alias("path"), "value")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def wrong_result_counts(files: DataFrame, dirs: DataFrame | None = None) -> DataFrame:
    """(dir, n_files) of run directories that do not hold exactly one result file.

    `files` has dir and path. `dirs` adds directories that may hold none at all.
    """
    counts = files.where(file_name(F.col("path")).rlike(r"^results_.*\.json$")).groupBy("dir").agg(
        F.count("*").alias("n_files")
    )
    if dirs is not None:
        counts = dirs.select("dir").distinct().join(counts, "dir", "left").withColumn("n_files", F.coalesce("n_files", F.lit(0)))
    return counts.where("n_files <> 1")


def latest_sample_files(files: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per task the newest `samples_<task>_<timestamp>.jsonl`. The timestamp shape keeps `a` apart from `a_b`."""
    pattern = r"^samples_(.+)_(\d{4}-\d{2}-\d{2}T.+)\.jsonl$"
    name = file_name(F.col("path"))
    return (
        files.where(name.rlike(pattern))
        .select(*by, "path", F.regexp_extract(name, pattern, 1).alias("task"))
        .groupBy(*by, "task").agg(F.max("path").alias("path"))
    )


def discover_runs(files: DataFrame) -> DataFrame:
    """(model, run, run_ord): the run directories of each model, numbered from the oldest."""
    path = F.col("path")
    found = files.where(path.rlike(r"/harness/eval_[^/]+/")).select(
        F.regexp_extract(path, r"([^/]+)/harness/eval_[^/]+/", 1).alias("model"),
        F.regexp_extract(path, r"/harness/(eval_[^/]+)/", 1).alias("run"),
    ).distinct()
    runs = found.groupBy("model").agg(F.array_sort(F.collect_set("run")).alias("_runs"))  # directory names only
    return runs.select("model", F.posexplode("_runs").alias("run_ord", "run"))
