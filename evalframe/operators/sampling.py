"""Deterministic sample selections. Seeded hashes take the place of shuffles, so a rerun picks the same rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from evalframe.functions import scores
from evalframe.operators.scale import lowest_share, top_k

PREREQUISITE_MARK = "_prereq_"
MEMORY_PREFIX = "memory_"


def priority(seed: int, *ids: Column) -> Column:
    """A uniform hex priority per row."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in ids]), 256)


def binary_label(metric_names: Column, values: Column) -> Column:
    """Right or wrong by the first binary metric a sample has; several attempts must all be right.

    `values` is MAP<STRING, ARRAY<DOUBLE>>: one number per attempt.
    """
    usable = F.filter(metric_names, lambda m: m.isin(scores.BINARY_METRICS) & (
        F.coalesce(F.size(F.try_element_at(values, m)), F.lit(0)) > 0))
    attempts = F.try_element_at(values, F.get(usable, F.lit(0)))
    mean = F.aggregate(attempts, F.lit(0.0), lambda a, v: a + v) / F.size(attempts)
    return mean == 1.0


def stratified_samples(
    samples: DataFrame, n_positive: int = 2, n_negative: int = 3, seed: int = 42,
    by: Sequence[str] = ("task",), id_column: str = "sample_id",
) -> DataFrame:
    """Per task `n_positive` right and `n_negative` wrong samples, a short side filled from the other.

    A task without any label gives that many samples at random. At most n_positive + n_negative rows per task and
    label are ever compared, which is all that either side can need.
    """
    wanted = n_positive + n_negative
    order = [priority(seed, F.col(id_column)), F.col(id_column)]
    first = top_k(samples, [*by, "is_correct"], order, wanted, rank="_rank")
    task = Window.partitionBy(*by)  # at most 3 * wanted rows by now
    right = F.count_if(F.col("is_correct")).over(task)
    wrong = F.count_if(~F.col("is_correct")).over(task)
    short = lambda have, want: F.greatest(F.lit(want) - have, F.lit(0))
    quota = (
        F.when(F.col("is_correct"), n_positive + short(wrong, n_negative))
        .when(~F.col("is_correct"), n_negative + short(right, n_positive))
        .when((right == 0) & (wrong == 0), wanted)
        .otherwise(0)
    )
    return first.withColumn("_quota", quota).where(F.col("_rank") <= F.col("_quota")).select(*samples.columns)


def capped_samples(
    samples: DataFrame, cap: int, by: Sequence[str] = ("task",), priority_column: str = "priority", order: str = "ord"
) -> DataFrame:
    """The `cap` rows with the lowest priorities per task, a null priority before all others, ties to the earlier row."""
    return top_k(samples, by, [F.col(priority_column), F.col(order)], cap)


def random_subset(rows: DataFrame, limit: float, by: Sequence[str], id_column: str, seed: int = 42) -> DataFrame:
    """A seeded subset per group: `limit` rows, or the share `limit` of them (rounded up) when it is below 1."""
    size = F.ceil(F.lit(float(limit)) * F.col("n")) if limit < 1 else F.lit(math.floor(limit))
    marked = rows.withColumn("_priority", priority(seed, F.col(id_column)))
    return lowest_share(marked, by, "_priority", [id_column], size).drop("_priority")


def first_n_with_prereqs(entries: DataFrame, n: int) -> DataFrame:
    """The first n questions of a category and, before them, the prerequisites of their scenarios.

    `entries` has category, ord and id; `is_prereq` is added. Ids read like memory_kv_0-customer-0.
    """
    marked = entries.withColumn("is_prereq", F.contains("id", F.lit(PREREQUISITE_MARK))).withColumn(
        "scenario", F.get(F.split("id", "-"), F.lit(1))
    )
    questions = top_k(marked.where("NOT is_prereq"), ["category"], [F.col("ord")], n)
    scenarios = questions.where(F.startswith("id", F.lit(MEMORY_PREFIX))).select("category", "scenario").distinct()
    needed = marked.where("is_prereq").join(scenarios, ["category", "scenario"], "left_semi")
    return needed.select(*marked.columns).unionByName(questions).drop("scenario")


def explode_attempts(samples: DataFrame) -> DataFrame:
    """One row per attempt of a repeated sample, with its own id, metric values and responses.

    `values` is MAP<STRING, ARRAY<DOUBLE>> and responses are ARRAY<ARRAY<STRING>> (request, attempt). Samples without
    `repeat_indices` stay one row.
    """
    repeated = F.col("repeat_indices").isNotNull()
    indices = F.coalesce("repeat_indices", F.array(F.lit(None).cast("int")))
    # the list position is the logged index itself
    at = lambda c: F.get(c, F.col("repeat_index"))
    one = lambda name: F.transform(F.col(name), lambda r: F.when(repeated, F.array(at(r))).otherwise(r))
    exploded = samples.withColumn("repeat_index", F.explode(indices))
    return exploded.withColumns({
        "doc_id": F.when(repeated, F.concat(F.col("doc_id").cast("string"), F.lit("/repeat-"), F.col("repeat_index")))
                   .otherwise(F.col("doc_id").cast("string")),
        "values": F.transform_values("values", lambda k, v: F.when(repeated, F.array(at(v))).otherwise(v)),
        "resps": one("resps"),
        "filtered_resps": one("filtered_resps"),
    }).drop("repeat_indices")
