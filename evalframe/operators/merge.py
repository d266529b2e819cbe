"""Partial and repeated runs merged by their different "newest wins" rules.

`part` is a number that grows from the oldest to the newest part of a run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from evalframe.operators.scale import heavy_join, hot_keys


def latest_task_wins(entries: DataFrame, by: Sequence[str] = ("model", "section", "task"), part: str = "part") -> DataFrame:
    """The newest part that has a task in a section replaces the task's whole entry there."""
    return _newest(entries, entries.groupBy(*by).agg(F.max(part).alias("_last"), F.count("*").alias("_rows")), by, part)


def _newest(rows: DataFrame, last: DataFrame, by: Sequence[str], part: str) -> DataFrame:
    """The rows of the part `_last` of their key; `_rows` counts the key's rows, which tells the hot keys."""
    joined = heavy_join(rows, last.select(*by, "_last"), by, heat=hot_keys(last, by, "_rows"))
    return joined.where(F.col(part) == F.col("_last")).drop("_last")


def current_protocols(protocols: DataFrame, results: DataFrame, by: Sequence[str] = ("model", "task")) -> DataFrame:
    """Repeat protocols that still hold: a later part with results but without a protocol drops the older one."""
    newest = results.groupBy(*by).agg(F.max("part").alias("_last"))
    kept = protocols.join(newest, list(by), "left").where(F.col("_last").isNull() | (F.col("part") >= F.col("_last")))
    return latest_task_wins(kept.drop("_last"), by)


def replace_repeat_history(attempts: DataFrame, results: DataFrame, by: Sequence[str] = ("model", "task")) -> DataFrame:
    """A rerun drops all older attempts of its tasks, also when it made fewer.

    Only the newest part of an attempt can be kept, so the parts are compared on one row per attempt.
    """
    attempt = [*by, "repeat_index"]
    newest = attempts.groupBy(*attempt).agg(F.max("part").alias("_last"), F.count("*").alias("_rows"))
    rerun = results.groupBy(*by).agg(F.max("part").alias("_rerun"))
    kept = newest.join(rerun, list(by), "left").where("_rerun IS NULL OR _last >= _rerun")
    return _newest(attempts, kept.select(*attempt, "_last", "_rows"), attempt, "part")


def latest_metric_wins(metrics: DataFrame, by: Sequence[str] = ("model", "task", "name"), run: str = "run") -> DataFrame:
    """Across whole runs: per metric name the newest score."""
    return metrics.groupBy(*by).agg(F.max_by("score", run).alias("score"))


def latest_samples_win(files: DataFrame, excluded: Sequence[str] = (), part: str = "part") -> DataFrame:
    """Per sample file name the newest part's copy; files of excluded tasks are skipped."""
    kept = files
    for task in excluded:
        kept = kept.where(~F.startswith("file", F.lit(f"samples_{task}_")))
    others = [c for c in files.columns if c not in ("model", "file")]
    return kept.groupBy("model", "file").agg(F.max_by(F.struct(*others), part).alias("_f")).select(
        "model", "file", "_f.*"
    )


def latest_run_by_name(runs: DataFrame, by: Sequence[str] = ("display_name",), created: Column | None = None) -> DataFrame:
    """The newest run per display name; equal times go to the larger run id."""
    order = created if created is not None else F.struct("created_at", "run_id")
    others = [c for c in runs.columns if c not in by]
    return runs.groupBy(*by).agg(F.max_by(F.struct(*others), order).alias("_r")).select(*by, "_r.*")


def task_prefixes(task: Column, separators: str = "_/") -> Column:
    """The task itself and every prefix of it that ends right before a separator."""
    cuts = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(task), F.lit(1))),
        lambda i: F.when(F.substring(task, i, F.lit(1)).isin(*separators), F.substring(task, F.lit(1), i - 1)),
    )
    return F.array_distinct(F.array_append(F.filter(cuts, lambda c: c.isNotNull()), task))


def tasks_below(tasks: DataFrame, excluded: DataFrame) -> DataFrame:
    """Distinct tasks that equal an excluded one or continue it after `_` or `/`; `tasks` has one row for each."""
    return (
        tasks.select("task", F.explode(task_prefixes(F.col("task"))).alias("_prefix"))
        .join(excluded.select(F.col("task").alias("_prefix")).distinct(), "_prefix", "left_semi")
        .select("task").distinct()
    )


def exclude_tasks(rows: DataFrame, excluded: DataFrame) -> DataFrame:
    """Rows whose task is not excluded. Prefixes are matched on the distinct task names by an equi-join."""
    names = rows.groupBy("task").agg(F.count("*").alias("_rows"))
    return heavy_join(rows, tasks_below(names, excluded), ["task"], "left_anti", heat=hot_keys(names, ["task"], "_rows"))


def exclude_listed(rows: DataFrame, excluded: Sequence[str]) -> DataFrame:
    """The same for a short list of names: a filter of the rows without any join."""
    task = F.col("task")
    for name in excluded:
        rows = rows.where(
            (task != name) & ~F.startswith(task, F.lit(f"{name}_")) & ~F.startswith(task, F.lit(f"{name}/"))
        )
    return rows


def completed_tasks(
    found: DataFrame, tasks: DataFrame, force_patterns: Sequence[str] = (), force_after: str | None = None
) -> DataFrame:
    """(task, dir): the newest directory with a result for each requested task.

    `found` has dir, dir_name and key for every key found in a directory's results. Forced tasks only count from
    `force_after` on; without it they never count.
    """
    # most keys are no tasks and a few of them are in every document
    wanted = tasks.select(F.col("task").alias("key")).distinct()
    hits = heavy_join(found, wanted, ["key"], "left_semi").withColumnRenamed("key", "task")
    forced = F.lit(False)
    for pattern in force_patterns:
        forced = forced | F.contains("task", F.lit(pattern))
    fresh = F.lit(False) if force_after is None else F.col("dir_name") >= force_after
    return hits.where(~forced | fresh).groupBy("task").agg(
        F.max_by("dir", F.struct("dir_name", "dir")).alias("dir")
    )


def missing_tasks(tasks: DataFrame, completed: DataFrame) -> DataFrame:
    """Requested tasks without a completed result."""
    return tasks.join(completed, "task", "left_anti")


def result_dirs(completed: DataFrame) -> DataFrame:
    """The distinct directories to merge."""
    return completed.select("dir").distinct()


def same_settings(runs: DataFrame, signature: str) -> DataFrame:
    """Runs made under exactly the requested settings."""
    return runs.where(F.col("signature") == signature)
