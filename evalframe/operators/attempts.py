"""Trials, simulations and repeated attempts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from evalframe.functions import scores, text
from evalframe.operators.scale import top_k

# A reward counts as a success within this distance of 1.
SUCCESS_TOLERANCE = 1e-6
NO_REWARD_FILE = "RewardFileNotFoundError"


def is_success(reward: Column) -> Column:
    return F.abs(reward - 1.0) <= SUCCESS_TOLERANCE


def all_pass_ratio(successes: Column, trials: Column, k: Column) -> Column:
    """C(c, k) / C(n, k): the chance that k of n trials drawn at random all succeeded."""
    return F.aggregate(
        F.sequence(F.lit(0).cast("long"), k.cast("long") - 1), F.lit(1.0),
        lambda done, i: done * F.greatest(successes - i, F.lit(0)) / (trials - i),
    )


def any_pass_ratio(successes: Column, trials: Column, k: Column) -> Column:
    """1 - C(n - c, k) / C(n, k): the chance that at least one of k trials succeeded."""
    return 1.0 - all_pass_ratio(trials - successes, trials, k)


def pass_hat_k(trials: DataFrame, num_trials: int, by: Sequence[str] = ("domain",)) -> DataFrame:
    """pass^k for k = 1..num_trials: mean over the tasks with at least k trials."""
    per_task = trials.groupBy(*by, "task_id").agg(
        F.count("*").alias("n"), F.count_if(is_success(F.col("reward"))).alias("c")
    )
    return (
        per_task.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(num_trials), F.col("n").cast("int")))).alias("k"))
        .groupBy(*by, "k")
        .agg(F.avg(all_pass_ratio(F.col("c"), F.col("n"), F.col("k"))).alias("score"))
    )


def mark_simulations(sims: DataFrame) -> DataFrame:
    """Adds `cause`: why the model is to blame for a simulation without reward."""
    cause = text.failure_cause(*[F.col(c) for c in ("termination_reason", "error", "error_type", "error_traceback")])
    return sims.withColumn("cause", F.when(F.col("reward").isNull(), cause))


def simulation_summary(
    sims: DataFrame, num_trials: int, by: Sequence[str] = ("domain",), expected: int | None = None
) -> DataFrame:
    """(by, metric, score): rewards, pass^k, counts, and the same scores without the model's own failures.

    A failure of the model counts as reward 0; other simulations without reward are left out and counted.
    Everything follows from one aggregate per task.
    """
    reward, cause = F.col("reward"), F.col("cause")
    per_task = mark_simulations(sims).groupBy(*by, "task_id").agg(
        F.count(reward).alias("scored"),
        F.count(cause).alias("failed"),
        F.count_if(cause == "empty_reply").alias("empty"),
        F.count_if(reward.isNull() & cause.isNull()).alias("unscored"),
        F.count_if(is_success(reward)).alias("c"),
        F.coalesce(F.sum("reward"), F.lit(0.0)).alias("rewards"),
    ).withColumn("n", F.col("scored") + F.col("failed"))
    c, n, scored = F.col("c"), F.col("n"), F.col("scored")
    ks = [F.lit(k).cast("long") for k in range(1, num_trials + 1)]
    sums = per_task.groupBy(*by).agg(
        F.count_if(n > 0).alias("tasks"),
        *[F.sum(name).alias(f"sum_{name}") for name in ("n", "scored", "failed", "empty", "unscored", "rewards")],
        *[F.avg(F.when(n >= k, all_pass_ratio(c, n, k))).alias(f"all_{i}") for i, k in enumerate(ks, 1)],
        *[F.avg(F.when(scored >= k, all_pass_ratio(c, scored, k))).alias(f"own_{i}") for i, k in enumerate(ks, 1)],
    )
    total = lambda name: F.col(f"sum_{name}")
    split = (total("failed") > 0) & (total("scored") > 0)
    values = {
        "avg_reward": F.try_divide(total("rewards"), total("n")),
        "n_tasks": F.col("tasks"),
        "n_simulations": total("n"),
        "n_agent_failures": total("failed"),
        "n_empty_replies": total("empty"),
        "n_context_overflows": total("failed") - total("empty"),
        "n_unscored": total("unscored"),
        "avg_reward_excluding_agent_failures": F.when(split, F.try_divide(total("rewards"), total("scored"))),
    }
    for k in range(1, num_trials + 1):
        values[f"pass^{k}"] = F.col(f"all_{k}")
        values[f"pass^{k}_excluding_agent_failures"] = F.when(split, F.col(f"own_{k}"))
    if expected is not None:
        values["n_missing"] = F.greatest(F.lit(expected) - total("n") - total("unscored"), F.lit(0))
    return sums.select(*by, F.explode(F.array(*[
        F.struct(F.lit(name).alias("metric"), value.cast("double").alias("score")) for name, value in values.items()
    ])).alias("m")).select(*by, "m.*").where("score IS NOT NULL")


def zero_missing_reward(trials: DataFrame, no_reward_file: DataFrame) -> DataFrame:
    """Trials listed as having no reward file become failed trials with reward 0."""
    listed = no_reward_file.select("benchmark", "trial_name", F.lit(True).alias("_zero")).distinct()
    return trials.join(listed, ["benchmark", "trial_name"], "left").withColumn(
        "rewards", F.when(F.col("_zero"), F.create_map(F.lit("reward"), F.lit(0.0))).otherwise(F.col("rewards"))
    ).drop("_zero")


def _classified(trials: DataFrame, missing_reward_is_zero: bool) -> DataFrame:
    """Rewards after the missing-file rule, whether a trial was scored, and the error type of the others."""
    has_rewards = F.coalesce(F.cardinality("rewards") > 0, F.lit(False))
    zeroed = F.lit(missing_reward_is_zero) & ~has_rewards & F.coalesce(
        F.col("exception_type") == NO_REWARD_FILE, F.lit(False)
    )
    return (
        trials.withColumn("scored", has_rewards | zeroed)
        .withColumn("rewards", F.when(zeroed, F.create_map(F.lit("reward"), F.lit(0.0))).otherwise(F.col("rewards")))
        .withColumn("error_type", F.when(~F.col("scored"), F.coalesce("exception_type", F.lit("no reward"))))
    )


def trial_summary(trials: DataFrame, missing_reward_is_zero: bool = False) -> DataFrame:
    """Per benchmark mean_reward, n_trials, n_scored and n_errors.

    A scored trial without a `reward` counts 0; with no `reward` anywhere the mean is NULL.
    """
    reward = F.try_element_at("rewards", F.lit("reward"))
    return _classified(trials, missing_reward_is_zero).groupBy("benchmark").agg(
        F.when(F.count(F.when(F.col("scored"), reward)) > 0,
               F.avg(F.when(F.col("scored"), F.coalesce(reward, F.lit(0.0))))).alias("mean_reward"),
        F.count("*").alias("n_trials"),
        F.count_if("scored").alias("n_scored"),
        F.count_if(~F.col("scored")).alias("n_errors"),
    )


def reward_means(trials: DataFrame, missing_reward_is_zero: bool = False) -> DataFrame:
    """(benchmark, metric, score): mean of each named reward over the trials that have it."""
    return (
        _classified(trials, missing_reward_is_zero).where("scored")
        .select("benchmark", F.explode("rewards").alias("metric", "value"))
        .groupBy("benchmark", "metric").agg(F.avg("value").alias("score"))
    )


def errors_by_type(trials: DataFrame, missing_reward_is_zero: bool = False) -> DataFrame:
    return (
        _classified(trials, missing_reward_is_zero).where("NOT scored")
        .groupBy("benchmark", "error_type").agg(F.count("*").alias("n"))
    )


def trial_metrics(summary: DataFrame, rewards: DataFrame, pass_at_k: DataFrame | None = None) -> DataFrame:
    """Metric rows of a benchmark: named rewards (else the old mean_reward), pass@k and the trial counts."""
    old = summary.join(rewards, "benchmark", "left_anti").where("mean_reward IS NOT NULL").select(
        "benchmark", F.lit("reward").alias("metric"), F.col("mean_reward").alias("score")
    )
    counts = summary.select("benchmark", F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("score"))
        for c in ("n_trials", "n_scored", "n_errors")
    ])).alias("m")).select("benchmark", "m.*")
    rows = rewards.unionByName(old).unionByName(counts)
    if pass_at_k is not None:
        rows = rows.unionByName(pass_at_k.select(
            "benchmark", F.concat(F.lit("pass@"), F.col("k").cast("string")).alias("metric"), "score"))
    return rows


def _cut(text: Column, chars: int | None) -> Column:
    return text if chars is None else F.left(text, F.lit(chars))


def summarize_trial(trials: DataFrame, message_chars: int | None = None) -> DataFrame:
    """Trial rows, messages cut after `message_chars` if given; a 0/1 reward also becomes the pass@1 label."""
    reward = F.try_element_at("rewards", F.lit("reward"))
    message = _cut(F.coalesce("exception_message", F.lit("")), message_chars)
    seconds = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1_000_000
    return trials.select(
        "benchmark", F.col("task_name").alias("task"), F.col("trial_name").alias("trial"), "rewards",
        F.when(F.col("exception_type").isNotNull(), F.concat("exception_type", F.lit(": "), message)).alias("error"),
        "n_input_tokens", "n_output_tokens",
        seconds.cast("long").alias("duration_sec"),
        F.when(reward.isin(0.0, 1.0), reward).alias("pass@1"),
    )


def run_duration(spans: DataFrame, by: Sequence[str]) -> DataFrame:
    """Whole seconds from the first start to the last end, 0 if unknown."""
    micros = F.unix_micros(F.max("ended_at")) - F.unix_micros(F.min("started_at"))
    return spans.groupBy(*by).agg(F.coalesce(F.floor(micros / 1_000_000), F.lit(0)).alias("duration_sec"))


def chunk_durations(chunks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sum of the whole-number durations and the number of chunks without one. `content` is the file's text."""
    clean = F.regexp_replace("content", r"\s+", "")
    valid = F.coalesce(clean.rlike("^[0-9]+$"), F.lit(False))
    return chunks.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(valid, clean.try_cast("long"))), F.lit(0)).alias("duration_sec"),
        F.count_if(~valid).alias("n_missing"),
    )


def report_metrics(reports: DataFrame, errors: DataFrame) -> DataFrame:
    """Per (model, dataset): n_samples as the largest metric count, n_errors as distinct errored instances."""
    sizes = reports.groupBy("model", "dataset").agg(F.coalesce(F.max("num"), F.lit(0)).alias("n_samples"))
    failed = errors.groupBy("model", "dataset").agg(F.count_distinct("instance").alias("n_errors"))
    return sizes.join(failed, ["model", "dataset"], "left").withColumn("n_errors", F.coalesce("n_errors", F.lit(0)))


def repeat_means(attempts: DataFrame, ks: Sequence[int], by: Sequence[str] = ("task",)) -> DataFrame:
    """mean@m and pass@k per task from 0/1 attempts of each document; m is the smallest and largest attempt count."""
    per_doc = attempts.groupBy(*by, "doc_id").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.count_if(is_success(F.col("value"))).alias("c")
    )
    passes = [
        F.avg(F.when(F.col("n") >= k, any_pass_ratio(F.col("c"), F.col("n"), F.lit(k)))).alias(f"pass_at_{k}")
        for k in ks
    ]
    return per_doc.groupBy(*by).agg(
        F.avg("mean").alias("mean_repeats"), F.min("n").alias("min_repeats"), F.max("n").alias("max_repeats"), *passes
    )


def append_error_samples(
    selected: DataFrame, unscored: DataFrame, n_errors: int, by: Sequence[str], order: Sequence[Column]
) -> DataFrame:
    """The selection plus the first `n_errors` unscored rows per group, without a label."""
    extra = top_k(unscored, by, order, n_errors).withColumn("is_correct", F.lit(None).cast("boolean"))
    return selected.unionByName(extra.select(*selected.columns))


def summarize_review(
    reviews: DataFrame, message_chars: int | None = None, patch_chars: int | None = None, failed_tests: int | None = None,
) -> DataFrame:
    """Review rows, cut where a length is given. An instance whose evaluation failed keeps no `acc`: the failure is not the model's."""
    acc = F.try_element_at("value", F.lit("acc"))
    failed = text.is_evaluation_error(F.col("completed"), F.col("error"))
    return reviews.select(
        "model", "file", "instance", "repo", "resolved", "tests.tests_passed", "tests.tests_required",
        (F.col("tests.failed_tests") if failed_tests is None else F.slice("tests.failed_tests", 1, failed_tests)).alias("failed_tests"),
        _cut(F.col("error"), message_chars).alias("error"), "n_input_tokens", "n_output_tokens",
        _cut(F.coalesce("patch", F.lit("")), patch_chars).alias("patch"),
        F.when(~failed & acc.isin(0.0, 1.0), acc).alias("acc"),
    )


def summarize_log_samples(samples: DataFrame, by: Sequence[str]) -> DataFrame:
    """Scorer values, explanations and the usable metric names of log samples; transcripts are left out.

    `scores` is ARRAY<STRUCT<scorer, value, explanation>>.
    """
    named = lambda field: F.map_from_entries(F.filter(
        F.transform("scores", lambda s: F.struct(s["scorer"].alias("key"), field(s).alias("value"))),
        lambda e: F.coalesce(e["value"].cast("string") != "", F.lit(False)),
    ))
    value = lambda s: scores.categorical_score(s["value"])
    return samples.select(
        *by, named(value).alias("values"), named(lambda s: s["explanation"]).alias("explanations"),
        F.transform(F.filter("scores", lambda s: value(s).isNotNull()), lambda s: s["scorer"]).alias("metrics"),
    )
