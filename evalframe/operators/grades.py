"""Judge verdicts, answer accuracy and thinking metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from evalframe.functions import scores, text
from evalframe.operators.scale import heavy_join, hot_keys

GRADES = ["C", "P", "I", "N"]


def grade_distribution(grades: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Index, hallucination rate, category shares, accuracy and standard error of C/P/I/N grades."""
    grade, n = F.col("grade"), F.count("*")
    value = scores.categorical_score(grade)
    of = {g: F.count_if(grade == g) for g in GRADES}
    wrong_or_open = of["P"] + of["I"] + of["N"]
    hallucination = F.coalesce(F.try_divide(of["I"].cast("double"), wrong_or_open.cast("double")), F.lit(0.0))
    deviation = F.when(n > 1, F.stddev_samp(value)).otherwise(0.0)
    return grades.groupBy(*by).agg(
        (100.0 * (of["C"] - of["I"]) / n).alias("index"),
        hallucination.alias("hallucination_rate"),
        (1.0 - hallucination).alias("non_hallucination_rate"),
        *[(of[g] / n).alias(f"share_{g}") for g in GRADES],
        F.avg(value).alias("accuracy"),
        (deviation / F.sqrt(n.cast("double"))).alias("stderr"),
        n.alias("n"),
    )


def pairwise_rates(verdicts: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Win and win-or-tie rate over all graded pairs, unparsed ones included; failed judge calls have no outcome."""
    outcome, n = F.col("outcome"), F.count("outcome")
    count = lambda *names: F.count_if(outcome.isin(*names))
    return verdicts.groupBy(*by).agg(
        n.alias("n_graded"),
        F.try_divide(count("win"), n).alias("win_rate"),
        F.try_divide(count("win", "tie"), n).alias("win_or_tie_rate"),
        count("tie").alias("ties"), count("loss").alias("losses"), count("unparsed").alias("unparsed"),
    )


def popularity_breakdown(answers: DataFrame, by: Sequence[str] = ("prop",)) -> DataFrame:
    """Accuracy by relation and by the power of ten of the subject's popularity."""
    decade = F.floor(F.log10(F.greatest(F.col("s_pop"), F.lit(1)).cast("double"))).cast("int")
    return answers.withColumn("decade", decade).groupBy(*by, "decade").agg(
        F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy")
    )


def thinking_means(responses: DataFrame, by: Sequence[str] = ("model",), unit: str = "chars") -> DataFrame:
    """Response length over all responses, thinking length over the well-formed ones only, and the format rates."""
    rate = lambda flag: F.avg(F.col(flag).cast("double"))
    return responses.groupBy(*by).agg(
        F.avg("response_length").alias(f"response_length_{unit}"),
        F.avg(F.when(F.col("format_correct"), F.col("thinking_length"))).alias(f"thinking_length_{unit}"),
        rate("has_open").alias("thinking_format_has_open"),
        rate("has_close").alias("thinking_format_has_close"),
        rate("format_correct").alias("thinking_format_correct"),
    )


def batches(submissions: DataFrame, size: int = 70, by: Sequence[str] = ("model", "epoch")) -> DataFrame:
    """Per attempt number how many submissions there are and whether the batch is complete."""
    return submissions.groupBy(*by).agg(F.count("*").alias("n_submissions")).withColumn(
        "complete", F.col("n_submissions") == size
    )


def complete_batches(submissions: DataFrame, size: int = 70, by: Sequence[str] = ("model", "epoch")) -> DataFrame:
    """One row per complete batch with its submissions. Groups are sized first, so none above `size` is collected."""
    sizes = batches(submissions, size, by)
    complete = sizes.where("complete").select(*by)
    payload = F.struct(*[c for c in submissions.columns if c not in by])
    heat = hot_keys(sizes, by, "n_submissions")
    return heavy_join(submissions, complete, by, "left_semi", heat=heat).groupBy(*by).agg(
        F.array_sort(F.collect_list(payload)).alias("submissions")
    )


def judge_texts(files: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, judge_text): a task's deliverables in order as the judge reads them.

    `files` has ord, name, content and size; a task without any file carries NULLs. The parts are cut before they are
    brought together, so a judge text holds at most the limit per deliverable.
    """
    part = text.judge_part(F.col("name"), F.col("content"), F.col("size"))
    return files.select(*by, F.when(F.col("name").isNotNull(), F.struct("ord", part.alias("part"))).alias("p")).groupBy(
        *by).agg(F.array_sort(F.collect_list("p")).alias("_parts")).select(
        *by, F.when(F.size("_parts") > 0, F.array_join(F.transform("_parts", lambda p: p["part"]), "\n\n")).otherwise(
            "(no deliverable files produced)").alias("judge_text"))
