"""Contents of evaluation files as typed tables. Each function takes a (path, value) table."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from evalframe import schemas
from evalframe.functions import samples as sample_fields
from evalframe.functions.let import keep, let
from evalframe.sources.files import directory, file_name, text_files, wrong_result_counts


def harness_documents(files: DataFrame) -> DataFrame:
    """The parsed sections of result files, one row per file."""
    return files.select("path", F.from_json("value", schemas.RESULTS).alias("r")).select("path", "r.*")


def harness_results(files: DataFrame) -> DataFrame:
    """(path, task, key, raw, json_type): every field of the `results` section."""
    tasks = harness_documents(files).select("path", F.explode("results").alias("task", "fields"))
    return tasks.select("path", "task", F.explode("fields").alias("key", "v")).select(
        "path", "task", "key", F.col("v").cast("string").alias("raw"), F.expr("schema_of_variant(v)").alias("json_type")
    )


def read_harness_results(spark: SparkSession, root: str) -> DataFrame:
    """The results below `root`, which has to hold exactly one result file."""
    files = text_files(spark, root, "results_*.json")
    wrong = wrong_result_counts(files.select(F.lit(root).alias("dir"), "path"), spark.range(1).select(F.lit(root).alias("dir")))
    found = wrong.first()
    if found:
        raise ValueError(f"expected exactly one results file below {root}, found {found['n_files']}")
    return harness_results(files)


def sample_lines(lines: DataFrame) -> DataFrame:
    """Typed harness samples; blank lines are skipped. `scores` holds each listed metric as its JSON text, so that text is
    told from numbers; `doc_id` is NULL for an id that is no number, `doc_key` is the id as text."""
    parsed = lines.select("path", "value", keep(F.try_parse_json("value")).alias("v"))  # blank lines are no JSON either
    typed = parsed.select("path", F.from_json("value", schemas.SAMPLE).alias("s"), "v")
    return typed.select(
        "path", "s.*", F.try_variant_get("v", "$.doc_id", "string").alias("doc_key"),
        _metric_fields(F.col("s.metrics"), F.col("v")).alias("scores"))


def bad_sample_lines(lines: DataFrame) -> DataFrame:
    """Lines that are not JSON, with their file."""
    return lines.where((F.trim("value") != "") & F.try_parse_json("value").isNull())


def attempt_values(scores: Column) -> Column:
    """Metric fields MAP<STRING, STRING> as numbers per attempt: a plain number is one attempt, a list is several."""
    return F.map_filter(
        F.transform_values(scores, lambda k, v: F.when(
            F.startswith(v, F.lit("[")), F.from_json(v, "ARRAY<DOUBLE>")
        ).otherwise(F.array(_number(v)))),
        lambda k, v: F.coalesce(F.forall(v, lambda x: x.isNotNull()), F.lit(False)),
    )


def trials(files: DataFrame) -> DataFrame:
    """Trial records of `jobs/<benchmark>/<trial>/result.json`."""
    rows = files.select("path", F.from_json("value", schemas.TRIAL).alias("t"))
    return rows.select(
        F.regexp_extract("path", r"jobs/([^/]+)/[^/]+/result\.json$", 1).alias("benchmark"),
        "t.task_name", "t.trial_name", F.col("t.verifier_result.rewards").alias("rewards"),
        "t.exception_info.exception_type", "t.exception_info.exception_message",
        "t.agent_result.n_input_tokens", "t.agent_result.n_output_tokens",
        F.col("t.started_at").try_cast("timestamp").alias("started_at"),
        F.col("t.finished_at").try_cast("timestamp").alias("finished_at"),
    ).where("benchmark <> ''")


def reviews(lines: DataFrame) -> DataFrame:
    """Review records of `reviews/<model>/<dataset>_<subset>.jsonl`, with both readings of the scoring report."""
    record = F.from_json("value", schemas.REVIEW)
    rows = lines.select("path", keep(F.when(record["sample_score"].isNotNull(), record)).alias("r"))
    score, usage = "r.sample_score.score", "r.agent_trace.total_usage"
    report = F.col(f"{score}.metadata.report")
    return rows.select(
        F.regexp_extract("path", r"reviews/([^/]+)/[^/]+$", 1).alias("model"),
        F.regexp_replace(file_name(F.col("path")), r"\.jsonl.*$", "").alias("file"),
        F.coalesce(F.nullif(F.col("r.sample_score.sample_metadata.instance_id"), F.lit("")),
                   F.col("r.sample_score.sample_id")).alias("instance"),
        F.col("r.sample_score.sample_metadata.repo").alias("repo"),
        F.col(f"{score}.value").alias("value"),
        F.coalesce(F.col(f"{score}.status"), F.lit("success")).alias("status"),
        F.col(f"{score}.extracted_prediction").alias("patch"),
        F.col(f"{score}.metadata.completed").alias("completed"),
        F.col(f"{score}.metadata.resolved").alias("resolved"),
        F.col(f"{usage}.input_tokens").alias("n_input_tokens"),
        F.col(f"{usage}.output_tokens").alias("n_output_tokens"),
        F.array_min(F.transform("r.agent_trace.events", lambda e: e["timestamp"])).alias("first_event"),
        F.array_max(F.transform("r.agent_trace.events", lambda e: e["timestamp"])).alias("last_event"),
        F.get_json_object(report, "$.error").alias("error"),
        report_tests(report).alias("tests"),
    )


def report_tests(report: Column) -> Column:
    """(passed, required, failed) of a scoring report in either of its shapes."""
    empty = F.array().cast("array<string>")

    def read(ran: Column) -> Column:
        required = F.concat(F.coalesce(ran["f2p"], empty), F.coalesce(ran["p2p"], empty))
        groups = F.filter(
            F.map_values(F.from_json(report, schemas.REPORT_BY_GROUP)), lambda r: r["tests_status"].isNotNull()
        )
        return F.when(
            ran["f2p"].isNotNull() | ran["p2p"].isNotNull(), sample_fields.required_tests(ran["tests"], required)
        ).otherwise(let(F.get(groups, F.lit(0))["tests_status"], lambda status: F.when(
            status.isNotNull(), sample_fields.required_tests_by_group(status))))

    return let(F.from_json(report, schemas.REPORT_RAN), read)


def reports(files: DataFrame) -> DataFrame:
    """Benchmark reports, unreadable files skipped; one row per metric."""
    rows = files.where(F.try_parse_json("value").isNotNull()).select(
        "path", F.from_json("value", schemas.REPORT).alias("r")
    )
    return rows.select(
        "path", F.col("r.model_name").alias("model"), F.col("r.dataset_name").alias("dataset"), "r.score",
        F.explode_outer("r.metrics").alias("m"),
    ).select("path", "model", "dataset", "score", F.col("m.identity.name").alias("metric"),
             F.col("m.score").alias("metric_score"), F.col("m.num").alias("num"))


def simulations(files: DataFrame) -> DataFrame:
    """One row per simulation of a results document."""
    rows = files.select("path", F.from_json("value", schemas.SIMULATIONS).alias("r"))
    return rows.select(
        "path", F.col("r.info.environment_info.domain_name").alias("domain"), F.explode("r.simulations").alias("s")
    ).select(
        "path", "domain", "s.task_id", "s.termination_reason", F.col("s.reward_info.reward").alias("reward"),
        "s.info.error", "s.info.error_type", "s.info.error_traceback",
        F.col("s.start_time").try_cast("timestamp").alias("started_at"),
        F.col("s.end_time").try_cast("timestamp").alias("ended_at"),
    )


def category_scores(lines: DataFrame) -> DataFrame:
    """Category scores from the header lines of `<prefix>_<category>_score.json` files."""
    category = F.regexp_replace(F.regexp_replace(file_name(F.col("path")), r"_score\.json$", ""), r"^BFCL_v\d+_", "")
    return lines.select("path", category.alias("category"), F.from_json("value", schemas.CATEGORY_SCORE).alias("s")).where(
        "s.accuracy IS NOT NULL AND s.total_count IS NOT NULL"
    ).select(directory(F.col("path")).alias("dir"), "category", "s.accuracy",
             F.col("s.correct_count").alias("correct"), F.col("s.total_count").alias("total"))


def percent_cell(text: Column) -> Column:
    """`71.74%` as 0.7174; anything that is no number gives NULL."""
    return F.regexp_replace(text, "%$", "").try_cast("double") / 100


def read_group_csv(spark: SparkSession, path: str, group: str, column: str) -> DataFrame:
    """One group's score from the single data row of a CSV the benchmark writes."""
    rows = spark.read.option("header", "true").csv(path)
    return rows.limit(1).select(F.lit(group).alias("group"), percent_cell(F.col(f"`{column}`")).alias("score"))


def question_rows(raw: DataFrame) -> DataFrame:
    """Entity questions with their gold aliases as an array."""
    return raw.select("id", "question", "prop", F.from_json("possible_answers", "ARRAY<STRING>").alias("aliases"),
                      "s_pop", "o_pop")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions from a tab-separated file."""
    raw = (
        spark.read.option("sep", "\t").option("header", "true").option("quote", '"').option("escape", '"')
        .option("multiLine", "true").schema(schemas.QUESTIONS).csv(path)
    )
    return question_rows(raw)


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_keys(documents: pd.Series) -> pd.Series:
    """All object keys of a JSON document at any depth; NULL for a document that is not JSON."""

    def keys(text: str | None) -> list[str] | None:
        try:
            pending, found = [json.loads(text)], set()
        except (TypeError, ValueError):
            return None
        while pending:
            value = pending.pop()
            if isinstance(value, dict):
                found.update(value)
                pending.extend(value.values())
            elif isinstance(value, list):
                pending.extend(value)
        return sorted(found)

    return documents.map(keys)


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def flatten_json(documents: pd.Series) -> pd.Series:
    """A JSON object as one level of `a/b/c` keys; lists become text. NULL for what is no JSON object."""

    def flatten(text: str | None) -> dict[str, str | None] | None:
        try:
            flat, pending = {}, [("", json.loads(text))]
        except (TypeError, ValueError):
            return None
        if not isinstance(pending[0][1], dict):
            return None
        while pending:
            prefix, value = pending.pop()
            for key, child in value.items():
                path = f"{prefix}/{key}" if prefix else key
                if isinstance(child, dict):
                    pending.append((path, child))
                else:
                    flat[path] = None if child is None else str(child)
        return flat

    return documents.map(flatten)


def _number(text: Column) -> Column:
    return F.when(text == "true", F.lit(1.0)).when(text == "false", F.lit(0.0)).otherwise(text.try_cast("double"))


def _metric_fields(metrics: Column, line: Column) -> Column:
    """The line's own value of each metric it lists, as JSON text."""
    named = F.array_distinct(F.coalesce(metrics, F.array().cast("array<string>")))
    return let(F.try_variant_get(line, "$", "map<string,variant>"), lambda fields: F.map_from_entries(F.transform(
        named, lambda m: F.struct(m.alias("key"), F.to_json(F.try_element_at(fields, m)).alias("value")))))
