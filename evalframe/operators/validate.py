"""Checks of export records, instances and written exports, as one row per problem."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from evalframe.functions import ids
from evalframe.operators import export

# Fields every record and every instance has to have.
RECORD_FIELDS = [
    "schema_version", "evaluation_id", "retrieved_timestamp", "source_metadata", "model_info", "eval_library",
    "evaluation_results",
]
INSTANCE_FIELDS = [
    "schema_version", "evaluation_id", "model_id", "evaluation_name", "sample_id", "interaction_type", "input",
    "answer_attribution", "evaluation",
]
RECORD = (
    "schema_version STRING, evaluation_id STRING, retrieved_timestamp STRING, source_metadata STRING, "
    "model_info STRUCT<name STRING, id STRING, additional_details STRUCT<model_availability STRING, hf_model_url STRING>>, "
    "eval_library STRING, evaluation_results ARRAY<STRUCT<evaluation_name STRING, "
    "source_data STRUCT<source_type STRING, hf_repo STRING, dataset_name STRING, "
    "additional_details STRUCT<hf_dataset_url STRING>>, "
    "metric_config STRUCT<lower_is_better BOOLEAN, min_score DOUBLE, max_score DOUBLE>, "
    "score_details STRUCT<score VARIANT>>>, "
    "detailed_evaluation_results STRUCT<checksum STRING, total_rows BIGINT>"
)
INSTANCE = (
    "schema_version STRING, evaluation_id STRING, model_id STRING, evaluation_name STRING, sample_id STRING, "
    "interaction_type STRING, input STRUCT<raw STRING, reference ARRAY<STRING>>, answer_attribution STRING, "
    "evaluation STRUCT<score VARIANT, is_correct VARIANT>"
)


def validate_records(records: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, message) for each broken rule of the record JSON in `value`."""
    rows = records.select(*by, F.from_json("value", RECORD).alias("r"), F.json_object_keys("value").alias("keys"))
    model, details = F.col("r.model_info"), F.col("r.model_info.additional_details")
    named = _filled(model["name"]) & _filled(model["id"])
    whole = F.array(
        _missing(F.col("keys"), RECORD_FIELDS, "missing top-level fields: "),
        _note(_differs(F.col("r.schema_version"), export.SCHEMA_VERSION), "expected schema_version " + export.SCHEMA_VERSION),
        _note(~named, "model_info requires name and id"),
        _note(named & ~ids.is_repo_id(model["id"]), "model_info.id must use owner/model format"),
        _note(named & ids.is_repo_id(model["id"]) & (details["model_availability"] == "open_weights")
              & _differs(details["hf_model_url"], F.concat(F.lit(export.REPO_URL), model["id"])),
              "model_info requires the direct model URL"),
        _note(F.coalesce(F.size("r.evaluation_results"), F.lit(0)) < 1, "evaluation_results must be non-empty"),
    )
    results = rows.select(*by, F.posexplode("r.evaluation_results").alias("pos", "e"))
    e, data = F.col("e"), F.col("e.source_data")
    score = F.try_variant_get(F.col("e.score_details.score"), "$", "double")
    numeric = _numeric(F.col("e.score_details.score"))
    hosted = F.coalesce(data["source_type"] == "hf_dataset", F.lit(False))
    repo_ok = ids.is_repo_id(data["hf_repo"])
    entry = F.array(
        *[_note(F.col(f"e.{name}").isNull(), f"missing {name}")
          for name in ("evaluation_name", "source_data", "metric_config", "score_details")],
        _note(~ids.has_name_scheme(e["evaluation_name"]), "evaluation_name must use [composite.]family.benchmark.split"),
        _note(hosted & ~repo_ok, "hf_repo must use owner/dataset format"),
        _note(hosted & repo_ok & _differs(data["dataset_name"], data["hf_repo"]), "dataset_name must match the dataset id"),
        _note(hosted & repo_ok & _differs(
            data["additional_details"]["hf_dataset_url"], F.concat(F.lit(export.DATASET_URL), data["hf_repo"])),
            "source_data requires the direct dataset URL"),
        _note(~numeric, "score must be numeric"),
        _note(F.col("e.metric_config.lower_is_better").isNull(), "metric_config.lower_is_better is required"),
        _note(numeric & (score < F.col("e.metric_config.min_score")), "score is below metric_config.min_score"),
        _note(numeric & (score > F.col("e.metric_config.max_score")), "score exceeds metric_config.max_score"),
    )
    label = F.concat(F.lit("evaluation_results["), F.col("pos").cast("string"), F.lit("]: "))
    return _messages(rows, by, whole).unionByName(
        results.select(*by, F.explode(_kept(entry)).alias("message"), "pos").select(
            *by, F.concat(label, F.col("message")).alias("message"))
    )


def validate_instances(lines: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, message) for each broken rule of the instance JSON in `value`."""
    rows = lines.select(*by, F.from_json("value", INSTANCE).alias("r"), F.json_object_keys("value").alias("keys"))
    checks = F.array(
        _missing(F.col("keys"), INSTANCE_FIELDS, "missing instance fields: "),
        _note(_differs(F.col("r.schema_version"), export.SCHEMA_VERSION),
              "expected instance schema_version " + export.SCHEMA_VERSION),
        _note(_differs(F.col("r.interaction_type"), "single_turn"), "instances must be single_turn"),
        _note(~ids.has_name_scheme(F.col("r.evaluation_name")),
              "evaluation_name must use [composite.]family.benchmark.split"),
        _note(F.col("r.input.raw").isNull() | F.col("r.input.reference").isNull(),
              "input requires raw text and a reference list"),
        _note(~_numeric(F.col("r.evaluation.score")), "evaluation.score must be numeric"),
        _note(F.coalesce(_type(F.col("r.evaluation.is_correct")) != "BOOLEAN", F.lit(True)),
              "evaluation.is_correct must be boolean"),
    )
    return _messages(rows, by, checks)


def validate_export(records: DataFrame, lines: DataFrame, by: Sequence[str]) -> DataFrame:
    """Records checked against their written instances: missing, wrong row count, wrong digest; then both rule sets."""
    told = records.select(*by, F.from_json("value", RECORD).alias("r")).select(*by, "r.detailed_evaluation_results.*")
    found = export.instance_totals(lines, by).withColumnsRenamed({"checksum": "_digest", "total_rows": "_rows"})
    compared = told.where("total_rows IS NOT NULL").join(found, list(by), "left")
    absent = F.col("_rows").isNull()
    checks = F.array(
        _note(absent, "missing instance results"),
        _note(~absent & _differs(F.col("checksum"), F.col("_digest")), "checksum mismatch"),
        _note(~absent & (F.col("total_rows") != F.col("_rows")), "row-count mismatch"),
    )
    return (
        _messages(compared, by, checks)
        .unionByName(validate_records(records, by))
        .unionByName(validate_instances(lines, by))
    )


def _messages(rows: DataFrame, by: Sequence[str], checks: Column) -> DataFrame:
    return rows.select(*by, F.explode(_kept(checks)).alias("message"))


def _kept(checks: Column) -> Column:
    return F.filter(checks, lambda m: m.isNotNull())


def _note(broken: Column, message: str) -> Column:
    return F.when(F.coalesce(broken, F.lit(False)), message)


def _missing(keys: Column, required: Sequence[str], message: str) -> Column:
    absent = F.array_sort(F.array_except(F.array(*[F.lit(f) for f in required]), keys))
    return F.when(F.size(absent) > 0, F.concat(F.lit(message), F.array_join(absent, ", ")))


def _differs(value: Column, expected: Column | str) -> Column:
    expected = F.lit(expected) if isinstance(expected, str) else expected
    return ~F.equal_null(value, expected)


def _filled(text: Column) -> Column:
    return F.coalesce(text != "", F.lit(False))


def _type(value: Column) -> Column:
    return F.call_function("schema_of_variant", value)


def _numeric(value: Column) -> Column:
    return F.coalesce(_type(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.lit(False))
