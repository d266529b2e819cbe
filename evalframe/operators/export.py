"""Export records and their instances.

A record holds the scores of one (model, collection); its instances are the samples behind them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from evalframe.functions import ids, samples as sample_fields, scores
from evalframe.functions.let import keep, let
from evalframe.operators.scale import heavy_join, hot_keys, literal_rows

# Fixed values of the export format.
SCHEMA_VERSION = "0.2.2"
SELF_DEPLOYED = ["hf", "vllm", "sglang", "megatron_lm"]
REPO_URL = "https://huggingface.co/"
DATASET_URL = "https://huggingface.co/datasets/"

# Known metrics as (metric, id, name, kind, unit, lowest, highest, lower_is_better).
KNOWN_METRICS = [
    ("acc", "accuracy", "Accuracy", "accuracy", "proportion", 0.0, 1.0, None),
    ("accuracy", "accuracy", "Accuracy", "accuracy", "proportion", 0.0, 1.0, None),
    ("acc_norm", "normalized_accuracy", "Normalized accuracy", "accuracy", "proportion", 0.0, 1.0, None),
    ("exact_match", "exact_match", "Exact match", "accuracy", "proportion", 0.0, 1.0, None),
    ("f1", "f1", "F1", "f1", "proportion", 0.0, 1.0, None),
    ("em", "exact_match", "Exact match", "accuracy", "proportion", 0.0, 1.0, None),
    ("mcc", "matthews_correlation", "Matthews correlation coefficient", "correlation", "coefficient", -1.0, 1.0, None),
    ("pass@1", "pass_at_1", "pass@1", "pass_rate", "proportion", 0.0, 1.0, None),
    ("pass_at_1", "pass_at_1", "pass@1", "pass_rate", "proportion", 0.0, 1.0, None),
    ("passed", "pass_rate", "Pass rate", "pass_rate", "proportion", 0.0, 1.0, False),
    ("degeneration", "degeneration", "Degeneration rate", "rate", "proportion", 0.0, 1.0, True),
]

_KNOWN = [
    ("metric", "string"), ("id", "string"), ("name", "string"), ("kind", "string"), ("unit", "string"),
    ("lowest", "double"), ("highest", "double"), ("lower_is_better", "boolean"),
]
_NULLS = {"ignoreNullFields": "false"}


def slug(text: Column, separator: str = "_") -> Column:
    squeezed = F.regexp_replace(F.lower(text), "[^a-z0-9]+", separator)
    return F.regexp_replace(squeezed, f"^{separator}|{separator}$", "")


def metric_config(metric: Column, filter_name: Column, namespace: Column, higher_is_better: Column,
                  variant_roots: Sequence[str] = ()) -> Column:
    """Identity, unit, range and direction of a metric; unknown metrics get a namespaced id and no range."""
    base = F.regexp_replace(metric, r"_mean_repeats$", "")
    k = F.regexp_extract(base, r"^pass(?:@|_at_)(\d+)$", 1)
    passes = k != ""
    entry = F.get(F.filter(literal_rows(KNOWN_METRICS, _KNOWN), lambda row: row["metric"] == base), F.lit(0))
    suffix = slug(base)
    for root in reversed(variant_roots):
        rest = F.regexp_replace(base, f"^{root}_", "")
        suffix = F.when(F.startswith(base, F.lit(f"{root}_")), F.concat(F.lit(f"{root}."), slug(rest))).otherwise(suffix)

    def config(known: Column) -> Column:
        return F.struct(
            F.when(filter_name == "none", metric).otherwise(
                F.concat(metric, F.lit(" (filter: "), filter_name, F.lit(")"))).alias("evaluation_description"),
            F.coalesce(known["lower_is_better"], ~F.coalesce(higher_is_better, F.lit(True))).alias("lower_is_better"),
            F.coalesce(known["id"], F.when(passes, F.concat(F.lit("pass_at_"), k)),
                       F.concat(slug(namespace), F.lit("."), suffix)).alias("metric_id"),
            F.coalesce(known["name"], F.when(passes, F.concat(F.lit("pass@"), k)), base).alias("metric_name"),
            F.coalesce(known["kind"], F.when(passes, F.lit("pass_rate"))).alias("metric_kind"),
            F.coalesce(known["unit"], F.when(passes, F.lit("proportion"))).alias("metric_unit"),
            F.coalesce(known["lowest"], F.when(passes, F.lit(0.0))).alias("min_score"),
            F.coalesce(known["highest"], F.when(passes, F.lit(1.0))).alias("max_score"),
            F.when(known.isNotNull() | passes, "continuous").alias("score_type"),
        )

    return let(entry, config)


def apply_overrides(config: Column, override: Column, benchmark: Column, split: Column, filter_name: Column) -> Column:
    """A metric config with a mapping's override (MAP<STRING, STRING>) on top, templates filled in."""
    def filled(key: str) -> Column:
        text = F.try_element_at(override, F.lit(key))
        for name, value in (("{benchmark}", benchmark), ("{split}", split), ("{filter}", filter_name)):
            text = F.replace(text, F.lit(name), value)
        return text

    for key in ("metric_id", "metric_name", "metric_kind", "metric_unit"):
        config = config.withField(key, F.coalesce(filled(key), config[key]))
    for key in ("min_score", "max_score"):
        config = config.withField(key, F.coalesce(filled(key).try_cast("double"), config[key]))
    lower = filled("lower_is_better")
    config = config.withField("lower_is_better", F.coalesce(lower.try_cast("boolean"), config["lower_is_better"]))
    any_override = override.isNotNull() & (F.cardinality(override) > 0)
    return config.withField("score_type", F.when(any_override, "continuous").otherwise(config["score_type"]))


def convert_samples(samples: DataFrame) -> DataFrame:
    """Instance rows of scorable samples; samples without a scalar score are left out.

    Besides the sample fields (`scores` MAP<STRING, STRING>) the rows carry evaluation_id, model_id, evaluation_name
    and result_keys ARRAY<STRING>.
    """
    fields = {f.name for f in samples.schema.fields}
    optional = lambda name: F.col(name) if name in fields else F.lit(None).cast("string")
    text = lambda name: F.coalesce(optional(name).cast("string"), F.lit(""))
    filter_name = F.coalesce("filter", F.lit("none"))
    prepared = samples.select(
        "*", keep(sample_fields.sample_score(F.col("scores"), F.col("filter"), F.col("result_keys"))).alias("_score")
    ).select(
        "*",
        sample_fields.extract_prompt(F.col("arguments"), optional("doc"), optional("input")).alias("_prompt"),
        sample_fields.extract_choices(F.col("arguments")).alias("_choices"),
    )
    prepared = prepared.withColumn("_output", sample_fields.extract_output(
        F.col("filtered_resps"), F.col("resps"), F.col("_choices")))
    carried = [c for c in samples.columns if c in ("model", "task", "ord", "collection", "developer", "uuid")]
    return prepared.select(*carried, F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"), "evaluation_id", "model_id", "evaluation_name",
        F.coalesce(F.col("doc_id").cast("string"), F.lit("0")).alias("sample_id"),
        ids.sample_hash(F.col("_prompt"), text("target")).alias("sample_hash"),
        F.lit("single_turn").alias("interaction_type"),
        F.struct(F.col("_prompt").alias("raw"), F.array(text("target")).alias("reference"),
                 F.col("_choices").alias("choices")).alias("input"),
        F.struct(F.array("_output").alias("raw")).alias("output"),
        F.array(F.struct(
            F.lit(0).alias("turn_idx"), F.lit("output.raw").alias("source"), F.col("_output").alias("extracted_value"),
            filter_name.alias("extraction_method"), F.lit(True).alias("is_terminal"),
        )).alias("answer_attribution"),
        F.col("_score").alias("evaluation"),
        F.struct(text("doc_hash").alias("doc_hash"), text("prompt_hash").alias("prompt_hash"),
                 text("target_hash").alias("target_hash"), filter_name.alias("filter"),
                 optional("repeat_index").cast("string").alias("repeat_index")).alias("metadata"),
    ).alias("instance"))


def with_priority(instances: DataFrame) -> DataFrame:
    """Adds the selection priority of an instance."""
    return instances.withColumn("priority", ids.sample_priority(
        F.col("instance.evaluation_name"), F.col("instance.metadata.filter"), F.col("instance.sample_hash"),
        F.col("instance.sample_id")))


def instance_lines(instances: DataFrame) -> DataFrame:
    """Instances as JSON lines beside their partition columns."""
    return instances.select(*[c for c in instances.columns if c != "instance"],
                            F.to_json("instance", _NULLS).alias("value"))


def lines_digest(value: Column) -> Column:
    """An order-free digest of a set of lines: it sums 60-bit sha256 prefixes, so every part of a file can add its own."""
    return F.sum(F.conv(F.left(F.sha2(value, 256), F.lit(15)), 16, 10).cast("decimal(38,0)")).cast("string")


def instance_totals(lines: DataFrame, by: Sequence[str]) -> DataFrame:
    return lines.groupBy(*by).agg(F.count("*").alias("total_rows"), lines_digest(F.col("value")).alias("checksum"))


def sample_accounting(samples: DataFrame, cap: int | None = None, by: Sequence[str] = ("model", "task")) -> DataFrame:
    """Source, scorable and exported rows per task and whether the task was capped or had no scorable row.

    `samples` has a boolean `scorable` per source row.
    """
    exported = F.col("scorable_rows") if cap is None else F.least(F.col("scorable_rows"), F.lit(cap))
    return samples.groupBy(*by).agg(
        F.count("*").alias("source_rows"), F.count_if("scorable").alias("scorable_rows")
    ).withColumns({
        "exported_rows": exported,
        "capped": F.lit(cap is not None) & (F.col("scorable_rows") > (cap or 0)),
        "unscored": F.col("scorable_rows") == 0,
    })


def evaluation_results(rows: DataFrame) -> DataFrame:
    """Adds `result`, the score entry of a record.

    `rows` has task, key, score, evaluation_name, benchmark, higher_is_better, standard_error, num_samples, dataset_id,
    dataset_name, source_type and evaluation_timestamp.
    """
    metric, filter_name = scores.metric_of(F.col("key")), scores.filter_of(F.col("key"))
    return rows.withColumn("result", F.struct(
        ids.result_id(F.col("task"), F.col("key"), F.col("score")).alias("evaluation_result_id"),
        F.col("evaluation_name"),
        F.struct("dataset_name", "source_type", F.when(F.col("source_type") == "hf_dataset", F.col("dataset_id")).alias("hf_repo"),
                 F.struct(F.when(F.col("source_type") == "hf_dataset", F.concat(F.lit(DATASET_URL), F.col("dataset_id")))
                          .alias("hf_dataset_url")).alias("additional_details")).alias("source_data"),
        F.col("evaluation_timestamp"),
        metric_config(metric, filter_name, F.col("benchmark"), F.col("higher_is_better")).alias("metric_config"),
        F.struct(F.col("score"), F.struct(
            F.when(F.col("standard_error").isNotNull(), F.struct(
                F.col("standard_error").alias("value"), F.lit("bootstrap").alias("method"))).alias("standard_error"),
            F.col("num_samples")).alias("uncertainty")).alias("score_details"),
    ))


def record_ids(results: DataFrame) -> DataFrame:
    """(model_id, collection, developer, model, uuid) of every record."""
    model = F.col("model_id")
    return results.groupBy("model_id", "collection").agg(F.min("source_sha").alias("_sha")).select(
        "model_id", "collection", F.substring_index(model, "/", 1).alias("developer"),
        F.substring_index(model, "/", -1).alias("model"),
        ids.stable_uuid(F.col("_sha"), F.col("collection"), model).alias("uuid"),
    )


def keyed_lines(instances: DataFrame, records: DataFrame) -> DataFrame:
    """Instances of (model_id, collection) as JSON lines under their record's ids."""
    lines = instance_lines(instances.select("model_id", "collection", "instance"))
    heat = hot_keys(instances, ["model_id", "collection"])
    return heavy_join(lines, records, ["model_id", "collection"], spread=["value"], heat=heat)


def export_records(results: DataFrame, totals: DataFrame, source_name: str, retrieved: str) -> DataFrame:
    """One record per (model_id, collection): (collection, developer, model, uuid, record).

    `results` has model_id, collection, task, key, result, source_sha and evaluation_timestamp; a record collects the
    handful of scores of its tasks. `totals` has the number and digest of the instances per uuid.
    """
    order = F.struct("task", "key", "result")
    model = F.col("model_id")
    grouped = results.groupBy("model_id", "collection").agg(
        F.transform(F.array_sort(F.collect_list(order)), lambda r: r["result"]).alias("evaluation_results"),
        F.min("source_sha").alias("source_sha"), F.max("evaluation_timestamp").alias("evaluation_timestamp"),
    ).withColumns({
        "developer": F.substring_index(model, "/", 1), "model": F.substring_index(model, "/", -1),
        "uuid": ids.stable_uuid(F.col("source_sha"), F.col("collection"), model),
    })
    record = F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.concat_ws("/", "collection", "model_id", F.lit(retrieved)).alias("evaluation_id"),
        F.col("evaluation_timestamp"), F.lit(retrieved).alias("retrieved_timestamp"),
        F.struct(F.lit(source_name).alias("source_name"), F.lit("evaluation_run").alias("source_type")).alias("source_metadata"),
        F.struct(F.lit("lm_eval").alias("name")).alias("eval_library"),
        F.struct(F.col("model").alias("name"), model.alias("id"), F.col("developer")).alias("model_info"),
        F.col("evaluation_results"),
        F.when(F.col("total_rows") > 0, F.struct(
            F.lit("jsonl").alias("format"), F.lit("sum-sha256-60").alias("hash_algorithm"), F.col("checksum"),
            F.col("total_rows"))).alias("detailed_evaluation_results"),
    )
    return grouped.join(totals.select("uuid", "total_rows", "checksum"), "uuid", "left").select(
        "collection", "developer", "model", "uuid", record.alias("record"))


def manifest(records: DataFrame, warnings: DataFrame) -> DataFrame:
    """One manifest row per model: its records and the distinct warnings, as JSON. Both lists are per run, not per sample."""
    listed = records.groupBy("developer", "model").agg(
        F.array_sort(F.collect_list(F.struct("collection", "uuid"))).alias("records"))
    noted = warnings.groupBy("model").agg(F.array_sort(F.collect_set("warning")).alias("warnings"))
    body = F.struct(
        F.lit(1).alias("format_version"), F.concat_ws("/", "developer", "model").alias("model_id"),
        F.size("records").alias("n_records"), F.col("records"),
        F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"),
        F.lit(False).alias("publishing_performed"),
    )
    return listed.join(noted, "model", "left").select("model", F.to_json(body, _NULLS).alias("value"))


def hub_entry(dataset_id: Column, task_id: Column, value: Column, date: Column, url: Column, source: str, notes: Column) -> Column:
    """One YAML entry of a result preview."""
    return F.concat(
        F.lit("- dataset:\n    id: "), ids.quoted(dataset_id), F.lit("\n    task_id: "), ids.quoted(task_id),
        F.lit("\n  value: "), value.cast("string"), F.lit("\n  date: "), ids.quoted(date),
        F.lit("\n  source:\n    url: "), ids.quoted(url), F.lit(f'\n    name: "{source}"\n  notes: '), ids.quoted(notes),
        F.lit("\n"),
    )
