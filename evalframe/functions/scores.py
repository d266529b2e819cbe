"""Metric keys and score values as Columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Task-level fields that sit beside the metrics of a task but are not scores.
METADATA_KEYS = ["alias", "samples", "name", "sample_len", "sample_count"]

# Metrics whose per-sample value says right (1) or wrong (0).
BINARY_METRICS = ["acc", "accuracy", "exact_match", "exact_match_strict", "pass@1", "em"]

# Raw length metrics and failure rates, by key suffix.
COUNT_SUFFIXES = [
    "response_length_words", "response_length_chars", "response_length_tokens",
    "thinking_length_words", "thinking_length_chars", "thinking_length_tokens",
]
FAILURE_SUFFIXES = ["generation_truncated", "generation_think_truncated", "generation_parse_failed"]

# Categorical verdicts of a scorer.
CATEGORY_VALUES = {"C": 1.0, "I": 0.0, "P": 0.5, "N": 0.0}

# Task-name parts that a short column name leaves out.
SHORT_NAME_DROPS = ["_direct", "_avg", "_comprehensive"]


def metric_of(key: Column) -> Column:
    """`metric` of a `metric,filter` key."""
    return F.trim(F.split_part(key, F.lit(","), F.lit(1)))


def filter_of(key: Column) -> Column:
    """`filter` of a `metric,filter` key, `none` without one."""
    return F.when(F.contains(key, F.lit(",")), F.trim(F.regexp_replace(key, "^[^,]*,", ""))).otherwise(F.lit("none"))


def parse_score(key: Column, value: Column) -> Column:
    """The score of a raw result field; NULL for metadata, missing and non-numeric values."""
    text = F.trim(value)
    missing = key.isin(METADATA_KEYS) | text.isin("", "N/A")
    # JSON booleans count as 1 and 0 here; the export filter rejects them instead.
    number = F.when(text == "true", F.lit(1.0)).when(text == "false", F.lit(0.0)).otherwise(text.try_cast("double"))
    return F.when(~F.coalesce(missing, F.lit(True)), number)


def is_unreadable(key: Column, value: Column) -> Column:
    """True for a field that is neither metadata nor missing and still no number: worth a warning."""
    text = F.trim(value)
    return ~key.isin(METADATA_KEYS) & value.isNotNull() & ~text.isin("", "N/A") & parse_score(key, value).isNull()


def is_exportable(key: Column, json_type: Column, score: Column) -> Column:
    """Numeric, finite, no metadata, no standard error; `json_type` tells numbers from booleans and strings."""
    numeric = json_type.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    finite = score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))
    return ~key.isin(METADATA_KEYS) & ~F.contains(key, F.lit("_stderr")) & numeric & finite


def normalize_score(score: Column) -> Column:
    """Bring percentages to [0, 1]; exactly 1.0 stays 1.0."""
    return F.when((score > 1.0) | (score < 0.0), score / 100.0).otherwise(score)


def metric_kind(key: Column) -> Column:
    """`count`, `failure` or `rate` by the part after the task name."""
    suffix = F.regexp_replace(key, "^[^/]*/", "")
    return (
        F.when(suffix.isin(COUNT_SUFFIXES), "count")
        .when(suffix.isin(FAILURE_SUFFIXES), "failure")
        .otherwise("rate")
    )


def short_metric_name(key: Column) -> Column:
    """Task name without the parts that only tell how it was run."""
    name = F.substring_index(key, "/", 1)
    for part in SHORT_NAME_DROPS:
        name = F.replace(name, F.lit(part), F.lit(""))
    return name


def categorical_score(value: Column, json_type: Column | None = None) -> Column:
    """A scorer's value as a number: C/I/P/N, booleans and numeric text; lists and objects give NULL."""
    lookup = F.create_map(*[F.lit(x) for pair in CATEGORY_VALUES.items() for x in pair])
    number = F.coalesce(
        F.try_element_at(lookup, F.upper(value)),
        F.when(value == "true", F.lit(1.0)).when(value == "false", F.lit(0.0)),
        value.try_cast("double"),
    )
    if json_type is None:
        return number
    return F.when(~json_type.rlike("^(ARRAY|OBJECT|VOID)"), number)


def parse_run_name(
    name: Column,
    method_filter: bool = False,
    dataset_rules: Sequence[tuple[Sequence[str], str, int]] = (
        (("maxmin",), "maxmin", 1),
        (("deltaqwen", "0.6b", "qwen"), "Qwen3-32B_vs_0.6B", 2),
        (("qrpo",), "maxmin", 1),
    ),
    known: Mapping[str, str] | None = None,
) -> Column:
    """Hyper-parameters read from a run name, as struct(display, dataset_order, length_norm, lr).

    `dataset_rules` are (markers, dataset, order) in the order they are tried; other runs take the last `_` part.
    """
    lower = F.lower(name)
    beta = F.regexp_extract(name, r"beta([0-9.]+)", 1)
    lr_text = F.regexp_replace(F.regexp_extract(name, r"lr([0-9eE.\-]+)", 1), r"-+$", "")
    has_lr = name.rlike(r"lr[0-9eE.\-]")
    lr = F.when(has_lr, F.coalesce(lr_text.try_cast("double"), F.lit(float("inf")))).otherwise(F.lit(float("inf")))
    ebs = F.regexp_extract(name, r"ebs(\d+)", 1)

    dataset, order = F.substring_index(name, "_", -1), F.lit(4)
    for markers, label, position in reversed(dataset_rules):
        hit = _any_contains(lower, markers)
        dataset = F.when(hit, label).otherwise(dataset)
        order = F.when(hit, position).otherwise(order)

    norm_flag = F.regexp_extract(lower, r"ln[_-]?(true|false)", 1)
    norm = F.when(
        (norm_flag == "true") | ((norm_flag == "") & _any_contains(lower, ["lengthnorm", "length_norm"])), "lenNorm"
    ).otherwise("")
    method = F.lit("") if method_filter else (
        F.when(F.contains(lower, F.lit("qrpo")), "qrpo").when(F.contains(lower, F.lit("dpo")), "dpo").otherwise("")
    )
    empty_to_null = lambda c: F.nullif(c, F.lit(""))
    display = F.concat_ws(
        "_",
        dataset,
        empty_to_null(method),
        F.when(beta == "", "bUnk").otherwise(F.concat(F.lit("b"), beta)),
        F.when(ebs == "", "ebs128").otherwise(F.concat(F.lit("ebs"), ebs)),
        F.when(has_lr, F.concat(F.lit("lr"), lr_text)).otherwise("unknown_lr"),
        empty_to_null(norm),
    )
    for run, label in (known or {}).items():
        display = F.when(name == run, label).otherwise(display)
        order = F.when(name == run, 0).otherwise(order)
        norm = F.when(name == run, "").otherwise(norm)
        lr = F.when(name == run, 0.0).otherwise(lr)
    return F.struct(
        display.alias("display"), order.cast("int").alias("dataset_order"), norm.alias("length_norm"), lr.alias("lr")
    )


@F.pandas_udf(T.StringType())
def _four_digits(values: pd.Series, signed: pd.Series) -> pd.Series:
    """Text of the double itself, as `%.4f` gives it: its shortest decimal text may be a half where the double is none."""
    return pd.Series([format(v, "+.4f" if s else ".4f") for v, s in zip(values, signed)], dtype="object")


def delta_cell(delta: Column) -> Column:
    return _four_digits(delta, F.lit(True))


def plain_cell(score: Column) -> Column:
    return _four_digits(score, F.lit(False))


def percent(score: Column) -> Column:
    """Percent with one decimal, halves to even."""
    return F.bround(score * 100, 1)


def percent_cell(score: Column) -> Column:
    return F.format_string("%.1f", percent(score))


def count_cell(score: Column) -> Column:
    """Whole number, halves up."""
    return F.floor(score + 0.5).cast("string")


def _any_contains(text: Column, markers: Sequence[str]) -> Column:
    hit = F.lit(False)
    for marker in markers:
        hit = hit | F.contains(text, F.lit(marker))
    return hit
