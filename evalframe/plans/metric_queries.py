"""Raw result fields, scores and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.functions import ids, scores, settings
from evalframe.operators import export, leaderboard, metrics
from evalframe.plans import views
from evalframe.plans.registry import query, table

_PARSED = views.RAW + """, v_parsed AS (
  SELECT model, model_no, part, task, key, CASE raw WHEN 'true' THEN 1.0 ELSE TRY_CAST(raw AS DOUBLE) END AS score,
    split_part(key, ',', 1) AS metric, CASE WHEN contains(key, ',') THEN split_part(key, ',', 2) ELSE 'none' END AS filter
  FROM v_raw WHERE key NOT IN ('alias', 'samples', 'name', 'sample_len', 'sample_count') AND raw <> 'N/A'
    AND (raw = 'true' OR TRY_CAST(raw AS DOUBLE) IS NOT NULL))"""


@query("p1_parse_metric_score", """SELECT model, part, task, key, round(score, 6) AS score FROM v_parsed""", _PARSED)
def parse_metric_score(spark, sf):
    return metrics.parse_metrics(views.raw_results(spark, sf)).select(
        "model", "part", "task", "key", F.round("score", 6).alias("score")
    )


@query("p1_unreadable_fields", """
SELECT task, key, count(*) AS n FROM v_raw
WHERE key NOT IN ('alias', 'samples', 'name', 'sample_len', 'sample_count') AND raw NOT IN ('N/A', 'true')
  AND TRY_CAST(raw AS DOUBLE) IS NULL GROUP BY ALL""", views.RAW)
def unreadable(spark, sf):
    return metrics.unreadable_fields(views.raw_results(spark, sf)).groupBy("task", "key").agg(F.count("*").alias("n"))


@query("p2_split_metric_key", """
SELECT metric, filter, count(*) AS n, round(sum(score), 4) AS score FROM v_parsed GROUP BY ALL""", _PARSED)
def split_metric_key(spark, sf):
    return metrics.parse_metrics(views.raw_results(spark, sf)).groupBy("metric", "filter").agg(
        F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("score")
    )


_PROMOTED = _PARSED + """, v_named AS (
  SELECT model, part, task, CASE filter WHEN 'none' THEN metric ELSE key END AS name, score FROM v_parsed
  UNION ALL
  SELECT model, part, task, metric, score FROM (
    SELECT *, count(*) OVER (PARTITION BY model, part, task, metric) AS c FROM v_parsed WHERE filter <> 'none')
  WHERE c = 1)"""


def _named(spark, sf):
    return metrics.promote_single_filter(
        metrics.parse_metrics(views.raw_results(spark, sf)), ("model", "part", "task")
    )


@query("p3_promote_single_filter", "SELECT model, part, task, name, round(score, 6) AS score FROM v_named", _PROMOTED)
def promote_single_filter(spark, sf):
    return _named(spark, sf).select("model", "part", "task", "name", F.round("score", 6).alias("score"))


@query("p4_numeric_metrics", """
SELECT model, part, task, key, round(raw::DOUBLE, 6) AS score FROM v_raw
WHERE kind = 'number' AND NOT contains(key, '_stderr') AND key NOT IN ('sample_len', 'alias')""", views.RAW)
def numeric_metrics(spark, sf):
    return metrics.numeric_metrics(views.numeric_results(spark, sf)).select(
        "model", "part", "task", "key", F.round("score", 6).alias("score")
    )


@query("p5_flatten_metrics", """
SELECT model, task || '/' || name AS key, round(arg_max(score, part), 6) AS score FROM v_named GROUP BY model, task, name
""", _PROMOTED)
def flatten_metrics(spark, sf):
    return metrics.flatten_metrics(_named(spark, sf), order="part").withColumn("score", F.round("score", 6))


@query("p7_normalize_score", """
SELECT model, key, round(CASE WHEN score > 1 OR score < 0 THEN score / 100 ELSE score END, 6) AS score FROM v_summary
""", views.SUMMARY)
def normalize_score(spark, sf):
    return views.summary(spark, sf).select(
        "model", "key", F.round(scores.normalize_score(F.col("score")), 6).alias("score")
    )


@query("p8_metric_kind", """
SELECT key, CASE WHEN regexp_matches(key, '/(response|thinking)_length_(words|chars|tokens)$') THEN 'count'
  WHEN regexp_matches(key, '/generation_(truncated|think_truncated|parse_failed)$') THEN 'failure' ELSE 'rate' END AS kind,
  count(*) AS n FROM v_summary GROUP BY ALL""", views.SUMMARY)
def metric_kind(spark, sf):
    return views.summary(spark, sf).groupBy("key").agg(F.count("*").alias("n")).select(
        "key", scores.metric_kind(F.col("key")).alias("kind"), "n"
    )


# Run names of customers: every part of a name present or absent by key.
_RUN_NAMES = """v_names AS (
  SELECT c_custkey AS id, concat_ws('-',
    CASE c_custkey % 4 WHEN 0 THEN 'run_MaxMin' WHEN 1 THEN 'x_deltaqwen' WHEN 2 THEN 'QRPO' ELSE 'sft_' || c_mktsegment END,
    CASE WHEN c_custkey % 3 > 0 THEN 'beta0.' || (c_custkey % 9 + 1) END,
    CASE WHEN c_custkey % 5 > 0 THEN 'lr' || (c_custkey % 9 + 1) || 'e-6' END,
    CASE WHEN c_custkey % 7 > 1 THEN 'ebs' || (c_custkey % 512) END,
    CASE c_custkey % 6 WHEN 0 THEN 'lnTrue' WHEN 1 THEN 'ln_false' WHEN 2 THEN 'LengthNorm' END,
    CASE WHEN c_custkey % 8 = 3 THEN 'dpo' END, 'seed_' || c_mktsegment) AS name
  FROM customer)"""


def _run_names(spark, sf):
    key = F.col("c_custkey")
    part = lambda condition, *pieces: F.when(condition, F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in pieces]))
    nine = (key % 9 + 1).cast("string")
    return table(spark, sf, "customer").select(key.alias("id"), F.concat_ws(
        "-",
        F.when(key % 4 == 0, "run_MaxMin").when(key % 4 == 1, "x_deltaqwen").when(key % 4 == 2, "QRPO").otherwise(
            F.concat(F.lit("sft_"), "c_mktsegment")),
        part(key % 3 > 0, "beta0.", nine), part(key % 5 > 0, "lr", nine, "e-6"),
        part(key % 7 > 1, "ebs", (key % 512).cast("string")),
        F.when(key % 6 == 0, "lnTrue").when(key % 6 == 1, "ln_false").when(key % 6 == 2, "LengthNorm"),
        F.when(key % 8 == 3, "dpo"), F.concat(F.lit("seed_"), "c_mktsegment"),
    ).alias("name"))


@query("p9_parse_run_name", r"""
SELECT id, concat_ws('_',
    CASE WHEN low LIKE '%maxmin%' THEN 'maxmin' WHEN low LIKE '%qwen%' OR low LIKE '%0.6b%' THEN 'Qwen3-32B_vs_0.6B'
         WHEN low LIKE '%qrpo%' THEN 'maxmin' ELSE split_part(name, '_', -1) END,
    CASE WHEN low LIKE '%qrpo%' THEN 'qrpo' WHEN low LIKE '%dpo%' THEN 'dpo' END,
    CASE WHEN regexp_matches(name, 'beta[0-9.]+') THEN 'b' || regexp_extract(name, 'beta([0-9.]+)', 1) ELSE 'bUnk' END,
    CASE WHEN regexp_matches(name, 'ebs\d+') THEN 'ebs' || regexp_extract(name, 'ebs(\d+)', 1) ELSE 'ebs128' END,
    CASE WHEN regexp_matches(name, 'lr[0-9eE.\-]+') THEN 'lr' || rtrim(regexp_extract(name, 'lr([0-9eE.\-]+)', 1), '-')
         ELSE 'unknown_lr' END,
    CASE WHEN regexp_matches(low, 'ln[_-]?true') OR (NOT regexp_matches(low, 'ln[_-]?(true|false)') AND low LIKE '%lengthnorm%')
         THEN 'lenNorm' END) AS display,
  CASE WHEN low LIKE '%maxmin%' THEN 1 WHEN low LIKE '%qwen%' THEN 2 WHEN low LIKE '%qrpo%' THEN 1 ELSE 4 END AS dataset_order,
  coalesce(TRY_CAST(nullif(rtrim(regexp_extract(name, 'lr([0-9eE.\-]+)', 1), '-'), '') AS DOUBLE), 999.0)::DOUBLE AS lr
FROM (SELECT *, lower(name) AS low FROM v_names)""", _RUN_NAMES)
def parse_run_name(spark, sf):
    return _run_names(spark, sf).withColumn("p", scores.parse_run_name(F.col("name"))).select(
        "id", "p.display", "p.dataset_order", F.when(F.col("p.lr") == float("inf"), 999.0).otherwise(F.col("p.lr")).alias("lr")
    )


@query("p10_short_metric_name", """
SELECT p_partkey, replace(replace(replace(replace(p_name, ' ', '_') || ['_direct', '_avg', '_comprehensive', ''][1 + p_partkey % 4],
  '_direct', ''), '_avg', ''), '_comprehensive', '') AS short FROM part""")
def short_metric_name(spark, sf):
    suffix = F.element_at(F.array(*[F.lit(s) for s in ("_direct", "_avg", "_comprehensive", "")]),
                          (F.col("p_partkey") % 4 + 1).cast("int"))
    key = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), suffix, F.lit("/acc"))
    return table(spark, sf, "part").select("p_partkey", scores.short_metric_name(key).alias("short"))


@query("p11_categorical_score", """
SELECT event_id, CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'click' THEN 0.5 WHEN 'error' THEN 0.0
  WHEN 'view' THEN CASE WHEN k % 2 = 0 THEN 1.0 ELSE 0.0 END
  ELSE CASE WHEN k % 3 = 0 THEN k / 100.0 END END::DOUBLE AS score FROM v_events""", views.EVENTS)
def categorical_score(spark, sf):
    kind, k = F.col("event_type"), F.col("k")
    value = (
        F.when(kind == "purchase", "c").when(kind == "click", "P").when(kind == "error", "I")
        .when(kind == "view", F.when(k % 2 == 0, "true").otherwise("false"))
        .otherwise(F.when(k % 3 == 0, (k / 100.0).cast("string")).when(k % 3 == 1, "[1, 0]").otherwise("unclear"))
    )
    json_type = F.when(value == "[1, 0]", "ARRAY<BIGINT>").otherwise("STRING")
    return views.events(spark, sf).select("event_id", scores.categorical_score(value, json_type).alias("score"))


# Settings texts of orders.
def _order_args(spark, sf):
    key = F.col("o_orderkey").cast("string")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.concat(F.lit("pretrained=acme/m-"), key, F.lit(", dtype=bfloat16,stop=a,b"),
                 F.when(F.col("o_orderkey") % 2 == 0, ",temperature=0.5").otherwise(",do_sample=False"),
                 F.when(F.col("o_orderkey") % 3 == 0, ",dtype=float32").otherwise("")).alias("args"),
    )


@query("p29_parse_model_args", """
SELECT o_orderkey, 'acme/m-' || o_orderkey AS pretrained, CASE WHEN o_orderkey % 3 = 0 THEN 'float32' ELSE 'bfloat16' END AS dtype,
  'a,b' AS stop, CASE WHEN o_orderkey % 2 = 0 THEN 4 ELSE 4 END::INT AS n_args FROM orders""")
def parse_model_args(spark, sf):
    parsed = _order_args(spark, sf).withColumn("m", settings.parse_args(F.col("args")))
    at = lambda k: F.try_element_at("m", F.lit(k)).alias(k)
    return parsed.select("o_orderkey", at("pretrained"), at("dtype"), at("stop"), F.size("m").alias("n_args"))


@query("p30_parse_gen_kwargs", """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'float' END AS temperature_type,
  CASE WHEN o_orderkey % 2 = 1 THEN 'bool' END AS do_sample_type, 'str' AS stop_type FROM orders""")
def parse_gen_kwargs(spark, sf):
    parsed = _order_args(spark, sf).withColumn("m", settings.parse_args(F.col("args")))
    kind = lambda k: F.when(F.map_contains_key("m", k), settings.literal_type(F.try_element_at("m", F.lit(k)))).alias(f"{k}_type")
    return parsed.select("o_orderkey", kind("temperature"), kind("do_sample"), kind("stop"))


def _generation(spark, sf):
    key = F.col("o_orderkey")
    run = F.when(key % 5 == 0, "temperature=0.5,top_p=0.9,max_tokens=64").otherwise("do_sample=False")
    task = F.when(key % 3 == 0, "max_gen_toks=128,top_k=5").when(key % 3 == 1, "temperature=1")
    config = settings.generation_config(settings.parse_args(run), settings.parse_args(task))
    kind = F.when(key % 2 == 0, "generate_until").otherwise("multiple_choice")
    return table(spark, sf, "orders").select("o_orderkey", config.alias("g"), kind.alias("output_type"))


_GENERATION = """v_generation AS (
  SELECT o_orderkey, o_orderkey % 2 = 0 AS generative,
    CASE WHEN o_orderkey % 3 = 1 THEN 1.0 WHEN o_orderkey % 5 = 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS temperature,
    CASE WHEN o_orderkey % 5 = 0 THEN 0.9 END::DOUBLE AS top_p, CASE WHEN o_orderkey % 3 = 0 THEN 5.0 END::DOUBLE AS top_k,
    CASE WHEN o_orderkey % 3 = 0 THEN 128 WHEN o_orderkey % 5 = 0 THEN 64 END::BIGINT AS max_tokens
  FROM orders)"""


@query("p31_generation_config", "SELECT o_orderkey, temperature, top_p, top_k, max_tokens FROM v_generation", _GENERATION)
def generation_config(spark, sf):
    return _generation(spark, sf).select("o_orderkey", "g.*")


@query("p31_generation_warnings", """
SELECT o_orderkey, 'order-' || o_orderkey || ': maximum generation tokens are not logged' AS warning
FROM v_generation WHERE generative AND max_tokens IS NULL""", _GENERATION)
def generation_warnings(spark, sf):
    task = F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"))
    return _generation(spark, sf).select("o_orderkey", F.explode(
        settings.generation_warnings(task, F.col("output_type"), F.col("g"))).alias("warning"))


@query("p32_metric_config", """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'accuracy' WHEN 1 THEN 'exact_match' WHEN 2 THEN 'pass_at_' || (p_partkey % 9)
    WHEN 3 THEN 'degeneration' ELSE trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') || '.my_score_x' END AS metric_id,
  CASE p_partkey % 5 WHEN 0 THEN 'Accuracy' WHEN 1 THEN 'Exact match' WHEN 2 THEN 'pass@' || (p_partkey % 9)
    WHEN 3 THEN 'Degeneration rate' ELSE 'My score (x)' END AS metric_name,
  CASE WHEN p_partkey % 5 = 3 THEN true ELSE p_size % 2 = 0 END AS lower_is_better,
  CASE WHEN p_partkey % 5 < 4 THEN 0.0 END::DOUBLE AS min_score, CASE WHEN p_partkey % 5 < 4 THEN 1.0 END::DOUBLE AS max_score,
  CASE p_partkey % 5 WHEN 0 THEN 'acc' WHEN 1 THEN 'exact_match_mean_repeats' WHEN 2 THEN 'pass@' || (p_partkey % 9)
    WHEN 3 THEN 'degeneration' ELSE 'My score (x)' END || CASE WHEN p_size % 3 = 0 THEN ' (filter: strict)' ELSE '' END AS evaluation_description
FROM part""")
def metric_config(spark, sf):
    key = F.col("p_partkey")
    metric = (
        F.when(key % 5 == 0, "acc").when(key % 5 == 1, "exact_match_mean_repeats")
        .when(key % 5 == 2, F.concat(F.lit("pass@"), (key % 9).cast("string")))
        .when(key % 5 == 3, "degeneration").otherwise("My score (x)")
    )
    config = export.metric_config(
        metric, F.when(F.col("p_size") % 3 == 0, "strict").otherwise("none"), F.col("p_brand"), F.col("p_size") % 2 != 0
    )
    return table(spark, sf, "part").select("p_partkey", config.alias("c")).select(
        "p_partkey", "c.metric_id", "c.metric_name", "c.lower_is_better", "c.min_score", "c.max_score", "c.evaluation_description"
    )


@query("p41_run_signature", """
SELECT o_orderkey, sha256('{"configuration":{"limit":"' || (o_orderkey % 7) || '","model":"m-' || o_custkey || '","suite":"'
  || o_orderpriority || '"},"schema_version":1}') AS signature FROM orders""")
def run_signature(spark, sf):
    fields = F.create_map(
        F.lit("suite"), F.col("o_orderpriority"), F.lit("model"), F.concat(F.lit("m-"), F.col("o_custkey").cast("string")),
        F.lit("limit"), (F.col("o_orderkey") % 7).cast("string"),
    )
    return table(spark, sf, "orders").select("o_orderkey", ids.run_signature(fields).alias("signature"))


@query("p43_has_scores", """
SELECT model FROM v_summary WHERE key LIKE '%thinking_length%' GROUP BY model""", views.SUMMARY)
def has_scores(spark, sf):
    cells = views.summary(spark, sf).select("model", F.when(F.contains("key", F.lit("thinking_length")), F.col("score")).alias("score"))
    return metrics.has_scores(cells)
