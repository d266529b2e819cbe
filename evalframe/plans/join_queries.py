"""Lookups, merges, mappings and document sets."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from evalframe.functions import ids
from evalframe.operators import attempts, docsets, leaderboard, mapping, merge, resolve
from evalframe.operators.mapping import TaskMapping
from evalframe.operators.scale import literal_rows
from evalframe.plans import views
from evalframe.plans.aggregate_queries import _GROUPED, sample_cells
from evalframe.plans.registry import query, table
from evalframe.sources import records

# --- J1-J3, J13: requested metrics --------------------------------------------------------------------------------------

REQUESTS = [
    "agieval/acc", "gsm8k/exact_match", "gsm8k_cot/exact_match,flex", "mgsm/exact_match", "mgsm_en/exact_match",
    "mgsm_de/exact_match", "mmlu_pro_law/exact_match", "mmlu_pro_law/exact_match,custom-extract", "mmlu_pro/exact_match",
    "code_gen/pass@1", "code_gen/pass@1_pass@2", "orbench/refusal", "nothing/acc", "gsm8k",
]

# (request, task, metric, filter, mean key, wants pass@k, multilingual): the parts written out for the SQL
_PARTS = [
    ("agieval/acc", "agieval", "acc", None, "agieval/acc_mean_repeats", False, False),
    ("gsm8k/exact_match", "gsm8k", "exact_match", None, "gsm8k/exact_match_mean_repeats", False, False),
    ("gsm8k_cot/exact_match,flex", "gsm8k_cot", "exact_match", "flex", "gsm8k_cot/exact_match_mean_repeats,flex", False, False),
    ("mgsm/exact_match", "mgsm", "exact_match", None, "mgsm/exact_match_mean_repeats", False, True),
    ("mgsm_en/exact_match", "mgsm_en", "exact_match", None, "mgsm_en/exact_match_mean_repeats", False, False),
    ("mgsm_de/exact_match", "mgsm_de", "exact_match", None, "mgsm_de/exact_match_mean_repeats", False, True),
    ("mmlu_pro_law/exact_match", "mmlu_pro_law", "exact_match", None, "mmlu_pro_law/exact_match_mean_repeats", False, False),
    ("mmlu_pro_law/exact_match,custom-extract", "mmlu_pro_law", "exact_match", "custom-extract",
     "mmlu_pro_law/exact_match_mean_repeats,custom-extract", False, False),
    ("mmlu_pro/exact_match", "mmlu_pro", "exact_match", None, "mmlu_pro/exact_match_mean_repeats", False, False),
    ("code_gen/pass@1", "code_gen", "pass@1", None, "code_gen/pass@1_mean_repeats", False, False),
    ("code_gen/pass@1_pass@2", "code_gen", "pass@1_pass@2", None, None, True, False),
    ("orbench/refusal", "orbench", "refusal", None, "orbench/refusal_mean_repeats", False, False),
    ("nothing/acc", "nothing", "acc", None, "nothing/acc_mean_repeats", False, False),
    ("gsm8k", "gsm8k", None, None, None, False, False),
]


def _value(v):
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'"


_RESOLVE = views.SUMMARY + ", v_requests(request, task, metric, filter, mean_key, wants_pass, multilingual) AS (VALUES " + ", ".join(
    "(" + ", ".join(_value(v) for v in row) + ")" for row in _PARTS) + """),
v_rows AS (SELECT s.model, s.key, s.score, split_part(s.key, '/', 1) AS key_task, p.task IS NOT NULL AS repeated
  FROM v_summary s LEFT JOIN v_protocols p ON p.model = s.model AND p.task = split_part(s.key, '/', 1)),
v_tiers AS (
  SELECT w.model, r.request, r.task, w.key, w.score,
    CASE WHEN w.repeated AND w.key = r.mean_key THEN 1
      WHEN w.repeated AND r.filter IS NULL AND starts_with(w.key, r.mean_key || ',') THEN 2
      WHEN r.multilingual THEN CASE WHEN contains(w.key, 'mgsm') AND NOT contains(w.key, 'stderr')
        AND ends_with(w.key, CASE WHEN w.repeated THEN 'exact_match_mean_repeats' ELSE 'exact_match' END) THEN 3 END
      WHEN w.key = r.request THEN 4
      WHEN NOT contains(w.key, 'stderr') AND (r.wants_pass OR NOT contains(w.key, '_pass@')) AND contains(lower(w.key), lower(r.task))
        AND contains(lower(w.key), lower(coalesce(r.metric, ''))) AND contains(lower(w.key), lower(coalesce(r.filter, ''))) THEN 5 END AS tier
  FROM v_rows w, v_requests r),
v_ranked AS (
  SELECT *, min(tier) OVER g AS best, avg(score) FILTER (tier = 3) OVER g AS mean,
    row_number() OVER (PARTITION BY model, request ORDER BY tier, contains(lower(task), 'gsm8k') AND NOT contains(key, 'strict-match'), length(key), key) AS rn
  FROM v_tiers WHERE tier IS NOT NULL WINDOW g AS (PARTITION BY model, request))"""


@query("j1_resolve_metric", """
SELECT model, request, CASE WHEN best <> 3 THEN key END AS key, round(CASE WHEN best = 3 THEN mean ELSE score END, 6) AS score
FROM v_ranked WHERE rn = 1""", _RESOLVE)
def resolve_metric(spark, sf):
    return resolve.resolve_metrics(views.summary(spark, sf), REQUESTS, views.protocols(spark, sf)).withColumn(
        "score", F.round("score", 6))


@query("j1_resolve_exact", """
SELECT model, request, CASE WHEN best <> 3 THEN key END AS key, round(CASE WHEN best = 3 THEN mean ELSE score END, 6) AS score
FROM v_ranked WHERE rn = 1 AND best < 5""", _RESOLVE)
def resolve_exact(spark, sf):
    return resolve.resolve_metrics(views.summary(spark, sf), REQUESTS, views.protocols(spark, sf), fuzzy=False).withColumn(
        "score", F.round("score", 6))


@query("j2_first_key", """
SELECT model, task, key FROM (SELECT *, row_number() OVER (PARTITION BY model, task ORDER BY
    contains(task, 'gsm8k') AND NOT contains(key, 'strict-match'), length(key), key) AS rn
  FROM (SELECT model, split_part(key, '/', 1) AS task, key FROM v_summary)) WHERE rn = 1""", views.SUMMARY)
def first_key(spark, sf):
    rows = views.summary(spark, sf).select("model", F.substring_index("key", "/", 1).alias("task"), "key", F.col("key").alias("ord"))
    return resolve.first_key(rows, ["model", "task"])


@query("j3_repeat_mean_key", "SELECT model, request, key FROM v_ranked WHERE rn = 1 AND best < 3", _RESOLVE)
def repeat_mean_key(spark, sf):
    return resolve.repeat_mean_keys(views.summary(spark, sf), REQUESTS, views.protocols(spark, sf))


@query("j13_attach_repeat_label", """
SELECT model, request, base || CASE WHEN greedy THEN ' (greedy)' ELSE '' END AS label FROM (
  SELECT p.model, r.request, NOT p.sampling_enabled AND (r.task <> 'code_gen' OR p.model_no % 6 > 0 OR r.wants_pass OR p.model_no % 4 = 0) AS greedy,
    CASE WHEN r.wants_pass THEN 'pass@2 (m=' || p.repeats || ')'
      WHEN x.key IS NOT NULL THEN 'mean@' || CASE WHEN r.task <> 'code_gen' OR p.model_no % 6 > 0 OR p.repeats = 5 THEN p.repeats::VARCHAR
        ELSE '[' || least(p.repeats, 5) || ', ' || greatest(p.repeats, 5) || ']' END END AS base
  FROM v_protocols p JOIN v_requests r ON r.task = p.task
  LEFT JOIN (SELECT * FROM v_ranked WHERE rn = 1 AND best < 3) x ON x.model = p.model AND x.request = r.request)
WHERE base IS NOT NULL""", _RESOLVE)
def attach_repeat_label(spark, sf):
    return resolve.repeat_labels(views.summary(spark, sf), REQUESTS, views.protocols(spark, sf))


# --- J4, U1, U2 ---------------------------------------------------------------------------------------------------------


@query("j4_baseline_delta", """
SELECT c.model, c.request, round(c.score, 6) AS score, round(c.score - b.score, 6) AS delta
FROM v_cells c LEFT JOIN (SELECT request, score FROM v_cells WHERE model = 'src6') b USING (request)""", _GROUPED)
def baseline_delta(spark, sf):
    frame = leaderboard.baseline_delta(sample_cells(spark, sf), "src6")
    return frame.select("model", "request", F.round("score", 6).alias("score"), F.round("delta", 6).alias("delta"))


@query("u1_union_sources", """
SELECT task, metric, round(avg(score), 6) AS score, count(*) AS n FROM (
  SELECT split_part(key, '/', 1) AS task, split_part(key, '/', 2) AS metric, score FROM v_summary
  UNION ALL SELECT benchmark, 'reward', reward FROM v_trials WHERE reward IS NOT NULL
  UNION ALL SELECT 'calls', category, accuracy FROM v_categories) GROUP BY ALL""",
       views.SUMMARY + ", " + views.TRIALS + ", " + views.CATEGORY_VIEW)
def union_sources(spark, sf):
    harness = views.summary(spark, sf).select(
        F.substring_index("key", "/", 1).alias("task"), F.substring_index("key", "/", -1).alias("metric"), "score")
    trials = views.trials(spark, sf).select(
        F.col("benchmark").alias("task"), F.lit("reward").alias("metric"), F.try_element_at("rewards", F.lit("reward")).alias("score"))
    calls = views.categories(spark, sf).select(F.lit("calls").alias("task"), F.col("category").alias("metric"), F.col("accuracy").alias("score"))
    return harness.unionByName(trials.where("score IS NOT NULL")).unionByName(calls).groupBy("task", "metric").agg(
        F.round(F.avg("score"), 6).alias("score"), F.count("*").alias("n"))


@query("u2_needed_runs", """
SELECT source AS run_name FROM documents UNION SELECT 'src' || s_suppkey FROM supplier UNION SELECT 'src' || n_nationkey FROM nation""")
def needed_runs(spark, sf):
    named = lambda name, column: table(spark, sf, name).select(F.concat(F.lit("src"), F.col(column).cast("string")).alias("run_name"))
    return leaderboard.needed_runs(
        table(spark, sf, "documents").select(F.col("source").alias("run_name")), named("supplier", "s_suppkey"), named("nation", "n_nationkey"))


# --- K1-K5, J8-J10: merges -------------------------------------------------------------------------------------------------

# A part holds a task's section only for some keys, so that older parts show through.
_HELD = "(model_no + part) % 4 <> 0"
_PARTS_VIEW = views.RAW + f""", v_sections AS (
  SELECT model, part, 'results' AS section, task, key, raw AS value FROM v_raw WHERE {_HELD}
  UNION ALL SELECT model, part, 'configs', task, 'part', part::VARCHAR FROM v_raw WHERE key = 'alias' AND (model_no + part) % 3 <> 0)"""


def _sections(spark, sf):
    raw = views.raw_results(spark, sf)
    results = raw.where(_HELD).select("model", "part", F.lit("results").alias("section"), "task", "key", F.col("raw").alias("value"))
    configs = raw.where("key = 'alias' AND (model_no + part) % 3 <> 0").select(
        "model", "part", F.lit("configs").alias("section"), "task", F.lit("part").alias("key"), F.col("part").cast("string").alias("value"))
    return results.unionByName(configs)


@query("k1_latest_task_wins", """
SELECT model, part, section, task, key, value FROM (
  SELECT *, rank() OVER (PARTITION BY model, section, task ORDER BY part DESC) AS r FROM v_sections) WHERE r = 1""", _PARTS_VIEW)
def latest_task_wins(spark, sf):
    return merge.latest_task_wins(_sections(spark, sf))


_HISTORY = views.COUNTS + f""", v_results AS (SELECT model, task, part FROM v_counts WHERE {_HELD}),
v_attempts AS (SELECT model, task, part, r AS repeat_index, (k1 + r) / n::DOUBLE AS score
  FROM v_counts, (SELECT unnest([0, 1, 2]) AS r) WHERE r <= part + model_no % 2)"""


def _history(spark, sf):
    rows = views.counts(spark, sf)
    attempts_ = rows.withColumn("repeat_index", F.explode(F.array(*[F.lit(i) for i in range(3)]))).where(
        "repeat_index <= part + model_no % 2"
    ).select("model", "task", "part", "repeat_index", ((F.col("k1") + F.col("repeat_index")) / F.col("n")).alias("score"))
    return attempts_, rows.where(_HELD).select("model", "task", "part")


@query("k2_replace_repeat_history", """
SELECT model, task, repeat_index, part, round(score, 6) AS score FROM (
  SELECT a.*, row_number() OVER (PARTITION BY a.model, a.task, repeat_index ORDER BY a.part DESC) AS rn
  FROM v_attempts a LEFT JOIN (SELECT model, task, max(part) AS last FROM v_results GROUP BY ALL) l ON l.model = a.model AND l.task = a.task
  WHERE l.last IS NULL OR a.part >= l.last) WHERE rn = 1""", _HISTORY)
def replace_repeat_history(spark, sf):
    return merge.replace_repeat_history(*_history(spark, sf)).withColumn("score", F.round("score", 6))


@query("k2_current_protocols", """
SELECT p.model, p.task, p.part FROM (SELECT model, task, max(part) AS part FROM v_attempts GROUP BY ALL) p
LEFT JOIN (SELECT model, task, max(part) AS last FROM v_results GROUP BY ALL) l ON l.model = p.model AND l.task = p.task
WHERE l.last IS NULL OR p.part >= l.last""", _HISTORY)
def current_protocols(spark, sf):
    attempts_, results = _history(spark, sf)
    return merge.current_protocols(attempts_.select("model", "task", "part").distinct(), results)


_NAMED = views.RAW + """, v_numbers AS (SELECT model, task, key AS name, part AS run, TRY_CAST(raw AS DOUBLE) AS score FROM v_raw
  WHERE kind = 'number' AND (length(key) + model_no + part) % 3 <> 0)"""


@query("k3_latest_metric_wins", "SELECT model, task, name, round(arg_max(score, run), 6) AS score FROM v_numbers GROUP BY ALL", _NAMED)
def latest_metric_wins(spark, sf):
    rows = views.raw_results(spark, sf).where("kind = 'number' AND (length(key) + model_no + part) % 3 <> 0").select(
        "model", "task", F.col("key").alias("name"), F.col("part").alias("run"), F.col("raw").cast("double").alias("score"))
    return merge.latest_metric_wins(rows).withColumn("score", F.round("score", 6))


@query("k4_latest_samples_win", """
SELECT model, file, max(part) AS part, arg_max(n, part) AS n_lines FROM (
  SELECT model, 'samples_' || task || '_2025-01-01T00.jsonl' AS file, part, n FROM v_counts)
WHERE NOT starts_with(file, 'samples_mgsm_') GROUP BY ALL""", views.COUNTS)
def latest_samples_win(spark, sf):
    files = views.counts(spark, sf).select(
        "model", F.concat(F.lit("samples_"), "task", F.lit("_2025-01-01T00.jsonl")).alias("file"), "part", F.col("n").alias("n_lines"))
    return merge.latest_samples_win(files, excluded=["mgsm"])


@query("k5_latest_run_by_name", """
SELECT display_name, arg_max(run_id, created * 1000000000 + run_id) AS run_id FROM (
  SELECT o_custkey AS display_name, o_orderkey AS run_id, epoch(o_orderdate)::BIGINT AS created FROM orders) GROUP BY ALL""")
def latest_run_by_name(spark, sf):
    runs = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("display_name"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("created_at"))
    return merge.latest_run_by_name(runs).select("display_name", "run_id")


@query("j8_exclude_tasks", """
SELECT model, part, section, task, count(*) AS n FROM v_sections WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT unnest(['mmlu_pro', 'mgsm', 'gsm8k_cot', 'agi']) AS x) WHERE task = x OR starts_with(task, x || '_') OR starts_with(task, x || '/'))
GROUP BY ALL""", _PARTS_VIEW)
def exclude_tasks(spark, sf):
    failed = spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in ("mmlu_pro", "mgsm", "gsm8k_cot", "agi")])).alias("task"))
    return merge.exclude_tasks(_sections(spark, sf), failed).groupBy("model", "part", "section", "task").agg(F.count("*").alias("n"))


@query("j8_exclude_listed", """
SELECT model, part, section, task, count(*) AS n FROM v_sections
WHERE task NOT LIKE 'mmlu_pro%' AND task NOT LIKE 'mgsm%' AND task NOT IN ('gsm8k_cot', 'agi') GROUP BY ALL""", _PARTS_VIEW)
def exclude_listed(spark, sf):
    rows = merge.exclude_listed(_sections(spark, sf), ["mmlu_pro", "mgsm", "gsm8k_cot", "agi"])
    return rows.groupBy("model", "part", "section", "task").agg(F.count("*").alias("n"))


_SCAN = views.COUNTS + """, v_found AS (
  SELECT DISTINCT '/logs/' || model || '/eval_' || part AS dir, 'eval_' || part AS dir_name, task, model FROM v_counts WHERE (model_no + part + length(task)) % 3 = 0),
v_tasks AS (SELECT DISTINCT model || '/' || task AS task FROM v_counts),
v_done AS (SELECT model || '/' || task AS task, arg_max(dir, dir_name) AS dir FROM v_found
  WHERE NOT contains(task, 'mgsm') OR dir_name >= 'eval_1' GROUP BY ALL)"""


def _scan(spark, sf):
    """Result documents with tasks as keys at different depths, scanned for every key."""
    rows = views.counts(spark, sf).where("(model_no + part + length(task)) % 3 = 0")
    full = F.concat("model", F.lit("/"), "task")
    inner = F.concat(F.lit('"'), full, F.lit('": {"acc": 0.5}'))
    nested = F.when(F.length("task") % 2 == 0, F.concat(F.lit('{"results": {'), inner, F.lit("}}"))).otherwise(
        F.concat(F.lit('{"groups": [{"deep": {'), inner, F.lit('}}], "note": "\\"x\\": 1"}')))
    payloads = rows.select(
        F.concat(F.lit("/logs/"), "model", F.lit("/eval_"), F.col("part").cast("string")).alias("dir"),
        F.concat(F.lit("eval_"), F.col("part").cast("string")).alias("dir_name"), nested.alias("payload"))
    found = payloads.select("dir", "dir_name", F.explode(records.json_keys("payload")).alias("key"))
    tasks = views.counts(spark, sf).select(full.alias("task")).distinct()
    return tasks, merge.completed_tasks(found, tasks, ["mgsm"], "eval_1")


@query("j9_missing_tasks", "SELECT task FROM v_tasks WHERE task NOT IN (SELECT task FROM v_done)", _SCAN)
def missing_tasks(spark, sf):
    return merge.missing_tasks(*_scan(spark, sf))


@query("j9_result_dirs", "SELECT DISTINCT dir FROM v_done", _SCAN)
def result_dirs(spark, sf):
    return merge.result_dirs(_scan(spark, sf)[1])


@query("j9_same_settings", """
SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'""")
def same_settings(spark, sf):
    fields = F.create_map(F.lit("suite"), F.col("o_orderpriority"), F.lit("backend"), F.col("o_orderstatus"))
    runs = table(spark, sf, "orders").select("o_orderkey", ids.run_signature(fields).alias("signature"))
    wanted = hashlib.sha256(b'{"configuration":{"backend":"F","suite":"1-URGENT"},"schema_version":1}').hexdigest()
    return merge.same_settings(runs, wanted).select("o_orderkey")


@query("j10_completed_task_match", "SELECT task, dir FROM v_done", _SCAN)
def completed_task_match(spark, sf):
    return _scan(spark, sf)[1]


# --- J5-J7, J15-J17, P33, P34, U3: mapping -----------------------------------------------------------------------------------

MAPPINGS = [
    TaskMapping("segment_building", "building", family="segments", split="main"),
    TaskMapping("gsm8k", "gsm8k"),
    TaskMapping("segment", "segments", pattern=r"segment_(?P<name>[a-z]+)_(?P<n>\d+)", split_template="{name} no__{n}", configless_is_overall=True),
    TaskMapping("brand", "brands", pattern=r"^brand_(?:x_)?(?P<split>.+)$"),
    TaskMapping("brand_rest", "late", pattern=r"brand_.*", split_template="rest"),
]


@query("j5_map_task", r"""
SELECT id, task, CASE WHEN task = 'segment_building' THEN 'segment_building' WHEN task = 'gsm8k_self_consistency' THEN 'gsm8k'
    WHEN regexp_full_match(task, 'segment_[a-z]+_\d+') THEN 'segment' WHEN regexp_full_match(task, 'brand_(x_)?.+') THEN 'brand' END AS root,
  CASE WHEN task = 'segment_building' THEN 'segment_building' WHEN task = 'gsm8k_self_consistency' THEN 'gsm8k'
    WHEN regexp_full_match(task, 'segment_[a-z]+_\d+|brand_.+') THEN task END AS alias,
  CASE WHEN task = 'segment_building' THEN 'main' WHEN task = 'gsm8k_self_consistency' THEN 'overall'
    WHEN regexp_full_match(task, 'segment_[a-z]+_\d+') THEN regexp_replace(task, 'segment_([a-z]+)_(\d+)', '\1_no_\2') || CASE WHEN has_config THEN '' ELSE '_overall' END
    WHEN task LIKE 'brand_%' THEN regexp_replace(task, '^brand_(x_)?', '') END AS split
FROM v_names""", """v_names AS (
  SELECT c_custkey AS id, c_custkey % 2 = 0 AS has_config, CASE c_custkey % 5 WHEN 0 THEN 'segment_building' WHEN 1 THEN 'gsm8k_self_consistency'
    WHEN 2 THEN 'segment_' || lower(c_mktsegment) || '_' || c_custkey WHEN 3 THEN 'brand_' || CASE WHEN c_custkey % 2 = 0 THEN 'x_' ELSE '' END || c_nationkey
    ELSE 'unknown_' || c_custkey END AS task FROM customer)""")
def map_task(spark, sf):
    key = F.col("c_custkey")
    task = (
        F.when(key % 5 == 0, "segment_building").when(key % 5 == 1, "gsm8k_self_consistency")
        .when(key % 5 == 2, F.concat(F.lit("segment_"), F.lower("c_mktsegment"), F.lit("_"), key.cast("string")))
        .when(key % 5 == 3, F.concat(F.lit("brand_"), F.when(key % 2 == 0, "x_").otherwise(""), F.col("c_nationkey").cast("string")))
        .otherwise(F.concat(F.lit("unknown_"), key.cast("string"))))
    rows = table(spark, sf, "customer").select(key.alias("id"), task.alias("task"), (key % 2 == 0).alias("has_config"))
    return mapping.map_tasks(rows, MAPPINGS).select("id", "task", "root", "alias", "split")


# Scored tasks of each brand: the brand's types, their sizes, and the single parts.
_SCORED = """v_scored AS (
  SELECT DISTINCT * FROM (
    SELECT lower(p_brand) AS model, lower(p_type) AS task, false AS has_config, true AS is_group FROM part
    UNION ALL SELECT lower(p_brand), lower(p_type) || '_' || p_size, p_size % 2 = 0, false FROM part
    UNION ALL SELECT lower(p_brand), lower(p_type) || '_' || p_size || '_' || p_partkey, true, false FROM part))"""


def _scored_tasks(spark, sf):
    part = table(spark, sf, "part")
    kind, size, number = F.lower("p_type"), F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    rows = F.array(
        F.struct(kind.alias("task"), F.lit(False).alias("has_config"), F.lit(True).alias("is_group")),
        F.struct(F.concat_ws("_", kind, size).alias("task"), (F.col("p_size") % 2 == 0).alias("has_config"), F.lit(False).alias("is_group")),
        F.struct(F.concat_ws("_", kind, size, number).alias("task"), F.lit(True).alias("has_config"), F.lit(False).alias("is_group")))
    return part.select(F.lower("p_brand").alias("model"), F.explode(rows).alias("t")).select("model", "t.*").distinct()


@query("j6_internal_parent", """
SELECT t.model, t.task, coalesce(p.task, t.task) AS benchmark, CASE WHEN p.task IS NULL THEN 'overall'
  ELSE substr(t.task, length(p.task) + 2) || CASE WHEN EXISTS (SELECT 1 FROM v_scored c WHERE c.model = t.model AND starts_with(c.task, t.task || '_'))
    THEN '_overall' ELSE '' END END AS split
FROM v_scored t LEFT JOIN (SELECT t.model, t.task AS child, arg_min(c.task, length(c.task)) AS task FROM v_scored t JOIN v_scored c
  ON c.model = t.model AND starts_with(t.task, c.task || '_') AND (c.is_group OR NOT c.has_config) GROUP BY ALL) p
  ON p.model = t.model AND p.child = t.task""", _SCORED)
def internal_parent(spark, sf):
    return mapping.internal_parents(_scored_tasks(spark, sf)).select("model", "task", "benchmark", "split")


_EDGES = """v_edges AS (
  SELECT 'region_' || n_regionkey AS parent, 'nation_' || n_nationkey AS child FROM nation
  UNION SELECT 'nation_' || c_nationkey, 'customer_' || c_custkey FROM customer
  UNION SELECT 'nation_' || s_nationkey, 'supplier_' || s_suppkey FROM supplier
  UNION SELECT 'customer_' || c_custkey, 'nation_' || c_nationkey FROM customer WHERE c_custkey % 100 = 0
  UNION SELECT 'customer_' || o_custkey, 'order_' || o_orderkey FROM orders)"""


def _edges(spark, sf):
    name = lambda prefix, column: F.concat(F.lit(prefix), F.col(column).cast("string"))
    edge = lambda t, a, ca, b, cb: table(spark, sf, t).select(name(a, ca).alias("parent"), name(b, cb).alias("child"))
    cycle = table(spark, sf, "customer").where("c_custkey % 100 = 0").select(
        name("customer_", "c_custkey").alias("parent"), name("nation_", "c_nationkey").alias("child"))
    return (
        edge("nation", "region_", "n_regionkey", "nation_", "n_nationkey")
        .unionByName(edge("customer", "nation_", "c_nationkey", "customer_", "c_custkey"))
        .unionByName(edge("supplier", "nation_", "s_nationkey", "supplier_", "s_suppkey"))
        .unionByName(edge("orders", "customer_", "o_custkey", "order_", "o_orderkey")).unionByName(cycle))


_DESCENDANTS = "RECURSIVE " + _EDGES + """, v_below(root, task) AS (
  SELECT 'region_' || r_regionkey, child FROM region JOIN v_edges ON parent = 'region_' || r_regionkey
  UNION SELECT b.root, e.child FROM v_below b JOIN v_edges e ON e.parent = b.task)"""


@query("j7_group_descendants", "SELECT root, task FROM v_below", _DESCENDANTS)
def group_descendants(spark, sf):
    roots = table(spark, sf, "region").select(F.concat(F.lit("region_"), F.col("r_regionkey").cast("string")).alias("task"))
    return mapping.group_descendants(_edges(spark, sf), roots)


@query("j7_prefix_descendants", "SELECT model, task FROM v_scored WHERE starts_with(task, 'small_') AND task <> 'small_gen_0shot'", _SCORED)
def prefix_descendants(spark, sf):
    return mapping.prefix_descendants(_scored_tasks(spark, sf), "small_gen_0shot").select("model", "task")


_META = "RECURSIVE " + _SCORED + """, v_kinds AS (
  SELECT DISTINCT lower(p_brand) AS model, lower(p_type) AS kind, lower(p_type) || '_' || p_size AS sized,
    lower(p_type) || '_' || p_size || '_' || p_partkey AS single, p_partkey FROM part),
v_meta AS (
  SELECT model, kind AS parent, sized AS child FROM v_kinds WHERE length(kind) % 2 = 0
  UNION SELECT model, sized, single FROM v_kinds WHERE length(kind) % 2 = 0
  UNION SELECT model, single, kind FROM v_kinds WHERE p_partkey % 40 = 0),
v_selectors AS (
  SELECT model, kind AS selector FROM v_kinds UNION SELECT model, single FROM v_kinds WHERE p_partkey % 20 = 0
  UNION SELECT model, 'none' FROM v_kinds UNION SELECT model, split_part(kind, '_', 1) FROM v_kinds),
v_tree(model, root, task) AS (
  SELECT s.model, s.selector, child FROM v_selectors s JOIN v_meta m ON m.model = s.model AND parent = selector
  UNION SELECT t.model, root, child FROM v_tree t JOIN v_meta m ON m.model = t.model AND parent = t.task)"""


@query("j7_select_aggregates", """
SELECT s.model, s.selector, r.task AS aggregate, coalesce(t.task, n.task) AS task,
  CASE WHEN r.task IS NULL THEN (SELECT count(*) FROM v_scored x WHERE x.model = s.model AND starts_with(x.task, s.selector || '_')) END AS n_similar,
  CASE WHEN r.task IS NULL THEN 'no scored aggregate of that name' WHEN coalesce(t.task, n.task) IS NULL THEN 'no task below the aggregate' END AS error
FROM v_selectors s LEFT JOIN (SELECT DISTINCT model, task FROM v_scored) r ON r.model = s.model AND r.task = s.selector
LEFT JOIN v_tree t ON t.model = r.model AND t.root = r.task
LEFT JOIN (SELECT DISTINCT model, task FROM v_scored) n ON t.task IS NULL AND n.model = r.model AND starts_with(n.task, r.task || '_')""", _META)
def select_aggregates(spark, sf):
    """Sized kinds and single parts below each kind, by metadata where it is logged, else by name; some selectors fail."""
    kind = F.lower("p_type")
    rows = table(spark, sf, "part").select(
        F.lower("p_brand").alias("model"), kind.alias("kind"), F.concat_ws("_", kind, F.col("p_size").cast("string")).alias("sized"),
        F.concat_ws("_", kind, F.col("p_size").cast("string"), F.col("p_partkey").cast("string")).alias("single"), "p_partkey")
    even = rows.where("length(kind) % 2 = 0")
    edge = lambda frame, parent, child: frame.select("model", F.col(parent).alias("parent"), F.col(child).alias("child"))
    groups = edge(even, "kind", "sized").unionByName(edge(even, "sized", "single")).unionByName(
        edge(rows.where("p_partkey % 40 = 0"), "single", "kind"))
    named = lambda frame, column: frame.select("model", column.alias("selector"))
    selectors = named(rows, F.col("kind")).unionByName(named(rows.where("p_partkey % 20 = 0"), F.col("single"))).unionByName(
        named(rows, F.lit("none"))).unionByName(named(rows, F.substring_index("kind", "_", 1)))
    found = mapping.select_aggregates(_scored_tasks(spark, sf), groups, selectors)
    count = F.when(F.col("aggregate").isNull(), F.coalesce(F.size("similar"), F.lit(0)).cast("long"))
    return found.select("model", "selector", "aggregate", "task", count.alias("n_similar"), "error")


@query("u3_exclusion_set", """
SELECT task FROM (SELECT 'nation_' || n_nationkey AS task FROM nation UNION SELECT task FROM v_below) WHERE task NOT IN (
  SELECT 'region_' || r_regionkey FROM region) AND task NOT LIKE 'supplier_%'""", _DESCENDANTS)
def exclusion_set(spark, sf):
    named = lambda t, prefix, column: table(spark, sf, t).select(F.concat(F.lit(prefix), F.col(column).cast("string")).alias("task"))
    aggregates = named("region", "region_", "r_regionkey").unionByName(named("supplier", "supplier_", "s_suppkey"))
    return mapping.exclusion_set(named("nation", "nation_", "n_nationkey"), group_descendants(spark, sf), aggregates)


@query("p33_source_data", """
SELECT t.model, t.task, coalesce(t.dataset, s.dataset) AS dataset_id, coalesce(t.dataset, s.dataset, 'bench') AS dataset_name,
  CASE WHEN coalesce(t.dataset, s.dataset) LIKE '%/%' THEN 'hf_dataset' ELSE 'other' END AS source_type
FROM v_sets t LEFT JOIN (SELECT p.model, p.task, min(c.dataset) AS dataset FROM v_sets p JOIN v_sets c ON c.model = p.model
    AND starts_with(c.task, p.task || '_') AND c.dataset LIKE '%/%' GROUP BY ALL HAVING count(DISTINCT c.dataset) = 1) s
  ON s.model = t.model AND s.task = t.task""", _SCORED + """, v_sets AS (
  SELECT model, task, CASE WHEN length(task) - length(replace(task, '_', '')) = 2 THEN
    CASE WHEN split_part(task, '_', 2)::INT % 3 = 0 THEN 'local' WHEN split_part(task, '_', 2)::INT % 3 = 1 THEN 'acme/' || split_part(task, '_', 2)
      ELSE 'acme/' || split_part(task, '_', 3) END END AS dataset FROM v_scored)""")
def source_data(spark, sf):
    task, middle = F.col("task"), F.split_part("task", F.lit("_"), F.lit(2))
    number = middle.try_cast("int") % 3
    leaf = F.length(task) - F.length(F.replace(task, F.lit("_"), F.lit(""))) == 2
    dataset = F.when(leaf, F.when(number == 0, "local").when(number == 1, F.concat(F.lit("acme/"), middle)).otherwise(
        F.concat(F.lit("acme/"), F.split_part("task", F.lit("_"), F.lit(3)))))
    rows = _scored_tasks(spark, sf).select("model", "task", F.lit("bench").alias("benchmark"), dataset.alias("dataset"))
    return mapping.source_data(rows, rows.where("dataset IS NOT NULL")).select("model", "task", "dataset_id", "dataset_name", "source_type")


@query("p34_uncertainty", """
SELECT a.model, a.part, a.task, split_part(a.key, ',', 1) AS metric, CASE WHEN contains(a.key, ',') THEN split_part(a.key, ',', 2) ELSE 'none' END AS filter,
  round(a.raw::DOUBLE, 6) AS score, round(e.raw::DOUBLE, 6) AS standard_error
FROM v_raw a LEFT JOIN v_raw e ON e.model = a.model AND e.part = a.part AND e.task = a.task AND e.kind = 'number'
  AND e.key = split_part(a.key, ',', 1) || '_stderr,' || split_part(a.key, ',', 2)
WHERE a.kind = 'number' AND NOT contains(a.key, '_stderr')""", views.RAW)
def uncertainty(spark, sf):
    rows = views.raw_results(spark, sf).where("kind = 'number'").withColumn("score", F.col("raw").cast("double"))
    return mapping.uncertainty(rows, ("model", "part", "task")).withColumns(
        {c: F.round(c, 6) for c in ("score", "standard_error")})


# Candidates of tasks, in order: some absent, some with a repeat count to fill in.
_CANDIDATES = [
    ("agieval", 0, "acc_norm,none"), ("agieval", 1, "acc,none"), ("gsm8k", 0, "exact_match,strict-match"),
    ("gsm8k", 1, "exact_match,flexible"), ("mmlu_pro", 0, "exact_match,other"), ("code_gen", 0, "pass@1_pass@{repeats},none"),
    ("code_gen", 1, "pass@1,none"),
]


def _candidate_table(spark):
    rows = [(t, p, c, 2 if "{" in c else None) for t, p, c in _CANDIDATES]
    return spark.range(1).select(F.explode(literal_rows(
        rows, [("task", "string"), ("pos", "int"), ("candidate", "string"), ("repeats", "int")])).alias("c")).select(
        "c.*", F.lit(False).alias("repeat_scoring"), F.lit(True).alias("keeps_mean"), F.lit(None).cast("string").alias("repeat_filter"))


_HEADLINE = views.SUMMARY + """, v_metrics AS (SELECT model, split_part(key, '/', 1) AS task, split_part(key, '/', 2) AS key, score FROM v_summary
  WHERE NOT contains(key, '_stderr')),
v_candidates(task, pos, key) AS (VALUES """ + ", ".join(
    f"('{t}', {p}, '{c.replace('{repeats}', '2')}')" for t, p, c in _CANDIDATES) + """),
v_hits AS (SELECT m.model, m.task, arg_min(m.key, pos) AS key, arg_min(score, pos) AS score FROM v_metrics m JOIN v_candidates c
  ON c.task = m.task AND c.key = m.key GROUP BY ALL)"""


def _summary_metrics(spark, sf):
    return views.summary(spark, sf).where("NOT contains(key, '_stderr')").select(
        "model", F.substring_index("key", "/", 1).alias("task"), F.substring_index("key", "/", -1).alias("key"), "score")


@query("j16_select_headline", """
SELECT model, task, key, round(score, 6) AS score FROM v_hits UNION ALL
SELECT model, task, key, round(score, 6) FROM v_metrics m WHERE NOT contains(key, '_pass@')
  AND NOT EXISTS (SELECT 1 FROM v_hits h WHERE h.model = m.model AND h.task = m.task)""", _HEADLINE)
def select_headline(spark, sf):
    candidates = mapping.expand_candidates(_candidate_table(spark))
    return mapping.select_headline(_summary_metrics(spark, sf), candidates).withColumn("score", F.round("score", 6))


@query("j17_metric_mismatch", """
SELECT DISTINCT model, task FROM v_metrics m WHERE task IN (SELECT task FROM v_candidates)
  AND NOT EXISTS (SELECT 1 FROM v_hits h WHERE h.model = m.model AND h.task = m.task)""", _HEADLINE)
def metric_mismatch(spark, sf):
    return mapping.metric_mismatch(_summary_metrics(spark, sf), mapping.expand_candidates(_candidate_table(spark)))


@query("j15_scoped_hashes", """
SELECT t.model, t.task, sha1(t.task) AS hash FROM v_scored t WHERE EXISTS (
  SELECT 1 FROM v_scored r WHERE r.model = t.model AND r.has_config AND (r.task = t.task OR starts_with(r.task, t.task || '_')))""", _SCORED)
def scoped_hashes(spark, sf):
    rows = _scored_tasks(spark, sf)
    return mapping.scoped_hashes(rows.select("model", "task", F.sha1("task").alias("hash")), rows.where("has_config"))


@query("j14_zero_missing_reward", """
SELECT benchmark, trial_name, CASE WHEN exception_type = 'RewardFileNotFoundError' THEN 0.0 ELSE reward END::DOUBLE AS reward FROM v_trials""", views.TRIALS)
def zero_missing_reward(spark, sf):
    trials = views.trials(spark, sf)
    listed = trials.where(F.col("exception_type") == attempts.NO_REWARD_FILE).select("benchmark", "trial_name")
    return attempts.zero_missing_reward(trials, listed).select(
        "benchmark", "trial_name", F.try_element_at("rewards", F.lit("reward")).alias("reward"))


# --- J11, J12: document sets ---------------------------------------------------------------------------------------------------


# A question for every ten documents; its set are these ten, listed out of order.
_ORDER = [3, 0, 7, 4, 1, 8, 5, 2, 9, 6]


def _doc_questions(spark, sf):
    docs = table(spark, sf, "documents")
    first = F.expr("doc_id div 10")
    names = F.array_join(F.transform(F.array(*[F.lit(i) for i in _ORDER]), lambda i: F.concat(
        F.lit("d"), (first * 10 + i).cast("string"), F.lit(".txt"))), ";")
    questions = docs.where("doc_id % 10 = 0").select(
        F.col("doc_id").alias("question_id"), F.concat(F.lit("set"), first.cast("string")).alias("directory"), names.alias("data_source_filenames"))
    files = docs.select(
        F.concat(F.lit("set"), first.cast("string")).alias("directory"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), "text")
    return questions, files


@query("j11_assemble_doc_sets", """
SELECT first * 10 AS question_id, CASE WHEN count(*) = 10 THEN sha256(string_agg(
  'BEGIN DOCUMENT ' || pos || ':' || chr(10) || text || chr(10) || 'END DOCUMENT ' || pos, chr(10) || chr(10) ORDER BY pos)) END AS documents,
  (10 - count(*))::INT AS n_missing
FROM (SELECT doc_id // 10 AS first, doc_id % 10 AS place, list_position([3, 0, 7, 4, 1, 8, 5, 2, 9, 6], doc_id % 10) AS pos, text FROM documents)
GROUP BY first HAVING bool_or(place = 0)""")
def assemble_doc_sets(spark, sf):
    return docsets.assemble_doc_sets(*_doc_questions(spark, sf)).select(
        "question_id", F.sha2("documents_text", 256).alias("documents"), F.size("missing_documents").alias("n_missing"))


# Names of part files per brand; every seventh file name lost a letter, every eleventh name has no file at all.
_FILES = """v_names AS (
  SELECT p_brand AS directory, p_name || ' no ' || p_partkey || ' ' || md5(p_partkey::VARCHAR) || '.txt' AS name, p_partkey FROM part)"""


def _named_files(spark, sf):
    name = F.concat("p_name", F.lit(" no "), F.col("p_partkey").cast("string"), F.lit(" "), F.md5(F.col("p_partkey").cast("string")), F.lit(".txt"))
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("directory"), name.alias("name"), "p_partkey")
    damaged = F.when(F.col("p_partkey") % 7 == 3, F.concat(F.left("name", F.lit(4)), F.lit("#~"), F.expr("substring(name, 6)"))).otherwise(F.col("name"))
    return rows.select("directory", "name"), rows.where("p_partkey % 11 <> 5").select("directory", damaged.alias("name"))


@query("j12_pair_corrupted_names", """
SELECT directory, name, CASE WHEN p_partkey % 7 = 3 THEN left(name, 4) || '#~' || substr(name, 6) ELSE name END AS file
FROM v_names WHERE p_partkey % 11 <> 5""", _FILES)
def pair_corrupted_names(spark, sf):
    return docsets.pair_names(*_named_files(spark, sf))


@query("j12_unresolved_names", "SELECT directory, name FROM v_names WHERE p_partkey % 11 = 5", _FILES)
def unresolved_names(spark, sf):
    names, files = _named_files(spark, sf)
    return docsets.unresolved_names(names, docsets.pair_names(names, files))
