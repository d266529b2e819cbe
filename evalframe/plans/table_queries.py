"""Leaderboards and sample selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.operators import attempts, export, leaderboard, sampling
from evalframe.plans import views
from evalframe.plans.aggregate_queries import LANGS, REQUESTS, _GROUPED, sample_cells
from evalframe.plans.registry import query, table
from evalframe.plans.sample_queries import _HASHED, converted

BASELINES = ["src6", "src3"]

_AVERAGES = _GROUPED + """, v_averages AS (
  SELECT c.model, round_even(avg(c.score - b.score), 4) AS average
  FROM v_cells c LEFT JOIN (SELECT request, score FROM v_cells WHERE model = 'src6') b USING (request) WHERE c.metric = 'acc' GROUP BY ALL)"""


def _averages(spark, sf):
    cells = sample_cells(spark, sf).where(F.endswith("request", F.lit("/acc")))
    return leaderboard.average_improvement(leaderboard.baseline_delta(cells, BASELINES[0]))


@query("k6_rank_leaderboard", """
SELECT model, average, row_number() OVER (ORDER BY CASE model WHEN 'src6' THEN 0 WHEN 'src3' THEN 1 ELSE 2 END,
  CASE WHEN model NOT IN ('src6', 'src3') THEN average END DESC NULLS LAST, model) AS position FROM v_averages""", _AVERAGES)
def rank_leaderboard(spark, sf):
    return leaderboard.rank_leaderboard(_averages(spark, sf), BASELINES)


@query("k6_rank_by_order", """
SELECT model, average, row_number() OVER (ORDER BY CASE model WHEN 'src6' THEN 0 WHEN 'src3' THEN 1 WHEN 'src9' THEN 2 WHEN 'src1' THEN 3 ELSE 4 END,
  model) AS position FROM v_averages""", _AVERAGES)
def rank_by_order(spark, sf):
    return leaderboard.rank_leaderboard(_averages(spark, sf), BASELINES, model_order=["src9", "src1"])


@query("k7_top_n", """
SELECT model, average FROM v_averages WHERE model IN ('src6', 'src3') UNION ALL
(SELECT model, average FROM v_averages WHERE model NOT IN ('src6', 'src3') ORDER BY average DESC NULLS LAST, model LIMIT 5)""", _AVERAGES)
def top_n(spark, sf):
    return leaderboard.top_n(_averages(spark, sf), 5, BASELINES)


_PIVOTED = ["de/acc", "en_avg/acc", "en/acc", "es/acc", "fr/acc", "fr/generation_truncated"]
_WIDE = _GROUPED + """, v_wide AS (
  SELECT model, round(max(score) FILTER (request = 'de/acc'), 6) AS de, round(max(score) FILTER (request = 'en/acc'), 6) AS en,
    round(max(score) FILTER (request = 'es/acc'), 6) AS es, round(max(score) FILTER (request = 'fr/generation_truncated'), 6) AS fr
  FROM v_cells WHERE request IN ('de/acc', 'en/acc', 'es/acc', 'fr/generation_truncated') GROUP BY ALL)"""


def _pivoted(spark, sf):
    wide = leaderboard.pivot_leaderboard(sample_cells(spark, sf), _PIVOTED)
    return wide.select("model", *[F.round(c, 6).alias(c) for c in LANGS])


@query("k16_pivot_leaderboard", "SELECT * FROM v_wide", _WIDE)
def pivot_leaderboard(spark, sf):
    return _pivoted(spark, sf)


@query("k8_complete_only", "SELECT * FROM v_wide WHERE de IS NOT NULL AND en IS NOT NULL AND es IS NOT NULL AND fr IS NOT NULL", _WIDE)
def complete_only(spark, sf):
    return leaderboard.complete_only(_pivoted(spark, sf), LANGS)


@query("k9_best_badge", """
SELECT model, request, percent, n > 1 AND abs(percent - top) < 0.01 AS best FROM (
  SELECT *, max(percent) OVER (PARTITION BY request) AS top, count(*) OVER (PARTITION BY request) AS n FROM (
    SELECT model, request, round_even(score * 100, 1) AS percent FROM v_cells WHERE metric = 'acc'))""", _GROUPED)
def best_badge(spark, sf):
    cells = sample_cells(spark, sf).where(F.endswith("request", F.lit("/acc")))
    return leaderboard.best_badge(cells).select("model", "request", "percent", "best")


@query("k17_pivot_grouped_table", """
SELECT r.ord, r.grp AS "group", r.request, r.display, c.* EXCLUDE (request)
FROM (VALUES """ + ", ".join(str(r) for r in REQUESTS) + """, (90, 'Empty', 'xx/acc', 'xx')) r(ord, grp, request, display)
LEFT JOIN (PIVOT (SELECT model, request, round(score, 6) AS score FROM v_cells) ON model USING max(score) GROUP BY request) c
  ON c.request = r.request""", _GROUPED)
def pivot_grouped_table(spark, sf):
    cells = sample_cells(spark, sf).withColumn("score", F.round("score", 6))
    requests = leaderboard.request_table(spark, [*REQUESTS, (90, "Empty", "xx/acc", "xx")])
    return leaderboard.pivot_grouped_table(cells, requests)


@query("k18_train_test_split", """
SELECT request, count(*) AS n, CASE WHEN request IN ('agieval/acc', 'de/acc') THEN 'test' ELSE 'train' END AS split FROM v_cells GROUP BY ALL""", _GROUPED)
def train_test_split(spark, sf):
    requests = sample_cells(spark, sf).groupBy("request").agg(F.count("*").alias("n"))
    return leaderboard.split_metrics(requests, ["agieval/acc", "de/acc"])


@query("k19_thinking_groups", """
SELECT f.ord::INT AS ord, f.grp AS "group", t.task || '/' || f.suffix AS request, t.task || ' - ' || f.grp AS display
FROM (SELECT DISTINCT replace(p_name, ' ', '_') AS task FROM part) t, (VALUES (0, 'Thinking Format: Has Open (%)', 'thinking_format_has_open'),
  (1, 'Thinking Format: Has Close (%)', 'thinking_format_has_close'), (2, 'Thinking Format Correct (%)', 'thinking_format_correct'),
  (3, 'Thinking Length (words)', 'thinking_length_words'), (4, 'Response Length (words)', 'response_length_words'), (5, 'Truncated (%)', 'generation_truncated'),
  (6, 'Thinking Truncated (%)', 'generation_think_truncated'), (7, 'Parse Failed (%)', 'generation_parse_failed')) f(ord, grp, suffix)""")
def thinking_groups(spark, sf):
    tasks = table(spark, sf, "part").select(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")).alias("task")).distinct()
    return leaderboard.thinking_groups(tasks, "words", format_detail=True, label_with_group=True)


@query("k17_thinking_table", """
SELECT * FROM (PIVOT (
  SELECT model, key AS request, round(CASE WHEN key LIKE '%length%' OR score BETWEEN 0 AND 1 THEN score ELSE score / 100 END, 6) AS score FROM v_summary
  WHERE regexp_matches(key, '^(gsm8k|code_gen|agieval)/(thinking_format_correct|thinking_length_tokens|response_length_tokens|generation_truncated)$'))
  ON model USING max(score) GROUP BY request)""", views.SUMMARY)
def thinking_table(spark, sf):
    summary = views.summary(spark, sf)
    tasks = ["gsm8k", "code_gen", "agieval"]
    requests = [
        (i, label, f"{task}/{suffix}", task)
        for i, (label, suffix) in enumerate(leaderboard.thinking_specs("tokens")) for task in tasks
    ]
    cells = leaderboard.table_cells(summary, [r[2] for r in requests], thinking=True).withColumn("score", F.round("score", 6))
    return leaderboard.pivot_grouped_table(cells, leaderboard.request_table(spark, requests).select("request"), thinking=True)


@query("k20_format_cells", """
SELECT c.model, c.request, CASE WHEN c.model = 'src6' OR b.score IS NULL THEN printf('%.4f', c.score) ELSE printf('%+.4f', c.score - b.score) END AS text
FROM v_cells c LEFT JOIN (SELECT request, score FROM v_cells WHERE model = 'src6') b USING (request) WHERE c.metric <> 'response_length_chars'""", _GROUPED)
def format_cells(spark, sf):
    cells = sample_cells(spark, sf).where(~F.endswith("request", F.lit("_chars")))
    return leaderboard.format_cells(cells, "src6").select("model", "request", "text")


@query("k20_display_cells", """
SELECT model, request, CASE metric WHEN 'response_length_chars' THEN floor(score + 0.5)::BIGINT::VARCHAR ELSE printf('%.1f', round_even(score * 100, 1)) END AS text
FROM v_cells""", _GROUPED)
def display_cells(spark, sf):
    return leaderboard.display_cells(sample_cells(spark, sf)).select("model", "request", "text")


# --- sample selections --------------------------------------------------------------------------------------------------------

_LABELLED = views.SAMPLES + """, v_labelled AS (SELECT doc_id, task || '_' || model AS task, CASE WHEN task <> 'es' THEN quality = 1 END AS is_correct FROM v_samples)"""


def _labelled(spark, sf):
    return views.samples(spark, sf).select(
        "doc_id", F.concat_ws("_", "task", "model").alias("task"), F.when(F.col("task") != "es", F.col("quality") == 1).alias("is_correct"))


@query("k10_stratified_samples", """
SELECT task, doc_id, is_correct FROM (
  SELECT *, row_number() OVER (PARTITION BY task, is_correct ORDER BY sha256('42:' || doc_id)) AS rn,
    count(*) FILTER (is_correct) OVER (PARTITION BY task) AS n_pos, count(*) FILTER (NOT is_correct) OVER (PARTITION BY task) AS n_neg FROM v_labelled)
WHERE rn <= CASE WHEN is_correct THEN 2 + greatest(3 - n_neg, 0) WHEN NOT is_correct THEN 3 + greatest(2 - n_pos, 0) WHEN n_pos = 0 AND n_neg = 0 THEN 5 ELSE 0 END""", _LABELLED)
def stratified_samples(spark, sf):
    return sampling.stratified_samples(_labelled(spark, sf), id_column="doc_id").select("task", "doc_id", "is_correct")


@query("k10_binary_label", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL WHEN o_orderkey % 5 = 3 THEN o_orderkey % 2 = 0 ELSE o_orderkey % 3 = 0 END AS is_correct FROM orders""")
def binary_label(spark, sf):
    key = F.col("o_orderkey")
    one = lambda hit: F.when(hit, 1.0).otherwise(0.0)
    values = (
        F.when(key % 5 == 4, F.create_map(F.lit("bleu"), F.array(F.lit(1.0))))
        .when(key % 5 == 3, F.create_map(F.lit("exact_match"), F.array(F.lit(1.0), one(key % 2 == 0), F.lit(1.0))))
        .otherwise(F.create_map(F.lit("bleu"), F.array(F.lit(0.5)), F.lit("acc"), F.array(one(key % 3 == 0)))))
    names = F.array(F.lit("bleu"), F.lit("acc"), F.lit("exact_match"))
    return table(spark, sf, "orders").select("o_orderkey", sampling.binary_label(names, values).alias("is_correct"))


_PRIORITY = _HASHED + """, v_priority AS (
  SELECT 'm' || (o_custkey % 5) AS model, 'task' || (o_custkey % 4) AS task, o_orderkey,
    sha256('{"evaluation_name": "fam.bench.overall", "filter": "' || filter || '", "sample_hash": "' || sample_hash || '", "sample_id": "' || o_orderkey || '"}') AS priority
  FROM v_hashed WHERE kind < 2)"""


@query("k11_capped_samples", """
SELECT model, task, o_orderkey::VARCHAR AS sample_id, priority FROM (
  SELECT *, row_number() OVER (PARTITION BY model, task ORDER BY priority, o_orderkey) AS rn FROM v_priority) WHERE rn <= 25""", _PRIORITY)
def capped_samples(spark, sf):
    rows = export.with_priority(converted(spark, sf))
    return sampling.capped_samples(rows, 25, ["model", "task"]).select("model", "task", "instance.sample_id", "priority")


@query("k11_capped_samples_large", """
SELECT model, task, o_orderkey::VARCHAR AS sample_id FROM (
  SELECT *, row_number() OVER (PARTITION BY model, task ORDER BY priority, o_orderkey) AS rn FROM v_priority) WHERE rn <= 200""", _PRIORITY)
def capped_samples_large(spark, sf):
    rows = export.with_priority(converted(spark, sf)).select("model", "task", "ord", "instance.sample_id", "priority")
    return sampling.capped_samples(rows, 200, ["model", "task"]).select("model", "task", "sample_id")


@query("k12_explode_attempts", """
SELECT CASE WHEN o_orderkey % 4 = 3 THEN o_orderkey::VARCHAR ELSE o_orderkey || '/repeat-' || i END AS doc_id, CASE WHEN o_orderkey % 4 < 3 THEN i END AS repeat_index,
  CASE WHEN o_orderkey % 4 = 3 THEN 0.5 ELSE ((o_orderkey + i) % 2)::DOUBLE END::DOUBLE AS acc,
  CASE WHEN o_orderkey % 4 = 3 THEN 'only' ELSE 'r' || i END AS response
FROM orders, (SELECT unnest([0, 1, 2]) AS i) WHERE i <= CASE WHEN o_orderkey % 4 = 3 THEN 0 ELSE o_orderkey % 3 END""")
def explode_attempts(spark, sf):
    key = F.col("o_orderkey")
    repeated = key % 4 < 3
    indices = F.when(repeated, F.sequence(F.lit(0), (key % 3).cast("int")))
    values = F.when(repeated, F.transform(F.array(*[F.lit(i) for i in range(3)]), lambda i: ((key + i) % 2).cast("double"))).otherwise(F.array(F.lit(0.5)))
    responses = F.array(F.when(repeated, F.array(*[F.lit(f"r{i}") for i in range(3)])).otherwise(F.array(F.lit("only"))))
    rows = table(spark, sf, "orders").select(
        key.alias("doc_id"), indices.alias("repeat_indices"), F.create_map(F.lit("acc"), values).alias("values"),
        responses.alias("resps"), responses.alias("filtered_resps"))
    return sampling.explode_attempts(rows).select(
        "doc_id", "repeat_index", F.col("values")["acc"][0].alias("acc"), F.col("resps")[0][0].alias("response"))


@query("k13_random_subset", """
SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY sha256('42:' || p_partkey)) AS rn,
  count(*) OVER (PARTITION BY p_brand) AS n FROM part) WHERE rn <= ceil(0.3::DOUBLE * n)""")
def random_subset(spark, sf):
    return sampling.random_subset(table(spark, sf, "part").select("p_brand", "p_partkey"), 0.3, ["p_brand"], "p_partkey")


@query("k13_random_subset_n", """
SELECT o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY sha256('7:' || o_orderkey)) AS rn FROM orders)
WHERE rn <= 1234""")
def random_subset_n(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderstatus", "o_orderkey")
    return sampling.random_subset(rows, 1234, ["o_orderstatus"], "o_orderkey", seed=7)


_ENTRIES = """v_entries AS (
  SELECT p_brand AS category, p_partkey AS ord, p_partkey % 4 = 0 AS is_prereq, 's' || (p_partkey % 40 // 4) AS scenario, p_size % 5 < 4 AS memory,
    CASE WHEN p_size % 5 < 4 THEN 'memory_kv_' ELSE 'plain_' END || CASE WHEN p_partkey % 4 = 0 THEN 'prereq_' ELSE '' END || p_partkey || '-s' || (p_partkey % 40 // 4) || '-1' AS id
  FROM part)"""


@query("k14_first_n_with_prereqs", """
SELECT category, id, false AS is_prereq FROM v_questions UNION ALL SELECT category, id, true FROM v_entries e WHERE contains(id, '_prereq_') AND EXISTS (
  SELECT 1 FROM v_questions q WHERE q.category = e.category AND starts_with(q.id, 'memory_') AND q.scenario = e.scenario)""", _ENTRIES + """,
v_questions AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY ord) AS rn FROM v_entries WHERE NOT contains(id, '_prereq_')) WHERE rn <= 5)""")
def first_n_with_prereqs(spark, sf):
    key = F.col("p_partkey")
    scenario = F.concat(F.lit("-s"), F.expr("(p_partkey % 40) div 4").cast("string"), F.lit("-1"))
    name = F.concat(
        F.when(F.col("p_size") % 5 < 4, "memory_kv_").otherwise("plain_"), F.when(key % 4 == 0, "prereq_").otherwise(""), key.cast("string"), scenario)
    entries = table(spark, sf, "part").select(F.col("p_brand").alias("category"), key.alias("ord"), name.alias("id"))
    return sampling.first_n_with_prereqs(entries, 5).select("category", "id", "is_prereq")


@query("k15_error_samples", """
SELECT benchmark, trial_name, label FROM (
  SELECT benchmark, trial_name, reward = 1 AS label, reward IS NOT NULL AS scored, row_number() OVER (PARTITION BY benchmark, reward IS NOT NULL,
    CASE WHEN reward IS NOT NULL THEN reward = 1 END ORDER BY CASE WHEN reward IS NOT NULL THEN sha256('42:' || trial_name) ELSE trial_name END) AS rn
  FROM v_trials WHERE reward IN (0, 1) OR event_type IN ('error', 'signup')) WHERE rn <= CASE WHEN NOT scored THEN 3 WHEN label THEN 2 ELSE 3 END""", views.TRIALS)
def error_samples(spark, sf):
    trials = attempts.summarize_trial(views.trials(spark, sf)).select(
        "benchmark", F.col("trial").alias("trial_name"), F.col("rewards").isNotNull().alias("scored"), (F.col("pass@1") == 1.0).alias("is_correct"))
    scored = trials.where("is_correct IS NOT NULL").select("benchmark", "trial_name", "is_correct")
    picked = sampling.stratified_samples(scored, by=["benchmark"], id_column="trial_name")
    unscored = trials.where("NOT scored").select("benchmark", "trial_name")
    return attempts.append_error_samples(picked, unscored, 3, ["benchmark"], [F.col("trial_name")]).select(
        "benchmark", "trial_name", F.col("is_correct").alias("label"))
