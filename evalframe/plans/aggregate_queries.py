"""Rewards, grades, categories and averages."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.functions import text
from evalframe.functions.samples import sample_score
from evalframe.operators import attempts, categories, export, grades, leaderboard
from evalframe.operators.resolve import multilingual_mean
from evalframe.plans import views
from evalframe.plans.registry import query, table
from evalframe.plans.sample_queries import (
    _KEYS, _REVIEWS, _inference_causes, _messages, _reviews, _verdicts, harness_line_fields,
)

# C(c, k) / C(n, k) for k up to 3, written out.
_RATIO = """CASE k WHEN 1 THEN c / n::DOUBLE WHEN 2 THEN c * greatest(c - 1, 0) / (n * (n - 1))::DOUBLE
  ELSE c * greatest(c - 1, 0) * greatest(c - 2, 0) / (n * (n - 1) * (n - 2))::DOUBLE END"""


@query("a1_pass_hat_k", f"""
SELECT domain, k, round(avg({_RATIO}), 6) AS score
FROM (SELECT domain, task_id, count(*) AS n, count(*) FILTER (reward = 1) AS c FROM v_sims WHERE reward IS NOT NULL GROUP BY ALL),
  (SELECT unnest([1, 2, 3]) AS k) WHERE n >= k GROUP BY ALL""", views.SIMS)
def pass_hat_k(spark, sf):
    scored = views.simulations(spark, sf).where("reward IS NOT NULL")
    return attempts.pass_hat_k(scored, 3).withColumn("score", F.round("score", 6))


_SIM_SUMMARY = views.SIMS + f""", v_tasks AS (SELECT domain, task_id, count(reward) AS scored, count(*) FILTER (reward IS NULL AND cause IS NOT NULL) AS failed,
    count(*) FILTER (cause = 'empty_reply') AS empty, count(*) FILTER (reward IS NULL AND cause IS NULL) AS unscored,
    count(*) FILTER (reward = 1) AS c, coalesce(sum(reward), 0) AS rewards FROM v_sims GROUP BY ALL),
v_sums AS (SELECT domain, count(*) FILTER (scored + failed > 0) AS tasks, sum(scored) AS scored, sum(failed) AS failed, sum(empty) AS empty,
    sum(unscored) AS unscored, sum(rewards) AS rewards FROM v_tasks GROUP BY domain HAVING sum(scored + failed) > 0),
v_passes AS (SELECT domain, k, avg(CASE WHEN n1 >= k THEN a END) AS a, avg(CASE WHEN n2 >= k THEN b END) AS b FROM (
  SELECT t.domain, k, scored + failed AS n1, scored AS n2, (SELECT {_RATIO} FROM (SELECT scored + failed AS n)) AS a,
    CASE WHEN scored >= k THEN (SELECT {_RATIO} FROM (SELECT scored AS n)) END AS b
  FROM v_tasks t, (SELECT unnest([1, 2, 3]) AS k) WHERE scored + failed >= k) GROUP BY ALL)"""


@query("a2_sim_summary", """
SELECT domain, metric, round(score::DOUBLE, 6) AS score FROM (
  SELECT domain, 'avg_reward' AS metric, rewards / (scored + failed) AS score FROM v_sums
  UNION ALL SELECT domain, 'n_tasks', tasks FROM v_sums UNION ALL SELECT domain, 'n_simulations', scored + failed FROM v_sums
  UNION ALL SELECT domain, 'n_agent_failures', failed FROM v_sums UNION ALL SELECT domain, 'n_empty_replies', empty FROM v_sums
  UNION ALL SELECT domain, 'n_context_overflows', failed - empty FROM v_sums UNION ALL SELECT domain, 'n_unscored', unscored FROM v_sums
  UNION ALL SELECT domain, 'n_missing', greatest(1000000 - scored - failed - unscored, 0) FROM v_sums
  UNION ALL SELECT domain, 'avg_reward_excluding_agent_failures', rewards / scored FROM v_sums WHERE failed > 0 AND scored > 0
  UNION ALL SELECT domain, 'pass^' || k, a FROM v_passes
  UNION ALL SELECT domain, 'pass^' || k || '_excluding_agent_failures', b FROM v_passes JOIN v_sums USING (domain)
    WHERE failed > 0 AND scored > 0 AND b IS NOT NULL)""", _SIM_SUMMARY)
def sim_summary(spark, sf):
    return attempts.simulation_summary(views.simulations(spark, sf), 3, expected=1_000_000).withColumn(
        "score", F.round("score", 6))


_MEAN_REWARD = """
SELECT benchmark, CASE WHEN count(r) > 0 THEN round(avg(CASE WHEN scored THEN coalesce(r, 0) END), 6) END AS mean_reward, count(*) AS n_trials,
  count(*) FILTER (scored) AS n_scored, count(*) FILTER (NOT scored) AS n_errors
FROM (SELECT benchmark, {reward} AS r, {scored} AS scored FROM v_trials) GROUP BY ALL"""
_SCORED = "event_type IN ('purchase', 'view', 'click')"
_ZEROED = "coalesce(exception_type = 'RewardFileNotFoundError', false)"


def _rounded_summary(frame):
    return frame.withColumn("mean_reward", F.round("mean_reward", 6))


@query("a3_trial_summary", _MEAN_REWARD.format(reward="reward", scored=_SCORED), views.TRIALS)
def trial_summary(spark, sf):
    return _rounded_summary(attempts.trial_summary(views.trials(spark, sf)))


@query("a3_trial_summary_zeroed", _MEAN_REWARD.format(
    reward=f"CASE WHEN {_ZEROED} THEN 0.0 ELSE reward END", scored=f"({_SCORED} OR {_ZEROED})"), views.TRIALS)
def trial_summary_zeroed(spark, sf):
    return _rounded_summary(attempts.trial_summary(views.trials(spark, sf), missing_reward_is_zero=True))


@query("a3_reward_means", """
SELECT benchmark, metric, round(avg(value), 6) AS score FROM (
  SELECT benchmark, 'reward' AS metric, reward AS value FROM v_trials UNION ALL SELECT benchmark, 'strict', strict FROM v_trials)
WHERE value IS NOT NULL GROUP BY ALL""", views.TRIALS)
def reward_means(spark, sf):
    return attempts.reward_means(views.trials(spark, sf)).withColumn("score", F.round("score", 6))


@query("a3_errors_by_type", """
SELECT benchmark, coalesce(exception_type, 'no reward') AS error_type, count(*) AS n FROM v_trials
WHERE event_type IN ('error', 'signup') GROUP BY ALL""", views.TRIALS)
def errors_by_type(spark, sf):
    return attempts.errors_by_type(views.trials(spark, sf))


@query("a4_trial_metrics", """
SELECT benchmark, metric, round(score::DOUBLE, 6) AS score FROM (
  SELECT benchmark, 'reward' AS metric, avg(reward) AS score FROM v_trials GROUP BY ALL HAVING count(reward) > 0
  UNION ALL SELECT benchmark, 'strict', avg(strict) FROM v_trials GROUP BY ALL HAVING count(strict) > 0
  UNION ALL SELECT benchmark, 'n_trials', count(*) FROM v_trials GROUP BY ALL
  UNION ALL SELECT benchmark, 'n_scored', count(*) FROM v_trials WHERE event_type IN ('purchase', 'view', 'click') GROUP BY ALL
  UNION ALL SELECT benchmark, 'n_errors', count(*) FROM v_trials WHERE event_type IN ('error', 'signup') GROUP BY ALL
  UNION ALL SELECT benchmark, 'pass@2', avg(1 - (n - c) * greatest(n - c - 1, 0) / (n * (n - 1))::DOUBLE) FROM (
    SELECT benchmark, task_name, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS c FROM v_trials GROUP BY ALL)
    WHERE n >= 2 GROUP BY ALL)""", views.TRIALS)
def trial_metrics(spark, sf):
    trials = views.trials(spark, sf)
    success = F.coalesce(F.try_element_at("rewards", F.lit("reward")), F.lit(0.0))
    passed = attempts.repeat_means(
        trials.select("benchmark", F.col("task_name").alias("doc_id"), success.alias("value")), [2], ["benchmark"]
    ).where("pass_at_2 IS NOT NULL").select("benchmark", F.lit(2).alias("k"), F.col("pass_at_2").alias("score"))
    return attempts.trial_metrics(attempts.trial_summary(trials), attempts.reward_means(trials), passed).withColumn(
        "score", F.round("score", 6))


@query("a5_report_metrics", """
SELECT model, dataset, max(n)::BIGINT AS n_samples, sum(e)::BIGINT AS n_errors FROM (
  SELECT model, split_part(file, '_', 1) AS dataset, count(*) AS n, count(DISTINCT CASE WHEN evaluation_error THEN instance END) AS e
  FROM v_reviews GROUP BY ALL) GROUP BY ALL""", _REVIEWS)
def report_metrics(spark, sf):
    reviews = _reviews(spark, sf).withColumn("dataset", F.substring_index("file", "_", 1))
    reports = reviews.groupBy("model", "dataset").agg(F.count("*").alias("num"))
    errors = reviews.where(text.is_evaluation_error(F.col("completed"), F.col("error")))
    return attempts.report_metrics(reports, errors)


@query("a6_run_duration", """
SELECT domain, coalesce(floor(epoch_us(max(ended_at)) / 1e6 - epoch_us(min(started_at)) / 1e6), 0)::BIGINT AS duration_sec
FROM v_sims GROUP BY ALL""", views.SIMS)
def run_duration(spark, sf):
    return attempts.run_duration(views.simulations(spark, sf), ["domain"])


@query("a7_sum_chunk_duration", """
SELECT o_orderstatus, coalesce(sum(CASE WHEN o_orderkey % 4 = 0 THEN o_custkey END), 0)::BIGINT AS duration_sec,
  count(*) FILTER (o_orderkey % 4 <> 0) AS n_missing FROM orders GROUP BY ALL""")
def sum_chunk_duration(spark, sf):
    key, value = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    content = F.when(key % 4 == 0, F.concat(F.lit(" "), value, F.lit("\n"))).when(key % 4 == 1, F.concat(value, F.lit("s"))).when(
        key % 4 == 2, F.concat(F.lit("-"), value))
    chunks = table(spark, sf, "orders").select("o_orderstatus", content.alias("content"))
    return attempts.chunk_durations(chunks, ["o_orderstatus"])


_GROUPED = views.SAMPLES + """, v_cells AS (
  SELECT model, task || '/' || metric AS request, avg(v) AS score, metric FROM (
    SELECT model, task, 'acc' AS metric, quality AS v FROM v_samples
    UNION ALL SELECT model, task, 'generation_truncated', toxic FROM v_samples
    UNION ALL SELECT model, task, 'response_length_chars', n_chars FROM v_samples) GROUP BY ALL)"""


def sample_cells(spark, sf):
    """Accuracy, a failure rate and a length per model and task."""
    rows = views.samples(spark, sf).groupBy("model", "task").agg(
        F.avg("quality").alias("acc"), F.avg("toxic").alias("generation_truncated"), F.avg("n_chars").alias("response_length_chars"))
    names = ("acc", "generation_truncated", "response_length_chars")
    return rows.select("model", F.explode(F.array(*[
        F.struct(F.concat_ws("/", "task", F.lit(n)).alias("request"), F.col(n).cast("double").alias("score")) for n in names
    ])).alias("c")).select("model", "c.*")


LANGS = ["de", "en", "es", "fr"]
REQUESTS = [
    (i * 3 + j, group, f"{lang}/{metric}", lang)
    for j, (group, metric) in enumerate((("Quality", "acc"), ("Safety", "generation_truncated"), ("Length", "response_length_chars")))
    for i, lang in enumerate(LANGS)
]


@query("a8_group_macro_avg", """
SELECT CASE metric WHEN 'acc' THEN 'Quality' WHEN 'generation_truncated' THEN 'Safety' ELSE 'Length' END AS "group", model,
  round(avg(score), 6) AS average, count(*) AS n_metrics FROM v_cells GROUP BY ALL""", _GROUPED)
def group_macro_avg(spark, sf):
    return leaderboard.group_averages(sample_cells(spark, sf), leaderboard.request_table(spark, REQUESTS)).withColumn(
        "average", F.round("average", 6))


@query("a9_overall_avg", "SELECT model, round(avg(score) FILTER (metric = 'acc'), 6) AS overall FROM v_cells GROUP BY ALL", _GROUPED)
def overall_avg(spark, sf):
    return leaderboard.overall_average(sample_cells(spark, sf)).withColumn("overall", F.round("overall", 6))


@query("a10_avg_improvement", """
SELECT c.model, round_even(avg(c.score - b.score), 4) AS average FROM v_cells c LEFT JOIN (SELECT request, score FROM v_cells WHERE model = 'src6') b
  USING (request) WHERE c.metric = 'acc' GROUP BY ALL""", _GROUPED)
def avg_improvement(spark, sf):
    cells = sample_cells(spark, sf).where(F.endswith("request", F.lit("/acc")))
    return leaderboard.average_improvement(leaderboard.baseline_delta(cells, "src6"))


@query("a11_multilingual_avg", """
SELECT s.model, round(avg(score), 6) AS score, count(*) AS n_keys
FROM v_summary s LEFT JOIN v_protocols p ON s.model = p.model AND p.task = split_part(s.key, '/', 1)
WHERE contains(key, 'mgsm') AND ends_with(key, CASE WHEN p.task IS NULL THEN 'exact_match' ELSE 'exact_match_mean_repeats' END)
GROUP BY ALL""", views.SUMMARY)
def multilingual_avg(spark, sf):
    return multilingual_mean(views.summary(spark, sf), views.protocols(spark, sf)).withColumn("score", F.round("score", 6))


@query("a12_degeneration_avg", """
SELECT model, round(avg(score), 6) AS degeneration FROM v_summary WHERE key LIKE '%/degeneration' GROUP BY ALL""", views.SUMMARY)
def degeneration_avg(spark, sf):
    return leaderboard.degeneration_average(views.summary(spark, sf)).withColumn("degeneration", F.round("degeneration", 6))


@query("a13_subject_breakdown", """
SELECT s.model, CASE split_part(key, '/', 1) WHEN 'mmlu_pro_law' THEN 'law' WHEN 'mmlu_pro_computer_science' THEN 'computer science' END AS subject,
  round(arg_max(score, key), 6) AS score
FROM v_summary s LEFT JOIN v_protocols p ON p.model = s.model AND p.task = split_part(s.key, '/', 1)
WHERE key LIKE 'mmlu_pro%' AND key LIKE '%exact_match%' AND NOT (p.task IS NOT NULL AND key = 'mmlu_pro_law/exact_match,custom-extract')
GROUP BY ALL""", views.SUMMARY)
def subject_breakdown(spark, sf):
    return leaderboard.subject_breakdown(views.summary(spark, sf), protocols=views.protocols(spark, sf)).withColumn(
        "score", F.round("score", 6))


@query("a14_word_count_avg", """
SELECT model, round(avg(score), 6) AS word_count FROM v_summary WHERE key = 'alpaca_eval/avg_word_count' GROUP BY ALL""", views.SUMMARY)
def word_count_avg(spark, sf):
    return leaderboard.word_count_average(views.summary(spark, sf)).withColumn("word_count", F.round("word_count", 6))


@query("a14_overrefusal", """
SELECT model, round(CASE WHEN score > 1 THEN score / 100 ELSE score END * 100, 6) AS overrefusal FROM v_summary WHERE key = 'orbench/refusal'
""", views.SUMMARY)
def overrefusal(spark, sf):
    return leaderboard.overrefusal(views.summary(spark, sf)).withColumn("overrefusal", F.round("overrefusal", 6))


_COMPLETE = views.CATEGORY_VIEW + """, v_complete AS (
  SELECT model, grp FROM (
    SELECT model, CASE WHEN category LIKE 'live%' THEN 'live' WHEN category LIKE 'multi_turn%' THEN 'multi_turn'
      WHEN category LIKE 'memory%' OR category LIKE 'web%' THEN 'agentic' ELSE 'non_live' END AS grp FROM v_categories)
  GROUP BY model, grp HAVING count(*) = CASE grp WHEN 'live' THEN 6 WHEN 'multi_turn' THEN 4 WHEN 'agentic' THEN 5 ELSE 7 END),
v_groups AS (SELECT o.model, o.grp, score FROM v_official o JOIN v_complete c ON o.model = c.model AND o.grp = c.grp),
v_all_groups AS (SELECT * FROM v_groups UNION ALL SELECT model, 'overall', avg(score) FROM v_groups WHERE grp <> 'agentic'
  GROUP BY model HAVING count(score) = 3)"""


def _groups(spark, sf):
    return categories.group_scores(views.categories(spark, sf), views.official_groups(spark, sf))


@query("a15_category_groups", """SELECT model, grp AS "group", round(score, 6) AS score FROM v_all_groups""", _COMPLETE)
def category_groups(spark, sf):
    return _groups(spark, sf).withColumn("score", F.round("score", 6))


_WEIGHTED = _COMPLETE + """, v_wide AS (
  SELECT model, count(*) FILTER (category NOT LIKE 'web%') AS n,
    (avg(accuracy) FILTER (category IN ('simple_python', 'simple_java', 'simple_javascript'))
      + sum(accuracy) FILTER (category IN ('multiple', 'parallel', 'parallel_multiple'))) / 4 AS non_live,
    sum(accuracy * total) FILTER (category IN ('live_simple', 'live_multiple', 'live_parallel', 'live_parallel_multiple'))
      / sum(total) FILTER (category IN ('live_simple', 'live_multiple', 'live_parallel', 'live_parallel_multiple')) AS live,
    avg(accuracy) FILTER (category IN ('irrelevance', 'live_irrelevance')) AS irrelevance,
    avg(accuracy) FILTER (category LIKE 'multi_turn%') AS multi_turn, avg(accuracy) FILTER (category LIKE 'memory%') AS memory
  FROM v_categories GROUP BY ALL HAVING n = 20),
v_weighted AS (SELECT *, 0.1 * non_live + 0.1 * live + 0.1 * irrelevance + 0.3 * multi_turn + 0.4 * memory AS overall FROM v_wide)"""


@query("a16_weighted_overall", """
SELECT model, round(non_live, 6) AS non_live, round(live, 6) AS live, round(irrelevance, 6) AS irrelevance, round(multi_turn, 6) AS multi_turn,
  round(memory, 6) AS memory, round(overall, 6) AS overall_no_web_search FROM v_weighted""", _WEIGHTED)
def weighted_overall(spark, sf):
    frame = categories.overall_without_search(views.categories(spark, sf))
    return frame.select("model", *[F.round(c, 6).alias(c) for c in frame.columns if c != "model"])


@query("a17_category_metrics", """
SELECT model, metric, round(score::DOUBLE, 6) AS score FROM (
  SELECT model, grp AS metric, score FROM v_all_groups WHERE score IS NOT NULL
  UNION ALL SELECT w.model, u.m, u.s FROM v_weighted w, LATERAL (SELECT unnest([{'m': 'non_live', 's': non_live}, {'m': 'live', 's': live},
    {'m': 'irrelevance', 's': irrelevance}, {'m': 'multi_turn', 's': multi_turn}, {'m': 'memory', 's': memory},
    {'m': 'overall_no_web_search', 's': overall}]) AS u) WHERE NOT EXISTS (
      SELECT 1 FROM v_all_groups g WHERE g.model = w.model AND g.grp = u.m AND g.score IS NOT NULL)
  UNION ALL SELECT model, category, accuracy FROM v_categories
  UNION ALL SELECT model, 'n_samples', sum(total) FROM v_categories GROUP BY ALL)""", _WEIGHTED)
def category_metrics(spark, sf):
    rows = views.categories(spark, sf)
    return categories.category_metrics(rows, _groups(spark, sf), categories.overall_without_search(rows)).withColumn(
        "score", F.round("score", 6))


@query("a18_grade_distribution", """
SELECT model, round(100.0 * (count(*) FILTER (grade = 'C') - count(*) FILTER (grade = 'I')) / count(*), 6) AS "index",
  round(coalesce(count(*) FILTER (grade = 'I') / nullif(count(*) FILTER (grade <> 'C'), 0)::DOUBLE, 0), 6) AS hallucination_rate,
  round(1 - coalesce(count(*) FILTER (grade = 'I') / nullif(count(*) FILTER (grade <> 'C'), 0)::DOUBLE, 0), 6) AS non_hallucination_rate,
  round(avg((grade = 'C')::INT), 6) AS "share_C", round(avg((grade = 'P')::INT), 6) AS "share_P",
  round(avg((grade = 'I')::INT), 6) AS "share_I", round(avg((grade = 'N')::INT), 6) AS "share_N",
  round(avg(v), 6) AS accuracy, round(stddev_samp(v) / sqrt(count(*)), 6) AS stderr, count(*) AS n
FROM (SELECT *, CASE grade WHEN 'C' THEN 1.0 WHEN 'P' THEN 0.5 ELSE 0.0 END::DOUBLE AS v FROM v_grades) GROUP BY ALL""", views.GRADES)
def grade_distribution(spark, sf):
    graded = views.grades(spark, sf).select("model", text.grade_letter(F.col("judge_text")).alias("grade"))
    frame = grades.grade_distribution(graded)
    return frame.select("model", "n", *[F.round(c, 6).alias(c) for c in frame.columns if c not in ("model", "n")])


@query("a19_pairwise_rates", """
SELECT model, count(outcome) AS n_graded, round(count(*) FILTER (outcome = 'win') / count(outcome)::DOUBLE, 6) AS win_rate,
  round(count(*) FILTER (outcome IN ('win', 'tie')) / count(outcome)::DOUBLE, 6) AS win_or_tie_rate, count(*) FILTER (outcome = 'tie') AS ties,
  count(*) FILTER (outcome = 'loss') AS losses, count(*) FILTER (outcome = 'unparsed') AS unparsed FROM (
  SELECT 'model_' || (user_id % 10) AS model, CASE WHEN k % 10 = 7 THEN NULL WHEN event_type = 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'win' ELSE 'loss' END
    WHEN event_type = 'click' THEN CASE WHEN k % 2 = 0 THEN 'loss' ELSE 'win' END WHEN event_type = 'view' THEN 'tie' ELSE 'unparsed' END AS outcome
  FROM v_events) GROUP BY ALL""", views.EVENTS)
def pairwise_rates(spark, sf):
    verdicts = _verdicts(spark, sf).select(
        F.concat(F.lit("model_"), (F.col("user_id") % 10).cast("string")).alias("model"),
        F.when(F.col("k") % 10 != 7, F.col("outcome")).alias("outcome"))
    frame = grades.pairwise_rates(verdicts)
    return frame.withColumns({c: F.round(c, 6) for c in ("win_rate", "win_or_tie_rate")})


@query("a20_popularity_breakdown", """
SELECT o_orderpriority AS prop, floor(log10(greatest(floor(o_totalprice)::BIGINT, 1)))::INT AS decade, count(*) AS n,
  round(avg((o_orderstatus = 'F')::INT), 6) AS accuracy FROM orders GROUP BY ALL""")
def popularity_breakdown(spark, sf):
    answers = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("prop"), F.floor("o_totalprice").alias("s_pop"), (F.col("o_orderstatus") == "F").alias("correct"))
    return grades.popularity_breakdown(answers).withColumn("accuracy", F.round("accuracy", 6))


@query("a21_inference_error_counts", """
SELECT 'model_' || (user_id % 10) AS model, count(*) AS n_entries, count(*) FILTER (event_type = 'error') AS n_errors,
  count(*) FILTER (event_type = 'error' AND k % 3 = 0) AS n_context_overflow, count(*) FILTER (event_type = 'error' AND k % 3 <> 0) AS n_other
FROM v_events WHERE event_type <> 'view' GROUP BY ALL""", views.EVENTS)
def inference_error_counts(spark, sf):
    return categories.inference_error_counts(_inference_causes(spark, sf))


@query("a22_thinking_means", """
SELECT role AS model, round(avg(length(text)), 6) AS response_length_chars,
  round(avg(length(text) + 5) FILTER (turn % 4 = 0), 6) AS thinking_length_chars,
  round(avg((turn % 4 IN (0, 2))::INT), 6) AS thinking_format_has_open, round(avg((turn % 4 IN (0, 1))::INT), 6) AS thinking_format_has_close,
  round(avg((turn % 4 = 0)::INT), 6) AS thinking_format_correct FROM conversations GROUP BY ALL""")
def thinking_means(spark, sf):
    reply = F.col("reply")
    has_open, has_close = F.contains(reply, F.lit(text.THINK_START)), F.contains(reply, F.lit(text.THINK_END))
    responses = _messages(spark, sf).select(
        F.col("role").alias("model"), F.length("text").alias("response_length"), (F.length("text") + 5).alias("thinking_length"),
        has_open.alias("has_open"), has_close.alias("has_close"), (has_open & has_close).alias("format_correct"))
    frame = grades.thinking_means(responses)
    return frame.select("model", *[F.round(c, 6).alias(c) for c in frame.columns if c != "model"])


@query("a23_batch_completeness", """
SELECT 'model_' || (user_id % 10) AS model, (user_id // 10)::BIGINT AS epoch, count(*) AS n_submissions, count(*) = 70 AS complete
FROM v_events GROUP BY ALL""", views.EVENTS)
def batch_completeness(spark, sf):
    return grades.batches(_submissions(spark, sf))


@query("a23_complete_batches", """
SELECT 'model_' || (user_id % 10) AS model, (user_id // 10)::BIGINT AS epoch, 70 AS n, min(event_id) AS first_id
FROM v_events GROUP BY ALL HAVING count(*) = 70""", views.EVENTS)
def complete_batches(spark, sf):
    return grades.complete_batches(_submissions(spark, sf)).select(
        "model", "epoch", F.size("submissions").alias("n"), F.col("submissions")[0]["problem_id"].alias("first_id"))


def _submissions(spark, sf):
    return views.events(spark, sf).select(
        F.concat(F.lit("model_"), (F.col("user_id") % 10).cast("string")).alias("model"),
        F.expr("user_id div 10").alias("epoch"), F.col("event_id").alias("problem_id"), F.col("event_type").alias("generated_code"))


@query("a24_sample_accounting", """
SELECT 'm' || (o_custkey % 5) AS model, 'task' || (o_custkey % 4) AS task, count(*) AS source_rows, count(*) FILTER (o_orderkey % 3 < 2) AS scorable_rows,
  least(count(*) FILTER (o_orderkey % 3 < 2), 500) AS exported_rows, count(*) FILTER (o_orderkey % 3 < 2) > 500 AS capped,
  count(*) FILTER (o_orderkey % 3 < 2) = 0 AS unscored FROM orders GROUP BY ALL""")
def sample_accounting(spark, sf):
    score = sample_score(F.col("scores"), F.col("filter"), F.array(*[F.lit(k) for k in _KEYS]))
    rows = harness_line_fields(spark, sf).select(
        F.concat(F.lit("m"), (F.col("o_custkey") % 5).cast("string")).alias("model"),
        F.concat(F.lit("task"), (F.col("o_custkey") % 4).cast("string")).alias("task"), score.isNotNull().alias("scorable"))
    return export.sample_accounting(rows, 500)


@query("a25_weighted_group_score", """
SELECT model, round(sum(score * n) / sum(n), 6) AS score, sum(n)::BIGINT AS n FROM (
  SELECT model, task, avg(toxic) AS score, count(*) AS n FROM v_samples GROUP BY ALL) GROUP BY ALL""", views.SAMPLES)
def weighted_group_score(spark, sf):
    per_task = views.samples(spark, sf).groupBy("model", "task").agg(F.avg("toxic").alias("score"), F.count("*").alias("n"))
    return categories.weighted_group_score(per_task).withColumn("score", F.round("score", 6))


@query("a26_repeat_means", """
SELECT task, round(avg(mean), 6) AS mean_repeats, min(n) AS min_repeats, max(n) AS max_repeats,
  round(avg(c / n::DOUBLE), 6) AS pass_at_1, round(avg(1 - (n - c) * greatest(n - c - 1, 0) / (n * (n - 1))::DOUBLE) FILTER (n >= 2), 6) AS pass_at_2
FROM (SELECT l_linestatus AS task, l_orderkey, count(*) AS n, avg((l_returnflag = 'A')::INT) AS mean, count(*) FILTER (l_returnflag = 'A') AS c
  FROM lineitem GROUP BY ALL) GROUP BY ALL""")
def repeat_means(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("task"), F.col("l_orderkey").alias("doc_id"),
        F.when(F.col("l_returnflag") == "A", 1.0).otherwise(0.0).alias("value"))
    frame = attempts.repeat_means(rows, [1, 2])
    return frame.withColumns({c: F.round(c, 6) for c in ("mean_repeats", "pass_at_1", "pass_at_2")})
