"""The given tables read as evaluation data, as DataFrames and as the CTEs the oracle SQL starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evalframe.plans.registry import table

# Task names given to lineitem rows by part key.
TASKS = [
    "gsm8k", "gsm8k_cot", "mgsm_de", "mgsm_fr", "mgsm_en", "mmlu_pro", "mmlu_pro_law", "mmlu_pro_computer_science",
    "agieval", "code_gen", "orbench", "alpaca_eval",
]
CATEGORIES = [
    "simple_python", "simple_java", "simple_javascript", "multiple", "parallel", "parallel_multiple", "irrelevance",
    "live_simple", "live_multiple", "live_parallel", "live_parallel_multiple", "live_irrelevance", "live_relevance",
    "multi_turn_base", "multi_turn_miss_func", "multi_turn_miss_param", "multi_turn_long_context",
    "memory_kv", "memory_vector", "memory_rec_sum", "web_search_base", "web_search_no_snippet",
]


def _sql_list(names: list[str]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def _spark_list(names: list[str]) -> str:
    return "array(" + ", ".join(f"'{n}'" for n in names) + ")"


# --- labelled samples ---------------------------------------------------------------------------------------------

SAMPLES = """v_samples AS (
  SELECT doc_id, lang AS task, source AS model, quality, toxic, n_chars
  FROM documents JOIN labels USING (doc_id))"""


def samples(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents").select(
        "doc_id", F.col("lang").alias("task"), F.col("source").alias("model"), "n_chars"
    )
    return documents.join(table(spark, sf, "labels"), "doc_id").select(
        "doc_id", "task", "model", "quality", "toxic", "n_chars"
    )


# --- lineitem as per-sample scores of many models ------------------------------------------------------------------

COUNTS = f"""v_counts AS (
  SELECT 'acme/model-' || l_suppkey AS model, l_suppkey AS model_no, l_linenumber % 3 AS part,
         {_sql_list(TASKS)}[1 + (l_partkey % {len(TASKS)})::INT] AS task,
         count(*) AS n, count(*) FILTER (l_returnflag = 'A') AS k1,
         count(*) FILTER (l_linestatus = 'O') AS k2, count(*) FILTER (l_returnflag = 'R') AS k3
  FROM lineitem GROUP BY ALL)"""


def counts(spark: SparkSession, sf: str) -> DataFrame:
    names = F.expr(_spark_list(TASKS))
    rows = table(spark, sf, "lineitem").select(
        F.concat(F.lit("acme/model-"), F.col("l_suppkey").cast("string")).alias("model"),
        F.col("l_suppkey").alias("model_no"), (F.col("l_linenumber") % 3).alias("part"),
        F.element_at(names, (F.col("l_partkey") % len(TASKS) + 1).cast("int")).alias("task"),
        "l_returnflag", "l_linestatus",
    )
    return rows.groupBy("model", "model_no", "part", "task").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "A").alias("k1"),
        F.count_if(F.col("l_linestatus") == "O").alias("k2"), F.count_if(F.col("l_returnflag") == "R").alias("k3"),
    )


def _ratio_sql(top: str, bottom: str) -> str:
    scaled = f"((10000 * ({top})) // ({bottom}))"
    return f"({scaled} // 10000)::VARCHAR || '.' || lpad(({scaled} % 10000)::VARCHAR, 4, '0')"


def _ratio(top: str, bottom: str):
    scaled = f"((10000 * ({top})) div ({bottom}))"
    return F.expr(f"concat(cast({scaled} div 10000 as string), '.', lpad(cast({scaled} % 10000 as string), 4, '0'))")


# Raw result fields: key -> (top, bottom) of a ratio.
RATIOS = {
    "acc,none": ("k1", "n"), "exact_match,strict-match": ("k2", "n"), "exact_match,flexible-extract": ("k3", "n"),
    "f1,custom": ("k1 + k2", "2 * n"), "f1_stderr,custom": ("k3", "9 * n"),
}

RAW = COUNTS + """, v_raw AS (
  SELECT model, model_no, part, task, u.key AS key, u.raw AS raw, u.kind AS kind FROM v_counts, LATERAL (
    SELECT unnest([
      {'key': 'alias', 'raw': task, 'kind': 'text'}, {'key': 'sample_len', 'raw': n::VARCHAR, 'kind': 'number'},
      {'key': 'acc_stderr,none', 'raw': 'N/A', 'kind': 'text'}, {'key': 'remark', 'raw': 'see log', 'kind': 'text'},
      {'key': 'quoted', 'raw': '0.5', 'kind': 'text'}, {'key': 'passed', 'raw': 'true', 'kind': 'flag'},
      {'key': 'length', 'raw': (50 * n)::VARCHAR, 'kind': 'number'}, """ + ", ".join(
    f"{{'key': '{key}', 'raw': {_ratio_sql(*pair)}, 'kind': 'number'}}" for key, pair in RATIOS.items()
) + """]) AS u))"""


def raw_results(spark: SparkSession, sf: str) -> DataFrame:
    text = lambda key, value, kind: F.struct(F.lit(key).alias("key"), value.alias("raw"), F.lit(kind).alias("kind"))
    fields = F.array(
        text("alias", F.col("task"), "text"), text("sample_len", F.col("n").cast("string"), "number"),
        text("acc_stderr,none", F.lit("N/A"), "text"), text("remark", F.lit("see log"), "text"),
        text("quoted", F.lit("0.5"), "text"), text("passed", F.lit("true"), "flag"),
        text("length", (50 * F.col("n")).cast("string"), "number"),
        *[text(key, _ratio(*pair), "number") for key, pair in RATIOS.items()],
    )
    return counts(spark, sf).select("model", "model_no", "part", "task", F.explode(fields).alias("u")).select(
        "model", "model_no", "part", "task", "u.key", "u.raw", "u.kind"
    )


# Numeric fields only, as DOUBLE, with the JSON type the export filter asks for.
def numeric_results(spark: SparkSession, sf: str) -> DataFrame:
    return raw_results(spark, sf).withColumn(
        "json_type", F.when(F.col("kind") == "number", "DOUBLE").when(F.col("kind") == "flag", "BOOLEAN").otherwise("STRING")
    )


def result_files(spark: SparkSession, sf: str) -> DataFrame:
    """Result documents as files: one per model and part, holding every task's fields."""
    value = F.when(F.col("kind") == "text", F.to_json(F.array("raw"))).otherwise(F.concat(F.lit("["), "raw", F.lit("]")))
    inner = F.expr("substring(_json, 2, length(_json) - 2)")
    fields = raw_results(spark, sf).withColumn("_json", value).withColumn(
        "field", F.concat(F.lit('"'), "key", F.lit('": '), inner)
    )
    tasks = fields.groupBy("model", "model_no", "part", "task").agg(
        F.array_join(F.array_sort(F.collect_list("field")), ", ").alias("body")
    )
    return tasks.groupBy("model", "model_no", "part").agg(F.concat(
        F.lit('{"results": {'),
        F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('"'), "task", F.lit('": {'), "body", F.lit("}")))), ", "),
        F.lit("}}"),
    ).alias("value")).withColumn("path", F.concat(
        F.lit("/logs/"), "model", F.lit("/harness/eval_"), F.col("part").cast("string"),
        F.lit("/results_2025-01-0"), (F.col("part") + 1).cast("string"), F.lit("T00-00-00.json"),
    ))


# --- run summaries and repeat protocols ----------------------------------------------------------------------------

_SCORES = """v_scores AS (
  SELECT model, model_no, task, sum(n)::BIGINT AS n, sum(k1)::BIGINT AS k1, sum(k2)::BIGINT AS k2, sum(k3)::BIGINT AS k3
  FROM v_counts GROUP BY ALL)"""

# (key after the task, condition on task / model_no, value); the SQL reads the same in Spark and DuckDB.
SUMMARY_FIELDS = [
    ("acc,none", "task IN ('agieval', 'gsm8k')", "k1 / CAST(n AS DOUBLE)"),
    ("acc_stderr,none", "task IN ('agieval', 'gsm8k')", "k1 / CAST(9 * n AS DOUBLE)"),
    ("exact_match", "task LIKE 'mgsm%'", "k2 / CAST(n AS DOUBLE)"),
    ("exact_match,strict-match", "task LIKE 'gsm8k%' AND model_no % 3 <> 0", "k2 / CAST(n AS DOUBLE)"),
    ("exact_match,flexible", "task LIKE 'gsm8k%'", "k3 / CAST(n AS DOUBLE)"),
    ("exact_match,custom-extract", "task LIKE 'mmlu_pro%'", "k1 / CAST(n AS DOUBLE)"),
    ("exact_match_mean_repeats", "task = 'mgsm_de'", "k3 / CAST(n AS DOUBLE)"),
    ("exact_match_mean_repeats,custom-extract", "task = 'mmlu_pro_law'", "k3 / CAST(n AS DOUBLE)"),
    ("pass@1_mean_repeats,none", "task = 'code_gen'", "k1 / CAST(n AS DOUBLE)"),
    ("pass@1_pass@2,none", "task = 'code_gen'", "(k1 + k2) / CAST(2 * n AS DOUBLE)"),
    ("refusal", "task = 'orbench'", "100.0 * k2 / CAST(n AS DOUBLE)"),
    ("avg_word_count", "task = 'alpaca_eval'", "CAST(n + k1 AS DOUBLE)"),
    ("degeneration", "task IN ('gsm8k', 'agieval')", "k3 / CAST(4 * n AS DOUBLE)"),
    ("degeneration_stderr", "task = 'gsm8k'", "k3 / CAST(9 * n AS DOUBLE)"),
    ("response_length_tokens", "task IN ('gsm8k', 'code_gen')", "CAST(40 * n + k1 AS DOUBLE)"),
    ("thinking_length_tokens", "task IN ('gsm8k', 'code_gen') AND model_no % 2 = 0", "CAST(20 * n + k2 AS DOUBLE)"),
    ("thinking_format_correct", "task IN ('gsm8k', 'code_gen') AND model_no % 2 = 0", "k2 / CAST(n AS DOUBLE)"),
    ("generation_truncated", "task = 'gsm8k'", "k3 / CAST(8 * n AS DOUBLE)"),
]
HAS_PROTOCOL = "task IN ('mgsm_de', 'mmlu_pro_law', 'code_gen') AND model_no % 2 = 0"

SUMMARY = COUNTS + ", " + _SCORES + ", v_summary AS (" + " UNION ALL ".join(
    f"SELECT model, model_no, task || '/{key}' AS key, {value} AS score FROM v_scores WHERE {condition}"
    for key, condition, value in SUMMARY_FIELDS
) + f"""), v_protocols AS (
  SELECT model, model_no, task, (2 + model_no % 3)::INT AS repeats, model_no % 4 <> 0 AS sampling_enabled
  FROM v_scores WHERE {HAS_PROTOCOL})"""


def scores(spark: SparkSession, sf: str) -> DataFrame:
    return counts(spark, sf).groupBy("model", "model_no", "task").agg(*[F.sum(c).alias(c) for c in ("n", "k1", "k2", "k3")])


def summary(spark: SparkSession, sf: str) -> DataFrame:
    fields = F.expr("array(" + ", ".join(
        f"CASE WHEN {condition} THEN named_struct('key', concat(task, '/{key}'), 'score', CAST({value} AS DOUBLE)) END"
        for key, condition, value in SUMMARY_FIELDS) + ")")
    present = F.filter(fields, lambda f: f.isNotNull())
    return scores(spark, sf).select("model", "model_no", F.explode(present).alias("f")).select(
        "model", "model_no", "f.key", "f.score"
    )


def protocols(spark: SparkSession, sf: str) -> DataFrame:
    repeats = (F.lit(2) + F.col("model_no") % 3).cast("int")
    contributors = F.when(F.col("model_no") % 6 == 0, F.array("task", F.lit("mgsm_de"))).otherwise(F.array("task"))
    return scores(spark, sf).where(HAS_PROTOCOL).select(
        "model", "model_no", "task", repeats.alias("repeats"), (F.col("model_no") % 4 != 0).alias("sampling_enabled"),
        F.map_from_entries(F.array_distinct(F.array(
            F.struct(F.lit("mgsm_de").alias("k"), F.lit(5).alias("v")),
            F.when(F.col("task") != "mgsm_de", F.struct(F.col("task").alias("k"), repeats.alias("v"))).otherwise(
                F.struct(F.lit("mgsm_de").alias("k"), F.lit(5).alias("v"))),
        ))).alias("per_task_repeats"),
        F.create_map(F.lit("pass@1_mean_repeats,none"), contributors).alias("metric_tasks"),
    )


# --- events as simulations, trials, grades and reviews ----------------------------------------------------------------

EVENTS = """v_events AS (
  SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"""


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k")
    )


SIMS = EVENTS + """, v_sims AS (
  SELECT 'domain_' || (user_id % 5) AS domain, user_id::VARCHAR AS task_id, event_id,
    CASE event_type WHEN 'error' THEN NULL WHEN 'purchase' THEN 1.0 WHEN 'signup' THEN 1.0 WHEN 'click' THEN 0.5 ELSE 0.0 END::DOUBLE AS reward,
    CASE WHEN event_type <> 'error' THEN NULL WHEN k % 3 = 0 THEN 'empty_reply' WHEN k % 3 = 1 AND k % 2 = 0 THEN 'context_overflow' END AS cause,
    ts AS started_at, CASE WHEN k % 10 = 0 THEN NULL ELSE ts + to_seconds(k) END AS ended_at
  FROM v_events)"""


def simulations(spark: SparkSession, sf: str) -> DataFrame:
    kind, k = F.col("event_type"), F.col("k")
    failed = kind == "error"
    return events(spark, sf).select(
        F.concat(F.lit("domain_"), (F.col("user_id") % 5).cast("string")).alias("domain"),
        F.col("user_id").cast("string").alias("task_id"), "event_id",
        F.when(kind.isin("purchase", "signup"), 1.0).when(kind == "click", 0.5).when(kind == "view", 0.0).alias("reward"),
        F.when(failed, "infrastructure_error").otherwise("user_stop").alias("termination_reason"),
        F.when(failed & (k % 3 == 0), F.lit("AssistantMessage must have either content or tool_calls, got none")).alias("error"),
        F.when(failed & (k % 3 == 1), "ContextWindowExceededError").when(failed, "TimeoutError").alias("error_type"),
        F.when(failed, F.when(k % 2 == 0, "File /x/tau2/agent/base.py").otherwise("File /x/tau2/user/sim.py")).alias("error_traceback"),
        F.col("ts").alias("started_at"),
        F.when(k % 10 != 0, F.timestamp_add("SECOND", k, F.col("ts"))).alias("ended_at"),
    )


TRIALS = EVENTS + """, v_trials AS (
  SELECT 'bench_' || (user_id % 7) AS benchmark, user_id::VARCHAR AS task_name, event_id::VARCHAR AS trial_name, event_type, k,
    CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'view' THEN 0.0 WHEN 'click' THEN CASE WHEN user_id % 7 = 3 THEN NULL ELSE 0.25 END END::DOUBLE AS reward,
    CASE event_type WHEN 'click' THEN k / 100.0 END::DOUBLE AS strict,
    CASE event_type WHEN 'error' THEN ['RewardFileNotFoundError', 'AgentTimeoutError', 'VerifierError'][1 + k % 3] END AS exception_type,
    ts, value
  FROM v_events)"""


def trials(spark: SparkSession, sf: str) -> DataFrame:
    kind, k = F.col("event_type"), F.col("k")
    reward = lambda value: F.create_map(F.lit("reward"), F.lit(value))
    strict = F.create_map(F.lit("strict"), k / 100.0)
    exceptions = F.array(*[F.lit(e) for e in ("RewardFileNotFoundError", "AgentTimeoutError", "VerifierError")])
    return events(spark, sf).select(
        F.concat(F.lit("bench_"), (F.col("user_id") % 7).cast("string")).alias("benchmark"),
        F.col("user_id").cast("string").alias("task_name"), F.col("event_id").cast("string").alias("trial_name"),
        F.when(kind == "purchase", reward(1.0)).when(kind == "view", reward(0.0)).when(
            kind == "click", F.when(F.col("user_id") % 7 == 3, strict).otherwise(F.map_concat(reward(0.25), strict))
        ).alias("rewards"),
        F.when(kind == "error", F.element_at(exceptions, (k % 3 + 1).cast("int"))).alias("exception_type"),
        F.when(kind == "error", F.repeat(F.lit("no luck "), k)).alias("exception_message"),
        k.cast("long").alias("n_input_tokens"), (k * 2).cast("long").alias("n_output_tokens"),
        F.col("ts").alias("started_at"), F.timestamp_add("SECOND", k, F.col("ts")).alias("finished_at"),
    )


GRADES = EVENTS + """, v_grades AS (
  SELECT 'model_' || (user_id % 10) AS model, event_id, k,
    CASE event_type WHEN 'purchase' THEN 'C' WHEN 'click' THEN 'P' WHEN 'error' THEN 'I' ELSE 'N' END AS grade
  FROM v_events)"""


def grades(spark: SparkSession, sf: str) -> DataFrame:
    """Judge replies: an early mention, then the verdict; some without any."""
    kind, k = F.col("event_type"), F.col("k")
    letter = F.when(kind == "purchase", "C").when(kind == "click", "p").when(kind == "error", "I").otherwise("N")
    reply = F.when(kind == "signup", F.lit("I cannot say. GRADE: X")).otherwise(
        F.concat(F.lit("Could be GRADE: C.\nBut then\ngrade :  "), letter, F.when(k % 2 == 0, ".").otherwise("")))
    return events(spark, sf).select(
        F.concat(F.lit("model_"), (F.col("user_id") % 10).cast("string")).alias("model"), "event_id", "k", "event_type",
        reply.alias("judge_text"),
    )


CATEGORY_VIEW = f"""v_categories AS (
  SELECT * FROM (
    SELECT 'acme/model-' || l_suppkey AS model, l_suppkey AS model_no,
      {_sql_list(CATEGORIES)}[1 + (l_partkey % {len(CATEGORIES)})::INT] AS category,
      count(*) AS total, count(*) FILTER (l_returnflag = 'A') AS correct,
      count(*) FILTER (l_returnflag = 'A') / count(*)::DOUBLE AS accuracy
    FROM lineitem GROUP BY ALL)
  WHERE NOT (model_no % 3 = 0 AND category = 'simple_java') AND NOT (model_no % 5 = 0 AND category LIKE 'web_search%')),
v_official AS (
  SELECT model, model_no, grp, CASE WHEN model_no % 7 <> 0 THEN sum(correct) / sum(total)::DOUBLE END AS score FROM (
    SELECT *, CASE WHEN category LIKE 'live%' THEN 'live' WHEN category LIKE 'multi_turn%' THEN 'multi_turn'
      WHEN category LIKE 'memory%' OR category LIKE 'web%' THEN 'agentic' ELSE 'non_live' END AS grp FROM v_categories)
  GROUP BY model, model_no, grp)"""


def categories(spark: SparkSession, sf: str) -> DataFrame:
    names = F.expr(_spark_list(CATEGORIES))
    rows = table(spark, sf, "lineitem").select(
        F.concat(F.lit("acme/model-"), F.col("l_suppkey").cast("string")).alias("model"), F.col("l_suppkey").alias("model_no"),
        F.element_at(names, (F.col("l_partkey") % len(CATEGORIES) + 1).cast("int")).alias("category"), "l_returnflag",
    )
    right = F.count_if(F.col("l_returnflag") == "A")
    scored = rows.groupBy("model", "model_no", "category").agg(
        F.count("*").alias("total"), right.alias("correct"), (right / F.count("*")).alias("accuracy")
    )
    return scored.where(
        ~((F.col("model_no") % 3 == 0) & (F.col("category") == "simple_java"))
        & ~((F.col("model_no") % 5 == 0) & F.startswith("category", F.lit("web_search")))
    )


def official_groups(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("category")
    group = F.when(F.startswith(c, F.lit("live")), "live").when(F.startswith(c, F.lit("multi_turn")), "multi_turn").when(
        F.startswith(c, F.lit("memory")) | F.startswith(c, F.lit("web")), "agentic").otherwise("non_live")
    return categories(spark, sf).withColumn("group", group).groupBy("model", "model_no", "group").agg(
        (F.sum("correct") / F.sum("total")).alias("score")
    ).withColumn("score", F.when(F.col("model_no") % 7 != 0, F.col("score")))
