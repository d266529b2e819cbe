"""Answers, verdicts, reviews and sample fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.functions import ids, prompts, samples as sample_fields, settings, text
from evalframe.operators import attempts, export, grades
from evalframe.plans import views
from evalframe.plans.registry import query, table
from evalframe.sources import records, sinks

START, END = text.THINK_START, text.THINK_END

# Conversations with reasoning around them: closed, stray close, never closed, none.
_MESSAGES = f"""v_messages AS (
  SELECT conv_id, turn, role, text, CASE turn % 4
    WHEN 0 THEN '{START}plan ' || role || chr(10) || 'more{END} ' || text WHEN 1 THEN 'loose {END}' || text || ' '
    WHEN 2 THEN text || '{START}still thinking' ELSE text END AS reply
  FROM conversations)"""


def _messages(spark, sf):
    turn, body = F.col("turn"), F.col("text")
    reply = (
        F.when(turn % 4 == 0, F.concat(F.lit(f"{START}plan "), "role", F.lit(f"\nmore{END} "), body))
        .when(turn % 4 == 1, F.concat(F.lit(f"loose {END}"), body, F.lit(" ")))
        .when(turn % 4 == 2, F.concat(body, F.lit(f"{START}still thinking"))).otherwise(body)
    )
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", "text", reply.alias("reply"))


@query("p12_strip_reasoning", r"""
SELECT conv_id, turn, role, regexp_replace(text, '^\s+|\s+$', '', 'g') AS answer FROM conversations""")
def strip_reasoning(spark, sf):
    return _messages(spark, sf).select("conv_id", "turn", "role", text.strip_reasoning(F.col("reply")).alias("answer"))


@query("p13_includes_any", """
SELECT a.conv_id, a.turn, count(*) AS n_questions,
  bool_or(len(list_filter(string_split_regex(q.text, '[^[:alpha:]éèêçàùâîôûëïüäöß]+'),
    lambda w: length(w) > 6 AND contains(lower(a.text), lower(w)))) > 0) AS correct
FROM conversations a JOIN conversations q ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 GROUP BY ALL""")
def includes_any(spark, sf):
    talk = table(spark, sf, "conversations")
    words = F.filter(F.split("text", "[^\\p{Alpha}éèêçàùâîôûëïüäöß]+"), lambda w: F.length(w) > 6)
    asked = talk.select("conv_id", (F.col("turn") + 1).alias("turn"), words.alias("aliases"))
    return talk.join(asked, ["conv_id", "turn"]).select(
        "conv_id", "turn", text.includes_any(F.col("text"), F.col("aliases")).alias("hit")
    ).groupBy("conv_id", "turn").agg(F.count("*").alias("n_questions"), F.max("hit").alias("correct"))


@query("p14_grade_letter", "SELECT event_id, grade FROM v_grades", views.GRADES)
def grade_letter(spark, sf):
    return views.grades(spark, sf).select("event_id", text.grade_letter(F.col("judge_text")).alias("grade"))


@query("p15_grade_word", """
SELECT event_id, CASE WHEN event_type = 'purchase' OR event_type = 'click' AND k % 2 = 0 THEN 'C' ELSE 'I' END AS grade
FROM v_events""", views.EVENTS)
def grade_word(spark, sf):
    kind, k = F.col("event_type"), F.col("k")
    reply = (
        F.when(kind == "purchase", "First I thought incorrect.\nFinal: CORRECT")
        .when(kind == "click", F.when(k % 2 == 0, "correct.").otherwise("correct? no, Incorrect"))
        .when(kind == "error", "correctly unsure").otherwise("")
    )
    return views.events(spark, sf).select("event_id", text.grade_word(reply).alias("grade"))


@query("p16_pairwise_verdict", """
SELECT event_id, CASE event_type WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'win' ELSE 'loss' END
  WHEN 'click' THEN CASE WHEN k % 2 = 0 THEN 'loss' ELSE 'win' END WHEN 'view' THEN 'tie' ELSE 'unparsed' END AS outcome
FROM v_events""", views.EVENTS)
def pairwise_verdict(spark, sf):
    return _verdicts(spark, sf).select("event_id", "outcome")


def _verdicts(spark, sf):
    kind = F.col("event_type")
    reply = (
        F.when(kind == "purchase", "Winner: A (not WINNER: B)").when(kind == "click", "winner: b")
        .when(kind == "view", "WINNER: tie").otherwise("neither")
    )
    return views.events(spark, sf).withColumn("outcome", text.pairwise_verdict(reply, F.col("k") % 2 == 0))


@query("p17_failure_cause", "SELECT event_id, cause FROM v_sims", views.SIMS)
def failure_cause(spark, sf):
    return attempts.mark_simulations(views.simulations(spark, sf)).select("event_id", "cause")


# Result lines of a generation: some broken, some with an inference error early or too late to count.
def _generation_lines(spark, sf):
    k, kind = F.col("k"), F.col("event_type")
    result = (
        F.when((kind == "error") & (k % 3 == 0), "Error during inference: context_length exceeded")
        .when((kind == "error") & (k % 3 == 1), "Error occurred during inference: timeout")
        .when((kind == "error") & (k % 3 == 2), F.concat(F.repeat(F.lit("x"), F.lit(2000)), F.lit("Error during inference")))
        .otherwise("call(1)")
    )
    line = F.when(kind == "view", F.lit('{"id": 1, "resul')).otherwise(
        F.concat(F.lit('{"id": "e", "result": "'), result, F.lit('"}')))
    return views.events(spark, sf).select(
        F.concat(F.lit("model_"), (F.col("user_id") % 10).cast("string")).alias("model"), "event_id", line.alias("value")
    )


def _inference_causes(spark, sf, chars=None):
    parsed = F.try_parse_json("value")
    body = F.to_json(F.try_variant_get(parsed, "$.result", "variant"))
    return _generation_lines(spark, sf).select(
        "model", "event_id", parsed.isNotNull().alias("parsed"), text.inference_error_cause(body, chars).alias("cause")
    )


@query("p18_inference_error_cause", """
SELECT event_id, CASE WHEN event_type = 'error' AND k % 3 = 0 THEN 'context_overflow' WHEN event_type = 'error' THEN 'other'
  END AS cause FROM v_events WHERE event_type <> 'view'""", views.EVENTS)
def inference_error_cause(spark, sf):
    return _inference_causes(spark, sf).where("parsed").select("event_id", "cause")


@query("p18_inference_error_head", """
SELECT event_id, CASE WHEN event_type = 'error' AND k % 3 = 0 THEN 'context_overflow' WHEN event_type = 'error' AND k % 3 = 1
  THEN 'other' END AS cause FROM v_events WHERE event_type <> 'view'""", views.EVENTS)
def inference_error_head(spark, sf):
    return _inference_causes(spark, sf, 1000).where("parsed").select("event_id", "cause")


# Review lines of events, in the two report shapes.
def _review_files(spark, sf):
    k, kind = F.col("k"), F.col("event_type")
    user = F.col("user_id")
    report = (
        F.when(kind == "error", F.when(k % 2 == 0, '{"error": "Patch Apply Failed: hunk 1"}').otherwise('{"error": "disk full"}'))
        .when(k % 2 == 0, F.concat(
            F.lit('{"f2p": ["A", "B"], "p2p": ["C"], "tests": [{"name": "A", "status": "PASSED"}'),
            F.when(k % 4 == 0, ', {"name": "B", "status": "FAILED"}').otherwise(', {"name": "B", "status": "PASSED"}'), F.lit("]}")))
        .otherwise(F.concat(
            F.lit('{"i1": {"tests_status": {"FAIL_TO_PASS": {"success": ["a"], "failure": []}, "PASS_TO_PASS": {"success": ["b"], "failure": ['),
            F.when(k % 3 == 0, '"c"').otherwise(""), F.lit("]}}}}")))
    )
    line = F.concat(
        F.lit('{"agent_trace": {"total_usage": {"input_tokens": '), k.cast("string"), F.lit(', "output_tokens": 5}, "events": [{"timestamp": '),
        F.unix_seconds("ts").cast("string"), F.lit('.5}, {"timestamp": '), (F.unix_seconds("ts") + k).cast("string"),
        F.lit('.5}]}, "sample_score": {"sample_id": "s'), F.col("event_id").cast("string"),
        F.lit('", "sample_metadata": {"instance_id": "'), F.when(k % 5 > 0, F.concat(F.lit("i"), F.col("event_id").cast("string"))).otherwise(""),
        F.lit('", "repo": "r'), user.cast("string"), F.lit('"}, "score": {"value": {"acc": '),
        F.when(kind == "purchase", "1").when(kind == "click", "0.5").otherwise("0"),
        F.lit('}, "status": "'), F.when(kind == "signup", "error").otherwise("success"),
        F.lit('", "extracted_prediction": "'), F.repeat(F.lit("p"), k * 100),
        F.lit('", "metadata": {"completed": '), F.when(kind == "error", "false").otherwise("true"),
        F.lit(', "resolved": '), F.when(kind == "purchase", "true").otherwise("false"), F.lit(', "report": '), report, F.lit("}}}}"),
    )
    path = F.concat(F.lit("/w/reviews/m"), (user % 4).cast("string"), F.lit("/set"), (user % 3).cast("string"), F.lit("_all.jsonl"))
    return views.events(spark, sf).select("event_id", path.alias("path"), line.alias("value"))


_REVIEWS = views.EVENTS + """, v_reviews AS (
  SELECT event_id, 'm' || (user_id % 4) AS model, 'set' || (user_id % 3) || '_all' AS file, event_type, k, user_id,
    CASE WHEN k % 5 > 0 THEN 'i' || event_id ELSE 's' || event_id END AS instance,
    event_type = 'error' AND k % 2 = 1 AS evaluation_error, epoch(date_trunc('second', ts)) + 0.5 AS first_event
  FROM v_events)"""


def _reviews(spark, sf):
    return records.reviews(_review_files(spark, sf))


@query("p19_evaluation_error", "SELECT model, file, instance FROM v_reviews WHERE evaluation_error", _REVIEWS)
def evaluation_error(spark, sf):
    return _reviews(spark, sf).where(text.is_evaluation_error(F.col("completed"), F.col("error"))).select(
        "model", "file", "instance")


@query("p20_required_tests", """
SELECT instance, CASE WHEN event_type = 'error' THEN NULL WHEN k % 4 = 0 THEN 1 WHEN k % 2 = 0 THEN 2 ELSE 2 END::INT AS tests_passed,
  CASE WHEN event_type = 'error' THEN NULL WHEN k % 2 = 0 OR k % 3 = 0 THEN 3 ELSE 2 END::INT AS tests_required,
  CASE WHEN event_type = 'error' THEN NULL WHEN k % 4 = 0 THEN 'B,C' WHEN k % 2 = 0 THEN 'C' WHEN k % 3 = 0 THEN 'c' ELSE '' END AS failed
FROM v_reviews""", _REVIEWS)
def required_tests(spark, sf):
    return _reviews(spark, sf).select(
        "instance", "tests.tests_passed", "tests.tests_required", F.array_join("tests.failed_tests", ",").alias("failed"))


@query("p21_summarize_trial", """
SELECT benchmark, trial_name AS trial, CASE WHEN exception_type IS NOT NULL THEN exception_type || ': ' || repeat('no luck ', k) END AS error,
  k::BIGINT AS duration_sec, CASE WHEN reward IN (0, 1) THEN reward END AS pass_at_1, k::BIGINT AS n_input_tokens FROM v_trials""", views.TRIALS)
def summarize_trial(spark, sf):
    return attempts.summarize_trial(views.trials(spark, sf)).select(
        "benchmark", "trial", "error", "duration_sec", F.col("pass@1").alias("pass_at_1"), "n_input_tokens")


@query("p22_summarize_review", """
SELECT instance, 'r' || user_id AS repo, event_type = 'purchase' AS resolved, (k * 100)::BIGINT AS patch_chars,
  CASE WHEN NOT evaluation_error AND event_type IN ('purchase', 'view', 'signup', 'error') THEN (event_type = 'purchase')::INT END::DOUBLE AS acc,
  CASE WHEN event_type = 'error' AND k % 2 = 0 THEN 'Patch Apply Failed: hunk 1' WHEN event_type = 'error' THEN 'disk full' END AS error,
  k::BIGINT AS n_input_tokens
FROM v_reviews""", _REVIEWS)
def summarize_review(spark, sf):
    return attempts.summarize_review(_reviews(spark, sf)).select(
        "instance", "repo", "resolved", F.length("patch").cast("long").alias("patch_chars"), "acc", "error", "n_input_tokens")


@query("p22_summarize_review_cut", """
SELECT instance, least(k * 100, 5000)::BIGINT AS patch_chars,
  CASE WHEN event_type = 'error' AND k % 2 = 0 THEN 'Patch Appl' WHEN event_type = 'error' THEN 'disk full' END AS error
FROM v_reviews""", _REVIEWS)
def summarize_review_cut(spark, sf):
    return attempts.summarize_review(_reviews(spark, sf), message_chars=10, patch_chars=5000, failed_tests=20).select(
        "instance", F.length("patch").cast("long").alias("patch_chars"), "error")


@query("p23_summarize_log_sample", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.0 WHEN 'P' THEN 0.5 END::DOUBLE AS grader,
  CASE WHEN o_orderkey % 3 = 0 THEN 0.25 END::DOUBLE AS ratio,
  CASE WHEN o_orderkey % 3 = 0 THEN 'grader,ratio' ELSE 'grader' END AS metrics,
  CASE WHEN o_orderkey % 2 = 0 THEN 'because ' || o_orderpriority END AS grader_explanation FROM orders""")
def summarize_log_sample(spark, sf):
    key = F.col("o_orderkey")
    grade = F.when(F.col("o_orderstatus") == "F", "C").when(F.col("o_orderstatus") == "O", "I").otherwise("P")
    why = F.when(key % 2 == 0, F.concat(F.lit("because "), "o_orderpriority")).otherwise("")
    score = lambda name, value, explanation: F.struct(F.lit(name).alias("scorer"), value.alias("value"), explanation.alias("explanation"))
    scores = F.array(
        score("grader", grade, why), score("ratio", F.when(key % 3 == 0, "0.25").otherwise("n/a"), F.lit(None).cast("string")))
    samples = table(spark, sf, "orders").select(key, F.lit("a long transcript").alias("messages"), scores.alias("scores"))
    return attempts.summarize_log_samples(samples, ["o_orderkey"]).select(
        "o_orderkey", F.try_element_at("values", F.lit("grader")).alias("grader"),
        F.try_element_at("values", F.lit("ratio")).alias("ratio"), F.array_join("metrics", ",").alias("metrics"),
        F.try_element_at("explanations", F.lit("grader")).alias("grader_explanation"))


@query("p24_clean_message", """
SELECT conv_id, turn, role, CASE WHEN turn % 3 = 0 THEN '' ELSE text END AS content, turn % 2 = 1 AND turn % 3 = 0 AS has_calls,
  CASE WHEN turn % 2 = 1 AND turn % 3 = 0 THEN 2 ELSE 2 END::INT AS n_fields
FROM conversations""")
def clean_message(spark, sf):
    turn = F.col("turn")
    message = F.create_map(
        F.lit("role"), F.col("role"), F.lit("content"), F.when(turn % 3 > 0, F.col("text")), F.lit("refusal"), F.lit(None),
        F.lit("tool_calls"), F.when((turn % 2 == 1) & (turn % 3 == 0), '[{"id": 1}]').when(turn % 2 == 1, F.lit(None)).otherwise("[]"),
    )
    cleaned = table(spark, sf, "conversations").select("conv_id", "turn", sample_fields.clean_message(message).alias("m"))
    return cleaned.select(
        "conv_id", "turn", F.col("m")["role"].alias("role"),
        F.coalesce(F.try_element_at("m", F.lit("content")), F.lit("")).alias("content"),
        F.map_contains_key("m", "tool_calls").alias("has_calls"), F.size("m").alias("n_fields"))


# --- harness samples out of orders ------------------------------------------------------------------------------------

_STATUSES = ["F", "O", "P"]
HARNESS = """v_harness AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_orderkey % 3 AS kind, o_orderkey % 2 AS odd,
    CASE o_orderkey % 3 WHEN 0 THEN 'Which status has order ' || o_orderkey || '?' WHEN 1 THEN 'Order "' || o_orderkey || '" of é' ELSE 'doc ' || o_orderkey END AS prompt,
    CASE o_orderkey % 3 WHEN 0 THEN o_orderstatus ELSE o_orderpriority END AS target
  FROM orders)"""


def harness_line_fields(spark, sf):
    """Orders as harness samples: multiple choice, generated text, and samples without arguments."""
    key, kind = F.col("o_orderkey"), F.col("o_orderkey") % 3
    text_key = key.cast("string")
    argument = lambda a, b: F.struct(a.alias("arg_0"), b.alias("arg_1"))
    question = F.concat(F.lit("Which status has order "), text_key, F.lit("?"))
    options = F.map_from_arrays(
        F.array(*[F.lit(f"gen_args_{i}") for i in range(3)]),
        F.array(*[argument(question, F.lit(f" {s} ")) for s in _STATUSES]))
    single = F.create_map(F.lit("gen_args_0"), argument(
        F.concat(F.lit('Order "'), text_key, F.lit('" of é')), F.lit(None).cast("string")))
    none = F.expr("cast(map() as map<string,struct<arg_0:string,arg_1:string>>)")
    # option scores: the first maximum is the option at (custkey mod 3), with a tie behind it
    score = lambda i: F.when(F.col("o_custkey") % 3 <= i, "1.5").otherwise("-2.0")
    scored = F.array(*[F.array(score(i)) for i in range(3)])
    said = F.array(F.array(F.concat(F.lit("It is "), "o_orderpriority")))
    correct = F.when(kind == 0, F.element_at(F.array(*[F.lit(s) for s in _STATUSES]), (F.col("o_custkey") % 3 + 1).cast("int")) == F.col("o_orderstatus"))
    scores = F.map_filter(F.create_map(
        F.lit("acc"), F.when(kind == 0, F.when(correct, "1.0").otherwise("0.0")),
        F.lit("exact_match"), F.when(kind == 1, F.when(key % 2 == 0, "true").otherwise("false")),
    ), lambda k, v: v.isNotNull())
    return table(spark, sf, "orders").select(
        key.alias("doc_id"), "o_custkey", F.when(kind == 2, F.concat(F.lit("doc "), text_key)).alias("doc"),
        F.lit(None).cast("string").alias("input"),
        F.when(kind == 0, F.col("o_orderstatus")).otherwise(F.col("o_orderpriority")).alias("target"),
        F.when(kind == 0, options).when(kind == 1, single).otherwise(none).alias("arguments"),
        F.when(kind == 0, scored).otherwise(said).alias("resps"),
        F.when(kind == 0, scored).otherwise(F.array().cast("array<array<string>>")).alias("filtered_resps"),
        F.map_keys(scores).alias("metrics"), scores.alias("scores"),
        F.when(kind == 1, "strict").otherwise("none").alias("filter"),
        F.sha1(text_key).alias("doc_hash"), F.lit("").alias("prompt_hash"), F.lit("").alias("target_hash"),
    )


@query("p25_extract_prompt", "SELECT o_orderkey AS doc_id, prompt FROM v_harness", HARNESS)
def extract_prompt(spark, sf):
    return harness_line_fields(spark, sf).select("doc_id", sample_fields.extract_prompt(
        F.col("arguments"), F.col("doc"), F.col("input")).alias("prompt"))


@query("p26_extract_choices", """
SELECT o_orderkey AS doc_id, CASE WHEN kind = 0 THEN 'F|O|P' END AS choices FROM v_harness""", HARNESS)
def extract_choices(spark, sf):
    return harness_line_fields(spark, sf).select(
        "doc_id", F.array_join(sample_fields.extract_choices(F.col("arguments")), "|").alias("choices"))


@query("p27_extract_output", """
SELECT o_orderkey AS doc_id, CASE WHEN kind = 0 THEN ['F', 'O', 'P'][1 + (o_custkey % 3)::INT] ELSE 'It is ' || o_orderpriority END AS output
FROM v_harness""", HARNESS)
def extract_output(spark, sf):
    choices = sample_fields.extract_choices(F.col("arguments"))
    return harness_line_fields(spark, sf).select("doc_id", sample_fields.extract_output(
        F.col("filtered_resps"), F.col("resps"), choices).alias("output"))


_KEYS = ["acc,none", "exact_match_mean_repeats,strict", "exact_match,flexible"]


@query("p28_sample_score", """
SELECT o_orderkey AS doc_id, CASE WHEN kind = 0 THEN (['F', 'O', 'P'][1 + (o_custkey % 3)::INT] = o_orderstatus)::INT ELSE 1 - odd END::DOUBLE AS score,
  CASE WHEN kind = 0 THEN ['F', 'O', 'P'][1 + (o_custkey % 3)::INT] = o_orderstatus ELSE odd = 0 END AS is_correct
FROM v_harness WHERE kind < 2""", HARNESS)
def sample_score(spark, sf):
    keys = F.array(*[F.lit(k) for k in _KEYS])
    return harness_line_fields(spark, sf).select("doc_id", sample_fields.sample_score(
        F.col("scores"), F.col("filter"), keys).alias("s")).where("s IS NOT NULL").select("doc_id", "s.*")


def converted(spark, sf):
    """Instances of the harness samples."""
    return export.convert_samples(harness_line_fields(spark, sf).withColumns({
        "model": F.concat(F.lit("m"), (F.col("o_custkey") % 5).cast("string")),
        "task": F.concat(F.lit("task"), (F.col("o_custkey") % 4).cast("string")), "ord": F.col("doc_id"),
        "evaluation_id": F.lit("bench/acme/m/1"), "model_id": F.lit("acme/m"), "evaluation_name": F.lit("fam.bench.overall"),
        "result_keys": F.array(*[F.lit(k) for k in _KEYS]),
    }))


_HASHED = HARNESS + """, v_hashed AS (
  SELECT *, sha256('{"raw": ' || to_json(prompt) || ', "reference": ' || to_json(target) || '}') AS sample_hash,
    CASE WHEN kind = 1 THEN 'strict' ELSE 'none' END AS filter
  FROM v_harness)"""


@query("p37_sample_hash", "SELECT o_orderkey AS doc_id, sample_hash FROM v_hashed", _HASHED)
def sample_hash(spark, sf):
    prompt = sample_fields.extract_prompt(F.col("arguments"), F.col("doc"), F.col("input"))
    return harness_line_fields(spark, sf).select("doc_id", ids.sample_hash(prompt, F.col("target")).alias("sample_hash"))


@query("p38_convert_sample", """
SELECT o_orderkey::VARCHAR AS sample_id, sample_hash, prompt AS raw, target AS reference, CASE WHEN kind = 0 THEN 3 END::INT AS n_choices,
  CASE WHEN kind = 0 THEN ['F', 'O', 'P'][1 + (o_custkey % 3)::INT] ELSE 'It is ' || o_orderpriority END AS output, filter,
  sha1(o_orderkey::VARCHAR) AS doc_hash FROM v_hashed WHERE kind < 2""", _HASHED)
def convert_sample(spark, sf):
    i = "instance."
    return converted(spark, sf).select(
        i + "sample_id", i + "sample_hash", i + "input.raw", F.col(i + "input.reference")[0].alias("reference"),
        F.when(F.col(i + "input.choices").isNotNull(), F.size(i + "input.choices")).alias("n_choices"),
        F.col(i + "output.raw")[0].alias("output"), i + "metadata.filter", i + "metadata.doc_hash")


@query("p6_flatten_sample", """
SELECT conv_id, turn, role, 'turn' || turn AS "meta/kind/name", "text", '[''a'', ' || turn || ']' AS "list" FROM conversations""")
def flatten_sample(spark, sf):
    turn = F.col("turn").cast("string")
    line = F.concat(
        F.lit('{"role": "'), "role", F.lit('", "text": '), ids.quoted(F.col("text")), F.lit(', "meta": {"kind": {"name": "turn'), turn,
        F.lit('"}}, "list": ["a", '), turn, F.lit("]}"))
    flat = table(spark, sf, "conversations").select("conv_id", "turn", records.flatten_json(line).alias("m"))
    return flat.select("conv_id", "turn", *[F.col("m")[name].alias(name) for name in ("role", "meta/kind/name", "text", "list")])


@query("p6_flatten_struct", """
SELECT o_orderkey AS "id", o_orderstatus AS "order/status", o_orderpriority AS "order/detail/priority" FROM orders""")
def flatten_struct(spark, sf):
    nested = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.struct(
        F.col("o_orderstatus").alias("status"), F.struct(F.col("o_orderpriority").alias("priority")).alias("detail")).alias("order"))
    return nested.select(*sinks.flatten_struct(nested.schema))


# --- identifiers ------------------------------------------------------------------------------------------------------

_UUID = """substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' ||
  substr('89ab89ab89ab89ab', 1 + strpos('0123456789abcdef', substr(h, 17, 1))::INT - 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"""


@query("p36_stable_ids", f"""
SELECT o_orderkey, {_UUID} AS uuid, sha256('order' || chr(0) || 'acc,none' || chr(0) || CASE WHEN o_orderkey % 2 = 0 THEN printf('%.17f', 0.25) ELSE printf('%.16f', 1.0) END) AS result_id,
  CASE WHEN length(name) <= 72 THEN name ELSE regexp_replace(left(name, 61), '[-_/]+$', '') || '-' || left(sha1(name), 10) END AS run_id
FROM (SELECT o_orderkey, sha256(o_orderkey || chr(0) || 'bench' || chr(0) || o_custkey) AS h,
  'model-' || o_orderkey || repeat('-abc', (o_orderkey % 30)::INT) || '-001' AS name FROM orders)""")
def stable_ids(spark, sf):
    key = F.col("o_orderkey")
    score = F.when(key % 2 == 0, 0.25).otherwise(1.0)
    model = F.concat(F.lit("model-"), key.cast("string"), F.repeat(F.lit("-abc"), (key % 30).cast("int")))
    return table(spark, sf, "orders").select(
        "o_orderkey", ids.stable_uuid(key.cast("string"), F.lit("bench"), F.col("o_custkey").cast("string")).alias("uuid"),
        ids.result_id(F.lit("order"), F.lit("acc,none"), score).alias("result_id"), ids.run_id(model).alias("run_id"))


@query("p36_sample_table_key", """
SELECT c_custkey, 'samples/' || CASE WHEN length(task) <= budget THEN task
  ELSE regexp_replace(left(task, budget - 11), '[-_/]+$', '') || '-' || left(sha1(task), 10) END AS key
FROM (SELECT c_custkey, lower(c_mktsegment) || repeat('_long', (c_custkey % 20)::INT) AS task,
  128 - 24 - 4 - 1 - 8 - length('run' || c_custkey) AS budget FROM customer)""")
def sample_table_key(spark, sf):
    task = F.concat(F.lower("c_mktsegment"), F.repeat(F.lit("_long"), (F.col("c_custkey") % 20).cast("int")))
    run = F.concat(F.lit("run"), F.col("c_custkey").cast("string"))
    return table(spark, sf, "customer").select("c_custkey", ids.sample_table_key(run, task).alias("key"))


@query("p39_infer_model_id", r"""
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'owner/m' || page_id WHEN page_id % 3 = 1 THEN 'hub/p' || page_id
  WHEN page_id % 2 = 0 THEN 'load/l' END AS model_id FROM pages""")
def infer_model_id(spark, sf):
    key, text_key = F.col("page_id"), F.col("page_id").cast("string")
    named = F.when(key % 3 == 0, F.concat(F.lit("owner/m"), text_key)).otherwise(F.concat(F.lit("./local/"), text_key))
    args = F.concat(F.when(key % 3 == 1, F.concat(F.lit("pretrained=hub/p"), text_key)).otherwise("pretrained=/ckpt/a/b"),
                    F.when(key % 2 == 0, ",load=load/l").otherwise(",load=none"))
    pages = table(spark, sf, "pages").select("page_id", named.alias("n"), settings.parse_args(args).alias("a"))
    return pages.select("page_id", ids.first_repo_id(F.col("n"), F.col("a")["pretrained"], F.col("a")["load"]).alias("model_id"))


@query("p40_package_version", """
SELECT s_suppkey, CASE WHEN s_suppkey % 3 < 2 THEN '0.' || s_suppkey || '.1' END AS version FROM supplier""")
def package_version(spark, sf):
    key = F.col("s_suppkey")
    line = F.when(key % 3 == 0, "[pip3] vLLM==0.").when(key % 3 == 1, "[conda]  vllm    0.").otherwise("[pip3] vllm-extra==0.")
    environment = F.concat(F.lit("OS: x\n[pip3] torch==2.0\n"), line, key.cast("string"), F.lit(".1\nend"))
    return table(spark, sf, "supplier").select("s_suppkey", ids.package_version(environment, "vllm").alias("version"))


@query("p35_evaluation_name", """
SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE concat_ws('.', CASE WHEN c_custkey % 2 = 0 THEN 'suite' END,
  CASE WHEN c_custkey % 3 = 0 THEN 'fam' ELSE lower(c_mktsegment) END, lower(c_mktsegment),
  CASE WHEN c_custkey % 5 = 0 THEN 'overall' ELSE 's' || c_custkey END) END AS name, c_custkey % 7 > 0 AS valid FROM customer""")
def evaluation_name(spark, sf):
    key = F.col("c_custkey")
    bench = F.lower("c_mktsegment")
    name = ids.evaluation_name(
        F.when(key % 2 == 0, "suite").otherwise(" "), F.when(key % 3 == 0, "fam").otherwise(""),
        F.when(key % 7 == 0, "a.b").otherwise(bench), F.when(key % 5 > 0, F.concat(F.lit("s"), key.cast("string"))))
    return table(spark, sf, "customer").select("c_custkey", name.alias("name"), ids.has_name_scheme(name).alias("valid"))


# --- prompts ----------------------------------------------------------------------------------------------------------


@query("p42_render_prompts", """
SELECT conv_id, turn, role, 'Answer the question with a short phrase only. Do not explain.' || chr(10) || chr(10) || 'Question: ' || text || chr(10) || 'Answer:' AS short_answer,
  '### Question' || chr(10) || 'Q' || chr(10) || chr(10) || CASE WHEN turn % 2 = 0 THEN '### Starter Code' || chr(10) || 'S' || chr(10) || chr(10) ELSE '' END
    || '### Answer' || chr(10) || chr(10) || 'A' || chr(10) || chr(10) || '### Question' || chr(10) || text || chr(10) || chr(10)
    || CASE WHEN turn % 2 = 0 THEN '### Starter Code' || chr(10) || role || chr(10) || chr(10) ELSE '' END || '### Answer' || chr(10) || chr(10) AS base
FROM conversations""")
def render_prompts(spark, sf):
    example = {"question": "Q", "sample_code": "S", "answer": "A"}
    starter = F.when(F.col("turn") % 2 == 0, F.col("role"))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", "role", prompts.short_answer(F.col("text")).alias("short_answer"),
        prompts.worked_example(F.col("text"), starter, example, example).alias("base"))


@query("p42_judge_prompts", """
SELECT a.conv_id, a.turn, count(*) AS n, sum(length(a.text) + length(q.text))::BIGINT AS chars
FROM conversations a JOIN conversations q ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 GROUP BY ALL""")
def judge_prompts(spark, sf):
    talk = table(spark, sf, "conversations")
    asked = talk.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    prompt = prompts.grade_prompt(F.col("question"), F.col("role"), F.col("text"))
    fixed = F.length(prompts.grade_prompt(F.lit(""), F.lit(""), F.lit(""))) + F.length("role")
    return talk.join(asked, ["conv_id", "turn"]).groupBy("conv_id", "turn").agg(
        F.count("*").alias("n"), F.sum(F.length(prompt) - fixed).cast("long").alias("chars"))


@query("p44_judge_text", """
SELECT doc_id // 10 AS task, sha256(string_agg(CASE WHEN doc_id % 3 = 0
    THEN '--- d' || doc_id || '.bin (binary, ' || n_chars || ' bytes, not extracted) ---'
    ELSE '--- d' || doc_id || '.TXT ---' || chr(10) || text END, chr(10) || chr(10) ORDER BY doc_id)) AS judge_text
FROM documents GROUP BY ALL""")
def judge_text(spark, sf):
    doc = F.col("doc_id")
    name = F.concat(F.lit("d"), doc.cast("string"), F.when(doc % 3 == 0, ".bin").otherwise(".TXT"))
    files = table(spark, sf, "documents").select(
        F.expr("doc_id div 10").alias("task"), doc.alias("ord"), name.alias("name"), F.col("text").alias("content"),
        F.col("n_chars").alias("size"))
    return grades.judge_texts(files, ["task"]).select("task", F.sha2("judge_text", 256).alias("judge_text"))
