"""Known value cases of the operators."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from evalframe.functions import ids, prompts, samples as sample_fields, scores, settings, text
from evalframe.operators import attempts, categories, docsets, export, grades, leaderboard, mapping, merge, metrics, resolve, sampling
from evalframe.operators.mapping import TaskMapping

PROTOCOLS = (
    "model string, task string, repeats int, per_task_repeats map<string,int>, metric_tasks map<string,array<string>>, "
    "sampling_enabled boolean"
)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def summary(spark, values):
    return spark.createDataFrame([("m", k, v, i) for i, (k, v) in enumerate(values.items())], "model string, key string, score double, ord int")


def protocol(spark, *rows):
    return spark.createDataFrame([("m", *r) for r in rows], PROTOCOLS)


def resolved(spark, values, request, protocols=None, fuzzy=True):
    rows = resolve.resolve_metrics(summary(spark, values), [request], protocols, fuzzy).collect()
    return rows[0].score if rows else None


def test_metadata_is_no_metric(spark):
    raw = {"name": "t", "alias": "t", "sample_len": "10", "sample_count": "5", "samples": "{}", "acc,none": "0.8975",
           "acc_stderr,none": "N/A", "acc_lenient,strict": "0.8975", "text": "0.5", "object": '{"a": 1}'}
    rows = spark.createDataFrame([("m", "t", k, v) for k, v in raw.items()], "model string, task string, key string, raw string")
    named = metrics.promote_single_filter(metrics.parse_metrics(rows))
    assert {(r.name, r.score) for r in named.collect()} == {
        ("acc", 0.8975), ("acc_lenient,strict", 0.8975), ("acc_lenient", 0.8975), ("text", 0.5)}
    assert [r.key for r in metrics.unreadable_fields(rows).collect()] == ["object"]


def test_two_filters_are_not_promoted(spark):
    rows = spark.createDataFrame(
        [("m", "t", "em,a", "1"), ("m", "t", "em,b", "0")], "model string, task string, key string, raw string")
    named = metrics.promote_single_filter(metrics.parse_metrics(rows))
    assert {r.name for r in named.collect()} == {"em,a", "em,b"}


@pytest.mark.parametrize("value,want", [(0.5, 0.5), (1.0, 1.0), (45.0, 0.45), (-5.0, -0.05), (0.0, 0.0), (None, None)])
def test_normalize(spark, value, want):
    got = one(spark, scores.normalize_score(F.lit(value).cast("double")))
    assert got == want if want is None else math.isclose(got, want)


def test_resolution_cases(spark):
    repeated = protocol(spark, ("code", 4, {"code": 4}, {"pass@1_mean_repeats,none": ["code"]}, True))
    values = {"code/pass@1_mean_repeats,none": 0.25, "code/pass@1_pass@2,none": 0.5}
    assert resolved(spark, values, "code/pass@1", repeated) == 0.25
    assert resolved(spark, {"code/pass@1_pass@2,none": 0.5}, "code/pass@1", repeated) is None
    other = {"mmlu_pro/exact_match_mean_repeats,none": 0.25, "mmlu_pro/exact_match_pass@2,none": 0.5}
    assert resolved(spark, other, "mmlu_pro/exact_match") == 0.25
    assert resolved(spark, other, "mmlu_pro/exact_match", fuzzy=False) is None
    plain = {"code/pass@1,none": 0.7, "code/pass@1_mean_repeats,none": 0.25}
    assert resolved(spark, plain, "code/pass@1") == 0.7  # without a protocol the mean is not preferred
    assert resolved(spark, {"gsm8k/exact_match,flexible": 0.1, "gsm8k/exact_match,strict-match": 0.2}, "gsm8k/exact_match") == 0.2
    assert resolved(spark, {"T_long/acc,none": 0.1, "T/ACC": 0.2}, "t/acc") == 0.2
    assert resolved(spark, {"t/acc_stderr": 0.1}, "t/acc") is None


def test_repeat_labels(spark):
    values = {"code/pass@1_mean_repeats,none": 0.25, "code/pass@1_pass@2,none": 0.5}
    requests = ["code/pass@1", "code/pass@1_pass@2"]

    def labels(*rows):
        frame = resolve.repeat_labels(summary(spark, values), requests, protocol(spark, *rows))
        return {r.request: r.label for r in frame.collect()}

    contributors = {"pass@1_mean_repeats,none": ["code"]}
    assert labels(("code", 4, {"code": 4}, contributors, True)) == {"code/pass@1": "mean@4", "code/pass@1_pass@2": "pass@2 (m=4)"}
    assert labels(("code", 4, {"code": 4}, contributors, False))["code/pass@1"] == "mean@4 (greedy)"
    two = {"pass@1_mean_repeats,none": ["code", "b"]}
    assert labels(("code", 4, {"code": 4, "b": 2}, two, True), ("b", 2, {}, {}, True))["code/pass@1"] == "mean@[2, 4]"


def test_multilingual_mean(spark):
    values = {"mgsm_de/exact_match_mean_repeats": 0.5, "mgsm_de/exact_match": 0.1, "mgsm_fr/exact_match": 0.7, "mgsm_fr/exact_match,none": 0.9}
    rows = protocol(spark, ("mgsm_de", 4, {}, {}, True))
    assert math.isclose(resolve.multilingual_mean(summary(spark, values), rows).first().score, 0.6)
    assert math.isclose(resolved(spark, values, "mgsm/exact_match", rows), 0.6)


def test_repeat_merge(spark):
    attempt = "model string, task string, part int, repeat_index int, score double"
    history = spark.createDataFrame(
        [("m", "a", 0, i, 1.0) for i in range(3)] + [("m", "b", 1, i, float(i)) for i in range(2)] + [("m", "a", 2, 0, 0.0)], attempt)
    results = spark.createDataFrame([("m", "a", 0), ("m", "b", 1), ("m", "a", 2)], "model string, task string, part int")
    kept = merge.replace_repeat_history(history, results)
    assert {(r.repeat_index, r.task, r.score) for r in kept.collect()} == {(0, "a", 0.0), (0, "b", 0.0), (1, "b", 1.0)}
    without = merge.exclude_tasks(kept, spark.createDataFrame([("b",)], "task string"))
    assert {(r.repeat_index, r.task) for r in without.collect()} == {(0, "a")}


def test_exclusion_stops_at_separators(spark):
    rows = spark.createDataFrame([("ab",), ("a_b",), ("a/b",), ("a",), ("b_a",)], "task string")
    kept = merge.exclude_tasks(rows, spark.createDataFrame([("a",)], "task string"))
    assert {r.task for r in kept.collect()} == {"ab", "b_a"}


def test_trials(spark):
    schema = (
        "benchmark string, task_name string, trial_name string, rewards map<string,double>, exception_type string, exception_message string, "
        "n_input_tokens long, n_output_tokens long, started_at timestamp, finished_at timestamp")
    import datetime as dt

    start = dt.datetime(2025, 1, 1)
    row = lambda name, rewards, error: ("swe", name, name, rewards, error, "x" * 900 if error else None, 1, 2, start, start + dt.timedelta(minutes=30))
    trials = spark.createDataFrame(
        [row("t1", {"reward": 1.0}, None), row("t2", {"reward": 0.0}, None), row("t3", None, "Boom"), row("t4", None, "RewardFileNotFoundError"),
         row("t5", {"reward": 0.25}, None)], schema)
    got = {r.trial: r for r in attempts.summarize_trial(trials).collect()}
    assert (got["t1"]["pass@1"], got["t2"]["pass@1"], got["t3"]["pass@1"], got["t5"]["pass@1"]) == (1.0, 0.0, None, None)
    assert got["t1"].duration_sec == 1800 and got["t3"].error == "Boom: " + "x" * 900
    cut = {r.trial: r.error for r in attempts.summarize_trial(trials, message_chars=500).collect()}
    assert cut["t3"] == "Boom: " + "x" * 500
    plain = attempts.trial_summary(trials).first()
    assert (plain.n_trials, plain.n_scored, plain.n_errors) == (5, 3, 2) and math.isclose(plain.mean_reward, 1.25 / 3)
    zeroed = attempts.trial_summary(trials, missing_reward_is_zero=True).first()
    assert (zeroed.n_scored, zeroed.n_errors) == (4, 1) and math.isclose(zeroed.mean_reward, 1.25 / 4)


SIM = "domain string, task_id string, termination_reason string, reward double, error string, error_type string, error_traceback string"


def sims(spark, *rows):
    frame = spark.createDataFrame([("d", *r) for r in rows], SIM)
    return {r.metric: r.score for r in attempts.simulation_summary(frame, 2).collect()}


def test_simulations(spark):
    empty = "AssistantMessage must have either content or tool_calls"
    got = sims(spark, ("1", "user_stop", 1.0, None, None, None), ("2", "user_stop", 0.0, None, None, None),
               ("3", "infrastructure_error", None, empty, None, None))
    assert math.isclose(got["pass^1"], 1 / 3) and got["pass^1_excluding_agent_failures"] == 0.5
    assert got["n_agent_failures"] == 1 and got["n_empty_replies"] == 1 and got["n_unscored"] == 0
    judge = sims(spark, ("1", "user_stop", 1.0, None, None, None), ("2", "infrastructure_error", None, "judge down", None, None))
    assert judge["n_unscored"] == 1 and judge["n_agent_failures"] == 0 and "avg_reward_excluding_agent_failures" not in judge
    two = sims(spark, ("1", "s", 1.0, None, None, None), ("1", "s", 1.0, None, None, None), ("2", "s", 1.0, None, None, None), ("2", "s", 0.0, None, None, None))
    assert two["pass^1"] == 0.75 and two["pass^2"] == 0.5


def test_ratios(spark):
    pick = lambda c, n, k: one(spark, attempts.all_pass_ratio(F.lit(c), F.lit(n), F.lit(k)))
    assert pick(3, 4, 2) == 0.5 and pick(1, 4, 2) == 0 and pick(0, 3, 3) == 0
    assert one(spark, attempts.any_pass_ratio(F.lit(1), F.lit(4), F.lit(2))) == 0.5


def test_reasoning(spark):
    start, end = text.THINK_START, text.THINK_END
    strip = lambda s: one(spark, text.strip_reasoning(F.lit(s)))
    assert strip(f"{start}a\nb{end} answer ") == "answer"
    assert strip(f"loose{end}x{end} y") == "y"
    assert strip(f"kept {start}open") == "kept"
    assert strip(f"{start}never closed") == ""
    assert strip("plain\n") == "plain"


def test_grades(spark):
    letter = lambda s: one(spark, text.grade_letter(F.lit(s)))
    assert letter("GRADE: C\nno, grade : i.") == "I" and letter("no grade") == "N" and letter("GRADE: Cx") == "N"
    word = lambda s: one(spark, text.grade_word(F.lit(s)))
    assert word("incorrect? CORRECT") == "C" and word("correct then INCORRECT") == "I" and word("") == "I"
    frame = lambda values: grades.grade_distribution(spark.createDataFrame([("m", v) for v in values], "model string, grade string")).first()
    assert frame("CCC")["index"] == 100 and frame("III")["index"] == -100 and frame("CCC").hallucination_rate == 0
    mixed = frame("CPIN")
    assert math.isclose(mixed.hallucination_rate, 1 / 3) and mixed.accuracy == 0.375 and mixed.share_P == 0.25


def test_category_groups(spark):
    def rows(names):
        frame = spark.createDataFrame([("m", c, 0.5, 1, 2) for c in names], "model string, category string, accuracy double, correct long, total long")
        official = spark.createDataFrame([("m", g, s) for g, s in (("non_live", 0.3), ("live", 0.6), ("multi_turn", 0.9), ("agentic", 0.1))],
                                         "model string, group string, score double")
        return {r.group: r.score for r in categories.group_scores(frame, official).collect()}, categories.overall_without_search(frame).collect()

    every = [c for group in categories.GROUP_CATEGORIES.values() for c in group]
    v3 = [c for g in categories.OVERALL_GROUPS for c in categories.GROUP_CATEGORIES[g]]
    groups, overall = rows(v3)
    assert set(groups) == {"non_live", "live", "multi_turn", "overall"} and math.isclose(groups["overall"], 0.6) and not overall
    groups, overall = rows([c for c in every if not c.startswith("web_search")])
    assert "agentic" not in groups and math.isclose(overall[0].overall_no_web_search, 0.5)
    assert "non_live" not in rows(v3[1:])[0]


def test_required_tests(spark):
    from evalframe.sources.records import report_tests

    read = lambda s: one(spark, report_tests(F.lit(s)))
    assert tuple(read('{"f2p": ["A"], "p2p": [], "tests": [{"name": "A", "status": "PASSED"}]}')) == (1, 1, [])
    assert tuple(read('{"f2p": ["A", "B"], "p2p": ["C"], "tests": [{"name": "A", "status": "PASSED"}, {"name": "B", "status": "FAILED"}]}')) == (1, 3, ["B", "C"])
    shaped = '{"i": {"tests_status": {"F": {"success": ["a", "b"], "failure": []}, "P": {"success": ["c"], "failure": []}}}}'
    assert tuple(read(shaped)) == (3, 3, [])
    assert read('{"error": "x"}') is None


def test_failure_markers(spark):
    cause = lambda s: one(spark, text.inference_error_cause(F.lit(s)))
    assert cause('"Error during inference: context length"') == "context_overflow"
    assert cause('"Error occurred during inference: 500"') == "other" and cause('"fine"') is None
    wrong = lambda done, error: one(spark, text.is_evaluation_error(F.lit(done), F.lit(error)))
    assert not wrong(False, "Patch Apply Failed: x") and not wrong(False, "Test timed out") and wrong(False, "lost") and wrong(False, None)
    assert not wrong(True, "lost") and not wrong(None, "lost")


def test_arguments(spark):
    parse = lambda s: one(spark, settings.parse_args(F.lit(s)))
    assert parse("pretrained=a/b, x = 1,y=2,3,z=a=b") == {"pretrained": "a/b", "x": "1", "y": "2,3", "z": "a=b"}
    assert parse("junk,a=1,a=2") == {"a": "2"}
    config = lambda run, task: one(spark, settings.generation_config(settings.parse_args(F.lit(run)), settings.parse_args(F.lit(task))))
    assert tuple(config("temperature=0.5,max_tokens=8", "max_gen_toks=9,top_k=3")) == (0.5, None, 3.0, 9)
    assert tuple(config("do_sample=False", "max_tokens=-1")) == (0.0, None, None, None)


def test_run_names(spark):
    parse = lambda s: tuple(one(spark, scores.parse_run_name(F.lit(s), known={"base": "Base"})))
    assert parse("base") == ("Base", 0, "", 0.0)
    assert parse("x-MaxMin-dpo-beta0.1-lr5e-7_ebs64-lnTrue") == ("maxmin_dpo_b0.1_ebs64_lr5e-7_lenNorm", 1, "lenNorm", 5e-7)
    # an `e` right behind the rate is read as part of it and makes it no number
    assert parse("qrpo-lr5e-7-ebs64")[0].endswith("lr5e-7-e") and parse("qrpo-lr5e-7-ebs64")[3] == float("inf")
    assert parse("run_other") == ("other_bUnk_ebs128_unknown_lr", 4, "", float("inf"))


def test_ids(spark):
    uuid = one(spark, ids.stable_uuid(F.lit("s"), F.lit("b"), F.lit("o/m")))
    assert len(uuid) == 36 and uuid[14] == "4" and uuid[19] in "89ab"
    long = "m" * 100
    short = one(spark, ids.run_id(F.lit(long)))
    assert len(short) <= 72 and short != one(spark, ids.run_id(F.lit(long + "x")))
    assert one(spark, ids.evaluation_name(F.lit(""), F.lit(None).cast("string"), F.lit("b"), F.lit(""))) == "b.b.overall"
    assert one(spark, ids.first_repo_id(F.lit("./a/b"), F.lit("a/b/c"), F.lit("o/m"))) == "o/m"


def test_prompts_keep_braces(spark):
    filled = one(spark, prompts.grade_prompt(F.lit("{answer}"), F.lit("c"), F.lit("a")))
    assert "[Question]: {answer}\n" in filled and "[Submitted answer]: a\n" in filled


def test_mapping(spark):
    rules = [TaskMapping("mmlu", "mmlu", split="main"), TaskMapping("arc", "arc", pattern=r"arc_(?P<split>[a-z]{2})"),
             TaskMapping("g", "g", pattern=r"g_(?P<split>.+)_x", configless_is_overall=True)]
    tasks = spark.createDataFrame([("mmlu", True), ("mmlu_self_consistency", True), ("arc_de", True), ("arc_long", True), ("g_a b_x", False)], "task string, has_config boolean")
    got = {r.task: (r.root, r.alias, r.split) for r in mapping.map_tasks(tasks, rules).collect()}
    assert got == {"mmlu": ("mmlu", "mmlu", "main"), "mmlu_self_consistency": ("mmlu", "mmlu", "main"), "arc_de": ("arc", "arc_de", "de"),
                   "arc_long": (None, None, None), "g_a b_x": ("g", "g_a b_x", "a_b_overall")}


def test_stratified_fill(spark):
    rows = [("t", f"p{i}", True) for i in range(9)] + [("t", "n0", False)] + [("u", f"x{i}", None) for i in range(9)] + [("t", "z", None)]
    frame = spark.createDataFrame(rows, "task string, sample_id string, is_correct boolean")
    picked = sampling.stratified_samples(frame).collect()
    count = lambda task, label: sum(r.task == task and r.is_correct is label for r in picked)
    assert (count("t", True), count("t", False), count("t", None), count("u", None)) == (4, 1, 0, 5)


def test_prerequisites(spark):
    names = ["memory_kv_prereq_0-a-0", "memory_kv_prereq_1-b-0", "memory_kv_0-a-0", "memory_kv_1-a-1", "memory_kv_2-b-0"]
    frame = spark.createDataFrame([("memory_kv", i, n) for i, n in enumerate(names)], "category string, ord int, id string")
    assert {r.id for r in sampling.first_n_with_prereqs(frame, 2).collect()} == {names[0], names[2], names[3]}


def test_sample_fields(spark):
    argument = lambda *pairs: F.create_map(*[x for k, a, b in pairs for x in (F.lit(k), F.struct(F.lit(a).alias("arg_0"), F.lit(b).alias("arg_1")))])
    gap = argument(("gen_args_0", "q", " a"), ("gen_args_1", "q", "b "), ("gen_args_3", "q", "d"))
    assert one(spark, sample_fields.extract_choices(gap)) == ["a", "b"]
    assert one(spark, sample_fields.extract_choices(argument(("gen_args_0", "q", "a")))) is None
    scored = lambda *values: F.array(*[F.array(F.lit(v)) for v in values])
    choices = F.array(F.lit("a"), F.lit("b"))
    empty = F.array().cast("array<array<string>>")
    pick = lambda *values: one(spark, sample_fields.extract_output(scored(*values), empty, choices))
    assert pick("1", "1") == "a" and pick("-3", "-1") == "b" and pick("x", "1") == '[["x"],["1"]]' and pick("0", "0", "5") == '[["0"],["0"],["5"]]'
    assert one(spark, sample_fields.extract_output(empty, empty, F.lit(None).cast("array<string>"))) == ""


def test_tables(spark):
    cells = spark.createDataFrame(
        [("base", "a/x", 0.5), ("base", "b/x", 0.5), ("m", "a/x", 0.75), ("n", "a/x", 0.25), ("n", "b/x", 1.0)], "model string, request string, score double")
    average = {r.model: r.average for r in leaderboard.average_improvement(leaderboard.baseline_delta(cells, "base")).collect()}
    assert average == {"base": 0.0, "m": 0.25, "n": 0.125}
    texts = {(r.model, r.request): r.text for r in leaderboard.format_cells(cells, "base").collect()}
    assert texts["base", "a/x"] == "0.5000" and texts["m", "a/x"] == "+0.2500" and texts["n", "a/x"] == "-0.2500"
    wide = leaderboard.pivot_leaderboard(cells, ["a/x", "b/x"])
    assert {r.model for r in leaderboard.complete_only(wide, ["a", "b"]).collect()} == {"base", "n"}
    best = {(r.model, r.request) for r in leaderboard.best_badge(cells).where("best").collect()}
    assert best == {("m", "a/x"), ("n", "b/x")}
    count = spark.createDataFrame([("m", "t/response_length_words", 412.5), ("m", "t/acc", 0.0625)], "model string, request string, score double")
    assert {r.text for r in leaderboard.display_cells(count).collect()} == {"413", "6.2"}


def test_cells_round_the_double_itself(spark):
    """0.00015 is just below the half its text shows, 0.12345 just above it; a small loss keeps its sign."""
    values = [0.00015, 0.12345, 0.10625, 0.28125, 0.5] + [k / 4000 for k in range(0, 4000, 7)]
    rows = spark.createDataFrame([("m", f"t{i}/x", v) for i, v in enumerate(values)] + [
        ("base", f"t{i}/x", 0.3) for i in range(len(values))] + [("m", "u/x", 0.29999), ("base", "u/x", 0.3)],
        "model string, request string, score double")
    texts = {(r.model, r.request): r.text for r in leaderboard.format_cells(rows, "base").collect()}
    assert all(texts["m", f"t{i}/x"] == f"{v - 0.3:+.4f}" for i, v in enumerate(values)) and texts["m", "u/x"] == "-0.0000"
    plain = {r.request: r.text for r in leaderboard.format_cells(rows.where("model = 'm'")).collect()}
    assert all(plain[f"t{i}/x"] == f"{v:.4f}" for i, v in enumerate(values))


def test_wide_tables_have_no_expression_per_model(spark):
    cells = spark.createDataFrame([("m1", "a/x", 0.5), ("m2", "a/x", None), ("m2", "b/x", 0.25)], "model string, request string, score double")
    requests = leaderboard.request_table(spark, [(1, "G", "a/x", "a"), (2, "G", "b/x", "b"), (3, "G", "c/x", "c")])
    wide = leaderboard.pivot_grouped_table(cells, requests)
    assert wide.columns == ["request", "ord", "group", "display", "m1", "m2"]
    assert {r.request: (r.ord, r.m1, r.m2) for r in wide.collect()} == {"a/x": (1, 0.5, None), "b/x": (2, None, 0.25), "c/x": (3, None, None)}
    assert [r.request for r in leaderboard.pivot_grouped_table(cells.where("model = 'm1'"), requests, thinking=True).collect()] == ["a/x"]
    assert "pivotfirst" not in wide._jdf.queryExecution().optimizedPlan().toString()


def test_documents(spark):
    questions = spark.createDataFrame([(1, "d", "b.txt;a.txt", "q")], "question_id int, directory string, data_source_filenames string, question string")
    documents = spark.createDataFrame([("d", "a.txt", "A"), ("d", "b.txt", "B"), ("d", "c.txt", "C")], "directory string, name string, text string")
    assert docsets.assemble_doc_sets(questions, documents).first().documents_text == (
        "BEGIN DOCUMENT 1:\nB\nEND DOCUMENT 1\n\nBEGIN DOCUMENT 2:\nA\nEND DOCUMENT 2")
    lists = [(1, "d", "a.txt;gone.txt"), (2, "d", "gone.txt"), (3, "e", "a.txt"), (4, "d", "a.txt")]
    partly = docsets.assemble_doc_sets(
        spark.createDataFrame(lists, "question_id int, directory string, data_source_filenames string"), documents)
    assert {r.question_id: (r.documents_text is None, r.missing_documents) for r in partly.collect()} == {
        1: (True, ["gone.txt"]), 2: (True, ["gone.txt"]), 3: (True, ["a.txt"]), 4: (False, [])}
    names = spark.createDataFrame([("d", "The company's annual report.txt"), ("d", "plain.txt"), ("d", "nothing like it.txt")], "directory string, name string")
    files = spark.createDataFrame([("d", "The companyΓÇÖs annual report.txt"), ("d", "plain.txt"), ("d", "extra file.txt")], "directory string, name string")
    paired = docsets.pair_names(names, files)
    assert {(r.name, r.file) for r in paired.collect()} == {
        ("plain.txt", "plain.txt"), ("The company's annual report.txt", "The companyΓÇÖs annual report.txt")}
    assert [r.name for r in docsets.unresolved_names(names, paired).collect()] == ["nothing like it.txt"]


def test_metric_identity(spark):
    config = lambda metric, filter_="none": one(spark, export.metric_config(F.lit(metric), F.lit(filter_), F.lit("My Bench"), F.lit(True), ["judge"]))
    assert config("acc").metric_id == "accuracy" and config("pass@5").metric_id == "pass_at_5" and config("pass@5").score_type == "continuous"
    assert config("Odd Score!").metric_id == "my_bench.odd_score" and config("judge_Strict A").metric_id == "my_bench.judge.strict_a"
    assert config("acc", "strict").evaluation_description == "acc (filter: strict)" and config("degeneration").lower_is_better
