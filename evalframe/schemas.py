"""Explicit schemas of everything that is read, as DDL."""

from __future__ import annotations

# Sections of a harness result file, each keyed by task. Scores stay VARIANT so that their JSON type is known.
RESULTS = (
    "results MAP<STRING, MAP<STRING, VARIANT>>, "
    "configs MAP<STRING, STRUCT<task STRING, dataset_path STRING, dataset_name STRING, test_split STRING, "
    "validation_split STRING, num_fewshot INT, output_type STRING, doc_to_text STRING, "
    "generation_kwargs MAP<STRING, STRING>, repeats INT>>, "
    "higher_is_better MAP<STRING, MAP<STRING, BOOLEAN>>, "
    "`n-samples` MAP<STRING, STRUCT<original BIGINT, effective BIGINT>>, `n-shot` MAP<STRING, INT>, "
    "config STRUCT<model STRING, model_args STRING, gen_kwargs STRING, `limit` DOUBLE, model_revision STRING, "
    "model_sha STRING, model_dtype STRING>, "
    "model_name STRING, lm_eval_version STRING, git_hash STRING, date DOUBLE, pretty_env_info STRING, "
    "task_hashes MAP<STRING, STRING>, group_subtasks MAP<STRING, ARRAY<STRING>>, "
    "repeat_protocols MAP<STRING, STRUCT<repeats INT, per_task_repeats MAP<STRING, INT>, "
    "metric_tasks MAP<STRING, ARRAY<STRING>>, sampling_enabled BOOLEAN>>, "
    "repeat_results ARRAY<STRUCT<repeat_index INT, results MAP<STRING, MAP<STRING, STRING>>>>"
)

# One harness sample line. Metric values beside these fields are read by name from the line itself.
SAMPLE = (
    "doc_id BIGINT, doc STRING, input STRING, target STRING, arguments MAP<STRING, STRUCT<arg_0 STRING, arg_1 STRING>>, "
    "resps ARRAY<ARRAY<STRING>>, filtered_resps ARRAY<ARRAY<STRING>>, metrics ARRAY<STRING>, filter STRING, "
    "doc_hash STRING, prompt_hash STRING, target_hash STRING, repeat_indices ARRAY<INT>"
)

TRIAL = (
    "task_name STRING, trial_name STRING, verifier_result STRUCT<rewards MAP<STRING, DOUBLE>>, "
    "exception_info STRUCT<exception_type STRING, exception_message STRING>, "
    "agent_result STRUCT<n_input_tokens BIGINT, n_output_tokens BIGINT>, started_at STRING, finished_at STRING"
)

REVIEW = (
    "agent_trace STRUCT<total_usage STRUCT<input_tokens BIGINT, output_tokens BIGINT>, "
    "events ARRAY<STRUCT<timestamp DOUBLE>>>, "
    "sample_score STRUCT<sample_id STRING, sample_metadata STRUCT<instance_id STRING, repo STRING>, "
    "score STRUCT<value MAP<STRING, DOUBLE>, status STRING, extracted_prediction STRING, "
    "metadata STRUCT<completed BOOLEAN, resolved BOOLEAN, report STRING>>>"
)

# The two shapes of a review's scoring report.
REPORT_RAN = "f2p ARRAY<STRING>, p2p ARRAY<STRING>, tests ARRAY<STRUCT<name STRING, status STRING>>, error STRING"
REPORT_BY_GROUP = "MAP<STRING, STRUCT<tests_status MAP<STRING, STRUCT<success ARRAY<STRING>, failure ARRAY<STRING>>>>>"

REPORT = (
    "dataset_name STRING, model_name STRING, score DOUBLE, "
    "metrics ARRAY<STRUCT<identity STRUCT<name STRING>, score DOUBLE, num BIGINT>>"
)

SIMULATIONS = (
    "info STRUCT<environment_info STRUCT<domain_name STRING>>, "
    "simulations ARRAY<STRUCT<task_id STRING, termination_reason STRING, reward_info STRUCT<reward DOUBLE>, "
    "info STRUCT<error STRING, error_type STRING, error_traceback STRING>, start_time STRING, end_time STRING>>"
)

CATEGORY_SCORE = "accuracy DOUBLE, correct_count BIGINT, total_count BIGINT"

QUESTIONS = "id STRING, question STRING, prop STRING, possible_answers STRING, s_pop BIGINT, o_pop BIGINT"
