"""Answers, judge replies and error texts as Columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Markers around inline reasoning.
THINK_START = "<|inner_prefix|>"
THINK_END = "<|inner_suffix|>"

# The last mention in a judge's reply is its verdict.
GRADE_LETTER_PATTERN = r"(?is).*grade\s*:\s*([cpin])\b"
GRADE_WORD_PATTERN = r"(?is).*\b(correct|incorrect)\b"

# Error texts that tell who is to blame.
EMPTY_REPLY_PREFIX = "AssistantMessage must have either content or tool_calls"
OVERFLOW_TYPE = "ContextWindowExceededError"
AGENT_PATH = "/tau2/agent/"
INFERENCE_ERROR_MARKERS = ["Error during inference", "Error occurred during inference"]
OVERFLOW_MARKERS = ["context length", "context_length"]
MODEL_FAILURES = ["Patch Apply Failed", "Test timed out"]

# File types a judge can read, and how much of a file it is shown.
TEXT_EXTENSIONS = [".txt", ".md", ".csv", ".json", ".py", ".yaml", ".yml"]


def strip_reasoning(text: Column) -> Column:
    """The answer without inline thinking; empty if the thinking never closed."""
    block = r"(?s)\Q" + THINK_START + r"\E.*?\Q" + THINK_END + r"\E"
    rest = F.regexp_replace(text, block, "")
    rest = F.substring_index(rest, THINK_END, -1)
    rest = F.substring_index(rest, THINK_START, 1)
    return F.regexp_replace(rest, r"^\s+|\s+$", "")


def includes_any(answer: Column, aliases: Column) -> Column:
    """True if any alias occurs in the answer, ignoring case."""
    lower = F.lower(answer)
    return F.exists(aliases, lambda alias: F.contains(lower, F.lower(alias)))


def grade_letter(reply: Column) -> Column:
    """The last `GRADE: X` with X in C, P, I, N; N when there is none."""
    letter = F.upper(F.regexp_extract(reply, GRADE_LETTER_PATTERN, 1))
    return F.coalesce(F.nullif(letter, F.lit("")), F.lit("N"))


def grade_word(reply: Column) -> Column:
    """C if the last word out of correct/incorrect is correct, else I."""
    word = F.lower(F.regexp_extract(reply, GRADE_WORD_PATTERN, 1))
    return F.when(word == "correct", "C").otherwise("I")


def pairwise_verdict(reply: Column, candidate_is_a: Column) -> Column:
    """win, loss or tie from the candidate's side; A is tested first, then B, then TIE."""
    upper = F.upper(reply)
    return (
        F.when(F.contains(upper, F.lit("WINNER: A")), F.when(candidate_is_a, "win").otherwise("loss"))
        .when(F.contains(upper, F.lit("WINNER: B")), F.when(candidate_is_a, "loss").otherwise("win"))
        .when(F.contains(upper, F.lit("WINNER: TIE")), "tie")
        .otherwise("unparsed")
    )


def failure_cause(termination: Column, error: Column, error_type: Column, traceback: Column) -> Column:
    """Why the model itself is to blame for a simulation without reward, else NULL."""
    infrastructure = F.coalesce(termination == "infrastructure_error", F.lit(False))
    return F.when(
        infrastructure,
        F.when(F.startswith(error, F.lit(EMPTY_REPLY_PREFIX)), "empty_reply").when(
            (error_type == OVERFLOW_TYPE) & F.contains(traceback, F.lit(AGENT_PATH)), "context_overflow"
        ),
    )


def inference_error_cause(result_json: Column, chars: int | None = None) -> Column:
    """context_overflow or other when the result (its first `chars` characters, if given) names an inference error, else NULL."""
    head = result_json if chars is None else F.left(result_json, F.lit(chars))
    return F.when(contains_any(head, INFERENCE_ERROR_MARKERS),
                  F.when(contains_any(head, OVERFLOW_MARKERS), "context_overflow").otherwise("other"))


def is_evaluation_error(completed: Column, report_error: Column) -> Column:
    """An evaluation that did not finish for a reason other than the model's own patch."""
    finished = F.coalesce(completed, F.lit(True))
    return ~finished & ~contains_any(F.coalesce(report_error, F.lit("")), MODEL_FAILURES)


def judge_part(name: Column, content: Column, size: Column, chars: int | None = None) -> Column:
    """One deliverable as the judge sees it: a headed text, cut after `chars` characters if given, or a size note."""
    shown = content if chars is None else F.left(content, F.lit(chars))
    extension = F.regexp_extract(F.lower(name), r"(\.[^.]+)$", 1)
    head = F.concat(F.lit("--- "), name)
    return F.when(
        extension.isin(TEXT_EXTENSIONS), F.concat(head, F.lit(" ---\n"), shown)
    ).otherwise(F.concat(head, F.lit(" (binary, "), size.cast("string"), F.lit(" bytes, not extracted) ---")))


def contains_any(text: Column, markers: Sequence[str]) -> Column:
    hit = F.lit(False)
    for marker in markers:
        hit = hit | F.contains(text, F.lit(marker))
    return hit
