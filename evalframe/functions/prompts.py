"""Prompts rendered from question tables, one Column per template."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

# Prompt texts.
SHORT_ANSWER = "Answer the question with a short phrase only. Do not explain.\n\nQuestion: {question}\nAnswer:"
GRADE = """\
You are grading a submitted answer to a factual question against a reference \
answer.

[Question]: {question}
[Reference answer]: {criterion}
[Submitted answer]: {answer}

Classify the submitted answer into exactly one of these four categories:

CORRECT: The submitted answer fully contains, or is equivalent in meaning \
to, the reference answer. Differences in formatting, phrasing, or a level \
of precision that doesn't change the substance of the answer are fine.
PARTIAL: The submitted answer is accurate and on the right track, but is \
missing part of what the reference answer requires, or is less precise or \
complete than it.
INCORRECT: The submitted answer contradicts the reference answer, or gives \
a materially different answer.
NOT_ATTEMPTED: No answer was given, or the response explicitly states it \
does not know or cannot answer, without guessing.

First give a brief explanation of your reasoning. Then finish your \
response with exactly one line of the form:

GRADE: <letter>

where <letter> is one of C (correct), P (partial), I (incorrect), or N \
(not attempted).
"""
DOCUMENTS = """BEGIN INPUT DOCUMENTS

{documents_text}

END INPUT DOCUMENTS

Answer the following question using the input documents provided above.

START QUESTION

{question}

END QUESTION
"""
CONSISTENCY = """Assess whether the following CANDIDATE ANSWER is CORRECT or INCORRECT.
For the CANDIDATE ANSWER to be correct, it must be consistent with the OFFICIAL ANSWER.

The question, for reference only: {question}
The OFFICIAL ANSWER: {official_answer}
CANDIDATE ANSWER TO ASSESS: {candidate_answer}

Reply only with CORRECT or INCORRECT.
"""


def fill(template: str, **values: Column) -> Column:
    """A template with each `{name}` replaced; the values are never scanned for placeholders themselves."""
    pieces, rest = [], template
    while rest:
        hits = [(rest.index("{" + name + "}"), name) for name in values if "{" + name + "}" in rest]
        if not hits:
            pieces.append(F.lit(rest))
            break
        start, name = min(hits)
        if start:
            pieces.append(F.lit(rest[:start]))
        pieces.append(F.coalesce(values[name], F.lit("")))
        rest = rest[start + len(name) + 2:]
    return F.concat(*pieces)


def short_answer(question: Column) -> Column:
    return fill(SHORT_ANSWER, question=question)


def grade_prompt(question: Column, criterion: Column, answer: Column) -> Column:
    return fill(GRADE, question=question, criterion=criterion, answer=answer)


def documents_prompt(documents_text: Column, question: Column) -> Column:
    return fill(DOCUMENTS, documents_text=documents_text, question=question)


def consistency_prompt(question: Column, official_answer: Column, candidate_answer: Column) -> Column:
    return fill(CONSISTENCY, question=question, official_answer=official_answer, candidate_answer=candidate_answer)


def worked_example(
    question: Column, starter: Column, with_starter: Mapping[str, str], without_starter: Mapping[str, str]
) -> Column:
    """A base-model prompt: one worked example, then the question; with a starter code both show one.

    The examples hold question, answer and sample_code.
    """
    has_starter = F.coalesce(starter != "", F.lit(False))

    def block(asked: Column, code: Column | None, answer: str) -> Column:
        parts = [F.lit("### Question\n"), asked, F.lit("\n\n")]
        if code is not None:
            parts += [F.lit("### Starter Code\n"), F.coalesce(code, F.lit("")), F.lit("\n\n")]
        parts.append(F.lit("### Answer\n\n" + (answer + "\n\n" if answer else "")))
        return F.concat(*parts)

    shot = lambda example, code: block(F.lit(example["question"]), code, example["answer"])
    return F.when(
        has_starter,
        F.concat(shot(with_starter, F.lit(with_starter.get("sample_code") or "")), block(question, starter, "")),
    ).otherwise(F.concat(shot(without_starter, None), block(question, None, "")))
