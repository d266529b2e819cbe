from __future__ import annotations

import random

import pytest

SF = "/root/testdata/sf0.001"

# Besides the key and the text, names that operators use inside.
EXTRA = "lang string, source string, n_chars long, `key` string, `row` string, doc string, id string, `rank` string, start string"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents from (doc_id, text) rows, with other columns whose names clash."""

    def build(rows):
        full = [(i, t, "xx", None, None if t is None else len(t), "k", None, "d", "i", "r", "s") for i, t in rows]
        return spark.createDataFrame(full, f"doc_id long, text string, {EXTRA}").repartition(3)

    return build


def passage(seed: int, count: int) -> str:
    pick = random.Random(seed)
    return " ".join("".join(pick.choice("abcdefghijklmnoprstuvéß") for _ in range(pick.randint(2, 9))) for _ in range(count))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank, tiny, repeated and very long texts, near copies, shared passages, periodic text."""
    long = passage(1, 30_000)
    shared = passage(2, 40)
    near = passage(3, 200).split(" ")
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (4, "word"), (5, "WORD"), (6, "a b c"), (7, "a b c"), (7, "a b c"),
        (8, long), (9, long + " end"), (10, passage(4, 60) + "\n" + shared + "\n" + passage(5, 60)),
        (11, passage(6, 60) + "\n" + shared), (12, shared + " " + passage(7, 30)), (13, "the same again " * 400),
        (14, "the same again " * 300), (None, passage(8, 50)), (None, None), (15, "x" * 5000), (16, "x" * 4990),
    ]
    rows += [(20 + k, " ".join(near[:k] + ["changed"] + near[k + 1 :])) for k in range(12)]
    rows += [(40 + k, passage(9, 80)) for k in range(6)]
    return rows
