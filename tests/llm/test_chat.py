"""Chat layouts and the reversible template."""

from __future__ import annotations

import hashlib
import json

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from evalframe.llm import chat
from evalframe.llm.queries import PROBE, op4_chat_format

PARTS = ["\\", "\\\\", "<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "[ROLE]", "[TEXT]", "[/ROLE]", "[", "<", "a", "é", "\n", " "]


def digest(turns):
    by = {}
    for key, _, role, text in sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1] is not None, t[1] or 0, t[2], t[3])):
        by.setdefault(key, []).append((role, text))
    return {key: (len(ts), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in ts).encode()).hexdigest(),
                  sum(len(t) for r, t in ts if r == "assistant"),
                  hashlib.sha256("".join(t for r, t in ts if r == "assistant").encode()).hexdigest()) for key, ts in by.items()}


def read(frame):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in frame.collect()}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), st.sampled_from([*chat.MARKS, "tool", "", "[TEXT]\\"]))
def test_a_turn_reads_back(text, role):
    import re

    def escape(part):
        return re.sub(chat.ESCAPED, r"\\\1", part)

    marks = chat.MARKS.get(role)
    out = marks[0] + escape(text) + marks[1] if marks else chat.OTHER[0] + escape(role) + chat.OTHER[1] + escape(text) + chat.OTHER[2]
    assert chat.read_turn(out) == (role, text)


def test_layouts(spark):
    records = [
        {"conv_id": 1, "turn": 1, "role": "assistant", "text": "b"}, {"conv_id": 1, "turn": 0, "role": "user", "text": None},
        {"id": 2, "messages": [{"role": "user", "content": PROBE}, {"role": "assistant", "content": "x\\"}], "extra": {"deep": [1]}},
        {"id": 3, "conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "ho"}]},
        {"id": 4, "prompt": "p", "completion": "c"}, {"id": 5, "instruction": "i", "input": "", "output": "o"},
        {"id": 6, "system": "s", "prompt": "p", "completion": "c"}, {"id": 7, "instruction": "i", "input": "in", "output": "o"},
        {"id": 8, "question": "?"}, {"conv_id": None, "turn": None, "role": None, "text": "null id"},
    ]
    texts = [json.dumps(r) for r in records] + [None, "", "[1]", "no json", json.dumps(records[0])]
    frame = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "record string, layout long")
    turns = chat.canonical_turns(frame, "record")
    assert turns.where("layout IS NULL").count() == 5
    got = read(chat.read_back(chat.formatted(turns.where("layout IS NOT NULL"))))
    assert got == digest([
        (1, 0, "user", ""), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (2, 0, "user", PROBE), (2, 1, "assistant", "x\\"),
        (3, 0, "user", "hi"), (3, 1, "assistant", "ho"), (4, 0, "user", "p"), (4, 1, "assistant", "c"), (5, 0, "user", "i"),
        (5, 1, "assistant", "o"), (6, 0, "system", "s"), (6, 1, "user", "p"), (6, 2, "assistant", "c"), (7, 0, "user", "i\nin"),
        (7, 1, "assistant", "o"), (None, None, "", "null id")])


def test_long_texts_and_no_rows(spark):
    long = "[INST] \\ </s>" * 40_000
    turns = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    assert read(chat.read_back(chat.formatted(turns))) == digest([(1, 0, "user", long), (1, 1, "assistant", long)])
    assert read(chat.read_back(chat.formatted(turns.where(F.lit(False))))) == {}


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    turns = [(r["conv_id"], r["turn"], r["role"], r["text"] or "") for r in rows]
    turns += [(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)]
    assert read(op4_chat_format(spark, sf)) == digest(turns)
