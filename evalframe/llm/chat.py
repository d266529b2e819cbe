"""Chat formatting: records of several layouts become canonical turns, and turns one escaped, reversible template.

The fingerprint of a record is a hash of its nested field paths, as far as any mapping knows them. It selects a declarative
mapping that names where the conversation, the turns, the roles and the texts are. Records whose fingerprint no mapping has
are returned apart. A canonical conversation is a row for each turn, so its length has no bound.

The template opens and closes every turn with marks. Inside texts a backslash goes before every backslash and every string
that is a mark, and one is taken away on reading, so each text comes back unchanged. The loss mask is the span of an
assistant's text in its formatted turn.

Nulls: a null text, role or content is empty; a null conversation id is one conversation, null turns come first. Equal
turn numbers are ordered by role and text; repeated rows stay. Fields that no mapping knows are ignored, whatever they are
called. A record that is null or no JSON object is unmapped. An empty table gives no turns.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Where each layout keeps its parts. `turns` is a list of objects; `fields` are turns in order, each a role
# and the fields whose texts make it up.
MAPPINGS = {
    "turn rows": {"id": "conv_id", "turn": "turn", "role": "role", "text": "text"},
    "messages": {"id": "id", "turns": "messages", "role": "role", "text": "content"},
    "shared": {"id": "id", "turns": "conversations", "role": "from", "text": "value"},
    "prompt": {"id": "id", "fields": [("user", ["prompt"]), ("assistant", ["completion"])]},
    "prompt with system": {"id": "id", "fields": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["completion"])]},
    "instruction": {"id": "id", "fields": [("user", ["instruction"]), ("assistant", ["output"])]},
    "instruction with input": {"id": "id", "fields": [("user", ["instruction", "input"]), ("assistant", ["output"])]},
}

# Other names of the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "model": "assistant"}

# The marks around the turns of each role; any other role is named between the first and the second.
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>")}
OTHER = ("[ROLE]", "[TEXT]", "[/ROLE]")
_CONTROL = ["<s>", *[m for pair in MARKS.values() for m in pair], *OTHER]
ESCAPED = "(" + "|".join(re.escape(m) for m in ["\\", *_CONTROL]) + ")"
_BACK = re.compile(r"\\(.)", re.DOTALL)
_TOKEN = re.compile(r"\\.|(" + "|".join(re.escape(m) for m in _CONTROL) + ")", re.DOTALL)


def mapping_paths(mapping: dict) -> list[str]:
    if "turns" in mapping:
        return [mapping["id"], *(f"{mapping['turns']}[].{mapping[k]}" for k in ("role", "text"))]
    if "fields" in mapping:
        return [mapping["id"], *(f for _, fields in mapping["fields"] for f in fields)]
    return [mapping[k] for k in ("id", "turn", "role", "text")]


def paths(value, prefix: str = "") -> set[str]:
    """Nested field paths of a JSON value; members of a list share the path of the list followed by []."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{prefix}.{k}" if prefix else k) for k, v in value.items())) if value else {prefix}
    if isinstance(value, list):
        return set().union(*(paths(v, prefix + "[]") for v in value)) if value else {prefix}
    return {prefix}


def fingerprint(found) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


def _text(value) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def _turns(record: dict, mapping: dict) -> list[tuple[int | None, str, str]]:
    if "turns" in mapping:
        return [(i, _text(t.get(mapping["role"])), _text(t.get(mapping["text"])))
                for i, t in enumerate(record[mapping["turns"]]) if isinstance(t, dict)]
    if "fields" in mapping:
        return [(i, role, "\n".join(_text(record.get(f)) for f in fields if record.get(f)))
                for i, (role, fields) in enumerate(mapping["fields"])]
    return [(record.get(mapping["turn"]), _text(record.get(mapping["role"])), _text(record.get(mapping["text"])))]


def _canonical(mappings: dict):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = set().union(*(mapping_paths(m) for m in mappings.values()))
        by_print = {fingerprint(mapping_paths(m)): (name, m) for name, m in mappings.items()}
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                try:
                    record = json.loads(text) if text else None
                except ValueError:
                    record = None
                mark = fingerprint(paths(record) & known) if isinstance(record, dict) else None
                name, mapping = by_print.get(mark, (None, None))
                if mapping is None:
                    rows.append((None, None, None, None, mark, None, text))
                    continue
                key = record.get(mapping["id"])
                key = key if isinstance(key, int) and not isinstance(key, bool) else None
                for turn, role, said in _turns(record, mapping):
                    rows.append((key, turn, ROLES.get(role, role), said, mark, name, None))
            names = ["conv_id", "turn", "role", "text", "fingerprint", "layout", "unmapped"]
            kinds = [pa.int64(), pa.int64()] + [pa.string()] * 5
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return read


def canonical_turns(records: DataFrame, column: str, mappings: dict = MAPPINGS) -> DataFrame:
    """conv_id, turn, role, text, fingerprint, layout; records without a mapping have layout null and stand in `unmapped`."""
    return records.select(F.col(column).cast("string")).mapInArrow(
        _canonical(mappings),
        "conv_id long, turn long, role string, text string, fingerprint string, layout string, unmapped string")


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, formatted, loss_start, loss_end (code points; null without loss): a row for each turn."""

    def escape(column: str):
        return F.regexp_replace(F.coalesce(F.col(column), F.lit("")), ESCAPED, r"\\$1")

    opened, closed = F.concat(F.lit(OTHER[0]), escape("role"), F.lit(OTHER[1])), F.lit(OTHER[2])
    for role, (mark, end) in MARKS.items():
        opened = F.when(F.col("role") == role, F.lit(mark)).otherwise(opened)
        closed = F.when(F.col("role") == role, F.lit(end)).otherwise(closed)
    loss = F.col("role") == "assistant"
    return turns.select("conv_id", "turn", "role", "text", opened.alias("_open"), escape("text").alias("_text"),
                        closed.alias("_close")).select(
        "conv_id", "turn", "role", "text", F.concat("_open", "_text", "_close").alias("formatted"),
        F.when(loss, F.length("_open")).cast("long").alias("loss_start"),
        F.when(loss, F.length("_open") + F.length("_text")).cast("long").alias("loss_end"),
    )


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def read_turn(text: str) -> tuple[str, str]:
    """Role and text of a formatted turn, from its marks alone."""
    marks = [(m.group(1), m.start(), m.end()) for m in _TOKEN.finditer(text) if m.group(1)]
    names = [m[0] for m in marks]
    for role, pair in MARKS.items():
        if names == list(pair):
            return role, unescape(text[marks[0][2] : marks[1][1]])
    if names != list(OTHER):
        raise ValueError("not a formatted turn")
    return unescape(text[marks[0][2] : marks[1][1]]), unescape(text[marks[1][2] : marks[2][1]])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads sorted turns as a stream; only the sums of one conversation are held."""
    current, state, out = None, None, []

    def close():
        out.append((current[0], state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["all"]))

    def flush():
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 6, kinds)], names)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end")]
        for key, text, start, end in zip(*columns):
            if current != (key,):
                if current is not None:
                    close()
                current, state = (key,), {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "all": 0}
            role, said = read_turn(text)
            state["n"] += 1
            state["turns"].update(f"{role}\n{said}\n".encode())
            state["all"] += len(text)
            if start is not None:
                learned = unescape(text[start:end])
                state["chars"] += len(learned)
                state["loss"].update(learned.encode())
        if len(out) >= 10_000:
            yield flush()
            out = []
    if current is not None:
        close()
    yield flush()


def read_back(output: DataFrame) -> DataFrame:
    """Digests of every conversation, read from the formatted turns."""
    partitions = int(output.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = output.repartition(partitions, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(
        _digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
