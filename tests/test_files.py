"""Sources, sinks and streaming on real files."""

from __future__ import annotations

import gzip
import io
import itertools
import json

import pytest
from pyspark.sql import functions as F

from evalframe.functions import samples
from evalframe.sources import dimensions, files, growing, records, sinks
from evalframe.streaming import progress


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_exactly_one_results_file(spark, tmp_path):
    write(tmp_path / "a/results_1.json", json.dumps({"results": {"t": {"acc,none": 0.5, "alias": "t", "flag": True}}}))
    rows = records.read_harness_results(spark, str(tmp_path))
    assert {(r.key, r.raw, r.json_type.startswith("DECIMAL")) for r in rows.collect()} == {
        ("acc,none", "0.5", True), ("alias", "t", False), ("flag", "true", False)}
    write(tmp_path / "b/results_2.json", "{}")
    with pytest.raises(ValueError, match="found 2"):
        records.read_harness_results(spark, str(tmp_path))
    write(tmp_path / "none/other.json", "{}")
    with pytest.raises(ValueError, match="found 0"):
        records.read_harness_results(spark, str(tmp_path / "none"))


def test_sample_lines(spark, tmp_path):
    lines = ['{"doc_id": 1, "target": "x", "metrics": ["acc"], "acc": 1.0}', "", '{"doc_id": 2, "metrics": ["acc", "em"], "acc": [1, 0], "em": true}', '{"doc_id"']
    write(tmp_path / "samples_t_2025-01-01T00.jsonl", "\n".join(lines))
    raw = files.text_files(spark, str(tmp_path), "samples_*.jsonl", whole=False)
    good = {r.doc_id: r.v for r in records.sample_lines(raw).select("doc_id", records.attempt_values(F.col("scores")).alias("v")).collect()}
    assert good == {1: {"acc": [1.0]}, 2: {"acc": [1.0, 0.0], "em": [1.0]}}
    assert [r.value for r in records.bad_sample_lines(raw).collect()] == ['{"doc_id"']


def test_sample_values_keep_their_type(spark, tmp_path):
    lines = ['{"doc_id": "q-7", "metrics": ["acc", "em", "f"], "acc": "1.0", "em": 0.5, "f": null}',
             '{"doc_id": 8, "metrics": ["acc"], "acc": [1, "1"]}']
    write(tmp_path / "samples_t_2025-01-01T00.jsonl", "\n".join(lines))
    rows = records.sample_lines(files.text_files(spark, str(tmp_path), "samples_*.jsonl", whole=False))
    keys = F.array(F.lit("acc,none"), F.lit("em,none"))
    got = {r.doc_key: (r.doc_id, r.v, r.s and r.s.score) for r in rows.select(
        "doc_id", "doc_key", records.attempt_values(F.col("scores")).alias("v"),
        samples.sample_score(F.col("scores"), F.lit("none"), keys).alias("s")).collect()}
    assert got["q-7"] == (None, {"em": [0.5]}, 0.5)  # text is no score
    assert got["8"][0] == 8 and got["8"][2] is None


def test_flattening_keeps_bad_lines(spark):
    rows = spark.createDataFrame([("{\"a\": {\"b\": [1, \"x\"]}}",), ("[1]",), ("{",), (None,)], "line string")
    assert [r.m for r in rows.select(records.flatten_json("line").alias("m")).collect()] == [{"a/b": "[1, 'x']"}, None, None, None]


def test_latest_sample_file(spark):
    names = ["samples_a_2025-01-01T00.jsonl", "samples_a_2025-02-01T00.jsonl", "samples_a_b_2025-03-01T00.jsonl", "samples_a_old.jsonl"]
    rows = spark.createDataFrame([("/x/" + n,) for n in names], "path string")
    assert {r.task: r.path for r in files.latest_sample_files(rows).collect()} == {"a": "/x/" + names[1], "a_b": "/x/" + names[2]}


def test_json_keys(spark):
    docs = spark.createDataFrame([('{"a": [{"b": 1}], "c": {"d": "e: f"}}',), ("{",), (None,)], "value string")
    assert [r.k for r in docs.select(records.json_keys("value").alias("k")).collect()] == [["a", "b", "c", "d"], None, None]


def test_group_csv(spark, tmp_path):
    write(tmp_path / "data_live.csv", "Model,Live Overall Acc\nm,71.74%\nn,1%\n")
    write(tmp_path / "data_multi.csv", "Model,Acc\nm,N/A\n")
    assert records.read_group_csv(spark, str(tmp_path / "data_live.csv"), "live", "Live Overall Acc").first().score == pytest.approx(0.7174)
    assert records.read_group_csv(spark, str(tmp_path / "data_multi.csv"), "multi", "Acc").first().score is None


def test_questions(spark, tmp_path):
    text = "id\tquestion\tprop\tpossible_answers\ts_pop\to_pop\n1\tWho \"\"is\"\" it?\tjob\t\"[\"\"a\"\", \"\"b c\"\"]\"\t10\t20\n"
    write(tmp_path / "q.tsv", text)
    row = records.read_questions(spark, str(tmp_path / "q.tsv")).first()
    assert (row.id, row.aliases, row.s_pop) == ("1", ["a", "b c"], 10)


def test_requests():
    lines = ["lost/acc", "# One", "a/acc,none", "", "## Two", "b/em", "b/f1"]
    assert dimensions.parse_requests(lines) == [(0, "One", "a/acc,none", "a"), (1, "Two", "b/em", "b"), (2, "Two", "b/f1", "b")]


def test_round_trip_of_lines(spark, tmp_path):
    rows = spark.createDataFrame([("a", "001", "x"), ("a", "2", "y"), ("b", "3", "z")], "collection string, model string, value string")
    sinks.write_lines(rows, str(tmp_path / "out"), ["collection", "model"])
    back = sinks.read_export_lines(spark, str(tmp_path / "out"), ["collection", "model"])
    assert {tuple(r) for r in back.select("collection", "model", "value").collect()} == {tuple(r) for r in rows.collect()}


def test_round_trip_of_small_files(spark, tmp_path):
    keys = ["collection", "developer", "model", "uuid"]
    odd = ["a/b", "50%", "c=d", "é ü", "%41", "q:'\"?*#[]{}\\^", None]
    rows = [("b", "acme", m, str(i), line) for i, m in enumerate(odd) for line in ('{"x": "é"}', "", '{"x": "é"}')]
    table = spark.createDataFrame(rows, ", ".join(f"{k} string" for k in [*keys, "value"]))
    sinks.write_small_files(table.limit(0), str(tmp_path / "none"), keys)
    assert sinks.read_small_files(spark, str(tmp_path / "none"), keys).count() == 0
    for _ in range(2):  # the second takes the place of the first
        sinks.write_small_files(table, f"file:{tmp_path}/out", keys)
    # the layout is that of Spark's own writer, both ways
    sinks.write_lines(table, str(tmp_path / "spark"), keys)
    names = lambda root: {str(p.parent.relative_to(tmp_path / root)) for p in (tmp_path / root).rglob("*.txt")}
    assert names("out") == names("spark") and len(list((tmp_path / "out").rglob("*.txt"))) == len(odd)
    for root in ("out", "spark"):
        for read in (sinks.read_small_files, sinks.read_export_lines):
            back = read(spark, str(tmp_path / root), keys).select(*keys, "value")
            assert sorted(map(str, back.collect())) == sorted(map(str, table.collect())), (root, read)


def test_progress_follows_new_segments(spark, tmp_path):
    line = lambda acc, status="success": json.dumps({"sample_score": {"score": {"value": {"acc": acc}, "status": status}}})
    root, sink, state = tmp_path / "in", tmp_path / "progress", tmp_path / "state"

    def run():
        progress.start_progress(spark, str(root), str(sink), str(state), once=True, idle=0).awaitTermination()
        return {r.key: (r.done, r.passed, r.failed) for r in progress.latest_progress(spark, str(sink)).collect()}

    write(root / "reviews/m/d_all.jsonl/0001", "\n".join([line(1.0), line(0.0), line(0.0, "error"), '{"sample_sc']))
    assert run() == {"m/d_all": (3, 1, 1)}
    write(root / "reviews/m/d_all.jsonl/0002", line(1.0))
    write(root / "reviews/m/e_all.jsonl/0001", line(0.5))
    assert run() == {"m/d_all": (4, 2, 1), "m/e_all": (1, 0, 0)}


def test_progress_of_a_file_that_grows_in_place(spark, tmp_path):
    line = lambda acc: json.dumps({"sample_score": {"score": {"value": {"acc": acc}, "status": "success"}}})
    root, sink, state = tmp_path / "in", tmp_path / "progress", tmp_path / "state"
    path = root / "reviews/m/d_all.jsonl"

    def run(more, idle=1000):
        path.parent.mkdir(parents=True, exist_ok=True)
        with path.open("a") as file:
            file.write(more)
        progress.start_progress(spark, str(root), str(sink), str(state), once=True, idle=idle).awaitTermination()
        return {r.key: (r.done, r.passed) for r in progress.latest_progress(spark, str(sink)).collect()}

    assert run(line(1.0) + "\n" + line(0.0) + "\n" + line(1.0)[:20]) == {"m/d_all": (2, 1)}
    assert run(line(1.0)[20:] + "\n") == {"m/d_all": (3, 2)}  # the half line of before, once
    assert run(line(1.0)) == {"m/d_all": (3, 2)}  # not finished yet
    assert run("", idle=0) == {"m/d_all": (4, 3)}  # left alone, so it is
    batches = [spark.read.parquet(str(p)).count() for p in sorted(sink.glob("batch=*"))]
    assert sum(batches) <= 4 and max(batches) == 1  # what came in, not what was known


@pytest.mark.parametrize("block", [1, 3, 1 << 20])
def test_ranges_give_every_line_once(monkeypatch, block):
    monkeypatch.setattr(growing, "BLOCK", block)
    for data in (b"", b"\n", b"a", b"a\nbb\n\nccc", b"\n\nx\n", b"long line without end" * 3):
        want, at = [], 0
        for part in data.split(b"\n"):
            want.append((at, part))
            at += len(part) + 1
        if want[-1][1] == b"":
            want.pop()
        for cuts in itertools.combinations(range(1, len(data)), 2) if len(data) < 14 else [(5, 9), (1, 40)]:
            edges = [0, *cuts, len(data)]
            got = []
            for a, b in zip(edges, edges[1:]):
                got += growing.range_lines(io.BytesIO(data), growing.Range("p", a, b, b == len(data)))
            assert got == want, (data, cuts)


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_zipped_files_give_every_line_once(monkeypatch, block):
    monkeypatch.setattr(growing, "BLOCK", block)
    members = [b"a\nbb\n", b"\nccc", b"dd\n" + b"p" * 5000, b"", b"\nlast"]
    data = gzip.compress(members[0]) + bytes(3) + b"".join(map(gzip.compress, members[1:]))
    want, at = [], 0
    for part in b"".join(members).split(b"\n"):
        want.append((at, part))
        at += len(part) + 1
    for cuts in ([], [1], [30], [len(data) - 1], range(5, len(data), 5)):  # sizes at which the growing file was looked at
        edges = [0, *cuts, len(data)]
        got = []
        for a, b in zip(edges, edges[1:]):
            got += growing.range_lines(io.BytesIO(data), growing.Range("p.gz", a, b, b == len(data)))
        assert got == want, cuts


def test_progress_of_zipped_segments(spark, tmp_path):
    line = lambda acc: json.dumps({"sample_score": {"score": {"value": {"acc": acc}}}, "patch": "p" * 10_000})
    root, sink, state = tmp_path / "in", tmp_path / "progress", tmp_path / "state"
    rows = spark.createDataFrame(
        [("a", "d_all.jsonl", line(float(i % 2))) for i in range(300)], "m string, f string, value string")

    def run():
        progress.start_progress(spark, str(root), str(sink), str(state), once=True).awaitTermination()
        return {r.key: (r.done, r.passed) for r in progress.latest_progress(spark, str(sink)).collect()}

    sinks.write_lines(rows, str(root / "reviews"), ["m", "f"], compression="gzip")
    segments = list(root.rglob("*.gz"))
    assert sum(p.stat().st_size for p in segments) < 100_000  # of 3 MB
    assert run() == {"m=a/f=d_all": (300, 150)}
    with segments[0].open("ab") as file:
        file.write(gzip.compress((line(1.0) + "\n").encode()))
    assert run() == {"m=a/f=d_all": (301, 151)}
