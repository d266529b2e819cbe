"""The pipeline against plain versions of its stages, and the registration that does without it."""

from __future__ import annotations

import subprocess
import sys
import textwrap

import corpus_pipeline
from evalframe.llm.shared import written

from .test_prefix_tree import plain as plain_groups
from .test_private_terms import plain as plain_spans
from .test_tokens_out import check_packing


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    items = [r["text"].lower() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf), "stage")
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "quality":
            good = [k for k in before if labels.get(k) == (1, 0)]
            assert sum(k in after for k in good) >= 0.95 * len(good)
        elif name == "near-duplicates":
            assert sorted(after) == sorted(k for k, _, c in plain_groups(list(before.items()), 5, 4, 5) if k == c)
        elif name == "decontamination":
            gone = set(before) - set(after)
            assert gone >= {k for k, t in before.items() if any(i in t.lower() for i in items)}
            assert len(gone) < 0.2 * len(before)
        else:
            assert sorted(after) == sorted(before)
            for k, text in before.items():
                assert (after[k] == text) == (sum(plain_spans(text)[:4]) == 0)
                assert sum(plain_spans(after[k])[:4]) == 0
        before = after
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    check_packing(rows, list(before.items()), corpus_pipeline.SEQUENCE)


def test_run_gives_the_last_stage(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(rows[0].asDict())


def test_odd_documents(spark, docs_of, odd_rows, sf):
    docs = docs_of(odd_rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf), "stage")
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() > 0
    empty = docs_of([])
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.collect() == []


def test_entry_without_the_operators():
    code = """
        import sys
        class Gone:
            def find_spec(self, name, path=None, target=None):
                if name == "corpus_pipeline" or name.startswith("evalframe.llm"):
                    raise ImportError(name)
        sys.meta_path.insert(0, Gone())
        import __spark_entry__ as entry
        names = entry.queries()
        assert names and "pipeline" not in names and not any(n.startswith("op") for n in names)
        assert set(entry.oracle_sql()) <= set(names)
    """
    subprocess.run([sys.executable, "-c", textwrap.dedent(code)], check=True, cwd=corpus_pipeline.__file__.rsplit("/", 1)[0], timeout=100)
