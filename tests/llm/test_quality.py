"""The quality sample: held-out accuracy, and what it does to odd rows."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalframe.llm import quality
from evalframe.llm.queries import GOOD, op9_importance_resampling

LABELS = "doc_id long, quality int, toxic int, text string, `good` string"


def test_threshold_far_below(spark):
    """Long documents have low weights: good ones at -900 are told from junk at -5,000."""
    rows = [(-900.0 - i, True) for i in range(20)] + [(-5000.0 - i, False) for i in range(20)]
    line = quality.threshold(spark.createDataFrame(rows, "log_weight double, good boolean"))
    assert -5000 < line <= -919


@pytest.fixture(scope="module")
def labels(spark, sf):
    return {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}


def test_held_out_accuracy(spark, labels):
    """Fitted with half of the labels, judged by the other half."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    known = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("doc_id % 2 = 0")
    model = quality.fit(docs, known, "doc_id", "text", GOOD)
    kept = {r["key"] for r in model.sample().select("key").collect()}
    unseen = {k: v for k, v in labels.items() if k % 2}
    good = [k for k, v in unseen.items() if v == (1, 0)]
    junk = [k for k, v in unseen.items() if v[0] == 0]
    toxic = [k for k, v in unseen.items() if v == (1, 1)]
    assert sum(k in kept for k in good) >= 0.97 * len(good)
    assert sum(k in kept for k in junk) <= 0.1 * len(junk)
    assert sum(k in kept for k in toxic) <= 0.15 * len(toxic)


def test_sample_and_stage_agree(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "text", GOOD)
    kept = quality.kept(docs, "doc_id", "text", model)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["key"] for r in model.sample().collect())
    assert sorted(r["doc_id"] for r in op9_importance_resampling(spark, sf).collect()) == sorted(r["doc_id"] for r in kept.collect())


def test_odd_rows(spark, docs_of):
    fine = [(i, f"a calm and friendly text about number{i % 7} and gardens") for i in range(120)]
    bad = [(200 + i, f"a calm text !!! xx!!! worthless{i % 3} scum scum") for i in range(60)]
    odd = [(None, None), (None, "a calm text !!! scum"), (400, None), (401, ""), (402, " \n"), (0, fine[0][1]), (403, "gardens " * 30_000)]
    docs = docs_of(fine + bad + odd)
    rows = [(i, 1, 0, "x", "y") for i in range(0, 100)] + [(200 + i, 0, 1, "x", "y") for i in range(0, 40)]
    rows += [(None, 1, 0, "x", "y"), (5, None, 0, "x", "y"), (9999, 1, 0, "x", "y"), (3, 1, 0, "x", "y")]
    model = quality.fit(docs, spark.createDataFrame(rows, LABELS), "doc_id", "text", GOOD)
    kept = quality.kept(docs, "doc_id", "text", model).collect()
    ids = [r["doc_id"] for r in kept]
    assert not [i for i in ids if i is not None and 200 <= i < 260]
    assert {i for i, _ in fine} | {400, 401, 402} <= set(ids) and ids.count(0) == 2
    assert sorted(r["key"] is None for r in model.sample().collect()).count(True) == ids.count(None)


def test_without_labels_or_rows(spark, docs_of):
    none = spark.createDataFrame([], LABELS)
    docs = docs_of([(1, "a"), (2, None)])
    model = quality.fit(docs, none, "doc_id", "text", GOOD)
    assert quality.kept(docs, "doc_id", "text", model).count() == 2 and model.sample().count() == 2
    empty = quality.fit(docs_of([]), spark.createDataFrame([(1, 1, 0, "x", "y")], LABELS), "doc_id", "text", GOOD)
    assert quality.kept(docs_of([]), "doc_id", "text", empty).collect() == []


def test_last_place(spark):
    values = [float(v) for v in [5, 5, 5, 1, 2, 2, 9, -3, 0]]
    places = spark.createDataFrame([(i, v, v) for i, v in enumerate(values)], "key long, log_weight double, place double")
    order = sorted(((-v, i) for i, v in enumerate(values)))
    for k in range(1, len(values) + 1):
        assert quality.last_place(places, k) == (-order[k - 1][0], order[k - 1][1])


def plain_features(text):
    """The n-grams of a text as text."""
    kind = lambda c: 0 if c in " \t\n\r\x0b\x0c" else 1 if c.isalnum() else 2
    tokens, last = [], 0
    for c in text.lower():
        if kind(c) and kind(c) == last:
            tokens[-1] += c
        elif kind(c):
            tokens.append(c)
        last = kind(c)
    found = set(tokens) | set(zip(tokens, tokens[1:]))
    stems = Counter(t[:quality.STEM] for t in tokens if kind(t[0]) == 1 and len(t) >= quality.STEM)
    found |= {("stem", t) for t, n in stems.items() if n >= quality.OFTEN}
    for back in range(1, quality.REACH + 1) if tokens else ():
        found.add((back, sum(a == b for a, b in zip(tokens, tokens[back:])) * 8 // len(tokens)))
    return found


def test_model_and_draw_against_plain_ones(spark, docs_of):
    """Weights are sums over plain n-grams; the draw takes the highest places and the noise decides between equal weights."""
    pick = random.Random(4)
    word = lambda: pick.choice(["calm", "garden", "reading", "river", "letter", "stone"]) + pick.choice(["", "s", "ing"])
    rows = [(i, " ".join(word() for _ in range(pick.randint(5, 30))) + (" spamword buy!!!" if i % 4 == 0 else "")) for i in range(400)]
    labels = [(i, 0 if i % 4 == 0 else 1, 0, "x", "y") for i in range(0, 400)]
    model = quality.fit(docs_of(rows), spark.createDataFrame(labels, LABELS), "doc_id", "text", GOOD)
    good = spark.createDataFrame(labels, LABELS).select(F.col("doc_id").alias("k"), (F.col("quality") == 1).alias("good"))
    held = F.pmod(F.xxhash64("k", F.lit(1)), F.lit(5)) == 0
    target = {r.k for r in good.where("good").where(~held).collect()}
    raw_n, target_n = Counter(), Counter()
    for i, t in rows:
        raw_n.update(plain_features(t))
        target_n.update(plain_features(t) if i in target else ())
    share = len(target) / len(rows)

    def weight(f):
        expected, seen = raw_n[f] * share, target_n[f]
        fewer = expected - seen > quality.CHANCE * math.sqrt(expected * (1 - share) + 0.25)
        return min(math.log((seen + quality.PSEUDO) / (expected + quality.PSEUDO)), 0) if fewer else 0.0

    got = {r.key: (r.log_weight, r.place) for r in model.places.collect()}
    for i, t in rows:
        assert got[i][0] == pytest.approx(sum(map(weight, plain_features(t))), abs=1e-3)
        assert got[i][1] - got[i][0] == pytest.approx(quality.TEMPERATURE * quality._noise(np.array([i]), 0)[0], abs=1e-9)
    for k in (0, 7, 150, 320, 400, 500):
        drawn = sorted(r.key for r in model.draw(k).collect())
        assert drawn == sorted(sorted(got, key=lambda i: (-got[i][1], i))[:k])
    clean = {i for i, (w, _) in got.items() if w == 0}
    one = {r.key for r in model.draw(150).collect()}
    other = {r.key for r in quality.fit(
        docs_of(rows), spark.createDataFrame(labels, LABELS), "doc_id", "text", GOOD, seed=5).draw(150).collect()}
    assert len(clean) == 300 and one <= clean and one != other  # noise alone decides between equal weights
