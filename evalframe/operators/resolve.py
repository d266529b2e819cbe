"""Requested metrics looked up in what each model logged.

A summary has the columns model, key (`task/metric[,filter]`) and score; an optional `ord` gives the source order.
Protocols list the tasks scored over repeated attempts: model, task, repeats, per_task_repeats MAP<STRING,INT>,
metric_tasks MAP<STRING,ARRAY<STRING>>, sampling_enabled.
"""

from __future__ import annotations

from collections.abc import Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evalframe.operators.scale import heavy_join, literal_rows
from evalframe.session import cut_lineage

MEAN_SUFFIX = "_mean_repeats"
PASS_MARK = "_pass@"

# How a key answers a request, best first.
_MEAN, _MEAN_FILTERED, _MULTILINGUAL, _EXACT, _FUZZY = range(1, 6)


def tie_break(task: Column, key: Column, order: Column) -> Column:
    """Sort value for keys that match equally well: on gsm8k strict-match first, then the shortest, then source order."""
    loose = F.contains(F.lower(task), F.lit("gsm8k")) & ~F.contains(key, F.lit("strict-match"))
    return F.struct(loose.alias("loose"), F.length(key).alias("length"), order.alias("ord"))


def first_key(matches: DataFrame, by: Sequence[str], task: str = "task", key: str = "key", order: str = "ord") -> DataFrame:
    """The preferred key per group of equally good matches."""
    return matches.groupBy(*by).agg(F.min_by(key, tie_break(F.col(task), F.col(key), F.col(order))).alias("key"))


def resolve_metrics(
    summary: DataFrame, requests: Sequence[str] | DataFrame, protocols: DataFrame | None = None, fuzzy: bool = True
) -> DataFrame:
    """(model, request, key, score) for every request a model can answer. `requests` may be a table with `request`.

    In order: the repeat mean (only for tasks with a protocol), the multilingual mean, the exact key, and with
    `fuzzy` a key containing task, metric and filter. Requests are matched once with every different key: exact ones by
    equi-joins, fuzzy ones by the tasks that an automaton over all of them finds in one pass over the key. Rows then only
    meet the requests that their key matches, and one partially aggregated group-by picks the winner.
    """
    asked = request_table(summary.sparkSession, requests)
    rows = _with_protocol(summary, protocols)
    keys = cut_lineage(rows.select("key").distinct(), "keys")
    matches = _mean_matches(keys, asked)
    plain = asked.where("NOT multilingual")
    matches = matches.unionByName(
        keys.join(plain.withColumn("key", F.col("request")), "key").select("key", "request", "task", F.lit(_EXACT).alias("tier")))
    if fuzzy:
        matches = matches.unionByName(_fuzzy_matches(keys, plain))
    best_match = matches.groupBy("key", "request", "task").agg(
        F.min(F.when(F.col("tier") <= _MEAN_FILTERED, F.col("tier"))).alias("_mean_tier"),
        F.min(F.when(F.col("tier") > _MEAN_FILTERED, F.col("tier"))).alias("_tier"))
    tier = F.coalesce(F.when(F.col("_repeated"), F.col("_mean_tier")), F.col("_tier"))
    matched = heavy_join(rows, best_match.withColumnRenamed("task", "_asked"), ["key"]).withColumn("tier", tier).where("tier IS NOT NULL")
    rank = F.struct(F.col("tier"), tie_break(F.col("_asked"), F.col("key"), F.col("ord")).alias("tie"))
    best = matched.groupBy("model", "request").agg(
        F.min("tier").alias("_tier"), F.min_by(F.struct("key", "score"), rank).alias("_best")
    ).select("model", "request", "_tier", "_best.key", "_best.score")
    # a mean over the keys of a model, the same for all requests that ask for it
    means = _multilingual_rows(rows).groupBy("model").agg(F.avg("score").alias("score")).crossJoin(
        asked.where("multilingual").select("request")).select(
        "model", "request", F.lit(_MULTILINGUAL).alias("_tier"), F.lit(None).cast("string").alias("key"), "score")
    return best.unionByName(means).groupBy("model", "request").agg(
        F.min_by(F.struct("key", "score"), "_tier").alias("_best")).select("model", "request", "_best.key", "_best.score")


def request_table(spark: SparkSession, requests: Sequence[str] | DataFrame) -> DataFrame:
    """Requests (`task/metric[,filter]`) and their parts; missing parts are NULL."""
    if not isinstance(requests, DataFrame):
        listed = literal_rows([(r,) for r in dict.fromkeys(requests)], [("request", "string")])
        requests = spark.range(1).select(F.explode(listed).alias("r")).select("r.request")
    request = F.col("request")
    slash = F.contains(request, F.lit("/"))
    name = F.when(slash, F.regexp_replace(request, "^[^/]*/", "")).otherwise("")
    metric = F.substring_index(name, ",", 1)
    comma = F.contains(name, F.lit(","))
    filter_name = F.when(comma, F.regexp_replace(name, "^[^,]*,", "")).otherwise("")
    task = F.substring_index(request, "/", 1)
    mean = F.concat(task, F.lit("/"), metric, F.lit(MEAN_SUFFIX), F.when(comma, F.concat(F.lit(","), filter_name)).otherwise(""))
    derived = F.contains(name, F.lit(MEAN_SUFFIX)) | F.contains(name, F.lit(PASS_MARK))
    return requests.select("request").distinct().select(
        "request", task.alias("task"), F.nullif(metric, F.lit("")).alias("metric"), F.nullif(filter_name, F.lit("")).alias("filter"),
        F.when(slash & ~derived, mean).alias("mean_key"), F.contains(request, F.lit(PASS_MARK)).alias("wants_pass"),
        ((metric == "exact_match") & F.contains(F.lower(task), F.lit("mgsm")) & ~F.contains(F.lower(task), F.lit("mgsm_en"))).alias("multilingual"))


def _mean_matches(keys: DataFrame, asked: DataFrame) -> DataFrame:
    """Keys that are the repeat mean of a request, with its own filter or any if it asks for none."""
    wanted = asked.where("mean_key IS NOT NULL")
    same = keys.join(wanted, keys["key"] == wanted["mean_key"]).select("key", "request", "task", F.lit(_MEAN).alias("tier"))
    base = keys.where(F.contains("key", F.lit(","))).withColumn("_base", F.substring_index("key", ",", 1))
    any_filter = wanted.where("filter IS NULL").select(F.col("mean_key").alias("_base"), "request", "task")
    return same.unionByName(base.join(any_filter, "_base").select("key", "request", "task", F.lit(_MEAN_FILTERED).alias("tier")))


def _fuzzy_matches(keys: DataFrame, asked: DataFrame) -> DataFrame:
    """Keys that contain task, metric and filter of a request, whatever the case."""
    lower = F.lower("key")
    named = asked.withColumn("_task", F.lower("task"))
    usable = keys.where(~F.contains("key", F.lit("stderr")))
    hits = substrings(usable.select("key", lower.alias("text")), named.select(F.col("_task").alias("pattern")))
    holds = lambda part: F.col(part).isNull() | F.contains(lower, F.lower(part))
    return hits.withColumnRenamed("pattern", "_task").join(named, "_task").where(
        (~F.contains("key", F.lit(PASS_MARK)) | F.col("wants_pass")) & holds("metric") & holds("filter")
    ).select("key", "request", "task", F.lit(_FUZZY).alias("tier"))


# Patterns in one automaton.
AUTOMATON = 50_000


def substrings(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(key, pattern): every pattern that the `text` of a key contains, an empty pattern always.

    The patterns are cut into blocks; an automaton over a block finds all of them in one pass over each text.
    """
    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    patterns = patterns.select("pattern").where("pattern IS NOT NULL").distinct()
    blocks = patterns.agg(F.ceil(F.count("*") / AUTOMATON).cast("int").alias("_blocks"))
    left = texts.crossJoin(F.broadcast(blocks)).select(  # one row
        "key", "text", F.explode(F.sequence(F.lit(0), F.greatest("_blocks", F.lit(1)) - 1)).alias("block"),
        F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part"))
    right = patterns.crossJoin(F.broadcast(blocks)).select(
        "pattern", F.pmod(F.xxhash64("pattern"), F.col("_blocks")).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(
        _contained, "key string, pattern string")


def _contained(texts: pd.DataFrame, patterns: pd.DataFrame) -> pd.DataFrame:
    automaton = ahocorasick.Automaton()
    for pattern in patterns["pattern"]:
        if pattern:
            automaton.add_word(pattern, pattern)
    always = {""} & set(patterns["pattern"])
    found = []
    if len(automaton):
        automaton.make_automaton()
    for key, text in zip(texts["key"], texts["text"]):
        held = {word for _, word in automaton.iter(text)} if len(automaton) else set()
        found += [(key, word) for word in held | always]
    return pd.DataFrame(found, columns=["key", "pattern"])


def _multilingual_rows(rows: DataFrame) -> DataFrame:
    """Keys of the multilingual task that end in the metric, in its repeat mean where the task has a protocol."""
    key = F.col("key")
    end = F.when(F.col("_repeated"), F.lit("exact_match" + MEAN_SUFFIX)).otherwise("exact_match")
    return rows.where(F.contains(key, F.lit("mgsm")) & F.endswith(key, end) & ~F.contains(key, F.lit("stderr")))


def repeat_mean_keys(summary: DataFrame, requests: Sequence[str] | DataFrame, protocols: DataFrame) -> DataFrame:
    """(model, request, key): the repeat mean that stands in for a request, where the task has a protocol."""
    rows = _with_protocol(summary, protocols).where("_repeated")
    keys = cut_lineage(rows.select("key").distinct(), "keys")
    matches = _mean_matches(keys, request_table(summary.sparkSession, requests)).withColumnRenamed("task", "_asked")
    rank = F.struct("tier", tie_break(F.col("_asked"), F.col("key"), F.col("ord")).alias("tie"))
    return heavy_join(rows, matches, ["key"]).groupBy("model", "request").agg(F.min_by("key", rank).alias("key"))


def repeat_labels(summary: DataFrame, requests: Sequence[str] | DataFrame, protocols: DataFrame) -> DataFrame:
    """(model, request, label): `mean@m` or `pass@k (m=m)`, with ` (greedy)` when no contributor was sampled."""
    named = request_table(summary.sparkSession, requests).select("request", "task")
    asked = heavy_join(protocols.select("model", "task", "repeats", "per_task_repeats", "metric_tasks"), named, ["task"])
    asked = asked.join(
        repeat_mean_keys(summary, requests, protocols).withColumnRenamed("key", "mean"), ["model", "request"], "left"
    )
    wanted = F.regexp_replace(F.coalesce("mean", "request"), "^[^/]*/", "")
    prefixed = F.filter(F.map_keys("metric_tasks"), lambda k: F.startswith(k, F.concat(F.col("_wanted"), F.lit(","))))
    ranked = F.array_sort(F.transform(prefixed, lambda k: F.struct(
        tie_break(F.col("task"), k, F.lit(0)).alias("tie"), k.alias("k"))))
    named = asked.withColumn("_wanted", wanted).withColumn(
        "_key", F.when(F.contains("_wanted", F.lit(",")), F.col("_wanted")).otherwise(
            F.coalesce(F.get(ranked, F.lit(0))["k"], F.col("_wanted")))
    )
    tasks = F.coalesce(F.try_element_at("metric_tasks", F.col("_key")), F.array().cast("array<string>"))
    counted = named.withColumn("_tasks", tasks).withColumn(
        "_counts", F.array_sort(F.array_distinct(F.transform("_tasks", lambda t: F.try_element_at("per_task_repeats", t))))
    )
    m = (
        F.when(F.size("_counts") == 0, F.col("repeats").cast("string"))
        .when(F.size("_counts") == 1, F.element_at("_counts", 1).cast("string"))
        .otherwise(F.concat(F.lit("["), F.array_join(F.col("_counts").cast("array<string>"), ", "), F.lit("]")))
    )
    passes = F.regexp_extract("request", r"_pass@([^,]*)", 1)
    base = (
        F.when(F.contains("request", F.lit(PASS_MARK)), F.concat(F.lit("pass@"), passes, F.lit(" (m="), m, F.lit(")")))
        .when(F.col("mean").isNotNull() | F.contains("request", F.lit(MEAN_SUFFIX)), F.concat(F.lit("mean@"), m))
    )
    labelled = counted.withColumn("_base", base).where(F.col("_base").isNotNull())
    members = labelled.select(
        "model", "request", "_base",
        F.explode(F.when(F.size("_tasks") > 0, F.col("_tasks")).otherwise(F.array("task"))).alias("task"),
    )
    modes = protocols.select("model", "task", "sampling_enabled")
    greedy = F.min(F.coalesce(~F.col("sampling_enabled"), F.lit(False)))
    return (
        members.join(modes, ["model", "task"], "left")
        .groupBy("model", "request", "_base").agg(greedy.alias("_greedy"))
        .select("model", "request", F.when(F.col("_greedy"), F.concat("_base", F.lit(" (greedy)"))).otherwise(
            F.col("_base")).alias("label"))
    )


def multilingual_mean(summary: DataFrame, protocols: DataFrame | None = None) -> DataFrame:
    """(model, score): mean over the keys of the multilingual task that end in the metric, repeat means where repeated."""
    rows = _multilingual_rows(_with_protocol(summary, protocols))
    return rows.groupBy("model").agg(F.avg("score").alias("score"), F.count("score").alias("n_keys"))


def _with_protocol(summary: DataFrame, protocols: DataFrame | None) -> DataFrame:
    rows = summary if "ord" in summary.columns else summary.withColumn("ord", F.col("key"))
    rows = rows.withColumn("_task", F.substring_index("key", "/", 1))
    if protocols is None:
        return rows.withColumn("_repeated", F.lit(False))
    known = protocols.select("model", F.col("task").alias("_task"), F.lit(True).alias("_known"))
    return rows.join(known, ["model", "_task"], "left").withColumn(  # few keys of a task per model, so none is hot
        "_repeated", F.coalesce("_known", F.lit(False))
    )
