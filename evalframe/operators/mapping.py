"""Tasks mapped to canonical names, hierarchies and headline metrics."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evalframe.functions import ids, scores
from evalframe.operators.merge import task_prefixes
from evalframe.operators.scale import heavy_join, literal_rows
from evalframe.session import cut_lineage

# Task-name endings with a meaning.
SELF_CONSISTENCY = "_self_consistency"
GENERATED_SUFFIX = "_gen_0shot"


@dataclass(frozen=True)
class TaskMapping:
    """One reviewed mapping: canonical names and, for benchmarks with subtasks, the rule that finds them."""

    task: str
    benchmark: str
    family: str = ""
    composite: str = ""
    split: str = "overall"
    collection: str = ""
    pattern: str | None = None
    split_template: str = "{split}"
    configless_is_overall: bool = False


def map_tasks(tasks: DataFrame, mappings: Sequence[TaskMapping]) -> DataFrame:
    """Adds root, alias and split to tasks(task, has_config): exact, self-consistency variant, first matching rule.

    `root` is the mapping used and NULL for an unmapped task.
    """
    names = F.array(*[F.lit(m.task) for m in mappings]) if mappings else F.array().cast("array<string>")
    task = F.col("task")
    base = F.regexp_replace(task, SELF_CONSISTENCY + r"\z", "")
    exact = F.when(F.array_contains(names, task), task)
    variant = F.when(F.endswith(task, F.lit(SELF_CONSISTENCY)) & F.array_contains(names, base), base)
    hits = []
    for m in mappings:
        if m.pattern:
            fits = task.rlike(f"^(?:{_java(m.pattern)})\\z")
            hits.append(F.when(fits, F.struct(F.lit(m.task).alias("root"), _split(m).alias("split"))))
    rule = F.coalesce(*hits) if hits else F.lit(None).cast("struct<root:string,split:string>")
    own_split = F.create_map(*[F.lit(x) for m in mappings for x in (m.task, m.split)])
    direct = F.coalesce(exact, variant)
    return tasks.withColumn("_rule", F.when(direct.isNull(), rule)).select(
        *tasks.columns,
        F.coalesce(direct, F.col("_rule.root")).alias("root"),
        F.when(exact.isNotNull() | F.col("_rule").isNotNull(), task).otherwise(variant).alias("alias"),
        F.coalesce(F.try_element_at(own_split, direct), F.col("_rule.split")).alias("split"),
    )


def mapping_table(spark: SparkSession, mappings: Sequence[TaskMapping]) -> DataFrame:
    """The mappings as a table keyed by `root`."""
    fields = ["root", "benchmark", "family", "composite", "collection"]
    rows = [(m.task, m.benchmark, m.family, m.composite, m.collection or m.benchmark) for m in mappings]
    return spark.range(1).select(F.explode(literal_rows(rows, [(f, "string") for f in fields])).alias("m")).select("m.*")


def internal_parents(tasks: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """benchmark and split of unmapped tasks from the scored tasks themselves.

    `tasks` has task, has_config and is_group for every scored task. The parent is the shortest scored task that is a
    group or has no config and that the task continues after `_`. All prefixes of a task are candidates, so an
    equi-join on them replaces comparing every pair of names.
    """
    prefixes = tasks.select(*by, "task", F.explode(task_prefixes(F.col("task"), "_")).alias("prefix")).where(
        "prefix <> task"
    )
    parents = tasks.where("is_group OR NOT has_config").select(*by, F.col("task").alias("prefix"))
    found = prefixes.join(parents, [*by, "prefix"]).groupBy(*by, "task").agg(
        F.min_by("prefix", F.length("prefix")).alias("parent")
    )
    continued = prefixes.select(*by, F.col("prefix").alias("task"), F.lit(True).alias("_has_child")).distinct()
    rest = F.expr("substring(task, length(parent) + 2)")
    split = F.when(F.col("parent").isNull(), "overall").when(F.col("_has_child"), F.concat(rest, F.lit("_overall"))).otherwise(rest)
    return (
        tasks.join(found, [*by, "task"], "left").join(continued, [*by, "task"], "left")
        .select(*tasks.columns, F.coalesce("parent", "task").alias("benchmark"), split.alias("split"))
    )


def safe_task_name(task: Column) -> Column:
    """Names that may serve as a benchmark identifier without a mapping."""
    return (task != "") & (task == F.trim(task)) & ~task.rlike(r"[./\\\x00]")


def group_descendants(edges: DataFrame, roots: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(root, task): everything below each root in edges(parent, child), within `by`; cycles are tolerated.

    A round takes the pairs of a root and a task that the round before found one step further, so each pair goes on once.
    Hierarchies are rarely deep: only what is not done after FIRST_ROUNDS gets steps of 2, 4, 8 and more edges, one more each
    round, and the number of rounds grows with the logarithm of the depth. Steps go through a task only if it joins few
    pairs (MOST_PAIRS for each edge of it): a task of many parents and many children would make pairs without end, and
    is passed by the edges. Every round is a table in the shared folder, and a task that many roots reach is split.
    """
    by = list(by)
    edges = cut_lineage(edges.select(*by, "parent", "child").distinct(), "edges")
    last, steps, doubling = edges, edges, True
    starts = roots.select(*by, F.col("task").alias("root")).distinct()
    new, below, rounds, size = starts.withColumn("task", F.col("root")), None, 0, None
    while True:
        if rounds >= FIRST_ROUNDS and doubling:
            size = size or edges.count()
            longer = cut_lineage(_doubled(last, by).join(steps, [*by, "parent", "child"], "left_anti"), "steps")
            count = longer.count()
            doubling = 0 < count <= MOST_PAIRS * size
            if doubling:
                last, steps = longer, steps.unionByName(longer)
                new = below  # what is known may take the longer steps too
        further = heavy_join(
            new.withColumnRenamed("task", "parent"), steps, [*by, "parent"]).select(*by, "root", F.col("child").alias("task")).distinct()
        new = cut_lineage(further if below is None else further.join(below, [*by, "root", "task"], "left_anti"), "reached")
        if new.isEmpty():
            return below if below is not None else new
        below, rounds = new if below is None else below.unionByName(new), rounds + 1


def _doubled(steps: DataFrame, by: list[str]) -> DataFrame:
    """Pairs that are two steps apart, by the tasks that join few."""
    heads = steps.groupBy(*by, F.col("parent").alias("_node")).agg(F.count("*").alias("_out"))
    tails = steps.groupBy(*by, F.col("child").alias("_node")).agg(F.count("*").alias("_in"))
    few = heads.join(tails, [*by, "_node"]).where(
        F.col("_in") * F.col("_out") <= MOST_PAIRS * (F.col("_in") + F.col("_out"))).select(*by, "_node")
    first = steps.withColumnRenamed("child", "_node").join(few, [*by, "_node"], "left_semi")
    return heavy_join(first, steps.withColumnRenamed("parent", "_node"), [*by, "_node"]).where("parent <> child").select(
        *by, "parent", "child").distinct()


# Rounds by single edges, and pairs that a longer step may make for each edge.
FIRST_ROUNDS, MOST_PAIRS = 8, 4


def select_aggregates(
    results: DataFrame, groups: DataFrame, selectors: DataFrame, by: Sequence[str] = ("model",)
) -> DataFrame:
    """(by, selector, aggregate, task, similar, error): the tasks below the aggregate that each selector names.

    `results` has the scored tasks, `groups` parent and child of the logged group metadata. A selector names a scored task, or
    the stem of one with the generated suffix. Below it is what the metadata lists under the selector or the aggregate, at
    any depth; without such metadata, the scored tasks that continue the aggregate's stem. A selector that names nothing
    (`similar` then has the scored tasks that continue it) or has nothing below gives one row with `error` instead of a task.

    Every selector of a group has a row for each task below, so the result can grow with the square of a group. These rows
    are made by the last join, and neither shuffled nor written here: what is below a group is found once, and a group
    whose only child is `c` shares what is below `c`.
    """
    by = list(by)
    scored = cut_lineage(results.select(*by, "task").distinct(), "scored")
    wanted = selectors.select(*by, "selector").distinct()
    names = F.array("selector", F.concat("selector", F.lit(GENERATED_SUFFIX)))  # the exact name counts first
    found = wanted.select(*by, "selector", F.posexplode(names).alias("_rank", "aggregate")).join(
        scored.withColumnRenamed("task", "aggregate"), [*by, "aggregate"], "left_semi").groupBy(*by, "selector").agg(
        F.min_by("aggregate", "_rank").alias("aggregate"))
    single = (F.count("child") == F.count("*")) & (F.min("child") == F.max("child"))
    owned = groups.groupBy(*by, F.col("parent").alias("_name")).agg(F.when(single, F.min("child")).alias("_only"))
    mark = lambda name, column: owned.select(*by, F.col("_name").alias(column), F.struct("_name", "_only").alias(name))
    grouped = cut_lineage(
        found.join(mark("_own", "selector"), [*by, "selector"], "left").join(mark("_of", "aggregate"), [*by, "aggregate"], "left")
        .select(*by, "selector", "aggregate", F.coalesce("_own", "_of").alias("_group")), "aggregates")
    listed = grouped.where("_group IS NOT NULL").select(
        *by, "selector", "aggregate", F.coalesce("_group._only", "_group._name").alias("root"), "_group._only")
    closure = group_descendants(groups, listed.select(*by, F.col("root").alias("task")), by)
    closure = closure.where("task IS NOT NULL").unionByName(closure.where("task IS NULL").distinct())
    by_group = heavy_join(closure, listed.drop("_only"), [*by, "root"], spread=["task"]).select(*by, "selector", "aggregate", "task")
    only = listed.where("_only IS NOT NULL").join(closure.where("root = task").select(*by, "root"), [*by, "root"], "left_anti").select(
        *by, "selector", "aggregate", F.col("_only").alias("task"))
    stems = scored.select(*by, "task", F.explode(F.filter(
        task_prefixes(F.col("task"), "_"), lambda p: p != F.col("task"))).alias("_stem"))
    named = grouped.where("_group IS NULL").select(
        *by, "selector", "aggregate", F.regexp_replace("aggregate", GENERATED_SUFFIX + "$", "").alias("_stem"))
    below = named.join(stems, [*by, "_stem"]).where("task <> aggregate").select(*by, "selector", "aggregate", "task")
    empty = named.join(below, [*by, "selector"], "left_anti").select(
        *by, "selector", "aggregate", F.lit("no task below the aggregate").alias("error"))
    unknown = cut_lineage(wanted.join(grouped, [*by, "selector"], "left_anti"), "unknown")
    similar = stems.withColumnRenamed("_stem", "selector").join(unknown, [*by, "selector"], "left_semi").groupBy(
        *by, "selector").agg(F.array_sort(F.collect_set("task")).alias("similar"))
    unknown = unknown.join(similar, [*by, "selector"], "left").withColumn("error", F.lit("no scored aggregate of that name"))
    return by_group.unionByName(only).unionByName(below).unionByName(empty, allowMissingColumns=True).unionByName(
        unknown, allowMissingColumns=True).select(*by, "selector", "aggregate", "task", "similar", "error")


def prefix_descendants(tasks: DataFrame, aggregate: str) -> DataFrame:
    """Scored tasks below an aggregate without group metadata, by name."""
    prefix = f"{aggregate.removesuffix(GENERATED_SUFFIX)}_"
    return tasks.where((F.col("task") != aggregate) & F.startswith("task", F.lit(prefix)))


def exclusion_set(excluded: DataFrame, descendants: DataFrame, aggregates: DataFrame) -> DataFrame:
    """Excluded tasks and all descendants, without the aggregates themselves."""
    return (
        excluded.select("task").unionByName(descendants.select("task")).distinct()
        .exceptAll(aggregates.select("task").distinct())
    )


def expand_candidates(candidates: DataFrame) -> DataFrame:
    """Candidate keys as they are logged: repeat count filled in, repeat suffix added under a repeat policy.

    `candidates` has task, pos, candidate, repeats (INT), repeat_scoring (BOOLEAN), keeps_mean (BOOLEAN) and
    repeat_filter (STRING).
    """
    key = F.col("candidate")
    base = F.substring_index(key, ",", 1)
    derived = F.contains(base, F.lit("_mean_repeats")) | F.contains(base, F.lit("_pass@"))
    filter_part = F.coalesce(
        F.concat(F.lit(","), F.col("repeat_filter")),
        F.when(F.contains(key, F.lit(",")), F.concat(F.lit(","), F.regexp_replace(key, "^[^,]*,", ""))), F.lit(""),
    )
    repeated = F.concat(base, F.when(derived, "").otherwise("_mean_repeats"), filter_part)
    policy = F.coalesce("repeat_scoring", F.lit(False))
    usable = ~policy | derived | F.coalesce("keeps_mean", F.lit(True))
    chosen = F.when(policy, repeated).otherwise(key)
    filled = F.when(F.col("repeats") > 0, F.replace(chosen, F.lit("{repeats}"), F.col("repeats").cast("string")))
    return candidates.where(usable).withColumn("candidate", F.coalesce(filled, chosen))


def select_headline(metrics: DataFrame, candidates: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Per task the first candidate it logged; a task without any keeps all its metrics except derived pass@k."""
    hits = heavy_join(
        metrics, candidates.select("task", F.col("candidate").alias("key"), "pos"), ["task", "key"]
    ).groupBy(*by, "task").agg(F.min_by(F.struct("key", "score"), "pos").alias("_m"))
    chosen = hits.select(*by, "task", "_m.key", "_m.score")
    rest = metrics.where(~F.contains("key", F.lit("_pass@"))).join(hits, [*by, "task"], "left_anti")
    return chosen.unionByName(rest.select(*by, "task", "key", "score"))


def metric_mismatch(metrics: DataFrame, candidates: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Scored tasks that have candidates but logged none of them."""
    wanted = candidates.groupBy("task").agg(F.collect_set("candidate").alias("_wanted"))  # a reviewed, short list
    present = F.max(F.array_contains("_wanted", F.col("key")))
    return heavy_join(metrics, wanted, ["task"]).groupBy(*by, "task").agg(present.alias("_any")).where("NOT _any").select(
        *by, "task")


def scoped_hashes(hashes: DataFrame, record_tasks: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Task hashes of a record's tasks and of the groups whose name they continue."""
    scope = record_tasks.select(*by, F.explode(task_prefixes(F.col("task"), "_")).alias("task")).distinct()
    return hashes.join(scope, [*by, "task"], "left_semi")


def source_data(tasks: DataFrame, configs: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Adds dataset_id and source_type; a task without a dataset takes the single one of the tasks continuing its name.

    `tasks` has task, benchmark and dataset (nullable), `configs` has task and dataset.
    """
    owned = configs.where(ids.is_repo_id(F.col("dataset")))
    below = owned.select(
        *by, "dataset", F.explode(F.filter(task_prefixes(F.col("task"), "_"), lambda p: p != F.col("task"))).alias("task")
    )
    single = below.groupBy(*by, "task").agg(
        F.min("dataset").alias("_low"), F.max("dataset").alias("_high")
    ).where("_low = _high").select(*by, "task", F.col("_low").alias("_shared"))
    dataset = F.coalesce("dataset", "_shared")
    hosted = ids.is_repo_id(dataset)
    return tasks.join(single, [*by, "task"], "left").select(
        *tasks.columns, dataset.alias("dataset_id"), F.coalesce(dataset, F.col("benchmark")).alias("dataset_name"),
        F.when(hosted, "hf_dataset").otherwise("other").alias("source_type"),
    )


def uncertainty(metrics: DataFrame, by: Sequence[str] = ("model", "task")) -> DataFrame:
    """Scores beside their standard errors: `metric_stderr,filter` belongs to `metric,filter`."""
    base = scores.metric_of(F.col("key"))
    filter_name = scores.filter_of(F.col("key"))
    is_error = F.endswith(base, F.lit("_stderr")) & F.contains(F.col("key"), F.lit(","))
    return (
        metrics.withColumn("_error", is_error)
        .withColumn("metric", F.when(is_error, F.regexp_replace(base, "_stderr$", "")).otherwise(base))
        .withColumn("filter", filter_name)
        .groupBy(*by, "metric", "filter")
        .agg(F.max(F.when(~F.col("_error"), F.col("score"))).alias("score"),
             F.max(F.when(F.col("_error"), F.col("score"))).alias("standard_error"))
        .where("score IS NOT NULL")
    )


def _java(pattern: str) -> str:
    return pattern.replace("(?P<", "(?<")


def _split(mapping: TaskMapping) -> Column:
    """The split named by a rule's template, cleaned up."""
    groups = re.compile(mapping.pattern).groupindex
    parts = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", mapping.split_template)):
        if i % 2 and piece not in groups:
            raise ValueError(f"{mapping.task}: no capture named {piece}")
        parts.append(F.regexp_extract("task", f"^(?:{_java(mapping.pattern)})\\z", groups[piece]) if i % 2 else F.lit(piece))
    text = F.regexp_replace(F.regexp_replace(F.trim(F.concat(*parts)), r"\s+", "_"), "_+", "_")
    text = F.coalesce(F.nullif(F.regexp_replace(text, "^_|_$", ""), F.lit("")), F.lit("overall"))
    if mapping.configless_is_overall:
        text = F.when((text != "overall") & ~F.col("has_config"), F.concat(text, F.lit("_overall"))).otherwise(text)
    return text
