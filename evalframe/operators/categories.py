"""Category scores of a function-calling benchmark rolled up into its groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The categories each group needs. A group with a category missing is not reported.
GROUP_CATEGORIES = {
    "non_live": ["simple_python", "simple_java", "simple_javascript", "multiple", "parallel", "parallel_multiple",
                 "irrelevance"],
    "live": ["live_simple", "live_multiple", "live_parallel", "live_parallel_multiple", "live_irrelevance",
             "live_relevance"],
    "multi_turn": ["multi_turn_base", "multi_turn_miss_func", "multi_turn_miss_param", "multi_turn_long_context"],
    "agentic": ["memory_kv", "memory_vector", "memory_rec_sum", "web_search_base", "web_search_no_snippet"],
}
SEARCH_CATEGORIES = ["web_search_base", "web_search_no_snippet"]
OVERALL_GROUPS = ["non_live", "live", "multi_turn"]

# Weights of the overall score without web search.
OVERALL_WEIGHTS = {"non_live": 10, "live": 10, "irrelevance": 10, "multi_turn": 30, "memory": 40}


def complete_groups(categories: DataFrame) -> DataFrame:
    """(model, group) of the groups all of whose categories were run."""
    lookup = F.create_map(*[F.lit(x) for g, names in GROUP_CATEGORIES.items() for n in names for x in (n, g)])
    needed = F.create_map(*[F.lit(x) for g, names in GROUP_CATEGORIES.items() for x in (g, len(names))])
    return (
        categories.withColumn("group", F.try_element_at(lookup, F.col("category")))
        .where(F.col("group").isNotNull())
        .groupBy("model", "group").agg(F.count_distinct("category").alias("_n"))
        .where(F.col("_n") == F.element_at(needed, F.col("group")))
        .select("model", "group")
    )


def group_scores(categories: DataFrame, official: DataFrame) -> DataFrame:
    """Official group scores of complete groups, plus the overall mean of the three groups where all have a score."""
    groups = official.join(complete_groups(categories), ["model", "group"], "left_semi").select("model", "group", "score")
    main = F.col("group").isin(OVERALL_GROUPS)
    overall = (
        groups.where(main).groupBy("model")
        .agg(F.count("score").alias("_n"), F.avg("score").alias("score"))
        .where(F.col("_n") == len(OVERALL_GROUPS))
        .select("model", F.lit("overall").alias("group"), "score")
    )
    return groups.unionByName(overall)


def overall_without_search(categories: DataFrame) -> DataFrame:
    """The weighted overall score with the web search categories left out; only for models with every category."""
    needed = [c for names in GROUP_CATEGORIES.values() for c in names if c not in SEARCH_CATEGORIES]
    live = [c for c in GROUP_CATEGORIES["live"] if c not in ("live_irrelevance", "live_relevance")]
    accuracy = lambda name: F.max(F.when(F.col("category") == name, F.col("accuracy")))
    in_live = F.col("category").isin(live)
    wide = categories.where(F.col("category").isin(needed)).groupBy("model").agg(
        F.count_distinct("category").alias("_n"),
        *[accuracy(name).alias(f"c_{name}") for name in needed],
        (F.sum(F.when(in_live, F.col("accuracy") * F.col("total"))) / F.sum(F.when(in_live, F.col("total")))).alias("live"),
    ).where(F.col("_n") == len(needed))
    c = lambda name: F.col(f"c_{name}")
    simple = _mean(c("simple_python"), c("simple_java"), c("simple_javascript"))
    scored = wide.select(
        "model", "live",
        _mean(simple, c("multiple"), c("parallel"), c("parallel_multiple")).alias("non_live"),
        _mean(c("irrelevance"), c("live_irrelevance")).alias("irrelevance"),
        _mean(*[c(n) for n in GROUP_CATEGORIES["multi_turn"]]).alias("multi_turn"),
        _mean(c("memory_kv"), c("memory_vector"), c("memory_rec_sum")).alias("memory"),
    )
    total = sum((F.col(name) * weight for name, weight in OVERALL_WEIGHTS.items()), F.lit(0.0)) / 100
    return scored.withColumn("overall_no_web_search", total)


def category_metrics(
    categories: DataFrame, groups: DataFrame, without_search: DataFrame, errors: DataFrame | None = None
) -> DataFrame:
    """Metric rows of a run: groups and overall, the weighted scores not already present, categories and counts."""
    named = groups.where("score IS NOT NULL").select("model", F.col("group").alias("metric"), "score")
    names = [c for c in without_search.columns if c != "model"]
    weighted = without_search.select("model", F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).alias("score")) for n in names
    ])).alias("m")).select("model", "m.*").join(named, ["model", "metric"], "left_anti")
    rows = named.unionByName(weighted)
    rows = rows.unionByName(categories.select("model", F.col("category").alias("metric"), F.col("accuracy").alias("score")))
    rows = rows.unionByName(categories.groupBy("model").agg(F.sum("total").cast("double").alias("score")).select(
        "model", F.lit("n_samples").alias("metric"), "score"))
    if errors is not None:
        rows = rows.unionByName(errors.select("model", F.explode(F.array(
            F.struct(F.lit("n_inference_errors").alias("metric"), F.col("n_errors").cast("double").alias("score")),
            F.struct(F.lit("n_context_overflows").alias("metric"), F.col("n_context_overflow").cast("double").alias("score")),
        )).alias("m")).select("model", "m.*"))
    return rows


def inference_error_counts(entries: DataFrame, by=("model",)) -> DataFrame:
    """Entries, errors and errors by cause; lines that could not be parsed are not entries."""
    cause = F.col("cause")
    return entries.where("parsed").groupBy(*by).agg(
        F.count("*").alias("n_entries"), F.count(cause).alias("n_errors"),
        F.count_if(cause == "context_overflow").alias("n_context_overflow"),
        F.count_if(cause == "other").alias("n_other"),
    )


def weighted_group_score(scores: DataFrame, by=("model",)) -> DataFrame:
    """Sample-size-weighted mean of the tasks of a group; unknown labels were dropped before."""
    return scores.groupBy(*by).agg((F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("score"), F.sum("n").alias("n"))


def _mean(*values: Column) -> Column:
    return sum(values[1:], values[0]) / len(values)
