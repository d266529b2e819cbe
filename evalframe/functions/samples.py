"""Fields of one harness sample line as Columns.

`arguments` is MAP<STRING, STRUCT<arg_0, arg_1>>, `resps` and `filtered_resps` are ARRAY<ARRAY<STRING>>,
`scores` is MAP<STRING, STRING> holding the per-sample metric values.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from evalframe.functions.let import let


def extract_prompt(arguments: Column, doc: Column, input_: Column) -> Column:
    """The first generation argument, else the document, else the input."""
    first = F.try_element_at(arguments, F.lit("gen_args_0"))
    empty = arguments.isNull() | (F.cardinality(arguments) == 0)
    return F.when(empty, F.coalesce(doc, input_, F.lit(""))).otherwise(F.coalesce(first["arg_0"], F.lit("")))


def extract_choices(arguments: Column) -> Column:
    """The answer options in order, up to the first gap; NULL for a sample that is not multiple choice."""
    key = lambda i: F.concat(F.lit("gen_args_"), i.cast("string"))
    indices = F.sequence(F.lit(0), F.cardinality(arguments))  # one past the last possible index: the first gap always exists
    stop = F.array_min(F.filter(indices, lambda i: ~F.map_contains_key(arguments, key(i))))
    texts = let(stop, lambda n: F.transform(  # named, or every index would look for the gap again
        F.slice(indices, F.lit(1), n), lambda i: F.trim(F.try_element_at(arguments, key(i))["arg_1"])))
    options = F.filter(texts, lambda o: o.isNotNull())
    multiple = F.coalesce(F.map_contains_key(arguments, F.lit("gen_args_1")), F.lit(False))
    return F.when(multiple, let(options, lambda found: F.when(F.size(found) > 0, found)))


def extract_output(filtered: Column, responses: Column, choices: Column) -> Column:
    """The chosen option (first maximum of the option scores) or the first response."""
    filled = lambda c: F.when(F.size(c) > 0, c)

    def pick(source: Column) -> Column:
        scores = F.transform(source, lambda r: F.get(r, F.lit(0)).try_cast("double"))
        readable = lambda s: F.coalesce(F.forall(s, lambda x: x.isNotNull()), F.lit(False)) & (F.size(s) > 0)
        best = lambda s: F.when(readable(s), F.get(choices, (F.array_position(s, F.array_max(s)) - 1).cast("int")))
        first = F.coalesce(F.get(F.get(source, F.lit(0)), F.lit(0)), F.lit(""))
        return F.when(
            choices.isNotNull(), F.coalesce(let(scores, best), F.to_json(source), F.lit("[]"))
        ).otherwise(first)

    return let(F.coalesce(filled(filtered), filled(responses)), pick)


def score_key(result_key: Column) -> Column:
    """Name of the per-sample field behind an aggregate key: without filter, repeat-mean and pass@k suffix."""
    metric = F.split_part(result_key, F.lit(","), F.lit(1))
    repeated = F.contains(metric, F.lit("_mean_repeats"))  # most keys need no expression
    metric = F.when(repeated, F.regexp_replace(metric, r"_mean_repeats$", "")).otherwise(metric)
    return F.substring_index(metric, "_pass@", 1)


def sample_score(scores: Column, sample_filter: Column, result_keys: Column) -> Column:
    """struct(score, is_correct) of the first exported metric with a scalar value under the row's filter."""
    filter_name = F.coalesce(sample_filter, F.lit("none"))
    applies = lambda k: ~F.contains(k, F.lit(",")) | (F.substr(k, F.instr(k, ",") + 1) == filter_name)
    number = lambda text: F.when(text == "true", F.lit(1.0)).when(text == "false", F.lit(0.0)).otherwise(
        text.try_cast("double")
    )
    values = F.transform(F.filter(result_keys, applies), lambda k: let(F.try_element_at(scores, score_key(k)), number))
    usable = F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return let(F.get(usable, F.lit(0)), lambda first: F.when(
        first.isNotNull(), F.struct(first.alias("score"), (first == 1.0).alias("is_correct"))))


def required_tests(ran: Column, required: Column) -> Column:
    """(passed, required, failed) for a report that lists the tests that ran; a test that never ran failed.

    `ran` is ARRAY<STRUCT<name, status>>, `required` an ARRAY of names.
    """
    passed = F.transform(F.filter(ran, lambda t: t["status"] == "PASSED"), lambda t: t["name"])
    passed = F.coalesce(passed, F.array().cast("array<string>"))
    failed = F.filter(required, lambda t: ~F.array_contains(passed, t))
    return F.struct(
        (F.size(required) - F.size(failed)).alias("tests_passed"),
        F.size(required).alias("tests_required"),
        failed.alias("failed_tests"),
    )


def required_tests_by_group(groups: Column) -> Column:
    """The same for a report MAP<STRING, STRUCT<success ARRAY, failure ARRAY>>."""
    empty = F.array().cast("array<string>")
    failed = F.flatten(F.transform(F.map_values(groups), lambda g: F.coalesce(g["failure"], empty)))
    passed = F.size(F.flatten(F.transform(F.map_values(groups), lambda g: F.coalesce(g["success"], empty))))
    return F.struct(
        passed.alias("tests_passed"), (passed + F.size(failed)).alias("tests_required"), failed.alias("failed_tests")
    )


def clean_message(message: Column) -> Column:
    """A chat message MAP<STRING, STRING> without null fields; without tool calls it always has a content."""
    kept = F.map_filter(message, lambda k, v: v.isNotNull())
    calls = F.try_element_at(kept, F.lit("tool_calls"))
    plain = calls.isNull() | calls.isin("", "[]")
    bare = F.map_filter(kept, lambda k, v: k != "tool_calls")
    filled = F.when(F.map_contains_key(bare, F.lit("content")), bare).otherwise(
        F.map_concat(bare, F.create_map(F.lit("content"), F.lit("")))
    )
    return F.when(plain, filled).otherwise(kept)
