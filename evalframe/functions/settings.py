"""Model arguments and generation settings as Columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from evalframe.functions.let import let

# Names under which the token limit of a generation may be logged, in order of preference.
MAX_TOKEN_KEYS = ["max_gen_toks", "max_new_tokens", "max_tokens"]

# Output types that generate text.
GENERATIVE_TYPES = ["generate_until", "generate"]


def parse_args(text: Column) -> Column:
    """`k=v,k2=v2` as MAP<STRING, STRING>; a part without `=` belongs to the value before it, the last key wins."""
    entries = F.filter(F.split(text, ",(?=[^,=]*=)"), lambda e: F.contains(e, F.lit("=")))
    value = lambda e: F.regexp_replace(F.regexp_replace(e, "(?s)^[^=]*=", ""), r"(?s)^\s*([^,]*?)\s*(,.*)?$", "$1$2")
    pairs = F.transform(entries, lambda e: F.struct(
        F.trim(F.substring_index(e, "=", 1)).alias("key"), value(e).alias("value")))
    last = lambda rows: F.filter(rows, lambda r, i: ~F.exists(
        F.slice(rows, i + 2, F.size(rows)), lambda later: later["key"] == r["key"]))
    return F.map_from_entries(let(pairs, last))


def literal_type(text: Column) -> Column:
    """int, float, bool, none or str: how a settings value reads as a literal."""
    return (
        F.when(text.rlike(r"^[+-]?\d+$"), "int")
        .when(text.rlike(r"^[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?$"), "float")
        .when(text.isin("True", "False"), "bool")
        .when(text == "None", "none")
        .otherwise("str")
    )


def number_of(text: Column) -> Column:
    return F.when(literal_type(text).isin("int", "float"), text.try_cast("double"))


def overlay(base: Column, top: Column) -> Column:
    """Two maps as one, `top` winning."""
    none = F.expr("cast(map() as map<string,string>)")
    return let(F.coalesce(top, none), lambda t: F.map_concat(
        F.map_filter(F.coalesce(base, none), lambda k, v: ~F.map_contains_key(t, k)), t))


def generation_config(run_settings: Column, task_settings: Column) -> Column:
    """temperature, top_p, top_k and max_tokens from run settings overlaid by task settings."""
    def read(merged: Column) -> Column:
        value = lambda key: F.try_element_at(merged, F.lit(key))
        greedy = value("do_sample").isin("False", "false")
        limit = F.coalesce(*[value(k) for k in MAX_TOKEN_KEYS])
        tokens = F.when(literal_type(limit) == "int", limit.try_cast("long"))
        return F.struct(
            F.coalesce(number_of(value("temperature")), F.when(greedy, F.lit(0.0))).alias("temperature"),
            number_of(value("top_p")).alias("top_p"),
            number_of(value("top_k")).alias("top_k"),
            F.when(tokens > 0, tokens).alias("max_tokens"),
        )

    return let(overlay(run_settings, task_settings), read)


def generation_warnings(task: Column, output_type: Column, config: Column) -> Column:
    """What a generative task should have logged and did not."""
    generative = output_type.isin(GENERATIVE_TYPES)
    notes = F.array(
        F.when(generative & config["temperature"].isNull(),
               F.concat(task, F.lit(": generation temperature is not logged"))),
        F.when(generative & config["max_tokens"].isNull(),
               F.concat(task, F.lit(": maximum generation tokens are not logged"))),
    )
    return F.filter(notes, lambda n: n.isNotNull())
