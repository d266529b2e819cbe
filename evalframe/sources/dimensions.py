"""Small inputs written by hand: metric request files and task lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def request_rows(lines: DataFrame) -> DataFrame:
    """Grouped metric requests of files given as (file, line_no, text).

    `# Name` starts a group; lines before the first header are dropped. A request file is a short hand-written list.
    """
    text = F.trim("text")
    header = F.startswith(text, F.lit("#"))
    seen = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    name = F.trim(F.regexp_replace(text, "^[# ]+", ""))
    marked = lines.withColumn("group", F.last(F.when(header, name), ignorenulls=True).over(seen))
    return marked.where(F.col("group").isNotNull() & ~header & (text != "")).select(
        "file", "line_no", "group", text.alias("request"), F.substring_index(text, "/", 1).alias("display")
    )


def flat_requests(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Requests without groups: comment lines dropped, the first of equal requests kept. `ord` orders the lines."""
    text = F.trim("text")
    kept = lines.where((text != "") & ~F.startswith(text, F.lit("#"))).select(*by, text.alias("request"), "ord")
    return kept.groupBy(*by, "request").agg(F.min("ord").alias("ord"))


def task_names(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Task names only: inline comments stripped, the part before `/`, first occurrence kept."""
    task = F.trim(F.substring_index(F.substring_index("text", "#", 1), "/", 1))
    return lines.select(*by, task.alias("task"), "ord").where("task <> ''").groupBy(*by, "task").agg(F.min("ord").alias("ord"))


def include_exclude(requests: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Requests containing one of `include`, else those containing none of `exclude`, ignoring case."""
    lower = F.lower("request")
    hit = F.lit(False)
    for part in include or exclude:
        hit = hit | F.contains(lower, F.lit(part.lower()))
    if include:
        return requests.where(hit)
    return requests.where(~hit)


def read_lines(path: str) -> list[str]:
    """A hand-written file on the driver."""
    with open(path, encoding="utf-8") as handle:
        return handle.read().splitlines()


def parse_requests(lines: Sequence[str]) -> list[tuple[int, str, str, str]]:
    """The driver-side twin of `request_rows`: (ord, group, request, display), ready for `request_table`."""
    found, group = [], None
    for line in (raw.strip() for raw in lines):
        if line.startswith("#"):
            group = line.lstrip("# ").strip()
        elif line and group is not None:
            found.append((len(found), group, line, line.split("/")[0]))
    return found
