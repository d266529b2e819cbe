"""Written results. Every sink is a distributed write; a directory stands where a single file would need one task."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from evalframe.operators import export
from evalframe.session import cut_lineage
from evalframe.sources.files import opened

EXPORT_KEYS = ("collection", "developer", "model", "uuid")

# How Spark names the directories of partitioned tables.
_ESCAPED, _NO_VALUE = r"""[\x00-\x1f"#%'*/:=?\\\x7f{\[\]^]""", "__HIVE_DEFAULT_PARTITION__"

READ_BYTES = 1 << 20  # text that a reading task gathers before it passes it on


def write_csv_table(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("header", "true").csv(path)


def grouped_json(cells: DataFrame, requests: DataFrame) -> DataFrame:
    """One JSON line per metric group: its averages and each metric's score by model."""
    rows = requests.join(cells, "request", "left")
    has = F.col("model").isNotNull()
    by_metric = rows.groupBy("group", "ord", "request", "display").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.when(has, F.struct("model", "score"))))).alias("scores")
    )
    metrics = by_metric.groupBy("group").agg(
        F.min("ord").alias("ord"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("ord", F.to_json(F.struct(
                F.col("request").alias("key"), "display", "scores")).alias("text")))),
            lambda m: m["text"],
        ).alias("_metrics"),
    )
    averages = rows.where(has).groupBy("group", "model").agg(F.avg("score").alias("average")).groupBy("group").agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "average"))))).alias("_average")
    )
    body = F.concat(
        F.lit('{"name":'), F.regexp_extract(F.to_json(F.array("group")), r"(?s)^\[(.*)\]$", 1),
        F.lit(',"average":'), F.coalesce("_average", F.lit("{}")),
        F.lit(',"metrics":['), F.array_join("_metrics", ","), F.lit("]}"),
    )
    return metrics.join(averages, "group", "left").select("ord", "group", body.alias("value"))


def write_lines(rows: DataFrame, path: str, by: Sequence[str] = (), compression: str = "none") -> None:
    """Text lines, in one directory per value of `by`."""
    _gathered(rows.select(*by, "value"), by).write.mode("overwrite").partitionBy(*by).text(path, compression=compression)


def _directory(name: str, value: str | None) -> str:
    return name + "=" + (re.sub(_ESCAPED, lambda c: f"%{ord(c[0]):02X}", value) if value else _NO_VALUE)


def _value(directory: str) -> str | None:
    text = directory.partition("=")[2]
    return None if text == _NO_VALUE else re.sub("%([0-9A-Fa-f]{2})", lambda c: chr(int(c[1], 16)), text)


def write_small_files(rows: DataFrame, path: str, by: Sequence[str]) -> None:
    """The lines of `write_lines` in the same directories, for so many of them that a file each is the main cost.

    The tasks write the files themselves, one for each value of `by`, with its lines in order. A repeated task writes the
    same names with the same lines; the driver learns the number of files only.
    """
    system, root = opened(path)
    system.create_dir(root)
    system.delete_dir_contents(root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(path)
        for batch in batches:
            for text, *values in zip(*(batch.column(c).to_pylist() for c in ("_text", *by))):
                place = "/".join([root, *(_directory(n, v) for n, v in zip(by, values))])
                system.create_dir(place)
                with system.open_output_stream(f"{place}/lines.txt", compression=None) as file:
                    file.write(text.encode())
            yield pa.record_batch({"files": pa.array([batch.num_rows], pa.int64())})

    lines = F.array_sort(F.collect_list(F.concat(F.coalesce("value", F.lit("")), F.lit("\n"))))
    rows.groupBy(*(F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in by)).agg(
        F.array_join(lines, "").alias("_text")).mapInArrow(write, "files long").agg(F.sum("files")).collect()


def read_small_files(spark: SparkSession, path: str, by: Sequence[str] = EXPORT_KEYS) -> DataFrame:
    """What `read_export_lines` gives, for many small files: they are found and read by tasks, level by level.

    No list of them goes to the driver, and a task reads its files one after the other.
    """
    def below(system: pafs.FileSystem, place: str, kind: pafs.FileType) -> list[str]:
        found = (f for f in system.get_file_info(pafs.FileSelector(place)) if f.type == kind)
        return sorted(f.path for f in found if not f.base_name.startswith((".", "_")))

    def directories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = opened(path)
        for batch in batches:
            for place in batch.column("place").to_pylist():
                yield pa.record_batch({"place": pa.array(below(system, place, pafs.FileType.Directory), pa.string())})

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = opened(path)
        rows, size = [], 0
        for batch in batches:
            for place in batch.column("place").to_pylist():
                for last in below(system, place, pafs.FileType.Directory):
                    values = [_value(part) for part in last.split("/")[-len(by):]]
                    for name in below(system, last, pafs.FileType.File):
                        with system.open_input_stream(name, compression=None) as file:
                            text = file.read().decode()
                        rows += ((line, *values) for line in text.removesuffix("\n").split("\n") if text)
                        size += len(text)
                    if size > READ_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["value", *by])
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["value", *by])

    places = spark.range(1).select(F.lit(opened(path)[1]).alias("place"))
    for _ in by[1:]:
        places = places.mapInArrow(directories, "place string").hint("rebalance")
    spread = places.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "place")
    return spread.mapInArrow(lines, ", ".join(f"{c} string" for c in ("value", *by)))


def write_export(results: DataFrame, instances: DataFrame, path: str, source_name: str, retrieved: str) -> None:
    """Instances and records below collection/developer/model/uuid.

    The instances are written first; the row counts and digests in the records are those of the written lines, so the
    samples are converted only once. The scores are read for the ids and for the records.
    """
    results = cut_lineage(results, "results")
    write_lines(export.keyed_lines(instances, export.record_ids(results)), f"{path}/instances", EXPORT_KEYS)
    totals = export.instance_totals(read_export_lines(results.sparkSession, f"{path}/instances"), ["uuid"])
    records = export.export_records(results, totals, source_name, retrieved)
    write_small_files(records.select(*EXPORT_KEYS, F.to_json("record").alias("value")), f"{path}/records", EXPORT_KEYS)


def read_export_lines(spark: SparkSession, path: str, keys: Sequence[str] = EXPORT_KEYS) -> DataFrame:
    """The lines of a written export with the columns its directories name."""
    schema = T.StructType([T.StructField(name, T.StringType()) for name in ("value", *keys)])
    return spark.read.schema(schema).text(path)


def write_sample_table(samples: DataFrame, path: str) -> None:
    """Flattened sample rows, one directory per task."""
    _gathered(samples, ["task"]).write.mode("overwrite").partitionBy("task").parquet(path)


def _gathered(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of one directory brought together, so that not every task writes a file into every directory.

    The rebalance hint lets AQE split a directory that is too large for one task.
    """
    return rows.hint("rebalance", *by) if by else rows


def flatten_struct(schema: T.StructType, prefix: str = "") -> list[Column]:
    """Columns `a/b/c` of a nested schema; lists become text."""
    columns = []
    for field in schema.fields:
        path = f"{prefix}.`{field.name}`" if prefix else f"`{field.name}`"
        name = path.replace("`", "").replace(".", "/")
        if isinstance(field.dataType, T.StructType):
            columns += flatten_struct(field.dataType, path)
        elif isinstance(field.dataType, T.ArrayType):
            columns.append(F.to_json(F.col(path)).alias(name))
        else:
            columns.append(F.col(path).alias(name))
    return columns
