"""Token ids as Arrow stream files: equal-length sequences and masks in fixed-size lists, read by position without copying.

Documents are range-partitioned by id and every partition becomes one file pair in a shared folder, in ascending order:
`part-N.arrow` holds one endless row of ids cut into sequences of one length (the last one padded, its padding masked out),
in record batches of a fixed number of sequences, and `part-N.docs.arrow` says where each document starts. The place of any
token is plain arithmetic: batch = at // (length * rows), so a reader maps the file and touches only what it asks for.

A file is written under a name of its own and then renamed, so a repeated or speculative task leaves one whole file. Ids are
stored in 16 bits where the vocabulary allows it. Nulls: a null text has only its end id, a null document id sorts first.
Equal ids are ordered by text. An empty table gives no files. Other input columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window, functions as F

from evalframe.llm import words
from evalframe.llm.shared import shared_folder, written
from evalframe.llm.tokens import encoder

LENGTH = 1024
ROWS = 256  # sequences in a record batch

_MANIFEST = "file string, part int, tokens long, docs long"


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


class _Sequences:
    """Appends ids to a file of fixed-size-list batches."""

    def __init__(self, stream, kind: np.dtype, length: int, rows: int) -> None:
        self.kind, self.length, self.block = kind, length, length * rows
        self.waiting, self.held, self.total = [], 0, 0
        ids = pa.list_(pa.from_numpy_dtype(kind), length)
        self.schema = pa.schema([("ids", ids), ("mask", pa.list_(pa.bool_(), length))])
        self.writer = pa.ipc.new_file(stream, self.schema)

    def append(self, ids: np.ndarray) -> None:
        self.waiting.append(ids.astype(self.kind))
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= self.block:
            self._write(self.held - self.held % self.block)

    def _write(self, count: int) -> None:
        flat = np.concatenate(self.waiting) if self.waiting else np.zeros(0, self.kind)
        for at in range(0, count, self.block):
            some = flat[at : min(at + self.block, count)]
            padded = -(-len(some) // self.length) * self.length
            mask = np.arange(padded) < len(some)
            some = np.concatenate([some, np.zeros(padded - len(some), self.kind)])
            self.writer.write_batch(pa.RecordBatch.from_arrays([
                pa.FixedSizeListArray.from_arrays(pa.array(some), self.length),
                pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))
        self.waiting, self.held = [flat[count:]], self.held - count

    def close(self) -> None:
        if self.held:
            self._write(self.held)
        self.writer.close()


class TokenFile:
    """A written file; `tokens(at, count)` gives ids by position."""

    def __init__(self, path: str) -> None:
        system, local = _opened(path)
        if isinstance(system, pafs.LocalFileSystem):
            self.source = pa.memory_map(local)
        else:
            self.source = system.open_input_file(local)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size
        self.rows = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 0
        self.number, self.ids, self.mask = -1, None, None

    def _batch(self, number: int) -> None:
        if number != self.number:
            batch = self.reader.get_batch(number)
            self.number = number
            self.ids = batch.column("ids").values.to_numpy()
            self.mask = batch.column("mask").values

    def chunks(self, at: int, count: int) -> Iterator[np.ndarray]:
        block = self.length * self.rows
        while count:
            self._batch(at // block)
            inside = at % block
            some = self.ids[inside : inside + count]
            if not len(some) or not self.mask[inside + len(some) - 1].as_py():
                raise ValueError("asked for tokens beyond the end of the file")
            yield some
            at, count = at + len(some), count - len(some)

    def tokens(self, at: int, count: int) -> np.ndarray:
        parts = list(self.chunks(at, count))
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def _writing(folder: str, tokenizer: str, end: int, length: int, rows: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part, mark = context.partitionId(), f".{context.taskAttemptId()}"
        encode = encoder(tokenizer)
        kind = np.dtype("<u2") if max(encode.vocabulary, end + 1) <= 1 << 16 else np.dtype("<u4")
        names = [f"{folder}/part-{part:06d}.arrow", f"{folder}/part-{part:06d}.docs.arrow"]
        system, first = _opened(names[0])
        second = _opened(names[1])[1]
        system.create_dir(_opened(folder)[1], recursive=True)
        docs = pa.schema([("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64())])
        count = 0
        with system.open_output_stream(first + mark) as a, system.open_output_stream(second + mark) as b:
            sequences, index = _Sequences(a, kind, length, rows), pa.ipc.new_file(b, docs)
            for batch in batches:
                texts = batch.column("text")
                for one, last, _, _ in words.slices(texts):
                    ids = encode.encode(texts.slice(one, last - one).to_pylist())
                    at = []
                    for packed in ids:
                        at.append(sequences.total)
                        sequences.append(np.frombuffer(packed, "<u4"))
                        sequences.append(np.array([end], "<u4"))
                    index.write_batch(pa.RecordBatch.from_arrays([
                        batch.column("doc_id").slice(one, last - one), pa.array(at, pa.int64()),
                        pa.array([len(p) // 4 + 1 for p in ids], pa.int64())], schema=docs))
                    count += last - one
            sequences.close()
            index.close()
        for name in (first, second):
            system.move(name + mark, name)
        if count:
            yield pa.RecordBatch.from_pylist(
                [{"file": names[0], "part": part, "tokens": sequences.total, "docs": count}],
                schema=pa.schema([("file", pa.string()), ("part", pa.int32()), ("tokens", pa.int64()), ("docs", pa.int64())]))

    return write


def write_tokens(
    documents: DataFrame, key: str, text: str, tokenizer: str, end: int, length: int = LENGTH, rows: int = ROWS,
) -> DataFrame:
    """Write the files; the result, itself a written table, has a row per file: file, part, tokens, docs, start."""
    spark = documents.sparkSession
    folder = shared_folder(spark, "token-files")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ordered = ordered.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")
    files = written(ordered.mapInArrow(_writing(folder, tokenizer, end, length, rows), _MANIFEST), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return written(files.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0))), "token-starts")


def _reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            file = TokenFile(row["file"])
            system, name = _opened(row["file"].removesuffix(".arrow") + ".docs.arrow")
            index = pa.ipc.open_file(system.open_input_file(name))
            for number in range(index.num_record_batches):
                docs = index.get_batch(number)
                sums = []
                for at, count in zip(docs.column("at").to_pylist(), docs.column("n_tokens").to_pylist()):
                    crc = 0
                    for some in file.chunks(at, count):
                        crc = zlib.crc32(some.astype("<u4").tobytes(), crc)
                    sums.append(crc)
                start = np.asarray(docs.column("at"), dtype=np.int64) + row["start"]
                yield pa.RecordBatch.from_arrays(
                    [docs.column("doc_id"), pa.array(start), docs.column("n_tokens"), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read from the files alone."""
    spread = files.repartition(max(files.sparkSession.sparkContext.defaultParallelism, 1), "file")
    return spread.mapInArrow(_reading, "doc_id long, start long, n_tokens long, ids_crc32 long")
