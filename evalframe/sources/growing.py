"""A streaming source for files that grow in place: every line once, however often its file is written to.

An offset is the size of each file, so the offset log of a query says how far each was read and no other state is kept. A
trigger reads only the bytes that were added, in ranges that many tasks share. A range gives the lines that end in it; the
one that it ends within waits for the range with its line feed, whose task looks back for where it began. A last line
without a line feed counts once its file has not changed for `idle` seconds. A file that became shorter is left alone
until it is longer than before.

A file whose name ends in `.gz` is unzipped as it is read and may grow, too, by further members or further bytes of one. Its
sizes and ranges are those of the file, the places of its lines those of the text. One task reads what was added to it,
and has to unzip what was known before as well, so zipped files suit segments that are closed.
"""

from __future__ import annotations

import re
import time
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from evalframe.sources.files import opened

BLOCK = 1 << 20  # bytes read, or unzipped, at a time
ZIPPED = ".gz"
_LINES = pa.schema([("path", pa.string()), ("at", pa.int64()), ("value", pa.string())])


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int
    closed: bool

    def __post_init__(self) -> None:
        super().__init__((self.path, self.start))


def _line_start(stream, at: int) -> int:
    """Where the line begins that the byte `at` belongs to."""
    while at > 0:
        begin = max(at - BLOCK, 0)
        stream.seek(begin)
        found = stream.read(at - begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        at = begin
    return 0


def range_lines(stream, part: Range) -> Iterator[tuple[int, bytes]]:
    """Where they begin and the bytes of the lines that end from `start` to before `stop`."""
    if part.path.endswith(ZIPPED):
        known = sum(len(block) for block in _unzipped(stream, part.start))
        return _lines(_unzipped(stream, part.stop), 0, known, part.closed)
    begin = _line_start(stream, part.start)
    return _lines(_blocks(stream, begin, part.stop), begin, part.start, part.closed)


def _blocks(stream, begin: int, stop: int) -> Iterator[bytes]:
    stream.seek(begin)
    while begin < stop and (block := stream.read(min(BLOCK, stop - begin))):
        yield block
        begin += len(block)


def _unzipped(stream, stop: int) -> Iterator[bytes]:
    """The text in the first `stop` bytes of a gzip file of any number of members, as far as these bytes give it."""
    unzip, fresh = zlib.decompressobj(wbits=31), True
    for data in _blocks(stream, 0, stop):
        while data:
            if fresh:  # members may be padded with zeros
                data = data.lstrip(b"\0")
            if data:
                fresh = False
                yield unzip.decompress(data, BLOCK)
                data = unzip.unconsumed_tail
                if unzip.eof:
                    data, unzip, fresh = unzip.unused_data, zlib.decompressobj(wbits=31), True


def _lines(blocks: Iterable[bytes], begin: int, start: int, closed: bool) -> Iterator[tuple[int, bytes]]:
    """The lines of a text that is read from `begin` on, those whose line feed stands at `start` or later."""
    held = []
    for block in blocks:
        *lines, rest = block.split(b"\n")
        for line in lines:
            whole = b"".join([*held, line])
            held = []
            if begin + len(whole) >= start:
                yield begin, whole
            begin += len(whole) + 1
        held.append(rest)
    rest = b"".join(held)
    if closed and rest:
        yield begin, rest


class GrowingLinesReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"]
        self.pattern = options.get("pattern", ".*")
        self.since = float(options.get("since", 0))
        self.idle = float(options.get("idle", 600))
        self.size = int(options.get("range", 64 << 20))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Size and whether it counts as finished, of each file that matches."""
        system, root = opened(self.root)
        now, out = time.time(), {}
        for info in system.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)):
            if info.type == pafs.FileType.File and re.search(self.pattern, info.path):
                changed = info.mtime.timestamp() if info.mtime is not None else now
                if changed >= self.since and info.size:
                    out[info.path] = [info.size, now - changed >= self.idle]
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        parts = []
        for path, (stop, closed) in sorted(end.items()):
            begin, was_closed = start.get(path, [0, False])
            if stop < begin or (stop == begin and closed == was_closed) or (stop == begin and was_closed):
                continue
            size = stop - begin if path.endswith(ZIPPED) else self.size
            cuts = [*range(begin, stop, size), stop] if stop > begin else [begin, stop]
            for a, b in zip(cuts, cuts[1:]):
                parts.append(Range(path, a, b, closed and b == stop))
        return parts

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.root)
        with system.open_input_file(partition.path) as stream:
            rows, size = [], 0
            for at, line in range_lines(stream, partition):
                rows.append((partition.path, at, line.decode("utf-8", "replace").removesuffix("\r")))
                size += len(line)
                if size > BLOCK:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _LINES)], schema=_LINES)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _LINES)], schema=_LINES)


class GrowingLines(DataSource):
    """Format `growing_lines`; options: path, pattern (of the file path), since (epoch seconds), idle (seconds), range (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "path string, at long, value string"

    def streamReader(self, schema) -> GrowingLinesReader:
        return GrowingLinesReader(dict(self.options))


def growing_lines(spark: SparkSession, root: str, **options: object) -> DataFrame:
    """A stream of (path, at, value): the lines of the files below `root` as they are completed."""
    spark.dataSource.register(GrowingLines)
    reader = spark.readStream.format("growing_lines").option("path", root)
    for key, value in options.items():
        reader = reader.option(key, str(value))
    return reader.load()
