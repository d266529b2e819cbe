"""Exact top-k inner-product search by tiles: blocks of queries times shards of vectors, merged in two steps.

Vectors are integers. Queries and candidates are packed into tiles, one matrix per row; every block of queries meets every
shard once, and a task keeps one block and one shard at a time: a matrix product, a partial selection of the best per
query, and their exact order. The lists of a query are merged first in groups of shards, then over the groups.

Products are computed in doubles while all partial sums stay below 2^53, else in Python integers; a score beyond 64 bits
is an error. Vectors that are null or hold a null or non-finite component take no part. Vectors of different lengths are
compared as if filled up with zeros; an empty vector scores 0. Repeated rows are candidates of their own, but a candidate
with the query's id is never returned. A null id takes no part. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from evalframe.llm.shared import written

QUERY_ROWS = 256
SHARD_ROWS = 4096
MERGED = 32  # shards merged in the first step
EXACT = float(1 << 53)

_TILE = "tile long, ids binary, width int, matrix binary"


def usable(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """id and floor(scale * component) as whole doubles, of the vectors that take part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))
    return vectors.where(F.col(vector).isNotNull() & F.col(key).isNotNull() & finite).select(
        F.col(key).cast("long").alias("id"), whole.alias("vector"))


def _packed(ids: np.ndarray, values: np.ndarray, lengths: np.ndarray, tile: int) -> dict:
    width = int(lengths.max()) if len(lengths) else 0
    matrix = np.zeros((len(ids), width))
    if width:
        matrix[np.arange(width) < lengths[:, None]] = values
    return {"tile": tile, "ids": ids.tobytes(), "width": width, "matrix": matrix.tobytes()}


def _pack(rows: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                some = batch.slice(at, rows)
                vectors = some.column("vector")
                ids = np.asarray(some.column("id"), dtype=np.int64)
                lengths = np.asarray(vectors.value_lengths(), dtype=np.int64)
                tile = _packed(ids, np.asarray(vectors.flatten(), dtype=np.float64), lengths, number)
                number += 1
                yield pa.RecordBatch.from_pylist([tile], schema=pa.schema(
                    [("tile", pa.int64()), ("ids", pa.binary()), ("width", pa.int32()), ("matrix", pa.binary())]))

    return pack


def tiles(vectors: DataFrame, rows: int) -> DataFrame:
    return vectors.mapInArrow(_pack(rows), _TILE)


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    width = min(left.shape[1], right.shape[1])
    left, right = left[:, :width], right[:, :width]
    if not width:
        return np.zeros((len(left), len(right)), np.int64)
    bound = np.abs(left).sum(axis=1).max() * np.abs(right).max() if len(left) and len(right) else 0
    if bound < EXACT:
        return (left @ right.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return whole(left).dot(whole(right).T).astype(np.int64)


def _best(k: int):
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                queries, ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
                left = np.frombuffer(row["q_matrix"]).reshape(len(queries), row["q_width"])
                right = np.frombuffer(row["matrix"]).reshape(len(ids), row["width"])
                order = np.argsort(ids, kind="stable")
                ids, scores = ids[order], _products(left, right[order])
                out = []
                for q, line in zip(queries, scores):
                    there = np.flatnonzero(ids != q)
                    some = line[there]
                    if len(some) > k:  # all that reach the k-th score, so that ties are cut by id
                        reach = np.flatnonzero(some >= np.partition(some, len(some) - k)[len(some) - k])
                        there, some = there[reach], some[reach]
                    first = np.argsort(-some, kind="stable")[:k]
                    out.append((np.full(len(first), q), ids[there[first]], some[first]))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([o[i] for o in out]), pa.int64()) for i in range(3)
                ] + [pa.array(np.full(sum(len(o[0]) for o in out), row["tile"]), pa.int64())], ["query_id", "id", "score", "tile"])

    return best


def top_k(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """query_id, rank (from 1), id, score: the k best candidates of each query, both given as `usable` rows."""
    spark = candidates.sparkSession
    blocks = written(tiles(queries, QUERY_ROWS), "query-tiles")
    shards = written(tiles(candidates, SHARD_ROWS), "shard-tiles")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = shards.repartition(partitions).crossJoin(blocks.select(  # rows are whole tiles
        F.col("tile").alias("q_tile"), F.col("ids").alias("q_ids"), F.col("width").alias("q_width"),
        F.col("matrix").alias("q_matrix")))
    lists = pairs.mapInArrow(_best(k), "query_id long, id long, score long, tile long")

    def first(rows: DataFrame, keys: list[Column]) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    group = F.pmod(F.xxhash64("tile"), F.lit(MERGED))
    merged = first(lists.withColumn("group", group), [F.col("query_id"), F.col("group")])
    return first(merged, [F.col("query_id")]).select("query_id", "rank", "id", "score")
