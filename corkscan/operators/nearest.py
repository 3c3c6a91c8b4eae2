"""Nearest vectors by cosine: exact, and over chosen partitions only.

Work grows with queries times vectors whatever the method, but pairs are never
rows: each task multiplies a block of queries with its vectors, keeps the k
nearest of each query as it goes, and hands on k rows per query.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corkscan.functions.matrices import PLACES, best_rows, matrix, tiles, unit_rows
from corkscan.operators.ranking import top_k
from corkscan.storage import new_path

# Queries sent to the tasks at a time: this many vectors of fixed size. A larger
# batch is answered block by block, each a scan of its own; at that size a scan
# costs far less than the products.
BLOCK_QUERIES = 4_096
# Distances held at a time in one task.
TILE_CELLS = 1 << 20

FOUND_SCHEMA = "text_id BIGINT, id BIGINT, _distance DOUBLE"
NEAREST_SCHEMA = f"{FOUND_SCHEMA}, rank INT"


@dataclasses.dataclass(frozen=True)
class QueryBlock:
    """Query ids, unit vectors and, if searched by partition, their partitions."""

    ids: np.ndarray
    units: np.ndarray
    probes: np.ndarray | None = None  # queries x partitions, True where searched

    def searching(self, part: int) -> np.ndarray:
        if self.probes is None:
            return np.arange(len(self.ids))
        return np.flatnonzero(self.probes[:, part])


def search_blocks(queries: DataFrame, search: Callable[[pa.Table], DataFrame], k: int) -> DataFrame:
    """(text_id, id, _distance, rank): ``search`` on blocks of ``queries`` (text_id, vector).

    The driver holds one block at a time. Of more than one, the queries are
    stored by block first and results as they are settled.
    """
    rows = queries.select(F.col("text_id").cast("bigint").alias("text_id"), "vector").where("vector IS NOT NULL")
    first = rows.limit(BLOCK_QUERIES + 1).toArrow()
    if first.num_rows <= BLOCK_QUERIES:
        return nearest_found(search(first), k)
    spark, stored, settled = rows.sparkSession, new_path(rows.sparkSession, "asked"), new_path(rows.sparkSession, "nearest")
    blocks = math.ceil(rows.count() / BLOCK_QUERIES)
    placed = rows.withColumn("block", F.pmod(F.xxhash64("text_id"), F.lit(blocks)).cast("int"))
    placed.write.partitionBy("block").parquet(stored)
    placed = spark.read.schema(placed.schema).parquet(stored)
    for block in range(blocks):
        asked = placed.where(F.col("block") == block).drop("block").toArrow()
        nearest_found(search(asked), k).write.mode("append").parquet(settled)
    return spark.read.schema(NEAREST_SCHEMA).parquet(settled)


def as_block(rows: pa.Table) -> QueryBlock:
    vectors = rows["vector"].combine_chunks()
    return QueryBlock(rows["text_id"].to_numpy(), unit_rows(matrix(vectors)))


class Nearest:
    """The k nearest ids of each query among the vectors seen so far."""

    def __init__(self, block: QueryBlock, k: int):
        self.block, self.k = block, k
        self.distances = np.full((k, len(block.ids)), np.inf)
        self.ids = np.full((k, len(block.ids)), -1, np.int64)

    def see(self, ids: np.ndarray, units: np.ndarray, part: int, extra: np.ndarray | float = 0.0) -> None:
        """Take in rows; a distance is 1 - (unit . query) + extra."""
        chosen = self.block.searching(part)
        if not len(chosen):
            return
        queries = self.block.units[chosen].T
        tile = max(1, TILE_CELLS // len(chosen))
        for start in range(0, len(ids), tile):
            rows = slice(start, start + tile)
            more = extra[rows, None] if isinstance(extra, np.ndarray) else extra
            distances = units[rows] @ queries
            np.subtract(1.0, distances, out=distances)
            distances += more
            at = best_rows(distances, ids[rows], self.k)
            near = np.where(at >= 0, np.take_along_axis(distances, np.maximum(at, 0), axis=0), np.inf)
            near = np.concatenate([self.distances[:, chosen], near])
            near_ids = np.concatenate([self.ids[:, chosen], ids[rows][at]])
            best = np.lexsort((near_ids, np.round(near, PLACES)), axis=0)[: self.k]
            self.distances[:, chosen] = np.take_along_axis(near, best, axis=0)
            self.ids[:, chosen] = np.take_along_axis(near_ids, best, axis=0)

    def found(self) -> pa.RecordBatch:
        place, query = np.nonzero(np.isfinite(self.distances))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(self.block.ids[query], pa.int64()),
                pa.array(self.ids[place, query], pa.int64()),
                pa.array(self.distances[place, query], pa.float64()),
            ],
            ["text_id", "id", "_distance"],
        )


def scan_vectors(block: QueryBlock, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Search a task's vectors (id, vector and, with probes, part_id)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Nearest(block, k)
        for batch in batches:
            for start, size in tiles(batch["vector"]):
                tile = batch.slice(start, size)
                ids = tile["id"].to_numpy(zero_copy_only=False)
                units = unit_rows(matrix(tile["vector"]))
                for part, rows in by_part(tile, block):
                    nearest.see(ids[rows], units[rows], part)
        yield nearest.found()

    return scan


def by_part(batch: pa.RecordBatch, block: QueryBlock) -> Iterator[tuple[int, np.ndarray]]:
    if block.probes is None:
        yield 0, np.arange(batch.num_rows)
        return
    parts = batch["part_id"].to_numpy(zero_copy_only=False)
    for part in np.unique(parts):
        yield int(part), np.flatnonzero(parts == part)


def nearest_found(found: DataFrame, k: int) -> DataFrame:
    """(text_id, id, _distance, rank): the k nearest over what all tasks found."""
    rounded = found.withColumn("_distance", F.round("_distance", PLACES) + F.lit(0.0))
    return top_k(rounded, "text_id", [F.asc("_distance"), F.asc("id")], k)


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(text_id, id, _distance, rank) over all of ``vectors`` (id, vector).

    ``queries`` holds ``text_id`` and ``vector``. Distance is 1 - cosine; rows
    without a direction (null or zero vectors) are left out.
    """
    rows = vectors.select(F.col("id").cast("bigint").alias("id"), "vector").where("vector IS NOT NULL")
    return search_blocks(queries, lambda asked: rows.mapInArrow(scan_vectors(as_block(asked), k), FOUND_SCHEMA), k)


def script_score(results: DataFrame) -> DataFrame:
    """``_score`` = cosine + 1 in place of ``_distance``; the order stays."""
    return results.withColumn("_score", F.round(2.0 - F.col("_distance"), PLACES)).drop("_distance")
