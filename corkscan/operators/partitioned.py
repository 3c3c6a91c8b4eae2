"""Coarse partitions of a vector table: train, assign, probe, search.

Centroids are a matrix of ``partitions x dim`` numbers whatever the table holds,
so they travel with the tasks; vectors never come to the driver.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from corkscan.functions.matrices import PLACES, list_array, matrix, tiles, unit_rows
from corkscan.operators import seeding
from corkscan.operators.nearest import FOUND_SCHEMA, QueryBlock, as_block, nearest_found, scan_vectors, search_blocks
from corkscan.storage import materialise

# Settings of the partitioned index and of its search.
NUM_PARTITIONS = 16
NUM_PROBES = 10

# Steps of training, unless told otherwise, and places that means are rounded to
# after each, so that the order of addition does not show.
TRAINING_STEPS = 20
MEAN_PLACES = 9
# What rounding may take from an angle near 0, where the arc cosine is steep.
ANGLE_SLACK = 1e-7
# Cosines held at a time when rows are compared with many centroids.
TILE_CELLS = 1 << 19


def train_centroids(vectors: DataFrame, partitions: int = NUM_PARTITIONS, steps: int = TRAINING_STEPS,
                    start: np.ndarray | None = None) -> np.ndarray:
    """Cluster the vectors (id, vector) by cosine; one unit centroid per partition.

    Begins with ``start``, or with ``seeded_centroids``. Every step looks at every
    vector and brings one row per partition to the driver. A partition that nothing
    is nearest to, as the second of two twins, begins again at the vector that lies
    farthest out in the widest partition. Ends early when nothing moves. There are
    fewer partitions than asked for only if there are fewer different vectors.
    """
    centroids = seeded_centroids(vectors, partitions) if start is None else start
    if not len(centroids):
        return centroids
    for _ in range(steps):
        moved, found = centroids.copy(), lloyd_step(vectors, centroids).collect()
        for row in found:
            moved[row["part_id"]] = np.round(row["centroid"], MEAN_PLACES)
        moved = unit_rows(moved)
        for part, row in zip(empty_parts(found, len(centroids)), widest_first(found)):
            moved[part] = row["far"]
        if np.array_equal(moved, centroids):
            break
        centroids = moved
    return centroids


def empty_parts(found: Sequence[Row], count: int) -> list[int]:
    return sorted(set(range(count)) - {row["part_id"] for row in found})


def widest_first(found: Sequence[Row]) -> list[Row]:
    """Partitions of more than one place, the one with the largest sum of distances first."""
    wide = [row for row in found if round(row["far_apart"], MEAN_PLACES) > 0]
    return sorted(wide, key=lambda row: (-round(row["spread"], MEAN_PLACES), row["part_id"]))


def seeded_centroids(vectors: DataFrame, partitions: int = NUM_PARTITIONS, rounds: int = seeding.ROUNDS) -> np.ndarray:
    """Unit vectors that lie apart, drawn over all vectors in a few passes."""
    rows = vectors.select("id", "vector").where("vector IS NOT NULL")
    units = lambda batch: unit_rows(matrix(batch["vector"]))
    candidates = seeding.race(rows, 1, 0, units, lambda _, points: np.where(np.isnan(points[:, 0]), 0.0, 1.0))
    for round_ in range(1, rounds + 1):
        if not len(candidates):
            break
        apart = functools.partial(_apart, candidates)
        more = seeding.race(rows, seeding.OVERSAMPLING * partitions, round_, units, apart)
        candidates = np.concatenate([candidates, more]) if len(more) else candidates
    weights = np.zeros(len(candidates))
    if not len(candidates):
        return candidates
    for row in lloyd_step(vectors, candidates).select("part_id", "n").collect():
        weights[row["part_id"]] = row["n"]
    return seeding.thin_out(candidates, weights, partitions)


def _apart(candidates: np.ndarray, _: pa.RecordBatch, points: np.ndarray) -> np.ndarray:
    usable, apart = ~np.isnan(points[:, 0]), np.zeros(len(points))
    apart[usable] = seeding.distances(points[usable], candidates)[1]
    return apart


def lowest_id_centroids(vectors: DataFrame, partitions: int = NUM_PARTITIONS) -> np.ndarray:
    """The vectors with the lowest ids as a repeatable start."""
    first = vectors.where("vector IS NOT NULL").orderBy("id").select("vector").limit(partitions).toArrow()
    return unit_rows(matrix(first["vector"].combine_chunks()))


def nearest_part(centroids: np.ndarray, vector: Column) -> Column:
    """The partition whose centroid has the highest cosine; the lowest on ties.

    Null for a vector without a direction.
    """

    def assign(vectors: pa.Array) -> pa.Array:
        if len(vectors) == 0:
            return pa.array([], pa.int32())
        parts, missing = np.empty(len(vectors), np.int32), np.empty(len(vectors), bool)
        for start, size in tiles(vectors):
            rows = slice(start, start + size)
            units = unit_rows(matrix(vectors.slice(start, size)))
            parts[rows], missing[rows] = nearest_parts(units, centroids, 1)[:, 0], np.isnan(units[:, 0])
        return pa.array(parts, mask=missing)

    assign.__annotations__ = {"vectors": pa.Array, "return": pa.Array}
    # Else a filter on the partition works it out a second time, in Python processes of its own.
    return F.arrow_udf(assign, "int").asNondeterministic()(vector)


def assign_partitions(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Add ``part_id`` to the vectors that have a direction; a narrow step."""
    assigned = vectors.where("vector IS NOT NULL").withColumn("part_id", nearest_part(centroids, F.col("vector")))
    return assigned.where("part_id IS NOT NULL")


def lloyd_step(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(part_id, n, centroid, spread, far_apart, far): the mean unit vector of each partition,
    the sum of squared distances from the old centroid, and the farthest vector.

    Each task adds up its own vectors, so a partition with a third of them is
    still one row per task in the shuffle.
    """

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape)
        spread, apart, far = np.zeros(len(centroids)), np.full(len(centroids), -1.0), np.zeros(centroids.shape)
        for batch in batches:
            for start, size in tiles(batch["vector"]):
                units = unit_rows(matrix(batch["vector"].slice(start, size)))
                units = units[~np.isnan(units[:, 0])]
                part = nearest_parts(units, centroids, 1)[:, 0]
                counts += np.bincount(part, minlength=len(centroids))
                np.add.at(sums, part, units)
                away = np.round(np.square(units - centroids[part]).sum(axis=1), 12)
                spread += np.bincount(part, away, minlength=len(centroids))
                keep_farthest(part, away, units, apart, far)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen.astype(np.int32)), pa.array(counts[seen]), list_array(sums[seen], pa.float64()), pa.array(spread[seen]),
             pa.array(apart[seen]), list_array(far[seen], pa.float64())],
            ["part_id", "n", "sums", "spread", "far_apart", "far"],
        )

    rows = vectors.select("vector").where("vector IS NOT NULL")
    sums = rows.mapInArrow(add_up, "part_id INT, n BIGINT, sums ARRAY<DOUBLE>, spread DOUBLE, far_apart DOUBLE, far ARRAY<DOUBLE>")
    total = sums.groupBy("part_id").agg(
        F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"), F.sum("spread").alias("spread"),
        # Of vectors equally far out the largest one, so that partitions of the data do not show.
        F.max(F.struct("far_apart", "far")).alias("far"))
    return total.select("part_id", "n", F.transform("sums", lambda x: x / F.col("n")).alias("centroid"), "spread", "far.far_apart", "far.far")


def keep_farthest(group: np.ndarray, away: np.ndarray, points: np.ndarray, apart: np.ndarray, far: np.ndarray) -> None:
    """Put the farthest point of each group into ``apart`` and ``far``; of equally far ones the largest."""
    most = np.full(len(apart), -1.0)
    np.maximum.at(most, group, away)
    rows = np.flatnonzero(away == most[group])
    if len(rows) > len(apart):  # copies
        rows = rows[np.unique(np.column_stack([group[rows], points[rows]]), axis=0, return_index=True)[1]]
    for row in rows.tolist():
        at = group[row]
        if (away[row], points[row].tolist()) > (apart[at], far[at].tolist()):
            apart[at], far[at] = away[row], points[row]


def probed_parts(queries: DataFrame, centroids: np.ndarray, nprobes: int = NUM_PROBES) -> DataFrame:
    """(text_id, part_id, probe): the ``nprobes`` partitions nearest to each query."""
    count = min(nprobes, len(centroids))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            units = unit_rows(matrix(batch["vector"]))
            usable = ~np.isnan(units[:, 0])
            parts = nearest_parts(units[usable], centroids, count)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(batch["text_id"].to_numpy(zero_copy_only=False)[usable], count), pa.int64()),
                    pa.array(parts.ravel().astype(np.int32)),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(parts))),
                ],
                ["text_id", "part_id", "probe"],
            )

    rows = queries.select("text_id", "vector").where("vector IS NOT NULL")
    return rows.mapInArrow(probe, "text_id BIGINT, part_id INT, probe INT")


def nearest_parts(units: np.ndarray, centroids: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` nearest centroids of each row, nearest first; the lower one on ties."""
    found = np.empty((len(units), count), np.int64)
    tile = max(1, TILE_CELLS // max(len(centroids), 1))
    for start in range(0, len(units), tile):
        rows = slice(start, start + tile)
        away = -np.round(units[rows] @ centroids.T, 12)
        if count == 1:
            found[rows, 0] = np.argmin(away, axis=1)
            continue
        # Only centroids as near as the last one that counts have to be put in order.
        last = np.partition(away, count - 1, axis=1)[:, count - 1]
        for row, (distances, bound) in enumerate(zip(away, last), start):
            near = np.flatnonzero(distances <= bound)
            found[row] = near[np.argsort(distances[near], kind="stable")[:count]]
    return found


def probing_block(rows: pa.Table, centroids: np.ndarray, nprobes: int) -> QueryBlock:
    """A block of queries with the partitions that each of them searches."""
    block = as_block(rows)
    probes = np.zeros((len(block.ids), len(centroids)), bool)
    if len(block.ids):
        np.put_along_axis(probes, nearest_parts(block.units, centroids, min(nprobes, len(centroids))), True, axis=1)
    return QueryBlock(block.ids, block.units, probes)


def only_probed(rows: DataFrame, block: QueryBlock) -> DataFrame:
    """Leave out partitions that no query of the block searches: folders are not read."""
    searched = np.flatnonzero(block.probes.any(axis=0)).tolist()
    return rows.where(F.col("part_id").isin(searched))


def flat_top_k(assigned: DataFrame, centroids: np.ndarray, queries: DataFrame,
               k: int = 10, nprobes: int = NUM_PROBES) -> DataFrame:
    """As ``exact_top_k``, over the nearest partitions of each query only.

    ``assigned`` holds ``id``, ``vector`` and ``part_id``, best stored by
    ``part_id``.
    """
    rows = assigned.select(F.col("id").cast("bigint").alias("id"), "vector", F.col("part_id").cast("int").alias("part_id"))

    def search(asked: pa.Table) -> DataFrame:
        block = probing_block(asked, centroids, nprobes)
        return only_probed(rows, block).mapInArrow(scan_vectors(block, k), FOUND_SCHEMA)

    return search_blocks(queries, search, k)


def partition_radii(assigned: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The largest angle between each centroid and the vectors of its partition (id, vector, part_id).

    A partition without vectors has a radius below zero: nothing has to be looked for in it.
    """
    directions = unit_rows(centroids)

    def narrowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.full(len(directions), np.inf)
        for batch in batches:
            part = batch["part_id"].to_numpy(zero_copy_only=False)
            cosines = np.einsum("ij,ij->i", unit_rows(matrix(batch["vector"])), directions[part]) if len(part) else np.empty(0)
            # A centroid without a direction bounds nothing.
            np.minimum.at(least, part, np.nan_to_num(cosines, nan=-1.0))
        seen = np.flatnonzero(np.isfinite(least))
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(least[seen])], ["part_id", "least"])

    radii = np.full(len(centroids), -1.0)
    rows = assigned.select("vector", F.col("part_id").cast("int").alias("part_id")).where("vector IS NOT NULL")
    for row in rows.mapInArrow(narrowest, "part_id INT, least DOUBLE").groupBy("part_id").agg(F.min("least").alias("least")).collect():
        radii[row["part_id"]] = np.arccos(np.clip(row["least"], -1.0, 1.0))
    return radii


def nearest_possible(units: np.ndarray, centroids: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Queries x partitions: no vector of a partition is nearer to a query than this, by the triangle inequality of angles."""
    angles = np.arccos(np.clip(units @ unit_rows(centroids).T, -1.0, 1.0))
    bounds = 1.0 - np.cos(np.clip(angles - radii - ANGLE_SLACK, 0.0, np.pi))
    return np.where(radii < 0, np.inf, np.nan_to_num(bounds, nan=0.0))


def pruned_top_k(assigned: DataFrame, centroids: np.ndarray, radii: np.ndarray, queries: DataFrame, k: int = 10, first: int = 1) -> DataFrame:
    """As ``exact_top_k``, rows and all, but partitions that cannot hold one of the k nearest are not read.

    The ``first`` nearest partitions of each query set a distance; of the others only
    those are searched whose radius lets them reach it.
    """
    rows = assigned.select(F.col("id").cast("bigint").alias("id"), "vector", F.col("part_id").cast("int").alias("part_id"))

    def search(asked: pa.Table) -> DataFrame:
        block = probing_block(asked, centroids, first)
        near = materialise(nearest_found(only_probed(rows, block).mapInArrow(scan_vectors(block, k), FOUND_SCHEMA), k), "first-probes")
        rest = remaining_block(block, near, centroids, radii, k)
        far = only_probed(rows, rest).mapInArrow(scan_vectors(rest, k), FOUND_SCHEMA)
        return near.select("text_id", "id", "_distance").unionByName(far)

    return search_blocks(queries, search, k)


def remaining_block(block: QueryBlock, near: DataFrame, centroids: np.ndarray, radii: np.ndarray, k: int) -> QueryBlock:
    """The same queries with the partitions that may still hold one of their k nearest; ``near`` holds what was found so far."""
    last = near.where(F.col("rank") == k).select("text_id", "_distance").collect()  # one row for each query of the block
    reached = {row["text_id"]: row["_distance"] for row in last}
    limits = np.array([reached.get(int(text), np.inf) for text in block.ids]).reshape(-1, 1)
    # Distances are rounded, and equal ones go to the lower id: half a place more can still win.
    open_ = nearest_possible(block.units, centroids, radii) <= limits + 10.0**-PLACES
    return QueryBlock(block.ids, block.units, open_ & ~block.probes & (radii >= 0))


def recall(found: DataFrame, exact: DataFrame, k: int = 10) -> DataFrame:
    """(text_id, recall): the share of each query's exact top k that was found."""
    both = exact.select("text_id", "id").join(
        found.select("text_id", "id", F.lit(1).alias("hit")), ["text_id", "id"], "left")
    return both.groupBy("text_id").agg((F.count("hit") / F.lit(k)).alias("recall"))
