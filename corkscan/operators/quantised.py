"""Product quantisation: train code words, encode vectors, search codes.

A vector is stored as its partition and one code per sub-vector of what is left
after taking off the centroid. Code words are ``sub_vectors x words x dim /
sub_vectors`` numbers whatever the table holds, so they travel with the tasks.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from corkscan.functions.matrices import list_array, matrix, unit_rows
from corkscan.operators import seeding
from corkscan.operators.nearest import FOUND_SCHEMA, Nearest, QueryBlock, by_part, search_blocks
from corkscan.operators.partitioned import MEAN_PLACES, NUM_PROBES, TRAINING_STEPS, keep_farthest, only_probed, probing_block

# Numbers per sub-vector (64 sub-vectors of 256 numbers) and the
# code words of each.
SUB_DIM = 4
WORDS = 256

# Rows compared with all words at a time: a block that stays in the cache.
ROWS_PER_TILE = 1_024
CODES_SCHEMA = "part_id INT, id BIGINT, codes ARRAY<SMALLINT>"


@dataclasses.dataclass(frozen=True)
class Quantiser:
    """Centroids (partitions x dim) and code words (sub_vectors x words x sub_dim)."""

    centroids: np.ndarray
    words: np.ndarray

    def residuals(self, vectors: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """What is left of unit vectors, as rows x sub_vectors x sub_dim."""
        return residuals(vectors, parts, self.centroids, self.words.shape[2])

    def encode(self, vectors: np.ndarray, parts: np.ndarray) -> np.ndarray:
        rest = self.residuals(vectors, parts)
        codes = np.empty(rest.shape[:2], np.int16)
        for m, words in enumerate(self.words):
            codes[:, m] = nearest_word(rest[:, m], words)
        return codes

    def decode(self, codes: np.ndarray, parts: np.ndarray) -> np.ndarray:
        rest = self.words[np.arange(len(self.words)), codes]
        return self.centroids[parts] + rest.reshape(len(codes), -1)


def residuals(vectors: np.ndarray, parts: np.ndarray, centroids: np.ndarray, sub_dim: int) -> np.ndarray:
    rest = unit_rows(vectors) - centroids[parts]
    return rest.reshape(len(rest), -1, sub_dim)


def nearest_word(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The nearest word of each point; of equal words, only the first is taken."""
    base = np.full(len(words), np.inf)
    first = np.unique(words, axis=0, return_index=True)[1]
    base[first] = np.square(words[first]).sum(axis=1)
    nearest = np.empty(len(points), np.int64)
    for start in range(0, len(points), ROWS_PER_TILE):
        rows = slice(start, start + ROWS_PER_TILE)
        nearest[rows] = np.argmin(np.round(base - 2.0 * (points[rows] @ words.T), 12), axis=1)
    return nearest


def words_step(assigned: DataFrame, model: Quantiser) -> DataFrame:
    """(m, code, n, word, spread, far_apart, far): the mean of the sub-vectors nearest to each
    code word, the sum of their squared distances from the old one, and the farthest of them.

    Each task adds up its own rows: one row per code word and task is shuffled.
    """
    subs, words, sub_dim = model.words.shape

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums, spread = np.zeros((subs, words), np.int64), np.zeros((subs, words, sub_dim)), np.zeros((subs, words))
        apart, far = np.full((subs, words), -1.0), np.zeros((subs, words, sub_dim))
        for batch in batches:
            if batch.num_rows:
                parts = batch["part_id"].to_numpy(zero_copy_only=False)
                rest = model.residuals(matrix(batch["vector"]), parts)
                for m in range(subs):
                    code = nearest_word(rest[:, m], model.words[m])
                    counts[m] += np.bincount(code, minlength=words)
                    np.add.at(sums[m], code, rest[:, m])
                    away = np.round(np.square(rest[:, m] - model.words[m][code]).sum(axis=1), 12)
                    spread[m] += np.bincount(code, away, minlength=words)
                    keep_farthest(code, away, rest[:, m], apart[m], far[m])
        m, code = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(m.astype(np.int32)), pa.array(code.astype(np.int32)), pa.array(counts[m, code]), list_array(sums[m, code], pa.float64()),
             pa.array(spread[m, code]), pa.array(apart[m, code]), list_array(far[m, code], pa.float64())],
            ["m", "code", "n", "sums", "spread", "far_apart", "far"])

    rows = assigned.select("vector", F.col("part_id").cast("int").alias("part_id"))
    sums = rows.mapInArrow(
        add_up, "m INT, code INT, n BIGINT, sums ARRAY<DOUBLE>, spread DOUBLE, far_apart DOUBLE, far ARRAY<DOUBLE>")
    total = sums.groupBy("m", "code").agg(
        F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"), F.sum("spread").alias("spread"),
        F.max(F.struct("far_apart", "far")).alias("far"))
    return total.select("m", "code", "n", F.transform("sums", lambda x: x / F.col("n")).alias("word"), "spread", "far.far_apart", "far.far")


def train_words(assigned: DataFrame, centroids: np.ndarray, sub_dim: int = SUB_DIM, words: int = WORDS,
                steps: int = TRAINING_STEPS, start: Quantiser | None = None) -> Quantiser:
    """Code words for each sub-vector of the ``assigned`` rows.

    Begins with ``start``, or with ``seeded_words``. Every step looks at every row and
    brings one row per code word to the driver. A word that nothing is nearest to, as
    the second of two equal ones, begins again at the sub-vector that lies farthest
    out among those of the widest word.
    """
    model = seeded_words(assigned, centroids, sub_dim, words) if start is None else start
    for _ in range(steps):
        moved = model.words.copy()
        found: list[list[Row]] = [[] for _ in moved]
        for row in words_step(assigned, model).collect():
            moved[row["m"], row["code"]] = np.round(row["word"], MEAN_PLACES)
            found[row["m"]].append(row)
        for m, rows in enumerate(found):
            empty = sorted(set(range(moved.shape[1])) - {row["code"] for row in rows})
            wide = [row for row in rows if round(row["far_apart"], MEAN_PLACES) > 0]
            wide.sort(key=lambda row: (-round(row["spread"], MEAN_PLACES), row["code"]))
            for code, row in zip(empty, wide):
                moved[m, code] = np.round(row["far"], MEAN_PLACES)
        if np.array_equal(moved, model.words):
            break
        model = Quantiser(centroids, moved)
    return model


def seeded_words(assigned: DataFrame, centroids: np.ndarray, sub_dim: int = SUB_DIM, words: int = WORDS,
                 rounds: int = 1) -> Quantiser:
    """Sub-vectors that lie apart, of rows drawn over the whole table.

    Rows are drawn by hash, then by how badly the sub-vectors drawn before stand for
    them; of each sub-vector's candidates, at most ``words`` are kept.
    """
    rows = assigned.select("id", "vector", F.col("part_id").cast("int").alias("part_id"))

    def rests(batch: pa.RecordBatch) -> np.ndarray:
        parts = batch["part_id"].to_numpy(zero_copy_only=False)
        return residuals(matrix(batch["vector"]), parts, centroids, sub_dim).reshape(batch.num_rows, -1)

    drawn = seeding.race(rows, words, 0, rests, lambda _, points: np.ones(len(points)))
    for round_ in range(1, rounds + 1):
        bad = functools.partial(_badly_told, drawn, sub_dim)
        more = seeding.race(rows, words, round_, rests, bad)
        drawn = np.concatenate([drawn, more]) if len(more) else drawn
    subs = np.round(drawn, MEAN_PLACES).reshape(len(drawn), -1, sub_dim).transpose(1, 0, 2)
    kept = [seeding.thin_out(points, np.ones(len(points)), words, seeding.SEED + m) for m, points in enumerate(subs)]
    # Where there are fewer different ones, the first stands in; training gives it another place, or leaves it unused.
    most = max(map(len, kept))
    return Quantiser(centroids, np.stack([np.concatenate([found, np.repeat(found[:1], most - len(found), axis=0)]) for found in kept]))


def _badly_told(drawn: np.ndarray, sub_dim: int, _: pa.RecordBatch, points: np.ndarray) -> np.ndarray:
    """The squared distance of each row from the nearest of the ``drawn`` sub-vectors, over all sub-vectors."""
    error = np.zeros(len(points))
    for start in range(0, points.shape[1], sub_dim):
        part = slice(start, start + sub_dim)
        for first in range(0, len(points), ROWS_PER_TILE):
            rows = slice(first, first + ROWS_PER_TILE)
            error[rows] += seeding.distances(points[rows, part], drawn[:, part])[1]
    return error


def lowest_id_words(assigned: DataFrame, centroids: np.ndarray, sub_dim: int = SUB_DIM, words: int = WORDS) -> Quantiser:
    """Sub-vectors of the rows with the lowest ids as a repeatable start."""
    first = assigned.orderBy("id").select("vector", "part_id").limit(words).toArrow()
    rest = residuals(matrix(first["vector"].combine_chunks()), first["part_id"].to_numpy(), centroids, sub_dim)
    return Quantiser(centroids, np.ascontiguousarray(rest.transpose(1, 0, 2)))


def sub_vector_size(dim: int, num_sub_vectors: int) -> int:
    """Numbers in each of ``num_sub_vectors`` parts of a vector of ``dim`` numbers."""
    if num_sub_vectors < 1 or dim % num_sub_vectors:
        raise ValueError(f"vectors of {dim} numbers cannot be cut into {num_sub_vectors} sub-vectors of one size")
    return dim // num_sub_vectors


def quantiser(centroids: np.ndarray, words: DataFrame) -> Quantiser:
    """Bring the code words, a fixed number of rows, to the driver."""
    rows = words.orderBy("m", "code").toArrow()
    subs = len(set(rows["m"].to_pylist()))
    flat = matrix(rows["word"].combine_chunks())
    return Quantiser(centroids, flat.reshape(subs, -1, flat.shape[1]))


def encode(assigned: DataFrame, model: Quantiser) -> DataFrame:
    """(part_id, id, codes) of every assigned vector; a narrow step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            parts = batch["part_id"].to_numpy(zero_copy_only=False)
            codes = model.encode(matrix(batch["vector"]), parts)
            yield pa.RecordBatch.from_arrays(
                [batch["part_id"], batch["id"], list_array(codes, pa.int16())], ["part_id", "id", "codes"])

    rows = assigned.select(F.col("part_id").cast("int").alias("part_id"), F.col("id").cast("bigint").alias("id"), "vector")
    return rows.mapInArrow(run, CODES_SCHEMA)


def residual_size(assigned: DataFrame, model: Quantiser) -> DataFrame:
    """(n, residual): one row with the number of vectors, and the mean squared distance of a unit vector from its decoded code."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = 0, 0.0
        for batch in batches:
            if batch.num_rows:
                units, parts = matrix(batch["vector"]), batch["part_id"].to_numpy(zero_copy_only=False)
                total += float(np.square(unit_rows(units) - model.decode(model.encode(units, parts), parts)).sum())
                count += batch.num_rows
        yield pa.RecordBatch.from_pydict({"n": pa.array([count], pa.int64()), "total": pa.array([total], pa.float64())})

    rows = assigned.select("vector", F.col("part_id").cast("int").alias("part_id")).mapInArrow(add_up, "n BIGINT, total DOUBLE")
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("n"), F.try_divide(F.sum("total"), F.sum("n")).alias("residual"))


def scan_codes(block: QueryBlock, model: Quantiser, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Search a task's codes.

    Each code word is looked up and put back in place, then one product gives
    the distance to every query of the block: half the squared distance of the
    unit query from the decoded vector, which is 1 - cosine for exact codes.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Nearest(block, k)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = batch["id"].to_numpy(zero_copy_only=False)
            parts = batch["part_id"].to_numpy(zero_copy_only=False)
            decoded = model.decode(matrix(batch["codes"], np.int16), parts)
            extra = (np.square(decoded).sum(axis=1) - 1.0) / 2.0
            for part, rows in by_part(batch, block):
                nearest.see(ids[rows], decoded[rows], part, extra[rows])
        yield nearest.found()

    return scan


def quantised_top_k(codes: DataFrame, model: Quantiser, queries: DataFrame,
                    k: int = 10, nprobes: int = NUM_PROBES) -> DataFrame:
    """(text_id, id, _distance, rank) from codes alone, over the nearest partitions.

    ``codes`` holds ``part_id``, ``id`` and ``codes``, best stored by ``part_id``.
    """
    rows = codes.select(F.col("part_id").cast("int").alias("part_id"), F.col("id").cast("bigint").alias("id"), "codes")

    def search(asked: pa.Table) -> DataFrame:
        block = probing_block(asked, model.centroids, nprobes)
        return only_probed(rows, block).mapInArrow(scan_codes(block, model, k), FOUND_SCHEMA)

    return search_blocks(queries, search, k)
