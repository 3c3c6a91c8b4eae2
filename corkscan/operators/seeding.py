"""Starting points for training, drawn in parallel by distance.

Each round looks at every vector once and draws more candidates, each with a chance
in proportion to its squared distance from those drawn before (an exponential race:
of the values -ln(u) / d2, with u from a hash of id and round, the smallest win, so
that every round brings a fixed number of rows to the driver, whatever the table
holds and however it is partitioned). Copies of a candidate have no distance and are
never drawn after it. The candidates, a few for each starting point wanted, are then
weighed with the number of vectors nearest to them, and thinned out on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corkscan.functions.matrices import list_array, matrix, tiles

# Rounds of drawing after the first, and candidates of each round for each starting point.
ROUNDS = 4
OVERSAMPLING = 2
SEED = 42


def race(rows: DataFrame, count: int, round_: int, points: Callable[[pa.RecordBatch], np.ndarray],
         weights: Callable[[pa.RecordBatch, np.ndarray], np.ndarray]) -> np.ndarray:
    """``count`` of the ``points`` of ``rows`` (id, vector, ...), drawn by hash in proportion to their ``weights``.

    Points with a weight of zero are not drawn. A task holds ``count`` points besides those it looks at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            for start, size in tiles(batch["vector"]):
                rows = batch.slice(start, size)
                found = points(rows)
                share = np.nan_to_num(weights(rows, found))
                draw = rows["draw"].to_numpy(zero_copy_only=False)
                chances = (draw.astype(np.uint64) >> np.uint64(11)).astype(float)
                with np.errstate(divide="ignore"):
                    keys = -np.log((chances + 0.5) / 2.0**53) / share
                first = np.argsort(keys, kind="stable")[:count]
                first = first[np.isfinite(keys[first])]
                best = _first([keys[first], draw[first], found[first]], best, count)
        if best is not None and len(best[0]):
            keys, draw, found = best
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(draw), list_array(found, pa.float64())], ["key", "draw", "point"])

    drawn = rows.withColumn("draw", F.xxhash64(F.lit(SEED), F.lit(round_), "id"))
    won = drawn.mapInArrow(run, "key DOUBLE, draw BIGINT, point ARRAY<DOUBLE>").orderBy("key", "draw").limit(count).toArrow()
    return matrix(won["point"].combine_chunks())


def _first(found: list[np.ndarray], before: list[np.ndarray] | None, count: int) -> list[np.ndarray]:
    """The ``count`` points (keys, draws, points) that win of those found and those before."""
    both = found if before is None else [np.concatenate(pair) for pair in zip(before, found)]
    first = np.lexsort((both[1], both[0]))[:count]
    return [values[first] for values in both]


def distances(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point the nearest centre, the first of equal ones, and the squared distance from it."""
    apart = np.maximum(np.round(np.square(points).sum(1)[:, None] - 2 * points @ centres.T + np.square(centres).sum(1), 12), 0.0)
    nearest = np.argmin(apart, axis=1)
    return nearest, apart[np.arange(len(points)), nearest]


def thin_out(candidates: np.ndarray, weights: np.ndarray, count: int, seed: int = SEED) -> np.ndarray:
    """At most ``count`` different candidates, each drawn by its weight times its squared distance from those before."""
    rng, weights = np.random.default_rng(seed), np.asarray(weights, float)
    apart, chosen = np.ones(len(candidates)), []
    while len(chosen) < count:
        chances = weights * apart
        if chances.sum() <= 0:
            # What is left are candidates that nothing is nearest to, if any.
            chances = apart.copy()
            if not chosen or chances.sum() <= 0:
                break
        chosen.append(int(np.searchsorted(np.cumsum(chances), rng.random() * chances.sum(), side="right").clip(0, len(candidates) - 1)))
        new = distances(candidates, candidates[chosen[-1:]])[1]
        apart = new if len(chosen) == 1 else np.minimum(apart, new)
    return candidates[chosen]
