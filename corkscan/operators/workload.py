"""Query lists for search trials: seeded draws and warm-up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corkscan.functions.hashing import draw

# The settings of a trial.
NUM_QUERIES = 1000
NUM_TRIALS = 3
SEED = 37
WARMUP_QUERIES = 10
SEARCH_TYPES = ("fts", "vector")


def sample_queries(terms: DataFrame, count: int = NUM_QUERIES, seed: int = SEED) -> DataFrame:
    """(query_id, query): ``count`` draws with replacement, the same for a seed.

    ``terms`` holds ``query_id`` (1, 2, ... without gaps) and ``query``.
    """
    return _pick(terms, count, lambda place, n_terms: draw(seed, place, n_terms))


def warmup_queries(terms: DataFrame, count: int = WARMUP_QUERIES) -> DataFrame:
    """(query_id, query): the terms in turn, over and over, ``count`` in all."""
    return _pick(terms, count, lambda place, n_terms: place % n_terms)


def _pick(terms: DataFrame, count: int, choose: Callable[[Column, int], Column]) -> DataFrame:
    places = terms.sparkSession.range(count).select(
        (F.col("id") + 1).alias("query_id"), (choose(F.col("id"), terms.count()) + 1).alias("chosen"))
    return places.join(terms.select(F.col("query_id").alias("chosen"), "query"), "chosen").select("query_id", "query")


def search_seed(search: str, seed: int = SEED) -> int:
    """Each kind of search draws with a seed of its own."""
    return seed + SEARCH_TYPES.index(search)
