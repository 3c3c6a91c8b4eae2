"""Batches of queries: equal texts are searched once, then handed out again."""

from __future__ import annotations

import dataclasses

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from corkscan.functions.text import tokens

# A batch has a proven size if it holds at most so many queries, or at most so
# many distinct texts, none of them longer than so many characters, with at most
# so many words in all. Its texts are broadcast, and their words are written into
# the scan's filter; any other batch is joined by shuffle. The results are the same.
FEW_QUERIES = 10_000
FEW_TEXTS = 5_000
SHORT_TEXT_CHARS = 4_000
FEW_WORDS = 100_000
# Results of so many rows are broadcast to the queries that share their texts.
FEW_RESULTS = 100_000


@dataclasses.dataclass(frozen=True)
class QueryBatch:
    """Queries (query_id, query) and, if their distinct texts are few, those texts.

    ``few`` holds (text_id, query, words). It changes the plan, and nothing else.
    """

    queries: DataFrame
    few: list[Row] | None = None

    def texts(self) -> DataFrame:
        """(text_id, query) of the distinct texts, from the driver if they are few."""
        if self.few is None:
            return distinct_texts(self.queries)
        return self.queries.sparkSession.createDataFrame(pa.table({
            "text_id": pa.array([r.text_id for r in self.few], pa.int64()),
            "query": pa.array([r.query for r in self.few], pa.string()),
        }))


def distinct_texts(queries: DataFrame) -> DataFrame:
    """(text_id, query) of each distinct text; the id is a hash of the text, so that
    query ids may be of any type, null, or repeated.

    A text that makes up a third of the batch is one row per task before the
    shuffle.
    """
    return queries.where("query IS NOT NULL").groupBy("query").agg(F.xxhash64("query").alias("text_id"))


def read_batch(queries: DataFrame, joined: bool = False) -> QueryBatch:
    """Look at the batch, but no further than up to the sizes above."""
    words = tokens(F.col("query"), joined)
    short = F.length("query") <= SHORT_TEXT_CHARS
    shown = [F.xxhash64("query").alias("text_id"), F.when(short, F.col("query")).alias("query"), F.size(words).alias("n")]
    asked = queries.where("query IS NOT NULL")
    seen = asked.select(*shown).limit(FEW_QUERIES + 1).collect()
    if len(seen) > FEW_QUERIES and all(r.query is not None for r in seen):
        seen = distinct_texts(asked).select(*shown).limit(FEW_TEXTS + 1).collect()
        if len(seen) > FEW_TEXTS:
            return QueryBatch(asked)
    if any(r.query is None for r in seen):
        return QueryBatch(asked)
    few = {r.query: r for r in seen}
    if sum(r.n for r in few.values()) > FEW_WORDS:
        return QueryBatch(asked)
    texts = QueryBatch(asked, list(few.values())).texts()
    return QueryBatch(asked, texts.select("text_id", "query", words.alias("words")).collect())


def per_query(batch: QueryBatch, results: DataFrame, k: int) -> DataFrame:
    """Hand the results of each text to all queries that have this text.

    ``results`` has a ``text_id``, and at most ``k`` rows for each. Query ids keep
    their type, and null is an id like any other.
    """
    named = batch.texts().join(results, "text_id").drop("text_id")
    if batch.few is not None and len(batch.few) * k <= FEW_RESULTS:
        named = F.broadcast(named)
    return batch.queries.select("query_id", "query").join(named, "query").drop("query")
