"""What is done with search results: fetch fields, hit flags, first hits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corkscan.schemas import KEYWORD_FIELDS, RESULT_FIELDS
from corkscan.sources.tables import bucket_of
from corkscan.storage import materialise

# Fixed value: what is shown for a query without hits.
NO_RESULT = "<no result>"


def fetch_fields(results: DataFrame, records: DataFrame, measure: str | None = None,
                 buckets: int | None = None) -> DataFrame:
    """(query_id, rank, result fields[, measure]) of each hit.

    ``results`` holds ``query_id``, ``rank``, ``id``. The top k is settled and
    written first: it is narrow, and once its size is known Spark can send the
    ids to the scan of ``records``. For records stored by ``write_by_id`` in
    ``buckets`` folders, only folders with hits are then read.
    """
    narrow = results.select("query_id", "rank", "id", *([measure] if measure else []))
    keys = ["id"]
    if buckets:
        narrow = narrow.withColumn("id_bucket", bucket_of(F.col("id"), buckets))
        keys.append("id_bucket")
    fields = [F.col(name).cast(kind).alias(name) for name, kind in RESULT_FIELDS.items()]
    # All ranks are 1 or more; Spark prunes folders only for a side with a filter.
    hits = materialise(narrow, "hits").where("rank >= 1")
    found = records.select(*fields, *keys[1:]).join(hits, keys)
    return found.select("query_id", "rank", *RESULT_FIELDS, *([measure] if measure else []))


def hit_flags(queries: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, n, hit): whether each query found anything."""
    counts = results.groupBy("query_id").agg(F.count("*").alias("n"))
    flagged = queries.select("query_id").join(counts, "query_id", "left")
    return flagged.select("query_id", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("hit"))


def first_hits(queries: DataFrame, results: DataFrame, column: str = "description") -> DataFrame:
    """(query_id, query, ``column``): the best hit's text, or a note that there is none."""
    best = results.where("rank = 1").select("query_id", column)
    shown = queries.join(best, "query_id", "left")
    return shown.select("query_id", "query", F.coalesce(column, F.lit(NO_RESULT)).alias(column))


def without_hits(queries: DataFrame, results: DataFrame) -> DataFrame:
    return queries.join(results.select("query_id"), "query_id", "left_anti")


def keyword_equals(records: DataFrame, field: str, values: Sequence[str] | Column) -> DataFrame:
    """Records whose whole field equals one of the values: no words are cut."""
    if field not in KEYWORD_FIELDS:
        raise ValueError(f"{field} is not kept whole")
    return records.where(F.col(field).isin(list(values)))
