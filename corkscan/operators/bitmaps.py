"""Candidate sets as bitmaps: which documents hold a word, 32,768 identifiers to a block.

A block in which a word is frequent is a bitmap of 4 KB; one in which it is rare is
the list of its places, which is shorter. The candidates of a query are the blocks
of its words, or-ed; they are counted from the bits alone, and documents are only
looked at where they are wanted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corkscan.functions.text import tokens
from corkscan.operators.text_index import TextIndex

# A bitmap takes as much room as so many places of 8 bytes.
DENSE_DOCUMENTS = 512
SCHEMA = "field STRING, term STRING, block BIGINT, n BIGINT, places ARRAY<BIGINT>, bits BINARY"


def build_bitmaps(index: TextIndex, path: str) -> None:
    """Write (field, term, block, n, places, bits) of all postings, sorted by word: one of ``places`` and ``bits`` is null.

    A word that every document holds is spread over its blocks; places of a block
    are at most ``DENSE_DOCUMENTS``.
    """
    rows = index.postings().select(
        "field", "term", F.bitmap_bucket_number("doc_id").alias("block"), F.bitmap_bit_position("doc_id").alias("place"))
    word = ["field", "term", "block"]
    sizes = rows.groupBy(*word).agg(F.count("*").alias("n"))
    placed = rows.join(sizes, word)
    dense = placed.where(F.col("n") > DENSE_DOCUMENTS).groupBy(*word, "n").agg(F.bitmap_construct_agg("place").alias("bits"))
    sparse = placed.where(F.col("n") <= DENSE_DOCUMENTS).groupBy(*word, "n").agg(F.sort_array(F.collect_list("place")).alias("places"))
    both = sparse.unionByName(dense, allowMissingColumns=True).select("field", "term", "block", "n", "places", "bits")
    both.repartitionByRange(*word).sortWithinPartitions(*word).write.parquet(path)


def read_bitmaps(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def candidate_bitmaps(bitmaps: DataFrame, queries: DataFrame, joined: bool = False) -> DataFrame:
    """(query_id, block, bits): the documents that hold any word of each query (query_id, query).

    Null is a query id like any other; queries that find nothing have no row.
    """
    asked = queries.select("query_id", F.explode(tokens(F.col("query"), joined)).alias("term")).distinct()
    hits = bitmaps.join(asked, "term").select("query_id", "block", "places", "bits")
    whole = hits.where("bits IS NOT NULL").select("query_id", "block", "bits")
    listed = hits.where("places IS NOT NULL").select("query_id", "block", F.explode("places").alias("place"))
    made = listed.groupBy("query_id", "block").agg(F.bitmap_construct_agg("place").alias("bits"))
    return whole.unionByName(made).groupBy("query_id", "block").agg(F.bitmap_or_agg("bits").alias("bits"))


def candidate_counts(candidates: DataFrame) -> DataFrame:
    """(query_id, n): how many documents each query has, from bits alone."""
    return candidates.groupBy("query_id").agg(F.sum(F.bitmap_count("bits")).alias("n"))


def candidate_documents(candidates: DataFrame, docs: DataFrame, id_column: str) -> DataFrame:
    """The rows of ``docs`` that are a candidate of any query: blocks meet by number, then a bit is looked up."""
    of_all = candidates.groupBy(F.col("block").alias("_block")).agg(F.bitmap_or_agg("bits").alias("_bits"))
    place = F.bitmap_bit_position(id_column).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("getbit", byte, (place % 8).cast("int"))
    return docs.join(of_all, F.bitmap_bucket_number(id_column) == F.col("_block")).where(bit == 1).select(*docs.columns)
