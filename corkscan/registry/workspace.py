"""Inputs that several checks share, made once per application and data folder.

Record lines are put together by Spark from the given tables and written to the
shared folder; indexes are built and published there. Each is made the first
time it is asked for.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corkscan.functions.encoders import HashingEncoder
from corkscan.functions.text import strip
from corkscan.operators import embedding, partitioned, quantised, text_index, validation
from corkscan.registry.fixed import DOCUMENT_LINES, KEYWORD_LINES
from corkscan.schemas import ANALYZED_FIELDS
from corkscan.sources.lines import read_json_lines
from corkscan.sources.tables import write_by_id
from corkscan.storage import materialise, new_path, shuffles_dropped

DIM = 64  # size of the vectors in the table ``embeddings``
BUCKETS = 8
PARTITIONS = 16
SQL_STEPS = 2

_workspaces: dict[tuple[str, str], "Workspace"] = {}


def workspace(spark: SparkSession, sf_dir: str) -> "Workspace":
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _workspaces:
        _workspaces[key] = Workspace(spark, sf_dir)
    return _workspaces[key]


def query_frame(spark: SparkSession, lines: Sequence[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(lines)), "query_id BIGINT, query STRING")


def in_key_order(df: DataFrame, key: str) -> DataFrame:
    """Spread rows so that files, taken by name, hold them in the order of ``key``."""
    return df.repartitionByRange(key).sortWithinPartitions(key)


class Workspace:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # --- record lines --------------------------------------------------------

    def review_parts(self, kept: DataFrame | None = None) -> DataFrame:
        """The values that the record lines are put together from, or those of the ids ``kept`` only."""
        part, documents, supplier, customer = map(self.table, ("part", "documents", "supplier", "customer"))
        nation = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        key = F.col("p_partkey")
        if kept is not None:
            part = part.join(kept.select((F.col("id") - 1).alias("p_partkey")), "p_partkey", "left_semi")
        # The texts come last: each join that is not broadcast shuffles the rows that it has so far.
        return (
            part
            .join(nation.select("n_nationkey", "n_name", "r_name"), F.col("n_nationkey") == key % 25)
            .join(supplier.select("s_suppkey", "s_name"), F.col("s_suppkey") == key % supplier.count())
            .join(customer.select("c_custkey", "c_name"), F.col("c_custkey") == key % customer.count())
            .join(documents.select("doc_id", "text"), F.col("doc_id") == key % documents.count())
        )

    def review_lines(self, kept: DataFrame | None = None) -> DataFrame:
        """(id, value): one line per part, or per part whose id is among ``kept``, some with missing, odd or broken values."""
        key = F.col("p_partkey")
        every = lambda n: key % n == 0
        null = F.lit(None).cast("string")
        keyword = F.element_at(F.array(*map(F.lit, KEYWORD_LINES)), (key % len(KEYWORD_LINES) + 1).cast("int"))
        points = (80 + F.col("p_size") % 21).cast("string")
        title = F.concat("p_name", F.lit("  "), "p_brand")
        country = (
            F.when(key % 7 == 0, null).when(key % 7 == 1, "").when(key % 7 == 2, "null").when(key % 7 == 3, "  ")
            .otherwise(F.col("n_name"))
        )

        def entry(name: str, value: Column, present: Column = F.lit(True)) -> Column:
            pair = F.to_json(F.struct(value.alias(name)), {"ignoreNullFields": "false"})
            return F.when(present, _inside(pair))

        entries = [
            entry("points", F.when(every(23), "x").when(every(29), F.concat(points, F.lit(".0"))).otherwise(points)),
            entry("title", F.when(every(31), null).when(every(37), F.concat(F.lit("\t"), title, F.lit(" "))).otherwise(title)),
            entry("description", F.when(every(41), null).otherwise(F.concat(keyword, F.lit(" "), "text"))),
            entry("taster_name", F.col("c_name")),
            entry("taster_twitter_handle", F.concat(F.lit("@"), key.cast("string"))),
            entry("price", F.when(every(11), F.lit(None).cast("double")).otherwise(F.col("p_retailprice")), ~every(43)),
            entry("designation", F.col("p_brand"), key % 2 == 0),
            entry("vineyard", F.col("p_brand"), key % 2 == 1),
            entry("variety", F.when(every(13), null).when(every(17), "").otherwise(F.col("p_type"))),
            entry("region_1", F.col("p_type")),
            entry("region_2", null),
            entry("province", F.col("r_name")),
            entry("country", country, key % 7 != 4),
            entry("winery", F.col("s_name")),
            entry("vintage", 1990 + F.col("p_size") % 30, every(5)),
            entry("notes", F.when(every(10), null).otherwise(F.col("p_type")), every(5)),
            entry("grapes", F.struct(F.col("p_size").alias("share"), (key % 2 == 0).alias("red")), every(5)),
            entry("id", key + 1),
        ]
        line = F.concat(F.lit("{"), F.concat_ws(",", *entries), F.lit("}"))
        return self.review_parts(kept).select((key + 1).alias("id"), F.when(every(47), F.col("p_name")).otherwise(line).alias("value"))

    @functools.cached_property
    def reviews_path(self) -> str:
        path = new_path(self.spark, "reviews")
        with shuffles_dropped(self.spark):
            in_key_order(self.review_lines(), "id").select("value").write.option("compression", "gzip").text(path)
        return path

    @functools.cached_property
    def loose_reviews_path(self) -> str:
        """The same lines in no order, for what needs none: their texts are shuffled once less."""
        if "reviews_path" in self.__dict__:
            return self.reviews_path
        path = new_path(self.spark, "loose-reviews")
        with shuffles_dropped(self.spark):
            self.review_lines().select("value").write.option("compression", "gzip").text(path)
        return path

    def valid_records(self) -> DataFrame:
        """The valid records as they are read from the lines, without storing them."""
        return validation.accepted(validation.check_records(read_json_lines(self.spark, self.loose_reviews_path)))

    def checked(self, fill: str = validation.FILL_FALSY) -> DataFrame:
        return validation.check_records(read_json_lines(self.spark, self.reviews_path), fill)

    @functools.cached_property
    def _valid_ids(self) -> DataFrame:
        lines = self.review_lines().select(F.col("value").alias("raw")).where(strip(F.col("value")) != "")
        with shuffles_dropped(self.spark):
            return materialise(validation.accepted(validation.check_records(lines)).select("id"), "valid")

    def valid_ids(self) -> DataFrame:
        """The ids of the valid records, told as the lines are put together: only ids are stored."""
        return self._valid_ids

    @functools.cached_property
    def records_path(self) -> str:
        """The valid records, written in folders by hash of the id."""
        path = new_path(self.spark, "records")
        write_by_id(validation.accepted(self.checked()), path, BUCKETS)
        return path

    def records(self) -> DataFrame:
        return self.spark.read.parquet(self.records_path)

    # --- text indexes --------------------------------------------------------

    @functools.cached_property
    def document_index(self) -> text_index.TextIndex:
        return text_index.build_text_index(self.table("documents"), new_path(self.spark, "documents"), "doc_id", ["text"])

    @functools.cached_property
    def changed_index(self) -> text_index.TextIndex:
        """The documents, every seventh one deleted, every third one changed, and every fifth one there again under a new id."""
        docs = self.table("documents").select("doc_id", "text", "source")
        first = text_index.build_text_index(docs, new_path(self.spark, "changed"), "doc_id", ["text"])
        fewer = text_index.delete_from_text_index(first, docs.where(F.col("doc_id") % 7 == 1), "doc_id")
        changed = docs.where(F.col("doc_id") % 3 == 0).withColumn("text", F.concat_ws(" ", "source", "text"))
        again = docs.where(F.col("doc_id") % 5 == 0).withColumn("doc_id", F.col("doc_id") + 1_000_000_000)
        return text_index.upsert_text_index(fewer, changed.unionByName(again), "doc_id")

    @functools.cached_property
    def compacted_index(self) -> text_index.TextIndex:
        return text_index.compact_text_index(self.changed_index)

    @functools.cached_property
    def record_index(self) -> text_index.TextIndex:
        return text_index.build_text_index(self.records(), new_path(self.spark, "record-index"), "id", ANALYZED_FIELDS)

    def document_queries(self) -> DataFrame:
        return query_frame(self.spark, DOCUMENT_LINES)

    def keyword_queries(self) -> DataFrame:
        return query_frame(self.spark, KEYWORD_LINES)

    def benchmark_queries(self) -> DataFrame:
        return self.table("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))

    # --- vectors -------------------------------------------------------------

    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))

    def label_means(self) -> DataFrame:
        """(text_id, vector): the mean vector of each label, as query vectors."""
        cells = self.table("embeddings").select("label", F.posexplode("embedding"))
        means = cells.groupBy("label", "pos").agg(F.round(F.avg(F.col("col").cast("double")), 6).alias("x"))
        in_order = F.array_sort(F.collect_list(F.struct("pos", "x")))
        vectors = means.groupBy("label").agg(F.transform(in_order, lambda p: p["x"].cast("float")).alias("vector"))
        return vectors.select(F.col("label").cast("bigint").alias("text_id"), "vector")

    def document_vectors(self) -> DataFrame:
        return self._document_vectors

    @functools.cached_property
    def _document_vectors(self) -> DataFrame:
        docs = self.table("documents").select(F.col("doc_id").alias("id"), "text")
        embedded = embedding.embed_documents(docs, "text", HashingEncoder(DIM), DIM)
        return materialise(embedded.select("id", "vector"), "document-vectors")

    @functools.cached_property
    def centroids(self):
        return partitioned.train_centroids(self.vectors(), PARTITIONS)

    def assigned(self) -> DataFrame:
        """The vectors with their partitions, stored: training and searches read them many times,
        and each Python step that follows another in one task is one more process."""
        return self._assigned

    @functools.cached_property
    def _assigned(self) -> DataFrame:
        return materialise(partitioned.assign_partitions(self.vectors(), self.centroids), "assigned")

    @functools.cached_property
    def model(self) -> quantised.Quantiser:
        return quantised.train_words(self.assigned(), self.centroids)

    @functools.cached_property
    def plain_centroids(self):
        """The vectors of the lowest ids: centroids that SQL can tell as well, not trained."""
        return partitioned.lowest_id_centroids(self.vectors(), PARTITIONS)

    def plainly_assigned(self) -> DataFrame:
        return self._plainly_assigned

    @functools.cached_property
    def _plainly_assigned(self) -> DataFrame:
        return materialise(partitioned.assign_partitions(self.vectors(), self.plain_centroids), "plainly-assigned")

    @functools.cached_property
    def stepped_centroids(self):
        """The vectors of the lowest ids after two steps of training: so few that they can be written out in SQL."""
        return partitioned.train_centroids(self.vectors(), PARTITIONS, SQL_STEPS, start=self.plain_centroids)

    @functools.cached_property
    def plain_model(self) -> quantised.Quantiser:
        return quantised.lowest_id_words(self.plainly_assigned(), self.plain_centroids)

    # --- query log -----------------------------------------------------------

    def query_log(self) -> DataFrame:
        """The table ``events`` read as a log: event types as searches, three trials."""
        return self.table("events").select(
            F.col("event_type").alias("search"), (F.col("event_id") % 3).cast("int").alias("trial"),
            F.col("event_id").alias("query_id"), (F.col("event_type") != "error").alias("ok"),
            F.col("value").alias("latency_ms"))

    def trial_elapsed(self) -> DataFrame:
        seconds = F.round(F.sum("latency_ms") / 1000.0, 6)
        return self.query_log().groupBy("search", "trial").agg(seconds.alias("elapsed_s"))


def _inside(pair: Column) -> Column:
    """The text between the braces of a JSON object."""
    return pair.substr(F.lit(2), F.length(pair) - 2)
