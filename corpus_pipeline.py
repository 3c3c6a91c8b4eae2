"""The training corpus: documents filtered, freed of copies and leaks, and put into tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corkscan.llm import bag_minhash, bpe, content_sort, templates, toxicity
from corkscan.llm.common import table
from corkscan.llm.registry import toxicity_model
from corkscan.shipping import ship
from corkscan.storage import materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold go."""
    ship(spark)
    scored = toxicity.score(docs, toxicity_model(docs, table(spark, sf_dir, "labels")), score_col="_score")
    return scored.where(F.col("_score") < toxicity.THRESHOLD).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the one with the largest doc_id stays."""
    ship(spark)
    found = content_sort.find_copies(docs, carry=docs.columns, keep="largest")
    return found.where("kept").select("row.*")


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` but for the rows with these keys: rows that share an identifier, or have none, are told apart by their texts."""
    rows = docs.select(bag_minhash.row_key("doc_id", "text").alias("key"), F.struct(*docs.columns).alias("row"))
    return bag_minhash.keep_ids(rows, "key", keys.select(F.col("key").alias("gone")), "left_anti").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates, the document with the smallest doc_id stays; one without an identifier only if all are."""
    ship(spark)
    others = bag_minhash.near_duplicate_rows(docs).where("NOT kept").select("key").distinct()
    return _without(docs, materialise(others, "near-copies"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; those that hold one of a few words among others stay."""
    ship(spark)
    told = docs.select(bag_minhash.row_key("doc_id", "text").alias("key"), "text")
    leaks = templates.find_leaks(told, table(spark, sf_dir, "benchmark"), id_col="key")
    return _without(docs, materialise(leaks.where("evidence").select("key").distinct(), "leaking"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their tokens; texts are what the tokens decode to."""
    ship(spark)
    encoded = bpe.encode(docs, decoded_col="decoded")
    return encoded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("bigint").alias("n_tokens"), "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontaminate),
    ("tokens", to_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again before the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
