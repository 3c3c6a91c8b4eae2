"""Percentiles of very large query logs from sketches that are stored and merged.

A sketch of the latencies is kept for each group and day, some tens of kilobytes
whatever the day holds. Any span of days is then a merge of its sketches, and the
log is not read again. Nulls are left out; null is a group like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corkscan.operators.metrics import PERCENTILES, join_groups
from corkscan.sources.versions import folders, newest, publish, version_path

# Size of a sketch. At this size a percentile is off by 0.13% of all ranks at most,
# with a chance of 99%; the error that is vouched for is four times that.
SKETCH_SIZE = 4_096
RANK_ERROR = 0.005


def sketch_log(log: DataFrame, keys: Sequence[str], value: str, day: Column, size: int = SKETCH_SIZE) -> DataFrame:
    """(keys, day, n, sketch): one sketch for each group and day; tasks send sketches, not rows."""
    rows = log.where(F.col(value).isNotNull()).select(*keys, day.alias("day"), F.col(value).cast("double").alias("_value"))
    return rows.groupBy(*keys, "day").agg(F.count("*").alias("n"), F.kll_sketch_agg_double("_value", size).alias("sketch"))


def append_sketches(sketches: DataFrame, root: str) -> None:
    """Publish ``sketches`` as the next batch under ``root``; earlier batches are not rewritten."""
    spark = sketches.sparkSession
    last = newest(spark, root)
    version = 0 if last is None else last + 1
    # What an attempt that failed has left in this folder is not published.
    sketches.write.mode("overwrite").parquet(version_path(root, version))
    kept = [] if last is None else folders(spark, root, last)
    publish(spark, root, version, [*kept, f"version={version}"])


def read_sketches(spark: SparkSession, root: str) -> DataFrame:
    """The sketches of all batches; a day may have several."""
    version = newest(spark, root)
    if version is None:
        raise FileNotFoundError(f"no sketches under {root}")
    return spark.read.parquet(*(f"{root}/{name}" for name in folders(spark, root, version)))


def merged_percentiles(sketches: DataFrame, keys: Sequence[str], wanted: Sequence[float] = PERCENTILES,
                       size: int = SKETCH_SIZE) -> DataFrame:
    """(keys, p, n, value): percentiles of the rows behind ``sketches``, within ``RANK_ERROR``."""
    merged = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", size).alias("sketch"))
    each = [F.struct(F.lit(float(p)).alias("p"), F.kll_sketch_get_quantile_double("sketch", F.lit(p / 100.0)).alias("value"))
            for p in wanted]
    return merged.select(*keys, "n", F.inline(F.array(*each))).select(*keys, "p", "n", "value")


def rank_errors(log: DataFrame, keys: Sequence[str], value: str, found: DataFrame) -> DataFrame:
    """(keys, p, n, error): how far the rank of each value in ``found`` is from the one asked for, as a share of all ranks.

    One pass over the log against a row for each group and percentile; equal values
    share a range of ranks, and any rank of it will do.
    """
    rows = log.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_value"))
    asked = found.groupBy(*keys).agg(F.collect_list(F.struct("p", "value")).alias("asked"))
    seen = join_groups(rows, asked, keys).select(*keys, "_value", F.inline("asked"))
    ranks = seen.groupBy(*keys, "p").agg(
        F.count("*").alias("n"), F.count_if(F.col("_value") < F.col("value")).alias("below"),
        F.count_if(F.col("_value") <= F.col("value")).alias("upto"))
    share = F.col("p") / 100.0
    error = F.greatest(F.lit(0.0), F.col("below") / F.col("n") - share, share - F.col("upto") / F.col("n"))
    return ranks.select(*keys, "p", "n", error.alias("error"))
