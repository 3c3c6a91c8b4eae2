"""Throughput and latency figures from a query log."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corkscan.operators.workload import NUM_QUERIES, SEED, WARMUP_QUERIES
from corkscan.storage import materialise

# The percentiles reported, the figures averaged and the layout of
# a report row.
PERCENTILES = (50, 95, 99)
FIGURES = ("success", "elapsed_s", "qps", "p50_ms", "p95_ms", "p99_ms")
REPORT_HEADER = (
    "| search | queries | runs | success_avg | elapsed_s_avg | qps_avg | p50_ms_avg | p95_ms_avg | p99_ms_avg "
    "| max_concurrency | seed | warmup_queries |"
)
REPORT_PLACES = {"success": 2, "elapsed_s": 4, "qps": 2, "p50_ms": 2, "p95_ms": 2, "p99_ms": 2}
MAX_CONCURRENCY = 16

# Precision of the sketch that brackets each percentile, and how far on either
# side (in that precision) the exact value is looked for first.
SKETCH_ACCURACY = 20_000
FIRST_SLACK = 2.0


def join_groups(one: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``one`` with the columns of ``other`` for the same group; null is a group like any other."""
    renamed = other.withColumnsRenamed({key: f"_{key}" for key in keys})
    same = functools.reduce(operator.and_, [one[key].eqNullSafe(renamed[f"_{key}"]) for key in keys])
    return one.join(renamed, same, how).drop(*(f"_{key}" for key in keys))


def _brackets(log: DataFrame, keys: Sequence[str], value: str, percentiles: Sequence[float], slack: float) -> DataFrame:
    """(keys, n, brackets): for each percentile, ranks and a range that should hold them."""
    width = slack / SKETCH_ACCURACY
    points = [min(max(p / 100.0 + side * width, 0.0), 1.0) for p in percentiles for side in (-1, 1)]
    sketch = log.groupBy(*keys).agg(
        F.count(value).alias("n"), F.percentile_approx(value, points, SKETCH_ACCURACY).alias("bounds"))
    rank = [F.lit(p / 100.0) * (F.col("n") - 1) for p in percentiles]
    return sketch.where("n > 0").select(*keys, "n", F.array(*[
        F.struct(
            F.lit(float(p)).alias("p"), rank[i].alias("rank"),
            F.col("bounds")[2 * i].alias("low"), F.col("bounds")[2 * i + 1].alias("high"))
        for i, p in enumerate(percentiles)
    ]).alias("brackets"))


def percentiles(log: DataFrame, keys: Sequence[str], value: str, wanted: Sequence[float] = PERCENTILES) -> DataFrame:
    """(keys, p, value): exact percentiles of each group, by linear interpolation.

    No group is brought together: a sketch names a narrow range around each
    percentile; values below it only count, and the few within it are put in
    order. If a range turns out not to hold the ranks, it is widened.
    """
    slack = FIRST_SLACK
    while True:
        found = materialise(_within_brackets(log, keys, value, wanted, slack), "percentiles")
        if found.where("NOT held").isEmpty():
            return found.drop("held")
        slack *= 16.0


def _within_brackets(log: DataFrame, keys: Sequence[str], value: str, wanted: Sequence[float], slack: float) -> DataFrame:
    rows = log.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_value"))
    brackets = materialise(_brackets(rows, keys, "_value", wanted, slack), "brackets")
    near = F.filter("brackets", lambda b: F.col("_value") <= b["high"])
    # One row per percentile; all values below its range share the NULL key.
    seen = join_groups(rows, brackets, keys).select(*keys, "n", "_value", F.inline(near))
    key = F.when(F.col("_value") >= F.col("low"), F.col("_value"))
    counted = seen.groupBy(*keys, "n", "p", "rank", key.alias("_key")).agg(F.count("*").alias("c"))
    in_order = Window.partitionBy(*keys, "p").orderBy(F.asc_nulls_first("_key"))
    running = counted.withColumn("upto", F.sum("c").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    low = F.floor("rank")
    high = F.least(low + 1, F.col("n") - 1)
    weight = F.col("rank") - low
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("_key")))
    held = F.coalesce(F.max(F.when(F.col("_key").isNull(), F.col("upto"))), F.lit(0)) <= F.max(low)
    picked = running.groupBy(*keys, "p").agg(
        at(low).alias("a"), at(high).alias("b"), F.max(weight).alias("w"),
        (held & (F.max("upto") > F.max(high))).alias("held"))
    return picked.select(*keys, "p", (F.col("a") * (1.0 - F.col("w")) + F.col("b") * F.col("w")).alias("value"), "held")


def trial_metrics(log: DataFrame, elapsed: DataFrame, num_queries: int = NUM_QUERIES) -> DataFrame:
    """(search, trial, figures): what each trial of each search came to.

    ``log`` holds search, trial, ok and latency_ms; ``elapsed`` search, trial and
    elapsed_s. Throughput is ``num_queries`` over the elapsed time, whatever
    succeeded; a trial without latencies reports 0.
    """
    keys = ["search", "trial"]
    success = log.groupBy(*keys).agg(F.sum(F.col("ok").cast("double")).alias("success"))
    wide = percentiles(log, keys, "latency_ms").groupBy(*keys).agg(*[
        F.max(F.when(F.col("p") == p, F.col("value"))).alias(f"p{p}_ms") for p in PERCENTILES
    ])
    rows = join_groups(join_groups(elapsed, success, keys, "left"), wide, keys, "left")
    return rows.select(
        *keys,
        F.coalesce("success", F.lit(0.0)).alias("success"),
        "elapsed_s",
        F.when(F.col("elapsed_s") > 0, F.lit(float(num_queries)) / F.col("elapsed_s"))
        .otherwise(F.lit(float("inf"))).alias("qps"),
        *[F.coalesce(f"p{p}_ms", F.lit(0.0)).alias(f"p{p}_ms") for p in PERCENTILES],
    )


def trial_averages(metrics: DataFrame) -> DataFrame:
    """(search, runs, figures): the mean of each figure over the trials."""
    return metrics.groupBy("search").agg(
        F.count("*").alias("runs"), *[F.avg(name).alias(f"{name}_avg") for name in FIGURES])


def _fixed(value: Column, places: int) -> Column:
    """A number with fixed decimals, halves rounded away from zero."""
    number = F.round(F.round(value, 6).try_cast("decimal(28,6)"), places).cast(f"decimal(28,{places})").cast("string")
    return F.when(value == float("inf"), F.lit("inf")).otherwise(number)


def report_rows(averages: DataFrame, num_queries: int = NUM_QUERIES, max_concurrency: int = MAX_CONCURRENCY,
                seed: int = SEED, warmup: int = WARMUP_QUERIES) -> DataFrame:
    """(search, line): one table row per search, under ``REPORT_HEADER``."""
    cells = [
        F.col("search"), F.lit(num_queries), F.col("runs"),
        *[_fixed(F.col(f"{name}_avg"), REPORT_PLACES[name]) for name in FIGURES],
        F.lit(max_concurrency), F.lit(seed), F.lit(warmup),
    ]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[c.cast("string") for c in cells]), F.lit(" |"))
    return averages.select("search", line.alias("line"))
