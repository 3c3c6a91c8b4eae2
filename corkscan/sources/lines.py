"""Read and write line and JSON files, and number their rows in file order."""

from __future__ import annotations

import re
import urllib.parse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corkscan.functions.text import strip
from corkscan.storage import materialise

# The table of input splits, four numbers each, is broadcast up to so many rows;
# a larger one is joined by shuffle, where Spark splits the rows of a large file.
MANY_SPLITS = 2_000_000


def non_empty(df: DataFrame, what: str) -> DataFrame:
    """``df``, or an error if it has no rows; looks at one row only."""
    if df.isEmpty():
        raise ValueError(f"no data found in {what}")
    return df


def numbered(df: DataFrame) -> DataFrame:
    """Add ``position``: rows of a file source counted from 1, in file order.

    Rows are counted per input split, and only the table of splits, one row for
    each, is put in order. It is written out, and broadcast unless it is large:
    a compressed file is one split, however much of the input it holds.
    """
    file, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    placed = df.select("*", F.monotonically_increasing_id().alias("_row"), F.xxhash64(file).alias("_file"), start.alias("_start"))
    named = df.select(F.monotonically_increasing_id().alias("_row"), file.alias("_path"), start.alias("_start"))
    splits = named.groupBy("_path", "_start").agg(F.min("_row").alias("_first"), F.count("*").alias("_rows"))
    earlier = Window.orderBy("_path", "_start").rowsBetween(Window.unboundedPreceding, -1)
    before = splits.select(F.xxhash64("_path").alias("_file"), "_start", "_first",
                           F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    before = materialise(before, "splits")
    if before.count() <= MANY_SPLITS:
        before = F.broadcast(before)
    joined = placed.join(before, ["_file", "_start"])
    position = (F.col("_before") + F.col("_row") - F.col("_first") + 1).alias("position")
    return joined.select(*df.columns, position)


def first_rows(df: DataFrame, count: int) -> DataFrame:
    """The first ``count`` rows by ``position``; 0 or less means all."""
    return df.where(F.col("position") <= count) if count > 0 else df


def read_json_lines(spark: SparkSession, path: str | list[str], with_position: bool = False) -> DataFrame:
    """(raw[, position]): one JSON record per line, plain or compressed.

    A gzip file cannot be split: where there are fewer such files than cores,
    the lines are spread out right after they are read.
    """
    lines = spark.read.text(path)
    files = lines.inputFiles()
    lines = lines.where(strip(F.col("value")) != "")  # blank lines are no records, and have no number
    rows = (numbered(lines) if with_position else lines).withColumnRenamed("value", "raw")
    cores = spark.sparkContext.defaultParallelism
    if len(files) < cores and any(f.endswith(".gz") for f in files):
        rows = rows.repartition(cores)
    return rows


def read_first_json_lines(spark: SparkSession, path: str, count: int) -> DataFrame:
    """(raw, position): the first ``count`` records, 0 or less meaning all; files after the last one needed are not opened.

    Records are counted file by file in path order, in steps of twice as many files
    as before, until there are enough. The driver holds the counts of one step.
    """
    if count <= 0:
        return read_json_lines(spark, path, with_position=True)
    files = sorted(spark.read.text(path).inputFiles())
    taken, found, step = [], 0, 1
    while found < count and len(taken) < len(files):
        more = files[len(taken) : len(taken) + step]
        lines = spark.read.text(_as_paths(more)).where(strip(F.col("value")) != "")
        rows = {_place(row["file"]): row["n"] for row in lines.groupBy(F.col("_metadata.file_path").alias("file")).agg(
            F.count("*").alias("n")).collect()}
        for file in more:
            if found < count:
                taken.append(file)
                found += rows.get(_place(file), 0)
        step *= 2
    return first_rows(read_json_lines(spark, _as_paths(taken) or path, with_position=True), count)


def _place(file: str) -> tuple[str, ...]:
    """What a file is told by, however many slashes stand behind its scheme."""
    return tuple(urllib.parse.urlsplit(file)[:3])


def _as_paths(files: Sequence[str]) -> list[str]:
    """Paths that name just these files, given as Spark lists them."""
    return [re.sub(r"([*?{}\[\]\\])", r"\\\1", urllib.parse.unquote(file)) for file in files]


def read_json_array(spark: SparkSession, path: str, fields: Sequence[str]) -> DataFrame:
    """The listed fields of the elements of files that each hold one JSON array.

    A file is read whole by one task: an array cannot be split. Values stay
    variants: a key that is not there is NULL, a null value is not.
    """
    schema = ", ".join(f"`{name}` VARIANT" for name in fields)
    return spark.read.option("multiLine", True).schema(schema).json(path)


def with_dense_id(records: DataFrame) -> DataFrame:
    """Add ``position`` and set ``id``: counted from 1 in file order, unless the
    record brings an id of its own."""
    own = F.try_variant_get("id", "$", "bigint")
    rows = numbered(records if "id" in records.columns else records.withColumn("id", F.lit(None).cast("variant")))
    return rows.withColumn("id", F.when(F.col("id").isNull(), F.col("position")).otherwise(own))


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists", keep_nulls: bool = True) -> None:
    """One JSON object per row, gzip; null columns are written as null or left out."""
    df.write.mode(mode).option("compression", "gzip").option("ignoreNullFields", not keep_nulls).json(path)


def read_query_lines(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query): stripped lines that are not blank, counted from 1 in file order."""
    lines = spark.read.text(path).where(strip(F.col("value")) != "")
    queries = numbered(lines).select(F.col("position").alias("query_id"), strip(F.col("value")).alias("query"))
    return non_empty(queries, path)
