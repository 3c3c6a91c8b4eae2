"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What Spark hands to a Python task at once, in bytes.
BATCH_BYTES = 4 << 20
# Rows that a Parquet reader holds at once; by default thousands, each with a whole text.
READ_ROWS = 512
# The texts that one step of a Python task holds at once, in bytes.
STEP_BYTES = 8 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, in whose session Python tasks now get batches of a few MB, however long its texts are."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; the session now reads Parquet ``READ_ROWS`` rows at a time, since texts are long."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) with null texts as empty ones; other columns are left behind,
    so that their names cannot clash with those that an operator adds."""
    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))


def give_back_memory() -> None:
    """Hand memory that Python has freed, as after training, back to the system; nothing where the C library cannot."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or one like it that no column of ``df`` has."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of ``column``; one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = batch.column(batch.schema.get_field_index(column)).nbytes
        rows = max(1, int(batch.num_rows * most / max(size, 1)))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def schema_of(df: DataFrame) -> str:
    """The columns of ``df`` as DDL."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
