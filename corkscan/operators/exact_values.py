"""Exact match on fields that are kept whole, without scanning the records.

The values of all such fields lie in a table of (field, value, id), a folder for
each field, sorted by value, with Bloom filters: a lookup reads the folder of its
field and the row groups whose range and filter admit the value.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corkscan.schemas import KEYWORD_FIELDS

# Different values that the filter of one row group is laid out for.
FILTER_VALUES = 200_000


def build_value_table(records: DataFrame, path: str, id_column: str = "id", fields: Sequence[str] = KEYWORD_FIELDS) -> None:
    """Write the values of ``fields``; null values are left out.

    Rows are dealt by field, value and id, so a value that a third of all records
    have lies in as many files as it needs.
    """
    pairs = F.array(*[F.struct(F.lit(name).alias("field"), F.col(name).cast("string").alias("value")) for name in fields])
    rows = records.select(F.col(id_column).cast("bigint").alias("id"), F.inline(pairs)).where("value IS NOT NULL")
    placed = rows.repartitionByRange("field", "value", "id").sortWithinPartitions("field", "value", "id")
    (
        placed.write.partitionBy("field")
        .option("parquet.bloom.filter.enabled#value", "true")
        .option("parquet.bloom.filter.expected.ndv#value", str(FILTER_VALUES))
        .parquet(path)
    )


def read_value_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("value STRING, id BIGINT, field STRING").parquet(path)


def find_values(table: DataFrame, wanted: Sequence[tuple[str, str]]) -> DataFrame:
    """(field, value, id) of records whose field equals one of the wanted values (field, value)."""
    unknown = {field for field, _ in wanted} - set(KEYWORD_FIELDS)
    if unknown:
        raise ValueError(f"not kept whole: {sorted(unknown)}")
    by_field: dict[str, list[str]] = {}
    for field, value in wanted:
        by_field.setdefault(field, []).append(value)
    # One scan for each field, so that the filter on values reaches the files.
    parts = [table.where((F.col("field") == field) & F.col("value").isin(values)) for field, values in by_field.items()]
    return functools.reduce(DataFrame.unionByName, parts, table.limit(0)).select("field", "value", "id")
