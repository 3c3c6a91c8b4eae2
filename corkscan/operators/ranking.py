"""Top-k per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(rows: DataFrame, group: str, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group, numbered from 1 in ``rank``.

    Spark cuts each task's share of a group to k rows before it shuffles, so no
    group is ever brought together whole.
    """
    window = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
