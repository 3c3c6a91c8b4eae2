"""Versions of a published table or index under one root folder.

A version is a list of folders, named last, in the small table ``published``;
readers take the newest version named there. New folders are written before that,
and folders of older versions may be named again. A job that fails on the way
leaves what is published as it was.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_if_there(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The Parquet table at ``path``, or None if there is none."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def newest(spark: SparkSession, root: str) -> int | None:
    published = read_if_there(spark, f"{root}/published", "version INT")
    return None if published is None else published.agg(F.max("version")).first()[0]


def folders(spark: SparkSession, root: str, version: int) -> list[str]:
    """The folders under ``root`` that a version is made of."""
    rows = read_if_there(spark, f"{root}/published", "version INT, folder STRING").where(F.col("version") == version)
    return sorted(row["folder"] for row in rows.select("folder").distinct().collect())


def version_path(root: str, version: int) -> str:
    return f"{root}/version={version}"


def next_version(spark: SparkSession, root: str, replace: bool) -> int:
    """The number for a new version; an error if there is one and it is to stay."""
    last = newest(spark, root)
    if last is not None and not replace:
        raise FileExistsError(f"{root} is published already; replace it or choose another folder")
    return 0 if last is None else last + 1


def publish(spark: SparkSession, root: str, version: int, names: Sequence[str] | None = None) -> None:
    """Name a version; it is the folder of its number unless ``names`` lists others."""
    rows = [(version, name) for name in (names or [f"version={version}"])]
    spark.createDataFrame(rows, "version INT, folder STRING").coalesce(1).write.mode("append").parquet(f"{root}/published")
