"""Published tables: append, replace, upsert by key, and the checks before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corkscan.functions.vectors import checked_size
from corkscan.sources.versions import read_if_there

CREATE, APPEND, OVERWRITE = "errorifexists", "append", "overwrite"
# Of stored texts, this takes about two thirds of what Spark's default does.
COMPRESSION = "zstd"


def with_vector_size(df: DataFrame, dim: int) -> DataFrame:
    """Check every vector's size as it is written, and note it in the schema."""
    return df.withColumn("vector", checked_size(F.col("vector"), dim)).withMetadata("vector", {"dim": dim})


def vector_size(table: DataFrame) -> int | None:
    """The size noted in the schema; for a table without a note, that of one row."""
    if "vector" not in table.columns:
        return None
    noted = table.schema["vector"].metadata.get("dim")
    if noted is None:
        row = table.where("vector IS NOT NULL").select(F.size("vector")).first()
        noted = row[0] if row else None
    return noted


def require_vector_size(table: DataFrame, dim: int) -> DataFrame:
    """``table``, or an error if its vectors are of another size."""
    found = vector_size(table)
    if found is not None and found != dim:
        raise ValueError(f"the table has vectors of size {found}, this load writes size {dim}; replace the table")
    return table


def wrong_sizes(table: DataFrame, dim: int) -> DataFrame:
    """(size, n): how many vectors are of another size, for a table without a note."""
    sizes = table.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n"))
    return sizes.where(F.col("size") != dim)


def write_table(df: DataFrame, path: str, mode: str = CREATE, partition_by: str | None = None, spread: bool = True) -> None:
    """Write ``df`` as Parquet; running an append twice repeats its rows.

    Where a partition column is given, its folders are written in files of even
    size: Spark splits a folder that holds a third of the rows. That shuffles them,
    unless ``spread`` is false because they are dealt by that column already.
    """
    if partition_by is None:
        df.write.mode(mode).option("compression", COMPRESSION).parquet(path)
    else:
        rows = df.hint("rebalance", partition_by) if spread else df
        rows.write.mode(mode).option("compression", COMPRESSION).partitionBy(partition_by).parquet(path)


def append_vectors(df: DataFrame, path: str, dim: int, mode: str = APPEND) -> None:
    """Add records with vectors to a table, which must hold vectors of that size."""
    if mode == APPEND:
        existing = read_if_there(df.sparkSession, path)
        if existing is not None:
            require_vector_size(existing, dim)
    write_table(with_vector_size(df, dim), path, mode)


def latest(batch: DataFrame, key: str, order: Column) -> DataFrame:
    """The last row of each key; a hot key is one row per task before the shuffle."""
    whole = F.struct(*batch.columns)
    return batch.groupBy(key).agg(F.max_by(whole, order).alias("row")).select("row.*")


def superseded(keys: DataFrame, key: str, order: str) -> DataFrame:
    """The rows of ``keys`` but for the last one of each key, by ``order``, which does not repeat.

    Needs these two columns only, where ``latest`` shuffles whole rows.
    """
    last = keys.groupBy(F.col(key).alias("_key")).agg(F.max(order).alias("_last"), F.count("*").alias("_n")).where("_n > 1")
    return keys.join(last, F.col(key).eqNullSafe(F.col("_key"))).where(F.col(order) < F.col("_last")).select(*keys.columns)


def upsert(table: DataFrame, batch: DataFrame, key: str, order: Column, keys: DataFrame | None = None) -> DataFrame:
    """``table`` with the rows of ``batch`` put in by key.

    ``table`` holds one row per key, so only the batch is grouped; of the table,
    only keys are compared. Where ``batch`` holds one row per key, too, ``keys`` are
    its keys, and its rows stay where they are.
    """
    new = (latest(batch, key, order) if keys is None else batch).select(*table.columns)
    kept = table.join(batch.select(key).distinct() if keys is None else keys, key, "left_anti").select(*table.columns)
    return kept.unionByName(new)


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_by_id(records: DataFrame, path: str, buckets: int, mode: str = CREATE) -> None:
    """Write records in folders by hash of the id, so that few ids touch few folders."""
    placed = records.withColumn("id_bucket", bucket_of(F.col("id"), buckets))
    spread = placed.hint("rebalance", "id_bucket").sortWithinPartitions("id_bucket", "id")
    spread.write.mode(mode).partitionBy("id_bucket").parquet(path)


def require_no_rejects(rejects: DataFrame) -> None:
    """Stop before anything is published if a row was rejected; show the first."""
    first = rejects.limit(1).collect()
    if first:
        raise ValueError(f"rejected rows, nothing was written; first: {first[0].asDict()}")
