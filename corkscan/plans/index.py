"""Build, open and add to a vector index: vectors, codes, centroids and code words on disk.

Vectors and codes lie in batches, one folder for the rows that were there when the
model was trained and one for each append; a version names its batches. Appends
leave older batches as they are. Each batch carries its drift: how much farther its
vectors lie from what their codes stand for than those of the first batch did. An
index that has drifted far wants to be built anew.
"""

from __future__ import annotations

import dataclasses
import functools
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corkscan.functions.matrices import list_array, matrix
from corkscan.operators import partitioned, quantised
from corkscan.sources.tables import require_vector_size, write_table
from corkscan.sources.versions import folders, newest, next_version, publish, version_path


VECTORS_SCHEMA = "id BIGINT, vector ARRAY<FLOAT>, part_id INT"
CODES_SCHEMA = "id BIGINT, codes ARRAY<SMALLINT>, part_id INT"
CENTROIDS_SCHEMA = "part_id INT, centroid ARRAY<DOUBLE>"
WORDS_SCHEMA = "m INT, code INT, word ARRAY<DOUBLE>"
DRIFT_SCHEMA = "n BIGINT, residual DOUBLE"


@dataclasses.dataclass(frozen=True)
class VectorIndex:
    """A published vector index; its tables are stored in folders by ``part_id``."""

    path: str
    model: quantised.Quantiser
    vectors: DataFrame
    codes: DataFrame
    root: str = ""
    version: int = 0
    batches: tuple[str, ...] = ()

    def drift(self) -> DataFrame:
        """(batch, n, residual, drift): the vectors of each batch, the mean squared distance of a unit vector from
        the decoded one, and this figure over that of the first batch; null if that is zero or the batch is empty."""
        spark = self.vectors.sparkSession
        found = [spark.read.schema(DRIFT_SCHEMA).parquet(f"{self.root}/{name}/drift").withColumn("batch", F.lit(at))
                 for at, name in enumerate(self.batches)]
        rows = functools.reduce(DataFrame.unionByName, found)
        first = found[0].select(F.col("residual").alias("first"))
        return rows.join(F.broadcast(first)).select(  # one row
            "batch", "n", "residual", F.try_divide("residual", "first").alias("drift"))


def build_vector_index(vectors: DataFrame, root: str, partitions: int = partitioned.NUM_PARTITIONS,
                       sub_dim: int = quantised.SUB_DIM, words: int = quantised.WORDS,
                       iterations: int = partitioned.TRAINING_STEPS, replace: bool = False,
                       num_sub_vectors: int | None = None) -> VectorIndex:
    """Train on, assign and encode all ``vectors`` (id, vector) and publish the result.

    Sub-vectors have ``sub_dim`` numbers, or there are ``num_sub_vectors`` of them.

    An index that is there already is an error, unless ``replace`` is set: then
    the new one becomes its next version.
    """
    spark = vectors.sparkSession
    version = next_version(spark, root, replace)
    path = version_path(root, version)
    rows = vectors.select(F.col("id").cast("bigint").alias("id"), F.col("vector").cast("array<float>").alias("vector"))
    centroids = partitioned.train_centroids(rows, partitions, iterations)
    dim = centroids.shape[1]
    sub_dim = quantised.sub_vector_size(dim, num_sub_vectors or max(dim // sub_dim, 1))
    _centroid_rows(spark, centroids).coalesce(1).write.parquet(f"{path}/ivf_centroids")
    write_table(partitioned.assign_partitions(rows, centroids), f"{path}/vectors", partition_by="part_id")
    assigned = spark.read.schema(VECTORS_SCHEMA).parquet(f"{path}/vectors")
    model = quantised.train_words(assigned, centroids, sub_dim, words, iterations)
    write_table(_word_rows(spark, model.words).coalesce(1), f"{path}/pq_codebooks")
    write_table(quantised.encode(assigned, model), f"{path}/pq_codes", partition_by="part_id")
    quantised.residual_size(assigned, model).coalesce(1).write.parquet(f"{path}/drift")
    publish(spark, root, version)
    return open_vector_index(spark, root, version)


def append_vector_index(index: VectorIndex, vectors: DataFrame) -> VectorIndex:
    """Add ``vectors`` (id, vector), assigned and encoded with the model of the index, as its next version.

    Nothing is trained and no older file is written again. The result holds the same
    rows as the union assigned and encoded at once. As in every append, running it
    twice repeats its rows. An error if ``index`` is not the newest version.
    """
    spark, version = vectors.sparkSession, index.version + 1
    if newest(spark, index.root) != index.version:
        raise ValueError(f"{index.root} has a newer version than {index.version}: open that")
    # Another name for each try: what a broken-off append has written is not in the way.
    name = f"batch={version}-{uuid.uuid4().hex[:8]}"
    path = f"{index.root}/{name}"
    rows = vectors.select(F.col("id").cast("bigint").alias("id"), F.col("vector").cast("array<float>").alias("vector"))
    require_vector_size(rows, index.model.centroids.shape[1])
    write_table(partitioned.assign_partitions(rows, index.model.centroids), f"{path}/vectors", partition_by="part_id")
    assigned = spark.read.schema(VECTORS_SCHEMA).parquet(f"{path}/vectors")
    write_table(quantised.encode(assigned, index.model), f"{path}/pq_codes", partition_by="part_id")
    quantised.residual_size(assigned, index.model).coalesce(1).write.parquet(f"{path}/drift")
    publish(spark, index.root, version, [*index.batches, name])
    return open_vector_index(spark, index.root, version)


def _centroid_rows(spark: SparkSession, centroids: np.ndarray) -> DataFrame:
    return spark.createDataFrame(pa.table({
        "part_id": pa.array(range(len(centroids)), pa.int32()), "centroid": list_array(centroids, pa.float64()),
    }))


def _word_rows(spark: SparkSession, words: np.ndarray) -> DataFrame:
    subs, count, sub_dim = words.shape
    return spark.createDataFrame(pa.table({
        "m": pa.array(np.repeat(np.arange(subs), count), pa.int32()), "code": pa.array(np.tile(np.arange(count), subs), pa.int32()),
        "word": list_array(words.reshape(-1, sub_dim), pa.float64()),
    }))


def read_model(spark: SparkSession, path: str) -> quantised.Quantiser:
    centroids = spark.read.schema(CENTROIDS_SCHEMA).parquet(f"{path}/ivf_centroids").orderBy("part_id").toArrow()
    words = spark.read.schema(WORDS_SCHEMA).parquet(f"{path}/pq_codebooks")
    return quantised.quantiser(matrix(centroids["centroid"].combine_chunks()), words)


def open_vector_index(spark: SparkSession, root: str, version: int | None = None) -> VectorIndex:
    """The index under ``root``, at its newest version unless one is named."""
    version = newest(spark, root) if version is None else version
    if version is None:
        raise FileNotFoundError(f"no vector index under {root}")
    # The model lies with the batch it was trained on, and those added to it follow in their order.
    names = sorted(folders(spark, root, version), key=lambda name: (not name.startswith("version="), int(name.split("=")[1].split("-")[0])))
    path = f"{root}/{names[0]}"
    parts = [f"{root}/{name}" for name in names]
    return VectorIndex(
        path, read_model(spark, path), _batches(spark, VECTORS_SCHEMA, parts, "vectors"), _batches(spark, CODES_SCHEMA, parts, "pq_codes"),
        root, version, tuple(names))


def _batches(spark: SparkSession, schema: str, parts: Sequence[str], name: str) -> DataFrame:
    """A table that lies in several folders, each with folders by partition."""
    return functools.reduce(DataFrame.unionByName, [spark.read.schema(schema).parquet(f"{part}/{name}") for part in parts])
