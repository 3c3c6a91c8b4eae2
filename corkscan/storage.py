"""Where tables that jobs share are written.

Index tables and cut lineages live in the folder the cluster names in
``spark.checkpoint.dir``, which every executor can reach. Only when a session
names none, as in a local test, is a folder of our own chosen.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
# Whether the files of a shuffle go as soon as the job that made it has ended.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# So many rows of a stored table may be broadcast to be joined; each counts about 100 bytes on the driver.
FEW_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    named = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all executors can reach")
        named = tempfile.mkdtemp(prefix="corkscan-")
        spark.conf.set(CHECKPOINT_DIR, named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other job uses."""
    application = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/corkscan/{application}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with a table that outlives the executors that wrote it.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Jobs begun inside drop their shuffle files when they have ended.

    By default the files stay until the driver happens to collect its garbage: several
    jobs in a row over the same texts then hold as many copies of them on disk.
    """
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)


def by_rows(df: DataFrame) -> DataFrame:
    """``df``, to be joined by broadcast if it has few rows, and by shuffle otherwise.

    Left to itself, Spark takes the size of a stored table for what it takes in memory;
    where values repeat, that is hundreds of times as much, all of it on the driver.
    """
    return F.broadcast(df) if df.count() <= FEW_ROWS else df.hint("merge")
