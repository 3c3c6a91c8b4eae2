"""Read large JSON arrays in ranges of bytes, many tasks to a file.

A file is read in fragments between commas, which Spark cuts into splits of any size.
Which commas end an element depends on all that stands before: whether a string is
open, and how many brackets are. What a split does to this state is told by three
numbers (whether it opens or closes a string, and how many brackets it opens, once if
it begins outside of a string and once if it begins inside), and these compose. So
one pass tells the three numbers of each split, a prefix over the splits of each
file gives the state that every split begins with, and a second pass cuts out the
elements. Only the elements at the edges of splits are put together afterwards, file
by file: at most two pieces for each split.

A compressed file is one split. Elements are never cut short; one that is longer than
a split goes through several. An array with no elements gives no rows, and so does an
empty file. A file that begins with anything but ``[`` is an error. What is no JSON
inside of an array gives NULL in every field, as in Spark's own reader.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corkscan.sources.lines import MANY_SPLITS
from corkscan.storage import materialise

_ESCAPED = re.compile(r"\\.", re.DOTALL)
_OPENS, _CLOSES = re.compile(r"[\[{]"), re.compile(r"[\]}]")

_STATE_SCHEMA = "file BIGINT, path STRING, start BIGINT, flips INT, outside BIGINT, inside BIGINT"
_BEGIN_SCHEMA = "file BIGINT, path STRING, start BIGINT, quoted BOOLEAN, depth BIGINT"
_PIECE_SCHEMA = "file BIGINT, start BIGINT, at BIGINT, closed BOOLEAN, piece STRING"


def _change(fragment: str) -> tuple[int, int, int]:
    """(flips, outside, inside) of a fragment: see the module's text."""
    parts = _ESCAPED.sub("", fragment).split('"') if "\\" in fragment else fragment.split('"')
    deeper = [len(_OPENS.findall(part)) - len(_CLOSES.findall(part)) for part in parts]
    return (len(parts) - 1) % 2, sum(deeper[0::2]), sum(deeper[1::2])


def _then(before: tuple[int, int, int], after: tuple[int, int, int]) -> tuple[int, int, int]:
    """The change of one stretch and the next one together."""
    flips, outside, inside = before
    return (flips + after[0]) % 2, outside + after[2 if flips else 1], inside + after[1 if flips else 2]


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each split that a task reads."""
    split, change = None, (0, 0, 0)

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "file": pa.array([split[0]], pa.int64()), "path": pa.array([split[1]]), "start": pa.array([split[2]], pa.int64()),
            "flips": pa.array([change[0]], pa.int32()), "outside": pa.array([change[1]], pa.int64()), "inside": pa.array([change[2]], pa.int64())})

    for batch in batches:
        for file, path, start, value in zip(*(batch[name].to_pylist() for name in ("file", "path", "start", "value"))):
            if (file, path, start) != split:
                if split is not None:
                    yield row()
                split, change = (file, path, start), (0, 0, 0)
            change = _then(change, _change(value))
    if split is not None:
        yield row()


def _begin(splits: pa.Table) -> pa.Table:
    """The state that each split of a file begins with."""
    splits = splits.sort_by([("path", "ascending"), ("start", "ascending")])
    path, total, quoted, depth = None, (0, 0, 0), [], []
    for own, *change in zip(*(splits[name].to_pylist() for name in ("path", "flips", "outside", "inside"))):
        path, total = own, total if own == path else (0, 0, 0)
        quoted.append(bool(total[0]))
        depth.append(total[1])
        total = _then(total, tuple(change))
    return splits.select(["file", "path", "start"]).append_column("quoted", pa.array(quoted, pa.bool_())).append_column(
        "depth", pa.array(depth, pa.int64()))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces between commas that end an element, numbered within each split; the last one of a split is not closed."""
    split, parts, at, quoted, depth = None, [], 0, False, 0
    for batch in batches:
        rows: list[tuple] = []
        for file, start, begins_quoted, begins_deep, value in zip(*(
                batch[name].to_pylist() for name in ("file", "start", "quoted", "depth", "value"))):
            if (file, start) != split:
                if parts:
                    rows.append((*split, at, False, ",".join(parts)))
                split, parts, at, quoted, depth = (file, start), [], 0, begins_quoted, begins_deep
            flips, outside, inside = _change(value)
            depth += inside if quoted else outside
            quoted = quoted != bool(flips)
            parts.append(value)
            if not quoted and depth == 1:
                rows.append((*split, at, True, ",".join(parts)))
                parts, at = [], at + 1
        yield _pieces(rows)
    if parts:
        yield _pieces([(*split, at, False, ",".join(parts))])


def _pieces(rows: Sequence[tuple]) -> pa.RecordBatch:
    file, start, at, closed, piece = zip(*rows) if rows else ((), (), (), (), ())
    return pa.RecordBatch.from_pydict({
        "file": pa.array(file, pa.int64()), "start": pa.array(start, pa.int64()), "at": pa.array(at, pa.int64()),
        "closed": pa.array(closed, pa.bool_()), "piece": pa.array(piece, pa.string())})


def array_elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, at, element): the texts of all elements; ``start`` is the split that an element ends in, ``at`` its
    number there, from 0, and ``file`` a hash of the path."""
    text = spark.read.option("lineSep", ",").text(path)
    named = F.col("_metadata.file_path")
    fragments = text.select(F.xxhash64(named).alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    states = text.select(F.xxhash64(named).alias("file"), named.alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")
    # A few numbers for each split, in order within each file.
    begin = materialise(
        states.mapInArrow(_states, _STATE_SCHEMA).groupBy("file").applyInArrow(_begin, _BEGIN_SCHEMA), "splits")
    begin = begin.drop("path")
    if begin.count() <= MANY_SPLITS:
        placed = fragments.join(F.broadcast(begin), ["file", "start"])
    else:
        in_order = fragments.withColumn("row", F.monotonically_increasing_id()).repartition("file", "start")
        placed = in_order.join(begin, ["file", "start"]).sortWithinPartitions("file", "start", "row").drop("row")
    pieces = materialise(placed.mapInArrow(_cut, _PIECE_SCHEMA), "pieces")

    whole = F.col("closed") & (F.col("at") > 0)
    inner = pieces.where(whole).select("file", "start", "at", F.col("piece").alias("element"))
    earlier = Window.partitionBy("file").orderBy("start", "at").rowsBetween(Window.unboundedPreceding, -1)
    edges = pieces.where(~whole).withColumn("number", F.coalesce(F.sum(F.col("closed").cast("bigint")).over(earlier), F.lit(0)))
    joined = edges.groupBy("file", "number").agg(
        F.array_sort(F.collect_list(F.struct("start", "at", "piece"))).alias("pieces"), F.bool_or("closed").alias("closed"))
    last = F.element_at("pieces", -1)
    joined = joined.select("file", last["start"].alias("start"), last["at"].alias("at"), "number", "closed",
                           F.array_join("pieces.piece", ",").alias("element"))
    opening, blank = r"^\x{FEFF}?[ \t\r\n]*\[", r"^\x{FEFF}?[ \t\r\n]*$"
    is_first = F.col("number") == 0
    wrong = is_first & ~F.col("element").rlike(opening) & ~F.col("element").rlike(blank)
    element = F.when(wrong, F.raise_error(F.lit("not a JSON array"))).when(
        is_first, F.regexp_replace("element", opening, "")).otherwise(F.col("element"))
    joined = joined.select("file", "start", "at", "closed", element.alias("element"))
    ended = F.when(F.col("closed"), F.col("element")).otherwise(F.regexp_replace("element", r"\][ \t\r\n]*$", ""))
    joined = joined.select("file", "start", "at", ended.alias("element")).where(~F.col("element").rlike(blank))
    return inner.unionByName(joined)


def read_large_json_array(spark: SparkSession, path: str, fields: Sequence[str]) -> DataFrame:
    """The listed fields of the elements of files that each hold one JSON array, as ``read_json_array`` gives them,
    with any number of tasks to a file; ``spark.sql.files.maxPartitionBytes`` sets how many."""
    schema = ", ".join(f"`{name}` VARIANT" for name in fields)
    parsed = array_elements(spark, path).select(F.from_json("element", schema).alias("record"))
    return parsed.select("record.*")
