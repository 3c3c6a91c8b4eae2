"""Exact duplicates by content sort.

Normalised bytes are range-partitioned by sampled splitters, sorted outside of
memory, and equal texts then stand next to each other. The splitters are cut
from a bounded key: the first bytes, a digest of all bytes, and the identifier.
The identifier is part of the order, so the copies of one text are dealt over as
many partitions as their number asks for. Neighbours are compared in full. A
group that reaches the edge of a partition may go on in the next one, and a group
of more than a few MB is handed on in parts, so that no task holds it whole; the
counts of such groups are put together in a small table.

Null texts count as empty. Null identifiers are smaller than all others. Of rows
that are equal in text and identifier, one stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corkscan.llm.common import bounded_batches, schema_of, steps, text_or_empty
from corkscan.storage import materialise

# Bytes at the start of a text that take part in the order of partitions.
HEAD_BYTES = 16
# What a task holds of one text's rows before it hands them on, in bytes.
WAITING_BYTES = 4 << 20
# So many keys that reach an edge may be broadcast; more are joined by shuffle.
FEW_EDGES = 200_000


def _with_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "_norm"):
        norm = pc.ascii_lower(batch["_norm"]).cast(pa.binary())
        digests = [hashlib.sha256(text.as_buffer()).digest() for text in norm]
        tags = np.array([int.from_bytes(d[:8], "little", signed=True) for d in digests], dtype=np.int64)
        columns = {name: batch[name] for name in batch.schema.names if name != "_norm"}
        columns |= {"_norm": norm, "_head": pc.binary_slice(norm, 0, HEAD_BYTES), "_tag": tags,
                    "_sha": pa.array([d.hex() for d in digests])}
        yield pa.RecordBatch.from_pydict(columns)


def _differs(column: pa.Array) -> np.ndarray:
    """For each row, whether it differs from the row before; the first one does."""
    found = np.ones(len(column), dtype=bool)
    if len(column) > 1:
        found[1:] = ~pc.equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return found


def _one_batch(parts: Sequence[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.concat_batches(parts)


def _groups(keep: str, waiting_bytes: int = WAITING_BYTES):
    """Sorted rows to rows with what is known of their group in this partition."""

    def key(rows: pa.RecordBatch, at: int) -> tuple:
        return rows["_head"][at], rows["_tag"][at]

    def described(rows: pa.RecordBatch, new_key: np.ndarray, edge: np.ndarray, tail: pa.RecordBatch | None) -> pa.RecordBatch:
        starts = np.flatnonzero(new_key | _differs(rows["_norm"]))
        sizes = np.diff(np.append(starts, rows.num_rows))
        chosen = starts if keep == "smallest" else starts + sizes - 1
        ids = rows["_id"]
        stays = np.zeros(rows.num_rows, dtype=bool)
        stays[chosen] = True
        if tail is not None and tail["_norm"][0] == rows["_norm"][0] and (
                keep == "smallest" or tail["_id"][0].as_py() == ids[int(chosen[0])].as_py()):
            stays[chosen[0]] = False  # handed on before, with the rows of ``tail``
        top = ids.take(pa.array(np.repeat(chosen, sizes)))
        columns = {n: rows[n] for n in rows.schema.names if n not in ("_norm", "_head", "_tag")}
        columns |= {"_top": top, "_size": np.repeat(sizes, sizes).astype(np.int64), "_stays": stays, "_edge": edge}
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # ``tail``: the last row handed on, if its key may go on.
        waiting, first, tail = None, None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = batch if waiting is None else _one_batch([waiting, batch])
            new_key = _differs(rows["_head"]) | _differs(rows["_tag"])
            if first is None:
                first = key(rows, 0)
            begins = np.flatnonzero(new_key)
            goes_on = key(rows, 0) == first or (tail is not None and key(tail, 0) == key(rows, 0))
            full = rows.num_rows if len(begins) == 1 and rows.nbytes >= waiting_bytes else int(begins[-1])
            if full:
                edge = np.zeros(full, dtype=bool)
                if goes_on or full == rows.num_rows:
                    edge[: begins[1] if len(begins) > 1 else full] = True
                yield described(rows.slice(0, full), new_key[:full], edge, tail)
                tail = rows.take(pa.array([full - 1])) if full == rows.num_rows else None
            waiting = rows.slice(full) if full < rows.num_rows else None
        if waiting is not None:
            new_key = np.zeros(waiting.num_rows, dtype=bool)
            new_key[0] = True
            yield described(waiting, new_key, np.ones(waiting.num_rows, dtype=bool), tail)

    return run


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (),
                keep: str = "smallest", waiting_bytes: int = WAITING_BYTES) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256[, row]): one row for each row of ``docs``.

    Texts are equal if they are the same bytes after A-Z are lower-cased.
    ``keep`` names the identifier of a group that stays. Columns named in
    ``carry`` travel along and come back in the struct ``row``. An empty table
    gives no rows.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    source = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_norm"),
                         *(F.col(name).alias(f"c_{name}") for name in carry))
    source = bounded_batches(source)
    base = schema_of(source.drop("_norm"))
    keyed = source.mapInArrow(_with_keys, f"{base}, _norm binary, _head binary, _tag bigint, _sha string")
    dealt = keyed.repartitionByRange("_head", "_tag", "_id").sortWithinPartitions("_head", "_tag", "_norm", "_id")
    id_type = source.schema["_id"].dataType.simpleString()
    found = dealt.mapInArrow(
        _groups(keep, waiting_bytes), f"{base}, _sha string, _top {id_type}, _size bigint, _stays boolean, _edge boolean")
    found = materialise(found, "content-sort")

    best = F.min("_top") if keep == "smallest" else F.max("_top")
    nulls = F.count_if(F.col("_id").isNull())
    edges = found.where("_edge").groupBy(F.col("_sha").alias("_edge_sha")).agg(
        (F.when(nulls == 0, best) if keep == "smallest" else best).alias("_edge_top"),
        F.count("*").alias("_edge_size"))
    # At most two keys for each partition of the sort, and one for each group of copies that is larger than ``waiting_bytes``.
    edges = materialise(edges, "edges")
    if edges.count() <= FEW_EDGES:
        edges = F.broadcast(edges)
    joined = found.join(edges, found["_sha"] == edges["_edge_sha"], "left")
    across = F.col("_edge_size").isNotNull()
    keep_id = F.when(across, F.col("_edge_top")).otherwise(F.col("_top"))
    return joined.select(
        F.col("_id").alias(id_col), keep_id.alias("keep_id"),
        F.when(across, F.col("_edge_size")).otherwise(F.col("_size")).alias("group_size"),
        (F.col("_stays") & F.col("_id").eqNullSafe(keep_id)).alias("kept"),
        F.col("_sha").alias("text_sha256"),
        *([F.struct(*(F.col(f"c_{name}").alias(name) for name in carry)).alias("row")] if carry else []))
