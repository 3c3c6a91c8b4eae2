"""What each filter of a chain removes, for every order that the chain can have.

The outcome of a document depends on one mask alone: which filters it fails. A
mask is mapped to one wide integer with a field of 64 bits for every figure of
every step of every order, 600 steps for five filters; a field holds 1 if the
document counts there. The integer of a part is the sum of the integers of its
documents, and its fields are then read back. A field would overflow into the
next one beyond 2^64 - 1 documents, more than a BIGINT count can tell.

Equal terms of that sum are counted before they are shuffled: a part has at most
128 kinds of documents (32 masks, good or not, toxic or not), however many rows
it has, and each kind adds its integer times its number. Copies are found by the
SHA-256 of the whole text and counted in the same way, so that no group of copies
and no part is ever gathered in one task.

Null texts are empty; a null part is the part ''. A null identifier is neither
smaller nor larger than another one: such a row is no copy of any, and no row is a
copy of it. Rows that repeat an identifier and its text are not copies of each
other. A label counts for an identifier if any row of ``labels`` sets it; rows
without an identifier have none. Empty tables give no parts and so no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corkscan.llm.common import text_or_empty

# The filters, by the letter of their failure condition; their bits in a mask are in this order.
FILTERS = "ABCDE"
COPY = FILTERS.index("E")

FIELD_BYTES = 8
FIGURES = ("removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
STEP_SCHEMA = ("part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, "
               "unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint")


def text_conditions(text: Column) -> dict[str, Column]:
    """Whether a text fails the filters that need nothing but the text."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    distinct = F.size(F.array_distinct(words)).cast("bigint")
    count, length = F.size(words).cast("bigint"), F.length(text).cast("bigint")
    capitals = length - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": count < 100,
        "B": 100 * distinct < 80 * count,
        "C": 100 * capitals > 10 * length,
        "D": text.rlike(r"[#$%&*|]"),
    }


def kinds(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          part_col: str = "lang") -> DataFrame:
    """(part, mask, good, toxic, n): how many documents of a part fail exactly the filters of a mask."""
    failed = text_conditions(F.col("text"))
    bits = [F.when(failed[name], 1 << FILTERS.index(name)).otherwise(0) for name in failed]
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                        text_or_empty(text_col).alias("text"))
    told = texts.select("id", "part", F.unhex(F.sha2("text", 256)).alias("sha"), sum(bits[1:], bits[0]).alias("mask"))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    kind = ["part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")]
    rows = told.join(known, "id", "left").groupBy("id", "sha", *kind).agg(F.count("*").alias("n"))
    # All copies of a text have one mask so far; of each kind only the smallest identifier can be the first of all.
    copies = rows.groupBy("sha", "part", "mask", "good", "toxic").agg(
        F.min("id").alias("first"), F.min_by("n", "id").alias("n_first"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_null"), F.sum("n").alias("n"))
    firsts = copies.groupBy("sha").agg(F.min("first").alias("first_of_all"))
    found = copies.join(firsts, "sha")
    passes = F.col("n_null") + F.when(F.col("first") == F.col("first_of_all"), F.col("n_first")).otherwise(0)
    both = F.array(F.struct(F.col("mask").alias("mask"), passes.alias("n")),
                   F.struct((F.col("mask") + (1 << COPY)).alias("mask"), (F.col("n") - passes).alias("n")))
    split = found.select("part", "good", "toxic", F.inline(both))
    return split.where("n > 0").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def _fields(order: Sequence[int], mask: int, good: bool, toxic: bool) -> Iterator[tuple[bool, ...]]:
    """For each step of ``order``, in which figures of FIGURES a document of this kind counts."""
    gone = False
    for bit in order:
        fails = bool(mask >> bit & 1)
        removed = fails and not gone
        yield removed, fails and gone, mask == 1 << bit, removed and good, removed and toxic
        gone = gone or fails


@cache
def packed(mask: int, good: bool, toxic: bool, orders: tuple[tuple[int, ...], ...]) -> int:
    """The wide integer of one document: a field of 1 for the document, then one for each figure of each step of each order."""
    fields = [True, *(counts for order in orders for step in _fields(order, mask, good, toxic) for counts in step)]
    return int.from_bytes(np.array(fields, dtype="<u8").tobytes(), "little")


def unpacked(total: int, orders: Sequence[Sequence[int]]) -> tuple[int, np.ndarray]:
    """The number of documents, and the figures by order, step and figure."""
    steps = sum(len(order) for order in orders)
    fields = np.frombuffer(total.to_bytes(FIELD_BYTES * (1 + steps * len(FIGURES)), "little"), dtype="<u8").astype(np.int64)
    return int(fields[0]), fields[1:].reshape(len(orders), -1, len(FIGURES))


def _steps_of(part: pa.Table, orders: Sequence[Sequence[int]], names: Sequence[str]) -> pa.Table:
    """All steps of all orders for the kinds of one part."""
    total = sum(row["n"] * packed(row["mask"], row["good"], row["toxic"], orders) for row in part.to_pylist())
    docs, figures = unpacked(total, orders)
    flat = {name: figures[:, :, at] for at, name in enumerate(FIGURES)}
    by_bit = np.zeros(len(names), dtype=np.int64)
    np.add.at(by_bit, np.array(orders), flat["removed"])
    steps = figures.shape[1]
    columns = {
        "part": [part["part"][0].as_py()] * (len(orders) * steps),
        "filter_order": np.repeat(["".join(names[bit] for bit in order) for order in orders], steps),
        "step": np.tile(np.arange(1, steps + 1, dtype=np.int32), len(orders)),
        "kept": (docs - np.cumsum(flat["removed"], axis=1)).ravel(),
    } | {name: values.ravel() for name, values in flat.items()} | {"shapley": by_bit[np.array(orders)].ravel()}
    return pa.table({name: pa.array(column) for name, column in columns.items()})


def audit(kinds: DataFrame, names: Sequence[str] = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from
    (part, mask, good, toxic, n); bit i of a mask is set if the filter ``names[i]`` is failed.

    A filter's ``shapley`` is the number of its removals over all orders. There are
    all orders of ``names``, so this is meant for up to six filters or so.
    """
    orders = tuple(permutations(range(len(names))))
    return kinds.groupBy("part").applyInArrow(lambda part: _steps_of(part, orders, names), STEP_SCHEMA)


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 part_col: str = "lang") -> DataFrame:
    """The steps of all orders of FILTERS over all rows of ``docs``, as of ``audit``."""
    return audit(kinds(docs, labels, id_col, text_col, part_col))
