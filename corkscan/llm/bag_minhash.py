"""Near-duplicates by weighted Jaccard similarity of bags of word shingles: BagMinHash.

A text is the bag (multiset) of its runs of five words. Weights are counts, so
they are discrete as they come. Each shingle has, for the weight intervals [0, 1),
[1, 2), [2, 4), [4, 8) and so on, a Poisson process whose rate is the length of the
interval; a point has a time, a weight level inside the interval and one component
of the signature, all drawn from a hash of the shingle. A component keeps the
earliest point among those below the weight of their shingle. Two bags then agree
in a component with a chance equal to their weighted Jaccard similarity. Times of
a process ascend, so that it ends as soon as it is later than every component.

Bands of the signature give candidate buckets, and links are verified on the whole
bags. No bucket is turned into all of its pairs:

1. Equal bags are one, told by their smallest identifier.
2. In each bucket all members are compared with one of them. What is linked forms
   classes.
3. Only buckets whose members are in several classes are looked at again: each
   member outside of the largest class is compared with the members of other
   classes, pair by pair in small buckets, and in blocks of bags as matrices in
   large ones, where only links come out. So every pair that shares a bucket is
   compared, or is in one class already.

A class is a connected component of links. Null and empty texts, and texts without
a word, are classes of their own; a text of fewer than five words is one shingle.
Rows with the same identifier are one document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corkscan.llm.common import bounded_batches, give_back_memory, steps, text_or_empty
from corkscan.llm.components import components
from corkscan.storage import materialise

SHINGLE_WORDS = 5
SIMILARITY = 0.8
# A pair at 0.8 is missed with a chance of (1 - 0.8 ** 5) ** 30 = 7e-6.
ROWS, BANDS = 5, 30
# Buckets up to this size are compared by the same first member in all bands, and pair by pair.
SMALL_BUCKET = 32
# In so many orders the first member of a large bucket is looked for: the buckets of a
# large group then share their first members, and a text is linked with few of them.
LEADER_ORDERS = 3
# Members in a block of a large bucket, and about as many bytes of bags; long texts make more blocks.
BLOCK_ONE, BLOCK_OTHER = 256, 512
BLOCK_BYTES = 16 << 20
# So many identifiers may be broadcast; more are joined by shuffle.
FEW_IDS = 500_000

# The texts that a task signs at once, in bytes.
TEXT_BYTES = 1 << 20

_WORD = re.compile(r"\w+")
_KNOWN_WORDS = 60_000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_known: dict[str, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that leaves no pattern (SplitMix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """The hashes of all runs of five words, sorted, with repeats."""
    words = _WORD.findall(text.lower())
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(_known) > _KNOWN_WORDS:
        _known.clear()
    for word in set(words):
        if word not in _known:
            _known[word] = xxhash.xxh3_64_intdigest(word)
    hashes = np.array([_known[word] for word in words], dtype=np.uint64)
    size = min(SHINGLE_WORDS, len(words))
    count = len(words) - size + 1
    mixed = np.full(count, size, dtype=np.uint64)
    for n in range(size):
        mixed = _mix(mixed * _GOLDEN + hashes[n : n + count])
    mixed.sort()
    return mixed


def as_set(bag: np.ndarray) -> np.ndarray:
    """A sorted bag as a set: the n-th copy of an element becomes an element of its own."""
    if len(bag) == 0:
        return bag
    starts = np.flatnonzero(np.append(True, bag[1:] != bag[:-1]))
    copy = np.arange(len(bag)) - np.repeat(starts, np.diff(np.append(starts, len(bag))))
    return np.sort(np.where(copy == 0, bag, _mix(bag + copy.astype(np.uint64) * _GOLDEN)))


def signatures(bags: list[np.ndarray], size: int) -> np.ndarray:
    """A row of ``size`` components for each sorted bag; rows of empty bags mean nothing."""
    flat = np.concatenate(bags) if bags else np.empty(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(bags)), [len(bag) for bag in bags])
    if not len(flat):
        return np.zeros((len(bags), size), dtype=np.uint64)
    first = np.flatnonzero(np.append(True, (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])))
    weight = np.diff(np.append(first, len(flat)))
    flat, owner = flat[first], owner[first]

    # One process for each weight interval that begins below the weight.
    intervals = np.ceil(np.log2(weight)).astype(np.int64) + 1
    source = np.repeat(np.arange(len(flat)), intervals)
    step = np.arange(len(source)) - np.repeat(np.cumsum(intervals) - intervals, intervals)
    rate = np.exp2(np.maximum(step - 1, 0))
    low = np.where(step == 0, 0.0, rate)
    seed = _mix(flat[source] + (step.astype(np.uint64) + np.uint64(1)) * _GOLDEN)
    owner, weight, time = owner[source], weight[source], np.zeros(len(source))

    earliest = np.full(len(bags) * size, np.inf)
    point_of = np.zeros(len(bags) * size, dtype=np.uint64)
    latest = np.full(len(bags), np.inf)
    state = seed
    while len(state):
        state = state + _GOLDEN
        drawn = _mix(state)
        time = time - np.log(((drawn >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        alive = time < latest[owner]
        if not alive.all():
            state, owner, weight, time, rate, low, drawn = (x[alive] for x in (state, owner, weight, time, rate, low, drawn))
        place = _mix(drawn ^ _GOLDEN)
        level = low + np.floor((place >> np.uint64(32)).astype(np.float64) * 2.0**-32 * rate)
        valid = level < weight
        key = owner[valid] * size + ((place[valid] & np.uint64(0xFFFFFFFF)) % np.uint64(size)).astype(np.int64)
        when, what = time[valid], place[valid]
        np.minimum.at(earliest, key, when)
        best = when == earliest[key]
        point_of[key[best]] = what[best]
        latest = earliest.reshape(len(bags), size).max(axis=1)
    return point_of.reshape(len(bags), size)


def band_keys(signature: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """One 64-bit key for each band of each row."""
    parts = signature.reshape(len(signature), bands, rows)
    key = np.broadcast_to(_mix(np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN), parts.shape[:2]).copy()
    for n in range(rows):
        key = _mix(key * _GOLDEN + parts[:, :, n])
    return key.view(np.int64)


def _digest(bag: np.ndarray) -> bytes:
    return hashlib.blake2b(bag, digest_size=16).digest()


def _sign(rows: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, most=TEXT_BYTES):
            bags = [shingles(text) for text in batch["text"].to_pylist()]
            keys = band_keys(signatures(bags, rows * bands), rows, bands)
            offsets = np.arange(0, keys.size + 1, bands, dtype=np.int32)
            yield pa.RecordBatch.from_pydict({
                "id": batch["id"], "text_sum": batch["text_sum"],
                "bag": pa.array([_digest(bag) if len(bag) else None for bag in bags], pa.binary()),
                "bands": pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))})
        give_back_memory()

    return run


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, most=TEXT_BYTES):
        bags = [shingles(text) for text in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_pydict({
            "rep": pa.array([_digest(bag) if len(bag) else None for bag in bags], pa.binary()),
            "bag": pa.array([as_set(bag).tobytes() for bag in bags], pa.binary())})
    give_back_memory()


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, kept = [], {}
        for a, bag_a, bag_b in zip(batch["a"].to_pylist(), batch["bag_a"], batch["bag_b"]):
            if a not in kept:
                kept = {a: np.frombuffer(bag_a.as_buffer(), dtype=np.uint64)}
            one, other = kept[a], np.frombuffer(bag_b.as_buffer(), dtype=np.uint64)
            if len(one) > len(other):
                one, other = other, one
            at = np.minimum(np.searchsorted(other, one), len(other) - 1)
            shared = int((other[at] == one).sum())
            found.append(shared / (len(one) + len(other) - shared))
        yield pa.RecordBatch.from_pydict({"a": batch["a"], "b": batch["b"], "similarity": pa.array(found, pa.float64())})


def _overlap_matrix(one: list[np.ndarray], other: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many elements each set of ``one`` shares with each of ``other``."""
    shared = np.intersect1d(np.concatenate(one), np.concatenate(other))
    result = np.zeros((len(one), len(other)), dtype=np.float32)
    for start in range(0, len(shared), columns):
        part = shared[start : start + columns]
        sides = []
        for sets in (one, other):
            side = np.zeros((len(sets), len(part)), dtype=np.float32)
            for row, elements in enumerate(sets):
                side[row, np.flatnonzero(np.isin(part, elements, assume_unique=True))] = 1
            sides.append(side)
        result += sides[0] @ sides[1].T
    return result


def _link_blocks(least: float):
    """The links between the two sides of one block of a bucket."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        sets = [np.frombuffer(bag.as_buffer(), dtype=np.uint64) for bag in rows["bag"]]
        left = np.array(rows["left"].to_pylist())
        ids, classes = np.array(rows["id"].to_pylist(), dtype=object), np.array(rows["class"].to_pylist(), dtype=object)
        one, other = np.flatnonzero(left), np.flatnonzero(~left)
        pairs = []
        if len(one) and len(other):
            both = _overlap_matrix([sets[n] for n in one], [sets[n] for n in other])
            sizes = np.array([len(s) for s in sets], dtype=np.float64)
            near = both / (sizes[one][:, None] + sizes[other][None, :] - both) >= least
            near &= classes[one][:, None] != classes[other][None, :]
            # One link to each class is enough.
            pairs = {(ids[one[i]], classes[other[j]]): ids[other[j]] for i, j in zip(*np.nonzero(near))}
            pairs = [(a, b) for (a, _), b in pairs.items()]
        kind = rows.schema.field("id").type
        return pa.table({"a": pa.array([a for a, _ in pairs], kind), "b": pa.array([b for _, b in pairs], kind)})

    return run


def keep_ids(rows: DataFrame, column: str, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """``rows`` whose ``column`` is (or with ``left_anti`` is not) among ``ids``, null like any other;
    few identifiers are broadcast, after they have been counted."""
    if ids.count() <= FEW_IDS:
        ids = F.broadcast(ids)
    return rows.join(ids, rows[column].eqNullSafe(ids[ids.columns[0]]), how)


def row_key(id_col: str, text_col: str) -> Column:
    """What tells a row of ``docs`` from others, also where identifiers are null or repeated: the identifier and a hash of the text."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("text_sum"))


def _verified(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b)."""
    other = bags.select(F.col("id").alias("b"), F.col("bag").alias("bag_b"))
    one = bags.select(F.col("id").alias("a"), F.col("bag").alias("bag_a"))
    id_type = pairs.schema["a"].dataType.simpleString()
    return pairs.join(other, "b").join(one, "a").mapInArrow(_overlaps, f"a {id_type}, b {id_type}, similarity double")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
                    rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(id, class_id): every identifier with the smallest one of its class.

    One row for each identifier; one that is repeated with texts of several classes
    has a row for each. Null identifiers count like others, but are the smallest of a
    class only if it has no other.
    """
    return near_duplicate_rows(docs, id_col, text_col, similarity, rows, bands).select(
        F.col("key.id").alias(id_col), "class_id").distinct()


def near_duplicate_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
                        rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(key, class_id, kept): one row for each row of ``docs``, told by its ``row_key``; of each class
    the smallest key is kept, null identifiers last, and of equal rows all are."""
    texts = bounded_batches(docs.select(row_key(id_col, text_col).alias("key"), text_or_empty(text_col).alias("text"))).select(
        "key.id", "key.text_sum", "text")
    id_type = texts.schema["id"].dataType.simpleString()
    # From here on a text is told by the digest of its bag of shingles.
    signed = materialise(texts.mapInArrow(
        _sign(rows, bands), f"id {id_type}, text_sum bigint, bag binary, bands array<bigint>"), "signatures")
    place = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("text_sum").alias("text_sum"))
    first = signed.where("bag IS NOT NULL").groupBy(F.col("bag").alias("rep")).agg(
        F.min(place).alias("place"), F.first("bands").alias("bands"))
    first = materialise(first, "bags")

    # Buckets of two bags and more.
    entries = first.select("rep", F.explode("bands").alias("key"))
    # Large buckets take the first of their members in one of a few orders.
    order = F.xxhash64("rep", F.pmod("key", F.lit(LEADER_ORDERS)))
    buckets = entries.groupBy("key").agg(
        F.count("*").alias("n"), F.min("rep").alias("least"), F.min(F.struct(order, "rep")).alias("first")).where("n > 1")
    leader = F.when(F.col("n") <= SMALL_BUCKET, F.col("least")).otherwise(F.col("first.rep"))
    members = materialise(entries.join(buckets, "key").select("key", "rep", "n", leader.alias("leader")), "members")
    wanted = materialise(members.select("rep").distinct().join(first.select("rep", "place"), "rep").select("rep", "place.id"), "wanted")
    sets = keep_ids(texts, "id", wanted.select(F.col("id").alias("wanted")).distinct()).select("text").mapInArrow(_bags, "rep binary, bag binary")
    bags = materialise(keep_ids(sets, "rep", wanted.select(F.col("rep").alias("wanted"))).dropDuplicates(["rep"]).select(
        F.col("rep").alias("id"), "bag", F.octet_length("bag").cast("bigint").alias("bytes")), "bag-sets")

    star = members.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    found = materialise(_verified(star, bags).where(F.col("similarity") >= similarity).select("a", "b"), "links")
    classes = components(found)

    # Buckets with members of several classes.
    placed = members.where("n > 2").join(classes, F.col("rep") == F.col("node"), "left").select(
        "key", "rep", "n", F.coalesce("label", "rep").alias("class"))
    placed = materialise(placed, "placed")
    sizes = placed.groupBy("key", "class").agg(F.count("*").alias("size"))
    open_buckets = sizes.groupBy("key").agg(
        F.max_by("class", F.struct("size", "class")).alias("main"), F.max("size").alias("most"), F.count("*").alias("classes"))
    open_buckets = open_buckets.where("classes > 1").select("key", "main", "most")
    placed = materialise(placed.join(open_buckets, "key").withColumn("outside", F.col("class") != F.col("main")), "open")

    small = placed.where(F.col("n") <= SMALL_BUCKET)
    one = small.where("outside").select("key", F.col("rep").alias("a"), F.col("class").alias("class_a"))
    other = small.select("key", F.col("rep").alias("b"), F.col("class").alias("class_b"))
    pairs = one.join(other, "key").where("class_a <> class_b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = _verified(pairs, bags).where(F.col("similarity") >= similarity).select("a", "b")

    large = placed.where(F.col("n") > SMALL_BUCKET)
    weights = large.join(bags.select(F.col("id").alias("rep"), "bytes"), "rep").groupBy("key").agg(
        F.sum("bytes").alias("bytes"), F.sum(F.when(F.col("outside"), F.col("bytes"))).alias("bytes_outside"))
    parts = lambda count, most, size: F.greatest(F.ceil(count / most), F.ceil(F.col(size) / BLOCK_BYTES)).cast("int")
    large = large.join(weights, "key").withColumns({
        "ps": parts(F.col("n") - F.col("most"), BLOCK_ONE, "bytes_outside"), "qs": parts(F.col("n"), BLOCK_OTHER, "bytes")})
    block = lambda count: F.pmod(F.xxhash64("rep"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    left = large.where("outside").select("key", "rep", "class", F.lit(True).alias("left"), block("ps").alias("p"), every("qs").alias("q"))
    right = large.select("key", "rep", "class", F.lit(False).alias("left"), block("qs").alias("q"), every("ps").alias("p"))
    blocks = left.unionByName(right).join(bags.select(F.col("id").alias("rep"), "bag"), "rep").withColumnRenamed("rep", "id")
    in_blocks = blocks.groupBy("key", "p", "q").applyInArrow(_link_blocks(similarity), "a binary, b binary")
    more = materialise(more.unionByName(in_blocks), "more-links")
    if not more.isEmpty():
        classes = components(found.unionByName(more))

    labelled = materialise(first.select("rep", "place").join(classes, F.col("rep") == F.col("node"), "left").select(
        "rep", "place", F.coalesce("label", "rep").alias("label")), "labelled")
    leading = labelled.groupBy("label").agg(F.min("place").alias("leading"), F.count("*").alias("n")).where("n > 1").drop("n")
    of_bag = labelled.join(leading, "label", "left").select("rep", F.coalesce("leading", "place").alias("leading"))
    result = signed.select("id", "text_sum", "bag").join(of_bag, F.col("bag") == F.col("rep"), "left")
    kept = F.col("leading").isNull() | (place == F.col("leading"))
    return result.select(F.struct("id", "text_sum").alias("key"), F.when(F.col("leading").isNull(), F.col("id")).otherwise(
        F.col("leading.id")).alias("class_id"), kept.alias("kept"))
