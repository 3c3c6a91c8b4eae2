"""Phrases that hold together, from a weighted de Bruijn graph of words.

The nodes of the graph are runs of words, and an edge goes from the first to the
last four words of a run of five. Only these longest runs are counted, one for
each place, cut short where a piece of text ends. The number of a shorter run is
the flow through its node: what goes out over its edges, plus the places at which
a piece ended there. So every order is made from the one above it. A node is
unary if one edge carries its whole flow; paths over unary nodes are compacted,
that is, a phrase whose words are always part of one longer phrase is left to it.

Phrases below ``min_count`` are not asked for, and a phrase that is frequent has
frequent pairs only. Pairs of words are therefore counted first, in hashed
buckets, and pieces end where a bucket stays below ``min_count``. Pairs that share
a bucket only make it look more frequent, so no frequent phrase is lost and all its
places are counted, whatever the number of buckets. It grows with the corpus up to
``MOST_BUCKETS``, which bounds what is broadcast to 32 MB.

Texts are counted in tasks and added up by key before and after the shuffle, so
neither a part nor a frequent phrase is gathered anywhere. Scores are computed with
decimals of 38 digits, exact up to 10^17 words in a part.

Null texts are empty, a null part is 'und'. Texts count once for each row, however
often a row or its identifier is repeated; identifiers are not read. Empty tables
give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corkscan.llm.common import STEP_BYTES, bounded_batches, steps, text_or_empty
from corkscan.storage import materialise

LONGEST = 5
LEAST_BUCKETS, MOST_BUCKETS = 1 << 20, 1 << 28
# Characters for each bucket: with four or more of them to a word there are as many buckets as words at least.
CHARS_A_BUCKET = 4
# Bits of one bitmap of bitmap_construct_agg.
BITMAP_BITS = 8 * 4096
# Into how many salts a part's phrases are dealt: to join what is known of the part, and to be
# ranked before the best of each salt are ranked together.
SALTS = 64

# Bytes of a text: A-Z lower-cased, a tab is a space, and whatever ends a piece is a line feed.
_BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")
_TOKENS = re.compile(rb"[^ \n]+|\n")
_END = 0


class _Numbers(dict):
    """Tokens to numbers from 0 in order of first sight; the end of a piece is 0."""

    def __init__(self) -> None:
        super().__init__({b"\n": _END})

    def __missing__(self, token: bytes) -> int:
        self[token] = number = len(self)
        return number


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """(part, words, numbers) of a stretch of texts of one part; every piece has a 0 at its end."""
    for batch in steps(batches):
        texts, parts = batch["text"].cast(pa.binary()), batch["part"].to_pylist()
        rows: dict[str, list[int]] = {}
        for row, part in enumerate(parts):
            rows.setdefault(part, []).append(row)
        for part, chosen in rows.items():
            joined = b"\n".join([*(texts[row].as_py().translate(_BYTES) for row in chosen), b""])
            at = 0
            while at < len(joined):  # a text of any length in stretches that end where a piece ends
                end = joined.find(b"\n", at + STEP_BYTES) + 1 or len(joined)
                known, found = _Numbers(), _TOKENS.findall(joined, at, end)
                numbers = np.fromiter(map(known.__getitem__, found), dtype=np.int64, count=len(found))
                yield part, list(known), numbers
                at = end


def _pair_buckets(part: str, words: list[bytes], numbers: np.ndarray, buckets: int) -> np.ndarray:
    """For every place the bucket of the pair that begins there, -1 if a piece ends at either word."""
    seed = zlib.crc32(part.encode())
    hashes = np.array([zlib.crc32(word, seed) for word in words], dtype=np.uint64)[numbers]
    mixed = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (hashes[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    found = ((mixed >> np.uint64(32)) & np.uint64(buckets - 1)).astype(np.int64)
    found[(numbers[:-1] == _END) | (numbers[1:] == _END)] = -1
    return np.append(found, -1)


def _pairs(buckets: int):
    """Texts to (bucket, n): how many pairs fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words, numbers in _numbered(batches):
            pairs, times = np.unique(_pair_buckets(part, words, numbers, buckets), return_counts=True)
            yield pa.RecordBatch.from_pydict({"bucket": pairs[pairs >= 0], "n": times[pairs >= 0].astype(np.int64)})

    return run


def _distinct_rows(rows: np.ndarray, values: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of numbers below ``values``, and how often each is there."""
    bits = max(1, int(values - 1).bit_length())
    keys = []
    for first in range(0, rows.shape[1], 63 // bits):
        key = np.zeros(len(rows), dtype=np.int64)
        for column in rows[:, first : first + 63 // bits].T:
            key = (key << bits) | column
        keys.append(key)
    order = np.lexsort(keys[::-1])
    new = np.ones(len(rows), dtype=bool)
    if len(rows):
        new[1:] = np.any([key[order][1:] != key[order][:-1] for key in keys], axis=0)
    starts = np.flatnonzero(new)
    return rows[order[starts]], np.diff(np.append(starts, len(rows)))


def _runs(buckets: int, frequent):
    """Texts to (part, phrase, n): the run of up to LONGEST words at every place; it ends with its piece, or where a pair is rare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(frequent.value, dtype=np.uint8)
        for part, words, numbers in _numbered(batches):
            pairs = _pair_buckets(part, words, numbers, buckets)
            goes_on = (bits[pairs >> 3] >> (pairs & 7).astype(np.uint8) & 1).astype(bool) & (pairs >= 0)
            alone = np.bincount(numbers[~goes_on], minlength=len(words))
            alone[_END] = 0
            single = np.flatnonzero(alone)
            starts = np.flatnonzero(goes_on)
            runs = np.zeros((len(starts), LONGEST), dtype=np.int64)
            runs[:, 0] = numbers[starts]
            within = np.ones(len(starts), dtype=bool)
            for k in range(1, LONGEST):
                # A place beyond the last one is the end of a piece, and no pair goes on from there.
                before = np.minimum(starts + k - 1, len(numbers) - 1)
                within &= goes_on[before]
                runs[within, k] = numbers[before[within] + 1]
            distinct, times = _distinct_rows(runs, len(words))
            lengths = np.concatenate([np.ones(len(single), dtype=np.int64), (distinct != _END).sum(axis=1)])
            flat = np.concatenate([single, distinct[distinct != _END]])
            text = pa.array([word.decode() for word in words], pa.string())
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), text.take(pa.array(flat)))
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part] * len(lengths), pa.string()), "phrase": pc.binary_join(lists, " "),
                "n": np.concatenate([alone[single], times]).astype(np.int64)})

    return run


def _bitmap(frequent: DataFrame, buckets: int) -> bytes:
    """The bits of the ``bucket`` numbers from 0, at most MOST_BUCKETS of them."""
    rows = frequent.groupBy(F.bitmap_bucket_number(F.col("bucket") + 1).alias("number")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bucket") + 1)).alias("bits"))
    whole = bytearray(max(buckets, BITMAP_BITS) // 8)
    size = BITMAP_BITS // 8
    for number, bits in rows.collect():
        whole[(number - 1) * size : number * size] = bits
    return bytes(whole)


def count_phrases(docs: DataFrame, min_count: int, text_col: str = "text", part_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(part, phrase, f) of all phrases of 1 to LONGEST words, joined by spaces, that are in a part at least ``min_count`` times, and
    (part, total) with the number of all words of a part."""
    source = bounded_batches(docs.select(F.coalesce(F.col(part_col).cast("string"), F.lit("und")).alias("part"),
                                         text_or_empty(text_col).alias("text")))
    chars = source.select(F.sum(F.length("text"))).first()[0] or 0
    buckets = LEAST_BUCKETS
    while buckets < min(chars // CHARS_A_BUCKET, MOST_BUCKETS):
        buckets *= 2
    # The part is in the hash of a pair. Nothing of a written table keeps files of its shuffle alive.
    pairs = source.mapInArrow(_pairs(buckets), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    pairs = materialise(pairs.where(F.col("n") >= min_count), "frequent-pairs")
    frequent = source.sparkSession.sparkContext.broadcast(_bitmap(pairs, buckets))
    runs = source.mapInArrow(_runs(buckets, frequent), "part string, phrase string, n bigint")
    runs = materialise(runs.groupBy("part", "phrase").agg(F.sum("n").alias("n")), "edges")
    flow = runs.where(_size() == LONGEST)
    orders = []
    for order in range(LONGEST, 0, -1):
        orders.append(flow.where(F.col("n") >= min_count).select("part", "phrase", F.col("n").alias("f")))
        if order > 1:
            out = flow.select("part", F.substring_index("phrase", " ", order - 1).alias("phrase"), "n")
            ended = runs.where(_size() == order - 1)
            flow = out.unionByName(ended).groupBy("part", "phrase").agg(F.sum("n").alias("n"))
    # Every word begins one run.
    totals = runs.groupBy("part").agg(F.sum("n").alias("total"))
    phrases = orders[0]
    for more in orders[1:]:
        phrases = phrases.unionByName(more)
    return materialise(phrases, "phrases"), totals


def compacted(phrases: DataFrame) -> DataFrame:
    """``phrases`` without those of several words that are never seen outside of one longer phrase.

    A phrase inside a longer one that is as frequent is also inside one that has
    just one word more and is as frequent, so single edges are all that count.
    """
    longer = phrases.where(_size() > 2)
    ends = F.array(F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)"))
    nodes = longer.withColumn("size", _size()).select("part", F.explode(ends).alias("phrase"), "f")
    nodes = nodes.groupBy("part", "phrase").agg(F.max("f").alias("edge"))
    branching = F.col("edge").isNull() | (F.col("edge") < F.col("f"))
    return phrases.where(_size() > 1).join(nodes, ["part", "phrase"], "left").where(branching).drop("edge")


def _size() -> Column:
    """The number of words of ``phrase``."""
    return F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit(""))) + 1


def _digits(name: str) -> Column:
    return F.col(name).cast("decimal(17,0)")


def _salt(name: str) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(SALTS)).cast("int")


def scored(candidates: DataFrame, phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """(part, phrase, a, l, r, total, score): ``candidates`` (part, phrase, f) at the cut that holds least."""
    sized = candidates.select("part", "phrase", F.col("f").alias("a"), _size().alias("size"))
    cuts = sized.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    left = phrases.select("part", F.col("phrase").alias("head"), F.col("f").alias("l"))
    right = phrases.select("part", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    cuts = cuts.withColumns({"head": F.expr("substring_index(phrase, ' ', k)"), "tail": F.expr("substring_index(phrase, ' ', k - size)"),
                             "salt": _salt("phrase")})
    of_part = totals.select("part", "total", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    known = cuts.join(left, ["part", "head"]).join(right, ["part", "tail"]).join(of_part, ["part", "salt"])
    wide = known.withColumns({"a38": _digits("a"), "t38": _digits("total"), "l38": _digits("l"), "r38": _digits("r")})
    wide = wide.withColumn("score", F.expr("(CAST(1000 AS DECIMAL(4,0)) * a38 * t38) div (l38 * r38)"))
    least = wide.groupBy("part", "phrase").agg(F.min_by(F.struct("a", "l", "r", "total", "score"), F.struct("score", "k")).alias("cut"))
    return least.select("part", "phrase", "cut.*")


def collocations(docs: DataFrame, min_count: int = 100, most: int = 2000, text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, rank, phrase, a, l, r, n, score): the ``most`` phrases of 2 to LONGEST words of each part that hold together best.

    ``a`` is the number of a phrase, ``l`` and ``r`` those of the two sides of its
    weakest cut, ``n`` the number of words of the part, and the score is
    floor(1000 a n / (l r)). Ties are broken by ``a``, then by the phrase's bytes.
    """
    phrases, totals = count_phrases(docs, min_count, text_col, part_col)
    found = scored(compacted(phrases), phrases, totals).select(
        "part", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A part's phrases are dealt over tasks; only the best of each salt are then ranked together.
    within = Window.partitionBy("part", "salt").orderBy(*best)
    found = found.withColumn("salt", _salt("phrase"))
    found = found.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= most)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(*best)).cast("bigint")).where(F.col("rank") <= most)
    return found.select("part", "rank", "phrase", "a", "l", "r", "n", "score")
