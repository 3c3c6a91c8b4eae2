"""Language identification with bitmask filters of character n-grams.

Of each language the most frequent n-grams of three and four characters are put
into one Bloom filter. The filters are cut into slices by slot: a slot is a bitmask
of the languages whose filter has this bit, so that the bitwise AND of an n-gram's
slots gives all languages that contain it at once. For each text the bits are
counted language by language, and each count is corrected by the share of n-grams
that the filter of this language lets through by chance. The largest count decides;
the first language in alphabetical order, if several are the largest.

Letters count in lower case, anything else as one space; a text without letters, and
null, is ``und`` with score 0. So is every text if nothing was there to learn from.
The score is the share of the language in the corrected counts of all.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corkscan.llm.bag_minhash import keep_ids
from corkscan.llm.common import bounded_batches, free_name, schema_of, steps, text_or_empty

UNKNOWN = "und"
SIZES = (3, 4)
# The sample that is learned from: labelled rows of each language.
SAMPLE_ROWS = 1_500
# N-grams of each language in the filters.
PROFILE = 4_000
SLOTS, PROBES = 1 << 16, 3
# A language may have a third of all rows: its rows are ranked in so many parts first.
SALTS = 64
MOST_LANGUAGES = 1_024
# The texts that a task reads at once, in bytes.
TEXT_BYTES = 1 << 20

_SPACE = 32


@functools.cache
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(code).isalpha() for code in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram hashes, text numbers) of all texts; a word has a space on either side."""
    lowered = [f" {text.lower()} " for text in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(text) for text in lowered])
    letter = _letters()[codes]
    keep = letter.copy()
    keep[:-1] |= letter[1:]  # a space before each word
    keep[1:] |= letter[:-1]  # and after it
    codes, owner, letter = np.where(letter, codes, _SPACE)[keep].astype(np.uint64), owner[keep], letter[keep]
    hashes, owners = [], []
    for size in SIZES:
        count = len(codes) - size + 1
        if count <= 0:
            continue
        valid = owner[:count] == owner[size - 1 :]
        for n in range(1, size - 1):
            valid &= letter[n : n + count]
        rolled = np.full(count, size, dtype=np.uint64)
        for n in range(size):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + codes[n : n + count]
        hashes.append(_mix(rolled[valid]))
        owners.append(owner[:count][valid])
    if not hashes:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def _slots(hashes: np.ndarray) -> list[np.ndarray]:
    return [((hashes >> np.uint64(21 * n)) % np.uint64(SLOTS)).astype(np.int64) for n in range(PROBES)]


@dataclass
class Filters:
    languages: list[str]
    slices: list[np.ndarray]  # for each 64 languages, a bitmask for each slot
    false_rate: np.ndarray  # for each language

    @classmethod
    def of(cls, profiles: dict[str, np.ndarray]) -> "Filters":
        languages = sorted(profiles)
        slices = [np.zeros(SLOTS, dtype=np.uint64) for _ in range(0, len(languages), 64)]
        for n, language in enumerate(languages):
            for slots in _slots(profiles[language]):
                slices[n // 64][np.unique(slots)] |= np.uint64(1) << np.uint64(n % 64)
        filled = [((slices[n // 64] >> np.uint64(n % 64)) & np.uint64(1)).mean() for n in range(len(languages))]
        return cls(languages, slices, np.array(filled) ** PROBES)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        hashes, owners = ngrams(texts)
        all_grams = np.bincount(owners, minlength=len(texts)).astype(np.float64)
        counts = np.zeros((len(self.languages), len(texts)))
        slots = _slots(hashes)
        for part, table in enumerate(self.slices):
            masks = functools.reduce(np.bitwise_and, (table[slot] for slot in slots))
            for n in range(part * 64, min(part * 64 + 64, len(self.languages))):
                found = (masks >> np.uint64(n % 64)) & np.uint64(1)
                counts[n] = np.bincount(owners, weights=found, minlength=len(texts))
        rate = self.false_rate[:, None]
        counts = np.maximum((counts - rate * all_grams) / (1 - rate), 0)
        if not len(self.languages):
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best, total = counts.argmax(axis=0), counts.sum(axis=0)
        score = np.where(total > 0, counts.max(axis=0) / np.maximum(total, 1e-9), 1 / len(self.languages))
        known = all_grams > 0
        return [self.languages[n] if k else UNKNOWN for n, k in zip(best, known)], np.where(known, score, 0.0)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, most=TEXT_BYTES):
        languages, numbers = np.unique(np.array(batch["lang"].to_pylist()), return_inverse=True)
        hashes, owners = ngrams(batch["text"].to_pylist())
        for n, language in enumerate(languages):
            grams, counts = np.unique(hashes[numbers[owners] == n], return_counts=True)
            yield pa.RecordBatch.from_pydict({"lang": [str(language)] * len(grams), "gram": grams.view(np.int64), "n": counts})


def _first(rows: DataFrame, order: list[Column], spread: Column, count: int) -> DataFrame:
    """The first ``count`` rows of each ``lang``: first in each of SALTS parts, then over these."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    salted = salted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= count)
    placed = salted.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return placed.where(F.col("place") <= count).drop("salt")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filters:
    """The filters of the languages of labelled rows; rows without a language tell nothing."""
    texts = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), text_or_empty(text_col).alias("text"))
    texts = texts.where("lang IS NOT NULL AND id IS NOT NULL")
    chosen = _first(texts.select("id", "lang"), [F.xxhash64("id"), F.col("id")], F.xxhash64("id"), SAMPLE_ROWS)
    part = keep_ids(texts, "id", chosen.select(F.col("id").alias("chosen")).distinct())
    counted = part.mapInArrow(_counted, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    profiles = _first(counted, [F.desc("n"), F.col("gram")], F.col("gram"), PROFILE)
    if chosen.select("lang").distinct().count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    by_language: dict[str, list[int]] = {}
    for row in profiles.select("lang", "gram").collect():  # at most MOST_LANGUAGES x PROFILE
        by_language.setdefault(row["lang"], []).append(row["gram"])
    return Filters.of({lang: np.array(grams, dtype=np.int64).view(np.uint64) for lang, grams in by_language.items()})


def predict(docs: DataFrame, filters: Filters, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score of each whole text."""
    text = free_name(docs, "_text")
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text, TEXT_BYTES):
            languages, scores = shared.value.predict(batch[text].to_pylist())
            rest = {name: batch[name] for name in batch.schema.names if name != text}
            yield pa.RecordBatch.from_pydict(rest | {"lang_pred": pa.array(languages, pa.string()), "score": pa.array(scores, pa.float64())})

    kept = bounded_batches(docs.drop("lang_pred", "score"))
    return kept.withColumn(text, text_or_empty(text_col)).mapInArrow(run, f"{schema_of(kept)}, lang_pred string, score double")
