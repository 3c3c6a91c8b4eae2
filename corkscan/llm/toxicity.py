"""Toxic texts by a convolutional classifier over hashed word embeddings, in numpy.

A word is the mean of hashed embeddings of itself and of its character n-grams, so
that forms of a word not met before are near the known ones. Filters of widths 1,
2 and 3 run over the whole text, the strongest response of each is kept (max
pooling), and a linear layer gives the logit. It is trained on a bounded sample of
labelled rows on the driver; scoring reads every text in Python tasks. Training
begins where naive Bayes ends: one direction of the embeddings is the log-odds of a
slot among toxic and other texts, and some filters look along it.

A second linear layer over the mean of the word embeddings tells the language, as
far as the text shows it. Thresholds are set for each such language on a part of
the sample that was not trained on, and the logit is moved so that the threshold
of each language becomes a score of 0.3.

Null and empty texts, and texts without a word, are scored like any other: every
filter is silent. Rows that repeat are scored each. Without labelled rows of both
kinds there is nothing to learn, and every score is 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corkscan.llm.common import bounded_batches, free_name, give_back_memory, schema_of, steps, text_or_empty

# The sample that is learned from: rows of each label, and characters in all.
SAMPLE_ROWS = 2_000
SAMPLE_CHARS = 16_000_000
THRESHOLD = 0.3
# The texts that a task scores at once, in bytes.
TEXT_BYTES = 384 << 10

SLOTS, DIM, FILTERS, WIDTHS, NGRAMS = 1 << 17, 12, 8, (1, 2, 3), (3, 4, 5)
BATCH, STEPS, EPOCHS, RATE = 48, 160, 3, 0.05

_WORD = re.compile(r"\w+")
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def hashed_parts(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(slots, owners): the slots of each word and of its n-grams, owners ascending."""
    marked = "".join([f"<{word}>" for word in words])
    chars = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(word) + 2 for word in words], dtype=np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(chars)) - np.repeat(ends - sizes, sizes)
    slots, owners = [], []
    rolling = np.zeros(len(chars), dtype=np.uint64)
    for n in range(max(NGRAMS)):
        shifted = np.zeros(len(chars), dtype=np.uint64)
        shifted[: len(chars) - n] = chars[n:]
        rolling = rolling * _GOLDEN + shifted
        if n + 1 in NGRAMS:
            whole = np.flatnonzero(place + n < np.repeat(sizes, sizes))
            slots.append(_mix(rolling[whole] + np.uint64(n)))
            owners.append(owner[whole])
    spread = _mix(chars + (place.astype(np.uint64) + np.uint64(1)) * _GOLDEN)
    slots.append(_mix(np.add.reduceat(spread, ends - sizes)))
    owners.append(np.arange(len(words)))
    slots, owners = np.concatenate(slots), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return (slots[order] % np.uint64(SLOTS)).astype(np.int64), owners[order]


@dataclass
class Texts:
    """Texts as numbers of different words; two silent words follow each text."""

    words: list[str]
    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def read(texts: list[str]) -> Texts:
    numbers = _Numbers()
    number = numbers.__getitem__
    each = [list(map(number, _WORD.findall(text.lower()))) for text in texts]
    silent, flat, starts, ends = len(numbers), [], [], []
    for ids in each:
        starts.append(len(flat))
        flat += ids
        ends.append(len(flat))
        flat += [silent] * (max(WIDTHS) - 1)
    return Texts(list(numbers), np.array(flat, dtype=np.int64), np.array(starts), np.array(ends))


@dataclass
class Model:
    embeddings: np.ndarray
    filters: np.ndarray  # DIM x (sum of WIDTHS) * FILTERS
    filter_bias: np.ndarray
    output: np.ndarray
    output_bias: float
    languages: list[str] = field(default_factory=list)
    language_layer: np.ndarray | None = None
    thresholds: np.ndarray | None = None  # logits, by language

    def mean_of(self, slots: np.ndarray, owners: np.ndarray) -> np.ndarray:
        """The embedding of each word, from its slots."""
        starts = np.flatnonzero(np.append(True, owners[1:] != owners[:-1]))
        sums = np.add.reduceat(self.embeddings[slots], starts, axis=0)
        return sums / np.bincount(owners)[:, None].astype(np.float32)

    def words(self, words: list[str]) -> np.ndarray:
        return self.mean_of(*hashed_parts(words)) if words else np.zeros((0, DIM), dtype=np.float32)

    def responses(self, texts: Texts, of_word: np.ndarray) -> np.ndarray:
        """What each filter says at each place, before its bias."""
        table = np.vstack([of_word @ self.filters, np.zeros((1, self.filters.shape[1]), dtype=np.float32)])
        count, result, column = len(texts.ids), [], 0
        for width in WIDTHS:
            total = np.zeros((count, FILTERS), dtype=np.float32)
            for n in range(width):
                total[: count - n] += table[texts.ids[n:], column : column + FILTERS]
                column += FILTERS
            result.append(total)
        return np.hstack(result)

    def pooled(self, texts: Texts, said: np.ndarray) -> np.ndarray:
        """The strongest response of each filter in each text; 0 in texts without words."""
        result = np.full((len(texts.starts), said.shape[1]), -np.inf, dtype=np.float32)
        some = texts.ends > texts.starts
        if some.any():
            bounds = np.column_stack([texts.starts[some], texts.ends[some]]).ravel()
            result[some] = np.maximum.reduceat(said, bounds, axis=0)[::2]
        return np.maximum(result + self.filter_bias, 0)

    def mean_words(self, texts: Texts, of_word: np.ndarray) -> np.ndarray:
        table = np.vstack([of_word, np.zeros((1, DIM), dtype=np.float32)])
        result = np.zeros((len(texts.starts), DIM + 1), dtype=np.float32)
        result[:, DIM] = 1
        for n, (start, end) in enumerate(zip(texts.starts, texts.ends)):
            if end > start:
                result[n, :DIM] = table[texts.ids[start:end]].mean(axis=0) * 10
        return result

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text its logit and the number of its language."""
        found = read(texts)
        of_word = self.words(found.words)
        logit = self.pooled(found, self.responses(found, of_word)) @ self.output + self.output_bias
        if self.language_layer is None:
            return logit, np.zeros(len(texts), dtype=np.int64)
        return logit, (self.mean_words(found, of_word) @ self.language_layer).argmax(axis=1)

    def scores(self, texts: list[str]) -> np.ndarray:
        logit, language = self.logits(texts)
        moved = logit.astype(np.float64) - self.thresholds[language] + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(moved, -50, 50)))


def silent() -> Model:
    """The model of no labels: every score is 0, as nearly as the logits go."""
    zeros = np.zeros(len(WIDTHS) * FILTERS, dtype=np.float32)
    return Model(np.zeros((SLOTS, DIM), dtype=np.float32), np.zeros((DIM, sum(WIDTHS) * FILTERS), dtype=np.float32),
                 zeros, zeros, -50.0, ["any"], None, np.zeros(1))


def train(texts: list[str], toxic: np.ndarray, languages: list[str | None], seed: int = 7) -> Model:
    """A model of labelled texts; a fifth of them only sets the thresholds."""
    rng = np.random.default_rng(seed)
    held = np.zeros(len(texts), dtype=bool)
    for label in (0, 1):
        held[np.flatnonzero(toxic == label)[::5]] = True
    learned = rng.permutation(np.flatnonzero(~held))
    share = np.array([(toxic[learned] == label).sum() for label in (0, 1)])
    if (share == 0).any():
        raise ValueError("the sample must hold labelled texts of both kinds")
    weight = len(learned) / 2 / share

    batches, seen = [], np.zeros((2, SLOTS))
    for start in range(0, len(learned), BATCH):
        chosen = learned[start : start + BATCH]
        found = read([texts[n] for n in chosen])
        slots, owners = hashed_parts(found.words) if found.words else (np.empty(0, dtype=np.int64),) * 2
        slots, owners = slots.astype(np.int32), owners.astype(np.int32)
        batches.append((chosen, found, slots, owners))
        first = np.searchsorted(owners, np.arange(len(found.words) + 1))
        for n, begin, end in zip(chosen, found.starts, found.ends):
            words = np.unique(found.ids[begin:end])
            if len(words):
                of_text = np.concatenate([slots[first[w] : first[w + 1]] for w in words])
                seen[toxic[n], np.unique(of_text)] += 1
    odds = np.log((seen[1] / share[1] + 0.02) / (seen[0] / share[0] + 0.02))

    columns = sum(WIDTHS) * FILTERS
    model = Model(rng.normal(0, 0.3, (SLOTS, DIM)).astype(np.float32), rng.normal(0, 0.3, (DIM, columns)).astype(np.float32),
                  np.zeros(len(WIDTHS) * FILTERS, dtype=np.float32), np.zeros(len(WIDTHS) * FILTERS, dtype=np.float32), -1.0)
    model.embeddings[:, 0] = odds
    for group in range(len(WIDTHS)):
        one = sum(WIDTHS[:group]) * FILTERS
        model.filters[0, one : one + FILTERS // 2] = 1.0
        model.output[group * FILTERS : group * FILTERS + FILTERS // 2] = 0.3
    squares = {name: np.full(np.shape(value), 1e-2, dtype=np.float32) for name, value in
               (("embeddings", model.embeddings), ("filters", model.filters), ("filter_bias", model.filter_bias), ("output", model.output))}
    bias_square = 1e-2

    def update(name: str, gradient: np.ndarray, rows=slice(None)) -> None:
        squares[name][rows] += gradient**2
        getattr(model, name)[rows] -= RATE * gradient / np.sqrt(squares[name][rows])

    for _ in range(max(EPOCHS, int(np.ceil(STEPS / len(batches))))):
        for number in rng.permutation(len(batches)):
            chosen, found, slots, owners = batches[number]
            if not found.words:
                continue
            of_word = model.mean_of(slots, owners)
            said = model.responses(found, of_word)
            pooled = model.pooled(found, said)
            logit = pooled @ model.output + model.output_bias
            truth = toxic[chosen]
            error = ((1 / (1 + np.exp(-logit)) - truth) * weight[truth] / len(chosen)).astype(np.float32)

            # Back through the one place where each filter was strongest.
            inward = error[:, None] * model.output[None, :] * (pooled > 0)
            cells, parts = [], []
            for n, (begin, end) in enumerate(zip(found.starts, found.ends)):
                if end > begin:
                    at, column = begin + said[begin:end].argmax(axis=0), 0
                    for group, width in enumerate(WIDTHS):
                        part = slice(group * FILTERS, (group + 1) * FILTERS)
                        for k in range(width):
                            cells.append(found.ids[at[part] + k] * columns + column + np.arange(FILTERS))
                            parts.append(inward[n, part])
                            column += FILTERS
            to_words = np.bincount(np.concatenate(cells), np.concatenate(parts), (len(found.words) + 1) * columns)
            to_words = to_words.reshape(-1, columns)[:-1].astype(np.float32)
            touched = np.flatnonzero(np.abs(to_words).max(axis=1) > 0)
            back = to_words[touched] @ model.filters.T / np.bincount(owners, minlength=len(found.words))[touched][:, None]
            update("filters", of_word[touched].T @ to_words[touched])
            update("filter_bias", inward.sum(axis=0))
            update("output", pooled.T @ error)
            bias_square += error.sum() ** 2
            model.output_bias -= RATE * error.sum() / np.sqrt(bias_square)
            position = np.full(len(found.words), -1)
            position[touched] = np.arange(len(touched))
            used = position[owners] >= 0
            rows, place = np.unique(slots[used], return_inverse=True)
            gradient = np.zeros((len(rows), DIM), dtype=np.float32)
            np.add.at(gradient, place, back[position[owners[used]]])
            update("embeddings", gradient, rows)
    _calibrate(model, texts, toxic, languages, held)
    return model


def _best_threshold(logit: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the gap with the fewest errors, where both kinds weigh the same."""
    order = np.argsort(logit)
    ordered, truth = logit[order], toxic[order]
    missed = np.append(0, np.cumsum(truth)) / max(truth.sum(), 1)
    false = np.append((truth == 0).sum(), (truth == 0).sum() - np.cumsum(truth == 0)) / max((truth == 0).sum(), 1)
    best = np.flatnonzero(missed + false == (missed + false).min())
    cut = best[len(best) // 2]
    low, high = ordered[max(cut - 1, 0)], ordered[min(cut, len(ordered) - 1)]
    return float(low + high) / 2


def _calibrate(model: Model, texts: list[str], toxic: np.ndarray, languages: list[str | None], held: np.ndarray) -> None:
    model.languages = sorted({lang for lang in languages if lang is not None}) or ["any"]
    logits, means = [], []
    for start in range(0, len(texts), BATCH):
        found = read(texts[start : start + BATCH])
        of_word = model.words(found.words)
        logits.append(model.pooled(found, model.responses(found, of_word)) @ model.output + model.output_bias)
        means.append(model.mean_words(found, of_word))
    logits, means = np.concatenate(logits), np.concatenate(means)
    known = np.array([lang is not None for lang in languages])
    answer = np.zeros((len(texts), len(model.languages)), dtype=np.float32)
    for n in np.flatnonzero(known):
        answer[n, model.languages.index(languages[n])] = 1
    layer = np.zeros((means.shape[1], len(model.languages)), dtype=np.float32)
    momentum = np.zeros_like(layer)
    for _ in range(600):
        guess = means[known] @ layer
        guess = np.exp(guess - guess.max(axis=1, keepdims=True))
        guess /= guess.sum(axis=1, keepdims=True)
        momentum = 0.9 * momentum + means[known].T @ (guess - answer[known]) / max(known.sum(), 1)
        layer -= 0.3 * momentum
    model.language_layer = layer
    language = (means @ layer).argmax(axis=1)
    overall = _best_threshold(logits[held], toxic[held])
    model.thresholds = np.full(len(model.languages), overall)
    for n in range(len(model.languages)):
        part = held & (language == n)
        if min((toxic[part] == 0).sum(), (toxic[part] == 1).sum()) >= 5:
            model.thresholds[n] = _best_threshold(logits[part], toxic[part])


def sample(texts: DataFrame, told: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list:
    """At most ``rows`` labelled texts of each kind, in the order of a hash of their
    identifier, and at most ``chars`` characters in all: (id, text, lang, label).

    Only sizes are joined with the labels; texts are read for the chosen rows alone.
    """
    sizes = texts.select("id", F.length("text").alias("size")).join(told, "id")
    chosen, budget = [], chars // 2
    for label in (0, 1):
        picked, left = sizes.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(rows).collect(), budget
        for row in picked:
            if row["size"] <= left:
                left -= row["size"]
                chosen.append((row["id"], label))
    if not chosen:
        return []
    ids = texts.sparkSession.createDataFrame(sorted(set(chosen)), told.schema)  # at most 2 x rows
    # Of an identifier that is repeated, the smallest text: a row for each that was chosen.
    found = texts.join(F.broadcast(ids), "id").groupBy("id", "label").agg(F.min(F.struct("text", "lang")).alias("told"))
    found = found.select("id", "told.*", "label").collect()
    return sorted(found, key=lambda row: (row["label"], row["id"], row["text"]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        lang_col: str = "lang") -> Model:
    """A model of the rows of ``docs`` that ``labels`` tells about."""
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), F.col(lang_col).alias("lang"))
    told = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label IS NOT NULL")
    rows = sample(texts, told)
    if len({row["label"] for row in rows}) < 2:
        return silent()
    model = train([row["text"] for row in rows], np.array([row["label"] for row in rows], dtype=np.int64), [row["lang"] for row in rows])
    del rows
    give_back_memory()
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text, 0 to 1."""
    text = free_name(docs, "_text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text, TEXT_BYTES):
            found = shared.value.scores(batch[text].to_pylist())
            rest = {name: batch[name] for name in batch.schema.names if name != text}
            yield pa.RecordBatch.from_pydict(rest | {score_col: pa.array(found, pa.float64())})
        give_back_memory()

    kept = bounded_batches(docs.drop(score_col))
    return kept.withColumn(text, text_or_empty(text_col)).mapInArrow(run, f"{schema_of(kept)}, `{score_col}` double")
