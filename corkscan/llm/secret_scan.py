"""Secrets in texts: candidates by shape, false positives removed by a random forest.

A candidate is a key with a known prefix, a value of ``SHORTEST_VALUE`` characters or
more that is assigned to the name of a credential, whatever it is made of, a run of
``SHORTEST`` characters or more in quotes with a digit in it, or such a run of
characters that keys are made of; where two overlap, the first of these counts. What the forest sees of it: its length and kinds of characters, how
usual its character transitions are among the words of the corpus, how much of it
is covered by the corpus's frequent words, the path of the document, and the words
and signs next to it. Frequent words are counted over all documents. The forest is
grown from labelled findings, of which a bounded sample is brought to the driver;
every candidate of every document is scored in Python tasks.

``weak_labels`` labels findings where no labelled ones are at hand: keys with a
known prefix and values that are assigned to the name of a credential are secrets,
what is part of an address, a number or a host name is not, and the others teach
nothing. Null and empty texts have no candidates. Rows that repeat are scanned
each. Without labelled findings of both kinds every score is 0.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corkscan.llm.common import bounded_batches, steps, text_or_empty
from corkscan.storage import materialise

SHORTEST = 12
SHORTEST_VALUE = 4
# Frequent words of the corpus that count as its dictionary.
DICTIONARY, WORD_LETTERS = 20_000, (3, 12)
# Labelled findings of each kind that the forest is grown from.
SAMPLE_FINDINGS = 5_000
TREES, DEPTH, LEAF, CUTS = 40, 9, 3, 24
THRESHOLD = 0.5
TEXT_BYTES = 2 << 20
# Words that a task counts before it passes them on.
COUNTED_WORDS = 200_000

# Names of credentials, prefixes of keys, and words that speak against a secret.
CREDENTIALS = {"key", "apikey", "token", "secret", "password", "passwd", "passphrase", "pwd", "auth", "authorization", "credential",
               "credentials", "bearer", "private", "access"}
KEY_PREFIXES = r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}"
HARMLESS = {"example", "sample", "test", "dummy", "placeholder", "mail", "email", "phone", "tel", "card", "iban", "isbn", "version", "id", "href"}
PATH_PARTS = {"test", "tests", "example", "examples", "doc", "docs", "fixture", "fixtures", "mock", "vendor", "node_modules"}

FEATURES = ["length", "lower", "upper", "digits", "others", "hex", "changes", "distinct", "usual", "covered", "path_length", "path_harmless",
            "path_depth", "assigned", "quoted", "credential", "harmless", "address", "spaced"]

_CANDIDATE = re.compile(rf"(?<![A-Za-z0-9_+/.-])(?=[A-Za-z_+/.-]*[0-9])[A-Za-z0-9+/][A-Za-z0-9_+/.-]{{{SHORTEST - 1},}}={{0,2}}")
_ASSIGNED = re.compile(
    rf"(?i:{'|'.join(sorted(CREDENTIALS, key=lambda name: (-len(name), name)))})[\"']?\s{{0,3}}[:=]\s{{0,3}}"
    rf"(?:\"(?P<double>[^\"\s]{{{SHORTEST_VALUE},}})\"|'(?P<single>[^'\s]{{{SHORTEST_VALUE},}})'|(?P<bare>[^\s\"'<>,;&]{{{SHORTEST_VALUE},}}))")
_QUOTED = re.compile(rf"([\"'])(?=[^\"'\s]*[0-9])(?P<value>[^\"'\s]{{{SHORTEST},}})\1")
_KNOWN_KEY = re.compile(rf"(?<![A-Za-z0-9])(?:{KEY_PREFIXES})(?![A-Za-z0-9])")
_LETTERS = re.compile(rf"[a-z]{{{WORD_LETTERS[0]},}}")
_PREFIX = re.compile(rf"(?:{KEY_PREFIXES})$")
_NEXT = 40  # characters to either side that neighbours are looked for in


def spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of the candidates of ``text``, in order; no two overlap."""
    found = [(0, *m.span()) for m in _KNOWN_KEY.finditer(text)]
    for m in _ASSIGNED.finditer(text):
        start, end = m.span(m.lastgroup)
        if m.lastgroup == "bare":  # the end of a sentence or bracket is no part of a value
            end = start + len(m[m.lastgroup].rstrip(".!?:)]}"))
        if end - start >= SHORTEST_VALUE:
            found.append((1, start, end))
    found += [(2, *m.span("value")) for m in _QUOTED.finditer(text)]
    found += [(3, *m.span()) for m in _CANDIDATE.finditer(text)]
    # The surer kinds first; what overlaps one that is kept goes.
    kept: list[tuple[int, int]] = []
    for _, start, end in sorted(found):
        at = bisect.bisect(kept, (start, end))
        if (at == 0 or kept[at - 1][1] <= start) and (at == len(kept) or end <= kept[at][0]):
            kept.insert(at, (start, end))
    return kept


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): the words of lower-case Latin letters of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def passed_on() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_pydict({"word": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})
            counts.clear()
            return rows

        for batch in steps(batches, most=TEXT_BYTES):
            for text in batch["text"].to_pylist():
                counts.update(_LETTERS.findall(text.lower()))
            if len(counts) > COUNTED_WORDS:
                yield passed_on()
        yield passed_on()

    texts = bounded_batches(docs.select(text_or_empty(text_col).alias("text")))
    counted = texts.mapInArrow(run, "word string, n bigint").where(F.length("word") <= WORD_LETTERS[1])
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counted: DataFrame, most: int) -> list:
    """The ``most`` rows of (word, n) with the largest counts; of equal ones, the first words.

    Counts are first put into classes, a few hundred whatever the corpus holds, so
    that the tasks need only put the classes in order that can be among the largest.
    """
    size = F.floor(F.log2("n") * 8)
    classes = sorted(counted.groupBy(size.alias("size")).agg(F.count("*").alias("words")).collect(), reverse=True)
    least, seen = 0, 0
    for row in classes:
        least, seen = row["size"], seen + row["words"]
        if seen >= most:
            break
    return counted.where(size >= least).orderBy(F.desc("n"), "word").limit(most).collect()


class Corpus:
    """Frequent words, and how usual each transition between characters is in them."""

    def __init__(self, words: dict[str, int]):
        self.words = frozenset(words)
        seen = np.full((128, 128), 0.1)
        for word, count in words.items():
            codes = np.frombuffer(word.encode("ascii"), dtype=np.uint8)
            np.add.at(seen, (codes[:-1], codes[1:]), np.log1p(count))
        self.transitions = np.log(seen / seen.sum(axis=1, keepdims=True))

    def usual(self, value: str) -> float:
        """The mean log-chance of the transitions of ``value``; characters beyond ASCII count as one that no word has."""
        codes = np.frombuffer(value.lower().encode("ascii", "replace"), dtype=np.uint8)
        return float(self.transitions[codes[:-1], codes[1:]].mean()) if len(codes) > 1 else 0.0

    def covered(self, value: str) -> float:
        """The share of ``value`` that frequent words cover, the longest first."""
        value, at, covered = value.lower(), 0, 0
        while at < len(value):
            for size in range(min(WORD_LETTERS[1], len(value) - at), WORD_LETTERS[0] - 1, -1):
                if value[at : at + size] in self.words:
                    covered += size
                    at += size
                    break
            else:
                at += 1
        return covered / len(value)


def features(value: str, before: str, after: str, path: str, corpus: Corpus) -> list[float]:
    size = len(value)
    kinds = ["l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "o" for c in value]
    counts = Counter(kinds)
    near = [word for word in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", before).lower()) if word][-3:]
    parts = set(re.split(r"[^a-z]+", path.lower()))
    return [
        size, counts["l"] / size, counts["u"] / size, counts["d"] / size, counts["o"] / size,
        sum(c in "0123456789abcdef" for c in value) / size, sum(a != b for a, b in zip(kinds, kinds[1:])) / size,
        len(set(value)) / size, corpus.usual(value), corpus.covered(value),
        len(path), bool(parts & PATH_PARTS), path.count("/"),
        bool(re.search(r"[=:]\s*[\"']?$", before)), before[-1:] in ("'", '"') and after[:1] == before[-1:],
        bool(set(near) & CREDENTIALS), bool(set(near) & HARMLESS), "@" in (before[-1:], after[:1]), before[-1:].isspace() or not before,
    ]


def _scan(corpus):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, most=TEXT_BYTES):
            rows = {name: [] for name in ("id", "start", "value", "before", "after", "features")}
            for n, text in enumerate(batch["text"].to_pylist()):
                for start, end in spans(text):
                    value, before, after = text[start:end], text[max(0, start - _NEXT) : start], text[end : end + _NEXT]
                    rows["id"].append(n)
                    rows["start"].append(start)
                    rows["value"].append(value)
                    rows["before"].append(before)
                    rows["after"].append(after)
                    rows["features"].append([float(x) for x in features(value, before, after, batch["path"][n].as_py(), corpus.value)])
            ids = batch["id"].take(pa.array(rows.pop("id"), pa.int64()))
            yield pa.RecordBatch.from_pydict({
                "id": ids, "start": pa.array(rows["start"], pa.int64()), "value": pa.array(rows["value"], pa.string()),
                "before": pa.array(rows["before"], pa.string()), "after": pa.array(rows["after"], pa.string()),
                "features": pa.array(rows["features"], pa.list_(pa.float64()))})

    return run


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(id, start, value, before, after, features): every candidate of every text, from character ``start`` (0 is the first)."""
    frequent = frequent_words(materialise(count_words(docs, text_col), "words"), DICTIONARY)
    corpus = docs.sparkSession.sparkContext.broadcast(Corpus({row["word"]: row["n"] for row in frequent}))
    texts = bounded_batches(docs).select(
        F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), text_or_empty(path_col).alias("path"))
    id_type = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(_scan(corpus), f"id {id_type}, start bigint, value string, before string, after string, features array<double>")


def weak_labels(found: DataFrame) -> DataFrame:
    """``found`` with a label: 1 for a secret, 0 for none, null where the rules say nothing."""
    feature = lambda name: F.get("features", FEATURES.index(name))
    secret = F.col("value").rlike(f"^(?:{KEY_PREFIXES})$") | (
        (feature("assigned") == 1) & (feature("credential") == 1) & (feature("covered") < 0.5))
    harmless = (feature("address") == 1) | (feature("harmless") == 1) | F.col("value").rlike(
        r"^[0-9.+/-]+$|^[A-Za-z]+[0-9]{0,3}$|\.(?:com|org|net|html|php)\b")
    return found.withColumn("label", F.when(secret, 1).when(harmless, 0))


@dataclass
class Forest:
    """Trees as arrays: what is compared with which cut, where to go, and the share of secrets."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        for feature, cut, below, share in self.trees:
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(DEPTH):
                inner = below[node] > 0
                right = rows[np.arange(len(rows)), feature[node]] > cut[node]
                node = np.where(inner, below[node] + right, node)
            total += share[node]
        return total / max(len(self.trees), 1)


def grow(rows: np.ndarray, labels: np.ndarray, seed: int = 11) -> Forest:
    """A forest of trees on bootstrap samples, with some of the features tried at each node."""
    rng = np.random.default_rng(seed)
    tried = max(2, int(np.sqrt(rows.shape[1])) + 1)
    # Both kinds weigh the same.
    weight = np.where(labels == 1, 0.5 / max((labels == 1).sum(), 1), 0.5 / max((labels == 0).sum(), 1)) * len(labels)
    trees = []
    for _ in range(TREES):
        feature, cut, below, share = [0], [0.0], [0], [0.0]
        waiting = [(0, rng.integers(0, len(rows), len(rows)), 0)]
        while waiting:
            node, part, depth = waiting.pop()
            x, y, w = rows[part], labels[part], weight[part]
            total, secrets = w.sum(), w[y == 1].sum()
            share[node] = secrets / total
            if depth == DEPTH - 1 or len(part) < 2 * LEAF or secrets in (0, total):
                continue
            best = (1e-9, -1, 0.0)
            for column in rng.choice(rows.shape[1], tried, replace=False):
                values = x[:, column]
                for at in np.unique(np.quantile(values, np.linspace(0.02, 0.98, CUTS))):
                    left = values <= at
                    if min(left.sum(), (~left).sum()) < LEAF:
                        continue
                    wl, sl = w[left].sum(), w[left & (y == 1)].sum()
                    wr, sr = total - wl, secrets - sl
                    gain = secrets * secrets / total + (total - secrets) ** 2 / total  # Gini, as sums of squares
                    gain = (sl * sl + (wl - sl) ** 2) / wl + (sr * sr + (wr - sr) ** 2) / wr - gain
                    if gain > best[0]:
                        best = (gain, column, float(at))
            if best[1] < 0:
                continue
            left = x[:, best[1]] <= best[2]
            feature[node], cut[node], below[node] = int(best[1]), best[2], len(feature)
            for side in (part[left], part[~left]):
                waiting.append((len(feature), side, depth + 1))
                for column in (feature, cut, below, share):
                    column.append(0)
        trees.append((np.array(feature), np.array(cut, dtype=np.float64), np.array(below), np.array(share, dtype=np.float64)))
    return Forest(trees)


def fit(findings: DataFrame) -> Forest:
    """A forest of labelled findings (id, start, features, label); null labels are left out."""
    rows = []
    for label in (0, 1):
        kind = findings.where(F.col("label") == label).select("features", "label", "id", "start")
        rows += kind.orderBy(F.xxhash64("id", "start"), "id", "start").limit(SAMPLE_FINDINGS).collect()
    if len({row["label"] for row in rows}) < 2:
        return Forest([])
    return grow(np.array([row["features"] for row in rows], dtype=np.float64), np.array([row["label"] for row in rows]))


def score(found: DataFrame, forest: Forest) -> DataFrame:
    """``found`` with the score of each candidate, 0 to 1."""
    shared = found.sparkSession.sparkContext.broadcast(forest)

    @F.arrow_udf("double")
    def scored(lists: pa.Array) -> pa.Array:
        rows = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), len(FEATURES))
        return pa.array(shared.value.scores(rows), pa.float64())

    return found.withColumn("score", scored(F.col("features")))


def scan(docs: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(id, start, length, value, label, score, secret): every candidate of ``docs``.

    The forest learns from findings in rows where ``learns``, a condition on ``id``, holds.
    """
    found = materialise(weak_labels(candidates(docs, id_col, text_col, path_col)), "candidates")
    scored = score(found, fit(found.where(learns)))
    return scored.select(F.col("id").alias(id_col), "start", F.length("value").cast("bigint").alias("length"), "value", "label", "score",
                         (F.col("score") >= THRESHOLD).alias("secret"))
