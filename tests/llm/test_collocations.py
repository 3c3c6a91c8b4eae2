"""Phrases against plain counting of every run of words."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from corkscan.llm import collocations as module
from corkscan.llm.collocations import collocations, count_phrases

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id BIGINT, text STRING, lang STRING"
FIELDS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def counted(rows):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(AZ)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for k in range(1, 6):
                counts[lang or "und"].update(tuple(words[at : at + k]) for at in range(len(words) - k + 1))
    return counts, totals


def expected(rows, least, most):
    counts, totals = counted(rows)
    for lang, every in counts.items():
        phrases = {phrase: f for phrase, f in every.items() if len(phrase) > 1 and f >= least}
        inside = defaultdict(int)
        for phrase, f in phrases.items():
            for k in range(2, len(phrase)):
                for at in range(len(phrase) - k + 1):
                    inside[phrase[at : at + k]] = max(f, inside[phrase[at : at + k]])
        found = []
        for phrase, a in phrases.items():
            if 100 * inside[phrase] < 100 * a:
                score, k = min((1000 * a * totals[lang] // (every[phrase[:k]] * every[phrase[k:]]), k) for k in range(1, len(phrase)))
                found.append((-score, -a, " ".join(phrase).encode(), every[phrase[:k]], every[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:most], 1):
            yield lang, rank, phrase.decode(), -a, left, right, totals[lang], -score


def told(frame):
    return sorted(tuple(r) for r in frame.withColumnRenamed("part", "lang").select(*FIELDS).collect())


def random_docs(rng, number, words):
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b"]
    for doc in range(number):
        text = "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.choice([0, 1, 2, 7, 60])))
        yield rng.choice([None, doc, doc // 2]), rng.choice([text, text, text, None]), rng.choice([None, "en", "de", "und"])


def test_random_documents(spark):
    rng = random.Random(3)
    words = ["the", "The", "of", "é", "É", "a b", "x-y", "z", "日本", "w1", "w2"]
    rows = list(random_docs(rng, 300, words)) + [(n, "one two three four five six", "en") for n in range(9)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    for least, most in ((3, 2000), (6, 11), (1, 40)):
        assert told(collocations(docs, least, most)) == sorted(expected(rows, least, most))


def test_counts_of_all_orders_in_few_buckets(spark, monkeypatch):
    """Pairs that share a bucket change nothing, and neither does the length of a step."""
    rows = list(random_docs(random.Random(8), 200, [f"w{n}" for n in range(30)]))
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    counts, totals = counted(rows)
    plain = {(lang, phrase): f for lang, every in counts.items() for phrase, f in every.items() if f >= 4}
    for buckets in (1, 64, 1 << 20):
        monkeypatch.setattr(module, "LEAST_BUCKETS", buckets)
        monkeypatch.setattr(module, "MOST_BUCKETS", buckets)
        phrases, words = count_phrases(docs, 4)
        assert {(r.part, tuple(r.phrase.split(" "))): r.f for r in phrases.collect()} == plain
        assert {r.part: r.total for r in words.collect() if r.total} == {part: n for part, n in totals.items() if n}


def test_long_texts_are_cut_between_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(module, "STEP_BYTES", 40)
    text = "a b c. " * 50 + "d " * 60
    batch = pa.RecordBatch.from_pydict({"part": ["en"], "text": [text]})
    stretches = [(list(words), numbers) for _, words, numbers in module._numbered(iter([batch]))]
    assert len(stretches) > 3 and all(numbers[-1] == 0 for _, numbers in stretches)
    joined = [words[n] for words, numbers in stretches for n in numbers]
    assert joined.count(b"a") == 50 and joined.count(b"d") == 60


def test_scores_beyond_64_bits(spark):
    big = 10**14
    phrases = spark.createDataFrame(
        [("p", "x", big), ("p", "y", 3 * big), ("p", "x y", big - 1)], "part STRING, phrase STRING, f BIGINT")
    totals = spark.createDataFrame([("p", 9 * 10**15)], "part STRING, total BIGINT")
    row = module.scored(module.compacted(phrases), phrases, totals).first()
    assert row.score == 1000 * (big - 1) * 9 * 10**15 // (big * 3 * big)


def test_distinct_rows_of_any_width():
    rng = np.random.default_rng(1)
    for values in (2, 1000, 1 << 40):
        rows = rng.integers(0, min(values, 3), (200, 5)) * max(1, (values - 1) // 2)
        found, times = module._distinct_rows(rows, values)
        plain = Counter(map(tuple, rows.tolist()))
        assert dict(zip(map(tuple, found.tolist()), times.tolist())) == plain


def test_one_hot_phrase_clashing_columns_and_empty_tables(spark):
    rows = [(n, "hot phrase here", "en") for n in range(3000)] + [(n, f"cold{n % 7} word", "en") for n in range(1000)]
    docs = spark.createDataFrame([(*row, 1, 2, 3) for row in rows], DOCS + ", words INT, part INT, n INT").repartition(8)
    assert told(collocations(docs)) == sorted(expected(rows, 100, 2000))
    assert collocations(docs.limit(0)).count() == 0
    nothing = spark.createDataFrame([(1, None, None), (2, "", "en"), (3, " . ", "en")], DOCS)
    assert collocations(nothing, 1).count() == 0
