"""Licence notices against a plain scan of every block."""

import random
import re
from math import ceil

import pytest

from corkscan.llm import license_scan as module
from corkscan.llm.license_scan import NOTICES, PHRASES, TEMPLATES_SCHEMA, scan

DOCS = "doc_id BIGINT, text STRING"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))


def expected(text, templates, share):
    """(n_words, n_places, first, last, phrase labels, labels, score) from every block and every template."""
    words, places, phrase_labels, labels, score = words_of(text), [], set(), set(), 0.0
    for label, template, phrase in templates:
        own = words_of(template)
        if not own:
            continue
        if phrase:
            starts = [at for at in range(len(words)) if words[at : at + len(own)] == own]
            places += starts
            if starts:
                phrase_labels.add(label)
                labels.add(label)
                score = 1.0
            continue
        width = 4
        while width < len(own):
            width *= 2
        for start in range(0, len(words), width):
            common = len(set(own) & set(words[start : start + 2 * width]))
            if common >= ceil(round(share * len(set(own)), 9)):
                labels.add(label)
                score = max(score, common / len(set(own)))
    return (len(words), len(places), min(places, default=None), max(places, default=None), sorted(phrase_labels), sorted(labels), score)


def told(frame):
    return sorted(((r.doc_id, (r.n_words, r.n_places, r.first_word, r.last_word, r.phrase_labels, r.labels, r.score)) for r in frame.collect()), key=str)


DEFAULT = [(label, text, True) for text, label in PHRASES] + [(label, text, False) for label, text in NOTICES]


def test_random_texts_with_notices(spark):
    rng = random.Random(4)
    vocabulary = sorted({word for _, text, _ in DEFAULT for word in words_of(text)}) + ["x", "y", "é", "日本", "12"]
    rows = []
    for doc in range(400):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 5, 40, 400]))]
        for _ in range(rng.choice([0, 0, 1, 3])):
            notice = rng.choice(DEFAULT)[1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                notice[rng.randrange(len(notice))] = rng.choice(vocabulary)
            at = rng.randrange(len(words) + 1)
            words[at:at] = notice
        text = "".join(rng.choice([word, word.upper(), word.title()]) + rng.choice([" ", "-", ".\n", "_", "\x00"]) for word in words)
        rows.append((rng.choice([None, doc, doc // 2]), rng.choice([text, text, text, text, None])))
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    assert told(scan(docs)) == sorted(((doc, expected(text, DEFAULT, 0.9)) for doc, text in rows), key=str)


@pytest.mark.parametrize("share", [0.3, 0.5, 1.0])
def test_other_templates_and_shares(spark, share):
    rng = random.Random(int(share * 10))
    letters = "abcdefgh"
    templates = [(f"t{n}", " ".join(rng.choice(letters) for _ in range(rng.randrange(0, 12))), rng.random() < 0.4) for n in range(12)]
    templates += [("twice", "a a", True), ("none", None, False)]
    rows = [(doc, " ".join(rng.choice(letters + "xyz") for _ in range(rng.randrange(0, 60)))) for doc in range(150)]
    found = scan(spark.createDataFrame(rows, DOCS).repartition(4), spark.createDataFrame(templates, TEMPLATES_SCHEMA), share)
    assert told(found) == sorted(((doc, expected(text, templates, share)) for doc, text in rows), key=str)


def test_planted_lines(spark):
    rows = [(1, "Alle.\nLicensed under the Apache License, Version 2.0.\nRest"), (2, "This work is licensed under the GNU General Public License, version 3."),
            (3, "Released under the MIT License."), (4, "Licensed under CC BY-NC 4.0."), (5, "(c) ALL RIGHTS  RESERVED. All rights reserved"),
            (6, "released under the other license"), (7, "all rights are reserved; cc. by_ general license public")]
    found = {r.doc_id: r for r in scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert {doc: ",".join(r.labels) for doc, r in found.items()} == {
        1: "apache-2.0", 2: "gpl", 3: "mit", 4: "cc-by,cc-by-nc", 5: "reserved", 6: "", 7: "cc-by"}
    assert (found[5].n_places, found[5].first_word, found[5].last_word) == (2, 1, 4)
    assert found[4].phrase_labels == ["cc-by"] and found[4].blocks[0].label == "cc-by"


def test_a_long_text_of_notices(spark, monkeypatch):
    monkeypatch.setattr(module, "STEP_BYTES", 1000)
    text = "all rights reserved " * 20_000 + "x" * 50_000
    row = scan(spark.createDataFrame([(1, text)], DOCS)).first()
    assert (row.n_words, row.n_places, row.first_word, row.last_word) == (60_001, 20_000, 0, 59_997)


def test_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "cc by", 1, 2, 3, 4)], DOCS + ", id INT, row INT, n_words INT, blocks INT")
    assert scan(docs).select("doc_id", "n_places").collect() == [(1, 1)]
    assert scan(docs.limit(0)).count() == 0
    nothing = scan(docs, spark.createDataFrame([], TEMPLATES_SCHEMA)).collect()
    assert [(r.n_words, r.labels, r.score) for r in nothing] == [(2, [], 0.0)]


def test_too_many_templates(spark, monkeypatch):
    monkeypatch.setattr(module, "MOST_TEMPLATE_WORDS", 3)
    with pytest.raises(ValueError):
        scan(spark.createDataFrame([(1, "a")], DOCS))
