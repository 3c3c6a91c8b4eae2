"""Near-duplicates against all pairs, and signatures against weighted Jaccard similarity."""

import random

import numpy as np

from corkscan.llm import bag_minhash as B
from corkscan.llm.components import components


def similarity(a, b):
    a, b = B.as_set(B.shingles(a)), B.as_set(B.shingles(b))
    both = len(np.intersect1d(a, b))
    return both / (len(a) + len(b) - both)


def classes_by_all_pairs(rows):
    label = {doc: doc for doc, _ in rows}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    with_words = [(doc, text) for doc, text in rows if text and len(B.shingles(text))]
    for n, (a, one) in enumerate(with_words):
        for b, other in with_words[:n]:
            if similarity(one, other) >= B.SIMILARITY:
                low, high = sorted((find(a), find(b)))
                label[high] = low
    return {doc: find(doc) for doc, _ in rows}


def words(rng, count, names=400):
    return [f"w{rng.randrange(names)}" for _ in range(count)]


def test_signatures_are_unbiased():
    agree, truth = [], []
    for seed in range(60):
        rng = random.Random(seed)
        one = words(rng, 200)
        other = list(one)
        for _ in range(8):
            other[rng.randrange(200)] = "changed"
        one, other = one + one[:50] * 4, other + other[:50] * rng.choice([1, 3, 9])  # weights
        a, b = " ".join(one), " ".join(other)
        signed = B.signatures([B.shingles(a), B.shingles(b)], 200)
        agree.append((signed[0] == signed[1]).mean())
        truth.append(similarity(a, b))
    assert abs(np.mean(agree) - np.mean(truth)) < 0.02


def test_classes_equal_all_pairs(spark):
    rng = random.Random(3)
    rows, passage = [], words(rng, 60)
    base = words(rng, 120)
    for n in range(150):  # a group of near copies of many degrees, larger than a small bucket
        copy = list(base)
        for _ in range(rng.randrange(8)):
            copy[rng.randrange(120)] = f"x{rng.random()}"
        rows.append((n, " ".join(copy)))
    for n in range(150, 220):  # texts that share a passage only
        rows.append((n, " ".join(passage + words(rng, rng.randrange(5, 200)))))
    rows += [(300 + n, " ".join(words(rng, 3))) for n in range(5)]
    rows += [(400, None), (401, ""), (402, "..."), (403, "a b c"), (404, "A, b C!"), (405, " ".join(words(rng, 30_000)))]
    rows += [(406, rows[0][1]), (407, rows[0][1] + "!")]
    docs = spark.createDataFrame([(doc, text, "clash") for doc, text in rows], "doc_id BIGINT, text STRING, class_id STRING")
    found = {r.doc_id: r.class_id for r in B.near_duplicates(docs).collect()}
    assert found == classes_by_all_pairs(rows)


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(B, "SMALL_BUCKET", 3)
    monkeypatch.setattr(B, "BLOCK_ONE", 4)
    monkeypatch.setattr(B, "BLOCK_OTHER", 5)
    rng = random.Random(5)
    base, rows = words(rng, 60), []
    for n in range(60):
        copy = list(base)
        for _ in range(rng.randrange(6)):
            copy[rng.randrange(60)] = f"x{rng.random()}"
        rows.append((n, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    assert {r.doc_id: r.class_id for r in B.near_duplicates(docs).collect()} == classes_by_all_pairs(rows)


def test_empty_table(spark):
    assert B.near_duplicates(spark.createDataFrame([], "doc_id BIGINT, text STRING")).count() == 0


def test_components_equal_union_find(spark):
    rng = random.Random(8)
    links = [(n, n + 1) for n in range(100, 160)] + [(7, n) for n in range(200, 400)]  # a chain and a star
    links += [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)] + [(5, 5)]
    shuffled = list(range(500, 540))
    rng.shuffle(shuffled)
    links += list(zip(shuffled, shuffled[1:]))  # a chain in no order
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        label[high] = low
    expected = {n: find(n) for pair in links for n in pair if pair[0] != pair[1]}
    found = components(spark.createDataFrame(links, "a BIGINT, b BIGINT"))
    assert {r.node: r.label for r in found.collect()} == expected
    assert components(spark.createDataFrame([], "a BIGINT, b BIGINT")).count() == 0


def test_null_and_repeated_ids(spark):
    """An identifier is only a name: links of every text count, whatever it is called."""
    rng = random.Random(1)
    text = lambda seed: " ".join(random.Random(seed).choices([f"w{n}" for n in range(500)], k=80))
    near = lambda seed: text(seed) + f" end{rng.randrange(9)}"
    rows = [(5, text(1)), (5, text(2)), (7, near(2)), (1, near(1)), (None, near(1)), (None, text(3)), (None, near(3)), (9, text(4)), (None, "short")]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id BIGINT, text STRING, bag INT, key STRING").repartition(4)
    found = sorted(((r.doc_id, r.class_id) for r in B.near_duplicates(docs).collect()), key=str)
    assert found == sorted([(5, 1), (5, 5), (7, 5), (1, 1), (None, 1), (None, None), (9, 9)], key=str)
    kept = {(r.key.id, r.key.text_sum) for r in B.near_duplicate_rows(docs).where("kept").collect()}
    assert len(kept) == 5 and {i for i, _ in kept} == {1, 5, 9, None}


def test_repeated_rows_are_kept_together_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, None), (2, "")], "doc_id BIGINT, text STRING")
    assert sorted(map(tuple, B.near_duplicates(docs).collect())) == [(1, 1), (2, 2)]
    assert B.near_duplicate_rows(docs).where("kept").count() == 4
    assert B.near_duplicate_rows(docs.limit(0)).count() == 0
