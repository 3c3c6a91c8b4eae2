"""The filter audit against a plain run of every chain."""

import random
import re
from itertools import permutations

import pytest

from corkscan.llm.filter_audit import FILTERS, audit, filter_audit, packed, unpacked

DOCS = "doc_id BIGINT, text STRING, lang STRING"
LABELS = "doc_id BIGINT, quality INT, toxic INT"
FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failures(rows):
    first = {}
    for doc, text, _ in rows:
        if doc is not None:
            first[text or ""] = min(doc, first.get(text or "", doc))
    for doc, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        yield {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": doc is not None and first[text] < doc}


def chains(rows, labels):
    """All figures, by (part, order, step), from running every chain."""
    good = {doc for doc, quality, _ in labels if quality == 1 and doc is not None}
    toxic = {doc for doc, _, mark in labels if mark == 1 and doc is not None}
    parts, expected = {}, {}
    for (doc, _, lang), failed in zip(rows, failures(rows)):
        parts.setdefault(lang or "", []).append((doc, failed))
    for part, docs in parts.items():
        for order in permutations(FILTERS):
            here = docs
            for step, letter in enumerate(order, 1):
                removed = [(doc, f) for doc, f in here if f[letter]]
                here = [(doc, f) for doc, f in here if not f[letter]]
                expected[part, "".join(order), step] = [
                    len(here), len(removed), sum(f[letter] for _, f in docs) - len(removed),
                    sum(f[letter] and sum(f.values()) == 1 for _, f in docs), sum(doc in good for doc, _ in removed),
                    sum(doc in toxic for doc, _ in removed)]
        for letter in FILTERS:
            own = [key for key in expected if key[0] == part and key[1][key[2] - 1] == letter]
            total = sum(expected[key][1] for key in own)
            for key in own:
                expected[key].append(total)
    return expected


def told(frame):
    return {(r.part, r.filter_order, r.step): [r[name] for name in FIGURES] for r in frame.collect()}


def random_text(rng):
    words = [rng.choice(["a", "bb", "Cc", "D$", "é", " x", "EEE", f"w{rng.randrange(400)}"]) for _ in range(rng.choice([0, 1, 99, 100, 101, 300]))]
    return rng.choice(["", " ", "\t"]) + "".join(word + rng.choice([" ", "\n", "\x0b", "  "]) for word in words)


def test_random_documents(spark):
    rng = random.Random(5)
    texts = [None, "", " ", "x" * 300_000] + [random_text(rng) for _ in range(60)]
    rows = [(rng.choice([None, *range(150)]), rng.choice(texts), rng.choice([None, "", "en", "de"])) for _ in range(300)]
    labels = [(rng.choice([None, *range(150)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(120)]
    found = filter_audit(spark.createDataFrame(rows, DOCS).repartition(5), spark.createDataFrame(labels, LABELS))
    assert told(found) == chains(rows, labels)


def test_a_group_of_copies_and_repeated_rows(spark):
    rows = [(n % 700, "same text", "en" if n % 2 else None) for n in range(2000)]
    found = told(filter_audit(spark.createDataFrame(rows, DOCS).repartition(6), spark.createDataFrame([], LABELS)))
    assert found == chains(rows, [])
    # The rows with the smallest identifier are no copies, all three of them: two under null and one under "en", or the other way round.
    assert found["", "EABCD", 1][0] + found["en", "EABCD", 1][0] == 3


def test_fields_do_not_overflow_into_each_other(spark):
    orders = tuple(permutations(range(5)))
    n = (1 << 62) + 7
    total = n * packed(31, True, False, orders) + 5 * packed(1, False, True, orders)
    docs, figures = unpacked(total, orders)
    assert docs == n + 5
    assert figures[0, 0].tolist() == [n + 5, 0, 5, n, 5] and figures[-1, -1].tolist() == [5, n, 5, 0, 5]
    kinds = spark.createDataFrame([("p", 31, True, False, n), ("p", 0, False, False, n)], "part STRING, mask INT, good BOOLEAN, toxic BOOLEAN, n BIGINT")
    first = audit(kinds).where("filter_order = 'ABCDE' AND step = 1").first()
    assert (first.kept, first.removed, first.good_lost) == (n, n, n)


def test_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a #", "en", 7, 8, 9)], DOCS + ", mask INT, sha INT, n INT")
    labels = spark.createDataFrame([(1, 1, 1, 4)], LABELS + ", good INT")
    assert told(filter_audit(docs, labels))["en", "DABCE", 1] == [0, 1, 0, 0, 1, 1, 60]
    assert filter_audit(docs.limit(0), labels.limit(0)).count() == 0


@pytest.mark.parametrize("names", ["A", "AB"])
def test_other_chains(spark, names):
    kinds = spark.createDataFrame([("p", 1, False, False, 3)], "part STRING, mask INT, good BOOLEAN, toxic BOOLEAN, n BIGINT")
    rows = audit(kinds, names).where("step = 1").orderBy("filter_order").collect()
    assert [(r.filter_order, r.removed, r.shapley) for r in rows] == ([("A", 3, 3)] if names == "A" else [("AB", 3, 6), ("BA", 0, 0)])
