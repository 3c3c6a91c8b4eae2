"""Exact duplicates against plain grouping."""

import random
from collections import defaultdict

import pyarrow as pa
import pytest

from corkscan.llm.content_sort import _groups, find_copies

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, keep=max):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[(text or "").translate(AZ)].append(doc)
    return {(doc, keep(groups[(text or "").translate(AZ)]), len(groups[(text or "").translate(AZ)])) for doc, text in rows}


def test_groups_and_odd_texts(spark):
    long = "x" * 300_000
    rows = [(1, "Same"), (2, "sAME"), (3, "same "), (4, None), (5, ""), (6, long), (7, long.upper()), (8, "Ä"), (9, "ä"), (10, "p" * 20 + "a"),
            (11, "p" * 20 + "b")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    for keep, pick in (("largest", max), ("smallest", min)):
        found = find_copies(docs, keep=keep).collect()
        assert {(r.doc_id, r.keep_id, r.group_size) for r in found} == expected(rows, pick)
        assert all(r.kept == (r.doc_id == r.keep_id) for r in found)


def test_one_text_over_many_partitions(spark):
    rows = [(n, "hot text" if n % 3 else f"text {n}") for n in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(7)
    found = find_copies(docs, keep="largest").collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in found} == expected(rows)
    assert sum(r.kept for r in found) == 1 + len([n for n, t in rows if t != "hot text"])


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = [(1, "a", "k1"), (1, "a", "k2"), (None, "a", "k3"), (None, "b", "k4")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, keep_id STRING")
    found = find_copies(docs, carry=docs.columns, keep="largest")
    kept = found.where("kept").select("row.*").collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, "b"), (1, "a")]
    assert docs.columns == found.select("row.*").columns


def test_empty_table(spark):
    assert find_copies(spark.createDataFrame([], "doc_id BIGINT, text STRING")).count() == 0


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_groups_are_handed_on_in_parts(keep):
    """Rows of one partition cut into batches in any way, with groups that are larger than what may wait."""
    rng = random.Random(9)
    for _ in range(60):
        texts = sorted(rng.choice(["a", "b", "b" * 30, "cc", "dd"]) for _ in range(40))
        rows = [(text, n) for text in sorted(set(texts)) for n in sorted(rng.randrange(6) for _ in range(texts.count(text)))]
        # Two texts may have one tag.
        batches, at = [], 0
        while at < len(rows):
            part = rows[at : at + rng.randrange(1, 9)]
            at += len(part)
            batches.append(pa.RecordBatch.from_pydict({
                "_id": pa.array([n for _, n in part], pa.int64()), "_norm": pa.array([t.encode() for t, _ in part], pa.binary()),
                "_head": pa.array([t[:1].encode() for t, _ in part], pa.binary()), "_tag": pa.array([7] * len(part), pa.int64()),
                "_sha": pa.array([t for t, _ in part])}))
        out = [row for batch in _groups(keep, rng.choice([0, 60, 500, 10_000]))(iter(batches)) for row in batch.to_pylist()]
        assert [(r["_sha"], r["_id"]) for r in out] == rows
        pick = min if keep == "smallest" else max
        for text in set(texts):
            mine = [r for r in out if r["_sha"] == text]
            open_ = [r for r in mine if r["_edge"]]
            assert len(open_) in (0, len(mine))
            best = pick(r["_id"] for r in mine)
            assert sum(r["_stays"] and r["_id"] == best for r in mine) == 1
            if not open_:
                assert {(r["_top"], r["_size"]) for r in mine} == {(best, len(mine))}
            else:
                assert pick(r["_top"] for r in mine) == best


def test_large_groups_in_parts_end_to_end(spark):
    rows = [(n % 1500, "hot " * 20 if n % 4 else f"text {n % 50}") for n in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        for keep, pick in (("largest", max), ("smallest", min)):
            found = find_copies(docs, keep=keep, waiting_bytes=1).collect()
            assert {(r.doc_id, r.keep_id, r.group_size) for r in found} == expected(rows, pick)
            assert sum(r.kept for r in found) == len({text for _, text in rows})
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
