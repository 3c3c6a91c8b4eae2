"""The stages of the pipeline against plain computations on their own inputs."""

import re

import pytest

import corpus_pipeline
from corkscan.llm import toxicity
from corkscan.llm.registry import toxicity_model
from tests.conftest import SMALL
from tests.llm.test_bag_minhash import classes_by_all_pairs
from tests.llm.test_content_sort import AZ

tokenizers = pytest.importorskip("tokenizers")


def plain(text):
    return " ".join(re.findall(r"[^\W\d_]+|\d+", (text or "").lower()))


def test_each_stage_on_its_own_input(spark, folder):
    from corkscan.llm import bpe

    docs, kept = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        stage(spark, docs, SMALL).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        if number < 4:
            assert docs.columns == columns
        kept.append(docs.collect())

    start = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = toxicity_model(start, spark.read.parquet(f"{SMALL}/labels.parquet"))
    rows = start.collect()
    scores = dict(zip((r.doc_id for r in rows), model.scores([r.text or "" for r in rows])))
    assert {r.doc_id for r in kept[0]} == {doc for doc, score in scores.items() if score < toxicity.THRESHOLD}

    last = {}
    for r in sorted(kept[0], key=lambda r: r.doc_id):
        last[(r.text or "").translate(AZ)] = r.doc_id
    assert sorted(r.doc_id for r in kept[1]) == sorted(last.values())

    classes = classes_by_all_pairs([(r.doc_id, r.text) for r in kept[1]])
    assert {r.doc_id for r in kept[2]} == {doc for doc, label in classes.items() if doc == label}

    items = [plain(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert {r.doc_id for r in kept[3]} == {r.doc_id for r in kept[2] if not any(item in plain(r.text) for item in items)}

    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    texts = {r.doc_id: r.text for r in kept[3]}
    assert {r.doc_id for r in kept[4]} == set(texts)
    for r in kept[4]:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.ids, r.n_tokens, r.decoded) == (ids, len(ids), library.decode(ids, skip_special_tokens=False))


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, SMALL)
        assert found.count() == 0


def test_stages_tell_rows_without_an_id_of_their_own_apart(spark):
    """Null ids, and two texts under one id: each text is judged for itself."""
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").where("length(text) > 150").first().text
    words = lambda seed: " ".join(f"w{(seed * 7919 + n * n * 31) % 997}" for n in range(90))
    rows = [(1, words(1)), (1, f"so {item} it is"), (None, f"and {item}"), (None, words(2)), (2, words(2) + " end"), (None, words(3)), (None, words(3) + " more")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").selectExpr(
        "doc_id", "text", "'en' AS lang", "'s' AS source", "CAST(length(text) AS BIGINT) AS n_chars", "1 AS key")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["decontamination"](spark, docs, SMALL)
    assert clean.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in clean.collect()) == sorted((i or 0, t) for i, t in rows if item not in t)
    alone = [(r.doc_id, r.text) for r in stages["near dedup"](spark, docs, SMALL).collect()]
    assert (2, words(2) + " end") in alone and (None, words(2)) not in alone and (1, words(1)) in alone
    assert len([t for i, t in alone if t.startswith(words(3))]) == 1
