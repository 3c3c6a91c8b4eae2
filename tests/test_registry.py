"""Every registered query against its SQL, and the search plans end to end."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from check import rows_of
from corkscan.functions.encoders import HashingEncoder
from corkscan.plans import index as index_plan
from corkscan.plans import search
from corkscan.registry.queries import TRAINED
from corkscan.registry.workspace import BUCKETS, workspace
from corkscan.operators import embedding, results, validation
from corkscan.sources.tables import with_vector_size
from corkscan.storage import materialise, new_path
from tests.conftest import SMALL

# The training-data queries have tests of their own.
QUERIES = {name: run for name, run in entry.queries().items() if name in entry.QUERIES}
SQL = {name: text for name, text in entry.oracle_sql().items() if name in entry.ORACLE}


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for file in Path(SMALL).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, name):
    frame = QUERIES[name](spark, SMALL)
    ours = rows_of(frame.columns, frame.collect())
    if name not in SQL:
        assert ours
        return
    found = db.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(frame.columns)
    assert ours == rows_of(columns, found.fetchall())


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES) - TRAINED


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "doc_id", "_score", "rank"]


def test_fields_are_fetched_from_few_folders(spark):
    w = workspace(spark, SMALL)
    found = search.search_keywords(w.record_index, w.records(), w.keyword_queries(), buckets=BUCKETS)
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString().lower()


def test_vector_search_end_to_end(spark):
    w = workspace(spark, SMALL)
    encoder, queries = HashingEncoder(256), w.keyword_queries()
    made = embedding.embed_documents(w.records().drop("id_bucket"), "to_vectorize", encoder)
    vectors = materialise(with_vector_size(made.select("id", "vector"), 256), "vectors")
    index = index_plan.build_vector_index(vectors, new_path(spark, "e2e"), iterations=5)
    assert index.model.words.shape[0] == 64
    found = search.search_vectors(index, w.records(), queries, encoder, buckets=BUCKETS)
    exact = search.search_by_script(vectors, w.records(), queries, encoder, buckets=BUCKETS)
    assert found.columns[-1] == "_distance" and exact.columns[-1] == "_score"
    assert found.count() == exact.count() == 100
    assert results.hit_flags(queries, found).where("NOT hit").isEmpty()
    everywhere = search.nearest_quantised(index, queries, encoder, nprobes=16)
    ids = {(r.query_id, r.id) for r in exact.collect()}
    assert len(ids & {(r.query_id, r.id) for r in everywhere.collect()}) >= 50


def test_lloyd_step_begins_at_trained_centroids(spark, db):
    """The step goes on from two steps of training: it moves vectors as they do not lie around the lowest ids."""
    w = workspace(spark, SMALL)
    sizes = lambda found: sorted((r.part_id, r.n) for r in found.select("part_id", "n").distinct().collect())
    plain = w.plainly_assigned().groupBy("part_id").count().withColumnRenamed("count", "n")
    assert sizes(QUERIES["ivf_lloyd_step"](spark, SMALL)) != sizes(plain)


def python_steps(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return plan.count("ArrowEvalPython") + plan.count("MapInArrow")


@pytest.mark.parametrize("name", ["pq_recall_at_10", "pq_plain_recall_at_10"])
def test_recall_of_codes_has_one_python_step_for_each_search(spark, name):
    """The search on codes and the exact one; steps in a row would be processes side by side in every task."""
    assert python_steps(QUERIES[name](spark, SMALL)) == 2


@pytest.mark.parametrize("name", ["ann_recall_at_10", "ann_plain_recall_at_10"])
def test_recall_of_partitions_has_one_python_step_for_each_search(spark, name):
    """Rows that are assigned already are searched, next to the exact search."""
    assert python_steps(QUERIES[name](spark, SMALL)) == 2


@pytest.mark.parametrize("name", ["ivfpq_top10", "ivfpq_plain_top10"])
def test_search_of_codes_is_one_python_step(spark, name):
    assert python_steps(QUERIES[name](spark, SMALL)) == 1


def test_valid_lines_are_those_of_the_ids_and_compressed(spark):
    """Keys are joined with keys: the texts of the lines are shuffled once, for the join with documents."""
    from corkscan.registry import queries as registered
    from corkscan.registry.workspace import Workspace

    w = Workspace(spark, SMALL)
    path = registered._write_valid_lines(w, "test-lines")
    valid = {r.id for r in w.valid_ids().collect()}
    assert valid == {r.id for r in validation.accepted(w.checked()).collect()} == {r.id for r in w.valid_records().collect()}
    lines = {r.id: r.value for r in w.review_lines().collect()}
    for part, step in (("all", 1), ("some", 10)):
        stored = spark.read.text(f"{path}/{part}")
        assert sorted(r.value for r in stored.collect()) == sorted(lines[n] for n in valid if n % step == 0)
        assert all(file.endswith(".gz") for file in stored.inputFiles())


def test_words_of_documents_that_do_not_repeat_are_counted_where_they_lie(spark):
    from corkscan.operators import text_index

    rows = [(1, "a b a", "x"), (2, "", None), (3, None, "y y"), (None, "n n", "z")]
    frame = lambda rows: spark.createDataFrame(rows, "id BIGINT, one STRING, two STRING")
    for docs in (frame(rows), frame([*rows, (1, "a b a", "w"), (1, "b", "x"), (None, "n m", "q")])):
        expected = sorted(map(tuple, text_index.term_counts(docs, "id", ["one", "two"]).collect()), key=str)
        found = text_index.spread_term_counts(docs, "id", ["one", "two"])
        assert found.columns == ["doc_id", "field", "term", "tf", "doc_len"]
        assert sorted(((r.doc_id, r.field, r.term, r.doc_len, r.tf) for r in found.collect()), key=str) == expected
    once = text_index.spread_term_counts(frame(rows), "id", ["one", "two"])
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString()
