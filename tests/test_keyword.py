import math
import random
import re

import pytest
from pyspark.sql import functions as F

from corkscan.operators import keyword, queries, results, text_index
from corkscan.storage import new_path

DOCS = [
    (1, "Red apple, red pear"),
    (2, "apple"),
    (3, "pear pear pear plum"),
    (4, ""),
    (5, None),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "query_id BIGINT, query STRING")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id BIGINT, description STRING")


@pytest.fixture(scope="module")
def index(spark, docs):
    return text_index.build_text_index(docs, new_path(spark, "kw"), "id", ["description"], buckets=3)


def by_hand(counts, length, df, n=3, avgdl=3.0, k1=1.2, b=0.75):
    return sum(
        math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avgdl))
        for t, tf in counts.items())


def test_bm25_by_hand(spark, index):
    assert dict(index.n) == {"description": 3} and dict(index.avgdl) == {"description": 3.0}
    found = keyword.keyword_top_k(index, frame(spark, [(9, "Apple pear")])).orderBy("rank").collect()
    df = {"apple": 2, "pear": 2}
    expected = [
        (1, by_hand({"apple": 1, "pear": 1}, 4, df)), (3, by_hand({"pear": 3}, 4, df)), (2, by_hand({"apple": 1}, 1, df)),
    ]
    expected.sort(key=lambda e: -e[1])
    assert [(r.query_id, r.doc_id, r.rank) for r in found] == [(9, d, i) for i, (d, _) in enumerate(expected, 1)]
    assert [r._score for r in found] == [round(s, 6) for _, s in expected]


def test_repeated_word_counts_twice(spark, index):
    found = {(r.query_id, r.doc_id): r._score
             for r in keyword.keyword_top_k(index, frame(spark, [(1, "plum"), (2, "PLUM plum")])).collect()}
    assert found[(2, 3)] == pytest.approx(2 * found[(1, 3)], abs=2e-6)


QUERIES = [(1, "apple pear"), (2, "plum"), (3, "apple pear"), (4, "nothing here"), (5, ""), (6, "red"), (7, None)]


def test_equal_texts_share_results(spark, index):
    found = sorted(keyword.keyword_top_k(index, frame(spark, QUERIES)).collect())
    first = [(r.doc_id, r._score, r.rank) for r in found if r.query_id == 1]
    assert first and first == [(r.doc_id, r._score, r.rank) for r in found if r.query_id == 3]
    assert {r.query_id for r in found} == {1, 2, 3, 6}


@pytest.mark.parametrize("sizes", [
    {"FEW_QUERIES": 2}, {"FEW_QUERIES": 2, "FEW_TEXTS": 2}, {"SHORT_TEXT_CHARS": 4}, {"FEW_WORDS": 3},
    {"FEW_QUERIES": 2, "FEW_RESULTS": 2},
])
@pytest.mark.parametrize("piece_rows", [1_000_000, 1])
def test_large_batches_give_the_same(spark, index, monkeypatch, sizes, piece_rows):
    monkeypatch.setattr(keyword, "PIECE_ROWS", piece_rows)
    batch = frame(spark, QUERIES)
    expected = sorted(keyword.keyword_top_k(index, batch).collect())
    for name, value in sizes.items():
        monkeypatch.setattr(queries, name, value)
    read = queries.read_batch(batch)
    by_shuffle = {"FEW_TEXTS", "SHORT_TEXT_CHARS", "FEW_WORDS"} & set(sizes)
    assert (read.few is None) == bool(by_shuffle)
    assert sorted(keyword.keyword_top_k(index, batch).collect()) == expected


@pytest.mark.parametrize("sizes", [{}, {"FEW_QUERIES": 1, "FEW_TEXTS": 1}])
def test_query_ids_of_any_type(spark, index, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(queries, name, value)
    for kind, ids in (("INT", [1, None, 1]), ("STRING", ["a", None, "a"]), ("BIGINT", [2**40, None, 2**40])):
        batch = spark.createDataFrame(list(zip(ids, ["plum", "plum", "red"])), f"query_id {kind}, query STRING")
        found = keyword.keyword_top_k(index, batch)
        assert found.schema["query_id"].dataType == batch.schema["query_id"].dataType
        expected = {(ids[0], 3), (None, 3)}
        assert {(r.query_id, r.doc_id) for r in found.collect()} >= expected


def test_repeated_and_known_ids_are_refused(spark, docs):
    with pytest.raises(ValueError, match="identifiers repeat"):
        text_index.build_text_index(docs.unionByName(docs), new_path(spark, "twice"), "id", ["description"])
    index = text_index.build_text_index(docs, new_path(spark, "it's"), "id", ["description"])
    with pytest.raises(ValueError, match="holds documents already"):
        text_index.append_text_index(index, docs.limit(1), "id")
    assert text_index.open_text_index(spark, index.root).postings().count() == index.postings().count()


def test_k_and_ties(spark):
    same = spark.createDataFrame([(i, "same words") for i in range(30, 0, -1)], "id BIGINT, description STRING")
    index = text_index.build_text_index(same.repartition(5), new_path(spark, "ties"), "id", ["description"])
    found = keyword.keyword_top_k(index, frame(spark, [(1, "words")]), k=4).orderBy("rank").collect()
    assert [r.doc_id for r in found] == [1, 2, 3, 4]
    assert keyword.match_top_k(index, frame(spark, [(1, "words")]), k=4).columns == ["query_id", "rank", "doc_id"]


def test_more_words_than_fit_a_filter(spark, index, monkeypatch):
    batch = frame(spark, [(1, " ".join(f"w{i}" for i in range(50)) + " plum")])
    expected = keyword.keyword_top_k(index, batch).collect()
    assert [r.doc_id for r in expected] == [3]
    monkeypatch.setattr(keyword, "FILTER_TERMS", 20)
    assert keyword.keyword_top_k(index, batch).collect() == expected


def test_fields_add_up(spark):
    rows = spark.createDataFrame(
        [(1, "apple", "plum"), (2, "pear", "apple"), (3, "fig", "fig")], "id BIGINT, title STRING, description STRING")
    index = text_index.build_text_index(rows, new_path(spark, "fields"), "id", ["title", "description"])
    batch = frame(spark, [(1, "apple")])
    scores = {tuple(f): {r.doc_id: r._score for r in keyword.keyword_top_k(index, batch, fields=f).collect()}
              for f in (["title"], ["description"], ["title", "description"])}
    assert set(scores[("title",)]) == {1} and set(scores[("description",)]) == {2}
    assert scores[("title", "description")] == {**scores[("title",)], **scores[("description",)]}
    with pytest.raises(ValueError, match="not indexed: winery"):
        keyword.keyword_top_k(index, batch, fields=["winery"])


def test_append_equals_rebuild(spark, docs, index):
    root = new_path(spark, "append")
    first = text_index.build_text_index(docs.where("id <> 3"), root, "id", ["description"], buckets=3)
    both = text_index.append_text_index(first, docs.where("id = 3"), "id")
    for table in ("postings", "term_doc_freq"):
        assert sorted(getattr(both, table)().collect()) == sorted(getattr(index, table)().collect())
    assert (both.n, both.avgdl) == (index.n, index.avgdl)
    batch = frame(spark, QUERIES)
    assert sorted(keyword.keyword_top_k(both, batch).collect()) == sorted(keyword.keyword_top_k(index, batch).collect())
    # The first version still answers as it did, and a session that built
    # nothing can open either.
    assert sorted({r.doc_id for r in first.postings().collect()}) == [1, 2]
    assert text_index.open_text_index(spark, root).postings().count() == index.postings().count()
    old = text_index.open_text_index(spark, root, version=0)
    assert sorted({r.doc_id for r in keyword.keyword_top_k(old, batch).collect()}) == [1, 2]
    with pytest.raises(ValueError, match="holds a batch"):
        text_index.append_text_index(first, docs.where("id = 3"), "id")


@pytest.fixture(scope="module")
def uneven(spark):
    """An index of texts with common and rare words in two fields, some changed and deleted, and texts to ask for."""
    rng, words = random.Random(6), [f"w{n}" for n in range(40)]
    shares = [1 / (n + 1) for n in range(40)]

    def some(ids):
        return [(i, " ".join(rng.choices(words, shares, k=rng.randrange(12))), " ".join(rng.choices(words, shares, k=rng.randrange(40)))) for i in ids]

    schema = "id BIGINT, title STRING, description STRING"
    index = text_index.build_text_index(
        spark.createDataFrame(some(range(400)), schema), new_path(spark, "uneven"), "id", ["title", "description"], buckets=4)
    index = text_index.upsert_text_index(index, spark.createDataFrame(some(range(300, 500)), schema), "id")
    index = text_index.delete_from_text_index(index, spark.createDataFrame([(i,) for i in range(0, 100, 3)], "id BIGINT"), "id")
    asked = [(n, " ".join(rng.choices(words + ["none"], k=rng.choice([1, 2, 2, 3, 6])))) for n in range(120)]
    return index, frame(spark, [*asked, (500, ""), (501, None), (502, "w0"), (503, "w0 w1"), (504, "w0 w0 w39")])


@pytest.mark.parametrize("fields", [None, ["title"]])
@pytest.mark.parametrize("k", [1, 3, 10, 1000])
def test_bounds_change_nothing(spark, uneven, fields, k):
    index, asked = uneven
    plain, pruned = (sorted(map(tuple, keyword.keyword_top_k(index, asked, k, fields, prune_pairs=pairs).collect())) for pairs in (10**9, 0))
    assert pruned == plain


def test_bounds_leave_pairs_out(spark, uneven):
    """Common words make no pairs of their own, and the lookup stays inside the buckets: what is shuffled are sums of what remains."""
    index, asked = uneven
    batch = queries.read_batch(asked)
    weights = keyword._local_weights(index, batch, ["title", "description"], keyword.Bm25())
    for row in weights.to_pylist():
        assert row["bound"] <= row["weight"]
    best = keyword._pruned_scores(index, weights, keyword.Bm25(), 3)
    pruned, every = best.count(), keyword.match_scores(index, batch).count()
    assert pruned < 0.6 * every
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and plan.count("Exchange hashpartitioning") == 1
    assert plan.index("Exchange hashpartitioning") < plan.index("Union")


def text_of(index):
    return sorted(tuple(r) for r in index.postings().collect()), sorted(tuple(r) for r in index.term_doc_freq().collect()), dict(index.n), dict(index.avgdl)


def test_changes_equal_a_rebuild(spark):
    """Random deletes and upserts, each version against an index built of what is there, and the older versions as they were."""
    rng, schema = random.Random(2), "id BIGINT, title STRING, description STRING"

    def some(ids):
        return [(i, " ".join(rng.choices("abcde", k=rng.randrange(4))), rng.choice([None, "", "a b", "c"])) for i in ids]

    there = {row[0]: row for row in some(range(30))}
    build = lambda rows, name: text_index.build_text_index(
        spark.createDataFrame(rows, schema), new_path(spark, name), "id", ["title", "description"], buckets=3)
    index = build(list(there.values()), "changing")
    versions = [(index, text_of(index))]
    for step in range(5):
        if step % 2 == 0:
            gone = [*rng.sample(range(45), 8), None, 3, 3]
            index = text_index.delete_from_text_index(index, spark.createDataFrame([(i,) for i in gone], "id BIGINT"), "id")
            there = {i: row for i, row in there.items() if i not in gone}
        else:
            new = some(rng.sample(range(45), 12))
            index = text_index.upsert_text_index(index, spark.createDataFrame(new, schema), "id")
            there |= {row[0]: row for row in new}
        assert text_of(index) == text_of(build(list(there.values()), "rebuilt"))
        assert {r.doc_id for r in index.ids().collect()} == set(there)
        versions.append((index, text_of(index)))
    compact = text_index.compact_text_index(index)
    assert text_of(compact) == text_of(index) and compact.tombstones == 0 < index.tombstones
    assert {r.doc_id for r in compact.ids().collect()} == set(there)
    for old, told in versions:
        assert text_of(text_index.open_text_index(spark, index.root, old.version)) == told
    more = text_index.append_text_index(compact, spark.createDataFrame(some([100]), schema), "id")
    assert {r.doc_id for r in more.ids().collect()} == {*there, 100}


def test_changes_that_are_refused_or_nothing(spark, docs):
    index = text_index.build_text_index(docs, new_path(spark, "refused"), "id", ["description"])
    assert text_index.delete_from_text_index(index, docs.where("id > 100"), "id") is index
    for rows, words in (([(1, "x"), (1, "y")], "identifiers repeat"), ([(None, "x")], "identifiers are null")):
        with pytest.raises(ValueError, match=words):
            text_index.upsert_text_index(index, spark.createDataFrame(rows, "id BIGINT, description STRING"), "id")
    fewer = text_index.delete_from_text_index(index, docs.where("id = 1"), "id")
    with pytest.raises(ValueError, match="holds a batch"):
        text_index.upsert_text_index(index, docs.where("id = 1"), "id")
    back = text_index.append_text_index(fewer, docs.where("id = 1"), "id")
    assert text_of(back) == text_of(index)


@pytest.mark.parametrize("filter_ids", [200, 0])
def test_changes_read_inside_buckets(spark, docs, monkeypatch, filter_ids):
    """Tombstones meet postings without a shuffle; a few identifiers read their buckets only."""
    monkeypatch.setattr(text_index, "FILTER_IDS", filter_ids)
    first = text_index.build_text_index(docs, new_path(spark, "inside"), "id", ["description"], buckets=5)
    index = text_index.delete_from_text_index(first, docs.where("id = 2"), "id")
    assert sorted({r.doc_id for r in index.postings().collect()}) == [1, 3]
    plan = index.postings()._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Exchange" not in plan
    search = keyword.keyword_top_k(index, frame(spark, [(1, "apple pear")]))._jdf.queryExecution().executedPlan().toString()
    assert search.count("Exchange hashpartitioning") == 1
    found = text_index._postings_of(index, spark.createDataFrame([(1,)], "doc_id BIGINT"))
    assert {r.doc_id for r in found.collect()} == {1}
    assert ("SelectedBucketsCount: 1 out of 5" in found._jdf.queryExecution().executedPlan().toString()) == bool(filter_ids)


def test_replace(spark, docs):
    root = new_path(spark, "replace")
    with pytest.raises(FileNotFoundError):
        text_index.open_text_index(spark, root)
    text_index.build_text_index(docs, root, "id", ["description"])
    with pytest.raises(FileExistsError):
        text_index.build_text_index(docs, root, "id", ["description"])
    text_index.build_text_index(docs.where("id = 2"), root, "id", ["description"], replace=True)
    opened = text_index.open_text_index(spark, root)
    assert [r.doc_id for r in opened.postings().collect()] == [2]
    opened.close()
    assert not spark.catalog.tableExists(opened.table)
    assert text_index.open_text_index(spark, root).postings().count() == 1


def test_field_without_words(spark):
    rows = spark.createDataFrame([(1, "apple", None)], "id BIGINT, title STRING, description STRING")
    index = text_index.build_text_index(rows, new_path(spark, "none"), "id", ["title", "description"])
    assert dict(index.n) == {"title": 1, "description": 0}
    batch = frame(spark, [(1, "apple")])
    assert keyword.keyword_top_k(index, batch, fields=["description"]).isEmpty()
    assert keyword.keyword_top_k(index, batch).count() == 1
    more = spark.createDataFrame([(2, "pear", "apple")], "id BIGINT, title STRING, description STRING")
    both = text_index.append_text_index(index, more, "id")
    assert dict(both.n) == {"title": 2, "description": 1}


def test_hot_words_are_few(spark, index, monkeypatch):
    freq = index.term_doc_freq()
    assert keyword._hot_words(index, freq).isEmpty()
    monkeypatch.setattr(keyword, "PIECE_ROWS", 1)
    assert [r.pieces for r in keyword._hot_words(index, freq).collect()] == [2, 2]
    monkeypatch.setattr(keyword, "HOT_WORDS", 3)
    assert keyword._hot_words(index, freq).count() <= 3


def test_plan(spark, index):
    """Read by bucket, words pushed to the scan, and one shuffle after the top k of each task."""
    plan = keyword.keyword_top_k(index, frame(spark, [(1, "apple pear")]))._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert physical.count("Exchange hashpartitioning") == 1
    assert physical.index("WindowGroupLimit") < physical.index("Exchange hashpartitioning")
    assert "Bucketed: true" in physical
    assert re.search(r"term#\d+ IN \(apple,pear\)", physical) and "PushedFilters" in physical and "BroadcastHashJoin" in physical


def test_build_shuffles_texts_only(spark, docs):
    spread = text_index._spread_postings(docs, "id", ["description"], 3, False)
    physical = spread._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange") == 1 and "REPARTITION_BY_NUM" in physical


def test_candidates_and_flags(spark, docs, index):
    batch = frame(spark, QUERIES).where("query IS NOT NULL")
    hits = keyword.matching_documents(index, docs, "id", batch)
    assert sorted(r.id for r in hits.collect()) == [1, 2, 3]
    found = keyword.keyword_top_k(index, batch)
    flags = {r.query_id: (r.n, r.hit) for r in results.hit_flags(batch, found).collect()}
    assert flags == {1: (3, True), 2: (1, True), 3: (3, True), 4: (0, False), 5: (0, False), 6: (1, True)}
    assert sorted(r.query_id for r in results.without_hits(batch, found).collect()) == [4, 5]
    shown = results.first_hits(batch, found.join(docs, F.col("id") == F.col("doc_id")))
    assert {r.query_id: r.description for r in shown.collect()}[4] == "<no result>"
    assert {r.query_id: r.description for r in shown.collect()}[2] == "pear pear pear plum"


def test_words_are_counted_row_by_row(spark):
    rows = spark.createDataFrame([(1, "b a B", None), (2, "", "x"), (3, None, "é É é_1 a a a"), (None, "a", "a b")],
                                 "id BIGINT, title STRING, description STRING")
    plain, by_row = (count(rows, "id", ["title", "description"]) for count in (text_index.postings, text_index.row_postings))
    assert by_row.columns == plain.columns and sorted(map(str, by_row.collect())) == sorted(map(str, plain.collect()))
    assert "Aggregate" not in by_row._jdf.queryExecution().executedPlan().toString()


def test_lookups_meet_documents_once(spark, uneven):
    """Of a document, one row of bits is joined, not a list that each of its postings is compared with."""
    index, asked = uneven
    weights = keyword._local_weights(index, queries.read_batch(asked), ["title", "description"], keyword.Bm25())
    plan = keyword._pruned_scores(index, weights, keyword.Bm25(), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_or" in plan and "collect_list" not in plan


def test_texts_with_the_same_known_words_are_one_search(spark, index, monkeypatch):
    asked = frame(spark, [(i, f"plum unknown{i}") for i in range(50)] + [(50, "plum plum"), (51, "nothing")])
    expected = sorted(keyword.keyword_top_k(index, asked).collect())
    monkeypatch.setattr(queries, "FEW_QUERIES", 2)
    monkeypatch.setattr(queries, "FEW_TEXTS", 2)
    batch = queries.read_batch(asked)
    assert batch.few is None
    found = keyword._searches(keyword._known_terms(index, batch.texts(), sorted(index.n)))
    assert (found.count(), found.select("search_id").distinct().count()) == (51, 2)
    assert sorted(keyword.keyword_top_k(index, asked).collect()) == expected
