"""Sketches against exact ranks, bitmaps and value tables against plain filters."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corkscan.operators import bitmaps, exact_values, sketches, text_index
from corkscan.schemas import KEYWORD_FIELDS

DAY = datetime.date(2020, 1, 1)


@pytest.fixture(scope="module")
def log(spark):
    draw = random.Random(4)
    rows = [(g, DAY + datetime.timedelta(days=n % 9), v) for g in ("a", None) for n, v in enumerate(draw.gauss(0, 5) for _ in range(20_000))]
    rows += [("equal", DAY, 7.0)] * 5_000 + [("one", DAY, 1.0), ("one", DAY, None), ("none", DAY, None)]
    return spark.createDataFrame(rows, "g STRING, day DATE, v DOUBLE").repartition(6)


def test_stored_sketches_merge_to_the_same_percentiles(spark, log, folder):
    even = F.dayofmonth("day") % 2 == 0
    sketches.append_sketches(sketches.sketch_log(log.where(even), ["g"], "v", F.col("day")), folder)
    sketches.append_sketches(sketches.sketch_log(log.where(~even), ["g"], "v", F.col("day")), folder)
    stored = sketches.read_sketches(spark, folder)
    assert stored.where("g = 'a'").count() == 9
    wanted = (0, 5, 50, 95, 99, 100)
    found = sketches.merged_percentiles(stored, ["g"], wanted)
    assert {(r.g, r.n) for r in found.collect()} == {("a", 20_000), (None, 20_000), ("equal", 5_000), ("one", 1)}
    errors = sketches.rank_errors(log, ["g"], "v", found).collect()
    assert len(errors) == 4 * len(wanted) and all(r.error <= sketches.RANK_ERROR for r in errors)
    # The whole log in one sketch is no nearer than the parts.
    whole = sketches.merged_percentiles(sketches.sketch_log(log, ["g"], "v", F.lit(DAY)), ["g"], wanted)
    assert all(r.error <= sketches.RANK_ERROR for r in sketches.rank_errors(log, ["g"], "v", whole).collect())


def test_a_wrong_value_has_its_rank_error(spark, log):
    wrong = spark.createDataFrame([("a", 50.0, -1e9)], "g STRING, p DOUBLE, value DOUBLE")
    assert sketches.rank_errors(log, ["g"], "v", wrong).first().error == 0.5


def test_no_sketches(spark, log, folder):
    with pytest.raises(FileNotFoundError):
        sketches.read_sketches(spark, folder)
    assert sketches.sketch_log(log.limit(0), ["g"], "v", F.col("day")).isEmpty()


def test_bitmaps_equal_sets(spark, folder, monkeypatch):
    monkeypatch.setattr(bitmaps, "DENSE_DOCUMENTS", 20)
    draw = random.Random(5)
    ids = draw.sample(range(1, 100_000), 300) + [0, -1, -40_000, 32_768, 32_769, 2**40]
    texts = {n: " ".join(w for w, chance in (("most", 0.9), ("some", 0.2), ("few", 0.02)) if draw.random() < chance) for n in ids}
    texts[7_000_000] = None
    docs = spark.createDataFrame(list(texts.items()), "doc_id BIGINT, text STRING")
    index = text_index.build_text_index(docs, f"{folder}/index", "doc_id", ["text"], buckets=3)
    bitmaps.build_bitmaps(index, f"{folder}/bits")
    made = bitmaps.read_bitmaps(spark, f"{folder}/bits")
    kinds = made.agg(F.count("bits").alias("bits"), F.count("places").alias("places"), F.count("*").alias("n")).first()
    assert kinds.bits and kinds.places and kinds.bits + kinds.places == kinds.n
    asked = [(1, "most"), (2, "Some few some"), (3, "nowhere"), (None, "few"), (5, None)]
    found = bitmaps.candidate_bitmaps(made, spark.createDataFrame(asked, "query_id INT, query STRING"))
    holds = lambda query: {n for n, text in texts.items() if set((text or "").split()) & set(query.lower().split())}
    expected = {q: len(holds(query)) for q, query in asked if query and holds(query)}
    assert {r.query_id: r.n for r in bitmaps.candidate_counts(found).collect()} == expected
    for q, query in asked[:3]:
        one = bitmaps.candidate_documents(found.where(F.col("query_id") == q), docs, "doc_id")
        assert {r.doc_id for r in one.collect()} == holds(query)
    index.close()


def rows_scanned(df):
    """Rows that the file scans of an executed plan have handed on."""
    df.collect()
    plan, total = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            plan.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        plan += [children.apply(i) for i in range(children.size())]
    return total


def test_values_that_are_not_there_are_skipped(spark, folder):
    names = [f"grower {n:05d}" for n in range(0, 20_000, 2)]
    columns = [F.element_at(F.array(*[F.lit(f"{name} {k}") for k in range(3)]), (F.col("id") % 3 + 1).cast("int")).alias(name)
               for name in KEYWORD_FIELDS if name != "winery"]
    wineries = spark.createDataFrame(list(enumerate(names)), "id BIGINT, winery STRING")
    exact_values.build_value_table(wineries.select("id", "winery", *columns), folder)
    table = exact_values.read_value_table(spark, folder)
    found = exact_values.find_values(table, [("winery", "grower 00010"), ("country", "country 1"), ("winery", "gone")])
    assert sorted((r.field, r.value, r.id) for r in found.collect() if r.field == "winery") == [("winery", "grower 00010", 5)]
    assert sorted(r.id for r in found.collect() if r.field == "country") == [n for n in range(10_000) if n % 3 == 1]
    # Inside the range of values of its file, but not among them: no row group is read.
    assert rows_scanned(exact_values.find_values(table, [("winery", "grower 00011")])) == 0
    assert 0 < rows_scanned(exact_values.find_values(table, [("winery", "grower 00012")])) <= 10_000
    with pytest.raises(ValueError, match="not kept whole"):
        exact_values.find_values(table, [("title", "x")])
    assert exact_values.find_values(table, []).isEmpty()


def test_numpy_agrees_on_one_group(spark, log):
    values = np.array([r.v for r in log.where("g = 'a'").collect()])
    found = sketches.merged_percentiles(sketches.sketch_log(log, ["g"], "v", F.col("day")), ["g"], (50,)).where("g = 'a'").first()
    assert abs((values <= found.value).mean() - 0.5) <= sketches.RANK_ERROR
