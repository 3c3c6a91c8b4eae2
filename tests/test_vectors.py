import functools
import tracemalloc
from pathlib import Path
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corkscan.functions.encoders import HashingEncoder, ModelEncoder, vector_of
from corkscan.functions import matrices
from corkscan.functions.matrices import best_rows, list_array, matrix, unit_rows
from corkscan.operators import embedding, nearest, partitioned, quantised, seeding
from corkscan.plans import index as index_plan
from corkscan.storage import materialise, new_path
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{SMALL}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector")).repartition(5)


@pytest.fixture(scope="module")
def asked(vectors):
    return vectors.where("id < 100").withColumnRenamed("id", "text_id")


@pytest.fixture(scope="module")
def exact(vectors, asked):
    return materialise(nearest.exact_top_k(vectors, asked), "exact")


@pytest.fixture(scope="module")
def index(spark, vectors):
    return index_plan.build_vector_index(vectors, new_path(spark, "vectors"))


def arrays(vectors):
    rows = vectors.orderBy("id").collect()
    x = np.array([r.vector for r in rows], float)
    return np.array([r.id for r in rows]), x / np.linalg.norm(x, axis=1, keepdims=True)


def brute_force(ids, units, queries, k=10):
    distances = np.round(1 - queries @ units.T, 6) + 0.0
    return [[(int(ids[i]), d[i]) for i in np.lexsort((ids, d))[:k]] for d in distances]


def listed(found):
    rows = found.orderBy("text_id", "rank").collect()
    return {q: [(r.id, r._distance) for r in rows if r.text_id == q] for q in {r.text_id for r in rows}}


def test_exact_equals_brute_force(vectors, exact):
    ids, units = arrays(vectors)
    expected = brute_force(ids, units, units[:100])
    found = listed(exact)
    assert [[i for i, _ in found[q]] for q in range(100)] == [[i for i, _ in e] for e in expected]
    assert np.allclose([[d for _, d in found[q]] for q in range(100)], [[d for _, d in e] for e in expected], atol=1.1e-6)


def test_blocks_and_tiles_give_the_same(vectors, asked, exact, index, monkeypatch):
    flat = listed(partitioned.flat_top_k(index.vectors, index.model.centroids, asked))
    coded = listed(quantised.quantised_top_k(index.codes, index.model, asked))
    monkeypatch.setattr(nearest, "BLOCK_QUERIES", 30)
    monkeypatch.setattr(nearest, "TILE_CELLS", 100)
    assert listed(nearest.exact_top_k(vectors.repartition(3), asked)) == listed(exact)
    assert listed(partitioned.flat_top_k(index.vectors, index.model.centroids, asked)) == flat
    assert listed(quantised.quantised_top_k(index.codes, index.model, asked)) == coded


def test_script_score_keeps_the_order(exact):
    scored = nearest.script_score(exact).orderBy("text_id", "rank").collect()
    assert all(a._score >= b._score for a, b in zip(scored, scored[1:]) if a.text_id == b.text_id)
    assert scored[0]._score == 2.0 and scored[0].text_id == scored[0].id


def test_vectors_without_direction_are_left_out(spark):
    rows = spark.createDataFrame(
        [(1, [0.0, 0.0]), (2, None), (3, [1.0, 0.0]), (4, [-2.0, 0.0])], "id BIGINT, vector ARRAY<FLOAT>")
    queries = spark.createDataFrame([(1, [3.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "text_id BIGINT, vector ARRAY<FLOAT>")
    assert listed(nearest.exact_top_k(rows, queries)) == {1: [(3, 0.0), (4, 2.0)]}
    centroids = np.array([[1.0, 0.0], [-1.0, 0.0]])
    assigned = partitioned.assign_partitions(rows, centroids)
    assert sorted((r.id, r.part_id) for r in assigned.collect()) == [(3, 0), (4, 1)]
    assert sorted(partitioned.probed_parts(queries, centroids, 1).collect()) == [(1, 0, 1)]
    assert listed(partitioned.flat_top_k(assigned, centroids, queries, nprobes=1)) == {1: [(3, 0.0)]}
    moved = sorted(partitioned.lloyd_step(rows, centroids).collect())
    assert [(r.part_id, r.n, r.centroid) for r in moved] == [(0, 1, [1.0, 0.0]), (1, 1, [-1.0, 0.0])]


def test_no_vectors_and_no_queries(spark, vectors, asked):
    assert nearest.exact_top_k(vectors.limit(0), asked).isEmpty()
    assert nearest.exact_top_k(vectors, asked.limit(0)).isEmpty()


def test_sizes_must_agree():
    with pytest.raises(ValueError, match="different sizes"):
        matrix(pa.array([[1.0, 2.0, 3.0], [1.0]]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0.0, 0.1, 0.10000001, 0.5, np.inf, np.nan]), st.integers(-9, 9)),
                min_size=1, max_size=30), st.integers(1, 12))
def test_best_rows(rows, k):
    distances = np.array([d for d, _ in rows])[:, None]
    ids = np.array([i for _, i in rows]) * 100 + np.arange(len(rows))
    found = {ids[i] for i in best_rows(distances, ids, k)[:, 0] if i >= 0}
    usable = sorted((round(d, 6), i) for d, i in zip(distances[:, 0], ids) if np.isfinite(d))
    assert found == {i for _, i in usable[:k]}


def test_all_partitions_probed_is_exact(index, asked, exact):
    found = partitioned.flat_top_k(index.vectors, index.model.centroids, asked, nprobes=16)
    assert listed(found) == listed(exact)


def recall(found, exact):
    return partitioned.recall(found, exact).agg(F.avg("recall")).first()[0]


def test_recall_grows_with_probes(index, asked, exact):
    flat = [recall(partitioned.flat_top_k(index.vectors, index.model.centroids, asked, nprobes=n), exact) for n in (1, 4, 10)]
    coded = [recall(quantised.quantised_top_k(index.codes, index.model, asked, nprobes=n), exact) for n in (1, 4, 10)]
    assert flat == sorted(flat) and coded == sorted(coded)
    assert flat[-1] >= 0.9 and coded[-1] >= 0.65


def test_codes_equal_nearest_words(index):
    rows = index.vectors.join(index.codes.drop("part_id"), "id").collect()
    model = index.model
    assert model.words.shape == (16, 256, 4)
    x = np.array([r.vector for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rest = (x - model.centroids[[r.part_id for r in rows]]).reshape(len(rows), 16, 4)
    codes = np.array([r.codes for r in rows])
    for m in range(16):
        apart = ((rest[:, m, None] - model.words[m]) ** 2).sum(-1)
        assert np.allclose(apart[np.arange(len(rows)), codes[:, m]], apart.min(axis=1), atol=1e-12)


def test_equal_words_give_the_first():
    words = np.array([[1.0, 0.0], [0.0, 0.0], [0.0, 0.0], [1.0, 0.0]])
    assert quantised.nearest_word(np.array([[0.1, 0.0], [0.9, 0.0]]), words).tolist() == [1, 0]


def test_quantised_distance_by_hand(index, asked):
    model = index.model
    found = quantised.quantised_top_k(index.codes, model, asked, nprobes=16).where("text_id = 5 AND rank = 3").first()
    coded = index.codes.where(F.col("id") == found.id).first()
    decoded = model.decode(np.array([coded.codes]), np.array([coded.part_id]))[0]
    q = np.array(asked.where("text_id = 5").first().vector, float)
    assert found._distance == pytest.approx(np.square(q / np.linalg.norm(q) - decoded).sum() / 2, abs=1e-6)


def test_index_is_replaced_as_a_version(spark, vectors):
    root = new_path(spark, "replaced")
    few = vectors.where("id < 40")
    index_plan.build_vector_index(few, root, partitions=2, words=8, iterations=2)
    with pytest.raises(FileExistsError):
        index_plan.build_vector_index(few, root, partitions=2, words=8, iterations=2)
    index_plan.build_vector_index(few.where("id < 30"), root, partitions=2, words=8, iterations=2, replace=True)
    assert index_plan.open_vector_index(spark, root).codes.count() == 30
    assert index_plan.open_vector_index(spark, root, 0).codes.count() == 40


def test_plans(index, asked, exact, vectors):
    """Only folders of probed partitions are read; tasks hand on their top k."""
    block = asked.where("text_id = 1").select("text_id", "vector").toArrow()
    probing = partitioned.probing_block(block, index.model.centroids, 2)
    plan = partitioned.only_probed(index.codes, probing)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part_id" in plan
    physical = nearest.exact_top_k(vectors, asked)._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange hashpartitioning(text_id") == 1 and "WindowGroupLimit" in physical


def test_partitions_are_worked_out_once(vectors):
    """Filters on the partition, as searches have them, start no Python process of their own."""
    assigned = partitioned.assign_partitions(vectors, np.eye(64)[:4]).where(F.col("part_id").isin([0, 2]))
    assert assigned._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert {r.part_id for r in assigned.collect()} == {0, 2}


def test_hashing_encoder(spark):
    rows = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "id INT, text STRING")
    made = {r.id: np.array(r.vector) for r in embedding.embed_documents(rows, "text", HashingEncoder(32), 32).collect()}
    assert np.allclose(np.linalg.norm(made[1]), 1.0) and len(made[1]) == 32
    assert np.count_nonzero(made[2]) == 1  # the prefix only
    assert np.allclose(made[2], made[3])


def test_training_looks_at_every_row(spark):
    """Two far groups: the lowest ids all lie in one, and the means find both."""
    rows = [(i, [1.0, 0.01 * i]) for i in range(10)] + [(i, [0.01 * i, 1.0]) for i in range(10, 40)]
    frame = spark.createDataFrame(rows, "id BIGINT, vector ARRAY<FLOAT>")
    centroids = partitioned.train_centroids(frame, 2, steps=10)
    groups = {r.part_id for r in partitioned.assign_partitions(frame, centroids).where("id < 10").collect()}
    others = {r.part_id for r in partitioned.assign_partitions(frame, centroids).where("id >= 30").collect()}
    assert len(groups) == len(others) == 1 and groups != others


def plain_training(points, centres, steps, unit):
    """Means of what is nearest, empty ones moved to the farthest point of the widest group, in plain numpy."""
    for _ in range(steps):
        apart = np.round(((points[:, None] - centres) ** 2).sum(-1), 10)
        near, moved = apart.argmin(1), centres.copy()
        away = apart[np.arange(len(points)), near]
        wide = []
        for group in range(len(centres)):
            rows = np.flatnonzero(near == group)
            if len(rows):
                moved[group] = np.round(points[rows].mean(0), 9)
                far = max(rows, key=lambda row: (away[row], points[row].tolist()))
                if away[far] > 1e-9:
                    wide.append((-round(away[rows].sum(), 9), group, points[far]))
        if unit:
            moved /= np.linalg.norm(moved, axis=1, keepdims=True)
        empty = [group for group in range(len(centres)) if not (near == group).any()]
        for group, (_, _, far) in zip(empty, sorted(wide, key=lambda w: w[:2])):
            moved[group] = far if unit else np.round(far, 9)
        centres = moved
    return centres


@pytest.mark.parametrize("start", ["seeded", "copies"])
def test_training_equals_plain_numpy(spark, start):
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.normal(size=(200, 8)), np.repeat(rng.normal(size=(1, 8)), 100, axis=0)])
    rows = [(i, [float(x) for x in np.float32(p)]) for i, p in enumerate(points)]
    frame = spark.createDataFrame([*rows, (900, None), (901, [0.0] * 8)], "id BIGINT, vector ARRAY<FLOAT>").repartition(5)
    units = np.array([v for _, v in rows])
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    centres = partitioned.seeded_centroids(frame, 6) if start == "seeded" else units[[250] * 4 + [0, 1]]
    found = partitioned.train_centroids(frame, 6, steps=20, start=centres)
    assert np.allclose(found, plain_training(units, centres, 20, True), atol=1e-7)
    assigned = partitioned.assign_partitions(frame, found)
    parts = np.argmax(np.round(units @ found.T, 12), axis=1)
    assert {r.id: r.part_id for r in assigned.collect()} == dict(enumerate(parts.tolist()))
    assert len(set(parts.tolist())) == 6

    model = quantised.seeded_words(assigned, found, 4, 16) if start == "seeded" else quantised.lowest_id_words(
        assigned.where("id >= 195"), found, 4, 16)
    trained = quantised.train_words(assigned, found, 4, 16, steps=8, start=model)
    rest = (units - found[parts]).reshape(len(units), 2, 4)
    for m in range(2):
        assert np.allclose(trained.words[m], plain_training(rest[:, m], model.words[m], 8, False), atol=1e-6)


def test_seeds_are_different_and_repeatable(spark, vectors):
    seeds = partitioned.seeded_centroids(vectors, 16)
    assert np.array_equal(seeds, partitioned.seeded_centroids(vectors.repartition(3), 16))
    assert len(np.unique(np.round(seeds, 6), axis=0)) == 16
    words = quantised.seeded_words(partitioned.assign_partitions(vectors, seeds), seeds, 32, 20).words
    assert words.shape == (2, 20, 32) and all(len(np.unique(w, axis=0)) == 20 for w in words)


def test_lowest_ids_that_are_copies(spark, vectors, asked, exact):
    """All partitions are used, and found in."""
    one = vectors.where("id = 7").first().vector
    low = spark.createDataFrame([(-n, one) for n in range(1, 400)], "id BIGINT, vector ARRAY<FLOAT>")
    both = vectors.unionByName(low)
    centroids = partitioned.train_centroids(both, 16)
    assigned = materialise(partitioned.assign_partitions(both, centroids), "assigned")
    assert assigned.select("part_id").distinct().count() == 16
    found = partitioned.flat_top_k(assigned, centroids, asked)
    assert recall(found, nearest.exact_top_k(both, asked)) >= 0.9


def test_fewer_vectors_than_partitions(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, None)], "id BIGINT, vector ARRAY<FLOAT>")
    centroids = partitioned.train_centroids(frame, 16)
    assert sorted(centroids.tolist()) == [[0.0, 1.0], [1.0, 0.0]]
    assert len(partitioned.train_centroids(frame.limit(0), 16)) == 0


def test_append_to_an_index(spark, vectors):
    root, later = new_path(spark, "appended"), F.col("id") % 3 == 0
    first = index_plan.build_vector_index(vectors.where(~later), root, partitions=4, words=16, iterations=3)
    files = {f: f.stat().st_mtime_ns for f in Path(root).rglob("*.parquet")}
    second = index_plan.append_vector_index(first, vectors.where(later & (F.col("id") % 2 == 0)))
    third = index_plan.append_vector_index(second, vectors.where(later & (F.col("id") % 2 == 1)).union(
        spark.createDataFrame([(-1, None), (-2, [0.0] * 64)], "id BIGINT, vector ARRAY<FLOAT>")))
    assert all(f.stat().st_mtime_ns == at for f, at in files.items())
    assigned = partitioned.assign_partitions(vectors, first.model.centroids)
    at_once = sorted((r.id, r.part_id, r.codes) for r in quantised.encode(assigned, first.model).collect())
    assert sorted((r.id, r.part_id, r.codes) for r in third.codes.collect()) == at_once
    assert {(r.id, r.part_id) for r in third.vectors.collect()} == {(i, p) for i, p, _ in at_once}
    opened = index_plan.open_vector_index(spark, root)
    assert opened.version == 2 and opened.codes.count() == third.codes.count() == vectors.count()
    assert index_plan.open_vector_index(spark, root, 0).codes.count() == first.codes.count()
    with pytest.raises(ValueError, match="newer version"):
        index_plan.append_vector_index(first, vectors.limit(1))
    with pytest.raises(ValueError, match="vectors of size 1"):
        index_plan.append_vector_index(third, spark.createDataFrame([(1, [1.0])], "id BIGINT, vector ARRAY<FLOAT>"))
    asked = vectors.where("id = 5").withColumnRenamed("id", "text_id")
    plan = partitioned.only_probed(opened.codes, partitioned.probing_block(asked.select("text_id", "vector").toArrow(), first.model.centroids, 1))
    assert plan._jdf.queryExecution().executedPlan().toString().count("PartitionFilters: [isnotnull(part_id") == 3
    drift = opened.drift().orderBy("batch").collect()
    assert [r.n for r in drift] == [first.codes.count(), second.codes.count() - first.codes.count(), 500 - second.codes.count()]
    assert drift[0].drift == 1.0 and 0.8 < drift[1].drift < 2
    far = spark.createDataFrame([(1000 + i, [float(x) for x in np.eye(64)[i]]) for i in range(64)], "id BIGINT, vector ARRAY<FLOAT>")
    drifted = index_plan.append_vector_index(opened, far)
    assert drifted.drift().where("batch = 3").first().drift > 1.2
    rebuilt = index_plan.build_vector_index(far, root, partitions=2, words=4, iterations=1, replace=True)
    assert (rebuilt.version, rebuilt.codes.count()) == (4, 64)
    added = index_plan.append_vector_index(rebuilt, vectors)
    assert added.codes.count() == 564 and added.batches[0] == "version=4"


def test_sub_vectors_must_fit():
    assert quantised.sub_vector_size(256, 64) == 4
    with pytest.raises(ValueError, match="cannot be cut"):
        quantised.sub_vector_size(64, 7)


def fake_model():
    return lambda texts: np.array([[len(t), 1.0, 2.0] for t in texts])


def test_model_encoder_and_truncation(spark):
    rows = spark.createDataFrame([("Abc ",)], "query STRING")
    encoder = ModelEncoder("lengths", fake_model)
    assert embedding.embed_texts(rows, encoder, 2).first().vector == [len("search_query: abc"), 1.0]
    with pytest.raises(Exception, match="expected vectors of shape"):
        embedding.embed_texts(rows, encoder, 4).collect()
    bad = ModelEncoder("bad", lambda: lambda texts: np.zeros((len(texts) + 1, 2)))
    with pytest.raises(Exception, match="expected vectors of shape"):
        rows.select(vector_of(F.col("query"), bad, 2)).collect()


@pytest.mark.parametrize("first", [1, 3, 16])
def test_pruned_search_is_exact(index, asked, exact, first):
    centroids = index.model.centroids
    radii = partitioned.partition_radii(index.vectors, centroids)
    assert listed(partitioned.pruned_top_k(index.vectors, centroids, radii, asked, first=first)) == listed(exact)


def test_pruning_leaves_partitions_out(spark):
    """On vectors in tight groups only the group of a query is read."""
    rng = np.random.default_rng(3)
    axes = np.eye(8)
    points = np.concatenate([axes[n] + 0.02 * rng.standard_normal((60, 8)) for n in range(8)])
    rows = [(n, v.astype(np.float32).tolist()) for n, v in enumerate(points)]
    vectors = spark.createDataFrame([*rows, (900, None), (901, [0.0] * 8)], "id BIGINT, vector ARRAY<FLOAT>")
    assigned = materialise(partitioned.assign_partitions(vectors, axes), "grouped")
    radii = partitioned.partition_radii(assigned, np.concatenate([axes, -axes[:1]]))
    assert (radii[:8] > 0).all() and radii[8] == -1
    radii = radii[:8]
    asked = vectors.where("id IN (3, 100, 470, 901)").withColumnRenamed("id", "text_id")
    found = partitioned.pruned_top_k(assigned, axes, radii, asked, k=5)
    assert listed(found) == listed(nearest.exact_top_k(vectors, asked, k=5))
    block = partitioned.probing_block(asked.select("text_id", "vector").where("text_id < 900").toArrow(), axes, 1)
    near = nearest.nearest_found(partitioned.only_probed(assigned, block).mapInArrow(
        nearest.scan_vectors(block, 5), nearest.FOUND_SCHEMA), 5)
    assert not partitioned.remaining_block(block, near, axes, radii, 5).probes.any()
    # More than a group holds: all others stay open.
    near = nearest.nearest_found(partitioned.only_probed(assigned, block).mapInArrow(
        nearest.scan_vectors(block, 70), nearest.FOUND_SCHEMA), 70)
    assert partitioned.remaining_block(block, near, axes, radii, 70).probes.sum() == 3 * 7


class Handed(Exception):
    """What a task would have been given."""


def task_of(run):
    """What ``run`` has each task do with its batches."""
    rows = MagicMock()
    rows.select.return_value = rows.where.return_value = rows.withColumn.return_value = rows

    def hand(task, _):
        raise Handed(task)

    rows.mapInArrow.side_effect = hand
    with pytest.raises(Handed) as handed:
        run(rows)
    return handed.value.args[0]


def vector_batch(count, seed=0):
    rng = np.random.default_rng(seed)
    columns = [pa.array(rng.permutation(count)), list_array(rng.normal(size=(count, 64)), pa.float32()),
               pa.array(rng.integers(0, 16, count).astype(np.int32)), pa.array(rng.integers(-2**63, 2**63, count))]
    return pa.RecordBatch.from_arrays(columns, ["id", "vector", "part_id", "draw"])


def some_units(count, seed=1):
    return unit_rows(np.random.default_rng(seed).normal(size=(count, 64)))


TASKS = {
    "search": lambda: nearest.scan_vectors(nearest.QueryBlock(np.arange(10), some_units(10)), 10),
    "search of partitions": lambda: nearest.scan_vectors(nearest.QueryBlock(np.arange(10), some_units(10), some_units(10)[:, :16] > 0), 10),
    "step": lambda: task_of(lambda rows: partitioned.lloyd_step(rows, some_units(129))),
    "draw": lambda: task_of(lambda rows: seeding.race(
        rows, 32, 1, lambda batch: unit_rows(matrix(batch["vector"])), functools.partial(partitioned._apart, some_units(129)))),
}


@pytest.mark.parametrize("name", TASKS)
def test_memory_of_a_task_does_not_grow_with_its_batches(spark, name):
    def peak(count):
        batch = vector_batch(count)
        tracemalloc.start()
        list(task(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    task = TASKS[name]()
    peak(100)
    assert peak(40_960) < 1.5 * peak(4_096)


def test_memory_of_a_search_does_not_grow_with_its_queries(spark):
    """A full block of queries holds little more than its distances at a time, not many copies of them."""
    task = nearest.scan_vectors(nearest.QueryBlock(np.arange(4_096), some_units(4_096)), 10)
    batch = vector_batch(1_024)
    tracemalloc.start()
    list(task(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60e6


@pytest.mark.parametrize("name", TASKS)
def test_small_tiles_give_the_same(spark, name, monkeypatch):
    batches = [vector_batch(300), vector_batch(0), vector_batch(50, 2)]

    def result():
        found = pa.Table.from_batches(list(TASKS[name]()(iter(batches)))).to_pydict()
        return {column: np.array(values) for column, values in found.items()}

    whole = result()
    monkeypatch.setattr(matrices, "ROW_CELLS", 64 * 7)
    small = result()
    assert whole.keys() == small.keys() and len(next(iter(whole.values())))
    for column, values in whole.items():
        assert values.shape == small[column].shape and np.allclose(values.astype(float), small[column].astype(float), atol=1e-9)


def test_draw_equals_the_order_of_all_rows(spark):
    """Of all batches of a task the rows with the smallest keys win, and rows without a weight are never drawn."""
    batches = [vector_batch(5_000), vector_batch(300, 2)]
    weights = lambda batch, _: (batch["id"].to_numpy() % 3).astype(float)
    task = task_of(lambda rows: seeding.race(rows, 20, 1, lambda batch: matrix(batch["vector"]), weights))
    found = pa.Table.from_batches(list(task(iter(batches)))).to_pydict()
    every = [(-np.log(((d % 2**64 >> 11) + 0.5) / 2**53) / (i % 3), d) for b in batches for i, d in zip(b["id"].to_pylist(), b["draw"].to_pylist()) if i % 3]
    assert found["draw"] == [d for _, d in sorted(every)[:20]]


def test_partitions_of_more_rows_than_a_tile(spark):
    units, centroids = some_units(9_000), some_units(16, 3)
    rows = [(i, None if i == 5_000 else [0.0] * 64 if i % 1_000 == 7 else x.tolist()) for i, x in enumerate(units)]
    vectors = spark.createDataFrame(rows, "id BIGINT, vector ARRAY<DOUBLE>").coalesce(1)
    expected = {i: int(np.argmax(units[i] @ centroids.T)) for i, x in rows if x and any(x)}
    assert {r.id: r.part_id for r in partitioned.assign_partitions(vectors, centroids).collect()} == expected
    sizes = {r.part_id: r.n for r in partitioned.lloyd_step(vectors, centroids).collect()}
    assert sizes == {part: list(expected.values()).count(part) for part in set(expected.values())}
