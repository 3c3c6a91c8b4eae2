import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from corkscan.functions.encoders import HashingEncoder
from corkscan.operators import validation
from corkscan.plans import ingest
from corkscan.sources import arrays, lines, tables, versions
from tests.test_validation import line


@pytest.fixture
def gzip_lines(tmp_path):
    def write(*files):
        for i, rows in enumerate(files):
            with gzip.open(tmp_path / f"part-{i}.jsonl.gz", "wt", encoding="utf-8") as f:
                f.write("".join(row + "\n" for row in rows))
        return str(tmp_path)

    return write


def test_json_lines_in_file_order(spark, gzip_lines):
    path = gzip_lines(["a", "", "b"], ["c"], ["d", "e"])
    rows = lines.read_json_lines(spark, path, with_position=True)
    assert [(r.position, r.raw) for r in rows.orderBy("position").collect()] == list(enumerate("abcde", 1))
    assert sorted(r.raw for r in lines.first_rows(rows, 3).collect()) == ["a", "b", "c"]
    assert lines.first_rows(rows, 0).count() == lines.read_json_lines(spark, path).count() == 5


def test_positions_across_splits_of_one_file(spark, tmp_path):
    (tmp_path / "q.txt").write_text("".join(f" line {i} \n" if i % 7 else "   \n" for i in range(1, 400)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        found = lines.read_query_lines(spark, str(tmp_path)).orderBy("query_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    expected = [f"line {i}" for i in range(1, 400) if i % 7]
    assert [(r.query_id, r.query) for r in found] == list(enumerate(expected, 1))


def test_no_query_lines_is_an_error(spark, tmp_path):
    (tmp_path / "q.txt").write_text(" \n\t\n")
    with pytest.raises(ValueError, match="no data"):
        lines.read_query_lines(spark, str(tmp_path))


def test_dense_ids(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"x": 1}, {"x": 2, "id": 90}, {"x": None}], indent=1))
    (tmp_path / "b.json").write_text(json.dumps([{"x": 4, "id": None}, {"y": 5}]))
    rows = lines.with_dense_id(lines.read_json_array(spark, str(tmp_path), ["id", "x"])).orderBy("position").collect()
    assert [r.id for r in rows] == [1, 90, 3, None, 5]
    plain = lines.with_dense_id(lines.read_json_array(spark, str(tmp_path), ["x"])).orderBy("position")
    missing = plain.select("id", F.col("x").isNull().alias("missing")).collect()
    assert [r.id for r in missing] == [1, 2, 3, 4, 5]
    assert [r.missing for r in missing] == [False, False, False, False, True]


def random_json(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 5)
    if kind < 3:
        return "".join(rng.choice(['"', "\\", ",", "[", "]", "{", "}", "é", "日", "\n", "a", " "]) for _ in range(rng.randrange(12)))
    if kind < 5:
        return rng.choice([None, True, 1, -2.5, 10**12])
    if kind == 5:
        return [random_json(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["x", "y,", '"]']): random_json(rng, depth + 1) for _ in range(rng.randrange(3))}


@pytest.mark.parametrize("size", ["23b", "300b", "128m"])
@pytest.mark.parametrize("indent", [None, 2])
def test_arrays_in_ranges_equal_the_plain_reader(spark, tmp_path, size, indent):
    rng = random.Random(9)
    files = [[{"id": n, "x": random_json(rng)} for n in range(count)] for count in (9, 0, 1, 5)]
    for n, rows in enumerate(files):
        text = json.dumps(rows, indent=indent, ensure_ascii=n % 2 == 0)
        (tmp_path / f"{n}.json").write_text(rng.choice(["", " \n", "\ufeff"] if indent else [""]) + text + rng.choice(["", "\n \n"]))
    (tmp_path / "empty.json").write_text("")
    expected = sorted(json.dumps(row, sort_keys=True) for rows in files for row in rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        found = arrays.array_elements(spark, str(tmp_path)).collect()
        rows = arrays.read_large_json_array(spark, str(tmp_path), ["id", "x"]).select(
            F.try_variant_get("id", "$", "int").alias("id"), F.to_json("x").alias("x")).collect()
        splits = spark.read.option("lineSep", ",").text(str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(json.dumps(json.loads(r.element), sort_keys=True) for r in found) == expected
    plain = lines.read_json_array(spark, str(tmp_path), ["id", "x"]).where("id IS NOT NULL").select(
        F.try_variant_get("id", "$", "int").alias("id"), F.to_json("x").alias("x")).collect()
    assert sorted(map(str, rows)) == sorted(map(str, plain))
    assert splits > 20 if size == "23b" else splits >= 1
    in_order = [json.loads(r.element)["id"] for r in sorted(found, key=lambda r: (r.file, r.start, r.at))]
    assert [n for n in in_order if n == 0] == [0] * 3 and len({(r.file, r.start, r.at) for r in found}) == len(found)


def test_arrays_of_other_things(spark, tmp_path):
    (tmp_path / "a.json").write_text('[1, "a,b", [2, 3], null]')
    assert sorted(r.element.strip() for r in arrays.array_elements(spark, str(tmp_path)).collect()) == ['"a,b"', "1", "[2, 3]", "null"]
    (tmp_path / "b.json").write_text('{"x": 1}')
    with pytest.raises(Exception, match="not a JSON array"):
        arrays.array_elements(spark, str(tmp_path)).collect()


def test_json_lines_keep_nulls(spark, folder):
    df = spark.createDataFrame([(1, None)], "id INT, x STRING")
    lines.write_json_lines(df, folder)
    assert [r.raw for r in lines.read_json_lines(spark, folder).collect()] == ['{"id":1,"x":null}']
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        lines.write_json_lines(df, folder)
    lines.write_json_lines(df, folder, "overwrite", keep_nulls=False)
    assert [r.raw for r in lines.read_json_lines(spark, folder).collect()] == ['{"id":1}']


def vectors(spark, *rows):
    return spark.createDataFrame(list(rows), "id BIGINT, vector ARRAY<FLOAT>")


def test_vector_size_is_kept_and_guarded(spark, folder):
    tables.append_vectors(vectors(spark, (1, [1.0, 2.0])), folder, 2)
    stored = spark.read.parquet(folder)
    assert stored.schema["vector"].metadata == {"dim": 2} and tables.vector_size(stored) == 2
    with pytest.raises(ValueError, match="size 2"):
        tables.append_vectors(vectors(spark, (2, [1.0])), folder, 1)
    with pytest.raises(Exception, match="expected vectors of size 2, got 1"):
        tables.append_vectors(vectors(spark, (2, [1.0])), folder, 2)
    tables.append_vectors(vectors(spark, (1, [1.0, 2.0])), folder, 2)
    assert spark.read.parquet(folder).count() == 2
    tables.append_vectors(vectors(spark, (3, [1.0])), folder, 1, tables.OVERWRITE)
    assert spark.read.parquet(folder).count() == 1


def test_vector_size_without_a_note(spark, folder):
    vectors(spark, (1, [1.0, 2.0, 3.0]), (2, None)).write.parquet(folder)
    assert tables.vector_size(spark.read.parquet(folder)) == 3
    assert tables.wrong_sizes(vectors(spark, (1, [1.0]), (2, [1.0, 2.0])), 2).collect() == [(1, 1)]


def test_upsert(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id INT, x STRING")
    batch = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 3)], "id INT, x STRING, position INT")
    once = tables.upsert(table, batch, "id", F.col("position"))
    twice = tables.upsert(once, batch, "id", F.col("position"))
    assert sorted(once.collect()) == sorted(twice.collect()) == [(1, "a"), (2, "d"), (3, "e")]


def test_rejects_stop_a_write(spark):
    rows = spark.createDataFrame([("x", ["points"])], "raw STRING, reasons ARRAY<STRING>")
    with pytest.raises(ValueError, match="points"):
        tables.require_no_rejects(rows)
    tables.require_no_rejects(rows.limit(0))


def test_versions(spark, folder):
    assert versions.newest(spark, folder) is None and versions.next_version(spark, folder, False) == 0
    versions.publish(spark, folder, 0)
    with pytest.raises(FileExistsError):
        versions.next_version(spark, folder, False)
    assert versions.next_version(spark, folder, True) == 1


def test_partitioned_write_splits_no_rows_off(spark, folder):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5).alias("part_id"))
    tables.write_table(rows, folder, partition_by="part_id")
    assert spark.read.parquet(folder).count() == 1000


ENCODER = HashingEncoder(16)


def test_load_appends_again(spark, gzip_lines, folder):
    path = gzip_lines([line(id=1), line(id=2)], [line(id=3)])
    done = ingest.load_records(spark, path, folder, ENCODER, dim=16)
    assert (done.rows, done.rejected) == (3, 0)
    ingest.load_records(spark, path, folder, ENCODER, limit=2, dim=16)
    stored = ingest.read_records(spark, folder)
    assert sorted(r.id for r in stored.collect()) == [1, 1, 2, 2, 3]
    assert "to_vectorize" in stored.columns
    with pytest.raises(ValueError, match="size 16"):
        ingest.load_records(spark, path, folder, HashingEncoder(8), dim=8)
    ingest.load_records(spark, path, folder, ENCODER, limit=1, overwrite=True, dim=16)
    assert [r.id for r in ingest.read_records(spark, folder).collect()] == [1]


def test_a_failed_overwrite_leaves_the_table(spark, gzip_lines, folder):
    ingest.load_records(spark, gzip_lines([line(id=1), line(id=2)]), folder, ENCODER, dim=16)
    bad = gzip_lines([line(id=3), line(id=4, points="x")])
    for _ in range(2):
        with pytest.raises(Exception, match="invalid record"):
            ingest.load_records(spark, bad, folder, ENCODER, overwrite=True, dim=16)
        assert sorted(r.id for r in ingest.read_records(spark, folder).collect()) == [1, 2]


def test_limit_counts_records(spark, gzip_lines, folder):
    path = gzip_lines(["", "  ", line(id=1), "", line(id=2), line(id=3)])
    assert ingest.load_records(spark, path, folder, ENCODER, limit=2, dim=16).rows == 2
    assert sorted(r.id for r in ingest.read_records(spark, folder).collect()) == [1, 2]


def test_load_stops_or_sets_aside(spark, gzip_lines, folder):
    path = gzip_lines([line(id=1), line(id=2, points="x")])
    with pytest.raises(Exception, match="invalid record"):
        ingest.load_records(spark, path, folder, ENCODER, dim=16)
    done = ingest.load_records(spark, path, folder, ENCODER, on_invalid=ingest.QUARANTINE, dim=16)
    assert (done.rows, done.rejected) == (1, 1)
    assert [r.reasons for r in ingest.read_rejected(spark, folder).collect()] == [["points"]]


def test_load_keyed_twice_is_once(spark, gzip_lines, folder):
    path = gzip_lines([line(id=1), line(id=2, title="old"), line(id=2, title="new"), line(id=3, country="null")])
    for version in range(2):
        assert ingest.load_keyed(spark, path, folder, ENCODER, dim=16).rows == 4
        stored = ingest.read_keyed(spark, folder)
        assert sorted((r._id, r.title) for r in stored.collect()) == [("1", "T"), ("2", "new"), ("3", "T")]
        assert versions.newest(spark, folder) == version
    assert "to_vectorize" not in stored.columns and stored.where("country = 'Unknown'").count() == 1
    with pytest.raises(ValueError, match="size 16"):
        ingest.load_keyed(spark, path, folder, HashingEncoder(8), dim=8)
    ingest.load_keyed(spark, path, folder, HashingEncoder(8), limit=1, recreate=True, dim=8)
    assert ingest.read_keyed(spark, folder).count() == 1


def test_keyed_loads_write_only_the_folders_they_touch(spark, gzip_lines, folder):
    ingest.load_keyed(spark, gzip_lines([line(id=n) for n in range(40)]), folder, ENCODER, dim=16, buckets=8)
    before = set(versions.folders(spark, folder, 0))
    ingest.load_keyed(spark, gzip_lines([line(id=7, title="new")]), folder, ENCODER, dim=16)
    after = set(versions.folders(spark, folder, 1))
    assert len(before) == len(after) == 8 and len(after - before) == 1
    stored = ingest.read_keyed(spark, folder)
    assert stored.count() == 40 and stored.where("title = 'new'").count() == 1


@pytest.mark.parametrize("few", [0, 16])
def test_keyed_loads_store_keys_aside_and_rows_once(spark, gzip_lines, folder, monkeypatch, few):
    """Rows are long: only what tells which of them stay is stored beside the table itself."""
    aside, store = [], ingest.materialise
    monkeypatch.setattr(ingest, "materialise", lambda df, name: aside.append(set(df.columns)) or store(df, name))
    monkeypatch.setattr(ingest, "FEW_BUCKETS", few)
    first = [line(id=n, title="one") for n in range(9)] + [line(id=3, title="two"), line(id=5, title="two"), line(id=3, title="three")]
    assert ingest.load_keyed(spark, gzip_lines(first), folder, ENCODER, dim=16, buckets=4).rows == 12
    more = [line(id=7, title="four"), line(id=20, title="four"), line(id=7, title="five")]
    assert ingest.load_keyed(spark, gzip_lines(more), folder, ENCODER, dim=16).rows == 3
    expected = {str(n): "one" for n in range(9)} | {"3": "three", "5": "two", "7": "five", "20": "four"}
    assert sorted((r._id, r.title) for r in ingest.read_keyed(spark, folder).collect()) == sorted(expected.items())
    assert aside and all(columns <= {"_id", "position"} for columns in aside)
    ingest.load_records(spark, gzip_lines(more), f"{folder}/plain", ENCODER, dim=16)
    both = [*ingest.read_keyed(spark, folder).inputFiles(), *ingest.read_records(spark, f"{folder}/plain").inputFiles()]
    assert both and all(".zstd." in file for file in both)
    stored = spark.read.parquet(f"{folder}/version=1")
    assert stored.where(tables.bucket_of(F.col("_id"), 4) != F.col("bucket")).isEmpty()


def test_jobs_drop_their_shuffles(spark):
    from corkscan.storage import DROP_SHUFFLES, shuffles_dropped

    before = spark.conf.get(DROP_SHUFFLES, None)
    with shuffles_dropped(spark):
        assert spark.conf.get(DROP_SHUFFLES) == "true"
        rows = spark.range(100).repartition(7).groupBy(F.col("id") % 5).count()
        assert [rows.count(), len(rows.collect()), len(rows.collect())] == [5, 5, 5]
    assert spark.conf.get(DROP_SHUFFLES, None) == before


def test_load_keyed_stops_on_a_reject(spark, gzip_lines, folder):
    with pytest.raises(ValueError, match="nothing was written"):
        ingest.load_keyed(spark, gzip_lines([line(id=1), line(points="x")]), folder, ENCODER, dim=16)
    assert ingest.read_keyed(spark, folder) is None


def test_empty_input_is_an_error(spark, gzip_lines, folder):
    with pytest.raises(ValueError, match="no data"):
        ingest.load_records(spark, gzip_lines([]), folder, ENCODER, dim=16)


def test_records_by_id(spark, folder):
    rows = spark.createDataFrame([(line(id=i),) for i in range(20)], "raw STRING")
    tables.write_by_id(validation.accepted(validation.check_records(rows)), folder, 4)
    stored = spark.read.parquet(folder)
    assert stored.count() == 20
    assert stored.where(tables.bucket_of(F.col("id"), 4) != F.col("id_bucket")).isEmpty()


def test_a_row_cap_opens_no_later_file(spark, gzip_lines, tmp_path):
    path = gzip_lines(["a", " ", "b"], ["", " "], ["c", "d"], ["e"])
    every = [(r.position, r.raw) for r in lines.read_first_json_lines(spark, path, 0).orderBy("position").collect()]
    assert every == list(enumerate("abcde", 1))
    for count in range(1, 8):
        rows = lines.read_first_json_lines(spark, path, count).orderBy("position").collect()
        assert [(r.position, r.raw) for r in rows] == every[:count]
    (tmp_path / "part-3.jsonl.gz").write_bytes(b"\x1f\x8bnot gzip at all")  # whoever opens it fails
    assert [r.raw for r in lines.read_first_json_lines(spark, path, 2).orderBy("position").collect()] == ["a", "b"]
    with pytest.raises(Exception):
        lines.read_first_json_lines(spark, path, 5).collect()


def test_a_row_cap_with_odd_names(spark, tmp_path):
    for name, text in (("a [1] b%20.txt", "x\ny\n"), ("c {2}*.txt", "z\n")):
        (tmp_path / name).write_text(text)
    assert [r.raw for r in lines.read_first_json_lines(spark, str(tmp_path), 3).orderBy("position").collect()] == ["x", "y", "z"]
    assert [r.raw for r in lines.read_first_json_lines(spark, str(tmp_path), 1).collect()] == ["x"]
