import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corkscan.operators import metrics, workload


def groups():
    rng = random.Random(5)
    return {
        "one": [3.5],
        "two": [1.0, 2.0],
        "same": [7.0] * 5_000,
        "mixed": [7.0] * 3_000 + [rng.expovariate(0.01) for _ in range(4_000)],
        "whole": [float(rng.randrange(50)) for _ in range(2_000)],
        "negative": [rng.gauss(0, 1) for _ in range(777)],
    }


@pytest.fixture(scope="module")
def values(spark):
    rows = [(name, v) for name, found in groups().items() for v in found]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame([*rows, ("empty", None), ("two", None)], "g STRING, v DOUBLE").repartition(6)


def check(found):
    got = {(r.g, r.p): r.value for r in found.collect()}
    assert set(g for g, _ in got) == set(groups())
    for name, data in groups().items():
        for p in (0, 50, 95, 99, 100):
            assert got[(name, p)] == pytest.approx(np.percentile(data, p), rel=1e-12, abs=1e-12)


def test_percentiles(values):
    check(metrics.percentiles(values, ["g"], "v", (0, 50, 95, 99, 100)))


def test_percentiles_when_the_first_range_is_too_narrow(values, monkeypatch):
    monkeypatch.setattr(metrics, "SKETCH_ACCURACY", 20)
    monkeypatch.setattr(metrics, "FIRST_SLACK", 0.001)
    check(metrics.percentiles(values, ["g"], "v", (0, 50, 95, 99, 100)))


@pytest.fixture(scope="module")
def log(spark):
    rows = [("fts", t, i, i % 10 > 0, float(i * (t + 1))) for t in range(3) for i in range(100)]
    return spark.createDataFrame(rows, "search STRING, trial INT, query_id BIGINT, ok BOOLEAN, latency_ms DOUBLE")


def test_trials(spark, log):
    elapsed = spark.createDataFrame([("fts", 0, 0.5), ("fts", 1, 2.0), ("fts", 2, 0.0), ("vector", 0, 4.0)],
                                    "search STRING, trial INT, elapsed_s DOUBLE")
    rows = {(r.search, r.trial): r for r in metrics.trial_metrics(log, elapsed).collect()}
    assert rows[("fts", 0)].success == 90.0 and rows[("fts", 0)].qps == 2000.0 and rows[("fts", 1)].qps == 500.0
    assert rows[("fts", 1)].p50_ms == np.percentile([i * 2.0 for i in range(100)], 50)
    assert math.isinf(rows[("fts", 2)].qps)
    idle = rows[("vector", 0)]
    assert (idle.success, idle.qps, idle.p50_ms, idle.p99_ms) == (0.0, 250.0, 0.0, 0.0)


def test_averages_and_report(spark, log):
    elapsed = spark.createDataFrame([("fts", t, t + 1.0) for t in range(3)], "search STRING, trial INT, elapsed_s DOUBLE")
    average = metrics.trial_averages(metrics.trial_metrics(log, elapsed))
    row = average.first()
    assert row.runs == 3 and row.elapsed_s_avg == 2.0 and row.qps_avg == pytest.approx((1000 + 500 + 1000 / 3) / 3)
    assert row.p50_ms_avg == pytest.approx(49.5 * 2)
    line = metrics.report_rows(average).first().line
    assert line == "| fts | 1000 | 3 | 90.00 | 2.0000 | 611.11 | 99.00 | 188.10 | 196.02 | 16 | 37 | 10 |"
    assert len(line.split("|")) == len(metrics.REPORT_HEADER.split("|"))


@pytest.fixture(scope="module")
def terms(spark):
    return spark.createDataFrame([(i, f"t{i}") for i in range(1, 11)], "query_id BIGINT, query STRING")


def test_draws_repeat_and_spread(terms):
    first = sorted(workload.sample_queries(terms, 1000).collect())
    assert first == sorted(workload.sample_queries(terms.repartition(3), 1000).collect())
    assert [r.query_id for r in first] == list(range(1, 1001))
    counts = [sum(r.query == f"t{i}" for r in first) for i in range(1, 11)]
    assert min(counts) > 60 and max(counts) < 140
    other = sorted(workload.sample_queries(terms, 1000, workload.search_seed("vector")).collect())
    assert workload.search_seed("vector") == 38 and other != first


def test_warmup_takes_turns(terms):
    rows = workload.warmup_queries(terms, 12).orderBy("query_id").collect()
    assert [r.query for r in rows] == [f"t{i}" for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 1, 2)]
    assert workload.warmup_queries(terms, 0).isEmpty()


def test_percentiles_of_a_column_expression(spark):
    rows = spark.range(101).select(F.lit("a").alias("g"), F.col("id").alias("v"))
    assert metrics.percentiles(rows, ["g"], "v", (25,)).first().value == 25.0
