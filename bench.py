"""Batch search on the test documents: index once, then 1,000 queries per search.

Follows the published protocol: 1,000 queries drawn with a fixed seed from ten
lines, warm-up queries before each trial, the mean of three trials. Equal texts are
searched once, so that such a batch is ten searches; the searches named ``distinct``
answer 1,000 different texts instead: two words of a document each. The warm-up of
a trial is a batch of ten queries of the same search, answered ``WARMUP_RUNS`` times.
Prints one JSON line; ``queries`` holds seconds per 1,000 queries, ``texts`` how
many of them are different, ``build`` seconds of the work done once before.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corkscan.functions.encoders import HashingEncoder
from corkscan.operators import keyword, nearest, text_index, workload
from corkscan.operators.embedding import embed_documents
from corkscan.plans import index as index_plan
from corkscan.plans import search
from corkscan.registry.fixed import DOCUMENT_LINES, VECTOR_LINES
from corkscan.registry.workspace import query_frame
from corkscan.schemas import EMBEDDING_DIM
from corkscan.shipping import ship
from corkscan.storage import materialise, new_path

# The warm-up queries are one batch here, answered this often before each trial.
WARMUP_RUNS = 3


def session(cores: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("corkscan-bench")
        .config("spark.sql.shuffle.partitions", "8" if cores == "*" else cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        # No call sites in error messages: less work per column expression.
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def timed(run):
    started = time.perf_counter()
    result = run()
    return result, time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    encoder, build = HashingEncoder(EMBEDDING_DIM), {}

    text, build["text_index"] = timed(
        lambda: text_index.build_text_index(docs, new_path(spark, "bench-text"), "doc_id", ["text"]))
    spread = docs.repartition(spark.sparkContext.defaultParallelism).withColumnRenamed("doc_id", "id")
    vectors, build["embed_documents"] = timed(
        lambda: materialise(embed_documents(spread, "text", encoder).select("id", "vector"), "bench-vectors"))
    vector, build["vector_index"] = timed(
        lambda: index_plan.build_vector_index(vectors, new_path(spark, "bench-vector")))

    def lines(kind: str) -> DataFrame:
        found = query_frame(spark, DOCUMENT_LINES if kind == "fts" else VECTOR_LINES)
        return found.withColumn("query_id", F.col("query_id") + 1)

    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), 0)
    pair = F.concat_ws(" ", F.get("words", F.col("doc_id").cast("int") % 7), F.get("words", F.lit(8)))
    pairs = docs.select("doc_id", words.alias("words")).where(F.size("words") > 8).select("doc_id", pair.alias("query"))
    pairs = pairs.groupBy("query").agg(F.min("doc_id").alias("query_id")).orderBy("query_id").limit(workload.NUM_QUERIES)
    distinct = materialise(pairs.select("query_id", "query").coalesce(1), "bench-distinct")

    def asked(kind: str) -> tuple[DataFrame, DataFrame]:
        """The batch of a search, and its warm-up."""
        if kind == "distinct":
            return distinct, materialise(distinct.limit(workload.WARMUP_QUERIES), "bench-warmup")
        drawn = workload.sample_queries(lines(kind), seed=workload.search_seed(kind))
        return materialise(drawn.coalesce(1), "bench-queries"), workload.warmup_queries(lines(kind))

    searches = {
        "keyword_bm25_distinct_top10": ("distinct", lambda q: keyword.keyword_top_k(text, q)),
        "keyword_match_distinct_top10": ("distinct", lambda q: keyword.match_top_k(text, q)),
        "vector_ivfpq_distinct_top10": ("distinct", lambda q: search.nearest_quantised(vector, q, encoder)),
        "vector_exact_distinct_top10": ("distinct", lambda q: nearest.script_score(search.nearest_exact(vectors, q, encoder))),
        "keyword_bm25_top10": ("fts", lambda q: keyword.keyword_top_k(text, q)),
        "keyword_match_top10": ("fts", lambda q: keyword.match_top_k(text, q)),
        "vector_ivfpq_top10": ("vector", lambda q: search.nearest_quantised(vector, q, encoder)),
        "vector_exact_top10": ("vector", lambda q: nearest.script_score(search.nearest_exact(vectors, q, encoder))),
    }
    seconds, qps, answered, texts = {}, {}, {}, {}
    for name, (kind, run) in searches.items():
        drawn, warm = asked(kind)
        texts[name] = drawn.select("query").distinct().count()
        trials = []
        for _ in range(workload.NUM_TRIALS):
            for _ in range(WARMUP_RUNS):
                run(warm).toArrow()
            found, spent = timed(lambda: run(drawn).toArrow())
            trials.append(spent)
        answered[name] = len(set(found["query_id"].to_pylist()))
        seconds[name] = round(sum(trials) / len(trials), 4)
        qps[name] = round(sum(workload.NUM_QUERIES / t for t in trials) / len(trials), 1)
        print(name, [round(t, 3) for t in trials], file=sys.stderr)
    print(json.dumps({
        "metric": "seconds to answer 1000 queries per search, summed over searches",
        "value": round(sum(seconds.values()), 4),
        "unit": "sec",
        "queries": seconds,
        "qps": qps,
        "answered": answered,
        "texts": texts,
        "build": {name: round(spent, 3) for name, spent in build.items()},
        "sf": sf_dir.rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
