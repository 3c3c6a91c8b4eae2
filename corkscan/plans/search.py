"""Whole searches over published indexes: query texts in, results out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from corkscan.functions.encoders import Encoder
from corkscan.operators import keyword, nearest, partitioned, quantised
from corkscan.operators.embedding import embed_texts
from corkscan.operators.queries import per_query, read_batch
from corkscan.operators.results import fetch_fields
from corkscan.operators.text_index import TextIndex
from corkscan.plans.index import VectorIndex
from corkscan.schemas import EMBEDDING_DIM, SEARCH_FIELD


def search_keywords(index: TextIndex, records: DataFrame, queries: DataFrame, k: int = 10,
                    fields: Sequence[str] = (SEARCH_FIELD,), buckets: int | None = None) -> DataFrame:
    """Result fields, rank and ``_score`` of the best ``k`` records of each query."""
    best = keyword.keyword_top_k(index, queries, k, fields).withColumnRenamed("doc_id", "id")
    return fetch_fields(best, records, "_score", buckets)


def nearest_exact(vectors: DataFrame, queries: DataFrame, encoder: Encoder, k: int = 10,
                  dim: int = EMBEDDING_DIM) -> DataFrame:
    """(query_id, id, _distance, rank): every vector is compared with every distinct text."""
    batch = read_batch(queries)
    return per_query(batch, nearest.exact_top_k(vectors, embed_texts(batch.texts(), encoder, dim), k), k)


def nearest_quantised(index: VectorIndex, queries: DataFrame, encoder: Encoder, k: int = 10,
                      nprobes: int = partitioned.NUM_PROBES, dim: int = EMBEDDING_DIM) -> DataFrame:
    """(query_id, id, _distance, rank) from the codes of the nearest partitions."""
    batch = read_batch(queries)
    vectors = embed_texts(batch.texts(), encoder, dim)
    return per_query(batch, quantised.quantised_top_k(index.codes, index.model, vectors, k, nprobes), k)


def search_vectors(index: VectorIndex, records: DataFrame, queries: DataFrame, encoder: Encoder, k: int = 10,
                   nprobes: int = partitioned.NUM_PROBES, buckets: int | None = None, dim: int = EMBEDDING_DIM) -> DataFrame:
    """Result fields, rank and ``_distance`` of the nearest ``k`` records of each query."""
    best = nearest_quantised(index, queries, encoder, k, nprobes, dim)
    return fetch_fields(best, records, "_distance", buckets)


def search_by_script(vectors: DataFrame, records: DataFrame, queries: DataFrame, encoder: Encoder, k: int = 10,
                     buckets: int | None = None, dim: int = EMBEDDING_DIM) -> DataFrame:
    """Result fields, rank and ``_score`` (cosine + 1) over all vectors."""
    best = nearest.script_score(nearest_exact(vectors, queries, encoder, k, dim))
    return fetch_fields(best, records, "_score", buckets)
