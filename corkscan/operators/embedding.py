"""Embed record texts and query texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corkscan.functions.encoders import Encoder, vector_of
from corkscan.functions.text import document_text, query_text
from corkscan.schemas import EMBEDDING_DIM


def embed_documents(docs: DataFrame, text_column: str, encoder: Encoder, dim: int = EMBEDDING_DIM) -> DataFrame:
    """Add ``vector``: each row's text, prefixed as a document, encoded."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    return docs.withColumn("vector", vector_of(document_text(text), encoder, dim))


def embed_texts(texts: DataFrame, encoder: Encoder, dim: int = EMBEDDING_DIM) -> DataFrame:
    """Add ``vector`` to distinct query texts (``query``), prefixed as queries."""
    return texts.withColumn("vector", vector_of(query_text(F.col("query")), encoder, dim))
