"""Keyword search: BM25 top-k and matching documents over a published text index."""

from __future__ import annotations

import dataclasses
import functools
import operator
from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corkscan.functions.matrices import PLACES
from corkscan.functions.text import quoted, tokens
from corkscan.operators.queries import QueryBatch, per_query, read_batch
from corkscan.operators.ranking import top_k
from corkscan.operators.text_index import TextIndex
from corkscan.storage import materialise

# Parquet pages are skipped by one equality test per word, for up to so many,
# in lists that Spark passes on whole.
FILTER_TERMS = 200
FILTER_LIST = 10
# Searches of a small batch that would add up more pairs of texts and documents than
# this leave out what bounds on scores exclude, at the price of one more pass.
PRUNE_PAIRS = 10_000_000
# The first pass reads the rarest words of a text, until they have so many times k postings.
FIRST_POSTINGS = 4
# Texts of a batch that one number has bits for.
BITS = 64
# Rounded scores lie this close to exact ones, with room for sums in another order.
SLACK = 2 * 10.0 ** -PLACES
# The shuffled join cuts the postings of a hot word into pieces of so many rows.
# The table of hot words is broadcast; it has two numbers for each of them, and at
# most so many rows: pieces are larger where there would be more.
PIECE_ROWS = 1_000_000
HOT_WORDS = 1_000_000


@dataclasses.dataclass(frozen=True)
class Bm25:
    k1: float = 1.2
    b: float = 0.75


def query_terms(texts: DataFrame, joined: bool = False) -> DataFrame:
    """(text_id, term, qtf): the words of each query text and their counts."""
    return (
        texts.select("text_id", F.explode(tokens(F.col("query"), joined)).alias("term"))
        .groupBy("text_id", "term")
        .agg(F.count("*").alias("qtf"))
    )


def _local_terms(batch: QueryBatch) -> pa.Table:
    """As ``query_terms``, of a small batch."""
    counts = [(r.text_id, term, n) for r in batch.few for term, n in sorted(Counter(r.words).items())]
    ids, terms, times = zip(*counts) if counts else ((), (), ())
    return pa.table({
        "text_id": pa.array(ids, pa.int64()), "term": pa.array(terms, pa.string()), "qtf": pa.array(times, pa.int64()),
    })


def _is_one_of(column: Column, values: Sequence[str]) -> Column:
    """``column`` is one of ``values``, in lists so short that each value is
    compared with the bounds of a Parquet page."""
    if not values or len(values) > FILTER_TERMS:
        return column.isin(list(values))
    lists = [column.isin(list(values[i:i + FILTER_LIST])) for i in range(0, len(values), FILTER_LIST)]
    return functools.reduce(operator.or_, lists)


def _checked_fields(index: TextIndex, fields: Sequence[str] | None) -> list[str]:
    unknown = [f for f in fields or () if f not in index.n]
    if unknown:
        raise ValueError(f"not indexed: {', '.join(unknown)}")
    return list(fields or sorted(index.n))


def _weights(index: TextIndex, terms: DataFrame, freq: DataFrame, fields: Sequence[str], bm25: Bm25) -> DataFrame:
    """(text_id, field, term, weight, avgdl, df, bound): the part of a score that no document changes, and
    the most that a document can score with the word.

    A score grows with the count of a word and falls with the length of its
    document, so the largest count and the smallest length bound it, whatever the
    mean length has become since they were written.
    """
    sizes = ", ".join(f"{quoted(f)}, struct({float(index.n[f])!r}D AS n, {index.avgdl[f]!r}D AS avgdl)" for f in fields)
    rows = freq.join(terms, "term").selectExpr("*", f"map({sizes})[field] AS size")
    idf = "ln(1D + (size.n - df + 0.5D) / (df + 0.5D))"
    rows = rows.selectExpr("*", f"qtf * {idf} * {bm25.k1 + 1.0!r}D AS weight", "size.avgdl AS avgdl")
    return rows.selectExpr("text_id", "field", "term", "weight", "avgdl", "df",
                           f"weight * {_share(bm25, 'top_tf', 'least_len')} AS bound")


def _share(bm25: Bm25, tf: str, doc_len: str) -> str:
    """How much of a word's weight a document gets."""
    return f"({tf} / ({tf} + {bm25.k1!r}D * ({1.0 - bm25.b!r}D + {bm25.b!r}D * {doc_len} / avgdl)))"


def _local_weights(index: TextIndex, batch: QueryBatch, fields: Sequence[str], bm25: Bm25) -> pa.Table:
    """As ``_weights``, of a small batch: at most one row per query word and field."""
    terms = _local_terms(batch)
    freq = index.word_figures().where(F.col("field").isin(list(fields)))
    asked = _is_one_of(F.col("term"), sorted(set(terms["term"].to_pylist())))
    return _weights(index, F.broadcast(index.spark.createDataFrame(terms)), freq.where(asked), fields, bm25).toArrow()


def _rows_of(index: TextIndex, weights: pa.Table) -> DataFrame:
    """The postings of all words in ``weights``."""
    fields, terms = (sorted(set(weights[name].to_pylist())) for name in ("field", "term"))
    return index.postings().where(F.col("field").isin(fields)).where(_is_one_of(F.col("term"), terms))


def _local_hits(index: TextIndex, weights: pa.Table) -> DataFrame:
    """Postings of the words in ``weights``, each with the weight it has for a text."""
    return _rows_of(index, weights).join(F.broadcast(index.spark.createDataFrame(weights)), ["field", "term"])


def _known_terms(index: TextIndex, texts: DataFrame, fields: Sequence[str]) -> DataFrame:
    """As ``query_terms``, of the words that the index has."""
    known = index.word_figures().where(F.col("field").isin(list(fields))).select("term").distinct()
    return query_terms(texts, index.joined).join(known, "term", "left_semi")


def _searches(terms: DataFrame) -> DataFrame:
    """(text_id, search_id, terms): texts with the same words as often are one search, named after one of them."""
    bags = materialise(terms.groupBy("text_id").agg(F.sort_array(F.collect_list(F.struct("term", "qtf"))).alias("terms")), "bags")
    named = bags.groupBy("terms").agg(F.min("text_id").alias("search_id"))
    return materialise(bags.join(named, "terms").select("text_id", "search_id", "terms"), "searches")


def _best_of_many(index: TextIndex, batch: QueryBatch, fields: Sequence[str], bm25: Bm25, k: int) -> DataFrame:
    """The best ``k`` documents of each text of any batch; words that the index lacks make no difference between texts."""
    searches = _searches(_known_terms(index, batch.texts(), fields))
    asked = searches.where("text_id = search_id").select("text_id", F.inline("terms"))
    best = _best(_rounded(_summed(_hits(index, asked, fields, bm25), bm25)), k)
    return searches.select("text_id", "search_id").join(best.withColumnRenamed("text_id", "search_id"), "search_id").drop("search_id")


def _hits(index: TextIndex, terms: DataFrame, fields: Sequence[str], bm25: Bm25) -> DataFrame:
    """Postings of the query words (text_id, term, qtf) of any batch, each with the weight it has for a text."""
    in_fields = F.col("field").isin(list(fields))
    freq, rows = index.word_figures().where(in_fields), index.postings().where(in_fields)
    weights = _weights(index, terms, freq, fields, bm25)
    hot = _hot_words(index, freq)
    pieces = F.coalesce("pieces", F.lit(1))
    named = F.xxhash64("field", "term") == F.col("word")
    weights = weights.join(F.broadcast(hot), named, "left").withColumn(
        "piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("pieces", "word")
    spread = rows.join(F.broadcast(hot), named, "left").withColumn(
        "piece", F.pmod(F.xxhash64("doc_id"), pieces).cast("int")).drop("pieces", "word")
    return spread.join(weights, ["field", "term", "piece"])


def _hot_words(index: TextIndex, freq: DataFrame) -> DataFrame:
    """(word, pieces): hashes of words in so many documents that their postings are
    joined in pieces, by hash of the document.

    There are no more postings than words in the texts, so at most ``HOT_WORDS``
    words can pass the bound. Of two words with one hash, the pieces of the more
    frequent one count for both.
    """
    all_words = sum(index.n[f] * index.avgdl[f] for f in index.n)
    bound = max(PIECE_ROWS, int(all_words / HOT_WORDS))
    hot = freq.where(F.col("df") > bound)
    return hot.groupBy(F.xxhash64("field", "term").alias("word")).agg(F.ceil(F.max("df") / bound).cast("int").alias("pieces"))


def _summed(hits: DataFrame, bm25: Bm25) -> DataFrame:
    """(doc_id, text_id, score): added up inside each bucket."""
    return hits.groupBy("doc_id", "text_id").agg(F.expr(f"sum(weight * {_share(bm25, 'tf', 'doc_len')}) AS score"))


def _rounded(scores: DataFrame) -> DataFrame:
    return scores.select("doc_id", "text_id", F.round("score", PLACES).alias("_score"))


def match_scores(index: TextIndex, batch: QueryBatch, fields: Sequence[str] | None = None, bm25: Bm25 = Bm25()) -> DataFrame:
    """(doc_id, text_id, _score) of every document that holds a word of a text.

    A word asked for twice counts twice; scores add up over words and fields.
    """
    fields = _checked_fields(index, fields)
    if batch.few is None:
        hits = _hits(index, query_terms(batch.texts(), index.joined), fields, bm25)
    else:
        hits = _local_hits(index, _local_weights(index, batch, fields, bm25))
    return _rounded(_summed(hits, bm25))


def _best(scores: DataFrame, k: int) -> DataFrame:
    return top_k(scores, "text_id", [F.desc("_score"), F.asc("doc_id")], k)


def _by_text(weights: pa.Table) -> dict[int, list[dict]]:
    """The words of each text."""
    texts: dict[int, list[dict]] = {}
    for row in weights.to_pylist():
        texts.setdefault(row["text_id"], []).append(row)
    return texts


def _rarest(words: Sequence[dict], postings: int) -> list[dict]:
    """The rarest words, as many as it takes to have so many postings."""
    taken, total = [], 0
    for word in sorted(words, key=lambda w: (w["df"], w["field"], w["term"])):
        if taken and total >= postings:
            break
        taken.append(word)
        total += word["df"]
    return taken


def _cannot_do_alone(words: Sequence[dict], threshold: float) -> list[dict]:
    """The words with the lowest bounds, as many as stay below ``threshold`` together: a document needs another one."""
    taken, total = [], 0.0
    for word in sorted(words, key=lambda w: (w["bound"], w["field"], w["term"])):
        total += word["bound"]
        if total + SLACK >= threshold:
            break
        taken.append(word)
    return taken


def _bits(place: str, count: int) -> list[Column]:
    """Aggregates: which of the places 0 to ``count`` - 1 there are, ``BITS`` to a number."""
    return [F.expr(f"coalesce(bit_or(if({place} DIV {BITS} = {n}, shiftleft(1L, {place} % {BITS}), 0L)), 0L)")
            for n in range(-(-count // BITS))]


def _pruned_scores(index: TextIndex, weights: pa.Table, bm25: Bm25, k: int) -> DataFrame:
    """As ``match_scores``, of the documents that can be among the best ``k`` of a text.

    A first pass adds up the rarest words of each text; the k-th best sum is a
    threshold that the k best documents reach. Words that together stay below it
    are not read for their own sake: documents are found by the other words, those
    that cannot reach the threshold even with the best of the rest are left out,
    and only for what remains are the rest looked up, document by document, inside
    the bucket. No pair of a text and a document is made for a common word alone.
    """
    texts, schema = _by_text(weights), weights.schema
    first = pa.Table.from_pylist([w for words in texts.values() for w in _rarest(words, FIRST_POSTINGS * k)], schema)
    tops = _best(_rounded(_summed(_local_hits(index, first), bm25)), k)
    # One row for each text of a small batch.
    reached = {r.text_id: r.least for r in tops.groupBy("text_id").agg(
        F.min("_score").alias("least"), F.count("*").alias("n")).where(F.col("n") >= k).collect()}
    rest = {text: _cannot_do_alone(words, reached.get(text, 0.0)) for text, words in texts.items()}
    others = {(w["text_id"], w["field"], w["term"]) for words in rest.values() for w in words}
    finders = [w for words in texts.values() for w in words if (w["text_id"], w["field"], w["term"]) not in others]
    found = _summed(_local_hits(index, pa.Table.from_pylist(finders, schema)), bm25)
    if not others:
        return _rounded(found)
    limits = pa.table({
        "text_id": pa.array(list(rest), pa.int64()),
        "place": pa.array(range(len(rest)), pa.int32()),
        "open": pa.array([sum(w["bound"] for w in words) for words in rest.values()], pa.float64()),
        "least": pa.array([reached.get(text, 0.0) - SLACK for text in rest], pa.float64())})
    numbered = index.spark.createDataFrame(limits.select(["text_id", "place"]))
    # As many rows as the batch has texts, and query words.
    found = found.join(F.broadcast(index.spark.createDataFrame(limits)), "text_id").where("score + open >= least")
    lookups = pa.Table.from_pylist([w for words in rest.values() for w in words], schema)
    # One row for each document, a bit for each text of the batch: joined on the document alone, it stays in its bucket.
    asked = found.select("doc_id", "place").groupBy("doc_id").agg(F.array(*_bits("place", len(rest))).alias("asked"))
    rows = _rows_of(index, lookups).join(asked.hint("shuffle_hash"), "doc_id")
    rows = rows.join(F.broadcast(index.spark.createDataFrame(lookups).join(F.broadcast(numbered), "text_id")), ["field", "term"])
    extra = _summed(rows.where(f"getbit(asked[place DIV {BITS}], place % {BITS}) = 1"), bm25)
    both = found.select("doc_id", "text_id", "score").unionByName(extra)
    return _rounded(both.groupBy("doc_id", "text_id").agg(F.sum("score").alias("score")))


def keyword_top_k(index: TextIndex, queries: DataFrame, k: int = 10,
                  fields: Sequence[str] | None = None, bm25: Bm25 = Bm25(), prune_pairs: int = PRUNE_PAIRS) -> DataFrame:
    """(query_id, doc_id, _score, rank): the best ``k`` documents of each query.

    ``queries`` holds ``query_id`` and ``query``. Any word may match; equal
    scores are in order of ``doc_id``. A small batch that makes more than
    ``prune_pairs`` pairs is answered with bounds on scores; the rows are the same.
    """
    batch, fields = read_batch(queries, index.joined), _checked_fields(index, fields)
    if batch.few is None:
        return per_query(batch, _best_of_many(index, batch, fields, bm25, k), k)
    weights = _local_weights(index, batch, fields, bm25)
    if sum(weights["df"].to_pylist()) > prune_pairs:
        scores = _pruned_scores(index, weights, bm25, k)
    else:
        scores = _rounded(_summed(_local_hits(index, weights), bm25))
    return per_query(batch, _best(scores, k), k)


def match_top_k(index: TextIndex, queries: DataFrame, k: int = 10, fields: Sequence[str] | None = None) -> DataFrame:
    """(query_id, rank, doc_id): as ``keyword_top_k``, without the score."""
    return keyword_top_k(index, queries, k, fields).select("query_id", "rank", "doc_id")


def matching_documents(index: TextIndex, docs: DataFrame, id_column: str, queries: DataFrame,
                       fields: Sequence[str] | None = None) -> DataFrame:
    """The rows of ``docs`` that hold at least one word of at least one query."""
    batch = read_batch(queries, index.joined)
    hits = index.postings().where(F.col("field").isin(_checked_fields(index, fields)))
    if batch.few is not None:
        hits = hits.where(_is_one_of(F.col("term"), sorted({word for text in batch.few for word in text.words})))
    else:
        hits = hits.join(query_terms(batch.texts(), index.joined).select("term").distinct(), "term", "left_semi")
    # Distinct within each bucket: no shuffle.
    return docs.join(hits.select(F.col("doc_id").alias(id_column)).distinct(), id_column, "left_semi")
