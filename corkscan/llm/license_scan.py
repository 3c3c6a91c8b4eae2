"""Licence notices by an exact set-similarity join of text blocks with templates.

A template is a phrase or a notice. A block holds it if it has at least a given
share of the template's distinct words (its containment). All words that templates
have are put in one order, the rarest of the corpus first. A block that has enough
words of a template has one of those that come first in it: of n words, of which m
are needed, one of the first n - m + 1. So blocks are joined with templates on
those prefix words only. Two filters go before the words are compared: a block
needs m words at least (length), and the words that follow the common one must be
enough on both sides (position). No pair with enough words in common fails them.

Blocks are taken at every scale that the templates need: for templates of up to w
words (w a power of two) one begins at every w-th word and is 2 w long, so every
place of w words is inside one. Words that no template has are left out of the
order; they add nothing to what is in common. A phrase needs all of its words, and
is then looked for as written, at the places that begin in the first half of the
block, which makes every place count once.

Texts are cut and filtered in tasks, row by row, and only blocks with a prefix
word are written out, so what is joined are few blocks, dealt by their words. A
long text, or a text that is one long list of notices, becomes many rows.
Templates are a table of bounded size (at most ``MOST_TEMPLATE_WORDS`` words, else
an error), and so are the frequencies of their words.

Null texts are empty: no words, no places, score 0. Rows are told apart by a
number given when they are written out, so identifiers may be null or repeated;
every row of ``docs`` gives one row. An empty table gives none.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corkscan.llm.common import STEP_BYTES, bounded_batches, id_and_text, steps
from corkscan.storage import materialise

# Phrases whose places are counted, and their labels.
PHRASES = [
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
]
# Notices by label, as their licences word them.
NOTICES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
                   "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("gpl", "licensed under the GNU General Public License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
            "as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
            "conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "Licensed under CC BY-NC"),
    ("cc-by-sa", "Licensed under CC BY-SA"),
    ("cc0", "dedicated the work to the public domain under CC0"),
]
CONTAINMENT = 0.9
MOST_TEMPLATE_WORDS = 100_000
LEAST_WIDTH = 4

_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
TEMPLATES_SCHEMA = "label STRING, text STRING, phrase BOOLEAN"
_BLOCK = "struct<width: int, block: int, seq: array<int>, toks: array<int>>"


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, with A-Z lower-cased."""
    return _WORDS.findall((text or "").encode().lower())


def _in_stretches(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text of any length, a few MB of text at a time."""
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + STEP_BYTES)
        end = gap.start() if gap else len(data)
        yield _WORDS.findall(data, at, end)
        at = end


def default_templates(spark: SparkSession) -> DataFrame:
    """(label, text, phrase): PHRASES and NOTICES."""
    rows = [(label, text, True) for text, label in PHRASES] + [(label, text, False) for label, text in NOTICES]
    return spark.createDataFrame(rows, TEMPLATES_SCHEMA)


@dataclass(frozen=True)
class Template:
    """A template in numbers: ``ranks`` are its distinct words from the rarest one on, ``seq`` its words as written."""

    label: str
    phrase: bool
    width: int
    needed: int
    ranks: tuple[int, ...]
    seq: tuple[int, ...]

    @property
    def prefix(self) -> tuple[int, ...]:
        return self.ranks[: len(self.ranks) - self.needed + 1]


def _frequencies(source: DataFrame, known: frozenset[bytes]) -> dict[bytes, int]:
    """How often every word of ``known`` is in the corpus; ``known`` is bounded by the templates."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            found: Counter[bytes] = Counter()
            for text in batch["text"].cast(pa.binary()):
                for words in _in_stretches(text.as_py().lower()):
                    found.update(filter(known.__contains__, words))
            yield pa.RecordBatch.from_pydict({"word": pa.array(list(found), pa.binary()), "n": pa.array(found.values(), pa.int64())})

    rows = source.mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(row.word): row.n for row in rows}


def number_templates(source: DataFrame, templates: DataFrame, containment: float) -> tuple[dict[bytes, int], list[Template]]:
    """The words of all templates by rank in the corpus, from 1 for the rarest, and the templates in ranks."""
    rows = [(row.label, bool(row.phrase), words_of(row.text)) for row in templates.select("label", "text", "phrase").collect()]
    if sum(len(words) for _, _, words in rows) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"templates have more than {MOST_TEMPLATE_WORDS} words")
    vocabulary = frozenset(word for _, _, words in rows for word in words)
    times = _frequencies(source, vocabulary)
    ranks = {word: at + 1 for at, word in enumerate(sorted(vocabulary, key=lambda word: (times.get(word, 0), word)))}
    numbered = set()
    for label, phrase, words in rows:
        if words:
            seq = tuple(ranks[word] for word in words)
            own = tuple(sorted(set(seq)))
            needed = len(own) if phrase else max(1, int(np.ceil(round(containment * len(own), 9))))
            width = max(LEAST_WIDTH, 1 << (len(seq) - 1).bit_length())
            numbered.add(Template(label or "", phrase, width, needed, own, seq))
    return ranks, sorted(numbered, key=lambda t: (t.width, t.label, t.seq))


def _blocks(ranks: dict[bytes, int], templates: Sequence[Template]):
    """Texts to (id, n_words, blocks): the blocks that have a prefix word and enough words for some template."""
    scales = []
    for width in sorted({t.width for t in templates}):
        of_width = [t for t in templates if t.width == width]
        first = np.zeros(len(ranks) + 1, dtype=bool)
        first[[rank for t in of_width for rank in t.prefix]] = True
        scales.append((width, first, min(t.needed for t in of_width)))

    def of_text(numbers: np.ndarray) -> list[dict]:
        found = []
        for width, first, least in scales:
            at = np.flatnonzero(first[numbers]) // width
            for block in np.unique(np.concatenate([at, at[at > 0] - 1])).tolist():
                seq = numbers[block * width : (block + 2) * width]
                toks = np.unique(seq[seq > 0])
                if len(toks) >= least:
                    found.append({"width": width, "block": block, "seq": seq.tolist(), "toks": toks.tolist()})
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block_type = pa.list_(pa.struct([("width", pa.int32()), ("block", pa.int32()), ("seq", pa.list_(pa.int32())),
                                         ("toks", pa.list_(pa.int32()))]))
        for batch in steps(batches):
            counts, blocks = [], []
            for text in batch["text"].cast(pa.binary()):
                parts = [np.fromiter((ranks.get(word, 0) for word in words), dtype=np.int32, count=len(words))
                         for words in _in_stretches(text.as_py().lower())]
                numbers = np.concatenate([np.zeros(0, dtype=np.int32), *parts])
                counts.append(len(numbers))
                blocks.append(of_text(numbers))
            yield pa.RecordBatch.from_pydict({"id": batch["id"], "n_words": pa.array(counts, pa.int64()), "blocks": pa.array(blocks, block_type)})

    return run


def candidate_blocks(docs: DataFrame, ranks: dict[bytes, int], templates: Sequence[Template], id_col: str, text_col: str) -> DataFrame:
    """(row, id, n_words, blocks): every row of ``docs`` with the blocks in which a template may be found."""
    source = bounded_batches(id_and_text(docs, id_col, text_col))
    id_type = source.schema["id"].dataType.simpleString()
    cut = source.mapInArrow(_blocks(ranks, templates), f"id {id_type}, n_words bigint, blocks array<{_BLOCK}>")
    # The number is fixed once it is written.
    return materialise(cut.select(F.monotonically_increasing_id().alias("row"), "*"), "licence-blocks")


def join_blocks(blocks: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """(row, label, phrase, containment, block, width, places): blocks (row, width, block, seq, toks) with the
    templates that they hold enough of; ``places`` are the words at which a phrase begins."""
    spark = blocks.sparkSession
    rows = [(at, t.label, t.phrase, t.width, t.needed, list(t.ranks), list(t.seq), i, rank)
            for at, t in enumerate(templates) for i, rank in enumerate(t.prefix)]
    prefixes = spark.createDataFrame(rows, "template INT, label STRING, phrase BOOLEAN, width INT, needed INT, ranks ARRAY<INT>, "
                                           "words ARRAY<INT>, i INT, rank INT")
    probes = blocks.select("row", "width", "block", "seq", "toks", F.posexplode("toks").alias("j", "rank"))
    # As many rows as templates have prefix words, fewer than MOST_TEMPLATE_WORDS.
    met = probes.join(F.broadcast(prefixes), ["width", "rank"])
    met = met.where((F.size("toks") >= F.col("needed"))
                    & (F.least(F.size("ranks") - F.col("i"), F.size("toks") - F.col("j")) >= F.col("needed")))
    common = F.size(F.array_intersect("toks", "ranks"))
    met = met.withColumn("common", common).where(F.col("common") >= F.col("needed"))
    # A template may meet a block by several words of its prefix.
    met = met.dropDuplicates(["row", "width", "block", "template"])
    starts = F.expr("filter(sequence(0, least(width, size(seq)) - 1), k -> slice(seq, k + 1, size(words)) = words)")
    places = F.when(F.col("phrase"), F.transform(starts, lambda k: k.cast("bigint") + F.col("block").cast("bigint") * F.col("width")))
    met = met.withColumn("places", places)
    return met.where(~F.col("phrase") | (F.size("places") > 0)).select(
        "row", "label", "phrase", (F.col("common") / F.size("ranks")).alias("containment"), "block", "width", "places")


def scan(docs: DataFrame, templates: DataFrame | None = None, containment: float = CONTAINMENT, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """(id, n_words, n_places, first_word, last_word, phrase_labels, labels, score, blocks): one row for each row of ``docs``.

    ``templates`` (label, text, phrase) are those of this module by default.
    ``n_places`` counts all places of phrases, which begin at ``first_word`` to
    ``last_word``. ``phrase_labels`` and ``labels`` are sorted, the latter with
    those of notices too. ``score`` is the largest containment found, 0 if none.
    ``blocks`` lists (label, first word, words, containment) of all blocks found.
    """
    templates = default_templates(docs.sparkSession) if templates is None else templates
    source = bounded_batches(id_and_text(docs, id_col, text_col))
    ranks, numbered = number_templates(source, templates, containment)
    rows = candidate_blocks(docs, ranks, numbered, id_col, text_col)
    spread = rows.where(F.size("blocks") > 0).select("row", F.inline("blocks"))
    met = join_blocks(spread, numbered)
    found = met.groupBy("row").agg(
        F.sum(F.when(F.col("phrase"), F.size("places")).otherwise(0)).cast("bigint").alias("n_places"),
        F.min(F.array_min("places")).alias("first_word"), F.max(F.array_max("places")).alias("last_word"),
        F.array_sort(F.collect_set(F.when(F.col("phrase"), F.col("label")))).alias("phrase_labels"),
        F.array_sort(F.collect_set("label")).alias("labels"), F.max("containment").alias("score"),
        F.array_sort(F.collect_list(F.struct(
            "label", (F.col("block").cast("bigint") * F.col("width")).alias("start"), (2 * F.col("width")).alias("words"),
            "containment"))).alias("blocks"))
    none = F.array().cast("array<string>")
    return rows.drop("blocks").join(found, "row", "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_places", F.lit(0).cast("bigint")).alias("n_places"), "first_word", "last_word",
        F.coalesce("phrase_labels", none).alias("phrase_labels"), F.coalesce("labels", none).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("blocks", F.array().cast(found.schema["blocks"].dataType)).alias("blocks"))
