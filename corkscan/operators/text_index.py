"""Full-text tables: postings, document lengths, document frequencies, sizes.

The postings are bucketed by document; each file is sorted by word. Bucketing by document
keeps a word that sits in a third of all documents spread over every bucket, and
lets search add up the words of a document without a shuffle. Sorting by word
lets the scan skip all Parquet pages but those of the words asked for.

Postings are never rewritten. A document that is changed or deleted leaves a
tombstone: its identifier and the batch from which on older postings of it are gone.
Tombstones are bucketed like the postings, so a read drops what is gone inside each
bucket, without a shuffle; an index without tombstones is read as it lies. Frequencies
and sizes are lowered by what went, and ``compact_text_index`` writes what is left.
"""

from __future__ import annotations

import dataclasses
import functools
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corkscan.functions.text import quoted, tokens
from corkscan.sources.versions import read_if_there
from corkscan.storage import by_rows, materialise

# Text in a bucket of postings, unless told otherwise: a task sorts the postings of a bucket in memory.
BUCKET_BYTES = 32 << 20
# Files that a task writes at a time; rows dealt by document are one bucket in each task.
OPEN_FILES = 16

POSTINGS_SCHEMA = "field STRING, term STRING, doc_id BIGINT, tf BIGINT, doc_len BIGINT, batch INT"
FREQ_SCHEMA = "field STRING, term STRING, df BIGINT, top_tf BIGINT, least_len BIGINT"
STATS_SCHEMA = ("field STRING, n BIGINT, total_len BIGINT, avgdl DOUBLE, buckets INT, joined BOOLEAN, folder STRING, "
                "tombstones BIGINT")
TOMBSTONES_SCHEMA = "doc_id BIGINT, gone INT"
# So few identifiers are written into the filter of the scan, which then reads their buckets only.
FILTER_IDS = 200


def analyze_fields(docs: DataFrame, id_column: str, fields: Sequence[str], joined: bool = False) -> DataFrame:
    """(doc_id, field, words) of each listed text column."""
    texts = F.array(
        *[F.struct(F.lit(name).alias("field"), tokens(F.col(name), joined).alias("words")) for name in fields]
    )
    return docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.inline(texts))


def term_counts(docs: DataFrame, id_column: str, fields: Sequence[str], joined: bool = False) -> DataFrame:
    """(doc_id, field, term, tf, doc_len): how often each word is in each field.

    Grouped on the document first: input that is already spread by document is
    counted where it lies.
    """
    return (
        analyze_fields(docs, id_column, fields, joined)
        .select("doc_id", "field", F.size("words").cast("bigint").alias("doc_len"), "words")
        .select("doc_id", "field", "doc_len", F.explode("words").alias("term"))
        .groupBy("doc_id", "field", "term", "doc_len")
        .agg(F.count("*").alias("tf"))
    )


def spread_term_counts(docs: DataFrame, id_column: str, fields: Sequence[str], joined: bool = False) -> DataFrame:
    """As ``term_counts``, but shuffles the words of documents alone whose identifiers repeat.

    Reads ``docs`` once more, to find these; their number decides how they are kept apart.
    """
    key = F.col(id_column).cast("bigint")
    often = docs.groupBy(key.alias("_often")).agg(F.count("*").alias("_n")).where("_n > 1").select("_often")
    often = materialise(often, "repeated-ids")
    columns = ["doc_id", "field", "term", "tf", "doc_len"]
    if often.isEmpty():
        return row_postings(docs, id_column, fields, joined).select(columns)
    among = lambda how: docs.join(by_rows(often), key.eqNullSafe(F.col("_often")), how)
    return row_postings(among("left_anti"), id_column, fields, joined).select(columns).unionByName(
        term_counts(among("left_semi"), id_column, fields, joined).select(columns))


def postings(docs: DataFrame, id_column: str, fields: Sequence[str], joined: bool = False) -> DataFrame:
    counts = term_counts(docs, id_column, fields, joined)
    return counts.select("field", "term", "doc_id", "tf", "doc_len")


def row_postings(docs: DataFrame, id_column: str, fields: Sequence[str], joined: bool = False) -> DataFrame:
    """As ``postings``, of documents whose identifiers do not repeat: words are counted row by row.

    The words of a row are put in order, and a word's count is the length of its run.
    A task holds the words of one row, not a table of all it has seen.
    """
    rows = analyze_fields(docs, id_column, fields, joined).select("doc_id", "field", _once(F.sort_array("words"), "words"))
    rows = rows.withColumn("n", F.size("words")).where("n > 0")
    begins = lambda i: ~F.get("words", i).eqNullSafe(F.get("words", i - 1))
    rows = rows.select("*", _once(F.filter(F.sequence(F.lit(0), F.col("n") - 1), begins), "first"))
    after = F.concat(F.slice("first", F.lit(2), F.size("first")), F.array("n"))
    runs = rows.select("doc_id", "field", "words", F.col("n").cast("bigint").alias("doc_len"), F.inline(F.arrays_zip("first", after.alias("after"))))
    tf = (F.col("after") - F.col("first")).cast("bigint").alias("tf")
    return runs.select("field", F.get("words", F.col("first")).alias("term"), "doc_id", tf, "doc_len")


def _once(column: Column, name: str) -> Column:
    """A column that is worked out once for each row, however often it is used."""
    return F.inline(F.array(F.struct(column.alias(name))))


def doc_lengths(docs: DataFrame, id_column: str, fields: Sequence[str], joined: bool = False) -> DataFrame:
    """(field, doc_id, doc_len) of the documents that have words: no shuffle."""
    return (
        analyze_fields(docs, id_column, fields, joined)
        .select("field", "doc_id", F.size("words").cast("bigint").alias("doc_len"))
        .where("doc_len > 0")
    )


def term_doc_freq(posting_rows: DataFrame) -> DataFrame:
    """(field, term, df, top_tf, least_len): number of documents that hold the word,
    its largest count in one, and the length of the shortest one.

    Counted on the map side first, so a word found everywhere is one row per
    task by the time it is shuffled.
    """
    return posting_rows.groupBy("field", "term").agg(
        F.count("*").alias("df"), F.max("tf").alias("top_tf"), F.min("doc_len").alias("least_len"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """(field, n, total_len, avgdl): one row per field."""
    return (
        lengths.groupBy("field")
        .agg(F.count("*").alias("n"), F.sum("doc_len").alias("total_len"))
        .withColumn("avgdl", F.try_divide("total_len", "n"))
    )


@dataclasses.dataclass(frozen=True)
class TextIndex:
    """A published full-text index: its tables, version and one-row figures.

    The tables are opened once, so that a search neither lists files nor infers
    schemas again.
    """

    spark: SparkSession
    root: str
    folder: str
    table: str
    buckets: int
    version: int
    joined: bool
    tombstones: int
    n: Mapping[str, int]
    avgdl: Mapping[str, float]
    _postings: DataFrame
    _term_doc_freq: DataFrame

    def postings(self) -> DataFrame:
        """Rows of every published batch, bucketed by ``doc_id``."""
        return self._postings

    def term_doc_freq(self) -> DataFrame:
        """(field, term, df)."""
        return self._term_doc_freq.select("field", "term", "df")

    def word_figures(self) -> DataFrame:
        """(field, term, df, top_tf, least_len); documents that went may still count in the last two."""
        return self._term_doc_freq

    def corpus_stats(self) -> DataFrame:
        return self.spark.read.schema(STATS_SCHEMA).parquet(f"{self.root}/corpus_stats/version={self.version}")

    def ids(self) -> DataFrame:
        """(doc_id, batch) of every document of this version, without words or with."""
        written = self.spark.read.schema("doc_id BIGINT, batch INT").parquet(f"{self.root}/{self.folder}-ids")
        return self._alive(written.where(F.col("batch") <= self.version))

    def _alive(self, rows: DataFrame) -> DataFrame:
        """``rows`` (doc_id, batch, ...) without those that a later batch changed or deleted."""
        return rows if self.tombstones == 0 else _without_gone(rows, self.spark.table(_gone(self.table)), self.version)

    def close(self) -> None:
        """Take the tables out of the session's catalog; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        self.spark.sql(f"DROP TABLE IF EXISTS {_gone(self.table)}")


def _new_table_name() -> str:
    return f"corkscan_postings_{uuid.uuid4().hex[:12]}"


def _gone(table: str) -> str:
    """The table of tombstones that goes with a table of postings."""
    return f"{table}_gone"


def _without_gone(rows: DataFrame, tombstones: DataFrame, version: int) -> DataFrame:
    """``rows`` (doc_id, batch, ...) that no tombstone up to ``version`` takes away.

    Both sides are bucketed alike; the tombstones of a bucket are the smaller one,
    with a row for each change of one of its documents.
    """
    known = tombstones.where(F.col("gone") <= version).hint("shuffle_hash")
    same = (rows["doc_id"] == known["doc_id"]) & (rows["batch"] < known["gone"])
    return rows.join(known, same, "left_anti")


def _publish(spark: SparkSession, root: str, folder: str, table: str, buckets: int, version: int, joined: bool,
             freq: DataFrame, stats: DataFrame, tombstones: int = 0) -> TextIndex:
    freq.orderBy("field", "term").write.parquet(f"{root}/term_doc_freq/version={version}")
    # Written last: its version is the one that readers may use.
    (
        stats.select("field", "n", "total_len", "avgdl", F.lit(buckets).alias("buckets"), F.lit(joined).alias("joined"),
                     F.lit(folder).alias("folder"), F.lit(tombstones).cast("bigint").alias("tombstones"))
        .coalesce(1)
        .write.parquet(f"{root}/corpus_stats/version={version}")
    )
    return open_text_index(spark, root, version, table)


def _write_postings(rows: DataFrame, path: str, table: str, buckets: int, batch: int, mode: str) -> None:
    _write_bucketed(rows.withColumn("batch", F.lit(batch)), path, table, buckets, ["term", "field"], mode)


def _write_bucketed(rows: DataFrame, path: str, table: str, buckets: int, order: Sequence[str], mode: str) -> None:
    """Write rows in buckets by document; rows of one bucket that lie in one task make one file.

    Rows are sorted before they are written, by ``order`` alone: a sort of the writer's own
    would compare bucket numbers first, which are the same for all rows of a task.
    """
    conf, name = rows.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name)
    conf.set(name, str(OPEN_FILES))
    try:
        (
            rows.sortWithinPartitions(*order)
            .write.mode(mode)
            .bucketBy(buckets, "doc_id")
            .option("path", path)
            .format("parquet")
            .saveAsTable(table)
        )
    finally:
        conf.set(name, before)


def build_text_index(docs: DataFrame, root: str, id_column: str, fields: Sequence[str], buckets: int | None = None,
                     joined: bool = False, replace: bool = False) -> TextIndex:
    """Write the index of ``docs`` under ``root``.

    An index that is there already is an error, unless ``replace`` is set: then
    the new one becomes its next version, with postings of its own. Texts are
    shuffled once, by document, into the buckets; words are counted and written
    there without another shuffle. There are so many ``buckets`` that each holds
    about ``BUCKET_BYTES`` of text, and not fewer than the session's shuffle width,
    if none are given. Identifiers that repeat are an error: a document is one row.
    """
    spark = docs.sparkSession
    last = _newest(spark, root)
    if last is not None and not replace:
        raise FileExistsError(f"there is a text index under {root}; replace it or choose another folder")
    version = 0 if last is None else last + 1
    _require_none(repeated_ids(docs, id_column), "identifiers repeat")
    buckets = buckets or _buckets_for(docs, fields)
    folder, table = f"postings-{version}", _new_table_name()
    _write_ids(docs, id_column, f"{root}/{folder}-ids", version)
    rows = _spread_postings(docs, id_column, fields, buckets, joined)
    _write_postings(rows, f"{root}/{folder}", table, buckets, version, "errorifexists")
    written = spark.table(table)
    return _publish(
        spark, root, folder, table, buckets, version, joined, term_doc_freq(written), _stats_of(written, fields))


def repeated_ids(docs: DataFrame, id_column: str) -> DataFrame:
    """(doc_id, n): identifiers of several rows; only identifiers are shuffled."""
    ids = docs.groupBy(F.col(id_column).cast("bigint").alias("doc_id")).agg(F.count("*").alias("n"))
    return ids.where("n > 1")


def known_ids(index: "TextIndex", docs: DataFrame, id_column: str) -> DataFrame:
    """(doc_id): identifiers of ``docs`` that the index holds already; not those that were deleted."""
    ids = docs.select(F.col(id_column).cast("bigint").alias("doc_id")).distinct()
    return ids.join(index.ids().select("doc_id"), "doc_id", "left_semi")


def _require_none(ids: DataFrame, what: str) -> None:
    first = ids.limit(1).collect()
    if first:
        raise ValueError(f"{what}, the first is {first[0].doc_id}; nothing was written")


def _write_ids(docs: DataFrame, id_column: str, path: str, batch: int) -> None:
    ids = docs.select(F.col(id_column).cast("bigint").alias("doc_id"))
    ids.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def _buckets_for(docs: DataFrame, fields: Sequence[str]) -> int:
    size = sum((F.coalesce(F.octet_length(F.col(name)), F.lit(0)).cast("bigint") for name in fields), F.lit(0).cast("bigint"))
    total = docs.agg(F.sum(size)).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))


def _spread_postings(docs: DataFrame, id_column: str, fields: Sequence[str], buckets: int, joined: bool) -> DataFrame:
    """Postings of documents whose identifiers do not repeat, dealt by document."""
    texts = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), *fields)
    return row_postings(texts.repartition(buckets, "doc_id"), "doc_id", fields, joined)


def _add_stats(*parts: DataFrame) -> DataFrame:
    sums = functools.reduce(DataFrame.unionByName, [p.select("field", "n", "total_len") for p in parts])
    return (
        sums.groupBy("field")
        .agg(F.sum("n").alias("n"), F.sum("total_len").alias("total_len"))
        .withColumn("avgdl", F.try_divide("total_len", "n"))
    )


def _stats_of(posting_rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Sizes from the postings, with a row of zeros for a field without words."""
    lengths = posting_rows.groupBy("doc_id", "field").agg(F.max("doc_len").alias("doc_len"))
    none = posting_rows.sparkSession.createDataFrame([(f, 0, 0) for f in fields], "field STRING, n BIGINT, total_len BIGINT")
    return _add_stats(corpus_stats(lengths), none)


def _require_unbroken(index: TextIndex, batch: int) -> None:
    """An error if another job has written, or begun to write, the batch after this version."""
    rows = index.spark.table(index.table).where(F.col("batch") >= batch)
    gone = read_if_there(index.spark, f"{index.root}/{index.folder}-gone", TOMBSTONES_SCHEMA)
    if not rows.isEmpty() or (gone is not None and not gone.where(F.col("gone") >= batch).isEmpty()):
        raise ValueError(f"{index.root} holds a batch {batch}: open the newest version, or replace the index "
                         "if an append was broken off")


def _next_version(index: TextIndex, batch: int, docs: DataFrame | None, id_column: str, old: DataFrame | None) -> TextIndex:
    """Publish ``batch``: without the documents named in ``old`` (doc_id), with those of ``docs``.

    Only the postings of the batch and tombstones are written. Frequencies and sizes
    are those of the version before, less what goes, and more what comes.
    """
    spark, fields = index.spark, sorted(index.n)
    freqs, sizes, tombstones = [index.word_figures()], [index.corpus_stats()], index.tombstones
    if old is not None:
        # Read before the tombstones are there.
        gone = _postings_of(index, old)
        minus = materialise(term_doc_freq(gone).withColumn("df", -F.col("df")), "frequencies-gone")
        less = materialise(_stats_of(gone, fields).select(
            "field", (-F.col("n")).alias("n"), (-F.col("total_len")).alias("total_len")), "sizes-gone")
        freqs.append(minus)
        sizes.append(less)
        named = materialise(old.withColumn("gone", F.lit(batch)), "tombstones")
        tombstones += named.count()
        mode = "append" if spark.catalog.tableExists(_gone(index.table)) else "errorifexists"
        _write_bucketed(named, f"{index.root}/{index.folder}-gone", _gone(index.table), index.buckets, ["doc_id"], mode)
    if docs is not None:
        rows = _spread_postings(docs, id_column, fields, index.buckets, index.joined)
        _write_ids(docs, id_column, f"{index.root}/{index.folder}-ids", batch)
        _write_postings(rows, f"{index.root}/{index.folder}", index.table, index.buckets, batch, "append")
        new = spark.table(index.table).where(F.col("batch") == batch)
        freqs.append(term_doc_freq(new))
        sizes.append(_stats_of(new, fields))
    freq = functools.reduce(DataFrame.unionByName, freqs).groupBy("field", "term").agg(
        F.sum("df").alias("df"), F.max("top_tf").alias("top_tf"), F.min("least_len").alias("least_len"))
    return _publish(spark, index.root, index.folder, index.table, index.buckets, batch, index.joined,
                    freq.where("df > 0"), _add_stats(*sizes), tombstones)


def _postings_of(index: TextIndex, ids: DataFrame) -> DataFrame:
    """The postings of some documents, found inside their buckets; a few are looked for in their buckets only."""
    few = ids.limit(FILTER_IDS + 1).collect()
    rows = index.postings()
    if len(few) <= FILTER_IDS:
        return rows.where(F.col("doc_id").isin([r.doc_id for r in few]))
    return rows.join(ids.repartition(index.buckets, "doc_id").hint("shuffle_hash"), "doc_id", "left_semi")


def append_text_index(index: TextIndex, docs: DataFrame, id_column: str) -> TextIndex:
    """Add documents that the index does not hold; old postings stay put.

    Frequencies and sizes of the new rows are added to the published ones, so
    that no posting is counted again. An identifier that repeats, or that the
    index holds already, is an error before anything is written.
    """
    _require_none(repeated_ids(docs, id_column), "identifiers repeat")
    _require_none(known_ids(index, docs, id_column), "the index holds documents already")
    _require_unbroken(index, index.version + 1)
    return _next_version(index, index.version + 1, docs, id_column, None)


def upsert_text_index(index: TextIndex, docs: DataFrame, id_column: str) -> TextIndex:
    """Add documents; those that the index holds already are replaced.

    The next version answers as an index built of the old documents with those of
    ``docs`` put in by identifier; older versions answer as before. A document
    whose fields are all empty is one without words, not a deleted one. Identifiers
    that repeat in ``docs``, or are null, are an error before anything is written.
    """
    _require_none(repeated_ids(docs, id_column), "identifiers repeat")
    _require_none(docs.select(F.col(id_column).cast("bigint").alias("doc_id")).where("doc_id IS NULL"), "identifiers are null")
    _require_unbroken(index, index.version + 1)
    old = materialise(known_ids(index, docs, id_column), "known-ids")
    return _next_version(index, index.version + 1, docs, id_column, None if old.isEmpty() else old)


def delete_from_text_index(index: TextIndex, ids: DataFrame, id_column: str) -> TextIndex:
    """Take documents out; identifiers that the index does not hold are passed over, and so are null and repeated ones.

    If it holds none of them, ``index`` is returned as it is.
    """
    _require_unbroken(index, index.version + 1)
    old = materialise(known_ids(index, ids, id_column), "known-ids")
    return index if old.isEmpty() else _next_version(index, index.version + 1, None, id_column, old)


def compact_text_index(index: TextIndex) -> TextIndex:
    """Write what is left of the postings anew, bucket by bucket, as a version without tombstones."""
    spark, version = index.spark, index.version + 1
    _require_unbroken(index, version)
    folder, table = f"postings-{version}", _new_table_name()
    _write_ids(index.ids(), "doc_id", f"{index.root}/{folder}-ids", version)
    _write_postings(index.postings(), f"{index.root}/{folder}", table, index.buckets, version, "errorifexists")
    return _publish(spark, index.root, folder, table, index.buckets, version, index.joined, term_doc_freq(spark.table(table)),
                    index.corpus_stats())


def _newest(spark: SparkSession, root: str) -> int | None:
    stats = read_if_there(spark, f"{root}/corpus_stats", f"{STATS_SCHEMA}, version INT")
    return None if stats is None else stats.agg(F.max("version")).first()[0]


def open_text_index(spark: SparkSession, root: str, version: int | None = None, table: str | None = None) -> TextIndex:
    """The index under ``root``, at its newest version unless one is named.

    The files carry their bucket numbers, so a session that did not write them
    only has to declare the table again.
    """
    version = _newest(spark, root) if version is None else version
    stats = None if version is None else read_if_there(spark, f"{root}/corpus_stats/version={version}", STATS_SCHEMA)
    if stats is None:
        raise FileNotFoundError(f"no text index under {root}")
    rows = stats.collect()  # one row per field
    buckets, folder, tombstones = rows[0].buckets, rows[0].folder, rows[0].tombstones or 0
    table = _new_table_name() if table is None else table
    _declare(spark, table, f"{root}/{folder}", POSTINGS_SCHEMA, buckets)
    if tombstones:
        _declare(spark, _gone(table), f"{root}/{folder}-gone", TOMBSTONES_SCHEMA, buckets)
    found = spark.table(table).where(F.col("batch") <= version)
    if tombstones:
        found = _without_gone(found, spark.table(_gone(table)), version)
    return TextIndex(
        spark, root, folder, table, buckets, version, rows[0].joined, tombstones,
        {r.field: r.n for r in rows}, {r.field: r.avgdl or 0.0 for r in rows}, found.drop("batch"),
        spark.read.schema(FREQ_SCHEMA).parquet(f"{root}/term_doc_freq/version={version}"),
    )


def _declare(spark: SparkSession, table: str, path: str, schema: str, buckets: int) -> None:
    """Have the table in the session's catalog, with files as they are now."""
    if spark.catalog.tableExists(table):
        spark.catalog.refreshTable(table)
        return
    spark.sql(f"CREATE TABLE {table} ({schema}) USING parquet CLUSTERED BY (doc_id) INTO {buckets} BUCKETS "
              f"LOCATION {quoted(path)}")
