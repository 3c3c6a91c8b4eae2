"""Benchmark decontamination by templates, with DataFrame functions only.

Numbers, names and units become typed placeholders, so that a question with other
numbers or names in it is the same template. Windows of five tokens of every
document are joined by hash with those of the benchmark. Where the windows of one
stretch of a document cover at least 0.8 of the windows of an item, each window of
the item is put to one place of the stretch, so that sentences of one pattern do not
meet each other, and the values that stand in its slots are compared: the same value
of the item must have become the same value everywhere in that stretch, as it does
when a question is given new parameters. Each shift of a stretch is tried; one that
agrees is enough.

A name is a run of capitalised words that do not begin a sentence; a number is a run
of digits with its separators and decimals; a unit is a known word right after a
number. Every text is also read in lower case, where names are words like others, so
that a copy in other cases is found; a document holds an item if either reading does. Windows of the benchmark with
fewer than three plain words say too little and are left out. Items with so few windows
that one lost at an edge is too many, or with none, are also looked for as a whole, all
tokens as they are written, however short they are; those are reported as one window.
Scripts without spaces between words are read character by character. Null and empty texts are in no result; rows with the same
identifier count as one document.

Both readings cost much more than a look for pairs of words. So texts are first
searched for clues: pairs of words of so many windows of each item that a text without
any of them cannot hold enough of the rest. Only texts with a clue are read in full;
the result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corkscan.llm.bag_minhash import keep_ids
from corkscan.llm.common import id_and_text
from corkscan.storage import by_rows, materialise

WINDOW = 5
COVERAGE = 0.8
PLAIN_WORDS = 3
# So many different benchmark windows may be broadcast; more are joined by shuffle.
FEW_WINDOWS = 500_000

# Units of measure and of money, as they are written after a number.
UNITS = [
    "mm", "cm", "m", "km", "in", "inch", "inches", "ft", "foot", "feet", "yd", "yard", "yards", "mile", "miles",
    "mg", "g", "kg", "gram", "grams", "lb", "lbs", "pound", "pounds", "oz", "ounce", "ounces", "t", "ton", "tons",
    "ml", "cl", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "cup", "cups",
    "ms", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hr", "hour", "hours", "day", "days",
    "week", "weeks", "month", "months", "year", "years", "kmh", "mph", "hz", "khz", "mhz", "ghz",
    "v", "w", "kw", "kwh", "j", "kj", "cal", "kcal", "n", "pa", "bar", "c", "f", "k",
    "usd", "eur", "gbp", "dollar", "dollars", "cent", "cents", "euro", "euros", "percent", "pct",
    "b", "kb", "mb", "gb", "tb", "byte", "bytes", "bit", "bits",
]
NAME, NUMBER, UNIT = "\x01", "\x02", "\x03"
# How a text is read: with its names, or in lower case; of both, the first that finds an item is reported.
NAMED, LOWERED = 0, 1
# An item that was found as a whole.
WHOLE = 2
# Scripts that put no spaces between words.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
# What clues are made of: no part of a word or number of either reading is in two of these.
CLUE_TOKENS = rf"[{UNSPACED}]|[\p{{L}}&&[^{UNSPACED}]]+|\p{{N}}+"


def values(text: Column) -> Column:
    """The tokens of a text as they are written, in lower case; the words of names begin with a mark."""
    marked = F.regexp_replace(text, r"(^|[^\p{L}])(\p{Lu}\p{Ll}+)", f"$1{NAME}$2")
    marked = F.regexp_replace(marked, rf"(^|[.!?:\n][^\p{{L}}\p{{N}}{NAME}]*){NAME}", "$1")
    marked = F.regexp_replace(marked, rf"[ \t\u00a0-]+{NAME}", f" {NAME}")  # the words of a name are one space apart
    name, number = rf"{NAME}\p{{L}}+(?: {NAME}\p{{L}}+)*", r"\p{N}+(?:[.,'’\u00a0\u202f]\p{N}+)*"
    return F.regexp_extract_all(F.lower(marked), F.lit(rf"{name}|{number}|[{UNSPACED}]|[\p{{L}}&&[^{UNSPACED}]]+"), 0)


def template(tokens: Column) -> Column:
    """The same tokens with placeholders for names, numbers and units."""
    number = lambda token: F.coalesce(token.rlike(r"^\p{N}"), F.lit(False))

    def slot(token: Column, at: Column) -> Column:
        unit = token.isin(UNITS) & number(F.get(tokens, at - 1))
        return (F.when(token.startswith(NAME), NAME).when(number(token), NUMBER)
                .when(unit, UNIT).otherwise(token))

    return F.transform(tokens, slot)


def _windows(hashes: str, size: int) -> Column:
    """A hash for each window of an array of hashes."""
    inside = lambda at: F.xxhash64(*(F.get(hashes, at + n) for n in range(size)))
    every = F.transform(F.sequence(F.lit(0), F.size(hashes) - size), inside)
    return F.when(F.size(hashes) >= size, every).otherwise(F.array().cast("array<bigint>"))


def _tokens(texts: DataFrame) -> DataFrame:
    """(id, reading, values, tokens, kinds): both readings of every text; ``kinds`` shows names also where ``tokens`` does not."""
    named = texts.select("id", values(F.col("text")).alias("named"))
    words = F.flatten(F.transform("named", lambda token: F.split(token, " ")))
    readings = F.array(*(F.struct(F.lit(reading).alias("reading"), marked.alias("marked"))
                         for reading, marked in ((NAMED, F.col("named")), (LOWERED, words))))
    split = named.select("id", F.explode(readings).alias("read")).select("id", "read.*")
    lowered = F.transform("marked", lambda token: F.replace(token, F.lit(NAME), F.lit("")))
    split = split.withColumn("values", F.when(F.col("reading") == LOWERED, lowered).otherwise(F.col("marked")))
    return split.select("id", "reading", "values", template(F.col("values")).alias("tokens"), template(F.col("marked")).alias("kinds"))


def _exploded(texts: DataFrame, size: int) -> DataFrame:
    """(id, reading, at, window): every window of every text."""
    hashed = _tokens(texts).select("id", "reading", F.transform("tokens", lambda token: F.xxhash64(token)).alias("hashes"))
    return hashed.select("id", "reading", F.posexplode(_windows("hashes", size)).alias("at", "window"))


def _wholes(texts: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """(id, item, evidence): items (item, values) all of whose values stand in a row in a text.

    The first values of an item are looked for everywhere, the rest only where those stand.
    """
    hashed = F.transform("values", lambda value: F.xxhash64(value))
    runs = items.where(F.size("values") > 0).select("item", hashed.alias("hashes")).select(
        "item", F.size("hashes").alias("length"), F.least(F.size("hashes"), F.lit(size)).alias("k"), F.xxhash64("hashes").alias("run"), "hashes")
    first = F.slice("hashes", F.lit(1), F.col("k"))
    runs = materialise(runs.select("item", "length", "k", "run", F.xxhash64(first).alias("head")), "whole-items")
    sizes = [row["k"] for row in runs.select("k").distinct().collect()]
    if not sizes:
        none = ", ".join(f"{name} {frame.schema[name].dataType.simpleString()}" for frame, name in ((texts, "id"), (items, "item")))
        return texts.sparkSession.createDataFrame([], f"{none}, evidence boolean")
    heads = runs.select("k", "head").distinct()
    if heads.count() <= FEW_WINDOWS:
        heads = F.broadcast(heads)
    read = lambda rows: _tokens(rows).where(F.col("reading") == LOWERED).select("id", hashed.alias("hashes"))

    def starts(k: int) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.size("hashes") - k), lambda at: F.struct(
            F.lit(k).alias("k"), at.alias("at"), F.xxhash64(F.slice("hashes", at + 1, F.lit(k))).alias("head")))
        return F.when(F.size("hashes") >= k, every).otherwise(F.array().cast("array<struct<k:int,at:int,head:bigint>>"))

    seen = read(texts).select("id", F.explode(F.concat(*map(starts, sizes))).alias("start")).select("id", "start.*")
    seen = seen.join(heads, ["k", "head"], "left_semi").join(runs.select("k", "head", "length").distinct(), ["k", "head"])
    places = materialise(seen.groupBy("id").agg(F.collect_set(F.struct("at", "length")).alias("places")), "whole-places")
    near = read(keep_ids(texts, "id", places.select(F.col("id").alias("wanted"))).dropDuplicates(["id", "text"]))
    run = lambda place: F.struct(
        place["length"].alias("length"), F.xxhash64(F.slice("hashes", place["at"] + 1, place["length"])).alias("run"))
    found = near.join(by_rows(places), "id").select("id", F.size("hashes").alias("said"), F.explode(F.array_distinct(F.transform("places", run))).alias("run"))
    found = found.select("id", "said", "run.*").join(runs.select("item", "length", "run"), ["length", "run"])
    enough = (F.col("length") >= size) | (F.col("length") == F.col("said"))
    return found.groupBy("id", "item").agg(F.bool_or(enough).alias("evidence"))


def _clue(tokens: str) -> Column:
    """(pair, length, key): what a text must hold in order to hold all of ``tokens``: the longest two plain
    words in a row, else the longest token, of numbers and names their first part; null if there are no tokens."""
    plain = lambda token: ~token.isin(NAME, NUMBER, UNIT) & (~token.rlike(f"[{UNSPACED}]") | (F.length(token) == 1))
    word = lambda token: plain(token) & token.rlike(r"^\p{L}")
    rest = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0)))
    pairs = F.zip_with(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))), rest, lambda one, two: F.when(
        word(one) & word(two), F.struct(F.lit(True).alias("pair"), (F.length(one) + F.length(two)).alias("length"), F.xxhash64(one, two).alias("key"))))
    first = lambda token: F.regexp_extract(token, CLUE_TOKENS, 0)
    singles = F.transform(F.filter(tokens, lambda token: ~token.isin(NAME, NUMBER, UNIT)), lambda token: F.struct(
        F.lit(False).alias("pair"), F.length(first(token)).alias("length"), F.xxhash64(first(token)).alias("key")))
    return F.coalesce(F.array_max(pairs), F.array_max(singles))


def _may_leak(texts: DataFrame, starts: DataFrame, few: DataFrame, size: int, coverage: float) -> DataFrame:
    """``texts`` without those that cannot hold an item.

    Of the windows of an item so many are taken, those with the longest clues first, that
    a text without any of them has too few of the rest; of an item that is looked for as
    a whole, one clue. A text needs one clue at least to be read in full.
    """
    windows = starts.select("item", "reading", F.size("starts").alias("n"), F.explode("starts").alias("at"), "tokens").select(
        "item", "reading", "n", "at", F.slice("tokens", F.col("at") + 1, F.lit(size)).alias("window"))
    clues = windows.select("item", "reading", "n", "at", _clue("window").alias("clue"))
    order = Window.partitionBy("item", "reading").orderBy(F.desc("clue.pair"), F.desc("clue.length"), "at")
    needed = F.col("n") - F.ceil(coverage * F.col("n")) + 1
    chosen = clues.withColumn("number", F.row_number().over(order)).where(F.col("number") <= needed).select("clue.*")
    wholes = few.where(F.size("values") > 0).select(_clue("values").alias("clue")).select("clue.*")
    clues = materialise(chosen.unionByName(wholes).select("pair", "key").distinct(), "clues")
    keys = clues.select("key").distinct()
    if keys.count() <= FEW_WINDOWS:
        keys = F.broadcast(keys)
    one = F.regexp_extract_all(F.lower("text"), F.lit(CLUE_TOKENS), 0)
    cut = texts.select("id", one.alias("one")).select("id", "one", F.slice("one", F.lit(2), F.greatest(F.size("one") - 1, F.lit(0))).alias("two"))
    both = cut.select("id", F.explode(F.arrays_zip("one", "two")).alias("both"))
    pair, single = F.xxhash64("both.one", "both.two"), F.xxhash64("both.one")
    if clues.where(~F.col("pair")).isEmpty():
        seen = both.select("id", pair.alias("key"))
    else:
        seen = both.select("id", F.explode(F.array(pair, single)).alias("key"))
    ids = seen.join(keys, "key", "left_semi").select(F.col("id").alias("wanted")).distinct()
    return keep_ids(texts, "id", materialise(ids, "clues-seen")).select("id", "text")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW,
               coverage: float = COVERAGE) -> DataFrame:
    """(id, item, windows, item_windows, slots, same_values, evidence): the items that each document holds.

    ``windows`` of the ``item_windows`` of an item were found in one stretch, with
    ``slots`` values compared, of which all were the item's own if ``same_values``.
    An item of fewer than ``size`` tokens, such as one word, is in many documents by
    chance: ``evidence`` is false for it, unless it is all that the document says.
    Documents without a leak are not in the result.
    """
    texts = id_and_text(docs, id_col, text_col).where("id IS NOT NULL")
    asked = id_and_text(benchmark, item_col, item_text_col).where("id IS NOT NULL").dropDuplicates(["id"])
    items = materialise(_tokens(asked).withColumnRenamed("id", "item"), "benchmark")

    plain = lambda at: F.size(F.filter(F.slice("tokens", at + 1, size), lambda t: ~t.isin(NAME, NUMBER, UNIT)))
    told = F.filter(F.sequence(F.lit(0), F.greatest(F.size("tokens") - size, F.lit(0))), lambda at: plain(at) >= PLAIN_WORDS)
    starts = items.where(F.size("tokens") >= size).select("item", "reading", F.size("tokens").alias("length"), "tokens", told.alias("starts"))
    hashed = starts.select("item", "reading", "length", F.size("starts").alias("item_windows"), "starts",
                           F.transform("tokens", lambda token: F.xxhash64(token)).alias("hashes"))
    known = hashed.select("item", "reading", "length", "item_windows", F.explode("starts").alias("item_at"), "hashes")
    known = materialise(known.select(
        "item", "reading", "length", "item_windows", "item_at",
        F.xxhash64(*(F.get("hashes", F.col("item_at") + n) for n in range(size))).alias("window")), "benchmark-windows")
    places_of = by_rows(known)

    enough = known.where((F.col("reading") == LOWERED) & (F.col("item_windows") - 1 >= coverage * F.col("item_windows")))
    few = items.where(F.col("reading") == LOWERED).join(enough.select("item").distinct(), "item", "left_anti").select("item", "values")
    texts = _may_leak(texts, starts, few, size, coverage)
    wholes = _wholes(texts, few, size).select(
        "id", "item", F.lit(WHOLE).alias("reading"), F.lit(1).cast("bigint").alias("windows"), F.lit(1).alias("item_windows"),
        F.lit(0).cast("bigint").alias("slots"), F.lit(True).alias("same_values"), "evidence")

    different = known.select("reading", "window").distinct()
    if different.count() <= FEW_WINDOWS:
        different = F.broadcast(different)
    seen = _exploded(texts, size).join(different, ["reading", "window"], "left_semi")
    found = seen.join(places_of, ["reading", "window"])
    # A stretch: places of an item in a document that differ by less than half of its
    # length, cut at two phases so that none is halved in both.
    width = F.greatest(F.floor(F.col("length") / 2), F.lit(1))
    shift = F.col("at") - F.col("item_at")
    found = found.select("id", "item", "reading", "item_windows", "at", "item_at", "length", width.alias("width"), shift.alias("shift"))
    found = found.withColumn("phase", F.explode(F.array(F.lit(0), F.lit(1))))
    stretch = F.floor((F.col("shift") + F.col("phase") * F.floor(F.col("width") / 2)) / F.col("width"))
    found = found.withColumn("stretch", stretch)
    place = ["id", "item", "reading", "phase", "stretch"]
    counted = found.groupBy(*place, "item_windows").agg(F.count_distinct("item_at").alias("windows"))
    covered = materialise(counted.where(F.col("windows") >= coverage * F.col("item_windows")), "covered")

    # Every window of the item in such a stretch is put to one place: the one whose shift
    # is nearest to an anchor, for which each shift of the stretch is taken in turn; of
    # windows that meet at one place, the nearest stays.
    wanted = covered.select(F.col("id").alias("wanted")).distinct()
    near = keep_ids(texts, "id", wanted).dropDuplicates(["id"])
    near = materialise(_tokens(near).drop("kinds").withColumnsRenamed({"values": "doc_values", "tokens": "doc_tokens"}), "covered-texts")
    near = near.hint("merge")
    hashes = F.transform("doc_tokens", lambda token: F.xxhash64(token))
    at_doc = by_rows(covered).join(near.select("id", "reading", hashes.alias("hashes")), ["id", "reading"])
    windows = at_doc.select(*place, "item_windows", F.posexplode(_windows("hashes", size)).alias("at", "window")).join(
        places_of.select("item", "reading", "window", "item_at", "length"), ["item", "reading", "window"])
    width = F.greatest(F.floor(F.col("length") / 2), F.lit(1))
    shift = F.col("at") - F.col("item_at")
    where = F.floor((shift + F.col("phase") * F.floor(width / 2)) / width)
    windows = windows.where(where == F.col("stretch")).select(*place, "item_windows", "item_at", shift.alias("shift"))
    windows = materialise(windows, "covered-windows")
    anchors = windows.select(*place, F.col("shift").alias("anchor")).distinct()
    place = [*place, "anchor"]
    nearest = F.min(F.struct(F.abs(F.col("shift") - F.col("anchor")).alias("drift"), "shift")).alias("nearest")
    # Never broadcast: stored, these rows take less than a byte each.
    aligned = windows.join(anchors.hint("merge"), place[:-1]).groupBy(*place, "item_windows", "item_at").agg(nearest)
    at = F.col("item_at") + F.col("nearest.shift")
    aligned = aligned.groupBy(*place, "item_windows", at.alias("at")).agg(F.min(F.struct("nearest.drift", "nearest.shift", "item_at")).alias("nearest"))
    aligned = materialise(aligned.select(*place, "item_windows", "nearest.*"), "aligned")
    counted = aligned.groupBy(*place, "item_windows").agg(F.count("*").alias("windows"))
    covered = counted.where(F.col("windows") >= coverage * F.col("item_windows"))

    # The values in the slots of those stretches. In lower case, a name that was changed is
    # in no window that was found; its place is then told by the windows next to it.
    asked_slots = items.select("item", "reading", F.posexplode(F.arrays_zip("kinds", "values")).alias("item_at", "both")).where(
        F.col("both.kinds").isin(NAME, NUMBER, UNIT)).select(
        "item", "reading", "item_at", F.col("both.kinds").alias("kind"), F.col("both.values").alias("item_value"))
    reach = F.when(F.col("reading") == LOWERED, size).otherwise(0)
    offsets = aligned.withColumn("n", F.explode(F.sequence(-reach, size - 1 + reach)))
    outside = F.greatest(-F.col("n"), F.col("n") - (size - 1), F.lit(0)).alias("outside")
    slots = offsets.select(*place, (F.col("item_at") + F.col("n")).alias("item_at"), outside, "drift", "shift").join(
        by_rows(asked_slots), ["item", "reading", "item_at"]).where((F.col("outside") == 0) | (F.col("kind") == NAME))
    slots = slots.groupBy(*place, "item_at", "kind", "item_value").agg(F.min(F.struct("outside", "drift", "shift")).alias("nearest"))
    slots = slots.groupBy(*place).agg(F.collect_list(
        F.struct("kind", "item_value", (F.col("item_at") + F.col("nearest.shift")).alias("at"))).alias("slots"))
    read = slots.join(near.select("id", "reading", "doc_values"), ["id", "reading"]).select(*place, F.explode(F.transform("slots", lambda slot: F.struct(
        slot["kind"].alias("kind"), slot["item_value"].alias("item_value"), F.coalesce(F.get("doc_values", slot["at"]), F.lit("")).alias("doc_value")))).alias("slot"))
    # Names of as many words are compared word by word, others as a whole.
    read = read.select(*place, "slot.*")
    words = F.arrays_zip(F.split("item_value", " ").alias("item_value"), F.split("doc_value", " ").alias("doc_value"))
    whole = F.array(F.struct("item_value", "doc_value"))
    alike = F.size(F.split("item_value", " ")) == F.size(F.split("doc_value", " "))
    read = read.select(*place, "kind", F.explode(F.when(alike, words).otherwise(whole)).alias("pair"))
    turned = read.select(*place, "kind", "pair.*").groupBy(*place, "kind", "item_value").agg(
        F.count("*").alias("slots"), F.count_distinct("doc_value").alias("turned"),
        F.bool_and(F.col("doc_value") == F.col("item_value")).alias("same"))
    checked = turned.groupBy(*place).agg(F.sum("slots").alias("slots"), F.max("turned").alias("turned"), F.bool_and("same").alias("same"))
    judged = covered.join(checked, place, "left").where(F.coalesce("turned", F.lit(1)) <= 1)
    leaks = judged.groupBy("id", "item", "reading").agg(
        F.max("windows").alias("windows"), F.max("item_windows").alias("item_windows"),
        F.max(F.coalesce("slots", F.lit(0))).alias("slots"), F.bool_or(F.coalesce("same", F.lit(True))).alias("same_values"),
        F.lit(True).alias("evidence"))
    told = ["windows", "item_windows", "slots", "same_values", "evidence"]
    first = leaks.unionByName(wholes).groupBy("id", "item").agg(F.min_by(F.struct(*told), "reading").alias("told"))
    return first.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "told.*")
