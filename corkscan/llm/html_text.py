"""Main text of web pages, with a suffix array of each host against boilerplate.

A page is read as blocks of text in page order. Blocks inside ``article`` or
``main`` are content. The token streams of all other blocks of a host are put
together, and the array of their suffixes shows which runs of at least ``RUN``
tokens occur on two different pages or more: those are boilerplate, and only runs
that are unique stay. What is left there but stands in an element that by its kind
or class is a menu, a header, a footer, an advert, a form, comments and the like is
dropped after that. An article or main inside an element that is dropped only for a
word of its layout, such as ``has-sidebar``, is content again. Runs inside of an article stay even where other pages have them
too: whole articles are copied, and a copy is no boilerplate. A run of more than
``RUN`` tokens that repeats is made of runs of ``RUN`` that repeat, so the order of
suffixes need not be known any further to know which tokens are covered.

Pages of one host with equal html are one page to the array, whatever their URLs and
identifiers are: copies of a page take nothing from each other.

The pages of a large host are dealt over groups of about ``CHUNK`` pages or
``CHUNK_BYTES`` of html, each with an array of its own. Runs that are on one page only within their group are then
counted across the groups of the host by the hash of their first ``RUN`` tokens,
which finds the same repeats as one array would. Only hashes of tokens are shuffled,
not pages, which are read a second time for their text; what the arrays say is needed
there only for pages with text that is neither in an article nor in a side element.

Null and empty pages have an empty text; broken markup is read as far as it goes.
Rows that repeat are read each. Pages without a host are a host of their own kind.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corkscan.llm.common import bounded_batches, steps, text_or_empty
from corkscan.llm.url_filter import host_of
from corkscan.storage import materialise

RUN = 6
CHUNK = 256
CHUNK_BYTES = 32 << 20
# The runs of so many pages, with so many places in all (4 bytes each), may be broadcast; more are joined by shuffle.
FEW_PAGES, FEW_PLACES = 100_000, 2_000_000

# Elements of HTML by what their text is.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "noembed", "noframes", "xmp", "svg", "math", "object", "canvas",
       "select", "video", "audio"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
          "mark", "nobr", "q", "ruby", "rb", "rp", "rt", "rtc", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt",
          "u", "var", "wbr", "img"}
CONTENT = {"article", "main"}
SIDE = {"head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "fieldset"}
SIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
COMMENTS = {"comment", "comments", "reply", "replies", "disqus", "respond"}
SIDE_WORDS = COMMENTS | {
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "aside", "ad", "ads",
    "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion", "notice", "notices", "cookie",
    "cookies", "consent", "gdpr", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related",
    "popup", "modal", "overlay", "pagination", "pager", "search", "form", "widget", "copyright", "disclaimer"}
# What an element of these words holds is no content, not even its articles; other words may be those of a layout round the content.
NO_LAYOUT = COMMENTS | {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "related"}
# A start tag that ends an open element of one of these kinds by itself.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}}

KEEP, OPEN, DROP = 0, 1, 2  # kinds of blocks: content, to be decided, side matter
LAYOUT = 3  # side matter but for the articles in it

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"(?i)\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_NOT_LETTERS = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_RAW_END = {name: re.compile(rf"(?i)</{name}\b[^>]*>") for name in RAW}


def _side(name: str, attributes: str) -> int:
    """DROP or LAYOUT for a side element, OPEN for any other."""
    if name in SIDE:
        return DROP
    if name in ("html", "body", "main"):
        return OPEN
    found = OPEN
    for key, *values in _ATTRIBUTE.findall(attributes) if "=" in attributes else ():
        value = next((v for v in values if v), "")
        if key.lower() == "role":
            if value.lower() in SIDE_ROLES:
                return DROP
        else:
            words = set(_NOT_LETTERS.split(_CAMEL.sub(" ", value).lower()))
            if words & (COMMENTS if name == "article" else NO_LAYOUT):
                return DROP
            if name != "article" and words & SIDE_WORDS:
                found = LAYOUT
    return found


def blocks_of(page: str) -> list[tuple[int, str]]:
    """(kind, text) of each block, in page order; white space is one space."""
    blocks, text = [], []
    stack = []  # (name, kind of what is inside)
    opened: dict[str, int] = {}
    kind, at = OPEN, 0

    def flush() -> None:
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                blocks.append((DROP if kind == LAYOUT else kind, whole))
            text.clear()

    def leave(names: set[str], until: set[str] = frozenset()) -> None:
        """Close the innermost element of these names, and all inside of it."""
        nonlocal kind
        if not any(opened.get(name) for name in names):
            return
        for n in range(len(stack) - 1, -1, -1):
            if stack[n][0] in names:
                for name, _ in stack[n:]:
                    opened[name] -= 1
                del stack[n:]
                kind = stack[-1][1] if stack else OPEN
                return
            if stack[n][0] in until:
                return

    while True:
        tag = _TAG.search(page, at)
        if tag is None:
            text.append(page[at:])
            break
        text.append(page[at : tag.start()])
        at = tag.end()
        closing, name, attributes = (tag[1], tag[2], tag[3]) if tag[2] else (tag[4], tag[5], tag[6])
        if not name:
            continue  # a comment or a declaration
        name = name.lower()
        if name not in INLINE:
            flush()
        if closing:
            if opened.get(name):
                leave({name})
            continue
        if name in RAW:
            if name not in ("svg", "math") or not attributes.endswith("/"):
                end = _RAW_END[name].search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in VOID:
            continue
        if name in ENDS:
            leave(ENDS[name], {"ul", "ol", "dl", "table"})
        elif name not in INLINE and opened.get("p"):
            leave({"p"})
        both = (kind, _side(name, attributes))
        inside = DROP if DROP in both else KEEP if name in CONTENT else LAYOUT if LAYOUT in both else kind
        if inside != kind:
            flush()
        stack.append((name, inside))
        opened[name] = opened.get(name, 0) + 1
        kind = inside
    flush()
    return blocks


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tokens of each page outside of its articles, and whether any of them is to be decided."""
    for batch in steps(batches, "html"):
        tokens, undecided = [], []
        for page in batch["html"].to_pylist():
            blocks = [(kind, text) for kind, text in blocks_of(page) if kind != KEEP]
            hashes = [xxhash.xxh3_64_intdigest(token) for _, text in blocks for token in text.split(" ")]
            tokens.append(np.array(hashes, dtype=np.uint64).view(np.int64))
            undecided.append(any(kind == OPEN for kind, _ in blocks))
        yield pa.RecordBatch.from_pydict({
            "row": batch["row"], "host": batch["host"], "tokens": pa.array(tokens, pa.list_(pa.int64())), "undecided": pa.array(undecided)})


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of all suffixes by their first ``RUN`` tokens or more, by prefix
    doubling, and a number for each suffix that equal beginnings share."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    length = 1
    while length < RUN:
        step = min(length, RUN - length)  # the last round does not look further than RUN
        later = np.zeros(len(rank), dtype=np.int64)
        later[: len(rank) - step] = rank[step:]
        rank = np.unique(rank * (rank.max() + 1) + later, return_inverse=True)[1] + 1
        length += step
    return np.argsort(rank, kind="stable"), rank


def _host_runs(rows: pa.Table) -> pa.Table:
    """For the pages of one group: at which tokens outside of articles a run begins
    that another page of the group has too, and the hash of the run at each token."""
    rows = rows.combine_chunks()
    sizes = rows["tokens"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    tokens = rows["tokens"].combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    page = np.repeat(np.unique(rows["row"].to_numpy(), return_inverse=True)[1], sizes)
    whole = np.arange(len(tokens)) + RUN <= np.repeat(ends, sizes)  # runs do not cross pages
    repeated, hashes = np.zeros(len(tokens), dtype=bool), np.zeros(len(tokens), dtype=np.uint64)
    if whole.any():
        order, rank = suffix_array(tokens)
        order = order[whole[order]]
        first = np.flatnonzero(np.append(True, rank[order][1:] != rank[order][:-1]))
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        several = np.minimum.reduceat(page[order], first) < np.maximum.reduceat(page[order], first)
        repeated[order] = several[group]
        for n in range(RUN):
            hashes[: len(tokens) - n] = hashes[: len(tokens) - n] * np.uint64(0x9E3779B97F4A7C15) + tokens[n:]
    found = [np.flatnonzero(repeated[a:b]).astype(np.int32) for a, b in zip(starts, ends)]
    runs = [hashes[a:b][whole[a:b]].view(np.int64) for a, b in zip(starts, ends)]
    return pa.table({name: rows[name] for name in ("host", "row", "undecided")} | {
        "found": pa.array(found, pa.list_(pa.int32())), "runs": pa.array(runs, pa.list_(pa.int64()))})


def _main_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "html"):
        texts = []
        for page, begun in zip(batch["html"].to_pylist(), batch["begun"].to_pylist()):
            covered = {at + n for at in begun or () for n in range(RUN)}
            kept, at = [], 0
            for kind, block in blocks_of(page):
                if kind == KEEP:
                    kept.append(block)
                    continue
                tokens = block.split(" ")
                unique = [token for n, token in enumerate(tokens, at) if n not in covered]
                at += len(tokens)
                if kind == OPEN and unique:
                    kept.append(" ".join(unique))
            texts.append(" ".join(kept))
        yield pa.RecordBatch.from_pydict({"page": batch["page"], "url": batch["url"], "text": pa.array(texts, pa.string())})


def boilerplate(pages: DataFrame) -> DataFrame:
    """(row, begun): for pages (row, host, html) with undecided blocks, the places of their
    tokens outside of articles at which a run begins that another page of the host has too."""
    streams = pages.mapInArrow(_streams, "row bigint, host string, tokens array<bigint>, undecided boolean")
    streams = streams.groupBy("row").agg(*(F.first(name).alias(name) for name in ("host", "tokens", "undecided")))
    sizes = pages.select("host", "row", F.octet_length("html").alias("bytes")).distinct().groupBy("host").agg(
        F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("bytes") / CHUNK_BYTES)).alias("chunks"))
    large = materialise(sizes.where("chunks > 1"), "large-hosts")
    streams = streams.join(large, "host", "left")
    chunk = F.pmod(F.xxhash64("row"), F.coalesce("chunks", F.lit(1))).cast("int")
    runs = streams.select("host", "row", "tokens", "undecided", chunk.alias("chunk")).groupBy("host", "chunk").applyInArrow(
        _host_runs, "host string, row bigint, undecided boolean, found array<int>, runs array<bigint>")
    runs = materialise(runs, "host-runs")

    # Across the groups of large hosts.
    begun = runs.join(large.select("host"), "host", "left_semi").select("host", "row", "undecided", F.posexplode("runs").alias("at", "run"))
    spread = begun.groupBy("host", "run").agg(F.min("row").alias("one"), F.max("row").alias("other")).where("one < other")
    across = begun.where("undecided").join(spread.select("host", "run"), ["host", "run"]).select("row", "at")
    within = runs.where("undecided").select("row", F.explode("found").alias("at"))
    return within.unionByName(across).groupBy("row").agg(F.collect_set("at").alias("begun"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text): the main text of each page, blocks joined by one space."""
    read = bounded_batches(pages).select(
        F.col(id_col).alias("page"), F.col(url_col).alias("url"), text_or_empty(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    read = read.withColumn("row", F.xxhash64("host", "html"))
    begun = materialise(boilerplate(read.select("row", "host", "html")), "boilerplate")
    size = begun.agg(F.count("*").alias("pages"), F.coalesce(F.sum(F.size("begun")), F.lit(0)).alias("places")).first()
    if size["pages"] <= FEW_PAGES and size["places"] <= FEW_PLACES:
        begun = F.broadcast(begun)
    page = ", ".join(f"{name} {read.schema[name].dataType.simpleString()}" for name in ("page", "url"))
    text = read.join(begun, "row", "left").select("page", "url", "html", "begun").mapInArrow(_main_text, f"{page}, text string")
    return text.select(F.col("page").alias(id_col), F.col("url").alias(url_col), "text")
