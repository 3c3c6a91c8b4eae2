"""Text expressions: strip, prefixes, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The prefixes the embedding model is trained with, the characters
# with the Unicode property White_Space, and the token patterns.
DOCUMENT_PREFIX = "search_document: "
QUERY_PREFIX = "search_query: "
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WORD = r"[\p{L}\p{M}\p{N}_]+"
# The same words, with one apostrophe between letters or one point or comma
# between digits kept inside the token (don't, 3.14).
JOINED_WORD = (
    r"[\p{L}\p{M}\p{N}_]+"
    r"(?:(?<=[\p{L}\p{M}])['’](?=\p{L})[\p{L}\p{M}\p{N}_]+|(?<=\p{N})[.,](?=\p{N})[\p{L}\p{M}\p{N}_]+)*"
)


def strip(text: Column) -> Column:
    """Drop white space of any kind (not only spaces) from both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def strip_lower(text: Column) -> Column:
    return F.lower(strip(text))


def document_text(text: Column) -> Column:
    """The text of a stored record as the encoder gets it."""
    return F.concat(F.lit(DOCUMENT_PREFIX), strip_lower(text))


def query_text(text: Column) -> Column:
    """The text of a query as the encoder gets it."""
    return F.concat(F.lit(QUERY_PREFIX), strip_lower(text))


def tokens(text: Column, joined: bool = False) -> Column:
    """Lower-cased words of ``text``, in order; no text gives no words."""
    pattern = JOINED_WORD if joined else WORD
    found = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def quoted(text: str) -> str:
    """``text`` as a literal of Spark SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
