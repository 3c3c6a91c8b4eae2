"""Check and coerce records: one narrow pass from JSON lines to typed rows.

Each line is parsed once into a map of variants, which tells a missing key from
a null value and a number from a text. Every rule that a record breaks is named
in ``reasons``; nothing else decides what happens to it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corkscan.functions.text import strip
from corkscan.schemas import (
    ALIASES, EMBED_FIELDS, FILLED_FIELDS, INTEGER_FIELDS, NOT_NULL_FIELDS, NUMBER_FIELDS,
    RECORD_FIELDS, SEARCH_TYPES, UNKNOWN_COUNTRY,
)

NOT_A_RECORD = "not a record"
# Rules for a missing country: any empty value, or null and the word "null".
FILL_FALSY = "falsy"
FILL_NULL_LITERAL = "null_literal"

# Texts that count as numbers.
INTEGER_TEXT = r"^[+-]?\d+(\.0+)?$"
NUMBER_TEXT = r"(?i)^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$|^[+-]?(inf|infinity|nan)$"


def parse_records(lines: DataFrame) -> DataFrame:
    """Add ``values``, the parsed object as a map; NULL if ``raw`` is not one."""
    return lines.withColumn("values", F.from_json("raw", "map<string,variant>"))


def unpack(parsed: DataFrame, *names: str) -> DataFrame:
    """Add the kind and the text of the named fields, each taken out once.

    The kind is STRING, BIGINT, DECIMAL(p,s), DOUBLE, BOOLEAN, ..., VOID for a
    null value, and NULL for a key that is not there. Where a field has two
    names, the key in the input wins over the field's own.
    """
    taken = []
    for name in names:
        keys = [ALIASES[name], name] if name in ALIASES else [name]
        value = F.coalesce(*[F.element_at("values", F.lit(key)) for key in keys])
        taken.append(F.schema_of_variant(value).alias(f"_kind_{name}"))
        taken.append(F.try_variant_get(value, "$", "string").alias(f"_text_{name}"))
    return _computed(parsed, taken)


def _computed(df: DataFrame, columns: Sequence[Column]) -> DataFrame:
    """``df`` with the columns worked out once per row.

    Later filters stay above an ``inline``; they would otherwise repeat the
    expressions of all columns that they look at.
    """
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def kind(name: str) -> Column:
    return F.col(f"_kind_{name}")


def text(name: str) -> Column:
    return F.col(f"_text_{name}")


def is_present(name: str) -> Column:
    """Whether the record has the key, under either of its names."""
    return kind(name).isNotNull()


def is_null(name: str) -> Column:
    return kind(name).isNull() | (kind(name) == "VOID")


def as_integer(name: str) -> Column:
    """Whole numbers, also as text ("91", "91.0") or true/false; else NULL."""
    value = strip(text(name))
    number = value.try_cast("decimal(38,10)")
    return (
        F.when(kind(name) == "BOOLEAN", value.cast("boolean").cast("bigint"))
        .when((kind(name) == "STRING") & ~value.rlike(INTEGER_TEXT), F.lit(None))
        .when(number == F.floor(number), number.try_cast("bigint"))
    )


def as_number(name: str) -> Column:
    """Numbers, also as text or true/false; else NULL."""
    value = strip(text(name))
    return (
        F.when(kind(name) == "BOOLEAN", value.cast("boolean").cast("double"))
        .when((kind(name) != "STRING") | value.rlike(NUMBER_TEXT), value.try_cast("double"))
    )


def as_stripped_text(name: str) -> Column:
    """Text without white space at its ends; NULL for anything but text."""
    return F.when(kind(name) == "STRING", strip(text(name)))


def filled_country(name: str, rule: str) -> Column:
    """The country, ``Unknown`` where it is missing; filled first, stripped second."""
    value, is_text = text(name), kind(name) == "STRING"
    if rule == FILL_FALSY:
        empty = F.when(is_text, value == "").otherwise(value.isin("false", "0", "0.0", "[]", "{}"))
    elif rule == FILL_NULL_LITERAL:
        empty = is_text & (value == "null")
    else:
        raise ValueError(f"unknown rule {rule!r}")
    return F.when(is_null(name) | empty, F.lit(UNKNOWN_COUNTRY)).otherwise(as_stripped_text(name))


def embed_text(*parts: Column) -> Column:
    """The parts that are not empty, as they came, one space between; ends stripped."""
    return strip(F.concat_ws(" ", *[F.nullif(part, F.lit("")) for part in parts]))


def extras(values: Column) -> Column:
    """The keys that no field declares, with their values as they came."""
    declared = [*RECORD_FIELDS, *ALIASES.values()]
    return F.map_filter(values, lambda key, _: ~key.isin(declared))


def _field(name: str, fill: str) -> Column:
    if name in FILLED_FIELDS:
        return filled_country(name, fill)
    if name in INTEGER_FIELDS:
        return as_integer(name).try_cast(RECORD_FIELDS[name])
    if name in NUMBER_FIELDS:
        return as_number(name)
    return as_stripped_text(name)


def missing_keys() -> Column:
    """The names of required keys that the record lacks; their values may be null."""
    required = [name for name in RECORD_FIELDS if name not in FILLED_FIELDS]
    return F.array_compact(F.array(*[F.when(~is_present(name), F.lit(name)) for name in required]))


def _reasons() -> Column:
    broken = []
    for name in RECORD_FIELDS:
        wrong = F.col(name).isNull() & (F.lit(True) if name in NOT_NULL_FIELDS else ~is_null(name))
        rule = F.when(wrong, F.lit(name))
        if name not in FILLED_FIELDS:
            rule = F.when(~is_present(name), F.lit(f"missing {name}")).otherwise(rule)
        broken.append(rule)
    unreadable = F.array(F.lit(NOT_A_RECORD))
    return F.when(F.col("values").isNull(), unreadable).otherwise(F.array_compact(F.array(*broken)))


def check_records(lines: DataFrame, fill: str = FILL_FALSY) -> DataFrame:
    """Lines (``raw``) with the typed fields, ``to_vectorize``, ``extras`` and ``reasons``."""
    unpacked = unpack(parse_records(lines), *RECORD_FIELDS)
    typed = _computed(unpacked, [
        *[_field(name, fill).alias(name) for name in RECORD_FIELDS],
        embed_text(*[text(name) for name in EMBED_FIELDS]).alias("to_vectorize"),
        extras(F.col("values")).alias("extras"),
    ])
    checked = typed.withColumn("reasons", _reasons())
    return checked.select(*lines.columns, *RECORD_FIELDS, "to_vectorize", "extras", "reasons")


def accepted(checked: DataFrame) -> DataFrame:
    """The valid records, without the line they came from."""
    return checked.where(F.size("reasons") == 0).drop("raw", "reasons")


def rejected(checked: DataFrame) -> DataFrame:
    """(raw, reasons) of the others."""
    return checked.where(F.size("reasons") > 0).select("raw", "reasons")


def fail_fast(checked: DataFrame) -> DataFrame:
    """The valid records; the first invalid one that a task meets ends the job."""
    message = F.concat(F.lit("invalid record ("), F.array_join("reasons", ", "), F.lit("): "), F.col("raw"))
    valid = F.when(F.size("reasons") > 0, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return checked.where(valid).drop("raw", "reasons")


def with_document_key(records: DataFrame) -> DataFrame:
    """The keyed form: ``_id`` holds the id as text, the embedding text is gone."""
    return records.withColumn("_id", F.col("id").cast("string")).drop("to_vectorize")


def dump_records(records: DataFrame, keep_nulls: bool = True) -> DataFrame:
    """(id, json): each record as one JSON object, extras after the declared fields."""
    options = {"ignoreNullFields": str(not keep_nulls).lower()}
    extra = F.col("extras")
    if not keep_nulls:
        extra = F.map_filter(extra, lambda _, value: ~F.is_variant_null(value))
    last = ["to_vectorize"] if "to_vectorize" in records.columns else []
    fields = F.to_json(F.struct(*RECORD_FIELDS, *last), options)
    inner = F.to_json(extra, {"ignoreNullFields": "false"})
    both = F.concat(F.expr("left(fields, length(fields) - 1)"), F.lit(","), F.expr("substring(inner, 2)"))
    rows = records.select("id", fields.alias("fields"), inner.alias("inner"))
    return rows.select("id", F.when(F.col("inner") == "{}", F.col("fields")).otherwise(both).alias("json"))


def search_types(records: DataFrame) -> DataFrame:
    """``id``, ``points`` and ``price`` cast as the search mapping declares them."""
    return records.withColumns({name: F.col(name).cast(type_) for name, type_ in SEARCH_TYPES.items()})
