"""The record, its fields and types."""

from __future__ import annotations

# Field names, types and rules of the record.
RECORD_FIELDS = {
    "id": "bigint",
    "points": "int",
    "title": "string",
    "description": "string",
    "price": "double",
    "variety": "string",
    "winery": "string",
    "vineyard": "string",
    "country": "string",
    "province": "string",
    "region_1": "string",
    "region_2": "string",
    "taster_name": "string",
    "taster_twitter_handle": "string",
}
INTEGER_FIELDS = ("id", "points")
NUMBER_FIELDS = ("price",)
TEXT_FIELDS = tuple(name for name, kind in RECORD_FIELDS.items() if kind == "string")
NOT_NULL_FIELDS = ("id", "points", "title")
FILLED_FIELDS = ("country",)
# Name under which a field may also arrive.
ALIASES = {"vineyard": "designation"}
UNKNOWN_COUNTRY = "Unknown"
EMBED_FIELDS = ("variety", "title", "description")
ANALYZED_FIELDS = (
    "title", "description", "variety", "winery", "vineyard", "country",
    "province", "region_1", "region_2", "taster_name",
)
# Fields that are also kept whole, for exact matches.
KEYWORD_FIELDS = (
    "variety", "winery", "country", "province", "region_1", "region_2",
    "taster_name", "taster_twitter_handle",
)
SEARCH_TYPES = {"id": "string", "points": "decimal(20,0)", "price": "double"}
RESULT_FIELDS = {
    "id": "bigint",
    "title": "string",
    "description": "string",
    "country": "string",
    "variety": "string",
    "price": "double",
    "points": "int",
}
SEARCH_FIELD = "description"
EMBEDDING_DIM = 256
