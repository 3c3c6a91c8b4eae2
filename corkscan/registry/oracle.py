"""SQL that another engine runs on the same tables, one text per query."""

from __future__ import annotations

from collections.abc import Sequence

from corkscan.registry.fixed import DOCUMENT_LINES, KEYWORD_LINES
from corkscan.registry.workspace import DIM, PARTITIONS, SQL_STEPS
from corkscan.schemas import ANALYZED_FIELDS, KEYWORD_FIELDS

WORD = r"[\p{L}\p{M}\p{N}_]+"
SPACE = r"[\s\p{Z}\x{85}\x{0B}]+"
K = 10
PROBES = 10
SUB_DIM = 4
WORDS = 256


def _values(lines: Sequence[str], first: int = 0) -> str:
    rows = ", ".join("({}, '{}')".format(i, line.replace("'", "''")) for i, line in enumerate(lines, first))
    return f"SELECT query_id::BIGINT AS query_id, query FROM (VALUES {rows}) AS v(query_id, query)"


def _strip(column: str) -> str:
    return f"regexp_replace({column}, '^{SPACE}|{SPACE}$', '', 'g')"


def _words(column: str) -> str:
    return f"regexp_extract_all(lower({column}), '{WORD}')"


# --- record lines ----------------------------------------------------------------

_KEYWORDS = "[" + ", ".join(f"'{line}'" for line in KEYWORD_LINES) + "]"

# The values as they stand in the lines; a line that is not a record has none.
RAW = f"""
raw AS (
  SELECT p_partkey AS k, p_partkey % 47 = 0 AS broken, p_partkey + 1 AS id,
    CASE WHEN p_partkey % 23 = 0 THEN 'x'
         WHEN p_partkey % 29 = 0 THEN (80 + p_size % 21)::VARCHAR || '.0'
         ELSE (80 + p_size % 21)::VARCHAR END AS points,
    CASE WHEN p_partkey % 31 = 0 THEN NULL
         WHEN p_partkey % 37 = 0 THEN chr(9) || p_name || '  ' || p_brand || chr(160)
         ELSE p_name || '  ' || p_brand END AS title,
    CASE WHEN p_partkey % 41 = 0 THEN NULL
         ELSE ({_KEYWORDS})[p_partkey % {len(KEYWORD_LINES)} + 1] || ' ' || text END AS description,
    c_name AS taster_name, '@' || p_partkey::VARCHAR AS taster_twitter_handle,
    p_partkey % 43 = 0 AS no_price,
    CASE WHEN p_partkey % 11 = 0 OR p_partkey % 43 = 0 THEN NULL ELSE p_retailprice END AS price,
    p_brand AS vineyard,
    CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 17 = 0 THEN '' ELSE p_type END AS variety,
    p_type AS region_1, NULL::VARCHAR AS region_2, r_name AS province,
    CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'null' WHEN 3 THEN '  ' WHEN 4 THEN NULL
         ELSE n_name END AS country,
    s_name AS winery,
    p_partkey % 5 = 0 AS has_extras, 1990 + p_size % 30 AS vintage,
    CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_type END AS notes, p_name,
    '{{"red":' || (p_partkey % 2 = 0)::VARCHAR || ',"share":' || p_size::VARCHAR || '}}' AS grapes
  FROM part
  JOIN documents ON doc_id = p_partkey % (SELECT count(*) FROM documents)
  JOIN supplier ON s_suppkey = p_partkey % (SELECT count(*) FROM supplier)
  JOIN customer ON c_custkey = p_partkey % (SELECT count(*) FROM customer)
  JOIN nation ON n_nationkey = p_partkey % 25
  JOIN region ON n_regionkey = r_regionkey
)"""

_COUNTRY_FALSY = f"CASE WHEN country IS NULL OR country = '' THEN 'Unknown' ELSE {_strip('country')} END"
_COUNTRY_LITERAL = f"CASE WHEN country IS NULL OR country = 'null' THEN 'Unknown' ELSE {_strip('country')} END"

RECORDS = RAW + f""",
records AS (
  SELECT id, split_part(points, '.', 1)::INTEGER AS points, {_strip('title')} AS title,
    {_strip('description')} AS description, price, {_strip('variety')} AS variety, {_strip('winery')} AS winery,
    {_strip('vineyard')} AS vineyard, {_COUNTRY_FALSY} AS country, {_COUNTRY_LITERAL} AS country_literal,
    {_strip('province')} AS province, {_strip('region_1')} AS region_1, region_2,
    {_strip('taster_name')} AS taster_name, {_strip('taster_twitter_handle')} AS taster_twitter_handle,
    {_strip("concat_ws(' ', nullif(variety, ''), nullif(title, ''), nullif(description, ''))")} AS to_vectorize,
    has_extras, vintage, notes, grapes
  FROM raw WHERE NOT broken AND points <> 'x' AND title IS NOT NULL AND NOT no_price
)"""

# Reasons in the order of the fields.
REJECTS = RAW + """,
rejects AS (
  SELECT k, CASE WHEN broken THEN ['not a record'] ELSE list_filter([
    CASE WHEN points = 'x' THEN 'points' END,
    CASE WHEN title IS NULL THEN 'title' END,
    CASE WHEN no_price THEN 'missing price' END], lambda r: r IS NOT NULL) END AS reasons, raw.*
  FROM raw WHERE broken OR points = 'x' OR title IS NULL OR no_price
)"""


# --- keyword search ----------------------------------------------------------------


def _postings(fields: str) -> str:
    """Postings, frequencies and sizes of ``fields`` (field, doc_id, body)."""
    return f"""
texts AS ({fields}),
words AS (SELECT field, doc_id, unnest({_words('body')}) AS term FROM texts),
posts AS (SELECT field, term, doc_id, count(*) AS tf FROM words GROUP BY ALL),
lens AS (SELECT field, doc_id, count(*) AS doc_len FROM words GROUP BY ALL),
sizes AS (SELECT field, count(*) AS n, sum(doc_len)::BIGINT AS total_len, avg(doc_len) AS avgdl FROM lens GROUP BY ALL),
freqs AS (SELECT field, term, count(*) AS df FROM posts GROUP BY ALL)"""


DOCUMENTS = _postings("SELECT 'text' AS field, doc_id, text AS body FROM documents")

CHANGED_DOCUMENTS = _postings("""SELECT 'text' AS field, doc_id, text AS body FROM documents WHERE doc_id % 7 <> 1 AND doc_id % 3 <> 0
  UNION ALL SELECT 'text', doc_id, concat_ws(' ', source, text) FROM documents WHERE doc_id % 3 = 0
  UNION ALL SELECT 'text', doc_id + 1000000000, text FROM documents WHERE doc_id % 5 = 0""")


def _record_fields(fields: Sequence[str]) -> str:
    each = " UNION ALL ".join(f"SELECT '{f}' AS field, id AS doc_id, {f} AS body FROM records" for f in fields)
    return RECORDS + "," + _postings(each)


def _ranked(queries: str, doc: str = "doc_id") -> str:
    return f"""
queries AS ({queries}),
asked AS (
  SELECT query_id, term, count(*) AS qtf
  FROM (SELECT query_id, unnest({_words('query')}) AS term FROM queries) GROUP BY ALL),
scores AS (
  SELECT query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
    / (tf + 1.2 * (0.25 + 0.75 * doc_len / avgdl))), 6) AS _score
  FROM asked JOIN posts USING (term) JOIN freqs USING (field, term) JOIN sizes USING (field)
  JOIN lens USING (field, doc_id) GROUP BY ALL),
ranked AS (
  SELECT query_id, doc_id AS {doc}, _score,
    row_number() OVER (PARTITION BY query_id ORDER BY _score DESC, doc_id)::INTEGER AS rank FROM scores),
best AS (SELECT * FROM ranked WHERE rank <= {K})"""


BEST_DOCUMENTS = DOCUMENTS + "," + _ranked(_values(DOCUMENT_LINES))


# --- vectors -----------------------------------------------------------------------


def _embedded(texts: str, name: str, prefix: str) -> str:
    """``name``(key, slot, value): hashed, scaled, 32-bit vectors of ``texts`` (key, body)."""
    return f"""
{name}_words AS (
  SELECT key, md5(unnest(regexp_extract_all('{prefix}' || lower({_strip('body')}), '{WORD}'))) AS h FROM ({texts})),
{name}_sums AS (
  SELECT key, ('0x' || substr(h, 1, 8))::BIGINT % {DIM} + 1 AS slot,
    sum(CASE WHEN ('0x' || substr(h, 9, 1))::BIGINT % 2 = 1 THEN -1 ELSE 1 END) AS s
  FROM {name}_words GROUP BY ALL),
{name}_norms AS (SELECT key, sqrt(sum(s * s)) AS norm FROM {name}_sums GROUP BY ALL),
{name} AS (
  SELECT key, slot, (s / norm)::FLOAT AS value FROM {name}_sums JOIN {name}_norms USING (key) WHERE s <> 0)"""


def _unit(vector: str) -> str:
    doubles = f"{vector}::DOUBLE[]"
    return f"list_transform({doubles}, lambda x: x / sqrt(list_dot_product({doubles}, {doubles})))"


UNITS = f"""
units AS (SELECT vec_id, {_unit('embedding')} AS u FROM embeddings),
means AS (
  SELECT label, pos, round(avg(x::DOUBLE), 6) AS x
  FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, {DIM} + 1)) AS pos FROM embeddings) GROUP BY ALL),
mean_vectors AS (SELECT label::BIGINT AS query_id, list(x ORDER BY pos)::FLOAT[] AS q FROM means GROUP BY ALL),
asking AS (SELECT query_id, {_unit('q')} AS q FROM mean_vectors)"""


# The vectors of the lowest ids as centroids and code words.
CENTROIDS = UNITS + f""",
centroids AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY vec_id) - 1)::INTEGER AS part_id, u AS c FROM units
  QUALIFY row_number() OVER (ORDER BY vec_id) <= {PARTITIONS}),
assigned AS MATERIALIZED (
  SELECT vec_id, u, part_id, c FROM units, centroids
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(list_dot_product(u, c), 12) DESC, part_id) = 1),
probes AS (
  SELECT query_id, q, part_id,
    row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(q, c), 12) DESC, part_id)::INTEGER AS probe
  FROM asking, centroids QUALIFY probe <= {PROBES})"""



def _stepped(steps: int) -> str:
    """``CENTROIDS``, moved to the means of what is nearest to them some times; one that
    nothing is nearest to begins again at the farthest vector of the widest one."""
    parts = [CENTROIDS, "centroids0 AS (SELECT part_id, c FROM centroids)"]
    for n in range(1, steps + 1):
        parts.append(f"""
member{n} AS MATERIALIZED (
  SELECT part_id, u, round(list_sum(list_transform(range(1, {DIM} + 1), lambda i: (u[i] - c[i]) ** 2)), 12) AS away
  FROM units, centroids{n - 1} WHERE NOT isnan(u[1])
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(list_dot_product(u, c), 12) DESC, part_id) = 1),
cells{n} AS (
  SELECT part_id, pos, round(avg(x), 9) AS x
  FROM (SELECT part_id, unnest(u) AS x, unnest(range(1, {DIM} + 1)) AS pos FROM member{n}) GROUP BY ALL),
means{n} AS (SELECT part_id, list(x ORDER BY pos) AS v FROM cells{n} GROUP BY ALL),
wide{n} AS (
  SELECT row_number() OVER (ORDER BY round(sum(away), 9) DESC, part_id) AS place, first(u ORDER BY away DESC, u DESC) AS far
  FROM member{n} GROUP BY part_id HAVING round(max(away), 9) > 0),
empty{n} AS (
  SELECT part_id, row_number() OVER (ORDER BY part_id) AS place FROM centroids{n - 1} ANTI JOIN means{n} USING (part_id)),
centroids{n} AS MATERIALIZED (
  SELECT part_id, CASE WHEN v IS NOT NULL THEN {_unit('v')} WHEN far IS NOT NULL THEN far ELSE c END AS c
  FROM centroids{n - 1} LEFT JOIN means{n} USING (part_id) LEFT JOIN empty{n} USING (part_id) LEFT JOIN wide{n} USING (place))""")
    parts.append(f"""
stepped AS (
  SELECT part_id, u FROM units, centroids{steps} WHERE NOT isnan(u[1])
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(list_dot_product(u, c), 12) DESC, part_id) = 1)""")
    return ",".join(parts)


CODES = CENTROIDS + f""",
rests AS (
  SELECT vec_id, part_id, c, list_transform(range(1, {DIM} + 1), lambda i: u[i] - c[i]) AS r FROM assigned),
subs AS MATERIALIZED (
  SELECT vec_id, part_id, m::INTEGER AS m, r[m * {SUB_DIM} + 1 : m * {SUB_DIM} + {SUB_DIM}] AS p
  FROM rests, range({DIM // SUB_DIM}) AS g(m)),
firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS code FROM units QUALIFY code < {WORDS}),
code_words AS MATERIALIZED (SELECT m, code::INTEGER AS code, p AS w FROM subs JOIN firsts USING (vec_id)),
codes AS (
  SELECT vec_id, part_id, m, code, w, p FROM subs JOIN code_words USING (m)
  QUALIFY row_number() OVER (PARTITION BY vec_id, m
    ORDER BY round(list_dot_product(w, w) - 2 * list_dot_product(p, w), 12), code) = 1),
decoded AS (
  SELECT vec_id, part_id, list_transform(range(1, {DIM} + 1), lambda i: c[i] + flat[i]) AS x
  FROM (SELECT vec_id, part_id, flatten(list(w ORDER BY m)) AS flat FROM codes GROUP BY ALL)
  JOIN centroids USING (part_id))"""


def _nearest(rows: str, distance: str) -> str:
    return f"""
near AS (SELECT query_id, vec_id, round({distance}, 6) + 0.0 AS _distance FROM {rows}),
nearest AS (
  SELECT query_id, vec_id, _distance,
    row_number() OVER (PARTITION BY query_id ORDER BY _distance, vec_id)::INTEGER AS rank
  FROM near QUALIFY rank <= {K})"""


EXACT = UNITS + "," + _nearest("asking, units", "1 - list_dot_product(q, u)")
FLAT = CENTROIDS + "," + _nearest("probes JOIN assigned USING (part_id)", "1 - list_dot_product(q, u)")
QUANTISED = CODES + "," + _nearest(
    "probes JOIN decoded USING (part_id)", "(1 - 2 * list_dot_product(q, x) + list_dot_product(x, x)) / 2")


# --- query log ---------------------------------------------------------------------

LOG = """
log AS (SELECT event_type AS search, (event_id % 3)::INTEGER AS trial, event_type <> 'error' AS ok, value AS latency_ms
  FROM events),
trials AS (
  SELECT search, trial, sum(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS success,
    round(sum(latency_ms) / 1000.0, 6) AS elapsed_s,
    quantile_cont(latency_ms, 0.5) AS p50_ms, quantile_cont(latency_ms, 0.95) AS p95_ms,
    quantile_cont(latency_ms, 0.99) AS p99_ms
  FROM log GROUP BY ALL),
measured AS (SELECT *, CASE WHEN elapsed_s > 0 THEN 1000.0::DOUBLE / elapsed_s ELSE 'inf'::DOUBLE END AS qps FROM trials),
averaged AS (
  SELECT search, count(*) AS runs, avg(success) AS success_avg, avg(elapsed_s) AS elapsed_s_avg, avg(qps) AS qps_avg,
    avg(p50_ms) AS p50_ms_avg, avg(p95_ms) AS p95_ms_avg, avg(p99_ms) AS p99_ms_avg FROM measured GROUP BY ALL)"""

_FIGURES = ("success", "elapsed_s", "qps", "p50_ms", "p95_ms", "p99_ms")


def _rounded(suffix: str = "") -> str:
    return ", ".join(f"round({name}{suffix}, 6) AS {name}{suffix}" for name in _FIGURES)


def _fixed(column: str, places: int) -> str:
    return f"round(round({column}, 6)::DECIMAL(28, 6), {places})::DECIMAL(28, {places})::VARCHAR"


QUERY_LINES = """
terms AS (
  SELECT row_number() OVER (ORDER BY p_partkey) AS query_id, p_name || ' ' || p_brand AS query
  FROM part WHERE p_partkey % 9 <> 0)"""

_DESCRIPTION_QUERIES = _values(KEYWORD_LINES) + " UNION ALL " + _values(DOCUMENT_LINES, 100)
_RECORD_SEARCH = _record_fields(["description"]) + ","

ORACLE: dict[str, str] = {
    # sources and sinks
    "reviews_scan": f"""WITH {RAW}
SELECT CASE WHEN NOT broken THEN id END AS id, CASE WHEN NOT broken THEN points END AS points,
  CASE WHEN NOT broken THEN title END AS title, CASE WHEN NOT broken THEN price END AS price,
  CASE WHEN NOT broken THEN country END AS country,
  CASE WHEN NOT broken THEN length(description)::INTEGER END AS description_chars FROM raw""",
    "json_array_scan": """
SELECT CASE WHEN p_partkey % 10 = 3 THEN p_partkey + 1000000 END AS id, p_name AS name, p_retailprice AS price FROM part""",
    "json_array_ranges": """
SELECT CASE WHEN p_partkey % 10 = 3 THEN p_partkey + 1000000 END AS id, p_name AS name, '[",{\\"' || p_brand || '\\"],' AS odd,
  p_size::BIGINT AS size FROM part""",
    "assign_dense_id": """
SELECT CASE WHEN p_partkey % 10 = 3 THEN p_partkey + 1000000 ELSE position END AS id, position, name
FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS position, p_name AS name FROM part)""",
    "jsonl_roundtrip": """
SELECT c_custkey, c_name, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal, true AS balance_written FROM customer""",
    "query_terms": f"WITH {QUERY_LINES} SELECT query_id, query FROM terms",
    "limit_rows_early": """
SELECT position, CASE WHEN p_partkey % 47 <> 0 THEN p_partkey + 1 END AS id
FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS position FROM part)
ORDER BY position LIMIT (SELECT count(*) // 10 FROM part)""",
    "empty_input": "SELECT count(*) AS blank_lines, 'ValueError' AS error FROM documents",
    "rebuilt_tables": f"""WITH {RECORDS}
SELECT kind, id, points, title FROM records, (VALUES ('plain'), ('keyed')) AS kinds(kind) WHERE id % 10 = 0""",
    "limit_rows": """
SELECT position, CASE WHEN p_partkey % 47 <> 0 THEN p_partkey + 1 END AS id
FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS position FROM part)
ORDER BY position LIMIT (SELECT count(*) // 2 FROM part)""",
    "table_append": "SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT s_suppkey, s_name FROM supplier",
    "overwrite_keeps_old": f"WITH {RECORDS} SELECT id, points, title FROM records",
    "quarantined_lines": f"""WITH {REJECTS}
SELECT CASE WHEN NOT broken THEN k + 1 END AS id, array_to_string(reasons, ',') AS reasons FROM rejects""",
    "keyed_load_twice": f"WITH {RECORDS} SELECT id::VARCHAR AS _id, points, title FROM records",
    "limit_rows_with_blanks": f"""WITH {QUERY_LINES}
SELECT query_id AS position, '  ' || query || chr(9) AS raw FROM terms WHERE query_id <= (SELECT count(*) // 2 FROM part)""",
    "vector_dim_guard": f"""
SELECT ({DIM} // 2)::INTEGER AS size, count(*) AS n FROM embeddings WHERE label = 0 HAVING count(*) > 0""",
    "keyed_upsert": """
WITH batch AS (SELECT o_custkey + o_orderkey % 3 AS id, o_totalprice AS amount, o_orderpriority AS origin FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey + o_orderkey % 3 ORDER BY o_orderkey DESC) = 1)
SELECT id, amount, origin FROM batch
UNION ALL SELECT c_custkey, c_acctbal, 'customer' FROM customer WHERE c_custkey NOT IN (SELECT id FROM batch)""",
    "write_rejects": f"""WITH {REJECTS}
SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM rejects) GROUP BY ALL""",
    # records
    "coerce_types": f"""WITH {RAW}
SELECT id, CASE WHEN points <> 'x' THEN split_part(points, '.', 1)::INTEGER END AS points, price FROM raw WHERE NOT broken""",
    "required_keys": f"""WITH {RAW}
SELECT id, CASE WHEN no_price THEN 'price' ELSE '' END AS missing, title IS NULL AS title_is_null
FROM raw WHERE NOT broken""",
    "strip_strings": f"WITH {RECORDS} SELECT id, title, country, variety, winery FROM records",
    "rename_designation": f"WITH {RECORDS} SELECT id, vineyard FROM records",
    "fill_country_falsy": f"WITH {RECORDS} SELECT id, country FROM records",
    "fill_country_null_literal": f"WITH {RECORDS} SELECT id, country_literal AS country FROM records",
    "derive_doc_key": f"WITH {RECORDS} SELECT id, id::VARCHAR AS _id FROM records",
    "compose_embed_text": f"WITH {RECORDS} SELECT id, to_vectorize FROM records",
    "extras_passthrough": f"""WITH {RECORDS}
SELECT id, 'vintage' AS key, 'BIGINT' AS kind, vintage::VARCHAR AS value FROM records WHERE has_extras
UNION ALL SELECT id, 'notes', CASE WHEN notes IS NULL THEN 'VOID' ELSE 'STRING' END, notes FROM records WHERE has_extras
UNION ALL SELECT id, 'grapes', 'OBJECT<red: BOOLEAN, share: BIGINT>', grapes FROM records WHERE has_extras""",
    "dump_record": f"""WITH {RECORDS}
SELECT id, (15 + CASE WHEN has_extras THEN 3 ELSE 0 END)::INTEGER AS keys_with_nulls,
  (14 - (description IS NULL)::INTEGER - (price IS NULL)::INTEGER - (variety IS NULL)::INTEGER
    + CASE WHEN has_extras THEN 2 + (notes IS NOT NULL)::INTEGER ELSE 0 END)::INTEGER AS keys_without_nulls,
  title, price, CASE WHEN has_extras THEN vintage::VARCHAR ELSE '' END AS vintage, CASE WHEN has_extras THEN grapes ELSE '' END AS grapes,
  length(description)::INTEGER AS description_chars FROM records""",
    "drop_embed_text": f"""WITH {RECORDS}
SELECT id, points, title, description, price, variety, winery, vineyard, country, province, region_1, region_2,
  taster_name, taster_twitter_handle, id::VARCHAR AS _id FROM records""",
    "ingest_counts": f"""WITH {RAW}, flagged AS (
  SELECT broken OR points = 'x' OR title IS NULL OR no_price AS bad FROM raw)
SELECT count(*) AS n_read, count(*) FILTER (NOT bad) AS n_valid, count(*) FILTER (bad) AS n_rejected FROM flagged""",
    "validation_rejects": f"""WITH {REJECTS}
SELECT CASE WHEN NOT broken THEN k + 1 END AS id, array_to_string(reasons, ',') AS reasons FROM rejects""",
    "mapping_casts": f"""WITH {RECORDS}
SELECT id::VARCHAR AS id, points::DECIMAL(20, 0) AS points, price FROM records""",
    "result_projection": f"""WITH {_RECORD_SEARCH} {_ranked(_values(KEYWORD_LINES), 'id')}
SELECT query_id, rank, id, title, description, country, variety, price, points, _score
FROM best JOIN records USING (id)""",
    "keyword_exact": f"""WITH {RECORDS}
SELECT id, variety, title FROM records
WHERE variety IN (SELECT DISTINCT p_type FROM part ORDER BY p_type LIMIT 2)""",
    "keyword_exact_fields": f"WITH {RECORDS} " + " UNION ALL ".join(
        f"SELECT '{name}' AS field, {name} AS value, id FROM records "
        f"WHERE {name} IN (SELECT min({name}) FROM records UNION ALL SELECT max({name}) FROM records)" for name in KEYWORD_FIELDS),
    # text
    "format_document_text": f"SELECT doc_id, 'search_document: ' || lower({_strip('text')}) AS formatted FROM documents",
    "format_query_text": f"SELECT item_id AS query_id, 'search_query: ' || lower({_strip('text')}) AS formatted FROM benchmark",
    "analyze_tokens": f"WITH {DOCUMENTS} SELECT doc_id, term, tf FROM posts",
    "analyze_fields": f"WITH {_record_fields(ANALYZED_FIELDS)} SELECT doc_id, field, term, tf FROM posts",
    # embedding
    "embed_documents": f"""WITH {_embedded('SELECT doc_id AS key, text AS body FROM documents', 'docs', 'search_document: ')}
SELECT key AS doc_id, slot::INTEGER AS slot, round(value::DOUBLE, 6) AS value FROM docs""",
    "encoder_shape": f"SELECT count(*) AS texts, {DIM} AS wanted, {DIM // 2} AS got FROM documents",
    "embed_queries": f"""WITH asked AS ({_values(DOCUMENT_LINES, 1_000_000)} UNION ALL SELECT item_id, text FROM benchmark),
distinct_texts AS (SELECT min(query_id) AS key, query AS body FROM asked GROUP BY query),
{_embedded('SELECT key, body FROM distinct_texts', 'texts', 'search_query: ')}
SELECT key AS text_id, slot::INTEGER AS slot, round(value::DOUBLE, 6) AS value FROM texts""",
    "truncate_vector": f"""
SELECT vec_id AS id, slot::INTEGER AS slot, round(x::DOUBLE, 6) + 0.0 AS value
FROM (SELECT vec_id, unnest(embedding[1:{DIM // 2}]) AS x, unnest(range(1, {DIM // 2} + 1)) AS slot FROM embeddings)""",
    # text index
    "postings": f"""WITH {DOCUMENTS}
SELECT field, term, doc_id, tf, doc_len FROM posts JOIN lens USING (field, doc_id)""",
    "doc_lengths": f"WITH {DOCUMENTS} SELECT field, doc_id, doc_len FROM lens",
    "term_doc_freq": f"WITH {DOCUMENTS} SELECT field, term, df FROM freqs",
    "corpus_stats": f"WITH {DOCUMENTS} SELECT field, n, total_len, round(avgdl, 6) AS avgdl FROM sizes",
    "postings_append": f"""WITH {DOCUMENTS}
SELECT field, term, doc_id, tf, doc_len, df FROM posts JOIN lens USING (field, doc_id) JOIN freqs USING (field, term)""",
    "postings_replaced": f"""WITH {DOCUMENTS}
SELECT field, term, count(*) AS df, 0 AS version FROM posts GROUP BY ALL
UNION ALL SELECT field, term, count(*) AS df, 1 AS version FROM posts WHERE doc_id % 2 = 0 GROUP BY ALL""",
    "postings_upsert": f"""WITH {CHANGED_DOCUMENTS}
SELECT field, term, doc_id, tf, doc_len, df FROM posts JOIN lens USING (field, doc_id) JOIN freqs USING (field, term)""",
    "bm25_after_upsert": f"""WITH {CHANGED_DOCUMENTS}, {_ranked('SELECT item_id AS query_id, text AS query FROM benchmark')}
SELECT query_id, doc_id, _score, rank FROM best WHERE rank <= 5""",
    # keyword search
    "repeated_documents": "SELECT doc_id, 2::BIGINT AS n FROM documents WHERE doc_id % 3 = 0",
    "known_documents": "SELECT doc_id + 7 AS doc_id FROM documents WHERE doc_id + 7 IN (SELECT doc_id FROM documents)",
    "bm25_text_ids": f"""WITH {DOCUMENTS}, {_ranked('SELECT item_id AS query_id, text AS query FROM benchmark')}
SELECT 'q' || query_id AS query_id, doc_id, _score, rank FROM best WHERE rank <= 3
UNION ALL SELECT CASE WHEN query_id % 2 = 0 THEN 'r' || query_id END, doc_id, _score, rank FROM best WHERE rank <= 3""",
    "bm25_many_texts": f"""WITH {DOCUMENTS},
longs AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{{9,}}') AS words FROM documents),
numbered AS (SELECT o_orderkey, o_orderkey % (SELECT count(*) FROM documents) AS doc_id FROM orders), {_ranked("""
  SELECT o_orderkey AS query_id, concat_ws(' ', words[o_orderkey % greatest(len(words), 1) + 1], 'n' || o_orderkey) AS query
  FROM numbered JOIN longs USING (doc_id)""")}
SELECT query_id, doc_id, _score, rank FROM best WHERE rank <= 2""",
    "bm25_top10": f"WITH {BEST_DOCUMENTS} SELECT query_id, doc_id, _score, rank FROM best",
    "bm25_benchmark_top10": f"""WITH {DOCUMENTS}, {_ranked('SELECT item_id AS query_id, text AS query FROM benchmark')}
SELECT query_id, doc_id, _score, rank FROM best""",
    "bm25_bounds_top10": f"""WITH {DOCUMENTS}, {_ranked('SELECT item_id AS query_id, text AS query FROM benchmark')}
SELECT query_id, doc_id, _score, rank FROM best""",
    "match_top10": f"WITH {BEST_DOCUMENTS} SELECT query_id, rank, doc_id FROM best",
    "match_candidates": f"""WITH {BEST_DOCUMENTS}
SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM scores)""",
    "match_bitmap_candidates": f"""WITH {BEST_DOCUMENTS}
SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM scores)""",
    "match_bitmap_counts": f"""WITH {DOCUMENTS}, {_ranked('SELECT item_id AS query_id, text AS query FROM benchmark')}
SELECT query_id, count(*) AS n FROM scores GROUP BY ALL""",
    "query_hit_flag": f"""WITH {BEST_DOCUMENTS}
SELECT query_id, coalesce(n, 0) AS n, n IS NOT NULL AS hit
FROM queries LEFT JOIN (SELECT query_id, count(*) AS n FROM best GROUP BY ALL) USING (query_id)""",
    "top1_description": f"""WITH {_RECORD_SEARCH} {_ranked(_DESCRIPTION_QUERIES, 'id')}
SELECT query_id, query, coalesce(description, '<no result>') AS description
FROM queries LEFT JOIN (SELECT query_id, description FROM best JOIN records USING (id) WHERE rank = 1) USING (query_id)""",
    "queries_without_hits": f"""WITH {BEST_DOCUMENTS}
SELECT query_id, query FROM queries WHERE query_id NOT IN (SELECT query_id FROM best)""",
    "bm25_multifield": f"""WITH {_record_fields(['variety', 'title', 'description'])},
{_ranked("SELECT p_partkey AS query_id, p_type || ' ' || p_name AS query FROM part")}
SELECT query_id, doc_id, _score, rank FROM best""",
    # vector search
    "exact_cosine_top10": f"WITH {EXACT} SELECT query_id, vec_id, _distance, rank FROM nearest",
    "exact_script_score_top10": f"WITH {EXACT} SELECT query_id, vec_id, round(2 - _distance, 6) AS _score, rank FROM nearest",
    "exact_pruned_top10": f"WITH {EXACT} SELECT query_id, vec_id, _distance, rank FROM nearest",
    "document_vector_top10": f"""WITH
{_embedded('SELECT doc_id AS key, text AS body FROM documents', 'docs', 'search_document: ')},
{_embedded(f"SELECT query_id AS key, query AS body FROM ({_values(DOCUMENT_LINES)})", 'asked', 'search_query: ')},
doc_sizes AS (SELECT key, sqrt(sum(value::DOUBLE * value::DOUBLE)) AS size FROM docs GROUP BY ALL),
asked_sizes AS (SELECT key, sqrt(sum(value::DOUBLE * value::DOUBLE)) AS size FROM asked GROUP BY ALL),
dots AS (
  SELECT asked.key AS query_id, docs.key AS doc_id, sum(asked.value::DOUBLE * docs.value::DOUBLE) AS dot
  FROM asked JOIN docs USING (slot) GROUP BY ALL),
near AS (
  SELECT a.key AS query_id, d.key AS doc_id, round(1 - coalesce(dot, 0) / (a.size * d.size), 6) + 0.0 AS _distance
  FROM asked_sizes a CROSS JOIN doc_sizes d LEFT JOIN dots ON dots.query_id = a.key AND dots.doc_id = d.key)
SELECT query_id, doc_id, _distance,
  row_number() OVER (PARTITION BY query_id ORDER BY _distance, doc_id)::INTEGER AS rank FROM near QUALIFY rank <= {K}""",
    "ivf_lloyd_step": f"""WITH {_stepped(SQL_STEPS)}
SELECT part_id, n, slot::INTEGER AS slot, round(value, 6) + 0.0 AS value FROM (
  SELECT part_id, count(*) AS n, slot, avg(x) AS value
  FROM (SELECT part_id, unnest(u) AS x, unnest(range(1, {DIM} + 1)) AS slot FROM stepped) GROUP BY part_id, slot)""",
    "ivf_lloyd_spread": f"""WITH {CENTROIDS},
away AS (SELECT part_id, list_sum(list_transform(range(1, {DIM} + 1), lambda i: (u[i] - c[i]) ** 2)) AS d FROM assigned)
SELECT part_id, round(sum(d), 6) + 0.0 AS spread, round(max(d), 6) + 0.0 AS far_apart FROM away GROUP BY part_id""",
    "pq_words_step": f"""WITH {CODES}
SELECT m, code, count(*) AS n, slot::INTEGER AS slot, round(avg(x), 6) + 0.0 AS value
FROM (SELECT m, code, unnest(p) AS x, unnest(range(1, {SUB_DIM} + 1)) AS slot FROM codes) GROUP BY m, code, slot""",
    "pq_plain_recall_at_10": f"""WITH {QUANTISED},
exact_near AS (SELECT query_id, vec_id, round(1 - list_dot_product(q, u), 6) + 0.0 AS _distance FROM asking, units),
exact AS (SELECT query_id, vec_id FROM exact_near
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY _distance, vec_id) <= {K})
SELECT query_id, round(count(nearest.vec_id) / {K}, 6) AS recall
FROM exact LEFT JOIN nearest USING (query_id, vec_id) GROUP BY ALL""",
    "ivf_plain_assign": f"WITH {CENTROIDS} SELECT vec_id, part_id FROM assigned",
    "ivf_plain_probe": f"WITH {CENTROIDS} SELECT query_id, part_id, probe FROM probes",
    "ivf_plain_flat_top10": f"WITH {FLAT} SELECT query_id, vec_id, _distance, rank FROM nearest",
    "pq_plain_encode": f"WITH {CODES} SELECT vec_id, part_id, m, code FROM codes",
    "ivfpq_plain_top10": f"WITH {QUANTISED} SELECT query_id, vec_id, _distance, rank FROM nearest",
    "ann_plain_recall_at_10": f"""WITH {CENTROIDS}, {_nearest("probes JOIN assigned USING (part_id)", "1 - list_dot_product(q, u)")},
exact_near AS (SELECT query_id, vec_id, round(1 - list_dot_product(q, u), 6) + 0.0 AS _distance FROM asking, units),
exact AS (SELECT query_id, vec_id FROM exact_near
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY _distance, vec_id) <= {K})
SELECT query_id, round(count(nearest.vec_id) / {K}, 6) AS recall
FROM exact LEFT JOIN nearest USING (query_id, vec_id) GROUP BY ALL""",
    # workload and figures
    "sample_queries": f"""WITH {QUERY_LINES},
draws AS (
  SELECT i + 1 AS query_id, ('0x' || substr(md5('37:' || i::VARCHAR), 1, 8))::BIGINT % n + 1 AS place
  FROM range((SELECT count(*) FROM orders)) AS g(i), (SELECT count(*) AS n FROM terms))
SELECT draws.query_id, query FROM draws JOIN terms ON terms.query_id = place""",
    "warmup_queries": f"""WITH {QUERY_LINES},
turns AS (
  SELECT i + 1 AS query_id, i % n + 1 AS place
  FROM range((SELECT count(*) FROM orders)) AS g(i), (SELECT count(*) AS n FROM terms))
SELECT turns.query_id, query FROM turns JOIN terms ON terms.query_id = place""",
    "latency_percentiles": f"WITH {LOG}\n" + " UNION ALL ".join(
        f"SELECT search, {p}::DOUBLE AS p, round(quantile_cont(latency_ms, {p / 100}), 6) AS latency_ms FROM log GROUP BY search"
        for p in (50, 95, 99)),
    "latency_sketches": f"WITH {LOG}\n" + " UNION ALL ".join(
        f"SELECT search, {p}::DOUBLE AS p, count(*) AS n, TRUE AS \"within\" FROM log WHERE latency_ms IS NOT NULL GROUP BY search" for p in (50, 95, 99)),
    "latency_percentiles_null": f"WITH {LOG}\n" + " UNION ALL ".join(
        f"SELECT nullif(search, 'error') AS search, {p}::DOUBLE AS p, round(quantile_cont(latency_ms, {p / 100}), 6) AS latency_ms "
        "FROM log GROUP BY search" for p in (50, 95, 99)),
    "trial_metrics_null": f"""WITH {LOG} SELECT nullif(search, 'error') AS search, trial, round(success, 6) AS success,
  round(p50_ms, 6) AS p50_ms FROM measured""",
    "trial_metrics": f"WITH {LOG} SELECT search, trial, {_rounded()} FROM measured",
    "trial_averages": f"WITH {LOG} SELECT search, runs, {_rounded('_avg')} FROM averaged",
    "report_rows": f"""WITH {LOG}
SELECT search, concat_ws(' | ', '| ' || search, '1000', runs, {_fixed('success_avg', 2)}, {_fixed('elapsed_s_avg', 4)},
  {_fixed('qps_avg', 2)}, {_fixed('p50_ms_avg', 2)}, {_fixed('p95_ms_avg', 2)}, {_fixed('p99_ms_avg', 2)},
  '16', '37', '10 |') AS line FROM averaged""",
}
