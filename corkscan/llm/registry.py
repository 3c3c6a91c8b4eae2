"""The registered queries of these operators and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corkscan.llm import (bag_minhash, bpe, chat, collocations, content_sort, filter_audit, html_text, language, license_scan,
                          secret_scan, templates, toxicity, url_filter)
from corkscan.llm.common import table


def remainder(column: str, of: int) -> Column:
    """crc32 of a number as text, modulo ``of``; -1 for null."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % of, F.lit(-1))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """A model of the labelled documents that are not held out."""
    return toxicity.fit(docs.where(remainder("doc_id", 4) != 2), labels)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    documents = table(spark, sf_dir, "documents")
    model = toxicity_model(documents, table(spark, sf_dir, "labels"))
    scored = toxicity.score(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score",
                         (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate for a secret in every document, and whether it is one; values as digests."""
    found = secret_scan.scan(table(spark, sf_dir, "documents"), remainder("id", 4) != 2)
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "start", "length",
                        F.sha2("value", 256).alias("value_sha256"), "score", "secret")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = html_text.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    documents = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 5) == 0
    filters = language.fit(documents.where(~held_out))
    return language.predict(documents.select("doc_id", held_out.alias("held_out"), "text"), filters).drop("text")


def op5_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near-duplicates."""
    return bag_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document to tokens and back, told by its digests."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode(documents, packed=True, decoded_col="decoded")
    return encoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


# The conversation that op7 formats besides those of the table.
TRICKY_CONVERSATION, TRICKY_TEXT = -7, r"\### Assistant: </turn> ok"


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(F.lit(TRICKY_CONVERSATION).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                   F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                   F.lit(TRICKY_TEXT).alias("text"))
    events = turns.unionByName(tricky).select(
        "conv_id", F.col("turn").alias("seq"), F.lit(chat.MESSAGE).alias("kind"), F.lit(None).alias("message"), "role", "text")
    formatted = chat.render(chat.final_messages(events))
    turns = chat.read_turns(F.col("formatted"))
    told = lambda turn: F.concat(turn["role"], F.lit("\n"), turn["text"], F.lit("\n"))
    back = formatted.select("conv_id", "formatted", turns.alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("learned"))
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", told), ""), 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies among all documents; the largest doc_id of a group stays."""
    return content_sort.find_copies(table(spark, sf_dir, "documents"), keep="largest")


def op9_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item in every document that holds it, also with other values in its slots."""
    return templates.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# The rules of op10 (host, path, verdict).
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on the URL of every page."""
    rules = spark.createDataFrame(URL_RULES, "host STRING, path STRING, verdict STRING")
    judged = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence phrases and notices of every document."""
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", F.col("n_places").alias("n_base"), "first_word", "last_word",
        F.array_join("phrase_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes at each step of all orders, for every language."""
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of every language."""
    found = collocations.collocations(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("part", "lang")


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_secret_scan": op2_secret_scan,
    "op3_html_text": op3_html_text,
    "op4_language": op4_language,
    "op5_bag_minhash": op5_bag_minhash,
    "op6_bpe": op6_bpe,
    "op7_chat": op7_chat,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_templates": op9_templates,
    "op10_url_filter": op10_url_filter,
    "op11_license_scan": op11_license_scan,
    "op12_filter_audit": op12_filter_audit,
    "op13_collocations": op13_collocations,
}

# What the template of op7 makes of a role or text.
_ESCAPED = r"replace(replace(replace(replace({0}, '\', '\\'), '###', '\h'), '</turn>', '\t'), ':' || chr(10), '\n')"
_RULES = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in URL_RULES)

_UNITS = ", ".join(f"'{unit}'" for unit in templates.UNITS)


def _template_tokens(source: str) -> str:
    """(id, vals, toks): the tokens of ``source`` (id, text) as written and as placeholders."""
    return rf"""
        SELECT id, vals, list_transform(vals, lambda v, i: CASE
            WHEN starts_with(v, chr(1)) THEN chr(1) WHEN regexp_matches(v, '^\p{{N}}') THEN chr(2)
            WHEN v IN ({_UNITS}) AND regexp_matches(vals[i - 1], '^\p{{N}}') THEN chr(3) ELSE v END) AS toks
        FROM (SELECT id, regexp_extract_all(lower(regexp_replace(regexp_replace(
                coalesce(text, ''), '(^|[^\p{{L}}])(\p{{Lu}}\p{{Ll}}+)', '\1' || chr(1) || '\2', 'g'),
                '(^|[.!?:\n][^\p{{L}}\p{{N}}\x01]*)\x01', '\1', 'g')), '\x01?\p{{L}}+|\p{{N}}+') AS vals
              FROM ({source}))"""


def _leaks_sql(size: int = templates.WINDOW) -> str:
    last = size - 1
    stretch = "floor((doc_at - item_at + phase * floor(width / 2)) / width)"
    return rf"""
        WITH items AS ({_template_tokens("SELECT item_id AS id, text FROM benchmark")}),
        docs AS ({_template_tokens("SELECT doc_id AS id, text FROM documents")}),
        starts AS (
            SELECT id AS item, len(toks) AS length, item_at, toks[item_at + 1 : item_at + {size}] AS part
            FROM items, range(len(toks) - {last}) AS g(item_at)),
        known AS MATERIALIZED (
            SELECT item, greatest(floor(length / 2), 1) AS width, item_at, part, count(*) OVER (PARTITION BY item) AS item_windows FROM starts
            WHERE len(list_filter(part, lambda t: t NOT IN (chr(1), chr(2), chr(3)))) >= {templates.PLAIN_WORDS}),
        found AS (
            SELECT id, item, item_windows, doc_at, item_at, phase, {stretch} AS stretch
            FROM (SELECT id, doc_at, toks[doc_at + 1 : doc_at + {size}] AS part FROM docs, range(len(toks) - {last}) AS g(doc_at))
            JOIN known USING (part), range(2) AS p(phase)),
        covered AS MATERIALIZED (
            SELECT id, item, phase, stretch, item_windows, count(DISTINCT item_at) AS windows FROM found GROUP BY ALL
            HAVING count(DISTINCT item_at) >= {templates.COVERAGE} * item_windows),
        slots AS (
            SELECT DISTINCT id, item, phase, stretch, doc_at + n AS doc_at, item_at + n AS item_at
            FROM found JOIN covered USING (id, item, phase, stretch), range({size}) AS o(n)),
        turned AS (
            SELECT slots.id, item, phase, stretch, items.toks[item_at + 1] AS kind, items.vals[item_at + 1] AS old, count(*) AS slots,
                   count(DISTINCT docs.vals[doc_at + 1]) AS turned, bool_and(docs.vals[doc_at + 1] = items.vals[item_at + 1]) AS same
            FROM slots JOIN items ON items.id = item JOIN docs ON docs.id = slots.id
            WHERE items.toks[item_at + 1] IN (chr(1), chr(2), chr(3)) GROUP BY ALL),
        checked AS (
            SELECT id, item, phase, stretch, sum(slots) AS slots, max(turned) AS turned, bool_and(same) AS same FROM turned GROUP BY ALL)
        SELECT id AS doc_id, item AS item_id, max(windows) AS windows, max(item_windows)::INTEGER AS item_windows,
               max(coalesce(slots, 0))::BIGINT AS slots, bool_or(coalesce(same, true)) AS same_values, true AS evidence
        FROM covered LEFT JOIN checked USING (id, item, phase, stretch) WHERE coalesce(turned, 1) <= 1 GROUP BY id, item"""


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_LICENCE_WORDS = r"regexp_extract_all(translate(coalesce({0}, ''), {1}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _licences_sql() -> str:
    rows = [(label, text, True) for text, label in license_scan.PHRASES] + [(label, text, False) for label, text in license_scan.NOTICES]
    values = ", ".join(f"({at}, {_quoted(label)}, {_quoted(text)}, {phrase})" for at, (label, text, phrase) in enumerate(rows))
    return rf"""
        WITH given(template, label, text, phrase) AS (VALUES {values}),
        templates AS (
            SELECT template, label, phrase, words, len(list_distinct(words)) AS size,
                   CASE WHEN phrase THEN len(list_distinct(words)) ELSE ceil(round({license_scan.CONTAINMENT} * len(list_distinct(words)), 9)) END AS needed,
                   greatest({license_scan.LEAST_WIDTH}, (2 ** ceil(log2(len(words))))::BIGINT)::BIGINT AS width
            FROM (SELECT *, {_LICENCE_WORDS.format("text", _AZ)} AS words FROM given)),
        entries AS (SELECT template, unnest(list_distinct(words)) AS word, size, needed, width FROM templates),
        docs AS MATERIALIZED (SELECT doc_id, {_LICENCE_WORDS.format("text", _AZ)} AS words FROM documents),
        places AS MATERIALIZED (
            SELECT doc_id, spot - 1 AS spot, word FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS spot FROM docs)
            WHERE word IN (SELECT word FROM entries)),
        phrases AS (
            SELECT docs.doc_id, label, p.spot FROM templates JOIN places p ON p.word = templates.words[1] JOIN docs USING (doc_id)
            WHERE phrase AND docs.words[p.spot + 1 : p.spot + len(templates.words)] = templates.words),
        notices AS (
            SELECT doc_id, template, count(DISTINCT word) AS common FROM (
                SELECT doc_id, template, word, spot // width - back AS block, needed FROM places JOIN entries USING (word), range(2) AS b(back))
            WHERE block >= 0 GROUP BY doc_id, template, block HAVING count(DISTINCT word) >= any_value(needed)),
        labelled AS (
            SELECT doc_id, label, 1.0 AS score FROM phrases
            UNION ALL SELECT doc_id, label, common / size FROM notices JOIN templates USING (template) WHERE NOT phrase),
        base AS (
            SELECT doc_id, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word,
                   array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels FROM phrases GROUP BY doc_id),
        every AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(score) AS score FROM labelled GROUP BY doc_id)
        SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
               coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
        FROM docs LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id)"""


def _audit_sql() -> str:
    bits = ", ".join(f"('{letter}', {1 << at})" for at, letter in enumerate(filter_audit.FILTERS))
    return rf"""
        WITH texts AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        failed AS (
            SELECT doc_id, part,
                   (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
                   + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::INT
                   + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask
            FROM texts),
        known AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
        kinds AS (
            SELECT part, mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
            FROM failed LEFT JOIN known USING (doc_id) GROUP BY ALL),
        filters(letter, bit) AS (VALUES {bits}),
        orders AS (
            SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
            FROM filters a, filters b, filters c, filters d, filters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
            AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
        steps AS (
            SELECT filter_order, step::INT AS step, bits[step] AS bit, list_sum(list_concat([0], bits[1 : step - 1]))::INT AS before
            FROM orders, range(1, 6) AS s(step)),
        counted AS (
            SELECT part, filter_order, step, bit,
                   sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
                   sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
                   sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
                   sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
                   sum(CASE WHEN good AND mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS good_lost,
                   sum(CASE WHEN toxic AND mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS toxic_lost
            FROM kinds, steps GROUP BY ALL)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
        FROM counted"""


def _collocations_sql(least: int = 100, most: int = 2000) -> str:
    places = " UNION ALL ".join(
        f"SELECT lang, words[spot : spot + {k - 1}] AS phrase FROM pieces, range(1, len(words) - {k - 2}) AS g(spot)" for k in range(1, 6))
    return rf"""
        WITH pieces AS MATERIALIZED (
            SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words
            FROM (SELECT coalesce(lang, 'und') AS lang,
                         unnest(string_split_regex(translate(coalesce(text, ''), {_AZ}), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
        counts AS MATERIALIZED (SELECT lang, phrase, count(*) AS f FROM ({places}) GROUP BY lang, phrase HAVING count(*) >= {least}),
        totals AS (SELECT lang, sum(len(words)) AS n FROM pieces GROUP BY lang),
        candidates AS MATERIALIZED (SELECT lang, phrase, f FROM counts WHERE len(phrase) > 1),
        inside AS (
            SELECT lang, phrase[s : s + size - 1] AS phrase, f FROM candidates, range(2, 5) AS z(size), range(1, 5) AS g(s)
            WHERE size < len(phrase) AND s + size - 1 <= len(phrase)),
        stay AS (
            SELECT * FROM candidates c WHERE NOT EXISTS (
                SELECT 1 FROM inside i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.f >= 100 * c.f)),
        cuts AS (
            SELECT stay.lang, stay.phrase, stay.f AS a, k, lefts.f AS l, rights.f AS r, n::BIGINT AS n,
                   (1000::HUGEINT * stay.f * n) // (lefts.f::HUGEINT * rights.f) AS score
            FROM stay, range(1, 5) AS c(k)
            JOIN counts lefts ON lefts.lang = stay.lang AND lefts.phrase = stay.phrase[1 : k]
            JOIN counts rights ON rights.lang = stay.lang AND rights.phrase = stay.phrase[k + 1 :]
            JOIN totals ON totals.lang = stay.lang WHERE k < len(stay.phrase)),
        least AS (
            SELECT lang, array_to_string(phrase, ' ') AS phrase, a, l, r, n, score::BIGINT AS score FROM cuts
            QUALIFY row_number() OVER (PARTITION BY lang, cuts.phrase ORDER BY score, k) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM least
        QUALIFY rank <= {most}"""


ORACLE = {
    "op11_license_scan": _licences_sql(),
    "op12_filter_audit": _audit_sql(),
    "op13_collocations": _collocations_sql(),
    "op9_templates": _leaks_sql(),
    "op7_chat": rf"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '{TRICKY_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{TRICKY_TEXT}'),
        whole AS (
            SELECT conv_id, count(*) AS n_turns,
                   string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS every,
                   coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS learned,
                   sum(length('### ' || {_ESCAPED.format("role")} || ':' || chr(10) || {_ESCAPED.format("text")} || '</turn>' || chr(10)))
                       AS formatted_chars
            FROM turns GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(every) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256,
               formatted_chars::BIGINT AS formatted_chars
        FROM whole""",
    "op10_url_filter": rf"""
        WITH rests AS (
            SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parts AS (
            SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM rests),
        lowered AS (
            SELECT page_id, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts),
        rules(rule_host, rule_path, rule_verdict) AS (VALUES {_RULES}),
        fitting AS (
            SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
                   arg_max(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
            FROM lowered JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
            GROUP BY page_id)
        SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM lowered LEFT JOIN fitting USING (page_id)""",
    "op8_exact_dedup": """
        WITH d AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS n
            FROM documents)
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(n) AS text_sha256
        FROM d WINDOW same AS (PARTITION BY n)""",
}
