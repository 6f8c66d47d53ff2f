"""Equivalent SQL for the query catalogue, for an engine that shares only its hashes with Spark."""

from __future__ import annotations

from collections.abc import Sequence

from ..fixed_values import ERROR_KEYWORDS
from ..functions import text as tx
from ..functions import wordlists as wl
from ..operators import mask, personal, vary
from ..operators.anonymize import consistent_key
from .queries import FORBIDDEN, KEYWORDS, MASK_RULES, THESAURUS


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values: Sequence[str]) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


def number(base: str, digits: int = 8) -> str:
    return f"(('0x' || substr(md5({base}), 1, {digits}))::BIGINT)"


def pick(values: Sequence[str], base: str) -> str:
    return f"{listed(values)}[1 + ({number(base)} % {len(values)})::INT]"


def digits(base: str, n: int) -> str:
    return f"lpad(({number(base, 15)} % {10 ** n})::VARCHAR, {n}, '0')"


def draw(base: str, *more: object) -> str:
    return base + "".join(f" || ':{m}'" for m in more)


def ranged(base: str, low: int, high: int) -> str:
    return f"(({number(base)} % {high - low + 1}) + {low})::VARCHAR"


def uuid4(base: str) -> str:
    return (f"(substr(md5({base}), 1, 8) || '-' || substr(md5({base}), 9, 4) || '-4' || substr(md5({base}), 14, 3) || '-' || "
            f"substr('89ab', 1 + ({number(draw(base, 'variant'))} % 4)::INT, 1) || substr(md5({base}), 18, 3) || '-' || "
            f"substr(md5({base}), 21, 12))")


def first_name(base: str) -> str:
    return pick(wl.FIRST_NAMES_FEMALE + wl.FIRST_NAMES_MALE, draw(base, "first"))


def full_name(base: str) -> str:
    return f"({first_name(base)} || ' ' || {pick(wl.LAST_NAMES, draw(base, 'last'))})"


def email(base: str) -> str:
    return (f"(lower({first_name(base)}) || '.' || lower({pick(wl.LAST_NAMES, draw(base, 'last'))}) || "
            f"{digits(draw(base, 'user', 0), 2)} || '@' || {pick(wl.MAIL_DOMAINS, draw(base, 'domain'))})")


def phone(base: str) -> str:
    return f"('(' || {digits(draw(base, 'p', 1), 3)} || ') 555-' || {digits(draw(base, 'p', 3), 4)})"


def address(base: str) -> str:
    return (f"({digits(draw(base, 'house', 0), 3)} || ' ' || {pick(wl.STREETS, draw(base, 'street'))} || ' ' || "
            f"{pick(wl.STREET_SUFFIXES, draw(base, 'suffix'))} || ', ' || {pick(wl.CITIES, draw(base, 'city'))} || ', ' || "
            f"{pick(wl.STATE_ABBREVIATIONS, draw(base, 'state'))} || ' ' || {digits(draw(base, 'zip', 0), 5)})")


def ipv4(base: str) -> str:
    return "(" + " || '.' || ".join(ranged(draw(base, f"octet{i}"), 0, 255) for i in range(4)) + ")"


def ssn(base: str) -> str:
    return (f"({digits(draw(base, 'p', 0), 3)} || '-' || {digits(draw(base, 'p', 2), 2)} || '-' || "
            f"{digits(draw(base, 'p', 4), 4)})")


def birthday(base: str) -> str:
    return f"strftime(DATE '1940-01-01' + ({number(draw(base, 'day'))} % 25000)::INT, '%Y-%m-%d')"


def card(base: str) -> str:
    body = f"('4' || {digits(draw(base, 'a'), 7)} || {digits(draw(base, 'b'), 7)})"
    terms = []
    for i in range(1, 16):
        digit = f"substr({body}, {i}, 1)::INT"
        terms.append(f"(CASE WHEN {digit} * 2 > 9 THEN {digit} * 2 - 9 ELSE {digit} * 2 END)" if i % 2 else digit)
    return f"({body} || ((10 - ({' + '.join(terms)}) % 10) % 10)::VARCHAR)"


def profile_sql(relation: str, fields: dict[str, str], lengths: bool) -> str:
    parts = []
    for field, label in fields.items():
        mean = (f"round(avg(coalesce(length({field}), 0)), 4)" if label == "string" else "NULL::DOUBLE")
        parts.append(
            f"SELECT '{field}' AS field, count(*) AS record_count, count({field}) AS present, "
            f"count(*) - count({field}) AS missing, CASE WHEN count({field}) > 0 THEN '{label}' END AS type"
            + (f", {mean} AS mean_length" if lengths else "") + f" FROM {relation}")
    return " UNION ALL ".join(parts)


def top_sql(relation: str, fields: Sequence[str], k: int = 5) -> str:
    return " UNION ALL ".join(
        f"(SELECT '{f}' AS field, {f} AS value, count(*) AS n, "
        f"row_number() OVER (ORDER BY count(*) DESC, {f}) AS rank FROM {relation} WHERE {f} IS NOT NULL "
        f"GROUP BY {f} QUALIFY rank <= {k})" for f in fields)


LABELLED = "(SELECT * FROM documents LEFT JOIN labels USING (doc_id))"
PAIRS = ("(SELECT u.conv_id, u.turn, u.text AS ask, a.text AS reply FROM conversations u LEFT JOIN conversations a "
         "ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')")
LABEL_KEYS = "CASE WHEN quality IS NULL THEN 'doc_id,lang,source' ELSE 'doc_id,lang,quality,source,toxic' END"
CODE_TYPE = "CASE event_type WHEN 'signup' THEN 'string' WHEN 'error' THEN NULL ELSE 'number' END"
CODE_TEXT = "CASE event_type WHEN 'signup' THEN '\"u' || user_id || '\"' WHEN 'error' THEN 'null' ELSE user_id::VARCHAR END"
FIRST = "row_number() OVER (PARTITION BY {0} ORDER BY {1})"
TOKENS = f"regexp_extract_all(text, '{tx.TOKEN}')"
WORDS = f"regexp_extract_all(text, '{tx.WORD_OR_MARK}')"


def lines_sql(relation: str, id: str, text: str) -> str:
    """One row per line: ``id, line_no, line``."""
    return (f"(SELECT {id}, generate_subscripts(ls, 1) AS line_no, unnest(ls) AS line FROM (SELECT {id}, "
            f"string_split_regex(regexp_replace({text}, '\\r?\\n\\z', ''), '\\r?\\n') AS ls FROM {relation} WHERE {text} <> ''))")


def first_keyword(keywords: Sequence[str]) -> str:
    cases = " ".join(f"WHEN contains(lower(line), {quoted(k)}) THEN {quoted(k)}" for k in keywords)
    return f"CASE {cases} END"


def hits_sql(relation: str, id: str, text: str, keywords: Sequence[str]) -> str:
    return (f"(SELECT * FROM (SELECT {id}, line_no::INT AS line_no, {first_keyword(keywords)} AS keyword, line "
            f"FROM {lines_sql(relation, id, text)}) WHERE keyword IS NOT NULL)")


def stripped(column: str) -> str:
    return f"regexp_replace({column}, '{tx.STRIP}', '', 'g')"


def finding(key: str, field: str, rule: str, value: str, detail: str, relation: str, condition: str) -> str:
    message = f"Field ''{field}'' breaks rule {rule}{' ' + detail.replace(chr(39), chr(39) * 2) if detail else ''}"
    return (f"SELECT {key} AS row_key, '{field}' AS field, '{rule}' AS rule, {value} AS value, "
            f"'{message}' AS message FROM {relation} WHERE {condition}")


def shuffled_sql(copies: int, keep: int) -> str:
    base = "doc_id || ':shuffle:42:' || copy_no || ':text:'"
    middle = (f"list_transform(list_sort(list_transform(range({keep}, n - {keep}), lambda p: "
              f"struct_pack(h := md5({base} || (p - {keep})), i := p, v := words[p + 1]))), lambda s: s.v)")
    mixed = (f"list_concat(list_concat(words[1:{keep}], {middle}), words[n - {keep - 1}:n])" if keep else middle)
    return (f"WITH c AS (SELECT doc_id, text, copy_no::INT AS copy_no, {TOKENS} AS words FROM documents, range({copies}) t(copy_no)), "
            f"d AS (SELECT *, len(words) AS n FROM c) "
            f"SELECT doc_id, CASE WHEN copy_no = 0 OR n <= {max(3, 2 * keep + 2)} THEN text ELSE array_to_string({mixed}, ' ') END AS text, "
            f"copy_no, CASE WHEN copy_no > 0 THEN 'shuffle' END AS method FROM d")


def _message_shuffle(column: str, i: int) -> str:
    words = f"regexp_extract_all({column}, '{tx.TOKEN}')"
    base = f"pair || ':shuffle:42:' || copy_no || ':messages:{i}:content:'"
    middle = (f"list_transform(list_sort(list_transform(range(2, len({words}) - 2), lambda p: "
              f"struct_pack(h := md5({base} || (p - 2)), i := p, v := {words}[p + 1]))), lambda s: s.v)")
    return (f"CASE WHEN {column} IS NULL OR copy_no = 0 OR len({words}) <= 6 THEN {column} ELSE array_to_string(list_concat(list_concat("
            f"{words}[1:2], {middle}), {words}[len({words}) - 1:len({words})]), ' ') END")


def synonym_sql(choices: str, prelude: str = "") -> str:
    """``choices`` is the synonym list of word ``w``."""
    base = "doc_id || ':synonym:42:1:text:' || (p - 1)"
    drawn = f"{number(base)} / 4294967296.0 < 0.2"
    return (f"WITH {prelude} t AS (SELECT doc_id, generate_subscripts(ws, 1) AS p, unnest(ws) AS w FROM "
            f"(SELECT doc_id, {WORDS} AS ws FROM documents WHERE len({TOKENS}) > 3)), "
            f"r AS (SELECT doc_id, p, CASE WHEN {drawn} AND s IS NOT NULL THEN "
            f"s[1 + ({number(base + chr(32) + '|| ' + quoted(':which'))} % len(s))::INT] ELSE w END AS w FROM {choices}), "
            f"j AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS new FROM r GROUP BY doc_id) "
            f"SELECT doc_id, text, 0 AS copy_no, NULL AS method FROM documents UNION ALL "
            f"SELECT doc_id, coalesce(new, text), 1, 'synonym' FROM documents LEFT JOIN j USING (doc_id)")


def split_sql(relation: str, key: str, train: float, valid: float, test: float, seed: int) -> str:
    """Rank by hash; the held-out rows come first, test before validation."""
    return (f"SELECT {key}, CASE WHEN r <= t THEN 'test' WHEN r <= rest THEN 'valid' ELSE 'train' END AS split FROM ("
            f"SELECT *, ceil(rest * (1.0::DOUBLE - {valid}::DOUBLE / ({valid}::DOUBLE + {test}::DOUBLE))) AS t FROM ("
            f"SELECT {key}, row_number() OVER (ORDER BY md5({key} || ':split:{seed}')) AS r, "
            f"ceil(count(*) OVER () * (1.0::DOUBLE - {train}::DOUBLE)) AS rest FROM {relation}))")


_docs_fields = {"doc_id": "number", "text": "string", "lang": "string", "source": "string", "n_chars": "number",
                "quality": "number", "toxic": "number"}
_orders_fields = {"o_orderkey": "number", "o_custkey": "number", "o_orderstatus": "string", "o_totalprice": "number",
                  "o_orderdate": "unknown", "o_orderpriority": "string"}
_part_fields = {"p_partkey": "number", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "number",
                "p_retailprice": "number"}
_lineitem_fields = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                    "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
_numeric = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_context = (f"SELECT h.doc_id, h.line_no AS hit_line, h.keyword, l.line_no::INT AS line_no, l.line, l.line_no = h.line_no AS is_hit "
            f"FROM {hits_sql('documents', 'doc_id', 'text', KEYWORDS)} h JOIN {lines_sql('documents', 'doc_id', 'text')} l "
            f"ON h.doc_id = l.doc_id AND l.line_no BETWEEN h.line_no - 2 AND h.line_no + 2")
_log = (
    f"SELECT doc_id AS row_key, 'prompt' AS field, 'empty template field auto-filled' AS action FROM {LABELLED} "
    f"WHERE lang IS NULL OR NOT regexp_matches(lang, '[^{tx.WS}]') "
    f"UNION ALL SELECT doc_id, 'completion', 'empty template field auto-filled' FROM {LABELLED} WHERE quality IS NULL ")
_same_code = f"(SELECT event_id, {FIRST.format('event_type, CASE WHEN event_type <> ' + quoted('error') + ' THEN user_id END', 'event_id')} AS rn, event_type, user_id FROM events)"
_thesaurus_case = "CASE lower(w) " + " ".join(f"WHEN {quoted(w)} THEN {listed(s)}" for w, s in THESAURUS.items()) + " END"
_keyed = f"sha256({quoted(consistent_key('s', 'name'))} || source)"
_pseudonym = f"{full_name(_keyed)} || '-' || substr({_keyed}, 1, 24)"
_types = ("email", "phone", "address", "ip", "ssn", "credit_card", "dob")
_makers = {"email": email, "phone": phone, "address": address, "ip": ipv4, "ssn": ssn, "credit_card": card, "dob": birthday}
_hyg = {
    "oversize": "strlen(text) > 8192",
    "trailing_space": f"regexp_matches(text, '[{tx.INLINE_WS}](\\r?\\n|\\z)')",
    "byte_order_mark": "starts_with(text, chr(65279))",
    "no_final_newline": "NOT ends_with(text, chr(10))",
    "control_characters": "regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]')",
}
_forbidden = " UNION ALL ".join(
    f"SELECT doc_id, line_no::INT AS line_no, {quoted(k)} AS keyword FROM {lines_sql('documents', 'doc_id', 'text')} "
    f"WHERE regexp_matches(line, {quoted('(?i)' + k)})" for k in FORBIDDEN)
_forbidden2 = " + ".join(f"regexp_matches(line, '(?i){k}')::INT" for k in ("license", "token"))

ORACLE: dict[str, str] = {
    # projections
    "template_alpaca": f"SELECT doc_id, source AS instruction, lang AS input, text AS output FROM documents QUALIFY {FIRST.format('text', 'doc_id')} = 1",
    "template_instruction": f"SELECT conv_id, turn, ask AS prompt, reply AS completion FROM {PAIRS}",
    "template_qa": f"SELECT doc_id, text AS question, quality::VARCHAR AS answer FROM {LABELLED}",
    "template_llama": "SELECT doc_id, text FROM documents",
    "template_mistral": f"SELECT conv_id, turn, ask AS instruction, '' AS response FROM {PAIRS}",
    "template_anthropic": f"SELECT conv_id, turn, ask AS input, reply AS output FROM {PAIRS}",
    "template_chat": f"SELECT conv_id, turn, 2 AS n_messages, 'user' AS role_0, 'assistant' AS role_1, ask AS content_0, reply AS content_1 FROM {PAIRS}",
    "template_openai": f"SELECT conv_id, turn, 3 AS n_messages, '' AS role_0, '' AS role_1, '' AS role_2, '' AS content_0, ask AS content_1, reply AS content_2 FROM {PAIRS}",
    "template_custom": "SELECT event_id::VARCHAR AS id, 'event' AS kind, 'who' AS name_0, user_id::VARCHAR AS value_0, 'what' AS name_1, event_type AS value_1 FROM events",
    "nested_path": "SELECT event_id, json_extract_string(props, '$.k') AS question, '' AS answer FROM events",
    "nested_list_path": "SELECT doc_id, coalesce(w[2], '') AS question, coalesce(w[1001], '') AS answer FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)",
    "nested_write": "SELECT event_id, json_extract_string(props, '$.k')::BIGINT + 1 AS k, 'log' AS kind FROM events",
    "input_paths": " UNION ALL ".join(
        f"SELECT '{p}' AS path, count({c}) AS n FROM {LABELLED}" for p, c in (
            ("item", "*"), ("item.doc_id", "doc_id"), ("item.label", "*"), ("item.label.quality", "quality"),
            ("item.label.toxic", "toxic"), ("item.tags", "*"), ("item.tags.lang", "lang"), ("item.tags.source", "source"))),
    "input_keys": f"SELECT DISTINCT unnest(string_split({LABEL_KEYS}, ',')) AS field FROM {LABELLED}",
    "preview": f"SELECT doc_id::VARCHAR AS doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(n_chars::VARCHAR, '') AS n_chars, coalesce(quality::VARCHAR, '') AS quality, coalesce(toxic::VARCHAR, '') AS toxic FROM (SELECT * FROM {LABELLED} ORDER BY doc_id LIMIT 100)",
    # profile
    "profile_orders": profile_sql("orders", _orders_fields, True),
    "profile_missing": profile_sql(LABELLED, _docs_fields, False),
    "profile_null_counts": " UNION ALL ".join(f"(SELECT '{f}' AS field, count(*) - count({f}) AS missing FROM {LABELLED} HAVING missing > 0)" for f in _docs_fields),
    "profile_mean_length": " UNION ALL ".join(f"SELECT '{f}' AS field, round(avg(coalesce(length({f}), 0)), 4) AS mean_length FROM documents" for f in ("text", "lang", "source")),
    "profile_records": (
        "SELECT 'code' AS field, count(*) AS record_count, count(*) AS present, count(*) FILTER (event_type = 'error') AS missing, "
        f"min_by({CODE_TYPE}, event_id) FILTER (event_type <> 'error') AS type FROM events "
        "UNION ALL SELECT 'type', count(*), count(*), 0, 'string' FROM events"),
    "profile_records_null_only": " UNION ALL ".join(
        f"SELECT '{f}' AS field, count(*) AS record_count, count({f}) AS present, 0 AS missing, '{t}' AS type FROM {LABELLED}"
        for f, t in (("doc_id", "number"), ("lang", "string"), ("source", "string"), ("quality", "number"), ("toxic", "number"))),
    "profile_top_values": top_sql("orders", ("o_orderstatus", "o_orderpriority")),
    "profile_top_texts": top_sql("documents", ("text", "lang", "source")),
    "value_counts_top10": "SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 10",
    "histogram": (
        "WITH e AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem), b AS (SELECT least(floor((l_quantity - lo) / ((hi - lo) / 10)), 9)::INT AS bin, lo, hi FROM lineitem, e) "
        "SELECT bin, round(lo + bin * ((hi - lo) / 10), 6) AS low, round(lo + (bin + 1) * ((hi - lo) / 10), 6) AS high, count(*) AS n FROM b GROUP BY bin, lo, hi"),
    "missing_patterns": f"SELECT concat_ws(',', {', '.join(f'CASE WHEN {f} IS NULL THEN {quoted(f)} END' for f in _docs_fields)}) AS missing_fields, count(*) AS n FROM {LABELLED} GROUP BY 1",
    "unique_counts": " UNION ALL ".join(f"SELECT '{f}' AS field, count(DISTINCT {f}) AS unique_count FROM lineitem" for f in _lineitem_fields),
    "correlation": " UNION ALL ".join(
        f"SELECT '{a}' AS field_a, '{b}' AS field_b, round(corr({a}, {b}), 6) AS correlation FROM lineitem"
        for i, a in enumerate(_numeric) for b in _numeric[i + 1:]),
    # duplicates and drift
    "dup_flags": f"SELECT doc_id, {FIRST.format('text', 'doc_id')} > 1 AS is_duplicate FROM documents",
    "dup_count": "SELECT count(*) AS record_count, count(DISTINCT text) AS distinct_count, count(*) - count(DISTINCT text) AS duplicate_count FROM documents",
    "dup_groups": "SELECT min(doc_id) AS first_key, count(*) AS n FROM documents GROUP BY text HAVING n > 1",
    "dedup_exact": f"SELECT * FROM documents QUALIFY {FIRST.format('text', 'doc_id')} = 1",
    "dedup_records": f"SELECT doc_id, lang, quality, toxic FROM {LABELLED} QUALIFY {FIRST.format('lang, quality, toxic', 'doc_id')} = 1",
    "field_drift": f"SELECT doc_id AS row_key, {LABEL_KEYS} AS fields FROM {LABELLED} WHERE fields <> (SELECT min_by({LABEL_KEYS}, doc_id) FROM {LABELLED})",
    "validate_records": f"SELECT event_id AS row_key, 'Duplicate record found.' AS message FROM {_same_code} WHERE rn > 1",
    "type_counts": (
        f"WITH c AS (SELECT 'code' AS field, {CODE_TYPE} AS type, count(*) AS n FROM events WHERE type IS NOT NULL GROUP BY 1, 2) "
        "SELECT field, type, n, (SELECT count(*) FROM c) AS types FROM c UNION ALL SELECT 'type', 'string', count(*), 1 FROM events"),
    "type_conflicts": f"SELECT event_id AS row_key, 'code' AS field, {CODE_TYPE} AS type, {CODE_TEXT} AS value FROM events WHERE type <> (SELECT t FROM (SELECT {CODE_TYPE} AS t FROM events) WHERE t IS NOT NULL GROUP BY t ORDER BY count(*) DESC, t DESC LIMIT 1)",
    "not_objects": "SELECT event_id AS row_key, 'number' AS type FROM events WHERE event_type = 'error'",
    # rules
    "rule_required": " UNION ALL ".join(
        finding("doc_id", f, "Required", f"{f}::VARCHAR", "", LABELLED, f"{f} IS NULL" + (f" OR NOT regexp_matches({f}, '[^{tx.WS}]')" if f in ("text", "lang", "source") else ""))
        for f in ("text", "lang", "source", "n_chars", "quality", "toxic")),
    "rule_type": finding("c_custkey", "c_acctbal", "Type Check", "c_acctbal::VARCHAR", "boolean", "customer", "c_acctbal IS NOT NULL"),
    "rule_type_variant": finding("event_id", "code", "Type Check", "'\"u' || user_id || '\"'", "number", "events", "event_type = 'signup'"),
    "rule_regex": finding("p_partkey", "p_name", "Regex Match", "p_name", "^[a-m].*(t|g)$", "part", "NOT regexp_matches(p_name, '^[a-m].*(t|g)$')"),
    "rule_length": finding("doc_id", "text", "Min Length", "text", "500", "documents", "length(text) < 500") + " UNION ALL " + finding("doc_id", "text", "Max Length", "text", "5000", "documents", "length(text) > 5000"),
    "rule_value": finding("l_orderkey", "l_linenumber", "Min Value", "l_linenumber::VARCHAR", "2", "lineitem", "l_linenumber < 2") + " UNION ALL " + finding("l_orderkey", "l_linenumber", "Max Value", "l_linenumber::VARCHAR", "6", "lineitem", "l_linenumber > 6"),
    "rule_custom": finding("event_id", "event_type", "Custom Python", "event_type", "x IN ('view', 'click', 'purchase')", "events", "event_type NOT IN ('view', 'click', 'purchase')") + " UNION ALL " + finding("event_id", "user_id", "Custom Python", "user_id::VARCHAR", "", "events", "user_id <= 20"),
    "validation_report": " UNION ALL ".join(
        [f"SELECT doc_id AS row_key, '{f}' AS field, 'missing' AS rule, {f}::VARCHAR AS value, 'Field ''{f}'' has no value' AS message FROM {LABELLED} WHERE {f} IS NULL"
         + (f" OR NOT regexp_matches({f}, '[^{tx.WS}]')" if f in ("text", "lang", "source") else "") for f in _docs_fields if f != "doc_id"]
        + [f"SELECT doc_id, NULL, 'duplicate', NULL, 'Duplicate record found.' FROM (SELECT doc_id, {FIRST.format('text, lang, source, n_chars, quality, toxic', 'doc_id')} AS rn FROM {LABELLED}) WHERE rn > 1",
           finding("doc_id", "lang", "Regex Match", "lang", "^(en|de)$", LABELLED, "lang NOT IN ('en', 'de')")]),
    "validation_summary": (
        "SELECT 'event_type' AS field, 'Custom Python' AS rule, count(*) AS n FROM events WHERE event_type NOT IN ('view', 'click', 'purchase') "
        f"UNION ALL SELECT 'code', 'type', count(*) FROM events WHERE {CODE_TYPE} <> (SELECT t FROM (SELECT {CODE_TYPE} AS t FROM events) WHERE t IS NOT NULL GROUP BY t ORDER BY count(*) DESC, t DESC LIMIT 1) "
        f"UNION ALL SELECT NULL, 'duplicate', count(*) FROM {_same_code} WHERE rn > 1 "
        "UNION ALL SELECT 'code', 'missing', count(*) FROM events WHERE event_type = 'error'"),
    "template_conformance": _log,
    # edit
    "search_filter": "SELECT * FROM customer WHERE contains(lower(concat_ws(chr(1), c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment)), 'machine')",
    "delete_keys": "SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "patch_cells": "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 0 THEN 'ARREARS' ELSE c_mktsegment END AS c_mktsegment FROM customer",
    "append_record": "SELECT * FROM supplier UNION ALL SELECT -1, 'New', NULL, NULL",
    "bulk_edit": "SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 0.0 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderstatus = 'F' THEN 'DONE' ELSE o_orderpriority END AS o_orderpriority FROM orders",
    "row_numbers": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS row_number FROM documents",
    # repair
    "repair_nulls": f"SELECT doc_id, text, lang, source, n_chars, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic, '' AS question, '' AS answer FROM {LABELLED}",
    "repair_template": f"SELECT doc_id, CASE WHEN regexp_matches(lang, '[^{tx.WS}]') THEN lang ELSE '<AUTO_FILLED_prompt>' END AS prompt, coalesce(quality::VARCHAR, '<AUTO_FILLED_completion>') AS completion, coalesce(toxic, 0) AS toxic FROM {LABELLED}",
    "repair_log": _log + f"UNION ALL SELECT doc_id, 'toxic', 'null filled with empty value' FROM {LABELLED} WHERE toxic IS NULL",
    "repair_count": f"SELECT count(*) AS record_count, count(*) FILTER (quality IS NULL OR toxic IS NULL) AS repaired_count, sum((quality IS NULL)::INT + (toxic IS NULL)::INT)::BIGINT AS action_count FROM {LABELLED}",
    "repair_chat": (
        "SELECT doc_id, CASE WHEN quality = 0 THEN 1 ELSE 2 END AS n_messages, CASE WHEN quality = 0 THEN NULL ELSE 'user' END AS role_0, "
        "CASE WHEN quality = 0 THEN NULL ELSE lang END AS content_0, CASE WHEN quality = 0 THEN NULL WHEN quality = 1 THEN 'assistant' ELSE '<AUTO_FILLED_role>' END AS role_1, "
        "CASE WHEN quality = 0 THEN NULL WHEN quality = 1 THEN '1' ELSE '<AUTO_FILLED_content>' END AS content_1, "
        f"source || '|' || coalesce(toxic::VARCHAR, '') AS tags, CASE WHEN toxic = 1 THEN 'x' END AS notes FROM {LABELLED}"),
    "repair_chat_log": (
        f"SELECT doc_id AS row_key, 'messages' AS field, 'missing list created' AS action FROM {LABELLED} WHERE quality = 0 "
        f"UNION ALL SELECT doc_id, 'messages', 'missing list element added' FROM {LABELLED} WHERE quality IS NULL "
        f"UNION ALL SELECT doc_id, 'messages[1].role', 'empty template field auto-filled' FROM {LABELLED} WHERE quality IS NULL "
        f"UNION ALL SELECT doc_id, 'messages[1].content', 'empty template field auto-filled' FROM {LABELLED} WHERE quality IS NULL "
        f"UNION ALL SELECT doc_id, 'tags[1]', 'null list item filled' FROM {LABELLED} WHERE toxic IS NULL "
        f"UNION ALL SELECT doc_id, 'notes', 'empty container removed' FROM {LABELLED} WHERE toxic IS DISTINCT FROM 1"),
    # augment
    "augment_count": "SELECT count(*) * 3 AS record_count, count(*) AS original_count, count(*) * 2 AS new_count FROM documents",
    "augment_shuffle": shuffled_sql(3, 2),
    "augment_shuffle_all": shuffled_sql(2, 0),
    "augment_synonym": synonym_sql(f"(SELECT *, {_thesaurus_case} AS s FROM t)"),
    "augment_synonym_table": synonym_sql(
        "(SELECT t.*, th.s FROM t LEFT JOIN th ON lower(t.w) = th.word)",
        "th AS (SELECT word, [upper(word), word || 's'] AS s FROM (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS word FROM conversations) WHERE regexp_full_match(word, '[a-z]{3,6}')),"),
    "augment_rephrase": (
        f"WITH d AS (SELECT *, len({TOKENS}) AS n, item_id || ':rephrase:42:1:text' AS base FROM benchmark), "
        f"s AS (SELECT *, list_transform(range(1, {number('base || ' + quoted(':sentences'))} % 3 + 2), lambda k: "
        f"list_transform(range(1, {number('base || ' + quoted(':length:') + ' || k')} % 11 + 6), lambda i: "
        f"{pick(wl.FILLER_WORDS, 'base || ' + quoted(':word:') + ' || k || ' + quoted(':') + ' || i')})) AS long, "
        f"list_transform(range(1, n + 1), lambda i: {pick(wl.FILLER_WORDS, 'base || ' + quoted(':word:') + ' || i')}) AS short FROM d) "
        "SELECT item_id, text, 0 AS copy_no, NULL AS method FROM benchmark UNION ALL "
        "SELECT item_id, CASE WHEN n <= 3 THEN text WHEN n > 10 THEN array_to_string(list_transform(long, lambda ws: "
        "upper(ws[1][1:1]) || array_to_string(ws, ' ')[2:] || '.'), ' ') "
        "ELSE upper(short[1][1:1]) || array_to_string(short, ' ')[2:] || '.' END, 1, 'rephrase' FROM s"),
    "augment_chat": (
        f"WITH c AS (SELECT conv_id || '-' || turn AS pair, copy_no::INT AS copy_no, ask, reply FROM {PAIRS}, range(2) t(copy_no)) "
        "SELECT pair, copy_no, CASE WHEN copy_no > 0 THEN 'shuffle' END AS method, 'user' AS role_0, 'assistant' AS role_1, "
        + ", ".join(_message_shuffle(c, i) + f" AS content_{i}" for i, c in enumerate(("ask", "reply"))) + " FROM c"),
    "augment_methods": (
        "SELECT copy_no::INT AS copy_no, CASE WHEN copy_no > 0 THEN ['shuffle', 'synonym', 'rephrase'][1 + ("
        + number("doc_id || ':method:42:' || copy_no") + " % 3)::INT] END AS method, count(*) AS n FROM documents, range(4) t(copy_no) GROUP BY 1, 2"),
    # anonymize
    "detect_sensitive": " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", '{c}' AS field, '{k}' AS type, count({c}) AS n FROM {t}" for t, c, k in (
            ("documents", "doc_id", "id"), ("events", "event_id", "id"), ("events", "user_id", "name"), ("customer", "c_name", "name"),
            ("supplier", "s_name", "name"), ("part", "p_name", "name"), ("pages", "page_id", "id"), ("conversations", "conv_id", "id"))),
    "anonymize_detected": f"SELECT c_custkey, CASE WHEN c_name IS NOT NULL THEN {full_name(quoted('') + ' || c_custkey || ' + quoted(':c_name:42'))} END AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "anonymize_id": f"SELECT doc_id, CASE WHEN source IS NOT NULL THEN {uuid4('doc_id || ' + quoted(':source:42'))} END AS source, lang FROM documents",
    "anonymize_name_consistent": f"SELECT doc_id, {_pseudonym} AS source, {_pseudonym} AS again FROM documents",
    "anonymize_types": "SELECT doc_id, " + ", ".join(
        f"CASE quality WHEN 1 THEN {_makers[k]('doc_id || ' + quoted(f':{k}:42'))} WHEN 0 THEN '' END AS {k}" for k in _types) + f" FROM {LABELLED}",
    "anonymize_unknown": "SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_mktsegment IS NOT NULL THEN 'ANONYMIZED_c_mktsegment' END AS c_mktsegment FROM customer",
    "anonymize_count": f"SELECT 'quality' AS field, 'id' AS type, count(quality) AS n FROM {LABELLED} UNION ALL SELECT 'source', 'name', count(source) FROM {LABELLED}",
    # split and generate
    "split_exact": split_sql("documents", "doc_id", 0.8, 0.1, 0.1, 42),
    "split_sizes": f"SELECT split, count(*) AS n FROM ({split_sql('orders', 'o_orderkey', 0.7, 0.2, 0.1, 7)}) GROUP BY split",
    "split_hash": f"SELECT CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'valid' ELSE 'test' END AS split, count(*) AS n, sum(l_linenumber)::BIGINT AS lines FROM (SELECT l_linenumber, {number('l_orderkey || ' + quoted(':split:42'))} / 4294967296.0::DOUBLE AS u FROM lineitem) GROUP BY 1",
    "generate_qa": f"SELECT doc_id AS row_id, {email('doc_id || ' + quoted(':question:42'))} AS question, {birthday('doc_id || ' + quoted(':answer:42'))} AS answer FROM documents",
    "generate_chat": "SELECT doc_id AS row_id, 'user' AS role_0, '' AS content_0, 'assistant' AS role_1, '' AS content_1 FROM documents",
    # text scans
    "kw_scan": f"SELECT doc_id, line_no, keyword, {stripped('line')} AS line FROM {hits_sql('documents', 'doc_id', 'text', KEYWORDS)}",
    "kw_context": _context,
    "kw_per_text": f"SELECT doc_id, count(*) AS hits FROM {hits_sql('documents', 'doc_id', 'text', KEYWORDS)} GROUP BY doc_id",
    "kw_top": f"SELECT keyword, count(*) AS n FROM {hits_sql('documents', 'doc_id', 'text', KEYWORDS)} GROUP BY keyword ORDER BY n DESC, keyword LIMIT 10",
    "kw_summary": f"SELECT (SELECT count(*) FROM documents) AS scanned, count(DISTINCT doc_id) AS with_hits, count(*) AS hits FROM {hits_sql('documents', 'doc_id', 'text', KEYWORDS)}",
    "kw_errors": f"SELECT event_id, line_no, keyword, {stripped('line')} AS line FROM {hits_sql('(SELECT event_id, concat_ws(chr(10), event_type, props) AS log FROM events)', 'event_id', 'log', ERROR_KEYWORDS)}",
    "forbidden_scan": _forbidden,
    "hygiene": (
        "WITH h AS (SELECT doc_id, sum(" + _forbidden2 + f")::INT AS hits FROM {lines_sql('documents', 'doc_id', 'text')} GROUP BY doc_id) "
        "SELECT doc_id, text = '' AS empty, " + ", ".join(f"(text <> '' AND {c}) AS {n}" for n, c in _hyg.items())
        + ", coalesce(hits, 0) AS forbidden_hits, coalesce(hits, 0) + " + " + ".join(f"(text <> '' AND {c})::INT" for c in _hyg.values())
        + " AS issues FROM documents LEFT JOIN h USING (doc_id)"),
    "hygiene_summary": (
        "SELECT count(*) AS checked, count(*) FILTER (issues > 0) AS with_issues, sum(issues)::BIGINT AS issues FROM (SELECT "
        + " + ".join(f"(text <> '' AND {c.replace('8192', '1048576')})::INT" for c in _hyg.values()) + " AS issues FROM (SELECT html AS text FROM pages))"),
    "wellformed_json": "SELECT event_id, json_valid(CASE WHEN event_type = 'error' THEN props || '}' ELSE props END) AS well_formed FROM events",
    "wellformed_xml": f"SELECT doc_id, lang = 'en' AND NOT contains(text, ']]>') AND NOT ({_hyg['control_characters']}) AS well_formed FROM documents",
    "wellformed_yaml": "SELECT doc_id, lang = 'en' AS well_formed FROM documents",
    "wellformed_summary": f"SELECT count(*) AS checked, count(*) FILTER ({_hyg['control_characters']}) AS failed FROM documents",
    # formats
    "io_jsonl": f"SELECT doc_id, text, lang, source, n_chars, quality, toxic FROM {LABELLED}",
    "io_json": f"SELECT doc_id, text, lang, source, n_chars, quality, toxic FROM {LABELLED}",
    "io_csv": f"SELECT doc_id, text, lang, source, n_chars, quality, toxic FROM {LABELLED}",
    "io_csv_headers": "SELECT * FROM part",
    "io_json_nested_data": "SELECT conv_id AS id, count(*) AS n, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id",
    "io_tsv": "SELECT * FROM part",
    "io_txt": "SELECT '{\"c_custkey\":' || c_custkey || ',\"c_name\":\"' || c_name || '\"}' AS text FROM customer",
    "io_parquet": "SELECT * FROM documents",
    "io_xml": "SELECT s_suppkey, s_name, s_acctbal, 'a|' || s_name AS tags FROM supplier",
    "io_yaml": f"SELECT doc_id, lang, source, n_chars, quality, toxic FROM {LABELLED}",
    "io_convert": "SELECT * FROM customer",
    "io_records": f"SELECT doc_id, lang, quality FROM {LABELLED}",
    "io_splits": f"SELECT split, count(*) AS n FROM ({split_sql('customer', 'c_custkey', 0.8, 0.1, 0.1, 42)}) GROUP BY split",
    "io_statistics": "SELECT field, record_count, missing, type FROM (" + profile_sql("part", _part_fields, False) + ")",
}


# -- near-duplicates, variations, balance, personal data in values ----------------------------------

def near_duplicates_sql(relation: str, key: str, text: str, words: int, percent: int) -> str:
    """All pairs that share a shingle, and the closure of those within the similarity."""
    return (
        f"WITH RECURSIVE w AS MATERIALIZED (SELECT {key} AS k, regexp_extract_all(lower({text}), '{tx.TOKEN}') AS w FROM {relation}), "
        f"s AS MATERIALIZED (SELECT k, unnest(CASE WHEN len(w) >= {words} THEN list_distinct(list_transform(range(1, len(w) - {words - 2}), "
        f"lambda i: array_to_string(w[i:i + {words - 1}], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END) AS s FROM w), "
        "n AS MATERIALIZED (SELECT k, count(*) AS n FROM s GROUP BY k), "
        "p AS (SELECT x.k AS a, y.k AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.k <> y.k GROUP BY ALL), "
        f"l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE 100 * c >= {percent} * (x.n + y.n - c)), "
        "r AS (SELECT k AS a, k AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a) "
        f"SELECT a AS {key}, min(b) AS representative, min(b) <> a AS is_near_duplicate FROM r GROUP BY a")


def noise_sql(relation: str, key: str, field: str, rate: float) -> str:
    """``key`` and the noisy field."""
    part = f"substr(h[i // {vary.PER_HASH} + 1], i % {vary.PER_HASH} * 4 + 1, 4)"
    swaps = lambda i: f"(k[{i} + 1] = 1 AND coalesce(CASE WHEN {i} > 0 THEN k[{i}] END, -1) <> 1 AND {i} + 1 < len(c))"
    return (
        f"(WITH c AS (SELECT {key}, {field}, regexp_extract_all({field}, '(?s).') AS c, {key} || ':noise:42:{field}' AS b FROM {relation}), "
        f"h AS (SELECT *, list_transform(range(0, (len(c) + {vary.PER_HASH - 1}) // {vary.PER_HASH}), lambda j: md5(b || ':' || j)) AS h FROM c), "
        f"k AS (SELECT *, list_transform(range(0, len(c)), lambda i: CASE WHEN {part} < '{round(rate * 65536):04x}' "
        f"THEN ('0x' || {part})::INT % 3 ELSE -1 END) AS k FROM h) "
        f"SELECT {key}, CASE WHEN {field} = '' THEN '' ELSE array_to_string(list_transform(range(0, len(c)), lambda i: "
        f"CASE WHEN {swaps('i')} THEN c[i + 2] WHEN i > 0 AND {swaps('(i - 1)')} THEN c[i] WHEN k[i + 1] = 0 THEN '' "
        f"WHEN k[i + 1] = 2 THEN c[i + 1] || c[i + 1] ELSE c[i + 1] END), '') END AS {field} FROM k)")


def sentences_sql(relation: str, key: str, field: str, rest: str) -> str:
    marks = f"[{vary.KEEP}{vary.END}{vary.NEXT}]"
    marked = (f"regexp_replace(regexp_replace({field}, {quoted(vary.NO_END)}, '\\1.{vary.KEEP}', 'g'), {quoted(vary.BOUNDARY)}, "
              f"'\\1{vary.END}\\2{vary.NEXT}\\3', 'g')")
    return (
        f"WITH p AS (SELECT *, regexp_split_to_array(replace({marked}, '{vary.KEEP}', ''), '[{vary.END}{vary.NEXT}]') AS p FROM {relation}), "
        f"s AS (SELECT *, list_transform(list_sort(list_transform(range(0, (len(p) + 1) // 2), lambda i: "
        f"md5({key} || ':sentences:42:{field}:' || i) || p[2 * i + 1])), lambda x: substr(x, 33)) AS s FROM p) "
        f"SELECT {key}, CASE WHEN len(p) = 1 OR regexp_matches({field}, '{marks}') THEN {field} ELSE array_to_string(list_transform(range(1, len(s) + 1), "
        f"lambda i: s[i] || coalesce(p[2 * i], '')), '') END AS {field}, {rest} FROM s")


def balance_sql(relation: str, key: str, label: str, target: str, seed: int, columns: str) -> str:
    return (
        f"WITH c AS (SELECT {label} AS l, count(*) AS n FROM {relation} WHERE {label} IS NOT NULL GROUP BY 1), "
        f"r AS (SELECT d.*, n, row_number() OVER (PARTITION BY {label} ORDER BY md5({key} || ':balance:{seed}')) AS rk "
        f"FROM {relation} d LEFT JOIN c ON l = {label}), t AS (SELECT {target} AS t FROM c) "
        f"SELECT {columns}, copy_no::INT AS copy_no FROM (SELECT *, unnest(range(0, CASE WHEN n IS NULL THEN 1 ELSE t // n + (rk <= t % n)::INT END)) AS copy_no "
        "FROM r, t)")


def personal_sql(relation: str, key: str, field: str) -> str:
    """``key, field, kind, start, end, value`` of one field."""
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    at = lambda i: f"substr({digits}, {i}::INT, 1)::INT"
    luhn = (f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN (length({digits}) - i) % 2 = 1 "
            f"THEN 2 * {at('i')} - CASE WHEN {at('i')} > 4 THEN 9 ELSE 0 END ELSE {at('i')} END)) % 10 = 0")
    flat = "replace(v, ' ', '')"
    turned = f"regexp_extract_all(substr({flat}, 5) || substr({flat}, 1, 4), '.')"
    mod = (f"list_reduce(list_transform({turned}, lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE (ascii(c) - 55)::VARCHAR END), "
           f"lambda a, c: ((a || c)::BIGINT % 97)::VARCHAR, '0') = '1'")
    valid = (
        r"CASE kind WHEN 'email' THEN regexp_matches(v, '[.][A-Za-z]{2,}$') AND NOT regexp_matches(v, '[.][.]|^[.]|[.]@|@[.-]') "
        rf"WHEN 'iban' THEN length({flat}) BETWEEN 15 AND 34 AND {mod} WHEN 'credit_card' THEN length({digits}) BETWEEN 13 AND 19 AND {luhn} "
        r"WHEN 'ssn' THEN NOT regexp_matches(v, '^(?:000|666|9)|-00-|-0000$') "
        rf"WHEN 'ip' THEN list_max(list_transform(string_split(v, '.'), lambda x: x::INT)) <= 255 ELSE length({digits}) BETWEEN 8 AND 15 END")
    kind = "CASE " + " ".join(f"WHEN regexp_full_match(v, '{p}') THEN '{k}'" for k, p in personal.PATTERNS.items()) + " END"
    return (
        f"(WITH p AS (SELECT {key}, regexp_split_to_array({field}, '{personal.ANY}') AS g, regexp_extract_all({field}, '{personal.ANY}') AS m "
        f"FROM {relation} WHERE regexp_matches({field}, '{personal.ANY}')), "
        f"i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM p), "
        f"v AS (SELECT {key}, m[i] AS v, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::INT AS start, "
        f"CASE WHEN g[i] = '' THEN i = 1 ELSE NOT regexp_matches(right(g[i], 1), '[A-Za-z0-9]') END AND "
        f"CASE WHEN g[i + 1] = '' THEN i = len(m) ELSE NOT regexp_matches(left(g[i + 1], 1), '[A-Za-z0-9]') END AS alone FROM i), "
        f"k AS (SELECT *, {kind} AS kind FROM v) "
        f"SELECT {key}, '{field}' AS field, kind, start, (start + length(v))::INT AS \"end\", v AS value FROM k WHERE alone AND {valid})")


def mask_sql(relation: str, field: str, columns: str, rules: Sequence[mask.MaskRule]) -> str:
    any_rule = "|".join(f"(?:{r.pattern})" for r in rules)

    def new(r: mask.MaskRule) -> str:
        if r.replacement is not None:
            return f"regexp_replace(v, {quoted(f'^(?:{r.pattern})$')}, {quoted(r.replacement)})"
        size = f"greatest(length(v) - {r.keep_last}, 0)"
        hidden = f"substr(v, 1, {size})"
        for shape, sign in mask.FORMAT:
            hidden = f"regexp_replace({hidden}, '{shape}', '{sign}', 'g')"
        return f"{hidden} || substr(v, {size} + 1)"

    cases = " ".join(f"WHEN regexp_full_match(v, {quoted(r.pattern)}) THEN {new(r)}" for r in rules)
    return (
        f"WITH p AS (SELECT *, regexp_split_to_array({field}, {quoted(any_rule)}) AS g, regexp_extract_all({field}, {quoted(any_rule)}) AS m FROM {relation}) "
        f"SELECT {columns}, CASE WHEN len(m) = 0 THEN {field} ELSE array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || "
        f"coalesce(list_transform(m[i:i], lambda v: CASE {cases} END)[1], '')), '') END AS {field} FROM p")


ORACLE |= {
    "io_splits_formats": (
        "SELECT format, split, count(*) AS n, sum(length(c_name))::BIGINT AS chars FROM (SELECT unnest(['csv', 'tsv', 'json', 'txt', 'xml']) AS format) "
        f"CROSS JOIN ({split_sql('customer', 'c_custkey', 0.8, 0.1, 0.1, 42)}) JOIN customer USING (c_custkey) GROUP BY ALL"),
    "template_native": (
        "SELECT doc_id, n_chars + 1 AS chars, n_chars > 1000 AS long, len(regexp_split_to_array(source, '[./-]'))::INT AS n_words, "
        "regexp_split_to_array(source, '[./-]')[1] AS word, '' AS nothing, 'size' AS name_0, 'lang' AS name_1, quality::INT AS value_0, lang AS value_1, "
        f"CASE WHEN quality IS NOT NULL THEN 'BIGINT' END AS type_0, CASE WHEN lang IS NOT NULL THEN 'STRING' END AS type_1 FROM {LABELLED}"),
    "near_duplicates": near_duplicates_sql("documents", "doc_id", "coalesce(text, '')", 5, 80),
    "near_duplicates_fields": near_duplicates_sql("pages", "page_id", "concat_ws(' ', url, html)", 3, 70),
    "augment_noise": (
        f"SELECT d.doc_id, n.text, d.lang, m.source, d.n_chars FROM documents d JOIN {noise_sql('documents', 'doc_id', 'text', 0.02)} n USING (doc_id) "
        f"JOIN {noise_sql('documents', 'doc_id', 'source', 0.02)} m USING (doc_id)"),
    "augment_sentences": sentences_sql("documents", "doc_id", "text", "lang, source, n_chars"),
    "balance_largest": balance_sql("labels", "doc_id", "toxic", "max(n)", 42, "doc_id, quality, toxic"),
    "balance_smallest": balance_sql("documents", "doc_id", "lang", "min(n)", 7, "doc_id, text, lang, source, n_chars"),
    "balance_number": balance_sql(LABELLED, "doc_id", "quality", "DISTINCT 101", 42, "doc_id, text, lang, source, n_chars, quality, toxic"),
    "personal_values": f"{personal_sql('documents', 'doc_id', 'text')} UNION ALL {personal_sql('documents', 'doc_id', 'source')}",
    "personal_report": (
        "SELECT field, kind, sum(n)::BIGINT AS places, count(*) AS records FROM (SELECT doc_id, field, kind, count(*) AS n FROM ("
        + personal_sql("documents", "doc_id", "text") + " UNION ALL " + personal_sql("documents", "doc_id", "lang") + ") GROUP BY ALL) GROUP BY ALL"),
    "mask_patterns": mask_sql("documents", "text", "doc_id, lang, source, n_chars", MASK_RULES),
}
