"""Filters in the condition language, one an operator."""

from __future__ import annotations

from . import dsl
from .catalogue import query

_CASES = {
    "between": ("orders", "o_orderkey", "o_totalprice between 1000 and 50000 and not (o_orderkey between 10 and 20)", "o_totalprice BETWEEN 1000 AND 50000 AND NOT o_orderkey BETWEEN 10 AND 20"),
    "in": ("customer", "c_custkey", "c_mktsegment in ['BUILDING', 'MACHINERY'] or c_nationkey notin [1, 2, 3, 4, 5, 6, 7, 8, 9]", "c_mktsegment IN ('BUILDING', 'MACHINERY') OR c_nationkey NOT IN (1, 2, 3, 4, 5, 6, 7, 8, 9)"),
    "like": ("part", "p_partkey", "p_name like '%e_ %' and p_name not ilike 'A%'", "p_name LIKE '%e_ %' AND p_name NOT ILIKE 'A%'"),
    "regex": ("customer", "c_custkey", r"c_name =~ '#0+1' and c_mktsegment ~* '^b|y$' and c_name !~ '7$'", "regexp_matches(c_name, '#0+1') AND regexp_matches(c_mktsegment, '(?i)^b|y$') AND NOT regexp_matches(c_name, '7$')"),
    "null": ("customer", "c_custkey", "odd is null or odd == 7 and not (odd != 7)", "odd IS NULL OR odd = 7"),
    "compare": ("customer", "c_custkey", "odd > 8 or not (c_acctbal >= 0)", "coalesce(odd > 8, false) OR NOT c_acctbal >= 0"),
    "functions": ("customer", "c_custkey", "istartswith(c_mktsegment, 'au') or (len(c_name) == 18 and icontains(c_name, '99')) or similarity(c_mktsegment, 'bilding') >= 0.8", "lower(c_mktsegment) LIKE 'au%' OR (length(c_name) = 18 AND c_name LIKE '%99%') OR 1 - levenshtein(lower(c_mktsegment), 'bilding')::DOUBLE / greatest(length(c_mktsegment), 7) >= 0.8"),
    "dotted": ("orders", "o_orderkey", "s.status == 'F' and s.inner.year between 1994 and 1996", "o_orderstatus = 'F' AND year(o_orderdate) BETWEEN 1994 AND 1996"),
    "nulls": ("customer", "c_custkey", "isnull(odd) and notnull(c_name) and exists(c_acctbal) and coalesce(odd, c_nationkey) < 13", "odd IS NULL AND c_nationkey < 13"),
    "membership": ("customer", "c_custkey", "oneof(c_nationkey, [1, 4, 9]) or iin(c_mktsegment, ['building', 'MACHINERY'])", "c_nationkey IN (1, 4, 9) OR lower(c_mktsegment) IN ('building', 'machinery')"),
    "substring": ("customer", "c_custkey", "'CHIN' in c_mktsegment and 'x' notin c_name", "c_mktsegment LIKE '%CHIN%' AND c_name NOT LIKE '%x%'"),
    "case": ("customer", "c_custkey", "lower(c_mktsegment) == 'building' or upper(c_name) =~ '99$' or strip('  a ') == c_name or lstrip(c_mktsegment) == 'MACHINERY' or rstrip(c_mktsegment) == 'none'", "c_mktsegment IN ('BUILDING', 'MACHINERY') OR c_name LIKE '%99'"),
    "norm": ("documents", "doc_id", "norm(text) =~ 'uber|leau' and norm(lang) != 'en'", "regexp_matches(regexp_replace(strip_accents(coalesce(text, '')), '[^\\x00-\\x7F]', '', 'g'), 'uber|leau') AND lang <> 'en'"),
    "edges": ("customer", "c_custkey", "startswith(c_mktsegment, 'BU') and endswith(c_name, '1') or iendswith(c_mktsegment, 'ure') or istartswith(c_mktsegment, 'house') and endswith(c_name, '2')", "c_mktsegment LIKE 'BU%' AND c_name LIKE '%1' OR c_mktsegment LIKE '%URE' OR c_mktsegment LIKE 'HOUSE%' AND c_name LIKE '%2'"),
    "contains": ("customer", "c_custkey", "contains(c_name, '01') or icontains(c_mktsegment, 'chin') or iequals(c_mktsegment, 'Furniture')", "c_name LIKE '%01%' OR c_mktsegment LIKE '%CHIN%' OR c_mktsegment = 'FURNITURE'"),
    "matches": ("customer", "c_custkey", "matches(c_name, '[13]7$') or imatches(c_mktsegment, '^auto') or fullmatch(c_mktsegment, 'F.*E') or ifullmatch(c_mktsegment, 'mach.nery')", "regexp_matches(c_name, '[13]7$') OR c_mktsegment LIKE 'AUTO%' OR c_mktsegment LIKE 'F%E' OR c_mktsegment = 'MACHINERY'"),
    "no_regex": ("customer", "c_custkey", "c_name =~ '(' or matches(c_name, '[') or c_name !~ '*' and c_custkey < 50", "c_custkey < 50"),
    "like_functions": ("part", "p_partkey", "like(p_name, '%e_ %') or ilike(p_name, 'A%')", "p_name LIKE '%e_ %' OR p_name ILIKE 'a%'"),
    "sequences": ("customer", "c_custkey", "any_icontains([c_name, c_mktsegment], 'mach') or all_icontains([c_name, c_mktsegment], 'u') and any_matches([c_name], '7$') or all_matches([c_name, c_mktsegment], '^[A-Z]') and c_custkey < 20 or all_matches([], 'a')",
        "c_mktsegment LIKE '%MACH%' OR lower(c_name) LIKE '%u%' AND lower(c_mktsegment) LIKE '%u%' AND c_name LIKE '%7' OR regexp_matches(c_name, '^[A-Z]') AND regexp_matches(c_mktsegment, '^[A-Z]') AND c_custkey < 20"),
    "booleans": ("events", "event_id", "isbool(word) and not istrue(word) or to_bool(word) and event_id < 300 or isfalse(word) and boolish(word)", "word IN ('F', 'no') OR word = ' Yes' AND event_id < 300"),
    "shares": ("events", "event_id", "boolish_ratio([word, event_type]) == 0.5 and percent_true([word, event_type, null, 'y']) == 0.5 or percent_false([word, 'n']) == 1", "word = ' Yes' OR word IN ('F', 'no')"),
    "names": ("events", "event_id", "looks_like_bool_name(label) or looks_like_id_name(label) and event_id < 500 or looks_like_dt_name(label) and event_id < 100", "label = 'is_paid' OR label = 'user_id' AND event_id < 500 OR label = 'shipdate' AND event_id < 100"),
    "dtypes": ("events", "event_id", "is_boolean_dtype(kind) or is_numeric_dtype(kind) and event_id < 500 or is_datetime_dtype(kind) and event_id < 100", "kind = 'boolean' OR kind = 'Int64' AND event_id < 500 OR kind = 'datetime64[ns]' AND event_id < 100"),
    "numbers": ("events", "event_id", "is_numeric(amount) and to_number(amount) >= 500 or to_number(amount, -1) == -1 and event_id < 50", "event_id % 3 > 0 AND event_id >= 500 OR event_id % 3 = 0 AND event_id < 50"),
    "counts": ("events", "event_id", "null_ratio([gap, word]) == 0.5 and unique_count([gap, null, word, word]) == 2 or unique_count([event_type, 'view']) == 1", "event_id % 4 = 0 OR event_type = 'view'"),
    "similar": ("customer", "c_custkey", "similar(c_mktsegment, 'Bulding') or any_similar([c_name, c_mktsegment], 'machnery', 0.85) or similarity(c_mktsegment, 'fürniture') >= 1", "c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE')"),
}

#: Columns that the cases add, in Spark's SQL and DuckDB's.
_WORD = "CASE event_type WHEN 'view' THEN ' Yes' WHEN 'error' THEN 'F' WHEN 'signup' THEN 'no' ELSE event_type END AS word"
_LABEL = "CASE event_id % 4 WHEN 0 THEN 'is_paid' WHEN 1 THEN 'user_id' WHEN 2 THEN 'shipdate' ELSE 'amount' END AS label"
_KIND = "CASE event_id % 4 WHEN 0 THEN 'boolean' WHEN 1 THEN 'Int64' WHEN 2 THEN 'datetime64[ns]' ELSE 'string' END AS kind"
_AMOUNT = "CASE WHEN event_id % 3 = 0 THEN '1d' ELSE {} END AS amount"
_GAP = "CASE WHEN event_id % 4 > 0 THEN 'x' END AS gap"
_ADDED = {
    "customer": (["CASE WHEN c_nationkey % 2 = 0 THEN NULL ELSE c_nationkey END AS odd"], ["CASE WHEN c_nationkey % 2 = 0 THEN NULL ELSE c_nationkey END AS odd"]),
    "events": ([_WORD, _LABEL, _KIND, _AMOUNT.format("cast(event_id AS string)"), _GAP], [_WORD, _LABEL, _KIND, _AMOUNT.format("event_id::VARCHAR"), _GAP]),
    "orders": (["named_struct('status', o_orderstatus, 'inner', named_struct('year', year(o_orderdate))) AS s"], []),
}

for _name, (_table, _key, _cond, _where) in _CASES.items():
    _own = _ADDED.get(_table, ([], []))

    @query(f"filter_dsl_{_name}", f"SELECT {_key} FROM (SELECT {', '.join(['*', *_own[1]])} FROM {_table}) AS r WHERE {_where}")
    def _(t, spark, name=_table, key=_key, cond=_cond, own=tuple(_own[0])):
        return t(name).selectExpr("*", *own).where(dsl.compile_column(cond)).select(key)
