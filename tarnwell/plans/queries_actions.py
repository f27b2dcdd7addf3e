"""Actions by their text, as rules call them; types by content; whole cleaning passes; roles from facts."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import ids, periods, pvalues
from ..operators import frames, layout, ordered, planner, profile, roles, topics
from ..sources import files, messy
from ..sources.staged import shared_root
from . import actions, config, pack, pipeline, rules
from .catalogue import query

r6 = lambda c: F.round(c, 6)


def acted(df, col: str, text: str, env: dict | None = None, order_by: list[str] | None = None):
    call = actions.parse_then(text)
    return actions.ACTIONS[call.name].run(df, col, call.bound(pack.DEFAULT_ENV | (env or {})), order_by or [])[0]


# one query an action: (action, table, key, column made in Spark's SQL, what DuckDB makes of it)
_ODD = "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END"
_CASES = {
    "coerce_numeric": ("coerce_numeric()", "orders", "o_orderkey", "concat('$', format_string('%.2f', o_totalprice))", "round(o_totalprice, 2)"),
    "parse_datetime": ("parse_datetime(datetime_formats)", "orders", "o_orderkey", "date_format(o_orderdate, 'M/d/yyyy')", "date_trunc('day', o_orderdate)::TIMESTAMP"),
    "parse_datetime_robust": ("parse_datetime_robust(utc=true)", "events", "event_id", "concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), '+02:00')", "date_trunc('second', ts) - INTERVAL 2 HOUR"),
    "parse_datetime_robust_years": ("parse_datetime_robust(yearfirst=true)", "orders", "o_orderkey", "date_format(o_orderdate, 'yy/M/d')", "date_trunc('day', o_orderdate)::TIMESTAMP"),
    "extract_datetime": ("extract_datetime", "orders", "o_orderkey", "concat('sent ', date_format(o_orderdate, 'yyyy/M/d'), ' by post')", "strftime(o_orderdate, '%Y/%-m/%-d')"),
    "parse_epoch": ("parse_epoch()", "events", "event_id", "unix_millis(cast(ts AS timestamp))", "make_timestamp(epoch_us(ts) // 1000 * 1000)"),
    "dt_floor": ("dt_floor('6h')", "events", "event_id", "ts", "time_bucket(INTERVAL '6 hours', ts)::TIMESTAMP"),
    "dt_ceil": ("dt_ceil('H')", "events", "event_id", "ts", "CASE WHEN date_trunc('hour', ts) = ts THEN ts ELSE date_trunc('hour', ts) + INTERVAL 1 HOUR END"),
    "dt_part": ("dt_part('month_name')", "orders", "o_orderkey", "o_orderdate", "monthname(o_orderdate)"),
    "cast_string": ("cast_string()", "customer", "c_custkey", "c_nationkey", "c_nationkey::VARCHAR"),
    "cast_category": ("cast_category(3)", "customer", "c_custkey", "c_mktsegment", "c_mktsegment"),
    "impute_mean": ("impute('mean')", "events", "event_id", _ODD, f"round(coalesce({_ODD}, (SELECT avg({_ODD}) FROM events)), 6)"),
    "impute_value": ("impute_value(numeric_default)", "customer", "c_custkey", "CASE WHEN c_nationkey > 5 THEN c_mktsegment END", "CASE WHEN c_nationkey > 5 THEN c_mktsegment ELSE 'median' END"),
    "materialize_missing_as": ("materialize_missing_as(cleaning.impute.text_default)", "customer", "c_custkey", "CASE WHEN c_nationkey > 5 THEN c_mktsegment END", "CASE WHEN c_nationkey > 5 THEN c_mktsegment ELSE 'N/A' END"),
    "impute_dt": ("impute_dt('constant', '2000-01-01')", "events", "event_id", "CASE WHEN event_id % 3 > 0 THEN ts END", "CASE WHEN event_id % 3 > 0 THEN ts ELSE TIMESTAMP '2000-01-01' END"),
    "outliers": ("outliers('iqr', iqr_multiplier=0.5, handle='drop')", "orders", "o_orderkey", "o_totalprice", "(SELECT CASE WHEN o_totalprice BETWEEN q[1] - 0.5 * (q[2] - q[1]) AND q[2] + 0.5 * (q[2] - q[1]) THEN o_totalprice END FROM (SELECT quantile_cont(o_totalprice, [0.25, 0.75]) AS q FROM orders))"),
    "text_normalize": ("text_normalize(lower=true)", "customer", "c_custkey", "concat('  ', c_mktsegment, ' \uFB01x ')", "lower(c_mktsegment) || ' fix'"),
    "normalize_null_tokens": ("normalize_null_tokens(['building'])", "customer", "c_custkey", "c_mktsegment", "nullif(c_mktsegment, 'BUILDING')"),
    "standardize_units": ("standardize_units('percent')", "lineitem", None, "l_discount * 100", "round(CASE WHEN l_discount * 100 > 1 THEN l_discount ELSE l_discount * 100 END, 6)"),
    "coerce_bool": ("coerce_bool(true_regex=['B.*'], false_regex=['.*Y'], true_tokens=[], false_tokens=[])", "customer", "c_custkey", "c_mktsegment", "CASE WHEN c_mktsegment LIKE 'B%' THEN true WHEN c_mktsegment LIKE '%Y' THEN false END"),
    "coerce_bool_keep": ("coerce_bool(true_tokens=['building'], drop_invalid=false)", "customer", "c_custkey", "c_mktsegment", "CASE WHEN c_mktsegment = 'BUILDING' THEN 'true' ELSE c_mktsegment END"),
    "rare_cats": ("cat_consolidate(0.5, 'few')", "customer", "c_custkey", "c_mktsegment", "'few'"),
    "map_synonyms": ("cat_map_synonyms()", "customer", "c_custkey", "c_mktsegment", "c_mktsegment"),
    "cat_extract_key": ("cat_extract_key(['(build|mach)'], 1, 'none', candidates=['builds', 'machs'])", "customer", "c_custkey", "c_mktsegment", "CASE c_mktsegment WHEN 'BUILDING' THEN 'builds' WHEN 'MACHINERY' THEN 'machs' ELSE 'none' END"),
    "cat_fuzzy_map": ("cat_fuzzy_map(['Building', 'Machinery'], 1)", "customer", "c_custkey", "concat(c_mktsegment, '!')", "CASE c_mktsegment WHEN 'BUILDING' THEN 'Building' WHEN 'MACHINERY' THEN 'Machinery' ELSE c_mktsegment || '!' END"),
    "regex_replace": ("regex_replace('#0+', repl='-')", "customer", "c_custkey", "c_name", "regexp_replace(c_name, '#0+', '-', 'g')"),
    "extract_digits": ("extract_digits()", "customer", "c_custkey", "c_name", "regexp_replace(c_name, '[^0-9]', '', 'g')"),
    "zero_pad": ("zero_pad(cleaning.ids.zip_width, cleaning.ids.pad_fillchar)", "customer", "c_custkey", "cast(c_custkey AS double)", "lpad(c_custkey::VARCHAR, greatest(5, length(c_custkey::VARCHAR))::INT, '0')"),
    "keep_alnum": ("keep_alnum(allowed='#', case='lower')", "customer", "c_custkey", "c_name", "lower(regexp_replace(c_name, '[^A-Za-z0-9#]', '', 'g'))"),
    "clip": ("clip(0, hi=5000)", "customer", "c_custkey", "c_acctbal", "least(greatest(c_acctbal, 0.0::DOUBLE), 5000.0::DOUBLE)"),
    "enforce_sign": ("enforce_sign('negative')", "customer", "c_custkey", "c_acctbal", "CASE WHEN c_acctbal < 0 THEN c_acctbal END"),
    "zero_as_missing": ("zero_as_missing(0.005)", "lineitem", None, "l_discount", "CASE WHEN abs(l_discount) > 0.005 THEN l_discount END"),
}

for _name, (_text, _table, _key, _made, _want) in _CASES.items():
    _keys = [_key] if _key else ["l_orderkey", "l_linenumber"]

    @query(f"action_{_name}", f"SELECT {', '.join(_keys)}, {_want} AS value FROM {_table}")
    def _(t, spark, text=_text, table=_table, keys=tuple(_keys), made=_made):
        got = acted(t(table).selectExpr(*keys, f"{made} AS value"), "value", text)
        return got.withColumn("value", r6("value")) if dict(got.dtypes)["value"] == "double" else got


@query("action_drop_column", "SELECT c_custkey FROM customer")
def _(t, spark):
    return acted(t("customer").select("c_custkey", "c_name"), "c_name", "drop_column")


@query("action_registry", "SELECT count(*) AS n FROM (SELECT unnest(range(35)))")
def _(t, spark):
    return spark.createDataFrame([(len(actions.ACTIONS),)], "n long")


# whole passes

_DAY = "time_bucket(INTERVAL '1 day', {0} + INTERVAL 12 HOUR)::TIMESTAMP"


@query("cleaned_lineitem", f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, lower(l_returnflag) AS l_returnflag, lower(l_linestatus) AS l_linestatus, {_DAY.format('l_shipdate')} AS l_shipdate FROM lineitem")
def _(t, spark):
    return rules.clean(t("lineitem")).df


@query("cleaned_events", f"SELECT event_id, {_DAY.format('ts')} AS ts, user_id, lower(event_type) AS event_type, value, CASE WHEN few AND n < 0.01 * rows THEN 'Other' ELSE lower(props) END AS props FROM (SELECT *, count(*) OVER (PARTITION BY lower(props)) AS n, count(*) OVER () AS rows FROM events), (SELECT count(DISTINCT props) <= 0.02 * count(*) AND count(DISTINCT props) <= 200 AS few FROM events)")
def _(t, spark):
    return rules.clean(t("events")).df


@query("cleaned_customer_as_shipped", "SELECT c_custkey, lower(c_name) AS c_name, c_nationkey, c_acctbal, lower(c_mktsegment) AS c_mktsegment FROM customer")
def _(t, spark):
    made = rules.clean(t("customer"), compat=True).df
    return made.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("rules_failures", "SELECT * FROM (VALUES ('bad-condition', NULL), ('bad-value', 'c_acctbal')) AS f(rule, col)")
def _(t, spark):
    own = [pack.Rule("bad-condition", 20, "name ==", "cast_string()"), pack.Rule("bad-value", 10, "name == 'c_acctbal'", "impute_value('none')"), pack.Rule("good", 5, "name == 'c_name'", "text_normalize()")]
    made = rules.apply_rules(t("customer"), own, {})
    return spark.createDataFrame([(f.rule, f.column) for f in made.failures], "rule string, col string")


@query("rules_recheck", "SELECT count(*) AS n, count(DISTINCT c_custkey) AS keys FROM customer")
def _(t, spark):
    df = t("customer").withColumn("_tmp_note", F.lit("x"))
    made = rules.recheck(df, roles.derived(df)).df
    assert set(made.columns) == set(df.columns)
    return made.agg(F.count("*").alias("n"), F.countDistinct("c_custkey").alias("keys"))


@query("rules_for_decided", "SELECT o_orderkey, o_totalprice AS amount FROM orders")
def _(t, spark):
    df = t("orders").select("o_orderkey", F.format_number("o_totalprice", 2).alias("amount"))
    schema = roles.decided(df)
    made = rules.apply_rules(df, rules.rules_for(schema), schema.roles()).df
    return made.select("o_orderkey", F.round(F.col("amount").cast("double"), 2).alias("amount"))


@query("rules_configured", "SELECT c_custkey, upper(c_name) AS c_name FROM customer")
def _(t, spark):
    text = chr(0xFEFF) + "[cleaning.outliers]\ndetect = 'iqr'\n[[cleaning.rules]]\nid = 'case'\npriority = 7\nwhen = \"name == 'c_name'\"\nthen = \"keep_alnum(allowed=cleaning.marks, case='upper')\"\n[cleaning]\nmarks = '#'\n"
    text = chr(0xFEFF) + "[cleaning]\nmarks = '#'\n[cleaning.outliers]\ndetect = 'iqr'\n[[cleaning.rules]]\nid = 'case'\npriority = 7\nwhen = \"name == 'c_name'\"\nthen = \"keep_alnum(allowed=cleaning.marks, case='upper')\"\n"
    made = config.of(config.parse(text))
    return rules.apply_rules(t("customer"), made.rules, {}, made.env).df.select("c_custkey", "c_name")


# roles and schemas

_FACTS = "count({c})::DOUBLE / count(*) AS cover, count(DISTINCT {c})::DOUBLE / count(*) AS uniq"
_KIND = {"event_id": "int", "ts": "datetime", "user_id": "int", "event_type": "string", "value": "float", "props": "string"}


def _role_sql(columns: dict[str, str], table: str) -> str:
    parts = []
    for c, kind in columns.items():
        text = kind == "string"
        like = f"avg((lower(trim({c})) IN ('true', 'false', 't', 'f', 'y', 'n', 'yes', 'no', '1', '0'))::INT)" if text else "0"
        number = f"avg(regexp_full_match(replace(trim({c}), ',', ''), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')::INT)" if text else "0"
        dates = f"avg(regexp_full_match(trim({c}), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}.*|[0-9]+/[0-9]+/[0-9]+.*')::INT)" if text else "0"
        length = f"avg(length({c}))" if text else "0"
        parts.append(f"SELECT '{c}' AS column_name, '{kind}' AS type, {_FACTS.format(c=c)}, count(DISTINCT {c}) AS nunique, {like} AS bools, {number} AS numbers, {dates} AS dates, {length} AS len FROM {table}")
    return f"""WITH f AS ({' UNION ALL '.join(parts)}),
v AS (SELECT *, CASE WHEN cover < 0.1 THEN 'text' WHEN type = 'datetime' THEN 'time' WHEN type = 'bool' THEN 'bool' WHEN type IN ('int', 'float') THEN CASE WHEN uniq >= 0.95 THEN 'id' ELSE 'numeric' END
WHEN dates >= 0.6 THEN 'time' WHEN numbers >= 0.8 THEN CASE WHEN uniq >= 0.95 THEN 'id' ELSE 'numeric' END WHEN bools >= 0.57 THEN 'bool' WHEN uniq <= 0.02 AND nunique <= 200 THEN 'categorical' WHEN len >= 8 THEN 'text' WHEN nunique <= 200 THEN 'categorical' ELSE 'text' END AS by_value,
CASE WHEN regexp_matches(column_name, '(?i)(date|time|timestamp|dt|ts)\\b') THEN 'time' WHEN regexp_matches(column_name, '(?i)(?:^|[_-])(id|uuid|guid|key)\\b') THEN 'id' WHEN regexp_matches(column_name, '(?i)^(is_|has_|flag_)') THEN 'bool' WHEN regexp_matches(column_name, '(?i)(lat|lng|lon|long|latitude|longitude)\\b') THEN 'geo' END AS by_name FROM f),
r AS (SELECT *, CASE WHEN by_name IS NOT NULL AND by_name <> by_value AND by_value = 'id' THEN by_name ELSE by_value END AS role, CASE WHEN by_name = by_value THEN 0.955 WHEN by_name IS NOT NULL THEN 0.8 ELSE 0.755 END * (0.25 + 0.75 * cover) AS sure FROM v)
SELECT column_name, type, role, round(least(0.99, greatest(0, sure - CASE WHEN role = 'bool' AND nunique > 4 THEN 0.08 ELSE 0 END)), 6)::DOUBLE AS confidence FROM r"""


@query("role_inference_events", _role_sql(_KIND, "events"))
def _(t, spark):
    return roles.role_table(t("events"))


_CUSTOMER = {"c_custkey": "int", "c_name": "string", "c_nationkey": "int", "c_acctbal": "float", "c_mktsegment": "string"}


@query("role_inference_customer", _role_sql(_CUSTOMER, "customer"))
def _(t, spark):
    return roles.role_table(t("customer").select(*_CUSTOMER))


@query("schema_derived", """WITH f AS (SELECT 'c_custkey' AS column_name, 'int' AS type, count(DISTINCT c_custkey)::DOUBLE / count(*) AS u, 0 AS len FROM customer UNION ALL SELECT 'c_name', 'string', 0, avg(length(c_name)) FROM customer
UNION ALL SELECT 'c_nationkey', 'int', count(DISTINCT c_nationkey)::DOUBLE / count(*), 0 FROM customer UNION ALL SELECT 'c_acctbal', 'float', count(DISTINCT c_acctbal)::DOUBLE / count(*), 0 FROM customer UNION ALL SELECT 'c_mktsegment', 'string', 0, avg(length(c_mktsegment)) FROM customer)
SELECT column_name, CASE WHEN regexp_matches(column_name, '(?i)^id$|_id$|^id_|id\\b|uuid|guid|key|hash|checksum') THEN 'id' WHEN type IN ('int', 'float') THEN CASE WHEN u > 0.98 THEN 'id' ELSE 'numeric' END WHEN len >= 16 THEN 'text' ELSE 'categorical' END AS role FROM f""")
def _(t, spark):
    return spark.createDataFrame([(c.name, c.role) for c in roles.derived(t("customer").select(*_CUSTOMER)).columns], "column_name string, role string")


@query("schema_decided", """WITH f AS (SELECT count(DISTINCT o_orderpriority)::DOUBLE / count(*) AS u FROM orders) SELECT * FROM (VALUES ('word', 'boolean'), ('amount', 'numeric'), ('o_orderdate', 'time'), ('name', 'text')) AS d(column_name, role)
UNION ALL SELECT 'o_orderpriority', CASE WHEN u <= 0.3 THEN 'categorical' ELSE 'text' END FROM f""")
def _(t, spark):
    made = t("orders").select(F.when(F.col("o_orderkey") % 2 == 0, "yes").otherwise("no").alias("word"), F.format_number("o_totalprice", 2).alias("amount"), "o_orderdate", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("name"), "o_orderpriority")
    return spark.createDataFrame([(c.name, c.role) for c in roles.decided(made).columns], "column_name string, role string")


def _unit(value: str) -> str:
    """The first unit that over a fifth of 50 values carry, by DuckDB: the values are all alike, so any 50 are."""
    shares = [("currency", "^[ ]*[$]"), ("percent", "(?i)(%|\\b(percent|pct)\\b)"), ("magnitude_k", "(?i)\\b(k|thousand)\\b"), ("magnitude_m", "(?i)\\b(million|mm)\\b")]
    whens = " ".join(f"WHEN avg(regexp_matches(v, '{p}')::INT) > 0.2 THEN '{n}'" for n, p in shares)
    return f"(SELECT CASE {whens} END FROM (SELECT {value} AS v FROM orders LIMIT 50))"


_PRICE = "printf('%.2f', o_totalprice)"


@query("unit_hints", f"SELECT 'price' AS column_name, {_unit(f"'$' || {_PRICE}")} AS hint UNION ALL SELECT 'share', {_unit(f"{_PRICE} || ' pct'")} UNION ALL SELECT 'amount', {_unit(f"{_PRICE} || ' thousand'")} UNION ALL SELECT 'plain', {_unit(_PRICE)}")
def _(t, spark):
    price = F.format_string("%.2f", "o_totalprice")
    made = t("orders").select(F.concat(F.lit("$"), price).alias("price"), F.concat(price, F.lit(" pct")).alias("share"), F.concat(price, F.lit(" thousand")).alias("amount"), price.alias("plain"))
    return spark.createDataFrame([(c, roles.unit_hint(made, c)) for c in made.columns], "column_name string, hint string")


@query("bootstrap_metrics", "SELECT 'event_type' AS column_name, round(avg((event_type IS NOT NULL)::INT), 6)::DOUBLE AS non_null_ratio, count(DISTINCT word) AS nunique, 'n/a,none' AS empty FROM (SELECT *, CASE WHEN event_id % 5 = 0 THEN 'None' WHEN event_id % 3 = 0 THEN ' N/A' ELSE event_type END AS word FROM events)")
def _(t, spark):
    df = t("events").select(F.when(F.col("event_id") % 5 == 0, "None").when(F.col("event_id") % 3 == 0, " N/A").otherwise(F.col("event_type")).alias("event_type"))
    m = pipeline.series_metrics(df)["event_type"]
    return spark.createDataFrame([("event_type", round(m["non_null_ratio"], 6), m["nunique"], ",".join(sorted(m["empty_token_candidates"])))], "column_name string, non_null_ratio double, nunique long, empty string")


# files


def _folder(spark, name: str) -> str:
    return f"{shared_root(spark)}/files-{name}"


@query("union_by_name_files", "SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN c_name END AS c_name, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END AS c_acctbal FROM customer")
def _(t, spark):
    at, c = _folder(spark, "union"), t("customer")
    files.write_any(c.where("c_custkey % 3 = 0").select("c_custkey", "c_name"), f"{at}/a.csv")
    files.write_any(c.where("c_custkey % 3 = 1").select("c_custkey", "c_name", "c_acctbal"), f"{at}/b.json")
    files.write_any(c.where("c_custkey % 3 = 2").select("c_custkey", "c_acctbal"), f"{at}/c.parquet")
    made = files.bronze(files.read_union(spark, [f"{at}/{n}" for n in ("a.csv", "b.json", "c.parquet", "missing.parquet")]))
    return made.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"))


def _roundtrip(kind: str, sql: str, columns: tuple):
    @query(f"{kind}_roundtrip", sql)
    def _(t, spark):
        path = f"{_folder(spark, kind)}/customer.{kind}"
        files.write_any(t("customer").select(*columns), path)
        return files.read_any(spark, path).select(*[F.col(c).cast(k).alias(c) for c, k in t("customer").select(*columns).dtypes])


for _kind in ("csv", "json", "parquet", "feather"):
    _roundtrip(_kind, "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer", ("c_custkey", "c_name", "c_acctbal", "c_mktsegment"))


@query("inventory_by_kind", "SELECT * FROM (VALUES ('csv', 'one', 1), ('parquet', 'two', 1), ('json', 'one', 1)) AS i(kind, slug, n)")
def _(t, spark):
    at, n = _folder(spark, "inventory"), t("nation").coalesce(1)
    for path in ("one/a.csv", "one/b.json", "two/c.parquet"):
        files.write_any(n, f"{at}/{path}")
    return layout.inventory(files.catalog(spark, at)).withColumn("n", F.col("n").cast("int"))


@query("bronze_types", """SELECT o_orderkey, date_trunc('day', o_orderdate)::TIMESTAMP AS order_date, make_timestamp(epoch_us(o_orderdate) // 1000 * 1000) AS sent_ts, round(o_totalprice, 2)::DOUBLE AS amount, lpad(o_custkey::VARCHAR, 6, '0') AS code, o_orderpriority, '{"a":' || o_custkey || '}' AS nested FROM orders""")
def _(t, spark):
    raw = t("orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy/M/d").alias("order_date"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).cast("string").alias("sent_ts"), F.format_number("o_totalprice", 2).alias("amount"),
        F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias("code"), "o_orderpriority", F.struct(F.col("o_custkey").alias("a")).alias("nested"))
    return files.bronze(raw)


@query("schema_report", "SELECT 'c_custkey' AS name, 'bigint' AS dtype, 0.0::DOUBLE AS missing_pct UNION ALL SELECT 'odd', 'string', round(avg((c_nationkey <= 5)::INT), 6) FROM customer")
def _(t, spark):
    made = files.schema_report(t("customer").select("c_custkey", F.when(F.col("c_nationkey") > 5, F.col("c_name")).alias("odd")))
    return made.withColumn("missing_pct", r6("missing_pct"))


@query("messy_rows", "SELECT 5000::BIGINT AS n, 5000::BIGINT AS keys")
def _(t, spark):
    return messy.messy(spark, 5000).agg(F.count("*").alias("n"), F.countDistinct("row_id").alias("keys"))


@query("silver_order", "SELECT event_id AS row_id, ts AS event_time, row_number() OVER (ORDER BY ts, event_id) AS place FROM events")
def _(t, spark):
    made = pipeline.ordered_by(t("events").select(F.col("event_id").alias("row_id"), F.col("ts").alias("event_time")))
    w = ordered.numbered(made, ["event_time", "row_id"], "place")
    return w.select("row_id", "event_time", "place")


# order, quantiles, fills of the whole frame

_NULLED = "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END"


@query("impute_ordered_whole", f"""WITH s AS (SELECT event_id, ts, {_NULLED} AS v FROM events) SELECT event_id, last_value(v IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ff,
first_value(v IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bf FROM s""")
def _(t, spark):
    df = t("events").selectExpr("event_id", "ts", f"{_NULLED} AS v")
    made = frames.impute(df, "v", "ffill", ["ts", "event_id"], out="ff")
    return frames.impute(made, "v", "bfill", ["ts", "event_id"], out="bf").select("event_id", "ff", "bf")


@query("impute_interpolate_whole", f"""WITH s AS (SELECT event_id, {_NULLED} AS v, row_number() OVER (ORDER BY ts, event_id) AS i FROM events),
k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS i0, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS i1, last_value(v IGNORE NULLS) OVER a AS v0, first_value(v IGNORE NULLS) OVER b AS v1 FROM s
WINDOW a AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(coalesce(v, v0 + (v1 - v0) * (i - i0) / (i1 - i0), v0, v1), 6) AS v FROM k""")
def _(t, spark):
    made = frames.impute(t("events").selectExpr("event_id", "ts", f"{_NULLED} AS v"), "v", "interpolate", ["ts", "event_id"])
    return made.select("event_id", r6("v").alias("v"))


@query("fe_windows_whole", """SELECT event_id, lag(value) OVER w AS lag1, lead(value) OVER w AS lead1, CASE WHEN count(value) OVER r >= 3 THEN round(avg(value) OVER r, 6) END AS roll7, round((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6, 6) AS gap FROM events
WINDOW w AS (ORDER BY ts, event_id), r AS (ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def _(t, spark):
    from ..operators import features as fe

    o, df = ["ts", "event_id"], t("events")
    df = fe.shifted(fe.shifted(df, "value", o, "lag1"), "value", o, "lead1", step=-1)
    df = fe.interarrival(fe.rolling(df, "value", o, "roll7", 7, 3), "ts", o, "gap")
    return df.select("event_id", "lag1", "lead1", r6("roll7").alias("roll7"), r6("gap").alias("gap"))


@query("fe_ewm_whole", """WITH RECURSIVE s AS (SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) AS i FROM events), r AS (SELECT event_id, i, value AS y FROM s WHERE i = 1 UNION ALL SELECT s.event_id, s.i, 0.8 * r.y + 0.2 * s.value FROM r JOIN s ON s.i = r.i + 1)
SELECT event_id, round(y, 6) AS ewm FROM r""")
def _(t, spark):
    from ..operators import features as fe

    return fe.ewm_mean(t("events").select("event_id", "ts", "value"), "value", ["ts", "event_id"], "ewm").select("event_id", r6("ewm").alias("ewm"))


@query("quantiles_exact", "SELECT round(quantile_cont(l_extendedprice, 0.01), 6) AS a, round(median(l_extendedprice), 6) AS b, round(quantile_cont(l_quantity, 0.333), 6) AS c FROM lineitem")
def _(t, spark):
    x, y = F.col("l_extendedprice"), F.col("l_quantity")
    return spark.createDataFrame([tuple(round(v, 6) for v in ordered.quantiles(t("lineitem"), [(x, 0.01), (x, 0.5), (y, 0.333)]))], "a double, b double, c double")


# time


@query("time_periods", "SELECT event_id, date_trunc('month', ts)::TIMESTAMP AS low, CASE WHEN date_trunc('month', ts) = ts THEN ts ELSE (date_trunc('month', ts) + INTERVAL 1 MONTH)::TIMESTAMP END AS high, ts + INTERVAL 9 HOUR AS tokyo FROM events")
def _(t, spark):
    ts = F.col("ts")
    return t("events").select("event_id", periods.floor_period(ts, "M").alias("low"), periods.ceil_period(ts, "M").alias("high"), periods.to_zone(ts, "Asia/Tokyo").alias("tokyo"))


@query("time_frequency", """WITH d AS (SELECT us - lag(us) OVER (ORDER BY us) AS gap FROM (SELECT DISTINCT epoch_us(o_orderdate) AS us FROM orders)), g AS (SELECT gap, count(*) AS n FROM d WHERE gap IS NOT NULL GROUP BY 1)
SELECT gap, round(n / (SELECT sum(n) FROM g), 6)::DOUBLE AS share, n = (SELECT sum(n) FROM g) AS regular FROM g ORDER BY n DESC, gap LIMIT 1""")
def _(t, spark):
    return periods.infer_frequency(t("orders"), "o_orderdate").withColumn("share", r6("share"))


# p-values against their densities, summed up by DuckDB in 40,000 steps of the root of the value

_AREA = "2 * sum({density} * u * x * x) / 40000"
_CHI2 = "pow(u * u * x * x, {k} / 2.0 - 1) * exp(-u * u * x * x / 2) / (pow(2, {k} / 2.0) * gamma({k} / 2.0))"
_F = "sqrt(pow({a} * u * u * x * x, {a}) * pow({b}, {b}) / pow({a} * u * u * x * x + {b}, {a} + {b})) / (u * u * x * x) * gamma(({a} + {b}) / 2.0) / (gamma({a} / 2.0) * gamma({b} / 2.0))"
_T = "gamma(({k} + 1) / 2.0) / (sqrt({k} * pi()) * gamma({k} / 2.0)) * pow(1 + x * x * u * u / {k}, -({k} + 1) / 2.0)"
_P = [("z 1.96", "1.96", "1 - 2 * sum(exp(-u * u * x * x / 2) / sqrt(2 * pi()) * x) / 40000"), ("t 2.228 10", "2.228", f"1 - 2 * sum({_T.format(k=10)} * x) / 40000")]
_P += [(f"chi2 {x} {k}", f"sqrt({x})", f"1 - {_AREA.format(density=_CHI2.format(k=k))}") for x, k in (("3.841", 1), ("11.07", 5))]
_P += [(f"f {x} {a} {b}", f"sqrt({x})", f"1 - {_AREA.format(density=_F.format(a=a, b=b))}") for x, a, b in (("4.965", 1, 10), ("3.326", 5, 10))]


@query("p_values", "WITH s AS (SELECT (i + 0.5) / 40000 AS u FROM range(40000) AS r(i)) " + " UNION ALL ".join(f"SELECT '{n}' AS test, round({p}, 6)::DOUBLE AS p FROM s, (SELECT {x}::DOUBLE AS x)" for n, x, p in _P) + " UNION ALL SELECT 'z nan', 1.0")
def _(t, spark):
    got = [("z 1.96", pvalues.z_two_tailed(1.96)), ("t 2.228 10", pvalues.t_two_tailed(2.228, 10)), ("chi2 3.841 1", pvalues.chi2_sf(3.841, 1)), ("chi2 11.07 5", pvalues.chi2_sf(11.07, 5)), ("f 4.965 1 10", pvalues.f_sf(4.965, 1, 10)), ("f 3.326 5 10", pvalues.f_sf(3.326, 5, 10)), ("z nan", pvalues.z_two_tailed(float("nan")))]
    return spark.createDataFrame([(n, round(p, 6)) for n, p in got], "test string, p double")


# topics


_METRICS = ("o_custkey", "o_totalprice")


@query("topics_base", """WITH m AS (SELECT 'o_totalprice' AS f, o_totalprice AS v FROM orders UNION ALL SELECT 'o_custkey', o_custkey FROM orders), a AS (SELECT f, count(v) AS n, avg(v) AS m, stddev_samp(v) AS s, greatest(abs(max(v) - avg(v)), abs(min(v) - avg(v))) AS far, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM m GROUP BY 1),
g AS (SELECT o_orderstatus AS c, sum(o_totalprice) AS t FROM orders GROUP BY 1)
SELECT 'kpi' AS family, f AS fields, n AS n_obs, 0.0::DOUBLE AS effect FROM a UNION ALL SELECT 'distribution', f, n, round(iqr / abs(m), 6) FROM a UNION ALL SELECT 'deviation', f, n, round(far / s, 6) FROM a
UNION ALL SELECT 'correlation', 'o_custkey,o_totalprice', count(*), round(abs(corr(o_custkey, o_totalprice)), 6) FROM orders
UNION ALL SELECT 'correlation', m || ',o_orderstatus', n, round(e, 6) FROM (SELECT 'o_totalprice' AS m, count(*) AS n, 1 - sum(w) / sum(t) AS e FROM (SELECT (o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_orderstatus)) ^ 2 AS w, (o_totalprice - avg(o_totalprice) OVER ()) ^ 2 AS t FROM orders)
UNION ALL SELECT 'o_custkey', count(*), 1 - sum(w) / sum(t) FROM (SELECT (o_custkey - avg(o_custkey) OVER (PARTITION BY o_orderstatus)) ^ 2 AS w, (o_custkey - avg(o_custkey) OVER ()) ^ 2 AS t FROM orders))""")
def _(t, spark):
    df = t("orders").select(*_METRICS, "o_orderstatus")
    r = topics.Roles(None, None, list(_METRICS), ["o_orderstatus"])
    found = [x for x in topics.base_candidates(df, r) if x.family in ("kpi", "distribution", "deviation", "correlation")]
    return spark.createDataFrame([(x.family, ",".join(x.primary), x.n_obs, round(x.effect, 6)) for x in found], "family string, fields string, n_obs long, effect double")


@query("topics_engineered", """SELECT * FROM (VALUES ('distribution', 'value', 'zscore_wins(value)'), ('trend', 'value', 'zscore_wins(value)'), ('ranking', 'ts', 'day_of_week'), ('distribution', 'ts,user_id', 'interarrival_seconds'), ('trend', 'value', 'lag1_value'), ('trend', 'value', 'lag1_value_by_user_id'),
('trend', 'value', 'lag1_value_by_event_type'), ('ranking', 'event_type,value', ''), ('part_to_whole', 'event_type,value', ''), ('ranking', 'event_type,__row_count__', '')) AS e(family, fields, feature)""")
def _(t, spark):
    r = topics.Roles("ts", "user_id", ["value"], ["event_type"])
    df = t("events").withColumn("value", F.pmod(F.col("event_id") * 7919, F.lit(1000)).cast("double"))  # no skew, no association
    seen = topics.Seen.of(df, r)
    found = [x for x in planner.engineered(df, r, seen) if x.family != "correlation"]
    plain = lambda x: x.detail.get("feature_plan", [{}])[0].get("name", "")
    return spark.createDataFrame([(x.family, ",".join(x.primary), plain(x)) for x in found], "family string, fields string, feature string")


@query("topics_causal", "SELECT round((avg(value) FILTER (user_id % 2 = 1) - avg(value) FILTER (user_id % 2 = 0)) / stddev_samp(value), 6) AS effect, count(*) FILTER (user_id % 2 = 1) AS n_treated, count(*) FILTER (user_id % 2 = 0) AS n_control FROM events")
def _(t, spark):
    df = t("events").withColumn("variant", F.when(F.col("user_id") % 2 == 1, "b").otherwise("a"))
    r = topics.Roles(None, None, ["value"], ["variant"])
    made = topics.as_frame(spark, [x for x in planner.engineered(df, r, topics.Seen.of(df, r)) if x.family == "causal"]).first()
    return topics.materialize(df, made).select(r6("effect").alias("effect"), "n_treated", "n_control")


@query("topics_counts", "SELECT event_type AS cat, count(*) AS count FROM events GROUP BY 1")
def _(t, spark):
    df = t("events")
    r = topics.Roles(None, None, ["value"], ["event_type"])
    found = [x for x in planner.engineered(df, r, topics.Seen.of(df, r)) if x.kind == "count_table"]
    return topics.materialize(df, topics.as_frame(spark, found).first())


@query("topics_fallback", "SELECT * FROM (VALUES ('kpi', 'value', 1.0::DOUBLE), ('trend', 'value', 0.95), ('ranking', 'event_type,value', 0.9), ('distribution', 'value', 0.88)) AS f(family, fields, score)")
def _(t, spark):
    df = t("events")
    r = topics.Roles("ts", None, ["value"], ["event_type"])
    found = planner.fallback(df, r, topics.Seen.of(df, r))
    return spark.createDataFrame([(x.family, ",".join(x.primary), s) for x, s in found], "family string, fields string, score double")


@query("topics_deviation", "SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS index, value, round((value - avg(value) OVER ()) / stddev_samp(value) OVER (), 6) AS z FROM events")
def _(t, spark):
    one = topics.as_frame(spark, [topics.Topic("deviation", ["value"])]).first()
    return topics.materialize(t("events"), one, ["ts", "event_id"]).withColumn("z", r6("z"))


@query("gold_charts", "SELECT * FROM (VALUES ('trend', 'line'), ('trend', 'column'), ('kpi', 'kpi'), ('ranking', 'ordered_bar'), ('ranking', 'ordered_column')) AS c(family, chart)")
def _(t, spark):
    some = [topics.Topic("trend", ["value"], charts=topics.CHARTS["trend"], time="ts"), topics.Topic("kpi", ["value"], charts=["kpi"]), topics.Topic("ranking", ["event_type", "value"], charts=topics.CHARTS["ranking"])]
    out = []
    for r in topics.as_frame(spark, some).collect():
        out += [(r.family, c["chart"]) for c in layout.charts(r, "x", topics.materialize(t("events"), r).columns, 2)]
    return spark.createDataFrame(out, "family string, chart string")


@query("layout_badges", "SELECT * FROM (VALUES ('kpi', 'key-metric'), ('correlation', 'significant,low-coverage'), ('causal', 'causal')) AS b(family, badges)")
def _(t, spark):
    some = [topics.Topic("kpi", ["a"]), topics.Topic("correlation", ["a", "b"], significance={"p_value": 0.01}, coverage=0.4), topics.Topic("causal", ["a"])]
    return spark.createDataFrame([(r.family, ",".join(layout.badges(r))) for r in topics.as_frame(spark, some).collect()], "family string, badges string")


@query("layout_manifest", """SELECT '{"charts": [], "components": [{"name": "a"}], "counts": {"charts": 0, "components": 1}}' AS manifest""")
def _(t, spark):
    return spark.createDataFrame([(json.dumps(layout.manifest([{"name": "a"}]), sort_keys=True),)], "manifest string")


@query("profile_conditions", "SELECT column_name, missing_pct > 0.1 AS gaps, nunique = 1 AS constant FROM (SELECT 'odd' AS column_name, avg((event_id % 4 = 0)::INT) AS missing_pct, 2 AS nunique FROM events UNION ALL SELECT 'same', 0, 1)")
def _(t, spark):
    from . import dsl

    found = profile.facts(t("events").select(F.when(F.col("event_id") % 4 > 0, F.col("event_id") % 2).alias("odd"), F.lit("x").alias("same")))
    test = lambda text, f: dsl.compile_facts(text)(f)
    return spark.createDataFrame([(c, test("missing_pct > 0.1", f), test("nunique == 1", f)) for c, f in found.items()], "column_name string, gaps boolean, constant boolean")


@query("sample_by_hash", "SELECT o_orderkey FROM orders WHERE substr(md5('42|' || o_orderkey::VARCHAR), 1, 8) < '40000000'")
def _(t, spark):
    return frames.hash_sample(t("orders"), 0.25, ["o_orderkey"]).select("o_orderkey")


@query("topics_best_metric", """WITH m AS (SELECT 'l_quantity' AS m, count(l_quantity) AS n, stddev_samp(l_quantity) AS s FROM lineitem UNION ALL SELECT 'l_tax', count(l_tax), stddev_samp(l_tax) FROM lineitem
UNION ALL SELECT 'odd', count(CASE WHEN l_orderkey % 2 = 0 THEN l_extendedprice END), stddev_samp(CASE WHEN l_orderkey % 2 = 0 THEN l_extendedprice END) FROM lineitem) SELECT m AS metric FROM m ORDER BY n DESC, s DESC LIMIT 1""")
def _(t, spark):
    df = t("lineitem").withColumn("odd", F.when(F.col("l_orderkey") % 2 == 0, F.col("l_extendedprice")))
    r = topics.Roles(None, None, ["l_tax", "l_quantity", "odd"], [])
    return spark.createDataFrame([(planner.best_metric(r, topics.Seen.of(df, r)),)], "metric string")


@query("row_hashes", "SELECT c_custkey, substr(sha256('=' || c_custkey || chr(31) || CASE WHEN c_nationkey > 5 THEN '=' || c_name ELSE '' END), 1, 16) AS hash FROM customer")
def _(t, spark):
    return t("customer").select("c_custkey", ids.row_hash(F.col("c_custkey"), F.when(F.col("c_nationkey") > 5, F.col("c_name")), size=16).alias("hash"))


@query("ids", "SELECT 'my-set-2024' AS slug, substr(sha256('[\"a\", 1]'), 1, 8) AS id")
def _(t, spark):
    return spark.createDataFrame([(ids.dataset_slug("My Set!", "2024"), ids.short_id(["a", 1]))], "slug string, id string")


@query("profile_coverage", "SELECT round(avg((event_id % 7 > 0 AND event_id % 3 > 0)::INT), 6)::DOUBLE AS coverage FROM events")
def _(t, spark):
    df = t("events").selectExpr("CASE WHEN event_id % 7 > 0 THEN value END AS a", "CASE WHEN event_id % 3 > 0 THEN value END AS b")
    return profile.coverage(df, ["a", "b", "none"]).withColumn("coverage", r6("coverage"))


@query("rules_improvement", "SELECT round(avg((event_id % 7 = 0)::INT) / 2 + 0.25, 6)::DOUBLE AS better FROM events")
def _(t, spark):
    df = t("events").selectExpr("event_id", "CASE WHEN event_id % 7 > 0 THEN concat('$', cast(value AS string)) END AS amount")
    own = [pack.Rule("a", 2, "name == 'amount'", "coerce_numeric()"), pack.Rule("b", 1, "name == 'amount'", "impute('median')")]
    made = rules.clean(df, own, roles.derived(df))
    return spark.createDataFrame([(round(rules.improvement(made.before, made.after), 6),)], "better double")


@query("rules_follow_ups", "SELECT * FROM (VALUES ('amount', 'coerce_numeric()'), ('word', 'coerce_bool()')) AS f(col, action)")
def _(t, spark):
    df = t("orders").select(F.format_number("o_totalprice", 2).alias("amount"), F.when(F.col("o_orderkey") % 2 == 0, "yes").otherwise("no").alias("word"))
    found = profile.facts(df)
    schema = roles.Schema("", [roles.ColumnSchema(c, "string", "text", 0.5) for c in df.columns])
    todo = rules.follow_ups(schema, found)
    return spark.createDataFrame([(c, todo[c][0]) for c in df.columns], "col string, action string")


@query("layout_plan", "SELECT 'trend: value' AS title, 'line' AS chart, 2::BIGINT AS place UNION ALL SELECT 'kpi: value', 'kpi', 1")
def _(t, spark):
    some = topics.as_frame(spark, [topics.Topic("trend", ["value"], charts=["line"]), topics.Topic("kpi", ["value"])]).withColumn("score_total", F.when(F.col("family") == "kpi", 9.0).otherwise(1.0))
    made = layout.plan(some, "events")["sections"]
    return spark.createDataFrame([(s["title"], s["chart"], i + 1) for i, s in enumerate(made)], "title string, chart string, place long")


@query("narrative", "SELECT '# events' || chr(10) || chr(10) || '## Files' || chr(10) || '- parquet events: 1' || chr(10) || chr(10) || '## Topics' || chr(10) || '- kpi: value (score 2.50)' || chr(10) AS text, 1::BIGINT AS topics")
def _(t, spark):
    counts = spark.createDataFrame([("parquet", "events", 1)], "kind string, slug string, n long").collect()
    chosen = topics.as_frame(spark, [topics.Topic("kpi", ["value"])]).withColumn("score_total", F.lit(2.5)).collect()
    made = layout.payload("events", counts, chosen)
    return spark.createDataFrame([(made["text"], len(made["topics"]))], "text string, topics long")


@query("suggested_actions", "SELECT * FROM (VALUES ('a', '{\"drop\": true, \"normalize\": {\"lower\": false, \"strip\": true}}'), ('b', '{\"drop\": false, \"impute\": \"median\"}'), ('c', '{\"drop\": false, \"flag_low_uniqueness_for_id\": true}')) AS s(col, todo)")
def _(t, spark):
    m = lambda cover, unique: {"non_null_ratio": cover, "unique_ratio": unique}
    got = [("a", pipeline.suggested("string", "text", m(0.05, 0.1))), ("b", pipeline.suggested("float", "numeric", m(0.9, 0.5))), ("c", pipeline.suggested("int", "id", m(1.0, 0.5)))]
    return spark.createDataFrame([(c, json.dumps(x, sort_keys=True)) for c, x in got], "col string, todo string")
