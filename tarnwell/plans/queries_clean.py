"""Cleaning queries: dirty text is made from the tables' values inside the query, on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import frames
from .catalogue import query

r6 = lambda c: F.round(c, 6)

DIRTY = {0: "concat('$', p)", 1: "concat(p, '%')", 2: "concat('(', p, ')')", 3: "concat(p, 'k')", 4: "concat(' ', p, ' ')", 5: "'n/a'", 6: "p"}
_CASES = " ".join(f"WHEN o_orderkey % 7 = {k} THEN {v}" for k, v in DIRTY.items())


def _dirty(t):
    return t("orders").selectExpr("o_orderkey", "format_string('%.2f', o_totalprice) AS p").selectExpr("o_orderkey", "p", f"CASE {_CASES} END AS dirty")


_DIRTY_SQL = f"d AS (SELECT o_orderkey, p, CASE {_CASES} END AS dirty FROM (SELECT o_orderkey, printf('%.2f', o_totalprice) AS p FROM orders))"


@query("clean_coerce_numeric", f"""WITH {_DIRTY_SQL}
SELECT o_orderkey, round(CASE o_orderkey % 7 WHEN 1 THEN p::DOUBLE * 0.01 WHEN 2 THEN -(p::DOUBLE) WHEN 3 THEN p::DOUBLE * 1000 WHEN 5 THEN NULL ELSE p::DOUBLE END, 6) AS value FROM d""")
def _(t, spark):
    return _dirty(t).select("o_orderkey", r6(V.coerce_numeric(F.col("dirty"))).alias("value"))


@query("clean_coerce_robust", f"""WITH {_DIRTY_SQL}
SELECT o_orderkey, round(CASE o_orderkey % 7 WHEN 1 THEN p::DOUBLE * 0.01 WHEN 2 THEN -(p::DOUBLE) WHEN 5 THEN NULL ELSE p::DOUBLE END, 6) AS value FROM d""")
def _(t, spark):
    return _dirty(t).select("o_orderkey", r6(V.coerce_robust(F.col("dirty"))).alias("value"))


@query("clean_clip", "SELECT c_custkey, least(greatest(c_acctbal, 0.0::DOUBLE), 5000.0::DOUBLE) AS value FROM customer")
def _(t, spark):
    return t("customer").select("c_custkey", V.clip(F.col("c_acctbal"), 0, 5000).alias("value"))


@query("clean_enforce_sign", """SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS positive, greatest(c_acctbal, 0.0::DOUBLE) AS nonnegative,
CASE WHEN c_acctbal < 0 THEN c_acctbal END AS negative FROM customer""")
def _(t, spark):
    return t("customer").select("c_custkey", *[V.enforce_sign(F.col("c_acctbal"), s).alias(s) for s in ("positive", "nonnegative", "negative")])


@query("clean_zero_as_missing", "SELECT l_orderkey, l_linenumber, CASE WHEN abs(l_discount) > 0.005 THEN l_discount END AS value FROM lineitem")
def _(t, spark):
    return t("lineitem").select("l_orderkey", "l_linenumber", V.zero_as_missing(F.col("l_discount"), 0.005).alias("value"))


@query("clean_percent_units", "SELECT l_orderkey, l_linenumber, round(CASE WHEN v > 1 THEN v / 100 ELSE v END, 6) AS value FROM (SELECT *, CASE WHEN l_linenumber < 5 THEN l_discount * 100 ELSE l_discount END AS v FROM lineitem)")
def _(t, spark):
    made = t("lineitem").withColumn("v", F.when(F.col("l_linenumber") < 5, F.col("l_discount") * 100).otherwise(F.col("l_discount")))
    return frames.standardize_percent(made, "v").select("l_orderkey", "l_linenumber", r6("v").alias("value"))


@query("clean_text_normalize", r"""SELECT doc_id, nullif(lower(trim(regexp_replace(translate(left(text, 200), '‘’“”–—−' || chr(160), '''''""--- '), '\s+', ' ', 'g'))), '') AS value FROM documents""")
def _(t, spark):
    return t("documents").select("doc_id", V.text_normalize(F.substring("text", 1, 200), lower=True).alias("value"))


@query("clean_null_tokens", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS value FROM events")
def _(t, spark):
    made = F.when(F.col("event_id") % 10 == 0, " N/A ").when(F.col("event_id") % 5 == 0, "<null>").otherwise(F.concat(F.col("event_type"), F.lit("  ")))
    return t("events").select("event_id", V.null_tokens(made).alias("value"))


@query("clean_coerce_bool", """SELECT event_id, CASE event_type WHEN 'view' THEN true WHEN 'click' THEN false WHEN 'signup' THEN true WHEN 'error' THEN false END AS value FROM events""")
def _(t, spark):
    made = F.when(F.col("event_type") == "view", "(YES!)").when(F.col("event_type") == "click", " off ").when(F.col("event_type") == "signup", "1.0").when(F.col("event_type") == "error", "0").otherwise("2")
    return t("events").select("event_id", V.coerce_bool(made).alias("value"))


@query("clean_regex_replace", r"SELECT c_custkey, regexp_replace(c_name, '(\w+)#0*(\d+)', '\2:\1') AS value FROM customer")
def _(t, spark):
    return t("customer").select("c_custkey", V.regex_replace(F.col("c_name"), r"(?P<w>\w+)#0*(\d+)", r"\2:\g<w>").alias("value"))


@query("clean_regex_replace_first", "SELECT p_partkey, CASE WHEN strpos(substr(p_name, 2), 'e') > 0 THEN substr(p_name, 1, strpos(substr(p_name, 2), 'e')) || 'E' || substr(p_name, strpos(substr(p_name, 2), 'e') + 2) WHEN p_name LIKE 'e%' THEN 'E' || substr(p_name, 2) ELSE p_name END AS value FROM part")
def _(t, spark):
    return t("part").select("p_partkey", V.regex_replace(F.col("p_name"), "e", "E", count=1).alias("value"))


@query("clean_extract_digits", "SELECT c_custkey, regexp_replace(c_name, '[^0-9]', '', 'g') AS value FROM customer")
def _(t, spark):
    return t("customer").select("c_custkey", V.extract_digits(F.col("c_name")).alias("value"))


@query("clean_zero_pad", "SELECT c_custkey, lpad(c_custkey::VARCHAR, greatest(4, length(c_custkey::VARCHAR))::INT, '0') AS value, CASE WHEN c_custkey % 2 = 0 THEN '-' ELSE '' END || lpad(c_custkey::VARCHAR, greatest(6, length(c_custkey::VARCHAR))::INT, '0') AS numeric FROM customer")
def _(t, spark):
    raw = F.concat(F.lit(" INV"), F.when(F.col("c_custkey") % 2 == 0, "-").otherwise(""), F.col("c_custkey").cast("string"), F.lit(" "))
    return t("customer").select("c_custkey", V.zero_pad(F.col("c_custkey"), 4).alias("value"), V.zero_pad(raw, 6, numeric_only=True).alias("numeric"))


@query("clean_keep_alnum", "SELECT c_custkey, upper(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) AS value FROM customer")
def _(t, spark):
    return t("customer").select("c_custkey", V.keep_alnum(F.col("c_name"), case="upper").alias("value"))


@query("clean_rare_categories", "WITH c AS (SELECT p_name, count(*)::DOUBLE / sum(count(*)) OVER () AS s FROM part GROUP BY 1) SELECT p_partkey, CASE WHEN s < 0.016 THEN 'Other' ELSE p.p_name END AS value FROM part p JOIN c USING (p_name)")
def _(t, spark):
    return frames.rare_categories(t("part"), "p_name", 0.016).select("p_partkey", F.col("p_name").alias("value"))


@query("clean_map_synonyms", "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1-%' OR o_orderpriority LIKE '2-%' THEN 'top' ELSE o_orderpriority END AS value FROM orders")
def _(t, spark):
    return t("orders").select("o_orderkey", V.map_synonyms(F.col("o_orderpriority"), {" 1-urgent ": "top", "2-HIGH": "top"}).alias("value"))


@query("clean_extract_key", r"SELECT c_custkey, coalesce(nullif(regexp_extract(c_name, '#0*([1-9])', 1), ''), 'Unknown') AS value FROM customer")
def _(t, spark):
    return t("customer").select("c_custkey", V.extract_key(F.col("c_name"), [r"#0*([1-9])"], 1, "Unknown").alias("value"))


@query("clean_extract_anchor", """WITH w AS (SELECT p_partkey, unnest(list_filter(string_split_regex(lower(p_name), '[^a-z]+'), lambda x: length(x) >= 3)) AS w FROM part),
f AS (SELECT w, count(*) AS n FROM w GROUP BY 1), m AS (SELECT w AS top FROM f ORDER BY n DESC, length(w) DESC, w DESC LIMIT 1)
SELECT p_partkey, w AS value FROM (SELECT w.p_partkey, w.w, row_number() OVER (PARTITION BY w.p_partkey ORDER BY f.n DESC, levenshtein(w.w, m.top), length(w.w) DESC, w.w) AS i FROM w JOIN f USING (w) CROSS JOIN m) WHERE i = 1""")
def _(t, spark):
    return frames.extract_anchor(t("part"), "p_name", out="value").select("p_partkey", "value")


@query("clean_fuzzy_map", "SELECT c_custkey, c_mktsegment AS value FROM customer")
def _(t, spark):
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    typo = F.concat(F.substring("c_mktsegment", 1, 3), F.lit("x"), F.substring("c_mktsegment", 4, 20))
    return t("customer").select("c_custkey", V.nearest(typo, segments).alias("value"))


@query("clean_parse_formats", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE date_trunc('day', o_orderdate)::TIMESTAMP END AS value FROM orders")
def _(t, spark):
    made = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "M/d/yyyy")).otherwise("soon")
    return t("orders").select("o_orderkey", V.parse_datetime(made).alias("value"))


@query("clean_parse_robust", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN NULL ELSE date_trunc('day', o_orderdate)::TIMESTAMP END AS value FROM orders")
def _(t, spark):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    day = F.date_trunc("day", d)
    made = F.when(k == 0, F.date_format(d, "MMM d, yyyy")).when(k == 1, F.concat(F.lit("due "), F.date_format(d, "yyyy-MM-dd"), F.lit(" latest"))).when(k == 2, F.unix_seconds(day.cast("timestamp")).cast("string"))
    made = made.when(k == 3, F.unix_micros(day.cast("timestamp")).cast("string")).otherwise("never")
    return t("orders").select("o_orderkey", V.parse_robust(made).alias("value"))


@query("clean_parse_epoch", "SELECT event_id, date_trunc('second', ts)::TIMESTAMP AS value FROM events")
def _(t, spark):
    made = t("events").withColumn("e", F.unix_seconds(F.col("ts").cast("timestamp")) * 1000)
    return frames.parse_epochs(made, "e").select("event_id", F.col("e").alias("value"))


@query("clean_extract_datetime", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS value FROM events")
def _(t, spark):
    made = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "'at' yyyy-MM-dd '!'")).otherwise(F.date_format("ts", "'on' yyyyMMdd"))
    return t("events").select("event_id", V.extract_datetime(made).alias("value"))


@query("clean_dt_step", """SELECT event_id, date_trunc('day', ts)::TIMESTAMP AS floor_day, time_bucket(INTERVAL '15 minutes', ts)::TIMESTAMP AS floor_15,
CASE WHEN date_trunc('hour', ts) = ts THEN ts ELSE date_trunc('hour', ts) + INTERVAL 1 HOUR END::TIMESTAMP AS ceil_hour,
CASE WHEN ts - date_trunc('day', ts) > INTERVAL 12 HOUR OR (ts - date_trunc('day', ts) = INTERVAL 12 HOUR AND (epoch(date_trunc('day', ts)) / 86400)::BIGINT % 2 = 1) THEN date_trunc('day', ts) + INTERVAL 1 DAY ELSE date_trunc('day', ts) END::TIMESTAMP AS round_day FROM events""")
def _(t, spark):
    ts = F.col("ts")
    return t("events").select("event_id", V.dt_step(ts, "D", "floor").alias("floor_day"), V.dt_step(ts, "15min", "floor").alias("floor_15"), V.dt_step(ts, "H", "ceil").alias("ceil_hour"), V.dt_step(ts, "D").alias("round_day"))


@query("clean_dt_parts", """SELECT o_orderkey, date_trunc('day', o_orderdate)::TIMESTAMP AS date, strftime(o_orderdate, '%H:%M:%S') AS time, year(o_orderdate) AS year, quarter(o_orderdate) AS quarter, month(o_orderdate) AS month,
day(o_orderdate) AS day, dayofyear(o_orderdate) AS dayofyear, hour(o_orderdate) AS hour, minute(o_orderdate) AS minute, second(o_orderdate) AS second, isodow(o_orderdate) - 1 AS weekday, week(o_orderdate) AS week,
isoyear(o_orderdate) AS iso_year, week(o_orderdate) AS iso_week, isodow(o_orderdate) AS iso_day, monthname(o_orderdate) AS month_name, dayname(o_orderdate) AS day_name FROM orders""")
def _(t, spark):
    return t("orders").select("o_orderkey", *[V.dt_part(F.col("o_orderdate"), p).alias(p) for p in V.PARTS])


def _gaps(t):
    return t("events").select("event_id", "user_id", "ts", "event_type", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("x"))


_GAPS = "g AS (SELECT event_id, user_id, ts, event_type, CASE WHEN event_id % 7 <> 0 THEN value END AS x FROM events)"

for _m, _f in (("mean", "avg(x)"), ("median", "median(x)")):

    @query(f"impute_{_m}", f"WITH {_GAPS} SELECT event_id, round(coalesce(x, (SELECT {_f} FROM g)), 6) AS value FROM g")
    def _(t, spark, m=_m):
        return frames.impute(_gaps(t), "x", m).select("event_id", r6("x").alias("value"))


@query("impute_mode", "WITH g AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN event_type END AS x FROM events) SELECT event_id, coalesce(x, (SELECT x FROM g WHERE x IS NOT NULL GROUP BY x ORDER BY count(*) DESC, x LIMIT 1)) AS value FROM g")
def _(t, spark):
    made = t("events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("x"))
    return frames.impute(made, "x", "mode").select("event_id", F.col("x").alias("value"))


@query("impute_constant", f"WITH {_GAPS} SELECT event_id, coalesce(x, 0.0::DOUBLE) AS value FROM g")
def _(t, spark):
    return frames.impute(_gaps(t), "x", "constant", value=0.0).select("event_id", F.col("x").alias("value"))


@query("impute_ffill", f"WITH {_GAPS} SELECT event_id, last_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM g")
def _(t, spark):
    return frames.impute(_gaps(t), "x", "ffill", ["ts", "event_id"], ["user_id"]).select("event_id", F.col("x").alias("value"))


@query("impute_bfill", f"WITH {_GAPS} SELECT event_id, first_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM g")
def _(t, spark):
    return frames.impute(_gaps(t), "x", "bfill", ["ts", "event_id"], ["user_id"]).select("event_id", F.col("x").alias("value"))


@query("impute_interpolate", f"""WITH {_GAPS}, n AS (SELECT *, row_number() OVER w AS i FROM g WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
k AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER a AS i0, last_value(x IGNORE NULLS) OVER a AS x0, first_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER b AS i1, first_value(x IGNORE NULLS) OVER b AS x1 FROM n
WINDOW a AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(coalesce(x, x0 + (x1 - x0) * (i - i0) / nullif(i1 - i0, 0), x0, x1), 6) AS value FROM k""")
def _(t, spark):
    return frames.impute(_gaps(t), "x", "interpolate", ["ts", "event_id"], ["user_id"]).select("event_id", r6("x").alias("value"))


@query("impute_time_median", "WITH g AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN epoch_us(ts) END AS x FROM events) SELECT event_id, coalesce(x, (SELECT floor(median(x))::BIGINT FROM g)) AS value FROM g")
def _(t, spark):
    made = t("events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.unix_micros(F.col("ts").cast("timestamp"))).alias("x"))
    return frames.impute(made, "x", "median").select("event_id", F.floor("x").alias("value"))


@query("outliers_mad", "WITH m AS (SELECT median(l_extendedprice) AS m, mad(l_extendedprice) AS d FROM lineitem) SELECT l_orderkey, l_linenumber, abs(0.6745 * (l_extendedprice - m) / d) > 1.5 AS outlier FROM lineitem, m")
def _(t, spark):
    return frames.outliers(t("lineitem"), "l_extendedprice", z=1.5, out="outlier").select("l_orderkey", "l_linenumber", "outlier")


@query("outliers_iqr", "WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders) SELECT o_orderkey, o_totalprice < a - 0.3 * (b - a) OR o_totalprice > b + 0.3 * (b - a) AS outlier FROM orders, q")
def _(t, spark):
    return frames.outliers(t("orders"), "o_totalprice", "iqr", k=0.3, out="outlier").select("o_orderkey", "outlier")


@query("outliers_drop", "WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders) SELECT o_orderkey, CASE WHEN o_totalprice BETWEEN a - 0.3 * (b - a) AND b + 0.3 * (b - a) THEN o_totalprice END AS value FROM orders, q")
def _(t, spark):
    return frames.outliers(t("orders"), "o_totalprice", "iqr", k=0.3, handle="drop").select("o_orderkey", F.col("o_totalprice").alias("value"))


@query("outliers_winsorize", "WITH q AS (SELECT quantile_cont(o_totalprice, 0.05) AS a, quantile_cont(o_totalprice, 0.95) AS b FROM orders) SELECT o_orderkey, round(least(greatest(o_totalprice, a), b), 6) AS value FROM orders, q")
def _(t, spark):
    return frames.outliers(t("orders"), "o_totalprice", handle="winsorize", limits=(0.05, 0.95)).select("o_orderkey", r6("o_totalprice").alias("value"))


@query("column_stats", "SELECT column_name, count(*) AS rows, count(v) AS non_null, round(1 - count(v)::DOUBLE / count(*), 6) AS missing_pct, count(DISTINCT v) AS nunique, round(count(DISTINCT v)::DOUBLE / count(*), 6) AS unique_ratio FROM (SELECT unnest(['c_custkey', 'c_mktsegment', 'c_nationkey']) AS column_name, unnest([c_custkey::VARCHAR, c_mktsegment, CASE WHEN c_nationkey > 5 THEN c_nationkey::VARCHAR END]) AS v FROM customer) GROUP BY 1")
def _(t, spark):
    made = frames.column_stats(t("customer").select("c_custkey", "c_mktsegment", F.when(F.col("c_nationkey") > 5, F.col("c_nationkey")).alias("c_nationkey")))
    return made.withColumns({c: r6(c) for c in ("missing_pct", "unique_ratio")})


@query("prune", "SELECT c_custkey, c_mktsegment FROM customer")
def _(t, spark):
    made = t("customer").select("c_custkey", "c_mktsegment", F.when(F.col("c_custkey") < 3, F.lit(1)).alias("sparse"), F.lit("x").alias("constant"))
    return frames.prune(made, 0.9, 0.001)[0]


@query("quarantine", "SELECT c_custkey, c_name AS __quarantine__c_name FROM customer")
def _(t, spark):
    return frames.quarantine(frames.quarantine(t("customer").select("c_custkey", "c_name"), ["c_custkey"]), ["c_custkey"])
