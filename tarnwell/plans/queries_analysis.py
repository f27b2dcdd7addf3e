"""Statistics, features and gold components."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as fe
from ..operators import gold, roles, stats, topics
from ..operators import profile as pr
from ..streaming import windows
from . import rules
from .catalogue import query

r6 = lambda c: F.round(c, 6)


def rounded(df, *cols, places=6):
    return df.withColumns({c: F.round(c, places) for c in cols})


@query("gold_trend", "SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS time, round(avg(o_totalprice), 6) AS value FROM orders GROUP BY 1")
def _(t, spark):
    return rounded(gold.trend(t("orders"), "o_orderdate", "o_totalprice"), "value")


@query("gold_kpi", "SELECT 'o_totalprice' AS metric_name, round(avg(o_totalprice), 6) AS value FROM orders")
def _(t, spark):
    return rounded(gold.kpi(t("orders"), "o_totalprice"), "value")


@query("gold_corr_pairs", "SELECT l_quantity AS a, l_extendedprice AS b FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL")
def _(t, spark):
    return gold.correlation_pairs(t("lineitem"), "l_quantity", "l_extendedprice")


@query("gold_num_cat", "SELECT l_returnflag AS cat, round(avg(l_extendedprice), 6) AS mean, count(*) AS count FROM lineitem GROUP BY 1")
def _(t, spark):
    return rounded(gold.by_category(t("lineitem"), "l_returnflag", "l_extendedprice"), "mean")


@query("gold_ranking_sum", "SELECT n_name AS cat, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def _(t, spark):
    met = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return gold.ranking(met, "n_name", "o_totalprice").withColumn("total", F.round("total", 2))


@query("gold_ranking_count", "SELECT event_type AS cat, count(*) AS count FROM events GROUP BY 1")
def _(t, spark):
    return gold.ranking(t("events"), "event_type")


@query("gold_p2w_sum", "SELECT o_orderpriority AS cat, round(sum(o_totalprice), 2) AS total, round(sum(o_totalprice) / sum(sum(o_totalprice)) OVER (), 6) AS pct_total FROM orders GROUP BY 1")
def _(t, spark):
    return rounded(gold.part_to_whole(t("orders"), "o_orderpriority", "o_totalprice"), "pct_total").withColumn("total", F.round("total", 2))


@query("gold_p2w_count", "SELECT l_returnflag AS cat, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS pct_total FROM lineitem GROUP BY 1")
def _(t, spark):
    return rounded(gold.part_to_whole(t("lineitem"), "l_returnflag"), "pct_total")


@query("gold_distribution", "SELECT value FROM events WHERE value IS NOT NULL")
def _(t, spark):
    return gold.distribution(t("events"), "value")


@query("gold_deviation", "SELECT o_orderkey AS key, o_totalprice AS value, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_samp(o_totalprice) OVER (), 6) AS z FROM orders")
def _(t, spark):
    return rounded(gold.deviation(t("orders"), "o_orderkey", "o_totalprice"), "z")


@query("gold_cohort", """WITH s AS (SELECT DISTINCT o_custkey, date_trunc('month', o_orderdate)::TIMESTAMP AS m FROM orders), f AS (SELECT *, min(m) OVER (PARTITION BY o_custkey) AS f FROM s),
c AS (SELECT f AS first_seen, ((year(m) - year(f)) * 12 + month(m) - month(f))::INT AS age, count(*) AS retained FROM f GROUP BY 1, 2)
SELECT *, first_value(retained) OVER w AS cohort_size, round(least(1.0, retained::DOUBLE / first_value(retained) OVER w), 6) AS retention_pct FROM c WINDOW w AS (PARTITION BY first_seen ORDER BY age)""")
def _(t, spark):
    return rounded(gold.cohort(t("orders"), "o_custkey", "o_orderdate"), "retention_pct")


@query("gold_dow", "SELECT dayname(ts) AS day_of_week, round(sum(value), 4) AS total FROM events GROUP BY 1")
def _(t, spark):
    return gold.day_of_week(t("events"), "ts", "value").withColumn("total", F.round("total", 4))


@query("gold_hod", "SELECT hour(ts)::VARCHAR AS hour_of_day, round(sum(value), 4) AS total FROM events GROUP BY 1")
def _(t, spark):
    return gold.hour_of_day(t("events"), "ts", "value").withColumn("total", F.round("total", 4))


@query("gold_rate", "SELECT c_custkey AS key, round(CASE WHEN c_acctbal / nullif(c_nationkey, 0) < 0 THEN 0 ELSE c_acctbal / nullif(c_nationkey, 0) END, 6) AS rate FROM customer")
def _(t, spark):
    return rounded(gold.rate(t("customer"), "c_acctbal", "c_nationkey", "c_custkey"), "rate")


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PAIRS = [(a, b) for i, a in enumerate(_NUM) for b in _NUM[i + 1 :]]


@query("stats_corr_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r, count(*) AS n FROM lineitem" for a, b in _PAIRS))
def _(t, spark):
    return rounded(stats.corr_matrix(t("lineitem"), _NUM), "r")


@query("stats_anova", """WITH g AS (SELECT l_returnflag, count(*) AS n, avg(l_extendedprice) AS m, var_pop(l_extendedprice) * count(*) AS ss FROM lineitem GROUP BY 1),
a AS (SELECT count(*) AS k, sum(n)::BIGINT AS n, sum(ss) AS ssw, sum(n * m * m) - sum(n * m) ^ 2 / sum(n) AS ssb FROM g)
SELECT round(ssb / (ssb + ssw), 6) AS eta2, k, n, round(ssb / (k - 1) / (ssw / (n - k)), 4) AS f FROM a""")
def _(t, spark):
    return rounded(stats.anova(t("lineitem"), "l_extendedprice", "l_returnflag"), "eta2").withColumn("f", F.round("f", 4))


@query("stats_cramers_v", """WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS o FROM lineitem GROUP BY 1, 2), m AS (SELECT *, sum(o) OVER (PARTITION BY a) AS r, sum(o) OVER (PARTITION BY b) AS c FROM c),
s AS (SELECT sum(o)::BIGINT AS n, sum(o)::DOUBLE * (sum(o * o::DOUBLE / (r * c)) - 1) AS chi2, count(DISTINCT a) AS ka, count(DISTINCT b) AS kb FROM m)
SELECT round(sqrt(chi2 / (n * (least(ka, kb) - 1))), 6) AS v, n, (ka - 1) * (kb - 1) AS dof, round(chi2, 4) AS chi2 FROM s""")
def _(t, spark):
    return rounded(stats.cramers(t("lineitem"), "l_returnflag", "l_linestatus"), "v").withColumn("chi2", F.round("chi2", 4))


@query("stats_trend_slope", """WITH d AS (SELECT date_trunc('day', o_orderdate) AS day, avg(o_totalprice) AS v FROM orders GROUP BY 1), i AS (SELECT *, row_number() OVER (ORDER BY day) AS i FROM d)
SELECT round(regr_slope(v, i) / avg(abs(v)), 9) AS slope, count(*) AS n FROM i""")
def _(t, spark):
    return stats.trend_slope(gold.trend(t("orders"), "o_orderdate", "o_totalprice"), "value", ["time"]).withColumn("slope", F.round("slope", 9))


@query("stats_gini_hhi", """WITH s AS (SELECT c_nationkey, sum(c_acctbal) AS x FROM customer GROUP BY 1 HAVING sum(c_acctbal) >= 0), i AS (SELECT *, row_number() OVER (ORDER BY x, c_nationkey) AS i FROM s)
SELECT round(2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*), 6) AS gini, round(sum(x * x) / sum(x) ^ 2, 6) AS hhi FROM i""")
def _(t, spark):
    return rounded(stats.concentration(t("customer"), "c_nationkey", "c_acctbal"), "gini", "hhi")


@query("stats_skew_kurt", "SELECT round(skewness(l_extendedprice), 6) AS skew, round(kurtosis(l_extendedprice), 6) AS kurt, round((quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)) / abs(avg(l_extendedprice)), 6) AS iqr_over_mean FROM lineitem")
def _(t, spark):
    x = F.col("l_extendedprice")
    iqr = F.percentile(x, F.lit(0.75)) - F.percentile(x, F.lit(0.25))
    return t("lineitem").agg(r6(stats.skew("l_extendedprice")).alias("skew"), r6(stats.kurt("l_extendedprice")).alias("kurt"), r6(iqr / F.abs(F.avg(x))).alias("iqr_over_mean"))


@query("stats_zmax", "SELECT round(max(abs((value - m) / s)), 6) AS zmax FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)")
def _(t, spark):
    return gold.deviation(t("events"), "event_id", "value").agg(r6(F.max(F.abs("z"))).alias("zmax"))


@query("stats_welch", """WITH a AS (SELECT avg(value) FILTER (user_id % 2 = 0) AS ma, avg(value) FILTER (user_id % 2 = 1) AS mb, var_samp(value) FILTER (user_id % 2 = 0) / count(*) FILTER (user_id % 2 = 0) + var_samp(value) FILTER (user_id % 2 = 1) / count(*) FILTER (user_id % 2 = 1) AS v FROM events)
SELECT round(ma - mb, 6) AS diff, round((ma - mb) / sqrt(v), 6) AS z FROM a""")
def _(t, spark):
    made = stats.welch(t("events"), "value", F.col("user_id") % 2 == 0)
    return spark.range(1).select(F.lit(round(made["diff"], 6)).alias("diff"), F.lit(round(made["z"], 6)).alias("z"))


@query("stats_autocorrelation", "WITH d AS (SELECT date_trunc('day', o_orderdate) AS day, avg(o_totalprice) AS v FROM orders GROUP BY 1), l AS (SELECT v, lag(v, 7) OVER (ORDER BY day) AS a, lag(v, 30) OVER (ORDER BY day) AS b FROM d) SELECT round(corr(v, a), 6) AS ac_7, round(corr(v, b), 6) AS ac_30 FROM l")
def _(t, spark):
    return rounded(fe.autocorrelation(gold.trend(t("orders"), "o_orderdate", "o_totalprice"), "value", ["time"]), "ac_7", "ac_30")


@query("fe_log1p_sqrt", "SELECT event_id, round(CASE WHEN value > -1 THEN ln(1 + value) END, 6) AS log, round(CASE WHEN value >= 0 THEN sqrt(value) END, 6) AS root FROM events")
def _(t, spark):
    return rounded(fe.sqrt(fe.log1p(t("events"), "value", "log"), "value", "root").select("event_id", "log", "root"), "log", "root")


@query("fe_zscore_wins", "WITH q AS (SELECT quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b FROM events), w AS (SELECT event_id, least(greatest(value, a), b) AS w FROM events, q) SELECT event_id, round((w - avg(w) OVER ()) / stddev_samp(w) OVER (), 6) AS z FROM w")
def _(t, spark):
    return rounded(fe.zscore_winsorized(t("events"), "value", "z").select("event_id", "z"), "z")


@query("fe_binary_ops", "SELECT l_orderkey, l_linenumber, round(greatest(l_extendedprice / nullif(l_quantity, 0), 0), 8) AS ratio, round(l_extendedprice - l_quantity, 6) AS diff, round(l_quantity * l_discount, 6) AS prod FROM lineitem")
def _(t, spark):
    made = fe.binary(fe.binary(fe.binary(t("lineitem"), "l_extendedprice", "l_quantity", "ratio", "ratio"), "l_extendedprice", "l_quantity", "diff", "diff"), "l_quantity", "l_discount", "prod", "prod")
    return rounded(made.select("l_orderkey", "l_linenumber", "ratio", "diff", "prod"), "diff", "prod").withColumn("ratio", F.round("ratio", 8))


@query("fe_calendar", "SELECT event_id, isodow(ts) - 1 AS dow, hour(ts) AS hour, week(ts) AS week, month(ts) AS month, quarter(ts) AS quarter, year(ts) AS year, isodow(ts) >= 6 AS is_weekend FROM events")
def _(t, spark):
    made = t("events")
    parts = ["dow", "hour", "week", "month", "quarter", "year", "is_weekend"]
    for p in parts:
        made = fe.calendar(made, "ts", p, p)
    return made.select("event_id", *parts)


_W = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"
_ORDER, _BY = ["ts", "event_id"], ["user_id"]


@query("fe_interarrival", f"SELECT event_id, round((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6, 6) AS gap FROM events {_W}")
def _(t, spark):
    return rounded(fe.interarrival(t("events"), "ts", _ORDER, "gap", _BY).select("event_id", "gap"), "gap")


@query("fe_lag_lead", f"SELECT event_id, lag(value) OVER w AS lag1, lead(value) OVER w AS lead1 FROM events {_W}")
def _(t, spark):
    return fe.shifted(fe.shifted(t("events"), "value", _ORDER, "lag1", _BY), "value", _ORDER, "lead1", _BY, -1).select("event_id", "lag1", "lead1")


@query("fe_rolling", f"""SELECT event_id, round(CASE WHEN count(value) OVER w7 >= 3 THEN avg(value) OVER w7 END, 6) AS mean7, round(CASE WHEN count(value) OVER w3 >= 2 THEN sum(value) OVER w3 END, 6) AS sum3 FROM events
WINDOW w7 AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), w3 AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def _(t, spark):
    made = fe.rolling(fe.rolling(t("events"), "value", _ORDER, "mean7", 7, 3, "mean", _BY), "value", _ORDER, "sum3", 3, 2, "sum", _BY)
    return rounded(made.select("event_id", "mean7", "sum3"), "mean7", "sum3")


@query("fe_ewm", """WITH RECURSIVE s AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, event_id, i, value AS y FROM s WHERE i = 1 UNION ALL SELECT s.user_id, s.event_id, s.i, 0.8 * r.y + 0.2 * s.value FROM r JOIN s ON s.user_id = r.user_id AND s.i = r.i + 1)
SELECT event_id, round(y, 6) AS ewm FROM r""")
def _(t, spark):
    return rounded(fe.ewm_mean(t("events").select("event_id", "user_id", "ts", "value"), "value", _ORDER, "ewm", _BY).select("event_id", "ewm"), "ewm")


@query("fe_text", r"SELECT doc_id, length(text) AS text_len, len(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS words, round(len(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) / nullif(len(regexp_extract_all(lower(text), '[a-z]+')), 0), 6) AS unique_ratio FROM documents")
def _(t, spark):
    made = fe.unique_token_ratio(fe.word_count(fe.text_length(t("documents"), "text", "text_len"), "text", "words"), "text", "unique_ratio")
    return rounded(made.select("doc_id", "text_len", "words", "unique_ratio"), "unique_ratio")


@query("fe_top_tokens", "SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS token FROM documents) GROUP BY 1 ORDER BY n DESC, token LIMIT 50")
def _(t, spark):
    return fe.top_tokens(t("documents"), "text")


@query("fe_ab_difference", "SELECT round((avg(value) FILTER (user_id % 2 = 0) - avg(value) FILTER (user_id % 2 <> 0)) / stddev_samp(value), 6) AS effect, count(*) FILTER (user_id % 2 = 0) AS n_treated, count(*) FILTER (user_id % 2 <> 0) AS n_control FROM events")
def _(t, spark):
    return rounded(fe.ab_difference(t("events"), "value", F.col("user_id") % 2 == 0), "effect")


@query("fe_did", "WITH m AS (SELECT median(epoch_us(ts)) AS m FROM events), e AS (SELECT *, epoch_us(ts) >= m AS late, user_id % 2 = 0 AS treated FROM events, m) SELECT round((avg(value) FILTER (treated AND late) - avg(value) FILTER (treated AND NOT late)) - (avg(value) FILTER (NOT treated AND late) - avg(value) FILTER (NOT treated AND NOT late)), 6) AS did FROM e")
def _(t, spark):
    return rounded(fe.difference_in_differences(t("events"), "value", F.col("user_id") % 2 == 0, "ts"), "did")


@query("fe_executed_plan", f"SELECT event_id, round(CASE WHEN value > -1 THEN ln(1 + value) END, 6) AS a, hour(ts) AS b, lag(value) OVER w AS c, round((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6, 6) AS d FROM events {_W}")
def _(t, spark):
    plan = [fe.FeatureSpec("a", "transform", ("value",), {"op": "log1p"}), fe.FeatureSpec("b", "time_derive", ("ts",), {"part": "hour"}), fe.FeatureSpec("c", "window", ("value",), {"op": "lag", "by": _BY}), fe.FeatureSpec("d", "time_delta", ("ts",), {"by": _BY})]
    return rounded(fe.execute(t("events"), plan, _ORDER).select("event_id", "a", "b", "c", "d"), "a", "d")


def _profile_sql(table: str, columns: list[tuple[str, str]]) -> str:
    parts = []
    for c, kind in columns:
        num = kind in ("int", "float")
        stats_ = f"round(avg({c}), 5), round(stddev_samp({c}), 6), round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6), min({c})::DOUBLE, max({c})::DOUBLE" if num else "NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE"
        length = f"round(avg(length({c})), 6)" if kind == "string" else "NULL::DOUBLE"
        parts.append(f"SELECT '{c}', '{kind}', round(1 - count({c})::DOUBLE / count(*), 6), count(DISTINCT {c}), round(count(DISTINCT {c})::DOUBLE / count(*), 6), {length}, {stats_} FROM {table}")
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) AS p(column_name, type, missing_pct, nunique, unique_ratio, avg_len, mean, std, iqr, min, max)"


_LINE = [(f"l_{c}", k) for c, k in (("orderkey", "int"), ("partkey", "int"), ("suppkey", "int"), ("linenumber", "int"), ("quantity", "float"), ("extendedprice", "float"), ("discount", "float"), ("tax", "float"), ("returnflag", "string"), ("linestatus", "string"), ("shipdate", "datetime"))]
_DOCS = [("doc_id", "int"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "int")]


@query("profile_facts_lineitem", _profile_sql("lineitem", _LINE))
def _(t, spark):
    return rounded(rounded(pr.profile(t("lineitem")), "missing_pct", "unique_ratio", "avg_len", "std", "iqr"), "mean", places=5)


@query("profile_facts_documents", _profile_sql("documents", _DOCS))
def _(t, spark):
    return rounded(rounded(pr.profile(t("documents")), "missing_pct", "unique_ratio", "avg_len", "std", "iqr"), "mean", places=5)


@query("profile_ratios", """SELECT round(avg((lower(trim(CASE event_type WHEN 'view' THEN ' Yes' WHEN 'error' THEN 'F' ELSE event_type END)) IN ('yes', 'f'))::INT), 6) AS bools, round(avg((event_id % 3 > 0)::INT), 6) AS numbers, round(avg((event_id % 4 > 0)::INT), 6) AS dates FROM events""")
def _(t, spark):
    e = t("events")
    made = F.when(F.col("event_type") == "view", " Yes").when(F.col("event_type") == "error", "F").otherwise(F.col("event_type"))
    numbers = F.when(F.col("event_id") % 3 > 0, F.lit("1,234.5")).otherwise("1d")
    dates = F.when(F.col("event_id") % 4 > 0, F.date_format("ts", "M/d/yyyy")).otherwise("today")
    return e.agg(r6(pr.bool_token_ratio(made)).alias("bools"), r6(pr.numeric_like_ratio(numbers)).alias("numbers"), r6(pr.datetime_parse_ratio(dates)).alias("dates"))


@query("profile_is_monotonic", "WITH d AS (SELECT user_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events) SELECT user_id, coalesce(min(d) >= 0, true) AS is_monotonic FROM d GROUP BY 1")
def _(t, spark):
    return pr.is_monotonic(t("events"), "event_id", ["ts", "event_id"], ["user_id"])


@query("canonical_categories", "SELECT DISTINCT c_mktsegment AS value, lower(c_mktsegment) AS canonical FROM customer")
def _(t, spark):
    return roles.canonical_categories(t("customer"), "c_mktsegment")


@query("topics_scored", """WITH t AS (SELECT * FROM (VALUES ('correlation', 0.5::DOUBLE, 100, 1.0::DOUBLE, 0.01::DOUBLE, 0), ('correlation', 0.4, 20, 0.9, NULL, 0), ('trend', 0.03, 50, 1.0, NULL, 200), ('kpi', 0.0, 80, 0.95, NULL, 0), ('distribution', 1.0, 500, 0.8, NULL, 0), ('deviation', 4.0, 500, 0.8, NULL, 0), ('cohort', 0.3, 40, 1.0, NULL, 0), ('causal', 0.5, 60, 0.6, 0.2, 0)) AS v(family, e, n, cov, p, pts)),
s AS (SELECT *, CASE family WHEN 'correlation' THEN e WHEN 'cohort' THEN e WHEN 'trend' THEN least(1, e / 0.06) WHEN 'distribution' THEN e / (1 + e) WHEN 'deviation' THEN e / (3 + e) WHEN 'causal' THEN e / (0.5 + e) WHEN 'kpi' THEN 0.2 END AS norm,
CASE WHEN family = 'correlation' AND n < 30 THEN 0.3 WHEN family = 'trend' AND pts > 180 THEN 0.1 WHEN family = 'cohort' THEN 0.1 ELSE 0 END AS pen, coalesce(1 - p, least(1, n / 100)) AS sig FROM t)
SELECT family, n AS n_obs, round(norm, 6) AS effect_norm, round(3 * cov + 2.5 * norm + 2 * sig + 1.5 * (1 - pen) - pen, 6) AS score_total FROM s""")
def _(t, spark):
    rows = [("correlation", 0.5, 100, 1.0, 0.01, 0), ("correlation", 0.4, 20, 0.9, None, 0), ("trend", 0.03, 50, 1.0, None, 200), ("kpi", 0.0, 80, 0.95, None, 0), ("distribution", 1.0, 500, 0.8, None, 0), ("deviation", 4.0, 500, 0.8, None, 0), ("cohort", 0.3, 40, 1.0, None, 0), ("causal", 0.5, 60, 0.6, 0.2, 0)]
    made = topics.as_frame(spark, [topics.Topic(f, [f, str(n)], [], e, {"n_points": pts}, {} if p is None else {"p_value": p}, n, c) for f, e, n, c, p, pts in rows])
    return rounded(topics.score(made).select("family", F.col("n_obs").cast("int").alias("n_obs"), "effect_norm", "score_total"), "effect_norm", "score_total")


@query("topics_candidates")
def _(t, spark):
    return topics.candidates(t("orders"))


@query("topics_selected")
def _(t, spark):
    return topics.select(topics.score(topics.candidates(t("orders"))))


@query("cleaned_orders", "SELECT o_orderkey, round(o_totalprice, 2) AS price_usd, date_trunc('day', o_orderdate)::TIMESTAMP AS order_date, CASE WHEN o_orderkey % 9 = 0 THEN 'Unknown' ELSE lower(o_orderpriority) END AS priority FROM orders")
def _(t, spark):
    made = t("orders").select("o_orderkey", F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("price_usd"), F.date_format("o_orderdate", "M/d/yyyy").alias("order_date"), F.when(F.col("o_orderkey") % 9 == 0, "n/a").otherwise(F.concat(F.lit("  "), F.col("o_orderpriority"))).alias("priority"))
    schema = roles.Schema("orders", [roles.ColumnSchema(c, "string", r, 1.0) for c, r in (("o_orderkey", "id"), ("price_usd", "numeric"), ("order_date", "time"), ("priority", "categorical"))])
    return rules.clean(made, schema=schema).df


@query("stream_windowed", "SELECT time_bucket(INTERVAL '6 hours', ts)::TIMESTAMP AS start, (time_bucket(INTERVAL '6 hours', ts) + INTERVAL 6 HOUR)::TIMESTAMP AS end, event_type, round(avg(value), 6) AS mean, round(sum(value), 3) AS total, count(*) AS n FROM events GROUP BY 1, 2, 3")
def _(t, spark):
    made = windows.windowed(t("events"), "ts", "value", "6 hours", "1 hour", "event_type")
    return rounded(made, "mean").withColumn("total", F.round("total", 3))


@query("stream_sessions", """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM e) SELECT user_id, min(ts)::TIMESTAMP AS start, (max(ts) + INTERVAL 12 HOUR)::TIMESTAMP AS end, count(*) AS n FROM s GROUP BY user_id, s""")
def _(t, spark):
    return windows.sessions(t("events"), "ts", "user_id", "12 hours")
