"""The data of charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import charts as ch
from .catalogue import query

r6 = lambda c: F.round(c, 6)


def rounded(df, *cols, places=6):
    return df.withColumns({c: F.round(c, places) for c in cols})


_BINS = "CASE WHEN hi > lo THEN least(floor(({x} - lo) / (hi - lo) * 30)::INT + 1, 30) ELSE 1 END"


@query("chart_histogram", f"SELECT {_BINS.format(x='o_totalprice')} AS bin, count(*) AS n FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) GROUP BY 1")
def _(t, spark):
    return ch.histogram(t("orders"), "o_totalprice")


@query("chart_frequency_polygon", f"WITH b AS (SELECT o_orderstatus AS grp, {_BINS.format(x='o_totalprice')} AS bin FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)) SELECT grp, bin, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY grp), 6) AS share FROM b GROUP BY 1, 2")
def _(t, spark):
    return rounded(ch.frequency_polygon(t("orders"), "o_totalprice", "o_orderstatus"), "share")


@query("chart_xy_heatmap", "WITH e AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS d FROM lineitem) SELECT least(floor((l_quantity - a) / (b - a) * 30)::INT + 1, 30) AS x_bin, least(floor((l_extendedprice - c) / (d - c) * 30)::INT + 1, 30) AS y_bin, count(*) AS n FROM lineitem, e GROUP BY 1, 2")
def _(t, spark):
    return ch.xy_heatmap(t("lineitem"), "l_quantity", "l_extendedprice")


@query("chart_ecdf", "SELECT DISTINCT l_returnflag, l_quantity AS value, round(cume_dist() OVER (PARTITION BY l_returnflag ORDER BY l_quantity), 6) AS share FROM lineitem")
def _(t, spark):
    return rounded(ch.ecdf(t("lineitem"), "l_quantity", "l_returnflag"), "share")


@query("chart_box", """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
SELECT event_type AS grp, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, min(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS low, max(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS high,
count(*) FILTER (NOT value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers FROM events JOIN q USING (event_type) GROUP BY q.event_type, event_type, q1, median, q3""")
def _(t, spark):
    return rounded(ch.box(t("events"), "value", "event_type"), "q1", "median", "q3")


@query("chart_calendar_heatmap", "WITH d AS (SELECT ts::DATE AS day, sum(value) AS value FROM events GROUP BY 1) SELECT floor(date_diff('day', date_trunc('week', (SELECT min(day) FROM d))::DATE, day) / 7)::BIGINT AS week, (isodow(day) - 1)::INT AS weekday, round(value, 4) AS value FROM d")
def _(t, spark):
    return rounded(ch.calendar_heatmap(t("events"), "ts", "value"), "value", places=4)


@query("chart_streamgraph", """WITH s AS (SELECT year(o_orderdate) AS time, o_orderstatus AS grp, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2), u AS (SELECT *, sum(value) OVER (PARTITION BY time ORDER BY grp) - sum(value) OVER (PARTITION BY time) / 2 AS upper FROM s)
SELECT time, grp, round(value, 3) AS value, round(upper, 3) AS upper, round(upper - value, 3) AS lower FROM u""")
def _(t, spark):
    return rounded(ch.streamgraph(t("orders"), F.year("o_orderdate"), "o_orderstatus", "o_totalprice"), "value", "upper", "lower", places=3)


@query("chart_slope", "SELECT user_id AS entity, arg_min(value, {'a': ts, 'b': event_id}) AS first_value, arg_max(value, {'a': ts, 'b': event_id}) AS last_value, count(*) AS points FROM events GROUP BY 1")
def _(t, spark):
    return ch.slope(t("events"), "user_id", "ts", "value", "event_id")


@query("chart_bump", """WITH s AS (SELECT year(o_orderdate) AS time, c_nationkey AS entity, sum(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY time ORDER BY value DESC, entity) AS rank FROM s),
k AS (SELECT entity FROM r WHERE rank <= 10 GROUP BY 1 ORDER BY count(*) DESC, entity LIMIT 10) SELECT time, entity, round(value, 2) AS value, rank FROM r WHERE entity IN (SELECT entity FROM k)""")
def _(t, spark):
    met = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rounded(ch.bump(met, F.year("o_orderdate"), "c_nationkey", "o_totalprice"), "value", places=2)


@query("chart_top_and_other", "WITH s AS (SELECT p_brand, sum(p_retailprice) AS v, row_number() OVER (ORDER BY sum(p_retailprice) DESC, p_brand) AS i FROM part GROUP BY 1) SELECT CASE WHEN i >= 6 THEN 'Other' ELSE p_brand END AS cat, round(sum(v), 2) AS value FROM s GROUP BY 1")
def _(t, spark):
    return rounded(ch.top_and_other(t("part"), "p_brand", "p_retailprice"), "value", places=2)


@query("chart_diverging", "SELECT c_mktsegment AS cat, round(avg(c_acctbal), 6) AS value, round(avg(c_acctbal) - avg(avg(c_acctbal)) OVER (), 6) AS deviation FROM customer GROUP BY 1")
def _(t, spark):
    return rounded(ch.diverging(t("customer"), "c_mktsegment", "c_acctbal"), "value", "deviation")


@query("chart_spine", "SELECT c_mktsegment AS cat, round(100 * avg((c_acctbal > 0)::INT), 6) AS positive, round(-100 * (1 - avg((c_acctbal > 0)::INT)), 6) AS negative FROM customer GROUP BY 1")
def _(t, spark):
    return rounded(ch.spine(t("customer"), "c_mktsegment", F.col("c_acctbal") > 0), "positive", "negative")


@query("chart_waterfall", "SELECT step, round(change, 2) AS change, round(sum(change) OVER (ORDER BY step), 2) AS level FROM (SELECT year(o_orderdate) AS step, sum(o_totalprice) AS change FROM orders GROUP BY 1)")
def _(t, spark):
    return rounded(ch.waterfall(t("orders"), F.year("o_orderdate"), "o_totalprice"), "change", "level", places=2)


_EDGES = "e AS (SELECT c_mktsegment AS source, o_orderpriority AS target, sum(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"


def _edges(t):
    return ch.sankey(t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")), "c_mktsegment", "o_orderpriority", "o_totalprice")


@query("chart_sankey", f"WITH {_EDGES} SELECT source, target, round(value, 2) AS value FROM e")
def _(t, spark):
    return rounded(_edges(t), "value", places=2)


@query("chart_network_nodes", f"WITH {_EDGES}, n AS (SELECT unnest([source, target]) AS node FROM e) SELECT node, count(*) AS degree, row_number() OVER (ORDER BY node) - 1 AS index FROM n GROUP BY 1")
def _(t, spark):
    return ch.nodes(_edges(t))


@query("chart_first_last_pivot", "WITH y AS (SELECT min(year(o_orderdate)) AS a, max(year(o_orderdate)) AS b FROM orders) SELECT o_orderpriority AS entity, round(avg(o_totalprice) FILTER (year(o_orderdate) = a), 6) AS earliest, round(avg(o_totalprice) FILTER (year(o_orderdate) = b), 6) AS latest FROM orders, y GROUP BY 1")
def _(t, spark):
    return rounded(ch.first_last_pivot(t("orders"), F.year("o_orderdate"), "o_orderpriority", "o_totalprice"), "earliest", "latest")


@query("chart_pyramid", "SELECT c_nationkey % 5 AS cat, round(100.0 * count(*) FILTER (c_acctbal > 4000) / sum(count(*)) OVER (), 6) AS right, round(-100.0 * count(*) FILTER (NOT c_acctbal > 4000) / sum(count(*)) OVER (), 6) AS left FROM customer GROUP BY 1")
def _(t, spark):
    return rounded(ch.pyramid(t("customer"), F.col("c_nationkey") % 5, F.col("c_acctbal") > 4000), "right", "left")


@query("chart_scaled", "SELECT p_type AS cat, round(sum(p_retailprice), 2) AS value, round(sqrt(sum(p_retailprice) / max(sum(p_retailprice)) OVER ()), 6) AS size FROM part GROUP BY 1")
def _(t, spark):
    return rounded(rounded(ch.scaled(t("part"), "p_type", "p_retailprice"), "value", places=2), "size")


@query("chart_top", "SELECT p_brand AS cat, round(sum(p_retailprice), 2) AS value FROM part GROUP BY 1 ORDER BY sum(p_retailprice) DESC, cat LIMIT 10")
def _(t, spark):
    return rounded(ch.top(t("part"), "p_brand", "p_retailprice"), "value", places=2)


@query("chart_icon_grid", "SELECT p_type AS cat, round(sum(p_retailprice), 2) AS value, round(sum(p_retailprice) / sum(sum(p_retailprice)) OVER () * 100)::BIGINT AS cells FROM part GROUP BY 1")
def _(t, spark):
    return rounded(ch.icon_grid(t("part"), "p_type", "p_retailprice"), "value", places=2)


@query("chart_venn", "WITH k AS (SELECT user_id, max((event_type = 'purchase')::INT) AS a, max((event_type = 'error')::INT) AS b, max((value > 100)::INT) AS c FROM events GROUP BY 1) SELECT a::VARCHAR || b::VARCHAR || c::VARCHAR AS mask, count(*) AS n FROM k GROUP BY 1")
def _(t, spark):
    return ch.venn(t("events"), "user_id", F.col("event_type") == "purchase", F.col("event_type") == "error", F.col("value") > 100)


@query("chart_seats", "WITH s AS (SELECT p_type AS cat, round(sum(p_retailprice) / sum(sum(p_retailprice)) OVER () * 100)::BIGINT AS cells FROM part GROUP BY 1) SELECT cat, unnest(range(1, cells + 1)) AS seat FROM s WHERE cells > 0")
def _(t, spark):
    return ch.seats(t("part"), "p_type", "p_retailprice")


@query("chart_great_circle", """WITH r AS (SELECT s_suppkey, radians(s_nationkey * 3 - 40) AS a, radians(s_nationkey * 10 - 120) AS l1, radians(45) AS b, radians(7) AS l2, unnest(range(17)) AS step FROM supplier),
d AS (SELECT *, acos(sin(a) * sin(b) + cos(a) * cos(b) * cos(l2 - l1)) AS d, step / 16 AS t FROM r), x AS (SELECT *, sin((1 - t) * d) / sin(d) AS p, sin(t * d) / sin(d) AS q FROM d)
SELECT s_suppkey, step::INT AS step, round(degrees(atan2(p * sin(a) + q * sin(b), sqrt((p * cos(a) * cos(l1) + q * cos(b) * cos(l2)) ^ 2 + (p * cos(a) * sin(l1) + q * cos(b) * sin(l2)) ^ 2))), 5) AS lat,
round(degrees(atan2(p * cos(a) * sin(l1) + q * cos(b) * sin(l2), p * cos(a) * cos(l1) + q * cos(b) * cos(l2))), 5) AS lon FROM x""")
def _(t, spark):
    places = t("supplier").select("s_suppkey", (F.col("s_nationkey") * 3 - 40).alias("lat1"), (F.col("s_nationkey") * 10 - 120).alias("lon1"), F.lit(45).alias("lat2"), F.lit(7).alias("lon2"))
    return rounded(ch.great_circle(places, "lat1", "lon1", "lat2", "lon2").select("s_suppkey", "step", "lat", "lon"), "lat", "lon", places=5)
