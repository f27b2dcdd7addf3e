"""The data of more charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import shapes as sh
from .catalogue import query


def rounded(df, *cols, places=6):
    return df.withColumns({c: F.round(c, places) for c in cols})


_PLACES = "(SELECT *, s_nationkey * 3.0::DOUBLE - 40 AS lat, s_suppkey % 17 * 10.0::DOUBLE - 80 AS lon FROM supplier)"


def _places(t):
    return t("supplier").withColumn("lat", F.col("s_nationkey") * 3.0 - 40).withColumn("lon", F.col("s_suppkey") % 17 * 10.0 - 80)


@query("chart_projected", "SELECT o_orderdate AS time, o_totalprice AS value, o_orderkey FROM orders WHERE o_orderdate IS NOT NULL")
def _(t, spark):
    return sh.projected(t("orders"), "line", ("o_orderkey",), time="o_orderdate", value="o_totalprice")


@query("chart_candlestick", """SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS time, arg_min(o_totalprice, {'a': o_orderdate, 'b': o_orderkey}) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
arg_max(o_totalprice, {'a': o_orderdate, 'b': o_orderkey}) AS close FROM orders GROUP BY 1""")
def _(t, spark):
    key = F.struct("o_orderdate", "o_orderkey")
    months = t("orders").groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("m")).agg(
        F.min_by("o_totalprice", key).alias("a"), F.max("o_totalprice").alias("b"), F.min("o_totalprice").alias("c"), F.max_by("o_totalprice", key).alias("d"))
    return sh.projected(months, "candlestick", time="m", open="a", high="b", low="c", close="d")


@query("chart_bubble", "SELECT c_nationkey AS x, c_acctbal AS y, c_custkey AS size FROM customer")
def _(t, spark):
    return sh.projected(t("customer"), "bubble", x="c_nationkey", y="c_acctbal", size="c_custkey")


@query("chart_stacked_bar", "SELECT p_brand AS category, p_type AS \"group\", round(sum(p_retailprice), 2) AS value FROM part GROUP BY 1, 2")
def _(t, spark):
    sums = t("part").groupBy("p_brand", "p_type").agg(F.round(F.sum("p_retailprice"), 2).alias("v"))
    return sh.projected(sums, "stacked_bar", category="p_brand", group="p_type", value="v")


@query("chart_irregular", """WITH d AS (SELECT epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts) AS d FROM events)
SELECT quantile_cont(d, 0.75) - quantile_cont(d, 0.25) > 0.15 * median(d) AS markers, (SELECT count(*) FROM events) AS n FROM d""")
def _(t, spark):
    return sh.irregular(t("events"), "ts")


@query("chart_priestley", """WITH r AS (SELECT o_orderkey AS label, epoch_us(o_orderdate) AS a, epoch_us(o_orderdate) + (o_custkey % 41 - 20) * 86400000000 AS b FROM orders), s AS (SELECT label, least(a, b) AS a, greatest(a, b) AS b FROM r)
SELECT label, make_timestamp(a) AS start, make_timestamp(b) AS "end", make_timestamp((a + b) // 2) AS middle, (b - a) / 1e6 AS seconds, row_number() OVER (ORDER BY a, a - b, label) AS place FROM s""")
def _(t, spark):
    made = t("orders").withColumn("end", F.expr("o_orderdate + make_interval(0, 0, 0, cast(o_custkey % 41 - 20 AS int))"))
    return sh.priestley(made, "o_orderkey", "o_orderdate", "end")


@query("chart_sized", "SELECT c_custkey, CASE WHEN (SELECT max(c_acctbal) FROM customer) > 0 THEN round(6 + 30 * sqrt(greatest(c_acctbal, 0) / (SELECT max(c_acctbal) FROM customer)), 6) ELSE 6 END AS size FROM customer")
def _(t, spark):
    return rounded(sh.sized(t("customer"), "c_acctbal").select("c_custkey", "size"), "size")


@query("chart_vertical_timeline", """WITH f AS (SELECT avg(value) AS m, quantile_cont(value, 0.97) - quantile_cont(value, 0.03) AS w FROM events)
SELECT event_id AS key, ts AS time, round((value - m) / (w / 2) * 0.9, 6) AS x FROM events, f""")
def _(t, spark):
    return rounded(sh.vertical_timeline(t("events"), "ts", "value", "event_id"), "x")


@query("chart_diverging_stacked", "WITH s AS (SELECT p_brand AS cat, p_type AS sub, sum(p_retailprice) AS v FROM part GROUP BY 1, 2) SELECT cat, sub, round(v - avg(v) OVER (), 4) AS deviation FROM s")
def _(t, spark):
    return rounded(sh.diverging_stacked(t("part"), "p_brand", "p_type", "p_retailprice"), "deviation", places=4)


@query("chart_surplus_deficit", "SELECT ts AS time, value, 100.0::DOUBLE AS target, greatest(value, 100.0::DOUBLE) AS above, least(value, 100.0::DOUBLE) AS below FROM events")
def _(t, spark):
    return sh.surplus_deficit(t("events"), "ts", "value", F.lit(100.0))


@query("chart_strip", "SELECT event_id AS key, value, event_type AS category, (dense_rank() OVER (ORDER BY event_type) - 1)::DOUBLE AS position FROM events")
def _(t, spark):
    return sh.strip(t("events"), "value", "event_id", "event_type")


@query("chart_barcode", "SELECT event_id AS key, value, 0.0::DOUBLE AS position FROM events")
def _(t, spark):
    return sh.strip(t("events"), "value", "event_id")


@query("chart_beeswarm")
def _(t, spark):
    return sh.strip(t("events"), "value", "event_id", "event_type", jitter=0.35)


@query("chart_radar", "SELECT l_returnflag AS entity, arg_min(l_quantity, {'a': l_orderkey, 'b': l_linenumber}) AS l_quantity, arg_min(l_tax, {'a': l_orderkey, 'b': l_linenumber}) AS l_tax FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax) GROUP BY 1")
def _(t, spark):
    first = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_returnflag")).alias("s")).select("l_orderkey", "l_linenumber", "s.*")
    return sh.radar(first.withColumn("tie", F.struct("l_orderkey", "l_linenumber")), "l_returnflag", ["l_quantity", "l_tax"], "tie")


@query("chart_symbols", """WITH s AS (SELECT p_brand AS cat, p_type AS grp, least(greatest(floor(sum(p_retailprice) / 500 + 0.5), 0), 400)::BIGINT AS n, dense_rank() OVER (ORDER BY p_brand) AS b FROM part GROUP BY 1, 2), k AS (SELECT *, unnest(range(n)) AS k FROM s)
SELECT cat, grp, (b - 1) * 12 + k % 10 AS x, -(k // 10) AS y FROM k""")
def _(t, spark):
    return sh.symbols(t("part"), "p_brand", "p_type", "p_retailprice", 500)


@query("chart_bullet", "SELECT c_custkey AS cat, c_acctbal AS value, 5000.0::DOUBLE AS target, round(c_acctbal - 5000, 6) AS delta, 3000.0::DOUBLE AS band1, 4500.0::DOUBLE AS band2, round(1.1 * greatest(c_acctbal, 5000), 6) AS \"end\" FROM customer")
def _(t, spark):
    return rounded(sh.bullet(t("customer"), "c_custkey", "c_acctbal", F.lit(5000)), "delta", "end", "band1", "band2")


@query("chart_chord", """WITH e AS (SELECT c_mktsegment AS source, o_orderpriority AS target, sum(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), n AS (SELECT unnest([source, target]) AS node FROM e),
m AS (SELECT node, 2 * pi() * (row_number() OVER (ORDER BY node) - 1) / count(*) OVER () AS a FROM (SELECT DISTINCT node FROM n))
SELECT source, target, round(value / max(value) OVER (), 6) AS weight, round(cos(a.a), 6) AS x0, round(sin(a.a), 6) AS y0, round(cos(b.a), 6) AS x1, round(sin(b.a), 6) AS y1 FROM e JOIN m a ON a.node = source JOIN m b ON b.node = target""")
def _(t, spark):
    from ..operators.charts import sankey

    edges = sankey(t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")), "c_mktsegment", "o_orderpriority", "o_totalprice")
    return rounded(sh.chord(edges), "weight", "x0", "y0", "x1", "y1")


@query("chart_bounds", f"WITH b AS (SELECT min(lat) - (max(lat) - min(lat)) * 0.08 AS south, max(lat) + (max(lat) - min(lat)) * 0.08 AS north, min(lon) - (max(lon) - min(lon)) * 0.08 AS west, max(lon) + (max(lon) - min(lon)) * 0.08 AS east FROM {_PLACES}) SELECT round(south, 6) AS south, round(north, 6) AS north, round(west, 6) AS west, round(east, 6) AS east, round((south + north) / 2, 6) AS lat, round((west + east) / 2, 6) AS lon FROM b")
def _(t, spark):
    return rounded(sh.bounds(_places(t), "lat", "lon"), "south", "north", "west", "east", "lat", "lon")


_GRID = "least(floor(({v} - {v}0) / ({v}1 - {v}0) * {n})::INT + 1, {n})"


@query("chart_contour", f"""WITH p AS (SELECT *, min(lat) OVER () AS lat0, max(lat) OVER () AS lat1, min(lon) OVER () AS lon0, max(lon) OVER () AS lon1 FROM {_PLACES}),
c AS (SELECT {_GRID.format(v='lat', n=5)} AS y_bin, {_GRID.format(v='lon', n=5)} AS x_bin, avg(s_acctbal) AS value FROM p GROUP BY 1, 2), e AS (SELECT quantile_cont(value, [0, 0.25, 0.5, 0.75, 1]) AS e FROM c)
SELECT y_bin, x_bin, round(value, 6) AS value, least(greatest(len(list_filter(e, lambda x: value > x)) - 1, 0), 3)::INT AS band FROM c, e""")
def _(t, spark):
    return rounded(sh.contour(_places(t), "lat", "lon", "s_acctbal", 5, 4), "value")


@query("chart_hotspots", f"""WITH p AS (SELECT *, min(lat) OVER () AS lat0, max(lat) OVER () AS lat1, min(lon) OVER () AS lon0, max(lon) OVER () AS lon1 FROM {_PLACES}),
c AS (SELECT {_GRID.format(v='lat', n=60)} AS y, {_GRID.format(v='lon', n=60)} AS x, lat0, lat1, lon0, lon1, count(*) AS n FROM p GROUP BY ALL) SELECT round(lat0 + (lat1 - lat0) * (y - 0.5) / 60, 6) AS lat, round(lon0 + (lon1 - lon0) * (x - 0.5) / 60, 6) AS lon, n FROM c ORDER BY n DESC, lat, lon LIMIT 3""")
def _(t, spark):
    return rounded(sh.hotspots(_places(t), "lat", "lon"), "lat", "lon")


@query("chart_cartogram")
def _(t, spark):
    places = _places(t).groupBy("s_nationkey").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.sum("s_acctbal").alias("v"))
    return rounded(sh.cartogram(places, "s_nationkey", "lat", "lon", "v"), "lat", "lon", "size")


@query("chart_voronoi")
def _(t, spark):
    places = _places(t).groupBy("s_nationkey").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    return rounded(sh.voronoi(places, "s_nationkey", "lon", "lat").select("key", "area", F.size("polygon").alias("corners")), "area")


@query("chart_spec", "SELECT 'line' AS chart, '{\"chart\": \"line\", \"columns\": [\"time\", \"value\"], \"data\": \"\", \"theme\": \"dark_blue\", \"title\": \"Totals\"}' AS spec")
def _(t, spark):
    made = sh.projected(t("orders"), "line", time="o_orderdate", value="o_totalprice")
    return spark.createDataFrame([("line", sh.spec("line", made.columns, "Totals"))], "chart string, spec string")
