"""More data of charts: timelines, strips, symbols, circles and maps, and the specification that a renderer reads."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from . import ordered
from .charts import _bin, _check
from .frames import impute, with_facts

#: Charts that draw columns as they are, and the columns that each needs.
FIELDS = {
    "line": ("time", "value"), "column": ("time", "value"), "area": ("time", "value"), "seismogram": ("time", "value"), "column_line": ("time", "column", "line"),
    "column_line_timeline": ("time", "column", "line"), "candlestick": ("time", "open", "high", "low", "close"), "fan_chart": ("time", "low", "middle", "high"), "connected_scatter": ("time", "x", "y"),
    "scatter": ("x", "y"), "bubble": ("x", "y", "size"), "bar": ("category", "value"), "paired_bar": ("category", "group", "value"), "paired_column": ("category", "group", "value"),
    "stacked_bar": ("category", "group", "value"), "marimekko": ("category", "group", "value"), "treemap": ("label", "value"), "choropleth": ("place", "value"), "parallel_coordinates": ("entity",),
}


def projected(df: DataFrame, chart: str, extra: tuple = (), **fields: str) -> DataFrame:
    """The columns of a chart under its own names, of rows that have the first of them; extra ones keep theirs."""
    if missing := [f for f in FIELDS[chart] if f not in fields]:
        raise KeyError(f"{chart} needs {missing}")
    _check(df, *fields.values(), *extra)
    first = fields[FIELDS[chart][0]]
    return df.where(F.col(first).isNotNull()).select(*[F.col(c).alias(f) for f, c in fields.items()], *extra)


def irregular(df: DataFrame, time: str) -> DataFrame:
    """One row: markers, whether steps between neighbouring times differ much, and n. Under three times they do."""
    us = df.where(F.col(time).isNotNull()).select(F.unix_micros(F.col(time).cast("timestamp")).cast("double").alias("us"))
    placed = ordered.numbered(us, ["us"], "i")
    steps = placed.join(placed.select((F.col("i") + 1).alias("i"), F.col("us").alias("last")), "i").select((F.col("us") - F.col("last")).alias("d"))
    q1, middle, q3 = ordered.quantiles(steps, [(F.col("d"), q) for q in (0.25, 0.5, 0.75)])
    odd = True if middle is None else q3 - q1 > 0.15 * middle
    return us.agg(F.count("*").alias("n")).select(((F.col("n") < 3) | F.lit(odd)).alias("markers"), "n")


def priestley(df: DataFrame, label: str, start: str, end: str) -> DataFrame:
    """Spans from the earlier to the later end, their middle and length in seconds, in order of start, the longest first."""
    _check(df, label, start, end)
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    a, b = F.least(us(start), us(end)), F.greatest(us(start), us(end))
    rows = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(F.col(label).alias("label"), a.alias("a"), b.alias("b"))
    placed = ordered.numbered(rows.withColumn("d", F.col("a") - F.col("b")), ["a", "d", "label"], "place")
    at = lambda x: F.timestamp_micros(x.cast("long")).cast("timestamp_ntz")
    return placed.select("label", at(F.col("a")).alias("start"), at(F.col("b")).alias("end"), at(F.floor((F.col("a") + F.col("b")) / 2)).alias("middle"), (-F.col("d") / 1e6).alias("seconds"), "place")


def sized(df: DataFrame, metric: str, least: float = 6, most: float = 36) -> DataFrame:
    """circle timeline: df with size, by the root of the value over the largest; all least where none is over 0."""
    x = F.greatest(F.coalesce(F.col(metric).cast("double"), F.lit(0.0)), F.lit(0.0))
    made = with_facts(df, F.max(x).alias("_top"))
    return made.withColumn("size", F.when(F.col("_top") > 0, least + (most - least) * F.sqrt(x / F.col("_top"))).otherwise(F.lit(float(least)))).drop("_top")


def vertical_timeline(df: DataFrame, time: str, metric: str, key: str, span: float = 1.0) -> DataFrame:
    """key, time and x: the value around the mean, nine tenths of the span wide between its 3rd and 97th percentile, with
    gaps filled along the order of time."""
    x = F.col(metric).cast("double")
    lo, hi = ordered.quantiles(df, [(x, 0.03), (x, 0.97)])
    width = ((hi - lo) if lo is not None else 0.0) or 1.0
    made = with_facts(df.select(F.col(key).alias("key"), F.col(time).alias("time"), x.alias("_v")), F.avg("_v").alias("_m"))
    placed = made.withColumn("x", (F.col("_v") - F.col("_m")) / (width / 2) * (span * 0.9)).drop("_v", "_m")
    return impute(placed, "x", "interpolate", ["time", "key"])


def diverging_stacked(df: DataFrame, cat: str, sub: str, metric: str, reference: float | None = None) -> DataFrame:
    """cat, sub, deviation of the summed values from the reference, or from their mean."""
    sums = df.dropna(subset=[cat, sub]).groupBy(F.col(cat).alias("cat"), F.col(sub).alias("sub")).agg(F.sum(metric).alias("value"))
    made = with_facts(sums, F.avg("value").alias("m"))
    return made.select("cat", "sub", (F.col("value") - (F.col("m") if reference is None else F.lit(float(reference)))).alias("deviation"))


def surplus_deficit(df: DataFrame, time: str, metric: str, target: Column) -> DataFrame:
    """time, value, target, and the edges of what is above and below it."""
    rows = df.where(F.col(time).isNotNull()).select(F.col(time).alias("time"), F.col(metric).cast("double").alias("value"), target.cast("double").alias("target"))
    return rows.withColumn("above", F.when(F.col("value") > F.col("target"), F.col("value")).otherwise(F.col("target"))).withColumn("below", F.when(F.col("value") > F.col("target"), F.col("target")).otherwise(F.col("value")))


def strip(df: DataFrame, metric: str, key: str, by: str | None = None, jitter: float = 0.0) -> DataFrame:
    """dot strip, and with jitter beeswarm; without by and jitter barcode: key, value, position. A category's position is its
    place among the names; jitter comes from the key's hash, so it is the same in every run."""
    rows = df.where(F.col(metric).isNotNull()).select(F.col(key).alias("key"), F.col(metric).cast("double").alias("value"), *([F.col(by).alias("_by")] if by else []))
    shift = (F.pmod(F.xxhash64("key"), F.lit(1 << 20)) / F.lit(float(1 << 19)) - 1) * jitter if jitter else F.lit(0.0)
    if not by:
        return rows.withColumn("position", shift)
    names = ordered.numbered(rows.where("_by IS NOT NULL").select("_by").distinct(), ["_by"], "_i")
    return rows.join(names, "_by").select("key", "value", F.col("_by").alias("category"), (F.col("_i") - 1 + shift).alias("position"))


def radar(df: DataFrame, entity: str, metrics: list[str], tie: str) -> DataFrame:
    """entity and the metrics of its first row, in order of tie."""
    _check(df, entity, tie, *metrics)
    return df.groupBy(F.col(entity).alias("entity")).agg(F.min_by(F.struct(*metrics), F.col(tie)).alias("_r")).select("entity", "_r.*")


def symbols(df: DataFrame, cat: str, group: str, metric: str, unit: float, per_row: int = 10, most: int = 400) -> DataFrame:
    """grouped symbols, isotype: an icon a unit of each sum, in rows of a block for each category; most is the chart's own
    limit of icons of a pair."""
    sums = df.dropna(subset=[cat, group]).groupBy(F.col(cat).alias("cat"), F.col(group).alias("grp")).agg(F.sum(metric).alias("value"))
    icons = F.least(F.greatest(F.floor(F.col("value") / unit + 0.5), F.lit(0)), F.lit(most)).cast("long")
    blocks = ordered.numbered(sums.select("cat").distinct(), ["cat"], "block")
    rows = sums.withColumn("icons", icons).where("icons > 0").join(blocks, "cat").select("cat", "grp", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("icons") - 1)).alias("k"))
    return rows.select("cat", "grp", ((F.col("block") - 1) * (per_row + 2) + F.col("k") % per_row).alias("x"), (-F.floor(F.col("k") / per_row)).alias("y"))


def bullet(df: DataFrame, cat: str, metric: str, target: Column) -> DataFrame:
    """cat, value, target, delta, the upper edges of two bands at 0.6 and 0.9 of the target, and the axis' end."""
    rows = df.select(F.col(cat).alias("cat"), F.col(metric).cast("double").alias("value"), target.cast("double").alias("target"))
    one, two = 0.6 * F.col("target"), 0.9 * F.col("target")
    return rows.select("cat", "value", "target", (F.col("value") - F.col("target")).alias("delta"), F.least(one, two).alias("band1"), F.greatest(one, two).alias("band2"), (1.1 * F.greatest("value", "target")).alias("end"))


def chord(edges: DataFrame, source: str = "source", target: str = "target", value: str = "value") -> DataFrame:
    """Edges with both ends on the unit circle, nodes in the order of their names, and the weight's share of the largest."""
    ends = edges.select(F.explode(F.array(F.col(source).cast("string"), F.col(target).cast("string"))).alias("node")).distinct()
    angle = 2 * math.pi * (F.col("_i") - 1) / F.col("_n")
    nodes = with_facts(ordered.numbered(ends, ["node"], "_i"), F.count("*").alias("_n")).select("node", F.cos(angle).alias("x"), F.sin(angle).alias("y"))
    place = lambda end, k: nodes.select(F.col("node").alias(f"_{end}"), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    met = with_facts(edges, F.max(value).alias("_top")).join(place("a", 0), F.col(source).cast("string") == F.col("_a")).join(place("b", 1), F.col(target).cast("string") == F.col("_b"))
    return met.select(F.col(source).alias("source"), F.col(target).alias("target"), (F.col(value) / F.col("_top")).alias("weight"), "x0", "y0", "x1", "y1")


def bounds(df: DataFrame, lat: str, lon: str, pad: float = 0.08) -> DataFrame:
    """One row: a map's south, north, west and east with a margin, and its centre; the whole earth without places."""
    x, y = (F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in (lon, lat))
    e = df.agg(F.min(y).alias("s"), F.max(y).alias("n"), F.min(x).alias("w"), F.max(x).alias("e"))
    high, wide = F.greatest(F.col("n") - F.col("s"), F.lit(1e-6)) * pad, F.greatest(F.col("e") - F.col("w"), F.lit(1e-6)) * pad
    none = (F.col("s").isNull()) | (F.col("w").isNull())
    made = {"south": (F.col("s") - high, -90.0), "north": (F.col("n") + high, 90.0), "west": (F.col("w") - wide, -180.0), "east": (F.col("e") + wide, 180.0)}
    out = e.select(*[F.when(none, F.lit(d)).otherwise(c).alias(k) for k, (c, d) in made.items()])
    return out.withColumn("lat", (F.col("south") + F.col("north")) / 2).withColumn("lon", (F.col("west") + F.col("east")) / 2)


def _cells(df: DataFrame, lat: str, lon: str, bins: int, *values: Column) -> DataFrame:
    rows = df.select(F.col(lat).cast("double").alias("y"), F.col(lon).cast("double").alias("x"), *values).where("y IS NOT NULL AND x IS NOT NULL")
    made = with_facts(rows, *[f(c).alias(f"{c}{n}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))])
    return made.withColumns({f"{c}_bin": _bin(F.col(c), F.col(f"{c}lo"), F.col(f"{c}hi"), bins) for c in "xy"})


def contour(df: DataFrame, lat: str, lon: str, metric: str, bins: int = 140, bands: int = 11, how: str = "mean") -> DataFrame:
    """Cells of a grid with their value and its band, of as many bands of equally many cells."""
    cells = _cells(df, lat, lon, bins, F.col(metric).cast("double").alias("v")).groupBy("y_bin", "x_bin")
    made = cells.agg({"mean": F.avg("v"), "sum": F.sum("v"), "count": F.count("v").cast("double")}[how].alias("value")).where("value IS NOT NULL")
    edges = [e for e in ordered.quantiles(made, [(F.col("value"), k / bands) for k in range(bands + 1)]) if e is not None]
    under = sum([F.when(F.col("value") > F.lit(e), 1).otherwise(0) for e in edges], F.lit(0))
    return made.withColumn("band", F.least(F.greatest(under - 1, F.lit(0)), F.lit(bands - 1)))


def hotspots(df: DataFrame, lat: str, lon: str, bins: int = 60, most: int = 3) -> DataFrame:
    """The fullest cells of a grid: their middle and number of rows."""
    cells = _cells(df, lat, lon, bins).groupBy("y_bin", "x_bin", "xlo", "xhi", "ylo", "yhi").agg(F.count("*").alias("n"))
    middle = lambda c: F.col(f"{c}lo") + (F.col(f"{c}hi") - F.col(f"{c}lo")) * (F.col(f"{c}_bin") - 0.5) / bins
    return cells.select(middle("y").alias("lat"), middle("x").alias("lon"), "n").orderBy(F.desc("n"), "lat", "lon").limit(most)


#: Places that a map's layout moves on the driver; charts have dozens.
MOST_PLACES = 3000


def _few(df: DataFrame, *cols: str) -> list:
    """A chart's places, which are a component's rows; more than a chart can show is an error, not a sample."""
    rows = df.select(*cols).dropna().orderBy(*cols).limit(MOST_PLACES + 1).collect()
    if len(rows) > MOST_PLACES:
        raise ValueError(f"over {MOST_PLACES} places: aggregate them first")
    return rows


def cartogram(df: DataFrame, place: str, lat: str, lon: str, metric: str, rounds: int = 160, push: float = 0.55, most: float = 46, least: float = 6) -> DataFrame:
    """place, lat, lon, size: circles by value, pushed apart until none overlap, or for so many rounds."""
    import numpy as np

    rows = _few(df, place, lat, lon, metric)
    y, x, v = (np.array([float(r[i]) for r in rows]) for i in (1, 2, 3))
    root = np.sqrt(np.clip(v, 0, None))
    size = np.clip(root / root.max() * most if len(v) and root.max() > 0 else np.zeros(len(v)), least, None)
    wide = np.cos(np.radians(y.mean())) if len(y) else 1.0
    x, radius = x * wide, size / 300.0
    for _ in range(rounds if len(v) > 1 else 0):
        dx, dy = x[None] - x[:, None], y[None] - y[:, None]
        far = np.hypot(dx, dy)
        over = np.maximum(0, radius[None] + radius[:, None] - far)
        np.fill_diagonal(over, 0)
        if not over.any():
            break
        same = far < 1e-12  # on one spot: apart by their numbers
        angle = 2 * np.pi * np.arange(len(v)) / len(v)
        ux, uy = np.where(same, np.cos(angle)[None] - np.cos(angle)[:, None], dx / np.maximum(far, 1e-12)), np.where(same, np.sin(angle)[None] - np.sin(angle)[:, None], dy / np.maximum(far, 1e-12))
        x, y = x - (ux * over).sum(1) * push / 2, y - (uy * over).sum(1) * push / 2
    return df.sparkSession.createDataFrame([(r[0], float(a), float(b / wide), float(s)) for r, a, b, s in zip(rows, y, x, size, strict=True)], df.select(F.col(place).alias("place")).schema.add("lat", "double").add("lon", "double").add("size", "double"))


def voronoi(df: DataFrame, key: str, x: str, y: str, margin: float = 0.05) -> DataFrame:
    """key, area, polygon (array of x, y): the part of the points' box, with a margin, that is nearer to a point than to any
    other. Points on one spot share their cell."""
    rows = _few(df, key, x, y)
    points = [(float(r[1]), float(r[2])) for r in rows]
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    box = []
    if points:
        mx, my = ((max(c) - min(c)) * margin or 1.0 for c in (xs, ys))
        box = [(min(xs) - mx, min(ys) - my), (max(xs) + mx, min(ys) - my), (max(xs) + mx, max(ys) + my), (min(xs) - mx, max(ys) + my)]
    out = []
    for r, p in zip(rows, points, strict=True):
        cell = box
        for far, q in sorted((math.dist(p, q), q) for q in set(points) if q != p):
            if far / 2 > max(math.dist(p, c) for c in cell):
                break
            cell = _nearer(cell, p, q)
        area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(cell, [*cell[1:], cell[0]], strict=True))) / 2
        out.append((r[0], area, [list(c) for c in cell]))
    return df.sparkSession.createDataFrame(out, df.select(F.col(key).alias("key")).schema.add("area", "double").add("polygon", ArrayType(ArrayType(DoubleType()))))


def _nearer(cell: list, p: tuple, q: tuple) -> list:
    """The part of a convex polygon that is nearer to p than to q."""
    side = lambda c: math.dist(c, q) ** 2 - math.dist(c, p) ** 2
    out = []
    for a, b in zip(cell, [*cell[1:], cell[0]], strict=True):
        sa, sb = side(a), side(b)
        if sa >= 0:
            out.append(a)
        if (sa > 0) != (sb > 0) and sa != sb:
            t = sa / (sa - sb)
            out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
    return out


def spec(chart: str, columns: list[str], title: str = "", theme: str = "dark_blue", data: str = "") -> str:
    """A chart's specification as JSON: what a renderer needs beside the data."""
    return json.dumps({"chart": chart, "columns": columns, "title": title, "theme": theme, "data": data}, sort_keys=True)
