"""What a report shows of the chosen topics: sections, badges, a manifest and a narrative."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import short_id, slugify
from .topics import CHARTS


def badges(topic) -> list[str]:
    sig = json.loads(topic.significance or "{}")
    out = []
    if sig.get("p_value") is not None and sig["p_value"] <= 0.05:
        out.append("significant")
    if topic.coverage_pct < 0.5:
        out.append("low-coverage")
    if topic.family == "kpi":
        out.append("key-metric")
    if topic.family == "causal":
        out.append("causal")
    return out


def plan(selected: DataFrame, dataset: str = "") -> dict:
    """Sections in order of score: title, chart, badges. Topics are a dozen; the driver holds them."""
    rows = selected.orderBy(F.desc("score_total"), "topic_id").collect()
    sections = [{"topic_id": r.topic_id, "title": f"{r.family}: {', '.join(r.primary_fields)}", "chart": next(iter(r.proposed_charts or CHARTS.get(r.family, [])), "table"), "badges": badges(r)} for r in rows]
    return {"dataset": dataset, "sections": sections}


#: Charts that fit a component of a family's columns.
FITS = {
    frozenset(("time", "value")): ("line", "column", "area", "calendar_heatmap"), frozenset(("a", "b")): ("scatter", "bubble", "xy_heatmap"), frozenset(("cat", "mean", "count")): ("ordered_bar", "ordered_column", "lollipop", "boxplot", "violin"),
    frozenset(("cat", "total")): ("ordered_bar", "ordered_column", "lollipop"), frozenset(("cat", "count")): ("ordered_bar", "ordered_column", "lollipop"), frozenset(("cat", "total", "pct_total")): ("treemap", "pie", "donut"),
    frozenset(("cat", "count", "pct_total")): ("treemap", "pie", "donut"), frozenset(("value",)): ("histogram", "boxplot", "violin", "beeswarm", "dot_strip_plot", "barcode_plot", "frequency_polygon", "cumulative_curve"),
    frozenset(("index", "value", "z")): ("diverging_bar",), frozenset(("metric_name", "value")): ("kpi",), frozenset(("a", "b", "count")): ("table", "xy_heatmap"),
}


def charts(topic, component: str, columns: list[str], most: int) -> list[dict]:
    """The charts that a topic proposes and its component's columns can draw, most of them at most."""
    own = FITS.get(frozenset(columns), ("bar", "column") if topic.family == "causal" else ("calendar_heatmap",) if topic.family == "cohort" else ())
    wanted = [c for c in (topic.proposed_charts or CHARTS.get(topic.family, [])) if c in own][:most]
    title = f"{topic.family}: {', '.join(topic.primary_fields)}"
    return [{"topic_id": topic.topic_id, "chart": c, "chart_id": chart_id(topic.topic_id, f"{topic.family}-{c}"), "component": component, "columns": list(columns), "title": title} for c in wanted]


def chart_id(topic_id: str, name: str) -> str:
    """A name that is the same for the same topic and chart."""
    return f"{slugify(name)}-{short_id([topic_id, name])}"


def manifest(components: list[dict], charts: list[dict] = ()) -> dict:
    return {"components": list(components), "charts": list(charts), "counts": {"components": len(components), "charts": len(list(charts))}}


def inventory(entries: DataFrame) -> DataFrame:
    """kind, slug, n of a catalog's entries."""
    return entries.groupBy("kind", "slug").agg(F.count("*").alias("n")).orderBy("kind", "slug")


def payload(dataset: str, counts: list, selected: list) -> dict:
    """What a narrative is made of, as a dict, with its text."""
    return {"dataset": dataset, "inventory": [r.asDict() for r in counts], "topics": [{"topic_id": r.topic_id, "family": r.family, "fields": list(r.primary_fields), "score": r.score_total} for r in selected], "text": narrative(dataset, counts, selected)}


def narrative(dataset: str, counts: list, selected: list) -> str:
    lines = [f"# {dataset}", "", "## Files", *[f"- {r.kind} {r.slug}: {r.n}" for r in counts], "", "## Topics", *[f"- {r.family}: {', '.join(r.primary_fields)} (score {r.score_total:.2f})" for r in selected]]
    return "\n".join(lines) + "\n"
