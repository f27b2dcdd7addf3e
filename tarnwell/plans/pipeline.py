"""Raw files to a cleaned table, and a cleaned table to components: the entry points."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout, planner, profile, roles, shapes, topics
from ..sources import files
from ..sources.storage import Storage
from . import rules
from .config import Config

#: Columns by which a cleaned table is ordered where it has them.
ORDER = ("event_time", "row_id")


@dataclass
class Silver:
    df: DataFrame
    schema: roles.Schema
    report: dict
    log: list[dict]
    failed: list[tuple[str, str]]


def ordered_by(df: DataFrame, cols: tuple = ORDER) -> DataFrame:
    """df in the order of those columns that it has: by ranges, and sorted within each."""
    have = [c for c in cols if c in df.columns]
    return df.repartitionByRange(*have).sortWithinPartitions(*have) if have else df


def to_silver(spark: SparkSession, paths: list[str], dataset: str = "", frozen: roles.Schema | None = None, order_by: list[str] | None = None, out: str | None = None, mode: str = "auto", subset: int = 0, config: Config | None = None, sort_by: tuple = ORDER) -> Silver:
    """Reads and unions files, gives columns their types, cleans them by rules, and writes the table, its schema, a schema
    report and the log of passes.

    Mode apply: the frozen schema's roles hold and one pass is made. bootstrap: the schema is inferred, and passes repeat
    while they improve it; with subset, on so many rows by their hash, and the whole table is then cleaned once by what was
    found. auto: apply with a frozen schema, given or lying at out; else bootstrap."""
    config = config or Config()
    store = Storage(spark)
    if frozen is None and mode != "bootstrap" and out and store.exists(f"{out}/schema.toml"):
        frozen = roles.Schema.from_toml(store.read_bytes(f"{out}/schema.toml").decode())
    if mode == "apply" and frozen is None:
        raise FileNotFoundError("no frozen schema to apply")
    failed: list = []
    raw = files.bronze(files.read_union(spark, paths, failed))
    if out:
        files.write_any(raw, f"{out}/normalize.parquet")
        raw = spark.read.parquet(f"{out}/normalize.parquet")
    if frozen and mode != "bootstrap":
        made = rules.clean(raw, config.rules, frozen, config.env, order_by, cfg=config.roles)
        log = [{"iter": 0, "schema_conf": made.schema.confidence, "rules_applied": len(made.hits)}]
    else:
        part = raw.orderBy(F.xxhash64(*raw.columns)).limit(subset) if subset and raw.count() > subset else raw
        made, log = rules.improve(part, dataset, config.loop["max_iter"], config.loop["min_schema_confidence"], order_by, config.rules, config.env, config.loop["min_improvement"], config.roles)
        if part is not raw:
            made = rules.clean(raw, config.rules, roles.propose(part, dataset, config.roles), config.env, order_by, cfg=config.roles)
    schema = frozen if frozen and mode != "bootstrap" else roles.Schema(dataset, made.schema.columns)
    if out:
        files.write_any(ordered_by(made.df, sort_by), f"{out}/dataset.parquet")
        files.write_any(files.schema_report(made.df), f"{out}/schema_report.parquet")
        store.write_bytes(f"{out}/schema.toml", schema.to_toml().encode())
        store.delete(f"{out}/loop_iter")
        files.append_log(spark, f"{out}/loop_iter", log)
    return Silver(made.df, schema, made.report(), log, failed)


#: Words for missing that a column's frequent values are searched for.
EMPTY_WORDS = frozenset(("", "na", "n/a", "none", "null", "nan", "-", "--", "nil", "missing", "unknown", "?"))


def series_metrics(df: DataFrame, found: dict | None = None) -> dict[str, dict]:
    """Coverage, distinct values, length, and words for missing among the 200 most frequent values of each column."""
    found = found or profile.facts(df, quartiles=False)
    texts = [c for c, f in found.items() if f["type"] == "string"]
    empty: dict[str, list] = {c: [] for c in texts}
    if texts:
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.lower(F.trim(F.col(f"`{c}`"))).alias("v")) for c in texts])).alias("s")
        known = df.select(each).where(F.col("s.v").isin(*sorted(EMPTY_WORDS))).groupBy("s.c", "s.v").agg(F.count("*").alias("n")).collect()
        counts = sorted(known, key=lambda r: (-r.n, r.v))
        for r in counts:
            empty[r.c].append(r.v)
    return {c: {"non_null_ratio": f["non_null_ratio"], "nunique": f["nunique"], "unique_ratio": f["unique_ratio"], "avg_len": f["avg_len"], "empty_token_candidates": empty.get(c, [])} for c, f in found.items()}


def suggested(dtype: str, role: str, m: dict) -> dict[str, Any]:
    """What to do with a column: drop it if next to nothing is there, else how to fill it; how to tidy text; doubts."""
    fill = {"numeric": "median", "categorical": "Unknown", "text": "N/A", "time": "parse/ffill", "bool": "mode"}
    out: dict[str, Any] = {"drop": m["non_null_ratio"] < 0.10 and role not in ("id", "time")}
    if not out["drop"] and role in fill:
        out["impute"] = fill[role]
    if dtype == "string":
        out["normalize"] = {"strip": True, "lower": False}
    if role == "id" and m["unique_ratio"] < 0.9:
        out["flag_low_uniqueness_for_id"] = True
    return out


def bootstrap(spark: SparkSession, paths: list[str], dataset: str, config: Config | None = None, out: str | None = None) -> dict:
    """A dataset's proposed schema with metrics, suggestions and hints of each column, from the first rows of its files."""
    config = config or Config()
    df = files.bronze(files.sample(spark, paths, int(config.loop["sample_rows"])))
    found = profile.facts(df, quartiles=False)
    schema, metrics = roles.propose(df, dataset, config.roles, found), series_metrics(df, found)
    columns = []
    for c in schema.columns:
        c.hints = {"unit_hint": roles.unit_hint(df, c.name) if c.dtype == "string" else None, "canonical_map_size": roles.canonical_categories(df, c.name).count() if c.role == "categorical" else 0}
        columns.append({"name": c.name, "dtype": c.dtype, "role": c.role, "role_confidence": c.confidence, "metrics": metrics[c.name], "suggestions": suggested(c.dtype, c.role, metrics[c.name]), "hints": c.hints})
    made = {"dataset": dataset, "row_count": next((f["rows"] for f in found.values()), 0), "column_count": len(columns), "schema_confidence": schema.confidence, "columns": columns}
    if out:
        store = Storage(spark)
        store.write_bytes(f"{out}/nlp_bootstrap.json", json.dumps(made, indent=2).encode())
        store.write_bytes(f"{out}/schema.toml", schema.to_toml().encode())
    return made | {"schema": schema}


def plan_topics(df: DataFrame, schema: roles.Schema | None = None, config: Config | None = None) -> tuple[DataFrame, DataFrame, bool]:
    """(candidates, selected with scores, whether they are the fallback's): without candidates, a few of the fallback."""
    config = config or Config()
    r = topics.Roles.of(df, schema=schema)
    seen = topics.Seen.of(df, r)
    found = topics.base_candidates(df, r, seen) + planner.engineered(df, r, seen)
    every = topics.as_frame(df.sparkSession, found)
    if found:
        return every, topics.select(topics.score(every, config.weights, config.thresholds), config.thresholds), False
    few = planner.fallback(df, r, seen, most=config.thresholds.most)
    made = topics.score(topics.as_frame(df.sparkSession, [t for t, _ in few]), config.weights, config.thresholds)
    scores = df.sparkSession.createDataFrame([(t.topic_id, float(s)) for t, s in few], "topic_id string, own double")
    chosen = made.join(F.broadcast(scores), "topic_id").withColumn("score_total", F.col("own")).select(*made.columns).orderBy(F.desc("score_total"), "topic_id")
    return made, chosen, True


def to_gold(df: DataFrame, dataset: str = "", schema: roles.Schema | None = None, out: str | None = None, config: Config | None = None, recheck: bool = False) -> dict:
    """Plans, scores and selects topics, and makes a component of each, with the specifications of the charts that fit it,
    as many as the settings allow; layout and manifest as dicts. recheck: the table goes through the rules once more,
    without losing a column or a value."""
    config = config or Config()
    if recheck:
        df = rules.recheck(df, schema or roles.derived(df, dataset), config.rules, config.env).df
    every, chosen, _ = plan_topics(df, schema, config)
    rows = chosen.collect()
    made, charts = [], []
    for i, r in enumerate(rows):
        component = topics.materialize(df, r, [c for c in ORDER if c in df.columns] or None)
        name = f"component_{i + 1:03d}_{r.family}"
        if out:
            files.write_any(component, f"{out}/transformed_data/{name}.parquet")
        made.append({"name": name, "topic_id": r.topic_id, "family": r.family, "columns": component.columns, "proposed_charts": list(r.proposed_charts)})
        charts += layout.charts(r, name, component.columns, config.charts_per_topic)
    done = {"layout": layout.plan(chosen, dataset), "manifest": layout.manifest(made, charts)}
    if out:
        store = Storage(df.sparkSession)
        files.write_any(every, f"{out}/artifacts/topics.parquet")
        files.write_any(chosen, f"{out}/artifacts/topics_selected.parquet")
        store.write_bytes(f"{out}/artifacts/layout_plan.json", json.dumps(done["layout"], indent=2).encode())
        store.write_bytes(f"{out}/manifest.json", json.dumps(done["manifest"], indent=2).encode())
        for c in charts:
            spec = shapes.spec(c["chart"], c["columns"], c["title"], str(config.section("env.theme") or "dark_blue"), f"transformed_data/{c['component']}.parquet")
            store.write_bytes(f"{out}/artifacts/charts/{c['chart_id']}.json", spec.encode())
    return done
