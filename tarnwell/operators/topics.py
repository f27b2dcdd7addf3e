"""Topics: candidate analyses of a frame, their scores, and the choice among them."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field
from itertools import combinations
from math import inf, sqrt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import pvalues
from ..sources.staged import stage
from . import features as fe
from . import gold, ordered, profile, roles, stats

#: Caps of the planner, names that are no metric.
MOST_NUMERIC, MOST_CATEGORIES, MOST_CARDINALITY, LEAST_VALUES = 16, 12, 60, 10
ID_NAMES = r"(?:^id$|_id$|^id_|uuid|guid|hash|checksum|^row_?id$|^entity_?id$|_index$)"
URI_NAMES = r"(?:uri|url|^path$|file(path|name)$)"
TEXT_LENGTH = 20


@dataclass
class Topic:
    """kind tells topics of one family apart, as in their identifiers."""

    family: str
    primary: list[str]
    secondary: list[str] = field(default_factory=list)
    effect: float = 0.0
    detail: dict = field(default_factory=dict)
    significance: dict = field(default_factory=dict)
    n_obs: int = 0
    coverage: float = 1.0
    complexity: float = 0.0
    charts: list[str] = field(default_factory=list)
    time: str | None = None
    kind: str = ""
    design: str | None = None
    assumptions: list[str] = field(default_factory=list)
    readability: float = 1.0

    @property
    def topic_id(self) -> str:
        fields = self.primary if not self.kind else [*self.secondary, *([self.time] if self.time else []), *self.primary]
        return hashlib.sha1(f"{self.kind or self.family}:{'|'.join(fields)}".encode()).hexdigest()[:10]

    def record(self) -> tuple:
        plain = lambda v: None if isinstance(v, float) and (v != v or abs(v) == inf) else v
        clean = lambda d: json.dumps({k: plain(v) for k, v in d.items()}, sort_keys=True)
        return (
            self.topic_id, self.family, self.primary, self.secondary, self.time, int(self.n_obs), float(min(1, max(0, self.coverage))), float(self.effect), clean(self.detail), clean(self.significance),
            self.design, self.assumptions, float(self.readability), float(self.complexity), self.charts,
        )


RECORD = (
    "topic_id string, family string, primary_fields array<string>, secondary_fields array<string>, time_field string, n_obs long, coverage_pct double, effect_size double, effect_detail string, "
    "significance string, causal_design string, assumptions_met array<string>, readability double, complexity_penalty double, proposed_charts array<string>"
)
CHARTS = {"kpi": ["kpi"], "trend": ["line", "column", "area"], "correlation": ["scatter", "xy_heatmap"], "ranking": ["ordered_bar", "ordered_column", "lollipop"], "part_to_whole": ["treemap", "pie", "donut"], "distribution": ["histogram", "boxplot"], "deviation": ["diverging_bar"], "cohort": ["calendar_heatmap"], "causal": ["bar", "column"]}


def as_frame(spark: SparkSession, topics: list[Topic]) -> DataFrame:
    return spark.createDataFrame([t.record() for t in topics], RECORD)


def good_metric(name: str, f: dict) -> bool:
    return f["type"] in ("int", "float") and not re.search(ID_NAMES, name, re.I) and not re.search(URI_NAMES, name, re.I) and f["non_null"] >= LEAST_VALUES and not (f["type"] == "int" and f["unique_ratio"] >= 0.98)


def good_category(name: str, f: dict, most: int = MOST_CARDINALITY) -> bool:
    return f["type"] in ("string", "bool") and 2 <= f["nunique"] <= most and not re.search(ID_NAMES, name, re.I)


@dataclass
class Roles:
    time: str | None
    entity: str | None
    metrics: list[str]
    categories: list[str]
    booleans: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)

    @staticmethod
    def of(df: DataFrame, found: dict | None = None, schema: roles.Schema | None = None) -> Roles:
        found = found or profile.facts(df, quartiles=False)
        by = schema.roles() if schema else {}
        times = [c for c in found if by.get(c) == "time" and found[c]["type"] == "datetime"] or [c for c, f in found.items() if f["type"] == "datetime"]
        entity = next((c for c, f in found.items() if (by.get(c) == "id" or roles.name_role(c) == "id" or c.endswith("key")) and f["unique_ratio"] < 0.95), None)
        whole = [c for c, f in found.items() if f["type"] == "bool" or f["type"] == "int" and f["nunique"] == 2 and (f["min"], f["max"]) == (0, 1)]
        metrics = [c for c, f in found.items() if good_metric(c, f) and c not in whole]
        useful = lambda c: (found[c]["non_null_ratio"], found[c]["std"] or 0.0)
        if len(metrics) > MOST_NUMERIC:
            metrics = sorted(metrics, key=useful, reverse=True)[:MOST_NUMERIC]
        cats = [c for c, f in found.items() if good_category(c, f) and f["type"] == "string"]
        if len(cats) > MOST_CATEGORIES:
            cats = sorted(cats, key=lambda c: found[c]["nunique"])[:MOST_CATEGORIES]
        texts = [c for c, f in found.items() if f["type"] == "string" and c not in cats and (f["avg_len"] or 0) >= TEXT_LENGTH and not re.search(f"{ID_NAMES}|{URI_NAMES}", c, re.I)]
        return Roles(times[0] if times else None, entity, metrics, cats, whole[:MOST_CATEGORIES], texts)


@dataclass
class Seen:
    """What planning reads of a frame, from a handful of aggregates whatever the number of columns: moments by metric, r and
    n by pair of metrics, moments by category, value and metric, associations by pair of categories, slopes by metric."""

    rows: int
    moments: dict
    pairs: dict
    groups: dict
    tables: dict
    slopes: dict
    retention: tuple | None

    @staticmethod
    def of(df: DataFrame, r: Roles) -> Seen:
        f, rows, moments = None, 0, {}
        pairs = list(combinations(r.metrics, 2))
        aggs = [F.count("*").alias("rows")]
        xs = {m: F.col(f"`{m}`").cast("double") for m in r.metrics}
        for i, m in enumerate(r.metrics):
            aggs += [f_(xs[m]).alias(f"{n}{i}") for n, f_ in (("n", F.count), ("m", F.avg), ("s", F.stddev_samp), ("lo", F.min), ("hi", F.max), ("g", F.skewness), ("k", F.kurtosis))]
            aggs.append(F.avg((xs[m] > 0).cast("double")).alias(f"p{i}"))
        for i, (a, b) in enumerate(pairs):
            aggs += [F.corr(xs[a], xs[b]).alias(f"r{i}"), F.count(F.when(xs[a].isNotNull() & xs[b].isNotNull(), 1)).alias(f"c{i}")]
        f = df.agg(*aggs).first()
        rows = f["rows"]
        q = ordered.quantiles(df, [(xs[m], s) for m in r.metrics for s in (0.25, 0.75)])
        for i, m in enumerate(r.metrics):
            n, g, k = f[f"n{i}"], f[f"g{i}"], f[f"k{i}"]
            skew = g * sqrt(n * (n - 1)) / (n - 2) if n > 2 and g is not None else None
            kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * k + 6) if n > 3 and k is not None else None
            moments[m] = {"n": n, "mean": f[f"m{i}"], "std": f[f"s{i}"], "min": f[f"lo{i}"], "max": f[f"hi{i}"], "positive": f[f"p{i}"], "skew": skew, "kurt": kurt, "iqr": q[2 * i + 1] - q[2 * i] if n else None}
        met = {p: (f[f"r{i}"], f[f"c{i}"]) for i, p in enumerate(pairs)}
        cats = [*r.categories, *r.booleans]
        return Seen(rows, moments, met, _groups(df, r.metrics, cats), _tables(df, r), _slopes(df, r), _retention(df, r))


def _groups(df: DataFrame, metrics: list[str], cats: list[str]) -> dict:
    """{category: [(value, rows, {metric: (n, mean, sum of squares, sum)})]}: one aggregate over all categories, of at most
    MOST_CARDINALITY values each."""
    out: dict = {c: [] for c in cats}
    if not cats:
        return out
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for i, c in enumerate(cats)])).alias("s")
    rows = df.select(each, *[F.col(f"`{m}`").cast("double").alias(f"x{j}") for j, m in enumerate(metrics)]).where("s.v IS NOT NULL")
    aggs = [F.count("*").alias("rows")]
    for j in range(len(metrics)):
        x = F.col(f"x{j}")
        aggs += [F.count(x).alias(f"n{j}"), F.avg(x).alias(f"m{j}"), (F.var_pop(x) * F.count(x)).alias(f"q{j}"), F.sum(x).alias(f"t{j}")]
    for g in rows.groupBy("s.c", "s.v").agg(*aggs).orderBy("c", "v").collect():
        out[cats[g.c]].append((g.v, g.rows, {m: (g[f"n{j}"], g[f"m{j}"], g[f"q{j}"], g[f"t{j}"]) for j, m in enumerate(metrics)}))
    return out


def _tables(df: DataFrame, r: Roles) -> dict:
    """{(a, b): (v, n, dof, chi2)} of all pairs of categories, and of booleans: one aggregate, sums by row and by column."""
    pairs = [*combinations(r.categories, 2), *combinations(r.booleans, 2)]
    if not pairs:
        return {}
    text = lambda c: F.col(f"`{c}`").cast("string")
    both = [F.struct(F.lit(i).alias("p"), text(a).alias("a"), text(b).alias("b")) for i, (a, b) in enumerate(pairs)]
    cells = df.select(F.inline(F.array(*both))).dropna().groupBy("p", "a", "b").agg(F.count("*").alias("o"))
    sums = cells.withColumn("r", F.sum("o").over(Window.partitionBy("p", "a"))).withColumn("c", F.sum("o").over(Window.partitionBy("p", "b")))
    made = sums.groupBy("p").agg(F.sum("o").alias("n"), F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))).alias("s"), F.countDistinct("a").alias("ka"), F.countDistinct("b").alias("kb"))
    out = {}
    for x in made.collect():
        least = min(x.ka, x.kb) - 1
        chi2 = max(0.0, x.n * (x.s - 1)) if least > 0 else 0.0
        out[pairs[x.p]] = (sqrt(chi2 / (x.n * least)) if least > 0 else 0.0, x.n, (x.ka - 1) * (x.kb - 1) if least > 0 else 0, chi2)
    return out


def _slopes(df: DataFrame, r: Roles) -> dict:
    """{metric: (slope, days)} of daily means, which one aggregate makes for all metrics."""
    if not r.time or not r.metrics:
        return {}
    day = F.date_trunc("day", F.col(f"`{r.time}`")).cast("timestamp_ntz")
    days = stage(df.where(F.col(f"`{r.time}`").isNotNull()).groupBy(day.alias("time")).agg(*[F.avg(F.col(f"`{m}`").cast("double")).alias(f"x{j}") for j, m in enumerate(r.metrics)]))
    out = {}
    for j, m in enumerate(r.metrics):
        s = stats.trend_slope(days.select("time", f"x{j}"), f"x{j}", ["time"]).first()
        out[m] = (s.slope, s.n) if s else (0.0, 0)
    return out


def _retention(df: DataFrame, r: Roles) -> tuple | None:
    if not r.time or not r.entity:
        return None
    return tuple(stats.cohorts(df, r.entity, r.time).agg(F.avg("retention_pct").alias("m"), F.sum("retained").alias("n")).first())


def anova_of(groups: list, metric: str) -> dict:
    """eta2, k, n, f, p from moments by group."""
    some = [g[metric][:3] for _, _, g in groups if g[metric][0]]
    k, n = len(some), sum(x[0] for x in some)
    if k < 2:
        return {"eta2": 0.0, "k": k, "n": n, "f": 0.0, "p": 1.0}
    middle = sum(x[0] * x[1] for x in some) / n
    ssb, ssw = sum(x[0] * (x[1] - middle) ** 2 for x in some), sum(x[2] for x in some)
    msb, msw = ssb / (k - 1), ssw / (n - k) if n > k else 0.0
    f = msb / msw if msw > 0 else inf if ssb > 0 else 0.0
    return {"eta2": ssb / (ssb + ssw) if ssb + ssw > 0 else 0.0, "k": k, "n": n, "f": f, "p": 0.0 if f == inf else pvalues.f_sf(f, k - 1, n - k)}


def welch_of(groups: list, metric: str) -> float:
    """p of the difference of two groups' means; 1 where one has under 3 values."""
    arms = [g[metric][:3] for _, _, g in groups]
    if len(arms) != 2 or min(a[0] for a in arms) < 3:
        return 1.0
    (na, ma, qa), (nb, mb, qb) = arms
    se = (qa / (na - 1) / na + qb / (nb - 1) / nb) ** 0.5
    return pvalues.z_two_tailed((ma - mb) / se if se else inf)


def _shares(groups: list, metric: str) -> tuple[list[str], list[float]]:
    """Groups in order of their sums, the largest first, and the sums' shares; nothing to share gives zeros."""
    sums = sorted(((g[metric][3] or 0.0, v) for v, _, g in groups if g[metric][0]), key=lambda x: (-x[0], x[1]))
    total = sum(s for s, _ in sums)
    return [v for _, v in sums], [s / total if total > 0 else 0.0 for s, _ in sums]


def gini_of(shares: list[float]) -> float:
    xs = sorted(x for x in shares if x >= 0)
    n, total = len(xs), sum(xs)
    return 2 * sum(i * x for i, x in enumerate(xs, 1)) / (n * total) - (n + 1) / n if total > 0 else 0.0


def base_candidates(df: DataFrame, r: Roles, seen: Seen | None = None) -> list[Topic]:
    """One family after another, all from what was seen."""
    seen = seen or Seen.of(df, r)
    out: list[Topic] = []
    rows = max(1, seen.rows)
    for m, f in seen.moments.items():
        n, share = f["n"], f["n"] / rows
        if n < LEAST_VALUES:
            continue
        out.append(Topic("kpi", [m], [], 0.0, {"mean": f["mean"], "sum": f["mean"] * n}, {}, n, share, 0, CHARTS["kpi"]))
        spread = f["iqr"] / abs(f["mean"]) if f["mean"] else 0.0
        out.append(Topic("distribution", [m], [], spread, {"skew": f["skew"], "kurtosis": f["kurt"]}, {}, n, share, 0, CHARTS["distribution"]))
        if f["std"]:
            zmax = max(abs(f["max"] - f["mean"]), abs(f["min"] - f["mean"])) / f["std"]
            out.append(Topic("deviation", [m], [], zmax, {"zmax": zmax}, {}, n, share, 0, CHARTS["deviation"]))
    for (a, b), (corr, n) in seen.pairs.items():
        if n >= 3 and corr is not None and corr == corr:
            out.append(Topic("correlation", [a, b], [], abs(corr), {"r": corr}, {"test": "pearson", "p_value": pvalues.pearson_p(corr, n)}, n, n / rows, 0, CHARTS["correlation"]))
    for m, (slope, n) in seen.slopes.items():
        if n >= 3:
            out.append(Topic("trend", [m], [], abs(slope), {"slope": slope, "n_points": n}, {}, n, 1.0, 0, CHARTS["trend"], time=r.time))
    for m in r.metrics:
        for c in r.categories:
            a = anova_of(seen.groups[c], m)
            if a["k"] >= 2:
                out.append(Topic("correlation", [m, c], [], a["eta2"], {"eta2": a["eta2"], "f": a["f"]}, {"test": "anova", "p_value": a["p"]}, a["n"], a["n"] / rows, 0, ["ordered_bar", "lollipop"]))
    for (a, b), (v, n, dof, chi2) in seen.tables.items():
        if dof and a in r.categories:
            out.append(Topic("correlation", [a, b], [], v, {"v": v, "chi2": chi2}, {"test": "chi2", "p_value": pvalues.chi2_sf(chi2, dof)}, n, n / rows, 0, ["table"]))
    for c in r.categories if r.metrics else []:
        m = r.metrics[0]
        names, shares = _shares(seen.groups[c], m)
        out.append(Topic("ranking", [c, m], [], sum(s * s for s in shares), {"top": names[:5]}, {}, rows, 1.0, 0, CHARTS["ranking"]))
        out.append(Topic("part_to_whole", [c, m], [], max(shares, default=0.0), {"gini": gini_of(shares)}, {}, rows, 1.0, 0, CHARTS["part_to_whole"]))
    if seen.retention:
        mean, n = seen.retention
        out.append(Topic("cohort", [r.entity], [], mean or 0.0, {"mean_retention": mean}, {}, n or 0, 1.0, 0.1, CHARTS["cohort"], time=r.time))
    return out


@dataclass(frozen=True)
class Weights:
    suitability: float = 3.0
    effect: float = 2.5
    signal: float = 2.0
    readability: float = 1.5
    complexity: float = 1.0


@dataclass(frozen=True)
class Thresholds:
    slope: float = 0.02
    correlation: float = 0.3
    causal_coverage: float = 0.7
    most: int = 12


def score(topics: DataFrame, w: Weights = Weights(), t: Thresholds = Thresholds()) -> DataFrame:
    """Adds effect_norm, suitability, readability_penalty, signal_quality, complexity and score_total."""
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    e, fam = F.coalesce("effect_size", F.lit(0.0)), F.col("family")
    norm = (
        F.when(fam.isin("correlation", "ranking", "part_to_whole", "cohort"), unit(e)).when(fam == "trend", unit(e / max(3 * t.slope, 1e-12))).when(fam == "distribution", unit(e / (1 + e)))
        .when(fam == "deviation", unit(e / (3 + e))).when(fam == "causal", unit(e / (0.5 + e))).when(fam == "kpi", F.lit(0.2)).otherwise(F.lit(0.0))
    )
    points = F.coalesce(F.get_json_object("effect_detail", "$.n_points").try_cast("double"), F.lit(0.0))
    penalty = F.when((fam == "correlation") & (F.col("n_obs") < 30), 0.3).when((fam == "trend") & (points > 180), 0.1).when(fam == "cohort", 0.1).otherwise(0.0)
    p = F.get_json_object("significance", "$.p_value").try_cast("double")
    signal = F.when(p.isNotNull(), unit(1 - p)).otherwise(unit(F.coalesce("n_obs", F.lit(0)) / 100))
    made = topics.withColumns({"effect_norm": norm, "suitability": unit(F.coalesce("coverage_pct", F.lit(0.0))), "readability_penalty": penalty, "signal_quality": signal})
    made = made.withColumn("complexity", F.coalesce("complexity_penalty", F.lit(0.0)) + F.col("readability_penalty"))
    total = w.suitability * F.col("suitability") + w.effect * F.col("effect_norm") + w.signal * F.col("signal_quality") + w.readability * (1 - F.col("readability_penalty")) - w.complexity * F.col("complexity")
    return made.withColumn("score_total", total)


def select(scored: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """The best topics: without weak correlations, weak trends and thin causal ones, one for each family and fields."""
    pearson = F.coalesce(F.get_json_object("significance", "$.test") == "pearson", F.lit(False))
    fam = F.col("family")
    kept = scored.where(~((fam == "correlation") & pearson & (F.col("effect_size") < t.correlation)))
    kept = kept.where(~((fam == "trend") & (F.col("effect_norm") < (1 / 3 if t.slope > 0 else 0.0))))
    kept = kept.where(~((fam == "causal") & (F.col("coverage_pct") < t.causal_coverage)))
    best = Window.partitionBy("family", "primary_fields").orderBy(F.desc("score_total"), "topic_id")
    return kept.withColumn("_i", F.row_number().over(best)).where("_i = 1").drop("_i").orderBy(F.desc("score_total"), "topic_id").limit(t.most)


def candidates(df: DataFrame, schema: roles.Schema | None = None, engineered: bool = True) -> DataFrame:
    """Base topics and, unless they are not wanted, engineered ones, from the same aggregates."""
    from . import planner

    r = Roles.of(df, schema=schema)
    seen = Seen.of(df, r)
    found = base_candidates(df, r, seen)
    return as_frame(df.sparkSession, found + (planner.engineered(df, r, seen) if engineered else []))


def features_of(topic) -> list[fe.FeatureSpec]:
    """The features that a topic's plan asks for."""
    plan = json.loads(topic.effect_detail or "{}").get("feature_plan", [])
    return [fe.FeatureSpec(p["name"], p["kind"], tuple(p["base_cols"]), p.get("params", {})) for p in plan]


#: What counts rows instead of a metric.
ROW_COUNT = "__row_count__"


def materialize(df: DataFrame, topic, order_by: list[str] | None = None) -> DataFrame:
    """The component of a topic's row. Features that it plans are made first; an order that ties needs more columns."""
    p, family, time = list(topic.primary_fields), topic.family, topic.time_field
    plan = features_of(topic)
    if family == "causal":
        return _effect(df, topic, plan)
    if plan:
        first = plan[0]
        made = fe.execute(df, [first], order_by or ([time] if time else []))
        if family == "trend":
            return gold.trend(made, time, first.name)
        return gold.ranking(made, first.name) if family == "ranking" else gold.distribution(made, first.name)
    if family == "kpi":
        return gold.kpi(df, p[0])
    if family == "trend":
        return gold.trend(df, time, p[0])
    if family == "correlation":
        numeric = [c for c in p if profile.tag(df.schema[c].dataType) in ("int", "float")]
        if len(numeric) == 2:
            return gold.correlation_pairs(df, *p)
        if numeric:
            return gold.by_category(df, next(c for c in p if c not in numeric), numeric[0])
        return df.dropna(subset=p).groupBy(F.col(p[0]).alias("a"), F.col(p[1]).alias("b")).agg(F.count("*").alias("count"))
    if family in ("ranking", "part_to_whole"):
        metric = None if p[1] == ROW_COUNT else p[1]
        return (gold.ranking if family == "ranking" else gold.part_to_whole)(df, p[0], metric)
    if family == "distribution":
        return gold.distribution(df, p[0])
    if family == "deviation":
        return gold.deviations(df, p[0], order_by)
    if family == "cohort":
        return gold.cohort(df, p[0], time)
    return df


def _effect(df: DataFrame, topic, plan: list) -> DataFrame:
    """One row: what a causal screen finds, beside what the topic says of it."""
    spec = plan[0]
    value, treated = spec.base_cols[0], spec.base_cols[1]
    arms = df.where(F.col(treated).isNotNull()).select(F.max(F.col(treated).cast("string"))).first()[0]
    arm = F.col(treated).cast("string") == F.lit(arms)
    made = fe.ab_difference(df, value, arm) if spec.kind == "causal_ab" else fe.difference_in_differences(df, value, arm, spec.base_cols[2])
    return made.withColumn("effect_detail", F.lit(topic.effect_detail))
