"""Engineered topics: features worth making, screens of pairs of columns, tables of counts, and causal screens.

A plan is a list of features with names, kinds and parameters, which features.execute makes; nothing is computed here but
what planning itself has seen already.
"""

from __future__ import annotations

import re
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pvalues
from . import features as fe
from .topics import CHARTS, LEAST_VALUES, ROW_COUNT, Roles, Seen, Topic, _shares, anova_of, gini_of, welch_of

#: Parts of names that tell a rate's two sides and a treatment; thresholds of the screens; how many columns,
#: levels and tokens a plan takes.
DENOMINATORS, NUMERATORS = r"(total|overall|base|denom|_all$)", r"(success|win|click|conv|count|num|passed|ok)"
TREATMENTS = ("treat", "variant", "group", "ab", "bucket", "experiment", "arm")
LEAST_R, LEAST_ETA2, LEAST_V, LEAST_V_BOOLEAN, MOST_P = 0.25, 0.05, 0.15, 0.1, 0.05
SKEW_LOG, SKEW_ROOT = 1.0, (0.7, 1.5)
MOST = {"transform": 8, "rate": 5, "pair": 6, "window": 8, "entity": 6, "levels": 5, "segment": 4, "tokens": 50, "screen": 10, "counts": 16, "treatments": 4, "ab": 6, "did": 4}
#: Kinds of topics, from which their identifiers are made, and names of features.
KINDS = {
    "spread": "distribution_fe", "course": "trend_fe", "rate": "rate", "pair": "num_interactions", "calendar": "calendar_breakdown", "gaps": "interarrival", "window": "ts_windows", "entity": "entity_ts_windows", "segment": "cat_ts_windows", "text": "text_fe", "numbers": "corr_num_num", "groups": "assoc_num_cat", "booleans": "assoc_bool_bool", "categories": "assoc_cat_cat", "arms": "assoc_num_bool", "ranking": "ranking_fe", "shares": "part_to_whole_fe", "counts": "count_table", "ab": "causal_ab_fe", "did": "causal_did_fe",
}
NAMES = {
    "log": "log1p({})", "root": "sqrt({})", "z": "zscore_wins({})", "rate": "rate_{}_over_{}", "diff": "delta_{}_minus_{}", "prod": "prod_{}_times_{}", "lag": "lag1_{}", "lead": "lead1_{}", "roll": "roll7_mean_{}", "ewm": "ewm_a0.2_{}", "acorr": "acorr_{}", "lag_by": "lag1_{}_by_{}", "roll3_by": "roll3_mean_{}_by_{}", "sum3_by": "roll3_sum_{}_by_{}", "gap_by": "prev_event_dt_by_{}", "roll7_by": "roll7_mean_{}_by_{}", "len": "len({})", "words": "words({})", "tokens": "tokens_topk({})", "unique": "unique_token_ratio({})", "ab": "ab_diff_{}_by_{}", "did": "did_{}_by_{}_over_{}",
}
CALENDAR = ("dow", "hour", "week", "month", "quarter", "year", "is_weekend")
SPREAD, BARS = ["histogram", "boxplot", "violin"], ["ordered_bar", "lollipop"]


def _plan(*specs: tuple) -> list[dict]:
    return [{"name": n, "kind": k, "base_cols": list(cols), "params": p} for n, k, cols, p in specs]


def engineered(df: DataFrame, r: Roles, seen: Seen) -> list[Topic]:
    return [*_transforms(r, seen), *_pairs(r, seen), *_calendar(r, seen), *_windows(r, seen), *_texts(df, r, seen), *_screens(r, seen), *_counts(r, seen), *_causal(r, seen)]


def _known(r: Roles, seen: Seen) -> list[str]:
    return [m for m in r.metrics if seen.moments[m]["n"] >= LEAST_VALUES]


def _share(seen: Seen, m: str) -> float:
    return seen.moments[m]["n"] / max(1, seen.rows)


def _transforms(r: Roles, seen: Seen) -> list[Topic]:
    out = []
    for m in _known(r, seen)[: MOST["transform"]]:
        skew = seen.moments[m]["skew"] or 0.0
        specs = [(NAMES["log"].format(m), "transform", [m], {"op": "log1p"})] * (skew > SKEW_LOG) + [(NAMES["root"].format(m), "transform", [m], {"op": "sqrt"})] * (SKEW_ROOT[0] < skew <= SKEW_ROOT[1])
        plan = _plan(*specs, (NAMES["z"].format(m), "transform", [m], {"op": "zscore_wins", "limits": [0.01, 0.99]}))
        n = seen.moments[m]["n"]
        out.append(Topic("distribution", [m], [], abs(skew), {"feature_plan": plan, "skew": skew}, {}, n, _share(seen, m), 0.06, SPREAD, kind=KINDS["spread"]))
        if r.time:
            out.append(Topic("trend", [m], [], abs(skew), {"feature_plan": plan}, {}, seen.rows, _share(seen, m), 0.12, CHARTS["trend"], time=r.time, kind=KINDS["course"]))
    return out


def _pairs(r: Roles, seen: Seen) -> list[Topic]:
    out, family, known = [], "trend" if r.time else "distribution", _known(r, seen)
    charts = ["line", "column"] if r.time else ["histogram", "boxplot"]
    named = lambda p: [m for m in known if re.search(p, m, re.I)][: MOST["rate"]]
    for a in named(NUMERATORS):
        for b in named(DENOMINATORS):
            if a != b and (seen.moments[b]["positive"] or 0) >= 0.5 and (seen.moments[a]["mean"] or 0) <= (seen.moments[b]["mean"] or 0):
                plan = _plan((NAMES["rate"].format(a, b), "binary_op", [a, b], {"op": "ratio"}))
                out.append(Topic(family, [a], [b], 0.0, {"feature_plan": plan}, {}, min(seen.moments[x]["n"] for x in (a, b)), min(_share(seen, a), _share(seen, b)), 0.08, charts, time=r.time, kind=KINDS["rate"]))
    for a, b in combinations([m for m in r.metrics[: MOST["pair"]] if m in known], 2):
        plan = _plan((NAMES["diff"].format(a, b), "binary_op", [a, b], {"op": "diff"}), (NAMES["prod"].format(a, b), "binary_op", [a, b], {"op": "prod"}))
        out.append(Topic(family, [a, b], [], 0.0, {"feature_plan": plan}, {}, seen.rows, min(_share(seen, a), _share(seen, b)), 0.07, charts[:2] if r.time else charts[:1], time=r.time, kind=KINDS["pair"]))
    return out


def _calendar(r: Roles, seen: Seen) -> list[Topic]:
    if not r.time:
        return []
    parts = _plan(*[({"dow": "day_of_week", "hour": "hour_of_day"}.get(part, part), "time_derive", [r.time], {"part": part}) for part in CALENDAR])
    gaps = _plan(("interarrival_seconds", "time_delta", [r.time], {"by": None}), *([("interarrival_seconds_by_id", "time_delta", [r.time], {"by": [r.entity]})] if r.entity else []))
    return [
        Topic("ranking", [r.time], [], 0.0, {"feature_plan": parts}, {}, seen.rows, 1.0, 0.04, BARS, time=r.time, kind=KINDS["calendar"]),
        Topic("distribution", [r.time, *([r.entity] if r.entity else [])], [], 0.0, {"feature_plan": gaps}, {}, seen.rows, 1.0, 0.06, SPREAD, time=r.time, kind=KINDS["gaps"]),
    ]


def _windows(r: Roles, seen: Seen) -> list[Topic]:
    if not r.time:
        return []
    out, known = [], _known(r, seen)

    def window(name: str, m: str, by: list[str] | None, op: str, **p) -> tuple:
        return (name, "window", [m], {"op": op, "by": by, **p})

    for m in known[: MOST["window"]]:
        slope, n = seen.slopes.get(m, (0.0, 0))
        plan = _plan(
            window(NAMES["lag"].format(m), m, None, "lag"), window(NAMES["lead"].format(m), m, None, "lead"), window(NAMES["roll"].format(m), m, None, "rolling_mean", window=7, min_periods=3),
            window(NAMES["ewm"].format(m), m, None, "ewm_mean", alpha=0.2), window(NAMES["acorr"].format(m), m, None, "autocorr_lags", lags=[7, 30]),
        )
        out.append(Topic("trend", [m], [], abs(slope), {"feature_plan": plan, "slope_norm": slope}, {}, n, _share(seen, m), 0.10, CHARTS["trend"], time=r.time, kind=KINDS["window"]))
    for m in known[: MOST["entity"]] if r.entity else []:
        by, e = [r.entity], r.entity
        plan = _plan(
            window(NAMES["lag_by"].format(m, e), m, by, "lag"), window(NAMES["roll3_by"].format(m, e), m, by, "rolling_mean", window=3, min_periods=2),
            window(NAMES["sum3_by"].format(m, e), m, by, "rolling_sum", window=3, min_periods=2), (NAMES["gap_by"].format(e), "time_delta", [r.time], {"by": by}),
        )
        out.append(Topic("trend", [m], by, 0.0, {"feature_plan": plan}, {}, seen.rows, _share(seen, m), 0.12, ["line", "column"], time=r.time, kind=KINDS["entity"], readability=0.95))
    for c in r.categories[: MOST["levels"]]:
        levels = [v for v, _, _ in sorted(seen.groups[c], key=lambda g: (-g[1], g[0]))[: MOST["levels"]]]
        for m in known[: MOST["segment"]] if levels else []:
            plan = _plan(window(NAMES["lag_by"].format(m, c), m, [c], "lag", keep_levels=levels), window(NAMES["roll7_by"].format(m, c), m, [c], "rolling_mean", window=7, min_periods=3, keep_levels=levels))
            out.append(Topic("trend", [m], [c], 0.0, {"feature_plan": plan, "levels": levels}, {}, seen.rows, _share(seen, m), 0.10, ["line", "column"], time=r.time, kind=KINDS["segment"], readability=0.95))
    return out


def _texts(df: DataFrame, r: Roles, seen: Seen) -> list[Topic]:
    """Tokens are counted over all rows, in one aggregate a column."""
    out = []
    for c in r.texts:
        tokens = [t.token for t in fe.top_tokens(df, c, MOST["tokens"]).collect()]
        n = df.agg(F.count(f"`{c}`")).first()[0]
        plan = _plan((NAMES["len"].format(c), "transform", [c], {"op": "text_len"}), (NAMES["words"].format(c), "transform", [c], {"op": "text_word_count"}), (NAMES["tokens"].format(c), "text_tokens", [c], {"tokens": tokens}), (NAMES["unique"].format(c), "text_summary", [c], {}))
        out.append(Topic("distribution", [c], [], float(len(tokens)), {"feature_plan": plan}, {}, seen.rows, n / max(1, seen.rows), 0.08, BARS, kind=KINDS["text"], readability=0.95))
    return out


def _screens(r: Roles, seen: Seen) -> list[Topic]:
    out, rows = [], max(1, seen.rows)

    def add(a: str, b: str, effect: float, detail: dict, test: str, p: float, n: int, cost: float, charts: list[str], kind: str) -> None:
        out.append(Topic("correlation", [a, b], [], effect, detail, {"test": test, "p_value": p}, n, n / rows, cost, charts, kind=kind))

    for (a, b), (corr, n) in seen.pairs.items():
        if n >= LEAST_VALUES and corr is not None and corr == corr and (abs(corr) >= LEAST_R or pvalues.pearson_p(corr, n) < MOST_P):
            add(a, b, abs(corr), {"r": corr}, "pearson", pvalues.pearson_p(corr, n), n, 0.14, CHARTS["correlation"], KINDS["numbers"])
    for m in r.metrics[: MOST["window"]]:
        for c in r.categories[: MOST["screen"]]:
            a = anova_of(seen.groups[c], m)
            if a["n"] >= LEAST_VALUES and a["k"] >= 2 and (a["eta2"] >= LEAST_ETA2 or a["p"] < MOST_P):
                add(m, c, a["eta2"], {"eta2": a["eta2"], "f": a["f"]}, "anova", a["p"], a["n"], 0.12, [*BARS, "boxplot"], KINDS["groups"])
    for (a, b), (v, n, dof, chi2) in seen.tables.items():
        both = a in r.booleans
        p = pvalues.chi2_sf(chi2, dof) if dof else 1.0
        if n >= LEAST_VALUES and dof and (v >= (LEAST_V_BOOLEAN if both else LEAST_V) or p < MOST_P):
            add(a, b, v, {"v": v, "chi2": chi2, "dof": dof}, "chi2", p, n, 0.09 if both else 0.10, ["table"], KINDS["booleans" if both else "categories"])
    for m in r.metrics[: MOST["screen"]]:
        for b in r.booleans[: MOST["screen"]]:
            if (p := welch_of(seen.groups[b], m)) < MOST_P:
                add(m, b, 0.0, {}, "welch_normal_approx", p, seen.moments[m]["n"], 0.08, ["boxplot", "violin", "bar"], KINDS["arms"])
    return out


def best_metric(r: Roles, seen: Seen) -> str | None:
    """The metric with most values, of equal ones that which varies most."""
    return max(_known(r, seen), key=lambda m: (_share(seen, m), seen.moments[m]["std"] or 0.0), default=None)


def _counts(r: Roles, seen: Seen) -> list[Topic]:
    out = []
    best = best_metric(r, seen)
    for c in r.categories if best else []:
        names, shares = _shares(seen.groups[c], best)
        n = sum(g[best][0] for _, _, g in seen.groups[c])
        if n:
            cover = n / max(1, seen.rows)
            out.append(Topic("ranking", [c, best], [], sum(s * s for s in shares), {"top": names[:5]}, {}, len(names), cover, 0.04, CHARTS["ranking"], kind=KINDS["ranking"]))
            out.append(Topic("part_to_whole", [c, best], [], max(shares, default=0.0), {"gini": gini_of(shares)}, {}, len(names), cover, 0.04, CHARTS["part_to_whole"], kind=KINDS["shares"]))
    for c in [*r.categories, *r.booleans][: MOST["counts"]]:
        out.append(Topic("ranking", [c, ROW_COUNT], [], 0.0, {"metric": "count"}, {}, seen.rows, 1.0, 0.03, BARS, kind=KINDS["counts"]))
    return out


def _causal(r: Roles, seen: Seen) -> list[Topic]:
    out = []
    for t in [c for c in [*r.categories, *r.booleans] if any(k in c.lower() for k in TREATMENTS)][: MOST["treatments"]]:
        for y in r.metrics[: MOST["ab"]]:
            plan = _plan((NAMES["ab"].format(y, t), "causal_ab", [y, t], {"assess": "diff_in_means"}))
            out.append(Topic("causal", [y], [t], 0.0, {"feature_plan": plan}, {}, seen.rows, _share(seen, y), 0.15, CHARTS["causal"], kind=KINDS["ab"], design="ab", assumptions=["randomization (heuristic)"], readability=0.95))
        for y in r.metrics[: MOST["did"]] if r.time else []:
            plan = _plan((NAMES["did"].format(y, t, r.time), "causal_did", [y, t, r.time], {"pre_post": "median_time_split"}))
            out.append(Topic("causal", [y], [t, r.time], 0.0, {"feature_plan": plan}, {}, seen.rows, _share(seen, y), 0.18, CHARTS["causal"], time=r.time, kind=KINDS["did"], design="did", assumptions=["parallel trends (heuristic)"], readability=0.9))
    return out


def fallback(df: DataFrame, r: Roles, seen: Seen, least: float = 0.3, most: int = 12) -> list[tuple[Topic, float]]:
    """A few topics and their scores where planning finds none: the metrics that vary most, their trends and rankings, one
    distribution and the best pair."""
    useful = sorted((m for m in r.metrics if _share(seen, m) >= least), key=lambda m: (-_share(seen, m) * (seen.moments[m]["std"] or 0.0), m))
    out = [(Topic("kpi", [m], [], 0.0, {}, {}, seen.rows, _share(seen, m), 0.0, CHARTS["kpi"]), 1.0) for m in useful[:3]]
    if r.time:
        out += [(Topic("trend", [m], [], 0.0, {}, {}, seen.rows, _share(seen, m), 0.0, ["line", "column"], time=r.time), 0.95) for m in useful[:3]]
    cats = sorted((c for c in r.categories if 3 <= len(seen.groups[c]) <= 50), key=lambda c: (len(seen.groups[c]), c))
    out += [(Topic("ranking", [c, useful[0]], [], 0.0, {}, {}, seen.rows, _share(seen, useful[0]), 0.0, ["ordered_bar", "ordered_column"]), 0.9) for c in cats[:3] if useful]
    if useful:
        out.append((Topic("distribution", [useful[0]], [], 0.0, {}, {}, seen.rows, _share(seen, useful[0]), 0.0, ["histogram", "boxplot"]), 0.88))
    pairs = {p: abs(c) for p, (c, n) in seen.pairs.items() if c is not None and c == c and n >= 3 and set(p) <= set(useful[:10])}
    if pairs:
        best = max(pairs, key=lambda p: (pairs[p], p))
        out.append((Topic("correlation", list(best), [], pairs[best], {}, {}, seen.rows, min(_share(seen, m) for m in best), 0.0, CHARTS["correlation"]), 0.87 + min(0.1, pairs[best])))
    return sorted(out, key=lambda x: -x[1])[:most]

