"""Cleaning by rules: when (a condition on a column's facts) then (an action on the column), by priority.

Columns don't read each other, so all go through the rules in step: a rule's actions change its columns, and only
what a later condition reads of a changed column is computed again, for all such columns in one aggregate, and only
where what the condition says of name, role and type holds. Jobs grow with the waves of changes, not with rules times
columns. Long chains of changes are cut by writing the frame to the shared folder.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators import frames, profile, roles
from ..sources.staged import stage
from . import actions, dsl
from .pack import DEFAULT_ENV, RULES, Rule, shipped

#: What rules call the roles.
ROLE_NAMES = {"bool": "boolean", "date": "time", "datetime": "time", "int": "numeric", "float": "numeric", "number": "numeric"}
#: Facts that take a job to know, and those of them that take a shuffle.
DISTINCT = {"nunique", "unique_ratio", "cardinality"}
MEASURED = {*profile.FACT_COLUMNS, *DISTINCT, "non_null_ratio", "bool_token_ratio", "numeric_like_ratio", "datetime_parse_ratio"}
#: Changes after which the plan is cut.
LONGEST_CHAIN = 3


@dataclass(frozen=True)
class Hit:
    rule: str
    column: str
    note: str


@dataclass(frozen=True)
class Failure:
    """What a rule could not do: column is None where the rule itself can't be read."""

    rule: str
    column: str | None
    error: str


@dataclass
class Cleaned:
    df: DataFrame
    hits: list[Hit]
    dropped: list[str]
    failures: list[Failure] = field(default_factory=list)
    before: dict = field(default_factory=dict)
    after: dict = field(default_factory=dict)
    schema: roles.Schema | None = None

    def report(self) -> dict:
        """Shape, columns, missing shares, rules, roles' confidence before and after, and a line of narrative."""
        added = [c for c in self.after if c not in self.before]
        changed = {c: [self.before[c]["type"], f["type"]] for c, f in self.after.items() if c in self.before and self.before[c]["type"] != f["type"]}
        missing = {c: {"before": self.before[c]["missing_pct"], "after": f["missing_pct"], "delta": f["missing_pct"] - self.before[c]["missing_pct"]} for c, f in self.after.items() if c in self.before}
        per: dict[str, list[str]] = {}
        for h in self.hits:
            per.setdefault(h.column, [])
            if h.note not in per[h.column]:
                per[h.column].append(h.note)
        sure = lambda facts: sum(roles.guess_role(c, f)[1] for c, f in facts.items()) / len(facts) if facts else 0.0
        return {
            "columns": {"added": added, "dropped": self.dropped, "type_changes": changed}, "missing_pct": missing,
            "failures": [vars(f) for f in self.failures],
            "rules": {"hits": [vars(h) for h in self.hits], "per_column_actions": per, "total_applications": len(self.hits)},
            "rescore": {"before": sure(self.before), "after": sure(self.after)},
            "narrative": f"{len(self.hits)} applications of rules on {len(per)} columns; {len(self.dropped)} dropped, {len(changed)} changed their type.",
        }


def _read(rules: list[Rule], fact: str) -> bool:
    """Whether a rule's condition names a fact."""
    return any(fact in r.when for r in rules)


def apply_rules(df: DataFrame, rules: list[Rule], role_of: dict[str, str], env: dict | None = None, order_by: list[str] | None = None, found: dict | None = None) -> Cleaned:
    """df after the rules, highest priority first. A rule that doesn't parse, or whose action fails, changes nothing and
    is among the failures. Outliers that are only counted are counted at a rule's end, for all its columns at once."""
    env = DEFAULT_ENV | (env or {})
    ready, failures = [], []
    for rule in sorted(rules, key=lambda r: (-r.priority, r.id)):
        try:
            node = dsl.parse(rule.when)
            parts = node.args if node.kind == "and" else (node,)
            first = [p for p in parts if not dsl.identifiers(p) & MEASURED]
            ready.append((rule, dsl.compile_facts(rule.when), first, dsl.identifiers(node) & MEASURED, actions.parse_then(rule.then)))
        except ValueError as e:
            failures.append(Failure(rule.id, None, str(e)))
    known = dict(found or profile.facts(df, quartiles=_read(rules, "iqr")))
    before, hits, dropped, chain = dict(known), [], [], 0
    stale: dict[str, set] = {}  # facts of changed columns that aren't known any more
    has_time = bool(order_by) and sum(ROLE_NAMES.get(r, r) == "time" for r in role_of.values()) == 1

    def context(col: str) -> dict:
        role = role_of.get(col, "text")
        return env | known[col] | {"name": col, "role": ROLE_NAMES.get(role, role), "has_time_index": has_time}

    for rule, holds, first, reads, call in ready:
        may = [c for c in df.columns if c in known and all(dsl.holds(p, context(c)) for p in first)]
        if again := sorted(c for c in may if reads & stale.get(c, set())):
            if chain >= LONGEST_CHAIN:
                df, chain = stage(df), 0
            for c, f in profile.facts(df, again, distinct=bool(reads & DISTINCT), quartiles="iqr" in reads, only=reads).items():
                known[c] = known[c] | f
                stale[c] -= reads | {"missing_pct", "non_null_ratio"} | (DISTINCT if reads & DISTINCT else set())
        counted: list[tuple[str, dict]] = []
        for col in may:
            if not holds(context(col)):
                continue
            bound = call.bound(env)
            if call.name == "outliers" and (bound.get("handle") or "flag") == "flag" and known[col]["type"] in ("int", "float"):
                counted.append((col, bound))
                continue
            try:
                made, note = actions.ACTIONS[call.name].run(df, col, bound, order_by or [])
                made.schema  # an action that doesn't fit the column fails here
            except Exception as e:
                failures.append(Failure(rule.id, col, f"{type(e).__name__}: {str(e).splitlines()[0][:200]}"))
                continue
            hits.append(Hit(rule.id, col, note or call.name))
            if call.name == "drop_column":
                dropped.append(col)
                known.pop(col)
            elif made is not df:
                stale[col] = set(MEASURED)
                known[col] = known[col] | {"type": profile.tag(made.schema[col].dataType)}
                chain += 1
            df = made
        if counted:
            if chain >= LONGEST_CHAIN:
                df, chain = stage(df), 0
            p = counted[0][1]
            many = frames.outlier_counts(df, [c for c, _ in counted], p.get("method") or "zscore", p.get("zscore_threshold") or 3.0, p.get("iqr_multiplier") or 1.5)
            hits += [Hit(rule.id, c, f"outliers(n={many[c]})") for c, _ in counted]
    return Cleaned(df, hits, dropped, failures, before)


def clean(df: DataFrame, rules: list[Rule] | None = None, schema: roles.Schema | None = None, env: dict | None = None, order_by: list[str] | None = None, compat: bool = False, cfg: roles.RoleConfig = roles.RoleConfig()) -> Cleaned:
    """Profile, rules, profile: the cleaned frame with its report's facts. What was changed is staged once, before the
    second profile reads it. compat: the rules as they take effect where only the shipped facts are known."""
    rules = (shipped() if compat else RULES) if rules is None else rules
    found = profile.facts(df, quartiles=_read(rules, "iqr"))
    schema = schema or roles.propose(df, cfg=cfg, found=found)
    made = apply_rules(df, rules, schema.roles(), env, order_by, found)
    if made.df is not df:
        made.df = stage(made.df)
    made.after = profile.facts(made.df, quartiles=False)
    made.schema = roles.propose(made.df, schema.dataset, found=made.after)
    return made


def follow_ups(schema: roles.Schema, facts: dict[str, dict], least: float = 0.9) -> dict[str, list[str]]:
    """Actions to try on columns whose role isn't sure, or that miss values."""
    out: dict[str, list[str]] = {}
    for c in schema.columns:
        f, todo = facts[c.name], []
        text = f["type"] == "string"
        if text and (f["numeric_like_ratio"] or 0) >= 0.6 and c.role in ("numeric", "id", "text", "categorical"):
            todo.append("coerce_numeric()")
        if text and ((f["datetime_parse_ratio"] or 0) >= 0.5 or c.role == "time"):
            todo.append("parse_datetime_robust()")
        if text and f["bool_token_ratio"] >= 0.57:
            todo.append("coerce_bool()")
        if f["missing_pct"] > 0:
            todo.append({"numeric": "impute('median')", "time": "impute_dt('median')"}.get(c.role, "impute_value('Unknown')") if c.role != "time" or not text else "parse_datetime_robust()")
        if text and c.role in ("text", "categorical"):
            todo.append("text_normalize()")
        if c.confidence < least or f["missing_pct"] > 0:
            out[c.name] = list(dict.fromkeys(todo))
    return {k: v for k, v in out.items() if v}


#: Actions that suggestions may turn into rules.
SAFE = frozenset(
    "normalize_null_tokens text_normalize regex_replace coerce_bool coerce_numeric impute impute_value cast_category rare_cats parse_datetime parse_datetime_robust "
    "parse_epoch dt_round outliers standardize_units zero_as_missing".split()
)


def rules_from(suggested: dict[str, list[str]], priority: int = 900) -> list[Rule]:
    """A rule for each suggestion that is safe to follow."""
    safe = lambda then: then.split("(", 1)[0].strip() in SAFE
    return [Rule(f"suggested:{c}:{i}", priority, f"name == {json.dumps(c)}", then) for c, todo in suggested.items() for i, then in enumerate(todo) if safe(then)]


#: What each decided role is cleaned by, in order; the last entry is what fills gaps.
_TIDY = ["normalize_null_tokens()", "text_normalize(strip=true, lower=false)"]
FOR_ROLE = {
    "boolean": (["normalize_null_tokens()", "text_normalize(strip=true, lower=true)", "coerce_bool()"], "impute_value(false)"), "numeric": ([*_TIDY, "coerce_numeric()"], "impute()"),
    "categorical": ([*_TIDY, "cast_category()", "rare_cats(0.01, 'Other')"], None), "time": (["parse_datetime_robust()"], None), "text": (_TIDY, None),
}


def rules_for(schema: roles.Schema) -> list[Rule]:
    """Rules for roles that rows decided: text is made what it says it is, gaps are filled where the role has a filling."""
    out = []
    for c in schema.columns:
        todo, filling = FOR_ROLE[c.role]
        steps = [] if c.role in ("numeric", "time") and c.dtype != "string" else list(todo)
        steps += [filling] if filling and c.hints.get("missing_pct", 0) > 0 else []
        steps += ["outliers()"] if c.role == "numeric" else []
        out += [Rule(f"decided:{c.name}:{i}", 990 - i, f"name == {json.dumps(c.name)}", then) for i, then in enumerate(steps)]
    return out


def score(schema_confidence: float, role_confidence: float, missing_rate: float) -> float:
    """How good a cleaned frame is: mostly its schema's sureness, less what is missing."""
    return 0.7 * schema_confidence + 0.3 * role_confidence - 0.25 * missing_rate


def missing_rate(facts: dict[str, dict]) -> float:
    return sum(f["missing_pct"] for f in facts.values()) / max(1, len(facts))


def improvement(before: dict[str, dict], after: dict[str, dict]) -> float:
    """A stand-in for confidence where no roles are known: what is missing less than before, and columns that got a type."""
    typed = lambda facts: sum(f["type"] != "string" for f in facts.values()) / max(1, len(facts))
    return (missing_rate(before) - missing_rate(after)) + 0.5 * (typed(after) - typed(before))


def improve(df: DataFrame, dataset: str = "", most: int = 3, enough: float = 0.9, order_by: list[str] | None = None, rules: list[Rule] | None = None, env: dict | None = None, least: float = 0.0, cfg: roles.RoleConfig = roles.RoleConfig()) -> tuple[Cleaned, list[dict]]:
    """Passes of rules and of what they suggest, while the score (sureness less missing) grows by more than least; the best,
    and a log."""
    best, top, log, extra = None, -1.0, [], []
    for i in range(most):
        made = clean(df, (RULES if rules is None else rules) + extra, env=env, order_by=order_by, cfg=cfg)
        missing = missing_rate(made.after)
        now = score(made.schema.confidence, made.schema.confidence, missing)
        log.append({"iter": i, "schema_conf": made.schema.confidence, "missing_rate": missing, "score": now, "width": len(made.df.columns), "rules_applied": len(made.hits)})
        if best is not None and now <= top + least:
            break
        best, top = made, now
        more = rules_from(follow_ups(made.schema, made.after))
        if made.schema.confidence >= enough or not more or more == extra:
            break
        extra = more
    return best, log


def recheck(df: DataFrame, schema: roles.Schema, rules: list[Rule] | None = None, env: dict | None = None, **kw) -> Cleaned:
    """One pass that drops no column and no value."""
    env = DEFAULT_ENV | (env or {})
    gentle = env | {"handle": "flag", "cleaning": {**env["cleaning"], "outliers": {**env["cleaning"].get("outliers", {}), "handle": "flag"}}}
    return clean(df, [r for r in (RULES if rules is None else rules) if not r.then.startswith("drop_column")], schema, gentle, **kw)
