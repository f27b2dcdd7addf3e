"""The action language: name(arg, ..., key=value) with literals, lists and names that are looked up later; and the
actions themselves, each of which changes one column of a frame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import frames, profile
from . import dsl


class ActionError(ValueError):
    """The text is no action."""


@dataclass(frozen=True)
class Name:
    """A dotted name, looked up in the policy's environment when the action runs."""

    path: str


@dataclass(frozen=True)
class Call:
    name: str
    params: dict

    def bound(self, env: dict) -> dict:
        look = lambda v: dsl._lookup(env, v.path) if isinstance(v, Name) else [look(x) for x in v] if isinstance(v, list) else v
        return {k: look(v) for k, v in self.params.items()}


class _Reader(dsl._Parser):
    def call(self) -> tuple[str, list, dict]:
        token = self.tokens[0] if self.tokens else None
        if not token or token.kind not in ("id",):
            raise ActionError("an action's name expected")
        self.at = 1
        args, named = [], {}
        if self.take("("):
            while not self.take(")"):
                if args or named:
                    self.need(",")
                ahead = self.tokens[self.at : self.at + 2]
                if len(ahead) == 2 and ahead[0].kind == "id" and ahead[1].text == "=" and ahead[1].kind == "op":
                    self.at += 2
                    named[ahead[0].text] = self.value()
                elif named:
                    raise ActionError("positional after named")
                else:
                    args.append(self.value())
        if self.at < len(self.tokens):
            raise ActionError(f"unexpected {self.tokens[self.at].text!r}")
        return token.text, args, named

    def value(self) -> Any:
        if self.take("["):
            out = []
            while not self.take("]"):
                if out:
                    self.need(",")
                out.append(self.value())
            return out
        if self.at >= len(self.tokens):
            raise ActionError("unexpected end")
        token = self.tokens[self.at]
        self.at += 1
        if token.kind in ("num", "str"):
            return token.value
        if token.kind == "kw" and token.text in ("true", "false", "null", "none"):
            return {"true": True, "false": False}.get(token.text)
        if token.kind == "id":
            return Name(token.text)
        raise ActionError(f"unexpected {token.text!r}")


@dataclass(frozen=True)
class Action:
    """run(df, column, params, order_by) -> (df, note); a note of None says nothing of interest."""

    name: str
    params: tuple
    run: Callable


ACTIONS: dict[str, Action] = {}


def action(name: str, *params: str):
    def add(fn):
        ACTIONS[name] = Action(name, params, fn)
        return fn

    return add


def parse_then(text: str) -> Call:
    """A call of a known action, its positional arguments under their names; a bare name is a call without arguments."""
    try:
        name, args, named = _Reader(text).call()
    except dsl.ConditionError as e:
        raise ActionError(str(e)) from e
    if name not in ACTIONS:
        raise ActionError(f"unknown action: {name}")
    known = ACTIONS[name].params
    if len(args) > len(known):
        raise ActionError(f"{name} takes {len(known)} arguments at most")
    if unknown := set(named) - set(known):
        raise ActionError(f"{name} has no {sorted(unknown)}")
    return Call(name, dict(zip(known, args, strict=False)) | named)


def _value_action(name: str, fn: Callable, *params: str) -> None:
    """An action that needs nothing but the value."""

    def run(df: DataFrame, col: str, p: dict, order_by: list[str]):
        x = F.col(f"`{col}`")
        if name in ON_TEXT and profile.tag(df.schema[col].dataType) == "float":  # a whole number has no point in its text
            x = F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("long").cast("string")).otherwise(x.cast("string"))
        return df.withColumn(col, fn(x, **{k: v for k, v in p.items() if v is not None})), None

    ACTIONS[name] = Action(name, params, run)


#: Actions on the digits and letters of a value.
ON_TEXT = frozenset(("keep_alnum", "extract_digits", "zero_pad", "regex_replace", "cast_string", "map_synonyms", "cat_map_synonyms"))
_as_tuple = lambda v: tuple(v or ())
_value_action("coerce_numeric", lambda c, unit_hint=None: V.coerce_numeric(c), "unit_hint")  # units stand in the values; a hint adds nothing
_value_action("parse_datetime", lambda c, formats=(): V.parse_datetime(c, tuple(java_format(f) for f in formats) or V.DATE_FORMATS), "formats")
_value_action("parse_datetime_robust", lambda c, utc=False, dayfirst=False, yearfirst=False: V.parse_robust(c, dayfirst, yearfirst, utc), "utc", "dayfirst", "yearfirst")
_value_action("extract_datetime", lambda c, patterns=None, case_insensitive=True: V.extract_datetime(c, tuple(V.java_pattern(p, "I" if case_insensitive else "") for p in patterns) if patterns else V.DATE_PATTERNS), "patterns", "case_insensitive")
for _how in ("round", "floor", "ceil"):
    _value_action(f"dt_{_how}", lambda c, freq="D", how=_how: V.dt_step(c, freq, how), "freq")
_value_action("dt_part", lambda c, part="date": V.dt_part(c, part), "part")
_value_action("cast_string", lambda c: c.cast("string"))
_value_action("text_normalize", lambda c, strip=True, lower=False: V.text_normalize(c, strip, lower), "strip", "lower")
_value_action("normalize_null_tokens", lambda c, null_tokens=(), case_insensitive=True, apply_text_normalize_first=True: V.null_tokens(c, _as_tuple(null_tokens), case_insensitive, apply_text_normalize_first), "null_tokens", "case_insensitive", "apply_text_normalize_first")
_value_action(
    "coerce_bool",
    lambda c, true_tokens=V.TRUE_TOKENS, false_tokens=V.FALSE_TOKENS, numeric_truthy=False, true_regex=(), false_regex=(), case_insensitive=True, strip=True, strip_edges=True, drop_invalid=True: V.coerce_bool(
        c, tuple(true_tokens), tuple(false_tokens), numeric_truthy, tuple(true_regex), tuple(false_regex), case_insensitive, strip, strip_edges, drop_invalid),
    "true_tokens", "false_tokens", "numeric_truthy", "true_regex", "false_regex", "case_insensitive", "strip", "strip_edges", "drop_invalid",
)
_value_action("map_synonyms", lambda c, mapping=None, case_insensitive=True: V.map_synonyms(c, mapping or {}, case_insensitive), "mapping", "case_insensitive")
ACTIONS["cat_map_synonyms"] = ACTIONS["map_synonyms"]
_value_action("cat_fuzzy_map", lambda c, candidates=(), max_distance=2, max_rel_distance=0.25: V.nearest(c, list(candidates), max_distance, max_rel_distance), "candidates", "max_distance", "max_rel_distance")
_value_action("regex_replace", lambda c, pattern=None, repl="", flags="", count=0, literal=False: V.regex_replace(c, pattern, repl, flags, count, literal) if pattern else c, "pattern", "repl", "flags", "count", "literal")
_value_action("extract_digits", lambda c, ascii_only=False, keep_sign=False, keep_decimal=False, empty_to_na=True: V.extract_digits(c, ascii_only, keep_sign, keep_decimal, empty_to_na), "ascii_only", "keep_sign", "keep_decimal", "empty_to_na")
_value_action("zero_pad", lambda c, width=0, fillchar="0", numeric_only=False: V.zero_pad(c, width, fillchar, numeric_only), "width", "fillchar", "numeric_only")
_value_action("keep_alnum", lambda c, allowed="", collapse=True, case=None, empty_to_na=False: V.keep_alnum(c, allowed, collapse, case, empty_to_na), "allowed", "collapse", "case", "empty_to_na")
_value_action("clip", lambda c, lo=None, hi=None: V.clip(V.coerce_robust(c), lo, hi), "lo", "hi")
_value_action("enforce_sign", lambda c, sign="nonnegative": V.enforce_sign(c, sign), "sign")
_value_action("zero_as_missing", lambda c, eps=0.0: V.zero_as_missing(V.coerce_robust(c), eps), "eps")


def java_format(fmt: str) -> str:
    """A strptime format as the JVM writes it; lenient in the number of digits of days and months."""
    known = {"Y": "yyyy", "m": "M", "d": "d", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "b": "MMM", "B": "MMMM", "f": "SSSSSS", "p": "a", "I": "hh", "z": "XX"}
    out, k = "", 0
    while k < len(fmt):
        if fmt[k] == "%" and k + 1 < len(fmt):
            out, k = out + known.get(fmt[k + 1], ""), k + 2
        else:
            out, k = out + (f"'{fmt[k]}'" if fmt[k].isalpha() else fmt[k]), k + 1
    return out


@action("parse_epoch", "unit")
def _(df, col, p, order_by):
    return frames.parse_epochs(df, col, p.get("unit")), None


@action("cast_category", "max_card")
def _(df, col, p, order_by):
    if (most := p.get("max_card")) is not None and {r.c: r.n for r in profile.distinct_counts(df.select(col), [col]).collect()}.get(0, 0) > most:
        return df, None
    return df.withMetadata(col, {"categorical": True}), "cast_category"


@action("impute", "method", "time_aware", "limit_direction")
def _(df, col, p, order_by):
    method = p.get("method") or "median"
    time = order_by[0] if p.get("time_aware") and order_by else None
    return frames.impute(df, col, method, order_by, time_col=time, limit_direction=p.get("limit_direction") or "both"), f"impute({method})"


@action("impute_value", "value", "force")
def _(df, col, p, order_by):
    value, kind = p.get("value"), df.schema[col].dataType
    if value is None and not p.get("force"):
        return df, None
    if profile.tag(kind) in ("int", "float") and dsl.to_number(value) is None:
        raise ActionError(f"{value!r} is no number")
    if profile.tag(kind) == "datetime" and not isinstance(value, str):
        raise ActionError(f"{value!r} is no date")
    return df.withColumn(col, F.coalesce(F.col(f"`{col}`"), F.lit("" if value is None else value).cast(kind))), f"impute_value({value})"


@action("materialize_missing_as", "value")
def _(df, col, p, order_by):
    return ACTIONS["impute_value"].run(df, col, {**p, "force": True}, order_by)


@action("impute_dt", "method", "value")
def _(df, col, p, order_by):
    method = p.get("method") or "median"
    if method == "constant":
        made = F.coalesce(F.col(col), F.lit(p.get("value") or "1970-01-01").cast("timestamp_ntz"))
        return df.withColumn(col, made), "impute_dt(constant)"
    if method == "median":
        us = df.withColumn("_us", F.unix_micros(F.col(col).cast("timestamp")))
        filled = frames.impute(us, "_us", "median")
        return filled.withColumn(col, F.timestamp_micros(F.floor("_us")).cast("timestamp_ntz")).drop("_us"), "impute_dt(median)"
    return (frames.impute(df, col, method, order_by), f"impute_dt({method})") if method in ("ffill", "bfill", "mode") else (df, None)


@action("outliers", "method", "zscore_threshold", "iqr_multiplier", "handle", "winsor_limits")
def _(df, col, p, order_by):
    handle = p.get("handle") or "flag"
    kind, z, k, limits = p.get("method") or "zscore", p.get("zscore_threshold") or 3.0, p.get("iqr_multiplier") or 1.5, tuple(p.get("winsor_limits") or (0.01, 0.99))
    if handle == "flag":
        return df, f"outliers(n={frames.outlier_counts(df, [col], kind, z, k)[col]})"
    return frames.outliers(df, col, kind, z, k, handle, limits), f"outliers({handle})"


@action("standardize_units", "unit_hint", "percent_target")
def _(df, col, p, order_by):
    if p.get("unit_hint") != "percent":
        return df, None
    return frames.standardize_percent(df.withColumn(col, V.coerce_robust(F.col(col))), col, p.get("percent_target") or "fraction"), "standardize_units(percent)"


@action("drop_column")
def _(df, col, p, order_by):
    return df.drop(col), "drop_column"


@action("rare_cats", "min_freq", "other_label")
def _(df, col, p, order_by):
    return frames.rare_categories(df, col, p.get("min_freq") or 0.01, p.get("other_label") or "Other"), None


ACTIONS["cat_consolidate"] = ACTIONS["rare_cats"]


@action("cat_extract_key", "patterns", "capture_group", "default", "mode", "candidates", "max_distance")
def _(df, col, p, order_by):
    """By patterns, or with mode anchor by the column's most frequent words; then by candidates near to it."""
    if p.get("mode") == "anchor":
        df, _ = ACTIONS["cat_extract_anchor"].run(df, col, {}, order_by)
    else:
        df = df.withColumn(col, V.extract_key(F.col(f"`{col}`"), list(p.get("patterns") or ()), p.get("capture_group") or 0, p.get("default")))
    if near := list(p.get("candidates") or ()):
        df = df.withColumn(col, V.nearest(F.col(f"`{col}`"), near, p.get("max_distance") or 2))
    return df, None


@action("cat_extract_anchor", "allow_digits", "min_token_len", "stopwords")
def _(df, col, p, order_by):
    return frames.extract_anchor(df, col, p.get("min_token_len") or 3, bool(p.get("allow_digits")), frozenset(p.get("stopwords") or frames.STOPWORDS)), None
