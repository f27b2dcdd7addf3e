"""Settings from a TOML file: rules and the environment they read, thresholds of roles and topics, where tables lie.

Nothing in a file is dropped: what this module doesn't know by name is still there under its section, and rules may refer
to it by its dotted name.
"""

from __future__ import annotations

import copy
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

from ..operators import roles, topics
from . import pack

#: Keys of a file, and the names that settings have here.
ROLE_KEYS = {
    "name_weight": "name_weight", "value_weight": "value_weight", "bool_token_min_ratio": "booleans", "date_parse_min_ratio": "dates", "unique_id_ratio": "unique_id",
    "categorical_max_unique_ratio": "categorical", "text_min_avg_len": "text_length", "min_non_null_ratio": "least_coverage", "penalize_bool_for_many_tokens": "many_tokens",
}
THRESHOLD_KEYS = {"min_corr_for_scatter": "correlation", "min_slope_for_trend": "slope", "max_charts_total": "most"}
WEIGHT_KEYS = {"suitability": "suitability", "effect_size": "effect", "signal_quality": "signal", "readability": "readability", "complexity": "complexity"}
LOOP = {"min_schema_confidence": 0.75, "min_role_confidence": 0.75, "max_iter": 5, "min_improvement": 0.0, "sample_rows": 200_000}


class ConfigError(ValueError):
    """The file is no TOML, or a value has no sense."""


@dataclass
class Config:
    raw: dict = field(default_factory=dict)
    rules: list[pack.Rule] = field(default_factory=lambda: list(pack.RULES))
    env: dict = field(default_factory=lambda: copy.deepcopy(pack.DEFAULT_ENV))
    roles: roles.RoleConfig = field(default_factory=roles.RoleConfig)
    thresholds: topics.Thresholds = field(default_factory=topics.Thresholds)
    weights: topics.Weights = field(default_factory=topics.Weights)
    loop: dict = field(default_factory=lambda: dict(LOOP))
    raw_root: str = "data/raw"
    gold_root: str = "data/gold"
    object_store: dict = field(default_factory=dict)
    charts_per_topic: int = 6
    seed: int = 42

    def section(self, path: str) -> Any:
        """What the file has under a dotted name, or None."""
        at: Any = self.raw
        for part in path.split("."):
            at = at.get(part) if isinstance(at, dict) else None
        return at


def _merged(base: dict, over: dict) -> dict:
    """base with what over has, section by section."""
    out = dict(base)
    for k, v in over.items():
        out[k] = _merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def parse(text: str) -> dict:
    """TOML, whatever an editor or a paste put around it: byte order marks, spaces of no width, code fences."""
    edge = "\ufeff\u200b\u200c\u200d\u2060 \t\r\n"
    text = text.strip(edge)
    if text.startswith("```"):
        first, _, rest = text.partition("\n")
        text = rest if first.strip("`").strip().isalpha() or not first.strip("`").strip() else text.strip("`")
        text = text.rstrip(edge).removesuffix("```")
    try:
        return tomllib.loads(text.strip(edge))
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"not TOML: {e}; it begins {text[:80]!r}") from e


def _taken(kind: type, values: dict, keys: dict) -> Any:
    known = {f.name for f in fields(kind)}
    return kind(**{keys[k]: v for k, v in values.items() if k in keys and keys[k] in known})


def of(raw: dict, base: Path | None = None) -> Config:
    """Settings of a parsed file. Relative roots are under base."""
    get = lambda path: Config(raw).section(path) or {}
    cleaning = get("cleaning")
    rules = cleaning.get("rules")
    known = {k: v for k, v in cleaning.items() if k != "rules"}
    env = _merged(copy.deepcopy(pack.DEFAULT_ENV), {"cleaning": known, "profiling": get("profiling"), "nlp": get("nlp")})
    impute, outliers = known.get("impute", {}), known.get("outliers", {})
    env |= {k: impute[k] for k in ("numeric_default", "categorical_default", "text_default") if k in impute}
    env |= {k: outliers[k] for k in ("zscore_threshold", "iqr_multiplier", "handle", "winsor_limits") if k in outliers}
    if (how := outliers.get("method", outliers.get("detect"))) is not None:
        env["detect"] = how
    if formats := get("profiling.roles").get("datetime_formats"):
        env["datetime_formats"] = formats
    if "cat_cardinality_max" in known.get("columns", {}):
        env["cat_cardinality_max"] = known["columns"]["cat_cardinality_max"]
    try:
        made = None if rules is None else [pack.Rule(str(r["id"]), int(r.get("priority", 50)), str(r["when"]), str(r["then"])) for r in rules]
    except (KeyError, TypeError, ValueError) as e:
        raise ConfigError(f"a rule needs id, when and then: {e}") from e
    at = lambda p: p if base is None or "://" in p or Path(p).is_absolute() else str(base / p)
    local = get("storage.local")
    out = Config(raw, list(pack.RULES) if made is None else made, env, _taken(roles.RoleConfig, {**get("nlp"), **get("nlp.role_scoring")}, ROLE_KEYS))
    out.thresholds, out.weights = _taken(topics.Thresholds, get("topics.thresholds"), THRESHOLD_KEYS), _taken(topics.Weights, get("weights"), WEIGHT_KEYS)
    out.loop |= {k: v for k, v in get("nlp").items() if k in LOOP}
    out.raw_root, out.gold_root = at(local.get("raw_root", out.raw_root)), at(local.get("gold_root", out.gold_root))
    out.object_store, out.charts_per_topic, out.seed = get("storage.minio"), int(get("charts").get("max_charts_per_topic", 6)), int(get("env").get("seed", 42))
    return out


def load(path: str) -> Config:
    """Settings of a file. Relative roots are under its folder, or under that folder's parent if it is called config."""
    where = Path(path).resolve()
    base = where.parent.parent if where.parent.name.lower() == "config" else where.parent
    return of(parse(where.read_text(encoding="utf-8", errors="replace")), base)
