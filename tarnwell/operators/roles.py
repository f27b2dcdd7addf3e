"""Roles of columns, from their names and facts."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import profile

#: Names that tell a role, and marks of units.
NAMES = (("time", r"(date|time|timestamp|dt|ts)\b"), ("id", r"(?:^|[_-])(id|uuid|guid|key)\b"), ("bool", r"^(is_|has_|flag_)"), ("geo", r"(lat|lng|lon|long|latitude|longitude)\b"))
UNITS = (("currency", r"^\s*\$"), ("percent", r"(?i)(%|\b(percent|pct)\b)"), ("magnitude_k", r"(?i)\b(k|thousand)\b"), ("magnitude_m", r"(?i)\b(million|mm)\b"))


@dataclass(frozen=True)
class RoleConfig:
    least_coverage: float = 0.10
    unique_id: float = 0.95
    dates: float = 0.60
    numbers: float = 0.80
    booleans: float = 0.57
    categorical: float = 0.02
    most_categories: int = 200
    text_length: float = 8
    name_weight: float = 0.45
    value_weight: float = 0.55
    many_tokens: float = 0.08


def name_role(name: str) -> str | None:
    return next((role for role, p in NAMES if re.search(p, name, re.I)), None)


def value_role(f: dict, cfg: RoleConfig = RoleConfig()) -> str:
    if f["non_null_ratio"] < cfg.least_coverage:
        return "text"
    if f["type"] == "datetime":
        return "time"
    if f["type"] == "bool":
        return "bool"
    unique = f["nunique"] / max(1, f["rows"])
    if f["type"] in ("int", "float"):
        return "id" if f["rows"] and unique >= cfg.unique_id else "numeric"
    if (f["datetime_parse_ratio"] or 0) >= cfg.dates:
        return "time"
    if (f["numeric_like_ratio"] or 0) >= cfg.numbers:
        return "id" if unique >= cfg.unique_id else "numeric"
    if f["bool_token_ratio"] >= cfg.booleans:
        return "bool"
    if unique <= cfg.categorical and f["nunique"] <= cfg.most_categories:
        return "categorical"
    if (f["avg_len"] or 0) >= cfg.text_length:
        return "text"
    return "categorical" if f["nunique"] <= cfg.most_categories else "text"


def guess_role(name: str, f: dict, cfg: RoleConfig = RoleConfig()) -> tuple[str, float]:
    """(role, confidence): the value's role; where values are merely unique, the name's; agreement makes sure."""
    by_name, by_value = name_role(name), value_role(f, cfg)
    if by_name and by_name == by_value:
        role, sure = by_name, min(0.99, 0.90 + 0.10 * max(cfg.name_weight, cfg.value_weight))
    elif by_name:
        role, sure = by_name if by_value == "id" else by_value, 0.75 + (0.05 if cfg.value_weight >= cfg.name_weight else 0.0)
    else:
        role, sure = by_value, 0.70 + 0.10 * cfg.value_weight
    sure *= 0.25 + 0.75 * f["non_null_ratio"]
    if role == "bool" and f["nunique"] > 4:
        sure -= cfg.many_tokens
    return role, max(0.0, min(0.99, sure))


@dataclass
class ColumnSchema:
    name: str
    dtype: str
    role: str
    confidence: float
    hints: dict = field(default_factory=dict)


@dataclass
class Schema:
    dataset: str
    columns: list[ColumnSchema]

    @property
    def confidence(self) -> float:
        return sum(c.confidence for c in self.columns) / len(self.columns) if self.columns else 0.0

    def roles(self) -> dict[str, str]:
        return {c.name: c.role for c in self.columns}

    def to_json(self) -> str:
        return json.dumps({"dataset": self.dataset, "columns": [asdict(c) for c in self.columns]})

    @staticmethod
    def from_json(text: str) -> Schema:
        raw = json.loads(text)
        return Schema(raw["dataset"], [ColumnSchema(**c) for c in raw["columns"]])

    def to_toml(self) -> str:
        out = [f"dataset = {json.dumps(self.dataset)}", f"schema_confidence = {self.confidence:.4f}", ""]
        for c in self.columns:
            out += ["[[columns]]", f"name = {json.dumps(c.name)}", f"dtype = {json.dumps(c.dtype)}", f"role = {json.dumps(c.role)}", f"role_confidence = {c.confidence:.4f}", f"hints = {json.dumps(json.dumps(c.hints))}", ""]
        return "\n".join(out)

    @staticmethod
    def from_toml(text: str) -> Schema:
        """Reads what to_toml writes, and files whose role_confidence is a table of role and confidence."""
        import tomllib

        raw = tomllib.loads(text)
        columns = raw.get("columns", [])
        columns = [{"name": k, **v} for k, v in columns.items()] if isinstance(columns, dict) else columns
        made = []
        for c in columns:
            sure = c.get("role_confidence", 0.0)
            role, sure = (sure.get("role", ""), sure.get("confidence", 0.0)) if isinstance(sure, dict) else (c.get("role", ""), sure)
            hints = c.get("hints", {})
            made.append(ColumnSchema(c["name"], c.get("dtype", "string"), c.get("role") or role, float(sure), json.loads(hints) if isinstance(hints, str) else hints))
        return Schema(raw.get("dataset") or raw.get("dataset_slug", ""), made)


def unit_hint(df: DataFrame, col: str, order_by: list[str] | None = None) -> str | None:
    """The first unit that over a fifth of the first 50 values carry; without an order, of 50 values by their hash, so that
    the same rows are read however the files lie."""
    c = F.col(col).cast("string")
    keys = [F.col(k) for k in order_by] if order_by else [F.xxhash64("v"), F.col("v")]
    some = df.where(c.isNotNull()).withColumn("v", c).orderBy(*keys).limit(50)
    row = some.agg(*[F.avg(F.rlike("v", F.lit(p)).cast("double")).alias(n) for n, p in UNITS]).first()
    return next((n for n, _ in UNITS if (row[n] or 0) > 0.2), None)


def canonical_categories(df: DataFrame, col: str, most: int = 200) -> DataFrame:
    """value, canonical of a column with at most that many values; none for more."""
    c = F.col(col).cast("string")
    values = df.where(c.isNotNull()).select(c.alias("value")).distinct().limit(most + 1)
    plain = F.lower(F.regexp_replace(F.trim("value"), r"\s+", " "))
    return values.select("value", plain.alias("canonical")) if values.count() <= most else values.select("value", plain.alias("canonical")).where("false")


def propose(df: DataFrame, dataset: str = "", cfg: RoleConfig = RoleConfig(), found: dict | None = None) -> Schema:
    found = found or profile.facts(df)
    return Schema(dataset, [ColumnSchema(c, f["type"], *guess_role(c, f, cfg)) for c, f in found.items()])


#: Names of identifiers, and limits of what types alone say.
DERIVED_ID, DERIVED_UNIQUE, DERIVED_TEXT = r"(?:^id$|_id$|^id_|id\b|uuid|guid|key|hash|checksum|^row_?id$|^entity_?id$)", 0.98, 16


def derived(df: DataFrame, dataset: str = "", found: dict | None = None) -> Schema:
    """A schema from types and names alone, for a table that has none."""
    out = []
    for c, f in (found or profile.facts(df, quartiles=False)).items():
        if f["type"] == "datetime":
            role, sure = "time", 0.8
        elif f["type"] == "bool":
            role, sure = "boolean", 0.6
        elif re.search(DERIVED_ID, c, re.I):
            role, sure = "id", 0.9
        elif f["type"] in ("int", "float"):
            role, sure = ("id", 0.8) if f["unique_ratio"] > DERIVED_UNIQUE else ("numeric", 0.7)
        else:
            role, sure = ("text", 0.6) if (f["avg_len"] or 0) >= DERIVED_TEXT else ("categorical", 0.55)
        out.append(ColumnSchema(c, f["type"], role, sure))
    return Schema(dataset, out)


@dataclass(frozen=True)
class TypeLimits:
    """Shares of values from which rows alone say what a column is."""

    booleans: float = 0.90
    numbers: float = 0.98
    letters: float = 0.02
    most_categories: int = 200
    unique: float = 0.30
    length: int = 50
    numbers_of_categories: float = 0.10
    booleans_of_categories: float = 0.70


#: How sure a decision by rows is.
DECIDED = {"numeric": 0.98, "boolean": 0.95, "time": 0.90, "categorical": 0.88, "text": 0.70}


def decided(df: DataFrame, limits: TypeLimits = TypeLimits(), found: dict | None = None) -> Schema:
    """Roles by what the rows hold, names aside: types as they are; text that spells booleans, or numbers without letters;
    short values of bounded number; or else text. Hints name the evidence."""
    found = found or profile.facts(df, quartiles=False)
    texts = [c for c, f in found.items() if f["type"] == "string"]
    letters = [F.avg(F.when(F.col(f"`{c}`").isNotNull(), F.col(f"`{c}`").rlike(r"\p{L}").cast("double"))).alias(f"a{i}") for i, c in enumerate(texts)]
    row = df.agg(*letters).first() if texts else None
    out = []
    for c, f in found.items():
        hints = {"missing_pct": f["missing_pct"], "nunique": f["nunique"], "unique_ratio": f["unique_ratio"]}
        if f["type"] != "string":
            role = {"datetime": "time", "bool": "boolean"}.get(f["type"], "numeric")
        else:
            alpha = row[f"a{texts.index(c)}"] or 0.0
            hints |= {"avg_len": f["avg_len"], "bool_like": f["bool_token_ratio"], "num_like": f["numeric_like_ratio"], "alpha": alpha}
            if f["bool_token_ratio"] >= limits.booleans:
                role = "boolean"
            elif (f["numeric_like_ratio"] or 0) >= limits.numbers and alpha <= limits.letters:
                role = "numeric"
            elif (
                2 <= f["nunique"] <= limits.most_categories and f["unique_ratio"] <= limits.unique and (f["avg_len"] or 0) <= limits.length
                and (f["numeric_like_ratio"] or 0) <= limits.numbers_of_categories and f["bool_token_ratio"] <= limits.booleans_of_categories
            ):
                role = "categorical"
            else:
                role = "text"
        out.append(ColumnSchema(c, f["type"], role, DECIDED[role], hints))
    return Schema("", out)


def role_table(df: DataFrame) -> DataFrame:
    made = propose(df)
    return df.sparkSession.createDataFrame([(c.name, c.dtype, c.role, round(c.confidence, 6)) for c in made.columns], "column_name string, type string, role string, confidence double")
