"""The rules that come with the engine, built from what they are about: which columns, which evidence, which action.

Rules stand in the order in which they run; priorities follow from it. Thresholds and defaults are names that are looked
up in the environment, so a configuration changes them without touching a rule.
"""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Rule:
    id: str
    priority: int
    when: str
    then: str


#: Defaults and thresholds that rules refer to.
DEFAULT_ENV: dict = {
    "numeric_default": "median", "categorical_default": "Unknown", "text_default": "N/A", "cat_cardinality_max": 200,
    "datetime_formats": ["%Y-%m-%d", "%m/%d/%Y", "%Y/%m/%d", "%Y-%m-%d %H:%M:%S", "%m/%d/%Y %H:%M:%S"],
    "detect": "zscore", "zscore_threshold": 3.0, "iqr_multiplier": 1.5, "handle": "flag", "winsor_limits": [0.01, 0.99],
    "cleaning": {
        "normalize": {"strip_text": True, "lowercase_text": False}, "normalize_null_tokens": {"null_tokens": ["missing", "n\\a"]},
        "impute": {"boolean_default": False, "text_default": "N/A"}, "outliers": {"handle": "flag"}, "datetime": {"utc": True, "dayfirst": False, "yearfirst": False},
        "regex": {"unicode_minus": "[\u2212\u2013\u2014]", "thousands_between_digits": r"(?<=\d)[,_](?=\d{3}\b)"}, "ids": {"zip_width": 5, "pad_fillchar": "0", "pad_numeric_only": True},
        "columns": {"droppable_exact": [], "always_keep": [], "cat_cardinality_max": 200, "drop_missing_pct": 0.9, "min_unique_ratio": 0.001},
    },
}

#: Parts of names that say what a column holds, and shares and lengths from which values do.
NAMED = {"postal": ("zip", "postal"), "phone": ("phone", "tel"), "money": ("amount", "price", "cost"), "percent": ("percent", "pct"), "share": ("ratio", "rate", "percent", "pct")}
TEMPORARY, CHECKSUMS = ("_tmp", "_raw", "tmp_", "raw_"), ("_hash", "_checksum")
BOOLEAN_SHARE, NUMBER_SHARE, NUMBER_UNIQUE, NUMBER_LENGTH, TEXT_LENGTH, RARE = 0.57, 0.92, 0.5, 18, 8, 0.01


def any_of(test: str, parts: tuple) -> str:
    return "(" + " or ".join(f"{test}(name, '{p}')" for p in parts) + ")"


def where(*evidence: str, roles: str = "", types: str = "", named: str = "") -> str:
    """A condition: a role of roles, a type of types, a name of that kind, and all evidence. A role with a minus in front
    is ruled out."""
    listed = lambda words: "[" + ", ".join(f"'{w.lstrip('-')}'" for w in words) + "]"
    parts = []
    if roles:
        words = roles.split()
        parts.append(f"role {'notin' if words[0].startswith('-') else 'in'} {listed(words)}")
    if types:
        parts.append(f"type in {listed(types.split())}")
    if named:
        parts.append(any_of("icontains", NAMED[named]))
    return " and ".join([*parts, *evidence])


NO_WORD = "normalize_null_tokens(null_tokens=cleaning.normalize_null_tokens.null_tokens, case_insensitive=true{})"
GAPS = "missing_pct > 0"
REPLACE = "regex_replace(pattern=cleaning.regex.{}, repl='{}')"
OUTLIERS = "outliers(method=detect, zscore_threshold=zscore_threshold, iqr_multiplier=iqr_multiplier, handle={}, winsor_limits=winsor_limits)"
DROP = "drop_column()"
SPARED = "name notin cleaning.columns.always_keep"
NUMBERS, WORDS = "int float", "categorical text"

#: (id, condition, action). Rules that share a priority are one group of the list, run in order of their ids.
_STEPS: list[list[tuple[str, str, str]]] = [
    # words that mean nothing, booleans, numbers in text
    [("words-for-missing", where(types="string"), NO_WORD.format(""))],
    [("booleans-by-spelling", f"bool_token_ratio >= {BOOLEAN_SHARE} or istartswith(name, 'bool_')", "coerce_bool()")],
    [("minus-signs", where(roles="numeric id", types="string"), REPLACE.format("unicode_minus", "-"))],
    [("booleans-fill", where(GAPS, roles="boolean"), "impute_value(cleaning.impute.boolean_default)")],
    [("thousands-separators", where(roles="numeric id", types="string"), REPLACE.format("thousands_between_digits", ""))],
    [("numbers-by-role", where("not icontains(name, 'id')", roles="numeric", types="string"), "coerce_numeric()")],
    [("numbers-by-content", where(
        f"not istartswith(name, 'cat_') and numeric_like_ratio >= {NUMBER_SHARE} and coalesce(unique_ratio, 0) <= {NUMBER_UNIQUE} and coalesce(avg_len, 0) <= {NUMBER_LENGTH}",
        roles="-time -categorical -text", types="string"), "coerce_numeric()")],
    # text and categories
    [("text-tidy", where(roles="text", types="string"), "text_normalize(strip=cleaning.normalize.strip_text, lower=cleaning.normalize.lowercase_text)")],
    [("words-lower", where("avg_len >= 1", roles=WORDS, types="string"), "text_normalize(strip=true, lower=true)")],
    [("words-for-missing-again", where(roles=WORDS, types="string"), NO_WORD.format(""))],
    [("categories-rare", where(f"unique_ratio > 0 and unique_ratio <= {NUMBER_UNIQUE}", roles="categorical"), f"rare_cats({RARE}, 'Other')")],
    [("categories-mark", where("cardinality <= cleaning.columns.cat_cardinality_max", roles="categorical"), "cast_category(cat_cardinality_max)"),
     ("dates-by-format", where(roles="time", types="string"), "parse_datetime(datetime_formats)")],
    # dates, gaps
    [("dates-any", where(roles="time", types="string"), "parse_datetime_robust(utc=cleaning.datetime.utc, dayfirst=cleaning.datetime.dayfirst, yearfirst=cleaning.datetime.yearfirst)"),
     ("gaps-numeric-by-time", where(GAPS, "has_time_index", roles="numeric", types=NUMBERS), "impute('interpolate')")],
    [("dates-from-epochs", where(roles="time", types=NUMBERS), "parse_epoch()"),
     ("gaps-categories", where(GAPS, roles="categorical", types="string"), "impute_value(categorical_default)"),
     ("gaps-numeric", where(GAPS, roles="numeric", types=NUMBERS), "impute(numeric_default)")],
    [("gaps-text", where(GAPS, f"avg_len >= {TEXT_LENGTH}", roles="text", types="string"), "impute_value(text_default)")],
    [("gaps-dates-forward", where(GAPS, "has_time_index", roles="time", types="datetime"), "impute_dt('ffill')")],
    [("extremes-count", where(roles="numeric", types=NUMBERS), OUTLIERS.format("handle")),
     ("gaps-dates-middle", where(GAPS, "not has_time_index", roles="time", types="datetime"), "impute_dt('median')")],
    [("extremes-winsorize", where("std > 0 and cleaning.outliers.handle == 'winsorize'", roles="numeric"), OUTLIERS.format("'winsorize'"))],
    # units, identifiers, signs
    [("percents-by-name", where(roles="numeric", named="percent"), "standardize_units('percent')")],
    [("percents-by-range", where("min >= 0 and max > 1 and max <= 100", roles="numeric", named="share"), "standardize_units('percent')")],
    [("phones", where(types="string", named="phone"), "extract_digits()"), ("postal-letters", where(named="postal"), "keep_alnum()")],
    [("postal-width", where(named="postal"), "zero_pad(cleaning.ids.zip_width, cleaning.ids.pad_fillchar, numeric_only=cleaning.ids.pad_numeric_only)")],
    [("money-not-negative", where(roles="numeric", named="money"), "enforce_sign('nonnegative')")],
    [("shares-of-zero", where(roles="numeric", named="share"), "zero_as_missing()")],
    [("dates-to-days", where(roles="time", types="datetime"), "dt_round('D')")],
    # what is still missing
    [("gaps-as-words", where(GAPS, types="string"), "materialize_missing_as(cleaning.impute.text_default)")],
    [("gaps-last", where(GAPS, types="string"), "impute_value(text_default)")],
    [("words-for-missing-last", where(types="string"), NO_WORD.format(", apply_text_normalize_first=false"))],
    # columns that say nothing
    [("drop-listed", "name in cleaning.columns.droppable_exact", DROP), ("drop-temporary", any_of("istartswith", TEMPORARY), DROP), ("drop-checksums", any_of("icontains", CHECKSUMS), DROP)],
    [("drop-constant", where("nunique <= 1 and unique_ratio <= cleaning.columns.min_unique_ratio", SPARED, roles="-boolean -text -categorical -id -time"), DROP),
     ("drop-sparse", where("missing_pct >= cleaning.columns.drop_missing_pct", SPARED, roles="-boolean -text -categorical -id -time"), DROP)],
]

RULES: list[Rule] = [Rule(id_, 10 * (len(_STEPS) - k), when, then) for k, group in enumerate(_STEPS) for id_, when, then in group]

#: Rules that change nothing where lengths, formats and facts that they read are not configured, as in the shipped setting.
WITHOUT_EFFECT = frozenset(
    "minus-signs booleans-fill thousands-separators categories-mark dates-any gaps-numeric-by-time gaps-dates-forward extremes-winsorize percents-by-range gaps-last drop-listed".split()
)


def shipped() -> list[Rule]:
    """The rules as they take effect in the shipped setting: without those that find nothing to go by, postal codes
    trimmed and not padded, and other words in lower case after words for missing are looked for."""
    out = []
    for r in RULES:
        if r.id in WITHOUT_EFFECT:
            continue
        if r.id == "postal-width":
            r = replace(r, then="zero_pad(0)")
        out.append(r)
        if r.id in ("words-for-missing", "words-for-missing-again"):
            out.append(Rule(f"{r.id}:lower", r.priority - 1, r.when, "text_normalize(strip=true, lower=true)"))
    return out
