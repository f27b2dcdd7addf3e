"""Column transforms that need nothing but the value: Column in, Column out, null stays null unless said."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .unicode import let, nfkc

#: Text that means missing, and spellings of booleans.
NULL_TOKENS = ("", "-", "\u2014", "\u2013", "n/a", "na", "none", "null", "nil", "nan", "nat", "<na>", "<null>", "<none>")
TRUE_TOKENS = ("true", "t", "y", "yes", "1", "on", "enabled", "active")
FALSE_TOKENS = ("false", "f", "n", "no", "0", "off", "disabled", "inactive")
#: Typographic characters and their plain forms.
FANCY, PLAIN = "\u2018\u2019\u201c\u201d\u2013\u2014\u2212\u00a0", "''\"\"--- "
CURRENCY = "$\u20ac\u00a3\u00a5\u20a9\u20b9"
#: Date patterns in order of preference.
MONTHS = "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
DATE_PATTERNS = (
    r"\b\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}(?::\d{2})?(?:\.\d{1,9})?(?:Z|[+-]\d{2}:?\d{2})?)?\b",
    r"\b\d{4}[/-]\d{1,2}[/-]\d{1,2}\b",
    r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
    rf"(?i)\b{MONTHS}\s+\d{{1,2}},?\s+\d{{2,4}}\b",
    rf"(?i)\b\d{{1,2}}\s+{MONTHS}\s+\d{{2,4}}\b",
    r"\b\d{8}\b",
)
DATE_FORMATS = ("yyyy-MM-dd", "M/d/yyyy", "yyyy/M/d", "yyyy-MM-dd HH:mm:ss", "M/d/yyyy HH:mm:ss")
ROBUST_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/M/d HH:mm:ss", "yyyy/M/d", "yyyy-M-d", "yyyyMMdd",
    "MMMM d yyyy", "MMM d yyyy", "d MMMM yyyy", "d MMM yyyy",
)


def number(text: Column) -> Column:
    """A plain decimal or exponent literal as a double, or null."""
    plain = F.trim(text)
    return F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain.try_cast("double"))


def _text(c: Column) -> Column:
    return c.cast("string")


def squeeze(c: Column) -> Column:
    """White space at the ends off, inside to one space."""
    return F.regexp_replace(F.regexp_replace(_text(c), r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def coerce_numeric(c: Column) -> Column:
    """Amounts: (3.5) is negative; currency signs, thousands separators and underscores go; percents are hundredths;
    k, thousand, m, mm and million scale. What is left and no number is null."""
    tidy = F.lower(F.regexp_replace(F.translate(F.trim(_text(c)), "\u2212\u2013", "--"), r"(?U)\s+", " "))
    # "(3.5)" is written "-3.5", and a sign, a currency sign and a sign again are taken off with the sign kept in front
    signed = F.regexp_replace(F.regexp_replace(tidy, r"^\((.*)\)$", "-$1"), rf"^([+-]?)\s*[{CURRENCY}]?\s*([+-]?)\s*[{CURRENCY}]?\s*", "$1$2")

    def scaled(s: Column) -> Column:
        body = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"^[+-]*", ""), r"\s*(%|percent|pct|(?<=[\d.\s])(k|thousand|mm?|million))$", ""), "[,_ ]", "")
        scale = F.when(s.rlike("(%|percent|pct)$"), 0.01).when(s.rlike(r"[\d.\s](k|thousand)$"), 1e3).when(s.rlike(r"[\d.\s](mm?|million)$"), 1e6).otherwise(1.0)
        sign = F.when(F.regexp_extract(s, "^([+-]*)", 1).isin("-", "+-", "-+"), -1.0).otherwise(1.0)
        return number(body) * scale * sign

    return let(signed, scaled)


def coerce_robust(c: Column) -> Column:
    """Numbers in messy text: brackets are negative, a percent sign anywhere is hundredths, and where the whole is no
    number the first numeric token is."""
    tidy = F.regexp_replace(F.translate(F.trim(_text(c)), "\u2212\u2013\u00a0", "-- "), r"\s+", " ")

    def read(s: Column) -> Column:
        plain = F.trim(F.regexp_replace(F.regexp_replace(s, r"^\((.*)\)$", "$1"), f"[{CURRENCY},_%]", ""))
        value = let(plain, lambda p: F.coalesce(number(p), number(F.regexp_extract(p, r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", 0))))
        return value * F.when(s.contains("%"), 0.01).otherwise(1.0) * F.when(s.rlike(r"^\(.*\)$"), -1.0).otherwise(1.0)

    return let(tidy, read)


def clip(x: Column, lo: float | None = None, hi: float | None = None) -> Column:
    out = x
    if lo is not None:
        out = F.when(out < lo, F.lit(float(lo))).otherwise(out)
    if hi is not None:
        out = F.when(out > hi, F.lit(float(hi))).otherwise(out)
    return out


def enforce_sign(c: Column, sign: str) -> Column:
    """positive and negative: others are null; nonnegative: negatives are 0. An amount in brackets, as accounts write
    it, counts by its size for the first and third, and as null for negative."""
    bracketed = F.trim(_text(c)).rlike(r"^\(.*\)$")
    return let(coerce_robust(c), lambda x: _signed(x, bracketed, sign))


def _signed(x: Column, bracketed: Column, sign: str) -> Column:
    size = F.when(bracketed, F.abs(x)).otherwise(x)
    if sign == "positive":
        return F.when(size > 0, size)
    if sign == "nonnegative":
        return F.when(size < 0, F.lit(0.0)).otherwise(size)
    if sign == "negative":
        return F.when(~bracketed & (x < 0), x)
    return x


def zero_as_missing(x: Column, eps: float = 0.0) -> Column:
    return F.when(F.abs(x) <= eps, F.lit(None).cast("double")).otherwise(x.cast("double"))


def percent_to_fraction(x: Column) -> Column:
    return F.when(x > 1, x / 100).otherwise(x)


def fraction_to_percent(x: Column) -> Column:
    return F.when(x <= 1, x * 100).otherwise(x)


def text_normalize(c: Column, strip: bool = True, lower: bool = False) -> Column:
    """Compatibility forms composed, typographic quotes, dashes and spaces to plain ones, control characters off, white
    space to single spaces; an empty text is null."""
    s = F.translate(nfkc(c), FANCY, PLAIN)
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)\s+", " "), r"[\x00-\x1f\x7f]", "")
    s = F.trim(s) if strip else s
    s = F.lower(s) if lower else s
    return F.nullif(s, F.lit(""))


def null_tokens(c: Column, tokens: tuple = (), ignore_case: bool = True, tidy: bool = True) -> Column:
    """Null where the value means missing; other values keep their case, tidied first or as they are."""
    known = sorted({*NULL_TOKENS, *(t.lower() if ignore_case else t for t in tokens)})
    return let(text_normalize(c) if tidy else _text(c), lambda s: F.when(~(F.lower(s) if ignore_case else s).isin(known), s))


def coerce_bool(c: Column, true: tuple = TRUE_TOKENS, false: tuple = FALSE_TOKENS, truthy: bool = False, true_patterns: tuple = (), false_patterns: tuple = (), ignore_case: bool = True, strip: bool = True, edges: bool = True, drop: bool = True) -> Column:
    """Spellings of booleans, or what whole patterns match, edges that are no words ignored; 0 and 1, or with truthy any
    number, too. What stands for both is null. Without drop, what stands for neither stays, and the column is text."""
    either = lambda w, words, patterns: F.coalesce(w.isin(*words), F.lit(False)) | _matches_any(w, patterns, ignore_case)

    def read(s: Column) -> Column:
        x = number(s)
        word = F.when(x.isNotNull(), s).otherwise(F.regexp_replace(s, r"(?U)^\W+|\W+$", "")) if edges else s
        by_number = F.when(x != 0, F.lit(True)).when(x == 0, F.lit(False)) if truthy else F.when(x == 1, F.lit(True)).when(x == 0, F.lit(False))

        def both(w: Column) -> Column:
            yes, no = either(w, true, true_patterns), either(w, false, false_patterns)
            return F.when(w.isNotNull(), F.when(yes & no, F.lit(None).cast("boolean")).when(yes, F.lit(True)).when(no, F.lit(False)).otherwise(by_number))

        return let(word, both)

    text = F.trim(_text(c)) if strip else _text(c)
    made = let(F.lower(text) if ignore_case else text, read)
    return made if drop else F.coalesce(made.cast("string"), _text(c))


def _matches_any(w: Column, patterns: tuple, ignore_case: bool) -> Column:
    whole = [java_pattern(p, "I" if ignore_case else "") for p in patterns]
    return F.coalesce(*[F.when(w.rlike(f"^(?:{p})$"), F.lit(True)) for p in whole], F.lit(False))


def java_replacement(text: str) -> str:
    """Back references as the regular expressions of the JVM write them."""
    return re.sub(r"\\g<(\w+)>", lambda m: f"${{{m[1]}}}" if not m[1].isdigit() else f"${m[1]}", re.sub(r"\\(\d+)", r"$\1", text.replace("$", r"\$")))


def java_pattern(pattern: str, flags: str = "", literal: bool = False) -> str:
    pattern = re.escape(pattern) if literal else pattern.replace("(?P<", "(?<").replace("(?P=", "\\k<")
    known = {"I": "i", "M": "m", "S": "s", "X": "x"}
    on = "".join(known[f] for f in flags.upper() if f in known)
    return (f"(?{on})" if on else "") + pattern


def regex_replace(c: Column, pattern: str | list[str], replacement: str = "", flags: str = "", count: int = 0, literal: bool = False) -> Column:
    """All matches, pattern after pattern; with count 1 the first match that isn't at the start, or else the first."""
    s = _text(c)
    for p in [pattern] if isinstance(pattern, str) else pattern:
        p, r = java_pattern(p, flags, literal), java_replacement(replacement)
        if count != 1:
            s = F.regexp_replace(s, p, r)
            continue
        places = F.regexp_instr(F.substr(s, F.lit(2)), F.lit(p))
        at = F.when(places > 0, places + 1).otherwise(F.lit(1))
        head, tail = F.substr(s, F.lit(1), at - 1), F.substr(s, at)
        hit = F.regexp_extract(tail, f"({p.replace('(', '(?:') if '(?' not in p else p})", 0)
        changed = F.concat(head, F.regexp_replace(hit, p, r), F.substr(tail, F.length(hit) + 1))
        s = F.when(s.rlike(p), changed).otherwise(s)
    return s


def extract_digits(c: Column, ascii_only: bool = False, keep_sign: bool = False, keep_decimal: bool = False, empty_to_null: bool = True) -> Column:
    kind = "0-9" if ascii_only else r"\p{Nd}"
    s = F.trim(_text(c))
    digits = F.regexp_replace(s, f"[^{kind}{'.' if keep_decimal else ''}]", "")
    if keep_sign:
        digits = F.when(digits != "", F.concat(F.regexp_extract(s, r"^([+-]?)", 1), digits)).otherwise(digits)
    return F.when(digits != "", digits) if empty_to_null else digits


def zero_pad(c: Column, width: int, fill: str = "0", numeric_only: bool = False) -> Column:
    """Padded on the left up to width; a sign stays in front, or with numeric_only counts apart from the width and the
    right-most number is all that stays."""
    s = F.trim(_text(c))
    if numeric_only:
        found = F.regexp_extract(s, r"([+-]?\d+)(?!.*\d)", 1)
        sign, body = F.regexp_extract(found, r"^([+-]?)", 1), F.regexp_replace(found, r"^[+-]", "")
        padded = F.concat(F.when(sign == "-", "-").otherwise(""), F.when(F.length(body) < width, F.lpad(body, width, fill)).otherwise(body))
        return F.when(found != "", padded).otherwise(F.when(F.length(s) < width, F.lpad(s, width, fill)).otherwise(s))
    return F.when(F.length(s) < width, F.lpad(s, width, fill)).otherwise(s)


def keep_alnum(c: Column, allowed: str = "", collapse: bool = True, case: str | None = None, empty_to_null: bool = False) -> Column:
    extra = re.escape(allowed).replace("&", r"\&").replace("[", r"\[")
    s = F.regexp_replace(nfkc(c), rf"[^\p{{L}}\p{{N}}{extra}]", "")
    if allowed and collapse:
        for ch in allowed:
            s = F.regexp_replace(s, f"{re.escape(ch)}+", ch.replace("\\", "\\\\").replace("$", "\\$"))
    s = {"upper": F.upper, "lower": F.lower}.get(case or "", lambda x: x)(s)
    return F.when(s != "", s) if empty_to_null else s


# dates


def _ntz(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def format_pattern(fmt: str) -> str:
    """What a text in that format looks like: a failed parse costs an exception, a failed match next to nothing."""
    known = {"yyyy": r"\d{4}", "yy": r"\d{2}", "MMMM": r"\p{L}{3,}", "MMM": r"\p{L}{3,}", "M": r"\d{1,2}", "d": r"\d{1,2}", "MM": r"\d{2}", "dd": r"\d{2}", "HH": r"\d{2}", "hh": r"\d{2}", "mm": r"\d{2}", "ss": r"\d{2}"}
    parts = re.finditer(r"'(?P<q>[^']*)'|(?P<f>([A-Za-z])\3*)|(?P<o>.)", fmt, re.S)
    return "^" + "".join(re.escape(m["q"]) if m["q"] is not None else known.get(m["f"], r"\S+") if m["f"] else re.escape(m["o"]) for m in parts) + "$"


def parse_datetime(c: Column, formats: tuple = DATE_FORMATS) -> Column:
    """By the first format that fits. Where all formats begin with digits, other texts are not held against any."""
    text = F.trim(_text(c))
    if all(re.match("[yMdH]", f) and not f.startswith("MMM") for f in formats):
        text = F.when(text.rlike(r"^\d"), text)
    return let(text, lambda s: F.coalesce(*(_century(_ntz(F.when(s.rlike(format_pattern(f)), F.try_to_timestamp(s, F.lit(f)))), f) for f in formats)))


def _century(ts: Column, fmt: str) -> Column:
    """Years of two digits from 69 on are of the last century."""
    return F.when(F.year(ts) >= 2069, ts - F.expr("INTERVAL 100 YEAR")).otherwise(ts) if "yy" in fmt and "yyyy" not in fmt else ts


def extract_datetime(c: Column, patterns: tuple = DATE_PATTERNS) -> Column:
    """The first date in a text, by the patterns' order; a plausible yyyymmdd gets its dashes."""
    found = []
    for p in patterns:
        hit = F.nullif(F.regexp_extract(_text(c), f"({p.removeprefix('(?i)')})" if not p.startswith("(?i)") else f"(?i)({p.removeprefix('(?i)')})", 1), F.lit(""))
        if p == r"\b\d{8}\b":
            dashed = F.concat_ws("-", F.substring(hit, 1, 4), F.substring(hit, 5, 2), F.substring(hit, 7, 2))
            fits = F.substring(hit, 5, 2).between("01", "12") & F.substring(hit, 7, 2).between("01", "31") & F.substring(hit, 1, 4).between("1900", "2100")
            hit = F.when(hit.isNotNull() & fits, dashed)
        found.append(hit)
    return F.coalesce(*found)


def epoch(x: Column, unit: Column | str) -> Column:
    """Seconds, ms, us or ns since 1970 as a timestamp."""
    unit = F.lit(unit) if isinstance(unit, str) else unit
    x = x.try_cast("double")
    micros = F.when(unit == "s", x * 1e6).when(unit == "ms", x * 1e3).when(unit == "us", x).when(unit == "ns", x / 1e3)
    return _ntz(F.timestamp_micros(micros.try_cast("long")))


def epoch_unit(size: Column) -> Column:
    """The unit of epochs of that size."""
    return F.when(size > 1e16, "ns").when(size > 1e14, "us").when(size > 1e11, "ms").otherwise("s")


def parse_robust(c: Column, dayfirst: bool = False, yearfirst: bool = False, utc: bool = False) -> Column:
    """General formats, then epochs by their number of digits, then a date found in the text. dayfirst and yearfirst say
    how 1/2/03 is read; with utc an offset at the end counts, and the time is that of UTC; without, it is left aside."""
    years = ("yy/M/d", "yy-M-d") if yearfirst else ()
    days = ("d/M/yyyy HH:mm:ss", "d/M/yyyy", "M/d/yyyy HH:mm:ss", "M/d/yyyy") if dayfirst else ("M/d/yyyy HH:mm:ss", "M/d/yyyy", "d/M/yyyy HH:mm:ss", "d/M/yyyy")
    formats = (*ROBUST_FORMATS, *years, *days)
    offset = F.regexp_extract(F.trim(_text(c)), r"\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?([+-]\d{2}):?(\d{2})$", 1)
    minutes = F.regexp_extract(F.trim(_text(c)), r"\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?([+-]\d{2}):?(\d{2})$", 2)
    s = F.regexp_replace(F.trim(_text(c)), r"(?<=\d),?(?=\s+\d{4}$)", "")
    s = F.regexp_replace(F.regexp_replace(s, r"\.\d{1,9}(?=$|Z|[+-])", ""), r"(Z|[+-]\d{2}:?\d{2})$", "")
    digits = F.regexp_extract(F.trim(_text(c)), r"^[+-]?(\d{9,19})$", 1)
    n = F.length(digits)
    unit = F.when(n >= 18, "ns").when(n >= 15, "us").when(n >= 12, "ms").when(n >= 9, "s")
    inside = F.regexp_replace(extract_datetime(c), r",", "")
    tidy = F.regexp_replace(F.regexp_replace(inside, r"\.\d{1,9}", ""), r"(Z|(?<=:\d{2})[+-]\d{2}:?\d{2})$", "")
    found = F.coalesce(parse_datetime(s, formats), epoch(digits, unit), parse_datetime(tidy, formats))
    if not utc:
        return found
    ahead = F.when(offset != "", offset.try_cast("int") * 60 + F.when(offset.startswith("-"), -1).otherwise(1) * minutes.try_cast("int"))
    return F.when(ahead.isNotNull(), _ntz(F.timestamp_micros(F.unix_micros(found.cast("timestamp")) - ahead.cast("long") * 60_000_000))).otherwise(found)


_UNITS = {"d": 86_400_000_000, "h": 3_600_000_000, "min": 60_000_000, "t": 60_000_000, "s": 1_000_000, "ms": 1000, "l": 1000, "us": 1, "w": 604_800_000_000}


def step_micros(freq: str) -> int | None:
    """Microseconds of a frequency such as D, H or 15min; None if it is none."""
    m = re.fullmatch(r"(\d*)\s*([A-Za-z]+)", freq.strip())
    unit = _UNITS.get(m[2].lower()) if m else None
    return int(m[1] or 1) * unit if unit else None


def dt_step(ts: Column, freq: str, how: str = "round") -> Column:
    """Floor, ceil, or round with ties to the even step; a frequency that is none changes nothing."""
    step = step_micros(freq)
    if not step:
        return _ntz(ts)
    us = F.unix_micros(ts.cast("timestamp"))
    low = us - F.pmod(us, F.lit(step))
    rest = us - low
    up = {"floor": F.lit(False), "ceil": rest > 0}.get(how, (rest * 2 > step) | ((rest * 2 == step) & (F.pmod(low / step, F.lit(2)) == 1)))
    return _ntz(F.timestamp_micros(F.when(up, low + step).otherwise(low)))


PARTS = {
    "date": lambda t: _ntz(F.date_trunc("day", t)), "time": lambda t: F.date_format(t, "HH:mm:ss"), "year": F.year, "quarter": F.quarter, "month": F.month, "day": F.dayofmonth,
    "dayofyear": F.dayofyear, "hour": F.hour, "minute": F.minute, "second": F.second, "weekday": F.weekday, "week": F.weekofyear, "iso_year": lambda t: F.extract(F.lit("YEAROFWEEK"), t),
    "iso_week": F.weekofyear, "iso_day": lambda t: F.weekday(t) + 1, "month_name": lambda t: F.date_format(t, "MMMM"), "day_name": lambda t: F.date_format(t, "EEEE"),
}
PART_ALIASES = {"dow": "weekday", "dayofweek": "weekday", "day_of_week": "weekday", "doy": "dayofyear", "isoweek": "iso_week", "isoyear": "iso_year", "weekofyear": "week", "monthname": "month_name", "dayname": "day_name"}


def dt_part(ts: Column, part: str) -> Column:
    made = PARTS.get(PART_ALIASES.get(part, part))
    return made(ts) if made else ts


# categories


def map_synonyms(c: Column, mapping: dict[str, str], ignore_case: bool = True) -> Column:
    s = F.trim(_text(c))
    key = F.lower(s) if ignore_case else s
    pairs = [x for k, v in mapping.items() for x in (F.lit(k.strip().lower() if ignore_case else k.strip()), F.lit(v))]
    return F.coalesce(F.create_map(*pairs)[key], _text(c)) if pairs else _text(c)


def extract_key(c: Column, patterns: list[str], group: int = 0, default: str | None = None) -> Column:
    """What the first pattern that matches finds."""
    found = [F.nullif(F.regexp_extract(_text(c), f"(?i){java_pattern(p)}", group), F.lit("")) for p in patterns]
    return F.coalesce(*found, F.lit(default))


def nearest(c: Column, candidates: list[str], most: int = 2, share: float = 0.25) -> Column:
    """The first candidate of least edit distance, if that is within most or the share of the longer text."""
    clean = lambda x: F.regexp_replace(F.lower(F.trim(x)), r"[^\p{L}\p{N}]", "")
    s = clean(_text(c))
    ways = []
    for k, word in enumerate(candidates):
        other = clean(F.lit(word))
        far = F.levenshtein(s, other)
        room = F.greatest(F.lit(most), F.greatest(F.lit(1), F.bround(F.greatest(F.length(s), F.length(other)) * share).cast("int")))
        ways.append(F.when(far <= room, F.struct(far.alias("d"), F.lit(k).alias("k"), F.lit(word).alias("w"))))
    best = F.array_min(F.array_compact(F.array(*ways)))["w"]
    return F.coalesce(best, _text(c)) if candidates else _text(c)


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer text's length, case and outer space ignored; two empty texts are alike."""
    a, b = F.lower(F.trim(F.coalesce(a, F.lit("")))), F.lower(F.trim(F.coalesce(b, F.lit(""))))
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)
