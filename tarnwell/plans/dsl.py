"""The condition language: one grammar, compiled to a predicate on facts (a driver dict) or to a Column on rows.

cond := or; or := and ("or" and)*; and := not ("and" not)*; not := "not" not | comparison
comparison := primary [is [not] primary | [not] (in | like | ilike) primary | notin primary | [not] between primary and
primary | (== != < <= > >= =~ !~ ~* !~*) primary]; comparisons don't chain, there is no arithmetic. Logic is two-valued:
a comparison with a missing value or of values that don't compare is false, and equality knows null.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import unicode
from ..functions import values as V


class ConditionError(ValueError):
    """The text is no condition."""


# lexer and parser

_TOKEN = re.compile(
    r"""\s+|(?P<num>-?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<str>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<id>[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)|(?P<op>==|!=|<=|>=|=~|!~\*|!~|~\*|<|>|\(|\)|\[|\]|,|=)""",
    re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
KEYWORDS = frozenset("and or not in notin like ilike is between true false null none".split())


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    value: Any = None


def tokenize(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ConditionError(f"unexpected {text[at]!r} at {at}")
        at = m.end()
        if m["num"]:
            out.append(Token("num", m["num"], float(m["num"]) if re.search(r"[.eE]", m["num"]) else int(m["num"])))
        elif m["str"]:
            out.append(Token("str", m["str"], re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1] if e[1] in "\\\"'" else "\\" + e[1]), m["str"][1:-1], flags=re.S)))
        elif m["id"]:
            low = m["id"].lower()
            out.append(Token("kw", low) if low in KEYWORDS else Token("id", m["id"]))
        elif m["op"]:
            out.append(Token("op", m["op"]))
    return out


@dataclass(frozen=True)
class Node:
    kind: str
    args: tuple


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at = tokenize(text), 0

    def peek(self, *texts: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at].kind in ("kw", "op") and self.tokens[self.at].text in texts

    def take(self, *texts: str) -> bool:
        if self.peek(*texts):
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise ConditionError(f"{text!r} expected")

    def whole(self) -> Node:
        made = self.either()
        if self.at < len(self.tokens):
            raise ConditionError(f"unexpected {self.tokens[self.at].text!r}")
        return made

    def either(self) -> Node:
        parts = [self.both()]
        while self.take("or"):
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Node("or", tuple(parts))

    def both(self) -> Node:
        parts = [self.negation()]
        while self.take("and"):
            parts.append(self.negation())
        return parts[0] if len(parts) == 1 else Node("and", tuple(parts))

    def negation(self) -> Node:
        return Node("not", (self.negation(),)) if self.take("not") else self.comparison()

    def comparison(self) -> Node:
        left = self.primary()
        if self.take("is"):
            no = self.take("not")
            return self._no(Node("cmp", ("==", left, self.primary())), no)
        start = self.at
        no = self.take("not")
        if self.take("between"):
            low = self.primary()
            self.need("and")
            return self._no(Node("between", (left, low, self.primary())), no)
        for op in ("in", "like", "ilike"):
            if self.take(op):
                return self._no(Node("cmp", (op, left, self.primary())), no)
        self.at = start
        if self.take("notin"):
            return self._no(Node("cmp", ("in", left, self.primary())), True)
        for op in ("==", "!=", "<=", ">=", "=~", "!~*", "!~", "~*", "<", ">"):
            if self.take(op):
                return Node("cmp", (op, left, self.primary()))
        return left

    @staticmethod
    def _no(node: Node, no: bool) -> Node:
        return Node("not", (node,)) if no else node

    def primary(self) -> Node:
        if self.take("("):
            made = self.either()
            self.need(")")
            return made
        if self.take("["):
            return Node("list", self._items("]"))
        if self.at >= len(self.tokens):
            raise ConditionError("unexpected end")
        token = self.tokens[self.at]
        self.at += 1
        if token.kind in ("num", "str"):
            return Node("lit", (token.value,))
        if token.kind == "kw" and token.text in ("true", "false", "null", "none"):
            return Node("lit", ({"true": True, "false": False}.get(token.text),))
        if token.kind == "kw" and token.text in ("like", "ilike") and self.take("("):  # the functions of that name
            return Node("call", (token.text, *self._items(")")))
        if token.kind == "id":
            return Node("call", (token.text, *self._items(")"))) if self.take("(") else Node("id", (token.text,))
        raise ConditionError(f"unexpected {token.text!r}")

    def _items(self, close: str) -> tuple:
        out = []
        while not self.take(close):
            if out:
                self.need(",")
            out.append(self.either())
        return tuple(out)


def parse(text: str) -> Node:
    return _Parser(text).whole()


def identifiers(node: Node) -> set[str]:
    """Roots of the names that a condition reads."""
    if node.kind == "id":
        return {node.args[0].split(".")[0]}
    return set().union(set(), *(identifiers(a) for a in node.args if isinstance(a, Node)))


# facts: values on the driver


def _missing(x: Any) -> bool:
    return x is None or (isinstance(x, float) and x != x)


def _str(x: Any) -> str:
    return "" if x is None else str(x)


def _seq(x: Any) -> list:
    return [] if x is None else list(x) if isinstance(x, (list, tuple, set, frozenset)) else list(x.values()) if isinstance(x, dict) else [x]


def _search(pattern: Any, text: Any, flags: int = 0, full: bool = False) -> bool:
    try:
        return bool((re.fullmatch if full else re.search)(_str(pattern), _str(text), flags))
    except re.error:
        return False


def _like(text: Any, pattern: Any, flags: int = 0) -> bool:
    rx = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in _str(pattern))
    return bool(re.fullmatch(rx, _str(text), flags | re.S))


def _ascii(x: Any) -> str:
    return unicodedata.normalize("NFKD", _str(x)).encode("ascii", "ignore").decode()


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similarity(a: Any, b: Any) -> float:
    a, b = _ascii(a).lower().strip(), _ascii(b).lower().strip()
    return 1.0 if not a and not b else 1 - edit_distance(a, b) / max(len(a), len(b))


#: Spellings of booleans in conditions, and names that tell roles.
TRUE_WORDS, FALSE_WORDS = frozenset("true t 1 y yes on ok ye".split()), frozenset("false f 0 n no off".split())
BOOL_NAME = r"^(?:is|has|can|should|flag|bool|enabled|active|valid|success|deleted|complete|paid|approved|verified)(?:_|$)"
ID_NAME, TIME_NAME = r"(?:^|_)(?:id|uuid|guid|key)(?:_|$)", r"(?:date|time|timestamp|dt|ts)"
NUMBER = r"^\s*[+-]?((\d+(\.\d*)?)|(\.\d+))([eE][+-]?\d+)?\s*$"


def to_bool(x: Any) -> bool | None:
    word = _str(x).strip().lower()
    return x if isinstance(x, bool) else True if word in TRUE_WORDS else False if word in FALSE_WORDS else None


def to_number(x: Any, default: float | None = None) -> float | None:
    if isinstance(x, (int, float)):
        return float(x)
    return float(_str(x)) if x is not None and re.match(NUMBER, _str(x)) else default


def _share(xs: Any, test: Callable) -> float:
    xs = _seq(xs)
    return sum(map(bool, map(test, xs))) / len(xs) if xs else 0.0


_I = re.I
FUNCTIONS: dict[str, Callable] = {
    "len": lambda x: 0 if x is None else len(x) if hasattr(x, "__len__") else len(_str(x)),
    "isnull": _missing, "notnull": lambda x: not _missing(x), "exists": lambda x: x is not None, "coalesce": lambda *xs: next((x for x in xs if not _missing(x)), None),
    "oneof": lambda x, xs: x in _seq(xs), "iin": lambda x, xs: _str(x).lower() in [_str(y).lower() for y in _seq(xs)],
    "lower": lambda x: _str(x).lower(), "upper": lambda x: _str(x).upper(), "strip": lambda x: _str(x).strip(), "lstrip": lambda x: _str(x).lstrip(), "rstrip": lambda x: _str(x).rstrip(), "norm": _ascii,
    "startswith": lambda x, y: _str(x).startswith(_str(y)), "endswith": lambda x, y: _str(x).endswith(_str(y)),
    "istartswith": lambda x, y: _str(x).lower().startswith(_str(y).lower()), "iendswith": lambda x, y: _str(x).lower().endswith(_str(y).lower()),
    "contains": lambda x, y: _str(y) in _str(x), "icontains": lambda x, y: _str(y).lower() in _str(x).lower(), "iequals": lambda x, y: _str(x).lower() == _str(y).lower(),
    "matches": lambda x, p: _search(p, x), "imatches": lambda x, p: _search(p, x, _I), "fullmatch": lambda x, p: _search(p, x, 0, True), "ifullmatch": lambda x, p: _search(p, x, _I, True),
    "like": _like, "ilike": lambda x, p: _like(x, p, _I),
    "any_icontains": lambda xs, y: any(_str(y).lower() in _str(x).lower() for x in _seq(xs)), "all_icontains": lambda xs, y: bool(_seq(xs)) and all(_str(y).lower() in _str(x).lower() for x in _seq(xs)),
    "any_matches": lambda xs, p: any(_search(p, x) for x in _seq(xs)), "all_matches": lambda xs, p: bool(_seq(xs)) and all(_search(p, x) for x in _seq(xs)),
    "isbool": lambda x: to_bool(x) is not None, "boolish": lambda x: to_bool(x) is not None, "istrue": lambda x: to_bool(x) is True, "isfalse": lambda x: to_bool(x) is False, "to_bool": lambda x: to_bool(x) or False,
    "boolish_ratio": lambda xs: _share(xs, lambda x: to_bool(x) is not None), "percent_true": lambda xs: _share(xs, lambda x: to_bool(x) is True), "percent_false": lambda xs: _share(xs, lambda x: to_bool(x) is False),
    "looks_like_bool_name": lambda x: _search(BOOL_NAME, x, _I), "looks_like_id_name": lambda x: _search(ID_NAME, x, _I), "looks_like_dt_name": lambda x: _search(TIME_NAME, x, _I),
    "is_boolean_dtype": lambda x: "bool" in _str(x).lower(), "is_numeric_dtype": lambda x: _search("int|float|double|number|numeric|decimal", x, _I), "is_datetime_dtype": lambda x: _search("timestamp|datetime", x, _I),
    "is_numeric": lambda x: to_number(x) is not None, "to_number": to_number,
    "null_ratio": lambda xs: _share(xs, _missing), "unique_count": lambda xs: len({None if _missing(x) else repr(x) for x in _seq(xs)}),
    "similarity": similarity, "similar": lambda a, b, least=0.8: similarity(a, b) >= least, "any_similar": lambda xs, y, least=0.8: any(similarity(x, y) >= least for x in _seq(xs)),
}


def _lookup(facts: Any, name: str) -> Any:
    for part in name.split("."):
        facts = facts.get(part) if isinstance(facts, dict) else getattr(facts, part, None)
        if facts is None:
            return None
    return facts


def _compare(op: str, a: Any, b: Any) -> bool:
    a, b = (None if _missing(x) else x for x in (a, b))
    if op in ("==", "!="):
        return (a == b) == (op == "==")
    if op == "in":
        return b is not None and (_str(a) in b if isinstance(b, str) else a in _seq(b))
    if op in ("like", "ilike"):
        return a is not None and _like(a, b, _I if op == "ilike" else 0)
    if op in ("=~", "~*", "!~", "!~*"):
        return _search(b, a, _I if op.endswith("*") else 0) != op.startswith("!")
    if a is None or b is None:
        return False
    try:
        return {"<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b}[op]()
    except TypeError:
        return False


def _value(node: Node, facts: Any) -> Any:
    kind, args = node.kind, node.args
    if kind == "lit":
        return args[0]
    if kind == "id":
        return _lookup(facts, args[0])
    if kind == "list":
        return [_value(a, facts) for a in args]
    if kind == "call":
        return FUNCTIONS[args[0]](*(_value(a, facts) for a in args[1:]))
    if kind == "and":
        return all(_value(a, facts) for a in args)
    if kind == "or":
        return any(_value(a, facts) for a in args)
    if kind == "not":
        return not _value(args[0], facts)
    if kind == "between":
        x, lo, hi = (_value(a, facts) for a in args)
        return _compare(">=", x, lo) and _compare("<=", x, hi)
    return _compare(args[0], _value(args[1], facts), _value(args[2], facts))


def _calls(node: Node) -> set[str]:
    own = {node.args[0]} if node.kind == "call" else set()
    return own.union(*(_calls(a) for a in node.args if isinstance(a, Node)))


def holds(node: Node, facts: Any) -> bool:
    """Whether a part of a condition is true; what goes wrong is false."""
    try:
        return bool(_value(node, facts))
    except Exception:
        return False


def compile_facts(text: str, allowed: set[str] | None = None) -> Callable[[Any], bool]:
    """A predicate on facts. What goes wrong while it runs is false; names outside of allowed are no condition."""
    node = parse(text)
    if unknown := _calls(node) - set(FUNCTIONS):
        raise ConditionError(f"unknown functions: {sorted(unknown)}")
    if allowed is not None and (unknown := identifiers(node) - allowed):
        raise ConditionError(f"unknown names: {sorted(unknown)}")

    return lambda facts: holds(node, facts)


# rows: Columns


def _s(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _items(x: Any) -> Column:
    """A list's items, or an array column; a single value is an array of one."""
    return F.array(*[i.cast("string") for i in x]) if isinstance(x, list) else x


def _share_of(xs: Any, test: Callable) -> Column:
    items = _items(xs)
    return F.coalesce(F.size(F.filter(items, test)) / F.nullif(F.size(items), F.lit(0)), F.lit(0.0))


def _regex(text: Column, pattern: Any, flags: str = "", full: bool = False) -> Column:
    """Whether the pattern is found; one that is no regular expression is found nowhere."""
    if isinstance(pattern, str):
        made = f"{flags}^(?:{pattern})$" if full else flags + pattern
        return F.rlike(text, F.lit(made)) if _is_regex(made) else F.lit(False)
    return F.rlike(text, F.concat(F.lit(flags + "^(?:"), pattern, F.lit(")$")) if full else F.concat(F.lit(flags), pattern))


def _is_regex(pattern: str) -> bool:
    """By the JVM, which will run it."""
    from pyspark import SparkContext

    context = SparkContext._active_spark_context
    try:
        context._jvm.java.util.regex.Pattern.compile(pattern) if context else re.compile(pattern)
        return True
    except Exception:
        return False


_BOOLISH = lambda c, words: F.lower(F.trim(_s(c))).isin(*sorted(words))
_ALL_WORDS = TRUE_WORDS | FALSE_WORDS
_IN = lambda x, y: F.contains(F.lower(_s(x)), F.lower(_s(y)))
_similar = lambda a, b: V.similarity(unicode.ascii_form(_s(a)), unicode.ascii_form(_s(b)))
_least = lambda x: F.lit(0.8) if x is None else x
#: Functions whose last argument is a regular expression, which reaches them as text where it is a literal.
_REGEX = {"matches": ("", False), "imatches": ("(?i)", False), "fullmatch": ("", True), "ifullmatch": ("(?i)", True)}
COLUMN_FUNCTIONS: dict[str, Callable] = {
    "len": lambda x: F.lit(len(x)) if isinstance(x, list) else F.coalesce(F.length(x), F.lit(0)), "isnull": lambda x: x.isNull(), "notnull": lambda x: x.isNotNull(), "exists": lambda x: x.isNotNull(), "coalesce": F.coalesce,
    "lower": lambda x: F.lower(_s(x)), "upper": lambda x: F.upper(_s(x)), "strip": lambda x: F.regexp_replace(_s(x), r"^\s+|\s+$", ""), "lstrip": lambda x: F.regexp_replace(_s(x), r"^\s+", ""), "rstrip": lambda x: F.regexp_replace(_s(x), r"\s+$", ""),
    "norm": lambda x: unicode.ascii_form(_s(x)),
    "startswith": lambda x, y: F.startswith(_s(x), _s(y)), "endswith": lambda x, y: F.endswith(_s(x), _s(y)), "istartswith": lambda x, y: F.startswith(F.lower(_s(x)), F.lower(_s(y))), "iendswith": lambda x, y: F.endswith(F.lower(_s(x)), F.lower(_s(y))),
    "contains": lambda x, y: F.contains(_s(x), _s(y)), "icontains": _IN, "iequals": lambda x, y: F.lower(_s(x)) == F.lower(_s(y)),
    "like": lambda x, p: F.like(_s(x), p), "ilike": lambda x, p: F.ilike(_s(x), p),
    "any_icontains": lambda xs, y: F.exists(_items(xs), lambda x: _IN(x, y)), "all_icontains": lambda xs, y: (F.size(_items(xs)) > 0) & F.forall(_items(xs), lambda x: _IN(x, y)),
    "any_matches": lambda xs, p: F.exists(_items(xs), lambda x: _regex(_s(x), p)), "all_matches": lambda xs, p: (F.size(_items(xs)) > 0) & F.forall(_items(xs), lambda x: _regex(_s(x), p)),
    "isbool": lambda x: _BOOLISH(x, _ALL_WORDS), "boolish": lambda x: _BOOLISH(x, _ALL_WORDS), "istrue": lambda x: _BOOLISH(x, TRUE_WORDS), "isfalse": lambda x: _BOOLISH(x, FALSE_WORDS), "to_bool": lambda x: _BOOLISH(x, TRUE_WORDS),
    "boolish_ratio": lambda xs: _share_of(xs, lambda x: _BOOLISH(x, _ALL_WORDS)), "percent_true": lambda xs: _share_of(xs, lambda x: _BOOLISH(x, TRUE_WORDS)), "percent_false": lambda xs: _share_of(xs, lambda x: _BOOLISH(x, FALSE_WORDS)),
    "looks_like_bool_name": lambda x: _regex(_s(x), BOOL_NAME, "(?i)"), "looks_like_id_name": lambda x: _regex(_s(x), ID_NAME, "(?i)"), "looks_like_dt_name": lambda x: _regex(_s(x), TIME_NAME, "(?i)"),
    "is_boolean_dtype": lambda x: _IN(x, F.lit("bool")), "is_numeric_dtype": lambda x: _regex(_s(x), "int|float|double|number|numeric|decimal", "(?i)"), "is_datetime_dtype": lambda x: _regex(_s(x), "timestamp|datetime", "(?i)"),
    "is_numeric": lambda x: V.number(_s(x)).isNotNull(), "to_number": lambda x, *d: F.coalesce(V.number(_s(x)), *d),
    "null_ratio": lambda xs: _share_of(xs, lambda x: x.isNull()), "unique_count": lambda xs: F.size(F.array_distinct(_items(xs))),
    "similarity": _similar, "similar": lambda a, b, least=None: _similar(a, b) >= _least(least), "any_similar": lambda xs, y, least=None: F.exists(_items(xs), lambda x: _similar(x, y) >= _least(least)),
}


def _literal(node: Node) -> Any:
    """A text literal as it stands, else the Column."""
    return node.args[0] if node.kind == "lit" and isinstance(node.args[0], str) else _column(node)


def _column(node: Node) -> Any:
    kind, args = node.kind, node.args
    if kind == "lit":
        return F.lit(args[0])
    if kind == "id":
        return F.col(args[0])
    if kind == "list":
        return [_column(a) for a in args]
    if kind == "call":
        name, *rest = args
        if name in ("oneof", "iin"):
            x, items = _column(rest[0]), _column(rest[1])
            return F.coalesce(x.isin(*items) if name == "oneof" else F.lower(_s(x)).isin(*[F.lower(_s(i)) for i in items]), F.lit(False))
        if name in _REGEX:
            flags, full = _REGEX[name]
            return _regex(_s(_column(rest[0])), _literal(rest[1]), flags, full)
        if name not in COLUMN_FUNCTIONS:
            raise ConditionError(f"no such function on rows: {name}")
        if name in ("any_matches", "all_matches"):
            return COLUMN_FUNCTIONS[name](_column(rest[0]), _literal(rest[1]))
        return COLUMN_FUNCTIONS[name](*(_column(a) for a in rest))
    sure = lambda c: F.coalesce(c.cast("boolean"), F.lit(False))
    if kind in ("and", "or"):
        return reduce(lambda a, b: a & b if kind == "and" else a | b, [sure(_column(a)) for a in args])
    if kind == "not":
        return ~sure(_column(args[0]))
    if kind == "between":
        return sure(_column(args[0]).between(_column(args[1]), _column(args[2])))
    op, a = args[0], _column(args[1])
    if op in ("=~", "~*", "!~", "!~*"):
        found = sure(_regex(_s(a), _literal(args[2]), "(?i)" if op.endswith("*") else ""))
        return ~found if op.startswith("!") else found
    b = _column(args[2])
    if op == "in":
        return sure(a.isin(*b)) if isinstance(b, list) else sure(F.contains(b, _s(a)))
    made = {
        "==": lambda: a.eqNullSafe(b), "!=": lambda: ~a.eqNullSafe(b), "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b, "like": lambda: F.like(a, b), "ilike": lambda: F.ilike(a, b),
    }[op]()
    return sure(made)


def compile_column(text: str) -> Column:
    """A boolean Column that is never null; names are columns."""
    return F.coalesce(_column(parse(text)).cast("boolean"), F.lit(False))
