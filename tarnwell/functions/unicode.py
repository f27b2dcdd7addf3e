"""Compatibility and plain forms of characters as Columns, by tables that the Unicode database's own rules fill."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points that have other forms; Hangul syllables, which are made by arithmetic, stay as they are.
_RANGES = (range(0x80, 0xAC00), range(0xF900, 0x10000), range(0x1D400, 0x1D800), range(0x1F100, 0x1F200), range(0x2F800, 0x2FA20))


@lru_cache
def _forms(plain: bool) -> tuple[str, str, dict[str, str]]:
    """(characters, the one each becomes, those that become several): of NFKD's ASCII part, or of NFKC."""
    one, to, many = [], [], {}
    for ch in (chr(k) for r in _RANGES for k in r):
        form = unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode() if plain else unicodedata.normalize("NFKC", ch)
        if len(form) == 1 and form != ch:
            one.append(ch), to.append(form)
        elif len(form) > 1:
            many[ch] = form
    return "".join(one), "".join(to), many


@lru_cache
def _composed() -> dict[str, str]:
    """Letters with their marks as several characters, and the one character that stands for them."""
    out = {}
    for ch in (chr(k) for k in _RANGES[0]):
        apart = unicodedata.normalize("NFD", ch)
        if len(apart) > 1 and unicodedata.category(apart[1]) == "Mn" and unicodedata.normalize("NFC", apart) == ch:
            out[apart] = ch
    return out


#: What stands between a table's entries and its sides, which no form has in it.
_ENTRY, _SIDE = "\x1e", "\x1f"


def let(value: Column, fn) -> Column:
    """fn of a value that is computed once, where writing it out each time would outgrow generated code."""
    return F.transform(F.array(value), fn)[0]


def _mapped(parts: Column, table: dict[str, str]) -> Column:
    """parts with those that the table has replaced, as one text. The table is one literal, folded once a plan."""
    pairs = F.str_to_map(F.lit(_ENTRY.join(f"{k}{_SIDE}{v}" for k, v in table.items())), F.lit(_ENTRY), F.lit(_SIDE))
    return F.array_join(F.transform(parts, lambda p: F.coalesce(pairs[p], p)), "")


def _folded(s: Column, plain: bool) -> Column:
    """s with its characters' forms. Whether any becomes several is asked by leaving those out: a look-up a character,
    where a pattern would hold each against all of them."""
    one, to, many = _forms(plain)
    has = lambda t: F.length(F.translate(t, "".join(many), "")) < F.length(t)
    return let(F.translate(s, one, to), lambda t: F.when(has(t), _mapped(F.split(t, ""), many)).otherwise(t))


def ascii_form(c: Column) -> Column:
    """The ASCII part of the compatibility decomposition: letters without marks, ligatures and widths undone."""
    return let(c.cast("string"), lambda s: F.when(s.rlike(r"[^\x00-\x7F]"), F.regexp_replace(_folded(s, True), r"[^\x00-\x7F]", "")).otherwise(s))


def _whole(t: Column) -> Column:
    return F.when(t.rlike(r"\p{Mn}"), _mapped(F.regexp_extract_all(t, F.lit(r"(?s).\p{Mn}*"), F.lit(0)), _composed())).otherwise(t)


def nfkc(c: Column) -> Column:
    """The compatibility composition, of texts that hold anything beyond ASCII."""
    return let(c.cast("string"), lambda s: F.when(s.rlike(r"[^\x00-\x7F]"), let(_folded(s, False), _whole)).otherwise(s))
