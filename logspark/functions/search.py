"""Search strings folded into one boolean Column.

``field:value``, ``field:"quoted value"``, ``"phrase"`` and bare words; neighbours are ANDed;
AND / OR associate to the left with equal precedence; an operator without a right side is ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, functions as F

_NAME = re.compile(r"[A-Za-z0-9_]+\Z")
COLUMN_FIELDS = ("source", "level")


def text_match(term: str, mode: str = "strict") -> Column:
    """Case-insensitive substring. ``%`` and ``_`` are ordinary characters.

    Strict looks at message and raw_json, loose at the whole record.
    """
    if not term:
        return F.lit(True)
    needle = F.lit(term.lower())
    names = ("message", "raw_json") if mode == "strict" else ("message", "raw_json", "source", "level")
    hit = F.lit(False)
    for name in names:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(name)), needle), F.lit(False))
    return hit


def json_field(name: str) -> Column:
    """Top-level JSON field of the record as text, '' when absent."""
    return F.coalesce(F.get_json_object("raw_json", f"$.{name}"), F.lit(""))


def field_match(name: str, value: str, mode: str = "strict") -> Column:
    """Equality on source / level (a plain column test that reaches the scan) or on a JSON field."""
    if not _NAME.match(name):
        raise ValueError(f"not a field name: {name!r}")
    target = F.col(name) if name in COLUMN_FIELDS else json_field(name)
    if mode == "loose":
        return F.lower(target) == value.lower()
    return target == value


def all_of(*parts: Column) -> Column:
    out = F.lit(True)
    for part in parts:
        out = out & part
    return out


def any_of(*parts: Column) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | part
    return out


def _condition(term: str, mode: str) -> Column:
    if term.startswith('"'):
        return text_match(term.strip('"') if term.endswith('"') else term, mode)
    name, colon, value = term.partition(":")
    if colon and _NAME.match(name):
        quoted = len(value) >= 2 and value[0] == value[-1] == '"'
        return field_match(name, value[1:-1] if quoted else value, mode)
    return text_match(term, mode)


def _terms(query: str) -> Iterator[str]:
    """Terms from left to right, each up to white space.

    A quote at the start of a term or right after ``field:`` runs to the next quote, white space and
    all; without one it is an ordinary character. A quote later in a field's value starts the next term.
    """
    rest = query.lstrip()
    while rest:
        name, colon, _ = rest.partition(":")
        value_at = len(name) + 1 if colon and _NAME.match(name) else 0
        closing = rest.find('"', value_at + 1) if rest.startswith('"', value_at) else -1
        if closing >= 0:
            end = closing + 1
        else:
            end = len(rest.split(None, 1)[0])
            later = rest.find('"', value_at + 1, end) if value_at and not rest.startswith('"', value_at) else -1
            end = later if later >= 0 else end
        yield rest[:end]
        rest = rest[end:].lstrip()


def search_condition(query: str, mode: str = "strict") -> Column:
    """One Column for a whole search string; an empty string matches everything."""
    result: Column | None = None
    pending: str | None = None
    for term in _terms(query or ""):
        if term in ("AND", "OR"):
            pending = term
            continue
        condition = _condition(term, mode)
        if result is None:
            # an operator before the first term starts from "everything"
            result = condition if pending in (None, "AND") else F.lit(True)
        else:
            result = (result | condition) if pending == "OR" else (result & condition)
        pending = None
    return F.lit(True) if result is None else result
