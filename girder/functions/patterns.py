"""The pattern dialects of policies, as native Column expressions.

``segments`` is the two-sided segment glob: ``*`` is any path, ``p::*`` is p and
what lies below, ``*::s`` is s at the end, ``*::m::*`` a run of whole segments
anywhere; ``*::`` and ``::*`` alone match nothing. Other dialects are named after
what they match. Every matcher takes (column, pattern) and returns a boolean
Column; ``any_pattern`` and ``first_pattern`` fold a list into one expression,
which stays inside code generation for the short lists that policies hold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

Matcher = Callable[[Column, str], Column]
SEP = "::"


def _inside(col: Column, body: str) -> Column:
    return F.concat(F.lit(SEP), col, F.lit(SEP)).contains(SEP + body + SEP)


def segments(col: Column, pattern: str) -> Column:
    if pattern == "*":
        return col.isNotNull()
    front, back = pattern.startswith("*::"), pattern.endswith("::*")
    body = pattern[3 if front else 0 : len(pattern) - (3 if back else 0)]
    if front and back and len(pattern) < 6 or not body:
        return col.isNotNull() & F.lit(False)
    if front and back:
        return _inside(col, body)
    if front:
        return F.concat(F.lit(SEP), col).endswith(SEP + body)
    if back:
        return F.concat(col, F.lit(SEP)).startswith(body + SEP)
    return col == body


def trailing_segments(col: Column, pattern: str) -> Column:
    """Only a trailing wildcard counts; anything else is exact."""
    if pattern == "*":
        return col.isNotNull()
    if pattern.endswith("::*") and len(pattern) > 3:
        return F.concat(col, F.lit(SEP)).startswith(pattern[:-3] + SEP)
    return col == pattern


def name_glob(col: Column, pattern: str) -> Column:
    """``*`` at either end of a bare name; ``**`` matches nothing."""
    if pattern == "*":
        return col.isNotNull()
    front, back = pattern.startswith("*"), pattern.endswith("*")
    body = pattern[1 if front else 0 : len(pattern) - (1 if back else 0)]
    if not body:
        return col.isNotNull() & F.lit(False)
    if front and back:
        return col.contains(body)
    if front:
        return col.endswith(body)
    if back:
        return col.startswith(body)
    return col == body


def name_suffix(col: Column, pattern: str) -> Column:
    """Only a leading wildcard counts."""
    return col.endswith(pattern[1:]) if pattern.startswith("*") else col == pattern


def type_text_glob(col: Column, pattern: str) -> Column:
    """As ``name_glob`` over the text of a type, but ``*`` and ``**`` match all."""
    return col.isNotNull() if set(pattern) == {"*"} else name_glob(col, pattern)


def single_star(col: Column, pattern: str) -> Column:
    """One ``*`` anywhere: prefix and suffix without overlap."""
    if "*" not in pattern:
        return col == pattern
    head, tail = pattern.split("*", 1)
    return col.startswith(head) & col.endswith(tail) & (F.length(col) >= len(head) + len(tail))


def segments_or_name(col: Column, pattern: str) -> Column:
    """Segment globs, falling through to name globs."""
    return segments(col, pattern) | name_glob(col, pattern)


def path_or_name(col: Column, pattern: str) -> Column:
    """A pattern with ``::`` is a segment glob, any other a name glob."""
    return segments(col, pattern) if SEP in pattern else name_glob(col, pattern)


def fragments(col: Column, pattern: str) -> Column:
    """The whole text or any path-like fragment of it."""
    parts = F.split(col, r"[^\p{L}\p{N}_:]+")
    return segments(col, pattern) | F.exists(parts, lambda x: (x != "") & segments(x, pattern))


def any_pattern(col: Column, patterns: Iterable[str], match: Matcher = segments) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | match(col, p)
    return F.coalesce(out, F.lit(False))


def first_pattern(col: Column, patterns: Iterable[str], match: Matcher = segments) -> Column:
    """The first pattern of the list that matches, else null."""
    out = F.lit(None).cast("string")
    for p in reversed(list(patterns)):
        out = F.when(F.coalesce(match(col, p), F.lit(False)), F.lit(p)).otherwise(out)
    return out


def first_value(col: Column, entries: Iterable[tuple[str, object]], match: Matcher = segments) -> Column:
    """The value of the first (pattern, value) entry whose pattern matches, else null."""
    entries = list(entries)
    if not entries:
        return F.lit(None)
    out = F.lit(None)
    for p, v in reversed(entries):
        out = F.when(F.coalesce(match(col, p), F.lit(False)), F.lit(v)).otherwise(out)
    return out
