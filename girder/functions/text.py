"""Text predicates of symbols, types and documentation, as native Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: texts of primitive types
PRIMITIVES = ["String", "str", "i8", "i16", "i32", "i64", "i128", "isize", "u8", "u16", "u32", "u64", "u128", "usize", "f32", "f64", "bool", "char"]
# fixed values: suffixes of boundary-shaped type names, tried in this order
BOUNDARY_SUFFIXES = ["Response", "Request", "Payload", "Schema", "Message", "Record", "Entity", "Model", "Reply", "View", "Body", "Resp", "Req", "Row", "Dto"]


def short_name(symbol: Column) -> Column:
    """Last ``::`` segment, trimmed."""
    return F.trim(F.substring_index(symbol, "::", -1))


def containing_module(symbol: Column) -> Column:
    """The symbol without its last segment; a bare name stays."""
    return F.when(symbol.contains("::"), F.left(symbol, F.length(symbol) - F.length(F.substring_index(symbol, "::", -1)) - 2)).otherwise(symbol)


def matched_suffix(name: Column) -> Column:
    out = F.lit(None).cast("string")
    for s in reversed(BOUNDARY_SUFFIXES):
        out = F.when(name.endswith(s) & (F.length(name) > len(s)), F.lit(s)).otherwise(out)
    return out


def stem(name: Column) -> Column:
    """The name without the first boundary suffix that fits."""
    suffix = matched_suffix(name)
    return F.coalesce(F.left(name, F.length(name) - F.length(suffix)), name)


def concept_id(stem_: Column) -> Column:
    """Camel case to kebab case, a boundary at each upper-case letter but the first."""
    return F.lower(F.regexp_replace(stem_, r"(?<!^)(\p{Lu})", "-$1"))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets given as arrays; 0 when both are empty. Single precision, as thresholds are compared in it."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union).cast("float")


def mentions(text: Column, name: Column) -> Column:
    """Whether the text holds the name as a whole identifier (ASCII boundary)."""
    return text.contains(name) & F.regexp_like(
        F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(r"[^A-Za-z0-9_]\Q"), name, F.lit(r"\E[^A-Za-z0-9_]"))
    )


def mentions_literal(text: Column, name: str) -> Column:
    return text.rlike(rf"(?<![A-Za-z0-9_]){re.escape(name)}(?![A-Za-z0-9_])")


def result_error(type_text: Column) -> Column:
    """E of a top-level ``Result<T, E>``: the part after the first comma outside brackets; null without one."""
    body = F.regexp_extract(F.trim(type_text), r"^(?:[A-Za-z0-9_:]*::)?Result<(.*)>$", 1)
    state = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("after"), F.lit("").alias("text"))

    def step(acc: Column, ch: Column) -> Column:
        depth = acc["depth"] + F.when(ch.isin("<", "(", "["), 1).when(ch.isin(">", ")", "]"), -1).otherwise(0)
        cut = ~acc["after"] & (acc["depth"] == 0) & (ch == ",")
        return F.struct(
            depth.alias("depth"), (acc["after"] | cut).alias("after"), F.when(acc["after"], F.concat(acc["text"], ch)).otherwise(acc["text"]).alias("text")
        )

    out = F.aggregate(F.split(body, ""), state, step)
    text = F.regexp_replace(F.trim(out["text"]), "^::", "")
    return F.when((body != "") & out["after"] & (text != ""), text)


def snake_to_pascal(name: Column) -> Column:
    """Null on an empty name or segment."""
    parts = F.split(name, "_")
    joined = F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 10_000))), "")
    return F.when((name != "") & ~F.exists(parts, lambda p: p == ""), joined)


def is_primitive(type_text: Column) -> Column:
    """A primitive's text behind ``&`` and layers of ``Option<...>``, however many: what is left of such a text are its closing brackets."""
    inside = type_text.rlike(rf"^(?:\s|&|Option<)*(?:{'|'.join(PRIMITIVES)})(?:\s|>)*$")
    return inside & (F.regexp_count(type_text, F.lit("<")) == F.regexp_count(type_text, F.lit(">")))


def starts_with_any(name: Column, prefixes: list[str]) -> Column:
    """The first prefix that fits, else null."""
    out = F.lit(None).cast("string")
    for p in reversed(prefixes):
        out = F.when(name.startswith(p), F.lit(p)).otherwise(out)
    return out
