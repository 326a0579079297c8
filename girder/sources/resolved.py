"""Conversions that a compiler has resolved, from its JSON documents of packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TYPE = "struct<resolved_path: struct<path: string, id: bigint>, primitive: string>"
_IMPL = f"struct<is_synthetic: boolean, blanket_impl: string, trait: struct<path: string, args: struct<angle_bracketed: struct<args: array<struct<type: {_TYPE}>>>>>, `for`: {_TYPE}>"
SCHEMA = f"struct<index: map<string, struct<span: struct<filename: string, begin: array<int>, end: array<int>>, inner: struct<impl: {_IMPL}>>>, paths: map<string, struct<path: array<string>>>>"

# fixed values: the paths under which the two traits are known
MECHANISMS = {"From": ["core::convert::From", "std::convert::From", "From"], "TryFrom": ["core::convert::TryFrom", "std::convert::TryFrom", "TryFrom"]}


def resolved_conversions(documents: DataFrame) -> DataFrame:
    """(package, from_type, to_type, mechanism, symbol, path, line_start, line_end, layer, backend) of documents (package, json).

    Every ``From`` and ``TryFrom`` that someone wrote: synthetic and blanket
    implementations are the compiler's own. A document's items and its table of
    paths become rows, and a type's name is the path of its id, met by a join
    within the package; without one, the name as written. A document that is
    null or no JSON gives no rows.
    """
    docs = documents.select("package", F.from_json("json", SCHEMA).alias("d"))
    items = docs.select("package", F.explode("d.index").alias("id", "item")).select("package", "item.span", F.col("item.inner.impl").alias("i")).where("i is not null")
    items = items.where("not coalesce(i.is_synthetic, false) and i.blanket_impl is null")
    mechanism = F.lit(None).cast("string")
    for name, known in MECHANISMS.items():
        mechanism = F.when(F.col("i.trait.path").isin(*known), name).otherwise(mechanism)
    kinds = F.filter("i.trait.args.angle_bracketed.args", lambda a: a["type"].isNotNull())
    found = items.select("package", "span", F.col("i.trait.path").alias("trait"), mechanism.alias("mechanism"), F.try_element_at(kinds, F.lit(1))["type"].alias("f"), F.col("i.for").alias("t"))
    found = found.where("mechanism is not null and f is not null")
    names = docs.select("package", F.explode("d.paths").alias("id", "p")).select("package", F.col("id").cast("long").alias("id"), F.array_join("p.path", "::").alias("name"))

    def named(df: DataFrame, side: str) -> DataFrame:
        own = names.select(F.col("package").alias("p2"), F.col("id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name"))
        return df.join(own, (F.col("package") == F.col("p2")) & (F.col(f"{side}.resolved_path.id") == F.col(f"{side}_id")), "left").drop("p2", f"{side}_id")

    found = named(named(found, "f"), "t")
    text = lambda side: F.coalesce(f"{side}_name", f"{side}.resolved_path.path", f"{side}.primitive")
    line = lambda c: F.try_element_at(c, F.lit(1))
    out = found.select(
        "package", text("f").alias("from_type"), text("t").alias("to_type"), "mechanism", "trait", F.col("span.filename").alias("path"),
        line(F.col("span.begin")).alias("line_start"), line(F.col("span.end")).alias("line_end"),
    ).where("from_type is not null and to_type is not null")
    symbol: Column = F.concat(F.lit("impl "), "trait", F.lit("<"), "from_type", F.lit("> for "), "to_type")
    return out.withColumns({"symbol": symbol, "layer": F.lit("SemanticResolved"), "backend": F.lit("compiler-json")}).drop("trait")


def overlaid(conversions: DataFrame, resolved: DataFrame) -> DataFrame:
    """Conversions read from sources with the resolved ones added, which ``distinct_conversions`` then prefers; their ordinals follow those of their file."""
    last = conversions.groupBy("path").agg(F.max(F.struct("pkg_ix", "file_ix", "item_ix")).alias("l"))
    more = resolved.join(last, "path", "left").select(
        F.coalesce("l.pkg_ix", F.lit(-1)).alias("pkg_ix"), F.coalesce("l.file_ix", F.lit(-1)).alias("file_ix"), (F.coalesce("l.item_ix", F.lit(0)) + 1).alias("item_ix"),
        "path", "line_start", "line_end", "from_type", "to_type", "mechanism", "symbol", "layer",
    )
    return conversions.select(*more.columns).unionByName(more)
