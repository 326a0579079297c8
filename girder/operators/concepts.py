"""Concept clustering, roles, canonical election and conversion provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import stab
from girder.functions.text import concept_id, jaccard, matched_suffix, short_name, stem

from girder.scratch import discard, made_of, materialize

ORD = ["pkg_ix", "file_ix", "item_ix"]


def roles(types: DataFrame, hints: DataFrame, concepts: DataFrame) -> DataFrame:
    """(ordinals, role): the policy's role, else that of a hint whose target line lies in the type; canonical beats boundary."""
    policy = concepts.groupBy("symbol").agg(F.max((F.col("role") == "canonical").cast("int")).alias("pc"))
    own = hints.where("category in ('canonical', 'boundary')").select("pkg_ix", "file_ix", "category", "target_start")
    hinted = stab(own, types.select(*ORD, "line_start", "line_end"), ["pkg_ix", "file_ix"], "target_start", "line_start", "line_end").groupBy(*ORD).agg(F.max((F.col("category") == "canonical").cast("int")).alias("hc"))
    code = F.coalesce("pc", "hc")
    return types.join(policy, "symbol", "left").join(hinted, ORD, "left").select(*ORD, F.when(code == 1, "Canonical").when(code == 0, "Boundary").otherwise("Unknown").alias("role"))


def clusters(types: DataFrame, fields: DataFrame, variants: DataFrame, hints: DataFrame, concepts: DataFrame, conversions: DataFrame) -> DataFrame:
    """Members of concept clusters: types of one stem whose shapes overlap.

    Structs with fields and enums with fields or variants are grouped by the
    name without its boundary suffix; the reference is the first canonical
    member, else the last of those with the most fields; overlap is the Jaccard
    index of field (else variant) names with it; a cluster has two members of
    at least .5. Adds overlap, confidence and concept.

    Members are read twice for their references and four times with them, so
    both are written: one plan would hold the joins before them eight times.
    """
    names = lambda df, a: df.groupBy(*ORD).agg(F.array_sort(F.collect_set("name")).alias(a), F.count("*").alias(f"n_{a}"))
    t = types.join(names(fields, "fs"), ORD, "left").join(names(variants, "vs"), ORD, "left")
    t = t.where((F.col("kind").isin("Struct", "Enum") & (F.col("n_fs") > 0)) | ((F.col("kind") == "Enum") & (F.col("n_vs") > 0)))
    t = t.withColumns({"shape": F.coalesce("fs", "vs"), "n_fields": F.coalesce("n_fs", F.lit(0)), "stem": stem(F.col("name"))})
    t = t.join(roles(types, hints, concepts), ORD).select(*ORD, "path", "module_path", "line_start", "line_end", "symbol", "name", "stem", "role", "shape", "n_fields")
    t = materialize(t, "members")
    canon = F.col("role") == "Canonical"
    ref = t.groupBy("stem").agg(
        F.count("*").alias("members"),
        F.min(F.when(canon, F.struct(*ORD, "symbol", "shape"))).alias("first"),
        F.max(F.struct("n_fields", *ORD, "symbol", "shape")).alias("widest"),
    ).where("members > 1")
    ref = ref.select("stem", "members", F.coalesce("first.symbol", "widest.symbol").alias("reference"), F.coalesce("first.shape", "widest.shape").alias("ref_shape"))
    m = materialize(t.join(ref, "stem").withColumn("overlap", jaccard(F.col("shape"), F.col("ref_shape"))).drop("ref_shape", "shape"), "members")
    discard(t)
    ends = m.select("stem", "symbol", "name")
    linked = (
        conversions.select(F.trim("from_type").alias("f"), F.trim("to_type").alias("t"))
        .join(ends.select("stem", F.explode(F.array("symbol", "name")).alias("f")).distinct(), "f")
        .join(ends.select(F.col("stem").alias("stem2"), F.explode(F.array("symbol", "name")).alias("t")).distinct(), "t")
        .where("stem = stem2").select("stem").distinct().withColumn("linked", F.lit(0.2))
    )
    others = F.avg(F.when(F.col("role") != "Canonical", F.col("overlap").cast("double")))
    base = F.when(F.max(canon.cast("int")) == 1, 0.4 + 0.4 * F.coalesce(others, F.lit(0.0))).otherwise(0.4 + 0.3 * F.avg(F.col("overlap").cast("double")))
    kept = m.groupBy("stem").agg(F.count_if(F.col("overlap") >= F.lit(0.5).cast("float")).alias("close"), base.alias("base")).where("close >= 2").join(linked, "stem", "left")
    kept = kept.select("stem", F.least(F.lit(1.0), F.col("base") + F.coalesce("linked", F.lit(0.0))).alias("confidence"))
    return made_of(m.join(kept, "stem").withColumn("concept", concept_id(F.col("stem"))), m)


def elect(members: DataFrame, conversions: DataFrame) -> DataFrame:
    """(stem, symbol, score): the canonical member of each cluster by name, layer and inbound conversions; none where the lead is under .2.

    Scores are tenths in whole numbers, so that ties are ties.
    """
    inbound = conversions.groupBy(short_name(F.col("to_type")).alias("to")).agg(F.count("*").alias("inbound"))
    layer = F.aggregate(
        F.split("symbol", "::"), F.lit(0),
        lambda a, s: a + F.when(s.isin("domain", "core", "model", "models"), 3).when(s.isin("api", "dto", "dtos", "transport"), -2).otherwise(0),
    )
    named = F.when(F.lower("name") == F.lower("stem"), 3).otherwise(0) - F.when(matched_suffix(F.col("name")).isNotNull(), 3).otherwise(0)
    s = members.join(inbound, short_name(F.col("symbol")) == F.col("to"), "left").withColumn("score", named + layer + F.coalesce("inbound", F.lit(0)))
    w = Window.partitionBy("stem").orderBy(F.desc("score"), *ORD)
    s = s.withColumns({"rn": F.row_number().over(w), "next": F.lead("score").over(w)}).where("rn = 1")
    return s.where(F.col("next").isNull() | (F.col("score") - F.col("next") >= 2)).select("stem", "symbol", F.col("score").cast("long").alias("score"))


RANK = {"Heuristic": 0, "Syntactic": 1, "SourceHint": 2, "SemanticResolved": 3}


def distinct_conversions(conversions: DataFrame) -> DataFrame:
    """One row a conversion (file, lines, mechanism, short ends): the highest provenance, else the first; no layer counts as heuristic."""
    rank = F.coalesce(*[F.when(F.col("layer") == k, v) for k, v in RANK.items()], F.lit(0))
    w = Window.partitionBy("path", "line_start", "line_end", "mechanism", short_name(F.col("from_type")), short_name(F.col("to_type"))).orderBy(rank.desc(), *ORD)
    return conversions.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
