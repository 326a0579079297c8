"""Accepting proposals into the concept table: outcomes as rows, the new table beside the old."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.functions.text import concept_id, stem

#: Outcomes that change the table.
DONE = ["added", "replaced", "confirmed", "refreshed"]


def outcomes(proposals: DataFrame, concepts: DataFrame, types: DataFrame) -> DataFrame:
    """What becomes of each proposal (ix, role, symbol, concept, boundary, force): adds the concept it means, and outcome.

    ``role`` is canonical or boundary. A canonical type without a concept gets
    that of its name's stem. Proposals are a batch: of those for one concept's
    canonical type the first by ``ix`` counts, of equal ones too; a boundary may
    belong to a concept that the batch itself adds. Outcomes are ``added``,
    ``replaced`` (forced), ``confirmed``, ``refreshed``, or else ``empty``,
    ``unknown symbol``, ``unknown concept``, ``in another concept``, ``already
    canonical``, ``canonical already set``, ``duplicate`` and ``conflict``.
    """
    names = types.groupBy("symbol").agg(F.min("name").alias("name"))
    p = proposals.join(names, "symbol", "left").withColumn("meant", F.coalesce("concept", F.when(F.col("role") == "canonical", concept_id(stem(F.col("name"))))))
    held = concepts.groupBy("symbol").agg(F.min(F.struct("concept", "role")).alias("h")).select("symbol", F.col("h.concept").alias("in_concept"), F.col("h.role").alias("in_role"))
    canon = concepts.where("role = 'canonical'").groupBy(F.col("concept").alias("meant")).agg(F.min("symbol").alias("present"))
    p = p.join(held, "symbol", "left").join(canon, "meant", "left")
    missing = F.when(F.coalesce("symbol", F.lit("")) == "", "empty").when(F.col("name").isNull(), "unknown symbol")
    elsewhere = F.col("in_concept").isNotNull() & ~F.col("in_concept").eqNullSafe(F.col("meant"))
    # the first sound proposal for a concept's canonical type, and the first of equal ones
    sound = missing.isNull() & ~elsewhere
    firsts = p.where((F.col("role") == "canonical") & sound).groupBy("meant").agg(F.min(F.struct("ix", "symbol")).alias("f")).select("meant", F.col("f.symbol").alias("first_symbol"))
    same = p.groupBy("role", "symbol", "meant").agg(F.min("ix").alias("first_ix"))
    p = p.join(firsts, "meant", "left").join(same.withColumnsRenamed({"role": "r2", "symbol": "s2", "meant": "m2"}), F.col("role").eqNullSafe(F.col("r2")) & F.col("symbol").eqNullSafe(F.col("s2")) & F.col("meant").eqNullSafe(F.col("m2")), "left")
    repeated = F.when(F.col("ix") > F.col("first_ix"), "duplicate")
    forced = F.coalesce("force", F.lit(False))
    as_canonical = (
        F.when(elsewhere, "in another concept")
        .when(F.col("symbol") != F.col("first_symbol"), "conflict")
        .when(F.col("present").isNull(), "added")
        .when(F.col("present") == F.col("symbol"), "confirmed")
        .when(forced, "replaced")
        .otherwise("canonical already set")
    )
    # a boundary is judged by the concept as it was, or by the one that the batch adds
    settled = F.coalesce("present", "first_symbol")
    as_boundary = (
        F.when(elsewhere, "in another concept")
        .when(settled.isNull(), "unknown concept")
        .when((settled == F.col("symbol")) | ((F.col("in_role") == "canonical") & ~elsewhere & F.col("in_concept").isNotNull()), "already canonical")
        .when(F.col("in_concept").isNotNull(), "refreshed")
        .otherwise("added")
    )
    said = F.coalesce(missing, repeated, F.when(F.col("role") == "canonical", as_canonical).otherwise(as_boundary))
    return p.select("ix", "role", "symbol", F.col("meant").alias("concept"), "boundary", said.alias("outcome"))


def merged(concepts: DataFrame, said: DataFrame) -> DataFrame:
    """The concept table (concept, role, symbol, boundary, source) after the proposals whose outcome changes it: a full outer join of the two."""
    done = said.where(F.col("outcome").isin(*DONE)).select("concept", "role", "symbol", F.col("boundary").alias("label"), "outcome")
    replaced = done.where("outcome = 'replaced'").select("concept", F.lit("canonical").alias("role"))
    kept = concepts.join(replaced, ["concept", "role"], "left_anti").select("concept", "role", "symbol", "boundary", "source").distinct()
    both = kept.join(done, ["concept", "role", "symbol"], "full")
    return both.select("concept", "role", "symbol", F.coalesce("label", "boundary").alias("boundary"), F.when(F.col("outcome").isNotNull(), "Accepted").otherwise(F.col("source")).alias("source"))
