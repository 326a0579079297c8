"""Tables of segment patterns met by equal keys, for policies too long for one expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pattern_key(pattern: Column) -> Column:
    """(kind, body) of a two-sided segment glob: exact, start (``p::*``), end (``*::s``), inner (``*::m::*``) or all (``*``); null for one that matches nothing."""
    front, back = pattern.startswith("*::"), pattern.endswith("::*")
    body = F.regexp_replace(F.regexp_replace(pattern, r"^\*::", ""), r"::\*$", "")
    kind = F.when(pattern == "*", "all").when(front & back, "inner").when(front, "end").when(back, "start").otherwise("exact")
    malformed = (front & back & (F.length(pattern) < 6)) | (((body == "") | (pattern == "*::") | (pattern == "::*")) & (pattern != "*"))
    return F.when(~malformed, F.struct(kind.alias("kind"), F.when(kind == "all", "").otherwise(body).alias("body")))


def path_keys(parts: Column) -> Column:
    """The keys of every pattern that matches a path, given its segments, but ``*``: the runs of whole segments, by whether they touch its ends."""
    n = F.size(parts)

    def runs(i: Column) -> Column:
        def keys(j: Column) -> Column:
            body = F.array_join(F.slice(parts, i, j - i + 1), "::")
            kinds = F.array_compact(F.array(F.lit("inner"), F.when(i == 1, "start"), F.when(j == n, "end"), F.when((i == 1) & (j == n), "exact")))
            return F.transform(kinds, lambda k: F.struct(k.alias("kind"), body.alias("body")))

        return F.flatten(F.transform(F.sequence(i, n), keys))

    return F.flatten(F.transform(F.sequence(F.lit(1), n), runs))


def first_patterns(paths: DataFrame, patterns: DataFrame, path: str = "path") -> DataFrame:
    """(path, ix, pattern): for each distinct path the first pattern, by ``ix``, of a table (ix, pattern) that matches it; paths that none matches are absent.

    Paths are taken apart into their runs of segments, patterns have one key
    each, and the two meet by equal keys: work grows with the paths' lengths and
    the matches, not with paths times patterns. Patterns that say the same count
    as the first of them, and ``*``, which matches all, is one row joined to all.
    """
    first = F.min(F.struct("ix", "pattern")).alias("p")
    keyed = patterns.select("ix", "pattern", pattern_key(F.col("pattern")).alias("k")).where("k is not null").groupBy("k.kind", "k.body").agg(first)
    own = paths.select(F.col(path).alias("path")).where("path is not null").distinct()
    parts = own.withColumn("parts", F.split("path", "::"))
    met = parts.select("path", F.explode(F.array_distinct(path_keys(F.col("parts")))).alias("k")).select("path", "k.kind", "k.body")
    best = met.join(keyed, ["kind", "body"]).groupBy("path").agg(F.min("p").alias("p"))
    any_path = keyed.where("kind = 'all'").agg(F.min("p").alias("star"))  # one row
    both = own.join(best, "path", "left").crossJoin(F.broadcast(any_path)).select("path", F.least("p", "star").alias("p"))
    return both.where("p is not null").select("path", "p.ix", "p.pattern")
