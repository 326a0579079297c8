"""Joins of points and closed intervals by equal keys: no row meets one that it does not overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of the tree over the line numbers: nodes of level k are FAN ** k lines wide; together they span every int.
FAN, LEVELS = 4, 16


def cover(low: Column, high: Column) -> Column:
    """The nodes (level, node) of the tree that tile [low, high] exactly, at most 2 (FAN - 1) a level; none where low > high or either is null."""
    low, end = low.cast("long"), high.cast("long") + 1

    def level(k: Column) -> Column:
        width = F.pow(F.lit(FAN), k).cast("long")
        a, b = F.ceil(low / width).cast("long"), F.floor(end / width).cast("long")  # whole nodes inside
        up, down = F.ceil(a / FAN).cast("long") * FAN, F.floor(b / FAN).cast("long") * FAN  # those the next level takes
        run = lambda x, y: F.when(x < y, F.sequence(x, y - 1)).otherwise(F.array().cast("array<bigint>"))
        nodes = F.when(up <= down, F.concat(run(a, up), run(down, b))).otherwise(run(a, b))
        return F.transform(nodes, lambda n: F.struct(k.cast("int").alias("level"), n.alias("node")))

    tiles = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), level))
    return F.when(low < end, tiles).otherwise(F.filter(tiles, lambda _: F.lit(False)))


def path_to_root(point: Column) -> Column:
    """The nodes (level, node) over a point, one a level; none for null."""
    point = point.cast("long")
    nodes = F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: F.struct(k.cast("int").alias("level"), F.floor(point / F.pow(F.lit(FAN), k)).cast("long").alias("node")))
    return F.when(point.isNotNull(), nodes)


def stab(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, low: str, high: str) -> DataFrame:
    """Each point with each interval of equal ``keys`` that holds it, ends included; other columns of both must differ by name.

    An interval is tiled by a few nodes of a tree over the numbers, a point is
    given the nodes over it: a point lies in exactly one tile of an interval
    that holds it, so the join is one of equal keys and its rows are the
    answer, whatever stands in one file. Rows shuffled grow with the inputs by
    the depth of the tree, and the keys of a crowded file are spread.
    """
    p = points.withColumn("_n", F.explode(path_to_root(F.col(point)))).select("*", F.col("_n.level").alias("_level"), F.col("_n.node").alias("_node")).drop("_n")
    i = intervals.withColumn("_n", F.explode(cover(F.col(low), F.col(high)))).select("*", F.col("_n.level").alias("_level"), F.col("_n.node").alias("_node")).drop("_n")
    return p.join(i, [*keys, "_level", "_node"]).drop("_level", "_node")


def overlap(left: DataFrame, right: DataFrame, keys: list[str], left_ends: tuple[str, str], right_ends: tuple[str, str]) -> DataFrame:
    """Each pair of rows of equal ``keys`` whose closed intervals share a number, once: the later of the two begins inside the other."""
    (a, b), (c, d) = left_ends, right_ends
    left, right = left.where(F.col(a) <= F.col(b)), right.where(F.col(c) <= F.col(d))
    starts_in_right = stab(left, right, keys, a, c, d)
    starts_in_left = stab(right, left.withColumn("_after", F.col(a).cast("long") + 1), keys, c, "_after", b).drop("_after")
    return starts_in_right.unionByName(starts_in_left)
