"""Shared pieces of the corpus operators: samples, maps over texts, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from girder.scratch import discard, materialize

__all__ = ["bounded_sample", "connected_components", "discard", "held_out", "map_texts", "materialize", "numbered", "read_documents"]

def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the fold crc32(doc_id as text) mod 5 = 0; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def bounded_sample(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """About ``rows`` rows of ``df`` at most, chosen by a hash of ``key`` and of the row's number: rows of one key, as
    of a null one, are drawn apart, and a table read the same way gives the same rows.

    One pass counts the rows, so the bound holds in expectation at every size.
    """
    total = df.count()
    if total <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(7), key, F.monotonically_increasing_id()), F.lit(total)) < rows)


def numbered(df: DataFrame, keys: list[str], name: str, buckets: int = 1024) -> DataFrame:
    """``df`` with a number from 1 among the rows of equal ``keys`` (nulls equal), as column ``name``.

    Rows are written once and dealt to ``buckets`` parts of their key, which
    are numbered apart and then offset, so that no task holds all rows of a key.
    """
    rows = materialize(df.withColumn("_m", F.monotonically_increasing_id()), "numbered").withColumn("_b", F.pmod(F.xxhash64("_m"), F.lit(buckets)))
    sizes = rows.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    own = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_m")))
    same = F.col("l._b") == F.col("r._b")
    for k in keys:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return own.alias("l").join(sizes.alias("r"), same).select(*[F.col(f"l.`{c}`") for c in df.columns], (F.col("_before") + F.col("_rn")).alias(name))


def map_texts(docs: DataFrame, make: Callable[[], Callable], spec: str, with_ids: bool = False) -> DataFrame:
    """Run a function of lists of texts over ``docs``; doc_id passes through Arrow untouched, nulls and all.

    ``make`` is called once a task and returns ``f(texts) -> (rows, columns)``:
    ``columns`` hold the values of ``spec``, ``rows`` the positions of the texts
    they belong to, or None when there is one value a text. ``with_ids``: ``f``
    also gets the ids.
    """
    fields = StructType.fromDDL(spec).fields
    kinds = [to_arrow_type(x.dataType) for x in fields]
    names = ["doc_id", *[x.name for x in fields]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = part.column(1).to_pylist()
                rows, columns = f(texts, part.column(0).to_pylist()) if with_ids else f(texts)
                ids = part.column(0) if rows is None else part.column(0).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, k) for c, k in zip(columns, kinds)]], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {spec}")


def connected_components(edges: DataFrame) -> DataFrame:
    """Component of every vertex of an undirected graph: ``edges`` (a long, b long) -> (v long, root long).

    Alternating large-star and small-star steps (logarithmic rounds in practice).
    Each round is a partial aggregation and one join, so a hub with a third of
    all edges is combined map-side and its join is split by adaptive execution.
    ``root`` is the smallest vertex of the component. Self loops and repeated
    edges are allowed; an empty graph gives an empty result.
    """
    cur = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("p")).distinct(), "cc"
    )
    before = None
    while True:
        both = cur.select(F.col("u").alias("v"), F.col("p").alias("n")).unionByName(
            cur.select(F.col("p").alias("v"), F.col("u").alias("n"))
        )
        low = both.groupBy("v").agg(F.min("n").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = (
            both.where("n > v").join(low, "v").select(F.col("n").alias("u"), F.col("m").alias("p")).where("u <> p").distinct()
        )
        down = large.groupBy("u").agg(F.min("p").alias("m"))
        small = (
            large.join(down, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("p")), F.struct(F.col("p").alias("u"), F.col("m").alias("p")))).alias("e"))
            .select("e.u", "e.p")
            .where("u <> p")
            .distinct()
        )
        last, cur = cur, materialize(small, "cc")
        discard(last)
        mark = tuple(
            cur.agg(F.count("*"), F.sum(F.xxhash64("u", "p").cast("decimal(38,0)")), F.countDistinct("u")).first()
        )
        # every vertex but the roots has exactly one parent and nothing moved: the forest is flat
        if mark == before:
            break
        before = mark
    roots = cur.select(F.col("p").alias("v")).distinct().select("v", F.col("v").alias("root"))
    return cur.select(F.col("u").alias("v"), F.col("p").alias("root")).unionByName(roots).groupBy("v").agg(F.min("root").alias("root"))
