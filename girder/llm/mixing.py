"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, numbered

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def row_hash(seed: int = 42) -> Column:
    """Seeded hash of a document's id and text."""
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))


def sainte_lague(df: DataFrame, group: list[str], weight: str, seats: str, order: list[str]) -> DataFrame:
    """Give each group's ``seats`` to its rows by the highest quotients weight / (2 j + 1); adds ``quota``.

    Every final quota lies between the roundings of weight / d for two divisors
    d known beforehand, so only about three quotients a row are ranked instead
    of one a seat. ``order`` names the columns that tell rows of a group apart
    and break ties; they must not be null.
    """
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    out = df.withColumn("_all", F.sum(weight).over(w)).withColumn("_n", F.sum((F.col(weight) > 0).cast("long")).over(w))
    share = F.col(weight) / F.col("_all")
    low = F.when(
        (F.col("_all") > 0) & (F.col(seats) * 2 > F.col("_n")), F.floor(share * (F.col(seats) - F.col("_n") / 2) + 0.5) - 1
    ).otherwise(0)
    high = F.when(F.col("_all") > 0, F.floor(share * (F.col(seats) + F.col("_n") / 2) + 0.5) + 1).otherwise(0)
    out = out.withColumn("_low", F.greatest(low, F.lit(0)).cast("long")).withColumn("_high", F.greatest(high, F.lit(1)).cast("long"))
    out = out.withColumn("_left", F.col(seats) - F.sum("_low").over(w))
    tries = out.select(
        *group, *order, weight, "_left", F.explode(F.sequence("_low", F.greatest("_low", F.col("_high") - 1))).alias("_j")
    ).withColumn("_q", F.col(weight) / (2 * F.col("_j") + 1))
    rank = F.row_number().over(w.orderBy(F.desc("_q"), *order))
    won = (
        tries.withColumn("_rank", rank)
        .groupBy(*group, *order)
        .agg(F.sum(((F.col("_rank") <= F.col("_left")) & (F.col(weight) > 0)).cast("long")).alias("_won"))
    )
    both = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*group, *order]]
    cond = both[0]
    for c in both[1:]:
        cond = cond & c
    return (
        out.alias("l")
        .join(won.alias("r"), cond)
        .select(*[F.col(f"l.{c}") for c in df.columns], (F.col("l._low") + F.col("r._won")).alias("quota"))
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Targets of the sources: (source, source_size, n_docs, rank, target).

    Sources by code point, null last, weigh ``weights`` repeating and share all
    words; a target stops at ``most`` times its source's size and the excess is
    reshared by weight until none is above (closed form: in the order of
    cap / weight the capped sources come first). The table has one row a source
    of the mix: it is the mix's own specification, hence the unpartitioned windows.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    one = Window.partitionBy(F.lit(0))
    src = src.withColumn("rank", F.row_number().over(one.orderBy(F.asc_nulls_last("source"))))
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    src = src.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * float(most))
    src = src.withColumn("_all", F.sum("source_size").over(one)).withColumn("_r", F.col("_cap") / F.col("_w"))
    line = one.orderBy("_r", "rank")
    before = F.coalesce(F.sum("_cap").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_w").over(line.rowsBetween(0, Window.unboundedFollowing))
    src = src.withColumn("_lam", (F.col("_all") - before) / rest)
    src = src.withColumn("_first", F.min(F.when(F.col("_r") >= F.col("_lam"), F.struct("_r", "rank", "_lam"))).over(one))
    target = F.when(F.col("_all") > 0, F.least("_cap", F.coalesce(F.col("_first._lam") * F.col("_w"), F.col("_cap")))).otherwise(0.0)
    return src.select("source", "source_size", "n_docs", "rank", target.alias("target"))


def mix(docs: DataFrame, block: int = 8, shard_docs: int = 500, most: int = 3, seed: int = 42) -> DataFrame:
    """How many words of each document the mix takes: (doc_id, source, size, source_size, target, taken, h), h a hash of id and text.

    All words are cut into equal blocks of ``block`` words; Sainte-Lague gives
    each source whole blocks, then each part of a source its quota of them, then
    each shard of a part: no apportionment ranks more than about the square root
    of a source's shards. A shard lines its documents
    up in seeded order and takes its leading blocks, whole rounds first when
    the quota exceeds the shard. Taken words of a source are within a block a
    shard of the target; no document gives more than ``most`` times its size.

    A source's shards grow in number with its documents, so a source with a
    third of all rows is spread; each shard is one spillable window group of
    a few numbers a row. Documents are dealt to shards by their id and text,
    many equal ones by their row's number too, so a repeated or null id is
    spread as well. Null text has size 0 and gives nothing; null doc_id is
    a document like any other; repeated rows are separate documents; an empty
    table gives an empty result. Extra columns are ignored. Reruns agree.
    """
    sizes = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_hash(seed).alias("h"))
    sizes = materialize(sizes.withColumn("mid", F.monotonically_increasing_id()), "sizes")
    many = sizes.groupBy("h").agg(F.count("*").alias("rows")).where(F.col("rows") > shard_docs // 10)
    sizes = sizes.join(many, "h", "left").withColumn("deal", F.when(F.col("rows").isNull(), F.col("h")).otherwise(F.xxhash64("h", "mid"))).drop("rows")
    src = source_targets(sizes, most=most)
    one = Window.partitionBy(F.lit(0))
    src = src.withColumn("seats", F.round(F.sum("source_size").over(one) / block).cast("long"))
    src = sainte_lague(src, [], "target", "seats", ["rank"])
    src = src.withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / shard_docs)).cast("long"))
    src = src.withColumn("n_parts", F.ceil(F.sqrt("n_shards")).cast("long"))
    src = materialize(src.select("source", "source_size", "target", "rank", "n_shards", "n_parts", F.col("quota").alias("blocks")), "sources")
    rows = sizes.alias("d").join(src.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    shard = F.pmod("d.deal", "s.n_shards")
    rows = rows.select("d.*", "s.rank", "s.source_size", "s.target", (shard % F.col("s.n_parts")).alias("part"), shard.alias("shard"))
    shards = materialize(rows.groupBy("rank", "part", "shard").agg(F.sum("size").alias("words")), "shards")
    parts = shards.groupBy("rank", "part").agg(F.sum("words").alias("words")).join(src.select("rank", "blocks"), "rank")
    parts = sainte_lague(parts, ["rank"], "words", "blocks", ["part"]).select("rank", "part", F.col("quota").alias("blocks"))
    shards = sainte_lague(shards.join(parts, ["rank", "part"]), ["rank", "part"], "words", "blocks", ["shard"])
    shards = shards.select("rank", "shard", "words", F.least(F.col("quota") * block, F.col("words") * most).alias("take"))
    line = Window.partitionBy("rank", "shard").orderBy("h", "mid").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("size").over(line), F.lit(0))).join(shards, ["rank", "shard"])
    rounds = F.when(F.col("words") > 0, F.floor(F.col("take") / F.col("words"))).otherwise(0).cast("long")
    rest = F.col("take") - rounds * F.col("words")
    taken = rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "h")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents as the mix has them: whole copies first, then one leading part of the words left; same columns as ``docs``.

    Documents of which nothing is taken are absent. A part is the document's
    first words joined by single spaces. ``n_chars`` is set anew. Rows meet
    their shares by id, source, size and text; rows equal in all of these share
    theirs evenly, the remainder a word each to the first of them, so that no
    word is lost.
    """
    whole_row = F.struct(*docs.columns).alias("doc")  # apart, so that no column's name can clash
    keys = ["doc_id", "source", "size", "h"]
    taken = materialize(mix(docs).groupBy(*keys).agg(F.sum("taken").alias("all"), F.count("*").alias("rows")).where(F.col("all") > 0), "taken")
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_hash().alias("h"), whole_row)
    same = lambda a, b: reduce(Column.__and__, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])
    met = lambda part: rows.alias("d").join(part.alias("m"), same("d", "m")).select("d.*", "m.all", "m.rows")
    alone = met(taken.where("rows = 1")).select("doc", "size", F.col("all").alias("taken"))
    equal = numbered(met(taken.where("rows > 1")), keys, "place")
    share = F.floor(F.col("all") / F.col("rows")) + (F.col("place") <= F.col("all") % F.col("rows")).cast("long")
    out = alone.unionByName(equal.select("doc", "size", share.alias("taken"))).where("taken > 0")
    whole = F.floor(F.col("taken") / F.col("size"))
    rest = F.col("taken") - whole * F.col("size")
    words = F.filter(F.split("doc.text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    part = F.array_join(F.slice(words, F.lit(1), rest.cast("int")), " ")
    copies = F.when(whole > 0, F.array_repeat(F.col("doc.text"), whole.cast("int"))).otherwise(F.array().cast("array<string>"))
    texts = F.concat(copies, F.when(rest > 0, F.array(part)).otherwise(F.array().cast("array<string>")))
    out = out.select("doc", F.explode(texts).alias("taken_text"))
    new = {"text": F.col("taken_text"), "n_chars": F.char_length("taken_text").cast("long")}
    return out.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
