"""Document fingerprints by I-Match over randomised subsets of an idf band's lexicon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: The idf band: terms in at most this share of all documents, up to the idf of a term in one document. What lies
#: outside is bounded whatever the corpus: at most a document's mean count of terms, divided by the share.
MOST_SHARE = 0.1
#: Lexicon subsets by a term's hash: (bits that a subset fixes beyond the first three, where they start, subsets used per
#: value of the first three). 128 of 1/128 of the lexicon each, 64 of 1/1024, 32 of 1/8192: sparse subsets for long texts.
LEVELS = ((4, 3, 16), (7, 7, 8), (10, 14, 4))


def term_list(text: Column) -> Column:
    """Distinct lower-cased terms of a text as 64-bit hashes: runs of letters and digits."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))


def id_range(cuts: list[int]) -> Column:
    """Number of the id range, 0 for the largest ids: how many of the descending ``cuts`` lie above doc_id. Two look-ups over short arrays."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    above = lambda xs: F.size(F.filter(xs, lambda e: e > F.col("doc_id")))
    array = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")
    # blocks whose last cut lies above count whole
    whole = above(array([x[-1] for x in blocks]))
    inner = F.element_at(F.array(*[array(x) for x in [*blocks, blocks[-1][-1:]]]), whole + 1)
    return F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).when(whole >= len(blocks), F.lit(len(cuts))).otherwise(whole * step + above(inner))


def with_next(docs: DataFrame, per_range: int = 2000, most_ranges: int = 20_000) -> DataFrame:
    """Pair each document with the next by descending doc_id (after the last: the first): adds rn, next_id, next_text.

    Documents are dealt to ranges (``bucket``) of about ``per_range`` rows, or
    of a ``most_ranges``-th of the table if that is more: this bounds the cut
    points that a plan holds, and sets how many tasks may share the work, not
    what they do. An id that fills more than a range, null among them, is split
    by its texts' hashes, and a text repeated more often than that under one id
    by row number. Each range also gets a copy of the following range's first
    document, which ends its line and is dropped after ``lead`` has seen it. No
    window spans the table and text is shuffled once. A null doc_id is smaller
    than any. Rows of one id come in an order of their own: the often repeated
    texts first, then by the text's hash.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keys = docs.select("doc_id", F.xxhash64("text").alias("h"))
    keys = materialize(keys.groupBy("doc_id", "h").agg(F.count("*").alias("n")), "ids")  # no texts
    total = keys.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranges = max(1, min(most_ranges, total // per_range))
    room = max(per_range, -(-total // ranges))
    cuts = keys.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)] or [0.5], 10 * ranges)).first()[0] or []
    # ids, and texts of an id, that fill more than a range: at most ``most_ranges`` rows each, hence broadcast
    parts = lambda n: F.ceil(n / room).cast("long")
    hot_ids = keys.groupBy("doc_id").agg(F.sum("n").alias("n")).where(F.col("n") > room).select("doc_id", parts(F.col("n")).alias("id_parts"), F.lit(1).alias("hot"))
    hot_texts = keys.where(F.col("n") > room).select("doc_id", "h", parts(F.col("n")).alias("text_parts"))
    rows = docs.withColumns({"h": F.xxhash64("text"), "t": F.xxhash64(F.monotonically_increasing_id())})
    by_id = F.col("d.doc_id").eqNullSafe(F.col("i.doc_id"))
    rows = rows.alias("d").join(F.broadcast(hot_ids).alias("i"), by_id, "left").select("d.*", "id_parts", "hot")
    by_text = F.col("d.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("d.h") == F.col("x.h"))
    rows = rows.alias("d").join(F.broadcast(hot_texts).alias("x"), by_text, "left").select("d.*", "text_parts")
    slot = lambda h, n: F.floor((F.shiftright(h, 32) + F.lit(1 << 31)) * n / F.lit(1 << 32)).cast("long")  # noqa: E731  order-preserving
    # (range, class, part, part): buckets in the order of their rows; a hot id is a cut, so the last of its range
    kind = F.when(F.col("hot").isNull(), 0).when(F.col("text_parts").isNotNull(), 1).otherwise(2)
    part = F.when(kind == 1, F.col("h")).when(kind == 2, slot(F.col("h"), F.col("id_parts"))).otherwise(F.lit(0).cast("long"))
    last = F.when(kind == 1, slot(F.col("t"), F.col("text_parts"))).otherwise(F.lit(0).cast("long"))
    hot = [x["doc_id"] for x in hot_ids.where("doc_id is not null").select("doc_id").collect()]
    bucket = F.struct(id_range(sorted({*map(int, cuts), *hot}, reverse=True)).alias("range"), kind.alias("kind"), part.alias("part"), last.alias("last"))
    rows = rows.select("doc_id", "text", "h", "t", bucket.alias("bucket"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), (-F.col("doc_id")).alias("neg"), "h", "t")).alias("top")
    tops = materialize(rows.groupBy("bucket").agg(first), "tops")  # a row a range
    ring, every = Window.partitionBy(F.lit(0)).orderBy(F.desc("bucket")), Window.partitionBy(F.lit(0))
    tops = tops.select(
        "bucket", (-F.col("top.neg")).alias("doc_id"), F.col("top.h").alias("h"), F.col("top.t").alias("t"),
        F.coalesce(F.lead("bucket").over(ring), F.max("bucket").over(every)).alias("ends"),
    )
    same = (F.col("d.bucket") == F.col("t.bucket")) & F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("d.h") == F.col("t.h")) & (F.col("d.t") == F.col("t.t"))
    rows = rows.alias("d").join(F.broadcast(tops).alias("t"), same, "left")
    place = lambda b, helper: F.struct(b.alias("bucket"), F.lit(helper).alias("helper"))
    own = F.array(place(F.col("d.bucket"), False))
    to = F.when(F.col("t.ends").isNull(), own).otherwise(F.array(place(F.col("d.bucket"), False), place(F.col("t.ends"), True)))
    rows = rows.select("d.doc_id", "d.text", "d.h", "d.t", F.explode(to).alias("at")).select("doc_id", "text", "h", "t", "at.*")
    line = Window.partitionBy("bucket").orderBy("helper", F.desc_nulls_last("doc_id"), "h", "t")
    rows = rows.withColumns({"rn": F.row_number().over(line), "next_id": F.lead("doc_id").over(line), "next_text": F.lead("text").over(line)})
    return rows.where(~F.col("helper")).drop("helper", "t")


def outside_band(docs: DataFrame, most_share: float = MOST_SHARE) -> list[int]:
    """Terms too frequent for the band, from document frequencies over all documents."""
    n = docs.count()
    found = docs.select(F.explode(term_list(F.coalesce("text", F.lit("")))).alias("term"))
    often = found.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") > max(1.0, most_share * n))
    return sorted(r["term"] for r in often.select("term").collect())


def _eighth(terms: Column, value: int) -> Column:
    return F.filter(terms, lambda t: t.bitwiseAND(F.lit(7)) == value)


def _subset(terms: Column, shift: int, bits: int, value: int) -> Column:
    return F.filter(terms, lambda t: F.shiftright(t, shift).bitwiseAND(F.lit((1 << bits) - 1)) == value)


def subset_hashes(eighths: list[str]) -> Column:
    """A byte a subset, from the hash of its sorted terms, 0 if it has none; seven in a number. ``eighths``: columns of the terms by the first three bits.

    Spark hashes an empty array to its seed, 42, which the exclusive or turns
    into 0.
    """
    cells = []
    for name in eighths:
        for bits, shift, used in LEVELS:
            cells += [F.xxhash64(_subset(F.col(name), shift, bits, k)).bitwiseXOR(F.lit(42)).bitwiseAND(F.lit(255)) for k in range(used)]
    words = []
    for i in range(0, len(cells), 7):
        word = cells[i]
        for cell in cells[i + 1 : i + 7]:
            word = F.shiftleft(word, 8).bitwiseOR(cell)
        words.append(word)
    return F.array(*words)


def text_form(words: Column) -> Column:
    """Fourteen hex digits a number."""
    return F.lower(F.array_join(F.transform(words, lambda w: F.lpad(F.hex(w), 14, "0")), ""))


def _zero_bytes(v: Column) -> Column:
    """How many of a number's seven lower bytes are zero; the top one is unused, which keeps the sum from overflowing."""
    low = F.lit(0x007F7F7F7F7F7F7F)
    return F.bit_count(F.bitwise_not((v.bitwiseAND(low) + low).bitwiseOR(v).bitwiseOR(low)).bitwiseAND(F.lit(0x0080808080808080)))


def likeness(a: Column, b: Column) -> Column:
    """Share of the subsets, but those empty on both sides, whose hashes agree; 0 to 1."""
    pairs = F.arrays_zip(a.alias("x"), b.alias("y"))
    both = F.aggregate(pairs, F.lit(0), lambda n, p: n + _zero_bytes(p["x"].bitwiseOR(p["y"])))
    same = F.aggregate(pairs, F.lit(0), lambda n, p: n + _zero_bytes(p["x"].bitwiseXOR(p["y"])))
    used = 7 * F.size(a) - both
    return F.when(used == 0, 1.0).otherwise((same - both) / used)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last half is the next document's beginning.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next). A fingerprint hashes the sorted distinct terms
    within the idf band, once for each of several random subsets of the
    lexicon. Text is shuffled once; the fingerprints are made where it lands.
    Equal texts have equal fingerprints; a text without a term in the band
    stands for itself and is like none but its equals. Null text is empty; null
    ids and repeated rows are documents; an empty table gives no rows; a single
    document is its own next. Extra columns are ignored.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    often = outside_band(docs)

    def band(text: Column) -> Column:
        found = term_list(text)
        kept = F.filter(found, lambda t: ~t.isin(often)) if often else found
        return F.sort_array(kept)

    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = with_next(docs).withColumn("edited", edited)
    rows = rows.select(
        "doc_id", "next_id", n.cast("long").alias("n_chars"), "h", F.xxhash64("next_text").alias("next_h"), F.xxhash64("edited").alias("edited_h"),
        F.sha2("edited", 256).alias("edited_sha256"), band(F.col("text")).alias("own"), band(F.col("edited")).alias("edit"),
    )
    whole = lambda c, h: F.when(F.size(c) == 0, F.array(h)).otherwise(F.col(c))
    rows = rows.withColumns({"own": whole("own", "h"), "edit": whole("edit", "edited_h")})
    names = [(f"own{i}", f"edit{i}") for i in range(8)]
    parts = [_eighth(F.col(c[:-1]), int(c[-1])).alias(c) for pair in names for c in pair]
    rows = rows.select("doc_id", "next_id", "n_chars", "h", "next_h", "edited_sha256", *parts)
    full = materialize(
        rows.select(
            "doc_id", "next_id", "n_chars", "h", "next_h", "edited_sha256",
            subset_hashes([x for x, _ in names]).alias("fingerprint"), subset_hashes([y for _, y in names]).alias("edited_fingerprint"),
        ),
        "fingerprints",
    )
    # the next document's fingerprint; rows that repeat another's id and text have the same one
    others = full.groupBy(F.col("doc_id").alias("id"), F.col("h").alias("other_h")).agg(F.first("fingerprint").alias("other"))
    out = full.join(others, F.col("next_id").eqNullSafe(F.col("id")) & (F.col("next_h") == F.col("other_h")))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", text_form(F.col("fingerprint")).alias("fingerprint"), text_form(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("other")).alias("near_next"),
    )
