"""Line dedup: drop lines that many documents share, keep one holder."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, materialize

#: Stripped at both ends of a line for its key.
BLANK = " \t\n\v\f\r"


def line_key(line: str, least_chars: int) -> bytes | None:
    """Digest of the normalised line; None for lines too short to count."""
    key = line.strip(BLANK)
    if len(key) < least_chars:
        return None
    return hashlib.md5(key.encode("utf-8", "surrogatepass").lower()).digest()  # bytes.lower() changes A-Z alone


def dedup_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """``docs`` with a struct column ``lines`` (n_lines long, n_dropped long, kept string).

    Normalised lines are exploded and hashed, once a document; documents are
    counted per hash with map-side partial sums, so a line in a third of all
    documents is a few rows per task. Lines of a hash in ``least_docs``
    documents go, except in the largest doc_id that holds it; the rest are
    joined in their order. Each document's hashes to drop come back as one row,
    joined to the text without a hint: Spark broadcasts them only below its own
    measured threshold and shuffles both sides otherwise.

    Null or empty text is one empty line. Every row is a document; rows that
    share a doc_id are counted apart and all keep their lines if it is the
    largest. A null doc_id is smaller than any other. Other columns come back
    as they are, but for one named ``lines``, which is replaced.
    """
    docs = docs.drop("lines")

    def emit():
        def f(texts: list) -> tuple[list, list]:
            rows, keys = [], []
            for i, text in enumerate(texts):
                found = {line_key(x, least_chars) for x in text.split("\n") if len(x) >= least_chars}
                found.discard(None)
                keys.extend(found)
                rows.extend([i] * len(found))
            return rows, [keys]

        return f

    held = materialize(map_texts(docs.where(F.char_length("text") >= least_chars), emit, "key binary"), "lines")
    often = held.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("top")).where(F.col("n") >= least_docs)
    often = materialize(often.select("key", "top"), "often")  # a table of its own, so that the join's hot keys can be split
    drops = (
        held.join(often, "key")
        .where(~F.col("doc_id").eqNullSafe(F.col("top")))
        .groupBy("doc_id")
        .agg(F.collect_set("key").alias("drops"))
    )

    @F.pandas_udf("n_lines long, n_dropped long, kept string")
    def rebuild(text: pd.Series, drop: pd.Series) -> pd.DataFrame:
        out = []
        for t, d in zip(text, drop):
            t = t if isinstance(t, str) else ""
            lines = t.split("\n")
            if d is None or len(d) == 0:
                out.append((len(lines), 0, t))
                continue
            gone = {bytes(x) for x in d}
            kept = [x for x in lines if len(x) < least_chars or line_key(x, least_chars) not in gone]
            out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
        return pd.DataFrame(out, columns=["n_lines", "n_dropped", "kept"])

    both = docs.alias("d").join(drops.alias("x"), F.col("d.doc_id").eqNullSafe(F.col("x.doc_id")), "left")
    return both.select("d.*", rebuild("d.text", "x.drops").alias("lines"))
