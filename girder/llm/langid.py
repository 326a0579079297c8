"""Language identification by bit-sliced Bloom filters of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, map_texts

_MIX = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63]
_CHUNK = 1 << 18
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point whether it is a letter, once a worker."""
    if not _letters:
        table = np.zeros(0x110000, bool)
        table[[i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i).isalpha()]] = True
        _letters.append(table)
    return _letters[0]


def grams(text: str, orders: tuple[int, ...] = (3, 4)) -> Iterator[np.ndarray]:
    """Hashes of the character n-grams of the lower-cased text, letters and word ends only, a bounded part at a time."""
    longest = max(orders)
    low = text.lower()
    for lo in range(0, len(low), _CHUNK):
        part = " " * (lo == 0) + low[max(0, lo - longest + 1 if lo else 0) : lo + _CHUNK] + " "
        c = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where(letters()[np.minimum(c, 0x10FFFF)], c, np.uint32(32)).astype(np.uint64)
        word = c != 32
        for n in orders:
            m = len(c) - n + 1
            if m < 1:
                continue
            h = np.full(m, n, np.uint64)
            inner = np.ones(m, bool)
            for i in range(n):
                h = (h ^ c[i : i + m]) * np.uint64(_MIX[i % len(_MIX)])
                h ^= h >> np.uint64(29)
                if 0 < i < n - 1:
                    inner &= word[i : i + m]
            yield h[inner]


@dataclass
class SlicedBloom:
    """One Bloom filter a language, stored bit-sliced: slot s holds one bit a language, so a look-up answers for all at once."""

    languages: list[str]
    slots: np.ndarray  # (words of 64 languages, slots)
    hashes: int

    @staticmethod
    def places(h: np.ndarray, hashes: int, slots: int) -> list[np.ndarray]:
        step = (h >> np.uint64(32)) | np.uint64(1)
        return [((h + np.uint64(i) * step) % np.uint64(slots)).astype(np.int64) for i in range(hashes)]

    def false_positive(self) -> np.ndarray:
        fill = [((self.slots[i // 64] >> self.slots.dtype.type(i % 64)) & self.slots.dtype.type(1)).mean() for i in range(len(self.languages))]
        return np.array(fill) ** self.hashes

    def predict(self, text: str, orders: tuple[int, ...], fpr: np.ndarray) -> tuple[str, float]:
        size, hits, total = len(self.languages), np.zeros(len(self.languages)), 0
        for h in grams(text, orders):
            total += len(h)
            at = self.places(h, self.hashes, self.slots.shape[1])
            for w, table in enumerate(self.slots):
                mask = table[at[0]]
                for p in at[1:]:
                    mask = mask & table[p]
                for i in range(64 * w, min(size, 64 * w + 64)):
                    hits[i] += np.count_nonzero(mask & table.dtype.type(1 << (i % 64)))
        # of the grams a language lacks, a share fpr is found all the same
        held = np.maximum(0.0, (hits - fpr * total) / np.maximum(1e-9, 1 - fpr))
        if total == 0 or held.max() <= 0:
            return self.languages[0], 0.0
        best = int(held.argmax())
        return self.languages[best], float(held[best] / held.sum())


def train(labelled: DataFrame, orders: tuple[int, ...] = (3, 4), slots: int = 1 << 20, hashes: int = 3, least: int = 4, share: float = 0.5) -> SlicedBloom:
    """Fit on ``labelled`` (text, lang): a gram belongs to each language that uses it at least ``share`` as often as its heaviest user.

    Grams are counted by Spark with partial sums a task; what reaches the
    driver is the filter itself, at most ``slots`` rows.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, own in pdf.groupby("lang")["text"]:
                every = [h for t in own if isinstance(t, str) for h in grams(t, orders)]
                if every:
                    h, n = np.unique(np.concatenate(every), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": h.view(np.int64), "n": n.astype(np.int64)})

    used = labelled.where("lang is not null and text is not null").select("text", "lang")
    counts = used.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return SlicedBloom([], np.zeros((1, slots), np.uint8), hashes)
    rate = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(float(totals[k])))])
    code = F.create_map(*[x for i, k in enumerate(languages) for x in (F.lit(k), F.lit(i))])
    rated = counts.select("gram", "n", code[F.col("lang")].alias("code"), (F.col("n") / rate[F.col("lang")]).alias("rate"))
    owners = (
        rated.groupBy("gram")
        .agg(F.sum("n").alias("n"), F.max("rate").alias("top"), F.collect_list(F.struct("code", "rate")).alias("by"))
        .where(F.col("n") >= least)
        .select("gram", F.explode(F.filter("by", lambda x: x["rate"] >= F.col("top") * share)).alias("x"))
        .select("gram", F.col("x.code").alias("code"))
    )

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p in SlicedBloom.places(pdf["gram"].to_numpy(np.int64).view(np.uint64), hashes, slots):
                yield pd.DataFrame({"slot": p, "code": pdf["code"].to_numpy()})

    bits = owners.mapInPandas(place, "slot long, code int").select(
        "slot", (F.col("code") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, code % 64)").alias("bit")
    )
    table = bits.groupBy("word", "slot").agg(F.bit_or("bit").alias("mask")).toArrow()
    kind = np.uint8 if len(languages) <= 8 else np.uint64
    filled = np.zeros((-(-len(languages) // 64), slots), kind)
    filled[table["word"].to_numpy(), table["slot"].to_numpy()] = table["mask"].to_numpy().view(np.uint64).astype(kind)
    return SlicedBloom(languages, filled, hashes)


def identify(docs: DataFrame, labelled: DataFrame, train_docs: int = 4000, orders: tuple[int, ...] = (3, 4)) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text, by a model fitted on about ``train_docs`` rows of ``labelled`` at most.

    The fit is on a bounded hash sample; prediction reads every text whole, in
    one pass without a shuffle, with a broadcast filter of fixed size. ``score``
    is the winner's share of the corrected counts. Null text or one without a
    letter is ``und`` with score 0, as is every text when nothing is labelled.
    Null ids and repeated rows come back as they are. Extra columns are ignored.
    """
    spark = docs.sparkSession
    sample = bounded_sample(labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang"), F.col("doc_id"), train_docs)
    model = train(sample, orders)
    shared, fpr = spark.sparkContext.broadcast(model), model.false_positive()

    def make():
        m = shared.value

        def f(texts: list) -> tuple[None, list]:
            out = [m.predict(t, orders, fpr) if t and m.languages and any(map(str.isalpha, t)) else ("und", 0.0) for t in texts]
            return None, [[x[0] for x in out], [x[1] for x in out]]

        return f

    return map_texts(docs, make, "lang_pred string, score double")
