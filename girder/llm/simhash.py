"""SimHash near-dedup by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, map_texts, materialize

_SPACES = bytes.maketrans(b"\t\n\v\f\r", b"     ")
#: Shingle hashes counted at a time, so that a very long text stays small.
_CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """64 bits; a bit is set if it is set in over half of the shingles' XXH64. No words: 0."""
    import xxhash

    if not text:
        return 0
    parts = text.encode("utf-8", "surrogatepass").lower().translate(_SPACES).split()  # bytes.lower() changes A-Z alone
    if not parts:
        return 0
    digest, n = xxhash.xxh64_intdigest, max(1, len(parts) - words + 1)
    counts = np.zeros(64, np.int64)
    for lo in range(0, n, _CHUNK):
        hashes = [digest(b" ".join(parts[i : i + words]), seed) for i in range(lo, min(n, lo + _CHUNK))]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in range(64) if 2 * counts[i] > n)


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp long): the unsigned fingerprint's bits as a signed long."""

    def make():
        return lambda texts: (None, [np.array([fingerprint(t, words, seed) for t in texts], np.uint64).view(np.int64)])

    return map_texts(docs, make, "fp long")


def _ball(bits: list[int], radius: int) -> np.ndarray:
    """Masks of up to ``radius`` flips among ``bits``, none first."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(bits, r)], np.uint64)


def _slice_of(v: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(v.shape, np.int64)
    for i, b in enumerate(bits):
        out |= ((v >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << i
    return out


def ball_links(fps: DataFrame, radius: int = 4, per_slice: int = 2_000_000) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints ``fp`` within ``radius`` bits into their components.

    Two fingerprints within the radius share a variant half the radius from
    either. Variants are dealt by a few of their bits: a fingerprint is sent
    once to every slice that its variants reach, and the slice's task writes
    out just the variants that fall there, which keeps the shuffle at tens of
    rows a fingerprint instead of thousands. In a slice, equal variants meet by
    sorting; all of a bucket link to its smallest fingerprint after a check of
    the distance. Bucket mates are within the radius of each other, so that no
    pair's link is lost though a large group is never written out as pairs. Of
    a slice's links only a forest leaves the task.
    """
    if radius % 2:
        raise ValueError("the radius must be even: variants half of it away meet in the middle")
    half = radius // 2
    n = fps.count()
    variants = len(_ball(list(range(64)), half))
    width = min(64, max(3, int(np.ceil(np.log2(max(1, n * variants / per_slice))))))
    bits = np.random.default_rng(5).permutation(64).tolist()
    keyed = bits[:width]
    near = _ball(keyed, half)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = pdf["fp"].to_numpy(np.int64).view(np.uint64)
            for lo in range(0, len(fp), 20_000):
                part = fp[lo : lo + 20_000]
                to = _slice_of(part[:, None] ^ near[None, :], keyed)
                yield pd.DataFrame({"slice": to.ravel(), "fp": np.repeat(part, len(near)).view(np.int64)})

    def pairs(fp: np.ndarray, keyed: list[int], want: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links of a slice's fingerprints as positions, each variant bucket's to its smallest; a dense slice is cut by more bits, so that memory stays bounded."""
        own = _slice_of(fp, keyed) ^ want
        reach = np.array([bin(int(x) & 0xFFFFFFFFFFFFFFFF).count("1") for x in own], np.int64) if len(fp) else own
        fp_at = np.flatnonzero(reach <= half)
        free = [b for b in bits if b not in keyed]
        if len(fp_at) * len(free) ** half > 4 * per_slice * half and len(free) > 8:  # thousands of fingerprints, at the usual slice size
            more = keyed + free[:4]
            for v in range(16):
                for a, b in pairs(fp[fp_at], more, want | v << len(keyed)):
                    yield fp_at[a], fp_at[b]
            return
        inner = {r: _ball(free, half - r) for r in range(half + 1)}
        apart = np.zeros(len(fp), np.int64)
        fixed = np.zeros(len(fp), np.uint64)
        for i, b in enumerate(keyed):
            bit = (own >> i) & 1
            apart += bit
            fixed |= bit.astype(np.uint64) << np.uint64(b)
        made, of = [], []
        for r, masks in inner.items():
            at = fp_at[apart[fp_at] == r]
            made.append(((fp[at] ^ fixed[at])[:, None] ^ masks[None, :]).ravel())
            of.append(np.repeat(at, len(masks)))
        v, o = np.concatenate(made), np.concatenate(of)
        if not len(v):
            return
        order = np.argsort(v, kind="stable")
        v, o = v[order], o[order]
        start = np.r_[True, v[1:] != v[:-1]]
        group = np.cumsum(start) - 1
        low = np.minimum.reduceat(o, np.flatnonzero(start)) if len(o) else o
        a, b = low[group], o
        keep = a != b
        a, b = a[keep], b[keep]
        if len(a):
            pair = np.unique(a.astype(np.int64) * len(fp) + b)
            a, b = pair // len(fp), pair % len(fp)
            sound = np.bitwise_count(fp[a] ^ fp[b]) <= radius
            a, b = a[sound], b[sound]
        yield a, b

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fp = np.unique(pdf["fp"].to_numpy(np.int64).view(np.uint64))
        root = np.arange(len(fp))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in pairs(fp, keyed, int(key[0])):
            for x, y in zip(a.tolist(), b.tolist()):
                p, q = find(x), find(y)
                if p != q:
                    root[max(p, q)] = min(p, q)
        moved = [(i, find(i)) for i in range(len(fp)) if root[i] != i]
        ends = np.array(moved, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": fp[ends[:, 0]].view(np.int64), "b": fp[ends[:, 1]].view(np.int64)})

    dealt = fps.select("fp").mapInPandas(deal, "slice long, fp long")
    return dealt.groupBy("slice").applyInPandas(meet, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """(doc_id, fp long, component_id long): documents whose fingerprints chain within ``radius`` bits.

    Equal fingerprints are one vertex with its smallest doc_id, so exact
    copies, however many, cost one row each. A null, empty or blank text has
    fingerprint zero and links like any other. A null doc_id takes part; the
    component's id is the smallest non-null one (null if there is none).
    Repeated rows come back repeated. An empty table gives no rows. Extra
    columns are ignored.
    """
    rows = materialize(fingerprints(docs, words, seed), "fingerprints")
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    roots = connected_components(ball_links(classes, radius))
    placed = classes.join(roots, F.col("fp") == F.col("v"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = materialize(placed.join(least, "root").select("fp", "component_id"), "components")
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, words: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """``docs`` with one row of each near-duplicate group; same columns.

    The row stays that has the group's smallest non-null doc_id, and of several
    with it the one of the smallest text hash. Rows are told apart by a number
    written beside them, not by doc_id, which may be null or repeated.
    """

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words, seed) for t in texts], np.uint64).view(np.int64))

    whole = F.struct(*docs.columns).alias("doc")  # apart, so that no column's name can clash
    held = docs.select(fp(F.col("text").cast("string")).alias("fp"), F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("hash"), whole)
    held = materialize(held, "marked")
    first = F.min(F.struct(F.col("doc.doc_id").isNull().alias("none"), F.col("doc.doc_id").alias("id"), "hash", "row"))
    classes = materialize(held.groupBy("fp").agg(first.alias("first")), "classes")
    roots = connected_components(ball_links(classes, radius))
    placed = classes.join(roots, F.col("fp") == F.col("v"), "left").select("first", F.coalesce("root", "fp").alias("root"))
    kept = placed.groupBy("root").agg(F.min("first").alias("first")).select("first.row")
    return held.join(kept, "row", "left_semi").select("doc.*")
