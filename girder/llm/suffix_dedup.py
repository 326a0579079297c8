"""Suffix-array dedup: repeated byte strings across documents, by a distributed merge sort of sampled suffixes.

Every string of LEAST bytes holds a sampled position (the smallest of its
K-gram hashes), the same in all its occurrences. So the suffixes at sampled
positions whose K-gram another text has too, each with the bytes just before
it, decide the matter. They are sorted in runs, exchanged front-coded in two
levels of key ranges, within the first of which they become runs anew, and merged by loser trees that carry the length of the
known common prefix. Suffixes of one K-gram stay together; the few K-grams too
frequent for one group are first collapsed to their distinct contexts and then
compared string by string.

There is one plan at every size: what is found is answered by shuffles on
hashes, no filter is broadcast, and the driver sees only the coarse bounds,
about the square root of the number of ranges.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

LEAST = 50
K = 25
SPAN = LEAST - K + 1  # K-grams of a string
KEY = LEAST + K + 2  # right context, reversed left context, their lengths
#: Bytes of text hashed at a time, so few that the arrays made of them stay in a core's cache; suffixes of a run; suffixes of a key range.
CHUNK, RUN, RANGE = 1 << 16, 120_000, 100_000
#: Sampled positions counted at a time, which bounds a worker's memory whatever a batch holds.
COUNTED = 1 << 18
#: Occurrences of a K-gram, more than a whole range, above which its suffixes are collapsed to distinct contexts and compared string by string.
HOT = RANGE
#: Coarse key ranges at least, so that small inputs spread over tasks too; sampled keys a range.
COARSE, SAMPLED = 32, 20
NO_ID = np.iinfo(np.int64).min  # a null doc_id: smaller than any
FAR = np.iinfo(np.int64).max

_rng = np.random.default_rng(2024)
_GRAM = _rng.integers(1, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_APART = np.uint64(0x9E3779B97F4A7C15)


def _rolling(x: np.ndarray) -> np.ndarray:
    """32-bit hash of the K bytes from each position, by doubling."""
    base = 0x9E3779B1
    power = lambda n: np.uint32(pow(base, n, 1 << 32))

    def joined(a: np.ndarray, b: np.ndarray, nb: int, na: int) -> np.ndarray:
        m = len(x) - na - nb + 1
        return a[:m] * power(nb) + b[na : na + m]

    one = x.astype(np.uint32) + np.uint32(1)
    two = joined(one, one, 1, 1)
    four = joined(two, two, 2, 2)
    eight = joined(four, four, 4, 4)
    sixteen = joined(eight, eight, 8, 8)
    h = joined(joined(sixteen, eight, 8, 16), one, 1, 24)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    return h


def anchors(buf: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sampled positions of documents laid end to end in ``buf``; ``ends`` are their ends."""
    if len(buf) < LEAST:
        return np.zeros(0, np.int64)
    h = _rolling(buf)
    v = h.astype(np.uint64)
    v <<= np.uint64(32)
    v |= np.arange(len(h), dtype=np.uint64)
    for step in (1, 2, 4, 8):
        v = np.minimum(v[:-step], v[step:])
    n = len(buf) - LEAST + 1
    at = np.minimum(v[:n], v[SPAN - 16 : SPAN - 16 + n]).astype(np.uint32)
    # a window counts if its place is not the last one's, or it is its document's first; the last LEAST - 1 of a document reach beyond it
    new = np.empty(n, bool)
    np.not_equal(at[1:], at[:-1], out=new[1:])
    for places, counts in ((np.r_[0, ends[:-1]], True), ((ends[:, None] - np.arange(1, LEAST)).ravel(), False)):
        new[places[(places >= 0) & (places < n)]] = counts
    return at[new].astype(np.int64)


def gram_hashes(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for i in range(K):
        out += (buf[at + i].astype(np.uint64) + np.uint64(1)) * _GRAM[i]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return (out ^ (out >> np.uint64(29))).view(np.int64)


def contexts(buf: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Keys of suffixes: LEAST bytes on, K bytes back in reverse, zero-padded at the document's ends, and both lengths."""
    right, left = np.minimum(LEAST, last - at), np.minimum(K, at - first)
    wide = np.concatenate([np.zeros(K, np.uint8), buf, np.zeros(LEAST, np.uint8)])
    around = np.lib.stride_tricks.sliding_window_view(wide, K + LEAST)[at]
    out = np.empty((len(at), KEY), np.uint8)
    out[:, :LEAST], out[:, LEAST : LEAST + K] = around[:, K:], around[:, :K][:, ::-1]
    for lo, size, most in ((0, right, LEAST), (LEAST, left, K)):
        short = np.flatnonzero(size < most)
        out[short, lo : lo + most] *= np.arange(most) < size[short, None]
    out[:, KEY - 2], out[:, KEY - 1] = right, left
    return out


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(buffer, document starts, ends, row numbers, first byte's place in its text, batch columns but the text) of about CHUNK bytes.

    A longer text comes in pieces that overlap by a key's reach, so that memory
    stays bounded whatever a text's length. Row numbers are those of the batch.
    """
    piece, lap = 8 * CHUNK, 2 * (LEAST + K)

    def lay(held: list[tuple]) -> tuple:
        sizes = np.array([len(x[0]) for x in held], np.int64)
        ends = np.cumsum(sizes)
        buf = np.frombuffer(b"".join(x[0] for x in held), np.uint8)
        return buf, ends - sizes, ends, np.array([x[1] for x in held], np.int64), np.array([x[2] for x in held], np.int64)

    for batch in batches:
        held: list[tuple] = []
        size = 0
        for row, text in enumerate(batch.column(0)):
            data = text.as_py().encode("utf-8", "surrogatepass")
            for lo in range(0, max(1, len(data) - lap), piece):
                held.append((data[lo : lo + piece + lap], row, lo))
                size += len(held[-1][0])
                if size >= CHUNK:
                    yield (*lay(held), batch)
                    held, size = [], 0
        if held:
            yield (*lay(held), batch)


def sampled_grams(texts: DataFrame) -> DataFrame:
    """(t, h): hashes of the sampled K-grams of each text, once each, from ``texts`` (text, t: its hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for buf, _, ends, rows, _, batch in chunks(batches):
            at = anchors(buf, ends)
            h, doc = gram_hashes(buf, at), np.searchsorted(ends, at, side="right")
            order = np.argsort(h.view(np.uint64) + doc.astype(np.uint64) * _APART)  # equal pairs side by side
            h, doc = h[order], doc[order]
            first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, np.int64)
            t = batch.column(1).to_numpy()[rows[doc[first]]]
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(h[first])], ["t", "h"])

    return texts.select("text", "t").mapInArrow(run, "t long, h long")


def gram_counts(texts: DataFrame) -> DataFrame:
    """(h, n, c): the same hashes with the number of texts that hold each and of its occurrences, a row for each hash of
    about COUNTED positions: a frequent one shrinks before it is shuffled, and the rest, which are distinct, cost no hash table."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        h, row = np.concatenate(held, axis=1)
        order = np.argsort(h, kind="stable")  # rows ascend already
        h, row = h[order], row[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])].astype(np.int64) if len(h) else np.zeros(0, np.int64)
        n = np.add.reduceat(new, first) if len(h) else new
        return pa.RecordBatch.from_arrays([pa.array(h[first]), pa.array(n), pa.array(np.diff(np.r_[first, len(h)]))], ["h", "n", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size, last = [], 0, -1
            for buf, _, ends, rows, _, _ in chunks([batch]):
                if size >= COUNTED and rows[0] != last:  # a text's pieces are counted together
                    yield counted(held)
                    held, size = [], 0
                at = anchors(buf, ends)
                held.append(np.stack([gram_hashes(buf, at), rows[np.searchsorted(ends, at, side="right")]]))
                size, last = size + len(at), rows[-1]
            if held:
                yield counted(held)

    return texts.select("text").mapInArrow(run, "h long, n long, c long")


def shared_grams(texts: DataFrame) -> DataFrame:
    """(t, grams, hots): each text's sampled K-grams that another text (or row) holds, the rarer and the hot ones apart.

    Counting aggregates within a part of a batch, then by the hash; the answer goes back by a join on the
    hash, whose hot keys adaptive execution splits, and comes as one row a
    distinct text, bounded by the text itself.
    """
    grams = sampled_grams(texts)
    shared = gram_counts(texts).repartition("h").groupBy("h").agg(F.sum("n").alias("n"), F.sum("c").alias("c")).where("n > 1")
    shared = materialize(shared.select("h", "c", (F.col("c") > HOT).alias("hot")), "grams")
    held = grams.join(shared, "h")
    pick = lambda which: F.collect_set(F.when(which, F.col("h")))
    asked = held.groupBy("t").agg(pick(~F.col("hot")).alias("grams"), pick(F.col("hot")).alias("hots"), F.sum(F.when(~F.col("hot"), 1).otherwise(0)).alias("m"))
    asked = materialize(asked, "asked")
    discard(shared)
    return asked


def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(hot, doc ids, text hashes, places, keys) of the suffixes at shared K-grams, from rows (text, t, doc_id, grams, hots)."""

    def wanted(column: pa.Array, rows: np.ndarray) -> np.ndarray:
        lists = column.take(pa.array(rows))
        of = np.repeat(np.arange(len(rows), dtype=np.uint64), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64) + of * _APART

    for buf, firsts, ends, rows, places, batch in chunks(batches):
        at = anchors(buf, ends)
        doc = np.searchsorted(ends, at, side="right")
        # a hash meets its own text's list; a chance meeting with another's only adds a suffix to compare
        mark = gram_hashes(buf, at).view(np.uint64) + doc.astype(np.uint64) * _APART
        t = batch.column(1).to_numpy()[rows]
        ids = batch.column(2).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)[rows]
        for hot in (False, True):
            use = np.isin(mark, wanted(batch.column(4 if hot else 3), rows))
            if use.any():
                p, d = at[use], doc[use]
                yield hot, ids[d], t[d], p - firsts[d] + places[d], contexts(buf, p, firsts[d], ends[d])


def _order(m: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(m), -(-m.shape[1] // 8) * 8), np.uint8)
    wide[:, : m.shape[1]] = m
    words = wide.view(">u8").astype(np.uint64)
    return np.lexsort(tuple(words[:, i] for i in reversed(range(words.shape[1]))))


def _prefixes(m: np.ndarray) -> np.ndarray:
    """Length of the prefix that each row shares with the one before; 0 for the first."""
    if len(m) < 2:
        return np.zeros(len(m), np.int64)
    differs = m[1:] != m[:-1]
    return np.r_[0, np.where(differs.any(axis=1), differs.argmax(axis=1), m.shape[1])]


def front_code(m: np.ndarray, lcp: np.ndarray | None = None) -> bytes:
    """Sorted keys as shared prefix lengths and the bytes after them; ``lcp`` if the prefixes are known (the first counts as 0)."""
    lcp = _prefixes(m) if lcp is None else np.r_[0, lcp[1:]]
    tails = m[np.arange(m.shape[1]) >= lcp[:, None]]
    return lcp.astype(np.uint8).tobytes() + tails.tobytes()


def front_decode(data: bytes, n: int, width: int = KEY) -> tuple[np.ndarray, np.ndarray]:
    """Keys and prefix lengths from ``front_code``: a byte comes from the last row whose tail covers its column."""
    lcp = np.frombuffer(data, np.uint8, n).astype(np.int64)
    tails = np.frombuffer(data, np.uint8, offset=n)
    # where a row's first column would lie in ``tails``; it grows with the rows, so the last row is the greatest
    start = np.cumsum(width - lcp) - width
    columns = np.arange(width)
    out = np.empty((n, width), np.uint8)
    carried = np.zeros(width, np.int64)
    for lo in range(0, n, 1024):
        part = slice(lo, lo + 1024)
        at = np.where(lcp[part, None] <= columns, start[part, None], 0)
        at[0] = np.maximum(at[0], carried)
        np.maximum.accumulate(at, axis=0, out=at)
        carried = at[-1].copy()
        at += columns
        out[part] = tails[at]
    return out, lcp


def loser_tree_merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int], list[int]]:
    """Merge sorted runs ``(keys, prefix lengths)``; returns (run, position, prefix shared with the key before) in order.

    A node of the tree holds the loser of its match and the prefix it shares
    with the winner. The next key of the winner's run shares a known prefix with
    the key just put out; on its way up, the longer known prefix wins unseen,
    and only at equal lengths are keys compared, as numbers of as many bytes, all of one length.
    """
    k = 1
    while k < max(1, len(runs)):
        k *= 2
    heads = [0] * k
    lens = [len(runs[i][0]) if i < len(runs) else 0 for i in range(k)]
    size = max((len(x) for r, _ in runs for x in r[:1]), default=0)
    keys = [[int.from_bytes(x, "big") for x in r] for r, _ in runs]

    def play(a: int, la: int, b: int, lb: int) -> tuple[int, int, int, int]:
        """(winner, its prefix, loser, its prefix with the winner) of two heads whose prefixes are with the last key put out."""
        if heads[a] >= lens[a]:
            return b, lb, a, -1
        if heads[b] >= lens[b]:
            return a, la, b, -1
        if la > lb:
            return a, la, b, lb
        if lb > la:
            return b, lb, a, la
        x, y = keys[a][heads[a]], keys[b][heads[b]]
        common = size - ((x ^ y).bit_length() + 7) // 8
        return (a, la, b, common) if x < y or (x == y and a < b) else (b, la, a, common)

    loser, prefix = [0] * k, [0] * k
    level = [(i, 0) for i in range(k)]
    width = k
    while width > 1:
        width //= 2
        above = []
        for j in range(width):
            (a, la), (b, lb) = level[2 * j], level[2 * j + 1]
            w, lw, l, ll = play(a, la, b, lb)
            loser[width + j], prefix[width + j] = l, ll
            above.append((w, lw))
        level = above
    win, shared = level[0]
    out_run, out_at, out_lcp = [], [], []
    while heads[win] < lens[win]:
        at = heads[win]
        out_run.append(win)
        out_at.append(at)
        out_lcp.append(shared)
        heads[win] = at + 1
        shared = runs[win][1][at + 1] if at + 1 < lens[win] else -1
        node = (win + k) // 2
        while node:
            l, ll = loser[node], prefix[node]
            # the common cases of play(), inlined: unequal known prefixes decide without a look at the keys
            if ll > shared:
                loser[node], prefix[node], win, shared = win, shared, l, ll
            elif ll == shared:
                win, shared, loser[node], prefix[node] = play(win, shared, l, ll)
            node //= 2
    return out_run, out_at, out_lcp


def earliest(m: np.ndarray, lcp: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For sorted distinct keys and the smallest document of each: the smallest document of every LEAST-byte string
    that starts d = 0..K bytes before the suffix, FAR where the key's document does not hold it."""
    right, left = m[:, KEY - 2].astype(np.int64), m[:, KEY - 1].astype(np.int64)
    out = np.full((len(m), K + 1), FAR)
    group = np.cumsum(lcp < K) - 1
    many = (np.bincount(group, minlength=1) > 1)[group] if len(m) else np.zeros(0, bool)
    reach = (left[:, None] >= np.arange(K + 1)) & (right[:, None] >= LEAST - np.arange(K + 1))
    out[reach] = np.broadcast_to(docs[:, None], out.shape)[reach]
    at = np.flatnonzero(many)
    if not len(at):
        return out
    back = m[at, LEAST : LEAST + K]
    by_left = _order(back)
    left_lcp = _prefixes(back[by_left])
    for d in range(K + 1):
        ok = reach[at, d]
        if ok.sum() < 2:
            continue
        r = np.cumsum(lcp[at] < LEAST - d)
        l = np.empty(len(at), np.int64)
        l[by_left] = np.cumsum(left_lcp < d)
        _, same = np.unique(r[ok] * (len(at) + 1) + l[ok], return_inverse=True)
        low = np.full(same.max() + 1, FAR)
        np.minimum.at(low, same, docs[at][ok])
        out[at[ok], d] = low[same]
    return out


def _pack(*arrays: np.ndarray) -> bytes:
    return zlib.compress(b"".join(x.tobytes() for x in arrays), 1)


def _grams_of(m: np.ndarray) -> np.ndarray:
    """The K-grams that keys begin with; ranges are cut between K-grams."""
    return np.ascontiguousarray(m[:, :K]).view(f"S{K}").ravel()


_FRAGMENT = {"n": pa.int64(), "data": pa.binary(), "docs": pa.binary()}


def fragments(m: np.ndarray, lcp: np.ndarray, docs: np.ndarray, cuts: np.ndarray) -> list[tuple]:
    """A sorted run cut at ``cuts``: (range, n, front-coded keys, packed occurrences); ``docs`` has a row each of ids, hashes, places."""
    to = np.searchsorted(cuts, _grams_of(m), side="right")
    at = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
    return [(int(to[lo]), int(hi - lo), zlib.compress(front_code(m[lo:hi], lcp[lo:hi]), 1), _pack(docs[:, lo:hi])) for lo, hi in zip(at, [*at[1:], len(m)])]


def sorted_again(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same as ``merged`` of many small fragments, sorted as one array: of tens of fragments a tree's path is long."""
    m = np.concatenate([front_decode(zlib.decompress(data), int(n))[0] for n, data, _ in parts])
    docs = np.concatenate([np.frombuffer(zlib.decompress(packed), np.int64).reshape(3, -1) for *_, packed in parts], axis=1)
    order = _order(m)
    m = m[order]
    return m, _prefixes(m), docs[:, order]


def merged(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, prefix lengths, occurrences) in order, of front-coded fragments (n, data, docs), by a loser tree."""
    keys, trees, docs = [], [], []
    for n, data, packed in parts:
        m, lcp = front_decode(zlib.decompress(data), int(n))
        flat = m.tobytes()
        keys.append(m)
        trees.append(([flat[i : i + KEY] for i in range(0, len(flat), KEY)], lcp.tolist()))
        docs.append(np.frombuffer(zlib.decompress(packed), np.int64).reshape(3, -1))
    of, at, lcp = (np.array(x, np.int64) for x in loser_tree_merge(trees))
    sizes = np.array([len(m) for m in keys], np.int64)
    spot = (np.cumsum(sizes) - sizes)[of] + at
    return np.concatenate(keys)[spot], lcp, np.concatenate(docs, axis=1)[:, spot]


def sorted_runs(rows: DataFrame, coarse: np.ndarray) -> DataFrame:
    """Suffixes of ``rows`` as sorted front-coded runs cut at the coarse bounds (hot false), and of hot ones a row for each distinct
    context of a run, with its smallest and greatest document and its packed occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {False: [], True: []}, {False: 0, True: 0}

        def batch(hot: bool, rows: int, **columns) -> pa.RecordBatch:
            kinds = {"c": pa.int32(), **_FRAGMENT, "key": pa.binary(), "low": pa.int64(), "high": pa.int64()}
            arrays = [pa.array([hot] * rows), *[pa.array(columns[k], v) if k in columns else pa.nulls(rows, v) for k, v in kinds.items()]]
            return pa.RecordBatch.from_arrays(arrays, ["hot", *kinds])

        def flush(hot: bool) -> pa.RecordBatch:
            m, docs = np.concatenate([x[1] for x in held[hot]]), np.concatenate([x[0] for x in held[hot]], axis=1)
            held[hot], size[hot] = [], 0
            order = _order(m)
            m, docs = m[order], docs[:, order]
            if not hot:
                c, n, data, packed = zip(*fragments(m, _prefixes(m), docs, coarse))
                return batch(False, len(c), c=c, n=n, data=data, docs=packed)
            at = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]).any(axis=1)])
            packed = [_pack(docs[:, lo:hi]) for lo, hi in zip(at, [*at[1:], len(m)])]
            low, high = np.minimum.reduceat(docs[0], at), np.maximum.reduceat(docs[0], at)
            return batch(True, len(at), key=[x.tobytes() for x in m[at]], docs=packed, low=low, high=high)

        for hot, ids, t, places, m in suffixes(batches):
            held[hot].append((np.stack([ids, t, places]), m))
            size[hot] += len(m)
            if size[hot] >= RUN:
                yield flush(hot)
        for hot in (False, True):
            if size[hot]:
                yield flush(hot)

    return rows.mapInArrow(run, "hot boolean, c int, n long, data binary, docs binary, key binary, low long, high long")


def range_bounds(rows: DataFrame, n_rows: int, n_ranges: int) -> tuple[np.ndarray, DataFrame]:
    """Coarse bounds, and for each coarse range its fine ones (c, cuts): quantiles of whole K-grams from a sample of texts.

    About SAMPLED keys a range are sampled, as a table; the driver gets what the
    coarse bounds need, a share that falls with the square root of the ranges.
    """
    spark = rows.sparkSession
    share = min(1.0, max(2000 / max(1, n_rows), SAMPLED / RANGE))
    some = rows.where(F.pmod(F.xxhash64(F.lit(9), "t", "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hot, *_, m in suffixes(batches):
            if not hot:
                flat = np.ascontiguousarray(m[:, :K]).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([flat[i : i + K] for i in range(0, len(flat), K)], pa.binary())], ["w"])

    sample = materialize(some.mapInArrow(heads, "w binary"), "sample")
    total = sample.count()
    n_coarse = min(n_ranges, max(COARSE, int(np.ceil(n_ranges**0.5))))
    few = sample.where(F.pmod(F.xxhash64(F.lit(3), "w", F.monotonically_increasing_id()), F.lit(max(1, total))) < SAMPLED * n_coarse)
    keys = np.array(sorted(few.toArrow()["w"].to_pylist()), f"S{K}")
    coarse = keys[[len(keys) * i // n_coarse for i in range(1, n_coarse)]] if len(keys) else keys
    step = max(1, total // n_ranges)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = np.array(batch.column(0).to_pylist(), f"S{K}")
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(coarse, w, side="right").astype(np.int32)), batch.column(0)], ["c", "w"])

    fine = sample.mapInArrow(placed, "c int, w binary").groupBy("c").agg(F.sort_array(F.collect_list("w")).alias("ws"))
    fine = fine.select("c", F.filter("ws", lambda _, i: (i + 1) % step == 0).alias("cuts"))
    return coarse, materialize(fine, "bounds") if total else spark.createDataFrame([], "c int, cuts array<binary>")


def refined(runs: DataFrame, fine: DataFrame) -> DataFrame:
    """Level two: within a coarse range fragments become sorted runs of about RUN suffixes, which are cut at the fine bounds.

    A partition is read as a stream, a coarse range's bounds first, so memory
    holds one run; a run of many suffixes meets about the square root of all
    ranges, so fragments grow in number with the suffixes alone.
    """
    none = F.lit(None)
    stream = runs.select("c", "n", "data", "docs", none.cast("array<binary>").alias("cuts")).unionByName(
        fine.select("c", F.lit(-1).cast("long").alias("n"), none.cast("binary").alias("data"), none.cast("binary").alias("docs"), "cuts")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cuts, held, size = None, np.zeros(0, f"S{K}"), [], 0

        def flush() -> pa.RecordBatch:
            f, n, data, packed = zip(*fragments(*sorted_again(held), cuts))
            arrays = [pa.array([now] * len(f), pa.int32()), pa.array(f, pa.int32()), *[pa.array(x, k) for x, k in zip((n, data, packed), _FRAGMENT.values())]]
            return pa.RecordBatch.from_arrays(arrays, ["c", "f", *_FRAGMENT])

        for batch in batches:
            for i in range(batch.num_rows):
                c, n, data, packed, own = (batch.column(k)[i].as_py() for k in range(5))
                if c != now:
                    if size:
                        yield flush()
                    now, cuts, held, size = c, np.zeros(0, f"S{K}"), [], 0
                if n < 0:
                    cuts = np.array(own, f"S{K}")
                    continue
                held.append((n, data, packed))
                size += n
                if size >= RUN:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return stream.repartition("c").sortWithinPartitions("c", "n").mapInArrow(run, "c int, f int, n long, data binary, docs binary")


SPANS = "doc_id long, t long, a long, b long"


def repeats(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Spans that a smaller document holds too, of all suffixes of a key range: strings at one anchor overlap, so a span an occurrence."""
    m, lcp, (ids, t, places) = merged(list(zip(pdf["n"], pdf["data"], pdf["docs"])))
    new = lcp < KEY
    new[:1] = True
    first = np.flatnonzero(new)
    table = earliest(m[first], lcp[first], np.minimum.reduceat(ids, first))
    of, out = np.cumsum(new) - 1, []
    for lo in range(0, len(ids), 50_000):
        part = slice(lo, lo + 50_000)
        hit = table[of[part]] < ids[part, None]
        some = np.flatnonzero(hit.any(axis=1))
        hit, at = hit[some], places[part][some]
        low, high = hit.argmax(axis=1), K - hit[:, ::-1].argmax(axis=1)
        out.append(pd.DataFrame({"doc_id": ids[part][some], "t": t[part][some], "a": at - high, "b": at - low + LEAST}))
    return pd.concat(out)


def hot_repeats(hot: DataFrame) -> DataFrame:
    """The same for suffixes of hot K-grams (key, low, high, docs), by aggregation.

    Equal contexts, as inside a passage that a third of all documents hold, are
    one row a run, and one in all after the aggregation. What differs, at a passage's ends, is
    taken apart into its up to K + 1 strings, whose smallest document is an
    aggregation as well.
    """
    byte = lambda i: F.conv(F.hex(F.substring("key", i, 1)), 16, 10).cast("int")
    entries = hot.groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    entries = entries.withColumns({"from": F.greatest(F.lit(0), F.lit(LEAST) - byte(KEY - 1)), "to": byte(KEY)}).where("from <= to")
    strings = entries.withColumn("d", F.explode(F.sequence("from", "to")))
    text = F.concat(F.substring(F.col("key"), F.lit(LEAST + 1), F.col("d")), F.substring(F.col("key"), F.lit(1), F.lit(LEAST) - F.col("d")))
    strings = strings.select("key", "high", "low", "d", text.alias("s"))
    least = strings.groupBy("d", "s").agg(F.min("low").alias("first"), F.max("high").alias("last")).where("first < last").drop("last")
    answers = strings.join(least, ["d", "s"]).where("first < high").groupBy("key").agg(F.collect_list(F.struct("d", "first")).alias("ds"))
    answers = materialize(answers, "answers")  # a table of its own, so that the join's hot keys can be split

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed, answer in zip(batch.column(0), batch.column(1)):
                ids, t, places = np.frombuffer(zlib.decompress(packed.as_py()), np.int64).reshape(3, -1)
                pairs = sorted((x["d"], x["first"]) for x in answer.as_py())
                d, first = np.array([x[0] for x in pairs]), np.array([x[1] for x in pairs], np.int64)
                for lo in range(0, len(ids), 50_000):
                    part = slice(lo, lo + 50_000)
                    hit = first < ids[part, None]
                    some = np.flatnonzero(hit.any(axis=1))
                    hit, at = hit[some], places[part][some]
                    a, b = at - d[len(d) - 1 - hit[:, ::-1].argmax(axis=1)], at - d[hit.argmax(axis=1)] + LEAST
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[part][some], t[part][some], a, b)], ["doc_id", "t", "a", "b"])

    return hot.join(answers, "key").select("docs", "ds").mapInArrow(spread, SPANS)


def removed_spans(texts: DataFrame) -> DataFrame:
    """(id, h, spans array<long>): bytes of each text (text, t, doc_id) that a string of a smaller doc_id covers; a span is its start * 128 + length."""
    asked = shared_grams(texts)
    n_rows, total = texts.count(), asked.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    rows = texts.join(asked, "t").select("text", "t", "doc_id", "grams", "hots")
    coarse, fine = range_bounds(rows, n_rows, max(1, round(total / RANGE)))
    runs = materialize(sorted_runs(rows, coarse), "runs")
    discard(asked)
    spans = refined(runs.where("not hot"), fine).groupBy("c", "f").applyInPandas(repeats, SPANS)
    spans = spans.unionByName(hot_repeats(runs.where("hot").select("key", "low", "high", "docs")))
    pack = F.collect_list(F.col("a") * 128 + (F.col("b") - F.col("a")))
    spans = materialize(spans.groupBy(F.col("doc_id").alias("id"), F.col("t").alias("h")).agg(pack.alias("spans")), "spans")
    discard(runs, fine)
    return spans


def dedup_suffixes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary): whole texts without bytes repeated from documents of smaller doc_id.

    A byte goes if a LEAST-byte string that covers it also starts in a
    document with a smaller doc_id; matches never cross documents and are
    judged on the input. Exact: sampling picks where to look, byte comparisons
    decide. Text is shuffled twice, to its shared K-grams and to its spans.

    Null text is empty and comes back whole; a null doc_id is smaller than any
    other; rows of equal doc_id take nothing from each other. Texts of fewer
    than LEAST bytes stay. An empty table gives no rows. Extra columns are
    ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("t", F.xxhash64("text"))
    spans = removed_spans(docs.where(F.octet_length("text") >= LEAST))
    both = docs.join(spans, (F.coalesce("doc_id", F.lit(int(NO_ID))) == F.col("id")) & (F.col("t") == F.col("h")), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1), batch.column(2)):
                data, spans = text.as_py().encode("utf-8", "surrogatepass"), spans.as_py()
                kept, at, runs = [], 0, 0
                for x in sorted(spans or []):
                    a, b = x >> 7, (x >> 7) + (x & 127)
                    if a > at or not runs:
                        kept.append(data[at:a])
                        runs += 1
                    at = max(at, b)
                kept.append(data[at:])
                out = b"".join(kept)
                rows.append((len(data), len(data) - len(out), runs, out))
            columns = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return both.select("doc_id", "text", "spans").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
