"""Packing tokenised documents into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import json
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, materialize

#: Words whose ids each Python worker remembers; the memory stays bounded.
WORD_CACHE = 1_000_000
#: Characters outside which a word goes through the tokenizer's own whole path.
PLAIN = re.compile(r"[\x21-\x7e\xa1-ɏ]+\Z")
SPACE = re.compile("[\t\n\v\f\r ]+")

_tokenizers: dict[str, "WordTokenizer"] = {}


class WordTokenizer:
    """Ids of whole texts under a BPE file of ``tokenizers``; a word at a time where the file is of the kind below, else whole.

    Such a file's pre-tokenizer never crosses white space and its normaliser never
    composes over it, so a text's ids are those of its words in turn. Plain
    words are split by the file's own pattern and handed to its BPE model;
    anything else goes through ``encode``. Ids are kept as little-endian
    32-bit bytes.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        # the short cut for plain words holds for files that lower-case, drop white space and split by one pattern into bytes
        steps = json.loads(self.whole.to_str())
        norm, pre = steps.get("normalizer") or {}, steps.get("pre_tokenizer") or {}
        named = lambda x, key: [y["type"] for y in x.get(key, [])]
        split = next((x["pattern"]["Regex"] for x in pre.get("pretokenizers", []) if x["type"] == "Split" and "Regex" in x["pattern"]), None)
        self.known = split is not None and named(pre, "pretokenizers") == ["Split", "ByteLevel"] and named(norm, "normalizers") == ["NFC", "Replace", "Lowercase"]
        self.split = regex.compile(split) if self.known else None
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.chars = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.seen: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        if PLAIN.match(word) and "<|" not in word:
            low = word.lower()
            pieces = [low] if low.isalpha() else self.split.findall(low)
            ids: list[int] = []
            for p in pieces:
                if not p.isascii():
                    p = "".join(map(self.chars.__getitem__, p.encode()))
                ids.extend(x.id for x in self.model.tokenize(p))
        else:
            ids = self.whole.encode(word, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if not self.known:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.seen) > WORD_CACHE:
            self.seen.clear()
        seen, words = self.seen, [w for w in SPACE.split(text) if w]
        for w in words:
            if w not in seen:
                seen[w] = self.word(w)
        return b"".join([seen[w] for w in words])


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp k-way differencing: positions of ``sizes`` in each of ``k`` subsets of near-equal sums.

    Partial partitions wait in a heap by their spread; the two widest are
    merged so that the fullest subset of one meets the emptiest of the other.
    """
    heap = []
    for i, n in enumerate(sizes):
        loads = np.zeros(k, np.int64)
        loads[0] = n
        heap.append((-n, i, loads, [i] + [None] * (k - 1)))
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, a, pa = heapq.heappop(heap)
        _, _, b, pb = heapq.heappop(heap)
        loads = a + b[::-1]
        order = np.argsort(-loads, kind="stable")
        loads = loads[order]
        both = [x if y is None else y if x is None else (x, y) for x, y in zip(pa, reversed(pb))]
        loads -= loads[-1]
        tick += 1
        heapq.heappush(heap, (-int(loads[0]), tick, loads, [both[j] for j in order.tolist()]))
    subsets = []
    for tree in heap[0][3] if heap else []:
        out, todo = [], [tree]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo.extend(x)
            elif x is not None:
                out.append(x)
        subsets.append(out)
    return subsets


def bundles(sizes: list[int], most: int) -> list[list[int]]:
    """Positions of ``sizes`` in bundles: pieces that fit are put together, in order, up to ``most`` ids; larger ones stay alone."""
    out: list[list[int]] = []
    room = 0
    for i, n in enumerate(sizes):
        if n > room:
            out.append([])
            room = max(most, n)
        out[-1].append(i)
        room -= n
    return out


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of at most ``capacity``; more windows whenever the fullest exceeds it, by bisection once enough are found.

    Where there are more than 32 pieces a window, as with many empty texts, small ones ride in bundles, which bounds the memory of the partial partitions.
    """
    if len(sizes) > 32 * -(-sum(sizes) // capacity):
        units = bundles(sizes, max(1, capacity // 16))
        if len(units) < len(sizes):
            return [[i for u in w for i in units[u]] for w in windows([sum(sizes[i] for i in u) for u in units], capacity)]

    def tried(k: int) -> tuple[list[list[int]], int]:
        parts = difference(sizes, k)
        return parts, max((sum(sizes[i] for i in p) for p in parts), default=0)

    low = max(1, -(-sum(sizes) // capacity)) - 1  # too few
    k = low + 1
    parts, worst = tried(k)
    while worst > capacity:
        low, k = k, k + max(1, (worst - capacity) * k // capacity // 4)
        parts, worst = tried(k)
    while k - low > 1:
        mid = (low + k) // 2
        fewer, worst = tried(mid)
        if worst <= capacity:
            parts, k = fewer, mid
        else:
            low = mid
    return [p for p in parts if p]


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, group_windows: int = 192, trim: int = 24, group_pieces: int = 100_000) -> DataFrame:
    """Pack all documents: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row a piece.

    A document's ids are those of its text, then ``end_id``. Full windows are
    cut off its front and stand alone; of the rest up to ``trim`` ids (by a
    hash) are cut off as a small piece that lets windows come out even. Pieces,
    never ids, are shuffled: to even groups of about ``group_windows``
    windows, or of ``group_pieces`` pieces if that is less, whose pieces Karmarkar-Karp differencing spreads over
    near-equal windows. A group's size is set by its window count alone, so no
    task grows with the corpus, and padding stays under about one window in
    ``group_windows``.

    Null or empty text is one piece of the end id alone. Null doc_id and
    repeated rows are documents like others. An empty table gives no rows.
    Extra columns are ignored.
    """
    last = np.array([end_id], "<u4").tobytes()

    def make():
        tok = tokenizer(tokenizer_path)

        def cut(texts: list) -> tuple[list, list]:
            rows = []
            for i, text in enumerate(texts):
                ids = (tok.ids(text) if text else b"") + last
                n = len(ids) // 4
                whole = n - n % capacity
                at = list(range(0, whole, capacity))
                if whole < n:
                    at.append(whole)
                    small = zlib.crc32(ids) % trim + 1
                    if n - whole > 8 * trim:
                        at.append(n - small)
                for lo, hi in zip(at, [*at[1:], n]):
                    rows.append((i, lo, hi - lo, zlib.crc32(ids[4 * lo : 4 * hi]), n))
            of, *columns = zip(*rows)
            return list(of), columns

        return cut

    pieces = materialize(map_texts(docs, make, "start long, length long, ids_crc32 long, doc_tokens long"), "pieces")
    n, total = pieces.where(F.col("length") < capacity).agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    groups = max(1, round(total / (group_windows * capacity)), round(n / group_pieces))
    full = pieces.where(F.col("length") == capacity)
    # a full window is named by its own number below zero: partition and row number of the stored pieces
    full = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    # by the row number in the stored table, so that repeated rows spread as well
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).alias("grp")
    rest = pieces.where(F.col("length") < capacity).select("*", spread)

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        pdf = pdf.reset_index(drop=True)
        sizes = pdf["length"].tolist()
        seq, off = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for w, members in enumerate(windows(sizes, capacity)):
            at = 0
            for i in members:
                seq[i], off[i], at = (int(key[0]) << 20) + w, at, at + sizes[i]
        pdf["sequence_id"], pdf["offset"] = seq, off
        return pdf[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    packed = rest.groupBy("grp").applyInPandas(fill, out)
    return packed.unionByName(full)
