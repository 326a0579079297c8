"""Helpers of the suffix dedup against plain loops, and how much they do."""

import zlib

import numpy as np
import pyarrow as pa

from girder.llm import suffix_dedup as s


def documents(seed):
    r = np.random.default_rng(seed)
    sizes = r.integers(0, [1, 52, 130, 700][seed % 4] + 1, r.integers(1, 9))
    buf = r.integers(97, 97 + [1, 2, 26][seed % 3], sizes.sum()).astype(np.uint8)
    return buf, np.cumsum(sizes) - sizes, np.cumsum(sizes)


def test_anchors_and_contexts_are_those_of_plain_loops():
    for seed in range(120):
        buf, firsts, ends = documents(seed)
        at = s.anchors(buf, ends)
        h = s._rolling(buf) if len(buf) >= s.LEAST else None
        want = {a + int(np.argmin(h[a : a + s.SPAN])) for f, e in zip(firsts, ends) for a in range(f, e - s.LEAST + 1)}
        assert at.tolist() == sorted(want)
        doc = np.searchsorted(ends, at, side="right")
        for p, d, key in zip(at, doc, s.contexts(buf, at, firsts[doc], ends[doc])):
            right, left = bytes(buf[p : min(p + s.LEAST, ends[d])]), bytes(buf[max(firsts[d], p - s.K) : p][::-1])
            assert bytes(key) == right.ljust(s.LEAST, b"\0") + left.ljust(s.K, b"\0") + bytes([len(right), len(left)])


def test_runs_sorted_again_are_the_merged_ones():
    r = np.random.default_rng(5)
    parts, n = [], 0
    for size in (1, 3000, 40, 1500, 0, 700):
        m = r.integers(0, 3, (size, s.KEY)).astype(np.uint8)
        m[:, : s.K] = 7
        m[size // 2 :] = m[: size - size // 2]
        m = m[s._order(m)]
        if size:
            parts.append((size, zlib.compress(s.front_code(m), 1), s._pack(np.arange(n, n + 3 * size).reshape(3, -1))))
            n += 3 * size
    for a, b in zip(s.sorted_again(parts), s.merged(parts)):
        assert (a == b).all()


def test_arrays_made_of_a_piece_of_text_are_small():
    """Eight bytes of hash and place for each byte of a piece fit a core's cache of a megabyte; before, they took two."""
    assert 8 * s.CHUNK <= 1 << 20


class Frame:
    """Hands out the function that a task would run; a worker would not see the module's changed limits."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return lambda *texts: [x for out in run(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])])) for x in out.to_pylist()]


def test_counts_are_made_of_parts_of_a_batch(monkeypatch):
    """A whole batch counted at once took a worker 167 MB; texts are counted once whatever parts they come in."""
    monkeypatch.setattr(s, "COUNTED", 20)
    monkeypatch.setattr(s, "CHUNK", 64)
    r = np.random.default_rng(2)
    texts = ["".join(r.choice(list("abcde"), n)) for n in (60, 3000, 90, 400, 70)] + ["ab" * 900]
    got = s.gram_counts(Frame())(*texts, texts[1])
    assert len({x["h"] for x in got}) < len(got)
    total = {}
    for x in got:
        n, c = total.get(x["h"], (0, 0))
        total[x["h"]] = n + x["n"], c + x["c"]
    copied = {int(h) for x in [texts[1]] for b in [np.frombuffer(x.encode(), np.uint8)] for h in s.gram_hashes(b, s.anchors(b, np.array([len(b)])))}
    assert {h for h, (n, _) in total.items() if n > 1} == copied
