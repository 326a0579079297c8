"""Brute-force versions of the corpus operators, for small fixtures."""

import hashlib
import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i + 1, n):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def suffix_removal(docs):
    """{doc_id: (n_bytes, n_removed, n_spans, sha)} of distinct ids."""
    out, seen = {}, set()
    for i, text in sorted(docs):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        own = [data[p : p + 50] for p in range(len(data) - 49)]
        for p, w in enumerate(own):
            if w in seen:
                gone[p : p + 50] = True
        seen.update(own)
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[i] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def lines(docs):
    """{doc_id: (n_lines, n_dropped, kept)} of distinct ids."""
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\v\f\r"))
    held = {}
    for i, t in docs:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                held.setdefault(k, set()).add(i)
    gone = {k: max(v) for k, v in held.items() if len(v) >= 5}
    out = {}
    for i, t in docs:
        xs = (t or "").split("\n")
        kept = [x for x in xs if gone.get(key(x), i) == i]
        out[i] = (len(xs), len(xs) - len(kept), "\n".join(kept))
    return out
