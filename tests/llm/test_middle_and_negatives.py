"""Fill-in-the-middle and hard negatives against plain versions, and their defined edge cases."""

import hashlib
import random
import re
from fractions import Fraction
from math import floor

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from girder.llm import fill_in_middle as fim
from girder.llm import hard_negatives as hn

UNITS = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def plain_middle(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    n = len(units)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return n, "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


@given(st.text(st.sampled_from("abZ .<PSM>\n0é😀İK"), max_size=60), st.integers(-5, 10**12))
@settings(max_examples=300, deadline=None)
def test_runs_cut_where_tokens_end(text, doc_id):
    assert fim.transform_text(text, doc_id) == plain_middle(doc_id, text)


@given(st.text(st.sampled_from("aB-<PSM> é"), max_size=40))
@settings(max_examples=100, deadline=None)
def test_every_unit_has_its_offset(text):
    runs, units = fim.ClassRuns(text), UNITS.findall(text)
    assert runs.units == len(units)
    assert [runs.offset(k) for k in range(len(units) + 1)] == [len("".join(units[:k])) for k in range(len(units) + 1)]


def test_middle_over_a_table(spark):
    r = random.Random(4)
    texts = ["".join(r.choice("ab C,.\n<>PSMé😀") for _ in range(r.randint(0, 80))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id, twice"), (None, "no id, twice"), (7, None), (8, ""), (9, "x<S>y"), (10, "word " * 200_000 + "é")]
    docs = spark.createDataFrame([(i, t, "f", 1) for i, t in rows], "doc_id long, text string, form string, n int").repartition(4)
    out = fim.fill_in_middle(docs)
    got = out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fim.restored(F.col("output"), F.col("form")).alias("back")).collect()
    key = lambda x: tuple(str(v) for v in x)
    assert sorted((tuple(x) for x in got), key=key) == sorted(((i, *plain_middle(i, t), t or "") for i, t in rows), key=key)
    assert {x.form for x in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).collect() == []


def plain_negatives(rows):
    """rows: (vec_id, vector, label); by exact fractions and plain sorting."""
    good = []
    for n, (i, v, y) in enumerate(rows):
        if y is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        good.append((n, i, [floor(256 * Fraction(x)) for x in v], y))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2])
    out = []
    for n, i, v, y in good:
        if i is None or i % 100:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, m, z) for m, j, w, z in good if m != n and len(w) == len(v)]
        for p in sorted((s for s in scored if s[3] == y), key=order)[:5]:
            fit = sorted((s for s in scored if s[3] != y and 30 * p[0] <= 100 * s[0] <= 90 * p[0]), key=order)[:10]
            out += [(i, p[1], k + 1, s[1], p[0], s[0]) for k, s in enumerate(fit)]
    return out


def mined(df, **more):
    key = lambda x: tuple(str(v) for v in x)
    return sorted((tuple(x) for x in hn.mine(df, **more).collect()), key=key)


@pytest.mark.parametrize("block,shard", [(2048, 8192), (2, 16)])
def test_negatives_against_plain_sorting(spark, block, shard):
    r = np.random.default_rng(5)
    middles = r.normal(size=(4, 12))
    rows = [(i * 10, [float(np.float32(x)) for x in (middles[i % 4] + r.normal(size=12)) / 4], int(i % 3)) for i in range(150)]
    rows += [(i * 100, rows[i][1], 1) for i in range(0, 60, 3)]  # a hot vector, repeated ids, ties
    rows += [(5, None, 1), (6, [float("nan")] * 12, 1), (100, [1.0] * 12, None), (None, rows[3][1], 0), (None, rows[3][1], 2), (7, [None] + [0.1] * 11, 2)]
    rows += [(200, [0.5, 0.25], 0), (201, [0.5, 0.5], 0), (202, [0.25, 0.25], 1), (300, [], 0), (301, [], 0), (302, [], 1), (-400, rows[1][1], 9)]
    rows += [(500, [1e12, -3e11, 7.0], 4), (501, [9e11, -2e11, 5.5], 4), (502, [5e11, 1e10, 1.25], 6), (503, [4e11, 2e10, 2.25], 6)]
    df = spark.createDataFrame([(i, v, y, 0, "b") for i, v, y in rows], "vec_id long, embedding array<double>, label int, uid int, block string").repartition(3)
    key = lambda x: tuple(str(v) for v in x)
    want = sorted(plain_negatives(rows), key=key)
    fits = [x if abs(x[4]) < 2**63 and abs(x[5]) < 2**63 else (*x[:4], *(min(max(v, -(2**63)), 2**63 - 1) for v in x[4:])) for x in want]
    assert mined(df, block=block, shard=shard) == fits


def test_pairs_are_discarded_before_their_products(monkeypatch):
    """On vectors whose leading components tell them apart, few pairs reach the integer products."""
    r = np.random.default_rng(2)
    x = np.floor(256 * r.normal(size=(3000, 32)) * 0.7 ** np.arange(32))
    _, q = np.linalg.eigh(x.T @ x)
    rot, seen = np.ascontiguousarray(q[:, ::-1]), []
    whole = hn.products
    monkeypatch.setattr(hn, "products", lambda a, b, bound: seen.append(len(a)) or whole(a, b, bound))
    rows, anchors = hn.Rotated(x, rot), hn.Rotated(x[:50], rot)
    ids = np.arange(3000)
    other = np.arange(50)[:, None] != ids[None, :]
    i, j, s = hn.best(anchors, rows, other, np.full(50, -np.inf), np.full(50, np.inf), 5, lambda j: (ids[j],))
    scores = (x[:50] @ x.T).astype(np.int64)
    for a in range(50):
        want = sorted((-scores[a, b], b) for b in range(3000) if b != a)[:5]
        assert [(-v, b) for v, b in zip(s[i == a], j[i == a])] == want
    assert sum(seen) < 0.05 * 50 * 3000


def test_negatives_of_an_empty_table(spark):
    assert mined(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")) == []
    assert mined(spark.createDataFrame([(100, [0.5], 1)], "vec_id long, embedding array<float>, label int")) == []


def test_positives_of_hot_labels_are_spread(spark):
    """A label with most rows is dealt to shards: the same rows come out as from one."""
    r = np.random.default_rng(9)
    rows = [(i, [float(x) for x in r.normal(size=6)], 1 if i % 10 else 2) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert mined(df, shard=20) == mined(df) == sorted(plain_negatives(rows), key=lambda x: tuple(str(v) for v in x))
