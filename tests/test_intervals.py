"""Interval joins against plain loops, and on one crowded file."""

import random

from girder.operators import shared
from girder.operators.intervals import overlap, stab

LINES = "k string, i long, lo int, hi int"


def some(seed, n, most, long_every=9):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lo = r.randint(0, most)
        out.append((r.choice("ab"), i, lo, lo + (r.randint(0, most) if i % long_every == 0 else r.randint(-2, 40))))
    return out + [("a", n, None, 5), ("a", n + 1, 5, None), (None, n + 2, 0, most), ("b", n + 3, 0, 2**31 - 1), ("b", n + 4, 7, 7)]


def test_points_in_intervals(spark):
    intervals, r = some(1, 120, 3000), random.Random(2)
    points = [(r.choice("ab"), j, r.randint(0, 3100)) for j in range(200)] + [("a", 900, None), (None, 901, 3), ("b", 902, 2**31 - 1), ("b", 903, 0)]
    got = stab(spark.createDataFrame(points, "k string, j long, p int"), spark.createDataFrame(intervals, LINES), ["k"], "p", "lo", "hi")
    want = sorted((j, i) for k, j, p in points for m, i, lo, hi in intervals if k is not None and k == m and None not in (p, lo, hi) and lo <= p <= hi)
    assert sorted((x.j, x.i) for x in got.collect()) == want


def test_overlapping_intervals(spark):
    left, right = some(3, 90, 800), some(4, 90, 800)
    names = lambda df, p: df.toDF("k", *[p + c for c in ("i", "lo", "hi")])
    got = overlap(names(spark.createDataFrame(left, LINES), "l"), names(spark.createDataFrame(right, LINES), "r"), ["k"], ("llo", "lhi"), ("rlo", "rhi"))
    fine = lambda x: x[0] is not None and None not in x and x[2] <= x[3]
    want = sorted((x[1], y[1]) for x in left for y in right if fine(x) and fine(y) and x[0] == y[0] and x[2] <= y[3] and y[2] <= x[3])
    assert sorted((x.li, x.ri) for x in got.collect()) == want


def test_one_file_with_many_items_and_hints(spark):
    """100,000 items and 100,000 hints of one file: rows between the joins stay in proportion."""
    n = 100_000
    items = spark.range(n).selectExpr("0 as pkg_ix", "0 as file_ix", "id as item_ix", "concat('s', id) as symbol", "cast(id * 10 as int) as line_start", "cast(id * 10 + 8 as int) as line_end")
    hints = spark.range(n).selectExpr("0 as pkg_ix", "0 as file_ix", "id as item_ix", "cast(id * 10 + id % 10 as int) as target_start")
    got = shared.hint_targets(hints, items).selectExpr("count(*) as n", "count(target_symbol) as hit", "count_if(target_symbol = concat('s', item_ix)) as own").first()
    assert tuple(got) == (n, n * 9 // 10, n * 9 // 10)
