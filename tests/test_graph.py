"""Strong components against a plain search, and on one long cycle."""

import random

import pytest

from girder.operators.graph import strong_components


def plain(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
        after.setdefault(b, set())

    def reach(v):
        seen, todo = set(), [v]
        while todo:
            for w in after[todo.pop()]:
                if w not in seen:
                    seen.add(w)
                    todo.append(w)
        return seen

    far = {v: reach(v) for v in after}
    out = {}
    for v in after:
        own = {w for w in far[v] if v in far[w]} | {v}
        if len(own) > 1:
            out[v] = (min(own), len(own))
    return out


def graphs():
    r = random.Random(7)
    yield [(r.randint(0, 40), r.randint(0, 40)) for _ in range(70)]
    long = [(100 + k, 100 + (k + 1) % 30) for k in range(30)]
    yield long + [(105, 120), (120, 3), (3, 4), (4, 3), (4, 5), (5, 6), (6, 7), (7, 5), (9, 9), (8, 100)]
    yield [(k, k + 1) for k in range(25)] + [(12, 4), (20, 15), (3, 0)] + [(50, 51), (51, 50), (51, 52), (52, 50)]
    yield [(1, 2), (2, 1), (2, 2), (2, 3), (3, 4), (4, 5), (5, 2)]


@pytest.mark.parametrize("case", range(4))
def test_against_plain_search(spark, case):
    edges = list(graphs())[case]
    got = strong_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {x.node: (x.component, x.size) for x in got} == plain(edges)


def test_one_long_cycle(spark):
    """A cycle of 20,000 nodes with chords and tails: rounds follow its logarithm."""
    n = 20_000
    ring = spark.range(n).selectExpr("id as src", f"(id + 1) % {n} as dst")
    chords = spark.range(20).selectExpr(f"id * {n // 20} as src", f"(id * {n // 20} + 777) % {n} as dst")
    tails = spark.range(5_000).selectExpr(f"{n} + id as src", f"{n} + id + 1 as dst").unionByName(spark.createDataFrame([(2 * n, 0), (5, n)], "src long, dst long"))
    got = strong_components(ring.unionByName(chords).unionByName(tails))
    assert tuple(got.selectExpr("count(*)", "min(component)", "max(component)", "min(size)", "max(node)").first()) == (n, 0, 0, n, n - 1)
