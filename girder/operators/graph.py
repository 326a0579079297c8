"""Graph operators over edge DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.scratch import discard, materialize


def reachability(edges: DataFrame) -> DataFrame:
    """All (src, dst) with a path, by doubling: each round joins the pairs known with themselves, so rounds are logarithmic in the longest path.

    Meant for graphs of packages: the closure is at most the square of the node
    count. Each round is written to the shared folder; the loop ends when a round adds nothing.
    """
    pairs, known = materialize(edges.select("src", "dst").distinct(), "paths"), -1
    while (n := pairs.count()) != known:
        known, before = n, pairs
        step = pairs.join(pairs.select(F.col("src").alias("dst"), F.col("dst").alias("to")), "dst").select("src", F.col("to").alias("dst"))
        pairs = materialize(pairs.unionByName(step).distinct(), "paths")
        discard(before)
    return pairs


def trimmed(edges: DataFrame, least: float = 0.0) -> DataFrame:
    """Distinct edges (src, dst) whose ends both have a way in and a way out: rounds go on while they take more than ``least`` of the edges, each at least one; 0 trims all."""
    now, n = materialize(edges.select("src", "dst").where("src <> dst").distinct(), "edges"), None
    while True:
        left = now.count()
        if n is not None and (left == n or left > (1 - least) * n) or not left:
            return now
        n, before = left, now
        ins, outs = now.select(F.col("dst").alias("v")).distinct(), now.select(F.col("src").alias("v")).distinct()
        kept = now.join(ins, F.col("src") == F.col("v"), "left_semi").join(outs, F.col("dst") == F.col("v"), "left_semi")
        now = materialize(kept, "edges")
        discard(before)


def contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph without its chains: (edges, chains, rings).

    A chain is a run of nodes with one edge in and one out; it becomes one edge
    from the node before it, ``first``, to the one after it, ``last``. ``chains``
    (node, first, last) tells where each of its nodes was; ``rings`` (node,
    component) are cycles of nothing else. The ends of chains are found by
    doubling, in rounds logarithmic in the longest.
    """
    outs = edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("n_out"), F.min("dst").alias("next"))
    ins = edges.groupBy(F.col("dst").alias("v")).agg(F.count("*").alias("n_in"), F.min("src").alias("prev"))
    links = materialize(outs.join(ins, "v").where("n_out = 1 and n_in = 1").select("v", "next", "prev", F.col("v").alias("low")), "chains")
    n = links.count()
    if not n:
        return edges, links.select(F.col("v").alias("node"), F.col("prev").alias("first"), F.col("next").alias("last")), links.select(F.col("v").alias("node"), F.col("low").alias("component"))
    for _ in range(max(1, n.bit_length())):
        ahead = links.select(F.col("v").alias("next"), F.col("next").alias("next2"), F.col("low").alias("low2"))
        back = links.select(F.col("v").alias("prev"), F.col("prev").alias("prev2"))
        far = links.join(ahead, "next", "left").join(back, "prev", "left")
        moved = far.select("v", F.coalesce("next2", "next").alias("next"), F.coalesce("prev2", "prev").alias("prev"), F.least("low", "low2").alias("low"), (F.col("next2").isNotNull() | F.col("prev2").isNotNull()).alias("moved"))
        before, links = links, materialize(moved, "chains")
        discard(before)
        if not links.where("moved").limit(1).count():
            break
    inside = links.select(F.col("v").alias("next"))
    rings = links.join(inside, "next", "left_semi").select(F.col("v").alias("node"), F.col("low").alias("component"))
    chains = links.join(inside, "next", "left_anti").select(F.col("v").alias("node"), F.col("prev").alias("first"), F.col("next").alias("last"))
    own = links.select("v")
    rest = edges.join(own, F.col("src") == F.col("v"), "left_anti").join(own, F.col("dst") == F.col("v"), "left_anti")
    rest = rest.select("src", "dst").unionByName(chains.select(F.col("first").alias("src"), F.col("last").alias("dst"))).distinct()
    return materialize(rest, "edges"), chains, rings


#: Share of the edges that a round of trimming must take to be followed by another; long tails are left to contraction.
TRIM = 0.1


def _spread(edges: DataFrame, marks: DataFrame, steps: int = 3) -> DataFrame:
    """(v, mark) once no edge leads to a smaller mark: each node takes the largest of those that reach it. A few steps are one job."""
    total = None
    while True:
        now = marks
        for _ in range(steps):
            sent = edges.join(now, F.col("src") == F.col("v")).select(F.col("dst").alias("v"), "mark")
            now = now.unionByName(sent).groupBy("v").agg(F.max("mark").alias("mark"))
        before, marks = marks, materialize(now, "marks")
        if total is not None:
            discard(before)
        new = tuple(marks.agg(F.count("*"), F.sum(F.xxhash64("v", "mark").cast("decimal(38,0)"))).first())
        if new == total:
            return marks
        total = new


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component, size): nodes that reach each other; the component is named by its smallest node. Nodes on no cycle are left out.

    By colouring: every node takes the largest name that reaches it; within a
    colour, the nodes from which its root can be reached are the root's
    component; edges between colours and to settled nodes go, and the rest is
    coloured anew. Before each round, nodes without a way in or out are
    trimmed and chains contracted, so that a long cycle is one step long. A
    table of a row a node or edge is written each round; no closure is made.
    """
    left, placed, levels = edges.select("src", "dst"), [], []
    while True:
        left = trimmed(left, TRIM)
        # a contraction may leave new chains and new tails
        while True:
            n = left.count()
            left, chains, rings = contracted(left)
            loops = left.where("src = dst").select(F.col("src").alias("node"))
            levels.append((chains, loops))
            placed.append(rings)
            left = trimmed(left, TRIM)
            if not left.limit(1).count() or left.count() > 0.8 * n:
                break
        if not left.limit(1).count():
            break
        nodes = left.select(F.col("src").alias("v")).unionByName(left.select(F.col("dst").alias("v"))).distinct()
        color = _spread(left, nodes.select("v", F.col("v").alias("mark")))
        ends = left.join(color.select(F.col("v").alias("src"), F.col("mark").alias("a")), "src").join(color.select(F.col("v").alias("dst"), F.col("mark").alias("b")), "dst")
        same = materialize(ends.where("a = b").select("src", "dst"), "edges")
        back = same.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        found = _spread(back, color.where("v = mark"))  # only roots begin: a mark says that the root is reached
        placed.append(found.select(F.col("v").alias("node"), F.col("mark").alias("component")))
        settled = found.select("v")
        left = materialize(same.join(settled, F.col("src") == F.col("v"), "left_anti").join(settled, F.col("dst") == F.col("v"), "left_anti"), "edges")
    known = reduce(DataFrame.unionByName, placed)
    # what was contracted last comes back first: a chain belongs to its ends' component if that is one
    for chains, loops in reversed(levels):
        known = known.unionByName(loops.join(known.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")))
        a, b = known.select(F.col("node").alias("first"), F.col("component").alias("ca")), known.select(F.col("node").alias("last"), F.col("component").alias("cb"))
        known = materialize(known.unionByName(chains.join(a, "first").join(b, "last").where("ca = cb").select("node", F.col("ca").alias("component"))), "components")
    names = known.groupBy("component").agg(F.min("node").alias("name"), F.count("*").alias("size")).where("size > 1")
    return known.join(names, "component").select("node", F.col("name").alias("component"), "size")
