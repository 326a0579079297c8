"""Embedding near-dedup by a pairwise join of rotated vectors: leading components first, exact cosines for what they leave."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import connected_components, discard, materialize

#: Vectors of one leaf, whose bounding boxes are held against each other; leaves of the other side in one stack of products.
#: Small products of contiguous blocks take little more than half the time of large ones here.
LEAF, WIDTH = 128, 8
#: Pairs that wait for their cosines.
PAIRS = 65_536
#: Copies of the table on their way at once, and bytes that may be so besides, whatever the table's size.
COPIES, ROOM = 3, 2**28


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """A seeded random orthogonal matrix: it spreads a vector's energy evenly over the components."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def packed(column: pa.Array) -> list[tuple[int, bytes] | tuple[None, None]]:
    """Length and bytes of each vector: components in single precision where that holds them all, else in double.

    Vectors that are null, empty or zero or hold null or non-finite components
    have neither. Equal vectors have equal bytes; -0.0 is 0.0.
    """
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    out: list = [(None, None)] * len(size)
    for dim in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == dim)
        flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)  # nulls become NaN
        x = flat.astype(np.float64).reshape(len(at), dim) + 0.0
        fine = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        with np.errstate(over="ignore", invalid="ignore"):
            single = x.astype(np.float32)
        narrow = (single == x).all(axis=1)
        for k in np.flatnonzero(fine).tolist():
            out[at[k]] = (dim, (single if narrow[k] else x)[k].tobytes())
    return out


def _matrix(rows: pd.Series, dim: int) -> np.ndarray:
    """Vectors of packed bytes; those in double precision scaled by powers of two, so that no product overflows."""
    if (rows.str.len() == 4 * dim).all():
        return np.frombuffer(b"".join(rows), np.float32).reshape(-1, dim)
    x = np.array([np.frombuffer(b, np.float32 if len(b) == 4 * dim else np.float64) for b in rows], np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _leaves(y: np.ndarray) -> np.ndarray:
    """An order of the rows in which each LEAF of them are near each other: halved again and again on the widest axis."""
    order, open_ = np.arange(len(y)), [(0, len(y))]
    while open_:
        lo, hi = open_.pop()
        if hi - lo <= LEAF:
            continue
        own = order[lo:hi]
        mid = ((hi - lo + LEAF - 1) // LEAF + 1) // 2 * LEAF
        order[lo:hi] = own[np.argpartition(y[own, y[own].var(axis=0).argmax()], mid - 1)]
        open_ += [(lo, lo + mid), (lo + mid, hi)]
    return order


class Tile:
    """Vectors of one tile, near ones together: as given, rotated, and their leading components with the norm of the rest."""

    def __init__(self, pdf: pd.DataFrame, dim: int):
        x, rot = _matrix(pdf["x"], dim), rotation(dim)
        lead = dim if dim <= 32 else max(31, 3 * dim // 8 - 1)
        square = np.empty(len(x))
        y, part = np.empty((len(x), dim), np.float32), np.empty((len(x), lead + 1), np.float32)
        for lo in range(0, len(x), 4096):
            own = x[lo : lo + 4096].astype(np.float64)
            square[lo : lo + 4096] = norm = np.einsum("ij,ij->i", own, own)
            turned = own / np.sqrt(norm)[:, None] @ rot
            y[lo : lo + 4096], part[lo : lo + 4096, :lead] = turned, turned[:, :lead]
            part[lo : lo + 4096, lead] = np.sqrt((turned[:, lead:] ** 2).sum(axis=1))
        order = _leaves(part)
        self.x, self.square, self.y, self.lead = x[order], square[order], y[order], part[order]
        self.uid, self.copies = pdf["uid"].to_numpy()[order], pdf["copies"].to_numpy()[order]
        first = np.arange(0, len(x), LEAF)
        whole = np.zeros((len(first) * LEAF, lead + 1), np.float32)
        whole[: len(x)] = self.lead
        self.across = np.ascontiguousarray(whole.reshape(-1, LEAF, lead + 1).transpose(0, 2, 1))  # a leaf's rows as columns
        self.low, self.high = np.minimum.reduceat(self.lead, first), np.maximum.reduceat(self.lead, first)


def cosines(one: Tile, two: Tile, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of paired rows in double precision, by the SQL's formula."""
    out = np.einsum("ij,ij->i", one.x[i].astype(np.float64), two.x[j].astype(np.float64))
    return out / np.sqrt(one.square[i] * two.square[j])


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Add edges a - b to a forest in which every vertex points at the smallest of its component."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root[:] = up


def met(one: Tile, two: Tile, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of two tiles' vectors, or within one: (copies that each vector links to, a forest over the links); ``two``'s rows follow ``one``'s.

    The lead of a vector is a vector of its own length, and two of them have no
    smaller product and no larger distance than the whole vectors: leaves whose
    boxes lie further apart are passed over, of the others one product in
    single precision, with a slack for its rounding, leaves the pairs whose
    cosine is computed in double precision. Where a product leaves many, as
    among near copies, one over all components settles those that are clear.
    """
    inner, dim = one is two, one.y.shape[1]
    slack = (dim + 8) * 2.0**-23
    floor, reach = np.float32(least - slack), 2 - 2 * least + 8 * slack
    off = 0 if inner else len(one.uid)
    counts, root = np.zeros(off + len(two.uid), np.int64), np.arange(off + len(two.uid))
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def add(p: np.ndarray, q: np.ndarray) -> None:
        nonlocal held
        waiting.append((p, q))
        held += len(p)
        if held > PAIRS:
            settle()

    def settle() -> None:
        nonlocal held
        i, j = (np.concatenate(v) for v in zip(*waiting, (np.zeros(0, np.int64),) * 2))
        waiting.clear()
        held = 0
        links = cosines(one, two, i, j) >= least
        i, j = i[links], j[links]
        np.add.at(counts, i, two.copies[j])
        np.add.at(counts, j + off, one.copies[i])
        unite(root, i, j + off)

    def dense(a: slice, b: slice) -> None:
        cos = one.y[a] @ two.y[b].T
        sure, open_ = cos >= np.float32(least + slack), np.abs(cos - np.float32(least)) <= np.float32(2 * slack)
        if inner:
            upper = np.arange(a.start, a.stop)[:, None] < np.arange(b.start, b.stop)
            sure, open_ = sure & upper, open_ & upper
        p, q = np.nonzero(open_ & ~sure)
        add(p + a.start, q + b.start)
        number = sure.astype(np.float64)
        mine, theirs = slice(a.start, a.stop), slice(b.start + off, b.stop + off)
        counts[mine] += (number @ two.copies[b]).astype(np.int64)
        counts[theirs] += (one.copies[a] @ number).astype(np.int64)
        p, q = np.nonzero(sure & (root[mine][:, None] != root[theirs]))
        unite(root, p + a.start, q + theirs.start)

    room = np.empty((WIDTH, LEAF, LEAF), np.float32)
    for k in range(len(one.low)):
        a = slice(k * LEAF, min(len(one.uid), (k + 1) * LEAF))
        gap = np.maximum(np.maximum(two.low - one.high[k], one.low[k] - two.high), 0)
        near = np.flatnonzero((gap * gap).sum(axis=1) <= reach)
        near = near[near >= k] if inner else near
        n = 0
        while n < len(near):
            m = n + 1
            while m < len(near) and m - n < WIDTH and near[m] == near[m - 1] + 1:
                m += 1
            first, last = int(near[n]), int(near[m - 1]) + 1
            n = m
            shape = (last - first, a.stop - a.start, LEAF)
            part = np.matmul(one.lead[a], two.across[first:last], out=room if shape == room.shape else None)
            if part.max() < floor:
                continue
            leaf, p, q = np.unravel_index(np.flatnonzero(part >= floor), shape)
            if len(p) > part.size / 64:
                dense(a, slice(first * LEAF, min(len(two.uid), last * LEAF)))
                continue
            p, q = p + a.start, q + (first + leaf) * LEAF
            fine = (q < len(two.uid)) & (p < q if inner else True)
            add(p[fine], q[fine])
    settle()
    return counts, root


def links(vectors: DataFrame, least: float = 0.9, tile: int = 65_536) -> DataFrame:
    """Links among distinct vectors ``(uid long, dim int, x binary, copies long)``, ``x`` as ``packed`` makes it, with cosine >= ``least``.

    Returns ``(a long, b long, n long)``: b = -1, the vector a links to n copies
    of others in some tiles; b >= 0, an edge a - b of forests over the links.

    The vectors of a length are dealt evenly to tiles of about ``tile`` vectors of
    64 components (fewer of more). In round r each tile meets the r-th after it,
    in a ring, so that a round sends every vector out twice and half as many
    rounds as tiles bring every two tiles together once. Rounds go in turn, as
    many at once as send no more than ``COPIES`` of the table and ``ROOM`` bytes:
    disk is in proportion to the table, whatever the number of tiles, and a
    group holds two tiles. Every round's links are added up with the earlier ones.
    """
    wide = F.ceil(F.col("n") * F.greatest("dim", F.lit(64)) / (64 * tile))
    sizes = vectors.groupBy("dim").agg(F.count("*").alias("n"), F.sum(F.length("x") + 64).alias("bytes"))
    tiles = materialize(sizes.select("dim", "bytes", F.greatest(wide, F.least(F.lit(6), F.ceil(F.col("n") / 1024))).cast("int").alias("tiles")), "tiles")
    most, size = tiles.agg(F.coalesce(F.max("tiles"), F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(1))).first()
    step = max(1, (COPIES + ROOM // size) // 2)
    body = vectors.select("uid", "dim", "x", "copies").join(tiles.select("dim", "tiles"), "dim")
    body = body.withColumn("t", F.pmod(F.xxhash64("uid"), F.col("tiles")).cast("int"))

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        one = Tile(pdf[pdf["side"] == 0], int(key[0]))
        two = Tile(pdf[pdf["side"] == 1], int(key[0])) if key[1] else one
        counts, root = met(one, two, least)
        uid = np.r_[one.uid, two.uid] if key[1] else one.uid
        some, moved = np.flatnonzero(counts), np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame({
            "a": np.r_[uid[some], uid[moved]],
            "b": np.r_[np.full(len(some), -1), uid[root[moved]]],
            "n": np.r_[counts[some], np.zeros(len(moved), np.int64)],
        })

    found = None
    for lo in range(0, most // 2 + 1, step):
        now = dealt(body, lo, lo + step).groupBy("dim", "round", "left").applyInPandas(meet, "a long, b long, n long")
        last, now = found, now if found is None else now.unionByName(found)
        found = materialize(now.groupBy("a", "b").agg(F.sum("n").alias("n")), "links")
        if last is not None:
            discard(last)
    discard(tiles)
    return found


def dealt(body: DataFrame, lo: int, hi: int) -> DataFrame:
    """Rows of the rounds from ``lo`` on and before ``hi``: ``(dim, round, left, side, uid, x, copies)``; ``left`` is the number of the pair's first tile."""
    tiles, t, r = F.col("tiles"), F.col("t"), F.col("round")
    rounds = F.when(F.lit(lo) <= F.floor(tiles / 2), F.sequence(F.lit(lo), F.least(F.lit(hi - 1), F.floor(tiles / 2).cast("int"))))
    sides = F.array(F.struct(t.alias("left"), F.lit(0).alias("side")), F.struct(F.pmod(t - r, tiles).alias("left"), F.lit(1).alias("side")))
    out = body.withColumn("round", F.explode(rounds)).withColumn("s", F.explode(sides))
    out = out.select("dim", "round", "s.left", "s.side", "uid", "x", "copies", "tiles").where("round > 0 or side = 0")
    # of an even ring, the round of opposite tiles names each pair twice
    return out.where((2 * r < tiles) | (r == 0) | (F.col("left") < r)).drop("tiles")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.9) -> DataFrame:
    """(key, n_links, component_id, kept) for every row: links at cosine >= ``least`` in double precision, none below.

    Equal vectors are one before the join and count each other after it, so a
    group of exact copies costs one vector. Vectors that are null, empty, zero
    or hold null or non-finite components link with nothing and are their own
    component; vectors of different lengths never link. Rows that repeat a key
    with a usable vector count as copies; a null key links too, while the
    component's id is the smallest non-null key. An empty table gives no rows.
    Other columns are ignored.
    """
    kind = vectors.schema[vector].dataType
    given = F.col(vector) if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else F.col(vector).cast("array<double>")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, xs = zip(*packed(batch.column(1))) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, pa.int32()), pa.array(xs, pa.binary())], ["id", "dim", "x"])

    rows = vectors.select(F.col(key).cast("long").alias("id"), given).mapInArrow(pack, "id long, dim int, x binary")
    good = rows.where("x is not null")
    classes = materialize(
        good.groupBy("dim", "x").agg(F.min("id").alias("low"), F.count("*").alias("copies")).withColumn("uid", F.monotonically_increasing_id()), "vectors"
    )
    found = links(classes, least)
    more = found.where("b < 0").groupBy(F.col("a").alias("uid")).agg(F.sum("n").alias("more"))
    roots = connected_components(found.where("b >= 0").select("a", "b"))
    placed = classes.select("uid", "low", "copies").join(more, "uid", "left").join(roots, F.col("uid") == F.col("v"), "left")
    placed = placed.select("uid", "low", "copies", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("root", "uid").alias("root"))
    least_id = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    placed = materialize(placed.join(least_id, "root").drop("root"), "placed")
    discard(found)
    # the only row of a vector has its key; rows that share one are looked up by it
    single = placed.where("copies = 1").select(F.col("low").alias("id"), "n_links", "component_id")
    shared = classes.where("copies > 1").select("uid", "dim", "x").join(placed.select("uid", "n_links", "component_id"), "uid").drop("uid")
    member = good.join(shared, ["dim", "x"]).select("id", "n_links", "component_id")
    alone = rows.where("x is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return single.unionByName(member).unionByName(alone).select(
        F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
    )
