"""Hard negatives of anchors: exact integer products, after partial products of a PCA rotation have discarded most pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

#: Shares of the rotated components after which pairs are tested; what is left is bounded by the residual norms.
STAGES = (0.125, 0.25, 0.5, 1.0)
#: Below this sum of magnitudes, products in double precision are exact integers.
EXACT = float(2**52)
LEAST_LONG, MOST_LONG = -(2**63), 2**63 - 1


def quantized(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component in double precision; null unless all components are finite."""
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # 2**52 and above are integers already; there the double's own floor keeps its value and its sign
    floored = lambda x: F.when(F.abs(x * scale) < EXACT, F.floor(x * scale).cast("double")).otherwise(
        F.greatest(F.least(x * scale, F.lit(1.7976931348623157e308)), F.lit(-1.7976931348623157e308)))
    return F.when(fine, F.transform(v, floored))


def rotations(vectors: DataFrame) -> dict[int, np.ndarray]:
    """An orthogonal matrix for each dimension, leading components first: eigenvectors of the second moments over all rows ``(dim, x)``.

    Tasks sum their own outer products, Spark adds them up: the driver gets one
    number a pair of components. Vectors are scaled by powers of two for this
    sum alone, so that none overflows; any orthogonal matrix gives right results.
    """

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            for dim, own in pdf.groupby("dim"):
                x = np.array(own["x"].tolist(), np.float64).reshape(len(own), int(dim))
                most = np.abs(x).max(axis=1, initial=0.0, keepdims=True)
                x = np.where(most > 1e100, x / np.maximum(most, 1.0), x)
                held[int(dim)] = held.get(int(dim), 0) + x.T @ x
        for dim, m in held.items():
            i, j = np.triu_indices(dim)
            yield pd.DataFrame({"dim": dim, "i": i, "j": j, "s": m[i, j]})

    found = vectors.select("dim", "x").where("dim > 0").mapInPandas(moments, "dim int, i int, j int, s double")
    rows = found.groupBy("dim", "i", "j").agg(F.sum("s").alias("s")).toPandas()
    out = {}
    for dim, own in rows.groupby("dim"):
        m = np.zeros((int(dim), int(dim)))
        m[own["i"], own["j"]] = own["s"]
        m = np.triu(m) + np.triu(m, 1).T
        values, q = np.linalg.eigh(m / max(np.abs(m).max(), 1e-300))
        out[int(dim)] = np.ascontiguousarray(q[:, np.argsort(-values, kind="stable")])
    return out


class Rotated:
    """Integer vectors with their rotated components and the norms of what follows each stage."""

    def __init__(self, x: np.ndarray, rot: np.ndarray | None):
        self.x, dim = x, x.shape[1]
        with np.errstate(over="ignore", invalid="ignore"):
            self.y = x @ rot if rot is not None else x
        self.cuts = sorted({max(1, int(np.ceil(dim * s))) for s in STAGES}) if dim else [0]
        with np.errstate(over="ignore", invalid="ignore"):
            self.norm = np.sqrt((x * x).sum(axis=1))
            self.rest = [np.sqrt((self.y[:, c:] ** 2).sum(axis=1)) for c in self.cuts]

    def take(self, rows: np.ndarray | slice) -> Rotated:
        out = object.__new__(Rotated)
        out.x, out.y, out.norm, out.cuts, out.rest = self.x[rows], self.y[rows], self.norm[rows], self.cuts, [r[rows] for r in self.rest]
        return out


def products(a: np.ndarray, b: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Exact integer inner products of paired rows; Python's own integers where double precision might round."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.einsum("ij,ij->i", a, b)
    large = ~(bound < EXACT)
    if not large.any():
        return out.astype(np.int64)
    exact = out.astype(object)
    for k in np.flatnonzero(large):
        exact[k] = sum(int(p) * int(q) for p, q in zip(a[k], b[k]))
    exact[~large] = [int(v) for v in out[~large]]
    return exact


def best(anchors: Rotated, rows: Rotated, allowed, low: np.ndarray, high: np.ndarray, k: int, tie) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the first ``k`` ``allowed`` rows of each anchor with low <= score <= high; scores descend, ties by ``tie``.

    Partial products over the leading components, plus and minus the product
    of the residual norms and a slack for rounding, enclose each score. A pair
    goes when its interval misses [low, high], or when k intervals lie inside
    [low, high] and wholly above it. Survivors get exact integer products.
    """
    none = np.zeros(0, np.int64)
    if not len(rows.x) or not len(anchors.x):
        return none, none, none
    dim = anchors.x.shape[1]
    low_, high_ = _floats(low)[:, None], _floats(high)[:, None]
    with np.errstate(over="ignore", invalid="ignore"):
        slack = (8 * dim + 64) * np.finfo(float).eps * anchors.norm[:, None] * rows.norm[None, :]
        part, alive, done = np.zeros(slack.shape), allowed.copy(), 0
        wide = 1e-12 * np.nan_to_num(np.abs(low_), posinf=0.0) + 1e-12 * np.nan_to_num(np.abs(high_), posinf=0.0)  # rounding of the limits themselves
        for cut, ra, rb in zip(anchors.cuts, anchors.rest, rows.rest):
            part += anchors.y[:, done:cut] @ rows.y[:, done:cut].T
            done = cut
            reach = ra[:, None] * rb[None, :] + slack
            top, bottom = part + reach, part - reach
            alive &= ~(top < low_ - wide) & ~(bottom > high_ + wide)
            if alive.shape[1] > k:
                sure = np.where(alive & (bottom >= low_ + wide) & (top <= high_ - wide), bottom, -np.inf)
                floor = np.partition(sure, -k, axis=1)[:, -k]
                alive &= ~(top < floor[:, None])
            if alive.sum() <= k * len(alive):
                break
    i, j = np.nonzero(alive)
    scores = products(anchors.x[i], rows.x[j], anchors.norm[i] * rows.norm[j])
    held = np.array([low[a] <= s <= high[a] for a, s in zip(i, scores)], bool) if scores.dtype == object else (scores >= low[i]) & (scores <= high[i])
    i, j, scores = i[held], j[held], scores[held]
    order = np.lexsort((*tie(j), _descending(scores), i))
    i, j, scores = i[order], j[order], scores[order]
    first = np.r_[True, i[1:] != i[:-1]] if len(i) else np.zeros(0, bool)
    rank = np.arange(len(i)) - np.maximum.accumulate(np.where(first, np.arange(len(i)), 0))
    return i[rank < k], j[rank < k], scores[rank < k]


def _descending(scores: np.ndarray) -> np.ndarray:
    """Numbers that sort as the scores do, the highest first."""
    if scores.dtype != object:
        return -scores
    place = {v: n for n, v in enumerate(sorted(set(scores), reverse=True))}
    return np.array([place[v] for v in scores], np.int64)


def _floats(limits: np.ndarray) -> np.ndarray:
    if limits.dtype != object:
        return limits.astype(float)
    return np.array([float(v) if abs(v) < 10**300 else np.copysign(np.inf, v > 0 or -1) for v in limits])


def _long(scores: np.ndarray) -> np.ndarray:
    return np.array([min(max(int(s), LEAST_LONG), MOST_LONG) for s in scores], np.int64) if scores.dtype == object else scores


def _matrix(rows: pd.Series, dim: int) -> np.ndarray:
    return np.array(rows.tolist(), np.float64).reshape(len(rows), dim)


def _frame(parts: list[pd.DataFrame], columns: str) -> pd.DataFrame:
    """One frame of the parts, typed even where there are none; strings stay plain objects."""
    kinds = {c: {"keyless": bool, "exact": object}.get(c, np.int64) for c in ["uid", *columns.split()]}
    return pd.concat(parts).astype(kinds) if parts else pd.DataFrame({c: np.zeros(0, k) for c, k in kinds.items()}).astype(kinds)


def _tie(pdf: pd.DataFrame):
    """Ties: smaller key first, null last, then the row's number."""
    keys = [pdf[c].to_numpy() for c in ("uid", "id", "keyless")]
    return lambda j: tuple(k[j] for k in keys)


def mine(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", anchor: Column | None = None,
    positives: int = 5, negatives: int = 10, band: tuple[int, int] = (30, 90), block: int = 2048, shard: int = 8192,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that ``anchor`` marks.

    The first ``positives`` other rows of an anchor's label by integer inner
    product are its positives; the first ``negatives`` rows of other labels
    whose score is from ``band[0]`` to ``band[1]`` hundredths of a positive's
    are that positive's hard negatives. Higher scores come first, ties by
    smaller key, null keys last.

    Anchors, the query set, are met with all rows block by block: rows of a
    label are dealt to shards by their number, anchors to blocks, so no label,
    however many rows it has, meets in one task. A task keeps the first few of
    a shard; Spark ranks these over the shards. Vectors of different lengths
    never meet. Rows with a null label, a null vector or any null or
    non-finite component take no part; an empty vector scores 0. Rows that
    repeat a key are rows of their own; a null key is never an anchor by the
    default mark, but may be positive or negative. Scores are exact whatever
    the components' size; beyond a long they are ranked between shards, and returned, as the nearest long.
    An empty table gives no rows; extra columns are ignored.
    """
    anchor = (F.col(key) % 100 == 0) if anchor is None else anchor
    rows = vectors.select(
        F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("id"), F.col(key).isNull().alias("keyless"), F.col(label).cast("long").alias("label"), quantized(F.col(vector)).alias("x"), F.coalesce(anchor, F.lit(False)).alias("anchor")
    ).where("label is not null and x is not null")
    rows = materialize(rows.withColumns({"dim": F.size("x"), "uid": F.monotonically_increasing_id()}), "negatives-rows")
    shared = rows.sparkSession.sparkContext.broadcast(rotations(rows))
    number = F.xxhash64(F.lit(3), "uid")
    room = F.ceil(F.count("*") * F.greatest(F.col("dim"), F.lit(64)) / (64 * shard))  # longer vectors, fewer rows a shard
    sizes = rows.groupBy("dim", "label").agg(room.alias("shards"))
    query = rows.where("anchor")
    blocks = query.groupBy("dim", "label").agg(F.ceil(F.count("*") / block).alias("blocks"))
    plan = materialize(sizes.join(blocks, ["dim", "label"]), "negatives-plan")  # a row a label that has anchors
    whole = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    apart = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # noqa: E731  both sides come from one table
    keys = ["dim", "label", "block", "shard"]
    own_block, own_shard = F.pmod(number, F.col("blocks")), F.pmod(number, F.col("shards"))
    asks = query.join(plan, ["dim", "label"]).select("dim", "label", own_block.alias("block"), F.explode(whole(F.col("shards"))).alias("shard"), "uid", "id", "keyless", "x")
    gives = rows.join(plan, ["dim", "label"]).select("dim", "label", F.explode(whole(F.col("blocks"))).alias("block"), own_shard.alias("shard"), "uid", "id", "keyless", "x")

    def nearest(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        dim, rot = int(key[0]), shared.value.get(int(key[0]))
        a, b = Rotated(_matrix(left["x"], dim), rot), Rotated(_matrix(right["x"], dim), rot)
        out, tie = [], _tie(right)
        for lo in range(0, len(left), 256):
            part = a.take(slice(lo, lo + 256))
            other = left["uid"].to_numpy()[lo : lo + 256, None] != right["uid"].to_numpy()[None, :]
            n = len(part.x)
            i, j, s = best(part, b, other, np.full(n, -np.inf), np.full(n, np.inf), positives, tie)
            out.append(pd.DataFrame({"uid": left["uid"].to_numpy()[lo + i], "p_uid": right["uid"].to_numpy()[j], "p_id": right["id"].to_numpy()[j], "keyless": right["keyless"].to_numpy()[j], "score": _long(s), "exact": [str(v) for v in s]}))
        return _frame(out, "p_uid p_id keyless score exact")

    met = asks.groupBy(*keys).cogroup(apart(gives).groupBy(*keys)).applyInPandas(nearest, "uid long, p_uid long, p_id long, keyless boolean, score long, exact string")
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "keyless", "p_id", "p_uid")
    chosen = met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    chosen = materialize(chosen, "negatives-positives")
    discard(plan)

    # every anchor with its positives' scores, against all rows of its dimension
    asked = query.join(chosen.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("place", "exact"))).alias("wanted")), "uid")
    plan2 = materialize(
        rows.groupBy("dim").agg(room.alias("shards")).join(asked.groupBy("dim").agg(F.ceil(F.count("*") / block).alias("blocks")), "dim"), "negatives-plan"
    )
    asks = asked.join(plan2, "dim").select("dim", own_block.alias("block"), F.explode(whole(F.col("shards"))).alias("shard"), "uid", "label", "x", "wanted")
    gives = rows.join(plan2, "dim").select("dim", F.explode(whole(F.col("blocks"))).alias("block"), own_shard.alias("shard"), "uid", "id", "keyless", "label", "x")
    least, most = band

    def hardest(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        dim, rot = int(key[0]), shared.value.get(int(key[0]))
        a, b = Rotated(_matrix(left["x"], dim), rot), Rotated(_matrix(right["x"], dim), rot)
        # a row for each positive of each anchor: its own limits of the score, as integers
        at, place, low, high = [], [], [], []
        for n, wanted in enumerate(left["wanted"]):
            for w in wanted:
                p = int(w["exact"])
                at.append(n)
                place.append(w["place"])
                low.append(-(-least * p // 100))
                high.append(most * p // 100)
        small = all(abs(v) < 2**62 for v in low + high)
        at, place = np.array(at, np.int64), np.array(place, np.int64)
        low, high = (np.array(v, np.int64 if small else object) for v in (low, high))
        mine, theirs, tie, out = left["label"].to_numpy(), right["label"].to_numpy(), _tie(right), []
        for lo in range(0, len(at), 256):
            own = at[lo : lo + 256]
            i, j, s = best(a.take(own), b, mine[own][:, None] != theirs[None, :], low[lo : lo + 256], high[lo : lo + 256], negatives, tie)
            out.append(pd.DataFrame({"uid": left["uid"].to_numpy()[own[i]], "place": place[lo + i], "negative_uid": right["uid"].to_numpy()[j], "negative_id": right["id"].to_numpy()[j], "keyless": right["keyless"].to_numpy()[j], "negative_score": _long(s)}))
        return _frame(out, "place negative_uid negative_id keyless negative_score")

    keys = ["dim", "block", "shard"]
    met = asks.groupBy(*keys).cogroup(apart(gives).groupBy(*keys)).applyInPandas(hardest, "uid long, place int, negative_uid long, negative_id long, keyless boolean, negative_score long")
    order = Window.partitionBy("uid", "place").orderBy(F.desc("negative_score"), "keyless", "negative_id", "negative_uid")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    named = lambda c: F.when(~F.col("keyless"), F.col(c))
    out = ranked.withColumn("negative_id", named("negative_id")).drop("keyless")
    out = out.join(chosen.select("uid", "place", named("p_id").alias("positive_id"), F.col("score").alias("positive_score")), ["uid", "place"])
    return out.join(query.select("uid", named("id").alias("anchor_id")), "uid").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
