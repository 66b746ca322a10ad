"""Exact nearest-neighbour methods over numbers.

Equal rows are collapsed to one weighted point first, so no group of copies meets itself. The points are cut
into leaves by a k-d tree whose splits come from a bounded sample. Three passes follow, each reading one leaf's
points at a time:

1. The k nearest in a point's own leaf bound its radius; a walk down the tree finds the leaves whose boxes lie within
   it, and the point visits those. Most points visit none, and no point is copied to where it cannot matter.
2. A visited leaf answers with what lies within the visitor's radius, at most the k nearest and their ties. Leaves
   with many visitors are worked in slices.
3. Home again, a point's own leaf and the answers, which come sorted by point, are merged.

The sample steers the cuts only; every result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsift.functions.messages import REASONS
from oddsift.functions.scalars import significant
from oddsift.operators.model import Model, project
from oddsift.operators.numeric import deviation_reason, deviation_steps
from oddsift.operators.orderstats import TopCut, join_on_values, quantiles, top_cuts
from oddsift.operators.prepare import Prepared
from oddsift.session import materialize

MAX_LEAVES = 65_536
LEAF_ROWS = 8_192
SAMPLE_PER_LEAF = 32
QUERY_CHUNK = 256
#: distances of a chunk of points: a task holds a handful of such arrays, whatever the leaf and the number of neighbours
CHUNK_CELLS = 1 << 19
VISITS_PER_SLICE = 100_000
BALANCE = 0.2  # a side whose median leaves less than this on one hand gives way to the next widest

# Neighbour counts and the density guard.
KNN_MIN = 5
LOF_NEIGHBOURS = 20
DENSITY_GUARD = 1e-10
SCORE_DIGITS = 9
TIE_DECIMALS = 10  # distances this close are ties, so last-bit noise cannot split a shell


@dataclass
class Points:
    """Distinct points (pid, w, x0.., n0..) with their leaves, written once, and the tree over the leaves."""

    df: DataFrame
    dims: int
    count: int
    rows: int
    leaves: int
    tree: tuple

    @property
    def unique(self) -> bool:
        return self.count == self.rows


def _split(part: np.ndarray, share: float) -> tuple[int, float] | None:
    """Side and cut near the share-quantile: the widest side with a balanced cut, or else the best balanced one.

    Values below the cut go left. Where one value fills the place of the quantile, the cut goes beside it.
    """
    width = part.max(axis=0) - part.min(axis=0)
    best, found = -1.0, None
    for j in np.argsort(-width, kind="stable"):
        if not width[j] > 0:
            break
        x = part[:, j]
        at = min(max(int(len(x) * share), 1), len(x) - 1)
        value = np.partition(x, at)[at]
        above = x[x > value]
        for cut in ([value] if (x < value).any() else []) + ([above.min()] if len(above) else []):
            below = float((x < cut).mean())
            fit = min(below / share, (1 - below) / (1 - share))
            if fit > best:
                best, found = fit, (int(j), float(cut))
        if best >= 2 * BALANCE:
            break
    return found


def _grow_tree(sample: np.ndarray, leaves: int):
    """Splits near the median until there are ``leaves`` parts or equal points."""
    dim, cut, left, right = [], [], [], []
    leaf_of: list[int] = []

    def add(idx: np.ndarray, want: int) -> int:
        node = len(dim)
        dim.append(-1)
        cut.append(0.0)
        left.append(-1)
        right.append(-1)
        leaf_of.append(-1)
        found = _split(sample[idx], (want // 2) / want) if want > 1 and len(idx) > 1 else None
        if found:
            dim[node], cut[node] = found
            below = sample[idx, found[0]] < found[1]
            # a lopsided cut deals the parts by what it found
            take = min(max(round(want * below.mean()), 1), want - 1)
            left[node] = add(idx[below], take)
            right[node] = add(idx[~below], want - take)
            return node
        leaf_of[node] = add.leaves
        add.leaves += 1
        return node

    add.leaves = 0
    add(np.arange(len(sample)), leaves)
    return tuple(np.array(a) for a in (dim, cut, left, right, leaf_of)), add.leaves


def _leaf_udf(tree):
    dim, cut, left, right, leaf_of = tree

    @F.pandas_udf("int")
    def leaf(cols: pd.DataFrame) -> pd.Series:
        x = cols.to_numpy(dtype=float)
        node = np.zeros(len(x), dtype=np.int64)
        while True:
            inner = np.flatnonzero(dim[node] >= 0)
            if not len(inner):
                return pd.Series(leaf_of[node].astype("int32"))
            at = node[inner]
            go_left = x[inner, dim[at]] < cut[at]
            node[inner] = np.where(go_left, left[at], right[at])

    return leaf


def distinct_points(p: Prepared, k: int, leaf_rows: int | None = None) -> Points:
    dims = len(p.numeric)
    raw = [f"n{j}" for j in range(dims)]
    z = [e.alias(f"x{j}") for j, e in enumerate(p.standardised())]
    grouped = p.df.groupBy(*raw).agg(F.count(F.lit(1)).alias("w"), F.min("row_id").alias("pid"))
    flat = materialize(grouped.select("pid", "w", *z, *raw), "points")
    count = flat.count()
    cores = p.df.sparkSession.sparkContext.defaultParallelism
    # a leaf that holds k points twice over bounds most radii by itself
    target = leaf_rows or max(2 * (k + 1), min(LEAF_ROWS, max(256, math.ceil(count / (4 * cores)))))
    leaves = min(MAX_LEAVES, max(1, math.ceil(count / target)))
    share = min(1.0, leaves * SAMPLE_PER_LEAF / count)
    steer = flat.filter(F.pmod(F.xxhash64("pid"), F.lit(1_000_000)) < math.ceil(share * 1_000_000))
    xs = [f"x{j}" for j in range(dims)]
    sample = steer.select(*xs).toPandas().to_numpy(dtype=float)  # at most about MAX_LEAVES * SAMPLE_PER_LEAF rows
    if len(sample) < 2:
        return Points(flat.withColumn("leaf", F.lit(0)), dims, count, p.rows, 1, _grow_tree(np.zeros((0, dims)), 1)[0])
    tree, leaves = _grow_tree(sample, leaves)
    placed = flat.withColumn("leaf", _leaf_udf(tree)(F.struct(*xs)))
    return Points(materialize(placed, "point-leaves"), dims, count, p.rows, leaves, tree)


class Boxes:
    """The tree with a box and a weight at every node."""

    def __init__(self, pts: Points):
        xs = [f"x{j}" for j in range(pts.dims)]
        found = pts.df.groupBy("leaf").agg(F.sum("w").alias("weight"), *[F.min(x).alias(f"lo_{x}") for x in xs], *[F.max(x).alias(f"hi_{x}") for x in xs])
        known = found.toPandas().set_index("leaf")  # one row per leaf, at most MAX_LEAVES
        _, _, self.left, self.right, self.leaf_of = pts.tree
        nodes = len(self.left)
        self.lo, self.hi = np.full((nodes, pts.dims), np.inf), np.full((nodes, pts.dims), -np.inf)
        self.weight = np.zeros(nodes)
        # children come after their parents
        for node in range(nodes - 1, -1, -1):
            leaf = self.leaf_of[node]
            if leaf < 0:
                a, b = self.left[node], self.right[node]
                self.lo[node], self.hi[node] = np.minimum(self.lo[a], self.lo[b]), np.maximum(self.hi[a], self.hi[b])
                self.weight[node] = self.weight[a] + self.weight[b]
            elif leaf in known.index:
                row = known.loc[leaf]
                self.lo[node], self.hi[node] = row[[f"lo_{x}" for x in xs]].to_numpy(float), row[[f"hi_{x}" for x in xs]].to_numpy(float)
                self.weight[node] = row["weight"]

    def radius(self, q: np.ndarray, k: int) -> float:
        """A radius around q that surely holds k rows besides itself: the far side of the nearest boxes that weigh enough."""
        at = np.flatnonzero((self.leaf_of >= 0) & (self.weight > 0))
        far = np.maximum(np.abs(self.hi[at] - q), np.abs(q - self.lo[at]))
        far = np.sqrt((far * far).sum(axis=1))
        order = np.argsort(far)
        enough = np.searchsorted(np.cumsum(self.weight[at][order]), k + 1)
        return float(far[order[min(enough, len(order) - 1)]])

    def touched(self, q: np.ndarray, radius: np.ndarray, home: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of q, leaf) for every leaf but ``home`` whose box begins within the radius."""
        rows, leaves = [], []
        reach = radius * (1 + 1e-9) + 1e-9
        stack = [(0, np.arange(len(q)))]
        while stack:
            node, at = stack.pop()
            gap = np.maximum(0, np.maximum(self.lo[node] - q[at], q[at] - self.hi[node]))
            at = at[np.sqrt((gap * gap).sum(axis=1)) <= reach[at]]
            leaf = self.leaf_of[node]
            if not len(at) or leaf == home or not self.weight[node]:
                continue
            if leaf >= 0:
                rows.append(at)
                leaves.append(np.full(len(at), leaf))
            else:
                stack += [(self.left[node], at), (self.right[node], at)]
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *rows]), np.concatenate([none, *leaves])


def _rows(width: int) -> int:
    """How many points are worked at a time when each meets ``width`` others."""
    return max(1, min(QUERY_CHUNK, CHUNK_CELLS // max(width, 1)))


def _distances(q: np.ndarray, x: np.ndarray, ties: bool) -> np.ndarray:
    acc = np.zeros((len(q), len(x)))
    for j in range(x.shape[1]):
        diff = q[:, j][:, None] - x[:, j][None, :]
        acc += diff * diff
    d = np.sqrt(acc)
    return np.round(d, TIE_DECIMALS) if ties else d


def _kth(d: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
    """Distance within which each row's entries weigh k; infinite where all of them do not."""
    if d.shape[1] > k + 1:
        idx = np.argpartition(d, k, axis=1)[:, : k + 1]
        d, w = np.take_along_axis(d, idx, 1), np.take_along_axis(w, idx, 1)
    order = np.argsort(d, axis=1)
    total = np.cumsum(np.take_along_axis(w, order, 1), axis=1)
    at = (total >= k).argmax(axis=1)
    rows = np.arange(len(d))
    return np.where(total[:, -1] >= k, d[rows, order[rows, at]], np.inf)


def _mean_distances(d: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
    if d.shape[1] > k + 1:
        # all but a point itself weigh one at least
        idx = np.argpartition(d, k, axis=1)[:, : k + 1]
        d, w = np.take_along_axis(d, idx, 1), np.take_along_axis(w, idx, 1)
    order = np.argsort(d, axis=1, kind="stable")
    d, w = np.take_along_axis(d, order, 1), np.take_along_axis(w, order, 1)
    taken = np.clip(k - (np.cumsum(w, axis=1) - w), 0, w)
    return (np.where(taken > 0, d, 0) * taken).sum(axis=1) / k


def _edges(pid: np.ndarray, d: np.ndarray, w: np.ndarray, o: np.ndarray, k: int) -> pd.DataFrame:
    kd = _kth(d, w, k)[:, None]
    inner, shell = d < kd, d == kd
    before, on_shell = (w * inner).sum(axis=1), (w * shell).sum(axis=1)
    take = np.where(inner, w, np.where(shell, w * ((k - before) / on_shell)[:, None], 0))
    i, j = np.nonzero(take > 0)
    return pd.DataFrame({"q": pid[i], "o": o[i, j], "d": d[i, j], "take": take[i, j], "kd": kd[i, 0]})


def _own(x: np.ndarray, pid: np.ndarray, w: np.ndarray, at: slice, ties: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distances and weights of a leaf's points seen from some of them; a row is not its own neighbour, its copies are."""
    d = _distances(x[at], x, ties)
    weights = np.repeat(w[None, :].astype(float), len(d), axis=0)
    weights[np.arange(len(d)), np.arange(at.start, at.start + len(d))] -= 1
    return d, weights


def _leaf_runs(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[tuple[bool, pd.DataFrame]]:
    """Batches sorted by ``key``, cut where the key changes; tells whether a run begins."""
    last = None
    for pdf in batches:
        values = pdf[key].to_numpy()
        starts = np.flatnonzero(np.r_[True, (values[1:] != values[:-1]).any(axis=1)]) if len(values) else []
        for a, b in zip(starts, [*starts[1:], len(values)]):
            this = tuple(values[a])
            yield this != last, pdf.iloc[a:b]
            last = this


def visits(pts: Points, k: int, ties: bool) -> DataFrame:
    """(leaf, home, pid, radius, x..): the points that have to ask another leaf."""
    xs = [f"x{j}" for j in range(pts.dims)]
    boxes = Boxes(pts)  # travels with the function, by value

    def leave(parts: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = pd.concat(parts)
        home = int(whole["leaf"].iloc[0])
        x, pid, w = whole[xs].to_numpy(float), whole["pid"].to_numpy(), whole["w"].to_numpy()
        step = _rows(len(x))
        for at in range(0, len(x), step):
            some = slice(at, min(at + step, len(x)))
            radius = _kth(*_own(x, pid, w, some, ties), k)
            for i in np.flatnonzero(np.isinf(radius)):
                radius[i] = boxes.radius(x[at + i], k)
            row, leaf = boxes.touched(x[some], radius, home)
            if len(row):
                out = {"leaf": leaf.astype("int32"), "home": np.full(len(row), home, "int32"), "pid": pid[some][row], "radius": radius[row]}
                yield pd.DataFrame(out | {c: x[some][row, j] for j, c in enumerate(xs)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: list[pd.DataFrame] = []
        for new, part in _leaf_runs(batches, ["leaf"]):
            if new and parts:
                yield from leave(parts)
                parts = []
            parts.append(part)
        if parts:
            yield from leave(parts)

    by_leaf = pts.df.select("leaf", "pid", "w", *xs).repartition("leaf").sortWithinPartitions("leaf", "pid")
    return by_leaf.mapInPandas(run, "leaf int, home int, pid bigint, radius double, " + ", ".join(f"{x} double" for x in xs))


def answers(pts: Points, asked: DataFrame, k: int, ties: bool, per_slice: int = VISITS_PER_SLICE) -> DataFrame:
    """(leaf, q, o, d, w): what the visited leaves hold within each visitor's radius; leaf is the visitor's home."""
    xs = [f"x{j}" for j in range(pts.dims)]
    # one row per visited leaf
    sliced = asked.groupBy("leaf").agg(F.ceil(F.count("*") / per_slice).cast("int").alias("slices"))
    hosts = pts.df.join(sliced, "leaf").select("leaf", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(0).alias("seq"),
                                               F.lit(None).cast("int").alias("home"), "pid", "w", F.lit(0.0).alias("radius"), *xs)
    guests = asked.join(sliced, "leaf").select("leaf", F.pmod(F.xxhash64("pid"), F.col("slices")).cast("int").alias("slice"), F.lit(1).alias("seq"),
                                               "home", "pid", F.lit(0).cast("bigint").alias("w"), "radius", *xs)
    stream = hosts.unionByName(guests).repartition("leaf", "slice").sortWithinPartitions("leaf", "slice", "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: list[pd.DataFrame] = []
        for new, part in _leaf_runs(batches, ["leaf", "slice", "seq"]):
            if part["seq"].iloc[0] == 0:
                parts = [part] if new else [*parts, part]
                continue
            if len(parts) > 1:
                parts = [pd.concat(parts)]
            x, o, w = parts[0][xs].to_numpy(float), parts[0]["pid"].to_numpy(), parts[0]["w"].to_numpy()
            q, pid, home, radius = part[xs].to_numpy(float), part["pid"].to_numpy(), part["home"].to_numpy(), part["radius"].to_numpy()
            step = _rows(len(x))
            for at in range(0, len(q), step):
                some = slice(at, at + step)
                d = _distances(q[some], x, ties)
                within = np.minimum(radius[some], _kth(d, np.broadcast_to(w.astype(float), d.shape), k))
                i, j = np.nonzero(d <= within[:, None])
                if len(i):
                    yield pd.DataFrame({"leaf": home[some][i].astype("int32"), "q": pid[some][i], "o": o[j], "d": d[i, j], "w": w[j]})

    return stream.mapInPandas(run, "leaf int, q bigint, o bigint, d double, w bigint")


def nearest(pts: Points, k: int, edges: bool) -> DataFrame:
    """(pid, score): mean distance to the k nearest rows; or the neighbour edges (q, o, d, take, kd)."""
    xs = [f"x{j}" for j in range(pts.dims)]
    found = answers(pts, materialize(visits(pts, k, edges), "visits"), k, edges)
    none = F.lit(None).cast("double")
    hosts = pts.df.select("leaf", F.lit(0).alias("seq"), "pid", F.lit(0).cast("bigint").alias("o"), none.alias("d"), "w", *xs)
    back = found.select("leaf", F.lit(1).alias("seq"), F.col("q").alias("pid"), "o", "d", "w", *[none.alias(x) for x in xs])
    stream = hosts.unionByName(back).repartition("leaf").sortWithinPartitions("leaf", "seq", "pid")

    def settle(home: pd.DataFrame, at: slice, more: pd.DataFrame) -> pd.DataFrame:
        """Some of a leaf's points, with the answers for them."""
        x, pid, w = home[xs].to_numpy(float), home["pid"].to_numpy(), home["w"].to_numpy()
        d, weights = _own(x, pid, w, at, edges)
        own = pid[at]
        o = np.broadcast_to(pid, d.shape)
        if len(more):
            row = np.searchsorted(own, more["pid"].to_numpy())
            count = np.bincount(row, minlength=len(own))
            place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            wide = [np.full((len(own), int(count.max())), fill) for fill in (np.inf, 0.0, -1)]
            for target, c in zip(wide, ("d", "w", "o")):
                target[row, place] = more[c].to_numpy()
            d, weights, o = (np.concatenate(pair, axis=1) for pair in zip((d, weights, o), wide))
        if edges:
            return _edges(own, d, weights, o, k)
        return pd.DataFrame({"pid": own, "score": _mean_distances(d, weights, k)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, home, done, held = [], None, 0, []

        def upto(stop: int) -> Iterator[pd.DataFrame]:
            """Settle the home's points before ``stop``, in chunks, from the answers held."""
            nonlocal done, held
            more = pd.concat(held) if held else back_none
            pid, asked, step, used = home["pid"].to_numpy(), more["pid"].to_numpy(), _rows(len(home)), 0
            while done < stop:
                cuts = np.searchsorted(asked, pid[done : min(done + step, stop)], side="right")
                # a chunk is as wide as its point with the most answers
                width = np.maximum.accumulate(np.diff(cuts, prepend=used)) + len(home)
                take = max(1, int(np.searchsorted(width * np.arange(1, len(width) + 1), 2 * CHUNK_CELLS, side="right")))
                yield settle(home, slice(done, done + take), more.iloc[used : cuts[take - 1]])
                used, done = int(cuts[take - 1]), done + take
            held = [more.iloc[used:].copy()] if used < len(more) else []

        def close() -> Iterator[pd.DataFrame]:
            nonlocal home
            home = pd.concat(parts) if home is None else home
            yield from upto(len(home))

        for new, part in _leaf_runs(batches, ["leaf", "seq"]):
            if part["seq"].iloc[0] == 0:
                if new and parts:
                    yield from close()
                    parts, home, done, held = [], None, 0, []
                parts.append(part)
                continue
            home = pd.concat(parts) if home is None else home
            held.append(part)
            # points before the last one answered for have all their answers
            yield from upto(int(np.searchsorted(home["pid"].to_numpy(), part["pid"].iloc[-1])))
        if parts:
            yield from close()

    back_none = pd.DataFrame({c: [] for c in ("pid", "o", "d", "w")})
    return stream.mapInPandas(run, "q bigint, o bigint, d double, take double, kd double" if edges else "pid bigint, score double")


def local_outlier_factors(edges: DataFrame, k: int) -> DataFrame:
    """(pid, score) from neighbour edges: the neighbours' densities over the point's own."""
    reach_of = edges.select(F.col("q").alias("o"), F.col("kd").alias("kd_o")).distinct()
    lrd = (
        edges.join(reach_of, "o")
        .groupBy("q")
        .agg((1 / (F.sum(F.col("take") * F.greatest("kd_o", "d")) / k + DENSITY_GUARD)).alias("lrd"))
    )
    lrd = materialize(lrd, "lof-density")
    around = edges.join(lrd.select(F.col("q").alias("o"), F.col("lrd").alias("lrd_o")), "o")
    sums = around.groupBy("q").agg((F.sum(F.col("take") * F.col("lrd_o")) / k).alias("mean_lrd"))
    return sums.join(lrd, "q").select(
        F.col("q").alias("pid"), significant(F.col("mean_lrd") / F.col("lrd"), SCORE_DIGITS).alias("score")
    )


def _attach(p: Prepared, pts: Points, scored: DataFrame, out: str):
    """A function that joins point scores back to rows."""
    if pts.unique:
        by_row = scored.select(F.col("pid").alias("row_id"), F.col("score").alias(out))
        return lambda df: df.join(by_row, "row_id").select(*df.columns, out)
    raw = [f"n{j}" for j in range(pts.dims)]
    table = scored.select(*raw, "w", F.col("score").alias(out))
    return lambda df: join_on_values(df, table, raw, "w", p.rows, F.col("row_id"), pts.count).drop("w")


def _score_points(pts: Points, scored: DataFrame, label: str) -> DataFrame:
    return materialize(pts.df.drop("leaf", *[f"x{j}" for j in range(pts.dims)]).join(scored, "pid"), label)


def fit_knn(p: Prepared, rate: float, leaf_rows: int | None = None) -> Model:
    k = min(max(KNN_MIN, int(math.sqrt(p.rows))), p.rows - 1)
    pts = distinct_points(p, k, leaf_rows)
    scored = _score_points(pts, nearest(pts, k, edges=False), "knn-scores")
    cut: TopCut = top_cuts(scored, {"s": F.col("score")}, p.rows, rate, F.col("pid"), F.col("w"), pts.count)["s"]
    attach = _attach(p, pts, scored, "_knn")
    score = F.col("_knn")
    prefix = F.format_string(REASONS["knn"], score, F.lit(k))
    flag, why = cut.flags(score), deviation_reason(prefix, cut.threshold, score)
    steps = deviation_steps(p, flag)
    add = lambda df: project(attach(df), "knn", steps, score, flag, why).drop("_knn")
    return Model("knn", add, cut.threshold, {"k": float(k)})


def outlier_quantile(scored: DataFrame, rate: float, n: int, rows: int) -> float:
    """The cut that the share ``rate`` of rows lies above, interpolated on the negated score."""
    wanted = {"s": (-F.col("score"), n, [rate])}
    return -quantiles(scored, wanted, F.col("w"), rows)["s"][rate]


def fit_lof(p: Prepared, rate: float, leaf_rows: int | None = None) -> Model:
    k = min(LOF_NEIGHBOURS, p.rows - 1)
    pts = distinct_points(p, k, leaf_rows)
    edges = materialize(nearest(pts, k, edges=True), "lof-edges")
    scored = _score_points(pts, local_outlier_factors(edges, k), "lof-scores")
    cut = outlier_quantile(scored, rate, p.rows, pts.count)
    attach = _attach(p, pts, scored, "_lof")
    score = F.col("_lof")
    prefix = F.format_string(REASONS["lof"], score, score)
    flag, why = score > cut, deviation_reason(prefix, cut, score)
    steps = deviation_steps(p, flag)
    add = lambda df: project(attach(df), "lof", steps, score, flag, why).drop("_lof")
    return Model("lof", add, cut, {"n_neighbors": float(k)})
