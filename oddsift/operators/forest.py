"""Isolation forest: trees grown on small seeded samples, scored in Arrow batches.

The sample is part of the method. It is drawn by hash order, so it depends on row ids and the seed alone.
The forest has a fixed size (trees x nodes of one 256-row tree), which bounds what is broadcast.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddsift.functions.messages import REASONS
from oddsift.operators.model import Model, project
from oddsift.operators.numeric import deviation_reason, deviation_steps
from oddsift.operators.orderstats import quantiles
from oddsift.operators.prepare import Prepared
from oddsift.session import fill_cores, materialize

# Forest size, sample size and seed.
TREES = 200
SAMPLE = 256
SEED = 42
EULER = 0.5772156649015329
HASH_RANGE = 1 << 40


def expected_depth(rows: int) -> float:
    """Mean path length of an unsuccessful search among ``rows`` keys."""
    if rows <= 1:
        return 0.0
    if rows == 2:
        return 1.0
    return 2.0 * (math.log(rows - 1.0) + EULER) - 2.0 * (rows - 1.0) / rows


def tree_samples(p: Prepared, trees: int, size: int, seed: int) -> DataFrame:
    """(tree, place, n0..): ``size`` rows per tree, without replacement inside a tree."""
    cols = [f"n{j}" for j in range(len(p.numeric))]
    below = int(HASH_RANGE * min(1.0, (2 * size + 64) / p.rows))

    def draw(tree):
        return F.pmod(F.xxhash64("row_id", tree, F.lit(seed)), F.lit(HASH_RANGE))

    # a row is copied only for the trees that may want it
    wanted = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < below)
    near = p.df.select("row_id", *cols, F.explode(wanted).alias("tree")).withColumn("draw", draw(F.col("tree")))
    place = F.row_number().over(Window.partitionBy("tree").orderBy("draw", "row_id")) - 1
    return near.withColumn("place", place).filter(F.col("place") < size).select("tree", "place", *cols)


def _grow(x: np.ndarray, depth: int, rng: np.random.Generator):
    """One tree in heap order; below a leaf every node repeats the leaf, so descent has a fixed length."""
    nodes = 2 ** (depth + 1) - 1
    feature, cut, length = np.zeros(nodes, np.int32), np.full(nodes, np.inf), np.zeros(nodes)

    def fill(node: int, level: int, value: float) -> None:
        length[node] = value
        if level < depth:
            fill(2 * node + 1, level + 1, value)
            fill(2 * node + 2, level + 1, value)

    def split(node: int, idx: np.ndarray, level: int) -> None:
        part = x[idx]
        low, high = part.min(axis=0), part.max(axis=0)
        open_sides = np.flatnonzero(high > low)
        if level == depth or len(idx) <= 1 or not len(open_sides):
            fill(node, level, level + expected_depth(len(idx)))
            return
        j = int(rng.choice(open_sides))
        at = rng.uniform(low[j], high[j])
        left = part[:, j] <= at
        if left.all():
            at, left = low[j], part[:, j] <= low[j]
        feature[node], cut[node] = j, at
        split(2 * node + 1, idx[left], level + 1)
        split(2 * node + 2, idx[~left], level + 1)

    split(0, np.arange(len(x)), 0)
    return feature, cut, length


def grow_forest(p: Prepared, trees: int = TREES, size: int = SAMPLE, seed: int = SEED):
    size = min(size, p.rows)
    depth = math.ceil(math.log2(max(size, 2)))
    cols = [f"n{j}" for j in range(len(p.numeric))]

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = pdf.sort_values("place")[cols].to_numpy(dtype=float)
        feature, cut, length = _grow(x, depth, np.random.default_rng([seed, tree]))
        return pd.DataFrame({"tree": [tree], "feature": [feature], "cut": [cut], "length": [length]})

    schema = "tree int, feature array<int>, cut array<double>, length array<double>"
    cores = p.df.sparkSession.sparkContext.defaultParallelism
    dealt = tree_samples(p, trees, size, seed).repartition(min(trees, 2 * cores), "tree")
    grown = dealt.groupBy("tree").applyInPandas(build, schema).toPandas().sort_values("tree")
    stacked = tuple(np.stack(grown[c].to_numpy()) for c in ("feature", "cut", "length"))
    return stacked, depth, size


def forest_scores(p: Prepared, forest) -> DataFrame:
    """(row_id, score) with score = 2^(-mean path length / expected path length)."""
    stacked, depth, size = forest
    spark = p.df.sparkSession
    shared = spark.sparkContext.broadcast(stacked)
    norm = expected_depth(size)

    @F.pandas_udf("double")
    def score(cols: pd.DataFrame) -> pd.Series:
        feature, cut, length = shared.value
        x = np.ascontiguousarray(cols.to_numpy(dtype=float))
        n, dims = x.shape
        flat, base = x.ravel(), np.arange(n) * dims
        total = np.zeros(n)
        for f, c, h in zip(feature, cut, length):
            node = np.zeros(n, dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (flat[base + f[node]] > c[node])
            total += h[node]
        return pd.Series(2.0 ** (-(total / len(feature)) / norm))

    return fill_cores(p.df, p.rows).select("row_id", score(F.struct(*[f"n{j}" for j in range(len(p.numeric))])).alias("score"))


def fit_isolation_forest(p: Prepared, rate: float, trees: int = TREES, seed: int = SEED) -> Model:
    scored = materialize(forest_scores(p, grow_forest(p, trees, SAMPLE, seed)), "forest-scores")
    cut = -quantiles(scored, {"s": (-F.col("score"), p.rows, [rate])})["s"][rate]
    table = scored.select("row_id", F.col("score").alias("_forest"))
    score = F.col("_forest")
    prefix = F.format_string(REASONS["isolation_forest"], score)
    flag, why = score > cut, deviation_reason(prefix, cut, score)
    steps = deviation_steps(p, flag)

    def add(df: DataFrame) -> DataFrame:
        return project(df.join(table, "row_id"), "isolation_forest", steps, score, flag, why).drop("_forest")

    return Model("isolation_forest", add, cut, {"n_estimators": float(trees), "random_state": float(seed)})
