"""Categorical methods.

A row's score depends only on its combination of values, so rows are collapsed to weighted combinations,
everything is counted and scored there, and one join carries the results back to the rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsift.functions.dist import binom_cdf, sidak_rate
from oddsift.functions.messages import REASONS
from oddsift.functions.scalars import significant, two_digits
from oddsift.operators.model import Model, outputs, pick, reason
from oddsift.operators.neighbors import DENSITY_GUARD, SCORE_DIGITS, outlier_quantile
from oddsift.operators.orderstats import BROADCAST_ROWS, join_on_values, top_cuts
from oddsift.operators.prepare import Prepared
from oddsift.session import materialize

# The p-value floor and the least neighbours of the neighbour method.
MIN_P_VALUE = 1e-300
LOF_MIN = 20

FULL_DEPTH_COLUMNS = 6  # up to here every subset of columns is summed at once (at most 64)
FIRST_DEPTHS = 3  # beyond, mismatch depths are added until every row has its neighbours


@dataclass
class Combinations:
    """Distinct combinations (c0.., w, first_row) and the counts behind them."""

    df: DataFrame
    count: int
    rows: int
    names: list[str]
    values: DataFrame  # (j, v, cnt, combos)
    kinds: list[tuple[int, float]] = field(default_factory=list)  # (distinct values, entropy in bits) per column

    @property
    def size(self) -> int:
        return len(self.names)

    @property
    def keys(self) -> list[str]:
        return [f"c{j}" for j in range(self.size)]


def _cells(df: DataFrame, keys: Sequence[str], carry: Sequence[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(j).alias("j"), F.col(c).alias("v")) for j, c in enumerate(keys)])
    return df.select(*carry, F.explode(cells).alias("cell")).select(*carry, "cell.j", "cell.v")


def combinations(p: Prepared) -> Combinations:
    keys = [f"c{j}" for j in range(len(p.categorical))]
    grouped = p.df.groupBy(*keys).agg(F.count(F.lit(1)).alias("w"), F.min("row_id").alias("first_row"))
    df = materialize(grouped, "combinations")
    values = materialize(
        _cells(df, keys, ["w"]).groupBy("j", "v").agg(F.sum("w").alias("cnt"), F.count(F.lit(1)).alias("combos")),
        "value-counts",
    )
    share = F.col("cnt") / p.rows
    per_column = values.groupBy("j").agg(
        F.count(F.lit(1)).alias("kinds"), F.sum("combos").alias("combos"), F.sum(-share * F.log2(share)).alias("bits")
    ).collect()
    got = {r["j"]: r for r in per_column}
    kinds = [(got[j]["kinds"], got[j]["bits"]) for j in range(len(keys))]
    return Combinations(df, got[0]["combos"], p.rows, list(p.categorical), values, kinds)


def relative_frequencies(p: Prepared) -> DataFrame:
    """(row_id, f0..): the share of rows that hold each cell's value in its column."""
    c = combinations(p)
    table = c.df.join(_value_arrays(c, c.values.withColumn("pv", F.lit(1.0))), "first_row")
    wide = table.select(*c.keys, "w", *[(F.col("counts")[j] / c.rows).alias(f"f{j}") for j in range(c.size)])
    joined = join_on_values(p.df.select("row_id", *c.keys), wide, c.keys, "w", c.rows, F.col("row_id"), c.count)
    return joined.select("row_id", *[f"f{j}" for j in range(c.size)])


def column_pairs(size: int) -> list[tuple[int, int]]:
    return list(itertools.combinations(range(size), 2))


def _value_arrays(c: Combinations, values: DataFrame) -> DataFrame:
    """(first_row, counts, pvs): each combination's value counts and p-values, in column order."""
    table = values.select("j", "v", "cnt", "combos", "pv")
    table_rows = sum(k for k, _ in c.kinds)
    hit = join_on_values(_cells(c.df, c.keys, ["first_row"]), table, ["j", "v"], "combos", c.count, F.col("first_row"), table_rows)
    sorted_cells = F.sort_array(F.collect_list(F.struct("j", "cnt", "pv")))  # one entry per column
    return hit.groupBy("first_row").agg(sorted_cells.alias("cells")).select(
        "first_row",
        F.transform("cells", lambda x: x["cnt"]).alias("counts"),
        F.transform("cells", lambda x: x["pv"]).alias("pvs"),
    )


def pair_counts(c: Combinations, pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """(k, va, vb, cnt, combos) for every observed pair of values."""
    return _pair_cells(c, pairs, ["w"]).groupBy("k", "va", "vb").agg(
        F.sum("w").alias("cnt"), F.count(F.lit(1)).alias("combos")
    )


def _pair_cells(c: Combinations, pairs: Sequence[tuple[int, int]], carry: Sequence[str]) -> DataFrame:
    cells = F.array(*[
        F.struct(F.lit(k).alias("k"), F.col(f"c{a}").alias("va"), F.col(f"c{b}").alias("vb"))
        for k, (a, b) in enumerate(pairs)
    ])
    return c.df.select(*carry, F.explode(cells).alias("cell")).select(*carry, "cell.k", "cell.va", "cell.vb")


def _pair_arrays(c: Combinations, pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """(first_row, joint): each combination's pair counts, in pair order."""
    table = materialize(pair_counts(c, pairs), "pair-counts")
    bound = c.count * len(pairs)
    hit = join_on_values(_pair_cells(c, pairs, ["first_row"]), table, ["k", "va", "vb"], "combos", c.count,
                         F.col("first_row"), bound)
    cells = F.sort_array(F.collect_list(F.struct("k", "cnt")))  # one entry per pair
    return hit.groupBy("first_row").agg(F.transform(cells, lambda x: x["cnt"]).alias("joint"))


def with_p_values(c: Combinations, rate: float) -> DataFrame:
    """Value counts with P(X <= count) under Binomial(rows, min(rate, 1 / kinds))."""
    rows = c.rows
    p0 = [min(rate, 1.0 / k) if k >= 2 else None for k, _ in c.kinds]

    @F.pandas_udf("double")
    def p_value(j: pd.Series, cnt: pd.Series) -> pd.Series:
        out = np.ones(len(j))
        jj, kk = j.to_numpy(), cnt.to_numpy()
        for col in np.unique(jj):
            if p0[col] is None:
                continue
            at = np.flatnonzero(jj == col)
            distinct, back = np.unique(kk[at], return_inverse=True)
            out[at] = binom_cdf(distinct, rows, p0[col])[back]
        return pd.Series(out)

    return c.values.withColumn("pv", p_value("j", "cnt"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


@dataclass
class CategoricalGroup:
    """Several categorical methods fitted together; their results come back in one join."""

    ids: list[str]
    add: Callable[[DataFrame], DataFrame]
    thresholds: dict[str, float | None]
    params: dict[str, dict[str, float]]

    def models(self) -> list[Model]:
        out = []
        for m in self.ids:
            def only(df, m=m):
                return self.add(df).select(*df.columns, f"{m}_score", f"{m}_flag", f"{m}_reason")
            out.append(Model(m, only, self.thresholds[m], self.params[m]))
        return out


def fit_categorical(p: Prepared, ids: Sequence[str], rate: float) -> CategoricalGroup:
    c = combinations(p)
    n, size = c.rows, c.size
    pairs = column_pairs(size)
    values = with_p_values(c, rate) if "binomial" in ids else c.values.withColumn("pv", F.lit(1.0))
    table = c.df.join(_value_arrays(c, values), "first_row")
    if size > 1 and {"chi_square", "cooccurrence"} & set(ids):
        table = table.join(_pair_arrays(c, pairs), "first_row")
    if "lof_categorical" in ids:
        table = table.join(category_outlier_factors(c), "first_row")

    counts, pvs = F.col("counts"), F.col("pvs")
    share = F.transform(counts, lambda x: x / n)
    live = [j for j, (_, bits) in enumerate(c.kinds) if bits > 0]
    a_of = F.array(*[F.lit(a + 1) for a, _ in pairs]) if pairs else None
    b_of = F.array(*[F.lit(b + 1) for _, b in pairs]) if pairs else None

    def expected(i: Column) -> Column:
        return F.element_at(counts, F.element_at(a_of, i + 1)) * F.element_at(counts, F.element_at(b_of, i + 1)) / n

    work = table.withColumn("share", share)
    score: dict[str, Column] = {}
    if "frequency" in ids:
        score["frequency"] = -F.log(F.array_min("share"))
    if "entropy" in ids:
        if live:
            rel = F.array(*[-F.log2(F.col("share")[j]) / F.lit(c.kinds[j][1]) for j in live])
            work = work.withColumn("rel", rel)
            score["entropy"] = _sum(F.col("rel")) / len(live)
        else:
            score["entropy"] = F.lit(0.0)
    if "chi_square" in ids:
        if size == 1:
            even = n / c.kinds[0][0]
            work = work.withColumn("residuals", F.array((F.lit(even) - counts[0]) / math.sqrt(even)))
        else:
            residual = F.transform("joint", lambda o, i: (expected(i) - o) / F.sqrt(expected(i)))
            work = work.withColumn("residuals", residual)
        score["chi_square"] = F.array_max("residuals")
    if "binomial" in ids:
        work = work.withColumn("pmin", F.array_min(pvs))
        score["binomial"] = -F.log10(F.greatest(F.lit(MIN_P_VALUE), F.least(F.lit(1.0), F.array_min(pvs))))
    if "cooccurrence" in ids:
        score["cooccurrence"] = (
            _sum(F.transform("joint", lambda o: -F.log(o / n))) / len(pairs) if size > 1 else F.lit(0.0)
        )
    if "lof_categorical" in ids:
        score["lof_categorical"] = F.col("cat_lof")
    scored = materialize(work.select("*", *[s.alias(f"s_{m}") for m, s in score.items()]), "scored-combinations")

    top = [m for m in ("frequency", "entropy", "chi_square", "cooccurrence") if m in ids]
    cuts = top_cuts(scored, {m: F.col(f"s_{m}") for m in top}, n, rate, F.col("first_row"), F.col("w"), c.count) if top else {}
    alpha = sidak_rate(rate, size)

    names, cells = c.names, [F.col(k) for k in c.keys]
    rarest = F.array_position("share", F.array_min("share")).cast("int")
    flags, reasons, thresholds, params = {}, {}, {}, {}
    for m in ids:
        s, flag, cut, extra = F.col(f"s_{m}"), F.lit(False), None, {}
        if m in cuts:
            flag, cut = cuts[m].flags(s), cuts[m].threshold
        if m == "frequency":
            name, value, pct = pick(names, rarest), pick(cells, rarest), F.element_at("share", rarest) * 100
            text = F.format_string(REASONS[m], name, value, pct)
            cut = math.exp(-cut) if cut is not None else None
            why = reason(text, name, value, pct / 100, cut)
        elif m == "entropy":
            if live:
                j = F.array_position("rel", F.array_max("rel")).cast("int")
                name, value = pick([names[i] for i in live], j), pick([cells[i] for i in live], j)
                bits = -F.log2(pick([F.col("share")[i] for i in live], j))
                why = reason(F.format_string(REASONS[m], s, name, value, bits), name, value, s, cut)
            else:
                why = reason(F.lit(""))
        elif m == "chi_square":
            j = F.array_position("residuals", F.array_max("residuals")).cast("int")
            if size == 1:
                text = F.format_string(REASONS["chi_square_one"], F.lit(names[0]), cells[0], s)
                why = reason(text, F.lit(names[0]), cells[0], s, cut)
            else:
                a, b = F.element_at(a_of, j), F.element_at(b_of, j)
                spots = [pick(names, a), pick(cells, a), pick(names, b), pick(cells, b)]
                why = reason(F.format_string(REASONS[m], *spots, s), spots[0], spots[1], s, cut, spots[2], spots[3])
        elif m == "binomial":
            flag, cut, extra = F.array_min("pvs") < alpha, alpha, {"alpha_coluna": alpha}
            j = F.array_position("pvs", F.array_min("pvs")).cast("int")
            name, value, pv = pick(names, j), pick(cells, j), F.array_min("pvs")
            why = reason(F.format_string(REASONS[m], name, value, two_digits(F.col("pmin")), two_digits(F.lit(alpha))),
                         name, value, pv, alpha)
        elif m == "cooccurrence":
            extra = {"pares": float(len(pairs))}
            if size > 1:
                j = F.array_position("joint", F.array_min("joint")).cast("int")
                a, b = F.element_at(a_of, j), F.element_at(b_of, j)
                spots = [pick(names, a), pick(cells, a), pick(names, b), pick(cells, b)]
                pct = F.array_min("joint") / n * 100
                why = reason(F.format_string(REASONS[m], *spots, pct), spots[0], spots[1], pct / 100, cut, spots[2], spots[3])
            else:
                why = reason(F.lit(""))
        else:
            cut = outlier_quantile(scored.select(s.alias("score"), "w"), rate, n, c.count)
            flag, extra = s > cut, {"n_neighbors": float(neighbour_count(n))}
            name, value, pct = pick(names, rarest), pick(cells, rarest), F.element_at("share", rarest) * 100
            why = reason(F.format_string(REASONS[m], s, name, value, pct), name, value, s, cut)
        flags[m], reasons[m], thresholds[m], params[m] = flag, why, cut, extra

    results = scored.select(
        *c.keys, "w", *[col for m in ids for col in outputs(m, F.col(f"s_{m}"), flags[m], reasons[m])]
    )

    def add(df: DataFrame) -> DataFrame:
        return join_on_values(df, results, c.keys, "w", n, F.col("row_id"), c.count).select(
            *df.columns, *[f"{m}_{part}" for m in ids for part in ("score", "flag", "reason")]
        )

    return CategoricalGroup(list(ids), add, thresholds, params)


def neighbour_count(n: int) -> int:
    return min(max(LOF_MIN, int(math.sqrt(n))), n - 1)


def mismatch_sums(df: DataFrame, keys: Sequence[str], count: int, measures: dict[str, Column], depth: int) -> DataFrame:
    """(gid, {name}_{m}): sums of each measure over the combinations that differ in exactly m columns.

    No pair of combinations is formed. Sums over all combinations that agree on a subset of columns are
    plain group-bys; adding and subtracting them over the subsets leaves the exact mismatch counts.
    """
    size = len(keys)
    subsets = [s for m in range(depth + 1) for s in itertools.combinations(range(size), size - m)]
    names = list(measures)
    masks = ", ".join("array(" + ", ".join("true" if j in s else "false" for j in range(size)) + ")" for s in subsets)
    base = df.select("gid", F.array(*keys).alias("_all"), *[e.alias(name) for name, e in measures.items()])
    spread = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(subsets) - 1))).alias("sid")).select(
        "gid", *names, "sid",
        F.zip_with("_all", F.element_at(F.expr(f"array({masks})"), F.col("sid") + 1), lambda v, keep: F.when(keep, v)).alias("key"),
    )
    bound = count * len(subsets)
    sums = spread.groupBy("sid", "key").agg(*[F.sum(x).alias(x) for x in names], F.count(F.lit(1)).alias("_combos"))
    if bound > BROADCAST_ROWS:
        sums = materialize(sums, "agreement-sums")
    miss_of = F.array(*[F.lit(size - len(s)) for s in subsets])
    hit = join_on_values(spread.select("gid", "sid", "key"), sums, ["sid", "key"], "_combos", count, F.col("gid"), bound)
    miss = F.element_at(miss_of, F.col("sid") + 1)
    agreed = hit.groupBy("gid").agg(*[
        F.sum(F.when(miss == t, F.col(x))).alias(f"_{x}_{t}") for x in names for t in range(depth + 1)
    ])
    exact = []
    for x in names:
        for m in range(depth + 1):
            terms = [
                (-1) ** (m - t) * math.comb(size - t, size - m) * F.col(f"_{x}_{t}") for t in range(m + 1)
            ]
            exact.append(sum(terms[1:], terms[0]).alias(f"{x}_{m}"))
    # written, so that the callers' formulas start from plain columns
    return materialize(agreed.select("gid", *exact), "mismatch-sums")


def category_outlier_factors(c: Combinations) -> DataFrame:
    """(first_row, cat_lof): local outlier factor under sqrt(2 * mismatching columns).

    Distances take few values, so neighbourhoods are described by weights per mismatch count. Rows tied at
    the last distance share the remaining neighbour places by weight, so equal rows get equal scores.
    """
    k = neighbour_count(c.rows)
    keys = c.keys
    points = c.df.withColumnRenamed("first_row", "gid")
    size, count = len(keys), c.count
    depth = size if size <= FULL_DEPTH_COLUMNS else FIRST_DEPTHS
    while True:
        around = mismatch_sums(points, keys, count, {"w": F.col("w")}, depth)
        reached = sum((F.col(f"w_{m}") for m in range(depth + 1)), F.lit(0)) - 1
        around = around.withColumn("reached", reached)
        if depth == size or around.filter(F.col("reached") < k).isEmpty():
            break
        depth += 1
    level = F.lit(depth)
    for m in reversed(range(depth)):
        so_far = sum((F.col(f"w_{i}") for i in range(m + 1)), F.lit(0)) - 1
        level = F.when(so_far >= k, m).otherwise(level)
    first = materialize(points.join(around.withColumn("level", level), "gid"), "mismatch-levels")
    levels = sorted(r["level"] for r in first.select("level").distinct().collect())  # at most size + 1 of them
    depth = levels[-1]

    gap = [math.sqrt(2.0 * m) for m in range(depth + 1)]

    def neighbourhood(value: Callable[[int], Column], own: Column) -> Column:
        """Sum of a measure over the k neighbours; ``value(m)`` sums it over m mismatches."""
        out = F.lit(None).cast("double")
        for m in range(depth + 1):
            weight_inside = sum((F.col(f"w_{i}") for i in range(m)), F.lit(0)) - 1
            inside = sum((value(i) for i in range(m)), F.lit(0.0)) - own
            if m == 0:
                part = (value(0) - own) * F.lit(float(k)) / (F.col("w_0") - 1)
            else:
                part = inside + value(m) * (F.lit(k) - weight_inside) / F.col(f"w_{m}")
            out = F.when(F.col("level") == m, part).otherwise(out)
        return out

    by_level = mismatch_sums(
        first, keys, count, {f"l{b}": F.when(F.col("level") == b, F.col("w")).otherwise(0) for b in levels}, depth
    )
    second = first.join(by_level, "gid")

    def reach(m: int) -> Column:
        return sum((F.col(f"l{b}_{m}") * max(gap[b], gap[m]) for b in levels), F.lit(0.0))

    own_reach = F.element_at(F.array(*[F.lit(g) for g in gap]), F.col("level") + 1)
    staged = second.select(
        *first.columns, *[reach(m).alias(f"_r{m}") for m in range(depth + 1)], own_reach.alias("_own"),
        (F.col("level") == 0).alias("dense"),
    )
    total = neighbourhood(lambda m: F.col(f"_r{m}"), F.col("_own"))
    staged = staged.select(*first.columns, "dense", total.alias("_total"))
    lrd = F.when(F.col("dense"), 1 / F.lit(DENSITY_GUARD)).otherwise(1 / (F.col("_total") / k + DENSITY_GUARD))
    staged = staged.withColumn("_lrd", lrd)
    third = materialize(
        staged.select(*first.columns, "dense", significant(F.col("_lrd"), 12).alias("lrd")), "mismatch-densities"
    )
    # densities of copies-only points are huge, so they are counted apart from the others, which are summed
    # as decimals: both stay exact under the additions and subtractions
    soft = F.when(~F.col("dense"), F.col("lrd") * F.col("w")).otherwise(0.0).cast("decimal(38,12)")
    heavy = F.when(F.col("dense"), F.col("w")).otherwise(0)
    sums = mismatch_sums(third, keys, count, {"soft": soft, "heavy": heavy}, depth)
    last = third.join(sums, "gid")

    def density(m: int) -> Column:
        return F.col(f"soft_{m}").cast("double") + F.col(f"heavy_{m}") / F.lit(DENSITY_GUARD)

    last = last.select(*third.columns, *[density(m).alias(f"_d{m}") for m in range(depth + 1)])
    factor = neighbourhood(lambda m: F.col(f"_d{m}"), F.col("lrd")) / k / F.col("lrd")
    scored = F.when(F.col("dense"), 1.0).otherwise(factor)
    return last.select(F.col("gid").alias("first_row"), significant(scored, SCORE_DIGITS).alias("cat_lof"))
