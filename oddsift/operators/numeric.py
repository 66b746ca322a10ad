"""Numeric methods that are closed forms over column statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsift.functions.dist import chi2_quantile, critical_z, sidak_rate
from oddsift.functions.messages import REASONS
from oddsift.functions.scalars import readable, readable_number
from oddsift.operators.model import Model, idle, largest, pick, place_of_largest, project, projection, reason
from oddsift.operators.orderstats import average_ranks, quantiles
from oddsift.operators.prepare import Prepared

# The constants of the robust rules.
NORMAL_QUARTILE = 0.6745
NORMAL_IQR = 1.349
MIN_FENCE = 0.5
MAD_CUT = 3.5

WIDE_COVARIANCE = 24  # beyond this many columns the covariance is summed as matrices
WIDE_DISTANCE = 10  # beyond this many columns D² is a matrix product per Arrow batch


def _cited(p: Prepared, flag: Column, values: list[Column], rank_by: Column) -> list[dict[str, Column]]:
    """Helper columns for a flagged row: its largest entry ``_v`` of ``values`` and that column's name and number."""
    return [
        {"_arr": F.when(flag, F.array(*values))},
        {"_order": F.when(flag, rank_by)},
        {"_j": F.when(flag, place_of_largest(F.col("_order")))},
        {"_name": pick(p.numeric, F.col("_j")), "_x": pick(p.numbers, F.col("_j")), "_v": F.when(F.col("_j").isNotNull(), F.element_at("_arr", F.col("_j")))},
        {"_text": readable_number(F.col("_x"))},
    ]


def deviation_steps(p: Prepared, flag: Column) -> list[dict[str, Column]]:
    """Helper columns that name the column farthest from its mean."""
    z = p.standardised()
    return _cited(p, flag, z, F.array(*[F.abs(v) for v in z]))


def deviation_reason(prefix: Column, threshold: float | None, stat: Column) -> Column:
    text = F.concat(prefix, F.format_string(REASONS["largest_deviation"], "_name", "_text", "_v"))
    return reason(text, F.col("_name"), F.col("_text"), stat, threshold)


def fit_zscore(p: Prepared, rate: float) -> Model:
    cut = critical_z(rate, len(p.numeric))
    z = [(x - F.lit(m.mean)) / F.lit(m.sd) if m.sd else F.lit(0.0) for x, m in zip(p.numbers, p.moments)]
    score, flag = F.col("_s"), F.col("_s") > cut
    steps = [{"_s": largest([F.abs(v) for v in z])}, *_cited(p, flag, z, F.array(*[F.abs(v) for v in z]))]
    text = F.format_string(REASONS["zscore"], "_name", "_text", "_v", F.lit(cut))
    why = reason(text, F.col("_name"), F.col("_text"), F.col("_v"), cut)
    return Model("zscore", projection("zscore", steps, score, flag, why), cut, {"z_critico": cut})


def fit_iqr(p: Prepared, rate: float) -> Model:
    q = p.quantiles([0.25, 0.75])
    m = max((critical_z(rate, len(p.numeric)) - NORMAL_QUARTILE) / NORMAL_IQR, MIN_FENCE)
    far, low, high = [], [], []
    for x, box, mom in zip(p.numbers, q, p.moments):
        q1, q3 = box[0.25], box[0.75]
        scale = q3 - q1 if q3 > q1 else mom.sd * NORMAL_IQR
        if scale > 0:
            far.append(F.greatest((F.lit(q1) - x) / F.lit(scale), (x - F.lit(q3)) / F.lit(scale)))
        else:
            far.append(F.lit(0.0))
        reach = m * scale if scale > 0 else float("inf")
        low.append(readable(q1 - reach))
        high.append(readable(q3 + reach))
    score, flag = F.col("_s"), F.col("_s") > m
    steps = [{"_s": largest(far)}, *_cited(p, flag, far, F.col("_arr"))]
    text = F.format_string(REASONS["iqr"], "_name", "_text", pick(low, F.col("_j")), pick(high, F.col("_j")), F.lit(m))
    why = reason(text, F.col("_name"), F.col("_text"), score, m)
    return Model("iqr", projection("iqr", steps, score, flag, why), m, {"multiplicador": m})


def fit_mad(p: Prepared, rate: float) -> Model:
    med = [q[0.5] for q in p.quantiles([0.5])]
    away = {f"d{j}": (F.abs(x - F.lit(c)), p.rows, [0.5]) for j, (x, c) in enumerate(zip(p.numbers, med))}
    spread = [v[0.5] for v in quantiles(p.df, away).values()]
    z = []
    for x, c, mad, mom in zip(p.numbers, med, spread, p.moments):
        if mad > 0:
            z.append(F.lit(NORMAL_QUARTILE) * (x - F.lit(c)) / F.lit(mad))
        else:
            z.append((x - F.lit(c)) / F.lit(mom.sd) if mom.sd else F.lit(0.0))
    score, flag = F.col("_s"), F.col("_s") > MAD_CUT
    steps = [{"_s": largest([F.abs(v) for v in z])}, *_cited(p, flag, z, F.array(*[F.abs(v) for v in z]))]
    middle = pick([readable(c) for c in med], F.col("_j"))
    text = F.format_string(REASONS["mad"], "_name", "_text", "_v", middle, F.lit(str(MAD_CUT)))
    why = reason(text, F.col("_name"), F.col("_text"), F.col("_v"), MAD_CUT)
    return Model("mad", projection("mad", steps, score, flag, why), MAD_CUT, {"limiar": MAD_CUT})


def covariance(p: Prepared, kept: list[int]) -> np.ndarray:
    """Sample covariance, summed from centred values."""
    size = len(kept)
    centred = [F.col(f"n{j}") - F.lit(p.moments[j].mean) for j in kept]
    out = np.zeros((size, size))
    if size <= WIDE_COVARIANCE:
        pairs = [(a, b) for a in range(size) for b in range(a, size)]
        r = p.df.agg(*[F.sum(centred[a] * centred[b]).alias(f"s{i}") for i, (a, b) in enumerate(pairs)]).first()
        for i, (a, b) in enumerate(pairs):
            out[a, b] = out[b, a] = r[i]
    else:
        def partial(batches):
            total = np.zeros((size, size))
            for pdf in batches:
                m = pdf.to_numpy(dtype=float)
                total += m.T @ m
            a, b = np.triu_indices(size)
            yield pd.DataFrame({"a": a.astype("int32"), "b": b.astype("int32"), "s": total[a, b]})

        sums = p.df.select(*[c.alias(f"d{i}") for i, c in enumerate(centred)]).mapInPandas(partial, "a int, b int, s double")
        for r in sums.groupBy("a", "b").agg(F.sum("s").alias("s")).collect():
            out[r["a"], r["b"]] = out[r["b"], r["a"]] = r["s"]
    return out / (p.rows - 1)


def fit_mahalanobis(p: Prepared, rate: float) -> Model:
    kept = [j for j, m in enumerate(p.moments) if m.sd > 0]
    if not kept:
        return idle("mahalanobis")
    inverse = np.linalg.pinv(covariance(p, kept), rcond=1e-12, hermitian=True)
    cut = chi2_quantile(1 - rate, len(kept))
    names, values = [p.numeric[j] for j in kept], [p.numbers[j] for j in kept]
    means = [p.moments[j].mean for j in kept]
    if len(kept) <= WIDE_DISTANCE:
        centred = {f"_d{i}": x - F.lit(m) for i, (x, m) in enumerate(zip(values, means))}
        parts = {
            f"_p{i}": F.col(f"_d{i}")
            * sum((F.col(f"_d{k}") * F.lit(float(inverse[i, k])) for k in range(len(kept))), F.lit(0.0))
            for i in range(len(kept))
        }
        total = sum((F.col(c) for c in parts), F.lit(0.0))
        steps = [centred, parts, {"_s": total, "_parts": F.array(*parts)}]
    else:
        split = _distance_parts(np.array(means), inverse)
        total = F.aggregate("_parts", F.lit(0.0), lambda acc, x: acc + x)
        steps = [{"_parts": split(F.array(*values))}, {"_s": total}]
    d2, flag = F.col("_s"), F.col("_s") > cut
    steps += [
        {"_j": F.when(flag, place_of_largest(F.col("_parts")))},
        {"_name": pick(names, F.col("_j")), "_x": pick(values, F.col("_j")),
         "_share": F.when(flag, F.bround(100 * F.element_at("_parts", F.col("_j")) / d2, 0))},
        {"_text": readable_number(F.col("_x"))},
    ]
    text = F.format_string(REASONS["mahalanobis"], d2, F.lit(cut), "_name", "_text", "_share")
    why = reason(text, F.col("_name"), F.col("_text"), d2, cut)
    return Model("mahalanobis", projection("mahalanobis", steps, d2, flag, why), cut, {"graus_liberdade": float(len(kept))})


def _distance_parts(mean: np.ndarray, inverse: np.ndarray):
    @F.pandas_udf("array<double>")
    def parts(rows: pd.Series) -> pd.Series:
        d = np.vstack(rows.to_numpy()) - mean
        return pd.Series(list(d * (d @ inverse)))

    return parts


def fence_ranks(p: Prepared, outside: list[Column], one_task_rows: int | None = None) -> DataFrame:
    """(row_id, score, worst): the most extreme rank of a row and its column among those outside a fence."""
    series = {f"n{j}": x for j, x in enumerate(p.numbers)}
    ranked = average_ranks(p.df, series, "row_id", p.rows, one_task_rows)
    lows = F.array(*[F.lit(float(a)) for a, _ in outside])
    highs = F.array(*[F.lit(float(b)) for _, b in outside])
    place = F.col("series") + 1
    out = (F.col("value") < F.element_at(lows, place)) | (F.col("value") > F.element_at(highs, place))
    extreme = F.abs(F.col("avg_rank") / p.rows - 0.5) * 2
    return ranked.select("row_id", "series", extreme.alias("extreme"), out.alias("out")).groupBy("row_id").agg(
        F.max("extreme").alias("_fence_score"),
        F.max(F.when(F.col("out"), F.struct("extreme", (-F.col("series")).alias("order")))).alias("_fence_worst"),
    )


def fit_percentile_fence(p: Prepared, rate: float) -> Model:
    a = sidak_rate(rate, len(p.numeric))
    q = p.quantiles([a / 2, 1 - a / 2])
    lows, highs = [v[a / 2] for v in q], [v[1 - a / 2] for v in q]
    table = fence_ranks(p, list(zip(lows, highs)))
    flag = F.col("_fence_worst").isNotNull()
    steps = [
        {"_j": (F.lit(1) - F.col("_fence_worst.order")).cast("int")},
        {"_name": pick(p.numeric, F.col("_j")), "_x": pick(p.numbers, F.col("_j"))},
        {"_text": readable_number(F.col("_x"))},
    ]
    text = F.format_string(
        REASONS["percentile_fence"], "_name", "_text", F.lit(100 * a / 2), F.lit(100 * (1 - a / 2)),
        pick([readable(v) for v in lows], F.col("_j")), pick([readable(v) for v in highs], F.col("_j")),
    )
    why = reason(text, F.col("_name"), F.col("_text"), F.col("_fence_worst.extreme"), a)

    def add(df: DataFrame) -> DataFrame:
        out = project(df.join(table, "row_id"), "percentile_fence", steps, F.col("_fence_score"), flag, why)
        return out.drop(*table.columns[1:])

    return Model("percentile_fence", add, a, {"alpha_coluna": a})
