"""Fitting any subset of the methods on one prepared table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from oddsift.operators.categorical import fit_categorical
from oddsift.operators.forest import fit_isolation_forest
from oddsift.operators.model import CATEGORICAL, MIN_COLUMNS, MIN_ROWS, NUMERIC, Model, check_rate, idle, kind
from oddsift.operators.neighbors import fit_knn, fit_lof
from oddsift.operators.numeric import fit_iqr, fit_mad, fit_mahalanobis, fit_percentile_fence, fit_zscore
from oddsift.operators.prepare import Prepared
from oddsift.functions.dist import sidak_rate

FIT_NUMERIC: dict[str, Callable[[Prepared, float], Model]] = {
    "zscore": fit_zscore,
    "iqr": fit_iqr,
    "mad": fit_mad,
    "mahalanobis": fit_mahalanobis,
    "knn": fit_knn,
    "lof": fit_lof,
    "isolation_forest": fit_isolation_forest,
    "percentile_fence": fit_percentile_fence,
}


@dataclass
class Fitted:
    """Fitted methods in the order asked for."""

    models: list[Model]
    steps: list[Callable[[DataFrame], DataFrame]]

    def add(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step(df)
        return df


def fit(p: Prepared, ids: Sequence[str], rate: float) -> Fitted:
    """Fit the methods; too few rows or columns leave a method idle, as zero scores without flags."""
    check_rate(rate)
    numeric = [m for m in ids if kind(m) == "numeric"]
    categorical = [m for m in ids if kind(m) == "categorical"]
    by_id: dict[str, Model] = {}
    steps = []
    if {"iqr", "mad", "percentile_fence"} & set(numeric) and p.numeric and p.rows >= MIN_ROWS:
        # one pass serves the quantiles of all methods that need some
        a = sidak_rate(rate, len(p.numeric))
        need = {"iqr": [0.25, 0.75], "mad": [0.5], "percentile_fence": [a / 2, 1 - a / 2]}
        p.quantiles([q for m in numeric for q in need.get(m, [])])
    for m in numeric:
        usable = p.rows >= MIN_ROWS and len(p.numeric) >= MIN_COLUMNS.get(m, 1)
        by_id[m] = FIT_NUMERIC[m](p, rate) if usable else idle(m)
        steps.append(by_id[m].add)
    live = [m for m in categorical if p.rows >= MIN_ROWS and len(p.categorical) >= MIN_COLUMNS.get(m, 1)]
    for m in categorical:
        if m not in live:
            by_id[m] = idle(m)
            steps.append(by_id[m].add)
    if live:
        group = fit_categorical(p, live, rate)
        by_id.update({model.id: model for model in group.models()})
        steps.append(group.add)
    return Fitted([by_id[m] for m in ids], steps)


__all__ = ["CATEGORICAL", "NUMERIC", "Fitted", "fit"]
