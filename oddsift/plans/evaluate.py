"""Scoring detectors against labels."""

from __future__ import annotations

import math
import time
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsift.functions.messages import NAMES, RANDOM_BASELINE
from oddsift.operators.model import kind
from oddsift.operators.orderstats import cumulative_counts
from oddsift.operators.prepare import equal_width_bins, prepare, quoted
from oddsift.operators.registry import fit
from oddsift.session import materialize

METRICS = ["f1", "precisao", "recall", "especificidade", "auc_roc", "taxa_real", "taxa_prevista", "lift_f1"]


def _guarded(top: Column, bottom: Column) -> Column:
    return F.when(bottom != 0, top / bottom).otherwise(0.0)


def confusion(scored: DataFrame) -> DataFrame:
    """(model, tp, fp, fn, tn, ...) from rows of (model, flag, label)."""
    flag, label = F.col("flag"), F.col("label") == 1
    counted = scored.groupBy("model").agg(
        F.count_if(flag & label).alias("tp"), F.count_if(flag & ~label).alias("fp"),
        F.count_if(~flag & label).alias("fn"), F.count_if(~flag & ~label).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    rated = counted.select(
        "model", "tp", "fp", "fn", "tn",
        _guarded(tp, tp + fp).alias("precisao"), _guarded(tp, tp + fn).alias("recall"),
        _guarded(tn, tn + fp).alias("especificidade"), ((tp + fn) / n).alias("taxa_real"),
        ((tp + fp) / n).alias("taxa_prevista"),
    )
    p, r = F.col("precisao"), F.col("recall")
    return rated.withColumn("f1", _guarded(2 * p * r, p + r)).withColumn("lift_f1", _guarded(F.col("f1"), F.col("taxa_real")))


def _scores_by_label(scored: DataFrame, models: Sequence[str]) -> DataFrame:
    """(series, value, cnt, pos, cum, cum_pos): label counts per distinct score with running totals."""
    place = F.array_position(F.array(*[F.lit(m) for m in models]), F.col("model")).cast("int") - 1
    counts = materialize(
        scored.filter(F.col("model").isin(*models)).groupBy(place.alias("series"), F.col("score").alias("value")).agg(
            F.count(F.lit(1)).alias("cnt"), F.sum(F.col("label").cast("bigint")).alias("pos")
        ),
        "score-labels",
    )
    return cumulative_counts(counts, also=["pos"])


def _named(models: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in models]), F.col("series") + 1).alias("model")


def auc_roc(scored: DataFrame, models: Sequence[str]) -> DataFrame:
    """(model, auc_roc) by the rank sum, ties at their mean rank; 0.5 when all scores are equal."""
    by_score = _scores_by_label(scored, models)
    rank = F.col("cum") - (F.col("cnt") - 1) / 2
    sums = by_score.groupBy("series").agg(
        F.sum(F.col("pos") * rank).alias("ranks"), F.sum("pos").alias("n1"), F.sum("cnt").alias("n"),
        F.count(F.lit(1)).alias("distinct"),
    )
    n1, n0 = F.col("n1"), F.col("n") - F.col("n1")
    auc = (F.col("ranks") - n1 * (n1 + 1) / 2) / (n1 * n0)
    return sums.select(_named(models), F.when(F.col("distinct") > 1, auc).otherwise(0.5).alias("auc_roc"))


def roc_curve(scored: DataFrame, models: Sequence[str]) -> DataFrame:
    """(model, score, fpr, tpr): one point per distinct score, flagging that score and above."""
    by_score = materialize(_scores_by_label(scored, models), "roc")
    totals = by_score.groupBy("series").agg(F.sum("cnt").alias("n"), F.sum("pos").alias("n1"))
    tp = F.col("n1") - F.col("cum_pos") + F.col("pos")
    flagged = F.col("n") - F.col("cum") + F.col("cnt")
    return by_score.join(F.broadcast(totals), "series").select(
        _named(models), F.col("value").alias("score"),
        ((flagged - tp) / (F.col("n") - F.col("n1"))).alias("fpr"), (tp / F.col("n1")).alias("tpr"),
    )


def metrics(scored: DataFrame, models: Sequence[str]) -> DataFrame:
    """All label metrics per model."""
    return confusion(scored).join(auc_roc(scored, models), "model")


def random_baseline(rates: DataFrame) -> DataFrame:
    """What labels drawn at the true rate would score; ``rates`` has (dataset, semente, taxa_real)."""
    c = F.col("taxa_real")
    model, name, kind_ = RANDOM_BASELINE
    return rates.select(
        F.lit(model).alias("modelo"), F.lit(name).alias("nome"), F.lit(kind_).alias("tipo"), "dataset", "semente",
        c.alias("f1"), c.alias("precisao"), c.alias("recall"), (1 - c).alias("especificidade"),
        F.lit(0.5).alias("auc_roc"), "taxa_real", c.alias("taxa_prevista"), F.lit(1.0).alias("lift_f1"),
    )


def score_dataset(df: DataFrame, features: Sequence[str], models: Sequence[str], rate: float,
                  row_id: str = "row_id", label: str = "label") -> DataFrame:
    """(row_id, model, score, flag, label) of every model; categorical ones see equal-width bins."""
    labels = df.select(quoted(row_id).alias("row_id"), quoted(label).cast("int").alias("label"))
    parts = []
    for wanted in ("numeric", "categorical"):
        ids = [m for m in models if kind(m) == wanted]
        if not ids:
            continue
        if wanted == "numeric":
            p = prepare(df, features, (), row_id)
        else:
            p = prepare(equal_width_bins(df, features), (), features, row_id)
        wide = materialize(fit(p, ids, rate).add(p.df), "scored")
        cells = F.array(*[
            F.struct(F.lit(m).alias("model"), F.col(f"{m}_score").alias("score"), F.col(f"{m}_flag").alias("flag"))
            for m in ids
        ])
        parts.append(wide.select("row_id", F.explode(cells).alias("cell")).select("row_id", "cell.*"))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return materialize(out.join(labels, "row_id"), "scored-labels")


def evaluate(datasets: Sequence[tuple[str, int, DataFrame, Sequence[str]]], models: Sequence[str]) -> DataFrame:
    """One row per model, dataset and seed, with the random baseline; the flag share is the true rate.

    ``datasets`` holds (name, seed, rows with row_id and label, feature columns).
    """
    parts = []
    for name, seed, df, features in datasets:
        rate = df.agg(F.avg("label")).first()[0]
        got = metrics(score_dataset(df, features, models, rate), models)
        names = F.create_map(*[F.lit(x) for m in models for x in (m, NAMES[m])])
        kinds = F.create_map(*[F.lit(x) for m in models for x in (m, kind(m))])
        rows = got.select(
            F.col("model").alias("modelo"), F.element_at(names, F.col("model")).alias("nome"),
            F.element_at(kinds, F.col("model")).alias("tipo"), F.lit(name).alias("dataset"),
            F.lit(seed).alias("semente"), *METRICS,
        )
        truth = df.agg(F.avg("label").alias("taxa_real")).select(
            F.lit(name).alias("dataset"), F.lit(seed).alias("semente"), "taxa_real"
        )
        parts += [rows, random_baseline(truth)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def mean_per_dataset(runs: DataFrame, measures: Sequence[str] = METRICS) -> DataFrame:
    return runs.groupBy("modelo", "nome", "tipo", "dataset").agg(*[F.avg(c).alias(c) for c in measures])


def mean_per_model(per_dataset: DataFrame, measures: Sequence[str] = METRICS) -> DataFrame:
    """Mean of the dataset means, best F1 first."""
    return per_dataset.groupBy("modelo", "nome", "tipo").agg(*[F.avg(c).alias(c) for c in measures]).orderBy(
        F.desc("f1"), "modelo"
    )


def pivot_metric(per_dataset: DataFrame, measure: str, datasets: Sequence[str]) -> DataFrame:
    """Models down, datasets across, rounded to three digits."""
    wide = per_dataset.groupBy("nome").pivot("dataset", list(datasets)).agg(F.avg(measure))
    return wide.select("nome", *[F.bround(quoted(d), 3).alias(d) for d in datasets])


def findings(per_dataset: DataFrame, per_model: DataFrame) -> DataFrame:
    """(finding, subject, value): the notable results of an evaluation."""
    base = RANDOM_BASELINE[0]
    real, real_ds = per_model.filter(F.col("modelo") != base), per_dataset.filter(F.col("modelo") != base)

    def best(df: DataFrame, finding: str, measure: str, subject: Column) -> DataFrame:
        top = df.select(subject.alias("subject"), F.col(measure).alias("value")).orderBy(F.desc("value"), "subject").limit(1)
        return top.select(F.lit(finding).alias("finding"), "subject", "value")

    def listed(df: DataFrame, finding: str, subject: Column, value: Column) -> DataFrame:
        return df.select(F.lit(finding).alias("finding"), subject.alias("subject"), value.alias("value"))

    nome = F.col("nome")
    mid = real_ds.filter(F.col("tipo") == "numeric").groupBy("dataset").agg(F.median("auc_roc").alias("auc"))
    parts = [
        listed(per_model.filter(F.col("modelo") == base), "random_f1", nome, F.col("f1")),
        best(real, "best_f1", "f1", nome),
        best(real, "best_auc", "auc_roc", nome),
        best(real, "best_specificity", "especificidade", nome),
        best(real_ds, "best_lift", "lift_f1", F.concat_ws("/", nome, F.col("dataset"))),
        listed(real.filter(F.col("auc_roc") < 0.5), "auc_below_chance", nome, F.col("auc_roc")),
        listed(real.filter(F.col("taxa_prevista") > 2 * F.col("taxa_real")), "flags_over_twice_the_rate", nome,
               F.col("taxa_prevista")),
        listed(mid.filter(F.col("auc") < 0.5), "dataset_below_chance", F.col("dataset"), F.col("auc")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def measure_times(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], models: Sequence[str],
                  rate: float = 0.05, repeats: int = 3, row_id: str = "row_id") -> DataFrame:
    """(modelo, nome, tipo, linhas, tempo_s): median seconds of fit and transform per model."""
    rows = []
    for m in models:
        cols = (numeric, ()) if kind(m) == "numeric" else ((), categorical)
        taken = []
        for _ in range(repeats):
            start = time.perf_counter()
            p = prepare(df, *cols, row_id)
            fit(p, [m], rate).add(p.df).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        rows.append((m, NAMES[m], kind(m), p.rows, float(np.median(taken))))
    return df.sparkSession.createDataFrame(rows, "modelo string, nome string, tipo string, linhas bigint, tempo_s double")


def fastest_at_largest(times: DataFrame) -> DataFrame:
    """Models at the largest measured size, fastest first."""
    largest = times.agg(F.max("linhas").alias("linhas"))
    return times.join(F.broadcast(largest), "linhas", "left_semi").select(
        "nome", (F.col("tempo_s") * 1000).alias("tempo_ms")
    ).orderBy("tempo_ms", "nome")


def class_subsample(df: DataFrame, anomalies: int, seed: int, row_id: str = "row_id", label: str = "label") -> DataFrame:
    """All normal rows and exactly ``anomalies`` labelled ones, drawn by hash order."""
    drawn = df.filter(quoted(label) == 1).orderBy(F.xxhash64(quoted(row_id), F.lit(seed)), quoted(row_id)).limit(anomalies)
    return df.filter(quoted(label) == 0).unionByName(drawn)


def class_as_anomaly(df: DataFrame, column: str, value) -> DataFrame:
    """Rows of one class become the anomalies."""
    return df.withColumn("label", (quoted(column) == value).cast("int"))


def synthetic(spark: SparkSession, rate: float, seed: int, rows: int = 2000, columns: int = 6) -> DataFrame:
    """(row_id, x1.., label): correlated normals; half the anomalies are extreme in one column, the others
    only break the correlation."""
    anomalies = round(rate * rows)
    extreme = anomalies // 2
    cov = np.array([[0.8 ** abs(i - j) for j in range(columns)] for i in range(columns)])
    root = np.linalg.cholesky(cov)

    def uniform(name: str) -> Column:
        # from the row alone, so that no partitioning changes the draw
        return (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(name)), F.lit(1 << 52)) + 0.5) / float(1 << 52)

    def normal(name: str) -> Column:
        return F.sqrt(-2 * F.log(uniform(name + "r"))) * F.cos(2 * math.pi * uniform(name + "a"))

    base = spark.range(rows).select(
        F.col("id").alias("row_id"), *[normal(f"g{j}").alias(f"g{j}") for j in range(columns)],
        *[uniform(f"u{j}").alias(f"u{j}") for j in range(columns)],
        *[uniform(x).alias(x) for x in ("where", "sign", "size")],
    )
    normal_rows = rows - anomalies
    out = []
    for j in range(columns):
        linked = sum((F.col(f"g{k}") * F.lit(float(root[j, k])) for k in range(j + 1)), F.lit(0.0))
        spike = F.when(F.col("sign") < 0.5, -1.0).otherwise(1.0) * (4.5 + 2.5 * F.col("size"))
        wild = F.when(F.floor(F.col("where") * columns) == j, spike).otherwise(F.col(f"u{j}") * 12 - 6)
        turned = -linked if j % 2 else linked
        broken = F.greatest(F.lit(-2.2), F.least(F.lit(2.2), turned))
        out.append(F.when(F.col("row_id") < normal_rows, linked)
                   .when(F.col("row_id") < normal_rows + extreme, wild).otherwise(broken).alias(f"x{j + 1}"))
    return base.select("row_id", *out, (F.col("row_id") >= normal_rows).cast("int").alias("label"))
