"""What every fitted method has in common."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsift.functions.messages import DESCRIPTIONS, NAMES

NUMERIC = (
    "zscore", "iqr", "mad", "mahalanobis", "knn", "lof", "isolation_forest", "percentile_fence",
)
CATEGORICAL = ("frequency", "entropy", "chi_square", "binomial", "cooccurrence", "lof_categorical")
MIN_ROWS = 3
MIN_COLUMNS = {"cooccurrence": 2}
INFINITE_SCORE = 1e12  # fixed value: what an infinite score is stored as

REASON_TYPE = (
    "struct<column:string,column2:string,value:string,value2:string,stat:double,threshold:double,message:string>"
)


def kind(model: str) -> str:
    if model in NUMERIC:
        return "numeric"
    if model in CATEGORICAL:
        return "categorical"
    raise KeyError(f"unknown model: {model}")


def list_models(spark) -> DataFrame:
    """(id, name, type, description) of every method."""
    rows = [(m, NAMES[m], kind(m), DESCRIPTIONS[m]) for m in NUMERIC + CATEGORICAL]
    return spark.createDataFrame(rows, "id string, name string, type string, description string")


def check_rate(rate: float) -> None:
    if not 0 < rate < 0.5:
        raise ValueError("the expected share of anomalies must lie between 0 and 0.5")


@dataclass
class Model:
    """A fitted method. ``add`` appends ``{id}_score``, ``{id}_flag`` and ``{id}_reason`` to prepared rows."""

    id: str
    add: Callable[[DataFrame], DataFrame]
    threshold: float | None = None
    params: Mapping[str, float] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.add(df)


def clean_score(score: Column) -> Column:
    return F.when(F.isnan(score), 0.0).when(score == float("inf"), INFINITE_SCORE).otherwise(score)


def outputs(model: str, score: Column, flag: Column, reason: Column) -> list[Column]:
    """The three output columns; the reason exists only where the flag is set."""
    return [
        clean_score(score.cast("double")).alias(f"{model}_score"),
        flag.alias(f"{model}_flag"),
        F.when(flag, reason).cast(REASON_TYPE).alias(f"{model}_reason"),
    ]


Steps = Sequence[Mapping[str, Column]]


def project(df: DataFrame, model: str, steps: Steps, score: Column, flag: Column, reason: Column) -> DataFrame:
    """Append the outputs, computing named helper columns step by step.

    Separate steps keep Catalyst from inlining one helper into the next many times over.
    """
    kept = df.columns
    for step in steps:
        df = df.select("*", *[c.alias(name) for name, c in step.items()])
    return df.select(*kept, *outputs(model, score, flag, reason))


def projection(model: str, steps: Steps, score: Column, flag: Column, reason: Column) -> Callable[[DataFrame], DataFrame]:
    return lambda df: project(df, model, steps, score, flag, reason)


def idle(model: str, params: Mapping[str, float] | None = None, threshold: float | None = None) -> Model:
    """A model for input it cannot judge: zero scores and no flags."""
    nothing = F.lit(None).cast(REASON_TYPE)
    return Model(model, projection(model, [], F.lit(0.0), F.lit(False), nothing), threshold, params or {})


def reason(
    message: Column,
    column: Column | None = None,
    value: Column | None = None,
    stat: Column | None = None,
    threshold: float | None = None,
    column2: Column | None = None,
    value2: Column | None = None,
) -> Column:
    empty = F.lit(None)
    return F.struct(
        (empty if column is None else column).cast("string").alias("column"),
        (empty if column2 is None else column2).cast("string").alias("column2"),
        (empty if value is None else value).cast("string").alias("value"),
        (empty if value2 is None else value2).cast("string").alias("value2"),
        (empty if stat is None else stat).cast("double").alias("stat"),
        F.lit(threshold).cast("double").alias("threshold"),
        message.alias("message"),
    )


def largest(values: list[Column]) -> Column:
    return values[0] if len(values) == 1 else F.greatest(*values)


def place_of_largest(arr: Column) -> Column:
    """1-based place of the first largest value of an array."""
    return F.array_position(arr, F.array_max(arr)).cast("int")


def pick(values: list, place: Column) -> Column:
    """The value at a 1-based place, null without one; plain Python values become literals."""
    arr = F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values])
    return F.when(place.isNotNull(), F.element_at(arr, place))
