"""Column profiles and the preparation shared by all methods."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsift.functions.scalars import is_filled, strip, to_num
from oddsift.operators.orderstats import quantiles
from oddsift.session import materialize

NUMERIC_SHARE = 0.9
MISSING = "missing"  # fixed value: the category that stands for null and blank cells


def quoted(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def with_row_id(df: DataFrame, name: str = "row_id", order: Sequence[str] = ()) -> DataFrame:
    """Dense 0-based row numbers.

    ``order`` is a unique sort key for tables that have one. Without it the numbers follow the scan order
    of a file-backed table: each file block is counted and the blocks' running total is added back.
    """
    if order:
        ranged = df.repartitionByRange(*[quoted(c) for c in order]).sortWithinPartitions(*[quoted(c) for c in order])
        parts = materialize(
            ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()),
            "numbered",
        )
        block = ["_part"]
    else:
        parts = (
            df.withColumn("_file", F.col("_metadata.file_path"))
            .withColumn("_start", F.col("_metadata.file_block_start"))
            .withColumn("_at", F.monotonically_increasing_id())
        )
        block = ["_file", "_start"]
    before = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition or file block, so this window is small whatever the table holds
    blocks = (
        parts.groupBy(*block).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
        .select(*block, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    out = parts.join(F.broadcast(blocks), block).withColumn(name, F.col("_offset") + F.col("_at") - F.col("_first"))
    return out.select(name, *[quoted(c) for c in df.columns])


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(position, name, type, missing, unique) per column.

    Cells are first counted per distinct raw text, so parsing touches each text once. A column is numeric
    when at least 90% of its filled cells parse and they take more than two values.
    """
    columns = list(columns or df.columns)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    cells = F.array(*[
        F.struct(
            F.lit(i).alias("position"),
            quoted(c).cast("string").alias("raw"),
            (F.lit(None).cast("double") if kinds[c].typeName() == "string" else to_num(quoted(c), kinds[c])).alias("typed"),
        )
        for i, c in enumerate(columns)
    ])
    texts = [i for i, c in enumerate(columns) if kinds[c].typeName() == "string"]
    counts = (
        df.select(F.explode(cells).alias("cell"))
        .groupBy("cell.position", "cell.raw", "cell.typed")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .withColumn("num", F.when(F.col("position").isin(texts), to_num(F.col("raw"))).otherwise(F.col("typed")))
        .withColumn("filled", is_filled(F.col("raw")) & ~(F.col("typed").isNull() & (F.col("raw") == "NaN")
                                                          & ~F.col("position").isin(texts)))
    )
    # one row per column and number, then one per column; no distinct aggregate has to expand the texts
    by_number = counts.groupBy("position", "num").agg(
        F.sum("cnt").alias("rows"), F.sum(F.when(F.col("filled"), F.col("cnt")).otherwise(0)).alias("filled"),
        F.count_if("filled").alias("texts"),
    )
    parsed = F.col("num").isNotNull() & (F.col("filled") > 0)
    summary = by_number.groupBy("position").agg(
        F.sum("rows").alias("rows"), F.sum("filled").alias("filled"), F.sum("texts").alias("unique"),
        F.sum(F.when(parsed, F.col("filled")).otherwise(0)).alias("parsed"), F.count_if(parsed).alias("numbers"),
    )
    numeric = (F.col("filled") > 0) & (F.col("parsed") >= NUMERIC_SHARE * F.col("filled")) & (F.col("numbers") > 2)
    return summary.select(
        "position",
        F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("position") + 1).alias("name"),
        F.when(numeric, "numeric").otherwise("categorical").alias("type"),
        (F.col("rows") - F.col("filled")).alias("missing"),
        "unique",
        "rows",
    ).orderBy("position")


def looks_like_id(profiled: DataFrame) -> DataFrame:
    """Categorical columns with a different value in every row."""
    return profiled.withColumn("looks_like_id", (F.col("type") == "categorical") & (F.col("unique") == F.col("rows")))


def category(c: Column) -> Column:
    """Trimmed text; null and blank cells become the category ``missing``."""
    s = strip(c.cast("string"))
    return F.when(c.isNull() | (s == ""), MISSING).otherwise(s)


@dataclass(frozen=True)
class Moments:
    mean: float
    sd: float
    sd_sample: float
    low: float
    high: float


@dataclass
class Prepared:
    """Rows ready for the methods: ``row_id``, numbers ``n0..``, categories ``c0..``."""

    df: DataFrame
    rows: int
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    moments: list[Moments] = field(default_factory=list)
    known_quantiles: dict[tuple[str, float], float] = field(default_factory=dict)

    @property
    def numbers(self) -> list[Column]:
        return [F.col(f"n{j}") for j in range(len(self.numeric))]

    @property
    def categories(self) -> list[Column]:
        return [F.col(f"c{j}") for j in range(len(self.categorical))]

    def standardised(self) -> list[Column]:
        """(x - mean) / population deviation; a constant column keeps its zeros."""
        return [(x - F.lit(m.mean)) / F.lit(m.sd or 1.0) for x, m in zip(self.numbers, self.moments)]

    def quantiles(self, shares: Sequence[float]) -> list[dict[float, float]]:
        """Exact quantiles of every number column; each is computed once."""
        need = [q for q in shares if any((f"n{j}", q) not in self.known_quantiles for j in range(len(self.numeric)))]
        if need:
            wanted = {f"n{j}": (x, self.rows, need) for j, x in enumerate(self.numbers)}
            for name, got in quantiles(self.df, wanted).items():
                self.known_quantiles.update({(name, q): v for q, v in got.items()})
        return [{q: self.known_quantiles[(f"n{j}", q)] for q in shares} for j in range(len(self.numeric))]


def _moments(df: DataFrame, columns: Sequence[Column]) -> tuple[int, list[int], list[Moments | None]]:
    aggs = [F.count(F.lit(1)).alias("rows")]
    for j, x in enumerate(columns):
        aggs += [F.count(x).alias(f"k{j}"), F.avg(x).alias(f"m{j}"), F.stddev_pop(x).alias(f"s{j}"),
                 F.stddev_samp(x).alias(f"t{j}"), F.min(x).alias(f"a{j}"), F.max(x).alias(f"b{j}")]
    r = df.agg(*aggs).first()
    got = []
    for j in range(len(columns)):
        if not r[f"k{j}"]:
            got.append(None)
            continue
        flat = r[f"a{j}"] == r[f"b{j}"]  # summation noise must not give a constant column a spread
        sample = r[f"t{j}"]
        got.append(Moments(
            r[f"m{j}"], 0.0 if flat else r[f"s{j}"],
            0.0 if flat or sample is None or math.isnan(sample) else sample, r[f"a{j}"], r[f"b{j}"],
        ))
    return r["rows"], [r[f"k{j}"] for j in range(len(columns))], got


def check_row_id(df: DataFrame, row_id: str) -> None:
    """Rows are told apart by their id, so a null or repeated one is an error."""
    ids = df.groupBy(quoted(row_id).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    bad = ids.filter(F.col("id").isNull() | (F.col("n") > 1)).first()
    if bad is not None:
        raise ValueError(f"{row_id} must be unique and not null: {bad['id']} stands in {bad['n']} rows")


def prepare(
    df: DataFrame,
    numeric: Sequence[str] = (),
    categorical: Sequence[str] = (),
    row_id: str = "row_id",
) -> Prepared:
    """Parse, impute and rename the chosen columns. Number columns without any number are dropped."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    raw = [to_num(quoted(c), kinds[c]) for c in numeric]
    cats = [category(quoted(c)).alias(f"c{j}") for j, c in enumerate(categorical)]
    slim = df.select(quoted(row_id).alias("row_id"), *[x.alias(f"r{j}") for j, x in enumerate(raw)], *cats)
    check_row_id(df, row_id)
    rows, filled, moments = _moments(slim, [F.col(f"r{j}") for j in range(len(raw))])
    kept = [j for j in range(len(raw)) if filled[j]]
    gaps = {f"r{j}": (F.col(f"r{j}"), filled[j], [0.5]) for j in kept if filled[j] < rows}
    medians = {name: q[0.5] for name, q in quantiles(slim, gaps).items()} if gaps else {}
    numbers = []
    for new, j in enumerate(kept):
        x = F.col(f"r{j}")
        numbers.append((F.coalesce(x, F.lit(medians[f"r{j}"])) if f"r{j}" in medians else x).alias(f"n{new}"))
    out = slim.select("row_id", *numbers, *[f"c{j}" for j in range(len(categorical))])
    if medians:
        _, _, moments = _moments(out, [F.col(f"n{new}") for new in range(len(kept))])
    else:
        moments = [moments[j] for j in kept]
    return Prepared(out, rows, [numeric[j] for j in kept], list(categorical), moments)


def equal_width_bins(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Replace number columns by right-closed equal-width bins ``f0..``; few-valued ones by their text. Null stays null."""
    stats = df.agg(*[
        a for j, c in enumerate(columns)
        for a in (F.min(quoted(c)).alias(f"a{j}"), F.max(quoted(c)).alias(f"b{j}"),
                  F.approx_count_distinct(quoted(c)).alias(f"d{j}"))
    ]).first()
    # the estimate only clears columns that are far above the bound; the others are counted exactly
    close = [j for j in range(len(columns)) if stats[f"d{j}"] <= bins * 4]
    exact = df.agg(*[F.count_distinct(quoted(columns[j])).alias(f"d{j}") for j in close]).first() if close else {}
    replaced = {}
    for j, c in enumerate(columns):
        x = quoted(c).cast("double")
        if j in close and exact[f"d{j}"] <= bins:
            replaced[c] = quoted(c).cast("string")
            continue
        if stats[f"a{j}"] is None:
            replaced[c] = F.lit(None).cast("string")
            continue
        edges = np.linspace(stats[f"a{j}"], stats[f"b{j}"], bins + 1)[1:-1]
        place = sum((F.when(x > float(e), 1).otherwise(0) for e in edges), F.lit(0))
        replaced[c] = F.when(x.isNotNull(), F.concat(F.lit("f"), place.cast("string")))
    return df.select(*[replaced[c].alias(c) if c in replaced else quoted(c) for c in df.columns])
