"""Exact order statistics and ranks without sorting whole tables in one task.

Order statistics narrow a bracket around each wanted rank: a sketch proposes cut values, a counting
pass checks them exactly, and only the rows inside the checked bracket are grouped and sorted. The
sketch steers the work; it never decides a result.

Ranks need every row's place. Up to ``ONE_TASK_ROWS`` rows a window per series is enough. Beyond, equal
values are counted first (so a value that fills a third of the table becomes one row), the counts are
dealt by ranges of value, and totals run inside the ranges, with one total per range carried on.

Lists that are read by page are written once in ranges; a page reads the ranges it touches.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsift.session import materialize

GROUP_ROWS = 200_000
ONE_TASK_ROWS = 2_000_000
BROADCAST_ROWS = 200_000
HOT_SHARE = 500
SALTS = 1024
MAX_ROUNDS = 24


@dataclass(frozen=True)
class OrderStat:
    """The value at a rank, the weight strictly below it, and the weight equal to it."""

    value: float
    below: int
    equal: int


@dataclass(frozen=True)
class Ranks:
    """An expression, the total weight of its values (nulls do not count), and 0-based ascending ranks."""

    expr: Column
    total: int
    ranks: tuple[int, ...]


@dataclass
class _Span:
    """An open interval of one expression that holds wanted ranks."""

    name: str
    ranks: list[int]
    rows: int
    weight: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    stalled: int = 0

    def inside(self, v: Column) -> Column:
        test = F.lit(True)
        if self.low is not None:
            test = test & (v > self.low)
        if self.high is not None:
            test = test & (v < self.high)
        return test


def order_statistics(
    df: DataFrame,
    wanted: Mapping[str, Ranks],
    weight: Column | None = None,
    rows: int | None = None,
    group_rows: int | None = None,
) -> dict[str, dict[int, OrderStat]]:
    """Exact values at the wanted ranks of several expressions, found together.

    ``weight`` lets one row stand for many; ``rows`` is then the number of rows of ``df``.
    """
    limit = GROUP_ROWS if group_rows is None else group_rows
    out: dict[str, dict[int, OrderStat]] = {name: {} for name in wanted}
    spans = [
        _Span(name, sorted(set(r.ranks)), r.total if rows is None else rows, r.total) for name, r in wanted.items()
    ]
    for _ in range(MAX_ROUNDS):
        wide = [s for s in spans if s.rows > limit and s.stalled < 3]
        if not wide:
            break
        spans = [s for s in spans if not any(s is t for t in wide)] + _narrow(df, wanted, wide, weight, out)
    _finish(df, wanted, spans, weight, out)
    return out


def _proposed_shares(s: _Span, weighted: bool) -> list[float]:
    if weighted:
        return [i / 32 for i in range(33)]
    shares = set()
    slack = 2 + 8 * s.stalled
    for rank in s.ranks:
        grid = round((rank - s.below) / max(s.weight, 1) * 1000)
        shares |= {max(grid - slack, 0) / 1000, min(grid + slack, 1000) / 1000}
    return sorted(shares)


def _placed_cells(df: DataFrame, wanted: Mapping[str, Ranks], cuts: dict[str, list[float]], w: Column) -> DataFrame:
    """(series, place, value, w): where each value lies among the cuts of its expression."""
    flat = df.select(*[wanted[name].expr.cast("double").alias(f"v{i}") for i, name in enumerate(cuts)], w.alias("w"))
    cells = ", ".join(f"{i}, {_place(f'v{i}', cuts[name])}, v{i}" for i, name in enumerate(cuts))
    placed = flat.selectExpr(f"stack({len(cuts)}, {cells}) as (series, place, value)", "w")
    return placed.filter(F.col("value").isNotNull())


def _place(v: str, cuts: list[float]) -> str:
    """SQL: 2k strictly between the cuts k-1 and k, and 2k + 1 on cut k."""
    return _balanced_sum([f"int({v} >= {c!r}D) + int({v} > {c!r}D)" for c in cuts])


def _balanced_sum(terms: list[str]) -> str:
    """A sum that nests only log-deep, which keeps generated code small."""
    if len(terms) <= 2:
        return " + ".join(terms) or "0"
    half = len(terms) // 2
    return f"({_balanced_sum(terms[:half])}) + ({_balanced_sum(terms[half:])})"


def _narrow(df, wanted, wide: list[_Span], weight: Column | None, out) -> list[_Span]:
    sketches = df.agg(*[
        F.kll_sketch_agg_double(F.when(s.inside(wanted[s.name].expr), wanted[s.name].expr), F.lit(2048)).alias(f"s{i}")
        for i, s in enumerate(wide)
    ])
    got = sketches.select(*[
        F.kll_sketch_get_quantile_double(
            F.col(f"s{i}"), F.array(*[F.lit(q) for q in _proposed_shares(s, weight is not None)])
        ).alias(f"c{i}")
        for i, s in enumerate(wide)
    ]).first()
    cuts: dict[str, list[float]] = {}
    for i, s in enumerate(wide):
        ends = {v for v in (s.low, s.high) if v is not None}
        cuts[s.name] = sorted({*cuts.get(s.name, []), *got[f"c{i}"], *ends})
    # count every expression against all of its cuts in one grouped pass
    w = F.lit(1).cast("bigint") if weight is None else weight
    counted = (
        _placed_cells(df, wanted, cuts, w)
        .groupBy("series", "place")
        .agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("rows"))
        .collect()
    )
    names = list(cuts)
    at = {(names[r["series"]], r["place"]): (r["w"], r["rows"]) for r in counted}
    narrowed: list[_Span] = []
    for name in names:
        parents = [s for s in wide if s.name == name]
        below = 0
        for place in range(2 * len(cuts[name]) + 1):
            here, rows = at.get((name, place), (0, 0))
            hit = [(s, r) for s in parents for r in s.ranks if below <= r < below + here]
            if hit and place % 2:
                for _, r in hit:
                    out[name][r] = OrderStat(cuts[name][place // 2], below, here)
            elif hit:
                parent = hit[0][0]
                k = place // 2
                narrowed.append(_Span(
                    name, [r for _, r in hit], rows, here, below,
                    cuts[name][k - 1] if k else None, cuts[name][k] if k < len(cuts[name]) else None,
                    parent.stalled + 1 if rows > 0.7 * parent.rows else 0,
                ))
            below += here
    return narrowed


def _finish(df, wanted, spans: list[_Span], weight: Column | None, out) -> None:
    if not spans:
        return
    w = F.lit(1).cast("bigint") if weight is None else weight
    cuts = {s.name: sorted({v for t in spans if t.name == s.name for v in (t.low, t.high) if v is not None}) for s in spans}
    names = list(cuts)
    wanted_places = []
    for s in spans:
        k = 0 if s.low is None else cuts[s.name].index(s.low) + 1
        wanted_places.append((names.index(s.name), 2 * k))
    keep = F.lit(False)
    for series, place in wanted_places:
        keep = keep | ((F.col("series") == series) & (F.col("place") == place))
    counts = _placed_cells(df, wanted, cuts, w).filter(keep).groupBy("series", "place", "value").agg(F.sum("w").alias("cnt"))
    # a span holds at most about GROUP_ROWS distinct values, by the counting passes above
    running = Window.partitionBy("series", "place").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("cum", F.sum("cnt").over(running))
    asked = [(s, at, r) for s, at in zip(spans, wanted_places) for r in s.ranks]
    picks = [
        F.min(F.when(
            (F.col("series") == at[0]) & (F.col("place") == at[1]) & (F.col("cum") > r - s.below),
            F.struct("value", "cum", "cnt"),
        )).alias(f"p{i}")
        for i, (s, at, r) in enumerate(asked)
    ]
    got = counts.agg(*picks).first()
    for i, (s, _, r) in enumerate(asked):
        p = got[f"p{i}"]
        out[s.name][r] = OrderStat(p["value"], s.below + p["cum"] - p["cnt"], p["cnt"])


def _linear_ranks(n: int, q: float) -> tuple[int, int, float]:
    place = q * (n - 1)
    low = min(int(math.floor(place)), n - 1)
    return low, min(low + 1, n - 1), place - low


def _between(a: float, b: float, t: float) -> float:
    return b - (b - a) * (1 - t) if t >= 0.5 else a + (b - a) * t


def quantiles(
    df: DataFrame,
    wanted: Mapping[str, tuple[Column, int, Iterable[float]]],
    weight: Column | None = None,
    rows: int | None = None,
    group_rows: int | None = None,
) -> dict[str, dict[float, float]]:
    """Exact linear-interpolation quantiles: name -> (expression, total weight of its values, shares)."""
    ranks = {}
    for name, (expr, n, shares) in wanted.items():
        need = {r for q in shares for r in _linear_ranks(n, q)[:2]}
        ranks[name] = Ranks(expr, n, tuple(need))
    found = order_statistics(df, ranks, weight, rows, group_rows)
    out: dict[str, dict[float, float]] = {}
    for name, (_, n, shares) in wanted.items():
        out[name] = {}
        for q in shares:
            low, high, t = _linear_ranks(n, q)
            out[name][q] = _between(found[name][low].value, found[name][high].value, t)
    return out


@dataclass(frozen=True)
class TopCut:
    """The cut of the top share: ``threshold`` is None when nothing is flagged."""

    threshold: float | None
    strict: bool = False

    def flags(self, score: Column) -> Column:
        if self.threshold is None:
            return F.lit(False)
        return score > self.threshold if self.strict else score >= self.threshold


def top_cuts(
    df: DataFrame,
    scores: Mapping[str, Column],
    n: int,
    rate: float,
    first_key: Column,
    weight: Column | None = None,
    rows: int | None = None,
) -> dict[str, TopCut]:
    """Cut values for about ``rate * n`` top rows that never split a group of equal scores.

    A group at the cut that would more than double the wanted count stays out as a whole, and scores
    that are all close to the first row's give no cut.
    """
    if n == 0:
        return {m: TopCut(None) for m in scores}
    ends = df.agg(*[
        a for m, s in scores.items()
        for a in (F.min(s).alias(f"{m}_lo"), F.max(s).alias(f"{m}_hi"), F.min_by(s, first_key).alias(f"{m}_s0"))
    ]).first()
    k = max(1, round(rate * n))
    live = {}
    for m, s in scores.items():
        s0 = ends[f"{m}_s0"]
        tolerance = 1e-8 + 1e-5 * abs(s0)
        if max(ends[f"{m}_hi"] - s0, s0 - ends[f"{m}_lo"]) > tolerance:
            live[m] = Ranks(s, n, (n - k,))
    found = order_statistics(df, live, weight, rows) if live else {}
    cuts = {m: TopCut(None) for m in scores}
    for m in live:
        stat = found[m][n - k]
        cuts[m] = TopCut(stat.value, strict=n - stat.below > 2 * k)
    return cuts


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows in a total order."""
    return df.orderBy(*order).limit(k)


def join_on_values(
    rows: DataFrame,
    table: DataFrame,
    keys: list[str],
    weight: str,
    total: int,
    salt: Column,
    table_rows: int | None = None,
    hot_groups: int = 1,
) -> DataFrame:
    """Left join of rows to a table with unique non-null keys, where one key may hold most rows.

    A table of at most ``BROADCAST_ROWS`` counted rows is broadcast. Otherwise the keys that hold more
    than 1/HOT_SHARE of the rows (fewer than HOT_SHARE of them per group, by arithmetic) are broadcast,
    and their rows spread over salts in the shuffle join that serves the rest.
    """
    payload = [c for c in table.columns if c not in keys]
    if table_rows is not None and table_rows <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), keys, "left")
    hot = table.filter(F.col(weight) * HOT_SHARE > total)
    cold = table.filter(F.col(weight) * HOT_SHARE <= total)
    packed = F.struct(*payload)
    out = rows.join(F.broadcast(hot.select(*keys, packed.alias("_hot"))), keys, "left")
    spread = F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int") + 1)
    out = out.withColumn("_salt", spread)
    out = out.join(cold.select(*keys, F.lit(0).alias("_salt"), packed.alias("_cold")), [*keys, "_salt"], "left")
    out = out.withColumn("_hit", F.coalesce("_hot", "_cold"))
    kept = [c for c in rows.columns]
    return out.select(*kept, *[F.col(f"_hit.{c}").alias(c) for c in payload])


def long_form(df: DataFrame, series: Mapping[str, Column], carry: list[str]) -> DataFrame:
    """(carry..., series, value): one row per cell, series numbered in order."""
    cells = F.array(*[
        F.struct(F.lit(i).alias("series"), e.cast("double").alias("value")) for i, e in enumerate(series.values())
    ])
    return df.select(*carry, F.explode(cells).alias("cell")).select(*carry, "cell.series", "cell.value")


def cumulative_counts(counts: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """(series, value, cnt) with unique values -> the same rows with ``cum``, the count up to the value.

    Further additive columns named in ``also`` get their own running totals, as ``cum_{name}``.

    The rows are dealt by ranges of (series, value) and written with the number of their range. Totals run inside
    each range, and one total per range and series is carried into the later ranges. No range holds more than its
    share of the distinct values, whatever their spacing. ``counts`` is read twice, so pass a materialised table.
    """
    totals = {"cnt": "cum", **{c: f"cum_{c}" for c in also}}
    placed = materialize(
        counts.repartitionByRange("series", "value").withColumn("_part", F.spark_partition_id()), "value-ranges"
    )
    before = Window.partitionBy("series").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_part", "series").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    # one row per range and series: as many as there are shuffle partitions and series, not rows
    carried = placed.groupBy("series", "_part").agg(*[F.sum(c).alias(c) for c in totals]).select(
        "series", "_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before_{c}") for c in totals]
    )
    return (
        placed.select("*", *[F.sum(c).over(inside).alias(f"_run_{c}") for c in totals])
        .join(F.broadcast(carried), ["series", "_part"])
        .select(*counts.columns, *[(F.col(f"_before_{c}") + F.col(f"_run_{c}")).alias(out) for c, out in totals.items()])
    )


@dataclass(frozen=True)
class OrderedList:
    """A written list in a total order: each row has the number of its range (``_part``) and its place in it.

    ``starts`` holds the number of rows before each range, and the length of the list last.
    """

    table: DataFrame
    starts: tuple[int, ...]

    def __len__(self) -> int:
        return self.starts[-1]

    def between(self, low: int, high: int) -> DataFrame:
        """The rows with ordinals from ``low`` to before ``high``, in order; only the files of their ranges are read."""
        columns = [c for c in self.table.columns if c not in ("_part", "_place")]
        low, high = max(low, 0), min(high, len(self))
        part, place = F.col("_part"), F.col("_place")
        if low >= high:
            return self.table.filter(part < 0).select(*columns)
        first, last = bisect_right(self.starts, low) - 1, bisect_left(self.starts, high) - 1
        rows = self.table.filter((part >= first) & (part <= last))
        rows = rows.filter((part > first) | (place >= low - self.starts[first]))
        rows = rows.filter((part < last) | (place < high - self.starts[last]))
        return rows.orderBy("_part", "_place").select(*columns)

    def numbered(self, name: str) -> DataFrame:
        """All rows with their ordinals from 0, not sorted."""
        at = F.lit(list(self.starts)).getItem(F.col("_part")) + F.col("_place")
        return self.table.withColumn(name, at.cast("bigint")).drop("_part", "_place")


def ordered_list(df: DataFrame, order: list[Column], label: str) -> OrderedList:
    """Sort ``df`` once by ranges and write it, a folder per range; ``order`` should leave no ties.

    ``df`` is read twice (once to find the ranges), so pass a materialised table or a cheap plan.
    """
    at = F.monotonically_increasing_id()  # the range's number above bit 33, the row's place in it below
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at)
    placed = placed.withColumn("_part", F.shiftright("_at", 33).cast("int"))
    placed = placed.withColumn("_place", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")
    table = materialize(placed, label, ["_part"])
    sizes = {r["_part"]: r["n"] for r in table.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = [sizes.get(i, 0) for i in range(max(sizes, default=-1) + 1)]
    return OrderedList(table, tuple(accumulate(counts, initial=0)))


def average_ranks(
    df: DataFrame,
    series: Mapping[str, Column],
    row_key: str,
    n: int,
    one_task_rows: int | None = None,
) -> DataFrame:
    """(row_key, series, value, avg_rank): 1-based ranks where equal values share their mean rank."""
    limit = ONE_TASK_ROWS if one_task_rows is None else one_task_rows
    cells = long_form(df, series, [row_key])
    if n <= limit:
        by_value = Window.partitionBy("series").orderBy("value")
        ties = Window.partitionBy("series", "value")
        rank = F.rank().over(by_value) + (F.count(F.lit(1)).over(ties) - 1) / 2
        return cells.withColumn("avg_rank", rank.cast("double"))
    counts = materialize(cells.groupBy("series", "value").agg(F.count(F.lit(1)).alias("cnt")), "value-counts")
    ranked = materialize(
        cumulative_counts(counts).withColumn("avg_rank", F.col("cum") - (F.col("cnt") - 1) / 2).drop("cum"),
        "value-ranks",
    )
    joined = join_on_values(cells, ranked, ["series", "value"], "cnt", n, F.col(row_key))
    return joined.select(row_key, "series", "value", F.col("avg_rank").cast("double").alias("avg_rank"))
