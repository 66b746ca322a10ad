"""One analysis: fit, combine, and report."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsift.functions.messages import NAMES
from oddsift.operators.model import kind
from oddsift.operators.orderstats import OrderedList, average_ranks, ordered_list
from oddsift.operators.prepare import MISSING, Prepared, prepare, quoted
from oddsift.operators.registry import Fitted, fit
from oddsift.session import materialize

# Usual sizes of a page and of a printed list, and the seed of a drawn scatter table.
PAGE_ROWS = 25
PRINTED_ROWS = 60
SCATTER_SEED = 0

SMALL_LIST = 10_000  # up to here a list's rows may be broadcast


class InvalidParameters(ValueError):
    pass


@dataclass(frozen=True)
class Parameters:
    models: tuple[str, ...]
    numeric_columns: tuple[str, ...] = ()
    categorical_columns: tuple[str, ...] = ()
    threshold: float = 0.05

    def fingerprint(self) -> str:
        """Sixteen hex digits that tell analyses apart; the order of the lists counts."""
        text = json.dumps({k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items()}, sort_keys=True)
        return hashlib.sha1(text.encode()).hexdigest()[:16]

    def check(self, columns: Sequence[str]) -> None:
        if not self.models:
            raise InvalidParameters("choose at least one model")
        unknown = {*self.numeric_columns, *self.categorical_columns} - set(columns)
        if unknown:
            raise InvalidParameters(f"no such columns: {sorted(unknown)}")
        if not 0 < self.threshold < 0.5:
            raise InvalidParameters("the expected share of anomalies must lie between 0 and 0.5")
        for m in self.models:
            try:
                wanted = kind(m)
            except KeyError as e:
                raise InvalidParameters(str(e)) from e
            if not (self.numeric_columns if wanted == "numeric" else self.categorical_columns):
                raise InvalidParameters(f"model {m} needs at least one {wanted} column")


def parameters_from_text(models: str, numeric: str = "", categorical: str = "", threshold: float = 0.05) -> Parameters:
    """Parameters from comma-separated lists; empty entries drop out."""
    def parts(s: str) -> tuple[str, ...]:
        return tuple(x for x in s.split(",") if x)

    return Parameters(parts(models), parts(numeric), parts(categorical), threshold)


@dataclass
class Analysis:
    """Report tables over one written result table. Everything below is lazy."""

    source: DataFrame
    row_id: str
    params: Parameters
    prepared: Prepared
    fitted: Fitted
    wide: DataFrame  # row_id, n0.., c0.., {model}_score/_flag/_reason

    @property
    def models(self) -> list[str]:
        return [m.id for m in self.fitted.models]

    def _per_model(self, fields: dict[str, str]) -> Column:
        return F.array(*[
            F.struct(F.lit(m).alias("model"), *[F.col(f"{m}_{part}").alias(part) for part in fields.values()])
            for m in self.models
        ])

    @property
    def results(self) -> DataFrame:
        """(row_id, model, score, flag, reason): one row per row and model."""
        cells = self._per_model({"s": "score", "f": "flag", "r": "reason"})
        return self.wide.select("row_id", F.explode(cells).alias("cell")).select("row_id", "cell.*")

    def _votes(self) -> Column:
        return sum((F.col(f"{m}_flag").cast("int") for m in self.models), F.lit(0))

    @property
    def votes(self) -> DataFrame:
        return self.wide.select("row_id", self._votes().alias("votes"))

    @cached_property
    def consensus_scores(self) -> DataFrame:
        """(row_id, consensus_score): mean percentile rank of the row over the models."""
        series = {m: F.col(f"{m}_score") for m in self.models}
        ranked = average_ranks(self.wide, series, "row_id", self.prepared.rows)
        # ranks are multiples of one half, so their sum is exact in any order
        mean = F.sum("avg_rank") / F.lit(float(self.prepared.rows * len(self.models)))
        return materialize(ranked.groupBy("row_id").agg(mean.alias("consensus_score")), "consensus")

    def model_summary(self) -> DataFrame:
        """(id, name, type, anomalies, rate, threshold, params)."""
        counts = self.wide.agg(*[F.count_if(f"{m}_flag").alias(m) for m in self.models])
        cells = F.array(*[
            F.struct(
                F.lit(m.id).alias("id"), F.lit(NAMES[m.id]).alias("name"), F.lit(kind(m.id)).alias("type"),
                F.col(m.id).alias("anomalies"),
                (F.col(m.id) / F.lit(max(self.prepared.rows, 1))).alias("rate"),
                F.lit(m.threshold).cast("double").alias("threshold"),
                F.create_map(*[x for k, v in m.params.items() for x in (F.lit(k), F.lit(float(v)))])
                .cast("map<string,double>").alias("params"),
            )
            for m in self.fitted.models
        ])
        return counts.select(F.explode(cells).alias("m")).select("m.*")

    def models_by_anomalies(self) -> DataFrame:
        return self.model_summary().orderBy(F.desc("anomalies"), "id")

    def top_rows(self, limit: int | None = None) -> DataFrame:
        """Flagged rows per model by falling score, all or at most ``limit`` each; rows count from 1."""
        tables = []
        for m in self.models:
            best = (
                self.wide.filter(F.col(f"{m}_flag"))
                .select("row_id", F.col(f"{m}_score").alias("score"), F.col(f"{m}_reason.message").alias("reason"))
                .orderBy(F.desc("score"), "row_id")
            )
            best = best if limit is None else best.limit(limit)
            tables.append(best.select(F.lit(m).alias("model"), (F.col("row_id") + 1).alias("row"), "score", "reason"))
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    def summary(self) -> DataFrame:
        """(rows, flagged_rows, flagged_by_majority, models_run)."""
        n = len(self.models)
        return self.votes.agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col("votes") > 0).alias("flagged_rows"),
            F.count_if(F.col("votes") > n / 2).alias("flagged_by_majority"),
        ).withColumn("models_run", F.lit(n))

    def votes_histogram(self) -> DataFrame:
        """Rows per number of votes, zeros included."""
        spark = self.wide.sparkSession
        all_votes = spark.range(len(self.models) + 1).select(F.col("id").cast("int").alias("votes"))
        seen = self.votes.groupBy("votes").agg(F.count(F.lit(1)).alias("rows"))
        return all_votes.join(seen, "votes", "left").select("votes", F.coalesce("rows", F.lit(0)).alias("rows"))

    def nonzero_histogram(self) -> DataFrame:
        return self.votes_histogram().filter(F.col("votes") > 0)

    @cached_property
    def ranked_consensus(self) -> OrderedList:
        """(row_id, votes, consensus_score) of rows with a vote, in report order; written once, read by ordinals."""
        voted = materialize(self.votes.filter(F.col("votes") > 0).join(self.consensus_scores, "row_id"), "voted")
        return ordered_list(voted, [F.desc("votes"), F.desc("consensus_score"), F.col("row_id")], "ranked")

    def consensus(self, limit: int | None = None) -> DataFrame:
        """The report's main list, whole or its first ``limit`` rows: (row, votes, consensus_score, values, reasons)."""
        if limit is None:
            top = self.votes.filter(F.col("votes") > 0).join(self.consensus_scores, "row_id")
        else:
            top = self.ranked_consensus.between(0, limit)
            top = F.broadcast(top) if limit <= SMALL_LIST else top
        return (
            self._told(top)
            .orderBy(F.desc("votes"), F.desc("consensus_score"), "row_id")
            .select((F.col("row_id") + 1).alias("row"), "votes", "consensus_score", "values", "reasons")
        )

    def _told(self, top: DataFrame) -> DataFrame:
        """``top`` with the values and reasons of its rows."""
        columns = [*self.params.numeric_columns, *self.params.categorical_columns]
        kinds = {f.name: f.dataType.typeName() for f in self.source.schema.fields}
        def shown(c: str) -> Column:
            x = quoted(c)
            return (F.when(~F.isnan(x), x) if kinds[c] in ("double", "float") else x).cast("string")
        values = F.create_map(*[x for c in dict.fromkeys(columns) for x in (F.lit(c), shown(c))])
        raw = self.source.select(quoted(self.row_id).alias("row_id"), values.alias("values"))
        said = F.array(*[
            F.when(F.col(f"{m}_flag"), F.struct(F.lit(NAMES[m]).alias("model"), F.col(f"{m}_reason.message").alias("reason")))
            for m in self.models
        ])
        reasons = self.wide.select("row_id", F.array_compact(said).alias("reasons"))
        return top.join(raw, "row_id").join(reasons, "row_id")

    def page(self, number: int, size: int = PAGE_ROWS) -> DataFrame:
        """One page of the consensus list, counted from 0; it reads the ranges that the page touches."""
        return self.ranked_consensus.between(number * size, (number + 1) * size)

    def pages(self, size: int = PAGE_ROWS) -> int:
        """The number of pages, from the list's length alone."""
        return -(-len(self.ranked_consensus) // size)

    def printed(self, rows: int = PRINTED_ROWS) -> DataFrame:
        """The first rows for print, each with the number shown and the number in the whole list."""
        listed = F.lit(len(self.ranked_consensus)).cast("bigint")
        return self.ranked_consensus.between(0, rows).select(
            "*", listed.alias("listed"), F.least(F.lit(rows).cast("bigint"), listed).alias("shown"))

    def numeric_statistics(self) -> DataFrame:
        """Spread of each imputed number column; ``missing`` counts the nulls of the raw column."""
        p = self.prepared
        q = p.quantiles([0.25, 0.5, 0.75])
        nulls = self.source.agg(*[F.count_if(quoted(c).isNull()).alias(f"k{j}") for j, c in enumerate(p.numeric)])
        cells = F.array(*[
            F.struct(
                F.lit(c).alias("column"), F.lit(p.rows).cast("bigint").alias("count"), F.col(f"k{j}").alias("missing"),
                *[F.lit(float(v)).alias(name) for name, v in (
                    ("mean", m.mean), ("std", m.sd_sample), ("min", m.low), ("q1", b[0.25]), ("median", b[0.5]),
                    ("q3", b[0.75]), ("max", m.high),
                )],
            )
            for j, (c, m, b) in enumerate(zip(p.numeric, p.moments, q))
        ])
        return nulls.select(F.explode(cells).alias("s")).select("s.*")

    def categorical_statistics(self) -> DataFrame:
        """Distinct values, the most frequent one (the smallest on ties), and the missing cells."""
        p = self.prepared
        cells = F.array(*[F.struct(F.lit(c).alias("column"), x.alias("v")) for c, x in zip(p.categorical, p.categories)])
        counts = self.wide.select(F.explode(cells).alias("cell")).groupBy("cell.column", "cell.v").agg(
            F.count(F.lit(1)).alias("cnt")
        )
        return counts.groupBy("column").agg(
            F.sum("cnt").alias("count"), F.count(F.lit(1)).alias("unique"),
            F.min(F.struct((-F.col("cnt")).alias("less"), "v")).alias("best"),
            F.coalesce(F.sum(F.when(F.col("v") == MISSING, F.col("cnt"))), F.lit(0)).alias("missing"),
        ).select("column", "count", "unique", F.col("best.v").alias("top"), (-F.col("best.less")).alias("top_freq"), "missing")

    def top_share(self) -> DataFrame:
        return self.categorical_statistics().withColumn("top_share", F.col("top_freq") / F.col("count"))

    def scatter(self, points: int | None = None) -> DataFrame | None:
        """(row, x, y, votes) of the first two number columns: all rows, or a seeded draw and all flagged rows."""
        if len(self.params.numeric_columns) < 2 or self.prepared.numeric[:2] != list(self.params.numeric_columns[:2]):
            return None
        flat = self.wide.select("row_id", F.col("n0").alias("x"), F.col("n1").alias("y"), self._votes().alias("votes"))
        if points is not None:
            drawn = flat.orderBy(F.xxhash64("row_id", F.lit(SCATTER_SEED)), "row_id").limit(points)
            flat = drawn.unionByName(flat.filter(F.col("votes") > 0)).dropDuplicates(["row_id"])
        return flat.select((F.col("row_id") + 1).alias("row"), "x", "y", "votes")

    def cited(self) -> DataFrame:
        """(row_id, cited): the columns that the row's reasons name."""
        named = F.array_compact(F.flatten(F.array(*[
            F.array(F.col(f"{m}_reason.column"), F.col(f"{m}_reason.column2")) for m in self.models
        ])))
        return self.wide.filter(self._votes() > 0).select("row_id", F.array_sort(F.array_distinct(named)).alias("cited"))

    def marked(self) -> DataFrame:
        """The source rows with one 0/1 column per model, the votes and the consensus score."""
        marks = self.wide.select(
            "row_id", *[F.col(f"{m}_flag").cast("int").alias(f"anomalia_{m}") for m in self.models],
            self._votes().alias("votos"),
        ).join(self.consensus_scores.select("row_id", F.bround("consensus_score", 4).alias("score_consenso")), "row_id")
        marks = marks.withColumnRenamed("row_id", "_marked_row")
        joined = self.source.join(marks, quoted(self.row_id) == F.col("_marked_row"))
        taken = set(marks.columns)
        own = [c for c in self.source.columns if c not in taken]
        return joined.select(*[self.source[f"`{c}`"] for c in own],
                             *[marks[c] for c in marks.columns if c != "_marked_row"])

    def cleaned(self) -> DataFrame:
        """The source rows that no model flagged."""
        flagged = self.votes.filter(F.col("votes") > 0).select(F.col("row_id").alias("_flagged_row"))
        return self.source.join(flagged, quoted(self.row_id) == F.col("_flagged_row"), "left_anti")

    def document(self, limit: int | None = None, points: int | None = None) -> DataFrame:
        """The report as one nested row: whole, or with lists of at most ``limit`` rows and ``points`` drawn points.

        A nested row must fit one task; for large tables give limits, or use ``document_lines``.
        """
        rows = self.top_rows(limit).groupBy("model").agg(
            F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("_order"), "row", "score", "reason"))).alias("rows")
        )
        models = self.model_summary().join(rows, F.col("id") == F.col("model"), "left").drop("model").withColumn(
            "rows", F.transform(F.coalesce("rows", F.array()), lambda r: F.struct(r["row"], r["score"], r["reason"]))
        )
        doc = self._heading()
        parts = [(models, "models"), (self.votes_histogram().orderBy("votes"), "votes_histogram")]
        ranked = self.consensus(limit)
        def earlier(l: Column, r: Column) -> Column:
            return (F.when(l["votes"] != r["votes"], r["votes"] - l["votes"])
                    .when(l["consensus_score"] > r["consensus_score"], -1)
                    .when(l["consensus_score"] < r["consensus_score"], 1)
                    .otherwise(F.signum(l["row"] - r["row"]).cast("int")))

        in_order = F.array_sort(F.collect_list(F.struct(*ranked.columns)), earlier)
        doc = doc.crossJoin(ranked.agg(in_order.alias("consensus")))
        if self.prepared.numeric:
            parts.append((self.numeric_statistics(), "numeric_statistics"))
        if self.prepared.categorical:
            parts.append((self.categorical_statistics(), "categorical_statistics"))
        scatter = self.scatter(points)
        if scatter is not None:
            parts.append((scatter, "scatter"))
        for df, name in parts:
            doc = doc.crossJoin(_listed(df, name))
        return doc

    def _heading(self) -> DataFrame:
        """(parameters, summary) in one row."""
        params = self.wide.sparkSession.range(1).select(F.struct(
            F.array(*[F.lit(m) for m in self.models]).alias("models"),
            F.array(*[F.lit(c) for c in self.params.numeric_columns]).cast("array<string>").alias("numeric_columns"),
            F.array(*[F.lit(c) for c in self.params.categorical_columns]).cast("array<string>").alias("categorical_columns"),
            F.lit(self.params.threshold).alias("threshold"),
        ).alias("parameters"))
        return params.crossJoin(self.summary().select(F.struct("*").alias("summary")))

    def document_lines(self) -> DataFrame:
        """The whole report with one row per entry, so that no row grows with the table.

        The row of section ``head`` holds what is as short as the lists of models and columns. Every other row holds one
        entry: of a model's flagged rows (``model_rows``), of the main list (``consensus``) or of the ``scatter`` table,
        in a column named like its section. ``nth`` counts from 0 in report order; scatter points have no order.
        """
        head = self._heading()
        parts = [(self.model_summary(), "models"), (self.votes_histogram().orderBy("votes"), "votes_histogram")]
        if self.prepared.numeric:
            parts.append((self.numeric_statistics(), "numeric_statistics"))
        if self.prepared.categorical:
            parts.append((self.categorical_statistics(), "categorical_statistics"))
        for df, name in parts:
            head = head.crossJoin(_listed(df, name))
        flagged = materialize(self.results.filter("flag").select("model", "score", "row_id", F.col("reason.message").alias("reason")), "flagged")
        by_model = ordered_list(flagged, [F.col("model"), F.desc("score"), F.col("row_id")], "flagged-rows").numbered("nth")
        row = (F.col("row_id") + 1).alias("row")
        lists = {
            "model_rows": by_model.select("nth", F.struct("model", row, "score", "reason").alias("model_rows")),
            "consensus": self._told(self.ranked_consensus.numbered("nth")).select(
                "nth", F.struct(row, "votes", "consensus_score", "values", "reasons").alias("consensus")),
        }
        scatter = self.scatter()
        if scatter is not None:
            lists["scatter"] = scatter.select(F.lit(None).cast("bigint").alias("nth"), F.struct("*").alias("scatter"))
        lines = head.withColumns({"section": F.lit("head"), "nth": F.lit(0).cast("bigint")})
        for name, entries in lists.items():
            lines = lines.unionByName(entries.withColumn("section", F.lit(name)), allowMissingColumns=True)
        return lines.select("section", "nth", *[c for c in lines.columns if c not in ("section", "nth")])


def _listed(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.collect_list(F.struct(*df.columns)).alias(name))


def analyze(df: DataFrame, params: Parameters, row_id: str = "row_id") -> Analysis:
    """Run the chosen methods and write their results once."""
    params.check(df.columns)
    p = prepare(df, params.numeric_columns, params.categorical_columns, row_id)
    p.df = materialize(p.df, "prepared")  # every method scans it, and text is then parsed only once
    fitted = fit(p, params.models, params.threshold)
    return Analysis(df, row_id, params, p, fitted, materialize(fitted.add(p.df), "results"))
