"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

All of it is DataFrame functions. Places of matches come from the stretches between them: a split by the pattern and
the list of its matches together give every start and end in code points.

The models count character pairs in labelled strings, smoothed by one and by a share ``UNSEEN`` of any pairs. A stretch of a run of ``CANDIDATE`` characters is
a secret if the log-likelihood ratio summed over its pairs is at least ``MIN_RATIO`` (the logarithm of the odds against
secrets in ordinary text). Numbers, dates, UUIDs and numbered names are ordinary, so they are not secrets by themselves. Its span is widened to the signs around it, and over parts of at most three characters next
to it. It stands beside the matches of fixed patterns, unless one of them covers it whole.

Defined cases: a null text is empty and has no spans; the hash is that of the empty string then. Repeated rows each
get a result row. An empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    group: int
    shortest: int


# The base patterns, the group whose length counts, and the length it needs.
BASE = [
    Kind("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 16),
    Kind("hex", r"[0-9a-f]+", 0, 32),
]
ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_=-"
CANDIDATE = Kind("random", r"[A-Za-z0-9+/_=-]{16,}", 0, 16)
#: from the last character of a stretch: the rest of its part, and up to eight short parts after it
BESIDE = r"^(?:[A-Za-z0-9]++|(?=[+/_=-]))(?:[+/_=-][A-Za-z0-9]{0,3}+(?![A-Za-z0-9])){0,8}+"
MIN_RATIO = 14.0
#: share of pairs that follow no sample: a pair that training never met says no more than that
UNSEEN = 0.05
NAMES = [k.name for k in BASE] + [CANDIDATE.name]
MASK = "[SECRET]"

# Parts of ordinary identifiers.
PARTS = (
    "get set add user name file path data list item index value key count total order date time start stop read write open close "
    "page text line word table column row node link host port server client request response error message status result type "
    "class object method field model view test build main init load save update delete create find sort filter merge split "
    "invoice customer account product payment address number version config service handler context session cache query queue job "
    "task worker event source target input output parse format convert validate check verify process provider module package import "
    "export local global public private image report review avoid"
).split()


def matches(text: Column, kind: Kind, order: int, keep: Column | None = None) -> Column:
    """array<struct<start, kind, end, value>> of a pattern's leftmost matches whose group is long enough."""
    gaps = F.split(text, kind.pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    value = whole if kind.group == 0 else F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group))
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>")

    def step(state: Column, m: Column) -> Column:
        start = state["at"] + F.length(m["gap"])
        end = start + F.coalesce(F.length(m["whole"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(order).alias("kind"), end.alias("end"), m["value"].alias("value"))
        grown = F.when(F.length(m["value"]) >= kind.shortest, F.array_append(state["spans"], span)).otherwise(state["spans"])
        return F.struct(end.alias("at"), grown.alias("spans"))

    steps = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), value.alias("value"))
    return F.aggregate(steps, F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("spans")), step, lambda s: s["spans"])


# ---------------------------------------------------------------- models


def ordinary_numbers(rows: DataFrame, part: Callable[[int], Column]) -> DataFrame:
    """Ordinary strings with digits for each ``id``: dates, counters, telephone numbers, UUIDs, URL paths, numbered names."""

    def drawn(seed: int, size: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(size))

    def digits(seed: int, size: int) -> Column:
        return F.lpad(drawn(seed, 10**size).cast("string"), size, "0")

    # any second of the fifty years from 1990 on
    time = F.timestamp_seconds(F.lit(631_152_000) + drawn(10, 50 * 31_557_600))
    digest = F.sha2(F.col("id").cast("string"), 256)
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    kinds = [
        *[F.date_format(time, f) for f in ("yyyyMMddHHmmss", "yyyy-MM-dd", "yyyyMMdd_HHmmss", "yyyy/MM/dd", "yyyyMMdd'T'HHmmss'Z'")],
        *[digits(20 + n, n) for n in (4, 8, 12, 16)],
        F.concat(digits(40, 16), digits(41, 8)),
        F.concat(F.lit("000000"), digits(42, 8)),
        F.concat_ws("-", F.concat(F.lit("+"), digits(43, 2)), digits(44, 3), digits(45, 3), digits(46, 4)),
        F.concat(F.lit("+"), digits(47, 11)),
        F.concat_ws("-", *[F.substring(digest, at, n) for at, n in cuts]),
        F.upper(F.concat_ws("-", *[F.substring(digest, at + 32 * (at < 13), n) for at, n in cuts])),
        F.concat_ws("_", part(0), F.year(time), digits(48, 9)),
        F.concat_ws("-", part(1), digits(49, 6)),
        F.concat_ws("/", part(0), part(1), F.date_format(time, "yyyy-MM-dd"), F.concat_ws("-", part(2), digits(50, 8))),
        F.concat_ws("/", part(2), digits(51, 5), part(3), digits(52, 3)),
        F.concat_ws("/", F.lit("api"), F.concat(F.lit("v"), digits(57, 1)), part(0), part(1)),
        F.concat(F.concat_ws("_", part(3), part(0)), digits(53, 2)),
        F.concat(F.initcap(part(1)), F.initcap(part(2)), digits(54, 1)),
        F.concat(F.upper(part(3)), F.lit("-"), digits(55, 7)),
        F.concat_ws("=", part(0), digits(56, 6)),
    ]
    return rows.select(F.explode(F.array(*kinds)).alias("value"))


def labelled_strings(spark: SparkSession, docs: DataFrame | None = None, text: str = "text", max_docs: int = 400) -> DataFrame:
    """Rows (value, random): digests in usual encodings, and identifiers joined from ordinary words, dates and numbers.

    Lower-case hexadecimal digests are left to the fixed pattern. With ``docs``, the runs of about ``max_docs`` documents
    drawn by a hash are ordinary too, without what the fixed patterns match, and without long runs that mix small letters,
    capitals and digits: those may be secrets themselves.
    """
    digest = F.sha2(F.col("id").cast("string"), 256)
    coded = F.base64(F.unhex(digest))
    upper = F.upper(F.conv(F.substring(digest, 1, 15), 16, 36))
    random = spark.range(3000).select(F.explode(F.array(coded, F.translate(coded, "+/", "-_"), F.concat(upper, F.reverse(upper)))).alias("value"))
    parts = F.array(*[F.lit(p) for p in PARTS])

    def part(k: int) -> Column:
        return F.element_at(parts, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(PARTS))) + 1).cast("int"))

    picked = [part(k) for k in range(4)]
    joined = [F.concat_ws(s, *picked) for s in ("_", "-", "/", "")] + [F.concat(*map(F.initcap, picked)), F.concat_ws("_", *map(F.upper, picked))]
    ordinary = spark.range(1000).select(F.explode(F.array(*joined)).alias("value")).unionAll(ordinary_numbers(spark.range(1000), part))
    if docs is not None:
        rows = docs.count()
        drawn = docs.where(F.pmod(F.xxhash64(text), F.lit(1 << 30)) < int((1 << 30) * min(1.0, max_docs / max(rows, 1))))
        rest = F.col(text)
        for pattern in (BASE[0].pattern, "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}"):
            rest = F.regexp_replace(rest, pattern, " ")
        runs = drawn.select(rest.alias("t")).distinct().select(F.explode(F.regexp_extract_all("t", F.lit("[A-Za-z0-9+/_=-]{4,}"), F.lit(0))).alias("value"))
        mixed = F.lit(True)
        for some in ("[a-z]", "[A-Z]", "[0-9]"):
            mixed &= F.col("value").rlike(some)
        ordinary = ordinary.unionAll(runs.distinct().where(~mixed | (F.length("value") < CANDIDATE.shortest)))
    return random.select("value", F.lit(True).alias("random")).unionAll(ordinary.select("value", F.lit(False).alias("random")))


def pair_ratios(labelled: DataFrame) -> list[float]:
    """For each pair of characters of the alphabet, log P(second | first) if random less that if ordinary."""
    size = len(ALPHABET)
    places = F.sequence(F.lit(1), F.length("value") - 1)
    pairs = labelled.where((F.length("value") > 1) & F.col("random").isNotNull())
    pairs = pairs.select("random", F.explode(F.transform(places, lambda i: F.substring(F.col("value"), i, F.lit(2)))).alias("pair"))
    # at most two rows for each pair of the alphabet come to the driver
    counts = {(r.random, r.pair): r.n for r in pairs.where(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$")).groupBy("random", "pair").agg(F.count("*").alias("n")).collect()}
    rows = {(k, a): sum(counts.get((k, a + b), 0) for b in ALPHABET) for k in (True, False) for a in ALPHABET}
    chance = {
        k: {a + b: (1 - UNSEEN) * (counts.get((k, a + b), 0) + 1) / (rows[k, a] + size) + UNSEEN / size for a in ALPHABET for b in ALPHABET}
        for k in (True, False)
    }
    return [math.log(chance[True][a + b] / chance[False][a + b]) for a in ALPHABET for b in ALPHABET]


def stretches(value: Column, ratios: list[float]) -> Column:
    """array<struct<from, to>> of a string's stretches whose pairs' log-likelihood ratios sum to at least ``MIN_RATIO``.

    A stretch begins where the running sum was last not above zero, and ends at its largest sum. It is closed when the
    sum is back at zero or has fallen by ``MIN_RATIO``, so ordinary text before, after or between secrets hides none.
    """
    table = F.split(F.lit(",".join(f"{r:.6g}" for r in ratios)), ",").cast("array<double>")
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    pairs = F.length(value) - 1
    sign = ALPHABET.index("+") + 1  # from here on; lines of one sign are ordinary

    def score(a: Column, b: Column) -> Column:
        return F.when((a == b) & (a >= sign), F.lit(0.0)).otherwise(F.element_at(table, (a - 1) * len(ALPHABET) + b))

    scores = F.zip_with(F.slice(codes, 1, pairs), F.slice(codes, 2, pairs), score)
    zero, none = F.lit(0.0), F.array().cast("array<struct<from:int,to:int>>")

    def closed(s: Column) -> Column:
        return F.when(s["best"] >= MIN_RATIO, F.array_append(s["done"], F.struct(s["from"].alias("from"), s["to"].alias("to")))).otherwise(s["done"])

    def step(s: Column, r: Column) -> Column:
        total, at = s["total"] + r, s["at"] + 1
        over = (total <= 0) | (total <= s["best"] - MIN_RATIO)
        more = total > s["best"]
        return F.struct(
            at.alias("at"), F.when(over, zero).otherwise(total).alias("total"), F.when(over, at).otherwise(s["from"]).alias("from"),
            F.when(over, zero).when(more, total).otherwise(s["best"]).alias("best"), F.when(more, at + 1).otherwise(s["to"]).alias("to"),
            F.when(over, closed(s)).otherwise(s["done"]).alias("done"),
        )

    start = F.struct(F.lit(0).alias("at"), zero.alias("total"), F.lit(0).alias("from"), zero.alias("best"), F.lit(0).alias("to"), none.alias("done"))
    return F.aggregate(scores, start, step, closed)


# ---------------------------------------------------------------- scan


def spans_of(text: Column, ratios: list[float]) -> tuple[Column, Column]:
    """The spans of the fixed patterns, and those of the models, each sorted."""
    base = F.array_sort(F.concat(*[matches(text, k, i) for i, k in enumerate(BASE)]))

    def within(run: Column) -> Column:
        value = run["value"]

        def span(s: Column) -> Column:
            left = F.reverse(F.substring(value, F.lit(1), s["from"] + 1))
            right = F.substring(value, s["to"], F.length(value))
            start = s["from"] + 1 - F.greatest(reach(left), F.lit(1))
            end = s["to"] - 1 + F.greatest(reach(right), F.lit(1))
            return F.struct(
                (run["start"] + start).alias("start"), F.lit(len(BASE)).alias("kind"), (run["start"] + end).alias("end"),
                F.substring(value, start + 1, end - start).alias("value"),
            )

        return F.transform(stretches(value, ratios), span)

    return base, F.array_distinct(F.flatten(F.transform(matches(text, CANDIDATE, len(BASE)), within)))


def reach(text: Column) -> Column:
    return F.length(F.regexp_extract(text, BESIDE, 0))


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(n) for n in NAMES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def with_spans(docs: DataFrame, ratios: list[float], text: Column, base: str, spans: str) -> DataFrame:
    """``docs`` with the sorted base spans and the sorted spans of all kinds, which may overlap."""
    fixed, found = spans_of(F.coalesce(text, F.lit("")), ratios)
    docs = docs.withColumn(base, fixed).withColumn(spans, found)
    free = F.filter(F.col(spans), lambda s: ~F.exists(F.col(base), lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])))
    return docs.withColumn(spans, F.array_sort(F.concat(F.col(base), free)))


def scan(docs: DataFrame, ratios: list[float], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts per base kind, the hash of the base spans and the list of all spans of every document."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    rows = with_spans(rows, ratios, F.col("text"), "base", "found")

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{BASE[kind].name}")

    counts = [count(i) for i in range(len(BASE))]
    return rows.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def redact(docs: DataFrame, ratios: list[float], text: str, spans: str, base: str) -> DataFrame:
    """``docs`` with every span of the text replaced by ``MASK``; ``spans`` and ``base`` name columns to use between."""
    rows = with_spans(docs, ratios, F.col(text), base, spans)

    def step(state: Column, s: Column) -> Column:
        before = F.substring(F.col(text), (state["at"] + 1).cast("int"), F.greatest(s["start"] - state["at"], F.lit(0)).cast("int"))
        out = F.when(s["start"] >= state["at"], F.concat(state["out"], before, F.lit(MASK))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    whole = F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(F.col(text), (s["at"] + 1).cast("int"), F.length(text))))
    return rows.withColumn(text, F.when(F.size(spans) > 0, whole).otherwise(F.col(text))).drop(spans, base)
