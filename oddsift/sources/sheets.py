"""Reading folders of regional CSV files as text tables."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddsift.functions.scalars import strip
from oddsift.operators.prepare import quoted
from oddsift.session import materialize

# Separators in order of preference, and the texts read as null.
EXTENSIONS = ("csv",)
SEPARATORS = (";", ",", "\t", "|")
NULL_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

_OVERFLOW = "_overflow"


class InvalidInput(ValueError):
    pass


def _listed(path: Column | str) -> Column:
    """Local paths with one slash after the scheme, whichever reader tells them."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of every file."""
    return spark.read.format("binaryFile").load(path).select(_listed("path").alias("path"), "length", "content")


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file."""
    return files(spark, path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def _extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def _plain_path(uri: Column) -> Column:
    """A file's path as listings show it: the metadata column has it as an encoded URI."""
    return _listed(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))))


def _literal(path: str) -> str:
    """A path that stands for itself where Spark takes a pattern."""
    return re.sub(r"([\\*?\[\]{}^,])", r"\\\1", path)


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, first, line) of all lines, their bytes as they are; ``first`` is true of a file's first block.

    A file that fails while it is read gives the lines before the failure.
    """
    text = spark.read.option("ignoreCorruptFiles", True).text(path)
    return text.select(
        _plain_path(F.col("_metadata.file_path")).alias("path"), (F.col("_metadata.file_block_start") == 0).alias("first"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"),
    )


def sniff(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, encoding, separator, head) of every file with a line, judged over all its lines; head is the first."""
    counts = [F.sum(F.octet_length("line") - F.octet_length(F.replace("line", F.lit(s), F.lit("")))).alias(f"s{i}") for i, s in enumerate(SEPARATORS)]
    seen = lines(spark, path).groupBy("path").agg(
        F.bool_and(F.is_valid_utf8("line")).alias("utf8"), *counts,
        F.min_by(F.when(F.col("first"), F.col("line").cast("binary")), F.when(F.col("first"), F.col("at"))).alias("head"),
    )
    places = [F.col(f"s{i}") for i in range(len(SEPARATORS))]
    best = F.array_position(F.array(*places), F.greatest(*places)).cast("int")
    return seen.select(
        "path", F.when(F.col("utf8"), "UTF-8").otherwise("ISO-8859-1").alias("encoding"),
        F.element_at(F.array(*[F.lit(s) for s in SEPARATORS]), best).alias("separator"), "head",
    )


def _header(names: Sequence[str | None]) -> list[str]:
    """Unnamed columns get a number, repeated names a counter."""
    seen: dict[str, int] = {}
    out = []
    for i, name in enumerate(names):
        name = name if name else f"Unnamed: {i}"
        n = seen.get(name, 0)
        seen[name] = n + 1
        out.append(name if n == 0 else f"{name}.{n}")
    return out


def read_csv(spark: SparkSession, path: str | list[str], encoding: str | None = None, separator: str | None = None,
             multiline: bool = False) -> DataFrame:
    """All-text rows. Lines with too many fields are skipped, short ones padded, null texts become null.

    Each file has its own encoding, separator and header. Files that agree in them are read together; other groups
    are united by column name and the whole is written once. Quoted line breaks need ``multiline``, which reads each
    file in one task.
    """
    found = sniff(spark, path).orderBy("path").collect()  # one row per file, as many as Spark lists anyway
    groups: dict[tuple, list[str]] = {}
    for r in found:
        groups.setdefault((encoding or r["encoding"], separator or r["separator"], bytes(r["head"] or b"")), []).append(_literal(r["path"]))
    if not groups:
        raise InvalidInput(f"no lines at {path}")
    if len(groups) == 1:
        ((enc, sep, _),) = groups
        return _read_alike(spark, path, enc, sep, multiline)
    # a file of blank lines alone has no columns and no rows; rejects() names it
    blank = {key for key in groups if not key[2].strip() and len(groups) > 1}
    tables = [_read_alike(spark, paths, enc, sep, multiline, key in blank) for key, paths in groups.items() for enc, sep, _ in [key]]
    tables = [t for t in tables if t is not None]
    if not tables:
        raise InvalidInput(f"no header at {path}")
    return materialize(reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), tables), "sheets")


def _read_alike(spark: SparkSession, path: str | list[str], encoding: str, separator: str, multiline: bool, blank: bool = False) -> DataFrame | None:
    reader = (
        spark.read.option("sep", separator).option("encoding", encoding).option("quote", '"').option("escape", '"')
        .option("multiLine", multiline)
    )
    top = reader.option("header", False).csv(path).first()
    if top is None and blank:
        return None
    if top is None:
        raise InvalidInput(f"no header at {path}")
    names = _header([None if v is None else v.lstrip("\ufeff") for v in top])
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, _OVERFLOW]])
    rows = reader.option("header", True).option("enforceSchema", True).schema(schema).csv(path)
    rows = rows.filter(F.col(_OVERFLOW).isNull())
    return rows.select(*[F.when(~quoted(c).isin(*NULL_TEXTS), quoted(c)).alias(c) for c in names])


def tidy(df: DataFrame) -> DataFrame:
    """Drop columns without any value, then rows without any, and clean the names."""
    got = df.agg(*[F.count(quoted(c)).alias(f"k{i}") for i, c in enumerate(df.columns)]).first()
    kept = [c for i, c in enumerate(df.columns) if got[f"k{i}"]]
    if not kept:
        raise InvalidInput("no data rows")
    filled = F.coalesce(*[quoted(c) for c in kept]).isNotNull()
    return df.filter(filled).select(*[quoted(c).alias(n) for c, n in zip(kept, clean_names(kept))])


def clean_names(names: Sequence[str]) -> list[str]:
    """Trimmed names; blank ones become ``coluna_{place}``; repeats get a counter."""
    return _header([c.strip() or f"coluna_{i + 1}" for i, c in enumerate(names)])


def read_sheet(spark: SparkSession, path: str, **options) -> DataFrame:
    return tidy(read_csv(spark, path, **options))


def rejects(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """(path, reason) of files that cannot be analysed: too large (if a limit is given), wrong kind, unreadable (not one
    line with text), or no data rows."""
    found = spark.read.format("binaryFile").load(path)
    # readers pass over empty files, so the listing names them
    listed = spark.createDataFrame([(p,) for p in found.inputFiles()], "path string").select(_plain_path(F.col("path")).alias("path"))
    sizes = listed.join(found.select(_listed("path").alias("path"), "length"), "path", "left").withColumn("length", F.coalesce("length", F.lit(0)))
    filled = lines(spark, path).filter(strip(F.col("line")) != "").groupBy("path").agg(F.count(F.lit(1)).alias("filled"))
    too_large = F.lit(False) if max_bytes is None else F.col("length") > max_bytes
    reason = (
        F.when(too_large, "too large").when(~_extension(F.col("path")).isin(*EXTENSIONS), "unsupported kind")
        .when(F.coalesce("filled", F.lit(0)) < 1, "unreadable").when(F.col("filled") < 2, "no data rows")
    )
    return sizes.join(filled, "path", "left").select("path", reason.alias("reason")).filter(F.col("reason").isNotNull())
