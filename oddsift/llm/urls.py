"""URL filters: allow and block rules, and a logistic regression on hashed character n-grams for the rest.

Everything is DataFrame functions and Spark's own learner. The learner's table is small: the distinct URLs that the
rules judge, or any other labelled URLs, thinned by a hash of the URL to about ``max_labelled`` rows.

Defined cases: a null URL, or one without ``://``, has an empty host and path; no rule fits it and the model judges
the empty strings. Without labelled URLs every score is 0.5. A URL at 0.5 or more is allowed. Repeated rows each get
a result row. An empty table gives an empty result. Only the id and URL columns are read.
"""

from __future__ import annotations

import string

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsift.session import materialize

# Verdict and (host and path) of each rule.
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
AFTER_SCHEME = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), AFTER_SCHEME, 1), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), AFTER_SCHEME, 2)


def fits(rule: str, host: Column, path: Column) -> Column:
    """The rule's host is the URL's or a domain above it, and its path begins the URL's path."""
    own = rule.split("/", 1)[0]
    return ((host == own) | host.endswith("." + own)) & path.startswith(rule[len(own) :])


def rule_of(rules: list[tuple[str, str]], host: Column, path: Column) -> Column:
    """The longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        out = F.when(fits(rule, host, path), F.lit(rule)).otherwise(out)
    return out


def rule_verdict(rules: list[tuple[str, str]], rule: Column) -> Column:
    out = F.lit(None).cast("string")
    for verdict, name in rules:
        out = F.when(rule == name, F.lit(verdict)).otherwise(out)
    return out


def grams(text: Column, size: int, mark: str) -> Column:
    """The character n-grams of a string between marks, each with a letter that says where it is from."""
    padded = F.concat(F.lit("^"), text, F.lit("$"))
    places = F.sequence(F.lit(1), F.greatest(F.length(padded) - size + 1, F.lit(1)))
    return F.transform(places, lambda i: F.concat(F.lit(mark), F.substring(padded, i, F.lit(size))))


def features(host: Column, path: Column) -> Column:
    return F.concat(*[grams(host, n, f"h{n}") for n in (3, 4)], *[grams(path, n, f"p{n}") for n in (2, 3)])


def train(labelled: DataFrame, max_labelled: int = 4000, bits: int = 14, rounds: int = 40, penalty: float = 0.001) -> PipelineModel | None:
    """Fit on rows (url, label 0 or 1); a url that stands there often counts once per label."""
    distinct = labelled.where(F.col("url").isNotNull() & F.col("label").isin(0, 1)).select("url", F.col("label").cast("double").alias("label")).distinct()
    distinct = materialize(distinct, "labelled-urls")
    rows = distinct.count()
    if not rows:
        return None
    drawn = distinct.where(F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, max_labelled / rows)))
    drawn = drawn.select("label", features(host_of(F.col("url")), path_of(F.col("url"))).alias("grams")).coalesce(4)
    hashing = HashingTF(inputCol="grams", outputCol="features", numFeatures=1 << bits, binary=True)
    learner = LogisticRegression(maxIter=rounds, regParam=penalty, probabilityCol="probability", labelCol="label")
    return PipelineModel([hashing, learner.fit(hashing.transform(drawn))])


def judge(
    pages: DataFrame, model: PipelineModel | None, rules: list[tuple[str, str]], page_id: str = "page_id", url: str = "url"
) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score of every URL."""
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = rows.withColumn("rule", rule_of(rules, F.col("host"), F.col("path")))
    if model is None:
        rows = rows.withColumn("score", F.lit(0.5))
    else:
        rows = model.transform(rows.withColumn("grams", features(F.col("host"), F.col("path"))))
        rows = rows.withColumn("score", vector_to_array("probability")[1])
    verdict = F.coalesce(rule_verdict(rules, F.col("rule")), F.when(F.col("score") >= 0.5, "allow").otherwise("block"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def labels_from_rules(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """The labelled table that the rules give: their URLs, 1 for allow and 0 for block."""
    rows = pages.select(F.col(url).alias("url"), rule_verdict(rules, rule_of(rules, host_of(F.col(url)), path_of(F.col(url)))).alias("verdict"))
    return rows.where("verdict is not null").select("url", F.when(F.col("verdict") == "allow", 1).otherwise(0).alias("label"))
