import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddsift.functions import dist, scalars


def test_sidak_inverts():
    assert dist.sidak_rate(0.05, 1) == pytest.approx(0.05)
    assert 1 - (1 - dist.sidak_rate(0.05, 30)) ** 30 == pytest.approx(0.05)


def test_chi_square_quantile_matches_the_jvm(spark):
    jvm = spark._jvm.org.apache.commons.math3.distribution.ChiSquaredDistribution
    for q, f in ((0.95, 2), (0.98, 6), (0.99, 30), (0.7, 1)):
        assert dist.chi2_quantile(q, f) == pytest.approx(jvm(float(f)).inverseCumulativeProbability(q), rel=1e-8)
    assert dist.chi2_quantile(0.95, 2) == pytest.approx(-2 * math.log(0.05), rel=1e-13)


@pytest.mark.parametrize("n,p", [(600, 0.02), (50, 0.3), (1000, 0.05)])
def test_binomial_tail_is_exact(n, p):
    ks = np.array([1, 2, 5, n // 20 or 1, n // 3, n - 1, n])
    exact = [float(sum(math.comb(n, i) * Fraction(p) ** i * (1 - Fraction(p)) ** (n - i) for i in range(k + 1))) for k in ks]
    assert dist.binom_cdf(ks, n, p) == pytest.approx(exact, rel=1e-12)


def test_number_texts(spark):
    cases = {
        "1.200,5": 1200.5, "2.000": 2000.0, "1200.5": 1200.5, "abc": None, "R$ 3,5": 3.5, "10%": 10.0, "-2.000": -2000.0,
        "1 200": 1200.0, "1 200": 1200.0, "1,234.56": 1.23456, "1,234,567": None, "2.0000": 2.0, "": None, "  ": None,
        "1d": None, "1f": None, "inf": None, "1e400": None, "1e3": 1000.0, " -7 ": -7.0, "+3.5": 3.5, ".5": 0.5, "5.": 5.0,
    }
    df = spark.createDataFrame([(k,) for k in cases], "v string").select("v", scalars.to_num(F.col("v")).alias("x"))
    assert {r.v: r.x for r in df.collect()} == cases
    flags = spark.createDataFrame([(True,)], "b boolean")
    assert flags.select(scalars.to_num(F.col("b"), flags.schema["b"].dataType)).first()[0] is None


def test_readable_numbers(spark):
    cases = {0.0: "0", 5.0: "5", 1020.4: "1020.4", 0.000123: "0.000123", 0.5: "0.5", -0.98765: "-0.9876", 12.345: "12.34",
             -3.0: "-3", 99999.999: "100000", 1e20: "100000000000000000000", 100.25: "100.25"}
    df = spark.createDataFrame([(k,) for k in cases], "v double")
    got = {r.v: r.x for r in df.select("v", scalars.readable_number(F.col("v")).alias("x")).collect()}
    assert got == cases
    assert [scalars.readable(v) for v in (5.0, 1020.4, 0.000123)] == ["5", "1020.4", "0.000123"]


def test_two_digits(spark):
    cases = {0.0067116: "0.0067", 7.2e-05: "7.2e-05", 0.05: "0.05", 0.0001: "0.0001", 1e-10: "1e-10", 1e-300: "1e-300"}
    df = spark.createDataFrame([(k,) for k in cases], "v double")
    assert {r.v: r.x for r in df.select("v", scalars.two_digits(F.col("v")).alias("x")).collect()} == cases


def test_fold_and_cites_and_buckets(spark):
    row = spark.sql("select '  São JOÃO ' as a, cast(null as string) as b").select(
        scalars.fold_text(F.col("a")), scalars.fold_text(F.col("b"))).first()
    assert tuple(row) == ("sao joao", "")
    said = F.array(F.lit("'valor' = 25000 está a 24"), F.lit("'loja' = 'Centro' aparece em 0,3%"))
    assert set(spark.range(1).select(scalars.cited_columns(said, ["valor", "loja"])).first()[0]) == {"valor", "loja"}
    got = spark.sql("select explode(array(0, 2, 3)) v").select(scalars.vote_bucket(F.col("v"), 5)).collect()
    assert [r[0] for r in got] == ["none", "minority", "majority"]


def test_fold_agrees_with_the_character_database(spark):
    import unicodedata

    texts = ["Ελλάδα ΐΰ", "Йё Їй Ў", "Việt Nam ĐỖ", "한국어 값 각", "ガギ ぱ", "ǖ ﬁ ½", "ো ொ", "\U0001109a \U000110ab", "a\u0301\u0327 ", "\ufa10", "", None]
    want = ["".join(c for c in unicodedata.normalize("NFD", t or "") if unicodedata.category(c) != "Mn").lower().strip() for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.f for r in df.select("i", scalars.fold_text(F.col("t")).alias("f")).orderBy("i").collect()] == want
