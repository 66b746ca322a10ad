import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from oddsift.operators import orderstats as o


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows hold one value."""
    g = np.random.default_rng(1)
    v = np.where(np.arange(6000) % 3 == 0, 5.0, np.round(g.exponential(20, 6000), 2))
    return spark.createDataFrame(pd.DataFrame({"row_id": range(6000), "v": v, "u": g.normal(size=6000)})), v


@pytest.mark.parametrize("group_rows", [10**6, 500, 20])
def test_quantiles_are_exact_however_narrow(skewed, group_rows):
    df, v = skewed
    shares = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = o.quantiles(df, {"v": (F.col("v"), len(v), shares)}, group_rows=group_rows)["v"]
    assert [got[q] for q in shares] == pytest.approx([np.quantile(v, q) for q in shares], rel=1e-15)


@pytest.mark.parametrize("group_rows", [10**6, 30])
def test_weighted_order_statistics(skewed, group_rows):
    df, v = skewed
    w = df.groupBy("v").agg(F.count("*").alias("w"))
    ranks = (0, 10, 2500, 5990, 5999)
    got = o.order_statistics(w, {"v": o.Ranks(F.col("v"), 6000, ranks)}, F.col("w"), w.count(), group_rows)["v"]
    s = np.sort(v)
    for r in ranks:
        assert (got[r].value, got[r].below, got[r].equal) == (s[r], (v < s[r]).sum(), (v == s[r]).sum())


def test_average_ranks_agree_on_both_paths(skewed):
    df, v = skewed
    series = {"v": F.col("v"), "u": F.col("u")}
    want = pd.Series(v).rank().to_numpy()
    for limit in (10**6, 100):
        got = o.average_ranks(df, series, "row_id", len(v), one_task_rows=limit).filter("series = 0").toPandas()
        assert (got.sort_values("row_id").avg_rank.to_numpy() == want).all()


def test_join_keeps_hot_and_cold_rows(spark, skewed):
    df, v = skewed
    table = df.groupBy("v").agg(F.count("*").alias("w"), F.max("u").alias("top"))
    salted = o.join_on_values(df, table, ["v"], "w", 6000, F.col("row_id")).toPandas()
    plain = o.join_on_values(df, table, ["v"], "w", 6000, F.col("row_id"), table.count()).toPandas()
    assert len(salted) == len(plain) == 6000
    assert (salted.sort_values("row_id").top.to_numpy() == plain.sort_values("row_id").top.to_numpy()).all()


@pytest.mark.parametrize("values,rate,flagged", [
    ([1, 1, 1, 1], 0.25, 0), ([0, 0, 5, 5, 1, 1, 1, 1, 1, 1], 0.1, 2), ([0, 1, 1, 1, 1, 1], 0.2, 0), ([3, 1, 2, 0, 0, 0], 0.17, 1),
])
def test_top_cut_never_splits_ties(spark, values, rate, flagged):
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(values)], "row_id bigint, s double")
    cut = o.top_cuts(df, {"s": F.col("s")}, len(values), rate, F.col("row_id"))["s"]
    assert df.filter(cut.flags(F.col("s"))).count() == flagged


def test_running_counts_over_uneven_ranges(spark):
    """Values a factor of ten apart, in ten ranges: any cut by width would leave nearly all of them in one."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(s, 10.0 ** i, i % 4 + 1) for s in (0, 1) for i in range(-150, 150)]
        df = spark.createDataFrame(rows, "series int, value double, cnt bigint").withColumn("twice", F.col("cnt") * 2)
        got = o.cumulative_counts(df, also=["twice"]).toPandas().sort_values(["series", "value"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert (got.cum == got.groupby("series").cnt.cumsum()).all()
    assert (got.cum_twice == 2 * got.cum).all() and len(got) == 600


def test_ordered_list_reads_only_the_ranges_of_a_page(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(5000).select("id", (F.col("id") * 7919 % 1000).alias("v"))
        ranked = o.ordered_list(df, [F.desc("v"), F.col("id")], "listed")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = df.toPandas().sort_values(["v", "id"], ascending=[False, True]).id.to_list()
    assert len(ranked) == 5000 and len(ranked.starts) > 4
    for low, high in ((0, 25), (2490, 2515), (4990, 5010), (0, 5000), (ranked.starts[2], ranked.starts[3]), (5000, 5025), (7, 7)):
        assert [r.id for r in ranked.between(low, high).collect()] == want[low:high]
    page = ranked.between(4980, 5000)
    assert "PartitionFilters: [isnotnull(_part" in page._jdf.queryExecution().executedPlan().toString()
    assert len({r.p for r in page.select(F.input_file_name().alias("p")).collect()}) == 1


def test_ordered_list_of_nothing(spark):
    ranked = o.ordered_list(spark.range(0), [F.col("id")], "nothing")
    assert len(ranked) == 0 and ranked.between(0, 25).count() == 0
