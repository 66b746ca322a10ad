"""Vectors of several dimensions in one table."""

from pyspark.sql import functions as F

from oddsift.llm import permindex


def test_every_dimension_is_searched(spark):
    vectors = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (10, [1.0, 0.0, 0.0]), (11, [1.0, 0.2, 0.0])]
    rows = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>")
    got = permindex.search(rows, F.col("vec_id") % 10 == 0, k=2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 1), (0, 2), (10, 11)]
