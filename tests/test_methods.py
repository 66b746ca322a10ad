import numpy as np
import pandas as pd
import pytest
from conftest import frame, neighbour_brute
from pyspark.sql import functions as F

from oddsift.operators import categorical, neighbors, orderstats
from oddsift.operators.model import CATEGORICAL, NUMERIC, list_models
from oddsift.operators.neighbors import fit_knn, fit_lof
from oddsift.operators.numeric import covariance
from oddsift.operators.prepare import prepare
from oddsift.operators.registry import fit


def run(spark, pdf, ids, rate, numeric=(), categorical=(), parts=None):
    df = frame(spark, pdf)
    if parts:
        df = df.orderBy(F.desc("row_id")).repartition(parts)
    p = prepare(df, list(numeric), list(categorical))
    return fit(p, ids, rate).add(p.df).toPandas().sort_values("row_id", ignore_index=True)


def test_methods_are_listed(spark):
    listed = {r.id: r.type for r in list_models(spark).collect()}
    assert listed == {**dict.fromkeys(NUMERIC, "numeric"), **dict.fromkeys(CATEGORICAL, "categorical")}


def test_failed_sensors_score_high(spark, planted_numbers):
    x, planted = planted_numbers
    r = run(spark, x, NUMERIC, 0.02, numeric=list(x.columns))
    for m in NUMERIC:
        assert (r[f"{m}_reason"].notna() == r[f"{m}_flag"]).all(), m
        assert {33, 121} <= set(r.nlargest(25, f"{m}_score").row_id), m
    assert planted <= set(r.nlargest(6, "mahalanobis_score").row_id) and r.mahalanobis_flag[407] and not r.zscore_flag[407]
    why = r.zscore_reason[33]
    assert why["column"] == "heat" and why["value"] == "58" and "'heat'" in why["message"]


def test_results_do_not_depend_on_partitions(spark, planted_numbers):
    x, _ = planted_numbers
    one, many = (run(spark, x, NUMERIC, 0.03, numeric=list(x.columns), parts=n) for n in (None, 11))
    for m in NUMERIC:
        assert np.allclose(one[f"{m}_score"], many[f"{m}_score"], rtol=1e-8) and one[f"{m}_flag"].equals(many[f"{m}_flag"]), m


def test_constant_and_repeated_columns(spark):
    ramp = np.r_[np.linspace(0, 1, 60), 30.0]
    r = run(spark, pd.DataFrame({"flat": 7.0, "ramp": ramp, "again": ramp * 2}), NUMERIC, 0.05, numeric=["flat", "ramp", "again"])
    assert all(np.isfinite(r[f"{m}_score"]).all() for m in NUMERIC)
    assert all(r[f"{m}_score"].idxmax() == 60 for m in NUMERIC)


def test_small_and_one_sided_inputs(spark):
    pair = run(spark, pd.DataFrame({"q": [4.0, 9.0]}), NUMERIC, 0.2, numeric=["q"])
    assert not any(pair[f"{m}_flag"].any() for m in NUMERIC)
    mostly = run(spark, pd.DataFrame({"q": [3.0] * 40 + [3.2, 81.0]}), ["mad"], 0.04, numeric=["q"])
    assert mostly.mad_flag.iloc[-1] and not mostly.mad_flag.iloc[:40].any()
    alone = run(spark, pd.DataFrame({"w": ["left"] * 70 + ["right"]}), ["cooccurrence"], 0.04, categorical=["w"])
    assert alone.cooccurrence_score.eq(0).all() and not alone.cooccurrence_flag.any()
    with pytest.raises(ValueError):
        run(spark, pd.DataFrame({"q": [3.0, 1.0, 2.0, 8.0]}), ["zscore"], 0.5, numeric=["q"])


def test_rows_need_their_own_id(spark):
    for ids in ([0, 1, 1], [0, None, 2]):
        df = spark.createDataFrame([(i, float(k)) for k, i in enumerate(ids)], "row_id bigint, q double")
        with pytest.raises(ValueError, match="unique"):
            prepare(df, ["q"], [])


def test_wide_covariance_agrees_with_numpy(spark):
    x = pd.DataFrame(np.random.default_rng(4).normal(50, 3, (300, 26)), columns=[f"c{i}" for i in range(26)])
    p = prepare(frame(spark, x), list(x.columns))
    assert np.allclose(covariance(p, list(range(26))), np.cov(x.to_numpy(), rowvar=False), rtol=1e-9)


def neighbour_inputs():
    g = np.random.default_rng(3)
    yield "continuous", g.normal(size=(700, 3))
    yield "copies", np.round(g.normal(size=(600, 2)) * 3)
    yield "one hot point", np.vstack([np.zeros((250, 2)), g.normal(size=(500, 2))])


@pytest.mark.parametrize("name,a", list(neighbour_inputs()), ids=[n for n, _ in neighbour_inputs()])
def test_neighbour_methods_match_brute_force(spark, name, a):
    z = (a - a.mean(axis=0)) / a.std(axis=0)
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2)).round(10)
    n = len(a)
    k = min(max(5, int(np.sqrt(n))), n - 1)
    x = pd.DataFrame(a, columns=[f"v{j}" for j in range(a.shape[1])])
    p = prepare(frame(spark, x), list(x.columns))
    for f, want in ((fit_knn, neighbour_brute(d, k)[0]), (fit_lof, neighbour_brute(d, 20)[1])):
        m = f(p, 0.05, leaf_rows=60)
        got = m.transform(p.df).toPandas().sort_values("row_id")
        assert np.allclose(got[f"{m.id}_score"], want, rtol=2e-8, atol=1e-9), m.id


def test_neighbour_search_with_a_heavy_value_and_busy_leaves(spark, monkeypatch):
    g = np.random.default_rng(8)
    a = g.normal(size=(900, 2))
    a[g.random(900) < 0.6, 0] = 0.25  # the widest side, mostly one value
    a[:, 0] *= 3
    monkeypatch.setattr(neighbors, "VISITS_PER_SLICE", 20)
    monkeypatch.setattr(neighbors.answers, "__defaults__", (20,))
    x = pd.DataFrame(a, columns=["u", "v"])
    p = prepare(frame(spark, x), ["u", "v"])
    k = 30
    pts = neighbors.distinct_points(p, k, 50)
    sizes = pts.df.groupBy("leaf").count().toPandas()["count"]
    assert pts.leaves > 10 and sizes.max() < 200
    z = (a - a.mean(axis=0)) / a.std(axis=0)
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2)).round(10)
    got = neighbors.nearest(pts, k, edges=False).toPandas().sort_values("pid")
    assert np.allclose(got["score"], neighbour_brute(d, k)[0], rtol=1e-8)
    # a point goes only to leaves that its radius touches
    asked = neighbors.visits(pts, k, ties=False)
    assert asked.count() < 900 * pts.leaves / 3 and asked.where("leaf = home").count() == 0


def test_splits_avoid_a_heavy_value():
    part = np.column_stack([np.r_[np.full(92, 5.0), np.linspace(0, 100, 8)], np.linspace(0, 1, 100)])
    side, cut = neighbors._split(part, 0.5)
    assert side == 1 and abs((part[:, 1] < cut).mean() - 0.5) < 0.02
    side, cut = neighbors._split(np.array([[1.0], [1.0], [1.0], [2.0]]), 0.5)
    assert (side, cut) == (0, 2.0)
    assert neighbors._split(np.ones((5, 2)), 0.5) is None


def test_odd_shipments_score_high(spark, planted_words):
    x, planted = planted_words
    r = run(spark, x, CATEGORICAL, 0.02, categorical=list(x.columns))
    for m in CATEGORICAL:
        assert (r[f"{m}_reason"].notna() == r[f"{m}_flag"]).all(), m
        assert r.set_index("row_id")[f"{m}_score"].idxmax() in planted, m
    assert all(r[f"{m}_flag"][18] for m in ("frequency", "entropy", "binomial")) and r.frequency_reason[18]["value"] == "balloon"
    assert planted <= set(r.nlargest(3, "cooccurrence_score").row_id) and planted <= set(r.row_id[r.lof_categorical_flag])


def many_words():
    """A column with more than fifty values beside two with few."""
    g = np.random.default_rng(5)
    return pd.DataFrame({"a": [f"v{int(v)}" for v in g.exponential(18, 800)], "b": g.choice(list("pqr"), 800), "c": g.choice(list("xy"), 800)})


@pytest.mark.parametrize("forced_shuffle", [False, True])
def test_categorical_outlier_factors_match_brute_force(spark, monkeypatch, forced_shuffle):
    if forced_shuffle:
        monkeypatch.setattr(orderstats, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(categorical, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(categorical, "FULL_DEPTH_COLUMNS", 0)
        monkeypatch.setattr(categorical, "FIRST_DEPTHS", 1)
    x = many_words()
    assert x.a.nunique() > 50
    codes = x.to_numpy(dtype=object)
    d = np.sqrt(2.0 * (codes[:, None, :] != codes[None]).sum(axis=2))
    want = neighbour_brute(d, max(20, int(np.sqrt(len(x)))))[1]
    got = run(spark, x, ["lof_categorical"], 0.05, categorical=list("abc"))
    assert np.allclose(got.lof_categorical_score, want, rtol=1e-7)


def test_category_scores_match_pandas_on_the_shuffled_path(spark, monkeypatch):
    monkeypatch.setattr(orderstats, "BROADCAST_ROWS", 0)
    x = many_words()
    n = len(x)
    r = run(spark, x, ["frequency", "cooccurrence", "chi_square"], 0.05, categorical=list("abc"))
    f = np.column_stack([x[c].map(x[c].value_counts() / n) for c in x])
    assert np.allclose(r.frequency_score, -np.log(f.min(axis=1)))
    joint = np.column_stack([x.groupby([a, b])[a].transform("size") / n for a, b in (("a", "b"), ("a", "c"), ("b", "c"))])
    assert np.allclose(r.cooccurrence_score, -np.log(joint).mean(axis=1))
    e = np.column_stack([f[:, i] * f[:, j] * n for i, j in ((0, 1), (0, 2), (1, 2))])
    assert np.allclose(r.chi_square_score, ((e - joint * n) / np.sqrt(e)).max(axis=1))


def test_every_pair_of_columns_counts(spark):
    assert len(categorical.column_pairs(27)) == 351
    g = np.random.default_rng(9)
    x = pd.DataFrame({f"c{i}": g.choice(list("ab"), 120) for i in range(27)})
    r = run(spark, x, ["cooccurrence"], 0.05, categorical=list(x.columns))
    v = (x == "a").to_numpy()
    joint = np.mean([-np.log((v[:, [i]] == v[:, i]).__and__(v[:, [j]] == v[:, j]).mean(axis=1)) for i in range(27) for j in range(i)], axis=0)
    assert np.allclose(r.cooccurrence_score, joint)


def test_fitted_closed_forms_score_a_stream(spark, planted_numbers, tmp_path):
    x, _ = planted_numbers
    p = prepare(frame(spark, x), list(x.columns))
    fitted = fit(p, ["zscore", "mahalanobis"], 0.02)
    folder = str(tmp_path / "rows")
    p.df.write.parquet(folder)
    stream = fitted.add(spark.readStream.schema(p.df.schema).parquet(folder)).select("row_id", "zscore_flag", "mahalanobis_flag")
    q = stream.writeStream.format("memory").queryName("scored_stream").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("scored_stream").toPandas().sort_values("row_id", ignore_index=True)
    want = fitted.add(p.df).select(*got.columns).toPandas().sort_values("row_id", ignore_index=True)
    assert got.equals(want)


def test_neighbour_chunks_are_bounded_by_cells(spark, monkeypatch):
    for width in (1, 300, 8192, 50_000, 10_000_000):
        rows = neighbors._rows(width)
        assert 1 <= rows <= neighbors.QUERY_CHUNK and (rows == 1 or rows * width <= neighbors.CHUNK_CELLS)
    # chunks of a few points, and of one where a point has many answers, give the same
    monkeypatch.setattr(neighbors, "CHUNK_CELLS", 400)
    a = np.random.default_rng(12).normal(size=(700, 2))
    x = pd.DataFrame(a, columns=["u", "v"])
    p = prepare(frame(spark, x), ["u", "v"])
    z = (a - a.mean(axis=0)) / a.std(axis=0)
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2)).round(10)
    pts = neighbors.distinct_points(p, 26, 60)
    got = neighbors.nearest(pts, 26, edges=False).toPandas().sort_values("pid")
    assert np.allclose(got["score"], neighbour_brute(d, 26)[0], rtol=1e-8)
