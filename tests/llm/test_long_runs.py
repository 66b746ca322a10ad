"""Scores of long runs of letters against all their segmentations, and the row keys of the pipeline."""

import numpy as np

import corpus_pipeline
from oddsift.llm import langid


def summed(body, pieces, probability):
    """Every way to cut ``body`` into pieces, by plain recursion over prefixes in logarithms."""
    index = {p: i for i, p in enumerate(pieces)}
    total = [np.zeros(probability.shape[1])]
    for end in range(1, len(body) + 1):
        ways = []
        for start in range(end):
            piece = body[start:end]
            i = index.get(piece, len(pieces) if end - start == 1 else None)
            if i is not None:
                ways.append(total[start] + np.log(probability[i]))
        total.append(np.logaddexp.reduce(ways, axis=0))
    return total[-1]


def test_long_runs_sum_all_segmentations(monkeypatch):
    monkeypatch.setattr(langid, "STRETCH", 64)
    g = np.random.default_rng(4)
    pieces = sorted({"▁a", "▁ab", "▁", "a", "b", "c", "ab", "abc", "bca", "cc", "ca", "abcabc"})
    probability = g.dirichlet(np.ones(len(pieces) + 1), 3).T
    for size in (200, 49, 64, 63, 1000):
        word = "".join(g.choice(list("abcx"), size))
        got = langid.long_likelihood(word, langid.Pieces(pieces), probability)
        assert np.allclose(got, summed("▁" + word, pieces, probability), rtol=1e-9)
        if size < 100:
            assert np.allclose(got, langid.Lattice([word], langid.Pieces(pieces)).log_likelihood(probability)[0], rtol=1e-9)


def test_stage_keeps_rows_by_their_own_text(spark):
    long = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    third = " ".join(f"u{i}" for i in range(60))
    rows = [(1, long), (2, long), (2, other), (None, other), (None, third), (None, third), (5, third), (7, third + " end"), (8, ""), (8, ""), (9, None)]
    docs = spark.createDataFrame([(*r, "en", "s", 1, "x") for r in rows], "doc_id bigint, text string, lang string, source string, n_chars int, row_key string")
    got = corpus_pipeline.jaccard_stage(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in got.collect() if r.text) == [(1, long), (2, other), (5, third)]
    assert sum(not r.text for r in got.collect()) == 3
    twice = docs.where("doc_id = 1").union(docs.where("doc_id = 1"))
    assert corpus_pipeline.jaccard_stage(spark, twice, "").count() == 1
    assert corpus_pipeline.jaccard_stage(spark, docs.limit(0), "").count() == 0
