import numpy as np
import pyarrow as pa
import pytest

from oddsift.llm import quality_net
from oddsift.llm.base import Tokens, text_slices


def test_pooled_vectors_are_the_means_over_tokens_and_form_no_row_per_token():
    g = np.random.default_rng(3)
    vectors = g.normal(size=(1 << quality_net.BUCKET_BITS, quality_net.WIDTH)).astype(np.float32)
    words = [f"w{i}" for i in range(500)]
    texts = ["", None, "one", *(" ".join(g.choice(words, int(n))) + "." for n in g.integers(1, 300, 150)), " ".join(g.choice(words, 60_000))]
    got = quality_net.pool_column(pa.array(texts), vectors)
    for t in text_slices(pa.array(texts), 1 << 30):
        tokens = Tokens(t, quality_net.TOKEN_KIND)
        place = quality_net.buckets(tokens.hashes())
        for i in range(t.n):
            own = vectors[place[tokens.first[i] : tokens.first[i + 1]]].astype(float)
            want = np.r_[own.mean(axis=0), np.sqrt((own * own).mean(axis=0))] if len(own) else np.zeros(128)
            assert np.allclose(got[i, :128], want, atol=1e-6) and got[i, 128] == pytest.approx(np.log1p(len(own)))

    class Rows(np.ndarray):
        def __getitem__(self, at):
            assert np.size(at) < 1000 or np.ndim(at) != 1  # buckets met, not tokens
            return np.asarray(self)[at]

    assert np.array_equal(quality_net.pool_column(pa.array(texts), vectors.view(Rows)), got)
