"""Parts of the operators against plain definitions, without Spark."""

import itertools
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from oddsift.llm import byte_bpe, jaccard, langid, packing, permindex, quality_net, rules
from oddsift.llm.base import Tokens, text_slices, windows


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.Vocabulary(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))


def test_prefixes_append_and_replace_like_encoding_anew(vocabulary):
    library = tiktoken.Encoding("own", pat_str="(?s).+", mergeable_ranks=vocabulary.rank, special_tokens={})
    rnd = random.Random(5)
    for _ in range(150):
        text = "".join(rnd.choice("abcdeorst nß é") for _ in range(rnd.randrange(1, 120))).encode()
        cut = rnd.randrange(len(text) + 1)
        prefix = byte_bpe.Prefix(vocabulary, text[:cut])
        prefix.append(text[cut:])
        assert prefix.ids() == byte_bpe.Prefix(vocabulary, text).ids()
        start = rnd.randrange(len(text) + 1)
        stop = rnd.randrange(start, len(text) + 1)
        prefix.replace(start, stop, b"xyz"[: rnd.randrange(4)])
        assert prefix.last == byte_bpe.Prefix(vocabulary, bytes(prefix.data)).last
        body = bytes(prefix.data)
        if body and body not in vocabulary.rank:
            try:
                whole = body.decode()
            except UnicodeDecodeError:
                continue
            assert prefix.ids() == library.encode_ordinary(whole)


def test_an_edit_leaves_a_far_end_alone(vocabulary):
    prefix = byte_bpe.Prefix(vocabulary, b"the quick brown fox jumps over the lazy dog " * 200)
    assert prefix.replace(10, 12, b"u") < 300


def test_tokens_keep_to_their_texts():
    texts = ["One two\nthree", None, "", "two", "\t two  three "]
    column = pa.array(texts)
    for limit in (1, 8, 1 << 20):
        words = []
        for t in text_slices(column, limit):
            tokens = Tokens(t, lower=True)
            h = tokens.hashes()
            words += [h[a:b].tolist() for a, b in itertools.pairwise(tokens.first)]
        assert [len(w) for w in words] == [3, 0, 0, 1, 2]
        assert words[0][1:] == words[4] and words[3][0] == words[4][0] and words[0][0] != words[0][1]
    (t,) = text_slices(column)
    tokens = Tokens(t, lower=True)
    value, at = windows(tokens.hashes(), tokens.first, 2)
    assert at.tolist() == [0, 1, 4] and value[1] == value[2]


def test_prefixes_of_linked_sets_share_what_they_ask_for():
    rng = np.random.default_rng(3)
    levels = rng.integers(0, 200, 1 << jaccard.SKETCH_BITS).astype(np.uint8)
    cost = jaccard.excess(levels)
    for _ in range(300):
        n = int(rng.integers(1, 160))
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        y = np.unique(np.concatenate((x[rng.random(len(x)) > 0.08], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 12)), dtype=np.uint64))))
        both = len(np.intersect1d(x, y))
        if both and 100 * both >= 85 * (len(x) + len(y) - both):
            (p, a), (q, b) = (jaccard.choose_prefix(v, levels, cost, 85, 100) for v in (x, y))
            assert len(set(p.tolist()) & set(q.tolist())) >= min(a, b)


def test_jensen_shannon_distance():
    p, q = np.array([[3, 1, 0, 0], [0, 0, 5, 5], [0, 0, 0, 0]]), np.array([0.25, 0.25, 0.5, 0])
    a, m = p[0] / 4, (p[0] / 4 + q) / 2
    kl = lambda x: sum(u * np.log2(u / v) for u, v in zip(x, m, strict=True) if u)
    got = rules.distance(p, q)
    assert np.isclose(got[0], np.sqrt((kl(a) + kl(q)) / 2)) and 0 < got[1] < 1 and got[2] == 0


def test_word_likelihood_sums_all_segmentations():
    names = sorted({"▁a", "▁", "a", "b", "ab", "ba", "▁ab", "aba"})
    pieces, p = langid.Pieces(names), np.random.default_rng(1).dirichlet(np.ones(len(names) + 1), 2).T
    words = ["ab", "abab", "b", "axb"]
    got = langid.Lattice(words, pieces).log_likelihood(p)
    for w, row in zip(words, got, strict=True):
        marked, total = "▁" + w, np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(marked) - 1):
            edges = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(marked)]
            parts = [marked[i:j] for i, j in itertools.pairwise(edges)]
            if all(x in names or (len(x) == 1) for x in parts):
                total += np.prod([p[names.index(x) if x in names else len(names)] for x in parts], axis=0)
        assert np.allclose(row, np.log(total))


def test_expectation_maximisation_raises_the_likelihood():
    words, counts = ["banana", "bandana", "cabana", "ana"], np.array([9.0, 4, 2, 7])
    names = sorted({c for w in words for c in w} | {"▁", "an", "ana", "ban", "▁ban"})
    pieces = langid.Pieces(names)
    value = [
        (langid.Lattice(words, pieces).log_likelihood(langid.fit_pieces(words, counts, pieces, n, 1e-6)[:, None])[:, 0] * counts).sum()
        for n in (1, 3, 8)
    ]
    assert value[0] < value[1] < value[2]


def test_patterns_meet_the_demand_near_the_bound():
    rng = np.random.default_rng(2)
    sizes, demand = np.arange(5, 60, 3), rng.integers(50, 400, 19).astype(float)
    columns, used = packing.patterns(sizes, demand, 100)
    assert (sizes @ columns <= 100).all() and np.allclose(columns @ used, demand)
    assert used.sum() <= 1.01 * (sizes @ demand) / 100
    whole, times = packing.plan(sizes, demand.astype(int), int(sizes @ demand) * packing.CLASS_WIDTH, 100 * packing.CLASS_WIDTH)
    assert (whole @ times <= demand).all() and times.sum() <= sizes @ demand // 100


def test_footrule_counts_missing_pivots_as_last():
    rng = np.random.default_rng(4)
    orders = np.array([rng.permutation(12)[:5] for _ in range(30)])
    places = np.full((30, 12), 5, dtype=np.int16)
    np.put_along_axis(places, orders, np.arange(5, dtype=np.int16)[None], 1)
    one = {p: i for i, p in enumerate(orders[0])}
    for got, other in zip(permindex.footrule(orders[0], places), orders, strict=True):
        two = {p: i for i, p in enumerate(other)}
        assert got == sum(abs(one.get(p, 5) - two.get(p, 5)) for p in range(12))


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 6))
    y = (rng.random(3000) < 1 / (1 + np.exp(-3 * x[:, 0] * x[:, 1]))).astype(int)
    net = quality_net.fit(x, y)
    p = net.probability(x)
    assert ((p > 0.5) == (y == 1)).mean() > 0.75
    for low in (0.0, 0.25, 0.5, 0.75):
        own = (p >= low) & (p < low + 0.25)
        assert abs(p[own].mean() - y[own].mean()) < 0.12
