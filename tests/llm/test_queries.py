"""The registered queries against brute force on the smallest tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from oddsift.llm import byte_bpe, idfiles
from oddsift.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


def held(ids, mod, rest):
    return np.array([zlib.crc32(str(i).encode()) % mod == rest for i in ids])


def query(spark, name, key="doc_id"):
    return QUERIES[name](spark, SF).toPandas().set_index(key)


def test_quality_scores_separate_held_out_labels(spark, docs):
    got = query(spark, "op1_quality_classifier").loc[docs.doc_id]
    assert (got.held_out.to_numpy() == held(docs.doc_id, 5, 0)).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    marked = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id").quality
    both = got.join(marked, how="inner")
    good, bad = both.score[both.quality == 1], both.score[both.quality == 0]
    assert (good.to_numpy()[:, None] > bad.to_numpy()[None]).mean() > 0.95


def base_spans(text):
    assign = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def test_base_secret_spans(spark, docs):
    got = query(spark, "op2_secret_scans")
    for doc, text in zip(docs.doc_id, docs.text.fillna(""), strict=True):
        spans = base_spans(text)
        listed = [f"{['assign', 'access', 'hex'][k]}:{a}:{b}" for a, k, b in spans]
        row = got.loc[doc]
        assert row.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(k == i for _, k, _ in spans) for i in range(3)]
        assert set(listed) <= set(row.spans.split(",")) or not listed


def test_url_parts_and_rules(spark):
    got = query(spark, "op3_url_filters", "page_id")
    rules = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
    for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", r.url or "")
        host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
        fit = [x for x in rules if ("." + host).endswith("." + x[1].split("/")[0]) and path.startswith("/" + x[1].split("/", 1)[1])]
        row = got.loc[r.page_id]
        assert (row.host, row.path) == (host, path) and 0 <= row.score <= 1
        if fit:
            verdict, rule = max(fit, key=lambda x: len(x[1]))
            assert (row.rule, row.verdict) == (rule, verdict)
        else:
            assert row.rule is None and row.verdict == ("allow" if row.score >= 0.5 else "block")


def test_byte_bpe_equals_library(spark, docs):
    tokens = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    ranks = {t: i for i, t in enumerate(tokens)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = query(spark, "op4_byte_bpe")
    for doc, text in zip(docs.doc_id, docs.text.fillna(""), strict=True):
        ids = np.array(library.encode_ordinary(text), dtype="<u4")
        row = got.loc[doc]
        assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def brute_groups(texts: dict[int, str], width: int, share: int) -> tuple[dict[int, int], dict[int, int]]:
    sets = {}
    for k, text in texts.items():
        w = WORD.findall((text or "").translate(LOWER))
        sets[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    group = {k: k for k in sets}

    def top(k):
        while group[k] != k:
            k = group[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            same = len(sets[a] & sets[b])
            if same and 100 * same >= share * (len(sets[a]) + len(sets[b]) - same):
                x, y = sorted((top(a), top(b)))
                group[y] = x
    return {k: len(v) for k, v in sets.items()}, {k: top(k) for k in sets}


def test_jaccard_components(spark, docs):
    sizes, groups = brute_groups(dict(zip(docs.doc_id, docs.text, strict=True)), 4, 85)
    got = query(spark, "op5_jaccard_join")
    assert got.n_shingles.to_dict() == sizes and got.component_id.to_dict() == groups


def test_rule_counts(spark, docs):
    got = query(spark, "op6_quality_rules")
    for doc, text in zip(docs.doc_id, docs.text.fillna(""), strict=True):
        words, row = WORD.findall(text), got.loc[doc]
        runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        often = Counter(runs)
        repeat = len({i + k for i, r in enumerate(runs) if often[r] > 1 for k in range(5)})
        lines = [x for x in text.split("\n") if WORD.search(x)]
        expected = [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeat]
        assert [row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words] == expected
        failed = len(words) < 10 or 100 * repeat > 20 * len(words)
        assert row.base_failed == failed and not (failed and row.kept)


@pytest.fixture(scope="module")
def word_ids(docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ordered = docs.sort_values("doc_id")
    encoded = library.encode_batch(ordered.text.fillna("").tolist(), add_special_tokens=False)
    return {d: np.array([*e.ids, 1], dtype="<u4") for d, e in zip(ordered.doc_id, encoded, strict=True)}


def test_id_files_round_trip(spark, word_ids, monkeypatch):
    paths, write = [], idfiles.write
    monkeypatch.setattr(idfiles, "write", lambda docs, path, *a: (paths.append(path), write(docs, path, *a)))
    got = query(spark, "op7_id_files")
    start = 0
    for doc, ids in word_ids.items():
        row = got.loc[doc]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    some = list(word_ids)[17]
    (found,) = idfiles.fetch(spark, paths[0], some)
    assert (found == word_ids[some]).all()
    assert idfiles.read(spark, paths[0]).count() == len(word_ids)


def check_pieces(got: pd.DataFrame, word_ids: dict) -> None:
    for doc, own in got.sort_values("start").groupby("doc_id"):
        ids, at = word_ids[doc], 0
        for p in own.itertuples():
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    padded = 0
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
        total = int(own.length.sum())
        assert total <= 2048
        padded += 0 if total & (total - 1) == 0 else 2048 - total
    assert padded == 0


def test_packing_places_every_token_once(spark, word_ids):
    got = QUERIES["op8_packing"](spark, SF).toPandas()
    assert set(got.doc_id) == set(word_ids)
    check_pieces(got, word_ids)


def test_language_of_held_out_documents(spark, docs):
    got = query(spark, "op9_language_id").loc[docs.doc_id]
    assert (got.held_out.to_numpy() == held(docs.doc_id, 3, 1)).all() and got.score.between(0, 1).all()
    right = got.lang_pred.to_numpy() == docs.lang.to_numpy()
    assert right[got.held_out & docs.text.notna().to_numpy()].mean() > 0.95


def test_nearest_neighbours_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().dropna(subset="embedding")
    v = np.array(rows.embedding.tolist(), dtype=np.float64)
    lengths, ids = np.sqrt((v * v).sum(axis=1)), rows.vec_id.to_numpy()
    got = QUERIES["op10_permutation_index"](spark, SF).toPandas().sort_values(["query_id", "rank"])
    hit = 0
    for i in np.flatnonzero(ids % 50 == 0):
        score = (v @ v[i]) / (lengths * lengths[i])
        own = got[got.query_id == ids[i]]
        by_id = dict(zip(ids, score, strict=True))
        assert own["rank"].tolist() == [1, 2, 3, 4, 5] and ids[i] not in set(own.vec_id)
        assert np.allclose(own.score, [by_id[x] for x in own.vec_id], rtol=0, atol=1e-12) and own.score.is_monotonic_decreasing
        score[i] = -9
        hit += len(set(own.vec_id) & set(ids[np.lexsort((ids, -score))[:5]]))
    assert hit >= 0.9 * 5 * (ids % 50 == 0).sum()
