"""Manifests against a plain recursive tree."""

import hashlib
import zlib

import pytest

from oddsift.llm import merkle
from oddsift.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars int, pos int, tree string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    def shown(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    n = None if row["n_chars"] is None else row["n_chars"] + more
    return h(*map(shown, (row["doc_id"], row["source"], row["lang"], n, row["text"])))


def reduce(nodes):
    """The root of a list of digests and each one's path: (sibling digests before, after) a level."""
    paths, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, held = [], []
        for i in range(0, len(nodes), 2):
            run = nodes[i : i + 2]
            for j, own in enumerate(owners[i : i + 2]):
                for leaf_at in own:
                    paths[leaf_at].append((run[:j], run[j + 1 :]))
            up.append(h(*run))
            held.append(sum(owners[i : i + 2], []))
        nodes, owners = up, held
    return nodes[0], paths


def plain(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append(r)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    done = []
    for name in names:
        own = sorted(trees[name], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        done.append((own, *reduce([leaf(r) for r in own])))
    root, upper = reduce([d[1] for d in done])
    out = []
    for (own, subroot, paths), above in zip(done, upper, strict=True):
        for r, path in zip(own, paths, strict=True):
            changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            fold = leaf(r, int(changed))
            siblings = []
            for before, after in path + above:
                siblings += before + after
                fold = h(*before, fold, *after)
            out.append((r["doc_id"], leaf(r), subroot, root, h(*siblings), fold, fold == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [12, 2, 1])
def test_manifest_equals_a_plain_tree(spark, bits):
    rows = [
        {"doc_id": i * 3 % 101, "text": "é" * (i % 9), "lang": ["en", "de", None, "é", "zz", "only"][i % 5 if i else 5], "source": None if i % 4 else "s", "n_chars": None if i % 11 == 0 else i,
         "pos": 1, "tree": "x"}
        for i in range(90)
    ]
    rows += [dict(rows[4])] * 3 + [{"doc_id": None, "text": None, "lang": "en", "source": "", "n_chars": 2, "pos": None, "tree": None}] * 2
    got = merkle.document_manifest(spark.createDataFrame(rows, SCHEMA).repartition(4), bits)
    want = plain(rows)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert {r[6] for r in want} == {True, False}


def test_empty_and_single(spark):
    assert merkle.document_manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    one = [{"doc_id": 7, "text": "a", "lang": "en", "source": "s", "n_chars": 1, "pos": 0, "tree": ""}]
    assert [tuple(r) for r in merkle.document_manifest(spark.createDataFrame(one, SCHEMA)).collect()] == plain(one)


def test_query_on_the_smallest_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op12_merkle_manifest"](spark, sf).collect()), key=str) == plain(rows)
