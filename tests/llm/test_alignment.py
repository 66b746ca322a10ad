"""Alignment of two tokenizers against all pairs of tokens."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from oddsift.llm import alignment
from oddsift.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(rows):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = alignment.byte_letters()
    first = {i: bytes(letters.get(c, 0) for c in t) for t, i in a.get_vocab().items()}
    docs = []
    for doc, text in rows:
        groups, links = [], []
        if text:
            body = b" " + text.encode()
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            p = [first[i] for i in x]
            q = [bytes([int(t[3:5], 16)]) if b.is_byte(i) else t.replace("▁", " ").encode() for i in y for t in [b.id_to_piece(i)]]
            if b"".join(p) == body == b"".join(q):
                spans = []
                for parts in (p, q):
                    ends = [sum(map(len, parts[: i + 1])) for i in range(len(parts))]
                    spans.append([(e - len(t), e) for e, t in zip(ends, parts, strict=True)])
                links = [(i, j) for i, s in zip(x, spans[0], strict=True) for j, t in zip(y, spans[1], strict=True) if s[0] < t[1] and t[0] < s[1]]
                start = 0
                for end in sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}):
                    groups.append(tuple([i for i, s in zip(ids, side, strict=True) if start <= s[0] < end] for ids, side in zip((x, y), spans, strict=True)))
                    start = end
        docs.append((doc, groups, links))
    count = Counter(pair for _, _, links in docs for pair in set(links))
    most = {}
    for (i, _), n in count.items():
        most[i] = max(most.get(i, 0), n)
    out = []
    for doc, groups, links in docs:
        shown = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((
            doc, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(count[k] == most[k[0]] for k in links),
            sum(count[k] for k in links), hashlib.sha256(shown.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=str)


ODD = [
    "hello  world", " leading", "trailing ", "a\n\n b\t c", "a \n b", "<|endoftext|> and <s> </s> <unk>", "x▁y z", "café 漢字 \U0001f600 ok", "  no break 　wide", "\x1c \x1c x",
    "don't  they're 1234567 !!! ???", "", None, " ", "   ", "é Å ﬁ", "a" * 200, "word " * 50, "\r\n \r\n", "tab\tonly", "nul\0byte x", "﻿bom start",
]


@pytest.mark.parametrize("looked_up", [1000_000, 3])
def test_odd_texts_equal_all_pairs(spark, looked_up):
    rows = [*enumerate(ODD), (None, "hello world"), (3, "a\n\n b\t c"), (3, "a\n\n b\t c")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id bigint, text string, pairs int").repartition(3)
    got = sorted((tuple(r) for r in alignment.aligned_counts(df, A, B, looked_up=looked_up).collect()), key=str)
    assert got == plain(rows)


def test_query_on_the_smallest_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows.sort(key=lambda r: len(r[1] or ""))
    # all pairs of a text are too many for the longest
    docs = spark.createDataFrame(rows[:150], "doc_id bigint, text string")
    assert sorted((tuple(r) for r in alignment.aligned_counts(docs, A, B).collect()), key=str) == plain(rows[:150])
    got = QUERIES["op13_token_alignment"](spark, sf).toPandas()
    assert sorted(got.doc_id) == sorted(r[0] for r in rows) and (got.n_links >= got.n_groups).all()


def test_groups_and_empty_table(spark):
    df = spark.createDataFrame([(1, "hello  world")], "doc_id bigint, text string")
    (row,) = alignment.groups(df, A, B).collect()
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    assert sum((g.a for g in row.groups), []) == a.encode(" hello  world").ids and sum((g.b for g in row.groups), []) == b.encode("hello  world")
    assert alignment.aligned_counts(df.limit(0), A, B).count() == 0


def test_windows_are_met_again():
    both = alignment.Pair(A, B)
    ids = next(both.encode(["one two one two one"]))
    assert len(both.align(*ids)) == 5
    known = len(both.windows)
    both.align(*ids)
    assert len(both.windows) == known


def test_known_chunks_give_their_windows_without_another_walk():
    both = alignment.Pair(A, B)
    both.worked.clear()
    texts = ["one two, three", "three one two, one", "a\n\n b\t c", "café  漢字 x▁y", "", None]
    kept = [list(zip(*both.align(*ids), strict=True)) if ids else None for ids in both.encode(texts)]
    walked, walk = [], both._window
    both._window = lambda a, b: walked.append(a) or walk(a, b)
    both.align = None  # it was called for every text
    found = list(both.aligned(texts[:3] + texts[4:]))
    assert len(walked) == 3 + len(both._split(texts[2]))
    for got, want in zip(found, kept[:3] + kept[4:], strict=True):
        if want is None:
            assert got is None
            continue
        assert ";".join(got[0]) == ";".join(want[0]) and sum(got[1]) == sum(want[1]) and b"".join(got[2]) == b"".join(want[2])
    del both.align
    (got,) = both.aligned([texts[3]])
    assert (got and ";".join(got[0])) == (kept[3] and ";".join(kept[3][0]))
