"""Repeated passages against a plain scan over all windows."""

import hashlib
import random

import pytest

from oddsift.llm import repeats


def plain(rows, min_len):
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        body = (text or "").encode()
        mark = bytearray(len(body))
        for i in range(len(body) - min_len + 1):
            window = body[i : i + min_len]
            if window in seen:
                mark[i : i + min_len] = b"\1" * min_len
            seen.add(window)
        kept = bytes(x for x, m in zip(body, mark, strict=True) if not m)
        runs = sum(m and not p for m, p in zip(mark, b"\0" + mark, strict=False))
        out.append((doc, len(body), sum(mark), runs, hashlib.sha256(kept).hexdigest()))
    return out


def ordered(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.fixture(scope="module")
def texts():
    g = random.Random(11)
    words = ["".join(g.choice("abcdefgh") for _ in range(g.randint(2, 7))) for _ in range(60)]

    def prose(n):
        return " ".join(g.choice(words) for _ in range(n))

    passages = [prose(g.randint(5, 60)) for _ in range(12)]
    rows = []
    for i in range(160):
        text = prose(g.randint(0, 60))
        for _ in range(g.randint(0, 3)):
            p = g.choice(passages)
            text += prose(g.randint(0, 9)) + p[g.randint(0, 40) : len(p) - g.randint(0, 40)]
        if i and g.random() < 0.2:
            text = g.choice(rows)[1]
            at = g.randint(0, len(text))
            text = text[:at] + "X" + text[at + 1 :]
        rows.append((i, text))
    # periodic texts, several bytes a letter, and a text that repeats itself
    return [*rows, (160, "é" * 300 + "a" * 500), (161, "a" * 300 + "é" * 200), (162, passages[3] * 4), (163, None), (164, ""), (165, "a" * 100), (166, "a" * 99)]


@pytest.mark.parametrize(("min_len", "most"), [(100, 20_000), (100, 4), (50, 3)])
def test_removed_bytes_equal_a_plain_scan(spark, texts, min_len, most):
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(5)
    assert ordered(repeats.digest(df, min_len, most)) == plain(texts, min_len)


def test_long_texts_in_pieces(spark, texts, monkeypatch):
    monkeypatch.setattr(repeats, "SLICE", 700)
    long = " ".join(t or "" for _, t in texts[:60])
    rows = [*texts[:80], (500, long), (501, long[:9000] + "Z" + long[9000:])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert ordered(repeats.digest(df)) == plain(rows, 100)


def test_rows_that_share_an_id_or_have_none(spark):
    text = " ".join(str(i * i) for i in range(40))
    n = len(text)
    rows = [(None, text, 1), (None, text, 2), (5, text, 3), (5, "q" * 40 + text, 4), (6, None, 5)]
    got = ordered(repeats.digest(spark.createDataFrame(rows, "doc_id bigint, text string, spans int")))
    first, *rest = sorted((r[:4] for r in got), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    assert first == (None, n, 0, 0) and rest == [(None, n, n, 1), (5, n, n, 1), (5, n + 40, n, 1), (6, 0, 0, 0)]


def test_empty_table(spark):
    assert repeats.digest(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_kept_text_and_spans(spark):
    a = "".join(chr(97 + i * 7 % 25) + str(i) for i in range(60))
    rows = [(1, a), (2, "begin " + a + " end")]
    got = {r.doc_id: r for r in repeats.remove(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert bytes(got[1].kept).decode() == a and not got[1].spans
    assert bytes(got[2].kept) == b"begin  end" and [tuple(s) for s in got[2].spans] == [(6, 6 + len(a))]


def test_maximal_repeats_have_all_occurrences():
    g = random.Random(3)
    sides = [("".join(g.choice("ab") for _ in range(12)), "".join(g.choice("ab") for _ in range(12))) for _ in range(40)]
    sides = sorted(set(sides))
    right = [x.encode() for x, _ in sides]
    order = sorted(range(len(sides)), key=right.__getitem__)
    right, left = [right[i] for i in order], [sides[i][1].encode() for i in order]
    got = {(tuple(sorted(m.tolist())), a, b) for m, a, b in repeats.maximal_repeats(right, left, 8)}
    want = set()
    for a in range(13):
        for b in range(1, 13):  # members share their piece
            if a + b >= 8:
                for i in range(len(sides)):
                    same = [j for j in range(len(sides)) if left[j][:a] == left[i][:a] and right[j][:b] == right[i][:b]]
                    wider = a < 12 and len({left[j][: a + 1] for j in same}) == 1
                    longer = b < 12 and len({right[j][: b + 1] for j in same}) == 1
                    if len(same) > 1 and not wider and not longer:
                        want.add((tuple(same), a, b))
    assert got == want
