"""References and verdicts of the quality rules against plain counting."""

import math
import re
from collections import Counter, defaultdict

import pytest

from oddsift.llm import rules

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
GROUPS = [" \t\x0b\x0c\r", "\n", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:!?'\"-", "()[]{}", "#*$%&|<>"]


def class_of(c):
    return 9 if ord(c) > 127 else next((i for i, g in enumerate(GROUPS) if c in g), 8)


def words_of(text):
    return [w.translate(LOWER) for w in WORD.findall(text or "")]


def divergence(counts, reference):
    """Jensen-Shannon distance of counts from shares, both by name."""
    n, total = sum(counts.values()), 0.0
    for k in {*counts, *reference}:
        p, q = counts.get(k, 0) / n, reference.get(k, 0)
        m = (p + q) / 2
        total += sum(x * math.log2(x / m) for x in (p, q) if x > 0) / 2
    return math.sqrt(min(max(total, 0), 1))


def plain(rows, limits=rules.Limits()):
    """id -> class distance, word distance and verdict, by dictionaries of strings."""
    words, classes = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang in rows:
        if lang is not None:
            words[lang].update(words_of(text))
            classes[lang].update(map(class_of, text or ""))
    words = {k: v for k, v in words.items() if v}
    sizes = {k: sum(v.values()) for k, v in words.items()}
    common = {w for k, v in words.items() for w, n in v.items() if n >= limits.common_share * sizes[k]}
    pooled_words, pooled_classes = Counter(), Counter()
    for k in words:
        pooled_words.update({w: n for w, n in words[k].items() if w in common})
        pooled_words[None] += sum(n for w, n in words[k].items() if w not in common)
        pooled_classes.update(classes[k])
    prior = limits.prior_words / max(sum(sizes.values()), 1)

    def reference(own, pooled):
        smooth = {k: own.get(k, 0) + prior * n for k, n in pooled.items()}
        return {k: v / sum(smooth.values()) for k, v in smooth.items()}

    own_words = {k: {**{w: n for w, n in v.items() if w in common}, None: sum(n for w, n in v.items() if w not in common)} for k, v in words.items()}
    word_refs = [reference(own_words[k], pooled_words) for k in words]
    class_refs = [reference(classes[k], pooled_classes) for k in words]
    out = {}
    for doc, text, _ in rows:
        found = Counter(w if w in common else None for w in words_of(text))
        seen, n = Counter(map(class_of, text or "")), len(words_of(text))
        a = min((divergence(seen, r) for r in class_refs), default=0) if seen else 0
        b = min((divergence(found, r) for r in word_refs), default=0) if n else 0
        far = a > limits.class_distance + limits.class_slack / math.sqrt(max(sum(seen.values()), 1))
        far |= b > limits.word_distance + limits.word_slack / math.sqrt(max(n, 1))
        out[doc] = a, b, not (far and n >= limits.min_words)
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in rules.score(df, rules.references(df)).collect()}
    for doc, (a, b, near) in plain(rows).items():
        assert got[doc].class_distance == pytest.approx(a, abs=1e-9) and got[doc].word_distance == pytest.approx(b, abs=1e-9)
        assert got[doc].kept == (near and not got[doc].base_failed)
    return got


def test_distances_and_verdicts_on_the_smallest_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = check(spark, [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()])
    assert sum(r.kept for r in got.values()) > len(got) / 2


@pytest.mark.parametrize("times", [1, 9, 11, 40])
def test_a_rare_language_is_kept_whatever_its_size(spark, times):
    """Ninety words of a language of their own, once to forty times: no number of words turns the verdict."""
    english = "the house of a man is on the road to the town and he said that it was good for him to go there now "
    rare = " ".join(f"{a}{b}" for a in ("ka", "mo", "ti", "lu", "se") for b in ("", "ru", "na", "ki", "pe", "wo")) + " "
    rows = [(i, english * 4 + f"number {i}", "en") for i in range(60)]
    rows += [(100 + i, rare + rare[::-1] + f"{i} " + rare.upper().lower(), "xx") for i in range(times)]
    got = check(spark, rows)
    assert all(got[d].word_distance < 0.6 for d in got) and len({got[d].kept for d in got if d >= 100}) == 1
