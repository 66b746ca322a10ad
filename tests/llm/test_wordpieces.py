import random

import numpy as np
import public_tokenizers

from oddsift.llm import wordpieces
from oddsift.llm.base import worker_store

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, "a\x01b c", "<|endoftext|> x", "\x01", " \x01 ", "é́ Ünï Σας İ", "it's 'S don't", "tab\tx  y\n\nz", "日本語 テスト", "<| a", "x" * 500, "12 4,5."]


def test_new_chunks_share_calls_and_give_the_librarys_ids(monkeypatch):
    worker_store("none")
    monkeypatch.setattr(wordpieces, "CACHED_CHUNKS", 40)
    ids = wordpieces.Ids(WORD_BPE, 1)
    texts = [*ODD, " ".join(f"Wort{i}, zahl-{i * 7}" for i in range(900)), *ODD]
    want = [[*ids.tokenizer.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]

    class Counting:
        calls = 0

        def __init__(self, own):
            self.own = own

        def encode_batch_fast(self, some, **kw):
            Counting.calls += len(some)
            return self.own.encode_batch_fast(some, **kw)

    ids.tokenizer = Counting(ids.tokenizer)
    assert [np.frombuffer(p, "<u4").tolist() for p in ids.encode(texts)] == want
    assert Counting.calls < 400  # it was one call for each of some 1,800 chunks
    assert len(ids.chunks) <= 41


def test_plain_texts_are_cut_as_the_library_cuts_them(monkeypatch):
    worker_store("none")
    monkeypatch.setattr(wordpieces, "CACHED_CHUNKS", 60)
    ids = wordpieces.Ids(WORD_BPE, 1)
    draw = random.Random(5)
    signs = [*map(chr, range(256)), *"aeÉß ,. \n's'the't'll" * 12]
    texts = ["".join(draw.choices(signs, k=40)) for _ in range(2000)] + [f"a{c}, {c}. {c}{c}, b{c}" for c in map(chr, range(256))]
    want = [[*e.ids, 1] for e in ids.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [np.frombuffer(p, "<u4").tolist() for p in ids.encode(texts)] == want
    assert len(ids.chunks) + len(ids.chunks.older) <= 62


def test_words_before_signs_are_met_again(monkeypatch):
    worker_store("none")
    ids = wordpieces.Ids(WORD_BPE, 1)
    worked = []
    model = ids.chunks.model

    class Counting:
        def tokenize(self, word):
            worked.append(word)
            return model.tokenize(word)

    ids.chunks.model = Counting()
    ids.encode(["élan vital élan, Vital. ÉLAN!! vital?! élan, vital."])
    # it was a call of the library for each of eight spellings
    assert sorted(worked) == sorted(["élan".translate(wordpieces.byte_letters()), "vital", ",", "!!", "?!", "."])
    worker_store("none")
