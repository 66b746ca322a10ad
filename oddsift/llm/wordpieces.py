"""Token ids of whole texts by a public tokenizer file, looked up chunk by chunk.

The tokenizer treats a text as the chunks between spaces, each on its own, so chunks met before in the worker are
looked up and only new ones go through the library. A chunk is whatever stands between spaces or line feeds.

Where the file cuts texts by ``WORDS``, the rule is plain for Latin-1 texts: they lower-case letter by letter, commas and
full stops after letters and digits are chunks of their own, and a new chunk is cut here and merged by the library's model.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

from oddsift.llm.base import worker_store

CACHED_CHUNKS = 400_000
LONGEST_CACHED = 64
#: new chunks encoded as one text, and the control character set between them
JOINED = 64
MARK = "\x01"

#: how a file must treat texts for the plain rule: its normalizers, and the pattern of its words as bytes
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
CUT = [
    {"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
#: the same for lower-cased Latin-1
LETTERS, DIGITS, SPACES = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
LATIN_WORDS = re.compile(f"[{LETTERS}]+|[{DIGITS}]|'(?:s|t|re|ve|m|ll|d)|[^{SPACES}{LETTERS}{DIGITS}]+")
#: letters and digits as ``a``, blanks, commas and full stops as ``,``, anything else as ``!``
KINDS = bytes(
    ord("a" if re.match(f"[{LETTERS}{DIGITS}]", chr(b)) else " " if chr(b) in " \n" else "," if chr(b) in ",." else "!") for b in range(256)
)


def byte_letters() -> dict[int, str]:
    """What byte-level vocabularies write for each Latin-1 character: a letter for each of its bytes in UTF-8."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    letter = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(256)}


class Known(dict):
    """Ids of chunks, ``CACHED_CHUNKS`` at most. Half of them may be chunks met again after a while, which stay; a quarter
    are the latest new ones, and a quarter those before them (``older``). A chunk of a plain text that is not known is
    worked out."""

    def __init__(self, model):
        super().__init__({"": b""})
        self.model, self.older, self.lasting, self.letters = model, {}, {"": b""}, byte_letters()

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.pop(chunk, None)
        if ids is None:
            ids = self.work_out(chunk)
        elif len(self.lasting) < CACHED_CHUNKS // 2:
            self.lasting[chunk] = ids
        self.keep(chunk, ids)
        return ids

    def work_out(self, chunk: str) -> bytes:
        if not (chunk.isascii() and chunk.isalpha()):
            words = LATIN_WORDS.findall(chunk)
            if words != [chunk]:
                return b"".join(map(self.__getitem__, words))
            if not (chunk.isascii() and chunk.isprintable()):
                chunk = chunk.translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(chunk)]).tobytes()

    def keep(self, chunk: str, ids: bytes) -> None:
        if len(chunk) > LONGEST_CACHED:
            return
        if len(self) >= CACHED_CHUNKS // 4 + len(self.lasting):
            self.older = {c: i for c, i in self.items() if c not in self.lasting}
            self.clear()
            self.update(self.lasting)
        self[chunk] = ids


class Ids:
    """Encodes texts with the tokenizer of a file whose words never reach across a space."""

    def __init__(self, path: str, end_id: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        store = worker_store("wordpieces")
        if store.get("path") != path:
            from tokenizers import Tokenizer

            store.clear()
            tokenizer = Tokenizer.from_file(path)
            with open(path, encoding="utf-8") as f:
                file = json.load(f)
            steps = [(file.get(name) or {}).get(kind) for name, kind in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
            plain = steps == [NORMAL, CUT] and not file.get("post_processor") and all("<|" in t["content"] for t in file["added_tokens"])
            store.update(path=path, tokenizer=tokenizer, plain=plain, chunks=Known(tokenizer.model))
        self.tokenizer, self.chunks, self.plain = store["tokenizer"], store["chunks"], store["plain"]
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids and the end id, as little-endian unsigned 32-bit integers. Null is empty."""
        out, others, look_up = [], [], self.chunks.__getitem__
        for i, x in enumerate(texts):
            chunks = self._plain_chunks(x or "")
            if chunks is None:
                others.append(i)
                out.append(b"")
            else:
                out.append(b"".join(map(look_up, chunks)) + self.end)
        for i, ids in zip(others, self._encode_others([texts[i] or "" for i in others]), strict=True):
            out[i] = ids + self.end
        return out

    def _plain_chunks(self, text: str) -> list[str] | None:
        """Chunks of a text that the plain rule covers. Special tokens are matched before all else, so those texts are not."""
        if not self.plain or "<|" in text:
            return None
        try:
            kinds = text.encode("latin-1").translate(KINDS)
        except UnicodeEncodeError:
            return None
        text = text.lower().replace("\n", " ")
        # a comma or full stop after another sign is one word with it
        if b"!, " not in kinds and b",, " not in kinds:
            text = text.replace(", ", " , ").replace(". ", " . ")
        return text.split(" ")

    def _encode_others(self, texts: list[str]) -> list[bytes]:
        split = []
        for x in texts:
            if x.isascii() and "<|" not in x:
                x = x.lower()
            split.append(x.replace("\n", " ").split(" "))
        found = {}
        for w in set().union(*split):
            found[w] = self.chunks.get(w, self.chunks.older.get(w))
        missing = [w for w, packed in found.items() if packed is None]
        for at in range(0, len(missing), 20_000):
            some = missing[at : at + 20_000]
            for w, packed in zip(some, self._encode_chunks(some), strict=True):
                found[w] = packed
                self.chunks.keep(w, packed)
        return [b"".join(map(found.__getitem__, chunks)) for chunks in split]

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk. Many go through the library in one text, told apart by a mark that stands between them."""
        runs = [chunks[at : at + JOINED] for at in range(0, len(chunks), JOINED)]
        if self.mark is None:
            return [p for run in runs for p in self._one_by_one(run)]
        out = []
        joined = self.tokenizer.encode_batch_fast([f" {MARK} ".join(run) for run in runs], add_special_tokens=False)
        for run, found in zip(runs, joined, strict=True):
            ids = np.array(found.ids, dtype="<u4")
            ends = np.flatnonzero(ids == self.mark).tolist()
            if len(ends) != len(run) - 1 or any(MARK in c or "<|" in c for c in run):
                out += self._one_by_one(run)
                continue
            body, ends = ids.tobytes(), [4 * e for e in ends]
            out += [body[a:b] for a, b in zip([0, *(e + 4 for e in ends)], [*ends, len(body)], strict=True)]
        return out

    def _one_by_one(self, chunks: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]
