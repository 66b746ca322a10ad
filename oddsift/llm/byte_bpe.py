"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string there is exactly one token that can end its encoding. ``Prefix`` keeps that token
for each prefix: encoding walks it backwards, an append extends it, and an edit recomputes only from the edit to the
place where old and new states agree again. A token may follow the last token of the prefix before it when no merge
across their boundary would come first; that is read off the two tokens' merge histories.

Texts are cut by a pattern first and each match is encoded alone, as rank-file tokenizers do; a match that is itself a
token is that token.

Defined cases: null and empty texts have no tokens, and the hashes of no bytes. Repeated rows give one result row
each. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsift.llm.base import worker_store

NEVER = 1 << 40
CACHED_PIECES = 500_000


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in rank order."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class Vocabulary:
    """Tokens, and for each the tokens at its left and right edge while its bytes are merged."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.longest = max(map(len, tokens), default=1)
        #: per token: (edge token, rank of the merge that absorbs it) from single byte to whole token
        self.left: dict[int, list[tuple[int, int]]] = {}
        self.right: dict[int, list[tuple[int, int]]] = {}
        self._follows: dict[tuple[int, int], bool] = {}
        for i, t in enumerate(tokens):
            self._history(i, t)
        #: tokens that merging their own bytes gives; no other can end an encoding
        self.reached = {tokens[i]: i for i in self.left}

    def _history(self, token: int, body: bytes) -> None:
        """Merge the token's own bytes and note its edges; a token that its bytes do not merge to gets none."""
        rank = self.rank
        parts = [body[k : k + 1] for k in range(len(body))]
        left, right = [], []
        while len(parts) > 1:
            best, at = NEVER, -1
            for k in range(len(parts) - 1):
                r = rank.get(parts[k] + parts[k + 1], NEVER)
                if r < best:
                    best, at = r, k
            if at < 0:
                return
            if at == 0:
                left.append((rank[parts[0]], best))
            if at == len(parts) - 2:
                right.append((rank[parts[-1]], best))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        self.left[token] = [*left, (token, NEVER)]
        self.right[token] = [*right, (token, NEVER)]

    def follows(self, before: int, after: int) -> bool:
        """Whether ``before`` then ``after`` stay as they are when their bytes are merged together."""
        key = before, after
        known = self._follows.get(key)
        if known is None:
            if len(self._follows) > 2_000_000:
                self._follows.clear()
            known = self._follows[key] = self._separate(before, after)
        return known

    def _separate(self, before: int, after: int) -> bool:
        a, b = self.right[before], self.left[after]
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = a[i], b[j]
            across = self.rank.get(self.tokens[x] + self.tokens[y], NEVER)
            # of merges with one rank the leftmost is first: before's own, then the one across, then after's own
            if across < x_until and across <= y_until and across < NEVER:
                return False
            if x_until == y_until == NEVER:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1


class Prefix:
    """A byte string with the last token of each of its prefixes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data = vocabulary, bytearray()
        self.last: list[int] = [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        done = len(self.data)
        self.data += data
        body = bytes(self.data)
        for end in range(done + 1, len(body) + 1):
            self.last.append(self._last(body, end))

    def replace(self, start: int, stop: int, data: bytes) -> int:
        """Put ``data`` in place of bytes ``start:stop``; returns how many prefixes were worked out anew."""
        old, tail = self.last, len(self.data) - stop
        self.data[start:stop] = data
        self.last = old[: start + 1]
        agree, offset, body = 0, stop - start - len(data), bytes(self.data)
        for end in range(start + 1, len(self.data) + 1):
            if agree > self.vocabulary.longest:
                self.last.extend(old[end + offset :])
                return end - start - 1
            token = self._last(body, end)
            self.last.append(token)
            # beyond the edit, equal tokens over the reach of the longest token settle all that follow
            in_tail = end > len(self.data) - tail
            agree = agree + 1 if in_tail and token == old[end + offset] else 0
        return len(self.data) - start

    def _last(self, body: bytes, end: int) -> int:
        v, last = self.vocabulary, self.last
        reached, known = v.reached.get, v._follows.get
        for start in range(max(0, end - v.longest), end):
            token = reached(body[start:end])
            if token is not None:
                if not start:
                    return token
                fits = known((last[start], token))
                if fits or fits is None and v.follows(last[start], token):
                    return token
        raise ValueError("a byte is missing from the vocabulary")

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.vocabulary.tokens[self.last[end]])
        return out[::-1]


class Encoder:
    """Encodes whole texts; pieces met before in this worker are looked up."""

    def __init__(self, tokens: list[bytes], pattern: str, key: str):
        self.pattern = regex.compile(pattern)
        store = worker_store("byte_bpe")
        if store.get("key") != key:
            store.clear()
            store.update(key=key, vocabulary=Vocabulary(tokens), pieces={})
        self.vocabulary: Vocabulary = store["vocabulary"]
        self.pieces: dict[str, bytes] = store["pieces"]

    def _piece(self, piece: str) -> bytes:
        body = piece.encode()
        whole = self.vocabulary.rank.get(body)
        ids = [whole] if whole is not None else Prefix(self.vocabulary, body).ids()
        packed = np.array(ids, dtype="<u4").tobytes()
        if len(self.pieces) < CACHED_PIECES and len(body) < 200:
            self.pieces[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        get, out = self.pieces.get, []
        for piece in self.pattern.findall(text):
            out.append(get(piece) or self._piece(piece))
        return b"".join(out)

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


def encode(docs: DataFrame, tokens: list[bytes], pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) and decoded bytes of every document."""

    def rows(encoder: Encoder, texts: Iterable[str | None]) -> dict[str, pa.Array]:
        packed = [encoder.encode(x or "") for x in texts]
        sizes = np.array([len(p) // 4 for p in packed], dtype=np.int32)
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
        flat = pa.array(np.frombuffer(b"".join(packed), dtype="<u4").astype(np.int32))
        return {"ids": pa.ListArray.from_arrays(offsets, flat), "decoded": pa.array([encoder.decode(p) for p in packed], pa.binary())}

    return _mapped(docs, tokens, pattern, rows, "ids array<int>, decoded binary", doc_id, text)


def digest(docs: DataFrame, tokens: list[bytes], pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, and sha256 of the packed ids and of the decoded bytes, without sending ids out of the task."""

    def rows(encoder: Encoder, texts: Iterable[str | None]) -> dict[str, pa.Array]:
        packed = [encoder.encode(x or "") for x in texts]
        return {
            "n_tokens": pa.array([len(p) // 4 for p in packed], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(encoder.decode(p)).hexdigest() for p in packed], pa.string()),
        }

    return _mapped(docs, tokens, pattern, rows, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", doc_id, text)


def _mapped(docs: DataFrame, tokens: list[bytes], pattern: str, rows, schema: str, doc_id: str, text: str) -> DataFrame:
    key = hashlib.sha256(b"\n".join(map(base64.b64encode, tokens)) + pattern.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokens, pattern, key)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = rows(encoder, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *found.values()], ["doc_id", *found])

    chosen = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, f"doc_id bigint, {schema}")
