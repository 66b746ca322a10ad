"""Token ids of two tokenizers aligned by the bytes they cover.

Tokenizer A is a byte-level BPE file, B a sentence-piece model that puts a space before the text; both encode the same
bytes, space and text. After the full tokenisation of a text its tokens are cut into windows at whitespace anchors:
offsets where tokens of both end, each followed by a token that starts with a space. What lies in a window depends on
its ids alone, so its groups (runs between shared ends) and links (pairs of tokens that overlap) are worked out once
and kept by the two id tuples. Where both tokenizers start anew at single spaces, the text between them is a window of
its own: what was worked out for it is looked up by that text, and its ids are not needed again.

The number of documents that hold a pair linked is summed over all documents. Each document then adds up its links'
counts: the table of pairs is looked up in memory while it has at most ``LOOKED_UP`` rows (16 bytes each), and is
joined by shuffle beyond that; both ways give the same result.

Defined cases: a null or empty text, and one whose tokens of A or B do not spell space and text, has no tokens; its
numbers are 0 and its groups empty. Special tokens in a text are plain text. Very long texts are encoded whole.
Repeated rows each count as a document. An empty table gives an empty result. Columns besides the two named are not
looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsift.llm.base import worker_store
from oddsift.session import materialize

LOOKED_UP = 4_000_000
KEPT_CHUNKS = 600_000
KEPT_WORKED = 600_000
UNSPELT = "", 0, b"", 0, 0
KEPT_WINDOWS = 600_000
LONGEST_KEPT = 48
#: a single space with text on both sides; both tokenizers start a token there
BETWEEN = re.compile(r"(?<=[^ ]) (?=\S)")
ODD = re.compile(r" \s|^ | $")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Length of each token in bytes, and whether it starts with a space."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        if not all(tokens):
            raise ValueError("a token without bytes")
        self.lengths = [len(t) for t in tokens]
        self.sizes = np.array(self.lengths, dtype=np.int64)
        self.spaced = np.array([t.startswith(b" ") for t in tokens], dtype=bool)


class Pair:
    """Both tokenizers; chunks of texts met before in this worker are looked up."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        store = worker_store("alignment")
        if store.get("paths") != (a_path, b_path):
            store.clear()
            store.update(paths=(a_path, b_path), chunks={}, windows={}, worked={}, **self._load(a_path, b_path))
        self.a, self.b, self.first, self.second = store["a"], store["b"], store["first"], store["second"]
        self.apart, self.chunks, self.windows, self.worked = store["apart"], store["chunks"], store["windows"], store["worked"]

    @staticmethod
    def _load(a_path: str, b_path: str) -> dict:
        import sentencepiece
        from tokenizers import Tokenizer

        a = Tokenizer.from_file(a_path)
        a.encode_special_tokens = True
        with open(a_path, encoding="utf-8") as f:
            model = json.load(f)
        letters = byte_letters()
        first = [b""] * a.get_vocab_size()
        added = {t["content"] for t in model["added_tokens"]}
        for token, i in a.get_vocab().items():
            first[i] = token.encode() if token in added else bytes(letters[c] for c in token)
        b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        second = []
        for i in range(b.get_piece_size()):
            piece = b.id_to_piece(i)
            second.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode())
        # where no token holds a space after another character, what stands before a space does not touch what follows
        pre = model.get("pre_tokenizer") or {}
        apart = pre.get("type") == "ByteLevel" and pre.get("use_regex", False) and not any(b" " in t.lstrip(b" ") for t in second)
        return {"a": a, "b": b, "first": Vocabulary(first), "second": Vocabulary(second), "apart": apart}

    def _split(self, text: str) -> list[str]:
        if not self.apart:
            return [text]
        return BETWEEN.split(text) if ODD.search(text) else text.split(" ")

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of A and B of each text, None where they do not spell it."""
        split = [self._split(t) if t else [] for t in texts]
        known, extra = self.chunks, []
        for c, ids in self._ids([c for c in set().union(*split) if c not in known]):
            if len(c) > LONGEST_KEPT or len(known) >= KEPT_CHUNKS + len(extra):
                extra.append(c)
            known[c] = ids
        for text, chunks in zip(texts, split, strict=True):
            found = [known[c] for c in chunks]
            if not found:
                yield None
            elif None in found:
                yield self._whole(text)
            else:
                yield tuple(np.frombuffer(b"".join(f[side] for f in found), "<i4") for side in (0, 1))
        for c in extra:
            del known[c]

    def _ids(self, chunks: list[str]) -> Iterator[tuple[str, tuple[bytes, bytes] | None]]:
        """Each chunk with its ids of A and B, or None where they do not spell it."""
        for at in range(0, len(chunks), 5_000):
            some = chunks[at : at + 5_000]
            of_a = self.a.encode_batch_fast([" " + c for c in some], add_special_tokens=False)
            of_b = self.b.encode(some, num_threads=1)
            for c, x, y in zip(some, of_a, of_b, strict=True):
                body, x = (" " + c).encode(), x.ids
                spelt = b"".join(map(self.first.tokens.__getitem__, x)) == body == b"".join(map(self.second.tokens.__getitem__, y))
                yield c, (array("i", x).tobytes(), array("i", y).tobytes()) if spelt else None

    def aligned(self, texts: list[str | None]) -> Iterator[tuple | None]:
        """For each text the groups as text, numbers of groups, link codes and numbers of tokens of A and B, each a tuple over
        its parts in order; None where the tokens do not spell it. No group or link crosses the ends of a chunk, which is
        spelt by itself."""
        split = [self._split(t) if t else [] for t in texts]
        known, extra = self.worked, []
        for c, ids in self._ids([c for c in set().union(*split) if c not in known]):
            if len(c) > LONGEST_KEPT or len(known) >= KEPT_WORKED + len(extra):
                extra.append(c)
            known[c] = (*self._window(*ids), len(ids[0]) // 4, len(ids[1]) // 4) if ids else UNSPELT
        for text, chunks in zip(texts, split, strict=True):
            found = tuple(zip(*map(known.__getitem__, chunks), strict=True)) or None
            if found and 0 in found[3]:
                ids = self._whole(text)
                found = ids and (*zip(*self.align(*ids), strict=True), (len(ids[0]),), (len(ids[1]),))
            yield found
        for c in extra:
            del known[c]

    def _whole(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """A text with a chunk that is not spelt may still be spelt as a whole."""
        x, y, body = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text), (" " + text).encode()
        if b"".join(map(self.first.tokens.__getitem__, x)) == body == b"".join(map(self.second.tokens.__getitem__, y)):
            return np.array(x, "<i4"), np.array(y, "<i4")
        return None

    def align(self, x: np.ndarray, y: np.ndarray) -> list[tuple]:
        """(groups as text, number of groups, link codes) of each window of two id sequences that spell the same."""
        ends_a, ends_b = np.cumsum(self.first.sizes[x]), np.cumsum(self.second.sizes[y])
        if ends_a[-1] != ends_b[-1]:
            raise ValueError("the two sequences do not cover the same bytes")
        # shared ends, but for the last, before a token of each that starts with a space
        at_b = np.searchsorted(ends_b, ends_a[:-1])
        anchor = np.flatnonzero((ends_b[at_b] == ends_a[:-1]) & self.first.spaced[x[1:]])
        next_b = at_b[anchor] + 1
        spaced = self.second.spaced[y[next_b]]
        cuts_a, cuts_b = (4 * (anchor[spaced] + 1)).tolist(), (4 * next_b[spaced]).tolist()
        body_a, body_b = x.tobytes(), y.tobytes()
        out, windows, i, j = [], self.windows, 0, 0
        for p, q in zip([*cuts_a, len(body_a)], [*cuts_b, len(body_b)], strict=True):
            key = body_a[i:p], body_b[j:q]
            found = windows.get(key)
            if found is None:
                found = self._window(*key)
                if len(windows) < KEPT_WINDOWS and len(key[0]) + len(key[1]) <= 8 * LONGEST_KEPT:
                    windows[key] = found
            out.append(found)
            i, j = p, q
        return out

    def _window(self, a: bytes, b: bytes) -> tuple[str, int, bytes]:
        """Walk both sequences by their ends; the tokens at hand always overlap."""
        x, y = array("i", a).tolist(), array("i", b).tolist()
        size_a, size_b, step = self.first.lengths, self.second.lengths, len(self.second.tokens)
        codes, groups, i, j, group_i, group_j = [], [], 0, 0, 0, 0
        end_a, end_b = size_a[x[0]], size_b[y[0]]
        while True:
            codes.append(x[i] * step + y[j])
            if end_a < end_b:
                i += 1
                end_a += size_a[x[i]]
            elif end_b < end_a:
                j += 1
                end_b += size_b[y[j]]
            else:
                i, j = i + 1, j + 1
                groups.append(",".join(map(str, x[group_i:i])) + "|" + ",".join(map(str, y[group_j:j])))
                if i == len(x):
                    return ";".join(groups), len(groups), array("q", codes).tobytes()
                group_i, group_j = i, j
                end_a += size_a[x[i]]
                end_b += size_b[y[j]]


ALIGNED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary, times binary"


def align(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its numbers, its groups' digest, its different linked pairs (int64 codes A id * size of B + B id)
    and how often each is linked (uint32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Pair(a_path, b_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows = []
                for found in both.aligned(part.column(1).to_pylist()):
                    if found is None:
                        rows.append((0, 0, 0, 0, "", b"", b""))
                        continue
                    texts, groups, links, n_a, n_b = found
                    codes = np.frombuffer(b"".join(links), "<i8")
                    pairs, times = np.unique(codes, return_counts=True)
                    shown = hashlib.sha256(";".join(texts).encode()).hexdigest()
                    rows.append((sum(n_a), sum(n_b), sum(groups), len(codes), shown, pairs.tobytes(), times.astype("<u4").tobytes()))
                columns = list(zip(*rows, strict=True))
                types = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [f.split()[0] for f in ALIGNED.split(", ")]
                )

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, ALIGNED)


def groups(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the groups of every document: (ids of A, ids of B) in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Pair(a_path, b_path)
        kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                out = []
                for ids in both.encode(part.column(1).to_pylist()):
                    shown = ";".join(w[0] for w in both.align(*ids)).split(";") if ids else []
                    out.append([dict(zip("ab", ([int(i) for i in side.split(",")] for side in g.split("|")), strict=True)) for g in shown])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, kind)], ["doc_id", "groups"])

    chosen = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, "doc_id bigint, groups array<struct<a: array<int>, b: array<int>>>")


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """pair, a (the A id), docs (documents that hold the pair linked) and best (whether no pair of that A id has more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            codes, counts = np.concatenate([c for c, _ in held]), np.concatenate([n for _, n in held])
            pairs, place = np.unique(codes, return_inverse=True)
            return pairs, np.bincount(place, weights=counts, minlength=len(pairs)).astype(np.int64)

        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i8")
            if len(codes):
                held.append((codes, np.ones(len(codes), np.int64)))
                size += len(codes)
            if size > 2_000_000:
                held = [summed()]
                size = len(held[0][0])
                if size > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1])], ["pair", "docs"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in summed()], ["pair", "docs"])

    counted = aligned.select("pairs").mapInArrow(run, "pair bigint, docs bigint").groupBy("pair").agg(F.sum("docs").alias("docs"))
    counted = counted.withColumn("a", F.floor(F.col("pair") / b_size).cast("int"))
    most = counted.groupBy("a").agg(F.max("docs").alias("most"))
    return counted.join(most, "a").select("pair", "a", "docs", (F.col("docs") == F.col("most")).alias("best"))


def score(aligned: DataFrame, counts: DataFrame, looked_up: int = LOOKED_UP) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if counts.count() > looked_up:
        return _score_by_join(aligned, counts).select(*names)
    table = counts.orderBy("pair").toArrow()
    pairs, docs, best = (table.column(c).to_numpy() for c in ("pair", "docs", "best"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_best, total = [], []
            for codes, times in zip(batch.column("pairs").to_pylist(), batch.column("times").to_pylist(), strict=True):
                place = np.searchsorted(pairs, np.frombuffer(codes, "<i8"))
                times = np.frombuffer(times, "<u4").astype(np.int64)
                n_best.append(int(times[best[place]].sum()))
                total.append(int((times * docs[place]).sum()))
            own = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(total, pa.int64())}
            yield pa.RecordBatch.from_arrays([own[c] if c in own else batch.column(c) for c in names], names)

    kinds = {"doc_id": "bigint", "groups_sha256": "string"}
    return aligned.mapInArrow(run, ", ".join(f"{c} {kinds.get(c, 'bigint')}" for c in names))


def _score_by_join(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """The same through a shuffle on the pair: links of a task's documents leave it once per pair and document."""
    keyed = materialize(aligned.withColumn("row", F.monotonically_increasing_id()), "aligned")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                codes, times = (part.column(c).to_pylist() for c in ("pairs", "times"))
                sizes = np.array([len(c) // 8 for c in codes])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(part.column("row").to_numpy(), sizes)), pa.array(np.frombuffer(b"".join(codes), "<i8")),
                     pa.array(np.frombuffer(b"".join(times), "<u4").astype(np.int64))],
                    ["row", "pair", "times"],
                )

    links = keyed.select("row", "pairs", "times").mapInArrow(run, "row bigint, pair bigint, times bigint")
    met = links.join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum")
    )
    found = keyed.join(met, "row", "left")
    return found.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("n_best", "count_sum")})


def aligned_counts(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", looked_up: int = LOOKED_UP) -> DataFrame:
    """Alignment of every document, with its links weighed by all documents."""
    import sentencepiece

    b_size = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    aligned = materialize(align(docs, a_path, b_path, doc_id, text), "aligned")
    return score(aligned, materialize(pair_counts(aligned, b_size), "pair_counts"), looked_up)
