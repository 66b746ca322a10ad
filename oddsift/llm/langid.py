"""Language identification by unigram pieces, summed over all segmentations.

Pieces come from a fixed public vocabulary. For each language every piece has a probability; a word's probability is
the sum, over all ways to cut it into pieces, of the product of their probabilities (a forward pass over its
characters). Expectation-maximisation on labelled words fits the pieces. A text's log-likelihood is the sum over its
words (runs of letters, lower-cased); the highest language wins, ties go to the first in code-point order.

Runs of letters longer than ``MAX_RUN`` are scored in stretches, with the forward sums carried from each to the next, so
every segmentation counts; for the fit they are cut at that length. A letter that is no piece counts as one, with a
probability that all such letters of a language share.

Defined cases: a null text, or one without a letter, is ``und`` with score 0. With nothing to learn from, every text
is ``und``. Rows with a null language or id are not learned from. Repeated rows each get a result row. Very long texts
are scored whole. An empty table gives an empty result. Columns besides the named ones are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsift.llm.base import worker_store

UNKNOWN = "und"
MAX_RUN = 48
WORD_START = "▁"
CACHED_WORDS = 300_000
ROWS = 500
STRETCH = 4096
LETTERS = re.compile(r"[^\W\d_]+")

#: typical probability of one character; scaling by it keeps products near 1
CHARACTER = 1 / 16


def vocabulary(path: str) -> list[str]:
    """The letter pieces of a SentencePiece model, lower case, with or without the word-start mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = set()
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        body = piece.removeprefix(WORD_START)
        if body.isalpha() and body == body.lower():
            pieces.add(piece)
    return sorted(pieces)


class Pieces:
    """The vocabulary, looked up by hash: a bit table first, then the sorted hashes."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        codes, lengths = letters(pieces)
        start = np.cumsum(lengths) - lengths
        value = np.zeros(self.size, dtype=np.uint64)
        for k in range(self.longest):
            more = lengths > k
            value[more] = extend(value[more], codes[start[more] + k])
        self.order = np.argsort(value)
        self.sorted = value[self.order]
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[value >> np.uint64(44)] = True

    def find(self, value: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1."""
        out = np.full(len(value), -1, dtype=np.int64)
        likely = np.flatnonzero(self.seen[value >> np.uint64(44)])
        if len(likely):
            at = np.minimum(np.searchsorted(self.sorted, value[likely]), self.size - 1)
            out[likely] = np.where(self.sorted[at] == value[likely], self.order[at], -1)
        return out


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all words on end, and the length of each word."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return codes, np.fromiter(map(len, words), np.int64, len(words))


def extend(value: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hashes of strings, each longer by one character."""
    value = (value ^ codes) * np.uint64(0x9E3779B97F4A7C15)
    return value ^ (value >> np.uint64(29))


@dataclass
class Model:
    langs: list[str] = field(default_factory=list)
    pieces: list[str] = field(default_factory=list)
    #: one row per piece and one for a letter that is no piece, a column per language
    probability: np.ndarray = field(default_factory=lambda: np.zeros((1, 0)))


class Lattice:
    """All pieces that fit into the given words: word, start, end and piece of each, sorted by end."""

    def __init__(self, words: list[str], pieces: Pieces, mark: str = WORD_START):
        codes, self.lengths = letters([mark + w for w in words])
        word = np.repeat(np.arange(len(words)), self.lengths)
        start = np.arange(len(codes)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        left = self.lengths[word] - start
        at, value, found = np.arange(len(codes)), np.zeros(len(codes), dtype=np.uint64), []
        for size in range(1, pieces.longest + 1):
            enough = left[at] >= size
            at, value = at[enough], value[enough]
            if not len(at):
                break
            value = extend(value, codes[at + size - 1])
            piece = pieces.find(value)
            if size == 1:
                piece[piece < 0] = pieces.size
            hit = piece >= 0
            found.append((word[at[hit]], start[at[hit]], start[at[hit]] + size, piece[hit]))
        self.word, self.start, self.end, self.piece = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(self.end, kind="stable")
        self.word, self.start, self.end, self.piece = (x[order] for x in (self.word, self.start, self.end, self.piece))
        self.cuts = np.searchsorted(self.end, np.arange(self.lengths.max(initial=0) + 2))

    def scaled(self, probability: np.ndarray) -> np.ndarray:
        return probability[self.piece] * (1 / CHARACTER) ** (self.end - self.start)[:, None]

    def forward(self, weight: np.ndarray) -> np.ndarray:
        """Scaled prefix sums: word, position, language."""
        n, width = len(self.lengths), int(self.lengths.max(initial=0)) + 1
        alpha = np.zeros((n, width, weight.shape[1]))
        alpha[:, 0] = 1
        for j in range(1, width):
            at = slice(self.cuts[j], self.cuts[j + 1])
            add = alpha[self.word[at], self.start[at]] * weight[at]
            for lang in range(weight.shape[1]):
                alpha[:, j, lang] = np.bincount(self.word[at], add[:, lang], n)
        return alpha

    def backward(self, weight: np.ndarray) -> np.ndarray:
        n, width = len(self.lengths), int(self.lengths.max(initial=0)) + 1
        beta = np.zeros((n, width, weight.shape[1]))
        beta[np.arange(n), self.lengths] = 1
        for j in range(width - 1, 0, -1):
            at = slice(self.cuts[j], self.cuts[j + 1])
            np.add.at(beta, (self.word[at], self.start[at]), beta[self.word[at], j] * weight[at])
        return beta

    def log_likelihood(self, probability: np.ndarray) -> np.ndarray:
        alpha = self.forward(self.scaled(probability))
        end = alpha[np.arange(len(self.lengths)), self.lengths]
        return np.log(np.maximum(end, 1e-300)) + self.lengths[:, None] * np.log(CHARACTER)


def long_likelihood(word: str, pieces: Pieces, probability: np.ndarray) -> np.ndarray:
    """Log-likelihood of one long run under every language.

    Stretch after stretch is laid out with the letters before it that a piece may still reach back to.
    """
    body, reach = WORD_START + word, pieces.longest
    past, logs = np.ones((1, probability.shape[1])), np.zeros(probability.shape[1])
    for at in range(0, len(body), STRETCH):
        base = at + 1 - len(past)
        lattice = Lattice([body[base : at + STRETCH]], pieces, "")
        weight = lattice.scaled(probability)
        alpha = np.zeros((int(lattice.lengths[0]) + 1, len(logs)))
        alpha[: len(past)] = past
        for j in range(len(past), len(alpha)):
            some = slice(lattice.cuts[j], lattice.cuts[j + 1])
            alpha[j] = (alpha[lattice.start[some]] * weight[some]).sum(axis=0)
            if j % 16 == 0:
                scale = np.maximum(alpha[j], 1e-300)
                logs += np.log(scale)
                alpha[max(0, j - reach) : j + 1] /= scale
        past = alpha[-reach:]
    return logs + np.log(np.maximum(past[-1], 1e-300)) + len(body) * np.log(CHARACTER)


def fit_pieces(words: list[str], counts: np.ndarray, pieces: Pieces, rounds: int, floor: float) -> np.ndarray:
    """Piece probabilities of one language by expectation-maximisation over all segmentations."""
    size = pieces.size + 1
    probability = np.full((size, 1), 1 / size)
    blocks = [(Lattice(words[i : i + 4096], pieces), counts[i : i + 4096]) for i in range(0, len(words), 4096)]
    for _ in range(rounds):
        expected = np.zeros(size)
        for lattice, times in blocks:
            weight = lattice.scaled(probability)
            alpha, beta = lattice.forward(weight), lattice.backward(weight)
            total = np.maximum(beta[:, 0, 0], 1e-300)
            use = alpha[lattice.word, lattice.start, 0] * weight[:, 0] * beta[lattice.word, lattice.end, 0]
            expected += np.bincount(lattice.piece, use / total[lattice.word] * times[lattice.word], size)
        probability = ((expected + floor) / (expected + floor).sum())[:, None]
    return probability[:, 0]


def word_runs(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def stretches(runs: list[str]) -> list[str]:
    """The runs, cut to a length that the fit can lay out together."""
    if max(map(len, runs), default=0) <= MAX_RUN:
        return runs
    return [w[i : i + MAX_RUN] for w in runs for i in range(0, len(w), MAX_RUN)]


def train(
    docs: DataFrame, usable: Column, vocabulary_path: str, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
    sample_per_lang: int = 300, rounds: int = 4, floor: float = 0.05,
) -> Model:
    """Fit on about ``sample_per_lang`` documents of each language, drawn by a hash of the id among ``usable`` rows.

    The sample bounds the fit; a language with fewer documents gives all it has. Word counts of the sample are formed
    per task and fitted per language; the driver gets one probability per piece and language.
    """
    pieces = vocabulary(vocabulary_path)
    rows = docs.where(usable & F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & F.col(text).isNotNull())
    sizes = rows.groupBy(F.col(lang).alias("lang")).count().collect()
    if not sizes:
        return Model()
    share = F.element_at(F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, min(1.0, sample_per_lang / r["count"]))]), F.col(lang))
    drawn = rows.where(F.pmod(F.xxhash64(F.col(doc_id).cast("string")), F.lit(1 << 30)) < share * (1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, Counter] = {}
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tables.setdefault(name, Counter()).update(stretches(word_runs(body)))
        for name, c in tables.items():
            columns = [pa.array([name] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "word", "n"])

    counted = drawn.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(count, "lang string, word string, n bigint")
    counted = counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("word")
        p = fit_pieces(frame["word"].tolist(), frame["n"].to_numpy(float), Pieces(pieces), rounds, floor)
        return pd.DataFrame({"lang": [frame["lang"].iloc[0]], "p": [p.tolist()]})

    fitted = counted.groupBy("lang").applyInPandas(fit, "lang string, p array<double>").collect()
    fitted.sort(key=lambda r: r.lang)
    return Model([r.lang for r in fitted], pieces, np.array([r.p for r in fitted]).T.reshape(len(pieces) + 1, -1))


class Scorer:
    """Log-likelihoods of words under every language, remembered for the worker's life up to a bound."""

    def __init__(self, model: Model, key: str):
        self.model, self.pieces = model, Pieces(model.pieces)
        store = worker_store("langid")
        if store.get("key") != key:
            store.clear()
            store.update(key=key, place={}, values=np.zeros((0, len(model.langs))))
        self.store = store

    def values(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A table of log-likelihoods, and the row of each word in it."""
        place, values = self.store["place"], self.store["values"]
        missing = [w for w in dict.fromkeys(words) if w not in place]
        if missing:
            if len(place) + len(missing) > CACHED_WORDS:
                place.clear()
                missing = list(dict.fromkeys(words))
                values = values[:0]
            missing.sort(key=len)
            base = len(place)
            place.update((w, base + i) for i, w in enumerate(missing))
            if len(values) < len(place):
                # memory that is not touched yet costs nothing, so there is no growing by copies
                grown = np.empty((max(CACHED_WORDS, len(place)), len(self.model.langs)))
                grown[:base] = values[:base]
                self.store["values"] = values = grown
            short = sum(len(w) <= MAX_RUN for w in missing)
            for i in range(0, short, 4096):
                some = missing[i : min(i + 4096, short)]
                values[base + i : base + i + len(some)] = Lattice(some, self.pieces).log_likelihood(self.model.probability)
            for i in range(short, len(missing)):
                values[base + i] = long_likelihood(missing[i], self.pieces, self.model.probability)
        return values, np.fromiter(map(place.__getitem__, words), np.int64, len(words))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.model.langs:
            return names, scores
        step, size = [], 0
        for i, x in enumerate(texts):
            runs = word_runs(x) if x else []
            step.append((i, runs))
            size += len(runs)
            if size > 100_000 or i == len(texts) - 1:
                self._score(step, names, scores)
                step, size = [], 0
        return names, scores

    def _score(self, step: list[tuple[int, list[str]]], names: list[str], scores: np.ndarray) -> None:
        step = [(i, runs) for i, runs in step if runs]
        if not step:
            return
        values, at = self.values([w for _, runs in step for w in runs])
        counts = np.array([len(runs) for _, runs in step])
        total = np.add.reduceat(values[at], np.concatenate(([0], np.cumsum(counts)[:-1])))
        best = total.argmax(axis=1)
        # words of one text are not independent: their evidence counts by the root of their number
        gap = (total - total.max(axis=1, keepdims=True)) / np.sqrt(counts)[:, None]
        share = 1 / np.exp(gap).sum(axis=1)
        for (i, _), b, s in zip(step, best, share, strict=True):
            names[i], scores[i] = self.model.langs[b], s


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    key = model_key(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model, key)
        for batch in sliced(batches):
            names, scores = scorer.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def keep(docs: DataFrame, model: Model, min_score: float = 0.5, text: str = "text") -> DataFrame:
    """The documents with a recognised language and at least ``min_score``, with all their columns."""
    key, place = model_key(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model, key)
        for batch in sliced(batches):
            names, scores = scorer.predict(batch.column(place).to_pylist())
            yield batch.filter(pa.array([n != UNKNOWN and s >= min_score for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def model_key(model: Model) -> str:
    """Tells models apart in a worker that serves several."""
    return f"{model.langs}{hash(model.probability.tobytes())}"
