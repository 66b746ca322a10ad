"""Quality rules: counts per document, and the distance of its histograms from language references.

A reference holds, for one value of ``lang``, the shares of character classes and of common words over all its
documents. A document is compared with the references by Jensen-Shannon distance (base 2, so 0 to 1): with the
character classes of the nearest language, and with the common words of the nearest language. It fails when either
distance exceeds its limit plus ``slack / sqrt(observations)``, the part that chance alone adds to a short text's
distance. Every language with a word has a reference: its counts and ``prior_words`` words in the shares of all languages
together, so a reference moves from the pooled shares to its own as its documents grow, without a step. Texts below
``min_words`` words are not compared; so are all texts when no language has a word.

Defined cases: a null or empty text has no words, so all counts are 0 and ``base_failed`` is true. A null ``lang``
feeds no reference. Repeated rows are separate documents and give one result row each. An empty table gives an empty
result. Only the id, text and language columns are read; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddsift.llm.base import LOWER, SPACE_BYTES, Texts, Tokens, byte_table, text_slices, windows, worker_store

# Character classes by byte. A byte that continues a character counts for none.
CLASSES = ["space", "line", "lower", "upper", "digit", "stop", "bracket", "symbol", "other", "wide"]
CLASS_OF = byte_table(
    {
        b" \t\x0b\x0c\r": 0, b"\n": 1, b"abcdefghijklmnopqrstuvwxyz": 2, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ": 3,
        b"0123456789": 4, b".,;:!?'\"-": 5, b"()[]{}": 6, b"#*$%&|<>": 7, bytes(range(128, 192)): 255,
        bytes(range(192, 256)): 9,
    },
    8,
)
#: texts are worked in runs of this size: histograms are kept per text and common word, hashes per byte
SLICE_BYTES = 1 << 19
SYMBOL = byte_table({b"#*$%&|<>": 1}).astype(bool)
CHARACTER = CLASS_OF != 255


@dataclass(frozen=True)
class Limits:
    min_words: int = 50
    prior_words: float = 50
    common_share: float = 0.002
    class_distance: float = 0.22
    word_distance: float = 0.36
    class_slack: float = 1.0
    word_slack: float = 0.8


@dataclass(frozen=True)
class References:
    """Shares by language (rows): of character classes, and of the common words in ``words`` plus all other words."""

    langs: list[str] = field(default_factory=list)
    classes: np.ndarray = field(default_factory=lambda: np.zeros((0, len(CLASSES))))
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    word_shares: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))


def class_counts(t: Texts) -> np.ndarray:
    owner = np.repeat(np.arange(t.n), np.diff(t.bounds))
    code = CLASS_OF[t.data]
    seen = code != 255
    flat = np.bincount(owner[seen] * len(CLASSES) + code[seen], minlength=t.n * len(CLASSES))
    return flat.reshape(t.n, len(CLASSES))


def word_counts(hashes: np.ndarray, owners: np.ndarray, n: int, known: np.ndarray) -> np.ndarray:
    """Counts of the known words (sorted hashes) per text; the last column counts all others."""
    at = np.searchsorted(known, hashes)
    if len(known):
        at = np.where(known[np.minimum(at, len(known) - 1)] == hashes, at, len(known))
    width = len(known) + 1
    return np.bincount(owners * width + at, minlength=n * width).reshape(n, width)


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    strip = SPACE_BYTES.decode()
    seen, count = set(), 0
    for line in text.split("\n"):
        if line.strip(strip):
            if line in seen:
                count += 1
            else:
                seen.add(line)
    return count


def base_counts(t: Texts, words: Tokens, texts: list[str]) -> dict[str, np.ndarray]:
    """The counts that need no reference."""
    inside = words.kind != 0
    run, at = windows(words.hashes(), words.first, 5)
    owners = words.owners()
    covered = np.zeros(len(words.start) + 1, dtype=np.int64)
    if len(run):
        key = run ^ (owners[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        same = ordered[1:] == ordered[:-1]
        twice = np.zeros(len(key), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(covered, at[twice], 1)
        np.subtract.at(covered, at[twice] + 5, 1)
    in_repeat = np.cumsum(covered[:-1]) > 0
    total = np.concatenate(([0], np.cumsum(in_repeat)))
    return {
        "n_words": np.diff(words.first),
        "word_chars": t.per_text(inside & CHARACTER[t.data]),
        "n_symbols": t.per_text(SYMBOL[t.data]),
        "n_dup_lines": np.array([repeated_lines(x) for x in texts], dtype=np.int64),
        "n_repeat_words": total[words.first[1:]] - total[words.first[:-1]],
    }


def distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row's shares from one reference; a row without counts is at distance 0."""
    total = counts.sum(axis=1, keepdims=True)
    p = counts / np.maximum(total, 1)
    m = (p + reference) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(reference > 0, reference * np.log2(reference / m), 0).sum(axis=1)
    return np.where(total[:, 0] > 0, np.sqrt(np.clip((left + right) / 2, 0, 1)), 0)


def nearest(counts: np.ndarray, references: np.ndarray) -> np.ndarray:
    out = np.full(len(counts), np.inf)
    for r in references:
        np.minimum(out, distance(counts, r), out=out)
    return np.where(np.isfinite(out), out, 0)


def judge(column: pa.Array, refs: References, limits: Limits) -> dict[str, np.ndarray]:
    """All counts, distances and verdicts for a column of texts."""
    parts = []
    for t in text_slices(column, SLICE_BYTES):
        texts = [x or "" for x in column.slice(t.first_row, t.n).to_pylist()]
        words = Tokens(t)
        out = base_counts(t, words, texts)
        lowered = Tokens(t, lower=True)
        counts = word_counts(lowered.hashes(), lowered.owners(), t.n, refs.words)
        classes = class_counts(t)
        out["class_distance"] = nearest(classes, refs.classes)
        out["word_distance"] = nearest(counts, refs.word_shares)
        n = out["n_words"]
        out["base_failed"] = (n < 10) | (100 * out["n_repeat_words"] > 20 * n)
        far = out["class_distance"] > limits.class_distance + limits.class_slack / np.sqrt(np.maximum(classes.sum(axis=1), 1))
        far |= out["word_distance"] > limits.word_distance + limits.word_slack / np.sqrt(np.maximum(n, 1))
        out["kept"] = ~out["base_failed"] & ~(far & (n >= limits.min_words))
        parts.append(out)
    if not parts:
        return {}
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


# ---------------------------------------------------------------- references


def references(docs: DataFrame, limits: Limits = Limits(), text: str = "text", lang: str = "lang") -> References:
    """Fit the references on all documents in two passes.

    The first pass keeps Misra-Gries counters per task and language. Summed over the tasks they fall short of the true
    counts by at most a quarter of ``common_share``, so the words at three quarters of it or more include every common
    word and are fewer than ``4 / (3 * common_share)`` per language. The second pass counts those words over all
    documents. Only these bounded tables reach the driver.
    """
    rows = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    share, n_classes = limits.common_share, len(CLASSES)

    def group(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[str], Texts]]:
        names = batch.column(0).to_pylist()
        for t in text_slices(batch.column(1), SLICE_BYTES):
            own, inverse = np.unique(np.array(names[t.first_row : t.first_row + t.n], dtype=object), return_inverse=True)
            yield inverse, list(own), t

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_store("rules")  # nothing is kept; what another operator left in this worker goes
        room, kept, totals = int(np.ceil(4 / share)), {}, {}
        for batch in batches:
            for inverse, own, t in group(batch):
                words = Tokens(t, lower=True)
                hashes, owner = words.hashes(), inverse[words.owners()]
                for k, name in enumerate(own):
                    found, counts = np.unique(hashes[owner == k], return_counts=True)
                    totals[name] = totals.get(name, 0) + int(counts.sum())
                    old_words, old_counts = kept.get(name, (found[:0], counts[:0]))
                    both, where = np.unique(np.concatenate((old_words, found)), return_inverse=True)
                    summed = np.bincount(where, np.concatenate((old_counts, counts)), len(both)).astype(np.int64)
                    if len(summed) > room:
                        summed = summed - np.partition(summed, -room - 1)[-room - 1]
                    kept[name] = both[summed > 0], summed[summed > 0]
        for name, (words, counts) in kept.items():
            word = pa.array([*words.view(np.int64).tolist(), None], pa.int64())
            n = pa.array([*counts.tolist(), totals[name]], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(word)), word, n], ["lang", "word", "n"])

    seen = rows.mapInArrow(frequent, "lang string, word bigint, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    totals = F.max(F.when(F.col("word").isNull(), F.col("n"))).over(Window.partitionBy("lang"))
    candidates = seen.withColumn("total", totals).where((F.col("n") >= 0.75 * share * F.col("total")) & F.col("word").isNotNull())
    known = np.unique(np.array([r.word for r in candidates.select("word").distinct().collect()], dtype=np.int64).view(np.uint64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_store("rules")  # nothing is kept; what another operator left in this worker goes
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for inverse, own, t in group(batch):
                words = Tokens(t, lower=True)
                per_lang = word_counts(words.hashes(), inverse[words.owners()], len(own), known)
                classes = np.zeros((len(own), n_classes), dtype=np.int64)
                np.add.at(classes, inverse, class_counts(t))
                for k, name in enumerate(own):
                    row = np.concatenate((classes[k], per_lang[k]))
                    sums[name] = sums[name] + row if name in sums else row
        for name, row in sums.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(row[at].astype(np.int64))], ["lang", "place", "n"]
            )

    counted = rows.mapInArrow(count, "lang string, place int, n bigint").groupBy("lang", "place").agg(F.sum("n").alias("n"))
    tables: dict[str, np.ndarray] = {}
    for r in counted.collect():
        tables.setdefault(r.lang, np.zeros(n_classes + len(known) + 1))[r.place] = r.n
    langs = sorted(k for k, v in tables.items() if v[n_classes:].sum() > 0)
    if not langs:
        return References()
    counts = np.array([tables[k] for k in langs])
    n_words = counts[:, n_classes:].sum(axis=1, keepdims=True)
    # common words are those of a language's own counts, before smoothing
    common = (counts[:, n_classes:-1] >= share * n_words).any(axis=0)
    # both histograms of the pooled table, in units of one word
    smooth = counts + limits.prior_words * counts.sum(axis=0) / n_words.sum()
    classes, words = smooth[:, :n_classes], smooth[:, n_classes:]
    words = words / words.sum(axis=1, keepdims=True)
    shares = np.column_stack((words[:, :-1][:, common], 1 - words[:, :-1][:, common].sum(axis=1)))
    return References(langs, classes / classes.sum(axis=1, keepdims=True), known[common], np.clip(shares, 0, 1))


def score(docs: DataFrame, refs: References, limits: Limits = Limits(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its counts, distances and verdicts."""
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_store("rules")
        for batch in batches:
            if batch.num_rows:
                out = judge(batch.column(1), refs, limits)
                cols = [pa.array(out[k].astype(np.int64)) for k in fields]
                cols += [pa.array(out["class_distance"]), pa.array(out["word_distance"])]
                cols += [pa.array(out["base_failed"]), pa.array(out["kept"])]
                names = ["doc_id", *fields, "class_distance", "word_distance", "base_failed", "kept"]
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names)

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id bigint, " + ", ".join(f"{k} bigint" for k in fields)
    return rows.mapInArrow(run, schema + ", class_distance double, word_distance double, base_failed boolean, kept boolean")


def keep(docs: DataFrame, refs: References, limits: Limits = Limits(), text: str = "text") -> DataFrame:
    """The documents whose verdict is to keep, with all their columns."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_store("rules")
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(judge(batch.column(place), refs, limits)["kept"]))

    return docs.mapInArrow(run, docs.schema)
