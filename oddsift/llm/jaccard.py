"""Groups of documents that word-shingle similarity links, by adaptive multi-match prefixes.

A document's set holds its distinct shingles of ``width`` lower-cased words. Sets of equal content are one class.
Classes order their shingles by a corpus-wide frequency sketch, rare first. Two sets of sizes m and n that reach the
similarity share at least ``l`` shingles among the first ``m - need(m) + l`` and ``n - need(n) + l``, whatever l is up
to the overlap they need. Each class picks its own ``l`` by estimated cost: longer prefixes read more postings but ask
for more matches before a pair is verified. A pair becomes a candidate when it shares as many prefix shingles as the
smaller of its two choices.

Pairs come from posting lists of the first ``m - need(m) + 1`` shingles. Only classes that are not yet connected need
comparing. So the first round takes, for each list, each class with the list's first class and with its neighbour: a
group of near copies costs its size, not its square. The second round takes all pairs of a list from different groups
of the first whose places in the list leave room for the overlap that their sizes ask for. Either round's pairs are
candidates if they share enough prefix shingles, and linked if their whole sets say so; nothing is capped, so no link
is missed.

Similarity is exact integer arithmetic on 64-bit shingle hashes. Classes are named by 64 bits of a set's digest: n
sets fall together by chance with probability n * n / 2 ** 65.

Defined cases: null, empty and wordless texts have no shingles and are linked with nothing. A row with a null id is
linked with nothing and its component is null. Rows that share an id are judged each by its own text. Repeated rows
give one result row each. An empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddsift.llm.base import Texts, Tokens, mix, text_slices, windows, worker_store
from oddsift.session import materialize

SKETCH_BITS = 20
BLOCK = 1 << 12
#: texts are worked in runs of this size: hashes and places take some hundred bytes for each byte of a run
SLICE_BYTES = 1 << 20
#: frequencies are kept as eighths of a power of two
STEPS = 8
MOST_EXTRA = 8


def shingle_sets(t: Texts, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Tokens(t, lower=True)
    hashes = words.hashes()
    value, at = windows(hashes, words.first, width)
    cuts = np.searchsorted(at, words.first)
    out = []
    for i in range(t.n):
        own = value[cuts[i] : cuts[i + 1]]
        if not len(own):
            short = hashes[words.first[i] : words.first[i + 1]]
            if len(short):
                own = np.array([len(short)], dtype=np.uint64)
                for h in short:
                    own = mix(own ^ h)
        out.append(np.unique(own))
    return out


def class_of(values: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)


def need(n: int, num: int, den: int) -> int:
    """Least overlap of a set of n with any set that reaches the similarity."""
    return -(-num * n // den)


# ---------------------------------------------------------------- frequency sketch


def sketch(texts: DataFrame, width: int) -> np.ndarray:
    """Frequency level of each of 2 ** SKETCH_BITS hash buckets over all texts, one byte each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_store("jaccard")  # nothing is kept; what another operator left in this worker goes
        total = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for batch in batches:
            for t in text_slices(batch.column(0), SLICE_BYTES):
                values = np.concatenate(shingle_sets(t, width))
                total += np.bincount(values >> np.uint64(64 - SKETCH_BITS), minlength=len(total))
        blocks = total.reshape(-1, BLOCK).astype(np.int32)
        for i in np.flatnonzero(blocks.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([int(i)], pa.int32()), pa.array([blocks[i].tobytes()], pa.binary())], ["block", "counts"])

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = np.frombuffer(body, dtype=np.int32).astype(np.int64)
                sums[i] = sums[i] + counts if i in sums else counts
        for i, counts in sums.items():
            levels = np.minimum(np.ceil(STEPS * np.log2(1 + counts)), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([levels.tobytes()], pa.binary())], ["block", "levels"])

    blocks = texts.mapInArrow(count, "block int, counts binary").repartition("block").mapInArrow(level, "block int, levels binary")
    out = np.zeros((1 << SKETCH_BITS) // BLOCK * BLOCK, dtype=np.uint8).reshape(-1, BLOCK)
    for r in blocks.collect():
        out[r.block] = np.frombuffer(r.levels, dtype=np.uint8)
    return out.reshape(-1)


def excess(levels: np.ndarray) -> np.ndarray:
    """By level, how many documents more than a bucket's usual load share a shingle: the estimate of its postings."""
    counts = 2.0 ** (np.arange(256) / STEPS) - 1
    usual = float(np.median(counts[levels]))
    return np.maximum(counts - usual - 3 * np.sqrt(usual) - 1, 0)


def choose_prefix(values: np.ndarray, levels: np.ndarray, cost: np.ndarray, num: int, den: int) -> tuple[np.ndarray, int]:
    """The prefix in global order and the number of matches it asks for."""
    level = levels[values >> np.uint64(64 - SKETCH_BITS)]
    order = np.argsort(level, kind="stable")
    n, overlap = len(values), need(len(values), num, den)
    reads = np.cumsum(cost[level[order]])
    matches = np.arange(1, min(MOST_EXTRA, overlap) + 1)
    read = reads[n - overlap + matches - 1]
    total = read + read / matches * (20 + n / 4)
    best = int(matches[np.argmin(total)])
    return values[order[: n - overlap + best]], best


# ---------------------------------------------------------------- documents and postings


def prepare(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Per document its class and set size; the first of a class in each task also carries the prefix."""
    levels = sketch(docs.select("text"), width)
    cost = excess(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_store("jaccard")  # nothing is kept; what another operator left in this worker goes
        met: set[int] = set()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for t in text_slices(batch.column(1), SLICE_BYTES):
                rows = []
                for i, values in enumerate(shingle_sets(t, width)):
                    doc = ids[t.first_row + i]
                    name, prefix, asked = None, None, None
                    if len(values) and doc is not None:
                        name = class_of(values)
                        if name not in met:
                            met.add(name)
                            prefix, asked = choose_prefix(values, levels, cost, num, den)
                            prefix = prefix.view(np.int64)
                    rows.append((doc, len(values), name, asked, prefix))
                doc, n, name, asked, prefix = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(name, pa.int64()), pa.array(asked, pa.int32()),
                     pa.array(prefix, pa.list_(pa.int64()))],
                    ["doc_id", "n", "class", "asked", "prefix"],
                )

    return docs.mapInArrow(run, "doc_id bigint, n bigint, class bigint, asked int, prefix array<bigint>")


def shared_postings(prepared: DataFrame, num: int, den: int) -> DataFrame:
    """Postings of prefix shingles that two classes or more have, each with the list's first class and the one before.

    ``most`` is the largest set that a class can be linked with if this is the first shingle they share: what is left
    of its own set from there on bounds their overlap. ``short`` tells the shingles that a single match asks for from
    those that a longer prefix adds.
    """
    postings = prepared.where("prefix is not null").select("class", "n", "asked", F.posexplode("prefix").alias("place", "token"))
    # the head is the class with the fewest rarer shingles before this one: the plainest of a family of copies
    most = F.floor((F.col("n") - F.col("place")) * (num + den) / num) - F.col("n")
    postings = postings.withColumn("most", most)
    row = Window.partitionBy("token").orderBy("place", "class")
    upto = row.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    listed = postings.select(
        "token", "class", "n", "asked", (F.col("place") <= F.col("n") - F.ceil(F.col("n") * num / den)).alias("short"),
        "most", F.first("class").over(upto).alias("head"), F.first("n").over(upto).alias("head_n"), F.first("most").over(upto).alias("head_most"),
        F.lag("class").over(row).alias("before"), F.lag("n").over(row).alias("before_n"), F.lag("most").over(row).alias("before_most"),
        F.lead("class").over(row).alias("after"),
    )
    # a class that several tasks wrote stands there several times: the first is kept, and lists of one class go
    repeated = F.coalesce(F.col("before") == F.col("class"), F.lit(False))
    others = (F.col("head") != F.col("class")) | F.coalesce(F.col("after") != F.col("class"), F.lit(False))
    return listed.where(~repeated & (others | (F.col("after") == F.col("class")))).drop("after")


def class_lists(shared: DataFrame) -> DataFrame:
    """One row per class: how many matches it asks for, and its shared prefix shingles.

    Shingles that only one class has cannot match, so the shared postings of a class stand for its prefix.
    """
    return shared.groupBy("class").agg(F.first("asked").alias("asked"), F.collect_list("token").alias("tokens"))


def enough_matches(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """The pairs (a, b) that share as many prefix shingles as the smaller of their two choices."""
    first, second = lists.toDF("a", "p", "x"), lists.toDF("b", "q", "y")
    both = pairs.join(first, "a").join(second, "b")
    return both.where(F.size(F.array_intersect("x", "y")) >= F.least("p", "q")).select("a", "b")


def filter_bits(ids: DataFrame, count: int) -> np.ndarray:
    """A Bloom filter of the ids: 16 bits an id, up to 2 ** 27 bits (16 MB) whatever their number."""
    size = 1 << min(27, max(16, (16 * count).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, dtype=bool)
        for batch in batches:
            bits[bit_places(batch.column(0).to_numpy(zero_copy_only=False), size)] = True
        blocks = np.packbits(bits).reshape(-1, min(size // 8, 1 << 13))
        for i in np.flatnonzero(blocks.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([int(i)], pa.int32()), pa.array([blocks[i].tobytes()], pa.binary())], ["block", "bits"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(body, dtype=np.uint8)
                sums[i] = sums[i] | own if i in sums else own
        for i, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["block", "bits"])

    found = ids.mapInArrow(mark, "block int, bits binary").repartition("block").mapInArrow(unite, "block int, bits binary").collect()
    out = np.zeros(size // 8, dtype=np.uint8).reshape(-1, min(size // 8, 1 << 13))
    for r in found:
        out[r.block] = np.frombuffer(r.bits, dtype=np.uint8)
    return out.reshape(-1)


def bit_places(ids: np.ndarray, size: int) -> np.ndarray:
    """Two places for each id, one row each."""
    value = mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    mask = np.uint64(size - 1)
    return np.stack((value & mask, (value >> np.uint64(32)) & mask), axis=1).astype(np.int64)


def verify(pairs: DataFrame, docs: DataFrame, prepared: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes that reach the similarity, from the texts of one document each.

    A filter of those documents' ids keeps other texts out of the shuffle; what it lets through besides does no harm.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    holder = prepared.where("prefix is not null").groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    chosen = materialize(wanted.join(holder, "class").select("doc_id"), "holders")
    bits = filter_bits(chosen, chosen.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_store("jaccard")  # nothing is kept; what another operator left in this worker goes
        met: set[int] = set()
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(0)))
            place = bit_places(batch.column(0).to_numpy(zero_copy_only=False), len(bits) * 8)
            batch = batch.filter(pa.array((bits[place >> 3] >> (7 - (place & 7)) & 1).all(axis=1)))
            for t in text_slices(batch.column(1), SLICE_BYTES):
                keep = [(class_of(v), v.view(np.int64)) for v in shingle_sets(t, width) if len(v)]
                keep = [(c, v) for c, v in keep if c not in met and not met.add(c)]
                if keep:
                    name, values = zip(*keep, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(name, pa.int64()), pa.array(values, pa.list_(pa.int64()))], ["class", "hashes"])

    sets = docs.select("doc_id", "text").mapInArrow(run, "class bigint, hashes array<bigint>")
    sets = sets.join(wanted, "class", "left_semi").dropDuplicates(["class"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, dtype=bool)
            left, right = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                x, y = left[i].values.to_numpy().view(np.uint64), right[i].values.to_numpy().view(np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                out[i] = den * both >= num * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(out))

    first = sets.select(F.col("class").alias("a"), F.col("hashes").alias("x"))
    second = sets.select(F.col("class").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(compare, "a bigint, b bigint")


# ---------------------------------------------------------------- components


def components(links: DataFrame) -> DataFrame:
    """node and label of every linked class, label being the least class of its component.

    Alternating stars: every node's larger neighbours, then its smaller ones, move to the least node it knows. The
    edges of each round are written, so no plan grows and lost executors cost one round.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        size = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % (1 << 40)).alias("h")).first()
        if (size.n, size.h) == before:
            return edges.select(F.col("u").alias("class"), F.col("v").alias("label"))
        before = size.n, size.h
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        moved = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(moved.union(small.select("u", F.col("m").alias("v"))).distinct(), "links")


def group(
    docs: DataFrame, width: int = 4, num: int = 85, den: int = 100, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_shingles and component_id (least id that links reach, its own included) of every row."""
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    prepared = materialize(prepare(docs, width, num, den), "prefixes")
    shared = materialize(shared_postings(prepared, num, den), "postings")
    lists = materialize(class_lists(shared), "lists")

    def linked(pairs: DataFrame) -> DataFrame:
        candidates = materialize(enough_matches(materialize(pairs, "pairs"), lists), "candidates")
        return materialize(verify(candidates, docs, prepared, width, num, den), "links")

    others = F.explode(F.array(*[F.struct(F.col(c).alias("c"), F.col(f"{c}_n").alias("m"), F.col(f"{c}_most").alias("reach")) for c in ("head", "before")]))
    stars = shared.where("short").select("class", "n", "most", others.alias("o")).select("class", "n", "most", "o.*")
    near = F.least("n", "m") * den >= F.greatest("n", "m") * num
    # as in the second round, places bound the pair; one that falls out here is met again there unless it is connected
    stars = stars.where((F.col("c") != F.col("class")) & near & (F.col("m") <= F.col("most")) & (F.col("n") <= F.col("reach")))
    labels = components(linked(stars.select(F.greatest("class", "c").alias("a"), F.least("class", "c").alias("b")).distinct()))

    # second round: pairs of a list from different groups of the first, the larger set or the greater name first
    labelled = shared.where("short").join(labels, "class", "left").select("token", "class", "n", "most", F.coalesce("label", "class").alias("label"))
    mixed = labelled.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("token")
    labelled = materialize(labelled.join(mixed, "token"), "mixed")
    groups = labelled.groupBy("token", F.col("label").alias("r"), F.col("n").alias("m")).agg(F.max("most").alias("reach"))
    fits = (F.col("m") <= F.col("n")) & near & (F.col("m") <= F.col("most")) & (F.col("n") <= F.col("reach")) & (F.col("label") != F.col("r"))
    one = labelled.join(groups, "token").where(fits).select("token", "r", "m", F.col("class").alias("a"), F.col("n").alias("k"))
    two = labelled.select("token", F.col("label").alias("r"), F.col("n").alias("m"), F.col("class").alias("b"), "most")
    met = one.join(two, ["token", "r", "m"]).where((F.col("k") <= F.col("most")) & ((F.col("m") < F.col("k")) | (F.col("b") < F.col("a"))))
    more = linked(met.select("a", "b").distinct())
    labels = components(labels.select(F.col("class").alias("a"), F.col("label").alias("b")).union(more))

    classes = prepared.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
    classes = classes.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
    found = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    by_class = materialize(classes.join(found, "label").select("class", "component_id"), "components")
    rows = prepared.select("doc_id", F.col("n").alias("n_shingles"), "class").join(by_class, "class", "left")
    return rows.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
