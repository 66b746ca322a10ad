"""A Merkle manifest of a table: one tree per group of rows, and one over their roots, with a proof for every row.

Positions come from a range-partitioned sort with running counts, so no group passes through one task. Trees are then
worked in blocks of ``2 ** BITS`` neighbouring nodes, each block a subtree of its own, in as many rounds as the height
asks for. Within a block the work is time-forward processing:

* Nodes bear labels (last leaf, level), under which children come before parents. Leaves stream in from Spark's
  external sort in that order; a priority queue holds the digests on their way to parents, and a node is settled once
  its label comes up. At most one message a level waits.
* A second sweep in reversed order takes the proof suffix of the block's root, which came down from the round above,
  and delivers to each child its sibling followed by its parent's suffix, down to the leaves.

A step of a proof is a side byte (lone, sibling on the left, sibling on the right) and the sibling's digest.

Defined cases: a null field is hashed as ``-``; a null group is the first tree. Rows of a group stand in the order of
their ids, null first, then of their digests; equal rows follow one another and each has its own place and proof. Very
long texts are hashed whole in the JVM. An empty table gives an empty result. Columns besides the named ones are not
looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from oddsift.llm.base import crc_of
from oddsift.session import materialize

BITS = 12
LONE, LEFT, RIGHT = 0, 1, 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and the value; null as a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


# ---------------------------------------------------------------- positions


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, the place within its tree from 0, and ``n``, the tree's number of rows."""
    columns = rows.columns
    last = "last_key"
    ranged = rows.withColumn(last, F.monotonically_increasing_id()).repartitionByRange(tree, *order, last).sortWithinPartitions(tree, *order, last)
    at = columns.index(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, current, count = TaskContext.get().partitionId(), (), 0
        for batch in batches:
            places = np.empty(batch.num_rows, np.int64)
            # dictionary codes tell runs of equal trees apart
            keys = batch.column(at).dictionary_encode(null_encoding="encode")
            code = keys.indices.to_numpy()
            starts = np.append(0, np.flatnonzero(code[1:] != code[:-1]) + 1) if len(code) else []
            for a, b in zip(starts, [*starts[1:], len(code)], strict=True):
                value = (keys.dictionary[int(code[a])].as_py(),)
                count = count if value == current else 0
                places[a:b] = np.arange(count, count + b - a)
                current, count = value, count + int(b - a)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(columns)], pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(places)], [*columns, "part", "place"]
            )

    schema = StructType([*rows.schema.fields, StructField("part", IntegerType()), StructField("place", LongType())])
    kept = materialize(ranged.mapInArrow(run, schema), "numbered")
    runs = kept.groupBy(F.col(tree).alias("r_tree"), F.col("part").alias("r_part")).agg(F.count("*").alias("rows"))
    whole = Window.partitionBy("r_tree")
    before = whole.orderBy("r_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("r_tree", "r_part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"), F.sum("rows").over(whole).alias("n"))
    met = kept.join(runs, kept[tree].eqNullSafe(runs.r_tree) & (kept.part == runs.r_part))
    return met.select(*columns, (F.col("base") + F.col("place")).alias("pos"), "n")


# ---------------------------------------------------------------- one block


def height(n: int) -> int:
    """Levels above the leaves of a tree over ``n`` leaves."""
    return (n - 1).bit_length()


def digest(*children: bytes) -> bytes:
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


class Subtree:
    """The nodes of ``levels`` levels over a run of leaves; ``nodes[level][i]`` is a digest."""

    def __init__(self, leaves: list[bytes], levels: int):
        self.leaves, self.levels = leaves, levels
        self.last = len(leaves) - 1
        self.nodes: list[list[bytes]] = [[] for _ in range(levels + 1)]
        self._forward()

    def _label(self, level: int, index: int) -> tuple[int, int]:
        return min(((index + 1) << level) - 1, self.last), level

    def _forward(self) -> None:
        """Settle nodes in label order; the queue delivers child digests to parents."""
        queue: list[tuple[tuple[int, int], int, bytes]] = []
        for i, leaf in enumerate(self.leaves):
            self._settle(queue, 0, i, leaf)
            while queue and queue[0][0][0] == i:
                label = queue[0][0]
                children = []
                while queue and queue[0][0] == label:
                    children.append(heapq.heappop(queue)[2])
                self._settle(queue, label[1], i >> label[1], digest(*children))

    def _settle(self, queue: list, level: int, index: int, value: bytes) -> None:
        self.nodes[level].append(value)
        if level < self.levels:
            heapq.heappush(queue, (self._label(level + 1, index >> 1), index, value))

    @property
    def root(self) -> bytes:
        return self.nodes[self.levels][0]

    def proofs(self, suffix: bytes) -> list[bytes]:
        """Each leaf's steps from below its parent up, ended by the root's ``suffix``: the sweep in reversed order."""
        queue = [((-self.last, -self.levels), 0, suffix)]
        out = [b""] * len(self.leaves)
        while queue:
            (_, level), index, steps = heapq.heappop(queue)
            level = -level
            if not level:
                out[index] = steps
                continue
            below = self.nodes[level - 1]
            left, right = 2 * index, 2 * index + 1
            if right >= len(below):
                children = [(left, bytes([LONE]))]
            else:
                children = [(left, bytes([RIGHT]) + below[right]), (right, bytes([LEFT]) + below[left])]
            for child, step in children:
                last, _ = self._label(level - 1, child)
                heapq.heappush(queue, ((-last, 1 - level), child, step + steps))
        return out


def steps(proof: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at < len(proof):
        side = proof[at]
        size = 0 if side == LONE else 32
        yield side, proof[at + 1 : at + 1 + size]
        at += 1 + size


def fold(leaf: bytes, proof: bytes) -> bytes:
    """The root that a leaf and its proof give."""
    for side, other in steps(proof):
        leaf = digest(leaf) if side == LONE else digest(other, leaf) if side == LEFT else digest(leaf, other)
    return leaf


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Rows sorted by (tree, block), block by block."""
    held: dict[str, list] = {}
    for batch in batches:
        rows = batch.to_pydict()
        keys = list(zip(rows["tree"], rows["block"], strict=True))
        start = 0
        for i in range(1, len(keys) + 1):
            if i < len(keys) and keys[i] == keys[start]:
                continue
            if held and (held["tree"][0], held["block"][0]) != keys[start]:
                yield held
                held = {}
            for name, column in rows.items():
                held.setdefault(name, []).extend(column[start:i])
            start = i
    if held:
        yield held


def block_levels(n: int, bits: int) -> int:
    return bits if n > 1 << bits else height(n)


# ---------------------------------------------------------------- rounds


def climb(nodes: DataFrame, bits: int) -> list[DataFrame]:
    """Tables (tree, pos, digest, n): the leaves, then after each round the roots of blocks, at last the trees' roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, pos, value, size = [], [], [], []
        for b in blocks(batches):
            n = b["n"][0]
            tree.append(b["tree"][0])
            pos.append(b["block"][0])
            value.append(Subtree(b["digest"], block_levels(n, bits)).root)
            size.append((n - 1 >> bits) + 1)
            if len(tree) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(tree, pa.string()), pa.array(pos, pa.int64()), pa.array(value, pa.binary()), pa.array(size, pa.int64())], ["tree", "pos", "digest", "n"])
                tree, pos, value, size = [], [], [], []
        if tree:
            yield pa.RecordBatch.from_arrays([pa.array(tree, pa.string()), pa.array(pos, pa.int64()), pa.array(value, pa.binary()), pa.array(size, pa.int64())], ["tree", "pos", "digest", "n"])

    rounds = [nodes]
    while not rounds[-1].where("n > 1").isEmpty():
        dealt = in_blocks(rounds[-1], bits)
        rounds.append(materialize(dealt.mapInArrow(run, "tree string, pos bigint, digest binary, n bigint"), "nodes"))
    return rounds


def in_blocks(nodes: DataFrame, bits: int) -> DataFrame:
    dealt = nodes.withColumn("block", F.shiftright("pos", bits))
    return dealt.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def descend(rounds: list[DataFrame], suffixes: DataFrame, bits: int) -> DataFrame:
    """(tree, pos, proof) of the leaves, from ``suffixes`` (tree, pos, proof) of the last table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            # the suffix of the block's root stands before its nodes
            suffix, leaves, n = b["proof"][0], b["digest"][1:], b["n"][-1]
            proofs = Subtree(leaves, block_levels(n, bits)).proofs(suffix)
            tree = pa.array([b["tree"][0]] * len(proofs), pa.string())
            yield pa.RecordBatch.from_arrays([tree, pa.array(b["pos"][1:], pa.int64()), pa.array(proofs, pa.binary())], ["tree", "pos", "proof"])

    for nodes in rounds[-2::-1]:
        below = nodes.select("tree", "pos", "digest", "n", F.shiftright("pos", bits).alias("block"), F.lit(None).cast("binary").alias("proof"))
        above = suffixes.select("tree", F.lit(-1).cast("bigint").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("bigint").alias("n"),
                                F.col("pos").alias("block"), "proof")
        dealt = below.unionByName(above).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
        suffixes = dealt.mapInArrow(run, "tree string, pos bigint, proof binary")
    return suffixes


def manifest(rows: DataFrame, tree: str, order: list[str], leaf: str, bits: int = BITS) -> DataFrame:
    """``rows`` with pos, subroot, root and proof (steps from the leaf to the root), for a column of leaf digests."""
    columns = rows.columns
    kept = materialize(numbered(rows, tree, [*order, leaf]), "leaves")
    rounds = climb(kept.select(F.col(tree).cast("string").alias("tree"), "pos", F.col(leaf).alias("digest"), "n"), bits)
    roots = rounds[-1].select(F.col("tree").alias("name"), F.col("digest").alias("subroot"))
    over = materialize(numbered(roots.withColumn("none", F.lit(None).cast("string")), "none", ["name"]), "subroots")
    top = climb(over.select(F.col("none").alias("tree"), "pos", F.col("subroot").alias("digest"), "n"), bits)
    root = top[-1].select(F.col("digest").alias("root"))
    start = top[-1].select("tree", "pos", F.lit(b"").alias("proof"))
    upper = descend(top, start, bits).select(F.col("pos").alias("u_pos"), "proof")
    # one row per tree
    subroots = materialize(over.join(upper, over.pos == upper.u_pos).select("name", "subroot", "proof"), "subroots")
    lower = descend(rounds, subroots.select(F.col("name").alias("tree"), F.lit(0).cast("bigint").alias("pos"), "proof"), bits)
    lower = lower.select(F.col("tree").alias("l_tree"), F.col("pos").alias("l_pos"), "proof")
    found = kept.join(lower, kept[tree].cast("string").eqNullSafe(lower.l_tree) & (kept.pos == lower.l_pos)).select(*columns, "pos", "proof")
    named = subroots.select(F.col("name").alias("s_tree"), "subroot")
    found = found.join(named, found[tree].cast("string").eqNullSafe(named.s_tree)).select(*columns, "pos", "proof", "subroot")
    # a single row
    return found.crossJoin(root)


def document_manifest(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    Rows whose id has a crc32 that 7 divides are folded from a tampered leaf, with one more in ``n_chars``.
    """
    columns = [F.col(c) for c in FIELDS]
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    tampered = F.coalesce(F.pmod(crc_of("doc_id"), F.lit(7)) == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    leaves = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "lang", leaf_digest(columns).alias("leaf"),
        F.when(tampered, leaf_digest(changed)).alias("other"),
    )
    proved = manifest(leaves, "lang", ["doc_id"], "leaf", bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = batch.to_pydict()
            shown, folded = [], []
            for leaf, other, proof in zip(r["leaf"], r["other"], r["proof"], strict=True):
                shown.append(digest(*[d for side, d in steps(proof) if side != LONE]).hex())
                folded.append(fold(leaf if other is None else other, proof))
            hexed = [pa.array([d.hex() for d in r[c]], pa.string()) for c in ("leaf", "subroot", "root")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *hexed, pa.array(shown, pa.string()), pa.array([d.hex() for d in folded], pa.string()),
                 pa.array([a == b for a, b in zip(folded, r["root"], strict=True)], pa.bool_())],
                ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
            )

    return proved.select("doc_id", "leaf", "other", "proof", "subroot", "root").mapInArrow(
        run, "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    )
