"""Packing token ids into sequences by cutting-stock column generation.

A document of n tokens gives ``n // capacity`` full sequences and a rest. Rests are counted in length classes. A
linear program over patterns (how many rests of each class share a sequence) minimises the number of sequences; its
columns are priced by a knapsack over the classes. Rounded down, the patterns have slots; the documents of a class are
ranked, and rank r takes slot r of its class. Patterns are taken back until their sequences hold no more than all
rests do. The rests without a slot are laid end to end over the room that is left in the sequences, and cut there;
what still remains fills whole sequences and then sequences of a power of two, which need no padding either.

The program sees only the histogram (at most ``capacity / CLASS_WIDTH`` counts). Ranks, offsets and cut places are
running totals in two levels: within a task or a block of rows, and over one row per task or block.

Defined cases: a null or empty text has only the end id. Rows are told apart by their place in a written table, so
null and repeated ids are packed like others. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsift.llm.wordpieces import Ids
from oddsift.session import materialize

CAPACITY = 2048
CLASS_WIDTH = 8
BLOCK = 1 << 17
CELL = 1 << 20
ROWS = 500

# ---------------------------------------------------------------- patterns


def best_pattern(value: np.ndarray, size: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The knapsack: how many of each kind fit into ``room`` with the greatest value."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    for r in range(1, room + 1):
        fits = size <= r
        gain = np.where(fits, value + best[np.maximum(r - size, 0)], -1.0)
        k = int(gain.argmax())
        if gain[k] > best[r - 1] + 1e-12:
            best[r], pick[r] = gain[k], k
        else:
            best[r] = best[r - 1]
    counts, r = np.zeros(len(size), dtype=np.int64), room
    while r > 0:
        if pick[r] < 0 or best[r] == best[r - 1]:
            r -= 1
        else:
            counts[pick[r]] += 1
            r -= size[pick[r]]
    return float(best[room]), counts


def patterns(size: np.ndarray, demand: np.ndarray, room: int, gap: float = 0.001, rounds: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Columns (one per pattern) and how often each is used, once the program's bound is within ``gap``.

    The prices divided by the best pattern's value are feasible for the dual program, so they bound the optimum.
    """
    columns = np.diag(room // size).astype(float)
    inverse = np.diag(1.0 / (room // size))
    use = inverse @ demand
    for step in range(1, rounds):
        prices = inverse.sum(axis=0)
        value, found = best_pattern(prices, size, room)
        if value <= 1 + 1e-9 or prices @ demand / value >= (1 - gap) * use.sum():
            break
        move = inverse @ found
        ratio = np.where(move > 1e-9, np.maximum(use, 0) / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratio.argmin())
        columns[:, out] = found
        if step % 256 == 0:
            inverse = np.linalg.inv(columns)
        else:
            row = inverse[out] / move[out]
            inverse -= np.outer(move, row)
            inverse[out] = row
        use = inverse @ demand
    return np.rint(columns).astype(np.int64), np.maximum(use, 0)


def plan(sizes: np.ndarray, demand: np.ndarray, tokens: int, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns and their whole numbers of sequences, no more than the rests' tokens fill."""
    if not len(sizes):
        return np.zeros((0, 0), np.int64), np.zeros(0, np.int64)
    columns, used = patterns(sizes, demand.astype(float), capacity // CLASS_WIDTH)
    times = np.floor(used + 1e-9).astype(np.int64)
    while (columns @ times > demand).any():
        times[np.argmax((columns[np.argmax(columns @ times - demand)] > 0) * times)] -= 1
    over = int(times.sum()) - tokens // capacity
    # patterns of many small rests go first: cutting small rests costs least
    for k in np.argsort(-columns.sum(axis=0), kind="stable"):
        if over <= 0:
            break
        take = min(over, int(times[k]))
        times[k] -= take
        over -= take
    return columns, times


# ---------------------------------------------------------------- running totals


def running(df: DataFrame, key: Column, value: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the total of ``value`` over all rows with a smaller ``key`` (unique, 0 or more, dense)."""
    df = df.withColumn("_block", F.floor(key / BLOCK))
    within = Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    # one row per block
    over = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = df.groupBy("_block").agg(F.sum(value).alias("_sum")).select("_block", F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_base"))
    df = df.withColumn(name, F.coalesce(F.sum(value).over(within), F.lit(0))).join(base, "_block")
    return df.withColumn(name, F.col(name) + F.col("_base")).drop("_block", "_base")


# ---------------------------------------------------------------- documents


def encode(
    docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, id_bytes: int = 4, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Ids of every document with its row number, the task and class of its rest, and its rank there within the task.

    Ids take ``id_bytes`` bytes each, 2 or 4. Running numbers are by task, so write the result before use.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, part = Ids(tokenizer, end_id), TaskContext.get().partitionId()
        row, full_before, ranks = part << 40, 0, np.zeros(capacity // CLASS_WIDTH + 1, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                packed = ids.encode(some.column(1).to_pylist())
                n = np.array([len(p) // 4 for p in packed], dtype=np.int64)
                full, kind = n // capacity, -(-(n % capacity) // CLASS_WIDTH)
                order = np.argsort(kind, kind="stable")
                sorted_kind = kind[order]
                nth = np.arange(len(n)) - np.searchsorted(sorted_kind, sorted_kind)
                rank = np.empty(len(n), dtype=np.int64)
                rank[order] = nth + ranks[sorted_kind]
                ranks += np.bincount(kind, minlength=len(ranks))
                before = full_before + np.cumsum(full) - full
                full_before += int(full.sum())
                if id_bytes == 2:
                    packed = [np.frombuffer(p, dtype="<u4").astype("<u2").tobytes() for p in packed]
                columns = [np.arange(row, row + len(n)), n, np.full(len(n), part), kind, rank, full, before]
                row += len(n)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), *map(pa.array, columns), pa.array(packed, pa.binary())],
                    ["doc_id", "row", "n", "part", "kind", "rank", "full", "full_before", "ids"],
                )

    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    fields = ["row", "n", "part", "kind", "rank", "full", "full_before"]
    return docs.mapInArrow(run, "doc_id bigint, " + ", ".join(f"{f} bigint" for f in fields) + ", ids binary")


def place(encoded: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """row, start, length, sequence_id and offset of every piece of the written ``encoded`` documents."""
    spark = encoded.sparkSession
    rest = F.col("n") % capacity
    counted = encoded.where("kind > 0").groupBy("kind").agg(F.count("*").alias("n"), F.sum(rest).alias("tokens")).orderBy("kind").collect()
    kinds, demand = np.array([r.kind for r in counted], dtype=np.int64), np.array([r.n for r in counted], dtype=np.int64)
    tokens = sum(r.tokens for r in counted)
    columns, times = plan(kinds, demand, tokens, capacity)
    n_planned = int(times.sum())

    # slots: one row per class and pattern
    first_sequence = np.cumsum(times) - times
    slots, taken = [], {}
    for i, kind in enumerate(kinds.tolist()):
        low = 0
        for p in np.flatnonzero((columns[i] > 0) & (times > 0)).tolist():
            each = int(columns[i, p])
            slots.append((kind, low, low + each * int(times[p]), each, int(first_sequence[p])))
            low += each * int(times[p])
        taken[kind] = low
    slot_rows = spark.createDataFrame(slots or [(-1, 0, 0, 1, 0)], "kind bigint, low bigint, high bigint, each bigint, first bigint")
    taken_rows = spark.createDataFrame(list(taken.items()) or [(-1, 0)], "kind bigint, taken bigint")

    # ranks over all tasks
    over = Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = encoded.where("kind > 0").groupBy("kind", "part").agg(F.count("*").alias("n"))
    base = base.select("kind", "part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("rank_base"))
    rests = encoded.where("kind > 0").select("row", "kind", "part", "rank", (F.col("n") - rest).alias("start"), rest.alias("length"))
    rests = rests.join(base, ["kind", "part"]).withColumn("rank", F.col("rank") + F.col("rank_base"))
    rests = materialize(rests.join(F.broadcast(taken_rows), "kind").select("row", "kind", "rank", "taken", "start", "length"), "rests")

    slot = (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    seated = rests.where("rank < taken").withColumnRenamed("kind", "k").join(F.broadcast(slot_rows), (F.col("k") == F.col("kind")) & slot)
    number = F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("each"))
    seated = seated.select("row", "start", "length", number.alias("sequence_id"))
    in_sequence = Window.partitionBy("sequence_id").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    seated = materialize(seated.withColumn("offset", F.coalesce(F.sum("length").over(in_sequence), F.lit(0))), "seated")

    # room: what the planned sequences leave, then whole sequences, then powers of two
    left = tokens - n_planned * capacity
    tail, at = [], left - left % capacity
    for bit in reversed(range(capacity.bit_length())):
        if left % capacity >> bit & 1:
            tail.append((n_planned + left // capacity + len(tail), 0, 1 << bit, at))
            at += 1 << bit
    used = seated.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    room = running(used, F.col("sequence_id"), capacity - F.col("used"), "begin")
    loose = rests.where("rank >= taken").withColumn("nth", F.col("rank") - F.col("taken"))
    spare = sum(int(d) for d in demand) - sum(taken.values())
    shift = dict(zip(kinds.tolist(), (np.cumsum(demand - np.array([taken[k] for k in kinds.tolist()], dtype=np.int64)) - (demand - np.array([taken[k] for k in kinds.tolist()], dtype=np.int64))).tolist(), strict=True))
    shift_rows = spark.createDataFrame(list(shift.items()) or [(-1, 0)], "kind bigint, shift bigint")
    loose = loose.join(F.broadcast(shift_rows), "kind").withColumn("nth", F.col("nth") + F.col("shift"))
    loose = running(loose, F.col("nth"), F.col("length"), "begin")
    # the planned sequences' room ends where the whole sequences begin
    inner = room.select("sequence_id", F.col("used").alias("offset"), (capacity - F.col("used")).alias("length"), "begin").where("length > 0")
    total = int(inner.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]) if spare else 0
    whole = spark.range(left // capacity).select(
        (F.col("id") + n_planned).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"), F.lit(capacity).cast("bigint").alias("length"), (F.col("id") * capacity + total).alias("begin")
    )
    tail_rows = spark.createDataFrame([(s, o, size, b + total) for s, o, size, b in tail], "sequence_id bigint, offset bigint, length bigint, begin bigint")
    pieces = overlay(loose.select("row", "start", "length", "begin"), inner.unionByName(whole).unionByName(tail_rows))

    n_before_full = n_planned + left // capacity + len(tail)
    parts = encoded.groupBy("part").agg(F.sum("full").alias("full"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", (F.coalesce(F.sum("full").over(order), F.lit(0)) + n_before_full).alias("full_base"))
    full = encoded.where("full > 0").select("row", "part", "full", "full_before").join(parts, "part")
    full = full.select("row", (F.col("full_base") + F.col("full_before")).alias("base"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)).alias("i"))
    full = full.select("row", (F.col("i") * capacity).alias("start"), F.lit(capacity).cast("bigint").alias("length"), (F.col("base") + F.col("i")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return full.unionByName(seated).unionByName(pieces)


def overlay(loose: DataFrame, room: DataFrame) -> DataFrame:
    """Lay the loose stretches end to end over the rooms end to end, and cut both where either ends."""

    def cells(df: DataFrame) -> DataFrame:
        first, last = F.floor(F.col("begin") / CELL), F.floor((F.col("begin") + F.col("length") - 1) / CELL)
        return df.where("length > 0").withColumn("cell", F.explode(F.sequence(first, last)))

    def cut(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = ["row", "start", "length", "sequence_id", "offset"]
        if a.empty or b.empty:
            return pd.DataFrame({n: pd.Series(dtype="int64") for n in names})
        a, b = a.sort_values("begin"), b.sort_values("begin")
        low, high = int(key[0]) * CELL, (int(key[0]) + 1) * CELL
        a0, b0 = a["begin"].to_numpy(), b["begin"].to_numpy()
        a1, b1 = a0 + a["length"].to_numpy(), b0 + b["length"].to_numpy()
        low, high = max(low, a0[0], b0[0]), min(high, a1[-1], b1[-1])
        edges = np.unique(np.concatenate((a0, b0, [low, high])))
        edges = edges[(edges >= low) & (edges <= high)]
        begin, size = edges[:-1], np.diff(edges)
        i, j = np.searchsorted(a0, begin, side="right") - 1, np.searchsorted(b0, begin, side="right") - 1
        out = [a["row"].to_numpy()[i], a["start"].to_numpy()[i] + begin - a0[i], size, b["sequence_id"].to_numpy()[j], b["offset"].to_numpy()[j] + begin - b0[j]]
        return pd.DataFrame(dict(zip(names, out, strict=True)))

    both = cells(loose).groupBy("cell").cogroup(cells(room).groupBy("cell"))
    return both.applyInPandas(cut, "row bigint, start bigint, length bigint, sequence_id bigint, offset bigint")


def pack(encoded: DataFrame, capacity: int = CAPACITY, with_ids: bool = True, id_bytes: int = 4) -> DataFrame:
    """One row per piece with its ids (little-endian unsigned 32-bit) or, without them, their crc32."""
    pieces = place(encoded, capacity).groupBy("row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                rows = []
                for doc, n, ids, parts in zip(*(some.column(k).to_pylist() for k in range(4)), strict=True):
                    ids = np.frombuffer(ids, dtype=f"<u{id_bytes}")
                    for p in parts:
                        own = ids[p["start"] : p["start"] + p["length"]].astype("<u4").tobytes()
                        rows.append((doc, p["start"], p["length"], own if with_ids else zlib.crc32(own), n, p["sequence_id"], p["offset"]))
                if rows:
                    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary() if with_ids else pa.int64(), *[pa.int64()] * 3]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    names = ["doc_id", "start", "length", "ids" if with_ids else "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = ", ".join(f"{n} {'binary' if n == 'ids' else 'bigint'}" for n in names)
    return encoded.select("row", "doc_id", "n", "ids").join(pieces, "row").select("doc_id", "n", "ids", "pieces").mapInArrow(run, schema)


def pack_texts(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Encode and pack every document."""
    from tokenizers import Tokenizer

    id_bytes = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    return pack(materialize(encode(docs, tokenizer, end_id, capacity, id_bytes), "encoded"), capacity, with_ids, id_bytes)
