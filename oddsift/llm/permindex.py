"""Nearest neighbours by cosine through a permutation index.

Pivots are vectors drawn by a hash; a vector is represented by its ``prefix`` nearest pivots in order. Every vector is
posted in the inverted files of its ``posts`` nearest pivots. A query looks into the files of its ``probes`` nearest
pivots, ranks each file's members by the footrule distance between permutations (a pivot outside a prefix stands at
its end), and reranks the best ``share`` of them by exact cosine. Equal vectors are one entry with its least ids, so
copies cost nothing and ties between them are exact.

Files are dealt in slices of at most about ``SLICE`` entries and ``QUERIES`` queries, sized from counts, so a popular
pivot is many tasks. On vectors without structure the share to rerank cannot shrink with the table: work grows with
queries times entries, in blocks.

Defined cases: a vector that is null, zero, or has a null or non-finite component takes no part, nor does a row with a
null id. Vectors of different dimensions are not compared. Rows that share an id count as one vector, at its best
score. A query gets fewer than ``k`` rows only where fewer other rows exist. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddsift.session import materialize

SLICE = 20_000
QUERIES = 4_000
LEAST_RERANKED = 64


def entries(vectors: DataFrame, query: Column, k: int, kind: str) -> DataFrame:
    """Distinct vectors: key, the packed vector, its k + 1 least ids, and whether some query has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, tuple[set[int], bool]] = {}
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind)
            rows = flat.reshape(batch.num_rows, -1)
            for doc, asks, row in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), rows, strict=True):
                body = row.tobytes()
                ids, asked = kept.get(body, (set(), False))
                ids.add(doc)
                if len(ids) > k + 1:
                    ids.remove(max(ids))
                kept[body] = ids, asked or asks
            if len(kept) > 50_000:
                yield packed(kept)
                kept = {}
        if kept:
            yield packed(kept)

    def packed(kept: dict[bytes, tuple[set[int], bool]]) -> pa.RecordBatch:
        keys = [hashlib.blake2b(body, digest_size=16).digest() for body in kept]
        ids, asked = zip(*kept.values(), strict=True)
        columns = [pa.array(keys, pa.binary()), pa.array(list(kept), pa.binary()), pa.array([sorted(i) for i in ids], pa.list_(pa.int64())), pa.array(asked, pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, ["key", "vector", "ids", "asked"])

    rows = vectors.select("vec_id", "v", query.alias("asks")).mapInArrow(run, "key binary, vector binary, ids array<bigint>, asked boolean")
    # a task sends at most k + 1 ids for a vector
    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1)
    return rows.groupBy("key").agg(F.first("vector").alias("vector"), ids.alias("ids"), F.max("asked").alias("asked"))


def permutations(unit: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each vector in order; ties go to the pivot drawn first."""
    return np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :prefix]


def footrule(one: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Footrule distance of one permutation prefix from many, given the place of every pivot in each of those."""
    m = len(one)
    at = places[:, one].astype(np.int32)
    # pivots in only one of two prefixes stand at place m in the other
    return np.abs(at - np.arange(m)).sum(axis=1) + m * (m + 1) // 2 - (m - at).sum(axis=1)


def unpack(column: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=kind).reshape(len(column), -1)


def search(
    table: DataFrame, query: Column, k: int = 5, pivots: int = 128, prefix: int = 64, posts: int = 4, probes: int = 32, share: float = 0.12,
    vec_id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows found for every row that ``query`` (of vec_id) marks.

    Vectors of each dimension have an index of their own.
    """
    double = isinstance(table.schema[vector].dataType.elementType, T.DoubleType)
    kind = "<f8" if double else "<f4"
    rows = table.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).alias("v")).where("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    sizes = sorted(r.d for r in rows.select(F.size("v").alias("d")).distinct().collect())  # one row per dimension
    if not sizes:
        return table.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    asks = F.coalesce(query, F.lit(False))
    found = [search_alike(rows.where(F.size("v") == d), asks, kind, k, pivots, prefix, posts, probes, share) for d in sizes]
    if len(found) == 1:
        return found[0]
    # an id may have vectors of several dimensions
    pairs = reduce(DataFrame.unionByName, found).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return ranked(pairs, k)


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_alike(rows: DataFrame, asks: Column, kind: str, k: int, pivots: int, prefix: int, posts: int, probes: int, share: float) -> DataFrame:
    """``search`` among the rows (vec_id, v) of one dimension."""
    known = materialize(entries(rows, asks, k, kind), "vectors")
    n = known.count()

    wanted = max(1, min(pivots, n // 8))
    # two draws in expectation, so that enough are there; at most that many rows reach the driver
    drawn = known.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, (2 * wanted + 20) / n)))
    drawn = drawn.select("vector").orderBy(F.xxhash64("key"), "key").limit(wanted).collect()
    base = np.frombuffer(b"".join(bytes(r.vector) for r in drawn), dtype=kind).reshape(len(drawn), -1).astype(np.float64)
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    width = min(prefix, len(base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=kind).reshape(batch.num_rows, -1).astype(np.float64)
            order = permutations(v / np.linalg.norm(v, axis=1, keepdims=True), base, width).astype(np.int32)
            columns = [*(batch.column(i) for i in range(4)), pa.array([o.tobytes() for o in order], pa.binary()), pa.array(order[:, :posts].tolist(), pa.list_(pa.int32())), pa.array(order[:, :probes].tolist(), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "vector", "ids", "asked", "order", "posts", "probes"])

    schema = "key binary, vector binary, ids array<bigint>, asked boolean, order binary, posts array<int>, probes array<int>"
    index = materialize(known.mapInArrow(run, schema), "permutations")

    posted = index.select("key", "vector", "ids", "order", F.explode("posts").alias("pivot"))
    asked = index.where("asked").select("key", "vector", "order", F.explode("probes").alias("pivot"))
    # one row per pivot
    slices = posted.groupBy("pivot").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    blocks = asked.groupBy("pivot").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
    deal = F.broadcast(slices.join(blocks, "pivot"))

    def part(count: str) -> Column:
        return F.pmod(F.xxhash64("key", "pivot"), F.col(count)).cast("int")

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    left = asked.join(deal, "pivot").select("key", "vector", "order", "pivot", part("blocks").alias("block"), every("slices").alias("slice"))
    # both sides come from one table: renaming tells their columns apart
    left = left.toDF(*left.columns)
    right = posted.join(deal, "pivot").select("key", "vector", "ids", "order", "pivot", part("slices").alias("slice"), every("blocks").alias("block"))
    n_pivots = len(base)

    def look(queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(queries) and len(members):
            orders, wanted_orders = unpack(members["order"], "<i4"), unpack(queries["order"], "<i4")
            places = np.full((len(members), n_pivots), width, dtype=np.int16)
            np.put_along_axis(places, orders, np.arange(width, dtype=np.int16)[None], 1)
            v, q = unpack(members["vector"], kind).astype(np.float64), unpack(queries["vector"], kind).astype(np.float64)
            lengths, own = np.sqrt((v * v).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
            keys, ids = members["key"].tolist(), members["ids"].tolist()
            take = min(len(members), max(LEAST_RERANKED, int(np.ceil(share * len(members)))))
            for i, name in enumerate(queries["key"]):
                near = np.argpartition(footrule(wanted_orders[i], places), take - 1)[:take]
                score = (v[near] * q[i]).sum(axis=1) / (lengths[near] * own[i])
                # ties for the last place all go on; the merge decides by id
                last = np.partition(score, -min(k + 1, take))[-min(k + 1, take)]
                out.extend((name, keys[near[j]], float(score[j]), list(ids[near[j]])) for j in np.flatnonzero(score >= last))
        return pd.DataFrame(out, columns=["query", "key", "score", "ids"])

    found = left.groupBy("pivot", "slice", "block").cogroup(right.groupBy("pivot", "slice", "block"))
    found = found.applyInPandas(look, "query binary, key binary, score double, ids array<bigint>").dropDuplicates(["query", "key"])
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.element_at("ids", 1))
    found = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).select("query", "score", F.explode("ids").alias("vec_id"))

    # the rows that ask, by the key of their vector
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(batch.num_rows, -1)
                keys = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in v]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary())], ["query_id", "query"])

    askers = rows.where(asks).select("vec_id", "v").mapInArrow(name, "query_id bigint, query binary")
    pairs = askers.join(found, "query").where("query_id != vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return ranked(pairs, k)
