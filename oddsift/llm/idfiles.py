"""Files of token ids: every document is one zstandard frame, all frames share one trained dictionary.

A store is a folder with two Parquet tables, written by Spark's committed writers so that lost executors leave no
half-written part:

* ``dictionary``: one row with the dictionary and its sha256;
* ``blocks``: rows of consecutive documents in ascending id order with ``part``, ``tokens_before`` (tokens of the part
  before the block), ``first_id`` and ``last_id``, ``dict_sha256``, and for each document its id (``doc_ids``), number
  of tokens (``sizes``) and end within ``frames`` (``ends``).

One document is read by pruning blocks on ``first_id`` and ``last_id`` and cutting its frame out of ``frames``.

The dictionary is trained on at most ``SAMPLES`` pieces of ``SAMPLE_BYTES`` from documents drawn by a hash; with too
few of them, or none, their bytes serve as a raw dictionary.

Defined cases: a null or empty text has only the end id. Null ids sort first and are kept. Rows that share an id stand
in the order of their texts, equal rows one after the other. An empty table gives an empty store and an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oddsift.llm.wordpieces import Ids

SAMPLES = 1024
SAMPLE_BYTES = 8192
DICTIONARY_BYTES = 32768
BLOCK_BYTES = 1 << 18
ROWS = 500

BLOCKS = (
    "part int, tokens_before bigint, first_id bigint, last_id bigint, dict_sha256 string, doc_ids array<bigint>, "
    "sizes array<bigint>, ends array<bigint>, frames binary"
)


def make_dictionary(samples: list[bytes]) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY_BYTES:]


def open_dictionary(body: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(body) if body else None


def sample(docs: DataFrame, tokenizer: str, end_id: int) -> list[bytes]:
    """Serialized ids of pieces of about two documents per sample wanted."""
    rows = docs.count()
    drawn = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 2 * SAMPLES / max(rows, 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids(tokenizer, end_id)
        for batch in batches:
            pieces = [p[i : i + SAMPLE_BYTES] for p in ids.encode(batch.column(0).to_pylist()) for i in range(0, len(p), SAMPLE_BYTES)]
            yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.binary())], ["piece"])

    pieces = drawn.select("text").mapInArrow(run, "piece binary")
    return [bytes(r.piece) for r in pieces.orderBy(F.xxhash64("piece"), "piece").limit(SAMPLES).collect()]


def write(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, level: int = 3, doc_id: str = "doc_id", text: str = "text"
) -> None:
    """Encode every whole text, append ``end_id``, and write the store to ``path``."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    body = make_dictionary(sample(docs, tokenizer, end_id))
    name = hashlib.sha256(body).hexdigest()
    spark.createDataFrame([(name, bytearray(body))], "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        ids, part, before = Ids(tokenizer, end_id), TaskContext.get().partitionId(), 0
        shared = open_dictionary(body)
        compressor = zstandard.ZstdCompressor(level=level, **({"dict_data": shared} if shared else {}))
        names, sizes, frames, held = [], [], [], 0

        def block() -> pa.RecordBatch:
            ends = np.cumsum([len(f) for f in frames]).tolist()
            row = (part, before, names[0], names[-1], name, names, sizes, ends, b"".join(frames))
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.list_(pa.int64())] * 3, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], [c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                for doc, packed in zip(some.column(0).to_pylist(), ids.encode(some.column(1).to_pylist()), strict=True):
                    frame = compressor.compress(packed)
                    names.append(doc)
                    sizes.append(len(packed) // 4)
                    frames.append(frame)
                    held += len(frame)
                    if held >= BLOCK_BYTES:
                        yield block()
                        before += sum(sizes)
                        names, sizes, frames, held = [], [], [], 0
        if names:
            yield block()

    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    return row.sha256, bytes(row.dictionary)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of every document, from the files."""
    return _decoded(spark, path, "ids binary", lambda packed: pa.array(packed, pa.binary()))


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and crc32 of the ids of every document, from the files."""
    return _decoded(spark, path, "ids_crc32 bigint", lambda packed: pa.array([zlib.crc32(p) for p in packed], pa.int64()))


def _decoded(spark: SparkSession, path: str, field: str, column) -> DataFrame:
    name, body = dictionary(spark, path)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    tokens = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x)
    parts = blocks.groupBy("part").agg(F.max(F.col("tokens_before") + tokens).alias("tokens"))
    # one row per writing task
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("tokens").over(order), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        shared = open_dictionary(body)
        decompressor = zstandard.ZstdDecompressor(**({"dict_data": shared} if shared else {}))
        for batch in batches:
            for i in range(batch.num_rows):
                start, used, names, sizes, ends, frames = (batch.column(k)[i].as_py() for k in range(6))
                if used != name:
                    raise ValueError("a block was written with another dictionary")
                cuts = [0, *ends]
                packed = [decompressor.decompress(frames[a:b]) for a, b in zip(cuts, ends, strict=False)]
                starts = start + np.cumsum([0, *sizes])[:-1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), column(packed)],
                    ["doc_id", "start", "n_tokens", field.split()[0]],
                )

    rows = blocks.join(parts, "part").select((F.col("base") + F.col("tokens_before")).alias("start"), "dict_sha256", "doc_ids", "sizes", "ends", "frames")
    return rows.mapInArrow(run, f"doc_id bigint, start bigint, n_tokens bigint, {field}")


def fetch(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """The ids of the documents with one id, reading only the blocks that may hold it and only its frames."""
    import zstandard

    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").where(F.lit(doc_id).between(F.col("first_id"), F.col("last_id")))
    place = F.posexplode(F.arrays_zip("doc_ids", "ends")).alias("at", "d")
    begin = F.when(F.col("at") > 0, F.element_at("ends", F.col("at"))).otherwise(0)
    found = blocks.select("*", place).where(F.col("d.doc_ids") == doc_id)
    found = found.select(F.substring(F.col("frames"), (begin + 1).cast("int"), (F.col("d.ends") - begin).cast("int")).alias("frame"), "part", "tokens_before", "at")
    shared = open_dictionary(dictionary(spark, path)[1])
    decompressor = zstandard.ZstdDecompressor(**({"dict_data": shared} if shared else {}))
    return [np.frombuffer(decompressor.decompress(bytes(r.frame)), dtype="<u4") for r in found.orderBy("part", "tokens_before", "at").collect()]
