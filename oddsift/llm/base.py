"""What the operators share: Arrow text columns as numpy tokens, hashes, and memory that outlives a task."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space bytes that separate words.
SPACE_BYTES = b" \t\n\x0b\x0c\r"

SLICE_BYTES = 4 << 20
BATCH_BYTES = 4 << 20
#: bytes of text whose tokens are hashed at a time
HASH_BLOCK = 1 << 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of(column: str) -> Column:
    """crc32 of a column written as text; null stays null."""
    return F.crc32(F.col(column).cast("string"))


def spare_name(taken: list[str], wish: str) -> str:
    """``wish``, with underscores appended until no column of ``taken`` has that name in any case."""
    low = {t.lower() for t in taken}
    while wish.lower() in low:
        wish += "_"
    return wish


def worker_store(name: str) -> dict:
    """A dict that outlives its task, so that later tasks of its Python worker find what earlier ones worked out.

    A worker holds one store at a time: asking for another name drops what the last one held.
    """
    box = sys.modules.setdefault("oddsift_worker_store", types.ModuleType("oddsift_worker_store"))
    if getattr(box, "name", None) != name:
        box.name, box.store = name, {}
        give_back()
    return box.store


def give_back() -> None:
    """Return freed memory to the system: allocators keep it otherwise, for as long as the worker lives."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only the GNU library has it
    if trim is not None:
        trim(0)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that reach Python workers to BATCH_BYTES each, unless the session names a bound itself.

    Spark's own bound is 64 MB, of which the executor and the worker hold several copies for every running task.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


# ---------------------------------------------------------------- text slices


class Texts:
    """A run of texts as one byte array; ``bounds[i]:bounds[i + 1]`` is text i."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, first_row: int):
        self.data, self.bounds, self.first_row = data, bounds, first_row
        self.n = len(bounds) - 1

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Number of set flags (one per byte) in each text."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.bounds[1:]] - total[self.bounds[:-1]]


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """Cut a text column into runs of about ``limit`` bytes; a longer text is a run of its own. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        stop = min(stop, len(column))
        yield Texts(data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row], row)
        row = stop


def byte_table(values: dict[bytes, int], default: int = 0) -> np.ndarray:
    out = np.full(256, default, dtype=np.uint8)
    for members, value in values.items():
        out[np.frombuffer(members, dtype=np.uint8)] = value
    return out


WORD_KIND = byte_table({SPACE_BYTES: 0}, 1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
STEP = np.uint64(0x5851F42D4C957F2D)


class Tokens:
    """Runs of bytes of one kind; ``first[i]:first[i + 1]`` are the tokens of text i."""

    def __init__(self, texts: Texts, kinds: np.ndarray = WORD_KIND, lower: bool = False):
        data = LOWER[texts.data] if lower else texts.data
        kind = kinds[data]
        edge = np.empty(len(data), dtype=bool)
        if len(data):
            edge[0] = True
            np.not_equal(kind[1:], kind[:-1], out=edge[1:])
            inner = texts.bounds[1:-1]
            edge[inner[inner < len(data)]] = True
        edge &= kind != 0
        self.start = np.flatnonzero(edge)
        self.first = np.searchsorted(self.start, texts.bounds)
        self.kind = kind
        self._data = data

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each token's bytes, worked out in blocks of tokens so that memory does not follow the run."""
        out = np.empty(len(self.start), dtype=np.uint64)
        at = 0
        while at < len(out):
            stop = max(at + 1, int(np.searchsorted(self.start, self.start[at] + HASH_BLOCK)))
            end = int(self.start[stop]) if stop < len(out) else len(self._data)
            out[at:stop] = self._block_hashes(self.start[at:stop], end)
            at = stop
        return out

    def _block_hashes(self, start: np.ndarray, end: int) -> np.ndarray:
        begin = int(start[0])
        lengths = np.diff(np.append(start, end))
        place = np.arange(begin, end, dtype=np.int64) - np.repeat(start, lengths)
        inside = self.kind[begin:end] == np.repeat(self.kind[start], lengths)
        place[~inside] = 0
        powers = np.cumprod(np.full(int(place.max()) + 1, STEP, dtype=np.uint64))
        value = BYTE_VALUES[self._data[begin:end]] * powers[place]
        value[~inside] = 0
        return mix(np.add.reduceat(value, start - begin))

    def owners(self) -> np.ndarray:
        """The text of each token."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def windows(token_hash: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` tokens, and the index of each run's first token; no run leaves its text."""
    if len(token_hash) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = len(token_hash) - width + 1
    value = np.zeros(count, dtype=np.uint64)
    for k in range(width):
        value = mix(value ^ token_hash[k : k + count])
    ends = np.repeat(first[1:], np.diff(first))[:count]
    at = np.flatnonzero(np.arange(count) + width <= ends)
    return value[at], at
