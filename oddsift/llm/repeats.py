"""Repeated passages of all texts: common-prefix intervals of a sparse enhanced suffix array.

A passage of ``min_len`` bytes always holds an anchor: the place whose next ``PIECE`` bytes hash lowest among the
passage's own. Equal passages agree on it, so every repeat shows up at an anchor, and only suffixes at anchors are
sorted. Two stages:

* Anchors with one context (``min_len - PIECE`` bytes before it, ``min_len`` from it on) form a class. All but the
  first of a class repeat that whole context. Classes that alone have their piece go no further.
* The first members of the other classes are sorted by piece and by what follows: the suffix array, dealt over tasks by
  piece. A stack scan over the common prefixes of neighbours gives the prefix intervals, deepest first. The members of
  an interval in order of what precedes them form intervals of common left extension in turn; one that reaches
  ``min_len`` in all and is not inside a single deeper prefix interval is a maximal repeat with all its occurrences:
  its members differ on both sides, or a text ends there.

Repeats that reach beyond an anchor's context come as overlapping parts, one for each anchor in them.

Pieces with more than ``most`` contexts are divided: a passage reaches at least half of what the shared bytes lack to
the left, or the rest to the right, so such a group goes on as two sets of smaller groups that share more bytes, up to
whole passages of ``min_len`` bytes.

Rows are told apart by id, and where ids repeat by the text's hash as well. Defined cases: null and empty texts have
no bytes and no repeats. A null id comes before all others. Of texts with one id the one with the lower hash comes
first; of equal rows one is first and the rest repeat it. Very long texts are read in pieces that overlap. An empty
table gives an empty result. Columns besides the two named are not looked at, whatever their names. Classes are named
by 64-bit digests of their contexts: two of n share a name with probability n^2 / 2^65.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from oddsift.llm.base import BYTE_VALUES, STEP, Texts, mix, text_slices
from oddsift.llm.jaccard import bit_places, filter_bits
from oddsift.session import materialize

PIECE = 32
SLICE = 1 << 20
MOST = 20_000
ANCHOR = "kind int, key bigint, class bigint, doc_id bigint, dig bigint, place bigint"


# ---------------------------------------------------------------- anchors


class Powers:
    """Powers of the hash base and of its inverse, as many as any slice so far has needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = np.uint64(pow(int(STEP), -1, 1 << 64))
            self.up = np.cumprod(np.full(n, STEP, dtype=np.uint64))
            self.down = np.cumprod(np.full(n, inverse, dtype=np.uint64))
        return self.up[:n], self.down[:n]


def slices(column: pa.Array, overlap: int) -> Iterator[tuple[Texts, int, bool]]:
    """Runs of texts of about ``SLICE`` bytes, the offset of the first byte in its text, and whether that text goes on.

    A longer text comes in pieces that reach ``overlap`` bytes beyond each cut on either side.
    """
    for t in text_slices(column, SLICE):
        if t.n > 1 or len(t.data) <= 2 * SLICE:
            yield t, 0, False
            continue
        for at in range(0, len(t.data), SLICE):
            start, stop = max(0, at - overlap), min(len(t.data), at + SLICE + overlap)
            yield Texts(t.data[start:stop], np.array([0, stop - start]), t.first_row), start, stop < len(t.data)


def anchors_of(t: Texts, min_len: int, powers: Powers) -> tuple[np.ndarray, ...]:
    """Text, place in the slice, piece hash and context hash of every anchor of a slice."""
    n = len(t.data)
    none = np.zeros(0, np.int64)
    if n < min_len:
        return none, none, none.view(np.uint64), none.view(np.uint64)
    up, down = powers.upto(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[t.data] * up[:n], out=total[1:])
    piece = mix((total[PIECE:] - total[:-PIECE]) * down[: n - PIECE + 1])
    # the place in the low bits makes the leftmost of equal hashes the least
    bits = np.uint64(n.bit_length())
    low = (piece >> bits << bits) | np.arange(len(piece), dtype=np.uint64)
    width, span = min_len - PIECE + 1, 1
    while span < width:
        step = min(span, width - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    sizes = np.diff(t.bounds)
    inside = np.ones(len(low), dtype=bool)
    starts = np.arange(min_len - 1)
    for end in t.bounds[1:-1]:
        cut = end - 1 - starts
        inside[cut[(cut >= 0) & (cut < len(inside))]] = False
    at = (low[inside] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
    own = np.repeat(np.arange(t.n), sizes)[at]
    start = np.maximum(at - (min_len - PIECE), t.bounds[own])
    stop = np.minimum(at + min_len, t.bounds[own + 1])
    shape = ((at - start) << 32 | (stop - start)).astype(np.uint64)
    context = mix(mix((total[stop] - total[start]) * down[start]) ^ mix(shape + np.uint64(1)))
    return own, at, piece[at], context


def anchors(docs: DataFrame, min_len: int) -> DataFrame:
    """One row per anchor. Within a batch all but the first of a class are repeats already (kind 1), the rest kind 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False) if not batch.column(0).null_count else None
            valid = np.ones(batch.num_rows, bool) if doc is not None else ~np.asarray(batch.column(0).is_null())
            doc = doc if doc is not None else np.asarray(batch.column(0).fill_null(0))
            dig = batch.column(1).to_numpy(zero_copy_only=False)
            rank = np.empty(batch.num_rows, np.int64)
            rank[np.lexsort((dig, doc, valid))] = np.arange(batch.num_rows)
            found = []
            for t, offset, goes_on in slices(batch.column(2), 2 * min_len):
                own, at, key, context = anchors_of(t, min_len, powers)
                # contexts that the cut of a long text shortens are whole in the piece beside
                whole = ((at >= min_len) | (offset == 0)) & ((at + min_len <= len(t.data)) | (not goes_on))
                found.append(tuple(c[whole] for c in (own + t.first_row, at - t.bounds[own] + offset, key, context)))
            if not any(len(f[0]) for f in found):
                continue
            own, at, key, context = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((at, rank[own], context))
            own, at, key, context = own[order], at[order], key[order], context[order]
            later = np.append(False, context[1:] == context[:-1])
            same = np.append(False, (own[1:] == own[:-1]) & (at[1:] == at[:-1])) & later
            own, at, key, context, later = (c[~same] for c in (own, at, key, context, later))
            # repeats only pass by: spread over all keys
            key = np.where(later, mix(context ^ (own.astype(np.uint64) << np.uint64(20)) ^ at.astype(np.uint64)), key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(later.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(np.where(later, 0, context.view(np.int64))),
                 pa.array(doc[own], pa.int64(), mask=~valid[own]), pa.array(dig[own]), pa.array(at)],
                [c.split()[0] for c in ANCHOR.split(", ")],
            )

    return docs.select("doc_id", "dig", "text").mapInArrow(run, ANCHOR)


def sort_out(found: DataFrame) -> DataFrame:
    """Repeats of whole contexts (kind 1), and first members of classes whose piece others have too (kind 2).

    Rows are dealt by ranges of (key, class), so a piece met everywhere spreads over tasks; a piece at the edge of a
    range counts as one that others have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "key", "doc_id", "dig", "place"]
        held, last, linked = None, None, True  # first member of the last class, its row; whether its piece is shared
        for batch in batches:
            if not batch.num_rows:
                continue
            kind, key, cls = (batch.column(i).to_numpy() for i in range(3))
            doc, dig, place = batch.column(3), batch.column(4).to_numpy(), batch.column(5).to_numpy()
            rows = np.flatnonzero(kind == 0)
            passed = batch.select(["kind", "key", "doc_id", "dig", "place"]).filter(pa.array(kind == 1))
            if passed.num_rows:
                yield passed
            if not len(rows):
                continue
            k, c = key[rows], cls[rows]
            new = np.append(last is None or (k[0], c[0]) != last[:2], (k[1:] != k[:-1]) | (c[1:] != c[:-1]))
            # which row leads the class of each row; -1 is the one held over
            lead = np.maximum.accumulate(np.where(new, np.arange(len(rows)), -1))
            valid = ~np.asarray(doc.is_null())[rows]
            number = np.asarray(doc.fill_null(0))[rows]
            g, p = dig[rows], place[rows]
            if last is None:
                last = (k[0], c[0], valid[0], number[0], g[0], p[0])
            lv, ln, lg, lp = (np.append(x, last[i])[lead] for i, x in ((2, valid), (3, number), (4, g), (5, p)))
            repeat = ~new & ~((valid == lv) & (number == ln) & (g == lg) & (p == lp))
            if repeat.any():
                at = rows[repeat]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ones(len(at), np.int32)), batch.column(1).take(pa.array(at)), doc.take(pa.array(at)), batch.column(4).take(pa.array(at)),
                     batch.column(5).take(pa.array(at))], names)
            leads = np.flatnonzero(new)
            lk = k[leads]
            if held is not None and len(leads):
                if linked or lk[0] == held.column(1)[0].as_py():
                    yield held
            if len(leads):
                before = np.append(held is None or held.column(1)[0].as_py() == lk[0], lk[1:] == lk[:-1])
                shared = before.copy()
                shared[:-1] |= lk[:-1] == lk[1:]
                sure = rows[leads[:-1][shared[:-1]]]
                out = [pa.array(np.full(batch.num_rows, 2, np.int32)), *(batch.column(i) for i in (1, 3, 4, 5))]
                both = pa.RecordBatch.from_arrays(out, names)
                if len(sure):
                    yield both.take(pa.array(sure))
                held, linked = both.slice(int(rows[leads[-1]]), 1), bool(before[-1])
                i = leads[-1]
                last = (k[i], c[i], valid[i], number[i], g[i], p[i])
        if held is not None:
            yield held

    ordered = found.repartitionByRange("key", "class").sortWithinPartitions("key", "class", "doc_id", "dig", "place")
    return ordered.mapInArrow(run, "kind int, key bigint, doc_id bigint, dig bigint, place bigint")


# ---------------------------------------------------------------- the suffix array of one piece


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def neighbours(strings: list[bytes]) -> np.ndarray:
    """Common prefix of each string of a sorted list with the one before; 0 for the first."""
    out = np.zeros(len(strings), np.int64)
    for i in range(1, len(strings)):
        out[i] = common(strings[i - 1], strings[i])
    return out


def intervals(shared: np.ndarray, floor: int) -> Iterator[tuple[int, int, int]]:
    """(first, end, depth) of all common-prefix intervals of two members or more and a depth of ``floor`` or more.

    A scan with a stack of open intervals; an interval comes after those inside it.
    """
    stack: list[tuple[int, int]] = []
    n = len(shared)
    for i, depth in enumerate([*shared[1:].tolist(), floor - 1] if n else [], 1):
        start = i - 1
        while stack and stack[-1][1] > depth:
            start, deep = stack.pop()
            yield start, i, deep
        if depth >= floor and (not stack or stack[-1][1] < depth):
            stack.append((start, depth))


class Ranges:
    """Least value over ranges of an array."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << len(self.levels) - 1 <= len(values):
            low, half = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(np.minimum(low[:-half], low[half:]))

    def least(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        out = np.empty(len(start), np.int64)
        level = np.floor(np.log2(stop - start)).astype(np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.levels[k][start[at]], self.levels[k][stop[at] - (1 << k)])
        return out


def maximal_repeats(right: list[bytes], left: list[bytes], min_len: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """Members, left and right extent of every maximal repeat of ``min_len`` bytes or more.

    ``right`` is what follows each anchor, in sorted order; ``left`` what precedes it, nearest byte first.
    """
    if len(right) == 2:
        after, before = common(*right), common(*left)
        if after + before >= min_len:
            yield np.arange(2), before, after
        return
    index = np.arange(len(right))
    after = neighbours(right)
    by_left = sorted(range(len(left)), key=left.__getitem__)
    before = neighbours([left[i] for i in by_left])
    # whoever cannot reach the length even with the nearest member on either side has no part in a repeat
    while True:
        best_right = np.maximum(after, np.append(after[1:], 0))
        best_left = np.empty(len(index), np.int64)
        best_left[by_left] = np.maximum(before, np.append(before[1:], 0))
        keep = best_right + best_left >= min_len
        if keep.all():
            break
        if keep.sum() < 2:
            return
        rest = np.flatnonzero(keep)
        after = np.append(0, Ranges(after).least(rest[:-1] + 1, rest[1:] + 1))
        sides = np.flatnonzero(keep[by_left])
        before = np.append(0, Ranges(before).least(sides[:-1] + 1, sides[1:] + 1))
        renamed = np.cumsum(keep) - 1
        by_left = renamed[np.asarray(by_left)[sides]].tolist()
        index = index[rest]
    place = np.empty(len(index), np.int64)
    place[by_left] = np.arange(len(index))
    lefts = Ranges(before)
    longest = int(before.max(initial=0))
    for start, end, depth in intervals(after, max(1, min_len - longest)):
        member = start + np.argsort(place[start:end])
        ranks = place[member]
        shared = np.append(0, lefts.least(ranks[:-1] + 1, ranks[1:] + 1))
        # children of the interval: runs of members that share more than its depth
        child = np.append(0, np.cumsum(after[start + 1 : end] <= depth))[member - start]
        for a, b, extent in intervals(shared, max(0, min_len - depth)):
            some = child[a:b]
            if some.min() != some.max():
                yield index[member[a:b]], extent, depth


# ---------------------------------------------------------------- contexts and groups


def cut(candidates: DataFrame, docs: DataFrame, min_len: int) -> DataFrame:
    """key, doc_id, dig, place and the bytes after and before (nearest first) of every candidate anchor."""
    wanted = candidates.groupBy("doc_id", "dig").agg(F.collect_list(F.struct("key", "place")).alias("wanted"))
    texts = near_documents(docs, candidates)[0]
    w = wanted.withColumnRenamed("doc_id", "w_doc").withColumnRenamed("dig", "w_dig")
    met = texts.join(w, texts.doc_id.eqNullSafe(w.w_doc) & (texts.dig == w.w_dig)).select("doc_id", "dig", "text", "wanted")
    reach = min_len - PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                keys, rows, places, after, before = [], [], [], [], []
                lists = part.column(3)
                for i in range(part.num_rows):
                    body = part.column(2)[i].as_buffer()
                    body = memoryview(body).tobytes()
                    some = lists[i].values
                    key, where = some.field("key").to_numpy(), some.field("place").to_numpy()
                    for p in where.tolist():
                        after.append(body[p : p + min_len])
                        before.append(body[max(0, p - reach) : p][::-1])
                    keys.append(key)
                    places.append(where)
                    rows.append(np.full(len(key), i))
                if rows:
                    own = pa.array(np.concatenate(rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(keys)), part.column(0).take(own), part.column(1).take(own), pa.array(np.concatenate(places)),
                         pa.array(after, pa.binary()), pa.array(before, pa.binary())],
                        ["key", "doc_id", "dig", "place", "after", "before"],
                    )

    return met.mapInArrow(run, "key bigint, doc_id bigint, dig bigint, place bigint, after binary, before binary")


def near_documents(docs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents that a bounded Bloom filter of the rows' documents lets through, and the others.

    The filter only keeps texts out of a shuffle; more documents than it can tell apart all go through.
    """
    name = lambda: F.xxhash64("doc_id", "dig").alias("name")
    names = rows.select(name()).distinct()
    bits = filter_bits(names, names.count())

    def side(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                place = bit_places(batch.column(batch.num_columns - 1).to_numpy(), len(bits) * 8)
                met = (bits[place >> 3] >> (7 - (place & 7)) & 1).all(axis=1)
                yield batch.filter(pa.array(met == wanted)).select(docs_columns)

        return run

    docs_columns = docs.columns
    named = docs.select(*docs_columns, name())
    return tuple(named.mapInArrow(side(w), docs.schema) for w in (True, False))


def divide(contexts: DataFrame, min_len: int) -> DataFrame:
    """Each group as two sets of groups that share more bytes; a member too short for a side is not in that side's."""
    need = F.lit(min_len) - F.col("a") - F.col("b")
    half = F.ceil(need / 2).cast("int")
    sides = F.array(
        F.struct(F.lit("before").alias("side"), (F.col("a") + half).alias("a"), F.col("b").alias("b"), F.substring(F.col("before"), F.lit(1), F.col("a") + half).alias("s")),
        F.struct(F.lit("after").alias("side"), F.col("a").alias("a"), (F.col("b") + need - half + 1).alias("b"),
                 F.substring(F.col("after"), F.lit(1), F.col("b") + need - half + 1).alias("s")),
    )
    both = contexts.select("key", "doc_id", "dig", "place", "after", "before", F.explode(sides).alias("h"))
    both = both.where(F.length("h.s") == F.when(F.col("h.side") == "before", F.col("h.a")).otherwise(F.col("h.b")))
    return both.select(F.xxhash64("key", "h.side", "h.s").alias("key"), "doc_id", "dig", "place", "after", "before", "h.a", "h.b")


def groups_of_pieces(found: DataFrame, docs: DataFrame, min_len: int, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Contexts of the candidates in groups of at most ``most``, and spans (doc_id, dig, start, stop) of groups that
    share ``min_len`` bytes and are larger still."""
    contexts = cut(found, docs, min_len).withColumn("a", F.lit(0)).withColumn("b", F.lit(PIECE))
    columns = contexts.columns
    done, spans, keyed = None, None, found
    while True:
        large = keyed.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > most).select("key")
        if large.isEmpty():
            break
        contexts, large = materialize(contexts, "contexts"), materialize(large, "large")
        small = contexts.join(large, "key", "left_anti").select(*columns)
        done = small if done is None else done.unionByName(small)
        hot = contexts.join(large, "key", "left_semi").select(*columns)
        whole = hot.where(F.col("a") + F.col("b") == min_len)
        least = whole.groupBy("key").agg(F.min(F.struct("doc_id", "dig", "place")).alias("first"))
        later = whole.join(least, "key").where(~F.struct("doc_id", "dig", "place").eqNullSafe(F.col("first")))
        later = later.select("doc_id", "dig", (F.col("place") - F.col("a")).alias("start"), (F.col("place") + F.col("b")).alias("stop"))
        spans = later if spans is None else spans.unionByName(later)
        contexts = keyed = divide(hot.where(F.col("a") + F.col("b") < min_len), min_len)
    done = contexts if done is None else done.unionByName(contexts)
    return done, spans


def over_groups(contexts: DataFrame, min_len: int, emit, schema: str) -> DataFrame:
    """Rows that ``emit(doc_ids, digs, places, repeats)`` finds for each piece, whose sorted suffixes stream past."""
    ordered = contexts.repartition("key").sortWithinPartitions("key", "after", "doc_id", "dig", "place")
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], [], [], []]
        rows: list[dict] = []

        def close() -> None:
            if len(held[0]) > 1:
                rows.extend(emit(*held[1:4], maximal_repeats(held[4], held[5], min_len)))
            for part in held:
                part.clear()

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "doc_id", "dig", "place", "after", "before")]
            key = batch.column(0).to_numpy()
            edges = (np.flatnonzero(key[1:] != key[:-1]) + 1).tolist()
            for a, b in zip([0, *edges], [*edges, len(key)], strict=True):
                if held[0] and a < b and held[0][0] != columns[0][a]:
                    close()
                for part, column in zip(held, columns, strict=True):
                    part.extend(column[a:b])
            if len(rows) >= 2_000:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                rows = []
        close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return ordered.mapInArrow(run, schema)


def later_spans(contexts: DataFrame, min_len: int) -> DataFrame:
    """doc_id, dig, start and stop of what each anchor's later occurrences of maximal repeats cover."""

    def emit(doc: list, dig: list, place: list, repeats) -> Iterator[dict]:
        rank = None
        for member, before, after in repeats:
            if rank is None:
                rank = np.empty(len(doc), np.int64)
                rank[sorted(range(len(doc)), key=lambda i: (doc[i] is not None, doc[i] or 0, dig[i], place[i]))] = np.arange(len(doc))
                left, right = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
            later = np.delete(member, rank[member].argmin())
            left[later] = np.maximum(left[later], before)
            right[later] = np.maximum(right[later], after)
        if rank is not None:
            for i in np.flatnonzero(right).tolist():
                yield {"doc_id": doc[i], "dig": dig[i], "start": place[i] - int(left[i]), "stop": place[i] + int(right[i])}

    return over_groups(contexts, min_len, emit, "doc_id bigint, dig bigint, start bigint, stop bigint")


def arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def told_apart(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, dig and text of every different row, and their number n; dig is the text's hash where ids repeat, else 0."""
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return docs.select("doc_id", F.lit(0).cast("bigint").alias("dig"), "text", F.lit(1).cast("bigint").alias("n"))
    docs = docs.groupBy("doc_id", F.xxhash64("text").alias("dig")).agg(F.first("text").alias("text"), F.count("*").alias("n"))
    return materialize(docs, "documents")


def candidates(docs: DataFrame, min_len: int) -> DataFrame:
    if min_len <= PIECE:
        raise ValueError(f"repeats must be longer than {PIECE} bytes")
    return materialize(sort_out(anchors(docs, min_len)), "anchors")


def maximal_groups(docs: DataFrame, min_len: int = 100, most: int = MOST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every maximal repeat as seen from each anchor in it: length, and all occurrences (doc_id, start).

    Occurrences are those of distinct contexts: the later places of one context stand in ``copies`` of its first.
    """
    told = told_apart(docs, doc_id, text)
    sorted_out = candidates(told, min_len)
    contexts, _ = groups_of_pieces(sorted_out.where("kind = 2"), told, min_len, most)

    def emit(doc: list, dig: list, place: list, repeats) -> Iterator[dict]:
        for member, before, after in repeats:
            yield {"length": before + after, "occurrences": [{"doc_id": doc[i], "start": place[i] - before} for i in member.tolist()]}

    return over_groups(contexts, min_len, emit, "length bigint, occurrences array<struct<doc_id: bigint, start: bigint>>")


def repeated_spans(docs: DataFrame, min_len: int, most: int) -> DataFrame:
    """doc_id, dig, start and stop of stretches that also stand earlier; they overlap, and may pass a text's ends."""
    sorted_out = candidates(docs, min_len)
    whole = sorted_out.where("kind = 1").select("doc_id", "dig", (F.col("place") - (min_len - PIECE)).alias("start"), (F.col("place") + min_len).alias("stop"))
    contexts, spans = groups_of_pieces(sorted_out.where("kind = 2"), docs, min_len, most)
    spans = later_spans(contexts, min_len) if spans is None else spans.unionByName(later_spans(contexts, min_len))
    return whole.unionByName(spans)


def remove(docs: DataFrame, min_len: int = 100, most: int = MOST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (the removed runs, array of start and stop) and kept (the remaining bytes) of every row."""

    def columns(body: bytes, runs: list[tuple[int, int]]) -> dict:
        return {"spans": [{"start": a, "stop": b} for a, b in runs], "kept": rest(body, runs)}

    return _finished(docs, min_len, most, doc_id, text, columns, "spans array<struct<start: bigint, stop: bigint>>, kept binary")


def digest(docs: DataFrame, min_len: int = 100, most: int = MOST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row, without sending texts out of the task."""

    def columns(body: bytes, runs: list[tuple[int, int]]) -> dict:
        kept = hashlib.sha256(rest(body, runs)).hexdigest()
        return {"n_removed": sum(b - a for a, b in runs), "n_spans": len(runs), "kept_sha256": kept}

    return _finished(docs, min_len, most, doc_id, text, columns, "n_removed bigint, n_spans bigint, kept_sha256 string")


def rest(body: bytes, runs: list[tuple[int, int]]) -> bytes:
    cuts = [0, *(x for run in runs for x in run), len(body)]
    return b"".join(body[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))


def merged(start: np.ndarray, stop: np.ndarray, size: int) -> list[tuple[int, int]]:
    """The union of spans as maximal runs."""
    start, stop = np.maximum(start, 0), np.minimum(stop, size)
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    new = np.append(True, start[1:] > stop[:-1])
    ends = np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)
    return list(zip(start[new].tolist(), stop[ends].tolist(), strict=True))


def _finished(docs: DataFrame, min_len: int, most: int, doc_id: str, text: str, columns, fields: str) -> DataFrame:
    told = told_apart(docs, doc_id, text)
    spans = materialize(repeated_spans(told, min_len, most), "spans")
    near, far = near_documents(told, spans)
    lists = spans.groupBy(F.col("doc_id").alias("s_doc"), F.col("dig").alias("s_dig")).agg(F.collect_list(F.struct("start", "stop")).alias("found"))
    met = near.join(lists, near.doc_id.eqNullSafe(lists.s_doc) & (near.dig == lists.s_dig), "left").select("doc_id", "text", "n", "found")
    none = F.lit(None).cast("array<struct<start: bigint, stop: bigint>>").alias("found")
    schema = f"doc_id bigint, n_bytes bigint, {fields}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows = []
                for doc, n, body, found in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(1), part.column(3), strict=True):
                    body = body.as_py().encode()
                    runs = []
                    if found.is_valid and len(found.values):
                        runs = merged(found.values.field("start").to_numpy(), found.values.field("stop").to_numpy(), len(body))
                    own = {"doc_id": doc, "n_bytes": len(body)}
                    rows.append(own | columns(body, runs))
                    if n > 1:
                        copy = own | columns(body, [(0, len(body))] if len(body) >= min_len else [])
                        rows.extend([copy] * (n - 1))
                    if len(rows) >= 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    arrow = arrow_schema(schema)
    return met.unionByName(far.select("doc_id", "text", "n", none)).mapInArrow(run, schema)
