"""Packing documents into sequences of a fixed number of tokens.

Martello and Toth's reduction fixes bins that dominate every other choice for their largest item; best-fit
decreasing packs the rest. Both need only how many pieces there are of each length, a table of at most
`capacity` rows whatever the input, so one plan covers the whole corpus. The plan is a list of bin kinds
with counts; pieces find their places by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, small_batches, trim, written
from .token_shards import encoder

#: Rows of a group within which ranks are counted.
GROUP = 200_000
#: Words that a worker remembers; fewer than the shards' writer, since packing may follow other stages in one session.
MEMORY = 200_000


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; documents over capacity are cut, the first piece taking what is left over."""

    def cut(batches):
        enc = encoder(tokenizer, MEMORY)
        for batch in batches:
            out = ([], [], [], [], [])
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(enc.encode(text.as_py()), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                edges = [0, *range(min(first, len(ids)), len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    for column, value in zip(out, (number, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
            trim()

    texts = small_batches(docs).select(F.col(quoted(id_column)).cast("long").alias("doc_id"), F.coalesce(F.col(quoted(text_column)), F.lit("")).alias("text"))
    return texts.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def longest_pair(some: list[int], counts: list[int], w: int, room: int) -> int:
    """The largest sum within room of two pieces beside one of length w; some: the lengths that there are."""
    found = 0
    for x in some:
        at = bisect_left(some, room - x + 1) - 1
        if at >= 0 and some[at] >= x and (some[at] > x or counts[x] - (x == w) > 1):
            found = max(found, x + some[at])
    return found


def reduce_by_dominance(counts: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix bins as Martello and Toth's procedure does, largest lengths first; counts is left with the rest.

    With the longest piece w and the pieces that fit beside it: none fit, or one completes the bin, or only one
    fits at a time: that bin (with the longest that fits) dominates. Two fit but no three, and the longest
    that fits is as long as the best pair: so does the bin with it.
    """
    fixed = []
    for w in range(capacity, 0, -1):
        while counts[w]:
            counts[w] -= 1
            room = capacity - w
            some = [x for x in range(1, room + 1) if counts[x]]
            counts[w] += 1
            if not some:
                fixed.append(((w,), 1 if 2 * w <= capacity else counts[w]))
                counts[w] -= fixed[-1][1]
                continue
            low: list[int] = []
            for x in some[:3]:
                low += [x] * min(3 - len(low), counts[x] - (x == w))
            best = some[-1]
            alone = len(low) < 2 or low[0] + low[1] > room
            if not (best == room or alone):
                if len(low) > 2 and sum(low) <= room:
                    break
                if best < longest_pair(some, counts, w, room):
                    break
            number = counts[w] // 2 if best == w else min(counts[w], counts[best])
            fixed.append(((w, best), number))
            counts[w] -= number
            counts[best] -= number
    return fixed


def best_fit(counts: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts of lengths; bins that hold the same are kept as one kind with a count."""
    kinds: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(held: tuple[int, ...], room: int, n: int) -> None:
        if n:
            if room not in kinds:
                kinds[room] = []
                insort(rooms, room)
            kinds[room].append((held, n))

    for w in range(capacity, 0, -1):
        left = counts[w]
        while left:
            at = bisect_left(rooms, w)
            if at == len(rooms):
                each = capacity // w
                put((w,) * each, capacity - each * w, left // each)
                put((w,) * (left % each), capacity - left % each * w, int(left % each > 0))
                break
            room = rooms[at]
            held, n = kinds[room].pop()
            if not kinds[room]:
                del kinds[room], rooms[at]
            each = room // w
            full = min(n, left // each)
            put(held + (w,) * each, room - each * w, full)
            left -= full * each
            n -= full
            if n and left:
                put(held + (w,) * left, room - left * w, 1)
                left, n = 0, n - 1
            put(held, room, n)
    return [kind for room in rooms for kind in kinds[room]]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    counts = [histogram.get(n, 0) for n in range(capacity + 1)]
    return reduce_by_dominance(counts, capacity) + best_fit(counts, capacity)


def places(bins: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: from rank, first sequence, pieces of the length per bin, offset of the first of them.

    Pieces of a length stand side by side in a bin, so rank - from gives the bin and the place.
    """
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for held, n in bins:
        offset = 0
        for w in dict.fromkeys(held):
            each = held.count(w)
            rows.setdefault(w, []).append((used.get(w, 0), sequence, each, offset))
            used[w] = used.get(w, 0) + each * n
            offset += each * w
        sequence += n
    return {w: tuple(np.array(x, np.int64) for x in zip(*r)) for w, r in rows.items()}


def pack(cut: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, length, ...).

    Ranks: rows of a length are dealt to groups by a hash of the document, groups are counted, and a row's rank
    is the sum of the groups before and its number in its own group. No length gathers in one task.
    """
    cut = written(cut, "pieces")
    histogram = {r.length: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    groups = max(1, -(-sum(histogram.values()) // GROUP)) * 8
    where = places(plan(histogram, capacity))
    cut = cut.withColumn("_g", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    sums = cut.groupBy("length", "_g").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("length", "_g", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    own = Window.partitionBy("length", "_g").orderBy("doc_id", "piece")
    ranked = cut.withColumn("_i", F.row_number().over(own) - 1).join(base, ["length", "_g"]).withColumn("_rank", F.col("_base") + F.col("_i"))
    ranked = ranked.select(*[c for c in cut.columns if c != "_g"], "_rank")

    def put(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for w in np.unique(length):
                rows = np.flatnonzero(length == w)
                start, first, each, at = where[int(w)]
                k = np.searchsorted(start, rank[rows], side="right") - 1
                number = rank[rows] - start[k]
                sequence[rows] = first[k] + number // each[k]
                offset[rows] = at[k] + number % each[k] * w
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    names = [c for c in ranked.columns if c != "_rank"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "_rank")
    return ranked.mapInArrow(put, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece with its sequence and offset.

    A null or empty text is the end id alone. Repeated rows are packed each by itself; a null number packs
    like any other. Other columns of docs are not used. An empty table gives no rows.
    """
    return pack(pieces(docs, tokenizer, capacity, end_id), capacity)
