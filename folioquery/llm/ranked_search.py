"""Ranked lexical search of many items at once, by shared partial sums.

1. The items, in blocks of bounded size, are sets of terms. Terms that stand next to each other in two items or more,
   once all are put in one order, become a shared set with a number of its own; so do pairs of sets, until none is
   shared: a graph in which a set is the sum of two others, and an item the sum of a few sets.
2. One pass over all texts counts their terms and finds the items' terms: a written table of postings by document.
3. One pass over the postings: for some documents at a time, each set's partial sums are worked out once, from those
   of the sets below it, and each item adds up its sets. A task keeps the best of each item.
4. The best of all tasks are ranked in two steps.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import quoted, release, small_batches, written

#: Documents returned for an item; bytes of the items of a block, about; sums held at a time; best rows of tasks ranked together.
TOP, BLOCK_BYTES, CELLS, TASKS = 10, 1 << 20, 1 << 22, 64
#: Letters and digits stay, A-Z as a-z; other ASCII characters separate terms; all others belong to terms.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(raw: bytes) -> list[bytes]:
    return raw.translate(TERMS).split()


@dataclass
class Sharing:
    """terms: their rows come first. left, right: the two rows that each further row is the sum of, a list for each
    level; items: the rows that each item is the sum of."""

    terms: list[bytes]
    left: list[np.ndarray] = field(default_factory=list)
    right: list[np.ndarray] = field(default_factory=list)
    items: list[np.ndarray] = field(default_factory=list)

    @property
    def rows(self) -> int:
        return len(self.terms) + sum(map(len, self.left))


def shared_sets(queries: list[list[bytes]]) -> Sharing:
    """The graph of shared term sets of some items. A term that an item repeats is in it as often, as different members."""
    terms: dict[bytes, int] = {}
    members: dict[tuple[int, int], int] = {}
    sets = []
    for query in queries:
        counts = Counter(terms.setdefault(t, len(terms)) for t in query)
        sets.append([members.setdefault((t, k), len(members)) for t, n in counts.items() for k in range(n)])
    held = np.bincount(np.concatenate([np.zeros(0, np.int64), *(np.array(s, np.int64) for s in sets)]), minlength=len(members))
    place = np.empty(len(members), np.int64)
    place[np.argsort(-held, kind="stable")] = np.arange(len(members))
    # one array of all items, members in the common order, -1 behind each item
    flat = np.array([x for s in sets for x in [*sorted(s, key=place.__getitem__), -1]], np.int64)
    row = np.array([t for t, _ in members], np.int64)
    out = Sharing(list(terms))
    while len(flat) > 1:
        both = np.flatnonzero((flat[:-1] >= 0) & (flat[1:] >= 0))
        pairs, counts = np.unique(flat[both] * len(row) + flat[both + 1], return_counts=True)
        shared = np.flatnonzero(counts > 1)
        if not len(shared):
            break
        # the most frequent first; none that touches a chosen one
        partner = np.full(len(row), -2, np.int64)
        named, busy = np.full(len(row), -1, np.int64), set()
        chosen = []
        for pair in pairs[shared[np.argsort(-counts[shared], kind="stable")]].tolist():
            a, b = divmod(pair, len(row))
            if a not in busy and b not in busy:
                busy |= {a, b}
                partner[a], named[a] = b, len(row) + len(chosen)
                chosen.append((a, b))
        here = both[partner[flat[both]] == flat[both + 1]]
        flat[here] = named[flat[here]]
        flat = np.delete(flat, here + 1)
        left, right = np.array(chosen, np.int64).T
        out.left.append(row[left])
        out.right.append(row[right])
        row = np.append(row, out.rows - len(chosen) + np.arange(len(chosen)))
    ends = np.flatnonzero(flat < 0)
    out.items = [row[flat[a:b]] for a, b in zip(np.append(0, ends[:-1] + 1), ends)] if len(ends) else []
    return out


def postings(docs: DataFrame, id_column: str, text: str, terms: list[bytes]) -> DataFrame:
    """id, n (terms of the text), terms (numbers of those among `terms`) and counts, one row per document; written."""
    numbers = {t: k for k, t in enumerate(terms)}

    def counted(texts: pa.Array) -> pa.Array:
        release()
        sizes, owners, found = np.zeros(len(texts), np.int64), [], []
        for k, value in enumerate(texts):
            if value.is_valid:
                words = terms_of(value.as_buffer().to_pybytes())
                sizes[k] = len(words)
                hits = [x for x in map(numbers.get, words) if x is not None]
                found.extend(hits)
                owners.append((k, len(hits)))
        keys = np.repeat([k for k, _ in owners], [n for _, n in owners]).astype(np.int64) * max(1, len(terms)) + np.array(found, np.int64)
        keys, counts = np.unique(keys, return_counts=True)
        offsets = np.searchsorted(keys, np.arange(len(texts) + 1) * max(1, len(terms))).astype(np.int32)
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (keys % max(1, len(terms)), counts)]
        return pa.StructArray.from_arrays([pa.array(sizes), *(x.cast(pa.list_(pa.int32())) for x in lists)], names=["n", "terms", "counts"])

    count = F.arrow_udf(counted, "n bigint, terms array<int>, counts array<int>").asNondeterministic()
    told = small_batches(docs).select(F.col(quoted(id_column)).alias("id"), F.col(quoted(text)).alias("body")).withColumn("found", count("body"))
    return written(told.select("id", "found.*"), "postings")


def part_of(counts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A term's share of its weight, for its occurrences in documents of a relative length."""
    return 1_000_000_000 * counts // (1000 * counts + 8 * length)


def relative_length(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """100 for a text of mean length, a quarter of it at least; beyond 64 bits by integers of any length."""
    if len(n) and 75 * int(n.max()) * docs >= 2**63:
        return np.array([100 - 75 + 75 * x * docs // total for x in n.tolist()], np.int64)
    return 100 - 75 + 75 * n * docs // total


def best_of(found: DataFrame, sharing: Sharing, weights: np.ndarray, docs: int, total: int, top: int) -> DataFrame:
    """task, item (its number in the block), id, score: the best documents of each item in each task."""
    step = max(1, CELLS // max(1, sharing.rows))
    flat = np.concatenate([np.zeros(0, np.int64), *sharing.items]).astype(np.int64)
    sizes = np.array([len(x) for x in sharing.items], np.int64)
    filled = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[filled]

    def scored(batches):
        release()
        nothing = np.zeros(0, np.int64)
        item, score, absent, ids = nothing, nothing, nothing, nothing
        bar = np.ones(len(sharing.items), np.int64)  # what a document has to reach for an item
        for batch in batches:
            n = batch.column("n").to_numpy()
            lists = batch.column("terms")
            offsets = lists.offsets.to_numpy()
            terms, counts = lists.values.to_numpy(), batch.column("counts").values.to_numpy().astype(np.int64)
            size = np.diff(offsets)
            owner = np.repeat(np.arange(len(n)), size)
            span = slice(offsets[0], offsets[-1])
            terms, counts = terms[span], counts[span]
            parts = weights[terms] * part_of(counts, relative_length(n, docs, total)[owner])
            unknown = batch.column("id").is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            known = batch.column("id").fill_null(0).to_numpy()
            for low in range(0, len(n), step):
                high = min(low + step, len(n))
                own = slice(offsets[low] - offsets[0], offsets[high] - offsets[0])
                sums = np.zeros((sharing.rows, high - low), np.int64)
                sums[terms[own], owner[own] - low] = parts[own]
                at = len(sharing.terms)
                for left, right in zip(sharing.left, sharing.right):
                    sums[at : at + len(left)] = sums[left] + sums[right]
                    at += len(left)
                scores = np.zeros((len(sizes), high - low), np.int64)
                if len(flat):
                    scores[filled] = np.add.reduceat(sums[flat], starts, axis=0)
                who, where = np.nonzero(scores >= bar[:, None])
                item, score = np.append(item, who), np.append(score, scores[who, where])
                absent, ids = np.append(absent, unknown[low + where]), np.append(ids, known[low + where])
                if len(item) > 2 * top * len(sizes):
                    order = np.lexsort((ids, absent, -score, item))
                    item, score, absent, ids = item[order], score[order], absent[order], ids[order]
                    rank = np.arange(len(item)) - np.searchsorted(item, item)
                    last = rank == top - 1
                    bar[item[last]] = score[last]
                    item, score, absent, ids = (x[rank < top] for x in (item, score, absent, ids))
        order = np.lexsort((ids, absent, -score, item))
        order = order[np.arange(len(order)) - np.searchsorted(item[order], item[order]) < top]
        task = np.full(len(order), TaskContext.get().partitionId(), np.int64)
        columns = [pa.array(task), pa.array(item[order]), pa.array(ids[order], mask=absent[order] > 0), pa.array(score[order])]
        yield pa.RecordBatch.from_arrays(columns, names=["task", "item", "id", "score"])

    return found.mapInArrow(scored, "task bigint, item bigint, id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text", item_column: str = "item_id", item_text: str = "text", top: int = TOP) -> DataFrame:
    """item (under item_column's name), rank, the document's id (under id_column's name), score: each item's best documents.

    Terms are runs of ASCII letters, digits and all characters beyond ASCII, A-Z lower-cased. A document's score is the
    sum over the item's terms, repeats included, of the term's weight times its share there (part_of), in integers;
    only scores above 0 count. Equal scores come by ascending id, null ids last, and repeated rows are documents of
    their own. Ids of documents are integers. Each row of items is an item, repeated ones too. A null text has no
    terms: such a document is found by none and counts in no mean, such an item finds none. Empty tables give no
    rows. Other columns don't matter, whatever their names.
    """
    spark = items.sparkSession
    if not isinstance(docs.schema[id_column].dataType, LongType):
        docs = docs.withColumn(id_column, F.col(quoted(id_column)).cast("long"))
    asked = items.select(F.col(quoted(item_column)).alias("asked"), F.col(quoted(item_text)).alias("words"), F.monotonically_increasing_id().alias("row"))
    asked = written(asked.where("words is not null"), "items")
    blocks = max(1, -(-int(asked.agg(F.sum(F.octet_length("words"))).first()[0] or 0) // BLOCK_BYTES))
    results, whole = [], None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).orderBy("row").collect()
        sharing = shared_sets([terms_of(r.words.encode("utf-8", "surrogatepass")) for r in rows])
        found = postings(docs, id_column, text, sharing.terms)
        if whole is None:
            whole = found.where("n > 0").agg(F.count("*"), F.sum("n")).first()
        count, total = whole[0], whole[1] or 1
        held = np.zeros(len(sharing.terms), np.int64)
        for term, n in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            held[term] = n
        weights = np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * n + 1))) for n in held.tolist()], np.int64)
        best = best_of(found, sharing, weights, count, total, top)
        names = spark.createDataFrame([(k, r.row) for k, r in enumerate(rows)], "item bigint, row bigint")
        results.append(best.join(F.broadcast(names), "item").drop("item"))
    merged = results[0]
    for other in results[1:]:
        merged = merged.union(other)

    order = [F.desc("score"), F.asc_nulls_last("id")]
    some = Window.partitionBy("row", "share").orderBy(*order)
    merged = merged.withColumn("share", F.pmod("task", F.lit(TASKS))).withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    ranked = merged.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(asked.drop("words"), "row").select(F.col("asked").alias(item_column), "rank", F.col("id").alias(id_column), "score")
