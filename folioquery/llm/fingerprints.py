"""Winnowing: fingerprints of documents, and each document's likeness to its edited text and its neighbour.

Rolling hashes of GRAM code points; of every WINDOW neighbouring ones the smallest is kept, of equal ones
the rightmost, with its position. Two texts that share GRAM + WINDOW - 1 code points in a row share a
selected hash. A text shorter than a gram has one hash, of all of it; an empty text has none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, slots, small_batches
from .rolling import Prefix, winnow

GRAM, WINDOW = 24, 100
#: Text bytes of a range of documents that one task follows in order.
RANGE = 16 << 20
#: Ranges that are enough for any input: their cut points go to the driver, and tasks read them as a stream.
RANGES = 10_000


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def fingerprint(points: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(positions, 32-bit hashes) of the selected grams, by position."""
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    grams = Prefix(points).windows(min(gram, len(points)))
    at = np.unique(winnow(grams, min(window, len(grams))))
    return at, (grams[at] >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index of two sets of hashes; two empty ones are alike."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def shown(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """id, positions array<long>, hashes array<long>: the fingerprint of every text; a null text is empty."""

    def run(batches):
        for batch in batches:
            found = [fingerprint(code_points(t.as_py()), gram, window) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.tolist() for p, _ in found], pa.list_(pa.int64())), pa.array([h.tolist() for _, h in found], pa.list_(pa.int64()))], names=["id", "positions", "hashes"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(quoted(id_column)).alias("id"), F.coalesce(F.col(quoted(text_column)), F.lit("")).alias("text")).mapInArrow(run, f"id {kind}, positions array<long>, hashes array<long>")


def compare_with_next(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Compare every document with its edited text and with the next document, in descending number.

    The edited text is the document with its last half replaced by as much of the next one's beginning; after
    the last document comes the first. Null numbers come last; rows of equal number are ordered by text. A
    null text is empty. A table of one row is its own neighbour; an empty table gives no rows.

    Documents are dealt to ranges of numbers, one task reads a range in order, and each range also gets the
    first document of the range that follows, so every text is shuffled once. positions and edited_positions tell where
    the grams of the two fingerprints start, in code points and in the order of their hashes.
    """
    spark = docs.sparkSession
    rows = small_batches(docs).select(F.col(quoted(id_column)).cast("long").alias("id"), F.coalesce(F.col(quoted(text_column)), F.lit("")).alias("text"))
    told = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).first()
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions array<long>, edited_positions array<long>"
    if not told["n"]:
        return spark.createDataFrame([], schema)
    count = max(slots(docs), min(RANGES, -(-told["size"] // RANGE)))
    cuts = np.array(sorted(set(rows.agg(F.percentile_approx("id", [(k + 1) / count for k in range(count - 1)] or [0.5], 100 * count)).first()[0] or [])), np.int64)

    @F.pandas_udf("int")
    def range_of(ids):
        # null numbers go with the smallest: ranges are numbered in descending order of number
        import pandas as pd

        null = ids.isna().to_numpy()
        return pd.Series(np.where(null, len(cuts), len(cuts) - np.searchsorted(cuts, ids.fillna(0).astype("int64").to_numpy(), side="left"))).astype("int32")

    placed = rows.withColumn("range", range_of("id"))
    tops = {r["range"]: r["top"] for r in placed.groupBy("range").agg(F.max("id").alias("top")).collect()}
    order = sorted(tops)
    before = {b: a for a, b in zip([order[-1], *order], order)}
    heads = spark.createDataFrame([(r, tops[r], before[r]) for r in order], "head_range int, top long, range int")
    # the first document of a range; of rows with the same number the one with the smallest text
    first = placed.withColumnRenamed("range", "head_range").join(F.broadcast(heads), "head_range").where(F.col("id").eqNullSafe(F.col("top")))
    first = first.groupBy("range").agg(F.first("top").alias("id"), F.min("text").alias("text"))
    both = placed.select("range", "id", "text", F.lit(0).alias("tail")).union(first.select("range", "id", "text", F.lit(1).alias("tail")))
    # a range is a partition, so that no task gets two where another has none
    ordered = both.repartitionById(len(cuts) + 1, F.col("range")).sortWithinPartitions("range", "tail", F.col("id").desc_nulls_last(), "text")

    def run(batches):
        held = None
        for batch in batches:
            out = []
            for number, text, tail in zip(batch.column("id").to_pylist(), batch.column("text"), batch.column("tail").to_pylist()):
                points = code_points(text.as_py())
                own = None if tail else fingerprint(points, gram, window)
                if held is not None:
                    old, old_points, old_own = held
                    half = len(old_points) // 2
                    edited = np.concatenate([old_points[: len(old_points) - half], points[:half]])
                    at, changed = fingerprint(edited, gram, window)
                    beside = (own or fingerprint(points, gram, window))[1]
                    digest = hashlib.sha256(edited.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((old, len(old_points), digest, shown(old_own[1]), shown(changed), likeness(old_own[1], changed), likeness(old_own[1], beside), old_own[0], at))
                held = None if tail else (number, points, own)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], names=names)

    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "positions", "edited_positions"]
    return ordered.mapInArrow(run, schema)
