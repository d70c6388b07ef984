"""A stored index of three-byte pieces, to find the rows whose text holds a term anywhere, as a part of a word, too.

A row that holds a term holds all of its pieces. The index keeps, for each piece, lists of the numbers of the rows that
hold it, one for each batch of rows, in folders by the piece; a lookup reads the folders of the terms' pieces, keeps the
rows that have all of them, and only these are tested. Terms of fewer than three bytes have no piece, and are tested on
all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .word_index import sent

#: Bytes of a piece, and folders of the stored index.
PIECE, FOLDERS = 3, 64


def distinct_pieces(texts: pa.Array) -> list[np.ndarray]:
    """The distinct pieces of the UTF-8 bytes of each text, as numbers in order."""
    out = []
    for value in texts:
        raw = np.frombuffer(value.as_buffer(), np.uint8).astype(np.int32) if value.is_valid else np.zeros(0, np.int32)
        out.append(np.unique(raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) if len(raw) >= PIECE else raw[:0])
    return out


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, parts)]).astype(np.int32), pa.array(np.concatenate([np.zeros(0, np.int32), *parts]), kind))


def pieces(text: Column) -> Column:
    """The distinct pieces of a text's UTF-8 bytes, each as a number."""
    return F.arrow_udf(lambda texts: lists(distinct_pieces(texts), pa.int32()), "array<int>")(text)


def _folder(piece: Column) -> Column:
    return F.pmod(piece, F.lit(FOLDERS)).cast("int")


def write_pieces(rows: DataFrame, path: str, number: str, text: str) -> None:
    """Store the pieces of the rows' texts in lower case; number: a column of whole numbers that tells rows apart.

    Each task turns its batches of rows into lists of numbers and adds a segment to each folder, so no piece moves, and one
    that most texts hold is spread over as many segments as there are tasks.
    """

    def turn(batches):
        for batch in batches:
            numbers = batch.column("number").to_numpy(zero_copy_only=False)
            found = distinct_pieces(batch.column("body"))
            owner = np.repeat(np.arange(len(found)), list(map(len, found)))
            piece = np.concatenate([np.zeros(0, np.int32), *found])
            order = np.argsort(piece, kind="stable")
            piece, owner = piece[order], owner[order]
            first = np.flatnonzero(np.diff(piece, prepend=-1))
            # ends are 32 bits wide: a batch has at most as many pieces as bytes
            held = pa.ListArray.from_arrays(np.append(first, len(piece)).astype(np.int32), pa.array(numbers[owner], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(piece[first], pa.int32()), held], names=["piece", "numbers"])

    told = rows.select(F.col(number).cast("long").alias("number"), F.lower(F.col(text)).alias("body")).where("number is not null")
    turned = told.mapInArrow(turn, "piece int, numbers array<long>").withColumn("folder", _folder(F.col("piece")))
    turned.sortWithinPartitions("folder", "piece").write.mode("overwrite").partitionBy("folder").parquet(path)


def rows_to_test(spark: SparkSession, path: str, terms: DataFrame, rows: DataFrame, number: str) -> DataFrame:
    """term, number of the rows that hold all pieces of a term; terms: term, in lower case, each once."""
    long, short = _asked(terms)
    every = rows.select(F.col(number).cast("long").alias("number")).where("number is not null").withColumn("term", F.explode(F.lit(short).cast("array<string>")))
    return _held(spark, path, long).union(every.select("term", "number"))


def _asked(terms: DataFrame) -> tuple[DataFrame, list[str]]:
    """Terms with their pieces, and those that have none; of these there are no more than pairs of bytes."""
    cut = terms.where("term <> ''").withColumn("pieces", pieces(F.col("term")))
    return cut.where(F.size("pieces") > 0), [r.term for r in cut.where(F.size("pieces") == 0).select("term").distinct().collect()]


def _held(spark: SparkSession, path: str, long: DataFrame) -> DataFrame:
    """term, number of the stored rows that hold all pieces of a term."""
    asked = long.select("term", F.size("pieces").alias("need"), F.explode("pieces").alias("piece")).withColumn("folder", _folder(F.col("piece")))
    hits = spark.read.parquet(path).join(sent(asked), ["folder", "piece"]).select("term", "need", F.explode("numbers").alias("number"))
    return hits.groupBy("term", "need", "number").agg(F.count("*").alias("got")).where("got = need").select("term", "number")


def rows_with(spark: SparkSession, path: str, terms: DataFrame, rows: DataFrame, number: str, text: str) -> DataFrame:
    """term, number for each row whose text, in lower case, holds a term; only rows_to_test are looked at.

    A text moves once, to all terms that are to be tested on it; the terms without a piece are tested where it lies.
    """
    long, short = _asked(terms)
    texts = rows.select(F.col(number).cast("long").alias("number"), F.lower(F.col(text)).alias("body")).where("number is not null")
    asked = _held(spark, path, long).groupBy("number").agg(F.collect_list("term").alias("terms"))
    holds = lambda told, asked_: told.select(F.explode(F.filter(asked_, lambda t: F.col("body").contains(t))).alias("term"), "number")
    return holds(texts.join(asked, "number"), F.col("terms")).union(holds(texts, F.lit(short).cast("array<string>")))
