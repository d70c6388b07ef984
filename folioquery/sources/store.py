"""A stored table of chunks that is changed by key, a folder at a time.

Rows lie in folders by a hash of their source and, so that a large source has several, by a hash of their id. A change
reads and rewrites the folders of the rows that it names; all other files stay as they are. What a folder will hold is
worked out and written to the shared folder first, and then replaces the old files by Spark's dynamic overwrite, so a
failure on the way leaves the table as it was. Each written folder has a row without an id, which readers leave out:
a folder that has lost all of its rows is replaced like any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .pages import delete_source, insert_chunks, scratch, upsert_chunks

#: Folders by source, and in each of these by id.
SOURCES, IDS = 16, 8
PLACE = ["source_folder", "id_folder"]


def source_folder(source: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(source, F.lit(""))), F.lit(SOURCES)).cast("int")


def in_folders(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumns({"source_folder": source_folder(F.col("source")), "id_folder": F.pmod(F.xxhash64(key, F.lit(1)), F.lit(IDS)).cast("int")})


def _replace(rows: DataFrame, folders: DataFrame, path: str, key: str) -> None:
    """Write rows as all that `folders` hold."""
    spark = rows.sparkSession
    blank = folders.select(*[(F.col(c) if c in PLACE else F.lit(None).cast(rows.schema[c].dataType)).alias(c) for c in rows.columns])
    ready = scratch(spark, "ready")
    rows.union(blank).write.parquet(ready)
    spread = spark.read.schema(rows.schema).parquet(ready).repartition(*PLACE).sortWithinPartitions(*PLACE, "source", key)
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PLACE).parquet(path)


def create_store(rows: DataFrame, path: str, key: str = "id") -> None:
    """Store rows (with key and source), each key once; rows without a key are left out."""
    own = in_folders(rows.where(F.col(key).isNotNull()).dropDuplicates([key]), key)
    folders = rows.sparkSession.range(SOURCES * IDS).select(F.floor(F.col("id") / IDS).cast("int").alias("source_folder"), (F.col("id") % IDS).cast("int").alias("id_folder"))
    _replace(own, folders, path, key)


def read_store(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    return spark.read.parquet(path).where(F.col(key).isNotNull()).drop(*PLACE)


def lookup_store(spark: SparkSession, path: str, keys: DataFrame, key: str = "id") -> DataFrame:
    """The rows of some keys (source, key); only their folders are read."""
    asked = in_folders(keys.select("source", key).distinct(), key)
    return spark.read.parquet(path).join(asked, ["source", key, *PLACE], "left_semi").drop(*PLACE)


def _change(spark: SparkSession, path: str, folders: DataFrame, key: str, change: Callable[[DataFrame], DataFrame]) -> int:
    """Let `change` tell what the folders hold now; returns how many there are. Their names are few, whatever the rows."""
    names = [(r[0], r[1]) for r in folders.select(*PLACE).distinct().collect()]
    if not names:
        return 0
    held = spark.read.parquet(path)
    pick = F.struct(*PLACE).isin([F.struct(F.lit(a).alias("source_folder"), F.lit(b).alias("id_folder")) for a, b in names])
    now = change(held.where(pick & F.col(key).isNotNull()).drop(*PLACE))
    _replace(in_folders(now, key).select(*[c for c in held.columns]), spark.createDataFrame(names, "source_folder int, id_folder int"), path, key)
    return len(names)


def insert_rows(new: DataFrame, path: str, key: str = "id") -> int:
    """Add the rows whose key the table lacks; returns the folders that were rewritten. Rows of a key have one source."""
    own = new.where(F.col(key).isNotNull())
    return _change(new.sparkSession, path, in_folders(own, key), key, lambda held: insert_chunks(held, own, key))


def upsert_rows(new: DataFrame, path: str, key: str = "id") -> int:
    """Put the rows in place of those with their keys; returns the folders that were rewritten."""
    own = new.where(F.col(key).isNotNull())
    return _change(new.sparkSession, path, in_folders(own, key), key, lambda held: upsert_chunks(held, own, key))


def delete_rows(spark: SparkSession, source: str, path: str, key: str = "id") -> int:
    """Remove a source's rows; returns how many there were. Only folders that hold some are rewritten."""
    held = spark.read.parquet(path).where((F.col("source_folder") == source_folder(F.lit(source))) & F.col(key).isNotNull())
    mine = held.where(F.col("source") == source)
    removed = mine.count()
    _change(spark, path, mine, key, lambda rows: delete_source(rows, source)[0])
    return removed
