"""Lines that documents of one host share, matched by keys of 128 bits. DataFrame functions only.

Texts are not moved to count lines: a distinct text of a host has a key (da, db), each of its lines has one, and only
these are shuffled. Counts are combined before each shuffle; no group is collected but the lines of one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, parted, salted_join, written


def host_key(host: Column) -> Column:
    """A host without null: rows with a null host form a host of their own."""
    return F.coalesce(F.concat(F.lit("="), host.cast("string")), F.lit(""))


def text_key(host: Column, text: Column) -> list[Column]:
    """128 bits that tell the texts of hosts apart, as da and db."""
    return [F.xxhash64(text, host_key(host)).alias("da"), F.xxhash64(text, host_key(host), F.lit(1)).alias("db")]


def line_key(bare: Column) -> Column:
    """128 bits of a line as it is compared; null for a blank one."""
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(bare, F.lit(1)).alias("b")))


def texts_with(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """da, db, lines (keys) of the texts that hold frequent lines (host, line); lines: host, line, da, db."""
    hits = lines.join(frequent.select("host", "line"), ["host", "line"])
    return written(hits.groupBy("da", "db").agg(F.collect_list("line").alias("lines")), "hits")


def split_by(keyed: DataFrame, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of keyed (da, db and others) that hold no frequent line, and those that may, with `lines`."""
    clean, maybe = parted(keyed, "da", hits, "da")
    # all copies of a text have one key
    return clean, salted_join(maybe, hits, ["da", "db"], hot_keys(maybe, ["da", "db"]))
