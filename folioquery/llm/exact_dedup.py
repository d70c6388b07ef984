"""Exact dedup by distributed MSD radix partitioning.

Documents are split by the bytes at the front of their texts, then each group by the bytes that follow, until a group
is a single document or its texts have ended. A digit is a slice of bytes, short at first and longer in every round;
rows are grouped by the slice itself, so equality needs no digest. Rows without company leave at once, so that of a
text that differs early only its first bytes are looked at.

A hot group's rows are dealt to as many tasks as its share asks for; counting combines them before the shuffle.
Hashes only deal rows and leave out those that certainly are alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import likely, owned, parted, quoted, written

#: Bytes of the first digit; how much longer the next one is; the longest.
FIRST, FACTOR, LONGEST = 128, 16, 1 << 20
#: Bytes that a text can have.
MOST = 2**31 - 1
#: A group of more than one in SHARES rows is dealt to several tasks.
SHARES = 500


def plain(text: Column) -> Column:
    """A text as it is compared: each run of ASCII white space is one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def digit_of(rest: Column, width: int) -> list[Column]:
    """The next digit of a text, and whether the text ends in it."""
    return [F.substring(rest, 1, width).alias("digit"), (F.length(rest) <= width).alias("ended")]


def split(opened: DataFrame, behind: Column, rows: int) -> DataFrame:
    """One round over row, id, group, digit, ended: the rows that have company in their group by digit and end.

    Returns row, id, group (a new number), rest, ended, keep (null-last flag, id and row of the smallest) and n.
    Texts that end with the digit are kept apart from those that go on. behind: the text behind the digit, from the
    column `left`; it is only worked out for rows that may have company. Written to the shared folder.
    """
    keys, mark = ["group", "digit", "ended"], F.xxhash64("group", "digit", "ended").alias("mark")
    counted = opened.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct(F.col("id").isNull().alias("absent"), "id", "row")).alias("keep"))
    groups = written(counted.where("n > 1").select("*", mark, F.monotonically_increasing_id().alias("number")), "groups")

    # fewer than SHARES groups are hot; together they are repeated less than twice SHARES times
    hot = F.broadcast(groups.where(F.col("n") * SHARES > rows).groupBy("mark").agg(F.ceil(F.max("n") * SHARES / rows).alias("shares")))
    shares = F.coalesce("shares", F.lit(1))
    some = likely(opened.withColumn("mark", mark), "mark", groups, "mark").withColumn("rest", behind).drop("left")
    some = some.join(hot, "mark", "left").withColumn("share", F.pmod(F.xxhash64("row"), shares)).drop("mark", "shares")
    spread = groups.join(hot, "mark", "left").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1))).drop("mark", "shares")
    return written(some.join(spread, [*keys, "share"]).select("row", "id", F.col("number").alias("group"), "rest", "ended", "keep", "n"), "members", codec="zstd")


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with keep_id, group_size and kept: which row stands for the text, how many have it, whether this one stays.

    Texts are equal when they are the same bytes after each run of ASCII white space became one space; null counts as
    empty, and empty texts are equal. The row with the smallest id stays; rows without an id come last, and of rows
    that have the same id (repeated rows) any one stays, and only one. Columns of the three names are replaced, others
    pass through, whatever their names. An empty table stays empty.
    """
    names, own = owned(docs, ("keep_id", "group_size", "kept"), text)
    rest = plain(F.col("body")).cast("binary")
    rows = docs.select(own, F.col(quoted(text)).alias("body"), F.col(quoted(id_column)).alias("id"), F.monotonically_increasing_id().alias("row"))
    # the first digit is written beside the text, so that the first count reads no texts
    rows = written(rows.select("*", *digit_of(rest, FIRST)), "texts", codec="zstd")
    opened = rows.select("row", "id", F.lit(0).cast("long").alias("group"), "digit", "ended", F.col("body").alias("left"))
    behind, width, count, closed = F.substring(plain(F.col("left")).cast("binary"), FIRST + 1, MOST), FIRST, rows.count(), []
    while count:
        members = split(opened, behind, count)
        closed.append(members.where("ended").select("row", "keep", "n"))
        going, width = members.where("not ended"), min(width * FACTOR, LONGEST)
        opened = going.select("row", "id", "group", *digit_of(F.col("rest"), width), F.col("rest").alias("left"))
        behind, count = F.substring("left", width + 1, MOST), going.count()
    if not closed:
        return rows.select(*names, F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    found = reduce(DataFrame.union, closed)
    kept = rows.select("own", "body", "id", "row")
    single, several = parted(kept, "row", found, "row")
    single = single.select("own", "body", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    several = several.join(found, "row", "left")
    met = F.col("n").isNotNull()
    several = several.select("own", "body", F.when(met, F.col("keep.id")).otherwise(F.col("id")).alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), F.coalesce(F.col("keep.row") == F.col("row"), F.lit(True)).alias("kept"))
    return single.union(several).select(*names, "keep_id", "group_size", "kept")


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row for each text, that with the smallest id; see exact_groups."""
    names, own = owned(docs, (), text)
    held = docs.select(F.col(quoted(id_column)).alias("id"), F.col(quoted(text)).alias("body"), own)
    return exact_groups(held, "id", "body").where("kept").select(*names)
