"""Greedy batches of rows in order, without reading a source in one task.

Where a batch ends depends on where it began. A source is cut into spans of its summed sizes. Each span works out, by
binary search over its prefix sums, where a batch that begins at one of its rows ends, and so for each row that a batch
could reach it by where the chain of batches leaves the span. These few rows are then followed from the first one over
all spans by pointer doubling, and each span numbers its own rows from its true entry.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.pages import scratch

#: Batches' worth of sizes in a span, and pages whose rows are summed together.
SPAN, PAGES = 64, 256


def in_order(sized: DataFrame) -> DataFrame:
    """sized (source, page, part, n) with i, from 0 in order of page and part, and pre, the sum of n before.

    Sums of the runs of pages before, and sums within a run, so that a source is summed by as many tasks as it has runs.
    """
    rows = sized.withColumn("run", F.floor(F.col("page") / PAGES))
    runs = rows.groupBy("source", "run").agg(F.count("*").alias("rows"), F.sum("n").alias("size"))
    before = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    base = runs.select(F.col("source").alias("s"), F.col("run").alias("r"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("rows", "size")])
    own = Window.partitionBy("source", "run").orderBy("page", "part")
    inside = rows.withColumns({"k": F.row_number().over(own), "sum": F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, -1))})
    told = inside.join(base, F.col("source").eqNullSafe(F.col("s")) & F.col("run").eqNullSafe(F.col("r")))
    return told.select("source", "page", "part", "n", (F.col("rows_before") + F.col("k") - 1).cast("long").alias("i"), (F.col("size_before") + F.coalesce("sum", F.lit(0))).cast("long").alias("pre"))


def next_starts(pre: np.ndarray, n: np.ndarray, most: int, items: int | None) -> np.ndarray:
    """Where the batch ends that begins at each row: the first row behind it, by place; a batch has one row at least."""
    ends = pre + n
    to = np.searchsorted(ends, pre + most, side="right")
    to = np.maximum(to, np.arange(len(pre)) + 1)
    return np.minimum(to, np.arange(len(pre)) + items) if items else to


def pack_batches(sized: DataFrame, most: int, items: int | None = None, span: int = SPAN) -> DataFrame:
    """source, page, part, batch: rows in order of page and part, as many to a batch as sum up to `most`; items: and no more than so many.

    sized: source, page, part, n (above 0). A row that is larger than `most` is a batch of its own. Batches of a source
    are numbered from 0; rows with a null source form one. An empty table stays empty.
    """
    spark, width = sized.sparkSession, span * most
    rows = in_order(sized).withColumn("span", F.floor(F.col("pre") / width).cast("long"))
    path = scratch(spark, "ordered")
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    # a batch that begins in a span ends within `most` behind it
    behind = rows.where((F.col("pre") % width < most) & (F.col("span") > 0)).select("*", (F.col("span") - 1).alias("at"))
    both = rows.select("*", F.col("span").alias("at")).union(behind)
    kind = sized.schema["source"].dataType.simpleString()

    def table(batch: pa.Table) -> tuple:
        batch = batch.sort_by("i")
        i, pre, n, own = (batch.column(c).to_numpy() for c in ("i", "pre", "n", "span"))
        mine = int((own == batch.column("at")[0].as_py()).sum())
        return batch, i, pre, next_starts(pre, n, most, items), mine

    def exits(batch: pa.Table) -> pa.Table:
        batch, i, pre, to, mine = table(batch)
        leaves, steps = to.copy(), np.ones(len(to), np.int64)
        for k in range(mine - 1, -1, -1):
            if to[k] < mine:
                leaves[k], steps[k] = leaves[to[k]], steps[to[k]] + 1
        first = np.flatnonzero((pre[:mine] % width < most) | (np.arange(mine) == 0))
        return pa.table({"source": batch.column("source").take(pa.array(first)), "i": i[first], "to": i[0] + leaves[first], "steps": steps[first]})

    def numbered(batch: pa.Table) -> pa.Table:
        batch, i, pre, to, mine = table(batch)
        entry, base = batch.column("entry").drop_null(), batch.column("base").drop_null()
        out = np.full(mine, -1, np.int64)
        if len(entry):
            at, number = int(entry[0].as_py() - i[0]), int(base[0].as_py())
            out[:at] = number - 1
            while at < mine:
                out[at : min(to[at], mine)] = number
                at, number = int(to[at]), number + 1
        return pa.table({**{c: batch.column(c).slice(0, mine) for c in ("source", "page", "part")}, "batch": pa.array(out, pa.int64(), mask=out < 0)})

    keys = ["source", "at"]
    jumps = scratch(spark, "jumps")
    both.groupBy(*keys).applyInArrow(exits, f"source {kind}, i long, to long, steps long").write.parquet(jumps)
    jump = spark.read.parquet(jumps)
    reached = jump.where("i = 0").select("source", "i", F.lit(0).cast("long").alias("base"))
    count = reached.count()
    while True:
        step = jump.select(F.col("source").alias("s"), F.col("i").alias("from"), "to", "steps")
        on = lambda df, place: df.join(step, F.col("source").eqNullSafe(F.col("s")) & (F.col(place) == F.col("from")))
        more = on(reached, "i").select("source", F.col("to").alias("i"), (F.col("base") + F.col("steps")).alias("base"))
        path = scratch(spark, "reached")
        reached.union(more).groupBy("source", "i").agg(F.min("base").alias("base")).write.parquet(path)
        reached = spark.read.parquet(path)
        now = reached.count()
        if now == count:
            break
        count, path = now, scratch(spark, "jumps")
        twice = jump.select("source", "i", F.col("to").alias("mid"), F.col("steps").alias("before"))
        on(twice, "mid").select("source", "i", "to", (F.col("before") + F.col("steps")).alias("steps")).write.parquet(path)
        jump = spark.read.parquet(path)

    # the place behind a source's last row is reached, too: its number is that of all batches
    whole = reached.groupBy("source").agg(F.max("base").alias("total")).select(F.col("source").alias("s"), "total")
    entries = rows.join(reached.select(F.col("source").alias("s"), F.col("i").alias("e"), "base"), F.col("source").eqNullSafe(F.col("s")) & (F.col("i") == F.col("e")))
    entries = entries.groupBy("source", "span").agg(F.min("i").alias("entry"), F.min("base").alias("base")).select(F.col("source").alias("s"), F.col("span").alias("sp"), "entry", "base")
    told = both.join(entries, F.col("source").eqNullSafe(F.col("s")) & (F.col("at") == F.col("sp")), "left").drop("s", "sp")
    told = told.groupBy(*keys).applyInArrow(numbered, f"source {kind}, page int, part int, batch long")
    # a last span that a batch of the one before takes up has no entry
    return told.join(whole, F.col("source").eqNullSafe(F.col("s"))).select("source", "page", "part", F.coalesce("batch", F.col("total") - 1).cast("int").alias("batch"))
