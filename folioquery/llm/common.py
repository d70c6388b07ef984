"""Helpers shared by the corpus operators: shared folder, written tables, Arrow plumbing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the id filter that is sent to the executors (2 MB), whatever the input's size.
FILTER_BITS = 1 << 24


#: Rows of a file of a small table.
ROWS = 10_000
#: Rows of whole texts in an Arrow batch.
BATCH = 2000
_held: dict[str, object] = {}


def held(name: str, make) -> object:
    """In a worker: the tables that tasks share under this name; those that other operators left there are let go."""
    if name not in _held:
        release()
        _held[name] = make()
    return _held[name]


def release() -> None:
    """In a worker: let go of what tasks of other operators have left, and give freed memory back to the machine."""
    if _held:
        _held.clear()
        gc.collect()
    trim()


def trim() -> None:
    """Give memory that this process has freed back to the machine; workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(df: DataFrame) -> DataFrame:
    """Let the session send whole texts to Python workers BATCH rows at a time, so that a worker holds few of them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= BATCH:
        df.sparkSession.conf.set(name, str(BATCH))
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none, a local one serves a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, rows: int | None = None, codec: str | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back.

    rows: about how many there are, where it is known; a small table then has few files, one for ROWS rows.
    codec: how to compress it, by default as the session does.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    (df if rows is None else df.coalesce(max(1, -(-rows // ROWS)))).write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slots(df: DataFrame, least: int = 8) -> int:
    """Partitions for a shuffle that the job sizes itself: the session's number, and those of the input."""
    spark = df.sparkSession
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def owned(df: DataFrame, made: Iterable[str], body: str | None = None) -> tuple[list[Column], Column]:
    """A way to carry the columns of df past columns of our own, whatever their names.

    Gives the expressions that take them out again, under their names and in their order, and the column `own` to
    select. Columns that bear a name in `made` are left out; the column `body` travels beside, under that name.
    """
    taken = {name.lower() for name in made}
    kept = [c for c in df.columns if c.lower() not in taken]
    fields = {c: f"f{k}" for k, c in enumerate(kept) if c != body}
    own = F.struct(*[F.col(quoted(c)).alias(f) for c, f in fields.items()] or [F.lit(0).alias("none")]).alias("own")
    return [(F.col("body") if c == body else F.col("own").getField(fields[c])).alias(c) for c in kept], own


def _words(ids: DataFrame, of: str) -> DataFrame:
    """A Bloom filter with one hash: FILTER_BITS bits at most, whatever the input, as words of 64 bits."""
    words = ids.select(_word(of).alias("_word"), _bit(of).alias("_bits")).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    return F.broadcast(words)


def _word(column: str) -> Column:
    return (F.pmod(F.xxhash64(F.lit(7), F.col(column)), F.lit(FILTER_BITS)) / 64).cast("long")


def _bit(column: str) -> Column:
    return F.expr(f"shiftleft(1L, cast(pmod(xxhash64(7, `{column}`), 64) as int))")


def _passed(df: DataFrame, column: str, words: DataFrame, absent: bool = False) -> DataFrame:
    joined = df.withColumn("_word", _word(column)).join(words, "_word", "left")
    hit = F.coalesce(F.col("_bits").bitwiseAND(_bit(column)) != 0, F.lit(False))
    return joined.where(~hit if absent else hit).drop("_word", "_bits")


def likely(df: DataFrame, column: str, ids: DataFrame, of: str) -> DataFrame:
    """The rows of df, whose columns are our own, whose column may be among ids.of.

    The filter is broadcast and has FILTER_BITS bits. When the ids outgrow it, it lets more rows pass; an exact
    join has to follow.
    """
    return _passed(df, column, _words(ids, of))


def parted(df: DataFrame, column: str, ids: DataFrame, of: str) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose column certainly isn't among ids.of, and those where it may be."""
    words = _words(ids, of)
    return _passed(df, column, words, absent=True), _passed(df, column, words)


def hot_keys(df: DataFrame, keys: list[str], parts: int = 500) -> DataFrame:
    """The keys that more than one in `parts` rows of df have: fewer than `parts`, whatever the input."""
    total = df.count()
    return written(df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") * parts > total).select(*keys), "hot")


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, how: str = "left", salts: int = 64) -> DataFrame:
    """left joined to right, whose rows of a hot key are repeated `salts` times so that those of left are dealt to as many tasks."""
    if not hot.limit(1).count():
        return left.join(right, keys, how)
    hot = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    dealt = left.withColumn("_row", F.monotonically_increasing_id()).join(hot, keys, "left")
    dealt = dealt.withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("_row"), F.lit(salts))).otherwise(0).cast("int")).drop("_hot", "_row")
    last = F.when(F.col("_hot"), salts - 1).otherwise(0)
    spread = right.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop("_hot")
    return dealt.join(spread, [*keys, "_salt"], how).drop("_salt")


def components(links: DataFrame, a: str = "a", b: str = "b", name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over links, for nodes that have a link.

    Alternating large-star and small-star rounds; every round is a written table, so that a lost
    executor costs no more than one round. Neighbours are only ever reduced with min(), which
    Spark combines before the shuffle; no group is collected.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = written(edges, name)
    rows, before = edges.count(), None
    for _ in range(rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(low, "u")
        small = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = written(small, name, 2 * rows)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        rows, before = now[0], now
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.union(roots)
