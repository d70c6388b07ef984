"""Stream operators with state, each with a batch twin: blocking, jobs, answer checking, ingestion, reassembly."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .processors import Block, Jobs, keep_variables, ordered_stream
from .sentences import Sentences


def sticky_block_stream(requests: DataFrame, ttl: str | None = None, delay: str | None = None) -> DataFrame:
    """sid, event_id, ts, blocked, since of every request; requests: sid, event_id, ts, flagged, and control ("unblock" or null).

    A flagged request blocks its session from then on, an unblock event frees it. Rows of one trigger are taken in order of
    time; results equal the batch twin's for rows in order. With delay, rows wait until the stream's time is so long past
    them and come out in order of time, repeated ones once, so that late ones count as the batch twin counts them. A block
    lasts until it is lifted; only with ttl an event that comes so long after its session's last one finds it free.
    """
    kind = requests.schema["sid"].dataType.simpleString()
    processor = Block(delay is not None, kind, int(pd.Timedelta(ttl).total_seconds() * 1000) if ttl else None)
    keyed = requests.select("sid", "event_id", "ts", "flagged", "control")
    return ordered_stream(keyed, processor, f"sid {kind}, event_id long, ts timestamp, blocked boolean, since timestamp", delay)


def blocked_sessions(told: DataFrame) -> DataFrame:
    """Sessions that are blocked by their latest event, with the time since when."""
    last = told.groupBy("sid").agg(F.max_by(F.struct("blocked", "since"), F.struct("ts", "event_id")).alias("l"))
    return last.where("l.blocked").select("sid", "l.since")


def job_progress_stream(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """job_id, entry, state, updated_at: the latest state of every entry, for update mode."""
    kept = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    latest = F.max_by(F.struct("state", F.col("ts").alias("updated_at")), "ts")
    return kept.groupBy("job_id", "entry").agg(latest.alias("l")).select("job_id", "entry", "l.state", "l.updated_at")


def suppress_duplicate_jobs_stream(requests: DataFrame, delay: str | None = None) -> DataFrame:
    """job_id, accepted, running of start requests; requests: job_id, step, mode, entries, ts, done (an end event of its job).

    A start is refused while the job that was accepted for the same step, mode and entries isn't done. With delay, rows
    wait until the stream's time is so long past them and come in order of time, repeated ones once.
    """
    key = F.sha2(F.concat_ws("|", "step", "mode", F.array_join(F.array_sort("entries"), ",")), 256)
    # at one time ends come first, then starts by number
    rank = F.concat(F.when(F.col("done"), "0").otherwise("1"), F.col("job_id").cast("string"))
    keyed = requests.select(key.alias("key"), F.col("job_id").cast("string").alias("job_id"), "ts", "done", rank.alias("rank"))
    return ordered_stream(keyed, Jobs(delay is not None, "string"), "key string, job_id string, accepted boolean, running string", delay).drop("key")


def validate_stream(chunks: DataFrame, repair: bool = True, run: int = 3, ttl: str = "10 minutes") -> DataFrame:
    """req, seq, sentence, valid, filler: sentences of token streams, checked as they end; chunks: req, i (from 0), data, ts, is_end, allowed.

    Chunks are read in order of i, however they arrive, each once; one that comes early waits for those before it. A
    label that follows a full stop stays with its sentence, so a sentence is only cut when what follows it is seen. The
    rest of the buffer comes out with the end event, or when the stream's time is `ttl` past the request's last chunk,
    then with the chunks that still waited. Without repair, every `run` invalid sentences in a row give a filler.
    """
    keep_variables(chunks.sparkSession)
    kind = chunks.schema["req"].dataType.simpleString()
    given = chunks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", ttl).select("req", "i", "data", "ts", "is_end", "allowed")
    processor = Sentences(repair, run, int(pd.Timedelta(ttl).total_seconds() * 1000))
    return given.groupBy("req").transformWithStateInPandas(statefulProcessor=processor, outputStructType=f"req {kind}, seq int, sentence string, valid boolean, filler boolean", outputMode="Append", timeMode="EventTime")


def ingest_once(path: str, ledger: str) -> Callable[[DataFrame, int], None]:
    """A load for ingest_stream that takes each batch in once, however often it is replayed.

    Rows lie in folders by the number of their batch, so a batch that failed on its way, or between its rows and its
    commit, replaces what it had written. The ledger then takes the number and the count of rows; a batch that it
    holds is left alone.
    """

    def load(batch: DataFrame, number: int) -> None:
        if number in ledger_of(batch.sparkSession, ledger):
            return
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
        rows = batch.sparkSession.read.parquet(path).where(F.col("batch") == number).count() if not batch.isEmpty() else 0
        batch.sparkSession.createDataFrame([(number, rows)], "number long, rows long").coalesce(1).write.mode("overwrite").parquet(f"{ledger}/number={number}")

    return load


def ledger_of(spark: SparkSession, ledger: str) -> dict[int, int]:
    """Rows by the number of each batch that was taken in; one entry a batch of the stream."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return {}
    return {r["number"]: r["rows"] for r in spark.read.schema("number long, rows long").option("recursiveFileLookup", True).parquet(ledger).collect()}


def ingest_stream(artifacts: DataFrame, checkpoint: str, load: Callable[[DataFrame, int], None]):
    """Start a query that hands new artifacts to `load` once, in batches; artifacts: a file stream."""
    return artifacts.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(load).start()
