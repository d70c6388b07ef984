"""A stored table that is changed by key rewrites the folders of its keys only; batches of a stream are taken in once."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from folioquery.sources import store as K
from folioquery.streaming import state as S


def files(path):
    return {os.path.relpath(f, path): os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/*/*.parquet")}


def folders_of(names):
    return {os.path.dirname(n) for n in names}


def rows(spark, ids, text, sources=12):
    return spark.createDataFrame([(f"id{k}", f"src{k % sources}", f"{text} {k}") for k in ids], "id string, source string, text string")


def texts(spark, path):
    return {r.id: r.text for r in K.read_store(spark, path).collect()}


def test_changes_touch_their_folders(spark, tmp_path):
    path = f"{tmp_path}/store"
    K.create_store(rows(spark, range(300), "old"), path)
    before, want = files(path), {f"id{k}": f"old {k}" for k in range(300)}
    assert texts(spark, path) == want and len(folders_of(before)) == K.SOURCES * K.IDS

    assert K.upsert_rows(rows(spark, [3, 7, 1000], "new"), path) == len(changed := folders_of({n for n in files(path) if n not in before}))
    assert len(changed) <= 3
    want |= {f"id{k}": f"new {k}" for k in (3, 7, 1000)}
    assert texts(spark, path) == want
    assert K.insert_rows(rows(spark, [3, 2000], "late"), path) <= 2
    want["id2000"] = "late 2000"
    assert texts(spark, path) == want

    before = files(path)
    assert K.delete_rows(spark, "src5", path) == 25
    want = {k: v for k, v in want.items() if int(k[2:]) % 12 != 5}
    assert texts(spark, path) == want and len(folders_of({n for n in files(path) if n not in before})) <= K.IDS
    assert K.delete_rows(spark, "nowhere", path) == 0
    found = K.lookup_store(spark, path, rows(spark, [3, 5, 9], ""))
    assert {r.id: r.text for r in found.collect()} == {"id3": "new 3", "id9": "old 9"}
    for source in [f"src{k}" for k in range(12)]:
        K.delete_rows(spark, source, path)
    assert texts(spark, path) == {}
    K.insert_rows(rows(spark, range(5), "again"), path)
    assert texts(spark, path) == {f"id{k}": f"again {k}" for k in range(5)}


def test_a_failed_change_leaves_the_table(spark, tmp_path):
    path = f"{tmp_path}/store"
    K.create_store(rows(spark, range(40), "old"), path)
    before = files(path)
    with pytest.raises(Exception, match="no such text"):
        K.upsert_rows(rows(spark, range(40), "new").withColumn("text", F.raise_error(F.lit("no such text")).cast("string")), path)
    assert files(path) == before and texts(spark, path) == {f"id{k}": f"old {k}" for k in range(40)}


def test_replayed_batches_change_nothing(spark, tmp_path):
    path, ledger = f"{tmp_path}/rows", f"{tmp_path}/ledger"
    load = S.ingest_once(path, ledger)
    load(rows(spark, range(10), "a"), 0)
    load(rows(spark, range(10), "a"), 0)
    load(rows(spark, range(10, 14), "b"), 1)
    assert spark.read.parquet(path).count() == 14 and S.ledger_of(spark, ledger) == {0: 10, 1: 4}


def test_crash_between_rows_and_commit(spark, tmp_path):
    """The stream fails after a batch's rows were written; started again it replays the batch."""
    path, ledger = f"{tmp_path}/rows", f"{tmp_path}/ledger"
    for k in range(3):
        rows(spark, range(10 * k, 10 * k + 10), "x").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("id string, source string, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    load = S.ingest_once(path, ledger)

    def crash(batch, number):
        load(batch, number) if number == 0 else batch.withColumn("batch", F.lit(number)).write.mode("append").partitionBy("batch").parquet(path)
        if number == 1:
            raise RuntimeError("lost")

    query = S.ingest_stream(stream(), f"{tmp_path}/at", crash)
    with pytest.raises(Exception, match="lost"):
        query.awaitTermination(60)
    assert spark.read.parquet(path).count() == 20 and S.ledger_of(spark, ledger) == {0: 10}
    S.ingest_stream(stream(), f"{tmp_path}/at", load).awaitTermination(60)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == sorted(f"id{k}" for k in range(30))
    assert S.ledger_of(spark, ledger) == {0: 10, 1: 10, 2: 10}
