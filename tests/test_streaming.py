"""Streams equal their batch twins on the same events."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from folioquery.operators import citations as C
from folioquery.operators import conversations as V
from folioquery.streaming import state as S

SMALL = "/root/testdata/sf0.001"


def replay(spark, df, folder, parts, order):
    """Write df in `parts` files by order and read it as a stream, a file a trigger."""
    rows = df.orderBy(*order).collect()
    for k in range(parts):
        spark.createDataFrame(rows[k * len(rows) // parts : (k + 1) * len(rows) // parts], df.schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def drained(stream, name, mode="append"):
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    query.processAllAvailable()
    query.stop()
    return stream.sparkSession.table(name)


def test_sticky_block_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet").limit(300)
    rows = events.select(F.col("user_id").alias("sid"), "event_id", "ts", (F.col("event_type") == "error").alias("flagged"), F.lit(None).cast("string").alias("control"))
    told = drained(S.sticky_block_stream(replay(spark, rows, str(tmp_path), 1, ["ts", "event_id"]), "1000 days"), "blocked")
    twin = V.sticky_block(events, "user_id", F.col("event_type") == "error", ["ts", "event_id"]).select(F.col("user_id").alias("sid"), "event_id", "blocked")
    assert sorted(map(tuple, told.select("sid", "event_id", "blocked").collect())) == sorted(map(tuple, twin.collect()))


def test_unblock_frees_the_session(spark, tmp_path):
    at = lambda k: datetime(2024, 1, 1) + timedelta(minutes=k)
    rows = spark.createDataFrame([(1, 1, at(0), True, None), (1, 2, at(1), False, None), (1, 3, at(2), False, "unblock"), (1, 4, at(3), False, None), (2, 5, at(1), True, None)], "sid long, event_id long, ts timestamp, flagged boolean, control string")
    told = drained(S.sticky_block_stream(replay(spark, rows, str(tmp_path), 1, ["ts"])), "freed")
    assert [r.blocked for r in told.orderBy("event_id").collect()] == [True, True, False, False, True]
    assert [r.sid for r in S.blocked_sessions(told).collect()] == [2]


def test_blocks_outlast_idle_days_and_equal_the_batch_twin(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet").limit(200)
    rows = events.select(F.col("user_id").alias("sid"), "event_id", "ts", (F.col("event_type") == "error").alias("flagged"), F.when(F.col("event_id") % 7 == 0, "unblock").alias("control"))
    told = drained(S.sticky_block_stream(replay(spark, rows, str(tmp_path), 3, ["ts", "event_id"])), "lasting")
    assert sorted(map(tuple, told.collect())) == sorted(map(tuple, V.block_until_lifted(rows).collect()))
    twin = S.blocked_sessions(V.block_until_lifted(rows)).collect()
    assert sorted(map(tuple, S.blocked_sessions(told).collect())) == sorted(map(tuple, twin)) and twin


def test_late_and_repeated_events_equal_the_batch_twin(spark, tmp_path):
    """Events that come up to an hour late, some twice, out of order over several triggers."""
    rows = spark.read.parquet(f"{SMALL}/events.parquet").limit(150).select((F.col("user_id") % 9).alias("sid"), "event_id", "ts", (F.col("event_type") == "error").alias("flagged"), F.when(F.col("event_id") % 7 == 0, "unblock").alias("control"))
    start = datetime(2024, 1, 1)
    told = [(r.sid, r.event_id, start + timedelta(minutes=4 * k), r.flagged, r.control) for k, r in enumerate(rows.orderBy("ts", "event_id").collect())]
    rows = spark.createDataFrame(told, "sid long, event_id long, ts timestamp, flagged boolean, control string")
    late = F.col("ts") + F.expr("make_interval(0, 0, 0, 0, 0, cast(event_id % 3 * 20 as int))")
    again = rows.where("event_id % 5 = 0")
    end = spark.createDataFrame([(-1, -1, start + timedelta(days=30), False, None)], rows.schema)
    arriving = rows.union(again).union(end).withColumn("arrives", late)
    stream = replay(spark, arriving, str(tmp_path), 5, ["arrives", "event_id"]).drop("arrives")
    out = drained(S.sticky_block_stream(stream, delay="2 hours"), "ordered").where("sid >= 0")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, V.block_until_lifted(rows).collect()))


def test_late_job_ends(spark, tmp_path):
    """An end that comes after a later start still frees its key before that start."""
    at = lambda k: datetime(2024, 1, 1) + timedelta(minutes=k)
    order = [("a", at(0), False), ("b", at(5), False), ("a", at(3), True), ("a", at(0), False), ("c", at(6), False), ("z", at(10000), False)]
    rows = spark.createDataFrame([(k, j, "split", "all", ["x"] if j != "z" else ["y"], ts, done) for k, (j, ts, done) in enumerate(order)], "n int, job_id string, step string, mode string, entries array<string>, ts timestamp, done boolean")
    told = drained(S.suppress_duplicate_jobs_stream(replay(spark, rows, str(tmp_path), 3, ["n"]).drop("n"), "1 hour"), "late_jobs")
    assert sorted((r.job_id, r.accepted, r.running) for r in told.collect()) == [("a", True, "a"), ("b", True, "b"), ("c", False, "b")]


def test_jobs_are_refused_while_one_runs(spark, tmp_path):
    at = lambda k: datetime(2024, 1, 1) + timedelta(minutes=k)
    rows = spark.createDataFrame(
        [("a", "split", "all", ["x", "y"], at(0), False), ("b", "split", "all", ["y", "x"], at(1), False), ("c", "split", "all", ["x"], at(1), False), ("a", "split", "all", ["x", "y"], at(2), True), ("d", "split", "all", ["x", "y"], at(3), False)],
        "job_id string, step string, mode string, entries array<string>, ts timestamp, done boolean",
    )
    told = drained(S.suppress_duplicate_jobs_stream(replay(spark, rows, str(tmp_path), 1, ["ts"])), "jobs")
    assert {r.job_id: (r.accepted, r.running) for r in told.collect()} == {"a": (True, "a"), "b": (False, "a"), "c": (True, "c"), "d": (True, "d")}


def test_sentences_of_a_token_stream(spark, tmp_path):
    text = "First one. [3.2] Second has [4.1]. Third is bare. Last ends [3.2]"
    at = datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, k, text[k * 9 : k * 9 + 9], at, k == len(text) // 9, ["3.2", "4.1"]) for k in range(len(text) // 9 + 1)], "req long, i int, data string, ts timestamp, is_end boolean, allowed array<string>")
    told = drained(S.validate_stream(replay(spark, rows, str(tmp_path), 1, ["i"])), "checked").orderBy("seq").collect()
    assert [(r.sentence, r.valid) for r in told] == [("First one. [3.2]", True), ("Second has. [4.1]", False), ("Third is bare. [3.2]", False), ("Last ends [3.2]", True)]


def chunked(spark, answers, size, at):
    """Chunk rows (n, req, i, data, ts, is_end, allowed) of answers (req, text, allowed), numbered as they are sent."""
    cut = [(req, k, text[k * size : (k + 1) * size], k == (len(text) - 1) // size, labels) for req, text, labels in answers for k in range((len(text) + size - 1) // size)]
    rows = [(n, req, k, data, at, end, labels) for n, (req, k, data, end, labels) in enumerate(cut)]
    return rows, "n int, req long, i int, data string, ts timestamp, is_end boolean, allowed array<string>"


def test_chunks_in_any_order_equal_the_batch_twin(spark, tmp_path):
    """Chunks shuffled over six triggers, a third of them sent twice, some of another request's end after it."""
    said = spark.read.parquet(f"{SMALL}/conversations.parquet").where("role = 'assistant' and text <> ''").orderBy("conv_id", "turn").limit(20).collect()
    labels = lambda r: [f"{r.conv_id % 3}.1", f"{r.conv_id % 3}.2"]
    answers = [(k, f"{r.text} [{r.conv_id % 3}.{r.turn % 4}] And more (see [1.1]). Then. [{r.conv_id % 3}.1] Last one", labels(r)) for k, r in enumerate(said)]
    rows, schema = chunked(spark, answers, 17, datetime(2024, 1, 1))
    shuffled = sorted([*rows, *rows[::3]], key=lambda r: (r[0] * 7919 % 1009, r[1]))
    sent = spark.createDataFrame([(n, *r[1:]) for n, r in enumerate(shuffled)], schema)
    told = drained(S.validate_stream(replay(spark, sent, str(tmp_path), 6, ["n"]).drop("n"), repair=False), "any_order")
    texts = spark.createDataFrame(answers, "req long, answer string, labels array<string>")
    checked = C.check_sentences(C.sentences(texts, ["req"]), texts.select("req", "labels"), ["req"])
    twin = C.fallback_on_run(checked.withColumnRenamed("valid", "passed"), ["req"]).select("req", "place", "sentence", "passed", "filler")
    assert sorted(map(tuple, told.collect())) == sorted(map(tuple, twin.collect()))
    assert {r.filler for r in told.collect()} == {True, False}


def test_a_lost_end_and_a_lost_chunk_come_out_by_the_timer(spark, tmp_path):
    at = lambda k: datetime(2024, 1, 1) + timedelta(minutes=k)
    rows = [
        (0, 1, 0, "One. [1.1] Two is not ov", at(0), False, ["1.1"]), (1, 2, 0, "Kept. [1.1] Then", at(0), False, ["1.1"]), (2, 2, 2, " after. [1.1]", at(1), True, None),
        (3, 3, 0, None, at(0), None, None), (4, 9, 0, "Later. [9] On", at(60), False, ["9"]), (5, 9, 1, " it goes [9]", at(120), False, None), (6, 9, 2, "", at(121), True, None),
    ]
    sent = spark.createDataFrame(rows, "n int, req long, i int, data string, ts timestamp, is_end boolean, allowed array<string>")
    told = drained(S.validate_stream(replay(spark, sent, str(tmp_path), 7, ["n"]).drop("n")), "by_timer")
    got = sorted((r.req, r.seq, r.sentence, r.valid) for r in told.collect())
    # the second request lacks its chunk 1: what came ahead of it comes out when the timer fires; the third never says anything
    assert got == [(1, 0, "One. [1.1]", True), (1, 1, "Two is not ov [1.1]", False), (2, 0, "Kept. [1.1]", True), (2, 1, "Then after. [1.1]", True), (9, 0, "Later. [9]", True), (9, 1, "On it goes [9]", True)]


def test_job_progress_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("entry"), F.col("value").cast("string").alias("state"), "ts").dropDuplicates(["job_id", "entry", "ts"])
    told = drained(S.job_progress_stream(replay(spark, events, str(tmp_path), 1, ["ts"])), "progress", "complete")
    twin = V.job_progress(events, "job_id", "entry", "state", ["ts"])
    assert sorted(map(tuple, told.select("job_id", "entry", "state").collect())) == sorted(map(tuple, twin.select("job_id", "entry", "state").collect()))


def test_ingest_takes_a_file_once(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/in")
    source = lambda: spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    load = lambda df, k: df.write.mode("append").parquet(f"{tmp_path}/out")
    S.ingest_stream(source(), f"{tmp_path}/check", load).awaitTermination(120)
    spark.range(10, 12).write.mode("append").parquet(f"{tmp_path}/in")
    S.ingest_stream(source(), f"{tmp_path}/check", load).awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 1, 2, 10, 11]
