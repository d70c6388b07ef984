"""Queries over conversations, answers and request logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import slices
from ..operators import citations as C
from ..operators import conversations as V
from ..sources.pages import scratch
from .text_queries import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


TITLE = r"""CASE WHEN t <> '' AND length(t) <= 60 AND NOT regexp_matches(t, '^\p{Ll}') AND NOT regexp_matches(t, '^(The|In|To|A|An|This|That|You|When|Where|How|What|Why|If|During|After|Before|For|With|From) ') AND NOT regexp_matches(t, '[.!?:]$')
 AND len(string_split_regex(t, '\s+')) <= 8 AND NOT regexp_matches(lower(t), 'can|should|will|would|could|must|may|might') THEN t END"""


@query(
    "w7_bookmarks",
    rf"""WITH b AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
 u AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_extract(coalesce(nt, ''), '^\s*([^\n]*)', 1), '^\s+|\s+$', '', 'g'), '^[#* ]+|[#* ]+$', '', 'g'), '^\s+|\s+$', '', 'g') AS t FROM b WHERE role = 'user')
 SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS ordinal, coalesce(CASE WHEN nr = 'assistant' THEN {TITLE} END, substring(coalesce(text, ''), 1, 60) || CASE WHEN length(text) > 60 THEN '…' ELSE '' END) AS label FROM u""",
)
def w7(spark, d):
    return V.bookmarks(table(spark, d, "conversations"))


@query("w8_clean_pairs", "WITH b AS (SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, role, text FROM b WHERE (role = 'user' AND after = 'assistant') OR (role = 'assistant' AND before = 'user')")
def w8(spark, d):
    return V.clean_pairs(table(spark, d, "conversations"))


@query("w9_number_duplicates", "SELECT conv_id, turn, role AS label, CASE WHEN n > 1 THEN role || ' ' || n ELSE role END AS display FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations)")
def w9(spark, d):
    return V.number_duplicates(table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("label")))


@query(
    "w10_delete_pairs",
    """WITH b AS (SELECT *, sum(CAST(role = 'user' AS INTEGER)) OVER w - 1 AS n, lag(role) OVER w AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
 SELECT conv_id, turn, role FROM b WHERE NOT (n = conv_id % 2 AND (role = 'user' OR (role = 'assistant' AND before = 'user')))""",
)
def w10(spark, d):
    turns = table(spark, d, "conversations")
    doomed = turns.select("conv_id", (F.col("conv_id") % 2).alias("n")).distinct()
    return V.delete_pairs(turns, doomed).select("conv_id", "turn", "role")


@query("w11_last_context", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_title FROM events WHERE coalesce(event_type, '') <> '' GROUP BY user_id")
def w11(spark, d):
    return V.last_context(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"])


@query("w13_sticky_block", "SELECT event_id, user_id, coalesce(max(CAST(event_type = 'error' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) = 1 AS blocked FROM events")
def w13(spark, d):
    events = table(spark, d, "events")
    return V.sticky_block(events, "user_id", F.col("event_type") == "error", ["ts", "event_id"]).select("event_id", "user_id", "blocked")


@query("t2_unblock", """WITH r AS (SELECT *, event_id % 7 = 0 AS lifts, sum(CAST(event_id % 7 = 0 AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS span FROM events), s AS (SELECT *, min(CASE WHEN event_type = 'error' AND NOT lifts THEN ts END) OVER (PARTITION BY user_id, span ORDER BY ts, event_id) AS since FROM r)
 SELECT user_id AS sid, event_id, since IS NOT NULL AS blocked, strftime(since, '%Y-%m-%d %H:%M:%S') AS since FROM s""")
def t2(spark, d):
    flagged, control = F.col("event_type") == "error", F.when(F.col("event_id") % 7 == 0, "unblock")
    told = V.block_until_lifted(table(spark, d, "events").select(F.col("user_id").alias("sid"), "event_id", "ts", flagged.alias("flagged"), control.alias("control")))
    return told.select("sid", "event_id", "blocked", F.date_format("since", "yyyy-MM-dd HH:mm:ss").alias("since"))


@query("t2_blocked_sessions", """WITH r AS (SELECT *, event_id % 7 = 0 AS lifts, sum(CAST(event_id % 7 = 0 AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS span FROM events), s AS (SELECT *, min(CASE WHEN event_type = 'error' AND NOT lifts THEN ts END) OVER (PARTITION BY user_id, span ORDER BY ts, event_id) AS since, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM r)
 SELECT user_id AS sid, strftime(since, '%Y-%m-%d %H:%M:%S') AS since FROM s WHERE back = 1 AND since IS NOT NULL""")
def t2b(spark, d):
    from ..streaming.state import blocked_sessions

    flagged, control = F.col("event_type") == "error", F.when(F.col("event_id") % 7 == 0, "unblock")
    told = V.block_until_lifted(table(spark, d, "events").select(F.col("user_id").alias("sid"), "event_id", "ts", flagged.alias("flagged"), control.alias("control")))
    return blocked_sessions(told).select("sid", F.date_format("since", "yyyy-MM-dd HH:mm:ss").alias("since"))


@query("t1_block_stream", ORACLES["t2_unblock"])
def t1(spark, d):
    """Requests as a stream that is stopped and started again at the middle of their time."""
    from ..streaming.state import sticky_block_stream

    inbox, progress, told = (scratch(spark, n) for n in ("requests", "progress", "blocks"))
    control = F.when(F.col("event_id") % 7 == 0, "unblock")
    requests = table(spark, d, "events").select(F.col("user_id").alias("sid"), "event_id", "ts", (F.col("event_type") == "error").alias("flagged"), control.alias("control"))
    middle = requests.agg(F.min("ts") + (F.max("ts") - F.min("ts")) / 2).first()[0]
    for half in (F.lit(True) if middle is None else F.col("ts") < middle, F.lit(False) if middle is None else F.col("ts") >= middle):
        requests.where(half).write.mode("append").parquet(inbox)
        stream = sticky_block_stream(spark.readStream.schema(requests.schema).parquet(inbox))
        stream.writeStream.option("checkpointLocation", progress).trigger(availableNow=True).format("parquet").start(told).awaitTermination()
    return spark.read.schema(stream.schema).parquet(told).select("sid", "event_id", "blocked", F.date_format("since", "yyyy-MM-dd HH:mm:ss").alias("since"))


@query("t3_job_progress", "SELECT user_id, event_type, arg_max(CAST(round(value) AS VARCHAR), (ts, event_id)) AS state FROM events GROUP BY user_id, event_type")
def t3(spark, d):
    events = table(spark, d, "events").withColumn("state", F.format_string("%.1f", F.round("value")))
    return V.job_progress(events, "user_id", "event_type", "state", ["ts", "event_id"]).select("user_id", "event_type", "state")


@query(
    "t4_duplicate_jobs",
    """WITH b AS (SELECT event_id, ts, ts + INTERVAL 1 HOUR AS ended, event_type || '|' || user_id AS k FROM events),
 c AS (SELECT event_id, ts, arg_max(event_id, (ended, event_id)) OVER w AS d, max(ended) OVER w AS e FROM b WINDOW w AS (PARTITION BY k ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT event_id AS job_id, d AS duplicate_of FROM c WHERE e > ts""",
)
def t4(spark, d):
    jobs = table(spark, d, "events").select(F.col("event_id").alias("job_id"), F.col("event_type").alias("step"), F.lit("all").alias("mode"), F.array(F.col("user_id").cast("string")).alias("entries"), F.col("ts").alias("started"), (F.col("ts") + F.expr("interval 1 hour")).alias("ended"))
    return V.duplicate_jobs(jobs)


@query("t7_reassemble", "SELECT conv_id, turn, text FROM conversations WHERE text <> ''")
def t7(spark, d):
    pieces = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(slices(F.col("text"))).alias("i", "data"))
    return V.reassemble(pieces, ["conv_id", "turn"], "i", "data")


def cited(spark, d):
    """Assistant turns as answers: a label after each, allowed or not by turn, and the allowed labels of the conversation."""
    label = F.concat(F.col("conv_id") % 9, F.lit("."), F.col("turn") % 4)
    said = table(spark, d, "conversations").where("role = 'assistant'")
    answers = said.select("conv_id", "turn", F.concat("text", F.lit(" ["), label, F.lit("]")).alias("answer"))
    allowed = said.select("conv_id").distinct().withColumn("labels", F.array(F.concat(F.col("conv_id") % 9, F.lit(".1")), F.concat(F.col("conv_id") % 9, F.lit(".3"))))
    return answers, allowed


SENTENCES = r"""WITH a AS (SELECT conv_id, turn, text || ' [' || (conv_id % 9) || '.' || (turn % 4) || ']' AS answer, [(conv_id % 9) || '.1', (conv_id % 9) || '.3'] AS labels FROM conversations WHERE role = 'assistant'),
 b AS (SELECT conv_id, turn, labels, string_split(regexp_replace(answer, '([.!?])\s+', '\1' || chr(2), 'g'), chr(2)) AS p FROM a),
 c AS (SELECT conv_id, turn, labels, unnest(list_filter(list_transform(p, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')) AS sentence, generate_subscripts(list_filter(p, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> ''), 1) - 1 AS place FROM b),
 e AS (SELECT *, regexp_extract(sentence, '\[([^\[\]]+)\]$', 1) AS label FROM c),
 f AS (SELECT *, label <> '' AND list_contains(labels, label) AND NOT regexp_matches(sentence, '(?i)\((see\s*)?\[[^\]]+\]\)') AS valid FROM e)"""


@query("q7_check_sentences", SENTENCES + " SELECT conv_id, turn, CAST(place AS INTEGER) AS place, sentence, valid FROM f")
def q7(spark, d):
    answers, allowed = cited(spark, d)
    cut = C.sentences(answers, ["conv_id", "turn"], citation_after_stop=False)
    return C.check_sentences(cut, allowed, ["conv_id"]).select("conv_id", "turn", "place", "sentence", "valid")


@query("q8_repair_sentence", SENTENCES + r" SELECT conv_id, turn, CAST(place AS INTEGER) AS place, regexp_replace(regexp_replace(sentence, '\s*\[[^\]]+\]\s*', '', 'g'), '^\s+|\s+$', '', 'g') || ' [' || CASE WHEN label <> '' AND list_contains(labels, label) THEN label ELSE labels[1] END || ']' AS repaired FROM f WHERE NOT valid")
def q8(spark, d):
    answers, allowed = cited(spark, d)
    cut = C.sentences(answers, ["conv_id", "turn"], citation_after_stop=False)
    return C.check_sentences(cut, allowed, ["conv_id"]).where("not valid").select("conv_id", "turn", "place", "repaired")


@query(
    "q9_fallback_on_run",
    SENTENCES + """, g AS (SELECT *, sum(CAST(valid AS INTEGER)) OVER (PARTITION BY conv_id, turn ORDER BY place) AS island FROM f), h AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, island, valid ORDER BY place) AS run FROM g)
 SELECT conv_id, turn, CAST(place AS INTEGER) AS place, NOT valid AND run % 3 = 0 AS filler FROM h""",
)
def q9(spark, d):
    answers, allowed = cited(spark, d)
    checked = C.check_sentences(C.sentences(answers, ["conv_id", "turn"], citation_after_stop=False), allowed, ["conv_id"])
    return C.fallback_on_run(checked.withColumnRenamed("valid", "passed"), ["conv_id", "turn"]).select("conv_id", "turn", "place", "filler")


# a label behind the stop stays with its sentence: a sentence ends before what is neither white space nor a label
WITH_LABELS = SENTENCES.replace(r"""regexp_replace(answer, '([.!?])\s+', '\1' || chr(2), 'g')""", r"""regexp_replace(answer, '([.!?](?:\s+\[[^\[\]]+\])*)\s+([^\s\[])', '\1' || chr(2) || '\2', 'g')""")


@query("q7_sentences_with_labels", WITH_LABELS + r" SELECT conv_id, turn, CAST(place AS INTEGER) AS place, sentence, valid, CASE WHEN valid THEN sentence ELSE regexp_replace(regexp_replace(sentence, '\s*\[[^\]]+\]\s*', '', 'g'), '^\s+|\s+$', '', 'g') || ' [' || CASE WHEN label <> '' AND list_contains(labels, label) THEN label ELSE labels[1] END || ']' END AS repaired FROM f")
def q7b(spark, d):
    answers, allowed = cited(spark, d)
    return C.check_sentences(C.sentences(answers, ["conv_id", "turn"]), allowed, ["conv_id"])


@query(
    "t5_validate_stream",
    WITH_LABELS + """, g AS (SELECT *, sum(CAST(valid AS INTEGER)) OVER (PARTITION BY conv_id, turn ORDER BY place) AS island FROM f), h AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, island, valid ORDER BY place) AS run FROM g)
 SELECT conv_id || '/' || turn AS req, CAST(place AS INTEGER) AS seq, sentence, valid, NOT valid AND run % 3 = 0 AS filler FROM h""",
)
def t5(spark, d):
    """Answers as streams of chunks, of which every second one comes a run of the stream earlier than the one before it."""
    from ..streaming.state import validate_stream

    inbox, progress, told = (scratch(spark, n) for n in ("chunks", "progress", "sentences"))
    answers, allowed = cited(spark, d)
    pieces = answers.join(allowed, "conv_id").select(F.concat_ws("/", "conv_id", "turn").alias("req"), F.posexplode(slices(F.col("answer"))).alias("i", "data"), F.lit("2024-01-01").cast("timestamp").alias("ts"), (F.col("i") == F.ceil(F.length("answer") / 64) - 1).alias("is_end"), F.col("labels").alias("allowed"))
    for odd in (1, 0):
        pieces.where(F.col("i") % 2 == odd).write.mode("append").parquet(inbox)
        stream = validate_stream(spark.readStream.schema(pieces.schema).parquet(inbox), repair=False)
        stream.writeStream.option("checkpointLocation", progress).trigger(availableNow=True).format("parquet").start(told).awaitTermination()
    return spark.read.schema(stream.schema).parquet(told)


@query("q10_answer_eval", "SELECT lang, count(*) AS tests, round(avg(CAST(contains(lower(text), lower(substring(source, 4))) AS INTEGER)), 6) AS pass_rate FROM documents GROUP BY lang")
def q10(spark, d):
    docs = table(spark, d, "documents")
    expected = docs.select("doc_id", "lang", F.substring("source", 4, 20).alias("expected"))
    return C.answer_eval(docs.select("doc_id", F.col("text").alias("answer")), expected, ["doc_id"], ["lang"])


@query("j6_resolve_citations", "SELECT conv_id, turn, (conv_id % 9) || '.' || (turn % 4) AS used, 'Part ' || (turn % 4) AS label, (conv_id % 9) || '.' || (turn % 4) AS code FROM conversations WHERE role = 'assistant' AND turn % 4 IN (1, 3) AND NOT contains(text, '[')")
def j6(spark, d):
    answers, allowed = cited(spark, d)
    plain = answers.where(~F.col("answer").rlike(r"\[.*\["))
    named = allowed.select("conv_id", F.explode("labels").alias("code")).withColumn("label", F.concat(F.lit("Part "), F.split_part("code", F.lit("."), F.lit(2))))
    keyed = named.join(plain.select("conv_id", "turn"), "conv_id")
    return C.resolve_citations(plain, keyed, ["conv_id", "turn"])


HITS = "(SELECT doc_id AS chunk_id, doc_id % 50 AS query_id, source, (doc_id * 37 % 1000) / 1000.0 AS score, CAST(doc_id % 8 AS INTEGER) AS page, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE (doc_id % 5) || '.0' END AS code FROM documents)"


def hits(spark, d):
    n = F.col("doc_id")
    code = F.when(n % 3 != 0, F.concat(n % 5, F.lit(".0")))
    return table(spark, d, "documents").select(
        n.alias("chunk_id"), (n % 50).alias("query_id"), "source", ((n * 37 % 1000) / 1000.0).alias("score"), (n % 8).cast("int").alias("page"), F.lit("").alias("primary_section_id2"),
        F.when(code.isNotNull(), F.array(code)).alias("primary_sections"), F.create_map(F.coalesce(code, F.lit("-")), F.lit(4)).alias("section_pages"),
        code.alias("section_code"), F.lit(None).cast("string").alias("section_title"), F.concat(F.lit(" Start "), (n % 5).cast("string")).alias("section_start"), (n % 8).cast("int").alias("first_page"),
    )


@query("w2_dedupe_hits", f"SELECT query_id, source, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source, code ORDER BY CAST(page = 4 AS INTEGER) DESC, score, chunk_id) AS r FROM {HITS}) WHERE code IS NULL OR r = 1")
def w2(spark, d):
    return C.dedupe_hits(hits(spark, d)).select("query_id", "source", "chunk_id", "score")


@query("w3_allowed_citations", f"WITH f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) AS r FROM {HITS}), g AS (SELECT *, 'Start ' || (chunk_id % 5) AS label, row_number() OVER (PARTITION BY query_id, source, chunk_id % 5 ORDER BY r) AS n FROM f WHERE r <= 6) SELECT query_id, source AS file, label, code, CASE WHEN page > 0 THEN page END AS page FROM g WHERE n = 1")
def w3(spark, d):
    return C.allowed_citations(hits(spark, d))
