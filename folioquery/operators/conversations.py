"""Chat histories: bookmarks, clean pairs, deletions, contexts, and request blocking. Windows by conversation or session."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import answer_title, or_empty, trimmed


def by_turn():
    return Window.partitionBy("conv_id").orderBy("turn")


def bookmarks(turns: DataFrame, stored_title: str | None = None) -> DataFrame:
    """conv_id, turn, ordinal, label of every user turn: the reply's stored or extracted title, else 60 characters of the question."""
    title = trimmed(or_empty(F.col(stored_title))) if stored_title else F.lit("")
    w = by_turn()
    seen = turns.withColumn("_role", F.lead("role").over(w)).withColumn("_text", F.lead("text").over(w)).withColumn("_title", F.lead(title).over(w))
    asked = F.concat(F.substring(or_empty(F.col("text")), 1, 60), F.when(F.length("text") > 60, "…").otherwise(""))
    replied = F.when(F.col("_role") == "assistant", F.coalesce(F.nullif("_title", F.lit("")), F.nullif(answer_title(F.col("_text")), F.lit(""))))
    users = seen.where("role = 'user'")
    return users.select("conv_id", "turn", (F.row_number().over(w) - 1).alias("ordinal"), F.coalesce(replied, asked).alias("label"))


def clean_pairs(turns: DataFrame) -> DataFrame:
    """Answered questions and their answers: of several questions before an answer the last; the rest is dropped."""
    w = by_turn()
    told = turns.where("role in ('user', 'assistant')").withColumn("_before", F.lag("role").over(w)).withColumn("_after", F.lead("role").over(w))
    return told.where("(role = 'user' and _after = 'assistant') or (role = 'assistant' and _before = 'user')").select(*turns.columns)


def number_duplicates(labels: DataFrame) -> DataFrame:
    """display: the label cut to 60 characters, numbered from its second appearance in the conversation."""
    shown = F.when(F.length("label") > 60, F.concat(F.substring("label", 1, 60), F.lit("…"))).otherwise(F.col("label"))
    nth = F.row_number().over(Window.partitionBy("conv_id", "_shown").orderBy("turn"))
    counted = labels.withColumn("_shown", shown).withColumn("_n", nth)
    return counted.withColumn("display", F.when(F.col("_n") > 1, F.concat_ws(" ", "_shown", "_n")).otherwise(F.col("_shown"))).drop("_shown", "_n")


def delete_pairs(turns: DataFrame, doomed: DataFrame) -> DataFrame:
    """turns without the n-th (from 0) user turn of each (conv_id, n) in doomed, and the assistant turn right after it."""
    w = by_turn()
    nth = F.sum((F.col("role") == "user").cast("int")).over(w) - 1
    placed = turns.withColumn("_n", nth.cast("long")).withColumn("_before", F.lag("role").over(w))
    hit = F.col("_n").eqNullSafe(F.col("n")) & ((F.col("role") == "user") | ((F.col("role") == "assistant") & (F.col("_before") == "user")))
    joined = placed.join(doomed.select(F.col("conv_id").alias("_c"), F.col("n").cast("long").alias("n")).distinct(), (F.col("conv_id") == F.col("_c")) & hit, "left_anti")
    return joined.select(*turns.columns)


def last_context(events: DataFrame, session: str, title: str, order: list[str]) -> DataFrame:
    """The latest non-empty title of every session."""
    return events.where(or_empty(F.col(title)) != "").groupBy(session).agg(F.max_by(title, F.struct(*order)).alias("last_title"))


def sticky_block(events: DataFrame, session: str, flagged, order: list[str]) -> DataFrame:
    """events with blocked: whether the session was flagged at or before this one, and since: the first flagged time."""
    first = events.where(flagged).groupBy(F.col(session).alias("_s")).agg(F.min(F.struct(*order)).alias("_first"))
    joined = events.join(first, F.col(session).eqNullSafe(F.col("_s")), "left")
    blocked = F.coalesce(F.struct(*order) >= F.col("_first"), F.lit(False))
    return joined.select(*events.columns, blocked.alias("blocked"), F.when(blocked, F.col(f"_first.{order[0]}")).alias("since"))


def block_until_lifted(requests: DataFrame) -> DataFrame:
    """sid, event_id, ts, blocked, since of every request (sid, event_id, ts, flagged, control): the batch twin of the stream.

    A flagged request blocks its session from then on; an event with the control "unblock" lifts that.
    """
    w = Window.partitionBy("sid").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    lifts = F.coalesce(F.col("control") == "unblock", F.lit(False))
    told = requests.withColumn("_lifts", lifts).withColumn("_span", F.sum(F.col("_lifts").cast("int")).over(w))
    own = Window.partitionBy("sid", "_span").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    since = F.min(F.when(F.col("flagged") & ~F.col("_lifts"), F.col("ts"))).over(own)
    return told.withColumn("since", since).select("sid", "event_id", "ts", F.col("since").isNotNull().alias("blocked"), "since")


def job_progress(events: DataFrame, job: str, entry: str, state: str, order: list[str]) -> DataFrame:
    """Latest state of every entry of a job, and when."""
    latest = F.max_by(F.struct(F.col(state).alias("state"), F.col(order[0]).alias("updated_at")), F.struct(*order))
    return events.groupBy(job, entry).agg(latest.alias("_l")).select(job, entry, "_l.state", "_l.updated_at")


def duplicate_jobs(jobs: DataFrame) -> DataFrame:
    """job_id, duplicate_of: jobs (job_id, step, mode, entries, started, ended) that ask what a job not yet done asks already.

    Every earlier job of the key counts until its end, also one that was itself suppressed; the stream twin, which knows
    what it let through, counts those only.
    """
    key = F.sha2(F.concat_ws("|", "step", "mode", F.array_join(F.array_sort("entries"), ",")), 256)
    before = Window.partitionBy("_key").orderBy("started", "job_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.struct("ended", "job_id")).over(before)
    marked = jobs.withColumn("_key", key).withColumn("_last", last)
    return marked.where(F.col("_last.ended") > F.col("started")).select("job_id", F.col("_last.job_id").alias("duplicate_of"))


def reassemble(pieces: DataFrame, keys: list[str], order: str, data: str) -> DataFrame:
    """Texts put together from ordered pieces."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(data).alias("d"))))
    return pieces.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["d"]), "").alias("text"))
