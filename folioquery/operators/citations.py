"""Citations and sentences of answers: resolution, checking, repair, and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import or_empty, trimmed, used_citations

# Forms that a sentence must not hold, and the label at its end.
FORBIDDEN = r"(?i)\((see\s*)?\[[^\]]+\]\)"
LAST_LABEL = r"\[([^\[\]]+)\]$"


def resolve_citations(answers: DataFrame, allowed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label and the allowed row (label or code) that an answer's used labels name; each pair once."""
    used = answers.select(*keys, F.explode(used_citations(F.col("answer"))).alias("used"))
    names = allowed.select(*keys, F.explode(F.array_distinct(F.array(trimmed(F.col("label")), trimmed(F.col("code"))))).alias("used"), "label", "code")
    return used.join(names, [*keys, "used"]).select(*keys, "used", "label", "code").distinct()


def sentences(answers: DataFrame, keys: list[str], text: str = "answer", citation_after_stop: bool = True) -> DataFrame:
    """keys, place, sentence: cut after [.!?] and white space; by default a label that follows the stop stays with its sentence."""
    body = or_empty(F.col(text))
    if citation_after_stop:
        body = F.regexp_replace(body, r"([.!?])\s+(\[[^\[\]]+\])", "$1\u0001$2")
        cut = F.regexp_replace(body, r"([.!?](?:\u0001\[[^\[\]]+\])*)\s+", "$1\u0002")
        parts = F.transform(F.split(cut, "\u0002"), lambda s: F.translate(s, "\u0001", " "))
    else:
        parts = F.split(F.regexp_replace(body, r"([.!?])\s+", "$1\u0002"), "\u0002")
    parts = F.filter(F.transform(parts, trimmed), lambda s: s != "")
    return answers.select(*keys, F.posexplode(parts).alias("place", "sentence"))


def is_valid(sentence: Column, allowed: Column) -> Column:
    label = trimmed(F.regexp_extract(sentence, LAST_LABEL, 1))
    return (label != "") & F.array_contains(allowed, label) & ~sentence.rlike(FORBIDDEN)


def repair_sentence(sentence: Column, allowed: Column) -> Column:
    """The sentence without its labels, and then its last label if that is allowed, else the first allowed one; null if none is."""
    labels = F.regexp_extract_all(sentence, F.lit(r"\[([^\]]+)\]"), F.lit(1))
    last = F.when(F.size(labels) > 0, trimmed(F.element_at(labels, -1)))
    label = F.when(F.coalesce(F.array_contains(allowed, last), F.lit(False)), last).otherwise(F.array_min(allowed))
    return F.when(label.isNotNull(), F.concat(trimmed(F.regexp_replace(sentence, r"\s*\[[^\]]+\]\s*", "")), F.lit(" ["), label, F.lit("]")))


def check_sentences(cut: DataFrame, allowed: DataFrame, keys: list[str]) -> DataFrame:
    """cut sentences with valid and repaired; allowed: keys and labels (array)."""
    joined = cut.join(allowed.select(*keys, "labels"), keys, "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))
    return joined.select(*cut.columns, is_valid(F.col("sentence"), F.col("labels")).alias("valid"), repair_sentence(F.col("sentence"), F.col("labels")).alias("repaired"))


def fallback_on_run(checked: DataFrame, keys: list[str], n: int = 3, passed: str = "passed") -> DataFrame:
    """checked with filler: true on every n-th sentence in a row that didn't pass."""
    w = Window.partitionBy(*keys).orderBy("place")
    island = F.sum(F.col(passed).cast("int")).over(w)
    run = F.row_number().over(Window.partitionBy(*keys, "_island", passed).orderBy("place"))
    marked = checked.withColumn("_island", island).withColumn("_run", run)
    return marked.withColumn("filler", ~F.col(passed) & (F.col("_run") % n == 0)).drop("_island", "_run")


def answer_eval(answers: DataFrame, expected: DataFrame, keys: list[str], group: list[str]) -> DataFrame:
    """Per group: tests, and the share of answers that hold the expected text in any case."""
    hit = F.lower(or_empty(F.col("answer"))).contains(F.lower("expected"))
    return expected.join(answers, keys).groupBy(*group).agg(F.count("*").alias("tests"), F.round(F.avg(hit.cast("int")), 6).alias("pass_rate"))


def dedupe_hits(hits: DataFrame, query: str = "query_id", key: Column | None = None) -> DataFrame:
    """Of hits of a query with one (source, key) the one on the section's own page, then of lower score, then of smaller id; keyless hits all stay."""
    own = key if key is not None else F.coalesce(F.nullif(F.trim(or_empty(F.col("primary_section_id2"))), F.lit("")), F.nullif(F.try_element_at("primary_sections", F.lit(1)), F.lit("")))
    wanted = F.try_element_at("section_pages", F.coalesce(F.try_element_at("primary_sections", F.lit(1)), F.lit("")))
    right = F.coalesce(F.col("page") == wanted, F.lit(False))
    keyed = hits.withColumn("_key", own).withColumn("_right", right)
    rank = F.row_number().over(Window.partitionBy(query, "source", "_key").orderBy(F.col("_right").desc(), "score", "chunk_id"))
    best = keyed.where("_key is not null").withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    return best.unionByName(keyed.where("_key is null")).drop("_key", "_right")


def allowed_citations(hits: DataFrame, query: str = "query_id", top: int = 6) -> DataFrame:
    """Per query the labels (title, else start, else code) of its first hits, each (file, label) once, in score order."""
    label = F.coalesce(*[F.nullif(trimmed(or_empty(F.col(c))), F.lit("")) for c in ("section_title", "section_start", "section_code")], F.lit(""))
    first = hits.withColumn("_r", F.row_number().over(Window.partitionBy(query).orderBy("score", "chunk_id"))).where(F.col("_r") <= top)
    named = first.withColumn("label", label)
    once = F.row_number().over(Window.partitionBy(query, "source", "label").orderBy("_r"))
    return named.withColumn("_n", once).where("_n = 1").select(query, F.col("source").alias("file"), "label", F.col("section_code").alias("code"), F.when(F.col("first_page") > 0, F.col("first_page")).alias("page"))
