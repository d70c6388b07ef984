"""Documents to training sequences: quality rules, line dedup, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last
return the columns of documents. Other columns pass through. Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.llm.common import owned, quoted, table, written
from folioquery.llm.line_dedup import drop_boilerplate
from folioquery.llm.ngram_join import ngram_classes
from folioquery.llm.packing import pack_documents
from folioquery.llm.quality import judge_quality
from folioquery.llm.queries import END_ID, vocabulary
from folioquery.llm.repeats import PASSAGE, PASSAGE_GRAM, cut_repeats

CAPACITY = 1024


def carried(docs: DataFrame) -> DataFrame:
    """What operators need of docs, and all its columns under one name, so that none clashes with theirs."""
    return docs.select("doc_id", "source", "text", owned(docs, (), "text")[1])


def shaped(df: DataFrame, docs: DataFrame, text: str | Column = "text") -> DataFrame:
    """The columns of docs out of carried rows, with the text and n_chars as they are now."""
    names, _ = owned(docs, (), "text")
    now = df.withColumn("body", F.col(text) if isinstance(text, str) else text)
    return now.select(*[F.length("body").cast("long").alias(c) if c == "n_chars" else name for c, name in zip(docs.columns, names)])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, and boilerplate lines of those that stay."""
    return shaped(judge_quality(carried(docs)).where("kept"), docs, "left_text")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their host go. Equal texts are one page here, as copies are still there."""
    return shaped(drop_boilerplate(carried(docs), distinct=True), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest number; rows without a number stay."""
    first = written(ngram_classes(docs).where("doc_id = component_id").select("doc_id").distinct(), "first")
    one = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return one.union(docs.where("doc_id is null")).select(*[F.col(quoted(c)) for c in docs.columns])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that stand elsewhere too go, at every place; white space around them stays."""
    cut = cut_repeats(carried(docs), "text", PASSAGE, PASSAGE_GRAM, words=True)
    return shaped(cut, docs, F.when(F.col("text").isNotNull(), F.col("kept_bytes").cast("string")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most CAPACITY tokens, one row per piece of a document."""
    return pack_documents(docs, vocabulary("byte_bpe_50k.json"), CAPACITY, END_ID)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packing),
]
#: Repeated passages and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
