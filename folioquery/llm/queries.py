"""One query per corpus operator, over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .exact_dedup import exact_groups, plain
from .fingerprints import compare_with_next
from .line_dedup import drop_boilerplate
from .ngram_join import ngram_classes
from .oracles import ORACLES
from .packing import pack_documents
from .periodic_runs import find_runs
from .quality import judge_quality
from .ranked_search import search
from .repeats import PASSAGE, cut_repeats, removed_digest
from .token_shards import token_shards
from .url_filter import judge_urls
from .warc import round_trip
from .word_bpe import digests, encode_documents

END_ID = 2


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_classes(table(spark, sf_dir, "documents"))


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_digest(cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), passage=PASSAGE))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 1024, END_ID)


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), END_ID)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = drop_boilerplate(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "source", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


def op8_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_left", F.sha2(F.encode("left_text", "UTF-8"), 256).alias("left_sha256"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(plain(F.col("text")).cast("binary"), 256).alias("text_sha256"))
    return exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """docs with every tenth text, by its number's checksum, made periodic from some word on."""
    words, i = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)")), F.col("i")
    told = docs.withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary"))).withColumn("g", F.expr("h div 10"))
    told = told.withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("w").cast("long"))
    told = told.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    periodic = F.expr("array_join(transform(sequence(1L, n), k -> element_at(w, cast(if(k - 1 >= a, a + (k - 1 - a) % p, k - 1) + 1 as int))), ' ')")
    return told.select("doc_id", F.when(F.col("a").isNotNull(), periodic).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = find_runs(with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length, (-r.start).alias("back"), (-r.period).alias("short"))))
    told = told.withColumns({"n_runs": F.size("runs").cast("long"), "best": best})
    lines = F.concat(F.lit(""), F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))), ""))
    return told.select(
        "doc_id", "n_runs", (-F.col("best.back")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.short")).alias("period"),
        F.expr("1000 * best.length div -best.short").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_repeats, op3_warc, op4_url_filter, op5_packing, op6_token_shards, op7_line_dedup, op8_word_bpe, op9_fingerprints, op10_quality, op11_exact_dedup, op12_periodic_runs, op13_ranked_search)}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
