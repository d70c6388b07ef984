"""Queries over sources and catalogs, on driver tables in their parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as K
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


# parts as catalog entries: the brand is the title, every seventh has none; the file name starts with the part's name
CATALOG = "(SELECT p_name || '-' || p_partkey || '.pdf' AS source, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_brand END AS title, CAST(p_size AS BIGINT) AS size_bytes, 'old' AS updated_at, p_partkey FROM part)"
FILES = "(SELECT p_name || '-' || p_partkey || '.pdf' AS source, CAST(p_size * 2 AS BIGINT) AS size_bytes, 'new' AS updated_at, p_partkey FROM part WHERE p_partkey % 3 <> 0)"
STEM = r"regexp_replace(source, '\.[^.]*$', '')"


def catalog(spark, d):
    n = F.col("p_partkey")
    return table(spark, d, "part").select(F.concat("p_name", F.lit("-"), n, F.lit(".pdf")).alias("source"), F.when(n % 7 == 0, "").otherwise(F.col("p_brand")).alias("title"), F.col("p_size").cast("long").alias("size_bytes"), F.lit("old").alias("updated_at"), n)


def files(spark, d):
    n = F.col("p_partkey")
    return table(spark, d, "part").where(n % 3 != 0).select(F.concat("p_name", F.lit("-"), n, F.lit(".pdf")).alias("source"), (F.col("p_size") * 2).cast("long").alias("size_bytes"), F.lit("new").alias("updated_at"), n)


@query("j2_sources_for_title", f"SELECT DISTINCT t.title, c.source FROM (SELECT DISTINCT p_brand AS title FROM part UNION SELECT DISTINCT substring(p_name, 1, 6) FROM part) t JOIN {CATALOG} c ON trim(c.title) <> '' AND (lower(c.title) = lower(trim(t.title)) OR starts_with(lower(c.source), lower(trim(t.title)))) WHERE trim(t.title) <> ''")
def j2(spark, d):
    parts = table(spark, d, "part")
    titles = parts.select(F.col("p_brand").alias("title")).union(parts.select(F.substring("p_name", 1, 6)))
    return K.sources_for_title(catalog(spark, d), titles)


@query("j3_new_sources", f"SELECT f.source, f.size_bytes FROM {FILES} f WHERE f.source NOT IN (SELECT source FROM {CATALOG} WHERE p_partkey % 5 <> 0)")
def j3(spark, d):
    return K.new_sources(files(spark, d), catalog(spark, d).where("p_partkey % 5 <> 0")).select("source", "size_bytes")


@query("j4_stale_pages", "SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'v1' ELSE 'v2.3' END AS version, md5(coalesce(text, '')) AS sha256 FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0")
def j4(spark, d):
    docs = table(spark, d, "documents")
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    expected = docs.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, "v1").otherwise("v2.3").alias("version"), digest.alias("sha256"))
    store = docs.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("id"), F.lit("v2.3").alias("version"), digest.alias("sha256"))
    return K.stale_pages(expected, store)


@query(
    "j5_expected_vs_present",
    """WITH e AS (SELECT source, source || '#s' || (doc_id % 50) || '–' || (doc_id // 50 % 40) AS id FROM documents GROUP BY ALL), s AS (SELECT DISTINCT source || '#s' || (doc_id % 50) || CASE WHEN doc_id % 2 = 0 THEN '-' ELSE '_' END || (doc_id // 50 % 40) AS id FROM documents WHERE doc_id % 3 <> 0),
 h AS (SELECT source, e.id, replace(e.id, '–', '-') IN (SELECT id FROM s) OR replace(e.id, '–', '_') IN (SELECT id FROM s) AS found FROM e)
 SELECT source, count(*) AS expected, count(*) FILTER (found) AS present, count(*) FILTER (NOT found) AS missing, coalesce(string_agg(id, ',' ORDER BY id) FILTER (NOT found), '') AS missing_ids FROM h GROUP BY source""",
)
def j5(spark, d):
    docs, n = table(spark, d, "documents"), F.col("doc_id")
    code = lambda mark: F.concat("source", F.lit("#s"), n % 50, mark, F.expr("doc_id div 50 % 40"))
    expected = docs.select("source", code(F.lit("–")).alias("id"))
    store = docs.where(n % 3 != 0).select(code(F.when(n % 2 == 0, "-").otherwise("_")).alias("id"))
    return K.expected_vs_present(expected, store).withColumn("missing_ids", F.array_join("missing_ids", ","))


@query("j12_merge_catalog", f"SELECT coalesce(c.source, f.source) AS source, CASE WHEN coalesce(trim(c.title), '') <> '' THEN trim(c.title) ELSE regexp_replace(coalesce(c.source, f.source), '\\.[^.]*$', '') END AS title, coalesce(f.size_bytes, c.size_bytes) AS size_bytes, coalesce(f.updated_at, c.updated_at) AS updated_at FROM (SELECT * FROM {CATALOG} WHERE p_partkey % 5 <> 0) c FULL JOIN {FILES} f ON c.source = f.source")
def j12(spark, d):
    return K.merge_catalog(catalog(spark, d).where("p_partkey % 5 <> 0").drop("p_partkey"), files(spark, d))


@query("j12_backfill_catalog", f"SELECT source, title, size_bytes, updated_at FROM {CATALOG} WHERE p_partkey % 5 <> 0 UNION ALL SELECT source, {STEM}, size_bytes, updated_at FROM {FILES} WHERE p_partkey % 5 = 0")
def j12b(spark, d):
    return K.backfill_catalog(catalog(spark, d).where("p_partkey % 5 <> 0"), files(spark, d))


@query("j12_assign_title", f"SELECT source, CASE WHEN p_partkey % 3 <> 0 THEN 'Set' ELSE title END AS title, size_bytes FROM {CATALOG}")
def j12c(spark, d):
    return K.assign_title(catalog(spark, d).drop("p_partkey"), files(spark, d).select("source", F.lit("Set").alias("new_title"))).select("source", "title", "size_bytes")


@query("j13_resolve_source", f"SELECT name, min(source) AS source FROM (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN upper({STEM}) ELSE {STEM} END AS name FROM {CATALOG}) n JOIN {CATALOG} c ON lower(n.name) = lower(regexp_replace(c.source, '\\.[^.]*$', '')) GROUP BY name")
def j13(spark, d):
    known = catalog(spark, d)
    names = known.select(F.when(F.col("p_partkey") % 2 == 0, F.upper(K.stem(F.col("source")))).otherwise(K.stem(F.col("source"))).alias("name"))
    return K.resolve_source(names, known)


@query("a9_list_titles", f"SELECT lower(t) AS key, arg_min(t, source) AS title FROM (SELECT source, CASE WHEN trim(title) = '' THEN {STEM} ELSE trim(title) END AS t FROM {CATALOG}) GROUP BY lower(t)")
def a9(spark, d):
    return K.list_titles(catalog(spark, d))


STAGES = "(SELECT 's' || l_orderkey AS source, l_orderkey % 40 AS g, count(*) AS total_pages, count(*) FILTER (l_returnflag <> 'R') AS pages_exported, count(*) FILTER (l_linestatus = 'F') AS analyzed_present, count(*) FILTER (l_quantity > 10) AS evals_present, count(*) FILTER (l_orderkey % 2 = 0 AND l_tax > 0.01) AS sections_present, count(*) FILTER (l_tax > 0.01) AS chunks_present FROM lineitem GROUP BY l_orderkey)"


def stages(spark, d):
    n = F.col("l_orderkey")
    return (
        table(spark, d, "lineitem").groupBy("l_orderkey").agg(
            F.count("*").alias("total_pages"), F.count_if(F.col("l_returnflag") != "R").alias("pages_exported"), F.count_if(F.col("l_linestatus") == "F").alias("analyzed_present"),
            F.count_if(F.col("l_quantity") > 10).alias("evals_present"), F.count_if((n % 2 == 0) & (F.col("l_tax") > 0.01)).alias("sections_present"), F.count_if(F.col("l_tax") > 0.01).alias("chunks_present"),
        ).withColumn("source", F.concat(F.lit("s"), n))
    )


COMPLETE = "CASE WHEN sections_present > 0 THEN chunks_present = sections_present ELSE total_pages > 0 AND chunks_present = total_pages END"


@query("a7_source_status", f"SELECT source, total_pages, sections_present, chunks_present, {COMPLETE} AS complete FROM {STAGES}")
def a7(spark, d):
    return K.source_status(stages(spark, d)).select("source", "total_pages", "sections_present", "chunks_present", "complete")


@query("a6_title_progress", f"SELECT CAST(g AS BIGINT) AS title, bool_and({COMPLETE}) AS complete, CAST(sum(CASE WHEN sections_present > 0 THEN sections_present ELSE total_pages END) AS BIGINT) AS total, CAST(sum(chunks_present) AS BIGINT) AS chunks, CAST(sum(pages_exported) AS BIGINT) AS pages, CAST(sum(analyzed_present) AS BIGINT) AS analyzed, CAST(sum(evals_present) AS BIGINT) AS evals, round(least(1.0, CAST(sum(chunks_present) AS DOUBLE) / sum(CASE WHEN sections_present > 0 THEN sections_present ELSE total_pages END)), 6) AS ratio FROM {STAGES} GROUP BY g")
def a6(spark, d):
    told = stages(spark, d)
    return K.title_progress(told.select("source", (F.col("l_orderkey") % 40).cast("long").alias("title")), told)


PAGES = "(SELECT source, doc_id % 100 AS page, CASE WHEN doc_id % 4 = 0 THEN 'v1' ELSE 'v2.3' END AS version FROM documents)"


def paged(spark, d):
    return table(spark, d, "documents").select("source", (F.col("doc_id") % 100).alias("page"), F.when(F.col("doc_id") % 4 == 0, "v1").otherwise("v2.3").alias("version"))


@query("a10_section_counts", f"SELECT source, count(*) AS sections, count(DISTINCT CASE WHEN page > 0 THEN page END) AS pages FROM {PAGES} GROUP BY source")
def a10(spark, d):
    return K.section_counts(paged(spark, d))


@query("a11_processed_pages", f"SELECT source, max(page) AS total_pages, count(DISTINCT CASE WHEN version = 'v2.3' AND page >= 1 THEN page END) AS processed FROM {PAGES} GROUP BY source")
def a11(spark, d):
    pages = paged(spark, d)
    return K.processed_pages(pages.groupBy("source").agg(F.max("page").alias("total_pages")), pages, "v2.3")


@query("a12_storage_usage", "SELECT count(*) AS files, round(sum(n_chars) / 1048576.0, 6) AS megabytes, (SELECT count(DISTINCT conv_id) FROM conversations) AS conversations FROM documents")
def a12(spark, d):
    return K.storage_usage(table(spark, d, "documents"), "n_chars", table(spark, d, "conversations").select("conv_id"))


@query("a17_catalog_validation", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM orders")
def a17(spark, d):
    return K.catalog_validation(table(spark, d, "orders").withColumnRenamed("o_orderstatus", "status"))


@query("j9_citations_by_page", "WITH c AS (SELECT source, doc_id % 60 AS page, doc_id FROM documents), m AS (SELECT DISTINCT source, page, (doc_id % 6) || '.0' AS code FROM c WHERE doc_id % 2 = 0) SELECT * FROM m UNION SELECT DISTINCT source, page, (doc_id % 4) || '.1' FROM c WHERE (source, page) NOT IN (SELECT source, page FROM m)")
def j9(spark, d):
    n = F.col("doc_id")
    chunks = table(spark, d, "documents").select("source", (n % 60).alias("page"), F.when(n % 2 == 0, F.create_map(F.concat(n % 6, F.lit(".0")), n % 60)).alias("section_pages"), F.array(F.concat(n % 4, F.lit(".1"))).alias("primary_sections"))
    return K.citations_by_page(chunks)


@query("j10_locate_section", "SELECT (doc_id % 6) || '.0' AS label, source, min(doc_id % 60) AS page, arg_min(doc_id % 10 + 1.0, (doc_id % 60, doc_id % 10))::DOUBLE AS left_ FROM documents WHERE doc_id % 6 IN (1, 4) GROUP BY ALL")
def j10(spark, d):
    n = F.col("doc_id")
    label = F.concat(n % 6, F.lit(".0"))
    chunks = table(spark, d, "documents").select("source", F.create_map(label, n % 60).alias("section_pages"), F.create_map(label, F.array((n % 10 + 1).cast("double"), F.lit(2.0), F.lit(3.0), F.lit(4.0))).alias("header_anchors_pct"), label.alias("label"))
    wanted = chunks.select("label").where("label in ('1.0', '4.0')")
    return K.locate_section(chunks, wanted).select("label", "source", "page", F.col("bbox")[0].alias("left_"))
