"""Sources, their titles, their completeness, and differences between what is expected and what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import or_empty, trimmed


def stem(name):
    return F.regexp_replace(name, r"\.[^.]*$", "")


def sources_for_title(catalog: DataFrame, titles: DataFrame) -> DataFrame:
    """title, source: sources whose title is equal in any case, or whose file name starts with it; untitled sources never match.

    The two conditions are joined apart: equality by hash, prefixes by their first three characters, and shorter ones by
    all they have, so that neither is a nested loop over the catalog.
    """
    known = catalog.where(trimmed(or_empty(F.col("title"))) != "").select(F.lower(trimmed(F.col("title"))).alias("_t"), "source", F.lower("source").alias("_f"))
    asked = titles.select("title", F.lower(trimmed(F.col("title"))).alias("_key")).where("_key <> ''").distinct()
    equal = asked.join(known, F.col("_key") == F.col("_t")).select("title", "source")
    short = 3
    head = lambda c: F.substring(c, 1, short)
    long = asked.where(F.length("_key") >= short).join(known, (head("_key") == head("_f")) & F.col("_f").startswith(F.col("_key"))).select("title", "source")
    few = asked.where(F.length("_key") < short)
    tiny = few.join(known.withColumn("_n", F.explode(F.array(F.lit(1), F.lit(2)))), (F.length("_key") == F.col("_n")) & (F.col("_key") == F.expr("substring(_f, 1, _n)"))).select("title", "source")
    return equal.union(long).union(tiny).distinct()


def new_sources(files: DataFrame, catalog: DataFrame) -> DataFrame:
    return files.join(catalog.select("source"), "source", "left_anti")


def stale_pages(expected: DataFrame, store: DataFrame) -> DataFrame:
    """Expected pages (id, version, sha256) that the store lacks or holds at another version or hash."""
    keys = ["id", "version", "sha256"]
    return expected.join(store.select(*keys), keys, "left_anti")


def id_variants(identifier):
    """The id, with a hyphen for an en dash in its code, and with underscores for those hyphens."""
    base, code = F.substring_index(identifier, "#s", 1), F.element_at(F.split(identifier, "#s", 2), -1)
    plain = F.replace(code, F.lit("–"), F.lit("-"))
    return F.array_distinct(F.array(identifier, F.concat(base, F.lit("#s"), plain), F.concat(base, F.lit("#s"), F.replace(plain, F.lit("-"), F.lit("_")))))


def expected_vs_present(expected: DataFrame, store: DataFrame) -> DataFrame:
    """Per source: expected, present and missing counts, and the missing ids in order."""
    tried = expected.select("source", "id").distinct().withColumn("variant", F.explode(id_variants(F.col("id"))))
    hit = tried.join(store.select(F.col("id").alias("variant")).distinct(), "variant", "left_semi").select("source", "id").distinct().withColumn("found", F.lit(True))
    told = expected.select("source", "id").distinct().join(hit, ["source", "id"], "left")
    missing = F.col("found").isNull()
    return told.groupBy("source").agg(
        F.count("*").alias("expected"), F.count("found").alias("present"), F.count_if(missing).alias("missing"), F.array_sort(F.collect_list(F.when(missing, F.col("id")))).alias("missing_ids")
    )


def merge_catalog(catalog: DataFrame, files: DataFrame) -> DataFrame:
    """source, title, size_bytes, updated_at: user titles stay, sizes and times are refreshed, missing files stay, new ones get their stem."""
    new = files.select("source", F.col("size_bytes").alias("_size"), F.col("updated_at").alias("_time"))
    both = catalog.join(new, "source", "full_outer")
    return both.select("source", F.coalesce(F.nullif(trimmed(or_empty(F.col("title"))), F.lit("")), stem(F.col("source"))).alias("title"), F.coalesce("_size", "size_bytes").alias("size_bytes"), F.coalesce("_time", "updated_at").alias("updated_at"))


def backfill_catalog(catalog: DataFrame, files: DataFrame) -> DataFrame:
    absent = new_sources(files, catalog).select("source", stem(F.col("source")).alias("title"), "size_bytes", "updated_at")
    return catalog.select("source", "title", "size_bytes", "updated_at").union(absent)


def assign_title(catalog: DataFrame, named: DataFrame) -> DataFrame:
    """named: source, new_title. Sources that the catalog lacks are added."""
    both = catalog.join(named, "source", "full_outer")
    return both.select("source", F.coalesce("new_title", "title").alias("title"), "size_bytes", "updated_at")


def resolve_source(names: DataFrame, catalog: DataFrame) -> DataFrame:
    """name, source: by exact stem, else by stem in any case; of several the first in order."""
    known = catalog.select("source", stem(F.col("source")).alias("_stem"))
    joined = names.select("name").distinct().join(known, F.lower("name") == F.lower("_stem"))
    return joined.groupBy("name").agg(F.min(F.struct((F.col("_stem") != F.col("name")).alias("differs"), F.col("source"))).alias("best")).select("name", "best.source")


def list_titles(catalog: DataFrame) -> DataFrame:
    """Titles distinct in any case, spelled as in the first source, stems for the untitled."""
    title = F.coalesce(F.nullif(trimmed(or_empty(F.col("title"))), F.lit("")), stem(F.col("source")))
    return catalog.withColumn("_t", title).groupBy(F.lower("_t").alias("key")).agg(F.min_by("_t", "source").alias("title"))


def source_status(stages: DataFrame) -> DataFrame:
    """stages with complete: as many chunks as sections if there are any, else as pages."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    complete = F.when(n("sections_present") > 0, n("chunks_present") == n("sections_present")).otherwise((n("total_pages") > 0) & (n("chunks_present") == n("total_pages")))
    return stages.withColumn("complete", complete)


def title_progress(catalog: DataFrame, stages: DataFrame, admin: bool = True) -> DataFrame:
    """Per title: complete where all of its sources are, the ratio of chunks to what they should be, and the stage counts."""
    n = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0))
    whole = F.when(n("sections_present") > 0, n("sections_present")).otherwise(n("total_pages"))
    joined = catalog.select("source", "title").join(source_status(stages), "source", "left")
    told = joined.groupBy("title").agg(
        F.bool_and(F.coalesce("complete", F.lit(False))).alias("complete"), F.sum(whole).alias("total"), F.sum(n("chunks_present")).alias("chunks"), F.sum(n("pages_exported")).alias("pages"),
        F.sum(n("analyzed_present")).alias("analyzed"), F.sum(n("evals_present")).alias("evals"),
    )
    ratio = F.when(F.col("total") > 0, F.least(F.lit(1.0), F.col("chunks") / F.col("total"))).otherwise(F.lit(0.0))
    told = told.withColumn("ratio", F.round(ratio, 6))
    return told if admin else told.where("complete")


def section_counts(chunks: DataFrame) -> DataFrame:
    """Per source: chunks and distinct pages over 0."""
    return chunks.groupBy("source").agg(F.count("*").alias("sections"), F.count_distinct(F.when(F.col("page") > 0, F.col("page"))).alias("pages"))


def processed_pages(totals: DataFrame, store: DataFrame, version: str) -> DataFrame:
    """Per source of totals (source, total_pages): pages 1..total that the store (source, page, version) has at the version."""
    have = store.where(F.col("version") == version).select(F.col("source").alias("_s"), "page").distinct()
    joined = totals.join(have, (F.col("source") == F.col("_s")) & F.col("page").between(1, F.col("total_pages")), "left")
    return joined.groupBy("source", "total_pages").agg(F.count("page").alias("processed"))


def storage_usage(files: DataFrame, size: str = "size_bytes", conversations: DataFrame | None = None) -> DataFrame:
    """files and megabytes, and with a table of conversation numbers how many there are."""
    told = files.agg(F.count("*").alias("files"), F.round(F.coalesce(F.sum(size), F.lit(0)) / 1048576, 6).alias("megabytes"))
    if conversations is None:
        return told
    return told.withColumn("conversations", F.lit(conversations.distinct().count()))


def catalog_validation(entries: DataFrame) -> DataFrame:
    """Totals by status, and under 'total' of all."""
    return entries.groupBy("status").agg(F.count("*").alias("n")).union(entries.agg(F.count("*").alias("n")).select(F.lit("total"), "n"))


def citations_by_page(chunks: DataFrame) -> DataFrame:
    """source, page, code: codes mapped to a page; pages of chunks without any get their primary sections."""
    mapped = chunks.select("source", F.explode("section_pages").alias("code", "page")).select("source", "page", "code").distinct()
    pages = chunks.join(mapped.select("source", "page").distinct(), ["source", "page"], "left_anti")
    return mapped.union(pages.select("source", "page", F.explode("primary_sections").alias("code"))).distinct()


def locate_section(chunks: DataFrame, labels: DataFrame) -> DataFrame:
    """label, source, page, bbox: the earliest page of a label among the chunks that map it."""
    mapped = chunks.select("source", F.explode("section_pages").alias("label", "page"), "header_anchors_pct").withColumn("bbox", F.try_element_at("header_anchors_pct", "label"))
    found = mapped.join(labels.select("label").distinct(), "label").groupBy("label", "source").agg(F.min(F.struct("page", F.col("bbox").isNull().alias("n"), "bbox")).alias("first"))
    return found.select("label", "source", "first.page", "first.bbox")


def page_ranks(pages: DataFrame) -> DataFrame:
    """Pages present, the last, and the gaps of every source."""
    w = Window.partitionBy("source").orderBy("page")
    gaps = pages.select("source", "page").distinct().withColumn("gap", F.col("page") - F.lag("page", 1, 0).over(w) - 1)
    return gaps.groupBy("source").agg(F.count("*").alias("present"), F.max("page").alias("last"), F.sum("gap").alias("absent"))
