"""Outlines that models make: merging batches, and checks against the headers that are there."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import or_empty, trimmed
from .sections import VALID_CODE

# Anchor prefixes of object kinds.
ANCHORS = {"definition": "def", "example": "ex", "table": "tbl", "figure": "fig", "chart": "chart", "box": "box", "note": "note"}


def merge_outline(batches: DataFrame) -> DataFrame:
    """Per source and code the row with the smallest first page; of equal ones the earliest batch."""
    row = F.struct("title", "first_page", "section_kind")
    good = batches.where((or_empty(F.col("code")) != "") & (F.col("first_page") > 0))
    return good.groupBy("source", "code").agg(F.min_by(row, F.struct("first_page", "batch")).alias("r")).select("source", "code", "r.title", "r.first_page", "r.section_kind")


def add_refined(outline: DataFrame, refined: DataFrame) -> DataFrame:
    """outline and the refined rows whose code it lacks."""
    return outline.unionByName(merge_outline(refined).join(outline.select("source", "code"), ["source", "code"], "left_anti"))


def merge_aliases(batches: DataFrame, outline: DataFrame) -> DataFrame:
    """Per source and phrase the code of the last batch, if the outline knows it."""
    last = batches.groupBy("source", "phrase").agg(F.max_by("code", F.struct("batch", "code")).alias("code"))
    return last.join(outline.select("source", "code").distinct(), ["source", "code"], "left_semi").select("source", "phrase", "code")


def merge_objects(batches: DataFrame, outline: DataFrame) -> DataFrame:
    """Objects with a known parent, a kind and a page; an anchor that isn't the parent's becomes <parent>.<kind>1."""
    kind = F.lower(trimmed(or_empty(F.col("kind"))))
    anchor = F.regexp_replace(or_empty(F.col("anchor_code")), "[^A-Za-z0-9.]", "")
    prefix = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in ANCHORS.items() for x in pair]), kind), F.lit("obj"))
    own = F.when((anchor != "") & anchor.startswith(F.col("parent_code")), anchor).otherwise(F.concat("parent_code", F.lit("."), prefix, F.lit("1")))
    good = batches.where((or_empty(F.col("parent_code")) != "") & (kind != "") & (F.col("first_page") > 0))
    known = outline.select("source", F.col("code").alias("parent_code")).distinct()
    return good.join(known, ["source", "parent_code"], "left_semi").select("source", "parent_code", kind.alias("kind"), "title", "first_page", own.alias("anchor_code"), "snippet")


def matching_ratio(a: Column, b: Column) -> Column:
    """Twice the characters in longest matching blocks, as a share of both texts, as the standard library has it; null for null."""
    from difflib import SequenceMatcher

    def ratios(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(left.to_pylist(), right.to_pylist())], pa.float64())

    return F.arrow_udf(ratios, "double")(a, b)


def unlike(a: Column, b: Column, least: float = 0.7) -> Column:
    """Whether the matching ratio of two texts is below `least`.

    Equal texts, and texts that differ too much in length to reach it, are told apart by that alone; blocks are only
    looked for in the others.
    """
    both = F.length(a) + F.length(b)
    alike, apart = a == b, 2 * F.least(F.length(a), F.length(b)) < least * both
    ask = ~alike & ~apart
    return F.when(alike, False).when(apart, True).otherwise(matching_ratio(F.when(ask, a), F.when(ask, b)) < least)


def outline_qa(outline: DataFrame, headers: DataFrame) -> DataFrame:
    """Per source: headers, outlined, found, coverage, missing, extra, and counts of page and title mismatches and bad codes."""
    seen = headers.select("source", "code", F.array_min("pages").alias("_page"), F.col("title").alias("_title"))
    both = outline.join(seen, ["source", "code"], "full_outer")
    bare = lambda c: F.regexp_replace(trimmed(or_empty(F.col(c))), "[:.]+$", "")
    here, there = F.col("first_page").isNotNull(), F.col("_page").isNotNull()
    far = here & there & (F.col("first_page") > 0) & (F.abs(F.col("first_page") - F.col("_page")) > 1)
    other = here & there & (bare("title") != "") & (bare("_title") != "")
    both = both.withColumns({"_own": F.when(other, F.lower(bare("title"))), "_other": F.when(other, F.lower(bare("_title")))}).withColumn("_unlike", F.coalesce(unlike(F.col("_own"), F.col("_other")), F.lit(False)))
    told = both.groupBy("source").agg(
        F.count_if(there).alias("headers"), F.count_if(here).alias("outlined"), F.count_if(here & there).alias("found"), F.count_if(~here & there).alias("missing"), F.count_if(here & ~there).alias("extra"),
        F.count_if(far).alias("page_mismatches"), F.count_if("_unlike").alias("title_mismatches"), F.count_if(here & ~F.col("code").rlike(VALID_CODE)).alias("invalid_codes"),
    )
    return told.withColumn("coverage", F.round(F.col("found") / F.greatest(F.lit(1), F.col("headers")), 6))


def code_sets(outline: DataFrame, headers: DataFrame) -> DataFrame:
    """source, code, side: in both, only outlined, or only in the pages."""
    a, b = outline.select("source", "code"), headers.select("source", "code")
    return a.intersect(b).withColumn("side", F.lit("both")).union(a.subtract(b).withColumn("side", F.lit("outline"))).union(b.subtract(a).withColumn("side", F.lit("headers")))


def unknown_targets(references: DataFrame, outline: DataFrame, target: str = "code") -> DataFrame:
    """Aliases or cross references whose target the outline lacks."""
    return references.join(outline.select("source", F.col("code").alias(target)).distinct(), ["source", target], "left_anti").select(*references.columns)


def object_qa(objects: DataFrame, headers: DataFrame) -> DataFrame:
    """objects with an issue: the anchor isn't the parent's, or the page is more than 5 from the parent's first."""
    seen = headers.select("source", F.col("code").alias("parent_code"), F.array_min("pages").alias("_page"))
    joined = objects.join(seen, ["source", "parent_code"], "left")
    stray = (or_empty(F.col("anchor_code")) != "") & ~F.col("anchor_code").startswith(F.col("parent_code"))
    far = (F.col("first_page") > 0) & (F.abs(F.col("first_page") - F.col("_page")) > 5)
    issues = F.array_compact(F.array(F.when(stray, "anchor_not_prefixed_by_parent"), F.when(far, "first_page_far_from_parent")))
    return joined.select(*objects.columns, F.explode(issues).alias("issue"))


def enrichment_violations(enriched: DataFrame) -> DataFrame:
    """Per source: counts of over-long summaries, too many keywords or anchors, keywords not in lower case, and bad breaks.

    enriched: source, summary, keywords, anchors (arrays), text, breaks (array of offsets). A break is bad outside the text, or
    between two letters or digits.
    """
    text = or_empty(F.col("text"))
    inside = lambda b: F.substring(text, b, F.lit(2)).rlike(r"^[\p{L}\p{N}]{2}$") & (b > 0) & (b < F.length(text))
    bad = F.size(F.filter(F.coalesce("breaks", F.array().cast("array<int>")), lambda b: (b < 0) | (b > F.length(text)) | inside(b)))
    size = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>")))
    raised = F.size(F.filter(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: k != F.lower(k)))
    return enriched.groupBy("source").agg(
        F.count_if(F.length("summary") > 160).alias("long_summaries"), F.count_if(size("keywords") > 8).alias("many_keywords"), F.sum(raised.cast("long")).alias("raised_keywords"), F.count_if(size("anchors") > 2).alias("many_anchors"), F.sum(bad.cast("long")).alias("bad_breaks")
    )


def batch_outcome(done: DataFrame, error: str = "error") -> DataFrame:
    return done.agg(F.count("*").alias("processed"), F.count_if(F.col(error).isNull()).alias("ok"), F.count_if(F.col(error).isNotNull()).alias("failed"))
