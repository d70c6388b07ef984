"""Sections of page texts: lines, headers, schemes, spill-over, aggregation into section chunks, segments and batches."""

from __future__ import annotations

import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.text import or_empty, trimmed
from ..sources.pages import MODEL_OUTPUT
from . import batches

# Section code families of whole lines, and headings in words.
NUMERIC = r"^\s*(\d+\.)+\d+\s*(:?\s*$|\s\s*\S)"
LETTERED = r"^\s*([A-Za-z]\d+(\.[A-Za-z0-9]+)*[a-z]?|\d+[A-Za-z]\d+(\.[A-Za-z0-9]+)*[a-z]?)\.?\s*:?(\s*$|\s+\S)"
LETTERED_INSIDE = r"\b([A-Za-z]\d+(\.[A-Za-z0-9]+)*[a-z]?|\d+[A-Za-z]\d+(\.[A-Za-z0-9]+)*[a-z]?)\.?\s+([A-Z][A-Za-z0-9'\-/()]+\s+)+[A-Za-z0-9'\-/()]+\s*$"
HEADINGS = ["setup", "components?", "objective", "objectives", "overview", "how to play", "turn order", "game round", "player turn", "phases", "phase [a-z]", "end of (the )?game", "game end", "scoring", "glossary", "reference"]
WORDED = r"^[A-Z][A-Z0-9 &'\-/()]{3,}$|^[A-Z][a-z0-9'\-/()]+(\s+[A-Z][a-z0-9'\-/()]+){0,2}$|^(?i:" + "|".join(HEADINGS) + r")\b"
LETTERED_ITEM = r"^[A-Z]\)\s+.+$"
VALID_CODE = r"^(\d+(\.[A-Za-z0-9]+)+|[A-Za-z]\d+(\.[A-Za-z0-9]+)*[a-z]?|\d+[A-Za-z]\d+(\.[A-Za-z0-9]+)*[a-z]?)$"
# Matches that make a family primary; pages looked at; characters of a segment and of a batch, what a segment costs, lines of a batch.
PRIMARY, SCHEME_PAGES, SEGMENT, BATCH, SEGMENT_COST, BATCH_LINES = 5, 8, 1600, 24000, 32, 800


def lines(pages: DataFrame) -> DataFrame:
    """source, page, line_no, line."""
    return pages.select("source", "page", F.posexplode(X.lines_of(F.col("text"))).alias("line_no", "line"))


def code_path(code: Column) -> Column:
    """Sort key of a dotted code: its parts as numbers; empty, and so first, where there are none."""
    return F.transform(F.filter(F.split(or_empty(code), r"\."), lambda p: p.rlike(r"^\d+$")), lambda p: p.cast("int"))


def numeric_first(code: Column) -> list[Column]:
    """Sort columns: numeric codes by their parts, the others after them by text."""
    return [(F.size(code_path(code)) == 0), code_path(code), F.lower(code)]


def with_next_page(pages: DataFrame) -> DataFrame:
    """pages with next_text of page + 1, null where the source has no such page."""
    after = pages.select("source", (F.col("page") - 1).alias("page"), F.col("text").alias("next_text"))
    return pages.join(after, ["source", "page"], "left")


def header_offset(text: Column) -> Column:
    """Characters before the first header line of a text; null if it has none."""
    rows = X.lines_of(text)
    header = lambda line: X.is_header(line) | X.title_case_header(line) | trimmed(line).rlike(LETTERED_ITEM)
    first = F.array_min(F.filter(F.transform(rows, lambda line, k: F.when(header(line), k)), lambda k: k.isNotNull()))
    return F.when(first.isNotNull(), F.aggregate(F.slice(rows, 1, F.coalesce(first, F.lit(0))), F.lit(0), lambda n, line: n + F.length(line) + 1))


def loose_at(text: Column, phrase: Column, whole: bool = False) -> Column:
    """Characters before the first place of a phrase in any case and spacing; null if it isn't there. whole: as whole words."""
    escaped = F.regexp_replace(trimmed(phrase), r"([^\p{L}\p{N}\s])", r"\\$1")
    edge = F.lit(r"\b" if whole else "")
    pattern = F.concat(F.lit("(?iu)"), edge, F.regexp_replace(escaped, r"\s+", r"\\s+"), edge)
    return F.when(trimmed(or_empty(phrase)) != "", F.nullif(F.regexp_instr(text, pattern), F.lit(0)) - 1)


def with_spill(text: Column, spill: Column) -> Column:
    """A page and what runs on from it, a blank line between them."""
    return F.when(or_empty(spill) != "", trimmed(F.concat(trimmed(text), F.lit("\n\n"), spill))).otherwise(trimmed(text))


def spill_text(pages: DataFrame, boundary: str | None = None) -> DataFrame:
    """pages with full_text: the page and the start of the next, cut before its first header and at half its length at most.

    boundary: a column with the header that the model expects on the next page; where the next page holds it, it wins.
    Of the next page only its first half moves, and what a header that begins there may need.
    """
    bare = trimmed(F.col("text"))
    half = F.floor(F.length(bare) / 2).cast("int")
    after = pages.select("source", (F.col("page") - 1).alias("page"), half.alias("_half"), F.substring(bare, F.lit(1), half + 256).alias("_next"))
    both = pages.join(after, ["source", "page"], "left")
    at = header_offset(F.col("_next"))
    if boundary:
        at = F.coalesce(loose_at(F.col("_next"), F.col(boundary), whole=True), at)
    spill = F.regexp_replace(F.substring(F.col("_next"), F.lit(1), F.least(F.col("_half"), at)), r"\s+$", "")
    return both.withColumn("full_text", with_spill(F.col("text"), spill)).drop("_half", "_next")


def refine_spill(pages: DataFrame, starts: DataFrame) -> DataFrame:
    """pages with full_text: the page and the next one up to the earliest of the section starts that are told for that page.

    starts: source, page, section_start. A page after which none is told, or found, keeps the full_text it has, or its text.
    """
    after = pages.select("source", "page", F.col("text").alias("next"))
    found = after.join(starts.select("source", "page", "section_start"), ["source", "page"]).withColumn("at", loose_at(F.col("next"), F.col("section_start")))
    cut = found.where("at is not null").groupBy("source", "page").agg(F.min_by(F.expr("substring(next, 1, at)"), "at").alias("_spill"))
    cut = cut.select("source", (F.col("page") - 1).alias("page"), F.regexp_replace("_spill", r"\s+$", "").alias("_spill"))
    held = F.col("full_text") if "full_text" in pages.columns else F.col("text")
    joined = pages.join(cut, ["source", "page"], "left")
    return joined.withColumn("full_text", F.when(F.col("_spill").isNotNull(), with_spill(F.col("text"), F.col("_spill"))).otherwise(held)).drop("_spill")


def scan_headers(pages: DataFrame) -> DataFrame:
    """source, label, count, first_page: numbered titles, and numbers whose title is the next line that isn't empty.

    Of numbers in a row every second one is the title of the one before.
    """
    w = Window.partitionBy("source", "page").orderBy("line_no")
    told = lines(pages).where(trimmed(F.col("line")) != "").withColumn("kind", X.line_kind(F.col("line")))
    told = told.withColumn("alone", F.coalesce(F.col("kind") == "number", F.lit(False))).withColumn("title", F.lead(trimmed(F.col("line"))).over(w))
    told = told.withColumn("block", F.sum((~F.col("alone")).cast("int")).over(w)).withColumn("place", F.sum(F.col("alone").cast("int")).over(Window.partitionBy("source", "page", "block").orderBy("line_no")))
    told = told.withColumn("asks", F.col("alone") & (F.col("place") % 2 == 1) & F.col("title").isNotNull()).withColumn("taken", F.coalesce(F.lag("asks").over(w), F.lit(False)))
    number = F.regexp_extract("line", r"^\s*(\d+(\.\d+)*)", 1)
    own = trimmed(F.substring_index(F.regexp_replace(trimmed(F.col("line")), r"^\d+(\.\d+)*\s+", ""), ":", 1))
    label = F.when(F.col("taken"), None).when(F.col("kind") == "number_title", F.concat_ws(" ", number, own)).when(F.col("asks"), F.concat_ws(" ", number, trimmed(F.substring_index("title", ":", 1))))
    return told.withColumn("label", label).where("label is not null").groupBy("source", "label").agg(F.count("*").alias("count"), F.min("page").alias("first_page"))


def section_index(chunks: DataFrame) -> DataFrame:
    """Per label: chunks and first page."""
    return chunks.where(trimmed(or_empty(F.col("section"))) != "").groupBy(trimmed(F.col("section")).alias("label")).agg(F.count("*").alias("count"), F.min("page").alias("first_page"))


def detect_scheme(pages: DataFrame, most: int = SCHEME_PAGES, known: DataFrame | None = None) -> DataFrame:
    """Per source: matching lines of each family on the first pages, and the scheme; known: source, scheme overrides."""
    bare = lines(pages.where(F.col("page") <= most)).select("source", trimmed(F.col("line")).alias("line"))
    hit = lambda *patterns: F.count_if(F.col("line").rlike("|".join(patterns)))
    told = bare.groupBy("source").agg(hit(NUMERIC).alias("numeric"), hit(LETTERED, LETTERED_INSIDE).alias("alphanum"), hit(WORDED).alias("words"))
    strong = (F.col("numeric") >= PRIMARY) | (F.col("alphanum") >= PRIMARY)
    scheme = F.when(strong, F.when(F.col("numeric") > F.col("alphanum"), "numeric").otherwise("alphanum")).when(F.col("words") > 0, "words").otherwise("numeric")
    told = told.withColumn("scheme", scheme)
    if known is not None:
        told = told.join(known.select(F.col("source"), F.col("scheme").alias("_known")), "source", "left").withColumn("scheme", F.coalesce("_known", "scheme")).drop("_known")
    return told


def header_index(pages: DataFrame, form: str | None = None) -> DataFrame:
    """Per source and code: its pages in order, and the title where it is seen first.

    form: a pattern that whole codes have to have, where the numbering of the pages is known; a line may also begin with
    a network address, say, which looks like a code of four numbers.
    """
    told = lines(pages).where(X.is_header(F.col("line"))).withColumn("code", X.extract_code(F.col("line"))).withColumn("title", X.match_key(F.regexp_replace(trimmed(F.col("line")), r"^\S+\s*", "")))
    if form:
        told = told.where(F.col("code").rlike(f"^(?:{form})$"))
    return told.groupBy("source", "code").agg(F.array_sort(F.collect_set("page")).alias("pages"), F.min_by("title", F.struct("page", "line_no")).alias("title"))


def first_run(pages: DataFrame, keys: list[str]) -> DataFrame:
    """The pages of each key up to its first gap."""
    w = Window.partitionBy(*keys).orderBy("page")
    ranked = pages.select(*keys, "page").distinct().withColumn("_n", F.row_number().over(w)).withColumn("_first", F.min("page").over(Window.partitionBy(*keys)))
    return ranked.where(F.col("page") - F.col("_n") == F.col("_first") - 1).select(*keys, "page")


def earliest_anchor(items: DataFrame) -> DataFrame:
    """source, section_id, anchor: the valid box (percent of the page) of the smallest page."""
    box = F.col("header_bbox_pct")
    inside = (F.size(box) >= 4) & box[0].between(0, 100) & box[1].between(0, 100) & (box[2] > 0) & (box[2] <= 100) & (box[3] > 0) & (box[3] <= 100)
    return items.where(inside).groupBy("source", "section_id").agg(F.min_by(F.slice("header_bbox_pct", 1, 4), F.struct("page", "header_bbox_pct")).alias("anchor"))


def aggregate_sections(artifacts: DataFrame, version: str, keyword_scope: str = "page") -> DataFrame:
    """Section chunks from page artifacts (pdf, page, llm): first title, start and id, pages up to the first gap, texts, keywords.

    keyword_scope "page": every keyword of the artifact's page; "major": those of a section's own item, for major codes only.
    A page's text is that of the artifact of the largest page that speaks for it. Sets are sorted.
    """
    items = artifacts.select(F.col("pdf").alias("source"), F.col("page").alias("artifact"), "llm.full_text", F.trim(or_empty(F.col("llm.summary"))).alias("page_summary"), F.col("llm.search_keywords").alias("page_keywords"), F.posexplode("llm.sections").alias("place", "item"))
    code = trimmed(or_empty(F.col("item.section_id")))
    keywords = F.col("page_keywords") if keyword_scope == "page" else F.when(X.is_major(code), F.col("item.search_keywords"))
    items = items.select(
        "source", "artifact", "place", "full_text", "page_summary", code.alias("section_id"), F.coalesce("item.page", "artifact").alias("page"), F.col("item.header_bbox_pct").alias("header_bbox_pct"),
        *[F.nullif(trimmed(or_empty(F.col(f"item.{c}"))), F.lit("")).alias(c) for c in ("title", "section_start", "section_id_2", "summary")],
        F.filter(F.transform(F.coalesce(keywords, F.array().cast("array<string>")), trimmed), lambda k: k != "").alias("keywords"),
    ).where("section_id <> ''")
    order = F.struct("artifact", "place")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    named = items.groupBy("source", "section_id").agg(first("title"), first("section_start"), first("section_id_2"), F.array_sort(F.collect_set("summary")).alias("summaries"), F.array_sort(F.collect_set(F.nullif("page_summary", F.lit("")))).alias("page_summaries"), F.min("page").alias("first_page"))
    run = first_run(items, ["source", "section_id"])
    texts = items.groupBy("source", "section_id", "page").agg(F.max_by("full_text", "artifact").alias("text"), F.array_distinct(F.flatten(F.collect_list("keywords"))).alias("keywords"))
    body = run.join(texts, ["source", "section_id", "page"]).groupBy("source", "section_id").agg(F.array_sort(F.collect_list(F.struct("page", "text", "keywords"))).alias("parts"))
    joined = named.join(body, ["source", "section_id"]).join(earliest_anchor(items), ["source", "section_id"], "left")
    pages = F.transform("parts", lambda p: p["page"])
    keys = F.array_sort(F.array_distinct(F.flatten(F.transform("parts", lambda p: p["keywords"]))))
    texts_ = F.filter(F.transform("parts", lambda p: p["text"]), lambda t: trimmed(or_empty(t)) != "")
    block = lambda c, lead="": F.when(c != "", F.concat(F.lit(lead), c))
    embed = F.concat_ws(
        "\n\n", trimmed(F.concat_ws(" ", F.lit("Section:"), "section_id", "title")), block(F.array_join(F.concat("summaries", "page_summaries"), "\n")), block(F.array_join(keys, ", "), "Search hints: KW: "),
        block(F.array_join(pages.cast("array<string>"), ", "), "Pages: "), block(F.array_join(texts_, "\n\n")),
    )
    stem = F.regexp_replace("source", r"\.[^.]*$", "")
    return joined.select(
        X.section_doc_id(stem, F.col("section_id")).alias("id"), "source", embed.alias("text"), F.col("section_id").alias("section_code"), F.col("section_id_2").alias("section_id2"), or_empty(F.col("title")).alias("section_title"),
        or_empty(F.col("section_start")).alias("section_start"), "first_page", pages.alias("pages"), F.coalesce(F.try_element_at("summaries", F.lit(1)), F.try_element_at("page_summaries", F.lit(1)), F.lit("")).alias("summary"),
        F.lit(version).alias("version"), F.lit("section").alias("chunk_kind"), F.when(F.col("anchor").isNotNull(), F.create_map("section_id", "anchor")).alias("header_anchors_pct"),
    )


def segment_lines(pages: DataFrame, most: int = SEGMENT) -> DataFrame:
    """source, page, part, text: whole lines, as many as fit."""
    rows = X.lines_of(trimmed(F.col("text")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("held"), F.lit(0).alias("size"))

    def add(state: Column, line: Column) -> Column:
        full = (state["size"] > 0) & (state["size"] + F.length(line) + 1 > most)
        return F.struct(
            F.when(full, F.concat(state["done"], F.array(F.array_join(state["held"], "\n")))).otherwise(state["done"]).alias("done"),
            F.when(full, F.array(line)).otherwise(F.concat(state["held"], F.array(line))).alias("held"),
            F.when(full, F.length(line) + 1).otherwise(state["size"] + F.length(line) + 1).alias("size"),
        )

    parts = F.aggregate(rows, start, add, lambda s: F.concat(s["done"], F.array(F.array_join(s["held"], "\n"))))
    return pages.where(trimmed(or_empty(F.col("text"))) != "").select("source", "page", F.posexplode(parts).alias("_k", "text")).select("source", "page", (F.col("_k") + 1).alias("part"), "text")


def pack_batches(segments: DataFrame, most: int = BATCH, cost: int = SEGMENT_COST, items: int | None = None) -> DataFrame:
    """source, page, part, batch: segments in order of page and part, as many to a batch as fit; items: and no more than so many.

    Only lengths move, and no task reads a source as a whole; see batches.
    """
    sized = segments.select("source", F.col("page").cast("int").alias("page"), F.col("part").cast("int").alias("part"), (F.length("text") + cost).cast("long").alias("n"))
    return batches.pack_batches(sized, most, items)


def embed_text(pages: DataFrame) -> DataFrame:
    """source, page, embed: summary, search hints (bounded lists), headers, and the text. pages: with arrays questions, synonyms, rules, keywords, headers."""
    few = lambda c, n, size: F.transform(F.slice(F.coalesce(F.col(c), F.array().cast("array<string>")), 1, n), lambda x: F.substring(x, 1, size))
    hint = lambda name, parts, sep: F.when(F.size(parts) > 0, F.concat(F.lit(name + ": "), F.array_join(parts, sep)))
    hints = F.concat_ws(" | ", hint("Q", few("questions", 5, 140), "; "), hint("SYN", few("synonyms", 20, 50), ", "), hint("R", few("rules", 8, 140), "; "), hint("KW", few("keywords", 24, 50), ", "))
    heads = F.array_join(F.coalesce("headers", F.array().cast("array<string>")), " | ")
    whole = F.concat_ws("\n\n", F.nullif(trimmed(or_empty(F.col("summary"))), F.lit("")), F.when(hints != "", F.concat(F.lit("Search hints: "), hints)), F.when(heads != "", F.concat(F.lit("Headers: "), heads)), "text")
    return pages.select("source", "page", whole.alias("embed"))


def page_section_split(artifacts: DataFrame) -> DataFrame:
    """source, page, primary, continuation (codes of the page itself and of the next), and maps of code to page, title and summary."""
    own = F.filter(F.coalesce("llm.sections", F.array()), lambda s: trimmed(or_empty(s["section_id"])) != "")
    code = lambda s: trimmed(s["section_id"])
    on = lambda k: F.array_distinct(F.transform(F.filter("own", lambda s: F.coalesce(s["page"], F.col("page")) == F.col("page") + k), code))
    mapped = lambda f: F.map_from_entries(F.transform(F.array_distinct(F.transform("own", code)), lambda c: F.struct(c, f(F.element_at(F.filter("own", lambda s: code(s) == c), -1)))))
    return artifacts.select("pdf", "page", own.alias("own")).select(
        F.col("pdf").alias("source"), "page", on(0).alias("primary"), on(1).alias("continuation"), mapped(lambda s: F.coalesce(s["page"], F.col("page"))).alias("section_pages"), mapped(lambda s: s["title"]).alias("section_titles"), mapped(lambda s: s["summary"]).alias("section_summaries")
    )


def salvage_json(outputs: DataFrame, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """outputs with llm parsed from the text, a fenced block, or the first balanced object that has what it needs; and the rows of which none has.

    The first two are native; only rows that both miss are scanned for braces, in Arrow batches.
    """
    needed = ("sections", "visuals", "visual_importance")
    whole = trimmed(or_empty(F.col(raw)))
    fenced = trimmed(F.regexp_extract(whole, r"(?is)```(?:json)?\s*(.*?)```", 1))
    good = lambda s: s.startswith("{") & F.try_parse_json(s).isNotNull() & F.forall(F.array(*map(F.lit, needed)), lambda k: F.array_contains(F.json_object_keys(s), k))
    found = outputs.withColumn("_json", F.when(good(whole), whole).when(good(fenced), fenced))
    scan = F.pandas_udf(balanced_objects, T.StringType())
    found = found.withColumn("_json", F.coalesce("_json", scan(F.when(F.col("_json").isNull(), whole))))
    parsed = found.withColumn("llm", F.from_json("_json", MODEL_OUTPUT))
    return parsed.where("_json is not null").drop("_json"), parsed.where("_json is null").drop("_json", "llm")


def balanced_objects(texts: pd.Series) -> pd.Series:
    """The first balanced {...} of each text that parses and has the needed keys; braces in strings don't count."""
    def first(text):
        start = text.find("{") if isinstance(text, str) else -1
        while start >= 0:
            try:
                value, end = json.JSONDecoder().raw_decode(text, start)
                if isinstance(value, dict) and {"sections", "visuals", "visual_importance"} <= value.keys():
                    return text[start:end]
            except ValueError:
                pass
            start = text.find("{", start + 1)
        return None

    return pd.Series([first(t) for t in texts], dtype=object)


def salvage_array(outputs: DataFrame, raw: str = "raw") -> DataFrame:
    """outputs with items: the objects (code, title, first_page) of the text's outermost array that have a code and a page number."""
    whole = trimmed(or_empty(F.col(raw)))
    inner = F.when(whole.startswith("[") & whole.endswith("]"), whole).otherwise(F.regexp_extract(whole, r"(?s)\[.*\]", 0))
    told = F.from_json(inner, "array<struct<code: string, title: string, first_page: string>>")
    clean = F.transform(F.coalesce(told, F.array()), lambda x: F.struct(trimmed(or_empty(x["code"])).alias("code"), trimmed(or_empty(x["title"])).alias("title"), x["first_page"].try_cast("int").alias("first_page")))
    return outputs.withColumn("items", F.filter(clean, lambda x: (x["code"] != "") & x["first_page"].isNotNull()))


def toc_pages(pages: DataFrame, top: int = 10) -> DataFrame:
    """source, page, lines, numbered, titled, is_toc: whether a page is a table of contents or an index.

    It is where most of its lines that aren't blank begin or end with a number, or where one of its first `top` lines
    names it and a quarter of them do.
    """
    told = lines(pages).where(trimmed(F.col("line")) != "")
    numbered = F.count_if(F.col("line").rlike(r"^\s*\d|\d\s*$"))
    titled = F.count_if((F.col("line_no") < top) & F.col("line").rlike(r"(?i)^\s*(table of contents|contents( continued)?|index)\s*$"))
    counted = told.groupBy("source", "page").agg(F.count("*").alias("lines"), numbered.alias("numbered"), titled.alias("titled"))
    return counted.withColumn("is_toc", (F.col("numbered") * 2 > F.col("lines")) | ((F.col("titled") > 0) & (F.col("numbered") * 4 >= F.col("lines"))))


def find_chunks(chunks: DataFrame, source_end: str = "", section_start: str = "", contains: str = "") -> DataFrame:
    """Chunks (source, section, text) whose source ends, in any case, whose section starts, and whose text has, in any case, what is asked."""
    hit = F.lower(or_empty(F.col("source"))).endswith(source_end.lower()) & trimmed(or_empty(F.col("section"))).startswith(section_start)
    return chunks.where(hit & F.lower(or_empty(F.col("text"))).contains(contains.lower()))


def merge_codes(batches: DataFrame) -> DataFrame:
    """source, code, first_page, title: the earliest page and the first title that isn't empty."""
    title = F.min_by("title", F.when(trimmed(or_empty(F.col("title"))) != "", F.col("batch")))
    return batches.where(or_empty(F.col("code")) != "").groupBy("source", "code").agg(F.min("first_page").alias("first_page"), title.alias("title"))


def outline_prompt(pages: DataFrame, most: int = 8, size: int = 1800) -> DataFrame:
    """Per source the first pages under page marks."""
    block = F.concat(F.lit("=== Page "), "page", F.lit(" ===\n"), F.substring(trimmed(F.col("text")), 1, size))
    parts = F.array_sort(F.collect_list(F.struct("page", block.alias("block"))))
    return pages.where(F.col("page") <= most).groupBy("source").agg(F.array_join(F.transform(parts, lambda p: p["block"]), "\n\n").alias("prompt"))


def title_prompt(pages: DataFrame, most: int = 10, size: int = 500) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("page", F.substring("text", 1, size).alias("head"))))
    return pages.where(F.col("page") <= most).groupBy("source").agg(F.array_join(F.transform(parts, lambda p: p["head"]), "\n\n").alias("prompt"))


def grep_context(pages: DataFrame, pattern: str, around: int = 2, ignore_case: bool = True, most: int | None = None) -> DataFrame:
    """source, page, line_no, line, context of the lines that match: the line with `around` lines before and after on its page.

    most: hits per source, first in order of page and line.
    """
    w = Window.partitionBy("source", "page").orderBy("line_no")
    near = F.array_join(F.collect_list("line").over(w.rowsBetween(-around, around)), "\n")
    hit = F.col("line").rlike(("(?i)" if ignore_case else "") + pattern)
    # only pages with a hit are cut into windows
    some = pages.where(F.col("text").rlike(("(?i)" if ignore_case else "") + pattern))
    found = lines(some).withColumn("context", near).where(hit)
    if most is None:
        return found
    order = Window.partitionBy("source").orderBy("page", "line_no")
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")
