"""Queries over the text functions, each over its whole table, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.sections import find_chunks
from ..sources import pages as P
from ..sources import store as K
from ..sources.pages import scratch

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query("s1_read_pages", "SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS page, doc_id, coalesce(replace(text, chr(160), ' '), '') AS text FROM documents")
def s1(spark, d):
    return P.numbered_pages(table(spark, d, "documents"))


@query("s3_content_hash", "SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents")
def s3(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))


@query("s9_flatten_metadata", "SELECT source, lang, '[' || string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) || ']' AS doc_ids FROM documents GROUP BY source, lang")
def s9(spark, d):
    grouped = table(spark, d, "documents").groupBy("source", "lang").agg(F.array_sort(F.collect_list("doc_id")).alias("doc_ids"))
    return P.flatten_metadata(grouped)


@query("s7_insert_chunks", "SELECT doc_id AS id, source FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, source FROM documents WHERE n_chars > 1000 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en' AND doc_id IS NOT NULL)")
def s7(spark, d):
    docs = table(spark, d, "documents")
    pick = lambda df: df.select(F.col("doc_id").alias("id"), "source")
    return P.insert_chunks(pick(docs.where("lang = 'en'")), pick(docs.where("n_chars > 1000")))


@query("s7_upsert_chunks", "SELECT doc_id AS id, 'new' AS origin FROM documents WHERE n_chars > 1000 UNION ALL SELECT doc_id, 'old' FROM documents WHERE lang = 'en' AND NOT coalesce(n_chars > 1000, false)")
def s7_upsert(spark, d):
    docs = table(spark, d, "documents")
    pick = lambda df, origin: df.select(F.col("doc_id").alias("id"), F.lit(origin).alias("origin"))
    return P.upsert_chunks(pick(docs.where("lang = 'en'"), "old"), pick(docs.where("n_chars > 1000"), "new"))


@query("s8_delete_source", "SELECT source, count(*) AS n FROM documents WHERE source IS DISTINCT FROM 'src3' GROUP BY source")
def s8(spark, d):
    left, _ = P.delete_source(table(spark, d, "documents"), "src3")
    return left.groupBy("source").agg(F.count("*").alias("n"))


@query("s7_store_upsert", "SELECT doc_id AS id, source, CASE WHEN n_chars > 1000 AND lang <> 'fr' THEN 'new' WHEN lang = 'en' THEN 'old' ELSE 'late' END AS origin FROM documents WHERE lang IN ('en', 'fr') OR n_chars > 1000")
def s7_store(spark, d):
    """A stored table, with rows put in place of others, then rows added that it lacks, read back."""
    docs, path = table(spark, d, "documents"), scratch(spark, "store")
    pick = lambda where, origin: docs.where(where).select(F.col("doc_id").alias("id"), "source", F.lit(origin).alias("origin"))
    K.create_store(pick("lang = 'en'", "old"), path)
    K.upsert_rows(pick("n_chars > 1000 AND lang <> 'fr'", "new"), path)
    K.insert_rows(pick("lang = 'fr' OR n_chars > 1000", "late"), path)
    return K.read_store(spark, path)


@query("s8_store_delete", "SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, (SELECT count(*) FROM documents WHERE source = 'src3') AS removed FROM documents WHERE source <> 'src3' GROUP BY source")
def s8_store(spark, d):
    docs, path = table(spark, d, "documents"), scratch(spark, "store")
    K.create_store(docs.select(F.col("doc_id").alias("id"), "source", "n_chars"), path)
    removed = K.delete_rows(spark, "src3", path)
    return K.read_store(spark, path).groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")).withColumn("removed", F.lit(removed).cast("long"))


@query("s10_lookup", "SELECT doc_id, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def s10(spark, d):
    return P.lookup(table(spark, d, "documents"), table(spark, d, "labels").where("quality = 1"), ["doc_id"]).select("doc_id", "source", "n_chars")


@query("s11_list_chunks", "SELECT source || '#p' || doc_id AS id, substring(text, 1, 160) AS preview FROM documents WHERE contains(lower(source || '#p' || doc_id), 'src1')")
def s11(spark, d):
    chunks = table(spark, d, "documents").select(F.concat("source", F.lit("#p"), "doc_id").alias("id"), "text")
    return P.list_chunks(chunks, "SRC1")


@query("f1_slugify", r"SELECT page_id, CASE WHEN s = '' THEN 'file' ELSE s END AS slug FROM (SELECT page_id, regexp_replace(regexp_replace(lower(coalesce(url, '')), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM pages)")
def f1(spark, d):
    return table(spark, d, "pages").select("page_id", X.slugify(F.col("url")).alias("slug"))


@query("f2_f3_page_names", "SELECT doc_id, source || '_p' || lpad(CAST(greatest(1, doc_id % 10000) AS VARCHAR), 4, '0') || '.pdf' AS name, CAST(greatest(1, doc_id % 10000) AS INTEGER) AS page FROM documents")
def f2(spark, d):
    named = table(spark, d, "documents").select("doc_id", X.page_name(F.col("source"), F.col("doc_id") % 10000).alias("name"))
    return named.withColumn("page", X.parse_page(F.col("name")))


CODE = "'S' || (doc_id % 7) || ' – ' || (doc_id % 5) || '/' || lang"


@query("f4_f5_section_ids", r"SELECT doc_id, source || '#s' || lower(regexp_replace(regexp_replace(replace(replace(" + CODE + r", '–', '-'), '/', '_'), '\s*-[\s-]*', '-', 'g'), '\s+', ' ', 'g')) AS id FROM documents")
def f5(spark, d):
    code = F.concat(F.lit("S"), F.col("doc_id") % 7, F.lit(" – "), F.col("doc_id") % 5, F.lit("/"), "lang")
    return table(spark, d, "documents").select("doc_id", X.section_doc_id(F.col("source"), code).alias("id"))


WORDS2 = "lower(array_to_string(list_slice(list_filter(string_split_regex(regexp_extract(coalesce(text, ''), '^[^\\n]*'), '[^a-zA-Z0-9]+'), lambda w: w <> ''), 1, 2), '-'))"


@query(
    "f6_section_id2",
    f"""WITH b AS (SELECT doc_id, source, regexp_extract(coalesce(text, ''), '^[^\\n]*') AS start, (doc_id % 9) || '.0-' || {WORDS2} AS own FROM documents),
    c AS (SELECT *, replace(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(source || '|' || own || '|' || start), '[^\\x00-\\x7F]', '', 'g')), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), ' ', '-') AS seed FROM b)
    SELECT doc_id, CASE WHEN regexp_full_match(own, '[A-Za-z0-9.]+-[a-z0-9-]+') AND start <> '' THEN own || '-' || substring(sha1(seed), 1, 4) ELSE '' END AS section_id2 FROM c""",
)
def f6(spark, d):
    start = F.regexp_extract(F.coalesce("text", F.lit("")), r"^[^\n]*", 0)
    return table(spark, d, "documents").select("doc_id", X.section_id2(F.col("source"), F.concat(F.col("doc_id") % 9, F.lit(".0")), F.lit(""), start).alias("section_id2"))


@query("f7_ascii_slug", r"SELECT doc_id, replace(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(regexp_extract(coalesce(text, ''), '^[^\n]*'))), '[^\x00-\x7F]', '', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), ' ', '-') AS slug FROM documents")
def f7(spark, d):
    return table(spark, d, "documents").select("doc_id", X.ascii_slug(F.regexp_extract(F.coalesce("text", F.lit("")), r"^[^\n]*", 0)).alias("slug"))


@query("f8_f11_codes", "SELECT doc_id, code, (NOT contains(code, '.') AND NOT contains(code, '/')) OR ends_with(code, '.0') AS major, CASE WHEN contains(code, '.') THEN code ELSE code || '.0' END AS number FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN (doc_id % 13) || '.0' WHEN 1 THEN (doc_id % 13) || '.' || (doc_id % 5) WHEN 2 THEN '' || (doc_id % 13) ELSE (doc_id % 13) || '/2' END AS code FROM documents)")
def f8(spark, d):
    n = F.col("doc_id")
    code = F.when(n % 4 == 0, F.concat(n % 13, F.lit(".0"))).when(n % 4 == 1, F.concat(n % 13, F.lit("."), n % 5)).when(n % 4 == 2, (n % 13).cast("string")).otherwise(F.concat(n % 13, F.lit("/2")))
    coded = table(spark, d, "documents").select("doc_id", code.alias("code"))
    return coded.select("doc_id", "code", X.is_major(F.col("code")).alias("major"), X.section_number(F.col("code")).alias("number"))


@query("f9_strip_retrieval_lines", r"SELECT conv_id, turn, regexp_replace(array_to_string(list_filter(string_split('Headers: a' || chr(10) || coalesce(text, '') || chr(10) || ' Overview: b', chr(10)), lambda x: NOT regexp_matches(x, '^\s*(Search hints:|Headers:|(?i:summary:|page summary:|overview:|key points:))')), chr(10)), '^\s+|\s+$', '', 'g') AS body FROM conversations")
def f9(spark, d):
    text = F.concat(F.lit("Headers: a\n"), F.coalesce("text", F.lit("")), F.lit("\n Overview: b"))
    return table(spark, d, "conversations").select("conv_id", "turn", X.strip_retrieval_lines(text).alias("body"))


@query("f10_clean_leaders", r"SELECT doc_id, array_to_string(list_transform(string_split(regexp_replace(regexp_replace(coalesce(text, '') || '......... 12', '…{2,}', '', 'g'), '\.{5,}', '', 'g'), chr(10)), lambda x: regexp_replace(regexp_replace(x, '\.{2,}\s*\d+\s*$', ''), '\s+$', '')), chr(10)) AS body FROM documents")
def f10(spark, d):
    return table(spark, d, "documents").select("doc_id", X.clean_leaders(F.concat(F.coalesce("text", F.lit("")), F.lit("......... 12"))).alias("body"))


@query("f12_f14_titles", r"SELECT p_partkey, CASE WHEN starts_with(lower(t), 'the ') THEN substring(t, 5) || ', The' WHEN starts_with(lower(t), 'a ') THEN substring(t, 3) || ', A' ELSE t END AS sorted, t || ' - ' || p_partkey || '.pdf' AS choice, p_partkey || '.pdf' AS source FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'The ' WHEN 1 THEN 'a ' ELSE '' END || p_name AS t FROM part)")
def f12(spark, d):
    n = F.col("p_partkey")
    titled = table(spark, d, "part").select("p_partkey", F.concat(F.when(n % 3 == 0, "The ").when(n % 3 == 1, "a ").otherwise(""), "p_name").alias("t"), F.concat(n, F.lit(".pdf")).alias("file"))
    choice = X.format_choice(F.col("t"), F.col("file"))
    return titled.select("p_partkey", X.sort_title(F.col("t")).alias("sorted"), choice.alias("choice"), X.choice_source(choice).alias("source"))


@query("f13_fallback_title", "SELECT s_suppkey, array_to_string(list_transform(string_split(replace(replace(lower(s_name), '#', ' '), '-', ' '), ' '), lambda w: upper(substring(w, 1, 1)) || substring(w, 2)), ' ') AS title FROM supplier")
def f13(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", X.fallback_title(F.concat(F.translate(F.lower("s_name"), "#", "_"), F.lit(".pdf"))).alias("title"))


LINES = "(SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)"


def lines(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", F.explode(X.lines_of(F.col("text"))).alias("line"))


@query("f16_title_case_lines", rf"SELECT source, count(*) AS n FROM (SELECT source, {TRIM.format('line')} AS s FROM {LINES}) WHERE length(s) BETWEEN 1 AND 80 AND NOT regexp_matches(s, '[.?!]$') AND NOT regexp_matches(s, '^[-•]') AND ((len(list_filter(string_split_regex(s, '\s+'), lambda w: regexp_matches(w, '\p{{L}}') AND w <> upper(w))) = 0 AND len(string_split_regex(s, '\s+')) <= 8) OR len(list_filter(string_split_regex(s, '\s+'), lambda w: regexp_matches(w, '^\p{{Lu}}'))) >= greatest(2, len(string_split_regex(s, '\s+')) // 2)) GROUP BY source")
def f16(spark, d):
    return lines(spark, d).where(X.title_case_header(F.col("line"))).groupBy("source").agg(F.count("*").alias("n"))


@query("f15_f17_headers", r"SELECT page_id, title, regexp_matches(title, '^\s*\d+(\.[A-Za-z0-9]+)+\b') AS is_header, lower(regexp_extract(title, '\d+(\.[A-Za-z0-9]+)+')) AS code FROM (SELECT page_id, (page_id % 20) || '.' || (page_id % 7) || ' Über' AS title FROM pages)")
def f15(spark, d):
    title = F.concat(F.col("page_id") % 20, F.lit("."), F.col("page_id") % 7, F.lit(" Über"))
    titled = table(spark, d, "pages").select("page_id", title.alias("title"))
    return titled.select("page_id", "title", X.is_header(F.col("title")).alias("is_header"), X.extract_code(F.col("title")).alias("code"))


@query("f18_match_keys", rf"SELECT conv_id, turn, regexp_replace({TRIM.format('split_part(' + TRIM.format('text') + ', chr(58), 1)')}, '[ :.]+$', '') AS key FROM conversations WHERE text IS NOT NULL")
def f18(spark, d):
    return table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", X.match_key(F.col("text")).alias("key"))


STOPS = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
TOKENS = f"list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '' AND NOT list_contains([{STOPS}], w))"


@query("f19_query_tokens", f"SELECT conv_id, turn, array_to_string({TOKENS}, ' ') AS tokens FROM conversations WHERE role = 'user'")
def f19(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.array_join(X.query_tokens(F.col("text")), " ").alias("tokens"))


MORE = "CASE WHEN regexp_matches(t, '[^aeiou]y$') THEN t[:-2] || 'ies' WHEN regexp_matches(t, '(s|x|z|ch|sh)$') THEN t || 'es' ELSE t || 's' END"


@query("f20_plural_variants", f"SELECT DISTINCT t, array_to_string(list_sort(list_distinct(list_filter([t, CASE WHEN ends_with(t, 'ies') AND length(t) > 3 THEN t[:-4] || 'y' END, CASE WHEN ends_with(t, 'es') AND length(t) > 2 THEN t[:-3] END, CASE WHEN ends_with(t, 's') AND length(t) > 1 THEN t[:-2] END, {MORE}], lambda x: x IS NOT NULL))), ' ') AS variants FROM (SELECT unnest({TOKENS}) AS t FROM conversations WHERE role = 'user')")
def f20(spark, d):
    tokens = table(spark, d, "conversations").where("role = 'user'").select(F.explode(X.query_tokens(F.col("text"))).alias("t")).distinct()
    return tokens.select("t", F.array_join(F.array_sort(X.plural_variants(F.col("t"))), " ").alias("variants"))


def first_of(items: str) -> str:
    """A list without later equals of an element."""
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


PLURALS = f"list_filter([w, CASE WHEN ends_with(t, 'ies') AND length(t) > 3 THEN t[:-4] || 'y' WHEN ends_with(t, 'es') AND length(t) > 2 THEN t[:-3] WHEN ends_with(t, 's') AND length(t) > 1 THEN t[:-2] END, {MORE}], lambda x: x IS NOT NULL)"
VARIANTS = rf"""WITH q AS (SELECT conv_id, turn, {TRIM.format('text')} AS raw FROM conversations WHERE role = 'user'), w AS (SELECT conv_id, turn, i, k[i] AS w, lower(k[i]) AS t FROM (SELECT *, unnest(range(1, least(6, len(k)) + 1)) AS i FROM (SELECT *, regexp_extract_all(raw, '([A-Za-z][A-Za-z\-]{{2,}})', 1) AS k FROM q))),
 p AS (SELECT conv_id, turn, i, CASE WHEN regexp_full_match(w, '\p{{L}}+') THEN {PLURALS} ELSE [w] END AS forms FROM w), f AS (SELECT conv_id, turn, flatten(list(forms ORDER BY i)) AS forms FROM p GROUP BY conv_id, turn),
 v AS (SELECT q.conv_id, q.turn, raw, substring(array_to_string({first_of('forms')}, ' '), 1, 200) AS tail FROM q LEFT JOIN f ON q.conv_id = f.conv_id AND q.turn = f.turn), b AS (SELECT conv_id, turn, CASE WHEN coalesce(raw, '') = '' THEN [] WHEN coalesce(tail, '') = '' OR {TRIM.format("raw || ' ' || tail")} = raw THEN [raw] ELSE [raw, {TRIM.format("raw || ' ' || tail")}] END AS l FROM v)
 SELECT conv_id, turn, CAST(unnest(range(0, len(l))) AS INTEGER) AS place, unnest(l) AS variant FROM b"""


@query("f21_query_variants", VARIANTS)
def f21(spark, d):
    asked = table(spark, d, "conversations").where("role = 'user'")
    return asked.select("conv_id", "turn", F.posexplode(X.query_variants(F.col("text"))).alias("place", "variant"))


@query("f22_ngram_phrases", f"SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1]), lambda p: length(p) >= 5) || list_filter(list_transform(range(1, len(k) - 1), lambda i: k[i] || ' ' || k[i + 1] || ' ' || k[i + 2]), lambda p: length(p) >= 7))), '|') AS phrases FROM (SELECT conv_id, turn, {TOKENS} AS k FROM conversations WHERE role = 'user')")
def f22(spark, d):
    asked = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", X.query_tokens(F.col("text")).alias("k"))
    return asked.select("conv_id", "turn", F.array_join(F.array_sort(X.ngram_phrases(F.col("k"))), "|").alias("phrases"))


EDGES = f"list_filter([base, replace(base, chr(39), '’'), replace(base, chr(39), 'ʼ'), CASE WHEN len(w) >= 4 THEN array_to_string(w[1:7], ' ') END], lambda x: x IS NOT NULL AND x <> '')"


@query("f23_edge_variants", f"WITH b AS (SELECT item_id, {TRIM.format('replace(text, chr(160), chr(32))')} AS base FROM benchmark), c AS (SELECT *, list_filter(string_split_regex(base, '\\s+'), lambda x: x <> '') AS w FROM b), e AS (SELECT item_id, {EDGES} AS l FROM c), u AS (SELECT item_id, {first_of('l')} AS l FROM e) SELECT item_id, CAST(unnest(range(0, len(l))) AS INTEGER) AS place, unnest(l) AS variant FROM u")
def f23(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.posexplode(X.edge_variants(F.col("text"))).alias("place", "variant"))


@query("f24_grep_preview", "SELECT doc_id, source, substring(text, greatest(1, instr(lower(text), 'license') - 150), 300 + 7) AS preview FROM documents WHERE contains(lower(text), 'license')")
def f24(spark, d):
    at = F.instr(F.lower("text"), "license")
    return table(spark, d, "documents").where(at > 0).select("doc_id", "source", F.substring(F.col("text"), F.greatest(F.lit(1), at - 150), F.lit(307)).alias("preview"))


@query("f25_find_chunks", "SELECT doc_id, source FROM documents WHERE ends_with(lower(source), '1') AND starts_with((doc_id % 9) || '.' || (doc_id % 4), '3.') AND contains(lower(text), 'the')")
def f25(spark, d):
    n = F.col("doc_id")
    chunks = table(spark, d, "documents").select("doc_id", "source", F.concat(n % 9, F.lit("."), n % 4).alias("section"), "text")
    return find_chunks(chunks, "1", "3.", "The").select("doc_id", "source")


@query("f26_section_match_rank", "SELECT doc_id, CASE WHEN num = '3' THEN 0 WHEN starts_with(num, '3.') THEN 1 WHEN lab = '3' THEN 2 WHEN starts_with(lab, '3.') THEN 3 END AS rank FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 6) || '.' || (doc_id % 3) ELSE '' END AS num, (doc_id % 5) || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '.' || (doc_id % 3) END AS lab FROM documents)")
def f26(spark, d):
    n = F.col("doc_id")
    number = F.when(n % 2 == 0, F.concat(n % 6, F.lit("."), n % 3)).otherwise("")
    label = F.concat(n % 5, F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("."), n % 3)), F.lit(" Title"))
    return table(spark, d, "documents").select("doc_id", X.section_match_rank(F.lit("3"), number, label).alias("rank"))


@query("f27_chunk_uid", "SELECT doc_id, regexp_replace(replace(replace(to_base64(unhex(sha1(source || '|' || doc_id || '|' || lang || '||' || substring(coalesce(text, ''), 1, 160)))), '+', '-'), '/', '_'), '=+$', '') AS uid FROM documents")
def f27(spark, d):
    return table(spark, d, "documents").select("doc_id", X.chunk_uid(F.col("text"), F.col("source"), F.col("doc_id"), F.col("lang"), F.lit(None).cast("string")).alias("uid"))


def either(words: list[str]) -> str:
    return r"\b(" + "|".join(words) + r")\b"


@query("f28_moderate", f"SELECT doc_id, regexp_matches(lower(coalesce(text, '')), '{either(X.ABUSE)}') OR (regexp_matches(lower(coalesce(text, '')), '{either(X.DEVELOPER)}') AND NOT regexp_matches(lower(coalesce(text, '')), '{either(X.DOMAIN)}') AND NOT contains(lower(coalesce(text, '')), lower(source))) AS flagged FROM documents")
def f28(spark, d):
    return table(spark, d, "documents").select("doc_id", X.moderate(F.col("text"), F.col("source")).alias("flagged"))


@query("f29_clip", "SELECT doc_id, sha256(CASE WHEN length(text) > 4000 THEN substring(text, 1, 4000) || ' …(truncated)' ELSE text END) AS digest FROM documents")
def f29(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(X.clip(F.col("text")), 256).alias("digest"))


@query("f30_slices", "SELECT conv_id, turn, i AS seq, substring(text, i * 64 + 1, 64) AS part FROM (SELECT *, unnest(range(0, CAST(ceil(length(text) / 64.0) AS INTEGER))) AS i FROM conversations WHERE role = 'assistant')")
def f30(spark, d):
    said = table(spark, d, "conversations").where("role = 'assistant'")
    return said.select("conv_id", "turn", F.posexplode(X.slices(F.col("text"))).alias("seq", "part")).withColumn("seq", F.col("seq").cast("long"))


KINDS = f"CASE WHEN regexp_matches(line, '{X.NUMBER_AND_TITLE}') THEN 'number_title' WHEN regexp_matches(line, '{X.NUMBER_ONLY}') THEN 'number' WHEN regexp_matches(line, '{X.CAPITALIZED.replace(chr(39), chr(39) * 2)}') THEN 'capitalized' ELSE 'none' END"


@query("f31_line_kinds", f"SELECT source, {KINDS} AS kind, count(*) AS n FROM {LINES} GROUP BY ALL")
def f31(spark, d):
    return lines(spark, d).groupBy("source", F.coalesce(X.line_kind(F.col("line")), F.lit("none")).alias("kind")).agg(F.count("*").alias("n"))


ANSWER = "text || ' [' || (conv_id % 9) || '.' || (turn % 4) || '] and [ Setup ] see [' || (conv_id % 9) || '.' || (turn % 4) || '].'"


def answers(spark, d):
    code = F.concat(F.col("conv_id") % 9, F.lit("."), F.col("turn") % 4)
    said = table(spark, d, "conversations").where("role = 'assistant'")
    return said.select("conv_id", "turn", F.concat("text", F.lit(" ["), code, F.lit("] and [ Setup ] see ["), code, F.lit("].")).alias("answer"))


@query("q2_used_citations", rf"SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all({ANSWER}, '\[([^\]]+)\]', 1), lambda x: {TRIM.format('x')}), lambda x: x <> ''))), '|') AS used FROM conversations WHERE role = 'assistant'")
def q2(spark, d):
    return answers(spark, d).select("conv_id", "turn", F.array_join(F.array_sort(X.used_citations(F.col("answer"))), "|").alias("used"))


@query("q3_link_citations", "SELECT conv_id, turn, text || ' [' || c || '](section:' || c || ') and [ Setup ](section:%20Setup%20) see [' || c || '](section:' || c || ').' AS linked FROM (SELECT *, (conv_id % 9) || '.' || (turn % 4) AS c FROM conversations WHERE role = 'assistant' AND text IS NOT NULL)")
def q3(spark, d):
    return answers(spark, d).select("conv_id", "turn", X.link_citations(F.col("answer")).alias("linked"))


MARKS = "'## **' || coalesce(text, '') || '** and `code` ~~gone~~ ![pic](a.png) [link](http://b/) __under__ \\*kept\\* _it_ <b>tag</b>'"
STEPS = [
    ("<[^>]+>", ""), (r"!\[(.*?)\]\((.*?)\)", r"\1"), (r"\[(.*?)\]\((.*?)\)", r"\1"), (r"^#{1,6}\s*", ""), (r"^>\s*", ""), (r"^\s*([-*+]\s+|\d+\.\s+)", ""),
    (r"\*\*(.*?)\*\*", r"\1"), ("__(.*?)__", r"\1"), (r"\*(.*?)\*", r"\1"), ("_(.*?)_", r"\1"), ("~~(.*?)~~", r"\1"), ("`([^`]+)`", r"\1"), (r"\\([\\`*_{}\[\]()#+\-.!])", r"\1"), (r"\s+", " "), (r"^\s+|\s+$", ""),
]


def bare_of(text: str) -> str:
    """SQL of the marks' removal, step by step."""
    out = TRIM.format(text)
    for pattern, by in STEPS:
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    return out


@query("q4_strip_markdown", f"SELECT 'page' AS kind, page_id AS id, 0 AS turn, sha256({bare_of("coalesce(html, '')")}) AS digest FROM pages UNION ALL SELECT 'said', conv_id, CAST(turn AS INTEGER), sha256({bare_of(MARKS)}) FROM conversations")
def q4(spark, d):
    marked = F.concat(F.lit("## **"), F.coalesce("text", F.lit("")), F.lit("** and `code` ~~gone~~ ![pic](a.png) [link](http://b/) __under__ \\*kept\\* _it_ <b>tag</b>"))
    digest = lambda c: F.sha2(X.strip_markdown(c), 256).alias("digest")
    pages = table(spark, d, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.lit(0).alias("turn"), digest(F.col("html")))
    return pages.union(table(spark, d, "conversations").select(F.lit("said"), "conv_id", F.col("turn").cast("int"), digest(marked)))


TITLE = r"regexp_replace(regexp_replace(regexp_extract(coalesce(text, ''), '^\s*([^\n]*)', 1), '^\s+|\s+$', '', 'g'), '^[#* ]+|[#* ]+$', '', 'g')"


@query("q5_answer_title", rf"SELECT conv_id, turn, CASE WHEN t <> '' AND length(t) <= 60 AND NOT regexp_matches(t, '^\p{{Ll}}') AND NOT regexp_matches(t, '^({'|'.join(X.SENTENCE_STARTS)}) ') AND NOT regexp_matches(t, '[.!?:]$') AND len(string_split_regex(t, '\s+')) <= 8 AND NOT regexp_matches(lower(t), '{'|'.join(X.MODALS)}') THEN t ELSE '' END AS title FROM (SELECT conv_id, turn, {TRIM.format(TITLE)} AS t FROM conversations WHERE role = 'assistant')")
def q5(spark, d):
    return table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", X.answer_title(F.col("text")).alias("title"))


SAID = "CASE CAST(turn % 4 AS INTEGER) WHEN 0 THEN '\"' || chr(39) || text || chr(39) || '\" ' WHEN 1 THEN ' ?! ' || chr(10) || text WHEN 2 THEN '\" ' || text || '...\"' ELSE text END"
CUT = r"regexp_replace(substring(regexp_replace({}, '[.!?:;,\s]+$', ''), 1, 60), '\s+$', '')"
HEAD = lambda c: TRIM.format(f"split_part({TRIM.format(c)}, chr(10), 1)")


@query("q6_tidy_title", f"WITH s AS (SELECT conv_id, turn, {HEAD('coalesce(' + SAID + chr(44) + ' chr(32))')} AS line, {HEAD("'Question ' || conv_id || ': ' || coalesce(text, '')")} AS q FROM conversations), b AS (SELECT *, {CUT.format("regexp_replace(regexp_replace(line, '^\"+|\"+$', '', 'g'), '^''+|''+$', '', 'g')")} AS cut FROM s) SELECT conv_id, turn, CASE WHEN cut <> '' THEN cut ELSE {CUT.format('q')} END AS title FROM b")
def q6(spark, d):
    n, text = F.col("turn") % 4, F.col("text")
    said = F.when(n == 0, F.concat(F.lit("\"'"), text, F.lit("'\" "))).when(n == 1, F.concat(F.lit(" ?! \n"), text)).when(n == 2, F.concat(F.lit('" '), text, F.lit('..."'))).otherwise(text)
    asked = F.concat(F.lit("Question "), "conv_id", F.lit(": "), F.coalesce(text, F.lit("")))
    return table(spark, d, "conversations").select("conv_id", "turn", X.tidy_title(said, asked).alias("title"))


@query("q11_toc_pages", rf"SELECT doc_id, sum(CAST(regexp_matches(line, '^\s*\d|\d\s*$') AS INTEGER)) AS numbered, count(*) AS lines, sum(CAST(regexp_matches(line, '^\s*\d|\d\s*$') AS INTEGER)) * 2 > count(*) AS is_toc FROM {LINES} WHERE line <> '' GROUP BY doc_id")
def q11(spark, d):
    hit = F.col("line").rlike(r"^\s*\d|\d\s*$").cast("int")
    counted = lines(spark, d).where("line <> ''").groupBy("doc_id").agg(F.sum(hit).alias("numbered"), F.count("*").alias("lines"))
    return counted.withColumn("is_toc", F.col("numbered") * 2 > F.col("lines"))
