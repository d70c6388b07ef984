"""Column functions over names, codes, header lines, queries and answers. Native expressions but for compatibility folding."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Header line families at the start of a line.
NUMERIC_HEADER = r"^\s*\d+(\.[A-Za-z0-9]+)+\b"
LETTER_HEADER = r"^\s*[A-Za-z]\d+(\.[A-Za-z0-9]+)*[a-z]?\b"
DIGIT_LETTER_HEADER = r"^\s*\d+[A-Za-z]\d+(\.[A-Za-z0-9]+)*[a-z]?\b"
# Section codes anywhere in a header, in order of preference.
CODES = [r"[A-Za-z]\d+(\.[A-Za-z0-9]+)*[a-z]?", r"\d+[A-Za-z]\d+(\.[A-Za-z0-9]+)*[a-z]?", r"\d+(\.[A-Za-z0-9]+)+"]
# Line kinds.
NUMBER_AND_TITLE = r"^\s*\d+(\.\d+)*\s+\S.*$"
NUMBER_ONLY = r"^\s*\d+(\.\d+)*\.?\s*:?\s*$"
CAPITALIZED = r"^\s*[A-Z][A-Za-z0-9][A-Za-z0-9 &'\-/()]+\s*$"
# Starts of lines that only serve retrieval; the first two by exact case, the others in any case.
RETRIEVAL_LINE = r"^\s*(Search hints:|Headers:|(?i:summary:|page summary:|overview:|key points:))"
# Words that queries are stripped of.
STOP_WORDS = [
    "a", "about", "an", "and", "are", "be", "been", "being", "by", "can", "could", "did", "do", "does", "explain", "for", "how", "in", "is", "may", "me", "might", "must", "of", "on", "or",
    "please", "shall", "should", "tell", "the", "to", "use", "uses", "using", "was", "were", "what", "when", "where", "who", "why", "will", "with", "would",
]
# Abuse, developer and domain vocabulary of the request filter.
ABUSE = [
    "jailbreak", "dan", r"developer\s+mode", r"system\s+prompt", r"ignore\s+(all\s+)?previous\s+(instructions|directions)", r"prompt\s*injection",
    "exploit", "hack(ing)?", r"sql\s+injection", "passwords?", r"credit\s+card", "ssn", "terror", "bomb", "kill", "violence", "porn", "sex(ual)?",
]
DEVELOPER = ["python", "javascript", "typescript", "react", "sql", "docker", "kubernetes", "api", "server", "npm"]
DOMAIN = ["rules?", "setup", "turn", "cards?", "dice", "board", "meeples?", "scor(e|ing)", r"win(ning)?\s+conditions?"]
# Starts and words that give a sentence away, not a title.
SENTENCE_STARTS = "The In To A An This That You When Where How What Why If During After Before For With From".split()
MODALS = "can should will would could must may might".split()


def trimmed(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def or_empty(s: Column) -> Column:
    return F.coalesce(s, F.lit(""))


def lines_of(text: Column) -> Column:
    """Lines of a text, whatever marks their ends."""
    return F.split(F.regexp_replace(or_empty(text), "\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x85  ]", "\n"), "\n", -1)


def slugify(s: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(or_empty(s)), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", F.lit("file")).otherwise(slug)


def page_name(slug: Column, page: Column) -> Column:
    return F.format_string("%s_p%04d.pdf", slug, F.greatest(F.lit(1), page.cast("int")))


def parse_page(name: Column) -> Column:
    """Page of a file name: four digits after the last _p, else the number of a pN name, else 1."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    number = F.coalesce(F.regexp_extract(stem, r"_p(\d{4})[^_]*$", 1).try_cast("int"), F.regexp_extract(stem, r"^p(\d+)$", 1).try_cast("int"), F.lit(1))
    return F.greatest(number, F.lit(1))


def normalize_code(s: Column) -> Column:
    dashed = F.translate(trimmed(or_empty(s)), "–—/", "--_")
    return F.lower(F.regexp_replace(F.regexp_replace(dashed, r"\s*-[\s-]*", "-"), r"\s+", " "))


def section_doc_id(stem: Column, code: Column) -> Column:
    return F.concat(stem, F.lit("#s"), normalize_code(code))


@F.pandas_udf(T.StringType())
def decomposed(texts: pd.Series) -> pd.Series:
    """The ASCII characters of the compatibility decomposition (NFKD)."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode("ascii")).astype(object)


def ascii_fold(s: Column) -> Column:
    """ASCII text as it is; of other text the ASCII characters of its decomposition. Only the latter goes through Python."""
    plain = s.rlike(r"^[\x00-\x7F]*$")
    return F.when(plain, s).otherwise(decomposed(F.when(~plain, s)))


def ascii_slug(s: Column) -> Column:
    """Lower case without accents, spaces as hyphens; letters without a decomposition to ASCII go."""
    return F.regexp_replace(trimmed(F.regexp_replace(F.lower(ascii_fold(or_empty(s))), r"\s+", " ")), " ", "-")


def section_id2(source: Column, code: Column, base: Column, start: Column) -> Column:
    """Base (or code and two words of the header) with four digits of a hash; empty where there is neither."""
    words = F.filter(F.split(or_empty(start), "[^a-zA-Z0-9]+"), lambda w: w != "")
    valid = r"^[A-Za-z0-9.]+-[a-z0-9-]+$"
    own = F.when(or_empty(base).rlike(valid), base).otherwise(F.concat_ws("-", code, ascii_slug(F.array_join(F.slice(words, 1, 2), "-"))))
    seed = ascii_slug(F.concat_ws("|", source, own, start))
    good = own.rlike(valid) & (or_empty(start) != "")
    return F.when(good, F.concat_ws("-", own, F.substring(F.sha1(seed.cast("binary")), 1, 4))).otherwise(F.lit(""))


def is_major(code: Column) -> Column:
    return (~code.contains(".") & ~code.contains("/")) | code.endswith(".0")


def strip_retrieval_lines(text: Column) -> Column:
    return trimmed(F.array_join(F.filter(lines_of(text), lambda line: ~line.rlike(RETRIEVAL_LINE)), "\n"))


def clean_leaders(text: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(or_empty(text), "…{2,}", ""), r"\.{5,}", "")
    return F.array_join(F.transform(lines_of(bare), lambda line: F.regexp_replace(F.regexp_replace(line, r"\.{2,}\s*\d+\s*$", ""), r"\s+$", "")), "\n")


def section_number(s: Column) -> Column:
    bare = trimmed(or_empty(s))
    return F.when((bare == "") | bare.contains("."), bare).otherwise(F.concat(bare, F.lit(".0")))


def sort_title(s: Column) -> Column:
    bare = trimmed(or_empty(s))
    return F.when(bare.rlike("(?i)^the "), F.concat(F.substring(bare, 5, 1 << 30), F.lit(", The"))).when(bare.rlike("(?i)^a "), F.concat(F.substring(bare, 3, 1 << 30), F.lit(", A"))).otherwise(bare)


def fallback_title(name: Column) -> Column:
    return F.initcap(F.translate(F.regexp_replace(name, r"\.pdf$", ""), "-_", "  "))


def format_choice(title: Column, source: Column) -> Column:
    return F.concat(title, F.lit(" - "), source)


def choice_source(choice: Column) -> Column:
    return F.substring_index(choice, " - ", -1)


def choice_title(choice: Column) -> Column:
    return F.substring_index(choice, " - ", 1)


def is_header(line: Column) -> Column:
    bare = trimmed(line)
    return (F.length(bare) >= 2) & (bare.rlike(NUMERIC_HEADER) | bare.rlike(LETTER_HEADER) | bare.rlike(DIGIT_LETTER_HEADER))


def title_case_header(line: Column) -> Column:
    bare = trimmed(or_empty(line))
    words = F.filter(F.split(bare, r"\s+"), lambda w: w != "")
    lettered = F.filter(words, lambda w: w.rlike(r"\p{L}"))
    capitals = F.forall(lettered, lambda w: w == F.upper(w))
    raised = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    sized = (F.length(bare) > 0) & (F.length(bare) <= 80) & ~bare.rlike(r"[.?!]$") & ~bare.rlike("^[-•]")
    return sized & ((capitals & (F.size(words) <= 8)) | (raised >= F.greatest(F.lit(2), F.floor(F.size(words) / 2))))


def extract_code(header: Column) -> Column:
    found = [F.nullif(F.regexp_extract(or_empty(header), p, 0), F.lit("")) for p in CODES]
    return F.lower(F.regexp_replace(F.coalesce(*found, F.lit("")), "[ :.]+$", ""))


def match_key(s: Column) -> Column:
    bare = trimmed(F.translate(or_empty(s), " ", " "))
    return F.regexp_replace(trimmed(F.substring_index(bare, ":", 1)), "[ :.]+$", "")


def match_tokens(s: Column) -> Column:
    words = F.split(F.lower(trimmed(F.regexp_replace(F.translate(or_empty(s), " ", " "), r"\s+", " "))), " ")
    return F.filter(F.transform(words, lambda w: F.regexp_replace(w, r"^[\-–—:;,.]+|[\-–—:;,.]+$", "")), lambda w: w != "")


def query_tokens(q: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(F.split(F.lower(or_empty(q)), "[^a-z0-9]+"), lambda w: (w != "") & ~F.array_contains(stop, w))


def plural_variants(t: Column) -> Column:
    """Every suffix rule that applies, for matching in ranking."""
    n, cut = F.length(t), lambda k: F.substring(t, F.lit(1), F.length(t) - k)
    more = F.when(t.rlike("[^aeiou]y$"), F.concat(cut(1), F.lit("ies"))).when(t.rlike("(s|x|z|ch|sh)$"), F.concat(t, F.lit("es"))).otherwise(F.concat(t, F.lit("s")))
    return F.array_distinct(F.array_compact(F.array(t, F.when(t.endswith("ies") & (n > 3), F.concat(cut(3), F.lit("y"))), F.when(t.endswith("es") & (n > 2), cut(2)), F.when(t.endswith("s") & (n > 1), cut(1)), more)))


def query_plurals(w: Column) -> Column:
    """The first suffix rule that applies, letters only, for widening a query; the word itself keeps its case."""
    t = F.lower(w)
    n, cut = F.length(t), lambda k: F.substring(t, F.lit(1), F.length(t) - k)
    fewer = F.when(t.endswith("ies") & (n > 3), F.concat(cut(3), F.lit("y"))).when(t.endswith("es") & (n > 2), cut(2)).when(t.endswith("s") & (n > 1), cut(1))
    more = F.when(t.rlike("[^aeiou]y$"), F.concat(cut(1), F.lit("ies"))).when(t.rlike("(s|x|z|ch|sh)$"), F.concat(t, F.lit("es"))).otherwise(F.concat(t, F.lit("s")))
    return F.when(w.rlike(r"^\p{L}+$"), F.array_distinct(F.array_compact(F.array(w, fewer, more)))).otherwise(F.array(w))


def query_variants(q: Column) -> Column:
    raw = trimmed(or_empty(q))
    words = F.slice(F.regexp_extract_all(raw, F.lit(r"([A-Za-z][A-Za-z\-]{2,})"), F.lit(1)), 1, 6)
    tail = F.substring(F.array_join(F.array_distinct(F.flatten(F.transform(words, query_plurals))), " "), 1, 200)
    both = F.array(raw, F.when(tail != "", trimmed(F.concat_ws(" ", raw, tail))))
    return F.when(raw == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.array_compact(both)))


def ngram_phrases(tokens: Column) -> Column:
    def joined(n: int, least: int) -> Column:
        at = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.filter(F.transform(at, lambda k: F.array_join(F.slice(tokens, k, n), " ")), lambda p: F.length(p) >= least)

    return F.array_union(joined(2, 5), joined(3, 7))


def edge_variants(s: Column) -> Column:
    base = trimmed(F.translate(or_empty(s), " ", " "))
    words = F.filter(F.split(base, r"\s+"), lambda w: w != "")
    prefix = F.when(F.size(words) >= 4, F.array_join(F.slice(words, 1, 7), " "))
    return F.filter(F.array_distinct(F.array_compact(F.array(base, F.translate(base, "'", "’"), F.translate(base, "'", "ʼ"), prefix))), lambda v: v != "")


def section_match_rank(query: Column, number: Column, label: Column) -> Column:
    """0 exact number, 1 child, 2 exact label, 3 child label, 2 more for cross references; null where nothing matches."""
    number, label = trimmed(or_empty(number)), trimmed(or_empty(label))
    own = F.regexp_extract(label, r"^\s*(\d+(\.\d+)*)\b", 1)
    below = F.concat(query, F.lit("."))
    cross = label.rlike(r"&\s*\d")
    rank = F.when((number != "") & (number == query), 0).when((number != "") & number.startswith(below), F.when(cross, 3).otherwise(1))
    return rank.when((own != "") & (own == query), F.when(cross, 4).otherwise(2)).when((own != "") & own.startswith(below), F.when(cross, 5).otherwise(3))


def chunk_uid(text: Column, source: Column, page: Column, section: Column, number: Column) -> Column:
    fields = [or_empty(c.cast("string")) for c in (source, page, section, number)]
    digest = F.unhex(F.sha1(F.concat_ws("|", *fields, F.substring(or_empty(text), 1, 160)).cast("binary")))
    return F.regexp_replace(F.translate(F.base64(digest), "+/", "-_"), "=+$", "")


def moderate(query: Column, title: Column) -> Column:
    """True for abuse, or for developer talk without a domain word and without the chosen title."""
    q, own = F.lower(or_empty(query)), F.lower(trimmed(or_empty(title)))
    says = lambda words: q.rlike(r"\b(" + "|".join(words) + r")\b")
    return (q != "") & (says(ABUSE) | (says(DEVELOPER) & ~says(DOMAIN) & ~((own != "") & q.contains(own))))


def clip(text: Column, most: int = 4000) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(" …(truncated)"))).otherwise(text)


def slices(text: Column, size: int = 64) -> Column:
    """Pieces of `size` characters; none for a text that is one JSON object."""
    n = F.ceil(F.length(text) / size).cast("int")
    at = F.when((n > 0) & ~text.rlike(r"^\s*\{[\s\S]*\}\s*$"), F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda k: F.substring(text, k * size + 1, F.lit(size)))


def line_kind(line: Column) -> Column:
    bare = F.regexp_replace(F.translate(line, " ", " "), "﻿", "")
    return F.when(bare.rlike(NUMBER_AND_TITLE), F.lit("number_title")).when(bare.rlike(NUMBER_ONLY), F.lit("number")).when(bare.rlike(CAPITALIZED), F.lit("capitalized"))


def used_citations(answer: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(or_empty(answer), F.lit(r"\[([^\]]+)\]"), F.lit(1)), trimmed), lambda c: c != ""))


def link_citations(answer: Column) -> Column:
    """Codes and worded labels in brackets become section links; what is a link already stays."""
    linked = F.regexp_replace(answer, r"\[(\d+(?:\.\d+)+|\d+/(?:\d+/)*\d+|[A-Za-z]\d+(?:\.[A-Za-z0-9]+)*[a-z]?|\d+[A-Za-z]\d+(?:\.[A-Za-z0-9]+)*[a-z]?)\](?!\()", "[$1](section:$1)")
    words = F.regexp_extract_all(linked, F.lit(r"\[((?=[^\]]*[A-Za-z])[^\]\n]{2,80})\](?!\()"), F.lit(1))
    one = lambda text, word: F.replace(text, F.concat(F.lit("["), word, F.lit("]")), F.concat(F.lit("["), word, F.lit("](section:"), F.replace(F.url_encode(word), F.lit("+"), F.lit("%20")), F.lit(")")))
    return F.aggregate(F.array_distinct(words), linked, one)


def strip_markdown(s: Column) -> Column:
    out = trimmed(or_empty(s))
    steps = [
        ("<[^>]+>", ""), (r"!\[(.*?)\]\((.*?)\)", "$1"), (r"\[(.*?)\]\((.*?)\)", "$1"), (r"^#{1,6}\s*", ""), (r"^>\s*", ""), (r"^\s*([-*+]\s+|\d+\.\s+)", ""),
        (r"\*\*(.*?)\*\*", "$1"), ("__(.*?)__", "$1"), (r"\*(.*?)\*", "$1"), ("_(.*?)_", "$1"), ("~~(.*?)~~", "$1"), ("`([^`]+)`", "$1"), (r"\\([\\`*_{}\[\]()#+\-.!])", "$1"),
    ]
    for pattern, by in steps:
        out = F.regexp_replace(out, pattern, by)
    return trimmed(F.regexp_replace(out, r"\s+", " "))


def answer_title(text: Column) -> Column:
    """The first line of an answer where it is plainly a title, else empty."""
    first = trimmed(F.regexp_extract(or_empty(text), r"^\s*([^\n]*)", 1))
    title = trimmed(F.regexp_replace(first, "^[#* ]+|[#* ]+$", ""))
    low = F.lower(title)
    modal = F.lit(False)
    for word in MODALS:
        modal = modal | low.contains(word)
    good = (title != "") & (F.length(title) <= 60) & ~title.rlike(r"^\p{Ll}") & ~title.rlike("^(" + "|".join(SENTENCE_STARTS) + ") ") & ~title.rlike("[.!?:]$")
    return F.when(good & (F.size(F.split(title, r"\s+")) <= 8) & ~modal, title).otherwise(F.lit(""))


def tidy_title(s: Column, question: Column, most: int = 60) -> Column:
    """The first line without quotes around it and punctuation after it, cut; where nothing is left, that of the question."""
    line = lambda c: trimmed(F.split_part(trimmed(or_empty(c)), F.lit("\n"), F.lit(1)))
    cut = lambda c: F.regexp_replace(F.substring(F.regexp_replace(c, r"[.!?:;,\s]+$", ""), 1, most), r"\s+$", "")
    bare = F.regexp_replace(F.regexp_replace(line(s), '^"+|"+$', ""), "^'+|'+$", "")
    return F.when(cut(bare) != "", cut(bare)).otherwise(cut(line(question)))
