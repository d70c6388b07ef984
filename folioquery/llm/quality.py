"""Rules on a document's own words, and rejection of documents that boilerplate lines deplete.

Lines are normalised and hashed; a line is boilerplate where more than a share of a host's distinct documents hold it.
Such lines leave the text, and a document that keeps too few of its words without them is rejected. Copies are one
document on both sides of the share: a line counts once per distinct remaining text, a host has its distinct texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import owned, quoted, release, small_batches, written
from .shared_lines import host_key, line_key, split_by, text_key, texts_with

#: The base rules: words a document needs, and percent of its words that may stand in repeated 8-word windows.
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
#: Characters that count as symbols, and as white space.
SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\x0b\x0c\r"
#: Line limit: the share of a host's distinct documents beyond which a line is boilerplate, at every size of a host; and
#: the documents that tell it, so that a pair of near copies doesn't make each other's lines boilerplate.
SHARE, LEAST_DOCUMENTS = 0.1, 3
#: Share of its words that a document has to keep.
LEFT = 0.3


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of WINDOW words that occur twice or more, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    code = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    # windows get exact numbers by doubling: pairs, fours, eights
    span = 1
    while span < WINDOW:
        pair = code[:-span] * np.int64(len(words) + 1) + code[span:]
        code = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        span *= 2
    twice = np.bincount(code)[code] > 1
    if not twice.any():
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip(b" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def own_counts(texts: pd.Series) -> pd.DataFrame:
    release()
    rows = []
    for text in texts:
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()
        rows.append((len(words), len(text) - sum(map(text.count, BLANK)), sum(map(text.count, SYMBOLS)), repeated_lines(raw), repeated_words(words)))
    return pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])


def plain_lines(text: Column) -> Column:
    """A text's lines as they are compared: lower case, digits alike, white space as single spaces, none at the ends."""
    alike = F.translate(F.lower(text), "123456789", "000000000")
    single = F.regexp_replace(alike, r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]", " ")
    return F.transform(F.split(single, "\n", -1), F.trim)


def words_in(plain: Column) -> Column:
    """The words of such a line."""
    return F.when(plain == "", 0).otherwise(F.length(plain) - F.length(F.replace(plain, F.lit(" "))) + 1).cast("long")


def boilerplate(docs: DataFrame, host: str, text: str, least: int, share: float) -> tuple[DataFrame, DataFrame]:
    """host, line (key), n of the boilerplate lines, and host, line, da, db, rest of all lines.

    A line counts once per distinct remaining text, which is the text less that line: copies that differ in nothing
    but the line (a page number, a date) are one. It is boilerplate where it counts `least` times at least, and more
    than `share` of the host's distinct texts. Copies are combined before the shuffle.
    """
    body, key = F.col(quoted(text)), host_key(F.col(quoted(host)))
    rows = docs.select(key.alias("host"), *text_key(F.col(quoted(host)), body), body.alias("body"))
    # a text's number is the XOR of its lines', each with its place; without the line's own it is that of the rest
    numbers = F.transform(F.split("body", "\n", -1), lambda line, k: F.xxhash64(line, k))
    own = rows.where("body is not null").select("host", "da", "db", numbers.alias("number"), F.transform(plain_lines(F.col("body")), line_key).alias("line"))
    whole = F.aggregate("number", F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))
    single = own.select("host", "da", "db", whole.alias("whole"), F.explode(F.arrays_zip("number", "line")).alias("z"))
    single = single.select("host", "da", "db", "whole", "z.number", "z.line").where("line is not null")
    rest = F.first("whole").bitwiseXOR(F.expr("bit_xor(DISTINCT number)"))
    lines = written(single.groupBy("host", "line", "da", "db").agg(rest.alias("rest")), "lines")
    counts = lines.groupBy("host", "line", "rest").agg(F.lit(1).alias("one")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    texts = rows.groupBy("host", "da", "db").agg(F.lit(1).alias("one"))
    totals = written(texts.groupBy("host").agg(F.count("*").alias("total")), "hosts")
    found = counts.join(totals, "host").where(F.col("n") > share * F.col("total"))
    return written(found.select("host", "line", "n"), "boilerplate"), lines


def judge_quality(docs: DataFrame, host: str = "source", text: str = "text", least: int = LEAST_DOCUMENTS, share: float = SHARE, left: float = LEFT) -> DataFrame:
    """docs with the columns of the verdict, in place of any that bear their names.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words: counts over the whole text. base_failed: too few
    words, or too many in repeated windows. n_left: words outside boilerplate lines. kept: neither failed nor
    depleted. left_text: the text without its boilerplate lines. A null text has no words and fails, and left_text
    is null; the null texts of a host are one of its documents. Documents with a null host form one host. Repeated rows are
    judged alike and all kept or dropped. Other columns pass through, whatever their names; an empty table stays empty.
    """
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_left", "kept", "left_text")
    docs = small_batches(docs)
    names, own = owned(docs, made, text)
    found, lines = boilerplate(docs, host, text, least, share)
    keyed = docs.select(own, F.col(quoted(text)).alias("body"), *text_key(F.col(quoted(host)), F.col(quoted(text))))
    clean, maybe = split_by(keyed, texts_with(lines, found))
    hits = F.transform(plain_lines(F.col("body")), lambda line: F.coalesce(F.array_contains("lines", line_key(line)), F.lit(False)))
    marked = maybe.select("own", "body", F.when(F.col("lines").isNotNull(), hits).alias("hits"), plain_lines(F.col("body")).alias("plain"))
    gone = F.filter("plain", lambda line, k: F.element_at("hits", k + 1))
    lost = F.aggregate(gone, F.lit(0).cast("long"), lambda n, line: n + words_in(line))
    stay = F.array_join(F.filter(F.split("body", "\n", -1), lambda line, k: ~F.element_at("hits", k + 1)), "\n")
    marked = marked.select("own", "body", F.when(F.col("hits").isNull(), 0).otherwise(lost).alias("lost"), F.when(F.col("hits").isNull(), F.col("body")).otherwise(stay).alias("left_text"))
    both = clean.select("own", "body", F.lit(0).cast("long").alias("lost"), F.col("body").alias("left_text")).union(marked)

    # declared nondeterministic so that a filter on the verdict doesn't make the optimizer evaluate it twice
    count = F.pandas_udf(own_counts, "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long").asNondeterministic()
    told = both.withColumn("n", count(F.coalesce("body", F.lit("")))).select("own", "body", "lost", "left_text", "n.*")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    told = told.withColumns({"base_failed": failed, "n_left": F.col("n_words") - F.col("lost")})
    return told.withColumn("kept", ~F.col("base_failed") & (F.col("n_left") >= left * F.col("n_words"))).select(*names, *made)
