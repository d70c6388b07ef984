"""Lines that many pages of one site share, dropped by their frequency relative to the site. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import owned, quoted, written
from .shared_lines import host_key, line_key, split_by, text_key, texts_with

#: Share of a host's pages beyond which a line is boilerplate; a line on one page is shared by none.
RATIO, LEAST_PAGES = 0.1, 2
#: Fixed value: leading and trailing characters that don't tell lines apart.
BLANK = " \t\n\x0b\x0c\r"


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def key_of(line: Column) -> Column:
    """The key of a line without the blanks around it; null for a blank line."""
    return line_key(F.btrim(line, F.lit(BLANK)))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST_PAGES, distinct: bool = False) -> tuple[DataFrame, DataFrame]:
    """host, line key, pages, total of the lines to drop, and host, line, da, db, copies of all lines.

    Pages are rows; with distinct, equal texts of a host are one page. A page's lines are made distinct before the
    shuffle.
    """
    body, key = F.col(quoted(text)), host_key(F.col(quoted(host)))
    pages = docs.select(key.alias("host"), *text_key(F.col(quoted(host)), body), body.alias("body"))
    keys = pages.where("body is not null").select("host", "da", "db", F.explode(F.array_distinct(F.filter(F.transform(lines(F.col("body")), key_of), lambda k: k.isNotNull()))).alias("line"))
    held = written(keys.groupBy("host", "line", "da", "db").agg(F.count("*").alias("copies")), "lines")
    counts = held.groupBy("host", "line").agg((F.count("*") if distinct else F.sum("copies")).alias("pages")).where(F.col("pages") >= least)
    if distinct:
        pages = pages.groupBy("host", "da", "db").agg(F.lit(1).alias("one"))
    totals = written(pages.groupBy("host").agg(F.count("*").alias("total")), "hosts")
    return written(counts.join(totals, "host").where(F.col("pages") > ratio * F.col("total")), "boilerplate"), held


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST_PAGES, distinct: bool = False) -> DataFrame:
    """docs with the text less its boilerplate lines, and n_lines and n_dropped.

    A line goes where more than `ratio` of the host's pages hold it, and at least `least`. Pages are rows; with
    distinct, equal texts of a host are one page. A null text stays null with no lines and counts as a page; blank
    lines are kept and never counted. Pages with a null host form a host of their own. Repeated rows are kept and
    treated alike. Columns n_lines and n_dropped are replaced; others pass through, whatever their names. An empty
    table stays empty.
    """
    names, own = owned(docs, ("n_lines", "n_dropped"), text)
    found, held = boilerplate(docs, host, text, ratio, least, distinct)
    keyed = docs.select(own, F.col(quoted(text)).alias("body"), *text_key(F.col(quoted(host)), F.col(quoted(text))))
    clean, maybe = split_by(keyed, texts_with(held, found))
    n = F.when(F.col("body").isNull(), 0).otherwise(F.size(lines(F.col("body")))).cast("long")
    clean = clean.select("own", "body", n.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    stay = F.filter(lines(F.col("body")), lambda line: ~F.coalesce(F.array_contains("lines", key_of(line)), F.lit(False)))
    cut = maybe.select("own", F.when(F.col("lines").isNull(), F.col("body")).otherwise(F.array_join(stay, "\n")).alias("body"), n.alias("n_lines"), F.when(F.col("lines").isNull(), n).otherwise(F.size(stay)).cast("long").alias("left"))
    return clean.union(cut.select("own", "body", "n_lines", F.col("n_lines") - F.col("left"))).select(*names, "n_lines", "n_dropped")
