"""URL rules and a weighted vocabulary for URLs.

Rules (host suffix, path prefix) are plain column expressions. Addresses that no rule fits are judged by
the vocabulary: an Aho-Corasick automaton finds strict and soft terms; a hit counts only where no letter
or digit stands on either side; one strict term, or several distinct soft ones, blocks the address.
"""

from __future__ import annotations

import string
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, owned, quoted

#: (host, path, verdict): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Default terms, in English, German, Spanish and French; terms_of reads others from a table.
STRICT = [
    "adult", "bdsm", "bukkake", "camgirl", "camgirls", "camsex", "creampie", "cumshot", "escort", "escorts", "fetish", "gangbang", "hardcore", "hentai", "hookers", "milf", "nsfw", "nudes",
    "porn", "pornhub", "porno", "pornografia", "pornographie", "pornos", "putas", "sexcam", "sexfilme", "sexvideos", "shemale", "threesome", "xvideos", "xxx",
]
SOFT = [
    "amateur", "apuestas", "babes", "bet", "betting", "bingo", "casino", "cheap", "citas", "crack", "dating", "diet", "erotic", "erotik", "erotique", "free", "gamble", "girls", "hot", "jackpot",
    "keygen", "kredit", "loan", "loans", "lottery", "nackt", "nude", "pharmacy", "pills", "poker", "prestamos", "rencontres", "replica", "serial", "sex", "sexe", "sexo", "sexy", "singles", "slots",
    "teen", "torrent", "viagra", "warez", "webcam", "wetten",
]
#: A strict term weighs as much as LIMIT distinct soft ones.
LIMIT = 2


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty where url is null or has no "://"."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def by_rules(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)) if rule is None else rule.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(v)) if verdict is None else verdict.when(fits, F.lit(v))
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def automaton(strict: Iterable[str], soft: Iterable[str]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for terms, is_strict in ((soft, False), (strict, True)):
        for term in filter(None, terms):
            made.add_word(term.lower(), (term.lower(), is_strict))
    made.make_automaton()
    return made


def hits_of(url: str, terms) -> tuple[int, int]:
    """Distinct strict and soft terms that stand in the address without a letter or digit next to them."""
    url = url.lower()
    found: tuple[set[str], set[str]] = (set(), set())
    for end, (term, is_strict) in terms.iter(url):
        start = end - len(term) + 1
        if (start == 0 or not url[start - 1].isalnum()) and (end + 1 == len(url) or not url[end + 1].isalnum()):
            found[is_strict].add(term)
    return len(found[1]), len(found[0])


def terms_of(table: DataFrame, term: str = "term", kind: str = "kind", most: int = 1_000_000) -> tuple[list[str], list[str]]:
    """(strict, soft) terms of a vocabulary table, whose kind is "strict" or "soft"; null terms are none.

    The terms go to every worker, so a table of over `most` rows is an error.
    """
    rows = table.select(F.col(quoted(term)), F.col(quoted(kind))).where(F.col(quoted(term)).isNotNull()).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the vocabulary has over {most} terms")
    return sorted(t for t, k in rows if k == "strict"), sorted(t for t, k in rows if k == "soft")


def judge_urls(pages: DataFrame, url_column: str = "url", rules=RULES, strict=STRICT, soft=SOFT, limit: int = LIMIT) -> DataFrame:
    """pages with host, path, rule, verdict, strict_hits and soft_hits in place of any such columns.

    A null, empty or malformed address has empty host and path, fits no rule and is allowed unless its
    text holds the terms. Repeated rows are judged alike and kept; other columns pass through, whatever their names;
    an empty table stays empty. The automaton is built once per worker, not for every batch.
    """
    made = ("host", "path", "rule", "verdict", "strict_hits", "soft_hits")
    names, own = owned(pages, made)
    url = F.col(quoted(url_column))
    host, path = host_and_path(url)
    parts = pages.select(own, F.coalesce(url, F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    rule, ruled = by_rules(F.col("host"), F.col("path"), rules)
    strict, soft = tuple(strict), tuple(soft)

    @F.pandas_udf("strict_hits int, soft_hits int")
    def hits(urls):
        import pandas as pd

        terms = held(f"url terms {strict} {soft}", lambda: automaton(strict, soft))
        return pd.DataFrame([hits_of(u, terms) for u in urls], columns=["strict_hits", "soft_hits"])

    hit = parts.withColumn("hits", hits("url"))
    heavy = F.col("hits.strict_hits") * limit + F.col("hits.soft_hits") >= limit
    verdict = F.coalesce(ruled, F.when(heavy, F.lit("block")).otherwise(F.lit("allow")))
    return hit.select(*names, "host", "path", rule.alias("rule"), verdict.alias("verdict"), "hits.strict_hits", "hits.soft_hits")
