"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import url_filter, warc

SPACE = r"[\x20\x09-\x0D]"
#: The five rules of the query: host, path, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
BARE = rf"regexp_replace(line, '^{SPACE}+|{SPACE}+$', '', 'g')"


def url_sql() -> str:
    """Rules as a CASE, longest first; a term counts where no letter or digit is next to it."""
    rules = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in rules]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{r}'" for f, r, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, _, v in fits) + " END"
    hits = lambda terms: "CAST(" + " + ".join(rf"CAST(regexp_matches(u, '(^|[^\p{{L}}\p{{N}}]){t}($|[^\p{{L}}\p{{N}}])') AS INTEGER)" for t in terms) + " AS INTEGER)"
    return rf"""WITH p AS (SELECT page_id, lower(coalesce(url, '')) AS u, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages), h AS (SELECT *, {hits(url_filter.STRICT)} AS strict_hits, {hits(url_filter.SOFT)} AS soft_hits FROM p)
 SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN strict_hits * {url_filter.LIMIT} + soft_hits >= {url_filter.LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, strict_hits, soft_hits FROM h"""


def line_dedup_sql() -> str:
    """A line goes where more than a tenth of its host's pages hold it, and two at least."""
    return rf"""WITH d AS (SELECT *, row_number() OVER () AS rid FROM documents), l AS (SELECT rid, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d WHERE text IS NOT NULL),
 b AS (SELECT *, {BARE} AS bare FROM l), t AS (SELECT source, count(*) AS total FROM d GROUP BY source), c AS (SELECT source, bare, count(DISTINCT rid) AS n FROM b WHERE bare <> '' GROUP BY source, bare),
 bad AS (SELECT c.source, bare FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source WHERE n >= 2 AND n > CAST(0.1 AS DOUBLE) * total),
 m AS (SELECT b.rid, b.line, b.k, bad.bare IS NOT NULL AS hit FROM b LEFT JOIN bad ON b.source IS NOT DISTINCT FROM bad.source AND b.bare = bad.bare),
 r AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (hit) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT hit), '')) AS text_sha256 FROM m GROUP BY rid)
 SELECT doc_id, source, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, text_sha256 FROM d LEFT JOIN r USING (rid)"""


def quality_sql() -> str:
    """A line is boilerplate where three distinct remaining texts of its host hold it that are over a tenth of the host's distinct texts."""
    words = rf"list_filter(string_split_regex(coalesce(text, ''), '{SPACE}+'), lambda w: w <> '')"
    plain = lambda line: rf"trim(regexp_replace(translate(lower({line}), '123456789', '000000000'), '{SPACE}+', ' ', 'g'), ' ')"
    return rf"""WITH d AS (SELECT doc_id, source, text, row_number() OVER () AS rid, {words} AS w, string_split(text, chr(10)) AS raw, list_transform(string_split(text, chr(10)), lambda x: {plain('x')}) AS plain FROM documents),
 win AS (SELECT rid, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8),
 rep AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1), cov AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY rid),
 l AS (SELECT rid, source, unnest(raw) AS line, unnest(plain) AS bare, generate_subscripts(raw, 1) AS k FROM d WHERE text IS NOT NULL),
 n AS (SELECT *, len(list_filter(string_split(bare, ' '), lambda w: w <> '')) AS nw FROM l), dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM n WHERE nw > 0 GROUP BY rid),
 u AS (SELECT rid, unnest(list_distinct(plain)) AS bare FROM d WHERE text IS NOT NULL),
 s AS (SELECT d.source, u.bare, array_to_string(list_transform(range(1, len(raw) + 1), lambda i: CASE WHEN plain[i] = u.bare THEN chr(1) ELSE raw[i] END), chr(10)) AS rest FROM u JOIN d USING (rid) WHERE u.bare <> ''),
 t AS (SELECT source, count(DISTINCT text) + CAST(bool_or(text IS NULL) AS BIGINT) AS total FROM d GROUP BY source), c AS (SELECT source, bare, count(DISTINCT rest) AS n FROM s GROUP BY source, bare),
 bad AS (SELECT c.source, bare FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source WHERE n >= 3 AND n > CAST(0.1 AS DOUBLE) * total),
 m AS (SELECT n.*, bad.bare IS NOT NULL AS hit FROM n LEFT JOIN bad ON n.source IS NOT DISTINCT FROM bad.source AND n.bare = bad.bare),
 r AS (SELECT rid, CAST(sum(nw) FILTER (hit) AS BIGINT) AS lost, sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT hit), '')) AS left_sha256 FROM m GROUP BY rid),
 a AS (SELECT doc_id, len(w) AS n_words, CAST(length(regexp_replace(coalesce(text, ''), '{SPACE}+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
 coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(w) - coalesce(lost, 0) AS n_left, left_sha256 FROM d LEFT JOIN cov USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN r USING (rid))
 SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_left >= CAST(0.3 AS DOUBLE) * n_words AS kept FROM a"""


def classes_sql(n: int = 5) -> str:
    """Sets of n-grams, pairs that share one, links of 75 of 100, and the smallest document over links."""
    return rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPACE}+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {n} THEN list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
 c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
 e AS (SELECT x, y FROM p JOIN c i ON i.doc_id = x JOIN c j ON j.doc_id = y WHERE 100 * shared >= 75 * (i.n + j.n - shared)), t AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
 r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT t.y, r.root FROM r JOIN t ON r.doc_id = t.x)
 SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, m.component_id FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id"""


def warc_sql(least: int = warc.LEAST) -> str:
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), f AS (SELECT h, min(page_id) AS first FROM p WHERE strlen(h) >= {least} GROUP BY h)
 SELECT page_id, strlen(p.h) AS payload_bytes, sha256(p.h) AS payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM p LEFT JOIN f ON p.h = f.h"""


def exact_sql() -> str:
    return rf"""WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{SPACE}+', ' ', 'g') AS plain FROM documents)
 SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(plain) AS text_sha256 FROM d WINDOW w AS (PARTITION BY plain)"""


def search_sql() -> str:
    """Integer scores over terms, 10 best a row of benchmark; all divisions are of positive integers."""
    terms = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return rf"""WITH d AS (SELECT doc_id, {terms} AS w FROM documents), g AS (SELECT count(*) AS c, CAST(sum(len(w)) AS BIGINT) AS total FROM d WHERE len(w) > 0),
 q AS (SELECT item_id, unnest({terms}) AS term FROM benchmark), q2 AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL), t AS (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d),
 p AS (SELECT doc_id, n, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
 s AS (SELECT p.doc_id, p.term, CAST(floor(1000 * ln((2 * c + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * c) // total))) AS part FROM p JOIN f USING (term), g),
 r AS (SELECT item_id, doc_id, CAST(sum(times * part) AS BIGINT) AS score FROM q2 JOIN s USING (term) GROUP BY item_id, doc_id),
 o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0) SELECT * FROM o WHERE rank <= 10"""


ORACLES: dict[str, str] = {"op1_ngram_join": classes_sql(), "op3_warc": warc_sql(), "op4_url_filter": url_sql(), "op7_line_dedup": line_dedup_sql(), "op10_quality": quality_sql(), "op11_exact_dedup": exact_sql(), "op13_ranked_search": search_sql()}
