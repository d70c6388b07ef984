"""Exact dedup, periodic runs and ranked search against brute force, with every kind of odd row."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("folioquery.llm")
from folioquery.llm import exact_dedup, periodic_runs, queries, ranked_search  # noqa: E402

SCHEMA = "doc_id long, text string, source string, keep_id string, `n.a``b` int"


def table(texts, first=0):
    return [(first + k, t, f"s{k % 2}", "mine", k) for k, t in enumerate(texts)]


# --- exact dedup


def equal_groups(rows):
    """(row's place) -> smallest id, size, by the texts themselves."""
    groups = collections.defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[re.sub(r"[ \t\n\x0b\x0c\r]+", " ", text or "")].append(doc_id)
    return groups


@pytest.fixture(scope="module")
def copies():
    r = random.Random(4)
    long = "x" * 40 + " y" * 5000
    texts = ["a b", "a  b", "a\n\tb", " a b", None, "", "   ", " ", long, long, long + "z", long + " z", "x" * 40, "x" * 32, "x" * 32, "x" * 31, "é\x85b", "é b", "é b", "é b"]
    texts += ["hot " * 50] * 400 + ["hot " * 50 + f"{k} tail" for k in range(60)] + [" ".join(r.choice("abc") for _ in range(r.randrange(30))) for _ in range(300)]
    rows = table(texts)
    r.shuffle(rows)
    return rows + [rows[3]] * 2 + [(None, "a b", "s", "mine", 0), (None, None, None, None, None)]


def test_exact_groups(spark, copies):
    df = exact_dedup.exact_groups(spark.createDataFrame(copies, SCHEMA).repartition(5))
    assert df.columns == ["doc_id", "text", "source", "n.a`b", "keep_id", "group_size", "kept"]
    found, groups = df.collect(), equal_groups(copies)
    assert len(found) == len(copies)
    kept = collections.Counter()
    for row in found:
        same = groups[re.sub(r"[ \t\n\x0b\x0c\r]+", " ", row.text or "")]
        known = [x for x in same if x is not None]
        assert (row.keep_id, row.group_size) == (min(known) if known else None, len(same))
        if row.kept:
            kept[re.sub(r"[ \t\n\x0b\x0c\r]+", " ", row.text or "")] += 1
            assert row.doc_id == row.keep_id
    assert kept == collections.Counter(list(groups))


def test_exact_rounds(spark, copies, monkeypatch):
    """Short digits and many shares give the same groups."""
    docs = spark.createDataFrame(copies, SCHEMA)
    want = sorted(map(repr, exact_dedup.exact_groups(docs).select("doc_id", "keep_id", "group_size").collect()))
    monkeypatch.setattr(exact_dedup, "FIRST", 1)
    monkeypatch.setattr(exact_dedup, "SHARES", 2)
    assert sorted(map(repr, exact_dedup.exact_groups(docs).select("doc_id", "keep_id", "group_size").collect())) == want


def test_hot_group_is_dealt(spark):
    """A group of all rows meets in several tasks, and is counted whole."""
    docs = spark.range(4000).selectExpr("id as doc_id", "repeat('same text ', 20) as text")
    found = exact_dedup.exact_groups(docs)
    assert found.groupBy("keep_id", "group_size", "kept").count().orderBy("kept").collect() == [(0, 4000, False, 3999), (0, 4000, True, 1)]


def test_exact_empty_and_single(spark):
    docs = spark.createDataFrame(table(["one", "two", "three"]), SCHEMA)
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs).collect()} == {(k, k, 1, True) for k in range(3)}
    assert exact_dedup.drop_copies(docs.union(docs)).columns == docs.columns
    assert exact_dedup.drop_copies(docs.union(docs)).count() == 3


def test_exact_other_id(spark):
    docs = spark.createDataFrame([("b", "t"), ("a", "t"), ("c", "u")], "`my.id` string, body string")
    assert {(r["my.id"], r.keep_id) for r in exact_dedup.exact_groups(docs, "my.id", "body").collect()} == {("a", "a"), ("b", "a"), ("c", "c")}


# --- periodic runs


def plain_runs(words, least=12):
    """start, length, period of all runs, by looking at every period."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q) and j > i:
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda x: (x[0], x[2]))


def without(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic(r, n, kinds):
    words = [str(r.randrange(kinds)) for _ in range(n)]
    if n > 20:
        a, p = r.randrange(n // 2), r.randrange(1, n // 3)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


@pytest.mark.parametrize("seed", range(8))
def test_runs_of_batches(seed):
    r = random.Random(seed)
    for _ in range(25):
        texts = [[w.encode() for w in periodic(r, r.choice([0, 1, 11, 12, 13, 60, 250]), r.choice([1, 2, 4]))] for _ in range(r.randrange(1, 7))]
        assert [[tuple(x) for x in found.tolist()] for found in periodic_runs.word_runs(texts)] == [plain_runs(t) for t in texts]


def test_fibonacci_word():
    """Words with as many runs as there can be."""
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 900:
        a, b = b, b + a
    assert [tuple(x) for x in periodic_runs.word_runs([b])[0].tolist()] == plain_runs(b)


def test_candidates_in_parts(monkeypatch):
    monkeypatch.setattr(periodic_runs, "CANDIDATES", 5)
    words = [b"x"] * 100 + [b"y", b"z"] * 30
    assert [tuple(x) for x in periodic_runs.word_runs([words])[0].tolist()] == plain_runs(words)


def test_agreement_of_places():
    r = np.random.default_rng(3)
    for kinds in (1, 2, 3):
        body = r.integers(1, kinds + 1, 400)
        symbols = np.concatenate([[0], body, [kinds + 1]])
        levels = periodic_runs.grammar(symbols)
        a = r.integers(1, 400, 300)
        b = r.integers(1, 400, 300)
        a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
        ahead, behind = periodic_runs.agreement(levels, a, b), periodic_runs.agreement(levels, a, b, back=True)
        for x, y, f, g in zip(a, b, ahead, behind):
            assert f == next(k for k in range(500) if symbols[x + k] != symbols[y + k])
            assert g == next(k for k in range(500) if symbols[x - k] != symbols[y - k])


def test_find_runs(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "TOGETHER", 300)
    r = random.Random(8)
    texts = [None, "", " \n\t ", "one", "ab " * 12, "ab\t\x0bcd\n" * 6, "ab cd " * 5, "é " * 12 + "日本 x " * 7, "a\x85b " * 14]
    texts += [" ".join(periodic(r, r.randrange(200), r.choice([1, 3, 8]))) for _ in range(60)] + ["w " * 20000]
    docs = spark.createDataFrame([(k, t, "s", f"c{k}", k) for k, t in enumerate(texts)], "doc_id long, text string, runs string, `found` string, body int")
    found = periodic_runs.find_runs(docs.union(docs.limit(9)).repartition(3))
    assert found.columns == ["doc_id", "text", "found", "body", "n_words", "runs", "collapsed"]
    rows = found.collect()
    assert len(rows) == len(texts) + 9
    for row in rows:
        words = re.findall(r"[^ \t\n\x0b\x0c\r]+", row.text or "")
        runs = plain_runs(words) if len(words) < 20000 else [(0, 20000, 1)]
        assert (row.n_words, [tuple(x) for x in row.runs], row.collapsed) == (len(words), runs, without(words, runs))
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0


def test_op12_contract(spark, tmp_path):
    r = random.Random(2)
    texts = [None, "", "solo"] + [" ".join(f"w{r.randrange(40)}" for _ in range(r.randrange(1, 150))) + "\n" for _ in range(150)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op12_periodic_runs(spark, str(tmp_path)).collect()
    assert len(found) == len(texts)
    for row in found:
        words = re.findall(r"[^ \t\n\x0b\x0c\r]+", texts[row.doc_id] or "")
        h, n = zlib.crc32(str(row.doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
        runs = plain_runs(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        lines = "".join(f"{a},{m},{q}\n" for a, m, q in runs)
        assert (row.n_runs, row.start, row.length, row.period) == (len(runs), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert row.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(without(words, runs).encode()).hexdigest()
    assert sum(row.n_runs > 0 for row in found) > 5


# --- ranked search


def words_of(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, top=10):
    counts = [(doc_id, collections.Counter(words_of(text))) for doc_id, text in docs]
    n_docs, total = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, c in counts:
            m = 25 + 75 * sum(c.values()) * n_docs // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in words_of(text) if c[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        out += [(item_id, k + 1, doc_id, -s) for k, (s, _, doc_id) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(6)
    vocabulary = [f"Wort{k}" for k in range(60)] + ["élan", "日本", "É", "x1", "naïve"]
    docs = [(k, " ".join(r.choices(vocabulary, k=r.randrange(1, 90)))) for k in range(300)]
    docs += [(300 + k, docs[5][1]) for k in range(40)] + [(400, None), (401, ""), (402, "!?"), (403, "wort1 " * 4000), (None, docs[5][1]), docs[7], docs[7]]
    items = [(k, ", ".join(r.choices(vocabulary[:30], k=r.randrange(1, 40)))) for k in range(25)]
    items += [(25, items[0][1]), (26, items[0][1] + " WORT1 wort1"), (27, None), (28, ""), (29, "unknown"), (30, docs[5][1]), (3, "wort1"), (31, "É é")]
    return docs, items


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_search(spark, corpus, monkeypatch, block):
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", block)
    monkeypatch.setattr(ranked_search, "CELLS", 2000)
    docs, items = corpus
    found = ranked_search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([(*x, "c", 1) for x in items], "item_id int, text string, doc_id string, score int").repartition(2))
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=repr) == plain_search(docs, items)


def test_search_empty(spark, corpus):
    docs, items = (spark.createDataFrame(rows, f"{name} int, text string") for rows, name in zip(corpus, ("doc_id", "item_id")))
    assert ranked_search.search(docs.limit(0), items).count() == 0
    assert ranked_search.search(docs, items.limit(0)).count() == 0
    assert ranked_search.search(docs.where("text is null"), items).count() == 0


def test_shared_sets_add_up(corpus):
    """Every item is the sum of its members, repeats included, and sharing saves sums."""
    asked = [[w.encode() for w in words_of(t)] for _, t in corpus[1]]
    graph = ranked_search.shared_sets(asked)
    rows = [collections.Counter({t: 1}) for t in graph.terms]
    for left, right in zip(graph.left, graph.right):
        rows += [rows[a] + rows[b] for a, b in zip(left, right)]
    assert len(rows) == graph.rows
    assert [sum((rows[k] for k in item), collections.Counter()) for item in graph.items] == [collections.Counter(q) for q in asked]
    assert sum(map(len, graph.items)) + sum(map(len, graph.left)) < 0.8 * sum(map(len, asked))
    assert ranked_search.shared_sets([]).items == [] and [len(x) for x in ranked_search.shared_sets([[], []]).items] == [0, 0]


def test_length_beyond_64_bits():
    assert ranked_search.relative_length(np.array([10**9]), 10**12, 10**15).tolist() == [25 + 75 * 10**9 * 10**12 // 10**15]


def test_overlarge_families_stay_linear(spark, monkeypatch):
    """Versions of a template that drift apart, far beyond FAMILY: other hubs link them, and few sets are left for blocks."""
    from folioquery.llm import ngram_join as J

    r, texts, words = random.Random(12), [], [f"t{k}" for k in range(120)]
    for k in range(700):
        for _ in range(2):
            words[r.randrange(len(words))] = f"v{k}x{r.randrange(10**6)}"
        texts.append(" ".join(words))
    monkeypatch.setattr(J, "BLOCK", 16)
    monkeypatch.setattr(J, "FAMILY", 64)
    copies, blocks = [], J.in_blocks

    def counted(rows):
        out = J.written(blocks(rows), "counted")
        copies.append(out.count())
        return out

    monkeypatch.setattr(J, "in_blocks", counted)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(max(0, i - 60), i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    got = {x.doc_id: x.component_id for x in J.ngram_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(texts))] == root
    with_turns = sum(copies)
    copies.clear()
    monkeypatch.setattr(J, "TURNS", 0)
    again = {x.doc_id: x.component_id for x in J.ngram_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert again == got
    assert with_turns <= sum(copies) // 2 and with_turns <= 4 * len(texts), (with_turns, sum(copies))


def test_odd_column_names(spark):
    import public_tokenizers as P

    from folioquery.llm import packing, repeats, word_bpe

    docs = spark.createDataFrame([(1, "one two"), (2, None)], "`doc.id` long, `my text` string").withColumnRenamed("my text", "my.text")
    assert {r.doc_id for r in packing.pieces(docs, str(P.path("byte_bpe_50k.json")), 16, 2, "doc.id", "my.text").collect()} == {1, 2}
    assert {r.doc_id for r in word_bpe.encode_documents(docs, str(P.path("word_bpe_49k.json")), "doc.id", "my.text").collect()} == {1, 2}
    texts = docs.withColumnRenamed("my.text", "text")
    assert repeats.repeat_groups(texts.limit(0)).count() == 0 and repeats.repeat_groups(texts.where("text is null")).count() == 0
