"""Corpus operators against brute force and round trips, on small tables with every kind of odd row."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("folioquery.llm")
import public_tokenizers as P  # noqa: E402

from folioquery.llm import byte_bpe, common, fingerprints, line_dedup, ngram_join, packing, quality, repeats, rolling, token_shards, url_filter, warc, word_bpe  # noqa: E402

BYTE, WORD = str(P.path("byte_bpe_50k.json")), str(P.path("word_bpe_49k.json"))
WORDS = ["alpha", "beta", "Gamma", "délta", "épsilon", "zêta", "êta", "theta", "iota", "kappa", "lambda,", "mu."]


def passage(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(400)) for _ in range(n))


def rows(n=60):
    """Copies, near copies, shared passages, short and empty texts, a null text, a long text, a repeated row."""
    out, r = [], random.Random(5)
    for k in range(n):
        kind = k % 6
        if kind == 0:
            text = passage(k // 12, 120)
        elif kind == 1:
            words = passage(1000 + k // 24, 150).split()
            for _ in range(3):
                words[r.randrange(len(words))] = f"edit{r.randrange(10**6)}"
            text = " ".join(words)
        elif kind == 2:
            text = passage(k, 40) + "\n" + passage(7, 90) + "\n" + passage(k + 500, 40)
        elif kind == 3:
            text = "\n".join([f"Über {k}", "All rights reserved.", passage(k, 30), "ab" * 300 if k == 3 else ""])
        elif kind == 4:
            text = ["", "one two three", "One  two\tthree", None, "x" * 900, "\n\n  \n", "a\x85b 日本語 😀 <|endoftext|>"][k // 6 % 7]
        else:
            text = passage(k, 60)
        out.append((k, text, "en", f"src{k % 3}", len(text or "")))
    out.append(out[0])
    out.append((n, passage(99, 9000), "en", "src0", 0))
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sets_of(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def test_ngram_classes_equal_brute_force(docs, empty):
    told = rows()
    sets = [sets_of(r[1]) for r in told]
    root = list(range(len(told)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(told)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i in range(len(told)):
        low[find(i)] = min(low.get(find(i), 1 << 60), told[i][0])
    found = sorted(map(tuple, ngram_join.ngram_classes(docs).select("doc_id", "n_shingles", "component_id").collect()))
    assert found == sorted((r[0], len(s), low[find(i)]) for i, (r, s) in enumerate(zip(told, sets)))
    assert ngram_join.ngram_classes(empty).count() == 0


def test_tree_walk_finds_all_links():
    r = random.Random(2)
    base = sorted(r.sample(range(10**6), 80))
    sets = [sorted(set(base) - set(r.sample(base, r.randrange(30))) | set(r.sample(range(10**6), r.randrange(20)))) for _ in range(60)]
    packed = sorted((np.array(s, ">u8").tobytes(), k, None) for k, s in enumerate(sets))
    tree = ngram_join.Tree(packed)
    for s in sets:
        linked = {k for k, t in enumerate(sets) if 100 * len(set(s) & set(t)) >= 75 * len(set(s) | set(t))}
        assert {k for k, _ in tree.walk(np.array(s, np.uint64), None)} == linked


def test_family_blocks_and_ngram_groups_agree(docs, monkeypatch):
    whole = sorted(map(tuple, ngram_join.ngram_classes(docs).collect()))
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    assert sorted(map(tuple, ngram_join.ngram_classes(docs).collect())) == whole
    monkeypatch.setattr(ngram_join, "FAMILY", 1)
    assert sorted(map(tuple, ngram_join.ngram_classes(docs).collect())) == whole


def cut_by_force(texts, length):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                cover[i : i + length] = True
        spans = int(cover[:1].sum() + (np.diff(cover.astype(int)) == 1).sum())
        out.append((len(t), int(cover.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~cover])).hexdigest()))
    return out


@pytest.mark.parametrize("group", [256, 1])
def test_repeats_equal_brute_force(docs, empty, group, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", group)
    told = rows()
    want = sorted((r[0], *x) for r, x in zip(told, cut_by_force([(r[1] or "").encode() for r in told], 400)))
    assert sorted(map(tuple, repeats.removed_digest(repeats.cut_repeats(docs)).collect())) == want
    assert repeats.cut_repeats(empty).count() == 0


def test_runs_in_slices(monkeypatch):
    raw = np.frombuffer(passage(3, 800).encode(), np.uint8)
    monkeypatch.setattr(repeats, "SLICE", 700)
    _, _, at, left, right = repeats.runs_of(raw, 400, 40)
    starts = sorted(p for a, b, n in zip(at, left, right) for p in range(a - b, a - b + n + 1))
    assert starts == list(range(len(raw) - 399))


def test_suffix_intervals():
    texts = sorted(["banana"[k:] for k in range(6)])
    lcp = [0] + [len(re.match("|".join(a[:k] for k in range(len(a), 0, -1)) + "|", b)[0]) for a, b in zip(texts, texts[1:])]
    assert sorted((h, a, b) for h, a, b in repeats.intervals(lcp) if b > a) == [(0, 0, 5), (1, 0, 2), (2, 4, 5), (3, 1, 2)]


def test_warc_round_trip(spark):
    long = passage(1, 9000)
    told = [(1, "http://a/x", long), (2, "http://b/", long), (3, None, None), (4, "http://c d/\n", "short"), (5, "http://e/", "short"), (6, "http://f/", "é" * 60), (7, "http://g/", "é" * 60), (None, "http://h/", "é" * 60), (8, "http://i/", "WARC/1.1\r\n\r\n" * 20), (1, "http://a/x", long)]
    got = warc.round_trip(spark.createDataFrame(told, "page_id long, url string, html string")).collect()
    first = {}
    for i, _, h in told:
        if i is not None:
            first[h] = min(i, first.get(h, 1 << 60))
    want = []
    for i, _, h in told:
        raw = (h or "").encode()
        again = len(raw) >= 100 and i != first[h]
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_reports_a_lost_segment():
    body = warc.to_chunks(b"x" * 20000)
    assert warc.from_chunks(body) == b"x" * 20000
    with pytest.raises(ValueError):
        warc.from_chunks(body[:9000])


def test_url_rules_and_vocabulary(spark):
    told = [
        (1, "http://Example.COM/en/1?x", "example.com/en/", "block"), (2, "https://www.example.com/en/", "www.example.com/en/", "allow"), (3, "https://a.www.example.com/en/2", "www.example.com/en/", "allow"),
        (4, "http://x.com/p", "com/", "allow"), (5, "http://x.com", None, "allow"), (6, "http://x.net/fr/", "net/fr/", "block"), (7, "http://xnet/fr/", None, "allow"), (8, None, None, "allow"), (9, "adult.org/x", None, "block"),
        (10, "http://adults.org/", None, "allow"), (11, "http://a.org/casino/poker", None, "block"), (12, "http://a.org/casino/casino", None, "allow"), (13, "", None, "allow"),
    ]
    got = url_filter.judge_urls(spark.createDataFrame([(i, u, "clash") for i, u, _, _ in told], "page_id long, url string, Host string")).collect()
    assert {r.page_id: (r["rule"], r.verdict) for r in got} == {i: (r, v) for i, _, r, v in told}
    assert {r.page_id: (r["host"], r.path) for r in got}[1] == ("example.com", "/en/1")


def test_packing_places_every_piece(docs, empty):
    library = byte_bpe.Encoder(BYTE).library
    got = packing.pack_documents(docs, BYTE).collect()
    ids = collections.defaultdict(list)
    for i, text, *_ in rows():
        ids[i].append(np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4"))
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 in {zlib.crc32(x[r.start : r.start + r.length].tobytes()) for x in ids[r.doc_id]}
    for held in bins.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))] and sum(n for _, n in held) <= 1024
    assert sum(r.length for r in got) == sum(len(x) for v in ids.values() for x in v)
    assert packing.pack_documents(empty, BYTE).count() == 0


def best_of(items, capacity):
    best = [len(items)]

    def fill(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for at in {b: i for i, b in enumerate(bins)}.values():
            if bins[at] >= items[k]:
                bins[at] -= items[k]
                fill(k + 1, bins)
                bins[at] += items[k]
        fill(k + 1, [*bins, capacity - items[k]])

    items = sorted(items, reverse=True)
    fill(0, [])
    return best[0]


def test_dominance_keeps_the_optimum():
    r = random.Random(3)
    for _ in range(300):
        capacity = r.choice([10, 12, 20, 30])
        items = [r.randint(1, capacity) for _ in range(r.randint(1, 9))]
        counts = [items.count(n) for n in range(capacity + 1)]
        fixed = packing.reduce_by_dominance(counts, capacity)
        left = [w for w, n in enumerate(counts) for _ in range(n)]
        assert sorted(left + [w for b, n in fixed for w in b * n]) == sorted(items)
        assert sum(n for _, n in fixed) + best_of(left, capacity) == best_of(items, capacity)


def test_shards_round_trip(spark, docs, empty):
    library = byte_bpe.Encoder(BYTE).library
    got = token_shards.token_shards(docs.union(spark.createDataFrame([(None, "no number", "", "", 0), (-5, "below", "", "", 0)], SCHEMA)), BYTE).collect()
    told = sorted([(r[0], r[1]) for r in rows()] + [(-5, "below")], key=lambda x: (x[0], str(x[1])))
    ids = [np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for _, t in [(None, "no number"), *told]]
    starts = np.cumsum([0, *map(len, ids)])[:-1]
    want = [(i, int(s), len(x), zlib.crc32(x.tobytes())) for i, s, x in zip([None, *(i for i, _ in told)], starts, ids)]
    assert sorted(map(tuple, got), key=lambda x: x[1]) == want
    path = common.fresh_path(spark, "shards")
    token_shards.write_shards(docs, path, BYTE, 2)
    found = token_shards.lookup(spark, path, [7, 12345]).collect()
    assert [(r.doc_id, len(r.ids) // 4) for r in found] == [(7, want[[w[0] for w in want].index(7)][2])]
    assert token_shards.token_shards(empty, BYTE).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_encoders_equal_the_library(seed):
    r = random.Random(seed)
    parts = ["a", "aaaa", "Don't", " ", "  ", "\n", "\t", "\r\n", "é", "é", "²", "\xa0", "\x85", "日本", "😀", "<|endoftext|>", "<|startoftext|>", "'s", "12", ".", "…", "\x1c", "İ", "Σ", "ΑΣ", "\x00"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(1500)]
    mine, words = byte_bpe.Encoder(BYTE), word_bpe.WordBpe(WORD)
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(WORD)
    found = words.encode_batch(texts)
    for text, ids in zip(texts, found):
        assert mine.encode(text).tolist() == mine.library.encode(text, add_special_tokens=False).ids
        want = other.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want and words.decode(ids) == other.decode(want, skip_special_tokens=False)


def test_word_table_stays_bounded(monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMORY", 20)
    mine = byte_bpe.Encoder(BYTE)
    for k in range(20):
        text = passage(k, 50)
        assert mine.encode(text).tolist() == mine.library.encode(text, add_special_tokens=False).ids
    assert len(mine.known) <= 20 and len(mine.words.index) <= 70


def test_word_bpe_over_a_table(docs, empty):
    got = word_bpe.digests(word_bpe.encode_documents(docs, WORD))
    assert got.count() == len(rows()) and got.where("n_tokens is null").count() == 0
    assert word_bpe.encode_documents(empty, WORD).count() == 0


def test_winnowing_keeps_its_promise():
    text = passage(1, 300)
    at, hashes = fingerprints.fingerprint(fingerprints.code_points(text))
    other = fingerprints.fingerprint(fingerprints.code_points("other words before " + text[200 : 200 + fingerprints.GRAM + fingerprints.WINDOW - 1]))[1]
    assert set(hashes) & set(other)
    grams = rolling.Prefix(fingerprints.code_points(text)).windows(fingerprints.GRAM)
    for k in range(len(grams) - fingerprints.WINDOW + 1):
        window = grams[k : k + fingerprints.WINDOW] >> np.uint64(32)
        assert k + int(np.flatnonzero(window == window.min())[-1]) in set(at.tolist())


def test_fingerprints_follow_the_order(docs, empty):
    told = sorted(((r[0], r[1] or "") for r in rows()), key=lambda x: (-x[0], x[1]))
    want = []
    for k, (i, text) in enumerate(told):
        after = told[(k + 1) % len(told)][1]
        half = len(text) // 2
        want.append((i, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
    got = fingerprints.compare_with_next(docs).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    by_text = collections.defaultdict(set)
    for r in got:
        by_text[dict(told)[r.doc_id]].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(v) == 1 for v in by_text.values())
    assert fingerprints.compare_with_next(empty).count() == 0


def test_quality_counts(docs, empty):
    got = {(r.doc_id, r.text): r for r in quality.judge_quality(docs.withColumn("N_Words", F.lit("clash"))).collect()}
    for i, text, *_ in rows():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = collections.Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        hit = {k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(8)}
        seen, again = set(), 0
        for line in (text or "").split("\n"):
            if line.strip(" \t\n\r\x0b\x0c"):
                again += line in seen
                seen.add(line)
        r = got[(i, text)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), again, len(hit))
        assert r.base_failed == (len(words) < 20 or 100 * len(hit) > 30 * len(words))
    assert quality.judge_quality(empty).count() == 0


def test_depleted_documents_go(spark):
    told = [(k, "\n".join(["Home page and search"] * 8 + [f"word{k} " * 3]) if k < 40 else passage(k, 40), "a") for k in range(80)]
    got = quality.judge_quality(spark.createDataFrame(told, "doc_id long, text string, source string")).collect()
    assert all(r.kept == (r.doc_id >= 40) for r in got)


def test_line_dedup(spark, empty):
    told = [(k, f"Site menu\nText {k} of the page\n\nSite menu" if k % 2 else f"Only {k}", "a" if k < 40 else None) for k in range(60)] + [(60, None, "b"), (61, "Site menu", "b")]
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(spark.createDataFrame(told, "doc_id long, text string, source string").withColumn("N_LINES", F.lit(9))).collect()}
    assert got[1].text == "Text 1 of the page\n" and got[1].n_dropped == 2 and got[41].n_dropped == 2
    assert got[60].text is None and got[60].n_lines == 0 and got[61].text == "Site menu" and got[2].text == "Only 2"
    assert line_dedup.drop_boilerplate(empty).count() == 0


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in common.components(links).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100}


def test_pipeline_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    folder = str(tmp_path)
    spark.createDataFrame(rows(), SCHEMA).write.parquet(f"{folder}/documents.parquet")
    at = spark.read.parquet(f"{folder}/documents.parquet")
    names = []
    for name, stage in corpus_pipeline.STAGES:
        before, at = at, common.written(stage(spark, at, folder), name)
        names.append((name, before.count(), at.count()))
        if name != "packing":
            assert at.columns == before.columns
    kept = {n: b for n, _, b in names}
    assert kept["quality_rules"] < len(rows()) and kept["near_duplicates"] < kept["line_dedup"] and kept["packing"] >= kept["repeated_passages"] > 0
    assert corpus_pipeline.run(spark, folder).count() == kept["packing"]


def test_pipeline_cuts_passages_of_over_50_words(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    english = lambda seed, n: " ".join(random.Random(seed).choices("a of the rule card turn player moves board phase".split(), k=n))
    shared, few = {51: english(1, 51), 60: passage(902, 60)}, english(3, 40)
    told = [(k, f"{passage(k, 70)} {shared[n]} {passage(k + 100, 70)}", "en", f"src{k}", 0) for k, n in enumerate([51, 51, 60, 60])]
    clean = [(k, f"{passage(k, 90)} {few} {passage(k + 100, 90)}", "en", f"src{k}", 0) for k in range(10, 13)]
    got = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, spark.createDataFrame(told + clean, SCHEMA), "").collect()}
    assert len(shared[51]) < 400
    for k, n in enumerate([51, 51, 60, 60]):
        assert shared[n] not in got[k] and passage(k, 70) in got[k] and passage(k + 100, 69).split(" ", 1)[1] in got[k]
    assert all(got[r[0]] == r[1] for r in clean)


@pytest.mark.parametrize("group", [256, 1])
def test_short_repeats_equal_brute_force(docs, group, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", group)
    told = rows()
    want = sorted((r[0], *x) for r, x in zip(told, cut_by_force([(r[1] or "").encode() for r in told], 101)))
    assert sorted(map(tuple, repeats.removed_digest(repeats.cut_repeats(docs, "text", 101, 24)).collect())) == want


def test_long_notices_deplete_documents(spark):
    notice = passage(77, 25)
    told = [(k, f"{notice}\nown words of {k}", "big") for k in range(80)] + [(k, passage(k, 60), "big") for k in range(100, 700)]
    told += [(k, f"Copy {k}\n{passage(78, 60)}", "copies") for k in range(700, 703)] + [(k, passage(k, 60), "copies") for k in range(710, 750)]
    told += [(k, f"{passage(80, 30)}\nown words of {k}", "small") for k in range(800, 803)]
    got = {r.doc_id: r for r in quality.judge_quality(spark.createDataFrame(told, "doc_id long, text string, source string")).collect()}
    assert all(not got[k].kept and got[k].n_left == 4 for k in [*range(80), *range(800, 803)])
    assert all(got[k].kept for k in [*range(100, 703), *range(710, 750)])


def test_lines_of_copied_documents_count(spark):
    """A notice that every document of a host holds goes from every copy, however often the documents are copied."""
    notice = passage(5, 25)
    texts = [f"{notice}\n{passage(300 + k, 8)}" for k in range(9)]
    told = [(20 * k + copy, text, "host") for k, text in enumerate(texts) for copy in range(20)] + [(k, f"{passage(k, 30)}\n{passage(k + 1, 30)}" if k > 502 else f"Shared by three\n{passage(k, 30)}", "large") for k in range(500, 600)]
    got = {r.doc_id: r for r in quality.judge_quality(spark.createDataFrame(told, "doc_id long, text string, source string")).collect()}
    assert all(got[k].left_text == passage(300 + k // 20, 8) and got[k].n_left == 8 and not got[k].kept for k in range(180))
    # three of a hundred are no more than three of a million
    assert all(got[k].left_text == got[k].text for k in range(500, 600))


def test_boilerplate_lines_leave_the_text(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    told = [(k, f"Page {k} of 340\n{passage(k, 40)}\n\n  PAGE {k + 1} of 999", "en", "a", 0) for k in range(30)] + [(k, passage(k, 40), "en", "a", 0) for k in range(30, 60)] + [(60, None, "en", "a", 0)]
    docs = spark.createDataFrame(told, SCHEMA)
    judged = {r.doc_id: r for r in quality.judge_quality(docs.withColumn("LEFT_TEXT", F.lit("clash"))).collect()}
    assert judged[60].left_text is None and judged[3].text == told[3][1]
    assert all(judged[k].left_text == passage(k, 40) + ("\n" if k < 30 else "") for k in range(60))
    got = {r.doc_id: r for r in corpus_pipeline.quality_rules(spark, docs, "").collect()}
    assert sorted(got) == list(range(60)) and all((r.text, r.n_chars) == (judged[k].left_text, len(r.text)) for k, r in got.items())


def test_pipeline_drops_lines_of_small_hosts(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    told = [(10 * h + k, f"Menu of {h}\nText {h} {k}", "en", f"host{h}", 0) for h in range(4) for k in range(h + 1)]
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, spark.createDataFrame(told, SCHEMA), "").collect()}
    assert got == {i: text if i == 0 else text.split("\n")[1] for i, text, *_ in told}
