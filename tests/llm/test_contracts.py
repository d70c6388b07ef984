"""Corpus operators against brute force where results depend on skew, length, order or names of columns."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("folioquery.llm")
import public_tokenizers as P  # noqa: E402

from folioquery.llm import common, fingerprints, line_dedup, ngram_join, quality, repeats, token_shards, url_filter, warc, word_bpe  # noqa: E402

BYTE, WORD = str(P.path("byte_bpe_50k.json")), str(P.path("word_bpe_49k.json"))
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names of columns that operators might use themselves.
ODD = ["_drop", "_host", "_lines", "_n", "_ka", "_word", "_hits", "a.b", "own", "body", "lines", "hits", "da", "db", "ka", "kb", "spans", "n", "host_", "key", "_salt", "x`y"]


def prose(seed, n, of=3000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(of)}" for _ in range(n))


def maximal_by_force(kinds, length):
    """Strings over the anchor that stand twice or more and whose occurrences differ, or end, on both sides."""
    found = set()
    for data, left, _ in kinds:
        for before in range(left + 1):
            for match in range(max(1, length - before), len(data) - left + 1):
                w = data[left - before : left + match]
                own = [k for k, (d, m, _) in enumerate(kinds) if m >= before and d[m - before : m + match] == w]
                if sum(kinds[k][2] for k in own) < 2:
                    continue
                sides = [[], []]
                for k in own:
                    d, m, copies = kinds[k]
                    for side, at in zip(sides, (m - before - 1, m + match)):
                        side += [d[at] if 0 <= at < len(d) else (k, c) for c in range(min(copies, 2))]
                if all(len(set(map(str, side))) > 1 for side in sides):
                    found.add((before, match, frozenset(own)))
    return found


@pytest.mark.parametrize("seed", range(4))
def test_maximal_repeats_equal_brute_force(seed):
    r = random.Random(seed)
    kinds = []
    while len(kinds) < 12:
        left, right = ("".join(r.choice("ab") for _ in range(r.randrange(1, 9))) for _ in range(2))
        kind = (f"{left}#{right}".encode(), len(left), r.choice([1, 1, 2, 5]))
        if kind[:2] not in {k[:2] for k in kinds}:
            kinds.append(kind)
    got = {(m[0][1], m[0][2], frozenset(k for k, _, _ in m)) for m in repeats.maximal_repeats(kinds, 5)}
    assert got == maximal_by_force(kinds, 5)
    wide = [(np.frombuffer(d, np.uint8).astype(">u8").tobytes(), left, n) for d, left, n in kinds]
    assert list(repeats.maximal_repeats(wide, 5, 8)) == list(repeats.maximal_repeats(kinds, 5))
    ranges = collections.defaultdict(list)
    for before, match, own in got:
        for k in own:
            ranges[k].append((-before, match - 1))
    assert repeats.covers(kinds, 5) == repeats.covers(wide, 5, 8) == {k: repeats.merged(v) for k, v in ranges.items()}


def cover_of(text, strings):
    cover = np.zeros(len(text), bool)
    for a, b in strings:
        cover[a:b] = True
    return cover


def covered_by_force(texts, length):
    seen = collections.Counter(tuple(t[i : i + length]) for t in texts for i in range(len(t) - length + 1))
    return [cover_of(t, [(i, i + length) for i in range(len(t) - length + 1) if seen[tuple(t[i : i + length])] > 1]) for t in texts]


@pytest.fixture(scope="module")
def hot(spark):
    """One passage in many texts, cut and continued differently, whole copies, and a periodic text."""
    r, base = random.Random(4), prose(1, 160)
    texts = []
    for k in range(400):
        a, b = r.randrange(0, 80), r.randrange(200, len(base))
        texts.append(f"{prose(k + 10, 8)} {base[a:b]} {prose(k + 1000, 8)}")
    texts += [prose(2, 90)] * 5 + ["ab" * 400, None, ""]
    return texts, spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], DOCS)


@pytest.mark.parametrize("group", [128, 8])
def test_hot_passage_equals_brute_force(hot, group, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", group)
    texts, docs = hot
    raw = [(t or "").encode() for t in texts]
    want = [bytes(np.frombuffer(t, np.uint8)[~c]) for t, c in zip(raw, covered_by_force(raw, 400))]
    got = {r.doc_id: bytes(r.kept_bytes) for r in repeats.cut_repeats(docs).collect()}
    assert [got[k] for k in range(len(texts))] == want


def test_repeat_groups_cover_what_is_cut(hot):
    texts, docs = hot
    groups = repeats.repeat_groups(docs).join(docs.select(*repeats.text_key(F.col("text")), "text").distinct(), ["ka", "kb"]).collect()
    strings = collections.defaultdict(set)
    for r in groups:
        raw = r.text.encode()
        assert r.size >= 400 and r.start >= 0 and r.start + r["size"] <= len(raw)
        strings[r["repeat"], r["size"]].add(raw[r.start : r.start + r["size"]])
    assert all(len(s) == 1 for s in strings.values())
    told = collections.defaultdict(list)
    for r in groups:
        told[r.text].append((r.start, r.start + r["size"]))
    covers = dict(zip([t for t in texts if t], covered_by_force([t.encode() for t in texts if t], 400)))
    assert all((cover_of(t.encode(), told[t]) == c).all() for t, c in covers.items())


def test_passages_of_words(spark):
    shared = prose(5000, 51)
    assert len(shared) < 400
    texts = [f"{prose(k, 70)}\n {shared}\t {prose(k + 100, 70)}" for k in range(20)] + [prose(k, 200) for k in range(200, 230)] + [f"{prose(300, 60)} {prose(5000, 50)} end"]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r for r in repeats.cut_repeats(docs, "text", 51, 8, words=True).collect()}
    for k in range(20):
        assert bytes(got[k].kept_bytes).decode() == f"{prose(k, 70)}\n \t {prose(k + 100, 70)}" and got[k].n_spans == 1
    assert all(got[k].n_removed == 0 for k in range(20, len(texts)))
    told = {r.doc_id: r.n_passage_words for r in repeats.cut_repeats(docs, passage=51).collect()}
    assert told == {k: 51 * (k < 20) for k in range(len(texts))}


@pytest.mark.parametrize("group", [128, 4])
def test_word_windows_equal_brute_force(spark, group, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", group)
    r, base = random.Random(8), prose(1, 200)
    texts = []
    for k in range(60):
        a = r.randrange(0, 120)
        texts.append(f"{prose(k + 10, 12)} {' '.join(base.split()[a : a + r.randrange(10, 80)])} {prose(k + 1000, 12)}")
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], DOCS)
    want = [int(c.sum()) for c in covered_by_force([t.split() for t in texts], 20)]
    got = {r.doc_id: len(texts[r.doc_id].split()) - len(bytes(r.kept_bytes).split()) for r in repeats.cut_repeats(docs, "text", 20, 4, words=True).collect()}
    assert [got[k] for k in range(len(texts))] == want


def test_very_long_texts_keep_their_links(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "slots", lambda df: 1)
    words = prose(1, 150_000, 10**7).split()
    other = list(words)
    other[70_000] = "edit"
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, prose(3, 200))], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_classes(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


@pytest.mark.parametrize("hubs", [1, 8])
def test_few_hubs_lose_no_links(spark, hubs, monkeypatch):
    monkeypatch.setattr(ngram_join, "HUBS", hubs)
    r, texts = random.Random(6), []
    for k in range(90):
        words = prose(k % 5, 80 + 40 * (k % 3)).split()
        for _ in range(r.randrange(6)):
            words[r.randrange(len(words))] = f"e{r.randrange(10**6)}"
        texts.append(" ".join(words))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(texts))] == root


def odd_columns(df):
    return df.select("*", *[F.concat(F.lit(f"{k}|"), F.col(df.columns[0]).cast("string")).alias(c) for k, c in enumerate(ODD)])


def check_odd(df, id_column):
    for row in df.collect():
        assert [row[c] for c in ODD] == [f"{k}|{row[id_column]}" for k in range(len(ODD))]


def test_clashing_names_pass_through(spark):
    menu = "Menu of the site"
    docs = odd_columns(spark.createDataFrame([(k, f"{menu}\n{prose(k, 60)}\n{prose(7, 80)}", "en", "a", 0) for k in range(30)], DOCS))
    assert docs.count() == 30
    check_odd(repeats.cut_repeats(docs, passage=51), "doc_id")
    cut = line_dedup.drop_boilerplate(docs)
    check_odd(cut, "doc_id")
    assert cut.where("n_dropped = 2").count() == 30
    judged = quality.judge_quality(docs)
    check_odd(judged, "doc_id")
    assert judged.where("n_left = 60").count() == 30
    assert ngram_join.ngram_classes(docs).count() == 30 and fingerprints.compare_with_next(docs).count() == 30
    check_odd(url_filter.judge_urls(odd_columns(spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string"))), "page_id")


def test_pipeline_keeps_odd_columns(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = odd_columns(spark.createDataFrame([(k, f"{prose(k // 2, 60)}\n{prose(k // 2 + 50, 60)}", "en", "a", 0) for k in range(20)], DOCS))
    for _, stage in pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, ""), "stage")
        check_odd(docs, "doc_id")
    assert sorted(r.doc_id for r in docs.collect()) == list(range(0, 20, 2))


def test_pipeline_equals_brute_force(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    r, told = random.Random(3), []
    for k in range(60):
        text = f"Page {k} of the site\n{prose(k, 90)}\n{prose(k + 500, 30)}"
        if k % 10 == 1:
            text = told[-1][1]
        elif k % 10 == 2:
            words = told[-1][1].split(" ")
            words[r.randrange(20, 60)] = "edit"
            text = " ".join(words)
        elif k % 10 == 3:
            text = f"{prose(k, 30)} {prose(900, 60)} {prose(k + 300, 30)}"
        elif k % 10 == 4:
            text = "too short"
        told.append((k, text, "en", f"h{k % 2}", len(text)))
    docs = spark.createDataFrame(told + [(60, None, "en", "h0", 0)], DOCS)

    quick = common.written(pipeline.quality_rules(spark, docs, ""), "a")
    normal = lambda line: "".join("0" if c.isdigit() else c for c in " ".join(line.lower().split()))
    rests = collections.defaultdict(set)
    for _, text, _, host, _ in told:
        for line in text.split("\n"):
            rests[host, normal(line)].add(tuple("\0" if normal(x) == normal(line) else x for x in text.split("\n")))
    total = collections.Counter(x[3] for x in told) + collections.Counter(["h0"])
    bad = {x for x, own in rests.items() if len(own) >= 10 or len(own) > max(1, 0.1 * total[x[0]])}
    want = {}
    for k, text, _, host, _ in told:
        left = [x for x in text.split("\n") if (host, normal(x)) not in bad]
        if len(text.split()) >= 20 and sum(len(x.split()) for x in left) >= 0.3 * len(text.split()):
            want[k] = "\n".join(left)
    assert {x.doc_id: x.text for x in quick.collect()} == want

    lines = common.written(pipeline.line_dedup(spark, quick, ""), "b")
    kept = {x.doc_id: x for x in quick.collect()}
    pages = {h: {x.text for x in kept.values() if x.source == h} for h in ("h0", "h1")}
    held = collections.Counter((h, line) for h, texts in pages.items() for t in texts for line in {x.strip() for x in t.split("\n")} if line)
    want = {k: "\n".join(x for x in row.text.split("\n") if not (held[row.source, x.strip()] >= 2 and held[row.source, x.strip()] > 0.1 * len(pages[row.source]))) for k, row in kept.items()}
    assert {x.doc_id: x.text for x in lines.collect()} == want

    near = common.written(pipeline.near_duplicates(spark, lines, ""), "c")
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for k, t in want.items()}
    root = {k: k for k in want}
    for i in sorted(want):
        for j in sorted(want):
            if j < i and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) > 0:
                a, b = root[i], root[j]
                root = {k: min(a, b) if x in (a, b) else x for k, x in root.items()}
    assert sorted(x.doc_id for x in near.collect()) == sorted(k for k in want if root[k] == k)

    cut = common.written(pipeline.repeated_passages(spark, near, ""), "d")
    texts = {x.doc_id: x.text for x in near.collect()}
    covers = dict(zip(texts, covered_by_force([t.split() for t in texts.values()], 51)))
    got = {x.doc_id: x.text for x in cut.collect()}
    assert {k: t.split() for k, t in got.items()} == {k: [w for w, c in zip(t.split(), covers[k]) if not c] for k, t in texts.items()}
    assert any(c.any() for c in covers.values()) and all(got[k] == texts[k] for k, c in covers.items() if not c.any())

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE)
    pieces = pipeline.packing(spark, cut, "").collect()
    size = collections.Counter()
    for p in pieces:
        size[p.doc_id] += p["length"]
    assert size == {k: len(library.encode(t, add_special_tokens=False).ids) + 1 for k, t in got.items()}


def test_ratio_holds_at_hosts_of_every_size(spark):
    told = [(k, f"Shared line\nown {k}", "en", "nine", 0) for k in range(9)] + [(10, "Alone\nhere", "en", "one", 0)] + [(20 + k, f"{'Rare' if k < 2 else k}\nown {k}", "en", "many", 0) for k in range(20)]
    got = {r.doc_id: r.n_dropped for r in line_dedup.drop_boilerplate(spark.createDataFrame(told, DOCS)).collect()}
    assert got == {k: int(k < 9) for k, *_ in told}
    copies = spark.createDataFrame([(k, "Same\ntext", "en", "h", 0) for k in range(5)] + [(5, "Same\nother", "en", "h", 0)], DOCS)
    assert {r.doc_id: r.text for r in line_dedup.drop_boilerplate(copies).collect()} == {k: "" for k in range(5)} | {5: "other"}
    assert {r.doc_id: r.text for r in line_dedup.drop_boilerplate(copies, distinct=True).collect()} == {k: "text" for k in range(5)} | {5: "other"}


def test_copies_count_once_in_quality(spark):
    copy = f"{prose(1, 40)}\n{prose(2, 40)}"
    told = [(k, copy, "en", "h", 0) for k in range(40)] + [(100 + k, prose(k + 10, 40), "en", "h", 0) for k in range(10)]
    got = quality.judge_quality(spark.createDataFrame(told, DOCS)).collect()
    assert all(r.kept and r.left_text == r.text for r in got)


def select_by_force(text, gram, window):
    points = fingerprints.code_points(text)
    grams = fingerprints.Prefix(points).windows(min(gram, len(points))) if len(points) else np.zeros(0, np.uint64)
    high = (grams >> np.uint64(32)).tolist()
    at = set()
    for k in range(max(0, len(high) - min(window, len(high)) + 1) if high else 0):
        part = high[k : k + min(window, len(high))]
        at.add(k + max(i for i, x in enumerate(part) if x == min(part)))
    return [(k, high[k]) for k in sorted(at)]


def test_fingerprints_equal_brute_force(spark):
    texts = [prose(1, 300), prose(1, 300) + " end", "", "abc", "é日😀" * 60, prose(2, 40), None, prose(1, 150) + prose(3, 150)]
    got = {r.doc_id: r for r in fingerprints.compare_with_next(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    alike = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    for k, text in enumerate(texts):
        text, after = text or "", texts[(k - 1) % len(texts)] or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        own, changed, other = (select_by_force(t, fingerprints.GRAM, fingerprints.WINDOW) for t in (text, edited, after))
        sets = [{h for _, h in x} for x in (own, changed, other)]
        r = got[k]
        assert (r.positions, r.edited_positions) == ([p for p, _ in own], [p for p, _ in changed])
        assert r.fingerprint == "".join(f"{h:08x}" for _, h in own) and r.edited_fingerprint == "".join(f"{h:08x}" for _, h in changed)
        assert (r.near_edited, r.near_next) == (alike(sets[0], sets[1]), alike(sets[0], sets[2]))


def test_shards_are_bounded_and_looked_up(spark, monkeypatch):
    monkeypatch.setattr(token_shards, "BLOCKS", 2)
    monkeypatch.setattr(token_shards, "BLOCK", 600)
    told = [(k * 3, prose(k, 30 + k)) for k in range(40)] + [(None, "no number"), (9, "again")]
    docs = spark.createDataFrame(told, "doc_id long, text string")
    path, manifest = common.fresh_path(spark, "shards"), common.fresh_path(spark, "manifest")
    token_shards.write_shards(docs, path, BYTE, 2)
    token_shards.write_manifest(spark, path, manifest)
    rows = spark.read.parquet(manifest).collect()
    assert len(rows) > 8 and sum(r.entries for r in rows) == 42 and sum(r.low is None for r in rows) == 1
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE)
    ids = lambda t: np.array(library.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes()
    got = sorted((str(r.doc_id), bytes(r.ids)) for r in token_shards.lookup(spark, path, [9, 117, 5, None, 10**9], manifest).collect())
    assert got == sorted([("9", ids(prose(3, 33))), ("9", ids("again")), ("117", ids(prose(39, 69))), ("None", ids("no number"))])
    assert token_shards.lookup(spark, path, [4], manifest).count() == 0
    found = sorted(token_shards.token_shards(docs, BYTE).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted([k for k, _ in told], key=lambda x: (x is not None, x))
    assert [r.start for r in found] == [0, *np.cumsum([r.n_tokens for r in found])[:-1].tolist()]


def test_word_bpe_digests_equal_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD)
    texts = [None, "", "One two three", prose(1, 400), "İstanbul ΑΣ\u0000 日本語", "a" * 5000, "  \n\t "] * 2
    got = {r.doc_id: r for r in word_bpe.digests(word_bpe.encode_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), WORD)).collect()}
    for k, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def archive(folder, records):
    (folder / "part-0.warc").write_bytes(b"".join(records))
    return str(folder)


def test_segments_in_any_order_and_lost_ones(spark, tmp_path):
    html = prose(1, 20000)
    digest = hashlib.sha256(html.encode()).hexdigest()
    records = warc.records_of(7, "http://a/", html, digest, None, None)
    assert len(records) > 3
    shuffled = [records[2], records[-1], records[0], *records[3:-1], records[1]]
    for name, held in (("order", shuffled), ("twice", records * 2)):
        (folder := tmp_path / name).mkdir()
        got = warc.read_warc(spark, archive(folder, held)).collect()
        assert [(r.page_id, hashlib.sha256(r.payload).hexdigest()) for r in got] == [(7, digest)] * (len(held) // len(records))
    short = records[-1].replace(b"Segment-Total-Length: ", b"Segment-Total-Length: 9")
    for name, held in (("middle", records[:1] + records[2:]), ("first", records[1:]), ("last", records[:-1]), ("total", records[:-1] + [short])):
        (folder := tmp_path / name).mkdir()
        with pytest.raises(Exception, match="segment"):
            warc.read_warc(spark, archive(folder, held)).collect()


def test_vocabulary_from_a_table(spark):
    told = spark.createDataFrame([("Badword", "strict"), ("meh", "soft"), ("bah", "soft"), (None, "soft"), ("meh", "soft")], "term string, kind string")
    strict, soft = url_filter.terms_of(told)
    assert (strict, soft) == (["Badword"], ["bah", "meh"])
    urls = spark.createDataFrame([(1, "http://a.org/badword"), (2, "http://a.org/badwords"), (3, "http://a.org/meh/meh"), (4, "http://a.org/meh-bah"), (5, None)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(urls, strict=strict, soft=soft).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow", 4: "block", 5: "allow"}
    with pytest.raises(ValueError):
        url_filter.terms_of(told, most=2)


def test_salted_join_keeps_rows(spark):
    left = spark.createDataFrame([(0, k) for k in range(200)] + [(k, k) for k in range(5)], "k int, v int")
    right = spark.createDataFrame([(k, f"r{k}") for k in range(4)], "k int, w string")
    hot = common.hot_keys(left, ["k"], 2)
    assert [r.k for r in hot.collect()] == [0]
    got = common.salted_join(left, right, ["k"], hot)
    assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right, ["k"], "left").collect()))
