"""What the third round's findings asked for."""

from pyspark.sql import functions as F

from folioquery.operators import geometry as G
from folioquery.operators import word_index as W
from test_operators import boxes


def plan(df):
    return df._jdf.queryExecution().toString()


def test_starts_are_sought_on_their_own_page(spark):
    words = boxes(spark, {p: ["of the and", f"the and of {p} the and"] for p in range(40)}).withColumn("block", F.lit(0))
    starts = spark.createDataFrame([("s", p, "of the and") for p in range(40)] + [("s", 1, "the: and of"), ("s", 2, "missing words"), ("s", 3, "of"), ("s", 4, "and 4"), ("s", 99, "of the"), ("t", 1, "of the"), ("s", 5, " ")], "source string, page int, section_start string")
    got = {r.source: (r.total, r.found) for r in G.anchor_hit_rate(starts, words).collect()}
    assert got == {"s": (45, 41), "t": (1, 0)}
    # the starts' words are joined by their page: a join by word alone grows with the square of the pages
    joins = [line for line in plan(G.anchor_hit_rate(starts, words)).splitlines() if "Join LeftOuter" in line or "Join Inner" in line]
    assert joins and all("page" in line for line in joins)


def test_stored_words_come_back_whole_and_none_moves(spark, tmp_path):
    words = W.placed(boxes(spark, {p: ["Of the, and of", f"the {p} – of"] for p in range(30)}))
    W.write_index(words, f"{tmp_path}/words")
    held = W.read_index(spark, f"{tmp_path}/words", spark.createDataFrame([("of",), ("the",), ("7",)], "key string"))
    columns = ["source", "page", "n_words", "place", *W.BOX, "key"]
    want = sorted(map(tuple, words.where(F.col("key").isin("of", "the", "7")).select(*columns).collect()))
    assert sorted(map(tuple, held.select(*columns).collect())) == want and len(want) == 30 * 5 + 1


def test_headers_of_a_known_numbering(spark):
    from folioquery.operators import sections as S

    pages = spark.createDataFrame([("s", 1, "1.2 Part 3\n20.118.157.107 is an address"), ("s", 2, "body\n1.2 Again"), ("s", 3, "11.2 Other")], "source string, page int, text string")
    told = lambda *form: {(r.code, tuple(r.pages), r.title) for r in S.header_index(pages, *form).collect()}
    assert told(r"\d\.\d") == {("1.2", (1, 2), "Part 3")}
    assert told() == {("1.2", (1, 2), "Part 3"), ("20.118.157.107", (1,), "is an address"), ("11.2", (3,), "Other")}


def test_headers_in_texts_equal_sql(spark, tmp_path):
    """Texts with network addresses at the start of a line, as larger tables have them."""
    import duckdb

    import __spark_entry__ as E

    rows = [(k, f"prose {k}\n20.118.157.{k % 7} and more\nßs Gaß" if k % 3 else "short", "en", f"src{k % 2}", 10) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("a8_header_index", "o5_code_sets", "j7_outline_qa"):
        df, told = E.queries()[name](spark, str(tmp_path)), con.sql(E.oracle_sql()[name])
        assert sorted(map(tuple, df.select(*told.columns).collect()), key=str) == sorted(told.fetchall(), key=str), name


def test_raised_fields_go_letter_by_letter(spark):
    import duckdb

    from folioquery.plans.retrieval_queries import FIELDS, spark_field

    text = "x" * 99 + "Straße ŉ ﬁne ǰ ΐ éa Ǆ"
    field = FIELDS["embedding_prefix_headers"]
    own = spark.createDataFrame([(text,)], "text string").select(F.lower(spark_field(field)).alias("v")).first().v
    assert own == duckdb.execute(f"select lower({field}) from (select ? as text)", [text]).fetchone()[0] and "ß" in own


def test_graph_recall_of_vectors_spread_evenly(spark):
    """Over 4096 vectors, and with questions that are no vectors of most parts."""
    import numpy as np

    from folioquery.operators import graph_index as N
    from folioquery.operators import retrieval as R

    told = np.random.default_rng(4).normal(size=(6000, 24))
    chunks = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(told)], "vec_id long, embedding array<double>")
    asked = chunks.where("vec_id % 50 = 0")
    for size in (N.PART, 3000):
        index = N.graph_index(chunks, size=size)
        assert R.recall(N.graph_search(asked, index), R.knn(asked, chunks)).first().recall >= 0.9


def test_distances_are_held_a_few_at_a_time():
    import tracemalloc

    import numpy as np

    from folioquery.operators import graph_index as N

    told = np.random.default_rng(4).normal(size=(5000, 32))
    tracemalloc.start()
    N.neighbour_graph(told)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 60


def drawn_words(spark, pages=30):
    """Pages of few different words, laid out as rows, and the same as a row a page."""
    import random

    rng = random.Random(5)
    words = boxes(spark, {p: [" ".join(rng.choice(["of", "The,", "and", "ofthe", "oft", "x"]) for _ in range(7)) for _ in range(p % 7 + 1)] for p in range(pages)}).withColumn("block", F.lit(0))
    return words, W.laid(words)


def test_phrases_with_gaps_move_asked_words_once(spark):
    words, laid = drawn_words(spark)
    # a phrase that is asked for twice is found as well
    phrases = spark.createDataFrame([("of the and",), ("The of",), ("and",), ("of the and",), ("the x of the",), ("none of",)], "phrase string")
    read = {p: sorted((r.block, r.line, r.word_no, r.y0, r.x0, r.x1, r.y1, W_key(r.word)) for r in words.where(F.col("page") == p).collect()) for p in range(30)}
    want = set()
    for p, page in read.items():
        for phrase in {r.phrase for r in phrases.collect()}:
            tokens, keys = phrase.lower().split(), [w[-1] for w in page]
            runs = [list(range(i, i + len(tokens))) for i in range(len(page)) if keys[i : i + len(tokens)] == tokens]
            if not runs and len(tokens) > 1:
                heights = sorted(max(0.5, w[6] - w[3]) for w in page)
                jump = max(6, 1.6 * (heights[(len(heights) - 1) // 2] + heights[len(heights) // 2]) / 2)
                for i in [i for i, k in enumerate(keys) if k == tokens[0]]:
                    used = [i]
                    for t in tokens[1:]:
                        nxt = next((j for j in range(used[-1] + 1, len(page)) if keys[j] == t), None)
                        if nxt is None or (page[nxt][1] != page[used[-1]][1] and abs(page[nxt][3] - page[used[-1]][3]) > jump):
                            break
                        used.append(nxt)
                    if len(used) == len(tokens) and len({page[j][1] for j in used}) <= 2:
                        runs.append(used)
            if runs:
                want.add((p, phrase, min(page[j][4] for j in runs[0]), min(page[j][3] for j in runs[0]), max(page[j][5] for j in runs[0]), max(page[j][6] for j in runs[0])))
    for form in (words, laid):
        told = G.phrase_box_gaps(form, phrases)
        assert {tuple(r)[1:] for r in told.collect()} == want and told.count() == len(want) > 60
    steps = plan(G.phrase_box_gaps(laid, phrases)).split("== Physical Plan ==")[1]
    assert "InPandas" not in steps and "Window" not in steps


def W_key(word):
    return word.lower().strip(" -–—:;,.")


def test_boxes_of_laid_pages_merge_where_they_are(spark):
    words, laid = drawn_words(spark)
    merged = G.merge_boxes(laid.select("source", "page", "words"), ["source", "page"])
    rows = G.merge_boxes(words.select("source", "page", *W.BOX), ["source", "page"])
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, rows.collect())) and rows.agg(F.sum("words")).first()[0] == words.count()
    kept = laid.localCheckpoint()
    assert "Exchange" not in plan(G.merge_boxes(kept, ["source", "page"]))


def test_codes_are_read_on_their_page(spark):
    words, laid = drawn_words(spark)
    codes = spark.createDataFrame([("OfThe",), ("and",), ("ofofoft",), ("xx",), ("xx",), ("q",), ("",)], "code string")
    read = {p: sorted((r.block, r.line, r.word_no, r.y0, r.x0, r.x1, r.y1, r.word.lower()) for r in words.where(F.col("page") == p).collect()) for p in range(30)}
    want = set()
    for p, page in read.items():
        for code in ("OfThe", "and", "ofofoft", "xx", "q"):
            for i in range(len(page)):
                used = next((page[i : i + k] for k in range(1, 7) if "".join(w[-1] for w in page[i : i + k]).startswith(code.lower())), None)
                if used:
                    want.add((p, code, min(w[4] for w in used), min(w[3] for w in used), max(w[5] for w in used), max(w[6] for w in used)))
                    break
    for form in (words, laid):
        assert sorted(tuple(r)[1:] for r in G.code_box(form, codes).collect()) == sorted(want)
    steps = plan(G.code_box(laid.localCheckpoint(), codes)).split("== Physical Plan ==")[1]
    assert "Window" not in steps and steps.count("Exchange hashpartitioning(source") <= 1


def test_what_is_known_of_sessions_is_read_once():
    """For all sessions of a bucket; in order of time, with the numbers as they break ties."""
    import pandas as pd

    from folioquery.streaming.processors import Block

    class Kept:
        def __init__(self):
            self.value, self.calls = [], 0

        def exists(self):
            return bool(self.value)

        def get(self):
            self.calls += 1
            return iter(self.value)

        def put(self, value):
            self.calls += 1
            self.value = value

        def clear(self):
            self.value = []

    block = Block(False, "long", 3_600_000)
    block.known = kept = Kept()
    at = lambda minutes: pd.Timestamp("2024-01-01 00:00:00.123457") + pd.Timedelta(minutes=minutes)

    def told(*rows):
        frame = pd.DataFrame(rows, columns=["sid", "ts", "event_id", "flagged", "control"])
        return [tuple(r) for r in pd.concat(block.handleInputRows((3,), iter([frame[:2], frame[2:]]), None))[["sid", "event_id", "blocked", "since"]].itertuples(index=False)]

    first = told((7, at(2), 4, False, None), (7, at(0), 1, True, None), (7, at(1), 3, False, None), (7, at(1), 2, None, "unblock"), (8, at(1), 9, True, None))
    assert first == [(7, 1, True, at(0)), (7, 2, False, pd.NaT), (7, 3, False, pd.NaT), (8, 9, True, at(1)), (7, 4, False, pd.NaT)]
    # a session that is free needs no entry
    assert [r[0] for r in kept.value] == [8] and kept.calls == 1
    assert told((8, at(61), 10, False, None), (7, at(6), 6, True, None)) == [(7, 6, True, at(6)), (8, 10, True, at(1))] and kept.calls == 3
    assert told((8, at(122), 11, False, None), (7, at(8), 12, False, "unblock")) == [(7, 12, False, pd.NaT), (8, 11, False, pd.NaT)] and kept.value == []


def test_page_files_lie_in_a_folder_a_source(spark, tmp_path):
    from folioquery.sources import pages as P

    docs = spark.createDataFrame([(k, f"a/b{k % 2}", None if k == 3 else f"é text {k}\n") for k in range(600)], "doc_id long, source string, text string")
    for path in (f"{tmp_path}/one", f"file:{tmp_path}/two", f"file://{tmp_path}/three"):
        P.write_page_files(docs, path)
        told = {r.path.split("/")[-1]: r["size_bytes"] for r in P.file_manifest(spark, path, "*.txt", recursive=True).where(F.col("path").contains("b1")).collect()}
        want = {f"part={p}.txt": sum(len(("" if k == 3 else f"é text {k}\n").encode()) + 1 for k in range(600) if k % 2 and k // 256 == p) for p in range(3)}
        assert told == want
    assert sorted(f.name for f in (tmp_path / "one").iterdir()) == ["source=a%2Fb0", "source=a%2Fb1"]
    # no folder for each file
    assert all(f.is_file() for f in (tmp_path / "one" / "source=a%2Fb0").iterdir())


def test_sections_of_a_source_are_stored_by_many_tasks(spark, tmp_path):
    from folioquery.sources import pages as P

    rows = spark.range(20_000).select(F.concat(F.lit("s#"), "id").alias("id"), F.lit("s").alias("source"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        P.write_sections(rows, f"{tmp_path}/store")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "store" / "source=s").glob("*.parquet"))) > 3
    told = P.read_sections(spark, f"{tmp_path}/store")
    assert told.select("id", "text").exceptAll(rows.select("id", "text")).isEmpty() and told.count() == 20_000


def test_pieces_are_stored_as_lists_without_a_shuffle(spark, tmp_path):
    import random

    from folioquery.operators import substring_index as U

    rng = random.Random(3)
    told = [(k, None if k % 50 == 7 else "".join(rng.choice("aAbé ") for _ in range(rng.randrange(0, 40)))) for k in range(400)]
    rows = spark.createDataFrame(told, "n long, text string").repartition(3)
    U.write_pieces(rows, f"{tmp_path}/pieces", "n", "text")
    stored = spark.read.parquet(f"{tmp_path}/pieces")
    pairs = {(k, p) for k, t in told if t for b in [t.lower().encode()] for p in (b[i] << 16 | b[i + 1] << 8 | b[i + 2] for i in range(len(b) - 2))}
    got = [(n, r.piece) for r in stored.collect() for n in r.numbers]
    # a row for a piece and batch, not for a piece and text
    assert set(got) == pairs and len(got) == len(pairs) and stored.count() <= 3 * len({p for _, p in pairs}) < len(pairs)
    asked = ["aab", "é", "b", "ab a", "a", "zzz", "bé b", ""]
    found = U.rows_with(spark, f"{tmp_path}/pieces", spark.createDataFrame([(t,) for t in asked], "term string"), rows, "n", "text")
    assert sorted(map(tuple, found.select("term", "number").collect())) == sorted((t, k) for t in asked for k, x in told if t and x and t in x.lower())


def test_bare_words_are_remembered_once():
    import public_tokenizers
    from tokenizers import Tokenizer

    from folioquery.llm.byte_bpe import Encoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, text = Tokenizer.from_file(path), "Plain words, plain. wörter! wörter plain? x1 Words"
    for memory in (3, 1000):
        own = Encoder(path, memory)
        for _ in range(2):
            assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert " Words" not in own.known and " words" in own.known


def test_words_that_come_once_take_no_room():
    import public_tokenizers
    from tokenizers import Tokenizer

    from folioquery.llm.byte_bpe import Encoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), Encoder(path, 40)
    texts = ["One two, three wörter. x1***", "Two words two, wörter", "one two\nthree, two. wörter! one two", *(" ".join(f"w{chr(97 + k)}{chr(97 + n)}," for n in range(26)) for k in range(26))]
    for text in texts[:1] + texts:
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
        if text == texts[0]:
            assert len(own.words.index) in (0, 5)
    assert len(own.words.index) < 20 and len(own.known) <= 10
    for text in texts + texts:
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(own.words.index) == 40
