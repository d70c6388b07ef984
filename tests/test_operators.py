"""Operators that SQL does not cover, on the rows that their rules are about."""

from pyspark.sql import functions as F

from folioquery.functions import text as X
from folioquery.operators import citations as C
from folioquery.operators import geometry as G
from folioquery.operators import model as M
from folioquery.operators import retrieval as R
from folioquery.operators import sections as S
from folioquery.sources import pages as P


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("r")).first().r


def test_header_families(spark):
    v = F.col("v")
    for line, code in [("3.0 Sequence of Play", "3.0"), ("2.3.4 Foo", "2.3.4"), ("F3 Wet Mass Adjustment", "f3"), ("I4 Boost", "i4"), ("1B6 Example", "b6")]:
        assert one(spark, X.is_header(v), line) and one(spark, X.extract_code(v), line) == code
    assert one(spark, X.title_case_header(v), "Turn Order") and not one(spark, X.is_header(v), "Turn Order") and not one(spark, X.is_header(v), "[2.5] PARTS INVENTORY")
    assert one(spark, X.slugify(v), None) == "file" and one(spark, X.normalize_code(v), " 6/3 – 2 ") == "6_3-2"


def test_links(spark):
    v = F.col("v")
    assert one(spark, X.link_citations(v), "See [3.5], [6/7], [F4.a], [The Cards] and [3.5](x).") == "See [3.5](section:3.5), [6/7](section:6/7), [F4.a](section:F4.a), [The Cards](section:The%20Cards) and [3.5](x)."
    assert one(spark, X.answer_title(v), "## **Moving Units**\nText") == "Moving Units" and one(spark, X.answer_title(v), "The units move.") == ""
    assert one(spark, X.query_variants(v), "move armies")[1].startswith("move armies move") and one(spark, X.query_variants(v), " ") == []


def test_sentences_keep_their_labels(spark):
    answers = spark.createDataFrame([(1, "Players may not trade. [3.2] They may (see [3.2]) build. Ends [3.2][4.1]")], "id long, answer string")
    allowed = spark.createDataFrame([(1, ["3.2", "4.1"])], "id long, labels array<string>")
    told = C.check_sentences(C.sentences(answers, ["id"]), allowed, ["id"]).orderBy("place").collect()
    assert [(r.sentence, r.valid) for r in told] == [("Players may not trade. [3.2]", True), ("They may (see [3.2]) build.", False), ("Ends [3.2][4.1]", True)]
    literal = C.sentences(answers, ["id"], citation_after_stop=False).orderBy("place").collect()
    assert literal[0].sentence == "Players may not trade." and "".join(r.sentence.replace(" ", "") for r in literal) == answers.first().answer.replace(" ", "")


def test_segments_and_batches(spark):
    pages = spark.createDataFrame([("s", k, "\n".join(f"line {k} {j} " + "x" * 90 for j in range(40))) for k in range(1, 21)], "source string, page int, text string")
    cut = S.segment_lines(pages)
    whole = cut.groupBy("source", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda p: p["text"]), "\n").alias("text"))
    assert whole.join(pages, ["source", "page", "text"]).count() == 20 and cut.where(F.length("text") > 1600).count() == 0
    batches = S.pack_batches(cut).join(cut, ["source", "page", "part"]).groupBy("batch").agg(F.sum(F.length("text") + 32).alias("n")).collect()
    assert max(r.n for r in batches) <= 24000 and sum(1 for r in batches if r.n < 22000) <= 1


def test_spill_over_stops_at_a_header(spark):
    pages = spark.createDataFrame([("s", 1, "end of"), ("s", 2, "this sentence.\n3.1 Next Part\n" + "x" * 200), ("s", 4, "alone")], "source string, page int, text string")
    got = {r.page: r.full_text for r in S.spill_text(pages).collect()}
    assert got[1] == "end of\n\nthis sentence." and got[4] == "alone"
    told = spark.createDataFrame([("s", 1, "3.1 Next"), ("s", 2, "none")], "source string, page int, mark string")
    assert {r.page: r.full_text for r in S.spill_text(pages.join(told, ["source", "page"], "left"), "mark").collect()}[1] == "end of\n\nthis sentence."


def test_first_run_stops_at_the_gap(spark):
    pages = spark.createDataFrame([("a", p) for p in (2, 3, 5, 6, 3)], "k string, page int")
    once = S.first_run(pages, ["k"])
    assert sorted(r.page for r in once.collect()) == [2, 3] and sorted(r.page for r in S.first_run(once, ["k"]).collect()) == [2, 3]


def test_knn_equals_brute_force(spark):
    vectors = [(k, [float((k * 7) % 11), float(k % 5), float(k % 3)]) for k in range(200)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): r.chunk_id for r in R.knn(df.where("vec_id < 5"), df, 3, same=False).collect()}
    for q in range(5):
        far = sorted((round(sum((a - b) ** 2 for a, b in zip(vectors[q][1], v)) ** 0.5, 6), i) for i, v in vectors if i != q)
        assert [got[q, k + 1] for k in range(3)] == [i for _, i in far[:3]]
    assert R.knn(df.limit(0), df, 3).count() == 0


def clustered(n, groups=40, dim=16):
    import numpy as np

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(groups, dim)) * 4
    return [(k, [float(x) for x in centres[k % groups] + rng.normal(size=dim) * 0.3], k % 3) for k in range(n)]


def test_blocks_of_any_size_give_the_same_neighbours(spark):
    df = spark.createDataFrame([(k, [float(x) for x in v[:2]], g) for k, v, g in clustered(300)] + [(900, None, 1)], "vec_id long, embedding array<float>, label int")
    asked = df.where("vec_id % 7 = 0")
    for by in (None, "label"):
        told = [sorted(map(tuple, R.knn(asked, df, 5, by, size=n, asked=m).collect())) for n, m in ((4096, 512), (11, 5), (3, 2))]
        assert told[0] == told[1] == told[2] and len(told[0]) == 5 * asked.where("embedding is not null").count()


def test_cells_prune_clustered_vectors(spark):
    df = spark.createDataFrame(clustered(3000), "vec_id long, embedding array<float>, label int").repartition(4).cache()
    asked = df.where("vec_id % 50 = 0")
    index = R.fit_cells(df)
    assert R.met_share(asked, df, index) < 0.1
    assert R.recall(R.ann(asked, df, index=index), R.knn(asked, df)).first().recall >= 0.95
    assert R.ann(df.limit(0), df.limit(0)).count() == 0


def test_batches_have_no_seams(spark):
    segments = spark.createDataFrame([(s, p, 1, "x" * (500 + (p * 37) % 900)) for s in ("a", "b") for p in range(1, 1500)], "source string, page int, part int, text string")
    got = sorted(map(tuple, S.pack_batches(segments).collect()))
    want = []
    for s in ("a", "b"):
        batch = size = 0
        for p in range(1, 1500):
            n = 500 + (p * 37) % 900 + 32
            if size and size + n > 24000:
                batch, size = batch + 1, 0
            size += n
            want.append((s, p, 1, batch))
    assert got == want
    few = S.pack_batches(segments.where("source = 'a' and page <= 10"), items=4).groupBy("batch").count().collect()
    assert sorted(r["count"] for r in few) == [2, 4, 4]


def test_refined_spill(spark):
    pages = spark.createDataFrame([("s", 1, "one "), ("s", 2, "runs on.\n(A)  New.Part here\nOther"), ("s", 3, "Start of three")], "source string, page int, text string")
    starts = spark.createDataFrame([("s", 2, "Other"), ("s", 2, "(a) new.part"), ("s", 3, "start"), ("s", 2, None), ("s", 2, "newxpart")], "source string, page int, section_start string")
    got = {r.page: r.full_text for r in S.refine_spill(pages, starts).collect()}
    assert got == {1: "one\n\nruns on.", 2: pages.collect()[1].text, 3: "Start of three"}


def boxes(spark, lines):
    """A page a key of `lines`; words of five units a character on lines of ten."""
    rows = []
    for page, texts in lines.items():
        for k, text in enumerate(texts):
            x = 10.0
            for i, word in enumerate(text.split(" ")):
                rows.append(("s", page, 0, k, i, x, 10.0 * k, x + 5 * len(word), 10.0 * k + 8, word, 500.0, 800.0, 0))
                x += 5 * len(word) + 5
    return spark.createDataFrame(rows, "source string, page int, block int, line int, word_no int, x0 double, y0 double, x1 double, y1 double, word string, page_w double, page_h double, rotation int")


def test_codes_are_boxed_at_their_section(spark):
    words = boxes(spark, {1: ["see 3.1 there", "3.1 Moving units fast"], 2: ["no codes in here", "4 . 2 Building roads here"], 3: ["5.1", "Trading goods all day 5.1"]})
    starts = spark.createDataFrame([("s", 1, "3.1", "3.1 Moving units"), ("s", 2, "4.2", "4 . 2 Building roads"), ("s", 3, "5.1", "Trading goods all"), ("s", 1, "9", "nowhere to be")], "source string, page int, code string, section_start string")
    got = {(r.page, r.code): (r.x0, r.y0, r.x1) for r in G.code_box_at(words, starts).collect()}
    assert got == {(1, "3.1"): (10.0, 10.0, 25.0), (2, "4.2"): (10.0, 10.0, 35.0), (3, "5.1"): (10.0, 0.0, 25.0)}
    long = "4.5.6.7.8.9.10.11.12.13.14.15"
    told = G.code_match(boxes(spark, {1: [f"a {long}: b"]}), spark.createDataFrame([(long,), ("b",)], "code string")).collect()
    assert {r.code: r.place for r in told} == {long: 2, "b": 3}
    only = G.phrase_box(words, spark.createDataFrame([("3.1 Moving units",), ("Moving units",)], "phrase string")).collect()
    assert {r.phrase: (r.x0, r.x1) for r in only} == {"3.1 Moving units": (30.0, 45.0), "Moving units": (30.0, 90.0)}


def test_folding_and_titles(spark):
    v = F.col("v")
    assert one(spark, X.ascii_slug(v), "Ĉu ﬁne ½ Straße…") == "cu-fine-12-strae..." and one(spark, X.ascii_slug(v), "Plain Text") == "plain-text"
    assert one(spark, X.tidy_title(v, F.lit("Why so?\nx")), '"?!"') == "Why so" and one(spark, X.tidy_title(v, F.lit("")), "\"'Turn order:'\"\nmore") == "Turn order" and one(spark, X.parse_page(v), "p12.pdf") == 12
    assert one(spark, X.choice_title(X.format_choice(v, F.lit("a.pdf"))), "The Game") == "The Game"


def test_contents_pages(spark):
    pages = spark.createDataFrame([("s", 1, "Table of Contents\n1.0 Setup 3\nTurns\nEnd"), ("s", 2, "Setup 3\nTurns 4\nEnd"), ("s", 3, "Some prose.\nIt has 4\nmore\nand more")], "source string, page int, text string")
    assert {r.page: r.is_toc for r in S.toc_pages(pages).collect()} == {1: True, 2: True, 3: False}


def test_model_errors_stay_in_their_rows(spark):
    def client():
        seen = {}

        def call(prompt):
            seen[prompt] = seen.get(prompt, 0) + 1
            if prompt == "busy" and seen[prompt] < 3:
                raise M.Overloaded("later")
            if prompt == "bad":
                raise ValueError("no")
            return prompt.upper()

        return call

    rows = spark.createDataFrame([(1, "fine"), (2, "busy"), (3, "bad"), (4, "known")], "id long, prompt string")
    cache = spark.createDataFrame([(4, "held")], "id long, answer string")
    got = {r.id: (r.answer, r.error) for r in M.map_model(rows, client, "id", "prompt", cache, pause=0.01).collect()}
    assert got == {1: ("FINE", None), 2: ("BUSY", None), 3: (None, "ValueError: no"), 4: ("held", None)}


def test_artifacts_and_sections(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"pdf": "r.pdf", "page": 2, "version": "v1", "llm": {"sections": [{"section_id": "3.1", "page": 2}], "visual_importance": 1, "full_text": "t"}}')
    (tmp_path / "b.json").write_text("{broken")
    good, bad = P.read_artifacts(spark, str(tmp_path))
    assert [r.page for r in good.collect()] == [2] and bad.count() == 1
    made = S.aggregate_sections(good, "v2.3")
    assert [r.id for r in made.collect()] == ["r#s3.1"]
    P.write_sections(made.select("id", "source", "text"), f"{tmp_path}-out")
    P.write_sections(made.select("id", F.lit("other").alias("source"), "text"), f"{tmp_path}-out")
    P.write_sections(made.select("id", "source", F.lit("again").alias("text")), f"{tmp_path}-out")
    assert {r.source: r.text[:5] for r in P.read_sections(spark, f"{tmp_path}-out").collect()} == {"r.pdf": "again", "other": "Secti"}
    names = {r.name for r in P.file_manifest(spark, str(tmp_path), "*.json").collect()}
    assert names == {"a.json", "b.json"}


def test_boxes_turn_with_the_page(spark):
    box = spark.createDataFrame([(r, 10.0, 16.0, 250.0, 400.0, 500.0, 800.0) for r in (0, 90, 180, 270)], "rotation int, x0 double, y0 double, x1 double, y1 double, page_w double, page_h double")
    got = {r.rotation: (round(r.nx, 2), round(r.ny, 2), round(r.nw, 2), round(r.nh, 2)) for r in G.normalize_box(box).collect()}
    assert got == {0: (0.0, 0.0, 50.0, 50.0), 90: (0.0, 50.0, 50.0, 50.0), 180: (50.0, 50.0, 50.0, 50.0), 270: (50.0, 0.0, 50.0, 50.0)}


def test_plans(spark):
    from folioquery.plans import registry

    plan = lambda name: registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan("o3_top_k")
    for name in ("j2_sources_for_title", "j5_expected_vs_present", "w13_sticky_block", "a1_aggregate_sections"):
        assert "CartesianProduct" not in plan(name) and "Python" not in plan(name)


def test_matching_ratio_is_the_standard_one(spark):
    from difflib import SequenceMatcher

    from folioquery.operators import outline as L

    titles = ["", "combat", "combat phase", "the combat phases", "abcd", "dcba", "sequence of play", "play sequence", "é" * 3, "a" * 250, "ab" * 150, None]
    pairs = spark.createDataFrame([(a, b) for a in titles for b in titles], "a string, b string")
    for r in pairs.select("a", "b", L.matching_ratio(F.col("a"), F.col("b")).alias("ratio"), L.unlike(F.col("a"), F.col("b")).alias("unlike")).collect():
        want = None if r.a is None or r.b is None else SequenceMatcher(None, r.a, r.b).ratio()
        assert r.ratio == want and (want is None or r.unlike == (want < 0.7))
