"""The graph index finds what an exact search finds, over more than one part."""

import numpy as np
from pyspark.sql import functions as F

from folioquery.operators import graph_index as N
from folioquery.operators import pivots as V
from folioquery.operators import retrieval as R
from folioquery.operators import substring_index as U


def points(n, groups, dim=24):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(groups, dim)) * 3
    return centres[np.arange(n) % groups] + rng.normal(size=(n, dim))


def test_graph_recall_over_parts(spark):
    told = [(k, [float(x) for x in v]) for k, v in enumerate(points(3000, 30))]
    chunks = spark.createDataFrame([*told, (3000, None)], "vec_id long, embedding array<float>")
    asked = chunks.where("vec_id % 60 = 0")
    index = N.graph_index(chunks, size=800)
    assert index.count() >= 4 and index.agg(F.sum(F.size("ids"))).first()[0] == 3000
    found, exact = N.graph_search(asked, index), R.knn(asked, chunks)
    assert R.recall(found, exact).first().recall >= 0.9
    assert N.share_met(N.graph_candidates(asked, index), 3000).first().met_share < 0.25
    both = found.join(exact, ["query_id", "chunk_id"]).where(F.abs(found.score - exact.score) > 1e-5)
    assert both.count() == 0 and found.groupBy("query_id").count().where("count <> 12").count() == 0


def test_graph_of_few_and_equal_vectors(spark):
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(40)] + [(50, [5.0, 5.0])], "vec_id long, embedding array<float>")
    found = N.graph_search(same.where("vec_id = 50"), N.graph_index(same), 3)
    assert [(r.chunk_id, r["rank"]) for r in found.orderBy("rank").collect()][0] == (50, 1) and found.count() == 3
    one = same.where("vec_id = 50")
    assert [r.chunk_id for r in N.graph_search(one, N.graph_index(one)).collect()] == [50]
    assert N.graph_search(one, N.graph_index(one.limit(0))).count() == 0


def test_graph_keeps_links_both_ways():
    told = points(600, 6)
    graph = N.neighbour_graph(told, 6)
    links = {(a, int(b)) for a, row in enumerate(graph) for b in row if b >= 0}
    assert all(a != b for a, b in links) and sum((b, a) in links for a, b in links) > 0.9 * len(links)


def test_pivots_rule_out_cells_and_stay_exact(spark):
    told = [(k, [float(x) for x in v]) for k, v in enumerate(points(3000, 30) * 1.0)]
    chunks = spark.createDataFrame([*told, (3000, None)], "vec_id long, embedding array<float>")
    asked = chunks.where("vec_id % 100 = 0")
    found, exact = V.knn_by_pivots(asked, chunks), R.knn(asked, chunks)
    columns = ["query_id", "chunk_id", "score", "rank"]
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(map(tuple, exact.select(*columns).collect()))
    assert V.pairs_met(asked, chunks) < 0.25
    few = chunks.where("vec_id < 5")
    assert V.knn_by_pivots(few, few).count() == 25 and V.knn_by_pivots(few, few.limit(0)).count() == 0


def test_pieces_choose_few_rows(spark, tmp_path):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefghijklmnopé"), 6)) for _ in range(400)]
    told = [(k, " ".join(rng.choice(words, 20))) for k in range(400)] + [(400, None), (401, ""), (402, "ab"), (403, "Needle in HAY")]
    rows = spark.createDataFrame(told, "n long, text string")
    terms = ["eedle", "in hay", "ab", "nowhere at all", words[0], words[1][1:5], "é"]
    asked = spark.createDataFrame([(t,) for t in [*terms, ""]], "term string")
    U.write_pieces(rows, f"{tmp_path}/pieces", "n", "text")
    found = sorted(map(tuple, U.rows_with(spark, f"{tmp_path}/pieces", asked, rows, "n", "text").collect()))
    assert found == sorted((t, k) for t in terms for k, text in told if text is not None and t in text.lower())
    tested = {r.term: r["count"] for r in U.rows_to_test(spark, f"{tmp_path}/pieces", asked, rows, "n").groupBy("term").count().collect()}
    assert tested["eedle"] == 1 and tested["in hay"] == 1 and tested[words[0]] < 60 and tested["ab"] == 404 and "nowhere at all" not in tested
