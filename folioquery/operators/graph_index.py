"""Approximate neighbours by a navigable graph, one for each part of the vectors, and exact ones by blocks ruled out early.

A part holds PART vectors at most, so parts grow in number and not in size. Of each vector the graph keeps neighbours
that are not nearer to each other than to it, and the links back; pivots spread over the part are where walks begin. A
question walks every part's graph with a beam, and the best of all parts are ranked. The index is a table, a row a part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import AT_ONCE, QUESTIONS, RANKED, block_rows, blocks, distances, salts_for

#: Vectors of a part; neighbours chosen for a vector, out of so many nearest; breadth of the beam, at least, and the
#: vectors of a part for one of its places: a question is no vector of most parts, and has to be led to its neighbours there.
PART, DEGREE, NEAREST, BEAM, PLACE = 16384, 10, 32, 20, 64


def spread_pivots(points: np.ndarray, count: int) -> np.ndarray:
    """Places of vectors that are far from each other: each the furthest from those before."""
    at = [0]
    far = distances(points, points[:1])[:, 0]
    while len(at) < min(count, len(points)):
        at.append(int(far.argmax()))
        far = np.minimum(far, distances(points, points[at[-1:]])[:, 0])
    return np.array(at)


def neighbour_graph(points: np.ndarray, degree: int = DEGREE, nearest: int = NEAREST) -> np.ndarray:
    """A row of places for each vector, -1 where there are fewer: its chosen neighbours and those that chose it."""
    n = len(points)
    if n < 2:
        return np.full((n, 1), -1, np.int32)
    nearest = min(nearest, n - 1)
    near, far = np.empty((n, nearest), np.int64), np.empty((n, nearest))
    for low in range(0, n, step := max(1, AT_ONCE // n)):
        d = distances(points[low : low + step], points)
        d[np.arange(len(d)), np.arange(low, low + len(d))] = np.inf
        part = np.argpartition(d, nearest - 1, 1)[:, :nearest]
        order = np.argsort(np.take_along_axis(d, part, 1), 1, kind="stable")
        near[low : low + step] = np.take_along_axis(part, order, 1)
        far[low : low + step] = np.take_along_axis(d, near[low : low + step], 1)
    chosen, count = np.full((n, degree), -1, np.int64), np.zeros(n, np.int64)
    for k in range(nearest):
        # one that is nearer to a chosen neighbour than to the vector is reached through that
        hidden = np.empty(n, bool)
        for low in range(0, n, 1024):
            at = slice(low, low + 1024)
            behind = ((points[near[at, k]][:, None] - points[np.maximum(chosen[at], 0)]) ** 2).sum(2)
            hidden[at] = ((behind < far[at, k, None]) & (chosen[at] >= 0)).any(1)
        new = np.flatnonzero(~hidden & (count < degree))
        chosen[new, count[new]] = near[new, k]
        count[new] += 1
    # places left over go to the nearest that were passed by
    for k in range(nearest):
        new = np.flatnonzero((count < degree) & ~(chosen == near[:, k, None]).any(1))
        chosen[new, count[new]] = near[new, k]
        count[new] += 1
    own, other = np.nonzero(chosen >= 0)[0], chosen[chosen >= 0]
    pairs = np.unique(np.concatenate([own * n + other, other * n + own]))
    a, b = pairs // n, pairs % n
    d = ((points[a] - points[b]) ** 2).sum(1)
    order = np.lexsort((d, a))
    a, b = a[order], b[order]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    out = np.full((n, 3 * degree), -1, np.int32)
    few = rank < 3 * degree
    out[a[few], rank[few]] = b[few]
    return out


def walk(points: np.ndarray, graph: np.ndarray, pivots: np.ndarray, asked: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each question the places of its `beam` best vectors (-1 where there are fewer), their squared distances, and how many vectors it met.

    All questions step together: each goes on to the neighbours of its best vector that it hasn't left yet, until none
    of those in the beam is left.
    """
    q, n = len(asked), len(points)
    met = np.zeros((q, n), bool)
    met[:, pivots] = True
    far = distances(asked, points[pivots])
    width = max(beam, len(pivots))
    places = np.full((q, width), -1, np.int64)
    best = np.full((q, width), np.inf)
    places[:, : len(pivots)], best[:, : len(pivots)] = pivots, far
    order = np.argsort(best, 1, kind="stable")[:, :beam]
    places, best = np.take_along_axis(places, order, 1), np.take_along_axis(best, order, 1)
    left = np.zeros_like(places, bool)
    going = np.arange(q)
    while len(going):
        open_ = np.where(left[going] | (places[going] < 0), np.inf, best[going])
        at = open_.argmin(1)
        more = np.isfinite(open_[np.arange(len(going)), at])
        going, at = going[more], at[more]
        if not len(going):
            break
        left[going, at] = True
        step = graph[places[going, at]].astype(np.int64)
        new = (step >= 0) & ~met[going[:, None], np.maximum(step, 0)]
        who, column = np.nonzero(new)
        to = step[who, column]
        met[going[who], to] = True
        d = np.full(step.shape, np.inf)
        d[who, column] = ((points[to] - asked[going[who]]) ** 2).sum(1)
        all_places = np.concatenate([places[going], np.where(new, step, -1)], 1)
        all_best, all_left = np.concatenate([best[going], d], 1), np.concatenate([left[going], np.zeros(step.shape, bool)], 1)
        order = np.argsort(all_best, 1, kind="stable")[:, :beam]
        places[going], best[going], left[going] = (np.take_along_axis(x, order, 1) for x in (all_places, all_best, all_left))
    return places, best, met.sum(1)


def graph_index(chunks: DataFrame, number: str = "vec_id", vector: str = "embedding", size: int = PART, degree: int = DEGREE) -> DataFrame:
    """salt, ids, matrix, graph, pivots: a row for each part of the vectors. Null vectors are left out."""
    parts = blocks(chunks, number, vector, [], size, salts_for(chunks, [], size))

    def build(batches):
        for salt, ids, raw in block_rows(batches, "salt", "ids", "matrix"):
            points = np.frombuffer(raw).reshape(len(ids), -1)
            pivots = spread_pivots(points, int(np.ceil(np.sqrt(len(ids)) / 2)))
            row = [salt, ids, raw.to_pybytes(), neighbour_graph(points, degree).tobytes(), pivots.astype(np.int32).tobytes()]
            kinds = [pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=["salt", "ids", "matrix", "graph", "pivots"])

    return parts.mapInArrow(build, "salt int, ids array<long>, matrix binary, graph binary, pivots binary")


def graph_candidates(questions: DataFrame, index: DataFrame, k: int = RANKED, beam: int = BEAM, number: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, chunk_id, score, salt, met: the k best of each part for each question, and the vectors it met there."""
    asked = blocks(questions, number, vector, [], QUESTIONS, salts_for(questions, [], QUESTIONS)).select(F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))
    last = int(index.agg(F.max("salt")).first()[0] or 0)
    pairs = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(last)))).join(index, "salt")

    def rank(batches):
        for q_ids, q_raw, salt, ids, raw, edges, first in block_rows(batches, "q_ids", "q_matrix", "salt", "ids", "matrix", "graph", "pivots"):
            points, asked_points = np.frombuffer(raw).reshape(len(ids), -1), np.frombuffer(q_raw).reshape(len(q_ids), -1)
            graph = np.frombuffer(edges, np.int32).reshape(len(ids), -1)
            places, best, met = walk(points, graph, np.frombuffer(first, np.int32).astype(np.int64), asked_points, max(beam, k, -(-len(ids) // PLACE)))
            own, far = ids[np.maximum(places, 0)], np.sqrt(best).round(6)
            order = np.lexsort((own, far), axis=1)[:, :k]
            own, far = np.take_along_axis(own, order, 1), np.take_along_axis(far, order, 1)
            who, column = np.nonzero(np.isfinite(far))
            columns = [q_ids[who], own[who, column], far[who, column], np.full(len(who), salt, np.int32), met[who]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "chunk_id", "score", "salt", "met"])

    return pairs.select("q_ids", "q_matrix", "salt", "ids", "matrix", "graph", "pivots").mapInArrow(rank, "query_id long, chunk_id long, score double, salt int, met long")


def graph_search(questions: DataFrame, index: DataFrame, k: int = RANKED, beam: int = BEAM, number: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, chunk_id, score, rank, as knn, from an index; candidates are scored exactly."""
    near = graph_candidates(questions, index, k, beam, number, vector).select("query_id", "chunk_id", "score")
    w = Window.partitionBy("query_id").orderBy("score", "chunk_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def share_met(candidates: DataFrame, chunks: int) -> DataFrame:
    """met_share: vectors that a question met on average, as a share of all."""
    own = candidates.groupBy("query_id", "salt").agg(F.first("met").alias("met")).groupBy("query_id").agg(F.sum("met").alias("met"))
    return own.agg(F.round(F.avg("met") / max(1, chunks), 6).alias("met_share"))
