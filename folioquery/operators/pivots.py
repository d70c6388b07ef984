"""Exact neighbours without meeting all vectors: pivots, and the triangle inequality.

Each vector lies in the cell of its nearest pivot. No vector of a cell is nearer to a question than its pivot less the
cell's radius; so once a question knows k vectors, it only has to meet cells that may hold a nearer one. What it knows
first are the vectors of its own cell. Pivots are PIVOTS at most, whatever the table; only they and the cells' radii are
sent to the tasks. Where vectors form clusters few cells are met, where they are spread evenly all of them are, and the
result is exact either way.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph_index import spread_pivots
from .retrieval import AT_ONCE, RANKED, distances, knn, with_cells

#: Pivots at most, vectors for one at least, and vectors that pivots are chosen from, those of the smallest hashes.
PIVOTS, EACH, SAMPLE = 1024, 64, 20_000
#: What scores may be off by, as they are rounded.
SLACK = 2e-6


def choose_pivots(chunks: DataFrame, number: str = "vec_id", vector: str = "embedding") -> np.ndarray:
    """Vectors that are far from each other, out of a bounded sample; any choice gives exact results."""
    rows = chunks.where(F.col(vector).isNotNull()).select(F.col(number).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    told = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    if not told:
        return np.zeros((0, 0))
    points = np.array([r["v"] for r in told])
    return points[spread_pivots(points, int(min(PIVOTS, max(1, len(points) // EACH))))]


def in_cells(chunks: DataFrame, pivots: np.ndarray, vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """chunks with their cell, and the radius of each cell; that of an empty one is below 0."""
    held = with_cells(chunks, pivots, 1, vector)

    @F.pandas_udf("double")
    def away(values: pd.Series, cells: pd.Series) -> pd.Series:
        if not len(values):
            return pd.Series([], dtype=float)
        return pd.Series(np.sqrt(((np.stack(values.to_list()).astype(float) - pivots[cells.to_numpy()]) ** 2).sum(1)))

    radius = np.full(len(pivots), -1.0)
    for cell, far in held.groupBy("cell").agg(F.max(away(vector, "cell"))).collect():
        radius[cell] = far
    return held, radius


def cells_to_meet(questions: DataFrame, pivots: np.ndarray, radius: np.ndarray, vector: str = "embedding", most: str = "most") -> DataFrame:
    """questions with `cell`, a row for each cell that may hold a vector within `most`; null: any distance."""

    @F.pandas_udf("array<int>")
    def near(values: pd.Series, limits: pd.Series) -> pd.Series:
        if not len(values):
            return pd.Series([], dtype=object)
        points, most, step, out = np.stack(values.to_list()).astype(float), limits.fillna(np.inf).to_numpy()[:, None], max(1, AT_ONCE // len(pivots)), []
        for k in range(0, len(points), step):
            low = np.sqrt(distances(points[k : k + step], pivots)) - radius[None] - SLACK
            out += [np.flatnonzero(row).astype(np.int32) for row in (radius[None] >= 0) & (low <= most[k : k + step])]
        return pd.Series(out)

    return questions.where(F.col(vector).isNotNull()).withColumn("cell", F.explode(near(vector, most)))


def limits(questions: DataFrame, held: DataFrame, pivots: np.ndarray, k: int, number: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """questions with most, the distance of the k-th vector of their own cell; null where it has fewer."""
    own = knn(with_cells(questions.select(number, vector), pivots, 1, vector), held, k, "cell", number, vector)
    last = own.where(F.col("rank") == k).select(F.col("query_id").alias("_q"), F.col("score").alias("most"))
    return questions.join(last, questions[number] == last["_q"], "left").drop("_q")


def knn_by_pivots(questions: DataFrame, chunks: DataFrame, k: int = RANKED, number: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """As knn, the same rows. Numbers of questions are unique; null vectors are left out; empty tables give no rows."""
    pivots = choose_pivots(chunks, number, vector)
    if not len(pivots):
        return knn(questions, chunks, k, None, number, vector)
    held, radius = in_cells(chunks.select(number, vector), pivots, vector)
    asked = cells_to_meet(limits(questions.select(number, vector), held, pivots, k, number, vector), pivots, radius, vector)
    return knn(asked, held, k, "cell", number, vector)


def pairs_met(questions: DataFrame, chunks: DataFrame, k: int = RANKED, number: str = "vec_id", vector: str = "embedding") -> float:
    """Vectors that a question meets in the last pass of knn_by_pivots, as a share of all, on average; chunks has some."""
    pivots = choose_pivots(chunks, number, vector)
    held, radius = in_cells(chunks.select(number, vector), pivots, vector)
    asked = cells_to_meet(limits(questions.select(number, vector), held, pivots, k, number, vector), pivots, radius, vector)
    both = asked.groupBy("cell").count().withColumnRenamed("count", "asked").join(held.groupBy("cell").count(), "cell")
    met = both.agg(F.sum(F.col("asked") * F.col("count"))).first()[0] or 0
    return met / max(1, questions.where(F.col(vector).isNotNull()).count() * held.count())
