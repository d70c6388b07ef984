"""Ranking chunks for many questions at once: exact and approximate neighbours, lexical re-ranking, contexts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.text import or_empty

# Hits ranked and hits used per question; fields and weights of lexical re-ranking, and the step per hit.
RANKED, USED, STEP = 12, 6, 0.20
WEIGHTS = {
    "embedding_prefix_summary": 8.0,
    "section_search_keywords": 9.0,
    "section_start_by_code": 1.0,
    "section_titles": 9.5,
    "section_summaries": 8.5,
    "primary_section_id2": 1.0,
    "section_id2_by_code": 1.0,
    "sections_raw": 6.0,
    "embedding_prefix_headers": 2.0,
    "embedding_prefix_search_hints": 2.0,
}
#: Vectors of a block of chunks and of a block of questions.
CHUNKS, QUESTIONS = 4096, 512
#: Distances that a task holds at once.
AT_ONCE = 500_000
#: Vectors that the cells of an index are fitted on, questions that its probes are fitted on, cells, and the recall aimed at.
SAMPLE, PROBED, CELLS, AIM = 20_000, 200, 64, 0.94


def blocks(vectors: DataFrame, number: str, vector: str, by: list[str], size: int, salts: int) -> DataFrame:
    """by, salt, ids, matrix: vectors packed into rows of at most `size`, dealt to salts by a hash of the number."""
    rows = vectors.where(F.col(vector).isNotNull()).select(*by, F.col(number).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(number), F.lit(salts)).cast("int").alias("salt"))
    spread = rows.repartition(*by, "salt").sortWithinPartitions(*by, "salt", "id")

    def pack(batches):
        now, ids, held = None, [], []
        for batch in batches:
            out = []
            keys = list(zip(*(batch.column(c).to_pylist() for c in [*by, "salt"])))
            values = batch.column("v")
            flat, ends = values.flatten().to_numpy(zero_copy_only=False), values.offsets.to_numpy()
            for k, (key, number) in enumerate(zip(keys, batch.column("id").to_pylist())):
                if held and (key != now or len(ids) == size):
                    out.append((*now, ids, np.concatenate(held).tobytes()))
                    ids, held = [], []
                now = key
                ids.append(number)
                held.append(flat[ends[k] - ends[0] : ends[k + 1] - ends[0]])
            yield made(out)
        yield made([(*now, ids, np.concatenate(held).tobytes())] if held else [])

    def made(rows):
        columns = list(zip(*rows)) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    kinds = [vectors.schema[c].dataType for c in by]
    arrow = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    names = [*by, "salt", "ids", "matrix"]
    types = [*(arrow[k.simpleString()] for k in kinds), pa.int32(), pa.list_(pa.int64()), pa.binary()]
    schema = ", ".join([*(f"`{c}` {k.simpleString()}" for c, k in zip(by, kinds)), "salt int", "ids array<long>", "matrix binary"])
    return spread.mapInArrow(pack, schema)


def block_rows(batches, *columns: str):
    """The rows of batches one by one, without copies: matrices as flat arrays over the batch's own bytes, ids as arrays."""
    for batch in batches:
        for k in range(batch.num_rows):
            cells = (batch.column(c)[k] for c in columns)
            yield tuple(v.as_buffer() if pa.types.is_binary(v.type) else v.values.to_numpy() if pa.types.is_list(v.type) else v.as_py() for v in cells)


def salts_for(vectors: DataFrame, by: list[str], size: int) -> int:
    """Salts that spread the vectors of the largest group over blocks of about `size`."""
    rows = vectors.groupBy(*by).count().agg(F.max("count")).first()[0] if by else vectors.count()
    return max(1, -(-(rows or 0) // size))


def knn(questions: DataFrame, chunks: DataFrame, k: int = RANKED, by: str | None = None, number: str = "vec_id", vector: str = "embedding", same: bool = True, size: int = CHUNKS, asked: int = QUESTIONS) -> DataFrame:
    """query_id, chunk_id, score, rank: the k chunks of least Euclidean distance per question, ties by number.

    by: a column on which question and chunk have to agree; it is joined on, so nothing else is ever ranked. Vectors
    travel and are compared in blocks of `size` and `asked`, dealt to as many salts as they fill, so tasks grow in
    number and not in size; only the k best of each pair of blocks are kept before the shuffle by question.
    same=False leaves out the chunk with the question's own number.
    """
    on = [by] if by else []
    salts = salts_for(chunks, on, size)
    left = blocks(questions, number, vector, on, asked, salts_for(questions, on, asked)).drop("salt").withColumnRenamed("ids", "q_ids").withColumnRenamed("matrix", "q_matrix")
    left = left.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    pairs = left.join(blocks(chunks, number, vector, on, size, salts), [*on, "salt"])

    def rank(batches):
        for q_ids, q_raw, ids, raw in block_rows(batches, "q_ids", "q_matrix", "ids", "matrix"):
            a, b = np.frombuffer(q_raw).reshape(len(q_ids), -1), np.frombuffer(raw).reshape(len(ids), -1)
            out = ([], [], [])
            # so many questions at a time that their distances take a few MB
            for low in range(0, len(a), step := max(1, AT_ONCE // len(ids))):
                far = np.sqrt(distances(a[low : low + step], b)).round(6)
                if not same:
                    far[q_ids[low : low + step][:, None] == ids[None]] = np.inf
                # whatever is as near as the k-th takes part in the order, so that ties go by number
                last = np.partition(far, k - 1, 1)[:, k - 1] if k < len(ids) else np.full(len(far), np.inf)
                for q, row, most in zip(q_ids[low : low + step], far, last):
                    near = np.flatnonzero(row <= most)
                    best = near[np.lexsort((ids[near], row[near]))[:k]]
                    best = best[np.isfinite(row[best])]
                    out[0].append(np.full(len(best), q))
                    out[1].append(ids[best])
                    out[2].append(row[best])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["query_id", "chunk_id", "score"])

    near = pairs.select("q_ids", "q_matrix", "ids", "matrix").mapInArrow(rank, "query_id long, chunk_id long, score double")
    w = Window.partitionBy("query_id").orderBy("score", "chunk_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def fit_cells(chunks: DataFrame, k: int = RANKED, number: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, cells: int = CELLS, aim: float = AIM) -> tuple[np.ndarray, int]:
    """Centres of an index's cells, and the cells to probe for a question.

    Fitted on `sample` vectors at most, those of the smallest hashes of their numbers, whatever the table's size: by
    k-means, and by the number of nearest cells that hold a share `aim` of the true neighbours of PROBED of them.
    """
    rows = chunks.where(F.col(vector).isNotNull()).select(F.col(number).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    told = rows.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    if not told:
        return np.zeros((1, 1)), 1
    points = np.array([r["v"] for r in told])
    centres = points[: min(cells, len(points))].copy()
    for _ in range(15):
        own = distances(points, centres).argmin(1)
        for cell in np.unique(own):
            centres[cell] = points[own == cell].mean(0)
    own = distances(points, centres).argmin(1)
    asked = points[-min(PROBED, len(points)) :]
    nearest = np.argsort(distances(asked, points), 1)[:, :k]
    rank_of = np.argsort(np.argsort(distances(asked, centres), 1), 1)
    needed = np.sort(np.take_along_axis(rank_of, own[nearest], 1).ravel())
    return centres, int(needed[min(len(needed) - 1, int(np.ceil(aim * len(needed))) - 1)]) + 1


def with_cells(vectors: DataFrame, centres: np.ndarray, probes: int, vector: str = "embedding") -> DataFrame:
    """vectors with `cell`, a row for each of the `probes` nearest cells."""

    @F.pandas_udf("array<int>")
    def nearest(values):
        import pandas as pd

        if not len(values):
            return pd.Series([], dtype=object)
        points, step = np.stack(values.to_list()).astype(float), max(1, AT_ONCE // len(centres))
        return pd.Series([cells for low in range(0, len(points), step) for cells in np.argsort(distances(points[low : low + step], centres), 1)[:, :probes].astype(np.int32)])

    return vectors.where(F.col(vector).isNotNull()).withColumn("cell", F.explode(nearest(vector)))


def ann(questions: DataFrame, chunks: DataFrame, k: int = RANKED, number: str = "vec_id", vector: str = "embedding", index: tuple[np.ndarray, int] | None = None) -> DataFrame:
    """As knn, from an index of cells: every chunk is in that of the nearest centre, a question meets the chunks of a few.

    Candidates are scored exactly. index: centres and probes, by default those of fit_cells. How much of the table a
    question meets depends on the vectors: little where they form clusters, half where they are spread evenly.
    """
    centres, probes = index or fit_cells(chunks, k, number, vector)
    asked, held = (with_cells(df.select(number, vector), centres, n, vector) for df, n in ((questions, probes), (chunks, 1)))
    return knn(asked, held, k, "cell", number, vector)


def met_share(questions: DataFrame, chunks: DataFrame, index: tuple[np.ndarray, int], vector: str = "embedding") -> float:
    """Candidates that questions meet on average, as a share of the chunks."""
    asked, held = (with_cells(df.select(vector), index[0], n, vector).groupBy("cell").count() for df, n in ((questions, index[1]), (chunks, 1)))
    both = asked.withColumnRenamed("count", "asked").join(held, "cell", "full").agg(F.sum(F.col("asked") * F.col("count")), F.sum("asked"), F.sum("count")).first()
    return round((both[0] or 0) * index[1] / max(1, (both[1] or 0) * (both[2] or 0)), 6)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """The share of the exact neighbours that were found."""
    both = exact.join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return both.agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))


def rerank_lexical(hits: DataFrame, questions: DataFrame, fields: list[str], query: str = "query_id", question: str = "question") -> DataFrame:
    """hits with score lowered by STEP for what their fields share with the question.

    A field with any form of any token counts its weight, and 0.6 of it for each of up to three phrases.
    """
    tokens = X.query_tokens(F.col(question))
    terms = questions.select(query, F.array_distinct(F.flatten(F.transform(tokens, X.plural_variants))).alias("_forms"), X.ngram_phrases(tokens).alias("_phrases"))
    # lowered once for a field, not for every form and phrase
    joined = hits.select("*", *[F.lower(or_empty(F.col(f))).alias(f"_low_{f}") for f in fields]).join(terms, query)
    total = F.lit(0.0)
    for field in fields:
        blob = F.col(f"_low_{field}")
        some = F.exists("_forms", blob.contains).cast("int")
        phrases = F.size(F.filter("_phrases", blob.contains))
        total = total + F.lit(WEIGHTS[field]) * (some + 0.6 * F.least(phrases, F.lit(3)))
    return joined.withColumn("score", F.round(F.col("score") - STEP * total, 6)).drop("_forms", "_phrases", *[f"_low_{f}" for f in fields])


def route(importance: Column, page: Column) -> Column:
    """Attach the page where it matters and is known, else its text."""
    return F.when((importance >= 4) & page.isNotNull(), F.lit("page")).otherwise(F.lit("text"))


def top_hits(hits: DataFrame, k: int, query: str = "query_id") -> DataFrame:
    w = Window.partitionBy(query).orderBy("score", "chunk_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def build_context(hits: DataFrame, query: str = "query_id", top: int = USED) -> DataFrame:
    """Per question the context block of its first hits (file, page, code, text); see instruction for what follows it."""
    lead = F.concat(F.lit("[Context from "), F.col("source"), F.lit(" p"), F.coalesce(F.col("page").cast("string"), F.lit("?")), F.concat(F.lit(" "), or_empty(F.col("code"))), F.lit("]\nCitation: ["), or_empty(F.col("code")), F.lit("]\n"))
    one = F.concat(lead, X.strip_retrieval_lines(F.col("text")))
    parts = F.array_sort(F.collect_list(F.struct("rank", one.alias("block"))))
    return top_hits(hits, top, query).groupBy(query).agg(F.array_join(F.transform(parts, lambda p: p["block"]), "\n\n").alias("context"))


def instruction(context: Column, question: Column) -> Column:
    """The text for a model: the context block and the question, each in its tags."""
    return F.concat(F.lit("<context>\n"), context, F.lit("\n</context>\n\n<question>"), or_empty(question), F.lit("</question>\n"))


def section_search(chunks: DataFrame, section: str, source: str | None = None, limit: int = 20) -> DataFrame:
    """Chunks (source, number, label, page, text) of a section by kind of match, page and length."""
    own = chunks.where(F.col("source") == source) if source else chunks
    ranked = own.withColumn("rank", X.section_match_rank(F.lit(section), F.col("number"), F.col("label"))).where("rank is not null")
    return ranked.orderBy("rank", F.coalesce("page", F.lit(999999)), F.length("text"), "id").limit(max(1, min(50, limit)))


def result_order(chunks: DataFrame) -> list[Column]:
    """Sort columns: source in any case, page, section number by its parts."""
    from .sections import code_path

    return [F.lower("source"), F.coalesce("page", F.lit(999999)), code_path(F.col("number"))]
