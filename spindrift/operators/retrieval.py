"""Top-k retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most bytes of query vectors that are shipped at once; more queries go in blocks.
QUERY_BYTES = 16 << 20
#: Queries and rows of the corpus of a tile: eight megabytes of scores.
TILE_QUERIES, TILE_ROWS = 1_024, 1_024


def best_of(batches: Iterator[pa.RecordBatch], names: np.ndarray, matrix: np.ndarray, k: int, id_col: str) -> Iterator[pa.RecordBatch]:
    """(qid, id, score): the k best rows (id, vector) of each query, tile by tile."""
    # the k best so far; a row of the corpus is looked at again only where it may be among them
    best_s, best_i, held = np.full((len(names), k), np.nan), np.zeros((len(names), k), np.int64), np.zeros(len(names), np.int64)
    for batch in batches if len(names) else ():
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy()
        vectors = batch.column(1).flatten().to_numpy().astype(np.float64).reshape(len(ids), -1)
        for of in range(0, len(names), TILE_QUERIES):
            some = slice(of, of + TILE_QUERIES)
            for at in range(0, len(ids), TILE_ROWS):
                s = matrix[some] @ vectors[at : at + TILE_ROWS].T
                least = np.where(held[some] < k, np.nan, best_s[some, -1])
                q, j = np.nonzero(~(s < least[:, None] - 1e-5))  # rounding to six places comes after
                if not len(q):
                    continue
                mine = np.flatnonzero(np.bincount(q, minlength=len(least)))
                back, nth = np.nonzero(np.arange(k) < held[some][mine, None])
                rows = np.concatenate([mine[back], q])
                scores = np.concatenate([best_s[some][mine][back, nth], np.round(s[q, j], 6)])
                who = np.concatenate([best_i[some][mine][back, nth], ids[at + j]])
                order = np.lexsort((who, -scores, rows))
                rows, scores, who = rows[order], scores[order], who[order]
                place = np.arange(len(rows)) - np.searchsorted(rows, rows)
                kept = place < k
                best_s[of + rows[kept], place[kept]], best_i[of + rows[kept], place[kept]] = scores[kept], who[kept]
                held[some] = np.maximum(held[some], np.bincount(rows[kept], minlength=len(least)))
    row, nth = np.nonzero(np.arange(k) < held[:, None])
    yield pa.RecordBatch.from_arrays([pa.array(names[row]), pa.array(best_i[row, nth]), pa.array(best_s[row, nth])], names=["qid", id_col, "score"])


def dense(queries: DataFrame, corpus: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(qid, k, id, score): the k largest dot products of each query, ties by id.

    A block of queries meets each Arrow batch of the corpus in tiles, each a matrix product of bounded
    size; a task keeps k rows per query, so what is shuffled grows with tasks, not rows.
    """
    rows = queries.select(F.col(id_col).alias("q"), F.col(vector).alias("v"))
    width = rows.select(F.max(F.size("v"))).first()[0] or 1
    blocks = max(1, -(-rows.count() * width * 8 // QUERY_BYTES))
    out = None
    for b in range(blocks):
        own = sorted(rows.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).collect(), key=lambda r: r.q)
        names, matrix = np.array([r.q for r in own], dtype=np.int64), np.array([r.v for r in own], dtype=np.float64)

        def run(batches: Iterator[pa.RecordBatch], names=names, matrix=matrix) -> Iterator[pa.RecordBatch]:
            yield from best_of(batches, names, matrix, k, id_col)

        part = corpus.select(id_col, vector).mapInArrow(run, f"qid bigint, {id_col} bigint, score double")
        out = part if out is None else out.union(part)
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), id_col)
    return out.withColumn("k", F.row_number().over(w)).where(F.col("k") <= k).select("qid", "k", id_col, "score")


#: Most rows of query words that are broadcast (some tens of megabytes); more are joined by word.
QUERY_WORDS = 500_000


def bm25(queries: DataFrame, docs: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(item_id, k, doc_id, score) by BM25 over lower-cased words cut at blanks.

    Lengths are taken from the texts; of the corpus's words only those of a query leave the scan, and they meet the
    queries where they are, so that a word in every document is no task of its own. Only if the queries have more than
    ``QUERY_WORDS`` words are both sides dealt by word, and Spark's skew join splits the frequent ones.
    """
    words = lambda c: F.filter(F.split(F.lower(c), " "), lambda w: w != "")
    q = queries.select("item_id", F.explode(F.array_distinct(words("text"))).alias("w")).distinct()
    small = q.limit(QUERY_WORDS + 1).count() <= QUERY_WORDS
    near = F.broadcast if small else (lambda df: df)
    held = docs.select("doc_id", words("text").alias("ws")).withColumn("n", F.size("ws"))
    stats = held.where("n > 0").agg(F.avg("n").alias("mean")).crossJoin(docs.agg(F.count(F.lit(1)).alias("docs")))  # one row
    tf = held.select("doc_id", "n", F.explode("ws").alias("w")).join(near(q.select("w").distinct()), "w", "left_semi").groupBy("doc_id", "n", "w").agg(F.count(F.lit(1)).alias("f"))
    df = tf.groupBy("w").agg(F.count(F.lit(1)).alias("df"))  # at most the queries' words
    hits = tf.join(near(q), "w").join(near(df), "w").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    scored = hits.groupBy("item_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))
    w = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
    return scored.withColumn("k", F.row_number().over(w).cast("long")).where(F.col("k") <= k).select("item_id", "k", "doc_id", "score")
