"""Approximate nearest neighbours by a permutation index.

Pivots are vectors of the data. A vector is represented by the order of the pivots from its nearest on: the rank of each pivot.
It is posted in the inverted files of its ``POST`` nearest pivots; a query visits the files of its ``VISIT`` nearest pivots,
ranks what it meets by the footrule distance over its ``NEAR`` nearest pivots, and scores the best share of each block exactly
(largest inner product, double precision). For vectors of unlike length, pivots are compared in the space with one more
coordinate that makes all lengths equal, so that angles there order inner products.

Files are cut into blocks of at most ``BLOCK`` vectors and ``BLOCK`` queries by a digest of the id, so a file that holds a third
of all vectors is worked on by many tasks, each within fixed memory. Only the pivots (a fixed number) are sent to the tasks.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, nor do those of another
dimension than the most frequent one, nor null ids; of rows with the same id the first (by components) counts; ties go to the
smaller id; a query never finds its own id; with fewer candidates than k all that are found come back; an empty table gives
an empty result. Nearness is the inner product of the vectors as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.tables import stored

PIVOTS, VECTORS_PER_PIVOT = 256, 8
POST, VISIT, NEAR = 8, 36, 96
SHARE, LEAST = 0.3, 200
BLOCK = 4096


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): the vectors that take part, as arrays of doubles."""
    v = F.col(vector_col).cast("array<double>")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.coalesce(fine, F.lit(False)))
    rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("v") == (common["d"] if common else 0))


def _posts(pivots: np.ndarray, bound: float, every: int):
    """Rank every vector's pivots; one row per file it is posted in and, for a query, per file it visits."""
    count = len(pivots)
    post, visit = min(POST, count), min(VISIT, count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                ids = part["id"].to_numpy(zero_copy_only=False)
                x = part["v"].flatten().to_numpy().reshape(len(ids), -1)
                rest = np.sqrt(np.maximum(0.0, bound * bound - (x * x).sum(1)))
                for query in (False, True):
                    keep = np.flatnonzero(ids % every == 0) if query else np.arange(len(ids))
                    if not len(keep):
                        continue
                    own = np.column_stack([x[keep], np.zeros(len(keep)) if query else rest[keep]])
                    order = np.argsort(-(own @ pivots.T), axis=1, kind="stable")
                    rank = np.empty_like(order, dtype=np.uint16)
                    np.put_along_axis(rank, order, np.arange(count, dtype=np.uint16)[None].repeat(len(keep), 0), 1)
                    files = order[:, : visit if query else post]
                    n = files.shape[1]
                    at = pa.array(np.repeat(keep, n))
                    ranks = pa.array([r.tobytes() for r in rank], pa.binary()).take(pa.array(np.repeat(np.arange(len(keep)), n)))
                    vec = pa.array([r.tobytes() for r in x[keep]], pa.binary()).take(pa.array(np.repeat(np.arange(len(keep)), n)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(files.ravel().astype(np.int32)), pa.array([query] * (n * len(keep))), part["id"].take(at), ranks, vec],
                        ["file", "query", "id", "ranks", "vec"],
                    )

    return run


def _matrix(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, kind).reshape(len(column), -1)


def _match(k: int):
    def run(posts: pa.Table, queries: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if posts.num_rows and queries.num_rows:
            posts = posts.sort_by("id")
            ids = posts["id"].to_numpy()
            ranks = np.ascontiguousarray(_matrix(posts["ranks"], np.uint16).T).astype(np.int16)
            vectors = _matrix(posts["vec"], np.float64)
            near = min(NEAR, len(ranks))
            take = min(len(ids), max(LEAST, 4 * k, int(np.ceil(SHARE * len(ids)))))
            own_ranks, own_vectors = _matrix(queries["q_ranks"], np.uint16).astype(np.int16), _matrix(queries["q_vec"], np.float64)
            for j, q in enumerate(queries["q_id"].to_pylist()):
                cols = np.argsort(own_ranks[j], kind="stable")[:near]
                rule = np.abs(ranks[cols] - own_ranks[j][cols, None]).sum(0, dtype=np.int32)
                best = np.sort(np.argsort(rule, kind="stable")[:take])  # back in id order: ties keep the smaller ids
                best = best[ids[best] != q]
                score = (vectors[best] * own_vectors[j]).sum(1)
                top = np.argsort(-score, kind="stable")[:k]
                out_q.append(np.full(len(top), q)), out_v.append(ids[best[top]]), out_s.append(score[top])
        cat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
        return pa.table({"query_id": cat(out_q, pa.int64()), "vec_id": cat(out_v, pa.int64()), "score": cat(out_s, pa.float64())})

    return run


def nearest(vectors: DataFrame, every: int, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id divisible by ``every`` its k best found, by score then id."""
    spark = vectors.sparkSession
    rows = stored(usable(vectors, id_col, vector_col))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("most")).first()
    empty = "query_id long, rank int, vec_id long, score double"
    if not size["n"]:
        return spark.createDataFrame([], empty)
    wanted = pivots or min(PIVOTS, max(16, size["n"] // VECTORS_PER_PIVOT))
    # a bounded sample in digest order; equal vectors would be one pivot
    sample = rows.orderBy(F.sha2(F.col("id").cast("string").cast("binary"), 256)).limit(4 * wanted).groupBy("v").agg(F.min("id").alias("id"))
    chosen = [r["v"] for r in sample.orderBy(F.sha2(F.col("id").cast("string").cast("binary"), 256)).limit(wanted).collect()]
    raw = np.array(chosen, float)
    rest = np.sqrt(np.maximum(0.0, size["most"] ** 2 - (raw * raw).sum(1)))
    points = np.column_stack([raw, rest])
    posts = stored(rows.mapInArrow(_posts(points, size["most"], every), "file int, query boolean, id bigint, ranks binary, vec binary"))
    parts = posts.groupBy("file", "query").count().groupBy("file").agg(
        F.max(F.when(~F.col("query"), F.ceil(F.col("count") / BLOCK))).cast("int").alias("np"), F.max(F.when(F.col("query"), F.ceil(F.col("count") / BLOCK))).cast("int").alias("nq")
    ).where("np IS NOT NULL AND nq IS NOT NULL")
    dealt = posts.join(F.broadcast(parts), "file")  # at most one row per pivot
    chunk = F.pmod(F.xxhash64("id"), F.when(F.col("query"), F.col("nq")).otherwise(F.col("np"))).cast("int")
    dealt = dealt.withColumn("own", chunk)
    side = lambda q, other: dealt.where(F.col("query") == q).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
    left = side(False, "nq").select("file", F.col("own").alias("pc"), F.col("other").alias("qc"), "id", "ranks", "vec")
    right = side(True, "np").select(
        F.col("file").alias("q_file"), F.col("other").alias("q_pc"), F.col("own").alias("q_qc"), F.col("id").alias("q_id"), F.col("ranks").alias("q_ranks"), F.col("vec").alias("q_vec")
    )
    found = left.groupBy("file", "pc", "qc").cogroup(right.groupBy("q_file", "q_pc", "q_qc")).applyInArrow(_match(k), "query_id bigint, vec_id bigint, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
