"""Whitening of embeddings by the covariance of weighted distinct vectors.

Every entry c becomes the whole number x = floor(64 c) + 1000000. Rows with the same x vector are one distinct vector whose weight
is the number of its rows (or 1 for each with ``repeats=False``, when only distinct vectors count). Sums are exact; the covariance
is a weighted product of matrices of centred rows, one partial matrix per task, added up by row number. The driver sees d sums and
d x d numbers, d being the length of the vectors, and finds the eigenvectors. Each distinct vector is whitened once and joined
back to its rows by the SHA-256 of its x; vectors that hold more than one part in ``HEAVY`` of all rows, fewer than ``HEAVY`` by
that bound, are broadcast, the others shuffled.

Defined results: rows whose vector is null, empty, or holds a null, non-finite or huge entry (2**40 or more) drop out, and so do vectors of
another length than the commonest one (ties: the longest). A component without variance (not above 1e-12 of the largest) has a null
``whitened`` and no part in ``identity_error``; where no vector varies, ``explained`` and ``identity_error`` are null. A deviation
beyond 64 bits is null. Components have the sign that makes their largest entry positive, the first one in a tie. Repeated ids and rows each get their
rows; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.core.session import scratch_path

SCALE, SHIFT = 64, 1_000_000  # the contract's whole-number form of an entry
HUGE = float(1 << 40)
HEAVY = 64
FLAT = 1e-12
_MOST = (1 << 63) - 1


class Whitening(NamedTuple):
    """n rows, their exact sums per dimension, components (k x d) with their eigenvalues, and each one's share of the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray


def whole_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows with ``x``, the whole-number form of the vector; rows without a usable vector drop out."""
    v = F.col(vector).cast("array<double>")
    fit = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & (F.abs(F.coalesce(c, F.lit(HUGE))) < HUGE) & ~F.isnan(c))
    # the bound stands in the expression, too: a filter may be pushed behind it
    x = F.transform(v, lambda c: F.when(F.abs(c) < HUGE, F.floor(c * F.lit(float(SCALE))) + F.lit(SHIFT).cast("long")))
    return rows.where(fit).withColumn("x", x)


def _matrix(column: pa.Array) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _row_sums(parts: DataFrame) -> list:
    """(i, v) partial rows of all tasks, added up by i and brought to the driver: one row of numbers for each i."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch["i"].to_pylist(), _matrix(batch["v"]) if batch.num_rows else ()):
                sums[i] = sums[i] + v if i in sums else v.copy()
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([list(v) for v in sums.values()], pa.list_(pa.float64()))], ["i", "v"])

    return parts.repartition("i").mapInArrow(add, "i int, v array<double>").orderBy("i").collect()


def _exact_sums(distinct: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and exact sum of every dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, w = _matrix(batch["x"]), batch["weight"].to_numpy()
            n += int(w.sum())
            low, high = (w @ (x & 0xFFFFF)).tolist(), (w @ (x >> 20)).tolist()  # two limbs, so that no sum passes 64 bits
            part = [h * (1 << 20) + lo for h, lo in zip(high, low)]
            sums = part if sums is None else [a + b for a, b in zip(sums, part)]
        if sums is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(sums)), pa.int32()), pa.array([n] * len(sums), pa.int64()), pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))], ["i", "n", "s"])

    parts = distinct.select("x", "weight").mapInArrow(partial, "i int, n bigint, s decimal(38,0)")
    rows = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()
    return (rows[0]["n"] if rows else 0), [int(r["s"]) for r in rows]


def _centre(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n: the whole part is taken off as a whole number, so nothing is lost to the common shift."""
    whole, rest = np.array([s // n for s in sums], np.int64), np.array([(s % n) / n for s in sums])
    return (x - whole).astype(np.float64) - rest


def _scatter(distinct: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                y = _centre(_matrix(batch["x"]), n, sums)
                part = (y * batch["weight"].to_numpy()[:, None]).T @ y
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "v"])

    return np.array([r["v"] for r in _row_sums(distinct.select("x", "weight").mapInArrow(partial, "i int, v array<double>"))])


def fit(distinct: DataFrame, components: int = 32) -> Whitening | None:
    """The whitening of weighted distinct vectors (x, weight); None where there are none."""
    n, sums = _exact_sums(distinct)
    if not n:
        return None
    v = _scatter(distinct, n, sums) / n
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    top = np.argsort(-values, kind="stable")[: min(components, len(sums))]
    basis = vectors[:, top].T.copy()
    basis *= np.sign(basis[np.arange(len(basis)), np.abs(basis).argmax(axis=1)])[:, None]
    trace = float(np.trace(v))
    e = np.maximum(values[top], 0.0)
    return Whitening(n, sums, basis, e, e / trace if trace > 0 else np.full(len(e), np.nan))


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over the dimensions of (n x - S)**2, exactly: in 64 bits where the bound allows it, else in Python's whole numbers."""
    whole, rest = np.array([s // n for s in sums], np.int64), [s % n for s in sums]
    off = x - whole
    bound = (int(np.abs(off).max(initial=0)) + 1) * n
    if bound * bound * len(sums) < _MOST:
        d = off * np.int64(n) - np.array(rest, np.int64)
        return (d * d).sum(axis=1).tolist()
    exact = [sum((n * o - r) ** 2 for o, r in zip(row, rest)) for row in off.tolist()]
    return [s if s <= _MOST else None for s in exact]


def whiten_distinct(distinct: DataFrame, model: Whitening) -> DataFrame:
    """(digest, weight, deviation, whitened) of every distinct vector."""
    live = model.eigenvalues > FLAT * max(model.eigenvalues[0], 0.0) if len(model.eigenvalues) else np.empty(0, bool)
    scale = np.where(live, 1.0 / np.sqrt(np.where(live, model.eigenvalues, 1.0)), np.nan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch["x"])
                z = (_centre(x, model.n, model.sums) @ model.components.T) * scale
                flat = pa.array(z.ravel(), from_pandas=True)  # NaN, of a flat component, becomes null
                offsets = pa.array(np.arange(0, z.size + 1, z.shape[1], dtype=np.int32))
                deviation = pa.array(_deviation(x, model.n, model.sums), pa.int64())
                yield pa.RecordBatch.from_arrays([batch["digest"], batch["weight"], deviation, pa.ListArray.from_arrays(offsets, flat)], ["digest", "weight", "deviation", "whitened"])

    return distinct.select("digest", "x", "weight").mapInArrow(run, "digest string, weight bigint, deviation bigint, whitened array<double>")


def identity_error(white: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the covariance of the whitened vectors minus the identity, over the components with variance."""
    live = np.flatnonzero(model.eigenvalues > FLAT * max(model.eigenvalues[0], 0.0))
    if not len(live):
        return None

    def columns(batch: pa.RecordBatch) -> np.ndarray:
        return _matrix(batch["whitened"])[:, live].astype(np.float64)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(live))
        for batch in batches:
            if batch.num_rows:
                sums = sums + batch["weight"].to_numpy().astype(float) @ columns(batch)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([sums], pa.list_(pa.float64()))], ["i", "v"])

    rows = white.select("whitened", "weight")
    mean = np.array(_row_sums(rows.mapInArrow(total, "i int, v array<double>"))[0]["v"]) / model.n

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((len(live), len(live)))
        for batch in batches:
            if batch.num_rows:
                y = columns(batch) - mean
                g = g + (y * batch["weight"].to_numpy()[:, None]).T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(len(g)), pa.int32()), pa.array(list(g), pa.list_(pa.float64()))], ["i", "v"])

    cov = np.array([r["v"] for r in _row_sums(rows.mapInArrow(scatter, "i int, v array<double>"))]) / model.n
    return float(np.abs(cov - np.eye(len(live))).max())


def whiten(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = 32, repeats: bool = True) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for every row with a usable vector and each component."""
    spark = rows.sparkSession
    schema = f"id {rows.schema[id_col].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    usable = whole_vectors(rows.select(F.col(id_col).alias("id"), F.col(vector).alias("v")), "v").select("id", "x")
    lengths = usable.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    usable = usable.where(F.size("x") == lengths[0]["d"])
    grouped = usable.groupBy("x").agg(F.count(F.lit(1)).alias("copies"))
    digest = F.sha2(F.col("x").cast("string").cast("binary"), 256)
    folder = scratch_path(spark, "whitening")
    grouped.select("x", digest.alias("digest"), "copies", (F.col("copies") if repeats else F.lit(1).cast("long")).alias("weight")).write.parquet(f"{folder}/distinct")
    distinct = spark.read.parquet(f"{folder}/distinct")
    model = fit(distinct, components)
    copies = distinct.select("digest", "copies")
    whiten_distinct(distinct, model).write.parquet(f"{folder}/white")
    white = spark.read.parquet(f"{folder}/white")
    error = identity_error(white, model)

    per = white.select("digest", "deviation", "whitened")
    heavy = copies.where(F.col("copies") * HEAVY > lengths[0]["count"]).select("digest")  # fewer than HEAVY rows
    own = usable.select("id", digest.alias("digest"))
    common = own.join(F.broadcast(per.join(F.broadcast(heavy), "digest")), "digest")
    others = own.join(F.broadcast(heavy), "digest", "left_anti").join(per.join(F.broadcast(heavy), "digest", "left_anti"), "digest")
    joined = common.unionByName(others)
    long = joined.select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    shares = F.array(*[F.lit(None if np.isnan(e) else float(e)).cast("double") for e in model.explained])
    return long.select(
        F.col("id").alias(id_col), (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
