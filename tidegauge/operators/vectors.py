"""Feature-vector operators: moments, PCA, window scores, calibration and fusion.

Vectors stay arrays through the joins. Work that grows with the data (moments, window means) is combined map-side; only
d x d matrices and fixed-size reference samples reach the driver or a broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.core.expr import ratio
from tidegauge.core.scan import exact_quantiles, prefix_scan
from tidegauge.core.session import cut_lineage

KERNEL_ROWS = 512  # size of the reference sample of the kernel scorers
MAX_DIM = 4096  # bound on d for the driver's d x d step


@dataclass(frozen=True)
class Pca:
    """Centre, components (k x d, largest variance first) and the variances of the projected reference."""

    mean: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    rows: int


def gram(df: DataFrame, col: str, d: int) -> DataFrame:
    """Row i of sum(x xT), sum of x_i and the count: one partial matrix per task, added up by row number."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, g = 0, np.zeros(d), np.zeros((d, d))
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["x"].to_numpy()).astype(np.float64)
                n, s, g = n + len(x), s + x.sum(axis=0), g + x.T @ x
        if n:
            yield pd.DataFrame({"i": np.arange(d), "n": n, "s": s, "g": list(g)})

    rows = df.select(F.col(col).cast("array<double>").alias("x"))
    parts = rows.mapInPandas(partial, "i int, n bigint, s double, g array<double>")
    row = ", ".join(f"sum(g[{j}])" for j in range(d))
    return parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.expr(f"array({row})").alias("g"))


def moments(df: DataFrame, col: str, d: int, eps: float = 0.0) -> DataFrame:
    """Long table (i, j, n, mu_i, cov_ij): sample covariance plus ``eps`` on the diagonal."""
    g = gram(df, col, d)
    other = g.select(F.col("i").alias("j"), F.col("s").alias("_sj"))
    long = g.select("i", "n", "s", F.posexplode("g").alias("j", "_gij"))
    joined = long.join(F.broadcast(other), "j")  # d rows
    cov = (F.col("_gij") - F.col("s") * F.col("_sj") / F.col("n")) / (F.col("n") - 1)
    return joined.select(
        "i", "j", "n", (F.col("s") / F.col("n")).alias("mu"), (cov + F.when(F.col("i") == F.col("j"), eps).otherwise(0.0)).alias("cov")
    )


def fit_moments(df: DataFrame, col: str, d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and covariance on the driver (d x d numbers)."""
    if d > MAX_DIM:
        raise ValueError(f"dimension {d} is above {MAX_DIM}")
    rows = gram(df, col, d).orderBy("i").collect()
    n = rows[0]["n"]
    s = np.array([r["s"] for r in rows])
    g = np.array([r["g"] for r in rows])
    return n, s / n, (g - np.outer(s, s) / n) / max(n - 1, 1)


def fit_pca(df: DataFrame, col: str, d: int, k: int) -> Pca:
    """PCA clipped to min(k, n, d): distributed covariance, d x d eigenvectors on the driver."""
    n, mean, cov = fit_moments(df, col, d)
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    top = np.argsort(values)[::-1][: max(1, min(k, n, d))]
    return Pca(mean, vectors[:, top].T.copy(), np.maximum(values[top], 0.0), n)


def keyed_models(rows: DataFrame, key: str, col: str, d: int, k: int) -> DataFrame:
    """(key, n, mean, basis, variances): a PCA of at most ``k`` components for every key in one aggregate.

    Gram sums are added up by key in every task (keys are tasks or labels, so these are a few matrices), then by key and row; the
    eigen step runs once per key on its d rows.
    """
    kind = rows.schema[key].dataType.simpleString()

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for pdf in batches:
            for value, part in pdf.groupby("key"):
                x = np.stack(part["x"].to_numpy()).astype(np.float64)
                n, s, g = sums.get(value, (0, np.zeros(d), np.zeros((d, d))))
                sums[value] = (n + len(x), s + x.sum(axis=0), g + x.T @ x)
        for value, (n, s, g) in sums.items():
            yield pd.DataFrame({"key": [value] * d, "i": np.arange(d), "n": n, "s": s, "g": list(g)})

    def model(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        n, s, g = int(pdf["n"].iloc[0]), pdf["s"].to_numpy(), np.stack(pdf["g"].to_numpy())
        cov = (g - np.outer(s, s) / n) / max(n - 1, 1)
        values, vectors = np.linalg.eigh((cov + cov.T) / 2)
        top = np.argsort(values)[::-1][: max(1, min(k, n, d))]
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "n": [n], "mean": [s / n], "basis": [vectors[:, top].T.ravel()], "variances": [np.maximum(values[top], 0.0)]})

    plain = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(col).cast("array<double>").alias("x"))
    parts = plain.mapInPandas(partial, f"key {kind}, i int, n bigint, s double, g array<double>")
    row = ", ".join(f"sum(g[{j}])" for j in range(d))
    summed = parts.groupBy("key", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.expr(f"array({row})").alias("g"))
    made = summed.groupBy("key").applyInPandas(model, f"key {kind}, n bigint, mean array<double>, basis array<double>, variances array<double>")
    return made.withColumnRenamed("key", key)


def score_modes(windows: Column, mean: Column, basis: Column, variances: Column, eps: float) -> Column:
    """Struct (mean_sample, p90_sample, window_mean) of windows of vectors, each under the model in its own row."""

    @F.pandas_udf(T.StructType([T.StructField(m, T.DoubleType()) for m in ("mean_sample", "p90_sample", "window_mean")]))
    def run(ws: pd.Series, centres: pd.Series, bases: pd.Series, spreads: pd.Series) -> pd.DataFrame:
        out = []
        for w, centre, b, v in zip(ws, centres, bases, spreads):
            z = (np.stack(list(w)).astype(np.float64) - centre) @ np.asarray(b).reshape(len(v), -1).T
            far = np.sqrt((z * z / (np.asarray(v) + eps)).sum(axis=1))
            middle = z.mean(axis=0)
            out.append((far.mean(), np.quantile(far, 0.9), np.sqrt((middle * middle / (np.asarray(v) + eps)).sum())))
        return pd.DataFrame(out, columns=["mean_sample", "p90_sample", "window_mean"])

    return run(windows, mean, basis, variances)


def project(col: Column, model: Pca) -> Column:
    """Centred projection of an array column, one Arrow batch at a time."""
    mean, basis = model.mean, model.components.T.copy()

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        if not len(x):
            return x
        return pd.Series(list((np.stack(x.to_numpy()).astype(np.float64) - mean) @ basis))

    return run(col)


def whitened_norm(means: Sequence[str], model: Pca, eps: float) -> Column:
    """Mahalanobis length of a projected vector given by column names; the projected reference has mean 0 and a diagonal
    covariance, so each squared coordinate is divided by its own variance."""
    terms = " + ".join(f"{m} * {m} / {float(var) + eps!r}D" for m, var in zip(means, model.variances))
    return F.expr(f"sqrt(greatest({terms}, 0.0D))")


def array_norm(z: Column, model: Pca, eps: float) -> Column:
    inv = F.expr("array(" + ", ".join(f"{1.0 / (float(v) + eps)!r}D" for v in model.variances) + ")")
    terms = F.zip_with(z, inv, lambda a, b: a * a * b)
    return F.sqrt(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x))


def window_means(drawn: DataFrame, keys: Sequence[str], streams: dict[str, int]) -> DataFrame:
    """Mean vector per window and stream as plain columns ``<stream>_<i>``: one pass, combined map-side, no explode."""
    aggs = [F.expr(f"avg({s}[{i}]) AS {s}_{i}") for s, k in streams.items() for i in range(k)]
    return drawn.groupBy(*keys).agg(*aggs)


def mahalanobis_scores(means: DataFrame, keys: Sequence[str], models: dict[str, Pca], eps: float) -> DataFrame:
    """Long table keys + (stream, score)."""
    per = [
        F.struct(F.lit(s).alias("stream"),
                 whitened_norm([f"{s}_{i}" for i in range(len(m.variances))], m, eps).alias("score"))
        for s, m in models.items()
    ]
    return means.select(*keys, F.explode(F.array(*per)).alias("p")).select(*keys, "p.stream", "p.score")


def window_distance(drawn: DataFrame, keys: Sequence[str], models: dict[str, Pca], eps: float) -> DataFrame:
    """Long table keys + (stream, score): Mahalanobis length of each window's mean projected vector.

    The rows of a window meet by one shuffle and follow each other; each Arrow batch is added up per window, and a window that
    goes on into the next batch carries its sums. The plan does not widen with the dimension.
    """
    streams = list(models)
    inverse = [1.0 / (models[s].variances + eps) for s in streams]
    schema = ", ".join(f"`{k}` {drawn.schema[k].dataType.simpleString()}" for k in keys) + ", stream string, score double"

    def scored(heads: list[pa.RecordBatch], sums: list[np.ndarray], counts: np.ndarray) -> pa.RecordBatch:
        table = pa.Table.from_batches(heads).combine_chunks()
        long = [np.sqrt(np.maximum(((x / counts[:, None]) ** 2 * w).sum(axis=1), 0.0)) for x, w in zip(sums, inverse)]
        cols = [pa.concat_arrays([table[k].combine_chunks()] * len(streams)) for k in keys]
        names = pa.array(np.repeat(streams, len(counts)), pa.string())
        return pa.RecordBatch.from_arrays([*cols, names, pa.array(np.concatenate(long))], [*keys, "stream", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, kept, count, last = None, None, 0, None  # the open window
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = list(zip(*(batch[k].to_pylist() for k in keys)))
            starts = np.array([0, *(i for i in range(1, len(rows)) if rows[i] != rows[i - 1])])
            sums = [np.add.reduceat(batch[s].flatten().to_numpy().reshape(batch.num_rows, -1), starts, axis=0) for s in streams]
            counts = np.diff(np.append(starts, batch.num_rows)).astype(float)
            heads = batch.select(list(keys)).take(pa.array(starts))
            if head is not None:
                if rows[0] == last:
                    sums = [np.vstack([x[:1] + y, x[1:]]) for x, y in zip(sums, kept)]
                    counts[0] += count
                else:
                    yield scored([head], kept, np.array([count]))
            if len(starts) > 1:
                yield scored([heads.slice(0, len(starts) - 1)], [x[:-1] for x in sums], counts[:-1])
            head, kept, count, last = heads.slice(len(starts) - 1), [x[-1:] for x in sums], counts[-1], rows[-1]
        if head is not None:
            yield scored([head], kept, np.array([count]))

    together = drawn.select(*keys, *streams).repartition(*keys).sortWithinPartitions(*keys)
    return together.mapInArrow(run, schema)


def permuted_scores(drawn: DataFrame, keys: Sequence[str], slot: str, models: dict[str, Pca], eps: float, orders: int) -> DataFrame:
    """Long table keys + (perm, stream, score): each window's vectors added up one by one in ``orders`` orders of their slots.

    The rows of a window follow each other and a task holds one batch of rows and the open window; the orders are digests of
    (perm, window, slot), taken where the window lies.
    """
    streams = list(models)
    inverse = {s: 1.0 / (models[s].variances + eps) for s in streams}
    window, keys = keys[-1], list(keys)
    schema = ", ".join(f"`{k}` {drawn.schema[k].dataType.simpleString()}" for k in keys) + ", perm int, stream string, score double"

    def scored(part: pd.DataFrame) -> list[tuple]:
        head, name, slots = tuple(part[k].iloc[0] for k in keys), part[window].iloc[0], part["_slot"].tolist()
        vectors = {s: np.stack(part[s].to_numpy()).astype(np.float64) for s in streams}
        found = []
        for perm in range(orders):
            by = sorted(range(len(slots)), key=lambda i: (hashlib.md5(f"{perm}:{name}:{slots[i]}".encode()).hexdigest(), slots[i]))
            for s, x in vectors.items():
                z = np.add.accumulate(x[by], axis=0)[-1] / len(by)  # one after the other, in this order
                found.append((*head, perm, s, float(np.sqrt(max((z * z * inverse[s]).sum(), 0.0)))))
        return found

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail = None  # rows of the open window
        for pdf in batches:
            pdf = pdf if tail is None else pd.concat([tail, pdf], ignore_index=True)
            new = (pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy()
            new[:1] = True
            cuts = np.append(np.flatnonzero(new), len(pdf))
            out = [row for lo, hi in zip(cuts[:-2], cuts[1:-1]) for row in scored(pdf.iloc[lo:hi])]
            tail = pdf.iloc[cuts[-2]:] if len(pdf) else None
            if out:
                yield pd.DataFrame(out, columns=[*keys, "perm", "stream", "score"])
        if tail is not None:
            yield pd.DataFrame(scored(tail), columns=[*keys, "perm", "stream", "score"])

    rows = drawn.select(*keys, F.col(slot).alias("_slot"), *streams)
    return rows.repartition(*keys).sortWithinPartitions(*keys, "_slot").mapInPandas(run, schema)


def window_arrays(drawn: DataFrame, keys: Sequence[str], streams: Sequence[str]) -> DataFrame:
    """The window's vectors as one bounded array per stream (window size x d)."""
    return drawn.groupBy(*keys).agg(*[F.collect_list(s).alias(s) for s in streams])


# ------------------------------------------------------------------ scorers over whole windows


def sq_dists(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2.0 * x @ y.T, 0.0)


def rbf_gamma(ref: np.ndarray, rows: int = 256) -> float:
    """Kernel width by the median rule: half the inverse of the median over distinct pairs of the leading ``rows``.

    Each row is compared with those after it, so no square matrix of pairs is held.
    """
    lead = ref[:rows]
    gaps = [((lead[i + 1 :] - lead[i]) ** 2).sum(axis=1) for i in range(len(lead) - 1)]
    apart = np.concatenate(gaps) if gaps else np.empty(0)
    apart = apart[apart > 0]
    return 0.5 / max(float(np.median(apart)), 5e-13) if apart.size else 0.5


def mmd_scorer(ref: np.ndarray):
    gamma = rbf_gamma(ref)
    within = float(np.exp(-gamma * sq_dists(ref, ref)).mean())

    def score(w: np.ndarray) -> float:
        return within + float(np.exp(-gamma * sq_dists(w, w)).mean()) - 2.0 * float(np.exp(-gamma * sq_dists(ref, w)).mean())

    return score


def rank_codes(rows: DataFrame, is_ref: Column, streams: dict[str, int], ids: Sequence[str]) -> tuple[DataFrame, dict[str, np.ndarray]]:
    """Rows outside the reference with each value replaced by its place among the whole reference, and the reference's tie sums.

    A stream of d values becomes an array of 3 d numbers: how many reference values of that dimension are at most the value, how many are
    below it, and the number of the value among all distinct ones. Equal values are combined before the scan, which runs over all
    dimensions side by side and cuts each one into buckets of values. The tie sums (d numbers a stream) are sum(t (t^2 - 1)) / 12
    over groups of t equal reference values.
    """
    width = sum(streams.values())
    long = rows.select(*ids, is_ref.alias("_ref"), F.posexplode(F.concat(*[F.col(s).cast("array<double>") for s in streams])).alias("_dim", "_q"))
    counts = long.groupBy("_dim", "_q").agg(F.sum(F.col("_ref").cast("long")).alias("_m"))
    ran = cut_lineage(prefix_scan(counts, ["_dim"], ["_q"], {"_le": ("sum", F.col("_m")), "_at": ("count", F.lit(1))}, axis=F.col("_q")))
    place = F.struct(F.col("_dim"), F.col("_le").cast("double").alias("le"), (F.col("_le") - F.col("_m")).cast("double").alias("lt"), F.col("_at").cast("double").alias("at"))
    coded = long.where("NOT _ref").join(ran, ["_dim", "_q"]).groupBy(*ids).agg(F.array_sort(F.collect_list(place)).alias("_p"))  # one entry a dimension
    cols, lo = [], 1
    for s, d in streams.items():
        part = F.slice("_p", lo, d)
        cols.append(F.concat(*[F.transform(part, lambda r: r[f]) for f in ("le", "lt", "at")]).alias(s))
        lo += d
    ties = {r["_dim"]: r["k"] for r in ran.groupBy("_dim").agg(F.sum(F.col("_m") * (F.col("_m") * F.col("_m") - 1) / 12.0).alias("k")).collect()}  # one row a dimension
    every, out, lo = np.array([float(ties.get(i) or 0.0) for i in range(width)]), {}, 0
    for s, d in streams.items():
        out[s], lo = every[lo : lo + d], lo + d
    return coded.select(*ids, *cols), out


def _ranked(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of a window's values in order, by dimension (columns), and the first and last position of each group of equal values."""
    d = w.shape[1] // 3
    by = np.argsort(w[:, 2 * d :], axis=0, kind="stable")
    le, lt, at = (np.take_along_axis(w[:, i * d : (i + 1) * d], by, axis=0) for i in range(3))
    n = len(w)
    index = np.arange(n)[:, None]
    new = np.vstack([np.ones((1, d), bool), at[1:] != at[:-1]])
    end = np.vstack([new[1:], np.ones((1, d), bool)])
    first = np.maximum.accumulate(np.where(new, index, 0), axis=0)
    last = np.minimum.accumulate(np.where(end, index, n)[::-1], axis=0)[::-1]
    return le, lt, first, last, new


def ks_scorer(ref_rows: int):
    """Largest distance of the two distribution functions over the dimensions, from rank codes: it is reached at a value of the window or just before one."""

    def score(w: np.ndarray) -> float:
        le, lt, first, last, _ = _ranked(w)
        at, before = np.abs(le / ref_rows - (last + 1) / len(w)), np.abs(lt / ref_rows - first / len(w))
        return float(max(at.max(), before.max()))

    return score


def cvm_scorer(ref_rows: int, ties: np.ndarray):
    """Largest two-sample Cramer-von Mises statistic over the dimensions, by mid-ranks, from rank codes.

    A reference value with c window values below it, equal ones counted half, stands c places behind its own rank. So the reference's sum of
    squares is a sum over the gaps and values of the window, plus the reference's own ties.
    """

    def score(w: np.ndarray) -> float:
        le, lt, first, last, new = _ranked(w)
        nx, ny = ref_rows, len(w)
        size, nth = last - first + 1, np.arange(ny)[:, None] - first + 1
        own = (((lt + le) / 2 + (size + 1) / 2 - nth) ** 2).sum(axis=0)
        gap = np.where(new, lt - np.vstack([np.zeros((1, le.shape[1])), le[:-1]]), 0.0) * first**2
        same = np.where(new, le - lt, 0.0) * (first + size / 2) ** 2
        ref = gap.sum(axis=0) + same.sum(axis=0) + (nx - le[-1]) * ny**2 + ties
        u = nx * ref + ny * own
        return float((u / (nx * ny * (nx + ny)) - (4.0 * nx * ny - 1.0) / (6.0 * (nx + ny))).max())

    return score


def lsdd_scorer(ref: np.ndarray, centres: int = 64, reg: float = 1e-3):
    """Least-squares density difference over Gaussian bumps at the first ``centres`` reference rows.

    The weights a minimise a'Ma / 2 - h'a + reg |a|^2 / 2, with h the difference of the mean bumps and M their mean product
    over both samples. At the minimum Ma = h - reg a, so the difference h'a - a'Ma / 2 is (h'a + reg |a|^2) / 2: with the
    Cholesky factor L of M + reg I and u = L^-1 h this is (|u|^2 + reg |L'^-1 u|^2) / 2, which cannot be negative.
    """
    at, width = ref[:centres], rbf_gamma(ref)

    def bumps(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and mean product of the bumps, row block by row block."""
        mean, product = np.zeros(len(at)), np.zeros((len(at), len(at)))
        for lo in range(0, len(x), 1024):
            k = np.exp(-width * sq_dists(x[lo : lo + 1024], at))
            mean += k.sum(axis=0)
            product += k.T @ k
        return mean / len(x), product / len(x)

    base = bumps(ref)

    def score(w: np.ndarray) -> float:
        own = bumps(w)
        factor = np.linalg.cholesky((base[1] + own[1]) / 2 + reg * np.eye(len(at)))
        u = np.linalg.solve(factor, base[0] - own[0])
        weights = np.linalg.solve(factor.T, u)
        return float(u @ u + reg * (weights @ weights)) / 2

    return score


def frechet_scorer(mean: np.ndarray, cov: np.ndarray, eps: float, clamp: bool = True):
    """Fréchet distance of window moments to reference moments through the PSD root of the reference covariance."""
    cov = cov + eps * np.eye(len(cov))
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    root = (vectors * np.sqrt(np.maximum(values, 0.0))) @ vectors.T

    def score(w: np.ndarray) -> float:
        cw = np.atleast_2d(np.cov(w, rowvar=False)) + eps * np.eye(w.shape[1])
        mid = root @ cw @ root
        cross = np.sqrt(np.maximum(np.linalg.eigvalsh((mid + mid.T) / 2), 0.0)).sum()
        term = float(np.trace(cov) + np.trace(cw) - 2.0 * cross)
        return float(((mean - w.mean(axis=0)) ** 2).sum()) + (max(term, 0.0) if clamp else term)

    return score


def score_windows(col: Column, scorer) -> Column:  # noqa: ANN001
    """Apply a scorer to an array-of-vectors column; each row is one bounded window."""

    @F.pandas_udf("double")
    def run(windows: pd.Series) -> pd.Series:
        return windows.map(lambda w: scorer(np.stack(list(w)).astype(np.float64)))

    return run(col)


def reference_sample(pool: DataFrame, col: str, idx: str = "idx", rows: int = KERNEL_ROWS) -> np.ndarray:
    """The first ``rows`` pool rows in digest order: the scorers' own sample size, so its size is bounded."""
    picked = pool.where(F.col(idx) < rows).select(idx, col).collect()
    return np.array([r[col] for r in sorted(picked, key=lambda r: r[idx])], dtype=np.float64)


# ------------------------------------------------------------------ calibration, fusion, rates


def thresholds(scores: DataFrame, keys: Sequence[str], q: float | Sequence[float], rows: int | None = None) -> DataFrame:
    """Linear quantile(s) of calibration scores; ``rows`` is the number of scores where the plan tells it."""
    if isinstance(q, float):
        return exact_quantiles(scores, keys, "score", [q], ["threshold"], rows).drop("n")
    names = [f"_t{i}" for i in range(len(q))]
    out = exact_quantiles(scores, keys, "score", list(q), names, rows)
    return out.select(*keys, F.array(*[F.col(n) for n in names]).alias("threshold"))


def fuse(scores: DataFrame, limits: DataFrame, keys: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Normalise by max(threshold, 1e-12) and apply every fusion rule; one row per window.

    Alarm of single / max / mean / top2 is value > 1; of two_vote it is count >= min(2, streams).
    """
    norm = scores.join(limits, ["stream", *extra]).withColumn(
        "norm", F.col("score") / F.greatest(F.col("threshold"), F.lit(1e-12))
    )
    ordered = F.sort_array(F.collect_list("norm"), asc=False)  # one entry per stream
    agg = norm.groupBy(*keys, *extra).agg(
        F.count(F.lit(1)).alias("streams"),
        F.min_by("norm", "stream").alias("single"),
        F.max("norm").alias("max_norm"),
        F.avg("norm").alias("mean_norm"),
        ordered.alias("_top"),
        F.sum((F.col("norm") > 1).cast("int")).alias("two_vote"),
    )
    top2 = F.when(F.col("streams") >= 2, (F.get("_top", F.lit(0)) + F.get("_top", F.lit(1))) / 2).otherwise(F.get("_top", F.lit(0)))
    return agg.withColumn("top2_mean_norm", top2).withColumn(
        "vote_alarm", F.col("two_vote") >= F.least(F.lit(2), F.col("streams"))
    ).drop("_top")


def detection_rates(fused: DataFrame, keys: Sequence[str], value: str = "max_norm", alarm: Column | None = None) -> DataFrame:
    """Alarm rate, mean and population deviation of the fused score per ratio."""
    hit = alarm if alarm is not None else F.col(value) > 1
    return fused.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("windows"),
        F.avg(hit.cast("double")).alias("rate"),
        F.avg(value).alias("mean_score"),
        F.stddev_pop(value).alias("std_score"),
    )


def macro_metrics(rates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """FPR at ratio 0, mean of (1-FPR, recalls) and the ratio-weighted recall."""
    clean = F.col("ratio") == 0
    return rates.groupBy(*keys).agg(
        F.max(F.when(clean, F.col("rate"))).alias("fpr"),
        F.avg(F.when(clean, 1 - F.col("rate")).otherwise(F.col("rate"))).alias("macro"),
        ratio(F.sum(F.col("ratio") * F.col("rate")), F.sum("ratio")).alias("weighted"),
    )


def standard_scaler(df: DataFrame, col: str, d: int) -> DataFrame:
    """One row with per-dimension mean and population deviation (tiny deviations become 1)."""
    v = [f"double({col}[{i}])" for i in range(d)]
    means = ", ".join(f"avg({x})" for x in v)
    scales = ", ".join(f"if(stddev_pop({x}) < 1e-12D, 1.0D, stddev_pop({x}))" for x in v)
    return df.agg(F.expr(f"array({means})").alias("mean"), F.expr(f"array({scales})").alias("scale"))


def standardize(df: DataFrame, col: str, scaler: DataFrame, out: str = "z") -> DataFrame:
    centred = F.zip_with(F.col(col).cast("array<double>"), F.col("mean"), lambda a, b: a - b)
    scaled = F.zip_with(centred, F.col("scale"), lambda a, b: a / b)
    return df.join(F.broadcast(scaler)).withColumn(out, scaled).drop("mean", "scale")  # one row


def pick_option(rows: DataFrame, uid: str, options: str, feature: str, heads: DataFrame) -> DataFrame:
    """Arg-max of stored linear-head scores among a row's own options; the first option when none has a head.

    ``heads``: label, w - one row per class. Ties keep the earlier option.
    """
    long = rows.select(uid, feature, F.explode(F.array_sort(F.map_entries(options))).alias("o"))
    scored = long.select(uid, feature, F.col("o.key").alias("letter"), F.col("o.value").alias("label")).join(heads, "label", "left")
    dot = F.aggregate(F.zip_with(F.col(feature).cast("array<double>"), F.col("w"), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    ranked = scored.withColumn("score", dot)
    return ranked.groupBy(uid).agg(
        F.coalesce(
            F.min_by("letter", F.when(F.col("score").isNotNull(), F.struct((-F.col("score")).alias("s"), F.col("letter")))),
            F.min("letter"),
        ).alias("choice"),
        F.max("score").alias("best_score"),
    )
