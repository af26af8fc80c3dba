"""Result tables: seed statistics, method comparisons, diagnostics, audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.core.expr import ratio, std0
from tidegauge.core.scan import prefix_scan


def mean_std(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and sample deviation per key; NULL metrics are skipped, one value gives 0.0."""
    cols = [c for m in metrics for c in (F.avg(m).alias(f"{m}_mean"), std0(F.col(m)).alias(f"{m}_std"))]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *cols)


def weighted_seed_score(rows: DataFrame, keys: Sequence[str], seed: str, value: str, weight: str) -> DataFrame:
    """sum(value*weight)/sum(weight) within a seed, then mean and deviation over seeds."""
    per_seed = rows.groupBy(*keys, seed).agg(ratio(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("score"))
    return mean_std(per_seed, keys, ["score"])


def wide_metric_row(
    rows: DataFrame, keys: Sequence[str], seed: str, level: str, picks: dict[str, float], metric: str, tol: float = 1e-9
) -> DataFrame:
    """One row per key: the metric at chosen levels and over all positive levels, averaged within and then over seeds."""
    at = {name: F.abs(F.col(level) - value) < tol for name, value in picks.items()}
    at["drift"] = F.col(level) > 0
    per_seed = rows.groupBy(*keys, seed).agg(*[F.avg(F.when(c, F.col(metric))).alias(n) for n, c in at.items()])
    return mean_std(per_seed, keys, list(at)).drop("n")


def window_fpr_table(rows: DataFrame, method: str, seed: str) -> DataFrame:
    """Alarm windows, windows and the per-seed percentages in seed order."""
    per_seed = rows.groupBy(method, seed).agg(F.sum("alarm_windows").alias("a"), F.sum("windows").alias("w"))
    pct = F.array_sort(F.collect_list(F.struct(F.col(seed), (100 * F.col("a") / F.col("w")).alias("p"))))  # one entry per seed
    return per_seed.groupBy(method).agg(
        F.sum("a").alias("alarm_windows"), F.sum("w").alias("windows"), (100 * F.sum("a") / F.sum("w")).alias("fpr_pct"),
        F.array_join(F.transform(pct, lambda r: F.format_string("%.4f", r["p"])), ";").alias("per_seed_pct"),
    )


def spread_stats(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("folds"), F.avg(value).alias("mean"), std0(F.col(value)).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    )


def pivot_methods(rows: DataFrame, keys: Sequence[str], method: str, value: str, methods: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).pivot(method, list(methods)).agg(F.first(value))


def relative_metrics(rows: DataFrame, keys: Sequence[str], method: str, value: str, base: str, own: str, best: str) -> DataFrame:
    """Gain over the base method and gap to the best one for every row, plus those of ``own``."""
    ctx = rows.groupBy(*keys).agg(
        *[F.coalesce(F.max(F.when(F.col(method) == m, F.col(value))), F.lit(0.0)).alias(f"_{n}") for n, m in (("b", base), ("o", own), ("t", best))]
    )
    return rows.join(ctx, list(keys)).select(
        *keys, method, value, (F.col("_o") - F.col("_b")).alias("own_gain"), (F.col("_t") - F.col("_o")).alias("own_gap"),
        (F.col(value) - F.col("_b")).alias("gain"), (F.col("_t") - F.col(value)).alias("gap"),
    )


def method_summary(rows: DataFrame, group: str, method: str, value: str, baselines: Sequence[str], base: str, tol: float = 1e-9) -> DataFrame:
    """Per method: mean, deviation, median over groups, gaps to the base and the best baseline, wins / losses / ties.

    Means of methods are a handful of rows; the group-wise comparison joins each row to its group's best baseline.
    """
    is_base = F.col(method).isin(list(baselines))
    best = rows.where(is_base).groupBy(group).agg(F.max(value).alias("_best"))
    diff = F.col(value) - F.col("_best")
    per = rows.join(best, group).groupBy(method).agg(
        F.count(F.lit(1)).alias("groups"), F.avg(value).alias("mean"), std0(F.col(value)).alias("std"),
        F.sum((diff > tol).cast("int")).alias("wins"), F.sum((diff < -tol).cast("int")).alias("losses"),
        F.sum((F.abs(diff) <= tol).cast("int")).alias("ties"),
    )
    refs = per.agg(F.max(F.when(F.col(method) == base, F.col("mean"))).alias("_m0"), F.max(F.when(is_base, F.col("mean"))).alias("_m1"))
    return per.join(F.broadcast(refs)).withColumn("gap_vs_base", F.col("mean") - F.col("_m0")).withColumn(  # one row
        "gap_vs_best", F.col("mean") - F.col("_m1")
    ).drop("_m0", "_m1")


def comparison_counts(rows: DataFrame, scenario: str, method: str, value: str, left: str, right: str, tol: float = 1e-12) -> DataFrame:
    pairs = pivot_methods(rows, [scenario], method, value, [left, right]).where(F.col(left).isNotNull() & F.col(right).isNotNull())
    d = F.col(left) - F.col(right)
    return pairs.agg(
        F.count(F.lit(1)).alias("scenarios"), F.sum((d > tol).cast("int")).alias("wins"),
        F.sum((F.abs(d) <= tol).cast("int")).alias("ties"), F.sum((d < -tol).cast("int")).alias("losses"),
        F.coalesce(F.avg(d), F.lit(0.0)).alias("mean_delta"),
    )


def method_spread(rows: DataFrame, keys: Sequence[str], method: str, value: str) -> DataFrame:
    top = F.struct(F.col(value), F.col(method))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("methods"), (F.max(value) - F.min(value)).alias("spread"),
        F.max_by(method, top).alias("best_method"), F.max(value).alias("best_value"),
    )


def pareto(rows: DataFrame, keys: Sequence[str], gain: str, cost: str) -> DataFrame:
    """Rows not dominated on (gain up, cost down): a running maximum along the cost axis instead of a self join."""
    best = rows.groupBy(*keys, cost).agg(F.max(gain).alias(gain))
    mark = F.struct(F.col(gain), (-F.col(cost)).alias("cheap"))
    ran = prefix_scan(best, keys, [cost], {"_top": ("max", mark)}, axis=F.col(cost))
    front = ran.where((F.col("_top")[gain] == F.col(gain)) & (F.col("_top")["cheap"] == -F.col(cost))).drop("_top")
    return rows.join(front, [*keys, cost, gain], "left_semi")


def keep_first(frames: Sequence[DataFrame], uid: str, order: str) -> DataFrame:
    """Union keeping one row per uid: the lowest source number, then the lowest order value; combined map-side."""
    tagged = None
    for i, df in enumerate(frames):
        part = df.withColumn("_src", F.lit(i))
        tagged = part if tagged is None else tagged.unionByName(part)
    cols = [c for c in tagged.columns if c not in (uid, "_src")]
    best = tagged.groupBy(uid).agg(F.min_by(F.struct(*cols), F.struct("_src", order)).alias("_r"))
    return best.select(uid, *[F.col(f"_r.{c}").alias(c) for c in cols])


def last_wins(rows: DataFrame, uid: str, ok: Column, line: Column) -> DataFrame:
    """One row per uid: a success beats errors, then the later line."""
    cols = [c for c in rows.columns if c != uid]
    best = rows.groupBy(uid).agg(F.max_by(F.struct(*cols), F.struct(ok.alias("a"), line.alias("b"))).alias("_r"))
    return best.select(uid, *[F.col(f"_r.{c}").alias(c) for c in cols])


def duplicates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def expected_grid(rows: DataFrame, dims: Sequence[str]) -> DataFrame:
    """All combinations of the small dimensions that occur, from one row of value sets."""
    out = rows.agg(*[F.collect_set(d).alias(d) for d in dims])  # each a small dimension
    for d in dims:
        out = out.withColumn(d, F.explode(d))
    return out


def completeness(rows: DataFrame, dims: Sequence[str], expected: DataFrame) -> DataFrame:
    seen = rows.select(*dims).distinct()
    missing = expected.join(seen, list(dims), "left_anti").withColumn("problem", F.lit("missing"))
    extra = seen.join(expected, list(dims), "left_anti").withColumn("problem", F.lit("unexpected"))
    return missing.unionByName(extra)


def range_problems(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Count of rows failing each check, one row per check."""
    counts = rows.agg(*[F.sum((~F.coalesce(c, F.lit(True))).cast("bigint")).alias(n) for n, c in checks.items()])
    per = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("failures")) for n in checks])
    return counts.select(F.explode(per).alias("c")).select("c.*")


def uid_hash(rows: DataFrame, keys: Sequence[str], uid: str) -> DataFrame:
    """sha256 of the newline-joined sorted uids of each (size-bounded) set."""
    text = F.array_join(F.sort_array(F.collect_set(F.col(uid).cast("string"))), "\n")
    return rows.groupBy(*keys).agg(F.sha2(text, 256).alias("uid_hash"), F.countDistinct(uid).alias("uids"))


def top_counts(rows: DataFrame, label: str, k: int = 8) -> DataFrame:
    """Rows, classes, min / median / max class size and the k largest classes (``k`` is the report's size)."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("c"))
    stats = counts.agg(
        F.sum("c").alias("rows"), F.count(F.lit(1)).alias("classes"), F.min("c").alias("min_class"),
        F.percentile("c", 0.5).alias("median_class"), F.max("c").alias("max_class"),
    )
    top = counts.orderBy(F.col("c").desc(), label).limit(k)
    text = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("a"), F.col(label).cast("string").alias("b")))),
                    lambda r: F.concat(r["b"], F.lit("="), (-r["a"]).cast("string"))), ";")
    return stats.join(F.broadcast(top.agg(text.alias("top"))))  # one row


def rank_within(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Rank of result rows inside a small group (folds, configurations)."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
