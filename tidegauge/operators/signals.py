"""Signals from losses: empirical distribution levels, format-aware references, events, trial summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.core.expr import std0
from tidegauge.core.scan import prefix_scan

ALL = "__all__"


def ecdf_levels(reference: DataFrame, values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Table (keys, value, level) with level = share of reference values <= value, for every value asked for.

    Both sides are reduced to distinct values first, then one bucketed running sum gives all levels; ties and hot values
    cost one row.
    """
    ref = reference.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_r"))
    return _levels(ref, values, keys, value)


def _levels(ref_counts: DataFrame, values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    asked = values.where(F.col(value).isNotNull()).select(*keys, value).distinct().withColumn("_r", F.lit(0).cast("bigint"))
    steps = ref_counts.unionByName(asked).groupBy(*keys, value).agg(F.sum("_r").alias("_r"), F.min("_r").alias("_asked"))
    ran = prefix_scan(steps, keys, [value], {"_cum": ("sum", F.col("_r"))}, axis=F.col(value))
    totals = ref_counts.groupBy(*keys).agg(F.sum("_r").alias("_n"))
    sized = ran.join(totals, list(keys)) if keys else ran.join(F.broadcast(totals))  # keyless: one row
    return sized.where(F.col("_asked") == 0).select(*keys, value, (F.col("_cum") / F.col("_n")).alias("level"))


def ecdf(reference: DataFrame, values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Values with their reference level; a hot value is split by the adaptive skew join (one level row per value)."""
    return values.join(ecdf_levels(reference, values, keys, value), [*keys, value], "left")


def format_group(fmt: Column) -> Column:
    return (
        F.when(fmt.isin("mcq", "yes_no"), "closed_set")
        .when(fmt == "open_short", "open_short")
        .when(fmt.isin("caption", "long_report"), "long_generation")
        .otherwise(fmt)
    )


def format_ecdf(reference: DataFrame, values: DataFrame, fmt: str, value: str) -> DataFrame:
    """Levels against the own format group, or against all reference values where the group has none."""
    ref = reference.withColumn("ref_group", format_group(F.col(fmt)))
    counts = ref.where(F.col(value).isNotNull()).groupBy("ref_group", value).agg(F.count(F.lit(1)).alias("_r"))
    both = counts.withColumn("ref_group", F.explode(F.array(F.col("ref_group"), F.lit(ALL))))
    both = both.groupBy("ref_group", value).agg(F.sum("_r").alias("_r"))
    present = ref.select("ref_group").distinct().withColumn("_own", F.lit(True))
    asked = values.withColumn("group", format_group(F.col(fmt))).join(
        present.withColumnRenamed("ref_group", "group"), "group", "left"
    )
    asked = asked.withColumn("fallback", F.col("_own").isNull()).withColumn(
        "ref_group", F.when(F.col("fallback"), ALL).otherwise(F.col("group"))
    ).drop("_own")
    return asked.join(_levels(both, asked, ["ref_group"], value), ["ref_group", value], "left").drop("ref_group")


def fallback_counts(scored: DataFrame) -> DataFrame:
    return scored.where("fallback").groupBy("group").agg(F.count(F.lit(1)).alias("missing"))


def binarize(level: Column, threshold: float, inclusive: bool) -> Column:
    return (level >= threshold if inclusive else level > threshold).cast("int")


def trial_summary(traces: DataFrame, keys: Sequence[str], horizon: int, budgets: Sequence[int]) -> DataFrame:
    """Recall within budgets, miss rate, censored mean delay and the window false-alarm rate."""
    hit = F.col("delay").isNotNull()
    censored = F.coalesce("delay", F.lit(horizon))
    within = [F.avg((hit & (censored <= b)).cast("double")).alias(f"r{b}") for b in (*budgets, horizon)]
    return traces.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trials"),
        F.avg(censored).alias("mean_delay_censored"),
        F.avg((~hit).cast("double")).alias("miss_rate"),
        F.sum("alarm_windows").alias("alarm_windows"),
        F.sum("windows").alias("windows"),
        (F.sum("alarm_windows") / F.sum("windows")).alias("fpr"),
        *within,
    )


def budget_recall(traces: DataFrame, keys: Sequence[str], budgets: Sequence[int], limit: Column) -> DataFrame:
    """One row per budget: share of trials detected in time, pre-change alarm rate and censored delay."""
    spread = traces.withColumn("budget", F.explode(F.array(*[F.lit(b) for b in budgets])))
    hit = F.coalesce(F.col("delay") <= F.col("budget"), F.lit(False))
    return spread.groupBy(*keys, "budget").agg(
        F.avg(hit.cast("double")).alias("recall"),
        F.avg((F.col("prechange") > 0).cast("double")).alias("prechange_rate"),
        F.avg(F.when(hit, F.col("delay")).otherwise(F.least(F.col("budget"), limit))).alias("censored_delay"),
    )


def pick_by_fpr(candidates: DataFrame, target: float) -> DataFrame:
    """First candidate within the target rate, else the lowest rate (lowest index on ties)."""
    ok = F.col("fpr") <= target
    rank = F.struct(
        F.when(ok, 0).otherwise(1).alias("a"), F.when(ok, 0.0).otherwise(F.col("fpr")).alias("b"), F.col("idx").alias("c")
    )
    return candidates.groupBy("method").agg(
        F.min_by("idx", rank).alias("selected_index"), F.min_by("param", rank).alias("param"), F.min_by("fpr", rank).alias("fpr")
    )


def pick_by_power(candidates: DataFrame, target: float) -> DataFrame:
    """Highest validation power within the target; ties take the larger rate, then the lower index."""
    rank = F.when(F.col("fpr") <= target, F.struct(F.col("power"), F.col("fpr"), (-F.col("idx")).alias("late")))
    best = candidates.groupBy("method").agg(F.max_by("idx", rank).alias("selected_index"), F.max(rank).alias("_best"))
    return best.select(
        "method", F.when(F.col("_best").isNull(), "not_calibratable").otherwise("selected").alias("status"),
        F.when(F.col("_best").isNotNull(), F.col("selected_index")).alias("selected_index"),
        F.col("_best.power").alias("power"), F.col("_best.fpr").alias("fpr"),
    )


def seed_summary(rows: DataFrame, keys: Sequence[str], seed: str, metric: str) -> DataFrame:
    """Mean within a seed, then mean and sample deviation over seeds (0.0 for a single seed)."""
    per_seed = rows.groupBy(*keys, seed).agg(F.avg(metric).alias("_m"))
    return per_seed.groupBy(*keys).agg(
        F.count("_m").alias("seeds"), F.avg("_m").alias(f"{metric}_mean"), std0(F.col("_m")).alias(f"{metric}_std")
    )


def tied_best(rows: DataFrame, metric: str, value: str, method: str, lower: Sequence[str], tol: float = 1e-12) -> DataFrame:
    """All methods at the optimum of each metric (minimum for the names in ``lower``)."""
    by = Window.partitionBy(metric)  # one row per method
    goal = F.when(F.col(metric).isin(list(lower)), F.min(value).over(by)).otherwise(F.max(value).over(by))
    return rows.withColumn("_goal", goal).where(F.abs(F.col(value) - F.col("_goal")) <= tol).select(metric, method, value)
