"""Budgeted configuration choice and phase-weighted accuracy as table problems.

Inference profiles (keys, lam, acc, thr) and training profiles (keys, gam, gain, train, gcost) are menus per group. A
choice never pairs the whole menus: with full coverage the score rises with accuracy for any training profile, so at a
given inference share only the most accurate affordable profile matters, and the useful shares are the costs on the
accuracy/cost front. Training profiles are cut to their gain/time front at each resource cost. Both cuts are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.core.expr import let, ratio
from tidegauge.core.scan import positions, prefix_scan, with_sizes
from tidegauge.operators.results import pareto

TOL = 1e-9


def with_cost(lams: DataFrame, rate: Column) -> DataFrame:
    """Resource cost of serving every arrival: rate over throughput."""
    return lams.withColumn("cost", rate / F.col("thr"))


def coverage_cost(rate: Column, throughput: Column, latency: Column, stored: Column) -> Column:
    """Cost from throughput, else from latency, else the stored value (1.0 when absent)."""
    return F.when(throughput > 0, rate / throughput).when(latency > 0, rate * latency).otherwise(F.coalesce(stored, F.lit(1.0)))


def coverage(share: Column, cost: Column) -> Column:
    return F.least(F.lit(1.0), share / F.greatest(cost, F.lit(TOL)))


def discounted(current: Column, future: Column, windows: int, d: float) -> Column:
    """(current + sum d^i future) / (1 + sum d^i) in closed form."""
    tail = float(windows) if d == 1.0 else d * (1 - d**windows) / (1 - d)
    return (current + tail * future) / (1 + tail)


def lambda_front(lams: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Profiles no other one beats on accuracy and cost; equal rows keep the smallest id."""
    front = pareto(lams.where(F.col("cost") <= 1 + TOL), keys, "acc", "cost")
    return front.groupBy(*keys, "acc", "cost").agg(F.min("lam").alias("lam"))


def gamma_front(gams: DataFrame, keys: Sequence[str]) -> DataFrame:
    front = pareto(gams, [*keys, "gcost"], "gain", "train")
    return front.groupBy(*keys, "gcost", "gain", "train").agg(F.min("gam").alias("gam"))


def grid_choice(
    lams: DataFrame, gams: DataFrame, keys: Sequence[str], horizon: Column, delay: float, min_active: float, min_gain: float
) -> DataFrame:
    """Best (inference profile, training profile or none, share) per key, full coverage required.

    A training candidate needs the active fraction and a gain over the best untrained profile at the same share.
    ``lams`` carries cost; ``horizon`` is an expression over the key columns.
    """
    shares = lambda_front(lams, keys).withColumn("I", F.least(F.lit(1.0), F.col("cost"))).withColumn("horizon", horizon)
    shares = shares.withColumn("R", 1 - F.col("I")).withColumn("cov", coverage(F.col("I"), F.col("cost")))
    shares = shares.withColumn("base", F.col("acc") * F.col("cov"))
    none = shares.select(
        *keys, "lam", F.lit(None).cast("bigint").alias("gam"), "I", "R", "acc", "cost", F.lit(None).cast("double").alias("finish"),
        F.lit(0.0).alias("active"), F.col("base").alias("utility"), F.col("base").alias("future"),
    )
    pairs = shares.join(gamma_front(gams, keys), list(keys)).where(F.col("R") + TOL >= F.col("gcost"))
    finish = F.col("train") / F.greatest(F.col("R"), F.lit(TOL))
    updated = F.least(F.lit(1.0), F.col("acc") + F.col("gain")) * F.col("cov")
    pairs = pairs.withColumn("finish", finish).withColumn("future", updated)
    old = F.least(F.lit(1.0), F.col("finish") / F.col("horizon"))
    pairs = pairs.withColumn("utility", old * F.col("base") + (1 - old) * F.col("future")).withColumn(
        "active", F.greatest(F.lit(0.0), 1 - (F.col("finish") + delay) / F.col("horizon"))
    )
    fit = pairs.where((F.col("active") >= min_active) & (F.col("utility") - F.col("base") >= min_gain)).select(none.columns)
    rank = F.struct("utility", "future", "acc", (-F.col("cost")).alias("cheap"), "R", (-F.col("lam")).alias("l"), (-F.coalesce("gam", F.lit(0))).alias("g"))
    cols = [c for c in none.columns if c not in keys]
    return none.unionByName(fit).groupBy(*keys).agg(F.max_by(F.struct(*cols), rank).alias("r")).select(*keys, "r.*")


def grid_choice_partial(
    lams: DataFrame, gams: DataFrame, keys: Sequence[str], horizon: Column, delay: float, min_active: float, min_gain: float
) -> DataFrame:
    """Choice with partial coverage; a training row belongs to one inference profile and has a measured accuracy.

    Shares are 0.01..1.00 plus the distinct profile costs of the key. Untrained, a profile is best at its own cost.
    """
    lams = lams.withColumn("horizon", horizon)
    at = lams.withColumn("I", F.least(F.lit(1.0), F.col("cost")))
    none = at.select(
        *keys, "lam", F.lit(None).cast("bigint").alias("gam"), "I", (1 - F.col("I")).alias("R"), coverage(F.col("I"), F.col("cost")).alias("cov"),
        F.lit(None).cast("double").alias("ready"), (F.col("acc") * coverage(F.col("I"), F.col("cost"))).alias("estimate"),
        (F.col("acc") * coverage(F.col("I"), F.col("cost"))).alias("future"),
    )
    hundred = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda i: i / F.lit(100.0))
    grid = lams.select(*keys).distinct().select(*keys, F.explode(hundred).alias("I")).unionByName(at.select(*keys, "I")).distinct()
    pairs = gams.join(lams.select(*keys, "lam", "acc", "cost", "horizon"), [*keys, "lam"]).join(grid.where("I < 1"), list(keys))
    pairs = pairs.withColumn("finish", F.col("train") / (1 - F.col("I"))).withColumn("cov", coverage(F.col("I"), F.col("cost")))
    done = F.col("finish") / F.col("horizon")
    est = F.col("cov") * (F.least(F.lit(1.0), done) * F.col("acc") + F.greatest(F.lit(0.0), 1 - done) * F.col("post"))
    pairs = pairs.withColumn("estimate", est).withColumn("active", F.greatest(F.lit(0.0), 1 - (F.col("finish") + delay) / F.col("horizon")))
    fit = pairs.where((F.col("active") >= min_active) & (F.col("estimate") - F.col("acc") * F.col("cov") >= min_gain)).select(
        *keys, "lam", "gam", "I", (1 - F.col("I")).alias("R"), "cov", (delay + F.col("finish")).alias("ready"), "estimate", (F.col("cov") * F.col("post")).alias("future")
    )
    rank = F.struct("estimate", "future", "R", "lam", F.coalesce("gam", F.lit(-1)).alias("g"))
    cols = [c for c in none.columns if c not in keys]
    return none.unionByName(fit).groupBy(*keys).agg(F.max_by(F.struct(*cols), rank).alias("r")).select(*keys, "r.*")


def estimate(acc: Column, cost: Column, gain: Column, train: Column, gcost: Column, share: Column, rest: Column, window: float, windows: int, d: float,
             margin: float = 0.0, ceiling: float = 1.0) -> Column:
    """Struct (current, future, long, finish, replaced) of one pair under a split budget; a NULL gain means no training.

    A trained profile replaces the old one where it reaches it plus ``margin``; no accuracy goes above ``ceiling``.
    """
    cov = coverage(share, cost)
    base = acc * cov
    finish = train / F.greatest(rest, F.lit(TOL))
    can = gain.isNotNull() & (rest >= gcost)
    on_time = can & (finish <= window)
    updated = F.least(F.lit(float(ceiling)), acc + gain) * cov
    replaced = on_time & (updated >= base + margin)
    old = F.greatest(F.lit(0.0), F.least(F.lit(1.0), finish / window))
    future = F.when(replaced, updated).otherwise(base)
    current = F.when(replaced, old * base + (1 - old) * updated).otherwise(base)
    return F.struct(
        current.alias("current"), future.alias("future"), discounted(current, future, windows, d).alias("long"),
        F.when(can, finish).alias("finish"), F.coalesce(replaced, F.lit(False)).alias("replaced"),
    )


def best_affordable(asks: DataFrame, share: str, lams: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For every ask the most accurate profile with cost <= share (cheapest on ties): a running maximum over both tables."""
    key_cols = [F.col(k) for k in keys]
    menu = lams.select(*key_cols, F.col("cost").alias("_x"), F.struct(F.col("acc"), (-F.col("cost")).alias("nc"), (-F.col("lam")).alias("nl")).alias("_m"))
    points = asks.select(*key_cols, F.col(share).alias("_x")).distinct().withColumn("_m", F.lit(None).cast("struct<acc:double,nc:double,nl:bigint>"))
    both = menu.unionByName(points).groupBy(*keys, "_x").agg(F.max("_m").alias("_m"), F.max(F.col("_m").isNull()).alias("_asked"))
    ran = prefix_scan(both, keys, ["_x"], {"_best": ("max", F.col("_m"))}, axis=F.col("_x"))
    got = ran.where("_asked AND _best IS NOT NULL").select(
        *keys, F.col("_x").alias(share), F.col("_best.acc").alias("acc"), (-F.col("_best.nc")).alias("cost"), (-F.col("_best.nl")).alias("lam")
    )
    return asks.join(got, [*keys, share])


def saturating_gain(base: Column, gain: Column, profile_steps: Column, target_steps: Column, cap: float = 1.0) -> Column:
    """One-point saturating curve A0 + (C-A0) x/(x+s) through the profiled point, read at the target step."""
    b = F.greatest(F.lit(0.0), F.least(F.lit(1.0), base))
    top = F.greatest(b, F.lit(min(1.0, cap)))
    reached = F.greatest(F.lit(0.0), F.least(top, b + gain))
    scale = profile_steps * (top - reached) / F.greatest(F.lit(1e-12), reached - b)
    far = (top - b) * (target_steps / (target_steps + scale))
    return (
        F.when((profile_steps <= 0) | (target_steps <= 0), F.greatest(-b, F.least(top - b, gain)))
        .when(reached <= b, F.greatest(-b, F.least(F.lit(0.0), reached - b)))
        .when(reached >= top - 1e-12, top - b)
        .otherwise(F.greatest(-b, F.least(top - b, far)))
    )


SCALE_DIVISORS = [8.0, 4.0, 2.0, 1.0, 0.5, 0.25, 0.125]  # fixed values of the scale search
SCALE_FIXED = [1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0]


def fit_curve_gain(curve: Column, target: Column, cap: float = 1.0) -> Column:
    """Struct (profile_gain, scale, predicted_gain) from a short array of (step, acc) points.

    The scale with the smallest squared error is taken from a fixed search list; equal errors keep the smaller scale.
    """

    def ends(pts: Column) -> Column:
        return F.struct(
            pts.alias("pts"), F.get(pts, F.lit(0))["acc"].alias("start"), F.get(pts, F.size(pts) - 1).alias("last"),
            F.greatest(F.get(pts, F.lit(0))["acc"], F.lit(min(cap, 1.0))).alias("top"),
        )

    def search(r: Column) -> Column:
        def sse(s: Column) -> Column:
            def err(p: Column) -> Column:
                pred = F.when(p["step"] > 0, r["start"] + (r["top"] - r["start"]) * (p["step"] / (p["step"] + s))).otherwise(r["start"])
                return (pred - p["acc"]) * (pred - p["acc"])

            return F.aggregate(r["pts"], F.lit(0.0), lambda a, p: a + err(p))

        scales = F.array(*[F.greatest(r["last"]["step"] / d, F.lit(1e-6)) for d in SCALE_DIVISORS], *[F.lit(v) for v in SCALE_FIXED])
        return F.array_min(F.transform(scales, lambda s: F.struct(sse(s).alias("e"), s.alias("s"))))["s"]

    def result(r: Column) -> Column:
        gain = F.greatest(F.lit(0.0), r["last"]["acc"] - r["start"])
        flat = (F.size(r["pts"]) < 2) | (gain <= 0)

        def read(best: Column) -> Column:
            far = F.greatest(F.lit(0.0), (r["top"] - r["start"]) * (target / (target + best)))
            predicted = F.when(flat | (r["top"] <= r["start"]), 0.0).otherwise(far)
            return F.struct(F.when(flat, 0.0).otherwise(gain).alias("profile_gain"), best.alias("scale"), predicted.alias("predicted_gain"))

        return let(search(r), read)

    return let(let(F.array_sort(curve), ends), result)


def extrapolate_time(measured: Column, steps: Column, target: Column) -> Column:
    return F.when((steps <= 0) | (target <= steps), measured).otherwise(measured * (target / steps))


def round_duration(seconds: Column) -> Column:
    """To 5 min, 1 min, 10 s or 1 s by size, halves to even."""
    def to(step: float) -> Column:
        return F.bround(seconds / step, 0) * step

    return F.when(seconds >= 3600, to(300.0)).when(seconds >= 600, to(60.0)).when(seconds >= 60, to(10.0)).otherwise(F.bround(seconds, 0))


def retrain_window(stats: DataFrame) -> DataFrame:
    """Window length from (t_min, t_med, t_p75, t_max) by the rule cascade, with the rule's name."""
    med, top = F.col("t_med"), F.col("t_max")
    at = {p: round_duration(p * top) for p in (0.50, 0.65, 0.80)}

    def inside(v: Column) -> Column:
        return (v > med) & (v < top)

    first = (
        F.when(inside(at[0.65]), F.struct(at[0.65].alias("v"), F.lit("0.65*max").alias("rule")))
        .when(inside(at[0.50]), F.struct(at[0.50].alias("v"), F.lit("0.50*max").alias("rule")))
        .when(inside(at[0.80]), F.struct(at[0.80].alias("v"), F.lit("0.80*max").alias("rule")))
        .otherwise(F.struct(at[0.65].alias("v"), F.lit("0.65*max").alias("rule")))
    )
    mid = round_duration((med + top) / 2)
    second = F.when(F.col("_a.v") >= top, F.struct(mid.alias("v"), F.lit("midpoint").alias("rule"))).otherwise(F.col("_a"))
    third = F.when(
        F.col("_b.v") <= med, F.struct(round_duration(F.greatest(med + 1, 0.65 * top)).alias("v"), F.lit("above_median").alias("rule"))
    ).otherwise(F.col("_b"))
    out = stats.withColumn("_a", first).withColumn("_b", second).withColumn("_c", third)
    return out.withColumn("selected", F.col("_c.v")).withColumn("rule", F.col("_c.rule")).drop("_a", "_b", "_c")


def ordered_correctness(rows: DataFrame, keys: Sequence[str], order: str, flags: Sequence[str]) -> DataFrame:
    """Stream position, group size and running correct counts of each prediction column."""
    ran = prefix_scan(
        rows, keys, [order], {"rn": ("count", F.lit(1)), **{f"cum_{f}": ("sum", F.col(f)) for f in flags}}, axis=F.col(order)
    )
    return with_sizes(ran, keys)


def phased_accuracy(rows: DataFrame, keys: Sequence[str], order: str, plans: DataFrame) -> DataFrame:
    """Accuracy of each plan over the ordered rows of its key: before the delay, until ready, after.

    ``rows``: 0/1 columns pre, base, post. ``plans``: keys, plan, d, r (indices), c0, c (coverages). The running counts are
    looked up at the two switch positions, so rows are scanned once however many plans there are.
    """
    marks = ordered_correctness(rows.select(*keys, order, "pre", "base", "post"), keys, order, ["pre", "base", "post"])
    marks = marks.select(*keys, "rn", "cum_pre", "cum_base", "cum_post")
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("post").alias("all_post"), F.sum("base").alias("all_base"))
    p = plans.join(totals, list(keys))
    n = F.col("n")
    p = p.withColumn("d", F.least(n, F.col("d")).cast("bigint")).withColumn("r", F.greatest(F.col("d"), F.least(n, F.coalesce("r", n))).cast("bigint"))
    for name in ("d", "r"):
        at = marks.select(*keys, F.col("rn").alias(name), *[F.col(f"cum_{c}").alias(f"{name}_{c}") for c in ("pre", "base", "post")])
        p = p.join(at, [*keys, name], "left").fillna(0, [f"{name}_{c}" for c in ("pre", "base", "post")])
    before = F.col("d_pre")
    middle = F.col("r_base") - F.col("d_base")
    after = F.col("all_post") - F.col("r_post")
    score = (F.col("c0") * before + F.col("c") * (middle + after)) / n
    return p.select(
        *keys, "plan", "n", "d", "r", before.alias("pre_correct"), middle.alias("base_correct"), after.alias("post_correct"),
        (n - F.col("r")).alias("adapted_n"), score.alias("score"), (F.col("c") * F.col("all_post") / n).alias("final"),
    )


def phased_by_task(rows: DataFrame, keys: Sequence[str], task: str, order: str, ready: Column, cover: Column) -> DataFrame:
    """Before / after, final and per-task accuracy around the ready index, with covered and timed-out counts."""
    numbered = with_sizes(positions(rows, keys, [order], F.col(order)), keys).withColumn("_ready", ready).withColumn("_c", cover)
    late = F.col("rn") > F.col("_ready")
    hit = F.when(late, F.col("post")).otherwise(F.col("base"))
    return numbered.groupBy(*keys, task).agg(
        F.count(F.lit(1)).alias("rows"), F.sum((~late).cast("int")).alias("before_n"),
        F.coalesce(ratio(F.sum(F.when(~late, F.col("base"))), F.sum((~late).cast("int"))), F.lit(0.0)).alias("before_acc"),
        F.coalesce(ratio(F.sum(F.when(late, F.col("post"))), F.sum(late.cast("int"))), F.lit(0.0)).alias("after_acc"),
        (F.first("_c") * F.avg(hit)).alias("current_acc"), (F.first("_c") * F.avg("post")).alias("final_acc"),
        ((1 - F.first("_c")) * F.count(F.lit(1))).alias("timeouts"),
    )
