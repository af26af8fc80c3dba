"""Deterministic sampling and splitting: digest order, keyed window plans, stratified allocation.

Random streams are replaced by rules every engine can repeat: rows are ranked by a digest of their id, and a window draws the
first places of its own keyed permutation of the pool, so draws within a window are distinct while they last.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.core.expr import hex_int, let, lit_array
from tidegauge.core.scan import hash_positions, with_sizes


ROUNDS = 16  # rounds of the keyed permutation


def digest(uid: Column, seed: str = "", kind: str = "md5") -> Column:
    text = F.concat(F.lit(f"{seed}:"), uid.cast("string")) if seed else uid.cast("string")
    return F.md5(text) if kind == "md5" else F.sha2(text, 256)


def stable_order(
    df: DataFrame, uid: str, seed: str, keys: Sequence[str] = (), name: str = "rn", rows: int | None = None
) -> DataFrame:
    """1-based rank by digest of "seed:uid" (the hex text sorts like the integer), optionally inside a key."""
    hashed = df.withColumn("_hex", digest(F.col(uid), seed))
    return hash_positions(hashed, list(keys), "_hex", uid, name, rows).drop("_hex")


def pool_index(df: DataFrame, uid: str, seed: str, keys: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """0-based draw index of a pool row."""
    return stable_order(df, uid, seed, keys, "idx", rows).withColumn("idx", F.col("idx") - 1)


def stable_mask(uid: Column, fraction: float) -> Column:
    """First 8 hex digits of sha256(uid) mod 10000 below the cutoff."""
    return hex_int(F.substring(F.sha2(uid.cast("string"), 256), 1, 8)) % 10_000 < int(round(fraction * 10_000))


def draw_turns(window: Column, seed: int = 0, source: int = 0) -> Column:
    """What the rounds of a window's permutation take from their digests, one (k, by, plus) a round; the same for all places of the window."""
    key = F.concat_ws(":", F.lit(str(seed)), F.lit(str(source)), window.cast("bigint").cast("string"))
    digests = F.transform(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), lambda r: F.md5(F.concat_ws(":", key, r.cast("string"))))
    return F.transform(digests, lambda h: F.struct(
        hex_int(F.substring(h, 1, 8)).alias("k"), hex_int(F.substring(h, 9, 7)).alias("by"), hex_int(F.substring(h, 16, 8)).alias("plus")))


def draw_index(
    window: Column, j: Column, pool_size: Column | int, seed: int = 0, source: int = 0, turns: Column | None = None
) -> Column:
    """The j-th place of a keyed permutation of 0 .. n-1: each (seed, source, window) has its own, and no place comes twice while j < n.

    Each round pairs x with K - x mod n and swaps the pair or not, by a bit that depends on the pair alone; so a round is a
    permutation of exactly n places, whatever n is. K and the bit's hash come from a digest of the key and the round. All products
    stay below 2**59. ``turns`` is the column of ``draw_turns``, made once per window before its places are listed.
    """
    n = (pool_size if isinstance(pool_size, Column) else F.lit(pool_size)).cast("bigint")

    def turn(x: Column, t: Column) -> Column:
        other = F.pmod(t["k"] % n - x, n)
        bit = (t["by"] * (F.greatest(x, other) % 2147483647) + t["plus"]) % 2147483647 % 2
        return F.when(bit == 1, other).otherwise(x)

    return F.aggregate(draw_turns(window, seed, source) if turns is None else turns, (j.cast("bigint") % n).cast("bigint"), turn)


def draw_all(turns: Column, count: Column | int, pool_size: int) -> Column:
    """Places 0 .. count-1 of a window's keyed permutation as one array, each as ``draw_index`` gives it, from the column of ``draw_turns``."""
    n = max(pool_size, 1)

    @F.pandas_udf("array<bigint>")
    def places(numbers: pd.Series, counts: pd.Series) -> pd.Series:
        out: list[np.ndarray] = []
        for lo in range(0, len(counts), 256):
            sizes = counts.iloc[lo : lo + 256].to_numpy(np.int64)
            rounds = np.stack(numbers.iloc[lo : lo + 256].to_list()).astype(np.int64).reshape(len(sizes), -1, 3)
            x = np.tile(np.arange(sizes.max(), dtype=np.int64) % n, (len(sizes), 1))
            for k, by, plus in rounds.transpose(1, 2, 0)[:, :, :, None]:
                other = (k % n - x) % n
                bit = (by * (np.maximum(x, other) % 2147483647) + plus) % 2147483647 % 2
                x = np.where(bit == 1, other, x)
            out += [row[:size] for row, size in zip(x, sizes)]
        return pd.Series(out)

    flat = F.flatten(F.transform(turns, lambda t: F.array(t["k"], t["by"], t["plus"])))
    return places(flat.cast("array<bigint>"), (count if isinstance(count, Column) else F.lit(count)).cast("int"))


def window_plan(
    spark: SparkSession,
    windows: int,
    size: int,
    ratios: Sequence[float],
    clean_size: int,
    drift_size: int,
    seed: int = 0,
) -> DataFrame:
    """Rows (ratio, window_id, slot, source, j, pool_idx, n_clean, n_drift): clean rows first, then drift rows.

    Draws repeat only when a pool is smaller than what one window takes from it.
    """
    shapes = F.array(
        *[
            F.struct(F.lit(float(r)).alias("ratio"), F.lit(size - round(size * r)).alias("n_clean"),
                     F.lit(round(size * r)).alias("n_drift"))
            for r in ratios
        ]
    )
    base = spark.range(windows).select(F.col("id").alias("window_id"), F.explode(shapes).alias("p")).select("window_id", "p.*")
    w = F.col("window_id") + F.round(F.col("ratio") * 1000).cast("bigint") * 7
    clean = draw_all(draw_turns(w, seed, 0), F.col("n_clean"), clean_size)
    drift = draw_all(draw_turns(w, seed, 1), F.col("n_drift"), drift_size)
    slots = base.select("*", F.posexplode(F.concat(clean, drift)).alias("slot", "pool_idx"))
    of_clean = F.col("slot") < F.col("n_clean")
    j = F.when(of_clean, F.col("slot")).otherwise(F.col("slot") - F.col("n_clean"))
    source = F.when(of_clean, "clean").otherwise("drift")
    return slots.select("ratio", "window_id", "slot", source.alias("source"), j.alias("j"), "pool_idx", "n_clean", "n_drift")


def stationary_plan(spark: SparkSession, windows: int, size: int, pool_size: int, seed: int = 0) -> DataFrame:
    """Windows drawn from one pool."""
    base = spark.range(windows).withColumnRenamed("id", "window_id")
    return base.select("window_id", F.posexplode(draw_all(draw_turns(F.col("window_id"), seed, 2), size, pool_size)).alias("slot", "pool_idx"))


def bootstrap_plan(spark: SparkSession, windows: int, size: int, pool_size: int, seed: str) -> DataFrame:
    """Draws with replacement: digest of (seed, window, slot) mod N."""
    slots = spark.range(windows).select(
        F.col("id").alias("window_id"), F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("slot")
    )
    text = F.concat_ws(":", F.lit(seed), F.col("window_id"), F.col("slot"))
    return slots.withColumn("pool_idx", hex_int(F.substring(F.md5(text), 1, 15)) % F.lit(max(pool_size, 1)))


def task_balanced_plan(spark: SparkSession, windows: int, size: int, sizes: dict, task_type: str, seed: str) -> DataFrame:
    """Uniform task per slot by digest, then distinct rows inside the task while it has enough of them.

    ``sizes`` maps task -> pool rows (one entry per task, a small dimension).
    """
    tasks = sorted(sizes)
    slots = spark.range(windows).select(
        F.col("id").alias("window_id"), F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("slot")
    )
    pick = (hex_int(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("window_id"), F.col("slot"))), 1, 15)) % len(tasks)).cast("int")
    chosen = slots.select(
        "window_id", "slot", F.get(lit_array(tasks), pick).cast(task_type).alias("task"),
        F.get(lit_array([sizes[t] for t in tasks]), pick).cast("bigint").alias("_n"),
    )
    within = Window.partitionBy("window_id", "task").orderBy("slot")  # at most one window of slots per group
    ranked = chosen.withColumn("_j", F.row_number().over(within) - 1)
    return ranked.withColumn("pool_idx", draw_index(F.col("window_id"), F.col("_j"), F.col("_n"))).drop("_n", "_j")


def layout_key(layout: str, size: Column, block: int | None = None, seed: str = "order") -> Column:
    """Sort key of a slot inside its window: contiguous tail, shuffled by digest, or drift blocks between clean parts."""
    slot, n_clean, n_drift = F.col("slot"), F.col("n_clean"), F.col("n_drift")
    if layout == "contiguous_tail":
        return F.lpad(slot.cast("string"), 10, "0")
    if layout == "shuffled":
        return F.concat(F.md5(F.concat_ws(":", F.lit(seed), F.col("window_id"), slot)), slot.cast("string"))
    if layout != "block" or not block or block <= 0:
        raise ValueError(f"unsupported layout {layout!r} or block size {block!r}")
    # clean rows are split into parts+1 near-equal runs (the first ones longer); part p is followed by drift block p
    parts = F.ceil(n_drift / block) + 1
    base, extra = F.floor(n_clean / parts), n_clean % parts
    long_rows = extra * (base + 1)
    part = F.when(slot < long_rows, F.floor(slot / (base + 1))).otherwise(
        extra + F.floor((slot - long_rows) / F.greatest(base, F.lit(1)))
    )
    group = F.when(slot < n_clean, 2 * part).otherwise(2 * F.floor((slot - n_clean) / block) + 1)
    return F.concat(F.lpad(group.cast("string"), 10, "0"), F.lpad(slot.cast("string"), 10, "0"))


def materialize(plan: DataFrame, pools: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Plan rows joined to their pool values and packed, in slot order, into one bounded array per window and source.

    ``pools``: source, pool_idx and the value columns.
    """
    # the planner takes an exploded range for the few rows it came from; a plan grows with the data and must not be broadcast
    drawn = plan.hint("merge").join(pools, ["source", "pool_idx"])
    return drawn.groupBy(*keys).agg(
        *[
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("source") == s, F.struct(F.col("slot"), F.col(v).alias("x"))))),
                lambda r: r["x"],
            ).alias(f"{s}_{v}")
            for v in values
            for s in ("clean", "drift")
        ]
    )


def allocate(labels: DataFrame, label: str, size: str, takes: Sequence[tuple[str, int]], seed: str) -> DataFrame:
    """Largest-remainder shares of successive takes, each from what the earlier ones left.

    ``labels`` is a class-count table (one row per class). Result: label and (name, lo, hi] ranges of within-class ranks.
    """
    out = labels.select(label, F.col(size).cast("bigint").alias("_left"), F.lit(0).cast("bigint").alias("_used"))
    every = Window.partitionBy()  # the class table only
    for name, count in takes:
        total = F.sum("_left").over(every)
        want = F.least(F.lit(count), total)
        share = out.withColumn("_exact", F.when(total > 0, want * F.col("_left") / total).otherwise(0.0)).withColumn(
            "_floor", F.floor("_exact")
        )
        share = share.withColumn("_miss", want - F.sum("_floor").over(every))
        by_rest = Window.partitionBy().orderBy(
            (F.col("_exact") - F.col("_floor")).desc(), F.md5(F.concat(F.lit(f"{seed}:{name}:rem:"), F.col(label))).desc(),
            F.col(label).desc(),
        )
        share = share.withColumn("_got", F.col("_floor") + (F.row_number().over(by_rest) <= F.col("_miss")).cast("int"))
        out = share.withColumn(f"hi_{name}", F.col("_used") + F.col("_got")).withColumn(
            "_used", F.col("_used") + F.col("_got")
        ).withColumn("_left", F.col("_left") - F.col("_got")).drop("_exact", "_floor", "_miss", "_got")
    return out.drop("_left", "_used")


def chained_split(
    df: DataFrame, uid: str, label: str, takes: Sequence[tuple[str, int]], seed: str, rest: str = "rest"
) -> DataFrame:
    """Tag every row with the take it falls into: one rank per class, compared with cumulative class ranges."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    ranges = allocate(counts, label, "_size", takes, seed)
    ranked = stable_order(df, uid, f"{seed}:label", [label])
    tagged = ranked.join(ranges, label)
    split = F.lit(None).cast("string")
    for name, _ in reversed(takes):
        split = F.when(F.col("rn") <= F.col(f"hi_{name}"), F.lit(name)).otherwise(split)
    return tagged.withColumn("split", F.coalesce(split, F.lit(rest))).drop(*[f"hi_{n}" for n, _ in takes])


def rank_split(df: DataFrame, uid: str, keys: Sequence[str], seed: str, cut: Column, names: tuple[str, str]) -> DataFrame:
    """First ``cut`` ranks of each key (an expression over n) go to names[0], the others to names[1]."""
    ranked = with_sizes(stable_order(df, uid, seed, keys), keys)
    return ranked.withColumn("split", F.when(F.col("rn") <= cut, names[0]).otherwise(names[1]))


def cuts_split(df: DataFrame, uid: str, seed: str, ends: Sequence[tuple[str, Column]], last: str) -> DataFrame:
    """Successive cut points of one digest-ordered list; the ends are expressions over n."""
    ranked = with_sizes(stable_order(df, uid, seed), [])
    split = F.lit(last)
    for name, end in reversed(ends):
        split = F.when(F.col("rn") <= end, F.lit(name)).otherwise(split)
    return ranked.withColumn("split", split)


def pair_interleave(clean: DataFrame, drift: DataFrame, uid: str, seed: str) -> DataFrame:
    """Pair the i-th clean with the i-th drift row in digest order; a digest coin decides which comes first."""
    a = stable_order(clean, uid, f"{seed}:a").select(F.col("rn").alias("pair"), F.col(uid).alias("_a"))
    b = stable_order(drift, uid, f"{seed}:b").select(F.col("rn").alias("pair"), F.col(uid).alias("_b"))
    coin = hex_int(F.substring(F.md5(F.concat(F.lit(f"{seed}:coin:"), F.col("pair").cast("string"))), 1, 8)) % 2 == 0
    first = F.struct(F.lit("clean").alias("source"), F.col("_a").alias(uid))
    second = F.struct(F.lit("drift").alias("source"), F.col("_b").alias(uid))
    both = F.when(coin, F.array(first, second)).otherwise(F.array(second, first))
    return a.join(b, "pair").select("pair", F.posexplode(both).alias("_i", "_r")).select(
        ((F.col("pair") - 1) * 2 + F.col("_i") + 1).alias("ord"), "pair", "_r.source", f"_r.{uid}"
    )
