"""Detectors over whole streams that are held as bounded segments.

A stream of any length is cut into segments (keys, seg, xs). Where no alarm falls, a segment moves the detector's state by elements
that compose (``blocks.PARTS``), so the state at the start of every segment of a key comes from one scan over small elements, part by
part of the state. An alarm resets the state, so a segment with an alarm hands on the state it ends in, whatever came before.

Keys of fewer than LONG segments are read through by one task, a segment at a time. For longer ones, every round scans for the states at all starts, runs the segments from them, and compares what they did with what the scan took
for granted: at first that no segment alarms. The segments up to the first one that behaved otherwise are settled; the later ones of that
key go into the next round. A key that never resets is settled in the first round. Rounds go on while each settles at least half of
what it began with, so there are at most log2(segments) of them and all together run each segment about twice. Keys that reset more often
are finished in a row: all their segments run side by side from a reset detector first, and the pass along the key reads a segment only
up to the first alarm that this run has too, as both are the same behind it. The values stay where they are: rounds join small rows to them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.core.session import cut_lineage, kept
from tidegauge.functions import blocks as bl
from tidegauge.functions import sequential as seq

LONG = 256  # segments of a key that one task runs through in a row; keys beyond are run segment by segment side by side
BLOCK = 4096  # segments of a key that one task scans in a row; more are first composed block by block
PART_FIELDS = {"ddm": [2, 5], "eddm": [5, 6], "hddm_w": [3, 6, 9], "page_hinkley": [2, 4, 6]}  # end of each part in a state


def _params(method: str, params: dict[str, Any] | None, varied: str | None):
    """Parameters of a row: ``varied`` names the one that the column ``param`` holds."""
    fixed = {**seq.DEFAULTS[method], **(params or {})}
    return lambda value: {**fixed, varied: float(value)} if varied else fixed


def segment_runs(packed: DataFrame, method: str, params: dict[str, Any] | None = None, varied: str | None = None, begin: str | None = None) -> DataFrame:
    """The rows with ``run``: the struct (at, state) of each segment, read from ``begin`` (a column of states) or from a reset detector."""
    given = _params(method, params, varied)

    @F.pandas_udf("at array<int>, state array<double>")
    def run(xs: pd.Series, s: pd.Series, value: pd.Series) -> pd.DataFrame:
        rows = [bl.trace(method, given(v), x, None if b is None else list(b)) for x, b, v in zip(xs, s, value)]
        return pd.DataFrame([(at, state) for at, state in rows], columns=["at", "state"])

    first = F.col(begin) if begin else F.lit(None).cast("array<double>")
    return packed.withColumn("run", run("xs", first, F.col("param") if varied else F.lit(0.0)))


def _elements(rows: DataFrame, part: int, method: str, params: dict[str, Any] | None, varied: str | None) -> Column:
    """Element of one part of the state for each segment, given the parts before it at the segment's start."""
    given, make = _params(method, params, varied), bl.PARTS[method][part].element

    @F.pandas_udf("array<double>")
    def element(xs: pd.Series, s: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([make(given(v), np.asarray(x, dtype=np.float64), bl.start(method) if b is None else list(b)) for x, b, v in zip(xs, s, value)])

    begin = F.col("begin") if "begin" in rows.columns else F.lit(None).cast("array<double>")
    return element("xs", begin, F.col("param") if varied else F.lit(0.0))


def _by_key(rows: DataFrame, *cols: str) -> DataFrame:
    """The rows of a key in one task. The key is hashed once more: a join's shuffle by the bare key would stand in for this one, and where
    that join turns out to be a broadcast, its shuffle is read as it was written, which leaves a key in several tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*cols))


def _scan(items: DataFrame, part: int, most: int, method: str, params: dict[str, Any] | None, varied: str | None) -> DataFrame:
    """(_k, seg, part state at the segment's start) of items (_k, seg, param, e, c): the element, or the state ``c`` a segment ends in for sure.

    The items of a key are small and follow each other in one task; from BLOCK on, blocks of them are composed first, the blocks'
    composites are scanned the same way, and each block then starts from its own state.
    """
    given, p = _params(method, params, varied), bl.PARTS[method][part]

    def starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for pdf in batches:
            out = []
            for k, blk, b, e, c, v in zip(pdf["_k"], pdf["_blk"], pdf["b"], pdf["e"], pdf["c"], pdf["param"]):
                if (k, blk) != now:
                    now, state = (k, blk), bl.start(method) if b is None else list(b)
                out.append(state)
                state = list(c) if c is not None else p.apply(given(v), state, list(e))
            yield pd.DataFrame({"_k": pdf["_k"], "seg": pdf["seg"], "at_start": out})

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, e0, c0, v0 = None, None, None, 0.0

        def row() -> pd.DataFrame:
            return pd.DataFrame({"_k": [now[0]], "seg": [now[1]], "param": [v0], "e": [e0], "c": [c0]})

        for pdf in batches:
            for k, blk, e, c, v in zip(pdf["_k"], pdf["_blk"], pdf["e"], pdf["c"], pdf["param"]):
                if (k, blk) != now:
                    if now is not None:
                        yield row()
                    now, e0, c0, v0 = (k, blk), None, None, v
                if c is not None:
                    e0, c0 = None, list(c)
                elif c0 is not None:
                    c0 = p.apply(given(v), c0, list(e))
                else:
                    e0 = list(e) if e0 is None else p.compose(given(v), e0, list(e))
        if now is not None:
            yield row()

    kind = "_k string, seg bigint"
    if most < BLOCK:
        whole = items.withColumn("_blk", F.lit(0).cast("long")).withColumn("b", F.lit(None).cast("array<double>"))
        return _by_key(whole, "_k").sortWithinPartitions("_k", "seg").mapInPandas(starts, f"{kind}, at_start array<double>")
    cut = _by_key(items.withColumn("_blk", F.floor(F.col("seg") / BLOCK)), "_k", "_blk").sortWithinPartitions("_k", "_blk", "seg")
    composed = cut.mapInPandas(totals, f"{kind}, param double, e array<double>, c array<double>")
    above = _scan(composed, part, most // BLOCK, method, params, varied).select("_k", F.col("seg").alias("_blk"), F.col("at_start").alias("b"))
    met = _by_key(cut.join(above, ["_k", "_blk"]), "_k", "_blk").sortWithinPartitions("_k", "_blk", "seg")
    return met.mapInPandas(starts, f"{kind}, at_start array<double>")


def _begins(live: DataFrame, sure: DataFrame, heads: DataFrame, most: int, method: str, params: dict[str, Any] | None, varied: str | None) -> DataFrame:
    """``live`` (_k, seg, param, xs) with ``begin``, the state at each start.

    ``sure`` (_k, seg, c) has the ends of live segments that alarm, ``heads`` (_k, seg, param, c) the ends of the settled segments before them.
    """
    fresh = bl.start(method)
    ends = [len(fresh)] if method in bl.WINDOWED else PART_FIELDS[method]
    rows, lo = live, 0
    for part, hi in enumerate(ends):
        items = rows.select("_k", "seg", "param", _elements(rows, part, method, params, varied).alias("e")).join(sure, ["_k", "seg"], "left")
        got = kept(_scan(items.unionByName(heads, allowMissingColumns=True), part, most, method, params, varied))
        if method in bl.WINDOWED:
            state = F.col("at_start")
        else:  # earlier parts as found, this one as scanned, later ones as after a reset
            state = F.concat(F.slice("begin", 1, lo) if part else F.array().cast("array<double>"), F.slice("at_start", lo + 1, hi - lo),
                             F.array(*[F.lit(float(v)) for v in fresh[hi:]]).cast("array<double>"))
        rows = rows.join(got, ["_k", "seg"]).withColumn("begin", state).drop("at_start")
        lo = hi
    return rows


def _in_a_row(held: DataFrame, method: str, params: dict[str, Any] | None, varied: str | None) -> DataFrame:
    """(_k, seg, at, state) of keys whose segments lie in one task: read one after the other, a few segments in memory at a time.

    ``held`` (_k, seg, param, xs) may have ``head``, the state that a key starts from, and ``run`` (at, state), the run of each segment from
    a reset detector: behind an alarm that both have, they are the same.
    """
    given = _params(method, params, varied)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for pdf in batches:
            out = []
            for k, v, xs, head, fresh in zip(pdf["_k"], pdf["param"], pdf["xs"], pdf["head"], pdf["run"]):
                if k != now:
                    now, state = k, bl.start(method) if head is None else list(head)
                if fresh is None:
                    at, state = bl.trace(method, given(v), xs, state)
                else:
                    at, state = bl.joined_trace(method, given(v), xs, state, list(fresh["at"]), list(fresh["state"]))
                out.append((at, state))
            yield pd.DataFrame({"_k": pdf["_k"], "seg": pdf["seg"], "at": [x[0] for x in out], "state": [x[1] for x in out]})

    extra = {"head": "array<double>", "run": "struct<at: array<int>, state: array<double>>"}
    held = held.withColumns({c: F.lit(None).cast(kind) for c, kind in extra.items() if c not in held.columns})
    return held.sortWithinPartitions("_k", "seg").mapInPandas(run, "_k string, seg bigint, at array<int>, state array<double>")


def chained(
    packed: DataFrame, keys: Sequence[str], method: str, params: dict[str, Any] | None = None, varied: str | None = None,
    long: int | None = None, stored: bool = False,
) -> DataFrame:
    """Rows (keys, seg, at, state) of unbroken runs over segments (keys, seg, xs): alarm positions inside each segment and the state behind it.

    With ``varied``, the column ``param`` (one of the keys) holds the value of that parameter. Keys of fewer than ``long`` segments (LONG)
    are read through in a row. ``stored`` segments are read again instead of being stored once more.
    """
    rows, long_from = packed if stored else cut_lineage(packed), LONG if long is None else long
    most = rows.agg(F.max("seg")).first()[0] or 0
    if most == 0:
        return segment_runs(rows, method, params, varied).select(*keys, "seg", "run.at", "run.state")
    named = F.to_json(F.struct(*[F.col(k) for k in keys]), {"ignoreNullFields": "false"}) if keys else F.lit("{}")
    value = F.col("param").cast("double") if varied else F.lit(0.0)
    named_rows = rows.select(named.alias("_k"), F.col("seg").cast("long").alias("seg"), value.alias("param"), "xs")
    if most < long_from:
        short, settled = named_rows, None
    else:
        long = kept(named_rows.groupBy("_k").agg(F.max("seg").alias("_last")).where(F.col("_last") >= long_from).select("_k"))
        short = named_rows.join(long, "_k", "left_anti")
        settled = _side_by_side(named_rows.join(long, "_k", "left_semi"), most, method, params, varied)
    through = _in_a_row(_by_key(short, "_k"), method, params, varied)
    settled = through if settled is None else settled.unionByName(through)
    back = rows.select(*keys, F.col("seg").cast("long").alias("seg"), named.alias("_k"))
    return back.join(settled, ["_k", "seg"]).select(*keys, "seg", "at", "state")


def _side_by_side(long: DataFrame, most: int, method: str, params: dict[str, Any] | None, varied: str | None) -> DataFrame:
    """(_k, seg, at, state) of keys of any length: rounds of scans and runs while they settle at least half of what is left, then the rest in a row."""
    spark = long.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = cut_lineage(long.repartition(n, "_k", "seg"))  # kept by (_k, seg): the joins of the rounds bring small rows to the values
    known = spark.createDataFrame([], "_k string, seg bigint, state array<double>, alarmed boolean")
    heads = spark.createDataFrame([], "_k string, seg bigint, param double, c array<double>")
    live, settled = held, None
    while True:
        sure = known.where("alarmed").select("_k", "seg", F.col("state").alias("c"))
        run = segment_runs(_begins(live, sure, heads, most, method, params, varied), method, params, varied, "begin")
        now = kept(run.select("_k", "seg", "param", "run.at", "run.state", (F.size("run.at") > 0).alias("alarmed")))
        old = known.select("_k", "seg", F.col("alarmed").alias("was"), F.col("state").alias("gave"))
        other = (F.col("alarmed") != F.coalesce("was", F.lit(False))) | (F.col("alarmed") & ~F.col("state").eqNullSafe(F.col("gave")))
        seen = now.join(old, ["_k", "seg"], "left").groupBy("_k").agg(F.min(F.when(other, F.col("seg"))).alias("first"), F.max("seg").alias("last"))
        first = kept(seen.where("first < last").select("_k", "first"))
        met = now.join(first, "_k", "left")
        done = met.where("first IS NULL OR seg <= first").select("_k", "seg", "at", "state")  # it began right, so what it did is right
        settled = done if settled is None else settled.unionByName(done)
        ran, left = met.agg(F.count(F.lit(1)), F.count_if(F.col("seg") > F.col("first"))).first()
        if not left:
            break
        live = held.join(first, "_k").where("seg > first").drop("first")
        heads = met.where("seg = first").select("_k", "seg", "param", F.col("state").alias("c"))
        if 2 * left > ran:
            rest = segment_runs(live, method, params, varied).join(heads.select("_k", F.col("c").alias("head")), "_k")
            settled = settled.unionByName(_in_a_row(_by_key(rest, "_k"), method, params, varied))
            break
        known = met.where("seg > first").select("_k", "seg", "state", "alarmed")
    return settled


def end_state(chain: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, state): the state behind the last segment."""
    return chain.groupBy(*keys).agg(F.max_by("state", "seg").alias("state"))


def chained_alarms(packed: DataFrame, keys: Sequence[str], method: str, params: dict[str, Any] | None, horizon: int) -> DataFrame:
    """(keys, at): alarm positions over whole streams in segments of ``horizon`` values."""
    at = chained(packed, keys, method, params).select(*keys, "seg", F.explode("at").alias("_i"))
    return at.select(*keys, (F.col("seg") * horizon + F.col("_i")).cast("long").alias("at"))


def fold_state(method: str, state: str = "state") -> Column:
    """A state of a fold method as the struct that its native fold reads."""
    whole = ("n", "k", "last", "bn")
    fields = ", ".join(f"'{f}', {f'int({state}[{i}])' if f in whole else f'{state}[{i}]'}" for i, f in enumerate(bl.FIELDS[method]))
    return F.expr(f"named_struct({fields})")
