"""Unbroken runs over bounded segments: alarms and end states as if the values had been read in one go."""

import numpy as np
import pytest
from conftest import SF
from pyspark import TaskContext
from pyspark.sql import functions as F

from tidegauge.functions import blocks as bl
from tidegauge.functions import sequential as seq
from tidegauge.operators import chains
from tidegauge.operators import sequences as ops

CASES = [
    ("ddm", {"warm": 30, "drift": 2.0}), ("eddm", {"warm": 10}), ("hddm_w", {"conf": 0.01}), ("page_hinkley", {"threshold": 5.0}),
    ("adwin", {"delta": 0.3}), ("kswin", {"alpha": 0.01}), ("optwin", {"delta": 0.5, "min_len": 10}),
]


def streams():
    rng = np.random.default_rng(3)
    quiet = (rng.random(2600) < 0.2).astype(float)
    loud = np.concatenate([rng.random(900) < 0.1, rng.random(500) < 0.5, rng.random(700) < 0.2, rng.random(301) < 0.8]).astype(float)
    wild = (rng.random(1500) < np.abs(np.sin(np.arange(1500) / 40.0))).astype(float)
    return {"quiet": quiet, "loud": loud, None: wild, "short": loud[880:930]}


def packed(spark, horizon):
    rows = [(k, i + 1, float(x)) for k, xs in streams().items() for i, x in enumerate(xs)]
    return ops.segments(spark.createDataFrame(rows, "key string, rn long, x double"), ["key"], F.col("x"), horizon)


@pytest.mark.parametrize("long", [0, 256])
@pytest.mark.parametrize("method,params", CASES)
def test_long_keys_are_unbroken_traces(spark, monkeypatch, method, params, long):
    monkeypatch.setattr(chains, "LONG", long)
    chain = chains.chained(packed(spark, 500), ["key"], method, params).collect()
    p = seq.settings(method, params)
    for key, xs in streams().items():
        want, end = bl.trace(method, p, xs)
        rows = sorted((r for r in chain if r["key"] == key), key=lambda r: r["seg"])
        assert [r["seg"] for r in rows] == list(range(-(-len(xs) // 500)))
        assert [500 * r["seg"] + a for r in rows for a in r["at"]] == want
        assert rows[-1]["state"] == pytest.approx(end, rel=1e-9, abs=1e-9)


def test_a_key_without_resets_takes_one_round(spark, monkeypatch):
    xs = (np.random.default_rng(4).random(20_000) < 0.2).astype(float)
    rows = spark.createDataFrame([("k", i + 1, float(x)) for i, x in enumerate(xs)], "key string, rn long, x double")
    segments = ops.segments(rows, ["key"], F.col("x"), 20)  # a thousand segments
    rounds, begins = [], chains._begins
    monkeypatch.setattr(chains, "_begins", lambda *a: rounds.append(1) or begins(*a))
    for method, params in (("ddm", {"drift": 9.0}), ("hddm_w", {"conf": 1e-9}), ("page_hinkley", {"threshold": 1e5}), ("adwin", {"delta": 1e-9})):
        rounds.clear()
        chain = chains.chained(segments, ["key"], method, params)
        assert len(rounds) == 1 and chain.where("size(at) > 0").count() == 0
        assert chains.end_state(chain, ["key"]).first()["state"] == pytest.approx(bl.trace(method, seq.settings(method, params), xs)[1], rel=1e-9, abs=1e-9)


def test_a_key_with_many_resets_takes_few_rounds(spark, monkeypatch):
    xs = (np.random.default_rng(5).random(12_000) < 0.3).astype(float)
    rows = spark.createDataFrame([("k", i + 1, float(x)) for i, x in enumerate(xs)], "key string, rn long, x double")
    segments = ops.segments(rows, ["key"], F.col("x"), 40)  # three hundred segments, most of them with an alarm
    rounds, begins = [], chains._begins
    monkeypatch.setattr(chains, "_begins", lambda *a: rounds.append(1) or begins(*a))
    for method, params in (("ddm", {"warm": 10, "drift": 1.5}), ("hddm_w", {"conf": 0.1})):
        rounds.clear()
        got = chains.chained_alarms(segments, ["key"], method, params, 40).collect()
        want = bl.trace(method, seq.settings(method, params), xs)[0]
        assert len(want) > 100 and sorted(r["at"] for r in got) == want
        assert len(rounds) <= 2


def test_keys_stay_in_one_task_where_a_join_becomes_a_broadcast(spark):
    """Rows of a key met by a small table: planned as a sorted merge by the key, run as a broadcast that reads its shuffle as it was written."""
    confs = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
        "spark.sql.adaptive.nonEmptyPartitionRatioForBroadcastJoin": "0", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for key, value in confs.items():
        spark.conf.set(key, value)
    try:
        live = spark.range(0, 4000, 1, 8).selectExpr("concat('k', id % 5) AS _k", "id AS seg", "repeat('x', 200) AS xs")
        heads = spark.range(5).selectExpr("concat('k', id) AS _k", "id AS head")
        held = chains._by_key(live.join(heads, "_k"), "_k").sortWithinPartitions("_k", "seg")
        rows = held.mapInPandas(lambda parts: (p[["_k", "seg"]].assign(task=TaskContext.get().partitionId()) for p in parts), "_k string, seg long, task int").collect()
    finally:
        for key in confs:
            spark.conf.unset(key)
    assert len(rows) == 4000 and len({(r["_k"], r["task"]) for r in rows}) == 5


@pytest.mark.parametrize("method,params", CASES)
def test_runs_join_behind_a_common_alarm(method, params):
    p, xs = seq.settings(method, params), streams()["loud"]
    for cut in (200, 931, 1500):
        begin = bl.trace(method, p, xs[:cut])[1]
        fresh, end = bl.trace(method, p, xs[cut:])
        got = bl.joined_trace(method, p, xs[cut:], begin, fresh, end)
        want = bl.trace(method, p, xs[cut:], begin)
        assert got[0] == want[0] and got[1] == pytest.approx(want[1], rel=1e-9, abs=1e-9)


def test_blocks_of_segments_are_composed(spark, monkeypatch):
    monkeypatch.setattr(chains, "BLOCK", 3)
    monkeypatch.setattr(chains, "LONG", 0)
    for method, params in (("hddm_w", {"conf": 0.01}), ("adwin", {"delta": 0.3})):
        got = chains.chained_alarms(packed(spark, 400), ["key"], method, params, 400).collect()
        for key, xs in streams().items():
            assert sorted(r["at"] for r in got if r["key"] == key) == bl.trace(method, seq.settings(method, params), xs)[0]


def test_grids_run_side_by_side(spark):
    xs = streams()["loud"]
    rows = spark.createDataFrame([(i + 1, float(x)) for i, x in enumerate(xs)], "rn long, x double")
    grid = spark.createDataFrame([(0, 1.5), (1, 3.0)], "idx int, param double")
    segments = ops.segments(rows, [], F.col("x"), 100).crossJoin(F.broadcast(grid))
    end = chains.end_state(chains.chained(segments, ["idx", "param"], "ddm", {"warm": 20}, "drift"), ["idx", "param"])
    for r in end.withColumn("fold", chains.fold_state("ddm")).collect():
        want = bl.trace("ddm", seq.settings("ddm", {"warm": 20, "drift": r["param"]}), xs)[1]
        assert r["state"] == pytest.approx(want, rel=1e-9) and r["fold"]["n"] == want[0]


SELECTIONS = ("calibration_rate", "config_fpr_select", "config_power_select")


@pytest.mark.parametrize("name", SELECTIONS)
def test_selections_of_fold_methods_equal_sql(spark, duck, name):
    from check import compare

    from tidegauge.plans import trials

    folded = getattr(trials, name)(spark, SF).where(F.col("method").isin(list(seq.FOLDS)))
    assert compare(folded, duck, trials.FOLDED_SQL[name]) is None


def test_selections_of_window_methods_by_brute_force(spark):
    """Every candidate of the window methods run value by value over the same windows."""
    from tidegauge.plans import trials

    p = trials.Pools(spark, SF)
    calibration = [float(r["level"] >= trials.LEVEL) for r in p.cal.orderBy("idx").collect()]
    still = [r["xs"] for r in p.stationary(p.k // 100, trials.WSIZE).collect()]
    plan = trials.smp.window_plan(spark, p.c // 250, trials.WSIZE, trials.POWER_RATIOS, p.c, p.d, 6)
    moved = [([float(v >= trials.LEVEL) for v in r["clean_level"]], [float(v >= trials.LEVEL) for v in r["drift_level"]], r["ratio"])
             for r in trials.smp.materialize(plan, p.both(), ["ratio", "window_id", "n_clean", "n_drift"], ["level"]).collect()]
    rates, chosen, powered = {}, {}, {}
    for method in bl.WINDOWED:
        rows = []
        for i, v in enumerate(seq.GRIDS[method][1]):
            given = {**seq.settings(method, seq.GRID_BASE.get(method)), seq.GRIDS[method][0]: v}
            warm = bl.trace(method, given, calibration)[1]
            fpr = float(np.mean([bool(bl.trace(method, given, xs, warm, most=1)[0]) for xs in still]))
            by_ratio = {}
            for clean, drift, ratio in moved:
                behind = bl.trace(method, given, clean, warm)[1]
                by_ratio.setdefault(ratio, []).append(bool(bl.trace(method, given, drift, behind, most=1)[0]))
            rows.append((i, v, fpr, float(np.mean([np.mean(h) for h in by_ratio.values()]))))
            rates[method, i] = round(fpr, 6)
        good = [r for r in rows if r[2] <= 0.05]
        chosen[method] = (good or sorted(rows, key=lambda r: (r[2], r[0])))[0][0]
        able = [r for r in rows if r[2] <= 0.5]
        powered[method] = max(able, key=lambda r: (r[3], r[2], -r[0]))[0] if able else None
    got = trials.calibration_rate(spark, SF).collect()
    assert {r["method"] for r in got} == set(seq.GRIDS) and {(r["method"], r["idx"]): r["fpr"] for r in got if r["method"] in bl.WINDOWED} == pytest.approx(rates, abs=1e-6)
    assert {r["method"]: r["selected_index"] for r in trials.config_fpr_select(spark, SF).collect() if r["method"] in bl.WINDOWED} == chosen
    assert {r["method"]: r["selected_index"] for r in trials.config_power_select(spark, SF).collect() if r["method"] in bl.WINDOWED} == powered


WINDOWS = {  # heads and tails of odd shapes, some with missing values
    "short": ([76, 72, 64, 0, 5], [4, 8, 16, 80, 75]), "long": ([120, 0], [200, 300]),
}


@pytest.mark.parametrize("method", list(seq.GRIDS))
def test_windows_of_all_candidates_at_once(spark, method):
    """Every candidate over every window as one detector after the other finds them: native folds, or window methods value by value."""
    rng, (varied, grid), base = np.random.default_rng(11), seq.GRIDS[method], seq.GRID_BASE.get(method)
    fixed, values = seq.settings(method, base), [float(v) for v in seq.GRIDS[method][1]]
    warm = (rng.random(700) < 0.3).astype(float)
    states = [bl.trace(method, {**fixed, varied: v}, warm)[1] for v in values]
    for broken in (False, True):
        rows = []
        for name, (heads, tails) in WINDOWS.items():
            for a, b in [] if broken and name == "long" else list(zip(heads, tails)) * 3:  # trace tests many ticks part by part, and a gap counts for its part
                rows.append(((rng.random(a) < rng.random()).astype(float).tolist(), (rng.random(b) < rng.random()).astype(float).tolist()))
        if broken:
            for i, (head, tail) in enumerate(rows):
                part = head if i % 2 and head else tail
                part[int(rng.integers(len(part)))] = None
        nan = [([np.nan if v is None else v for v in a], [np.nan if v is None else v for v in b]) for a, b in rows]
        got = bl.first_alarms(method, fixed, varied, values, states, [a for a, _ in nan], [b for _, b in nan])
        if method in bl.WINDOWED:
            want = [[(bl.trace(method, {**fixed, varied: v}, b, bl.trace(method, {**fixed, varied: v}, a, s)[1], most=1)[0] or [0])[0]
                     for v, s in zip(values, states)] for a, b in nan]
        else:
            f = seq.fold(method, {**(base or {}), varied: "param"})
            frame = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "w int, a array<double>, b array<double>")
            tried = spark.createDataFrame([(i, v, s) for i, (v, s) in enumerate(zip(values, states))], "idx int, param double, state array<double>")
            both = frame.crossJoin(F.broadcast(tried.withColumn("state", chains.fold_state(method))))
            found = {(r["w"], r["idx"]): r["delay"] or 0 for r in both.select("w", "idx", seq.onset_detection(f, "a", "b", "state")["delay"].alias("delay")).collect()}
            want = [[found[w, i] for i in range(len(values))] for w in range(len(rows))]
        assert got.tolist() == want and (broken or got.any())


@pytest.mark.parametrize("method", ["ddm", "hddm_w", "page_hinkley"])
def test_unknown_states_never_alarm(spark, method):
    """A missing value of the warm-up makes fields of the state NULL on their way through Arrow."""
    varied, grid = seq.GRIDS[method]
    state = [None if np.isnan(v) else v for v in bl.trace(method, seq.settings(method), [0.0, 1.0] * 30 + [np.nan] + [0.0] * 5)[1]]
    frame = spark.createDataFrame([([1.0, 0.0] * 20, [1.0] * 20, state, float(grid[0]))], "a array<double>, b array<double>, state array<double>, param double")
    found = seq.onset_detection(seq.fold(method, {varied: "param"}), "a", "b", "state")["delay"]
    assert None in state and frame.withColumn("state", chains.fold_state(method)).select(found.alias("d")).first()["d"] is None
    assert bl.first_alarms(method, seq.settings(method), varied, [grid[0]], [state], [[1.0, 0.0] * 20], [[1.0] * 20]).tolist() == [[0]]


def test_power_selection_warms_each_candidate_once_in_a_row(spark, monkeypatch):
    from tidegauge.plans import trials
    from tidegauge.plans.streams import SEGMENT_KEY

    monkeypatch.setattr(chains, "LONG", 2)  # a calibration signal of many times as many segments
    runs, rounds, chained, begins = [], [], chains.chained, chains._begins
    monkeypatch.setattr(chains, "chained", lambda *a, **k: runs.append(a[2]) or chained(*a, **k))
    monkeypatch.setattr(chains, "_begins", lambda *a: rounds.append(1) or begins(*a))
    want = trials.config_power_select(spark, SF).collect()
    spark.conf.set(SEGMENT_KEY, "20")
    try:
        runs.clear()
        got = trials.config_power_select(spark, SF).collect()
    finally:
        spark.conf.unset(SEGMENT_KEY)
    assert sorted(runs) == sorted(seq.GRIDS) and not rounds
    assert {r["method"]: (r["status"], r["selected_index"]) for r in got} == {r["method"]: (r["status"], r["selected_index"]) for r in want}


SEGMENTED = ["alarm_trace", "eddm_trace", "hddm_w", "page_hinkley", "adwin", "kswin", "warm_state", "detects_in_window"]


@pytest.mark.parametrize("name", SEGMENTED)
def test_twins_over_short_segments(spark, duck, name):
    from check import compare

    from tidegauge.plans import load_all
    from tidegauge.plans.registry import QUERIES, TWINS
    from tidegauge.plans.streams import SEGMENT_KEY

    load_all()
    spark.conf.set(SEGMENT_KEY, "50")
    try:
        assert compare(QUERIES[name](spark, SF), duck, TWINS[name]) is None
    finally:
        spark.conf.unset(SEGMENT_KEY)
