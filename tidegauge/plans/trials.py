"""Signals, calibration of sequential detectors and change-point trials on the event stream.

Losses are event values. A digest of the id halves them into calibration and test rows; test rows are the clean pool, and
those at or above the 0.70 calibration level form the degrading pool.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.core.session import cut_lineage, row_budget, scratch_path, table
from tidegauge.functions import blocks as bl
from tidegauge.functions import sequential as seq
from tidegauge.operators import chains
from tidegauge.operators import sampling as smp
from tidegauge.operators import sequences as ops
from tidegauge.operators import signals as sig
from tidegauge.plans import fold_sql as fs
from tidegauge.plans.registry import query
from tidegauge.plans.samples import draw_sql
from tidegauge.plans.streams import SEGMENT_KEY, SEGMENT_ROWS

CLEAN, AFTER, LEVEL = 100, 60, 0.70
IN_A_ROW = 1 << 26  # calibration values that one task reads through for a candidate; the segments of longer signals run side by side
FORMATS = {"click": "mcq", "view": "yes_no", "signup": "open_short", "purchase": "caption", "error": "binary"}

SIG_SQL = """ev AS (SELECT event_id, event_type, value, ('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT % 2 = 0 AS cal FROM events),
lv AS (SELECT *, (SELECT count(*) FROM ev c WHERE c.cal) AS ncal,
  sum(cal::INT) OVER (ORDER BY value RANGE UNBOUNDED PRECEDING) AS below FROM ev),
sg AS (SELECT event_id, event_type, value, cal, below::DOUBLE / ncal AS level FROM lv)"""

POOLS_SQL = f"""{SIG_SQL},
cp AS (SELECT level, event_id, row_number() OVER (ORDER BY md5('clean:' || event_id), event_id) - 1 AS idx FROM sg WHERE NOT cal),
dp AS (SELECT level, event_id, row_number() OVER (ORDER BY md5('drift:' || event_id), event_id) - 1 AS idx FROM sg WHERE NOT cal AND level >= {LEVEL}),
kp AS (SELECT level, event_id, row_number() OVER (ORDER BY md5('cal:' || event_id), event_id) - 1 AS idx FROM sg WHERE cal),
ct AS (SELECT (SELECT count(*) FROM cp) AS c, (SELECT count(*) FROM dp) AS d, (SELECT count(*) FROM kp) AS k)"""

TRIALS_SQL = f"""{POOLS_SQL},
tr AS (SELECT unnest(range((SELECT c // 250 FROM ct))) AS trial),
plan AS (SELECT trial, slot, CASE WHEN slot < {CLEAN} THEN 'clean' ELSE 'drift' END AS source,
  CASE WHEN slot < {CLEAN} THEN {draw_sql('trial', 'slot', '(SELECT c FROM ct)', 3, 0)}
  ELSE {draw_sql('trial', f'slot - {CLEAN}', '(SELECT d FROM ct)', 3, 1)} END AS pool_idx FROM tr, (SELECT unnest(range({CLEAN + AFTER})) AS slot)),
tv AS (SELECT trial, slot, source, coalesce(cp.level, dp.level) AS level, coalesce(cp.event_id, dp.event_id) AS event_id FROM plan
  LEFT JOIN cp ON source = 'clean' AND cp.idx = pool_idx LEFT JOIN dp ON source = 'drift' AND dp.idx = pool_idx)"""

CALSEQ_SQL = f"""cseq AS (SELECT 0 AS k, idx + 1 AS pos, (level >= {LEVEL})::INT::DOUBLE AS x FROM kp)"""


def signals(spark, sf) -> DataFrame:
    ev = table(spark, sf, "events", "event_id", "event_type", "value").withColumn(
        "cal", smp.hex_int(F.substring(F.md5(F.col("event_id").cast("string")), 1, 8)) % 2 == 0
    )
    return sig.ecdf(ev.where("cal"), ev, [], "value")


class Pools:
    """Clean, degrading and calibration pools with draw indices and their sizes."""

    def __init__(self, spark, sf):
        # stored once: every pool and trial reads these rows
        rows = cut_lineage(signals(spark, sf).select("event_id", "cal", "level"))
        test = rows.where(~F.col("cal"))
        sizes = rows.agg(
            F.sum((~F.col("cal")).cast("int")).alias("c"),
            F.sum((~F.col("cal") & (F.col("level") >= LEVEL)).cast("int")).alias("d"),
            F.sum(F.col("cal").cast("int")).alias("k"),
        ).first()
        self.c, self.d, self.k = sizes["c"], sizes["d"], sizes["k"]
        self.spark, self._packed, self._tried = spark, None, None
        self.clean = smp.pool_index(test, "event_id", "clean", rows=self.c)
        self.drift = smp.pool_index(test.where(F.col("level") >= LEVEL), "event_id", "drift", rows=self.d)
        self.cal = smp.pool_index(rows.where("cal"), "event_id", "cal", rows=self.k)

    def both(self) -> DataFrame:
        cols = ["event_id", "level", F.col("idx").alias("pool_idx")]
        a = self.clean.select(F.lit("clean").alias("source"), *cols)
        return a.unionByName(self.drift.select(F.lit("drift").alias("source"), *cols))

    def plan(self) -> DataFrame:
        turns = {"_c": smp.draw_turns(F.col("trial"), 3, 0), "_d": smp.draw_turns(F.col("trial"), 3, 1)}
        trials = self.spark.range(self.c // 250).withColumnRenamed("id", "trial").withColumns(turns)
        slots = trials.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(CLEAN + AFTER - 1))))
        clean = F.col("slot") < CLEAN
        idx = F.when(clean, smp.draw_index(F.col("trial"), F.col("slot"), self.c, turns=F.col("_c"))).otherwise(
            smp.draw_index(F.col("trial"), F.col("slot") - CLEAN, self.d, turns=F.col("_d"))
        )
        return slots.select("trial", "slot", F.when(clean, "clean").otherwise("drift").alias("source"), idx.alias("pool_idx"))

    def trials(self) -> DataFrame:
        """One row per trial: arrays of calibration levels before and after the change."""
        return smp.materialize(self.plan(), self.both(), ["trial"], ["level"])

    def warm(self, method: str, params: dict | None = None, grid: DataFrame | None = None) -> DataFrame:
        """State of a detector after the whole calibration signal, one row or one per row (idx, param) of the grid.

        The signal stays in bounded segments; the grid is a few fixed rows.
        """
        if self._packed is None:  # stored once: every method and candidate reads it
            events = self.cal.select((F.col("idx") + 1).alias("rn"), sig.binarize(F.col("level"), LEVEL, True).cast("double").alias("x"))
            self._packed = cut_lineage(ops.segments(events, [], F.col("x"), row_budget(self.spark, SEGMENT_KEY, SEGMENT_ROWS)))
        packed, keys, varied, long = self._packed, [], None, None
        if grid is not None:  # the candidates already run side by side
            packed, keys, varied = packed.join(F.broadcast(grid)), ["idx", "param"], seq.GRIDS[method][0]
            long = max(chains.LONG, IN_A_ROW // row_budget(self.spark, SEGMENT_KEY, SEGMENT_ROWS))
        out = chains.end_state(chains.chained(packed, keys, method, params, varied, long, stored=True), keys)
        return out.withColumn("state", chains.fold_state(method)) if method in seq.FOLDS else out

    def tried(self, method: str) -> list[tuple[int, float, list[float]]]:
        """Warmed candidates of a method (index, setting, state), for the closures of tasks: a few rows, each at most a window of values.

        All methods are warmed in one job and once, whatever reads them.
        """
        if self._tried is None:
            self._tried = {m: [] for m in seq.GRIDS}
            rows = None
            for m in seq.GRIDS:
                state = F.array(*[F.col("state")[f].cast("double") for f in bl.FIELDS[m]]) if m in seq.FOLDS else F.col("state")
                part = warmed(self, m).select("method", "idx", "param", state.alias("state"))
                rows = part if rows is None else rows.unionByName(part)
            for r in sorted(rows.collect(), key=lambda r: r["idx"]):
                self._tried[r["method"]].append((r["idx"], r["param"], r["state"]))
        return self._tried[method]

    def stationary(self, windows: int, size: int) -> DataFrame:
        plan = smp.stationary_plan(self.spark, windows, size, self.k, 4)
        drawn = plan.hint("merge").join(self.cal.select(F.col("idx").alias("pool_idx"), "level"), "pool_idx")
        packed = F.array_sort(F.collect_list(F.struct("slot", sig.binarize(F.col("level"), LEVEL, True).cast("double").alias("x"))))
        return drawn.groupBy("window_id").agg(F.transform(packed, lambda r: r["x"]).alias("xs"))


def spread(windows: DataFrame) -> DataFrame:
    """Windows stored once, over as many parts as a shuffle has: every method reads them, and each row stands for a run of every candidate."""
    return cut_lineage(windows.repartition(int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def events_of(levels: str) -> str:
    return f"transform({levels}, v -> double(v >= {LEVEL}D))"


def warmed(p: Pools, method: str) -> DataFrame:
    """State after calibration for each candidate setting: a handful of rows, one per grid value."""
    grid = p.spark.createDataFrame([(i, float(v)) for i, v in enumerate(seq.GRIDS[method][1])], "idx int, param double")
    states = p.warm(method, seq.GRID_BASE.get(method), grid)
    return states.select(F.lit(method).alias("method"), "idx", "param", "state")


def candidate(p: Pools, method: str):
    """(first alarm in an array, first alarm in a second array behind a first one) of every warmed candidate of a method, as columns of arrays, 0 where none."""
    fixed, name = seq.settings(method, seq.GRID_BASE.get(method)), seq.GRIDS[method][0]
    values, states = [v for _, v, _ in p.tried(method)], [s for _, _, s in p.tried(method)]

    @F.pandas_udf("array<int>")
    def first(clean: pd.Series, drift: pd.Series) -> pd.Series:
        return pd.Series(list(bl.first_alarms(method, fixed, name, values, states, list(clean), list(drift))))

    nothing = "cast(array() AS array<double>)"
    return (lambda xs: first(F.expr(nothing), F.expr(xs))), (lambda clean, drift: first(F.expr(clean), F.expr(drift)))


def tries(p: Pools, windows: DataFrame, method: str, first: Column, *cols: str) -> DataFrame:
    """(method, idx, param, cols, hit): one row per window and candidate, given the column of the candidates' first alarms."""
    idx, param = (F.array(*[F.lit(r[i]) for r in p.tried(method)]).cast(f"array<{kind}>") for i, kind in enumerate(("int", "double")))
    each = windows.select(*cols, F.posexplode(first).alias("_i", "_at"))
    return each.select(F.lit(method).alias("method"), F.get(idx, F.col("_i")).alias("idx"), F.get(param, F.col("_i")).alias("param"), *cols,
                       (F.col("_at") > 0).cast("double").alias("hit"))


def onset_rows(p: Pools, method: str, params: dict) -> DataFrame:
    f = seq.fold(method, params)
    warm = p.warm(method, params)
    rows = p.trials().join(F.broadcast(warm))  # one row
    both = seq.onset_detection(f, events_of("clean_level"), events_of("drift_level"), "state")
    return rows.select("trial", both.alias("o")).select("trial", "o.prechange", "o.delay")


# ------------------------------------------------------------------ signal queries


@query("ecdf", f"WITH {SIG_SQL} SELECT event_id, round(level, 6) AS level FROM sg")
def ecdf(spark, sf):
    return signals(spark, sf).select("event_id", F.round("level", 6).alias("level"))


FMT_SQL = """ev AS (SELECT event_id, value, ('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT % 2 = 0 AS cal,
  CASE event_type WHEN 'click' THEN 'closed_set' WHEN 'view' THEN 'closed_set' WHEN 'signup' THEN 'open_short' WHEN 'purchase' THEN 'long_generation' ELSE 'binary' END AS grp FROM events),
ref AS (SELECT grp, value FROM ev WHERE cal AND grp <> 'binary' UNION ALL SELECT '__all__', value FROM ev WHERE cal AND grp <> 'binary'),
q AS (SELECT event_id, value, cal, grp, CASE WHEN grp IN (SELECT grp FROM ref) THEN grp ELSE '__all__' END AS rg FROM ev),
u AS (SELECT rg, value, event_id, grp, 0 AS w FROM q WHERE NOT cal UNION ALL SELECT grp, value, NULL, NULL, 1 FROM ref),
r AS (SELECT *, sum(w) OVER (PARTITION BY rg ORDER BY value RANGE UNBOUNDED PRECEDING) AS below, sum(w) OVER (PARTITION BY rg) AS n FROM u)"""


def format_rows(spark, sf) -> DataFrame:
    """Test rows scored against calibration rows; the calibration part has no rows of the binary format."""
    fmt = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    ev = table(spark, sf, "events", "event_id", "event_type", "value").withColumn("format", fmt[F.col("event_type")])
    ev = ev.withColumn("cal", smp.hex_int(F.substring(F.md5(F.col("event_id").cast("string")), 1, 8)) % 2 == 0)
    return sig.format_ecdf(ev.where(F.col("cal") & (F.col("format") != "binary")), ev.where(~F.col("cal")), "format", "value")


@query("format_ecdf", f"""WITH {FMT_SQL}
SELECT event_id, grp AS "group", rg = '__all__' AS fallback, round(below::DOUBLE / n, 6) AS level FROM r WHERE w = 0""")
def format_ecdf(spark, sf):
    return format_rows(spark, sf).select("event_id", "group", "fallback", F.round("level", 6).alias("level"))


@query("join_fallback_group", f"""WITH {FMT_SQL}
SELECT grp AS "group", count(*) AS missing FROM r WHERE w = 0 AND rg = '__all__' GROUP BY 1""")
def join_fallback_group(spark, sf):
    return sig.fallback_counts(format_rows(spark, sf))


@query("degrading_filter", f"WITH {SIG_SQL} SELECT event_id, value FROM sg WHERE NOT cal AND level >= {LEVEL}")
def degrading_filter(spark, sf):
    return signals(spark, sf).where(~F.col("cal") & (F.col("level") >= LEVEL)).select("event_id", "value")


@query("binarize_event", f"""WITH {SIG_SQL}
SELECT event_id, (level >= 0.7)::INT AS degrading_event, (level > 0.95)::INT AS heterogeneous_event FROM sg""")
def binarize_event(spark, sf):
    lv = F.col("level")
    return signals(spark, sf).select(
        "event_id", sig.binarize(lv, LEVEL, True).alias("degrading_event"), sig.binarize(lv, 0.95, False).alias("heterogeneous_event")
    )


# ------------------------------------------------------------------ trials


@query("trial_indices", f"WITH {TRIALS_SQL} SELECT trial, slot, source, event_id FROM tv")
def trial_indices(spark, sf):
    p = Pools(spark, sf)
    return p.plan().join(p.both(), ["source", "pool_idx"]).select("trial", "slot", "source", "event_id")


@query("materialize_window", f"""WITH {TRIALS_SQL}
SELECT trial, string_agg((level >= {LEVEL})::INT::VARCHAR, '' ORDER BY slot) AS bits, round(avg(level), 6) AS mean_level FROM tv GROUP BY 1""")
def materialize_window(spark, sf):
    w = F.concat("clean_level", "drift_level")
    bits = F.array_join(F.transform(w, lambda v: (v >= LEVEL).cast("int").cast("string")), "")
    mean = F.aggregate(w, F.lit(0.0), lambda s, x: s + x) / F.size(w)
    return Pools(spark, sf).trials().select("trial", bits.alias("bits"), F.round(mean, 6).alias("mean_level"))


FOLDED = {"ddm": fs.ddm(30, "k.param"), "eddm": fs.eddm(30, "k.param"), "hddm_w": fs.hddm_w("k.param", 0.05), "page_hinkley": fs.page_hinkley("k.param")}


def warm_sql(m: str) -> str:
    """CTE ``m_warm``: state of each candidate of a method after the whole calibration signal."""
    rows = ", ".join(f"({i}, {float(v)}::DOUBLE)" for i, v in enumerate(seq.GRIDS[m][1]))
    return f"""{m}_grid(idx, param) AS (VALUES {rows}),
{m}_gseq AS (SELECT {{'idx': idx, 'param': param}} AS k, pos, x FROM cseq, {m}_grid),
{fs.fold_sql(*FOLDED[m], name=f'{m}_gw', seq=f'{m}_gseq')},
{m}_warm AS (SELECT * EXCLUDE (pos, alarm) FROM {m}_gw WHERE pos = (SELECT k FROM ct))"""


def from_warm(m: str, source: str, name: str) -> str:
    return fs.fold_sql(*FOLDED[m], seq=source, name=name, start=f"JOIN (SELECT k AS wk, * EXCLUDE (k) FROM {m}_warm) ON wk.idx = q.k.idx")


@query("warm_state", f"""WITH RECURSIVE {POOLS_SQL}, {CALSEQ_SQL}, {warm_sql('ddm')}
SELECT 'ddm' AS method, k.idx AS idx, k.param AS param, n, round(mean, 6) AS mean,
  round(CASE WHEN isinf(best) THEN -1 ELSE best END, 6) AS best FROM ddm_warm""")
def warm_state(spark, sf):
    s = F.col("state")
    best = F.when(s["best"] == float("inf"), -1.0).otherwise(s["best"])
    return warmed(Pools(spark, sf), "ddm").select(
        "method", "idx", "param", s["n"].alias("n"), F.round(s["mean"], 6).alias("mean"), F.round(best, 6).alias("best")
    )


WSIZE = 80
STAT_SQL = f"""sw AS (SELECT unnest(range((SELECT k // 100 FROM ct))) AS window_id),
sv AS (SELECT window_id, slot, (level >= {LEVEL})::INT::DOUBLE AS x FROM (SELECT window_id, slot, {draw_sql('window_id', 'slot', '(SELECT k FROM ct)', 4, 2)} AS pool_idx
  FROM sw, (SELECT unnest(range({WSIZE})) AS slot)) JOIN kp ON kp.idx = pool_idx)"""
HD_WARM = f"""{fs.fold_sql(*fs.hddm_w(0.05, 0.05), name='hw', seq='cseq')},
hwarm AS (SELECT * EXCLUDE (k, pos, alarm) FROM hw WHERE pos = (SELECT k FROM ct))"""
HW = {"conf": 0.05, "lam": 0.05}


@query("detects_in_window", f"""WITH RECURSIVE {POOLS_SQL}, {CALSEQ_SQL}, {HD_WARM}, {STAT_SQL},
wseq AS (SELECT window_id AS k, slot + 1 AS pos, x FROM sv),
{fs.fold_sql(*fs.hddm_w(0.05, 0.05), seq='wseq', start=', hwarm')}
SELECT k AS window_id, min(CASE WHEN alarm THEN pos END)::INT AS first_alarm FROM f GROUP BY 1""")
def detects_in_window(spark, sf):
    p = Pools(spark, sf)
    f = seq.fold("hddm_w", HW)
    warm = p.warm("hddm_w", HW)
    rows = p.stationary(p.k // 100, WSIZE).join(F.broadcast(warm))  # one row
    return rows.select("window_id", seq.first_detection(f, "xs", "state").alias("first_alarm"))


ONSET_SQL = f"""{TRIALS_SQL}, {CALSEQ_SQL}, {HD_WARM},
tseq AS (SELECT trial AS k, slot + 1 AS pos, (level >= {LEVEL})::INT::DOUBLE AS x FROM tv),
{fs.fold_sql(*fs.hddm_w(0.05, 0.05), seq='tseq', start=', hwarm')},
onset AS (SELECT k AS trial, count(*) FILTER (alarm AND pos <= {CLEAN})::INT AS prechange,
  min(CASE WHEN alarm AND pos > {CLEAN} THEN pos - {CLEAN} END)::INT AS delay FROM f GROUP BY 1)"""


@query("detects_after_onset", f"WITH RECURSIVE {ONSET_SQL} SELECT trial, prechange, delay FROM onset")
def detects_after_onset(spark, sf):
    return onset_rows(Pools(spark, sf), "hddm_w", HW)


def trial_traces(spark, sf) -> DataFrame:
    """Delay after onset plus alarm windows (last 20 of the clean part, every 10) of one method and seed."""
    p = Pools(spark, sf)
    f = seq.fold("hddm_w", HW)
    warm = p.warm("hddm_w", HW)
    rows = p.trials().join(F.broadcast(warm))  # one row
    clean = events_of("clean_level")
    ends = F.sequence(F.lit(20), F.lit(CLEAN), F.lit(10))
    at = seq.alarm_trace(f, clean, "state")
    out = rows.select("trial", "drift_level", "clean_level", "state", at.alias("at"))
    hits = F.filter(ends, lambda e: F.exists("at", lambda a: (a <= e) & (a > e - 20)))
    onset = seq.onset_detection(f, clean, events_of("drift_level"), "state")
    return out.select(
        "trial", onset["delay"].alias("delay"), onset["prechange"].alias("prechange"), F.size(hits).alias("alarm_windows"),
        F.size(ends).alias("windows"),
    )


BUDGETS = [10, 20, 40]
TRACE_SQL = f"""{ONSET_SQL}, ends AS (SELECT unnest(range(20, {CLEAN + 1}, 10)) AS e),
aw AS (SELECT trial, count(*) AS windows, count(*) FILTER (hit) AS alarm_windows FROM (SELECT t.trial, e, EXISTS (SELECT 1 FROM f
  WHERE f.k = t.trial AND f.alarm AND f.pos <= e AND f.pos > e - 20) AS hit FROM (SELECT DISTINCT trial FROM tv) t, ends) GROUP BY 1),
traces AS (SELECT * FROM onset JOIN aw USING (trial))"""


@query("trace_summary", f"""WITH RECURSIVE {TRACE_SQL}
SELECT 'hddm_w' AS method, count(*) AS trials, round(avg(coalesce(delay, {AFTER})), 6) AS mean_delay_censored,
  round(avg((delay IS NULL)::INT), 6) AS miss_rate, sum(alarm_windows) AS alarm_windows, sum(windows) AS windows,
  round(sum(alarm_windows) / sum(windows), 6) AS fpr, round(avg((coalesce(delay <= 10, false))::INT), 6) AS r10,
  round(avg((coalesce(delay <= 20, false))::INT), 6) AS r20, round(avg((coalesce(delay <= 40, false))::INT), 6) AS r40,
  round(avg((coalesce(delay <= {AFTER}, false))::INT), 6) AS r{AFTER} FROM traces""")
def trace_summary(spark, sf):
    rows = trial_traces(spark, sf).withColumn("method", F.lit("hddm_w"))
    out = sig.trial_summary(rows, ["method"], AFTER, BUDGETS)
    rounded = ["mean_delay_censored", "miss_rate", "fpr", *[f"r{b}" for b in (*BUDGETS, AFTER)]]
    return out.select("method", "trials", "alarm_windows", "windows", *[F.round(c, 6).alias(c) for c in rounded])


@query("delay_budget", f"""WITH RECURSIVE {ONSET_SQL}, b AS (SELECT unnest([10, 20, 40, 60]) AS budget)
SELECT budget, round(avg(coalesce(delay <= budget, false)::INT), 6) AS recall, round(avg((prechange > 0)::INT), 6) AS prechange_rate,
  round(avg(CASE WHEN delay <= budget THEN delay ELSE least(budget, {AFTER}) END), 6) AS censored_delay FROM onset, b GROUP BY 1""")
def delay_budget(spark, sf):
    rows = onset_rows(Pools(spark, sf), "hddm_w", HW)
    out = sig.budget_recall(rows, [], [10, 20, 40, 60], F.lit(AFTER))
    return out.select("budget", *[F.round(c, 6).alias(c) for c in ("recall", "prechange_rate", "censored_delay")])


RATIOS = [0.0, 0.1, 0.2, 0.5]
SHAPES = ", ".join(f"({r}::DOUBLE, {WSIZE - round(WSIZE * r)}, {round(WSIZE * r)})" for r in RATIOS)
RATIO_SQL = f"""{POOLS_SQL}, {CALSEQ_SQL}, {HD_WARM}, shapes(ratio, n_clean, n_drift) AS (VALUES {SHAPES}),
rs AS (SELECT ratio, window_id, slot, n_clean, n_drift, window_id + round(ratio * 1000)::BIGINT * 7 AS ww FROM
  (SELECT unnest(range((SELECT c // 250 FROM ct))) AS window_id), shapes, (SELECT unnest(range({WSIZE})) AS slot)),
rp AS (SELECT *, CASE WHEN slot < n_clean THEN {draw_sql('ww', 'slot', '(SELECT c FROM ct)', 6, 0)}
  ELSE {draw_sql('ww', 'slot - n_clean', '(SELECT d FROM ct)', 6, 1)} END AS pool_idx FROM rs),
rseq AS (SELECT {{'ratio': ratio, 'w': window_id, 'nc': n_clean, 'nd': n_drift}} AS k, slot + 1 AS pos, (coalesce(cp.level, dp.level) >= {LEVEL})::INT::DOUBLE AS x
  FROM rp LEFT JOIN cp ON slot < n_clean AND cp.idx = pool_idx LEFT JOIN dp ON slot >= n_clean AND dp.idx = pool_idx),
{fs.fold_sql(*fs.hddm_w(0.05, 0.05), seq='rseq', start=', hwarm')},
res AS (SELECT k.ratio AS ratio, k.w AS window_id, k.nd AS n_drift, k.nc AS n_clean,
  count(*) FILTER (alarm AND pos <= k.nc) AS pre, min(CASE WHEN alarm AND (k.nd = 0 OR pos > k.nc) THEN pos - CASE WHEN k.nd = 0 THEN 0 ELSE k.nc END END) AS delay FROM f GROUP BY ALL)"""


def ratio_results(spark, sf) -> DataFrame:
    """Per window: first alarm (ratio 0) or alarm after onset with pre-change alarms (contiguous tail)."""
    p = Pools(spark, sf)
    f = seq.fold("hddm_w", HW)
    warm = p.warm("hddm_w", HW)
    plan = smp.window_plan(spark, p.c // 250, WSIZE, RATIOS, p.c, p.d, 6)
    rows = smp.materialize(plan, p.both(), ["ratio", "window_id", "n_clean", "n_drift"], ["level"]).join(F.broadcast(warm))  # one row
    clean, drift = events_of("clean_level"), events_of("drift_level")
    onset = seq.onset_detection(f, clean, drift, "state")
    alone = F.struct(F.lit(0).alias("prechange"), seq.first_detection(f, clean, "state").alias("delay"))
    out = F.when(F.col("n_drift") > 0, onset).otherwise(alone)
    return rows.select("ratio", "window_id", "n_clean", "n_drift", out.alias("o")).select(
        "ratio", "window_id", "n_clean", "n_drift", "o.prechange", "o.delay"
    )


@query("eval_ratio_traces", f"""WITH RECURSIVE {RATIO_SQL}
SELECT ratio, count(*) AS windows, round(avg((delay IS NOT NULL)::INT), 6) AS rate,
  round(avg(CASE WHEN n_drift > 0 THEN coalesce(delay, n_drift) END), 6) AS censored_delay,
  round(avg(CASE WHEN n_drift > 0 THEN (pre > 0)::INT END), 6) AS prechange_rate FROM res GROUP BY 1""")
def eval_ratio_traces(spark, sf):
    drifted = F.col("n_drift") > 0
    return ratio_results(spark, sf).groupBy("ratio").agg(
        F.count(F.lit(1)).alias("windows"), F.round(F.avg(F.col("delay").isNotNull().cast("double")), 6).alias("rate"),
        F.round(F.avg(F.when(drifted, F.coalesce("delay", "n_drift"))), 6).alias("censored_delay"),
        F.round(F.avg(F.when(drifted, (F.col("prechange") > 0).cast("double"))), 6).alias("prechange_rate"),
    )


@query("constant_delay_rows", f"""WITH RECURSIVE {RATIO_SQL}
SELECT ratio, max(n_drift)::INT AS contiguous_delay, {WSIZE} AS shuffled_delay, count(*) AS windows FROM res WHERE ratio > 0 GROUP BY 1""")
def constant_delay_rows(spark, sf):
    """Delays of a detector that decides at the window's end, from the stored results of its windows: n_drift behind a contiguous
    tail, the whole window where the drift is shuffled in."""
    out = scratch_path(spark, "runs")
    ratio_results(spark, sf).write.json(out)
    runs = spark.read.schema("ratio double, window_id bigint, n_clean int, n_drift int").json(out).where("ratio > 0")
    size = (F.col("n_clean") + F.col("n_drift")).cast("int")
    return runs.groupBy("ratio").agg(
        F.max("n_drift").alias("contiguous_delay"), F.max(size).alias("shuffled_delay"), F.count(F.lit(1)).alias("windows")
    )


def fpr_sql(m: str) -> str:
    return f"""{warm_sql(m)},
{m}_fseq AS (SELECT {{'idx': idx, 'param': param, 'w': window_id}} AS k, slot + 1 AS pos, x FROM sv, {m}_grid),
{from_warm(m, f'{m}_fseq', f'{m}_f')},
{m}_det AS (SELECT k.idx AS idx, k.param AS param, k.w AS w, bool_or(alarm) AS hit FROM {m}_f GROUP BY 1, 2, 3),
{m}_cand AS (SELECT '{m}' AS method, idx, param, avg(hit::INT) AS fpr FROM {m}_det GROUP BY 2, 3)"""


def stacked(suffix: str) -> str:
    return " UNION ALL ".join(f"SELECT * FROM {m}_{suffix}" for m in FOLDED)


FPR_SQL = f"""{POOLS_SQL}, {CALSEQ_SQL}, {STAT_SQL},
{", ".join(fpr_sql(m) for m in FOLDED)},
cand AS ({stacked('cand')})"""


def calibration_rows(p: Pools) -> DataFrame:
    """Alarm rate of every candidate of every method on stationary windows."""
    windows, out = spread(p.stationary(p.k // 100, WSIZE)), None
    for method in seq.GRIDS:
        part = tries(p, windows, method, candidate(p, method)[0]("xs"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("method", "idx", "param").agg(F.avg("hit").alias("fpr"))


# SQL of the rows of the four fold methods; the window methods are checked by brute force in the tests
FOLDED_SQL = {"calibration_rate": f"WITH RECURSIVE {FPR_SQL} SELECT method, idx, param, round(fpr, 6) AS fpr FROM cand"}


@query("calibration_rate")
def calibration_rate(spark, sf):
    return calibration_rows(Pools(spark, sf)).withColumn("fpr", F.round("fpr", 6))


FOLDED_SQL["config_fpr_select"] = f"""WITH RECURSIVE {FPR_SQL}
SELECT method, idx AS selected_index, param, round(fpr, 6) AS fpr FROM (SELECT *, row_number() OVER (PARTITION BY method
  ORDER BY CASE WHEN fpr <= 0.05 THEN 0 ELSE 1 END, CASE WHEN fpr <= 0.05 THEN 0 ELSE fpr END, idx) AS r FROM cand) WHERE r = 1"""


@query("config_fpr_select")
def config_fpr_select(spark, sf):
    return sig.pick_by_fpr(calibration_rows(Pools(spark, sf)), 0.05).withColumn("fpr", F.round("fpr", 6))


POWER_RATIOS = [0.05, 0.1, 0.2]
POWER_SHAPES = ", ".join(f"({r}::DOUBLE, {WSIZE - round(WSIZE * r)}, {round(WSIZE * r)})" for r in POWER_RATIOS)


def power_sql(m: str) -> str:
    return f"""{m}_pseq AS (SELECT {{'idx': idx, 'param': param, 'ratio': ratio, 'w': window_id, 'nc': n_clean}} AS k, pos, x FROM psig, {m}_grid),
{from_warm(m, f'{m}_pseq', f'{m}_pf')},
{m}_pw AS (SELECT '{m}' AS method, idx, avg(rate) AS power FROM (SELECT idx, ratio, avg(hit::INT) AS rate FROM
  (SELECT k.idx AS idx, k.ratio AS ratio, k.w AS w, bool_or(alarm AND pos > k.nc) AS hit FROM {m}_pf GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 2)"""


POWER_SQL = f"""{FPR_SQL}, pshapes(ratio, n_clean, n_drift) AS (VALUES {POWER_SHAPES}),
ps AS (SELECT ratio, window_id, slot, n_clean, n_drift, window_id + round(ratio * 1000)::BIGINT * 7 AS ww FROM
  (SELECT unnest(range((SELECT c // 250 FROM ct))) AS window_id), pshapes, (SELECT unnest(range({WSIZE})) AS slot)),
pp AS (SELECT *, CASE WHEN slot < n_clean THEN {draw_sql('ww', 'slot', '(SELECT c FROM ct)', 6, 0)}
  ELSE {draw_sql('ww', 'slot - n_clean', '(SELECT d FROM ct)', 6, 1)} END AS pool_idx FROM ps),
psig AS (SELECT ratio, window_id, n_clean, slot + 1 AS pos, (coalesce(cp.level, dp.level) >= {LEVEL})::INT::DOUBLE AS x
  FROM pp LEFT JOIN cp ON slot < n_clean AND cp.idx = pool_idx LEFT JOIN dp ON slot >= n_clean AND dp.idx = pool_idx),
{", ".join(power_sql(m) for m in FOLDED)},
pw AS ({stacked('pw')})"""


FOLDED_SQL["config_power_select"] = f"""WITH RECURSIVE {POWER_SQL},
r AS (SELECT method, idx, power, fpr, fpr <= 0.5 AS ok, row_number() OVER (PARTITION BY method ORDER BY fpr <= 0.5 DESC, power DESC, fpr DESC, idx) AS k FROM cand JOIN pw USING (method, idx))
SELECT method, CASE WHEN ok THEN 'selected' ELSE 'not_calibratable' END AS status, CASE WHEN ok THEN idx END AS selected_index,
  round(CASE WHEN ok THEN power END, 6) AS power, round(CASE WHEN ok THEN fpr END, 6) AS fpr FROM r WHERE k = 1"""


@query("config_power_select")
def config_power_select(spark, sf):
    """Per method the candidate with the highest validation power (mean over drift ratios) within the target rate."""
    p = Pools(spark, sf)
    plan = smp.window_plan(spark, p.c // 250, WSIZE, POWER_RATIOS, p.c, p.d, 6)
    windows, out = spread(smp.materialize(plan, p.both(), ["ratio", "window_id", "n_clean", "n_drift"], ["level"])), None
    for method in seq.GRIDS:
        part = tries(p, windows, method, candidate(p, method)[1](events_of("clean_level"), events_of("drift_level")), "ratio")
        out = part if out is None else out.unionByName(part)
    power = out.groupBy("method", "idx", "ratio").agg(F.avg("hit").alias("h")).groupBy("method", "idx").agg(F.avg("h").alias("power"))
    best = sig.pick_by_power(calibration_rows(p).join(power, ["method", "idx"]), 0.5)
    return best.select("method", "status", "selected_index", F.round("power", 6).alias("power"), F.round("fpr", 6).alias("fpr"))
