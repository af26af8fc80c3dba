"""Event-stream queries: count windows, alarms, running detector levels and sequential traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.core.scan import with_sizes
from tidegauge.core.session import row_budget, table
from tidegauge.functions import blocks as bl
from tidegauge.operators import chains
from tidegauge.operators import sequences as ops
from tidegauge.plans import fold_sql as fs
from tidegauge.plans.registry import query

KEY = ["user_id"]


def is_error():
    return F.col("event_type") == "error"

SEGMENT_KEY, SEGMENT_ROWS = "spark.tidegauge.trace.segmentRows", 5000  # values per array of a trace; results do not depend on it
NUMBERED = """e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
  count(*) OVER (PARTITION BY user_id) AS cnt FROM events)"""


def numbered(spark: SparkSession, sf: str) -> DataFrame:
    return ops.event_positions(table(spark, sf, "events", "event_id", "ts", "user_id", "event_type", "value"))


@query("count_tumbling", f"""WITH {NUMBERED}
SELECT user_id, (rn - 1) // 20 AS window_id, count(*) AS n, round(avg(value), 6) AS mean_value,
  sum((event_type = 'error')::INT) AS errors
FROM e GROUP BY 1, 2 HAVING count(*) = 20""")
def count_tumbling(spark, sf):
    aggs = [F.round(F.avg("value"), 6).alias("mean_value"), F.sum(is_error().cast("int")).alias("errors")]
    return ops.tumbling(numbered(spark, sf), KEY, 20, aggs)


@query("count_sliding", f"""WITH {NUMBERED},
w AS (SELECT user_id, rn AS endpoint, sum(value) OVER s AS total, sum((event_type = 'error')::INT) OVER s AS errors
  FROM e WINDOW s AS (PARTITION BY user_id ORDER BY rn ROWS 29 PRECEDING))
SELECT user_id, endpoint, round(total / 30, 6) AS mean_value, errors FROM w
WHERE endpoint >= 30 AND (endpoint - 30) % 10 = 0""")
def count_sliding(spark, sf):
    w = ops.sliding_sums(numbered(spark, sf), KEY, 30, 10, {"total": F.col("value"), "errors": is_error().cast("int")})
    return w.select("user_id", "endpoint", F.round(F.col("total") / 30, 6).alias("mean_value"), "errors")


ALARM_WINDOWS = f"""{NUMBERED},
c AS (SELECT user_id, rn, sum((event_type = 'error' AND value > 10)::INT) OVER (PARTITION BY user_id ORDER BY rn) AS cum FROM e),
w AS (SELECT user_id, rn AS endpoint, cum - coalesce(lag(cum, 20) OVER (PARTITION BY user_id ORDER BY rn), 0) AS alarms FROM c)"""


@query("windows_with_alarm", f"""WITH {ALARM_WINDOWS}
SELECT user_id, endpoint, alarms, alarms > 0 AS has_alarm FROM w WHERE endpoint >= 20 AND (endpoint - 20) % 5 = 0""")
def windows_with_alarm(spark, sf):
    return ops.windows_with_alarm(numbered(spark, sf), KEY, is_error() & (F.col("value") > 10), 20, 5)


@query("first_alarm", f"""WITH {ALARM_WINDOWS}
SELECT user_id, min(CASE WHEN alarms >= 4 THEN endpoint END) AS first_alarm, count(*) AS checkpoints
FROM w WHERE endpoint >= 20 AND (endpoint - 20) % 5 = 0 GROUP BY user_id""")
def first_alarm(spark, sf):
    return ops.first_alarm(windows_with_alarm(spark, sf), KEY, F.col("alarms") >= 4)


@query("running_var", """SELECT user_id, event_id, count(*) OVER w AS n, round(sum(value) OVER w, 4) AS total,
  round(sqrt(coalesce(var_samp(value) OVER w, 0.0)), 6) AS std
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def running_var(spark, sf):
    ran = ops.running_moments(table(spark, sf, "events", "event_id", "ts", "user_id", "value"), KEY, "value")
    return ran.select("user_id", "event_id", "n", F.round(F.col("mean") * F.col("n"), 4).alias("total"), F.round(F.sqrt("variance"), 6).alias("std"))


@query("ddm", """WITH p AS (SELECT user_id, n, e::DOUBLE / n AS p FROM (SELECT user_id,
    row_number() OVER w AS n, sum((event_type = 'error')::INT) OVER w AS e
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))),
s AS (SELECT *, sqrt(p * (1 - p) / n) AS s FROM p),
b AS (SELECT *, min(CASE WHEN n > 30 THEN {'ps': p + s, 'late': -n, 'p': p, 's': s} END)
  OVER (PARTITION BY user_id ORDER BY n) AS best FROM s)
SELECT user_id, count(*) AS n, round(max_by(p, n), 6) AS final_rate,
  min(CASE WHEN p + s > best.p + 2.0 * best.s THEN n END) AS first_warning_level,
  min(CASE WHEN p + s > best.p + 3.0 * best.s THEN n END) AS first_drift
FROM b GROUP BY user_id""")
def ddm(spark, sf):
    lv = ops.ddm_levels(table(spark, sf, "events", "event_id", "ts", "user_id", "event_type"), KEY, is_error())
    return lv.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.max_by("p", "n"), 6).alias("final_rate"),
        F.min(F.when(F.col("warning") | F.col("drift"), F.col("n"))).alias("first_warning_level"),
        F.min(F.when(F.col("drift"), F.col("n"))).alias("first_drift"),
    )


@query("eddm", f"""WITH {NUMBERED},
d AS (SELECT user_id, rn, rn - coalesce(lag(rn) OVER w, 0) AS d, row_number() OVER w AS k FROM e
  WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id ORDER BY rn)),
v AS (SELECT *, sum(d * d) OVER (PARTITION BY user_id ORDER BY rn) AS s2 FROM d),
s AS (SELECT *, CASE WHEN rn > 5 AND k >= 2 THEN rn / k + 2.0 * sqrt(greatest((s2 - rn * rn / k) / (k - 1), 0.0)) END AS score FROM v),
b AS (SELECT *, max(score) OVER (PARTITION BY user_id ORDER BY rn) AS best FROM s)
SELECT user_id, count(*) AS errors, round(max(best), 6) AS best_score,
  min(CASE WHEN k > 5 AND score < best AND score / best < 0.9 THEN rn END) AS first_drift
FROM b GROUP BY user_id""")
def eddm(spark, sf):
    lv = ops.eddm_levels(
        table(spark, sf, "events", "event_id", "ts", "user_id", "event_type"), KEY, is_error(), warm_start=5
    )
    return lv.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("errors"),
        F.round(F.max("best"), 6).alias("best_score"),
        F.min(F.when(F.col("drift"), F.col("rn"))).alias("first_drift"),
    )


@query("ewma", f"""WITH RECURSIVE {NUMBERED}, seq AS (SELECT user_id AS k, rn AS pos, value AS x FROM e),
{fs.fold_sql({"n": "0", "t": "0.0::DOUBLE", "ibc": "1.0::DOUBLE"},
  [{"t": "CASE WHEN n = 0 THEN x ELSE 0.05::DOUBLE * x + 0.95::DOUBLE * t END",
    "ibc": "0.05::DOUBLE * 0.05::DOUBLE + 0.95::DOUBLE * 0.95::DOUBLE * ibc", "n": "n + 1"}, {"alarm": "false"}])}
SELECT k AS user_id, n::BIGINT AS n, round(t, 6) AS ewma, round(ibc, 9) AS ibc FROM f
WHERE pos = (SELECT count(*) FROM events WHERE user_id = f.k)""")
def ewma(spark, sf):
    out = ops.ewma_state(numbered(spark, sf), KEY, "value", 0.05)
    return out.select("user_id", "n", F.round("ewma", 6).alias("ewma"), F.round("ibc", 9).alias("ibc"))


def whole_trace(spark, sf, method, params, value=None) -> DataFrame:
    """Alarm positions per user over the unbroken stream."""
    rows = row_budget(spark, SEGMENT_KEY, SEGMENT_ROWS)
    packed = ops.segments(numbered(spark, sf), KEY, is_error().cast("double") if value is None else value, rows)
    return chains.chained_alarms(packed, KEY, method, params, rows)


def trace_twin(spec, x="(event_type = 'error')::INT::DOUBLE") -> str:
    return f"""WITH RECURSIVE {NUMBERED},
seq AS (SELECT user_id AS k, rn AS pos, {x} AS x FROM e),
{fs.fold_sql(*spec)}
SELECT k AS user_id, pos::BIGINT AS "at" FROM f WHERE alarm"""


@query("alarm_trace", trace_twin(fs.ddm(10, "1.5")))
def alarm_trace(spark, sf):
    return whole_trace(spark, sf, "ddm", {"warm": 10, "drift": 1.5})


@query("eddm_trace", trace_twin(fs.eddm(4, "0.9")))
def eddm_trace(spark, sf):
    return whole_trace(spark, sf, "eddm", {"warm": 4, "beta": 0.9})


@query("hddm_w", trace_twin(fs.hddm_w(0.1, 0.05)))
def hddm_w(spark, sf):
    return whole_trace(spark, sf, "hddm_w", {"conf": 0.1})


@query("page_hinkley", trace_twin(fs.page_hinkley("50.0"), "value"))
def page_hinkley(spark, sf):
    return whole_trace(spark, sf, "page_hinkley", {"threshold": 50.0}, F.col("value"))


@query("page_hinkley_up", trace_twin(fs.page_hinkley("20.0", mode="up"), "value"))
def page_hinkley_up(spark, sf):
    """Alarms on a rise only."""
    return whole_trace(spark, sf, "page_hinkley", {"threshold": 20.0, "mode": "up"}, F.col("value"))


@query("page_hinkley_down", trace_twin(fs.page_hinkley("20.0", mode="down"), "value"))
def page_hinkley_down(spark, sf):
    """Alarms on a fall only."""
    return whole_trace(spark, sf, "page_hinkley", {"threshold": 20.0, "mode": "down"}, F.col("value"))


@query("adwin", trace_twin(fs.adwin(0.9, 4, 5, 15, 400, 1)))
def adwin(spark, sf):
    return whole_trace(spark, sf, "adwin", {"delta": 0.9, "clock": 4, "min_len": 5, "grace": 15, "step": 1})


KSWIN = {"alpha": 0.2, "window": 40, "stat": 12, "clock": 2}
KS_TABLE = [bl.ks_equal_pvalue(k, KSWIN["stat"]) for k in range(1, KSWIN["stat"] + 1)]


@query("kswin", trace_twin(fs.kswin(**KSWIN, pvalues=KS_TABLE, mult=bl.kswin_step(KSWIN["window"] - KSWIN["stat"])), "value"))
def kswin(spark, sf):
    return whole_trace(spark, sf, "kswin", KSWIN, F.col("value"))


OPTWIN = {"delta": 0.9, "min_len": 5, "clock": 1, "step": 1, "max_window": 100, "f_test": 0, "two_sided": 1}


@query("optwin")
def optwin(spark, sf):
    return whole_trace(spark, sf, "optwin", OPTWIN, F.col("value"))


PHASED = f"""{NUMBERED},
ph AS (SELECT *, CASE WHEN rn <= least(cnt, ceil(cnt / 30.0 * 12.5)) THEN 'before' ELSE 'after' END AS phase FROM e)"""


def phased(spark, sf) -> DataFrame:
    """Ready index ceil(rate * ready) per user: events per day over a 30-day horizon, ready after 12.5 days."""
    rows = with_sizes(numbered(spark, sf), KEY, "cnt")
    ready = F.least(F.col("cnt"), F.ceil(F.col("cnt") / 30.0 * 12.5))
    return rows.withColumn("ready", ready).withColumn("phase", F.when(F.col("rn") <= ready, "before").otherwise("after"))


@query("phase_tag", f"""WITH {PHASED}
SELECT user_id, phase, count(*) AS n, min(rn) AS first_rn, round(avg(value), 6) AS mean_value FROM ph GROUP BY 1, 2""")
def phase_tag(spark, sf):
    return phased(spark, sf).groupBy("user_id", "phase").agg(
        F.count(F.lit(1)).alias("n"), F.min("rn").alias("first_rn"), F.round(F.avg("value"), 6).alias("mean_value")
    )


@query("phase_gaussian_smooth", f"""WITH {PHASED},
z AS (SELECT user_id, phase, row_number() OVER (PARTITION BY user_id, phase ORDER BY rn) - 1 AS pos,
  count(*) OVER (PARTITION BY user_id, phase) AS m, (event_type = 'error')::INT::DOUBLE AS v FROM ph),
kk AS (SELECT k, exp(-0.5 * (k / 15.0) ** 2) AS w FROM (SELECT unnest(range(-60, 61)) AS k)),
i AS (SELECT z.user_id, z.phase, z.pos, w, ((z.pos + k) % (2 * m) + 2 * m) % (2 * m) AS q, m FROM z, kk),
j AS (SELECT *, CASE WHEN q >= m THEN 2 * m - 1 - q ELSE q END AS src FROM i)
SELECT j.user_id, j.phase, j.pos, round(sum(j.w * z.v) / (SELECT sum(w) FROM kk), 6) AS v_smooth
FROM j JOIN z ON z.user_id = j.user_id AND z.phase = j.phase AND z.pos = j.src GROUP BY 1, 2, 3""")
def phase_gaussian_smooth(spark, sf):
    rows = phased(spark, sf)
    before = F.col("phase") == "before"
    rows = rows.select(
        "user_id", "phase",
        F.when(before, F.col("rn") - 1).otherwise(F.col("rn") - F.col("ready") - 1).alias("pos"),
        F.when(before, F.col("ready")).otherwise(F.col("cnt") - F.col("ready")).alias("m"),
        is_error().cast("double").alias("v"),
    )
    out = ops.phase_smooth(rows, ["user_id", "phase"], "pos", "m", "v")
    return out.withColumn("v_smooth", F.round("v_smooth", 6))


@query("block_means", f"""WITH {NUMBERED}
SELECT user_id, (rn - 1) // 10 AS block, count(*) AS n, round(avg((event_type = 'error')::INT), 6) AS mean
FROM e GROUP BY 1, 2""")
def block_means(spark, sf):
    rows = numbered(spark, sf)
    return rows.groupBy("user_id", F.floor((F.col("rn") - 1) / 10).alias("block")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(is_error().cast("int")), 6).alias("mean")
    )


@query("step_timeline", """WITH r AS (SELECT o_orderpriority AS load, 0.2 + (o_custkey % 60) / 97.0 AS inference,
  CASE WHEN o_orderstatus <> 'P' THEN 3.0 + o_orderkey % 400 END AS ready FROM orders),
b AS (SELECT DISTINCT load, t FROM (SELECT load, unnest([0.0, 3.0, 300.0]) AS t FROM r
  UNION ALL SELECT load, least(ready, 300.0) FROM r WHERE ready IS NOT NULL))
SELECT b.load, b.t::DOUBLE AS time_s,
  round(avg(CASE WHEN ready IS NOT NULL AND t < 3 THEN 1.0 ELSE inference END), 6) AS inference,
  round(avg(CASE WHEN ready IS NOT NULL AND t >= 3 AND t < ready THEN 1 - inference ELSE 0 END), 6) AS retraining,
  round(1 - avg(CASE WHEN ready IS NOT NULL AND t < 3 THEN 1.0 ELSE inference END)
    - avg(CASE WHEN ready IS NOT NULL AND t >= 3 AND t < ready THEN 1 - inference ELSE 0 END), 6) AS idle
FROM b JOIN r ON r.load = b.load GROUP BY b.load, b.t""")
def step_timeline(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    inf = 0.2 + (F.col("o_custkey") % 60) / 97.0
    rows = o.select(
        F.col("o_orderpriority").alias("load"), inf.alias("inference"), (1 - inf).alias("residual"),
        F.when(F.col("o_orderstatus") != "P", 3.0 + F.col("o_orderkey") % 400).alias("ready"),
    )
    out = ops.share_timeline(rows, "load", 3.0, 300.0)
    return out.select("load", "time_s", *[F.round(c, 6).alias(c) for c in ("inference", "retraining", "idle")])
