"""Streaming queries: each runs the stream over the table files to completion and returns its sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.core.session import row_budget, table
from tidegauge.operators import sampling as smp
from tidegauge.operators import vectors as vec
from tidegauge.plans.registry import TWINS, query
from tidegauge.plans.samples import EMB_SQL, vector_pool
from tidegauge.plans.streams import KSWIN, OPTWIN
from tidegauge.plans.trials import LEVEL, SIG_SQL
from tidegauge.plans.vectors import CAL_ONLY_SQL, DIM, EPS, HALF, MODEL_SQL, Q, STREAM_SQL, Setup, score_sql
from tidegauge.streaming import live

VALUES = 8_000_000  # numbers in the vectors of one micro-batch


def is_error():
    return F.col("event_type") == "error"


METHODS = {  # settings and signal of each live method: those of its batch trace
    "ddm": ({"warm": 10, "drift": 1.5}, "error"), "eddm": ({"warm": 4, "beta": 0.9}, "error"), "hddm_w": ({"conf": 0.1}, "error"),
    "page_hinkley": ({"threshold": 50.0}, "value"), "adwin": ({"delta": 0.9, "clock": 4, "min_len": 5, "grace": 15, "step": 1}, "error"),
    "kswin": (KSWIN, "value"), "optwin": (OPTWIN, "value"),
}


def live_alarms(spark, sf, method):
    """Alarms of one method over the replayed events."""
    params, signal = METHODS[method]
    x = is_error().cast("double") if signal == "error" else F.col("value")
    ev = table(spark, sf, "events", "user_id", "ts", "event_id", "event_type", "value")
    build = lambda stream: live.detector_alarms(stream, "user_id", ["ts", "event_id"], x, method, params)
    return live.run_replay(ev, "user_id", ["ts", "event_id"], build)[0].select("user_id", "at")


@query("stream_detector", TWINS["alarm_trace"])
def stream_detector(spark, sf):
    return live_alarms(spark, sf, "ddm")


def _each_method() -> None:
    for method, trace in (("eddm", "eddm_trace"), ("hddm_w", "hddm_w"), ("page_hinkley", "page_hinkley"), ("adwin", "adwin"), ("kswin", "kswin"), ("optwin", None)):
        query(f"stream_{method}", TWINS.get(trace))(lambda spark, sf, method=method: live_alarms(spark, sf, method))


_each_method()


@query("stream_window_score", f"""WITH {EMB_SQL},
{STREAM_SQL},
{MODEL_SQL},
o AS (SELECT stream, label, z, row_number() OVER (PARTITION BY stream, label ORDER BY vec_id) AS rn, count(*) OVER (PARTITION BY stream, label) AS n FROM
  (SELECT r.vec_id, r.label, 'A' AS stream, v[1:{HALF}] AS z FROM ranked r)),
ends AS (SELECT DISTINCT stream, label, rn AS endpoint FROM o WHERE rn >= 20 AND rn % 10 = 0),
wz AS (SELECT e.stream, e.label, e.endpoint, i, avg(o.z[i + 1]) AS m FROM ends e JOIN o ON o.label = e.label AND o.rn > e.endpoint - 20 AND o.rn <= e.endpoint, dims GROUP BY ALL),
wd AS (SELECT wz.stream, label, endpoint, list(wz.m - mu.m ORDER BY i) AS d FROM wz JOIN mu USING (stream, i) GROUP BY ALL),
{score_sql('wd', 'label, endpoint', 'sc')}
SELECT label, endpoint, round(score, 6) AS score FROM sc""")
def stream_window_score(spark, sf):
    """Count windows of 20 vectors every 10 per label, scored against the fitted first stream."""
    pool = vector_pool(spark, sf).withColumn("A", F.slice(F.col("embedding").cast("array<double>"), 1, HALF))
    model = vec.fit_pca(pool.where("split = 'fit'"), "A", HALF, HALF)
    vs = table(spark, sf, "embeddings").select("label", "vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, HALF).alias("A"))
    build = lambda stream: live.window_scores(stream, "label", "vec_id", "A", model, EPS, 20, 10)
    out, _ = live.run_replay(vs, "label", ["vec_id"], build, row_budget(spark, live.BATCH_KEY, max(1, VALUES // HALF)))
    return out.select("label", "endpoint", F.round("score", 6).alias("score"))


@query("stream_fused_alarm", f"""{CAL_ONLY_SQL},
thr AS (SELECT stream, quantile_cont(score, {Q}) AS threshold FROM calscores GROUP BY 1),
o AS (SELECT stream, label, z, row_number() OVER (PARTITION BY stream, label ORDER BY vec_id) AS rn FROM
  (SELECT r.vec_id, r.label, st.stream, v[s * {HALF} + 1:s * {HALF} + {HALF}] AS z FROM ranked r, st)),
ends AS (SELECT DISTINCT stream, label, rn AS endpoint FROM o WHERE rn >= 20 AND rn % 10 = 0),
wz AS (SELECT e.stream, e.label, e.endpoint, i, avg(o.z[i + 1]) AS m FROM ends e JOIN o ON o.stream = e.stream AND o.label = e.label AND o.rn > e.endpoint - 20 AND o.rn <= e.endpoint, dims GROUP BY ALL),
wd AS (SELECT wz.stream, label, endpoint, list(wz.m - mu.m ORDER BY i) AS d FROM wz JOIN mu USING (stream, i) GROUP BY ALL),
{score_sql('wd', 'label, endpoint', 'sc')},
nz AS (SELECT label, endpoint, score / greatest(threshold, 1e-12) AS norm FROM sc JOIN thr USING (stream))
SELECT label, endpoint, round(max(norm), 6) AS max_norm, round(avg(norm), 6) AS mean_norm, sum((norm > 1)::INT)::BIGINT AS votes, max(norm) > 1 AS alarm FROM nz GROUP BY 1, 2""")
def stream_fused_alarm(spark, sf):
    """Both streams joined by uid as they come, scored in count windows per label and fused with the calibrated thresholds.

    Event time is the id in seconds, far from the epoch: rows at or before it count as late from the start.
    """
    s = Setup(spark, sf)
    limits = {r["stream"]: r["threshold"] for r in s.limits().collect()}  # one row per stream
    v = F.col("embedding").cast("array<double>")
    rows = table(spark, sf, "embeddings", "label", "vec_id", "embedding").select(
        "label", "vec_id", F.timestamp_seconds(F.col("vec_id") + 1_000_000_000).alias("at"), F.slice(v, 1, HALF).alias("A"), F.slice(v, HALF + 1, HALF).alias("B"))

    def build(stream):
        both = live.joined_streams({"A": stream, "B": stream}, "vec_id", "at", ["label"], "60 SECONDS")
        return live.fused_alarms(both, "label", "vec_id", s.models, limits, EPS, 20, 10)

    out, _ = live.run_replay(rows, "label", ["vec_id"], build, row_budget(spark, live.BATCH_KEY, max(1, VALUES // DIM)))
    return out.select("label", "endpoint", F.round("max_norm", 6).alias("max_norm"), F.round("mean_norm", 6).alias("mean_norm"), "votes", "alarm")


@query("stream_error_rate", """SELECT date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS "end", count(*) AS n, sum((event_type = 'error')::INT) AS errors FROM events
GROUP BY 1, 2""")
def stream_error_rate(spark, sf):
    rates, _ = live.error_rate(live.stream_parquet(spark, sf, "events", 64 << 20), spark, "ts", is_error(), "1 day")
    return rates.select(F.col("start").cast("timestamp_ntz"), F.col("end").cast("timestamp_ntz"), "n", "errors")


@query("batch_error_rate", """SELECT date_trunc('day', ts) AS start, count(*) AS n, sum((event_type = 'error')::INT) AS errors FROM events GROUP BY 1""")
def batch_error_rate(spark, sf):
    """Batch twin of the event-time error rate, all windows."""
    w = F.window("ts", "1 day")
    ev = table(spark, sf, "events", "ts", "event_type")
    return ev.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(is_error().cast("int")).alias("errors")).select(F.col("w.start").alias("start"), "n", "errors")


@query("stream_ecdf_binarize", f"WITH {SIG_SQL} SELECT event_id, (level >= {LEVEL})::INT AS event FROM sg")
def stream_ecdf_binarize(spark, sf):
    cal = table(spark, sf, "events", "event_id", "value").where(smp.hex_int(F.substring(F.md5(F.col("event_id").cast("string")), 1, 8)) % 2 == 0)
    cuts = live.level_cut(cal, [], "value", LEVEL)
    out = live.binarize_live(live.stream_parquet(spark, sf, "events"), cuts, "value").select("event_id", "event")
    return live.run_to_table(out, spark)[0]


@query("stream_resume", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_resume(spark, sf):
    """The same query started twice on one progress folder: the second start finds nothing left to score."""
    def start():
        return live.unseen(live.stream_parquet(spark, sf, "events", 64 << 20), "event_id").select("event_id", "event_type")

    _, base = live.run_to_table(start(), spark)
    out, _ = live.run_to_table(start(), spark, base)
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
