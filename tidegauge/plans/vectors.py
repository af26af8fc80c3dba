"""Feature-vector queries: two 32-dimensional streams from the embeddings, drift pool shifted by +0.1 per dimension."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidegauge.core.scan import exact_quantiles, positions
from tidegauge.core.session import cut_lineage, scratch_path, table
from tidegauge.operators import sampling as smp
from tidegauge.operators import vectors as vec
from tidegauge.operators.sequences import sliding_sums
from tidegauge.plans.registry import query
from tidegauge.plans.samples import (
    EMB_SQL, MIXED_SQL, RATIOS, SIZE, draw_sql, mixed_plan, vector_pool, vector_splits,
)
from tidegauge.sources import sinks

DIM, HALF, EPS, SHIFT = 64, 32, 1e-6, 0.1
STREAMS = {"A": HALF, "B": HALF}
WINDOW = ["ratio", "window_id"]

# ------------------------------------------------------------------ SQL twins

STREAM_SQL = f"""st(s, stream) AS (VALUES (0, 'A'), (1, 'B')),
x AS (SELECT r.vec_id, r.label, r.split, r.idx, st.stream, CASE WHEN r.split = 'drift'
    THEN list_transform(v[s * {HALF} + 1:s * {HALF} + {HALF}], lambda q: q + {SHIFT}::DOUBLE)
    ELSE v[s * {HALF} + 1:s * {HALF} + {HALF}] END AS z FROM ranked r, st),
dims AS (SELECT unnest(range({HALF})) AS i)"""

MODEL_SQL = f"""long AS (SELECT stream, vec_id, i, z[i + 1] AS q FROM x, dims WHERE split = 'fit'),
mu AS (SELECT stream, i, avg(q) AS m FROM long GROUP BY 1, 2),
mul AS (SELECT stream, list(m ORDER BY i) AS ml FROM mu GROUP BY 1),
cov AS (SELECT a.stream, a.i, b.i AS j, covar_samp(a.q, b.q) + CASE WHEN a.i = b.i THEN {EPS}::DOUBLE ELSE 0 END AS c
  FROM long a JOIN long b ON a.stream = b.stream AND a.vec_id = b.vec_id GROUP BY 1, 2, 3),
cm AS (SELECT stream, list(c ORDER BY i * {HALF} + j) AS a0 FROM cov GROUP BY 1),
inv AS (SELECT stream, list_reduce(range({HALF}), lambda a, k: [
  CASE WHEN t // {HALF} = k AND t % {HALF} = k THEN 1.0 / a[k * {HALF} + k + 1]
       WHEN t // {HALF} = k THEN a[t + 1] / a[k * {HALF} + k + 1]
       WHEN t % {HALF} = k THEN -a[t + 1] / a[k * {HALF} + k + 1]
       ELSE a[t + 1] - a[(t // {HALF}) * {HALF} + k + 1] * a[k * {HALF} + (t % {HALF}) + 1] / a[k * {HALF} + k + 1] END
  FOR t IN range({HALF * HALF})], a0) AS p FROM cm)"""


def score_sql(means: str, keys: str, out: str) -> str:
    """CTE ``out`` with the Mahalanobis score of the mean vectors in ``means(stream, keys, d)``, d already centred."""
    return f"""{out} AS (SELECT stream, {keys}, sqrt(greatest(list_sum([d[t // {HALF} + 1] * d[t % {HALF} + 1] * p[t + 1]
  FOR t IN range({HALF * HALF})]), 0.0)) AS score FROM {means} JOIN inv USING (stream))"""


def centred_sql(drawn: str, keys: str, out: str) -> str:
    """CTE ``out(stream, keys, d)``: centred window means of ``drawn(stream, keys, z)``."""
    return f"""{out}_m AS (SELECT stream, {keys}, i, avg(z[i + 1]) AS m FROM {drawn}, dims GROUP BY stream, {keys}, i),
{out} AS (SELECT w.stream, {keys}, list(w.m - mu.m ORDER BY i) AS d FROM {out}_m w JOIN mu USING (stream, i) GROUP BY w.stream, {keys})"""


DRAWN_SQL = """drawn AS (SELECT x.stream, ratio, window_id, x.z, slot FROM plan JOIN x ON x.split = plan.source AND x.idx = plan.pool_idx)"""
CAL_SQL = f"""calplan AS (SELECT window_id, {draw_sql('window_id', 'slot', '(SELECT cal FROM nn)', 0, 2)} AS pool_idx FROM
  (SELECT unnest(range((SELECT 4 * (cal // 3) FROM nn))) AS window_id), (SELECT unnest(range({SIZE})) AS slot)),
caldrawn AS (SELECT x.stream, window_id, x.z FROM calplan JOIN x ON x.split = 'calibrate' AND x.idx = pool_idx)"""
BASE_SQL = f"{MIXED_SQL},\n{STREAM_SQL},\n{MODEL_SQL},\n{DRAWN_SQL}"
SCORES_SQL = f"{BASE_SQL},\n{centred_sql('drawn', 'ratio, window_id', 'wm')},\n{score_sql('wm', 'ratio, window_id', 'scores')}"
CALSCORES_SQL = f"{CAL_SQL},\n{centred_sql('caldrawn', 'window_id', 'cmn')},\n{score_sql('cmn', 'window_id', 'calscores')}"
Q = 0.95
FUSED_SQL = f"""{SCORES_SQL},
{CALSCORES_SQL},
thr AS (SELECT stream, quantile_cont(score, {Q}) AS threshold FROM calscores GROUP BY 1),
norm AS (SELECT stream, ratio, window_id, score / greatest(threshold, 1e-12) AS norm FROM scores JOIN thr USING (stream)),
fused AS (SELECT ratio, window_id, count(*) AS streams, min_by(norm, stream) AS single, max(norm) AS max_norm, avg(norm) AS mean_norm,
  list_avg(list_reverse_sort(list(norm))[1:2]) AS top2_mean_norm, sum((norm > 1)::INT) AS two_vote,
  sum((norm > 1)::INT) >= least(2, count(*)) AS vote_alarm FROM norm GROUP BY 1, 2)"""
RATES_SQL = f"""{FUSED_SQL},
rates AS (SELECT ratio, count(*) AS windows, avg((max_norm > 1)::INT) AS rate, avg(max_norm) AS mean_score,
  stddev_pop(max_norm) AS std_score FROM fused GROUP BY 1)"""

# ------------------------------------------------------------------ shared Spark frames


def shifted(df):
    """Stream arrays A and B; vectors of the drift pool carry the injected shift."""
    v = F.col("embedding").cast("array<double>")
    moved = F.when(F.col("split") == "drift", F.transform(v, lambda q: q + F.lit(SHIFT))).otherwise(v)
    return df.withColumn("_v", moved).withColumn("A", F.slice("_v", 1, HALF)).withColumn("B", F.slice("_v", HALF + 1, HALF)).drop("_v", "embedding")


class Setup:
    """Pool with both streams projected once, models and pool sizes; shared by the queries of one call."""

    def __init__(self, spark, sf, k: int = HALF):
        self.spark = spark
        self.raw = cut_lineage(shifted(vector_pool(spark, sf)))  # stored once, read by fit, plans and scorers
        fit = self.raw.where("split = 'fit'")
        self._fit, self._components, self._models = fit, k, None
        self.sizes = {r["split"]: r["count"] for r in self.raw.groupBy("split").count().collect()}  # four rows
        self._pool = None

    @property
    def models(self):
        if self._models is None:
            self._models = {s: vec.fit_pca(self._fit, s, HALF, self._components) for s in STREAMS}
        return self._models

    @property
    def k(self):
        return {s: len(m.variances) for s, m in self.models.items()}

    @property
    def pool(self):
        """Both streams projected once; calibration and evaluation read the stored projection."""
        if self._pool is None:
            cols = [vec.project(F.col(s), m).alias(s) for s, m in self.models.items()]
            self._pool = cut_lineage(self.raw.select("vec_id", "label", "split", "idx", *cols))
        return self._pool

    def drawn(self, plan=None, pool=None):
        plan = mixed_plan(self.spark, None, self.sizes) if plan is None else plan
        rows = (self.pool if pool is None else pool).select(
            F.col("split").alias("source"), F.col("idx").alias("pool_idx"), *STREAMS
        )
        return plan.hint("merge").join(rows, ["source", "pool_idx"])  # an exploded plan looks small to the planner, but must not be broadcast

    def cal_drawn(self, pool=None):
        n = self.sizes["calibrate"]
        plan = smp.stationary_plan(self.spark, 4 * (n // 3), SIZE, n).withColumn("source", F.lit("calibrate"))
        return self.drawn(plan, pool)

    def scores(self, drawn=None, keys=WINDOW):
        return vec.window_distance(self.drawn() if drawn is None else drawn, keys, self.models, EPS)

    @property
    def cal_rows(self):
        return len(STREAMS) * 4 * (self.sizes["calibrate"] // 3)

    def limits(self, q=None):
        """Thresholds per stream from the calibration windows."""
        return vec.thresholds(self.cal_scores(), ["stream"], Q if q is None else q, self.cal_rows)

    def cal_scores(self):
        return self.scores(self.cal_drawn(), ["window_id"])

    def fused(self):
        return vec.fuse(self.scores(), self.limits(), WINDOW)


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


# ------------------------------------------------------------------ queries


@query("vec_mean_cov", """WITH l AS (SELECT vec_id, unnest(range(64))::INT AS i, unnest(embedding::DOUBLE[]) AS q FROM embeddings)
SELECT a.i, b.i AS j, count(*) AS n, round(avg(a.q), 6) AS mu,
  round(covar_samp(a.q, b.q) + CASE WHEN a.i = b.i THEN 1e-6 ELSE 0 END, 6) AS cov
FROM l a JOIN l b USING (vec_id) GROUP BY a.i, b.i""")
def vec_mean_cov(spark, sf):
    m = vec.moments(table(spark, sf, "embeddings", "embedding"), "embedding", DIM, EPS)
    return m.select("i", "j", "n", *r6("mu", "cov"))


@query("pca_fit", f"""WITH {EMB_SQL}, l AS (SELECT unnest(range(64)) AS i, unnest(v) AS q FROM split WHERE split = 'fit'),
m AS (SELECT list(a ORDER BY i) AS m FROM (SELECT i, avg(q) AS a FROM l GROUP BY i))
SELECT vec_id, round(list_distance(v, m) ** 2, 6) AS energy FROM split, m""")
def pca_fit(spark, sf):
    """All components kept, so the projected energy must equal the centred energy, whatever the component signs."""
    rows = vector_splits(spark, sf)
    model = vec.fit_pca(rows.where("split = 'fit'"), "embedding", DIM, DIM)
    z = rows.select("vec_id", vec.project(F.col("embedding"), model).alias("z"))
    energy = F.aggregate(F.transform("z", lambda q: q * q), F.lit(0.0), lambda s, q: s + q)
    return z.select("vec_id", F.round(energy, 6).alias("energy"))


@query("standardize", """WITH l AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding::DOUBLE[]) AS q FROM embeddings),
s AS (SELECT i, avg(q) AS m, CASE WHEN stddev_pop(q) < 1e-12 THEN 1.0 ELSE stddev_pop(q) END AS sd FROM l GROUP BY i)
SELECT vec_id, round(sqrt(sum(((q - m) / sd) ** 2)), 6) AS z_norm, round(max((q - m) / sd), 6) AS z_max FROM l JOIN s USING (i) GROUP BY 1""")
def standardize(spark, sf):
    rows = table(spark, sf, "embeddings", "vec_id", "embedding")
    z = vec.standardize(rows, "embedding", vec.standard_scaler(rows, "embedding", DIM))
    norm = F.sqrt(F.aggregate(F.transform("z", lambda q: q * q), F.lit(0.0), lambda s, q: s + q))
    return z.select("vec_id", F.round(norm, 6).alias("z_norm"), F.round(F.array_max("z"), 6).alias("z_max"))


@query("window_mahalanobis", f"WITH {SCORES_SQL}\nSELECT ratio, window_id, stream, round(score, 6) AS score FROM scores")
def window_mahalanobis(spark, sf):
    return Setup(spark, sf).scores().withColumn("score", F.round("score", 6))


@query("window_mahalanobis_from_sums", f"WITH {SCORES_SQL}\nSELECT ratio, window_id, stream, round(score, 6) AS score FROM scores")
def window_mahalanobis_from_sums(spark, sf):
    """Clean and drift rows are added up apart; the window is the two sums over n."""
    s = Setup(spark, sf)
    cols = [(st, i) for st, k in s.k.items() for i in range(k)]
    sums = s.drawn().groupBy(*WINDOW, "source").agg(
        F.count(F.lit(1)).alias("n"), *[F.expr(f"sum({st}[{i}]) AS {st}_{i}") for st, i in cols]
    )
    total = sums.groupBy(*WINDOW).agg(*[F.expr(f"sum({st}_{i}) / sum(n) AS {st}_{i}") for st, i in cols])
    return vec.mahalanobis_scores(total, WINDOW, s.models, EPS).withColumn("score", F.round("score", 6))


@query("stream_ratio_scores", f"""WITH {SCORES_SQL}
SELECT stream, ratio, count(*) AS windows, round(avg(score), 6) AS mean_score, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score
FROM scores GROUP BY 1, 2""")
def stream_ratio_scores(spark, sf):
    return Setup(spark, sf).scores().groupBy("stream", "ratio").agg(
        F.count(F.lit(1)).alias("windows"), F.round(F.avg("score"), 6).alias("mean_score"),
        F.round(F.min("score"), 6).alias("min_score"), F.round(F.max("score"), 6).alias("max_score"),
    )


JOINED_SQL = f"""WITH {EMB_SQL},
{STREAM_SQL},
{MODEL_SQL},
xd AS (SELECT stream, vec_id, label, split, [z[t + 1] - ml[t + 1] FOR t IN range({HALF})] AS d FROM x JOIN mul USING (stream)),
{score_sql('xd', 'vec_id, label, split', 'sampled')}"""


@query("join_model", f"{JOINED_SQL}\nSELECT stream, vec_id, round(score, 6) AS distance FROM sampled")
def join_model(spark, sf):
    s = Setup(spark, sf)
    per = F.array(*[F.struct(F.lit(st).alias("stream"), vec.array_norm(F.col(st), m, EPS).alias("distance")) for st, m in s.models.items()])
    return s.pool.select("vec_id", F.explode(per).alias("p")).select("p.stream", "vec_id", F.round("p.distance", 6).alias("distance"))


@query("topk_distance", f"""{JOINED_SQL}, d AS (SELECT vec_id, max(score) AS distance FROM sampled GROUP BY 1)
SELECT rank, vec_id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (ORDER BY distance DESC, vec_id) AS rank,
  count(*) OVER () AS n FROM d) WHERE rank <= ceil(0.05 * n)""")
def topk_distance(spark, sf):
    """Farthest 5 %: the count grows with the table, so rows are ranked with the bucketed scan, not with limit."""
    s = Setup(spark, sf)
    dist = s.pool.select("vec_id", F.greatest(*[vec.array_norm(F.col(st), m, EPS) for st, m in s.models.items()]).alias("distance"))
    top = math.ceil(0.05 * sum(s.sizes.values()))
    ranked = positions(dist, [], [F.col("distance").desc(), "vec_id"], -F.col("distance"), "rank")
    return ranked.where(F.col("rank") <= top).select("rank", "vec_id", F.round("distance", 6).alias("distance"))


@query("sample_distance_modes", f"""{JOINED_SQL.replace(EMB_SQL, MIXED_SQL)},
wd AS (SELECT sampled.stream, ratio, window_id, score FROM plan JOIN ranked r ON r.split = plan.source AND r.idx = plan.pool_idx
  JOIN sampled USING (vec_id))
SELECT stream, ratio, window_id, round(avg(score), 6) AS mean_sample, round(quantile_cont(score, 0.9), 6) AS p90_sample FROM wd GROUP BY 1, 2, 3""")
def sample_distance_modes(spark, sf):
    s = Setup(spark, sf)
    dist = s.pool.select("split", "idx", *[vec.array_norm(F.col(st), m, EPS).alias(st) for st, m in s.models.items()])
    long = s.drawn(pool=dist).select(*WINDOW, F.explode(F.create_map(*[x for st in STREAMS for x in (F.lit(st), F.col(st))])).alias("stream", "d"))
    return long.groupBy("stream", *WINDOW).agg(
        F.round(F.avg("d"), 6).alias("mean_sample"), F.round(F.percentile("d", 0.9), 6).alias("p90_sample")
    )


def whole_window_scores(spark, sf, make):
    """Scores of a whole-window scorer in raw stream space; ``make(setup, stream)`` builds the scorer."""
    s = Setup(spark, sf)
    arrays = vec.window_arrays(s.drawn(pool=s.raw), WINDOW, list(STREAMS))
    per = F.array(*[F.struct(F.lit(st).alias("stream"), vec.score_windows(F.col(st), make(s, st)).alias("score")) for st in STREAMS])
    return arrays.select(*WINDOW, F.explode(per).alias("p")).select(*WINDOW, "p.stream", F.round("p.score", 6).alias("score"))


def sample_of(s: Setup, stream: str):
    return vec.reference_sample(s.raw.where("split = 'fit'"), stream)


@query("window_frechet")
def window_frechet(spark, sf):
    def make(s, st):
        _, mean, cov = vec.fit_moments(s.raw.where("split = 'fit'"), st, HALF)
        return vec.frechet_scorer(mean, cov, EPS)

    return whole_window_scores(spark, sf, make)


KREF_SQL = f"kref AS (SELECT stream, idx, z FROM x WHERE split = 'fit' AND idx < {vec.KERNEL_ROWS})"


@query("window_mmd", f"""WITH {MIXED_SQL},
{STREAM_SQL},
{DRAWN_SQL},
{KREF_SQL},
gam AS (SELECT a.stream, 1.0 / greatest(2.0 * quantile_cont(list_distance(a.z, b.z) ** 2, 0.5), 1e-12) AS g FROM kref a JOIN kref b
  ON a.stream = b.stream AND a.idx < b.idx WHERE b.idx < 256 AND list_distance(a.z, b.z) > 0 GROUP BY 1),
kxx AS (SELECT a.stream, avg(exp(-g * list_distance(a.z, b.z) ** 2)) AS xx FROM kref a JOIN kref b ON a.stream = b.stream JOIN gam ON gam.stream = a.stream GROUP BY 1),
kyy AS (SELECT a.stream, a.ratio, a.window_id, avg(exp(-g * list_distance(a.z, b.z) ** 2)) AS yy FROM drawn a JOIN drawn b
  ON a.stream = b.stream AND a.ratio = b.ratio AND a.window_id = b.window_id JOIN gam ON gam.stream = a.stream GROUP BY 1, 2, 3),
kxy AS (SELECT a.stream, a.ratio, a.window_id, avg(exp(-g * list_distance(a.z, b.z) ** 2)) AS xy FROM drawn a JOIN kref b
  ON a.stream = b.stream JOIN gam ON gam.stream = a.stream GROUP BY 1, 2, 3)
SELECT ratio, window_id, stream, round(xx + yy - 2 * xy, 6) AS score FROM kyy JOIN kxy USING (stream, ratio, window_id) JOIN kxx USING (stream)""")
def window_mmd(spark, sf):
    return whole_window_scores(spark, sf, lambda s, st: vec.mmd_scorer(sample_of(s, st)))


def rank_scores(spark, sf, make):
    """Scores from ranks against all fit rows; ``make(fit rows, tie sums)`` builds the scorer of a stream."""
    s = Setup(spark, sf)
    coded, ties = vec.rank_codes(s.raw, F.col("split") == "fit", STREAMS, ["split", "idx"])
    arrays = vec.window_arrays(s.drawn(pool=coded), WINDOW, list(STREAMS))
    per = F.array(*[F.struct(F.lit(st).alias("stream"), vec.score_windows(F.col(st), make(s.sizes["fit"], ties[st])).alias("score")) for st in STREAMS])
    return arrays.select(*WINDOW, F.explode(per).alias("p")).select(*WINDOW, "p.stream", F.round("p.score", 6).alias("score"))


POOLED_SQL = f"""WITH {MIXED_SQL},
{STREAM_SQL},
{DRAWN_SQL},
kref AS (SELECT stream, idx, z FROM x WHERE split = 'fit'),
wins AS (SELECT DISTINCT stream, ratio, window_id FROM drawn),
pooled AS (SELECT stream, ratio, window_id, i, 1 AS is_w, z[i + 1] AS q FROM drawn, dims
  UNION ALL SELECT stream, ratio, window_id, i, 0, z[i + 1] FROM wins JOIN kref USING (stream), dims),
sz AS (SELECT stream, ratio, window_id, i, sum(is_w) AS ny, sum(1 - is_w) AS nx FROM pooled GROUP BY 1, 2, 3, 4)"""


@query("window_ks", f"""{POOLED_SQL},
c AS (SELECT stream, ratio, window_id, i, sum(is_w) OVER w AS cw, sum(1 - is_w) OVER w AS cr FROM pooled
  WINDOW w AS (PARTITION BY stream, ratio, window_id, i ORDER BY q RANGE UNBOUNDED PRECEDING))
SELECT ratio, window_id, stream, round(max(abs(cr / nx - cw / ny)), 6) AS score FROM c JOIN sz USING (stream, ratio, window_id, i) GROUP BY 1, 2, 3""")
def window_ks(spark, sf):
    return rank_scores(spark, sf, lambda rows, ties: vec.ks_scorer(rows))


@query("window_cvm", f"""{POOLED_SQL},
rk AS (SELECT *, rank() OVER (PARTITION BY stream, ratio, window_id, i ORDER BY q)
    + (count(*) OVER (PARTITION BY stream, ratio, window_id, i, q) - 1) / 2.0 AS mid,
  row_number() OVER (PARTITION BY stream, ratio, window_id, i, is_w ORDER BY q) AS own FROM pooled),
u AS (SELECT stream, ratio, window_id, i, sum(CASE WHEN is_w = 1 THEN (mid - own) ** 2 END) AS uy, sum(CASE WHEN is_w = 0 THEN (mid - own) ** 2 END) AS ux FROM rk GROUP BY 1, 2, 3, 4)
SELECT ratio, window_id, stream, round(max((nx * ux + ny * uy) / (nx * ny * (nx + ny)) - (4.0 * nx * ny - 1) / (6.0 * (nx + ny))), 6) AS score
FROM u JOIN sz USING (stream, ratio, window_id, i) GROUP BY 1, 2, 3""")
def window_cvm(spark, sf):
    return rank_scores(spark, sf, vec.cvm_scorer)


@query("window_lsdd")
def window_lsdd(spark, sf):
    return whole_window_scores(spark, sf, lambda s, st: vec.lsdd_scorer(sample_of(s, st)))


CAL_ONLY_SQL = f"WITH {EMB_SQL},\n{STREAM_SQL},\n{MODEL_SQL},\n{CALSCORES_SQL}"


@query("calibrate_threshold", f"""{CAL_ONLY_SQL}
SELECT stream, count(*) AS windows, round(quantile_cont(score, {Q}), 6) AS threshold FROM calscores GROUP BY 1""")
def calibrate_threshold(spark, sf):
    s = Setup(spark, sf)
    q = exact_quantiles(s.cal_scores(), ["stream"], "score", [Q], ["threshold"], s.cal_rows)
    return q.select("stream", F.col("n").alias("windows"), F.round("threshold", 6).alias("threshold"))


@query("threshold_grid", f"""{CAL_ONLY_SQL}
SELECT stream, q, round(t, 6) AS threshold FROM (SELECT stream, unnest([0.95, 0.97, 0.99, 0.995]::DOUBLE[]) AS q,
  unnest(quantile_cont(score, [0.95, 0.97, 0.99, 0.995])) AS t FROM calscores GROUP BY 1)""")
def threshold_grid(spark, sf):
    qs = [0.95, 0.97, 0.99, 0.995]
    t = Setup(spark, sf).limits(qs)
    pairs = F.arrays_zip(F.array(*[F.lit(q) for q in qs]).alias("q"), F.col("threshold").alias("t"))
    return t.select("stream", F.explode(pairs).alias("p")).select("stream", "p.q", F.round("p.t", 6).alias("threshold"))


FUSE_COLS = ["single", "max_norm", "mean_norm", "top2_mean_norm"]


@query("fuse_scores", f"""WITH {FUSED_SQL}
SELECT ratio, window_id, streams, round(single, 6) AS single, round(max_norm, 6) AS max_norm, round(mean_norm, 6) AS mean_norm,
  round(top2_mean_norm, 6) AS top2_mean_norm, two_vote, vote_alarm FROM fused""")
def fuse_scores(spark, sf):
    return Setup(spark, sf).fused().select(*WINDOW, "streams", *r6(*FUSE_COLS), "two_vote", "vote_alarm")


@query("detection_rate", f"""WITH {RATES_SQL}
SELECT ratio, CASE WHEN ratio = 0 THEN 'fpr' ELSE 'recall' END AS metric, windows, round(rate, 6) AS rate,
  round(mean_score, 6) AS mean_score, round(std_score, 6) AS std_score FROM rates""")
def detection_rate(spark, sf):
    rates = vec.detection_rates(Setup(spark, sf).fused(), ["ratio"])
    metric = F.when(F.col("ratio") == 0, "fpr").otherwise("recall")
    return rates.select("ratio", metric.alias("metric"), "windows", *r6("rate", "mean_score", "std_score"))


@query("macro_weighted_acc", f"""WITH {RATES_SQL}
SELECT round(max(CASE WHEN ratio = 0 THEN rate END), 6) AS fpr, round(avg(CASE WHEN ratio = 0 THEN 1 - rate ELSE rate END), 6) AS macro,
  round(sum(ratio * rate) / sum(ratio), 6) AS weighted FROM rates""")
def macro_weighted_acc(spark, sf):
    rates = vec.detection_rates(Setup(spark, sf).fused(), ["ratio"])
    return vec.macro_metrics(rates, []).select(*r6("fpr", "macro", "weighted"))


@query("group_detection", f"""WITH {FUSED_SQL}, bridge(feature_group, stream) AS (VALUES ('A', 'A'), ('B', 'B'), ('A+B', 'A'), ('A+B', 'B')),
g AS (SELECT feature_group, ratio, window_id, max(norm) AS m FROM norm JOIN bridge USING (stream) GROUP BY 1, 2, 3)
SELECT feature_group, ratio, count(*) AS windows, round(avg((m > 1)::INT), 6) AS rate FROM g GROUP BY 1, 2""")
def group_detection(spark, sf):
    s = Setup(spark, sf)
    groups = F.when(F.col("stream") == "A", F.array(F.lit("A"), F.lit("A+B"))).otherwise(F.array(F.lit("B"), F.lit("A+B")))
    scores = s.scores().withColumn("feature_group", F.explode(groups))
    fused = vec.fuse(scores, s.limits(), ["feature_group", *WINDOW])
    return vec.detection_rates(fused, ["feature_group", "ratio"]).select("feature_group", "ratio", "windows", *r6("rate"))


@query("sink_model_tables", f"""WITH {FUSED_SQL}
SELECT cov.stream, count(*) FILTER (cov.i = cov.j) AS components, round(sum(c) FILTER (cov.i = cov.j) - {HALF} * {EPS}, 5) AS total_variance,
  round(any_value(threshold), 6) AS threshold FROM cov JOIN thr ON thr.stream = cov.stream GROUP BY 1""")
def sink_model_tables(spark, sf):
    """Fitted models and thresholds written to the shared folder and read back; the variances of all components add up to the trace."""
    s = Setup(spark, sf)
    out = scratch_path(spark, "models")
    sinks.write_models(spark, s.models, s.limits(), out)
    comps = spark.read.parquet(f"{out}/components").groupBy("stream").agg(F.count(F.lit(1)).alias("components"), F.round(F.sum("variance"), 5).alias("total_variance"))
    limits = spark.read.parquet(f"{out}/thresholds").select("stream", F.round("threshold", 6).alias("threshold"))
    return comps.join(F.broadcast(limits), "stream")  # one row per stream


PERMUTED_SQL = f"""{SCORES_SQL},
{CALSCORES_SQL},
thr AS (SELECT stream, quantile_cont(score, {Q}) AS threshold FROM calscores GROUP BY 1),
ordered AS (SELECT perm, ratio, window_id, stream, list(z ORDER BY md5(perm || ':' || window_id || ':' || slot), slot) AS zs
  FROM drawn, (SELECT unnest(range(20)) AS perm) GROUP BY ALL),
psum AS (SELECT perm, ratio, window_id, stream, len(zs) AS n, list_reduce(zs, lambda a, b: [a[t] + b[t] FOR t IN range(1, {HALF + 1})]) AS zt FROM ordered),
pd AS (SELECT stream, perm, ratio, window_id, [zt[t + 1] / n - ml[t + 1] FOR t IN range({HALF})] AS d FROM psum JOIN mul USING (stream)),
{score_sql('pd', 'perm, ratio, window_id', 'psc')},
pf AS (SELECT perm, ratio, window_id, max(score / greatest(threshold, 1e-12)) AS m FROM psc JOIN thr USING (stream) GROUP BY 1, 2, 3),
pspan AS (SELECT ratio, window_id, max(m) - min(m) AS span, count(DISTINCT m > 1) AS decisions FROM pf GROUP BY 1, 2)"""


@query("permutation_check", f"""WITH {PERMUTED_SQL}
SELECT count(*) AS windows, 20 AS permutations, round(max(span), 9) AS max_span, sum((decisions > 1)::INT)::BIGINT AS disagreements FROM pspan""")
def permutation_check(spark, sf):
    """Scores of each window added up in 20 shuffled orders; the window mean must not depend on the order."""
    s = Setup(spark, sf)
    orders = vec.permuted_scores(s.drawn(), WINDOW, "slot", s.models, EPS, 20)
    fused = vec.fuse(orders, s.limits(), [*WINDOW, "perm"])
    spans = fused.groupBy(*WINDOW).agg(
        (F.max("max_norm") - F.min("max_norm")).alias("span"),
        F.countDistinct(F.col("max_norm") > 1).alias("decisions"),
    )
    return spans.agg(
        F.count(F.lit(1)).alias("windows"), F.lit(20).alias("permutations"), F.round(F.max("span"), 9).alias("max_span"),
        F.sum((F.col("decisions") > 1).cast("bigint")).alias("disagreements"),
    )


@query("sliding_replay", f"""WITH {EMB_SQL},
{STREAM_SQL},
{MODEL_SQL},
{CALSCORES_SQL},
thr AS (SELECT stream, quantile_cont(score, {Q}) AS threshold FROM calscores GROUP BY 1),
t AS (SELECT trial, pos FROM (SELECT unnest(range((SELECT clean // 6 FROM nn))) AS trial), (SELECT unnest(range({SIZE + 60})) AS pos)),
p AS (SELECT trial, pos + 1 AS rn, CASE WHEN pos < {SIZE} THEN 'clean' ELSE 'drift' END AS source,
  CASE WHEN pos < {SIZE} THEN {draw_sql('trial', 'pos', '(SELECT clean FROM nn)', 5, 0)}
  ELSE {draw_sql('trial', f'pos - {SIZE}', '(SELECT drift FROM nn)', 5, 1)} END AS pool_idx FROM t),
e AS (SELECT unnest(range(0, 61, 5)) AS checkpoint),
rd AS (SELECT x.stream, trial, checkpoint, x.z FROM p JOIN e ON rn > checkpoint AND rn <= checkpoint + {SIZE} JOIN x ON x.split = p.source AND x.idx = p.pool_idx),
{centred_sql('rd', 'trial, checkpoint', 'rm')},
{score_sql('rm', 'trial, checkpoint', 'rs')},
f AS (SELECT trial, checkpoint, max(score / greatest(threshold, 1e-12)) AS fused FROM rs JOIN thr USING (stream) GROUP BY 1, 2)
SELECT trial, checkpoint, round(fused, 6) AS fused, fused > 1 AS alarm FROM f""")
def sliding_replay(spark, sf):
    """A clean window followed by 60 drift rows; at each checkpoint the last rows of the joint sequence are scored."""
    s = Setup(spark, sf)
    trials, after = s.sizes["clean"] // 6, 60
    pos = F.explode(F.sequence(F.lit(0), F.lit(SIZE + after - 1))).alias("pos")
    t = spark.range(trials).select(F.col("id").alias("trial"), pos)
    clean = F.col("pos") < SIZE
    plan = t.select(
        "trial", (F.col("pos") + 1).alias("rn"), F.when(clean, "clean").otherwise("drift").alias("source"),
        F.when(clean, smp.draw_index(F.col("trial"), F.col("pos"), s.sizes["clean"], 5, 0))
        .otherwise(smp.draw_index(F.col("trial"), F.col("pos") - SIZE, s.sizes["drift"], 5, 1)).alias("pool_idx"),
    )
    cols = {f"{st}_{i}": F.expr(f"{st}[{i}]") for st, k in s.k.items() for i in range(k)}
    sums = sliding_sums(s.drawn(plan), ["trial"], SIZE, 5, cols)
    means = sums.select("trial", (F.col("endpoint") - SIZE).alias("checkpoint"), *[(F.col(c) / SIZE).alias(c) for c in cols])
    scores = vec.mahalanobis_scores(means, ["trial", "checkpoint"], s.models, EPS)
    fused = vec.fuse(scores, s.limits(), ["trial", "checkpoint"])
    return fused.select("trial", "checkpoint", F.round("max_norm", 6).alias("fused"), (F.col("max_norm") > 1).alias("alarm"))


@query("score_linear_head", f"""WITH {EMB_SQL}, l AS (SELECT vec_id, label, split, i, v[i + 1] AS q FROM split, (SELECT unnest(range(64)) AS i)),
sc AS (SELECT i, avg(q) AS m, CASE WHEN stddev_pop(q) < 1e-12 THEN 1.0 ELSE stddev_pop(q) END AS sd FROM l GROUP BY i),
z AS (SELECT vec_id, label, i, (q - m) / sd AS z FROM l JOIN sc USING (i)),
w AS (SELECT label AS head, i, avg(z) AS w FROM z WHERE label < 8 GROUP BY 1, 2),
o AS (SELECT vec_id, unnest(['A', 'B', 'C']) AS letter, unnest([label, (label + 3) % 10, (label + 7) % 10]) AS head FROM embeddings),
s AS (SELECT o.vec_id, letter, sum(z.z * w.w) AS score FROM o LEFT JOIN w ON w.head = o.head LEFT JOIN z ON z.vec_id = o.vec_id AND z.i = w.i GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC NULLS LAST, letter) AS k FROM s)
SELECT vec_id, letter AS choice, round(score, 6) AS best_score FROM r WHERE k = 1""")
def score_linear_head(spark, sf):
    """Stored heads of the classes below 8 (class means of standardised features); options without a head are skipped."""
    rows = table(spark, sf, "embeddings")
    z = vec.standardize(rows, "embedding", vec.standard_scaler(rows, "embedding", DIM))
    heads = z.where("label < 8").groupBy("label").agg(F.expr("array(" + ", ".join(f"avg(z[{i}])" for i in range(DIM)) + ")").alias("w"))
    lab = F.col("label")
    options = F.create_map(F.lit("A"), lab, F.lit("B"), (lab + 3) % 10, F.lit("C"), (lab + 7) % 10)
    out = vec.pick_option(z.withColumn("options", options), "vec_id", "options", "z", heads)
    return out.withColumn("best_score", F.round("best_score", 6))


GRID_EPS, GRID_SIZE = 1e-4, 20
GRID_SHAPES = [(0.0, GRID_SIZE, 0), (0.5, GRID_SIZE // 2, GRID_SIZE // 2)]
GRID_MODES = ("mean_sample", "p90_sample", "window_mean")
GRID_MODEL_SQL = MODEL_SQL.replace("FROM x, dims WHERE split = 'fit'", "FROM gx, dims").replace(f"{EPS}::DOUBLE", f"{GRID_EPS}::DOUBLE")
GRID_SQL = f"""WITH {EMB_SQL},
{STREAM_SQL},
gx AS (SELECT label AS stream, vec_id, z FROM x WHERE stream = 'A'),
gp AS (SELECT stream AS label, vec_id, z, row_number() OVER (PARTITION BY stream ORDER BY md5('grid:' || vec_id), vec_id) - 1 AS idx FROM gx),
gn AS (SELECT label, count(*) AS n FROM gp GROUP BY 1),
{GRID_MODEL_SQL},
shapes(ratio, n_clean, n_drift) AS (VALUES {", ".join(f"({r}::DOUBLE, {a}, {b})" for r, a, b in GRID_SHAPES)}),
gw AS (SELECT r.label AS ref, r.n AS nr, d.label AS drift, d.n AS nd, ratio, n_clean, unnest(range(greatest(10, r.n // 2))) AS window_id
    FROM gn r JOIN gn d ON r.label <> d.label, shapes
  UNION ALL SELECT label, n, NULL, 0, -1.0, {GRID_SIZE}, unnest(range(greatest(10, n // 2))) FROM gn),
gs AS (SELECT *, window_id + round(greatest(ratio, 0) * 1000)::BIGINT * 7 AS ww FROM gw, (SELECT unnest(range({GRID_SIZE})) AS slot)),
gplan AS (SELECT ref, drift, ratio, window_id, CASE WHEN slot < n_clean THEN ref ELSE drift END AS label,
  CASE WHEN drift IS NULL THEN {draw_sql('window_id', 'slot', 'nr', 0, 2)} WHEN slot < n_clean THEN {draw_sql('ww', 'slot', 'nr', 0, 0)}
  ELSE {draw_sql('ww', 'slot - n_clean', 'greatest(nd, 1)', 0, 1)} END AS idx FROM gs),
gv AS (SELECT ref, drift, ratio, window_id, vec_id, z FROM gplan JOIN gp USING (label, idx)),
fd AS (SELECT ref AS stream, vec_id, [z[t + 1] - ml[t + 1] FOR t IN range({HALF})] AS d FROM (SELECT DISTINCT ref, vec_id, z FROM gv) JOIN mul ON mul.stream = ref),
{score_sql('fd', 'vec_id', 'far')},
gm AS (SELECT ref AS stream, drift, ratio, window_id, [list_avg([q[t + 1] FOR q IN zs]) - ml[t + 1] FOR t IN range({HALF})] AS d
  FROM (SELECT ref, drift, ratio, window_id, list(z) AS zs FROM gv GROUP BY ALL) JOIN mul ON mul.stream = ref),
{score_sql('gm', 'drift, ratio, window_id', 'mid')},
long3 AS (SELECT stream AS ref, drift, ratio, 'window_mean' AS mode, score FROM mid
  UNION ALL SELECT ref, drift, ratio, unnest(['mean_sample', 'p90_sample']), unnest([avg(score), quantile_cont(score, 0.9)])
    FROM gv JOIN far ON far.stream = gv.ref AND far.vec_id = gv.vec_id GROUP BY ref, drift, ratio, window_id),
gl AS (SELECT ref, mode, quantile_cont(score, 0.95) AS threshold FROM long3 WHERE drift IS NULL GROUP BY 1, 2)
SELECT ref AS reference, drift, mode, round(avg(CASE WHEN ratio = 0 THEN (score > threshold)::INT END), 6) AS fpr,
  round(avg(CASE WHEN ratio > 0 THEN (score > threshold)::INT END), 6) AS recall
FROM long3 JOIN gl USING (ref, mode) WHERE drift IS NOT NULL GROUP BY 1, 2, 3"""


@query("reference_drift_grid", GRID_SQL)
def reference_drift_grid(spark, sf):
    """Detection table over every reference task x every other task x score mode, in one job.

    Tasks are the labels. Each is projected by its own model (a row of the table of models), calibrated on its own windows and
    tested on windows that mix in each other label.
    """
    rows = cut_lineage(shifted(vector_splits(spark, sf)).select("vec_id", "label", "A"))
    models = vec.keyed_models(rows, "label", "A", HALF, HALF).withColumnRenamed("label", "reference")
    sizes = rows.where("label IS NOT NULL").groupBy(F.col("label").alias("reference")).agg(F.count(F.lit(1)).alias("nr"))  # one row per task
    others = sizes.select(F.col("reference").alias("drift"), F.col("nr").alias("nd"))
    shape = lambda r, a: F.struct(F.lit(r).alias("ratio"), F.lit(a).alias("n_clean"))
    pairs = sizes.crossJoin(others).where("reference <> drift").withColumn("shape", F.explode(F.array(*[shape(r, a) for r, a, _ in GRID_SHAPES])))
    alone = sizes.select("reference", F.lit(None).cast(rows.schema["label"].dataType).alias("drift"), "nr", F.lit(0).cast("long").alias("nd"), shape(-1.0, GRID_SIZE).alias("shape"))
    each = pairs.select("reference", "drift", "nr", "nd", "shape").unionByName(alone).select("reference", "drift", "nr", "nd", "shape.ratio", "shape.n_clean")
    each = each.withColumn("window_id", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(10), F.floor(F.col("nr") / 2)) - 1)))
    each = each.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "reference", "drift", "ratio", "window_id")
    w, single = F.col("window_id") + F.round(F.greatest("ratio", F.lit(0.0)) * 1000).cast("bigint") * 7, F.col("drift").isNull()
    each = each.withColumns({"_c": F.when(single, smp.draw_turns(F.col("window_id"), 0, 2)).otherwise(smp.draw_turns(w, 0, 0)), "_d": smp.draw_turns(w, 0, 1)})
    each = each.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(GRID_SIZE - 1))))
    clean = F.col("slot") < F.col("n_clean")  # all slots of a window without drift
    at = F.when(clean, smp.draw_index(w, F.col("slot"), F.col("nr"), turns=F.col("_c"))).otherwise(
        smp.draw_index(w, F.col("slot") - F.col("n_clean"), F.greatest("nd", F.lit(1).cast("long")), turns=F.col("_d"))
    )
    plan = each.select("reference", "drift", "ratio", "window_id", F.when(clean, F.col("reference")).otherwise(F.col("drift")).alias("label"), at.alias("pool_idx"))
    pool = smp.pool_index(rows, "vec_id", "grid", ["label"]).select("label", F.col("idx").alias("pool_idx"), "A")
    # the planner takes the exploded plan for a few rows; it grows with the pairs and the pool and must not be broadcast
    windows = plan.hint("merge").join(pool, ["label", "pool_idx"]).groupBy("reference", "drift", "ratio", "window_id").agg(F.collect_list("A").alias("vectors"))  # GRID_SIZE each
    modes = vec.score_modes(F.col("vectors"), F.col("mean"), F.col("basis"), F.col("variances"), GRID_EPS)
    scored = cut_lineage(windows.join(F.broadcast(models), "reference").select("reference", "drift", "ratio", modes.alias("m")))  # one model per task
    long = scored.select("reference", "drift", "ratio", F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(f"m.{m}").alias("score")) for m in GRID_MODES])).alias("s"))
    long = long.select("reference", "drift", "ratio", "s.*")
    limits = vec.thresholds(long.where("drift IS NULL"), ["reference", "mode"], 0.95)
    tested = long.where("drift IS NOT NULL").join(F.broadcast(limits), ["reference", "mode"])  # three rows per task
    hit = (F.col("score") > F.col("threshold")).cast("double")
    out = tested.groupBy("reference", "drift", "mode").agg(F.avg(F.when(F.col("ratio") == 0, hit)).alias("fpr"), F.avg(F.when(F.col("ratio") > 0, hit)).alias("recall"))
    return out.select("reference", "drift", "mode", *r6("fpr", "recall"))
