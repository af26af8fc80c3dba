"""Result-table queries on lineitem as the fact table: method = return flag, family = line status, seed = line number,
group = supplier, load = tax, weight = quantity, accuracy = price over a fixed scale."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.core.scan import exact_quantiles
from tidegauge.core.session import table
from tidegauge.operators import results as res
from tidegauge.operators import sampling as smp
from tidegauge.operators import signals as sig
from tidegauge.plans.registry import query

SCALE = 105001.0
FACTS_SQL = f"""facts AS (SELECT CASE l_returnflag WHEN 'N' THEN 'NoRetrain' WHEN 'R' THEN 'Periodic' ELSE 'Adaptive' END AS method,
  l_linestatus AS family, l_linenumber AS seed, l_suppkey AS grp, l_tax AS load, l_quantity AS n, l_extendedprice / {SCALE}::DOUBLE AS acc,
  l_discount AS disc FROM lineitem)"""
METHODS = ["NoRetrain", "Periodic", "Adaptive"]


def facts(spark, sf):
    li = table(spark, sf, "lineitem", "l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey", "l_tax", "l_quantity", "l_extendedprice", "l_discount")
    m = F.when(F.col("l_returnflag") == "N", "NoRetrain").when(F.col("l_returnflag") == "R", "Periodic").otherwise("Adaptive")
    return li.select(
        m.alias("method"), F.col("l_linestatus").alias("family"), F.col("l_linenumber").alias("seed"), F.col("l_suppkey").alias("grp"),
        F.col("l_tax").alias("load"), F.col("l_quantity").alias("n"), (F.col("l_extendedprice") / SCALE).alias("acc"), F.col("l_discount").alias("disc"),
    )


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


SEED_SQL = f"{FACTS_SQL}, runs AS (SELECT method, family, load, seed, avg(acc) AS acc FROM facts GROUP BY ALL)"


def seed_runs(spark, sf):
    return facts(spark, sf).groupBy("method", "family", "load", "seed").agg(F.avg("acc").alias("acc"))


@query("seed_mean_std", f"""WITH {SEED_SQL} SELECT method, family, load, count(*) AS n, round(avg(acc), 6) AS acc_mean,
  round(coalesce(stddev_samp(acc), 0), 6) AS acc_std FROM runs GROUP BY 1, 2, 3""")
def seed_mean_std(spark, sf):
    return res.mean_std(seed_runs(spark, sf), ["method", "family", "load"], ["acc"]).select("method", "family", "load", "n", *r6("acc_mean", "acc_std"))


@query("mean_of_seed_means", f"""WITH {FACTS_SQL}, s AS (SELECT method, family, seed, avg(acc) AS m FROM facts GROUP BY ALL)
SELECT method, family, count(m) AS seeds, round(avg(m), 6) AS acc_mean, round(coalesce(stddev_samp(m), 0), 6) AS acc_std FROM s GROUP BY 1, 2""")
def mean_of_seed_means(spark, sf):
    return sig.seed_summary(facts(spark, sf), ["method", "family"], "seed", "acc").select("method", "family", "seeds", *r6("acc_mean", "acc_std"))


@query("metric_row", f"""WITH {FACTS_SQL}, s AS (SELECT method, family, seed, avg(CASE WHEN abs(load) < 1e-9 THEN acc END) AS fpr,
  avg(CASE WHEN abs(load - 0.02) < 1e-9 THEN acc END) AS r02, avg(CASE WHEN abs(load - 0.08) < 1e-9 THEN acc END) AS r08,
  avg(CASE WHEN load > 0 THEN acc END) AS drift FROM facts GROUP BY ALL)
SELECT method, family, round(avg(fpr), 6) AS fpr_mean, round(coalesce(stddev_samp(fpr), 0), 6) AS fpr_std, round(avg(r02), 6) AS r02_mean,
  round(coalesce(stddev_samp(r02), 0), 6) AS r02_std, round(avg(r08), 6) AS r08_mean, round(coalesce(stddev_samp(r08), 0), 6) AS r08_std,
  round(avg(drift), 6) AS drift_mean, round(coalesce(stddev_samp(drift), 0), 6) AS drift_std FROM s GROUP BY 1, 2""")
def metric_row(spark, sf):
    out = res.wide_metric_row(facts(spark, sf), ["method", "family"], "seed", "load", {"fpr": 0.0, "r02": 0.02, "r08": 0.08}, "acc")
    return out.select("method", "family", *r6(*[c for c in out.columns if c not in ("method", "family")]))


@query("budget_aggregate", f"""WITH {FACTS_SQL}, b AS (SELECT method, load AS budget, seed, avg(acc) AS recall, avg(disc) AS prechange, avg(n) AS delay FROM facts GROUP BY ALL)
SELECT method, budget, count(*) AS n, round(avg(recall), 6) AS recall_mean, round(coalesce(stddev_samp(recall), 0), 6) AS recall_std,
  round(sqrt(avg(prechange)), 6) AS prechange_root, round(coalesce(stddev_samp(delay), 0), 6) AS delay_std FROM b GROUP BY 1, 2""")
def budget_aggregate(spark, sf):
    b = facts(spark, sf).groupBy("method", F.col("load").alias("budget"), "seed").agg(
        F.avg("acc").alias("recall"), F.avg("disc").alias("prechange"), F.avg("n").alias("delay")
    )
    out = res.mean_std(b, ["method", "budget"], ["recall", "prechange", "delay"])
    return out.select("method", "budget", "n", *r6("recall_mean", "recall_std"), F.round(F.sqrt("prechange_mean"), 6).alias("prechange_root"), *r6("delay_std"))


@query("window_fpr_table", f"""WITH {FACTS_SQL}, s AS (SELECT method, seed, sum((n * disc)::INT) AS a, sum(n::INT) AS w FROM facts GROUP BY ALL)
SELECT method, sum(a) AS alarm_windows, sum(w) AS windows, round(100 * sum(a) / sum(w), 6) AS fpr_pct,
  string_agg(printf('%.4f', 100 * a / w), ';' ORDER BY seed) AS per_seed_pct FROM s GROUP BY 1""".replace("(n * disc)::INT", "floor(n * disc + 1e-9)::BIGINT"))
def window_fpr_table(spark, sf):
    rows = facts(spark, sf).select(
        "method", "seed", F.floor(F.col("n") * F.col("disc") + 1e-9).alias("alarm_windows"), F.col("n").cast("int").alias("windows")
    )
    return res.window_fpr_table(rows, "method", "seed").withColumn("fpr_pct", F.round("fpr_pct", 6))


@query("task_macro", f"""WITH {FACTS_SQL}, t AS (SELECT method, load, grp, avg((acc > 0.5)::INT) AS rate FROM facts GROUP BY ALL)
SELECT method, load, count(*) AS n, round(avg(rate), 6) AS rate_mean, round(coalesce(stddev_samp(rate), 0), 6) AS rate_std FROM t GROUP BY 1, 2""")
def task_macro(spark, sf):
    t = facts(spark, sf).groupBy("method", "load", "grp").agg(F.avg((F.col("acc") > 0.5).cast("double")).alias("rate"))
    return res.mean_std(t, ["method", "load"], ["rate"]).select("method", "load", "n", *r6("rate_mean", "rate_std"))


@query("fold_aggregate", f"""WITH {FACTS_SQL}, f AS (SELECT method, seed, avg(acc) AS m FROM facts GROUP BY ALL)
SELECT method, count(*) AS folds, round(avg(m), 6) AS mean, round(coalesce(stddev_samp(m), 0), 6) AS std, round(min(m), 6) AS min, round(max(m), 6) AS max FROM f GROUP BY 1""")
def fold_aggregate(spark, sf):
    f = facts(spark, sf).groupBy("method", "seed").agg(F.avg("acc").alias("m"))
    return res.spread_stats(f, ["method"], "m").select("method", "folds", *r6("mean", "std", "min", "max"))


@query("weighted_seed_score", f"""WITH {FACTS_SQL}, s AS (SELECT family, method, load, seed, sum(acc * n) / sum(n) AS score FROM facts GROUP BY ALL)
SELECT family, method, load, count(*) AS n, round(avg(score), 6) AS score_mean, round(coalesce(stddev_samp(score), 0), 6) AS score_std FROM s GROUP BY 1, 2, 3""")
def weighted_seed_score(spark, sf):
    out = res.weighted_seed_score(facts(spark, sf), ["family", "method", "load"], "seed", "acc", "n")
    return out.select("family", "method", "load", "n", *r6("score_mean", "score_std"))


CELL_SQL = f"{FACTS_SQL}, cell AS (SELECT family, load, method, avg(acc) AS v FROM facts GROUP BY ALL)"


def cells(spark, sf, keys=("family", "load")):
    return facts(spark, sf).groupBy(*keys, "method").agg(F.avg("acc").alias("v"))


@query("summary_method", f"""WITH {FACTS_SQL}, g AS (SELECT grp, method, avg(acc) AS v FROM facts GROUP BY ALL),
b AS (SELECT grp, max(v) AS best FROM g WHERE method <> 'Adaptive' GROUP BY 1),
p AS (SELECT method, count(*) AS groups, avg(v) AS mean, coalesce(stddev_samp(v), 0) AS std, median(v) AS med, sum((v - best > 1e-9)::INT) AS wins,
  sum((v - best < -1e-9)::INT) AS losses, sum((abs(v - best) <= 1e-9)::INT) AS ties FROM g JOIN b USING (grp) GROUP BY 1)
SELECT method, groups, round(mean, 6) AS mean, round(std, 6) AS std, round(med, 6) AS median, wins, losses, ties,
  round(mean - (SELECT mean FROM p WHERE method = 'NoRetrain'), 6) AS gap_vs_base,
  round(mean - (SELECT max(mean) FROM p WHERE method <> 'Adaptive'), 6) AS gap_vs_best FROM p""")
def summary_method(spark, sf):
    g = facts(spark, sf).groupBy("grp", "method").agg(F.avg("acc").alias("v"))
    out = res.method_summary(g, "grp", "method", "v", ["NoRetrain", "Periodic"], "NoRetrain")
    med = exact_quantiles(g, ["method"], "v", [0.5], ["median"]).drop("n")
    return out.join(med, "method").select("method", "groups", *r6("mean", "std", "median"), "wins", "losses", "ties", *r6("gap_vs_base", "gap_vs_best"))


@query("comparison_counts", f"""WITH {FACTS_SQL}, g AS (SELECT grp, avg(acc) FILTER (method = 'Adaptive') AS a, avg(acc) FILTER (method = 'NoRetrain') AS b FROM facts GROUP BY 1),
d AS (SELECT a - b AS d FROM g WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT count(*) AS scenarios, sum((d > 1e-12)::INT) AS wins, sum((abs(d) <= 1e-12)::INT) AS ties, sum((d < -1e-12)::INT) AS losses, round(avg(d), 6) AS mean_delta FROM d""")
def comparison_counts(spark, sf):
    out = res.comparison_counts(cells(spark, sf, ("grp",)), "grp", "method", "v", "Adaptive", "NoRetrain")
    return out.withColumn("mean_delta", F.round("mean_delta", 6))


@query("relative_metrics", f"""WITH {CELL_SQL}, c AS (SELECT family, load, max(v) FILTER (method = 'NoRetrain') AS b, max(v) FILTER (method = 'Adaptive') AS o,
  max(v) FILTER (method = 'Periodic') AS t FROM cell GROUP BY 1, 2)
SELECT family, load, method, round(v, 6) AS v, round(o - b, 6) AS own_gain, round(t - o, 6) AS own_gap, round(v - b, 6) AS gain, round(t - v, 6) AS gap FROM cell JOIN c USING (family, load)""")
def relative_metrics(spark, sf):
    out = res.relative_metrics(cells(spark, sf), ["family", "load"], "method", "v", "NoRetrain", "Adaptive", "Periodic")
    return out.select("family", "load", "method", *r6("v", "own_gain", "own_gap", "gain", "gap"))


@query("method_matrix", f"""WITH {CELL_SQL} SELECT family, load, round(max(v) FILTER (method = 'NoRetrain'), 6) AS "NoRetrain",
  round(max(v) FILTER (method = 'Periodic'), 6) AS "Periodic", round(max(v) FILTER (method = 'Adaptive'), 6) AS "Adaptive" FROM cell GROUP BY 1, 2""")
def method_matrix(spark, sf):
    return res.pivot_methods(cells(spark, sf), ["family", "load"], "method", "v", METHODS).select("family", "load", *r6(*METHODS))


@query("noretrain_curve", f"""WITH {CELL_SQL} SELECT family, load, round(least(1.0, 1.0 / greatest(load * 50, 1e-9)), 6) AS expected_coverage, round(v, 6) AS actual FROM cell WHERE method = 'NoRetrain'""")
def noretrain_curve(spark, sf):
    rows = cells(spark, sf).where("method = 'NoRetrain'")
    cover = F.least(F.lit(1.0), 1.0 / F.greatest(F.col("load") * 50, F.lit(1e-9)))
    return rows.select("family", "load", F.round(cover, 6).alias("expected_coverage"), F.round("v", 6).alias("actual"))


SPREAD_SQL = f"""{CELL_SQL}, sp AS (SELECT family, load, count(*) AS methods, max(v) - min(v) AS spread, max_by(method, v) AS best_method, max(v) AS best_value FROM cell GROUP BY 1, 2)"""


@query("spread_diagnostics", f"""WITH {SPREAD_SQL} SELECT family, load, methods, round(spread, 6) AS spread, best_method, round(best_value, 6) AS best_value FROM sp""")
def spread_diagnostics(spark, sf):
    return res.method_spread(cells(spark, sf), ["family", "load"], "method", "v").select("family", "load", "methods", "best_method", *r6("spread", "best_value"))


@query("spread_by_family", f"""WITH {SPREAD_SQL} SELECT family, max_by(load, spread) AS peak_load, round(max(spread), 6) AS max_spread FROM sp GROUP BY 1""")
def spread_by_family(spark, sf):
    sp = res.method_spread(cells(spark, sf), ["family", "load"], "method", "v")
    top = F.struct(F.col("spread"), -F.col("load"))
    return sp.groupBy("family").agg(F.max_by("load", top).alias("peak_load"), F.round(F.max("spread"), 6).alias("max_spread"))


@query("scenario_aggregate", f"""WITH {FACTS_SQL} SELECT load, method, round(avg(acc), 6) AS long_mean, round(coalesce(stddev_samp(acc), 0), 6) AS long_std,
  sum((disc > 0.05)::INT) AS replaced, count(*) AS n, (SELECT string_agg(s, ';' ORDER BY s) FROM (SELECT DISTINCT seed::VARCHAR AS s FROM facts f2 WHERE f2.load = facts.load AND f2.method = facts.method)) AS seed_ids
FROM facts GROUP BY load, method""")
def scenario_aggregate(spark, sf):
    f = facts(spark, sf)
    return f.groupBy("load", "method").agg(
        F.round(F.avg("acc"), 6).alias("long_mean"), F.round(res.std0(F.col("acc")), 6).alias("long_std"),
        F.sum((F.col("disc") > 0.05).cast("int")).alias("replaced"), F.count(F.lit(1)).alias("n"),
        F.concat_ws(";", F.sort_array(F.collect_set(F.col("seed").cast("string")))).alias("seed_ids"),  # a few seeds
    )


@query("resource_summary", f"""WITH {FACTS_SQL} SELECT load, round(avg(acc), 6) AS inference, round(avg(CASE WHEN disc > 0 THEN 1 - acc ELSE 0 END), 6) AS training,
  round(avg(CASE WHEN disc > 0 THEN 0 ELSE 1 - acc END), 6) AS unused, sum((disc > 0)::INT) AS active FROM facts GROUP BY 1""")
def resource_summary(spark, sf):
    acc, trains = F.col("acc"), F.col("disc") > 0
    return facts(spark, sf).groupBy("load").agg(
        F.round(F.avg(acc), 6).alias("inference"), F.round(F.avg(F.when(trains, 1 - acc).otherwise(0.0)), 6).alias("training"),
        F.round(F.avg(F.when(trains, 0.0).otherwise(1 - acc)), 6).alias("unused"), F.sum(trains.cast("int")).alias("active"),
    )


@query("best_methods", f"""WITH {FACTS_SQL}, m AS (SELECT 'fpr' AS metric, method, avg(disc) AS value FROM facts GROUP BY 2 UNION ALL SELECT 'macro', method, avg(acc) FROM facts GROUP BY 2)
SELECT metric, method, round(value, 6) AS value FROM m WHERE abs(value - (SELECT CASE WHEN m2.metric = 'fpr' THEN min(m2.value) ELSE max(m2.value) END FROM m m2 WHERE m2.metric = m.metric GROUP BY m2.metric)) <= 1e-12""")
def best_methods(spark, sf):
    per = facts(spark, sf).groupBy("method").agg(F.avg("disc").alias("fpr"), F.avg("acc").alias("macro"))
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("fpr", "macro")])
    rows = per.select("method", F.explode(pairs).alias("p")).select("method", "p.*")
    return sig.tied_best(rows, "metric", "value", "method", ["fpr"]).withColumn("value", F.round("value", 6))


# ------------------------------------------------------------------ profiles (part) and quantiles


@query("pareto", """SELECT p_partkey, p_brand, p_size, p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_brand = a.p_brand
  AND b.p_retailprice >= a.p_retailprice AND b.p_size <= a.p_size AND (b.p_retailprice > a.p_retailprice OR b.p_size < a.p_size))""")
def pareto(spark, sf):
    part = table(spark, sf, "part", "p_partkey", "p_brand", "p_size", "p_retailprice")
    return res.pareto(part, ["p_brand"], "p_retailprice", "p_size").select("p_partkey", "p_brand", "p_size", "p_retailprice")


@query("capacity_diagnostics", """WITH d AS (SELECT DISTINCT p_brand, p_retailprice / 100 AS t FROM part), s AS (SELECT p_brand, count(*) AS configs, min(t) AS lo, median(t) AS med, max(t) AS hi FROM d GROUP BY 1),
r AS (SELECT unnest([9.0, 9.1, 9.25, 9.5, 9.75, 9.9, 10.0]) AS rate)
SELECT p_brand, configs, round(lo, 6) AS lo, round(med, 6) AS med, round(hi, 6) AS hi, (SELECT min(rate)::DOUBLE FROM r WHERE rate > lo) AS above_lo,
  (SELECT min(rate)::DOUBLE FROM r WHERE rate > med) AS above_med, (SELECT min(rate)::DOUBLE FROM r WHERE rate > hi) AS above_hi FROM s""")
def capacity_diagnostics(spark, sf):
    """Distinct throughputs per brand and the first arrival rate above the smallest, median and largest one."""
    rates = [9.0, 9.1, 9.25, 9.5, 9.75, 9.9, 10.0]
    d = table(spark, sf, "part", "p_brand", (F.col("p_retailprice") / 100).alias("t")).distinct()
    q = exact_quantiles(d, ["p_brand"], "t", [0.0, 0.5, 1.0], ["lo", "med", "hi"])

    def above_of(c):
        return F.array_min(F.filter(F.array(*[F.lit(r) for r in rates]), lambda r: r > F.col(c))).alias(f"above_{c}")

    above = [above_of(c) for c in ("lo", "med", "hi")]
    return q.select("p_brand", F.col("n").alias("configs"), *r6("lo", "med", "hi"), *above)


@query("profile_normalise", """SELECT p_brand, p_type, count(*) AS seeds, round(avg(coalesce(CASE WHEN p_size > 10 THEN p_size END, p_retailprice / 100.0)), 6) AS train_time,
  round(avg(coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_retailprice / 1009.0 END, p_size / 53.0)), 6) AS gain FROM part GROUP BY 1, 2""")
def profile_normalise(spark, sf):
    p = table(spark, sf, "part", "p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    time = F.coalesce(F.when(F.col("p_size") > 10, F.col("p_size").cast("double")), F.col("p_retailprice") / 100.0)
    gain = F.coalesce(F.when(F.col("p_partkey") % 3 == 0, F.col("p_retailprice") / 1009.0), F.col("p_size") / 53.0)
    return p.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("seeds"), F.round(F.avg(time), 6).alias("train_time"), F.round(F.avg(gain), 6).alias("gain"))


@query("detail_flags", """SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey DESC) = 1 AS selected FROM part""")
def detail_flags(spark, sf):
    """Mark the profile rows a method chose (here the most accurate one of each brand)."""
    p = table(spark, sf, "part", "p_partkey", "p_brand", "p_retailprice")
    chosen = p.groupBy("p_brand").agg(F.max_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("p_partkey")).withColumn("_sel", F.lit(True))
    return p.join(chosen, ["p_brand", "p_partkey"], "left").select("p_partkey", "p_brand", F.coalesce("_sel", F.lit(False)).alias("selected"))


@query("latency_summary", """SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice / 105001.0), 6) AS mean, round(quantile_cont(l_extendedprice / 105001.0, 0.5), 6) AS p50,
  round(quantile_cont(l_extendedprice / 105001.0, 0.95), 6) AS p95, round(quantile_cont(l_extendedprice / 105001.0, 0.99), 6) AS p99 FROM lineitem GROUP BY 1""")
def latency_summary(spark, sf):
    li = table(spark, sf, "lineitem", "l_returnflag", (F.col("l_extendedprice") / SCALE).alias("ms"))
    q = exact_quantiles(li, ["l_returnflag"], "ms", [0.5, 0.95, 0.99], ["p50", "p95", "p99"])
    means = li.groupBy("l_returnflag").agg(F.avg("ms").alias("mean"))
    return q.join(means, "l_returnflag").select("l_returnflag", "n", *r6("mean", "p50", "p95", "p99"))


@query("linear_quantile", """SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.25), 4) AS q25, round(median(value), 4) AS median, round(quantile_cont(value, 0.9), 4) AS q90 FROM events GROUP BY 1""")
def linear_quantile(spark, sf):
    q = exact_quantiles(table(spark, sf, "events", "event_type", "value"), ["event_type"], "value", [0.25, 0.5, 0.9], ["q25", "median", "q90"])
    return q.select("event_type", "n", *[F.round(c, 4).alias(c) for c in ("q25", "median", "q90")])


@query("nearest_rank_pct", """WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, max(n) AS n, max(n_chars) FILTER (rn = greatest(1, ceil(0.95 * n))) AS p95, (max(n_chars) FILTER (rn = greatest(1, ceil(0.95 * n))) // 784) * 784 AS aligned FROM r GROUP BY 1""")
def nearest_rank_pct(spark, sf):
    """Nearest-rank 95th percentile of size, aligned down to a multiple of 28*28."""
    from tidegauge.core.scan import prefix_scan

    docs = table(spark, sf, "documents", "lang", "n_chars")
    counts = docs.groupBy("lang", "n_chars").agg(F.count(F.lit(1)).alias("_m"))
    ran = prefix_scan(counts, ["lang"], ["n_chars"], {"_cum": ("sum", F.col("_m"))}, axis=F.col("n_chars"))
    sized = ran.join(docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang")
    rank = F.greatest(F.lit(1), F.ceil(0.95 * F.col("n")))
    p95 = F.min(F.when(F.col("_cum") >= rank, F.col("n_chars")))
    return sized.groupBy("lang", "n").agg(p95.alias("p95")).withColumn("aligned", F.floor(F.col("p95") / 784) * 784)


@query("loss_format_summary", """WITH e AS (SELECT event_type AS format, value, CASE WHEN ('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT % 2 = 0 THEN 'cal' ELSE 'test' END AS split FROM events),
g AS (SELECT quantile_cont(value, 0.95) AS q FROM e WHERE split = 'cal')
SELECT split, format, count(*) AS n, round(sum(value), 4) AS total, round(median(value), 4) AS median, round(quantile_cont(value, 0.95), 4) AS q95,
  round(avg((value > q)::INT), 6) AS above FROM e, g GROUP BY 1, 2""")
def loss_format_summary(spark, sf):
    h = smp.hex_int(F.substring(F.md5(F.col("event_id").cast("string")), 1, 8)) % 2 == 0
    e = table(spark, sf, "events", "event_id", F.col("event_type").alias("format"), "value").withColumn("split", F.when(h, "cal").otherwise("test"))
    limit = exact_quantiles(e.where("split = 'cal'"), [], "value", [0.95], ["q"]).select("q")
    q = exact_quantiles(e, ["split", "format"], "value", [0.5, 0.95], ["median", "q95"])
    means = e.join(F.broadcast(limit)).groupBy("split", "format").agg(  # one row
        F.round(F.sum("value"), 4).alias("total"), F.round(F.avg((F.col("value") > F.col("q")).cast("double")), 6).alias("above")
    )
    return q.join(means, ["split", "format"]).select("split", "format", "n", "total", F.round("median", 4).alias("median"), F.round("q95", 4).alias("q95"), "above")


@query("loss_task_summary", """SELECT lang, count(*) AS n, round(avg(ln(n_chars)), 6) AS mean_nll, round(avg(length(text) / 4.0), 4) AS mean_tokens, sum(n_chars) AS elapsed FROM documents GROUP BY 1""")
def loss_task_summary(spark, sf):
    d = table(spark, sf, "documents", "lang", "text", "n_chars")
    return d.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.log("n_chars")), 6).alias("mean_nll"),
        F.round(F.avg(F.length("text") / 4.0), 4).alias("mean_tokens"), F.sum("n_chars").alias("elapsed"),
    )


@query("task_counts", "SELECT lang AS task, source AS format, count(*) AS n FROM documents GROUP BY 1, 2")
def task_counts(spark, sf):
    return table(spark, sf, "documents", "lang", "source").groupBy(F.col("lang").alias("task"), F.col("source").alias("format")).agg(F.count(F.lit(1)).alias("n"))


@query("label_summary", """WITH c AS (SELECT p_brand, count(*) AS c FROM part GROUP BY 1), t AS (SELECT * FROM c ORDER BY c DESC, p_brand LIMIT 8)
SELECT sum(c) AS rows, count(*) AS classes, min(c) AS min_class, median(c) AS median_class, max(c) AS max_class,
  (SELECT string_agg(p_brand || '=' || c, ';' ORDER BY c DESC, p_brand) FROM t) AS top FROM c""")
def label_summary(spark, sf):
    return res.top_counts(table(spark, sf, "part", "p_brand"), "p_brand")


# ------------------------------------------------------------------ selection and audits

GRID_SQL = f"""{FACTS_SQL}, cfg AS (SELECT seed AS fold, family AS feature_group, load AS q, method AS pca, avg(acc) AS dev_macro, avg(disc) AS dev_fpr, avg(acc * disc) AS test_macro FROM facts GROUP BY 1, 2, 3, 4)"""


def configs(spark, sf):
    return facts(spark, sf).groupBy(
        F.col("seed").alias("fold"), F.col("family").alias("feature_group"), F.col("load").alias("q"), F.col("method").alias("pca")
    ).agg(F.avg("acc").alias("dev_macro"), F.avg("disc").alias("dev_fpr"), F.avg(F.col("acc") * F.col("disc")).alias("test_macro"))


@query("nested_select", f"""WITH {GRID_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY dev_macro DESC, dev_fpr, length(feature_group), pca, q) AS k FROM cfg)
SELECT 'nested' AS protocol, fold, feature_group, pca, q, round(test_macro, 6) AS test_macro FROM r WHERE k = 1
UNION ALL SELECT 'fixed', fold, feature_group, pca, q, round(test_macro, 6) FROM cfg WHERE feature_group = 'F' AND pca = 'Adaptive' AND q = 0.03""")
def nested_select(spark, sf):
    """Best development configuration per held-out fold, beside the fixed main configuration."""
    c = configs(spark, sf)
    key = F.struct((-F.col("dev_macro")).alias("a"), "dev_fpr", F.length("feature_group").alias("c"), "pca", "q")
    best = c.groupBy("fold").agg(F.min_by(F.struct(*[x for x in c.columns if x != "fold"]), key).alias("r")).select(F.lit("nested").alias("protocol"), "fold", "r.*")
    fixed = c.where("feature_group = 'F' AND pca = 'Adaptive' AND q = 0.03").select(F.lit("fixed").alias("protocol"), *c.columns)
    return best.unionByName(fixed).select("protocol", "fold", "feature_group", "pca", "q", F.round("test_macro", 6).alias("test_macro"))


@query("one_axis_slice", f"""WITH {GRID_SQL} SELECT 'q' AS axis, q AS value, q = 0.03 AS is_main, count(*) AS folds, count(DISTINCT fold) = (SELECT count(DISTINCT fold) FROM cfg) AS complete,
  round(avg(dev_macro), 6) AS mean, round(coalesce(stddev_samp(dev_macro), 0), 6) AS std, round(min(dev_macro), 6) AS worst, min_by(fold, dev_macro) AS worst_fold
FROM cfg WHERE feature_group = 'F' AND pca = 'Adaptive' GROUP BY q""")
def one_axis_slice(spark, sf):
    c = configs(spark, sf)
    total = c.agg(F.countDistinct("fold").alias("_all"))
    main = c.where("feature_group = 'F' AND pca = 'Adaptive'").groupBy("q").agg(
        F.count(F.lit(1)).alias("folds"), F.countDistinct("fold").alias("_d"), F.round(F.avg("dev_macro"), 6).alias("mean"),
        F.round(res.std0(F.col("dev_macro")), 6).alias("std"), F.round(F.min("dev_macro"), 6).alias("worst"),
        F.min_by("fold", F.struct("dev_macro", "fold")).alias("worst_fold"),
    )
    return main.join(F.broadcast(total)).select(  # one row
        F.lit("q").alias("axis"), F.col("q").alias("value"), (F.col("q") == 0.03).alias("is_main"), "folds",
        (F.col("_d") == F.col("_all")).alias("complete"), "mean", "std", "worst", "worst_fold",
    )


@query("ablation_rank", f"""WITH {FACTS_SQL}, g AS (SELECT method || '+' || family AS feature_group, avg(acc) AS macro, sum(acc * load) / sum(load) AS weighted, avg(disc) AS fpr FROM facts GROUP BY 1
UNION ALL SELECT method, avg(acc), sum(acc * load) / sum(load), avg(disc) FROM facts GROUP BY 1)
SELECT feature_group, round(macro, 6) AS macro, CASE 2 - len(list_filter(string_split(feature_group, '+'), lambda s: s IN ('Adaptive', 'F'))) WHEN 0 THEN 'full' WHEN 1 THEN 'minus_one' WHEN 2 THEN 'minus_two' ELSE 'other' END AS kind,
  rank() OVER (ORDER BY macro DESC, weighted DESC, fpr, len(string_split(feature_group, '+'))) AS rank FROM g""")
def ablation_rank(spark, sf):
    f = facts(spark, sf)
    both = f.withColumn("feature_group", F.explode(F.array(F.concat_ws("+", "method", "family"), F.col("method"))))
    g = both.groupBy("feature_group").agg(
        F.avg("acc").alias("macro"), (F.sum(F.col("acc") * F.col("load")) / F.sum("load")).alias("weighted"), F.avg("disc").alias("fpr")
    )
    parts = F.split("feature_group", "\\+")
    missing = F.size(F.array_except(F.array(F.lit("Adaptive"), F.lit("F")), parts))
    kind = F.when(missing == 0, "full").when(missing == 1, "minus_one").when(missing == 2, "minus_two").otherwise("other")
    w = res.Window.orderBy(F.desc("macro"), F.desc("weighted"), "fpr", F.size(parts))  # a handful of feature groups
    return g.select("feature_group", F.round("macro", 6).alias("macro"), kind.alias("kind"), F.rank().over(w).alias("rank"))


CAND_SQL = """inv AS (SELECT p_brand AS task, count(*) AS rows FROM part GROUP BY 1),
m AS (SELECT p_brand AS task, avg(p_size / 53.0) FILTER (p_partkey % 2 = 0) AS b0, avg(p_size / 53.0) FILTER (p_partkey % 2 = 1) AS b1,
  avg(p_retailprice / 1009.0) FILTER (p_partkey % 2 = 0) AS a0, avg(p_retailprice / 1009.0) FILTER (p_partkey % 2 = 1) AS a1 FROM part GROUP BY 1),
c AS (SELECT task, rows, (b0 + b1) / 2 AS mean_base, ((a0 - b0) + (a1 - b1)) / 2 AS mean_gain FROM m JOIN inv USING (task) WHERE rows >= 60 AND b0 IS NOT NULL AND b1 IS NOT NULL),
d AS (SELECT *, mean_gain + greatest(0.0, 0.6 - mean_base) AS drift_score FROM c)"""


@query("topk_candidates", f"""WITH {CAND_SQL}
SELECT * FROM (SELECT 'reference' AS role, task, round(mean_base, 6) AS score FROM d ORDER BY mean_base DESC, rows DESC LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'drift', task, round(drift_score, 6) FROM d ORDER BY drift_score DESC, mean_gain DESC LIMIT 5)""")
def topk_candidates(spark, sf):
    """Screening rows of two models per task: best references by mean base, best drift tasks by gain plus headroom."""
    p = table(spark, sf, "part", "p_partkey", F.col("p_brand").alias("task"), "p_size", "p_retailprice")
    model = (F.col("p_partkey") % 2).alias("model")
    per = p.groupBy("task", model).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.col("p_size") / 53.0).alias("base"), F.avg(F.col("p_retailprice") / 1009.0).alias("adapted")
    )
    t = per.groupBy("task").agg(
        F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("models"), F.avg("base").alias("mean_base"),
        F.avg(F.col("adapted") - F.col("base")).alias("mean_gain"),
    ).where("rows >= 60 AND models = 2")
    t = t.withColumn("drift_score", F.col("mean_gain") + F.greatest(F.lit(0.0), 0.6 - F.col("mean_base")))
    ref = t.orderBy(F.desc("mean_base"), F.desc("rows")).limit(5).select(F.lit("reference").alias("role"), "task", F.round("mean_base", 6).alias("score"))
    drift = t.orderBy(F.desc("drift_score"), F.desc("mean_gain")).limit(5).select(F.lit("drift").alias("role"), "task", F.round("drift_score", 6).alias("score"))
    return ref.unionByName(drift)


@query("dedup_first", """WITH u AS (SELECT o_custkey AS uid, o_orderkey AS line, 0 AS src FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT c_custkey, c_custkey, 1 FROM customer)
SELECT uid, arg_min(line, (src, line)) AS line FROM u GROUP BY 1""")
def dedup_first(spark, sf):
    a = table(spark, sf, "orders", F.col("o_custkey").alias("uid"), F.col("o_orderkey").alias("line"), "o_orderstatus").where("o_orderstatus = 'F'").drop("o_orderstatus")
    b = table(spark, sf, "customer", F.col("c_custkey").alias("uid"), F.col("c_custkey").alias("line"))
    return res.keep_first([a, b], "uid", "line")


@query("uniqueness_audit", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def uniqueness_audit(spark, sf):
    return res.duplicates(table(spark, sf, "lineitem", "l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@query("completeness_audit", f"""WITH {FACTS_SQL}, k AS (SELECT DISTINCT grp, load, method FROM facts), e AS (SELECT * FROM (SELECT s_suppkey AS grp FROM supplier), (SELECT DISTINCT load FROM facts), (SELECT DISTINCT method FROM facts))
SELECT grp, load, method, 'missing' AS problem FROM (SELECT * FROM e EXCEPT SELECT * FROM k) UNION ALL SELECT grp, load, method, 'unexpected' FROM (SELECT * FROM k EXCEPT SELECT * FROM e)
UNION ALL SELECT -1, NULL, 'observed', count(*)::VARCHAR FROM k""")
def completeness_audit(spark, sf):
    f = facts(spark, sf)
    dims = ["grp", "load", "method"]
    combos = res.expected_grid(f, ["load", "method"])
    packed = combos.agg(F.collect_list(F.struct("load", "method")).alias("c"))  # loads x methods
    expected = table(spark, sf, "supplier", F.col("s_suppkey").alias("grp")).join(F.broadcast(packed)).select("grp", F.explode("c").alias("c")).select("grp", "c.*")
    seen = f.select(*dims).distinct().agg(F.count(F.lit(1)).alias("k")).select(
        F.lit(-1).cast("bigint").alias("grp"), F.lit(None).cast("double").alias("load"), F.lit("observed").alias("method"), F.col("k").cast("string").alias("problem")
    )
    return res.completeness(f, dims, expected).unionByName(seen)


@query("selection_audit", f"""WITH {GRID_SQL} SELECT pca AS method, count(*) AS configs, sum((dev_fpr <= 0.05)::INT) AS feasible, sum((dev_fpr > 0.05 AND dev_macro > 0.4)::INT) AS violations FROM cfg GROUP BY 1""")
def selection_audit(spark, sf):
    """Selected rows (macro above 0.4) must obey the target rate."""
    over = F.col("dev_fpr") > 0.05
    return configs(spark, sf).groupBy(F.col("pca").alias("method")).agg(
        F.count(F.lit(1)).alias("configs"), F.sum((~over).cast("int")).alias("feasible"),
        F.sum((over & (F.col("dev_macro") > 0.4)).cast("int")).alias("violations"),
    )


@query("range_audit", """SELECT 'rate' AS "check", sum((NOT l_discount BETWEEN 0 AND 1)::BIGINT)::BIGINT AS failures FROM lineitem
UNION ALL SELECT 'delay', sum((NOT (l_quantity > 0 AND l_quantity <= 200))::BIGINT)::BIGINT FROM lineitem UNION ALL SELECT 'share', sum((NOT l_tax < 0.08)::BIGINT)::BIGINT FROM lineitem""")
def range_audit(spark, sf):
    li = table(spark, sf, "lineitem", "l_discount", "l_quantity", "l_tax")
    return res.range_problems(li, {
        "rate": F.col("l_discount").between(0, 1), "delay": (F.col("l_quantity") > 0) & (F.col("l_quantity") <= 200), "share": F.col("l_tax") < 0.08,
    })


@query("metric_recompute_audit", f"""WITH {SEED_SQL},
st AS (SELECT method, family, load, avg(acc) AS m, coalesce(stddev_samp(acc), 0) AS s, count(acc) AS n, sum(acc) AS t, sum(acc * acc) AS q FROM runs GROUP BY 1, 2, 3),
df AS (SELECT greatest(abs(m - t / n), abs(s - CASE WHEN n > 1 THEN sqrt(greatest((q - t * t / n) / (n - 1), 0)) ELSE 0 END)) AS d FROM st)
SELECT count(*) AS cells, round(max(d), 5) AS max_diff, sum((d > 1e-6)::INT) AS mismatches FROM df""")
def metric_recompute_audit(spark, sf):
    """Stored seed statistics against their recomputation from counts, sums and sums of squares."""
    runs = seed_runs(spark, sf)
    keys = ["method", "family", "load"]
    stored = res.mean_std(runs, keys, ["acc"])
    sums = runs.groupBy(*keys).agg(F.count("acc").alias("c"), F.sum("acc").alias("t"), F.sum(F.col("acc") * F.col("acc")).alias("q"))
    spread = F.sqrt(F.greatest((F.col("q") - F.col("t") * F.col("t") / F.col("c")) / (F.col("c") - 1), F.lit(0.0)))
    again = F.when(F.col("c") > 1, spread).otherwise(0.0)
    diff = F.greatest(F.abs(F.col("acc_mean") - F.col("t") / F.col("c")), F.abs(F.col("acc_std") - again))
    return stored.join(sums, keys).agg(
        F.count(F.lit(1)).alias("cells"), F.round(F.max(diff), 5).alias("max_diff"), F.sum((diff > 1e-6).cast("bigint")).alias("mismatches")
    )


@query("uid_set_hash", """WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY md5('boot:' || doc_id), doc_id) - 1 AS idx FROM documents)
SELECT idx // 25 AS block, sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id::VARCHAR)) AS uid_hash, count(*) AS uids FROM d GROUP BY 1""")
def uid_set_hash(spark, sf):
    """Hash of each block of 25 ids: the sets are size-bounded."""
    pool = smp.pool_index(table(spark, sf, "documents", "doc_id"), "doc_id", "boot")
    return res.uid_hash(pool.withColumn("block", F.floor(F.col("idx") / 25)), ["block"], "doc_id")
