"""Budget and replay queries: profiles come from part (group = type), test rows from orders (group = customer mod 6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.core.scan import exact_quantiles
from tidegauge.core.session import table
from tidegauge.operators import budget as bud
from tidegauge.operators import results as res
from tidegauge.plans.predictions import hash100
from tidegauge.plans.registry import query

TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
RATE, N_REF, DELAY = 2.0, 110.0, 3.0
LOADS = [0.5, 1.0, 1.4]

PROFILE_SQL = """lam AS (SELECT p_type AS grp, p_partkey AS lam, 0.3 + (p_partkey * 7919 % 10007) / 20014.0 AS acc, 1 + (p_partkey * 7 % 40) / 10.0 AS thr FROM part WHERE p_partkey % 4 = 0),
gam AS (SELECT p_type AS grp, p_partkey AS gam, (p_partkey * 104729 % 10009) / 33363.0 AS gain, 5 + (p_partkey * 1299709 % 10037) / 250.0 AS train, (p_size % 20) / 40.0 AS gcost FROM part WHERE p_partkey % 4 = 1)"""


def profiles(spark, sf):
    p = table(spark, sf, "part", "p_partkey", "p_type", "p_size")
    k = F.col("p_partkey")
    lam = p.where(k % 4 == 0).select(F.col("p_type").alias("grp"), k.alias("lam"), (0.3 + (k * 7919 % 10007) / 20014.0).alias("acc"), (1 + (k * 7 % 40) / 10.0).alias("thr"))
    gam = p.where(k % 4 == 1).select(
        F.col("p_type").alias("grp"), k.alias("gam"), ((k * 104729 % 10009) / 33363.0).alias("gain"), (5 + (k * 1299709 % 10037) / 250.0).alias("train"), ((F.col("p_size") % 20) / 40.0).alias("gcost")
    )
    return lam, gam


def choice_sql(loads) -> str:
    """The whole search as written: every share, every inference profile, every training profile."""
    ls = ", ".join(f"({float(x)}::DOUBLE, {RATE * x}::DOUBLE, {N_REF / (RATE * x)}::DOUBLE)" for x in loads)
    return f"""{PROFILE_SQL}, ld(load, rate, h) AS (VALUES {ls}),
grid AS (SELECT DISTINCT load, rate, h, grp, I FROM (SELECT load, rate, h, grp, i / 100.0 AS I FROM ld, (SELECT DISTINCT grp FROM lam), (SELECT unnest(range(1, 100)) AS i)
  UNION ALL SELECT load, rate, h, grp, least(1.0, rate / thr) FROM ld, lam UNION ALL SELECT load, rate, h, grp, greatest(0.0, 1 - gcost) FROM ld, gam) WHERE I > 0 AND I <= 1),
nt AS (SELECT load, h, grp, lam, acc, rate / thr AS cost, I, 1 - I AS R, least(1.0, I / greatest(rate / thr, 1e-9)) AS cov FROM grid JOIN lam USING (grp) WHERE rate / thr <= I + 1e-9),
b AS (SELECT load, grp, I, max(acc * cov) AS top FROM nt GROUP BY ALL),
tr AS (SELECT nt.*, gam, train / greatest(R, 1e-9) AS finish, least(1.0, acc + gain) * cov AS future FROM nt JOIN gam USING (grp) WHERE R + 1e-9 >= gcost),
tu AS (SELECT *, least(1.0, finish / h) * acc * cov + (1 - least(1.0, finish / h)) * future AS utility, greatest(0.0, 1 - (finish + {DELAY}) / h) AS active FROM tr),
cand AS (SELECT load, grp, lam, NULL::BIGINT AS gam, I, R, acc, cost, NULL::DOUBLE AS finish, 0.0::DOUBLE AS active, acc * cov AS utility, acc * cov AS future FROM nt
  UNION ALL SELECT load, grp, lam, gam, I, R, acc, cost, finish, active, utility, future FROM tu JOIN b USING (load, grp, I) WHERE active >= 0.2 AND utility - top >= 0.005),
best AS (SELECT load, grp, arg_max({{'lam': lam, 'gam': gam, 'I': I, 'R': R, 'finish': finish, 'active': active, 'utility': utility, 'future': future}},
  {{'a': utility, 'b': future, 'c': acc, 'd': -cost, 'e': R, 'f': -lam, 'g': -coalesce(gam, 0)}}) AS r FROM cand GROUP BY 1, 2)"""


CHOICE_COLS = ["I", "R", "finish", "active", "utility", "future"]
CHOICE_OUT = "grp, r.lam AS lam, r.gam AS gam, " + ", ".join(f'round(r.{c}, 6) AS "{c}"' for c in CHOICE_COLS)


def choices(spark, sf, loads):
    lam, gam = profiles(spark, sf)
    each = F.explode(F.array(*[F.lit(float(x)) for x in loads])).alias("load")
    lam = bud.with_cost(lam.select("*", each), RATE * F.col("load"))
    return bud.grid_choice(lam, gam.select("*", each), ["load", "grp"], N_REF / (RATE * F.col("load")), DELAY, 0.2, 0.005)


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


@query("budget_grid_choice", f"WITH {choice_sql([1.0])} SELECT {CHOICE_OUT} FROM best")
def budget_grid_choice(spark, sf):
    return choices(spark, sf, [1.0]).select("grp", "lam", "gam", *r6(*CHOICE_COLS))


@query("load_sweep", f"WITH {choice_sql(LOADS)} SELECT load, {CHOICE_OUT} FROM best")
def load_sweep(spark, sf):
    return choices(spark, sf, LOADS).select("load", "grp", "lam", "gam", *r6(*CHOICE_COLS))


OWN_SQL = f"""{PROFILE_SQL}, og AS (SELECT l.grp, l.lam, g.gam, least(1.0, l.acc + g.gain) AS post, train FROM gam g JOIN lam l ON l.lam = g.gam - 1)"""


def own_profiles(spark, sf):
    """Training rows measured on one inference profile each (the part before them)."""
    lam, gam = profiles(spark, sf)
    own = gam.drop("grp").withColumn("lam", F.col("gam") - 1).join(lam.select("grp", "lam", "acc"), "lam")
    return lam, own.select("grp", "lam", "gam", F.least(F.lit(1.0), F.col("acc") + F.col("gain")).alias("post"), "train")


@query("budget_grid_choice_v2", f"""WITH {OWN_SQL}, grid AS (SELECT DISTINCT grp, I FROM (SELECT grp, unnest(range(1, 101)) / 100.0 AS I FROM lam UNION ALL SELECT grp, least(1.0, 5.0 / thr) FROM lam)),
nt AS (SELECT grp, lam, acc, 5.0 / thr AS cost, I, least(1.0, I / (5.0 / thr)) AS cov FROM grid JOIN lam USING (grp)),
tr AS (SELECT nt.*, gam, post, train / (1 - I) AS finish FROM nt JOIN og USING (grp, lam) WHERE I < 1),
tu AS (SELECT *, cov * (least(1.0, finish / 22.0) * acc + greatest(0.0, 1 - finish / 22.0) * post) AS est, greatest(0.0, 1 - (finish + {DELAY}) / 22.0) AS active FROM tr),
cand AS (SELECT grp, lam, NULL::BIGINT AS gam, I, cov, NULL::DOUBLE AS ready, acc * cov AS est, acc * cov AS future FROM nt UNION ALL
  SELECT grp, lam, gam, I, cov, {DELAY} + finish, est, cov * post FROM tu WHERE active >= 0.2 AND est - acc * cov >= 0.005),
best AS (SELECT grp, arg_max({{'lam': lam, 'gam': gam, 'I': I, 'cov': cov, 'ready': ready, 'est': est, 'future': future}}, {{'a': est, 'b': future, 'c': 1 - I, 'd': lam, 'e': coalesce(gam, -1)}}) AS r FROM cand GROUP BY 1)
SELECT grp, r.lam AS lam, r.gam AS gam, round(r.I, 6) AS "I", round(r.cov, 6) AS cov, round(r.ready, 6) AS ready, round(r.est, 6) AS estimate, round(r.future, 6) AS future FROM best""")
def budget_grid_choice_v2(spark, sf):
    lam, own = own_profiles(spark, sf)
    out = bud.grid_choice_partial(bud.with_cost(lam, F.lit(5.0)), own, ["grp"], F.lit(22.0), DELAY, 0.2, 0.005)
    return out.select("grp", "lam", "gam", *r6("I", "cov", "ready", "estimate", "future"))


LONG_SQL = "(cur + 2.439 * fut) / 3.439"  # three future windows, discount 0.9


def estimate_sql(src: str, margin: float = 0.0, ceiling: float = 1.0) -> str:
    """CTE est over ``src(keys.., acc, cost, gain, train, gcost, I, R)`` with window 60."""
    return f"""e0 AS (SELECT *, least(1.0, I / greatest(cost, 1e-9)) AS cov FROM {src}),
e1 AS (SELECT *, cov * acc AS base, train / greatest(R, 1e-9) AS finish, R >= gcost AS can, least({ceiling}::DOUBLE, acc + gain) * cov AS upd FROM e0),
e2 AS (SELECT *, coalesce(can AND finish <= 60 AND upd >= base + {margin}::DOUBLE, false) AS rep FROM e1),
e3 AS (SELECT *, CASE WHEN rep THEN least(1.0, finish / 60) * base + (1 - least(1.0, finish / 60)) * upd ELSE base END AS cur, CASE WHEN rep THEN upd ELSE base END AS fut FROM e2),
est AS (SELECT *, {LONG_SQL} AS lng FROM e3)"""


def estimated(df, margin=0.0, ceiling=1.0):
    c = [F.col(x) for x in ("acc", "cost", "gain", "train", "gcost", "I", "R")]
    return df.withColumn("e", bud.estimate(*c, 60.0, 3, 0.9, margin, ceiling))


def estimate_table(spark, sf, margin=0.0, ceiling=1.0):
    lam, gam = profiles(spark, sf)
    pairs = gam.drop("grp").withColumn("lam", F.col("gam") - 1).join(bud.with_cost(lam, F.lit(2.0)), "lam").withColumn("I", F.lit(0.55)).withColumn("R", F.lit(0.45))
    e = estimated(pairs, margin, ceiling)
    return e.select("lam", "gam", F.round("e.current", 6).alias("current"), F.round("e.future", 6).alias("future"), F.round("e.long", 6).alias("long_avg"), F.round("e.finish", 6).alias("finish"), F.col("e.replaced").alias("replaced"))


def estimate_twin(margin=0.0, ceiling=1.0) -> str:
    return f"""WITH {PROFILE_SQL}, pr AS (SELECT l.grp, l.lam, g.gam, acc, 2.0 / thr AS cost, gain, train, gcost, 0.55 AS I, 0.45 AS R FROM gam g JOIN lam l ON l.lam = g.gam - 1), {estimate_sql('pr', margin, ceiling)}
SELECT lam, gam, round(cur, 6) AS current, round(fut, 6) AS future, round(lng, 6) AS long_avg, round(CASE WHEN can THEN finish END, 6) AS finish, rep AS replaced FROM est"""


@query("estimate_accuracy", estimate_twin())
def estimate_accuracy(spark, sf):
    return estimate_table(spark, sf)


@query("estimate_accuracy_strict", estimate_twin(0.03, 0.9))
def estimate_accuracy_strict(spark, sf):
    """A trained profile must beat the old one by a margin, and accuracies stay under a ceiling."""
    return estimate_table(spark, sf, 0.03, 0.9)


@query("discounted_avg", "SELECT l_orderkey, l_linenumber, round((l_extendedprice / 105001.0 + 2.439 * l_quantity / 53.0) / 3.439, 6) AS long_avg FROM lineitem")
def discounted_avg(spark, sf):
    li = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    v = bud.discounted(F.col("l_extendedprice") / 105001.0, F.col("l_quantity") / 53.0, 3, 0.9)
    return li.select("l_orderkey", "l_linenumber", F.round(v, 6).alias("long_avg"))


POLICY_SQL = f"""{PROFILE_SQL}, lc AS (SELECT *, 1.5 / thr AS cost FROM lam), l1 AS (SELECT grp, arg_max({{'lam': lam, 'acc': acc, 'cost': cost}}, {{'a': acc, 'b': -cost, 'c': -lam}}) AS l FROM lc WHERE cost <= 1 GROUP BY 1),
pols AS (SELECT 'no_retrain' AS method, grp, l.lam AS lam, NULL::BIGINT AS gam, l.acc AS acc, l.cost AS cost, NULL::DOUBLE AS gain, NULL::DOUBLE AS train, NULL::DOUBLE AS gcost, 1.0 AS I, 0.0 AS R FROM l1
UNION ALL SELECT 'fixed_half', grp, lam, NULL, acc, cost, NULL, NULL, NULL, 0.5, 0.5 FROM lc WHERE cost <= 0.5
UNION ALL SELECT 'fixed_half', grp, lam, gam, acc, cost, gain, train, gcost, 0.5, 0.5 FROM lc JOIN gam USING (grp) WHERE cost <= 0.5
UNION ALL SELECT 'inference_first', grp, l.lam, NULL, l.acc, l.cost, NULL, NULL, NULL, least(1.0, l.cost), 1 - least(1.0, l.cost) FROM l1
UNION ALL SELECT 'inference_first', grp, l.lam, gam, l.acc, l.cost, gain, train, gcost, least(1.0, l.cost), 1 - least(1.0, l.cost) FROM l1 JOIN gam USING (grp)
UNION ALL SELECT 'train_first', grp, lam, gam, acc, cost, gain, train, gcost, 1 - least(1.0, greatest(gcost, train / 60)), least(1.0, greatest(gcost, train / 60)) FROM lc JOIN gam USING (grp) WHERE cost <= 1 - least(1.0, greatest(gcost, train / 60))),
{estimate_sql('pols')},
sel AS (SELECT method, grp, arg_max({{'lam': lam, 'gam': gam, 'cur': cur, 'fut': fut, 'lng': lng}}, {{'z': CASE WHEN method = 'train_first' THEN fut ELSE lng END, 'a': CASE WHEN method = 'train_first' THEN lng ELSE fut END, 'b': cur, 'c': acc, 'd': -cost, 'e': -lam, 'f': -coalesce(gam, 0)}}) AS r FROM est GROUP BY 1, 2)"""


def policies(spark, sf):
    """No-retrain, fixed half, inference first and train first: each asks for the best affordable inference profile at its share."""
    lam, gam = profiles(spark, sf)
    lam = bud.with_cost(lam, F.lit(1.5))
    gam = bud.gamma_front(gam, ["grp"])
    groups = lam.select("grp").distinct()
    full = bud.best_affordable(groups.withColumn("share", F.lit(1.0)), "share", lam, ["grp"]).drop("share")
    half = bud.best_affordable(groups.withColumn("share", F.lit(0.5)), "share", lam, ["grp"]).drop("share")
    none = [F.lit(None).cast("bigint").alias("gam"), *[F.lit(None).cast("double").alias(c) for c in ("gain", "train", "gcost")]]
    g = [F.col("gam"), F.col("gain"), F.col("train"), F.col("gcost")]

    def rows(df, name, share, cols):
        return df.select(F.lit(name).alias("method"), "grp", "lam", "acc", "cost", *cols, share.alias("I"), (1 - share).alias("R"))

    need = F.least(F.lit(1.0), F.greatest(F.col("gcost"), F.col("train") / 60.0))
    train = bud.best_affordable(gam.withColumn("share", 1 - need), "share", lam, ["grp"])
    own = F.least(F.lit(1.0), F.col("cost"))
    every = rows(full, "no_retrain", F.lit(1.0), none)
    for part in (
        rows(half, "fixed_half", F.lit(0.5), none), rows(half.join(gam, "grp"), "fixed_half", F.lit(0.5), g), rows(full, "inference_first", own, none),
        rows(full.join(gam, "grp"), "inference_first", own, g),
        train.select(F.lit("train_first").alias("method"), "grp", "lam", "acc", "cost", *g, F.col("share").alias("I"), need.alias("R")),
    ):
        every = every.unionByName(part)
    e = estimated(every)
    first = F.col("method") == "train_first"
    rank = F.struct(
        F.when(first, F.col("e.future")).otherwise(F.col("e.long")).alias("z"), F.when(first, F.col("e.long")).otherwise(F.col("e.future")).alias("a"),
        F.col("e.current").alias("b"), "acc", (-F.col("cost")).alias("d"), (-F.col("lam")).alias("l"), (-F.coalesce("gam", F.lit(0))).alias("g"),
    )
    best = e.groupBy("method", "grp").agg(F.max_by(F.struct("lam", "gam", "e"), rank).alias("r"))
    return best.select("method", "grp", "r.lam", "r.gam", F.col("r.e.current").alias("current"), F.col("r.e.future").alias("future"), F.col("r.e.long").alias("long_avg"))


@query("baseline_policies", f"""WITH {POLICY_SQL} SELECT method, grp, r.lam AS lam, round(r.cur, 6) AS current, round(r.fut, 6) AS future, round(r.lng, 6) AS long_avg FROM sel""")
def baseline_policies(spark, sf):
    return policies(spark, sf).select("method", "grp", "lam", *r6("current", "future", "long_avg"))


@query("group_best_gap", f"""WITH {POLICY_SQL}, p AS (SELECT grp, max(r.lng) FILTER (method = 'inference_first') AS own, max(r.lng) FILTER (method <> 'inference_first') AS best FROM sel GROUP BY 1)
SELECT grp, round(best, 6) AS best_baseline, round(own, 6) AS own, round(own - best, 6) AS gap FROM p""")
def group_best_gap(spark, sf):
    m = ["no_retrain", "fixed_half", "train_first", "inference_first"]
    w = res.pivot_methods(policies(spark, sf), ["grp"], "method", "long_avg", m).withColumn("best", F.greatest(*m[:3]))
    return w.select("grp", F.round("best", 6).alias("best_baseline"), F.round(m[3], 6).alias("own"), F.round(F.col(m[3]) - F.col("best"), 6).alias("gap"))


# ------------------------------------------------------------------ replay over ordered test rows

ROWS_SQL = """rw AS (SELECT ['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'][o_custkey % 6 + 1] AS grp, o_orderkey AS uid, o_orderstatus AS task, (('0x' || substr(md5('pre:' || o_orderkey), 1, 8))::BIGINT % 100 < 45)::INT AS pre,
  (('0x' || substr(md5('base:' || o_orderkey), 1, 8))::BIGINT % 100 < 55)::INT AS base, (('0x' || substr(md5('post:' || o_orderkey), 1, 8))::BIGINT % 100 < 70)::INT AS post FROM orders),
rn AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY uid) AS rn, count(*) OVER (PARTITION BY grp) AS n FROM rw)"""


def test_rows(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    grp = F.get(F.array(*[F.lit(t) for t in TYPES]), (F.col("o_custkey") % 6).cast("int"))
    flags = [(hash100(f"{n}:", "o_orderkey") < cut).cast("int").alias(n) for n, cut in (("pre", 45), ("base", 55), ("post", 70))]
    return o.select(grp.alias("grp"), F.col("o_orderkey").alias("uid"), F.col("o_orderstatus").alias("task"), *flags)


PLAN_SQL = "pl AS (SELECT grp, c.lam AS plan, ceil(3.0 * n / 60.0) AS d, CASE WHEN c.lam % 8 = 0 THEN ceil((3.0 + c.thr * 9) * n / 60.0) END AS r, least(1.0, c.thr / 6.0) AS c0, least(1.0, c.thr / 4.0) AS c, c.acc AS estimate FROM lam c JOIN (SELECT DISTINCT grp, n FROM rn) USING (grp))"


def plans(spark, sf):
    """One plan per inference profile: 3 s upstream wait, 60 s horizon, every second one trains."""
    lam, _ = profiles(spark, sf)
    n = test_rows(spark, sf).groupBy("grp").agg(F.count(F.lit(1)).alias("_n"))
    p = lam.join(n, "grp")
    return p.select(
        "grp", F.col("lam").alias("plan"), F.ceil(3.0 * F.col("_n") / 60.0).alias("d"),
        F.when(F.col("lam") % 8 == 0, F.ceil((3.0 + F.col("thr") * 9) * F.col("_n") / 60.0)).alias("r"),
        F.least(F.lit(1.0), F.col("thr") / 6.0).alias("c0"), F.least(F.lit(1.0), F.col("thr") / 4.0).alias("c"), F.col("acc").alias("estimate"),
    )


SCORE_SQL = f"""{PROFILE_SQL}, {ROWS_SQL}, {PLAN_SQL},
q AS (SELECT pl.*, n, least(n, d)::BIGINT AS dd, greatest(least(n, d), least(n, coalesce(r, n)))::BIGINT AS rr FROM pl JOIN (SELECT DISTINCT grp, n FROM rn) USING (grp)),
s AS (SELECT q.grp, q.plan, any_value(q.n) AS n, any_value(dd) AS d, any_value(rr) AS r, any_value(c0) AS c0, any_value(c) AS c, any_value(estimate) AS estimate, sum(CASE WHEN rn <= dd THEN pre ELSE 0 END) AS a, sum(CASE WHEN rn > dd AND rn <= rr THEN base ELSE 0 END) AS b,
  sum(CASE WHEN rn > rr THEN post ELSE 0 END) AS p, sum(post) AS allp FROM q JOIN rn USING (grp) GROUP BY 1, 2),
sc AS (SELECT *, (c0 * a + c * (b + p)) / n AS score, c * allp / n AS final FROM s)"""


def scored_plans(spark, sf):
    pl = plans(spark, sf)
    out = bud.phased_accuracy(test_rows(spark, sf), ["grp"], "uid", pl)
    return out, pl


@query("phased_accuracy", f"""WITH {SCORE_SQL} SELECT grp, plan, n, d, r, a AS pre_correct, b AS base_correct, p AS post_correct, n - r AS adapted_n, round(score, 6) AS score, round(final, 6) AS final FROM sc""")
def phased_accuracy(spark, sf):
    out, _ = scored_plans(spark, sf)
    return out.withColumn("score", F.round("score", 6)).withColumn("final", F.round("final", 6))


@query("decision_table", f"""WITH {SCORE_SQL} SELECT grp, plan, r AS ready_index, round(estimate, 6) AS estimated, round(score, 6) AS actual_current, round(final, 6) AS actual_future, round((score + 2.439 * final) / 3.439, 6) AS actual_long, round(score - estimate, 6) AS error FROM sc""")
def decision_table(spark, sf):
    out, pl = scored_plans(spark, sf)
    j = out.join(pl.select("grp", "plan", "estimate"), ["grp", "plan"])
    long = bud.discounted(F.col("score"), F.col("final"), 3, 0.9)
    return j.select(
        "grp", "plan", F.col("r").alias("ready_index"), F.round("estimate", 6).alias("estimated"), F.round("score", 6).alias("actual_current"),
        F.round("final", 6).alias("actual_future"), F.round(long, 6).alias("actual_long"), F.round(F.col("score") - F.col("estimate"), 6).alias("error"),
    )


@query("oracle_best", f"""WITH {SCORE_SQL}, b AS (SELECT grp, arg_max({{'plan': plan, 'score': score, 'final': final}}, {{'a': score, 'b': final, 'c': estimate, 'd': -plan}}) AS r FROM sc GROUP BY 1)
SELECT grp, r.plan AS plan, round(r.score, 6) AS score, round(r.final, 6) AS final FROM b""")
def oracle_best(spark, sf):
    out, pl = scored_plans(spark, sf)
    j = out.join(pl.select("grp", "plan", "estimate"), ["grp", "plan"])
    best = j.groupBy("grp").agg(F.max_by(F.struct("plan", "score", "final"), F.struct("score", "final", "estimate", (-F.col("plan")).alias("p"))).alias("r"))
    return best.select("grp", "r.plan", F.round("r.score", 6).alias("score"), F.round("r.final", 6).alias("final"))


@query("estimated_vs_actual", f"""WITH {SCORE_SQL} SELECT CASE WHEN r < n THEN 'train' ELSE 'hold' END AS method, count(*) AS rows, round(avg(estimate), 6) AS mean_estimated, round(avg(score), 6) AS mean_actual, round(avg(score - estimate), 6) AS mean_error, round(avg(abs(score - estimate)), 6) AS mean_abs_error FROM sc GROUP BY 1""")
def estimated_vs_actual(spark, sf):
    out, pl = scored_plans(spark, sf)
    j = out.join(pl.select("grp", "plan", "estimate"), ["grp", "plan"]).withColumn("err", F.col("score") - F.col("estimate"))
    return j.groupBy(F.when(F.col("r") < F.col("n"), "train").otherwise("hold").alias("method")).agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.avg("estimate"), 6).alias("mean_estimated"), F.round(F.avg("score"), 6).alias("mean_actual"),
        F.round(F.avg("err"), 6).alias("mean_error"), F.round(F.avg(F.abs("err")), 6).alias("mean_abs_error"),
    )


@query("phased_accuracy_by_task", f"""WITH {ROWS_SQL}, t AS (SELECT *, rn > ceil(n * 0.4) AS late FROM rn)
SELECT grp, task, count(*) AS rows, sum((NOT late)::INT) AS before_n, round(coalesce(avg(base) FILTER (NOT late), 0), 6) AS before_acc, round(coalesce(avg(post) FILTER (late), 0), 6) AS after_acc,
  round(0.83 * avg(CASE WHEN late THEN post ELSE base END), 6) AS current_acc, round(0.83 * avg(post), 6) AS final_acc, round((1 - 0.83) * count(*), 6) AS timeouts FROM t GROUP BY 1, 2""")
def phased_accuracy_by_task(spark, sf):
    out = bud.phased_by_task(test_rows(spark, sf), ["grp"], "task", "uid", F.ceil(F.col("n") * 0.4), F.lit(0.83))
    return out.select("grp", "task", "rows", "before_n", *r6("before_acc", "after_acc", "current_acc", "final_acc", "timeouts"))


@query("group_total", "SELECT c_custkey, coalesce(nullif(count(*) FILTER (o_orderstatus = 'O'), 0), nullif(count(*) FILTER (o_orderstatus = 'F'), 0), count(o_orderkey)) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def group_total(spark, sf):
    """Window size from the first non-empty id list: open orders, then closed ones, then all (lists counted, not collected)."""
    c = table(spark, sf, "customer", "c_custkey")
    o = table(spark, sf, "orders", F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")

    def size(status):
        return F.nullif(F.sum((F.col("o_orderstatus") == status).cast("bigint")), F.lit(0))

    per = o.groupBy("c_custkey").agg(F.coalesce(size("O"), size("F"), F.count("o_orderkey")).alias("total"))
    return c.join(per, "c_custkey", "left").fillna({"total": 0})


@query("retrain_window", """WITH t AS (SELECT p_brand, p_size * 40.0 + p_retailprice / 7 AS t FROM part), s AS (SELECT p_brand, min(t) AS t_min, median(t) AS med, quantile_cont(t, 0.75) AS p75, max(t) AS top FROM t GROUP BY 1),
c AS (SELECT *, """ + ", ".join(
    f"CASE WHEN {p} * top >= 3600 THEN round_even({p} * top / 300, 0) * 300 WHEN {p} * top >= 600 THEN round_even({p} * top / 60, 0) * 60 WHEN {p} * top >= 60 THEN round_even({p} * top / 10, 0) * 10 ELSE round_even({p} * top, 0) END::DOUBLE AS c{int(p * 100)}" for p in (0.5, 0.65, 0.8)
) + """ FROM s),
a AS (SELECT *, CASE WHEN c65 > med AND c65 < top THEN c65 WHEN c50 > med AND c50 < top THEN c50 WHEN c80 > med AND c80 < top THEN c80 ELSE c65 END AS v FROM c)
SELECT p_brand, round(t_min, 4) AS t_min, round(med, 4) AS t_med, round(p75, 4) AS t_p75, round(top, 4) AS t_max, v AS selected FROM a""")
def retrain_window(spark, sf):
    t = table(spark, sf, "part", "p_brand", (F.col("p_size") * 40.0 + F.col("p_retailprice") / 7).alias("t"))
    s = exact_quantiles(t, ["p_brand"], "t", [0.0, 0.5, 0.75, 1.0], ["t_min", "t_med", "t_p75", "t_max"])
    return bud.retrain_window(s).select("p_brand", *[F.round(c, 4).alias(c) for c in ("t_min", "t_med", "t_p75", "t_max")], "selected")


# ------------------------------------------------------------------ scalar profile functions


@query("coverage_cost", """WITH c AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 2.0 / (p_retailprice / 500) WHEN p_partkey % 3 = 1 THEN 2.0 * p_size / 53.0 ELSE CASE WHEN p_partkey % 2 = 0 THEN p_size / 59.0 ELSE 1.0 END END AS cost FROM part)
SELECT p_partkey, round(cost, 6) AS cost, round(least(1.0, 0.6 / greatest(cost, 1e-9)), 6) AS coverage, round(cost / max(cost) OVER (), 6) AS relative FROM c""")
def coverage_cost(spark, sf):
    p = table(spark, sf, "part", "p_partkey", "p_size", "p_retailprice")
    k = F.col("p_partkey")
    cost = bud.coverage_cost(F.lit(2.0), F.when(k % 3 == 0, F.col("p_retailprice") / 500), F.when(k % 3 == 1, F.col("p_size") / 53.0), F.when(k % 2 == 0, F.col("p_size") / 59.0))
    c = p.select("p_partkey", cost.alias("cost"))
    top = c.agg(F.max("cost").alias("_m"))
    return c.join(F.broadcast(top)).select(  # one row
        "p_partkey", F.round("cost", 6).alias("cost"), F.round(bud.coverage(F.lit(0.6), F.col("cost")), 6).alias("coverage"), F.round(F.col("cost") / F.col("_m"), 6).alias("relative")
    )


@query("round_duration", "SELECT o_orderkey, (CASE WHEN s >= 3600 THEN round_even(s / 300, 0) * 300 WHEN s >= 600 THEN round_even(s / 60, 0) * 60 WHEN s >= 60 THEN round_even(s / 10, 0) * 10 ELSE round_even(s, 0) END)::DOUBLE AS rounded FROM (SELECT o_orderkey, (o_orderkey % 9000 + 0.5)::DOUBLE AS s FROM orders)")
def round_duration(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey")
    return o.select("o_orderkey", bud.round_duration((F.col("o_orderkey") % 9000 + 0.5).cast("double")).alias("rounded"))


@query("saturating_gain", """WITH g AS (SELECT p_partkey, p_retailprice / 1300 AS b, (p_partkey * 31 % 97) / 311.0 - 0.05 AS g, (p_size % 7) * 10 AS ps, 320 AS ts FROM part), h AS (SELECT *, greatest(0.0, least(1.0, b + g)) AS m FROM g)
SELECT p_partkey, round(CASE WHEN ps <= 0 THEN greatest(-b, least(1 - b, g)) WHEN m <= b THEN greatest(-b, least(0.0, m - b)) WHEN m >= 1 - 1e-12 THEN 1 - b ELSE greatest(-b, least(1 - b, (1 - b) * (ts / (ts + ps * (1 - m) / greatest(1e-12, m - b))))) END, 6) AS gain FROM h""")
def saturating_gain(spark, sf):
    p = table(spark, sf, "part", "p_partkey", "p_size", "p_retailprice")
    gain = bud.saturating_gain(F.col("p_retailprice") / 1300, (F.col("p_partkey") * 31 % 97) / 311.0 - 0.05, (F.col("p_size") % 7) * 10, F.lit(320))
    return p.select("p_partkey", F.round(gain, 6).alias("gain"))


CURVE_SQL = """cv AS (SELECT p_partkey, p_retailprice / 2000 AS a0, [0.0, 20.0, 40.0, 80.0] AS st, [p_retailprice / 2000, p_retailprice / 2000 + (p_partkey * 17 % 53) / 977.0, p_retailprice / 2000 + (p_partkey * 29 % 59) / 571.0, p_retailprice / 2000 + (p_partkey * 37 % 61) / 307.0 - 0.02] AS ac FROM part),
sl AS (SELECT unnest([0.625 * 16, 20.0, 40.0, 80.0, 160.0, 320.0, 640.0, 1.0, 2.0, 5.0, 50.0, 100.0]) AS s),
er AS (SELECT p_partkey, a0, ac, s, list_sum([((CASE WHEN st[i] > 0 THEN a0 + (1 - a0) * (st[i] / (st[i] + s)) ELSE a0 END) - ac[i]) ** 2 FOR i IN [1, 2, 3, 4]]) AS e FROM cv, sl),
bs AS (SELECT p_partkey, any_value(a0) AS a0, any_value(ac) AS ac, arg_min(s, {'e': e, 's': s}) AS s FROM er GROUP BY 1)"""


def curves(spark, sf):
    p = table(spark, sf, "part", "p_partkey", "p_brand", "p_size", "p_retailprice")
    a0, k = F.col("p_retailprice") / 2000, F.col("p_partkey")
    pts = [(0.0, a0), (20.0, a0 + (k * 17 % 53) / 977.0), (40.0, a0 + (k * 29 % 59) / 571.0), (80.0, a0 + (k * 37 % 61) / 307.0 - 0.02)]
    return p.withColumn("curve", F.array(*[F.struct(F.lit(s).alias("step"), a.alias("acc")) for s, a in pts]))


@query("curve_fit_gain", f"WITH {CURVE_SQL} SELECT p_partkey, s AS scale, round(greatest(0.0, ac[4] - a0), 6) AS profile_gain, round(CASE WHEN ac[4] > a0 THEN (1 - a0) * (320 / (320 + s)) ELSE 0 END, 6) AS predicted_gain FROM bs")
def curve_fit_gain(spark, sf):
    c = curves(spark, sf).select("p_partkey", bud.fit_curve_gain(F.col("curve"), F.lit(320.0)).alias("f"))
    return c.select("p_partkey", "f.scale", F.round("f.profile_gain", 6).alias("profile_gain"), F.round("f.predicted_gain", 6).alias("predicted_gain"))


@query("retarget_profile", f"""WITH {CURVE_SQL}, b AS (SELECT p_brand, p_size % 5 AS cfg, min(p_partkey) AS src FROM part GROUP BY 1, 2)
SELECT p.p_partkey, b.src AS source_id, p.p_partkey <> b.src AS reused, round((q.p_retailprice / 10) * (CASE WHEN p.p_size * 8 > 80 THEN p.p_size * 8 / 80.0 ELSE 1 END), 6) AS train_time,
  round(CASE WHEN ac[4] > a0 THEN (1 - a0) * (greatest(p.p_size * 8, 80) / (greatest(p.p_size * 8, 80) + s)) ELSE 0 END, 6) AS predicted_gain FROM part p JOIN b ON b.p_brand = p.p_brand AND b.cfg = p.p_size % 5 JOIN part q ON q.p_partkey = b.src JOIN bs ON bs.p_partkey = b.src""")
def retarget_profile(spark, sf):
    """Configurations sharing a normalised key reuse one measurement: time scaled by steps, gain read from its curve."""
    rows = curves(spark, sf).withColumn("cfg", F.col("p_size") % 5)
    first = rows.groupBy("p_brand", "cfg").agg(F.min_by(F.struct("p_partkey", "p_retailprice", "curve"), "p_partkey").alias("m"))
    j = rows.select("p_partkey", "p_brand", "cfg", (F.col("p_size") * 8).alias("steps")).join(first, ["p_brand", "cfg"])
    target = F.greatest(F.col("steps"), F.lit(80)).cast("double")
    fit = bud.fit_curve_gain(F.col("m.curve"), target)
    time = bud.extrapolate_time(F.col("m.p_retailprice") / 10, F.lit(80), F.col("steps"))
    return j.select(
        "p_partkey", F.col("m.p_partkey").alias("source_id"), (F.col("p_partkey") != F.col("m.p_partkey")).alias("reused"), F.round(time, 6).alias("train_time"),
        F.round(fit["predicted_gain"], 6).alias("predicted_gain"),
    )
