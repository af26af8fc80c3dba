"""Join, accuracy, filter and reader queries over samples and predictions derived from the tables."""

from __future__ import annotations


from pyspark.sql import functions as F

from tidegauge.core.session import scratch_path, table
from tidegauge.functions import answers as fn
from tidegauge.operators import predictions as pr
from tidegauge.operators import results as res
from tidegauge.operators import sampling as smp
from tidegauge.plans.registry import query
from tidegauge.sources import readers, sinks

SAMPLE_SQL = """smp AS (SELECT o_orderkey AS uid, o_orderpriority AS truth, o_orderstatus AS typ, ('0x' || substr(md5('pred:' || o_orderkey), 1, 8))::BIGINT % 100 AS h,
  ('0x' || substr(md5('pseudo:' || o_orderkey), 1, 8))::BIGINT % 100 AS h2, o_custkey FROM orders),
prd AS (SELECT uid, CASE WHEN h < 70 THEN truth ELSE '3-MEDIUM' END AS prediction, h2 < 85 AS accepted, CASE WHEN h2 < 60 THEN truth WHEN h2 < 80 THEN '1-URGENT' END AS pseudo FROM smp WHERE h < 95),
j AS (SELECT smp.*, prediction, accepted, pseudo FROM smp LEFT JOIN prd USING (uid))"""


def hash100(prefix, col):
    return smp.hex_int(F.substring(F.md5(F.concat(F.lit(prefix), F.col(col).cast("string"))), 1, 8)) % 100


def samples(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_custkey")
    return o.select(F.col("o_orderkey").alias("uid"), F.col("o_orderpriority").alias("truth"), F.col("o_orderstatus").alias("typ"), "o_custkey")


def stored_predictions(spark, sf):
    """Prediction rows for 95 % of the samples, with acceptance flags and pseudo labels."""
    s = samples(spark, sf).withColumn("h", hash100("pred:", "uid")).withColumn("h2", hash100("pseudo:", "uid")).where("h < 95")
    pseudo = F.when(F.col("h2") < 60, F.col("truth")).when(F.col("h2") < 80, "1-URGENT")
    return s.select("uid", F.when(F.col("h") < 70, F.col("truth")).otherwise("3-MEDIUM").alias("prediction"), (F.col("h2") < 85).alias("accepted"), pseudo.alias("pseudo"))


def joined(spark, sf):
    return samples(spark, sf).join(stored_predictions(spark, sf), "uid", "left")


def correct():
    return F.col("prediction") == F.col("truth")


def present():
    return F.col("prediction").isNotNull()



def rounded(df, name="accuracy"):
    return df.withColumn(name, F.round(name, 6))


# ------------------------------------------------------------------ joins


@query("join_aligned", "SELECT l.doc_id, d.lang, d.source, l.quality FROM labels l JOIN documents d USING (doc_id)")
def join_aligned(spark, sf):
    return pr.aligned(table(spark, sf, "documents", "doc_id", "lang", "source"), table(spark, sf, "labels", "doc_id", "quality"), "doc_id").select("doc_id", "lang", "source", "quality")


@query("join_missing_extra", """WITH m AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)), x AS (SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))
SELECT 'missing' AS side, (SELECT count(*) FROM m) AS keys, coalesce((SELECT string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FROM (SELECT * FROM m ORDER BY doc_id LIMIT 5)), '') AS first
UNION ALL SELECT 'extra', (SELECT count(*) FROM x), coalesce((SELECT string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FROM (SELECT * FROM x ORDER BY doc_id LIMIT 5)), '')""")
def join_missing_extra(spark, sf):
    return pr.missing_extra(table(spark, sf, "documents", "doc_id"), table(spark, sf, "labels", "doc_id"), "doc_id", 5)


@query("join_prediction_left", f"WITH {SAMPLE_SQL} SELECT typ, count(*) AS n, sum(coalesce(prediction = truth, false)::INT) AS correct, sum((prediction IS NULL)::INT) AS missing, round(sum(coalesce(prediction = truth, false)::INT) / count(*), 6) AS accuracy FROM j GROUP BY 1")
def join_prediction_left(spark, sf):
    return rounded(pr.accuracy_table(joined(spark, sf), ["typ"], correct(), present()))


@query("join_default_empty", f"WITH {SAMPLE_SQL} SELECT count(*) AS n, round(avg((coalesce(prediction, '') = truth)::INT), 6) AS accuracy FROM j")
def join_default_empty(spark, sf):
    hit = F.coalesce("prediction", F.lit("")) == F.col("truth")
    return joined(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(hit.cast("double")), 6).alias("accuracy"))


@query("join_nearest_rate", """WITH r AS (SELECT p_partkey, p_retailprice / 100 * (1 + (p_partkey % 4) * 4e-6) AS rate FROM part), k AS (SELECT DISTINCT round(p_retailprice) / 100 AS k FROM part WHERE p_size > 5),
m AS (SELECT p_partkey, rate, arg_min(k, (abs(k - rate), k)) AS k FROM r, k GROUP BY 1, 2)
SELECT p_partkey, CASE WHEN abs(rate - k) <= greatest(1e-5 * greatest(abs(rate), abs(k)), 1e-6) THEN k END AS matched FROM m""")
def join_nearest_rate(spark, sf):
    p = table(spark, sf, "part", "p_partkey", "p_size", "p_retailprice")
    rows = p.select("p_partkey", (F.col("p_retailprice") / 100 * (1 + (F.col("p_partkey") % 4) * 4e-6)).alias("rate"))
    keys = p.where("p_size > 5").select((F.round("p_retailprice") / 100).alias("k"))
    return pr.nearest_key(rows, "rate", keys, "k", 1e-5, 1e-6).select("p_partkey", "matched")


@query("annotate_load", """WITH ref AS (SELECT p_brand, min(p_retailprice) / 1000 AS r FROM part GROUP BY 1), f AS (SELECT unnest([0.1, 0.25, 0.5, 0.75, 1.0, 2.0, 4.0])::DOUBLE AS f)
SELECT p_partkey, arg_min(f, (abs(r * f - p_size / 16.0), f)) AS load_factor FROM part JOIN ref USING (p_brand), f GROUP BY 1""")
def annotate_load(spark, sf):
    p = table(spark, sf, "part", "p_partkey", "p_brand", "p_size", "p_retailprice")
    ref = p.groupBy("p_brand").agg((F.min("p_retailprice") / 1000).alias("r"))
    factor = pr.nearest_factor(F.col("p_size") / 16.0, F.col("r"), [0.1, 0.25, 0.5, 0.75, 1.0, 2.0, 4.0])
    return p.join(ref, "p_brand").select("p_partkey", factor.alias("load_factor"))


@query("prediction_coverage", f"WITH {SAMPLE_SQL} SELECT typ, count(*) AS required, sum((prediction IS NULL)::INT) AS missing, sum((prediction IS NULL)::INT) = 0 AS complete FROM j GROUP BY 1")
def prediction_coverage(spark, sf):
    need = samples(spark, sf).select("typ", "uid").distinct()
    gaps = need.join(stored_predictions(spark, sf).select("uid"), "uid", "left_anti").groupBy("typ").agg(F.count(F.lit(1)).alias("missing"))
    sizes = need.groupBy("typ").agg(F.count(F.lit(1)).alias("required"))
    out = sizes.join(gaps, "typ", "left").fillna({"missing": 0})
    return out.withColumn("complete", F.col("missing") == 0)


@query("missing_requests", f"WITH {SAMPLE_SQL} SELECT DISTINCT uid FROM j WHERE prediction IS NULL")
def missing_requests(spark, sf):
    return samples(spark, sf).select("uid").distinct().join(stored_predictions(spark, sf).select("uid"), "uid", "left_anti")


@query("join_loss_formats", """SELECT CASE event_type WHEN 'click' THEN 'mcq' WHEN 'view' THEN 'yes_no' WHEN 'signup' THEN 'open_short' WHEN 'purchase' THEN 'caption' END AS format,
  count(*) AS n, round(sum(value), 4) AS total, sum((event_type = 'error')::INT) AS unmatched FROM events GROUP BY 1""")
def join_loss_formats(spark, sf):
    """Losses joined to a five-row format dimension; losses without a format are counted, not dropped."""
    dim = spark.createDataFrame([("click", "mcq"), ("view", "yes_no"), ("signup", "open_short"), ("purchase", "caption")], "event_type string, format string")
    e = table(spark, sf, "events", "event_type", "value").join(F.broadcast(dim), "event_type", "left")  # fixed four rows
    return e.groupBy("format").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.sum(F.col("format").isNull().cast("int")).alias("unmatched")
    )


@query("join_profiles_cross", """WITH g AS (SELECT unnest(range(1, 11)) / 10.0 AS share)
SELECT p_brand, share::DOUBLE AS share, count(*) AS feasible, round(max(p_retailprice), 2) AS best_accuracy, arg_min(p_partkey, (-p_retailprice, p_size, p_partkey)) AS best_id FROM part JOIN g ON p_size / 50.0 <= share GROUP BY 1, 2""")
def join_profiles_cross(spark, sf):
    """Configurations against the resource grid: only grid points at or above a configuration's cost are produced."""
    p = table(spark, sf, "part", "p_partkey", "p_brand", "p_size", "p_retailprice")
    grid = F.filter(F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: i / F.lit(10.0)), lambda s: F.col("p_size") / 50.0 <= s)
    rank = F.struct((-F.col("p_retailprice")).alias("a"), "p_size", "p_partkey")
    return p.withColumn("share", F.explode(grid)).groupBy("p_brand", "share").agg(
        F.count(F.lit(1)).alias("feasible"), F.round(F.max("p_retailprice"), 2).alias("best_accuracy"), F.min_by("p_partkey", rank).alias("best_id")
    )


@query("join_source_priority", """WITH u AS (SELECT o_custkey AS uid, 0 AS p, -o_orderkey AS q, o_totalprice AS v FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_custkey, 1, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT c_custkey, 2, c_custkey, c_acctbal FROM customer)
SELECT uid, arg_min(v, (p, q)) AS value FROM u GROUP BY 1""")
def join_source_priority(spark, sf):
    """An overriding source (last row wins), then base rows (first wins), then a fallback table fill missing keys."""
    o = table(spark, sf, "orders", F.col("o_custkey").alias("uid"), "o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("value"))
    over = o.where("o_orderstatus = 'O'").select("uid", (-F.col("o_orderkey")).alias("ord"), "value")
    base = o.where("o_orderstatus = 'F'").select("uid", F.col("o_orderkey").alias("ord"), "value")
    rest = table(spark, sf, "customer", F.col("c_custkey").alias("uid"), F.col("c_custkey").alias("ord"), F.col("c_acctbal").alias("value"))
    return res.keep_first([over, base, rest], "uid", "ord").select("uid", "value")


@query("overlap_audit", """WITH s AS (SELECT doc_id, ('0x' || substr(md5('ov:' || doc_id), 1, 8))::BIGINT % 100 AS h FROM documents)
SELECT 'train' AS "left", 'val' AS "right", sum((h < 60 AND h >= 50)::INT) AS shared FROM s UNION ALL SELECT 'train', 'test', sum((h < 60 AND h >= 70)::INT) FROM s UNION ALL SELECT 'val', 'test', sum((h BETWEEN 70 AND 74)::INT) FROM s""")
def overlap_audit(spark, sf):
    d = table(spark, sf, "documents", "doc_id").withColumn("h", hash100("ov:", "doc_id"))
    h = F.col("h")
    return pr.overlap_counts(d, "doc_id", {"train": h < 60, "val": (h >= 50) & (h < 75), "test": h >= 70})


# ------------------------------------------------------------------ accuracy


@query("accuracy", f"WITH {SAMPLE_SQL} SELECT count(*) AS n, sum(coalesce(prediction = truth, false)::INT) AS correct, sum((prediction IS NULL)::INT) AS missing, round(avg(coalesce(prediction = truth, false)::INT), 6) AS accuracy FROM j")
def accuracy(spark, sf):
    return rounded(pr.accuracy_table(joined(spark, sf), [], correct(), present()))


@query("accuracy_by_type", f"WITH {SAMPLE_SQL} SELECT typ, count(*) AS n, sum(coalesce(prediction = truth, false)::INT) AS correct, sum((prediction IS NULL)::INT) AS missing, round(avg(coalesce(prediction = truth, false)::INT), 6) AS accuracy FROM j GROUP BY GROUPING SETS ((typ), ())")
def accuracy_by_type(spark, sf):
    return rounded(pr.accuracy_table(joined(spark, sf), ["typ"], correct(), present(), with_total=True)).select("typ", "n", "correct", "missing", "accuracy")


@query("accuracy_pseudo", f"WITH {SAMPLE_SQL} SELECT typ, count(*) AS n, round(avg((prediction = pseudo)::INT), 6) AS prediction_vs_pseudo, round(avg((pseudo = truth)::INT), 6) AS pseudo_vs_truth FROM j WHERE pseudo IS NOT NULL GROUP BY 1")
def accuracy_pseudo(spark, sf):
    p = stored_predictions(spark, sf).where(F.col("pseudo").isNotNull())
    return samples(spark, sf).join(p, "uid").groupBy("typ").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("prediction") == F.col("pseudo")).cast("double")), 6).alias("prediction_vs_pseudo"),
        F.round(F.avg((F.col("pseudo") == F.col("truth")).cast("double")), 6).alias("pseudo_vs_truth"),
    )


@query("accepted_accuracy", f"WITH {SAMPLE_SQL} SELECT typ, sum(coalesce(accepted, false)::INT) AS accepted, sum((coalesce(accepted, false) AND prediction = truth)::INT) AS correct, sum((prediction IS NULL)::INT) AS missing, round(sum((coalesce(accepted, false) AND prediction = truth)::INT) / sum(coalesce(accepted, false)::INT), 6) AS accuracy FROM j GROUP BY 1".replace("sum((coalesce(accepted, false) AND prediction = truth)::INT)", "sum(coalesce(accepted AND prediction = truth, false)::INT)"))
def accepted_accuracy(spark, sf):
    ok = F.coalesce("accepted", F.lit(False))
    out = joined(spark, sf).groupBy("typ").agg(
        F.sum(ok.cast("int")).alias("accepted"), F.sum((ok & F.coalesce(correct(), F.lit(False))).cast("int")).alias("correct"),
        F.sum((~present()).cast("int")).alias("missing"),
    )
    return out.withColumn("accuracy", F.round(pr.ratio(F.col("correct"), F.col("accepted"), 0.0), 6))


@query("report_accuracy", """WITH r AS (SELECT l_suppkey, sum(l_linenumber) AS correct, sum(l_quantity::INT) + 7 * count(*) AS total, CASE WHEN l_suppkey % 4 = 0 THEN max(l_discount) END AS strict FROM lineitem GROUP BY 1)
SELECT l_suppkey, round(coalesce(strict, correct / total), 6) AS accuracy FROM r""")
def report_accuracy(spark, sf):
    """A report's strict value where stored, else sum(correct)/sum(total) over its rows."""
    li = table(spark, sf, "lineitem", "l_suppkey", "l_linenumber", "l_quantity", "l_discount")
    r = li.groupBy("l_suppkey").agg(
        F.sum("l_linenumber").alias("correct"), (F.sum(F.col("l_quantity").cast("int")) + 7 * F.count(F.lit(1))).alias("total"), F.max("l_discount").alias("d")
    )
    strict = F.when(F.col("l_suppkey") % 4 == 0, F.col("d"))
    return r.select("l_suppkey", F.round(F.coalesce(strict, pr.ratio(F.col("correct"), F.col("total"))), 6).alias("accuracy"))


@query("error_summary", "SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice / 105001.0 - l_quantity / 53.0), 6) AS mean_error, round(avg(abs(l_extendedprice / 105001.0 - l_quantity / 53.0)), 6) AS mae, round(sqrt(avg((l_extendedprice / 105001.0 - l_quantity / 53.0) ** 2)), 6) AS rmse FROM lineitem GROUP BY 1")
def error_summary(spark, sf):
    e = table(spark, sf, "lineitem", "l_returnflag", (F.col("l_extendedprice") / 105001.0 - F.col("l_quantity") / 53.0).alias("e"))
    return e.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("e"), 6).alias("mean_error"), F.round(F.avg(F.abs("e")), 6).alias("mae"), F.round(F.sqrt(F.avg(F.col("e") * F.col("e"))), 6).alias("rmse")
    )


@query("dataset_audit", """WITH i AS (SELECT lang, doc_id, unnest(list_distinct(list_filter(['img_' || doc_id % 97, CASE WHEN doc_id % 3 = 0 THEN 'img_' || doc_id % 89 END], lambda x: x IS NOT NULL))) AS img FROM documents),
f AS (SELECT DISTINCT 'img_' || page_id AS img FROM pages WHERE page_id % 7 <> 0), m AS (SELECT lang, doc_id, count(*) AS refs FROM i GROUP BY 1, 2)
SELECT i.lang, count(DISTINCT i.doc_id) AS samples, count(*) AS refs, sum((f.img IS NULL)::INT) AS missing, round((SELECT avg((refs > 1)::INT) FROM m WHERE m.lang = i.lang), 6) AS multi_ratio FROM i LEFT JOIN f ON f.img = i.img GROUP BY 1""")
def dataset_audit(spark, sf):
    """Samples, image references, references missing from the file listing and share of multi-image samples per task."""
    d = table(spark, sf, "documents", "doc_id", "lang")

    def name(n):
        return F.concat(F.lit("img_"), (F.col("doc_id") % n).cast("string"))

    d = d.withColumn("refs", fn.image_refs(name(97), F.when(F.col("doc_id") % 3 == 0, name(89))))
    files = table(spark, sf, "pages", "page_id").where("page_id % 7 <> 0").select(F.concat(F.lit("img_"), F.col("page_id").cast("string")).alias("img")).distinct()
    per = d.groupBy("lang").agg(F.count(F.lit(1)).alias("samples"), F.sum(F.size("refs")).alias("refs"), F.round(F.avg((F.size("refs") > 1).cast("double")), 6).alias("multi_ratio"))
    lost = d.select("lang", F.explode("refs").alias("img")).join(files, "img", "left_anti").groupBy("lang").agg(F.count(F.lit(1)).alias("missing"))
    return per.join(lost, "lang", "left").fillna({"missing": 0}).select("lang", "samples", "refs", "missing", "multi_ratio")


@query("image_refs", """WITH i AS (SELECT doc_id, list_distinct(list_filter([CASE WHEN doc_id % 4 = 0 THEN '/data/pre_' || doc_id % 7 END, 'img_' || doc_id % 97, 'img_' || doc_id % 89], lambda x: x IS NOT NULL)) AS r FROM documents)
SELECT doc_id, len(r) AS images FROM i""")
def image_refs(spark, sf):
    key = F.col("doc_id")
    pre = F.when(key % 4 == 0, F.concat(F.lit("/data/pre_"), (key % 7).cast("string")))
    refs = fn.image_refs(pre, F.concat(F.lit("img_"), (key % 97).cast("string")), F.concat(F.lit("img_"), (key % 89).cast("string")))
    return table(spark, sf, "documents", "doc_id").select("doc_id", F.size(refs).alias("images"))


@query("eval_report", "SELECT d.source AS task, count(*) AS samples, count(l.doc_id) AS scored, count(l.doc_id) = count(*) AS complete FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def eval_report(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "source").join(table(spark, sf, "labels", "doc_id", "quality"), "doc_id", "left")
    out = d.groupBy(F.col("source").alias("task")).agg(F.count(F.lit(1)).alias("samples"), F.count("quality").alias("scored"))
    return out.withColumn("complete", F.col("samples") == F.col("scored"))


@query("judge_mean", """WITH k AS (SELECT event_type, (props->>'k')::INT AS k FROM events) SELECT event_type, round(avg(k), 6) AS dap, round(avg(k * 7 % 101), 6) AS ddr, round(avg(k * 13 % 101), 6) AS fc,
  round(avg((k + k * 7 % 101 + k * 13 % 101) / 3.0), 6) AS mean_score FROM k GROUP BY 1""")
def judge_mean(spark, sf):
    """Mean of stored judge dimensions held in a struct per row."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf, "events", "event_type", F.struct(k.alias("dap"), (k * 7 % 101).alias("ddr"), (k * 13 % 101).alias("fc")).alias("j"))
    total = (F.col("j.dap") + F.col("j.ddr") + F.col("j.fc")) / 3.0
    return e.groupBy("event_type").agg(*[F.round(F.avg(f"j.{c}"), 6).alias(c) for c in ("dap", "ddr", "fc")], F.round(F.avg(total), 6).alias("mean_score"))


# ------------------------------------------------------------------ projections and filters


@query("adapt_sample", "SELECT doc_id::VARCHAR AS uid, ('0x' || substr(md5(lang), 1, 4))::INT % 12 AS task_id, CASE WHEN doc_id % 5 = 0 THEN '/abs/' || doc_id ELSE '/data/' || source || '/' || doc_id END AS image_path, source AS gt, md5(text) AS question, CASE WHEN doc_id % 2 = 0 THEN lang END AS option_a FROM documents")
def adapt_sample(spark, sf):
    """Heterogeneous records to one schema: uid, task, absolute image path, answer and a meta struct."""
    d = table(spark, sf, "documents", "doc_id", "text", "lang", "source")
    key = F.col("doc_id").cast("string")
    raw = d.select(
        key.alias("uid"), (fn.F.conv(F.substring(F.md5("lang"), 1, 4), 16, 10).cast("int") % 12).alias("task_id"),
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("/abs/"), key)).otherwise(F.concat(F.lit("./"), "source", F.lit("/"), key)).alias("path"),
        F.col("source").alias("gt"),
        F.struct(F.col("text").alias("question"), F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("A"), F.col("lang"))).alias("options")).alias("meta"),
    )
    s = raw.withColumn("image_path", fn.norm_path(F.col("path"), "/data"))
    return s.select("uid", "task_id", "image_path", "gt", F.md5("meta.question").alias("question"), F.col("meta.options")["A"].alias("option_a"))


@query("norm_path", "SELECT page_id, '/data/' || page_id || '.png' AS a, '/abs/' || page_id AS b, NULL::VARCHAR AS c, '/data/images/' || page_id || '.JPG' AS option_image, 'text ' || page_id AS option_text FROM pages")
def norm_path(spark, sf):
    key = F.col("page_id").cast("string")
    opts = fn.absolutize_options(F.create_map(F.lit("A"), F.concat(F.lit("./images/"), key, F.lit(".JPG")), F.lit("B"), F.concat(F.lit("text "), key)), "/data")
    return table(spark, sf, "pages", "page_id").select(
        "page_id", fn.norm_path(F.concat(F.lit("./"), key, F.lit(".png")), "/data").alias("a"), fn.norm_path(F.concat(F.lit("/abs/"), key), "/data").alias("b"),
        fn.norm_path(F.lit(""), "/data").alias("c"), opts["A"].alias("option_image"), opts["B"].alias("option_text"),
    )


@query("filter_tasks", "SELECT vec_id, label FROM embeddings WHERE label IN (1, 3, 5)")
def filter_tasks(spark, sf):
    """Rows of a task variant, kept by a semi join with the variant's task list."""
    variant = spark.createDataFrame([(1,), (3,), (5,)], "label int")
    e = table(spark, sf, "embeddings", "vec_id", F.col("label").cast("int").alias("label"))
    return e.join(F.broadcast(variant), "label", "left_semi").select("vec_id", "label")  # fixed three rows


@query("id_ood_tag", "SELECT vec_id, label IN (0, 1, 2, 3) AS in_distribution, label >= 4 AS drifted FROM embeddings")
def id_ood_tag(spark, sf):
    lab = F.col("label")
    return table(spark, sf, "embeddings", "vec_id", "label").select("vec_id", lab.isin(0, 1, 2, 3).alias("in_distribution"), (~lab.isin(0, 1, 2, 3)).alias("drifted"))


@query("annotate_split", "SELECT doc_id AS uid, source AS task_key, CASE WHEN lang = 'en' THEN 'reference' ELSE 'stream' END AS split, lang AS group_id, CASE WHEN doc_id % 2 = 0 THEN 'val' ELSE 'train' END AS role FROM documents")
def annotate_split(spark, sf):
    """Split, group and role written into the nested meta, then listed per uid."""
    d = table(spark, sf, "documents", "doc_id", "lang", "source").withColumn("meta", F.struct(F.col("source").alias("task_key")))
    meta = F.col("meta").withField("split", F.when(F.col("lang") == "en", "reference").otherwise("stream")).withField("group_id", F.col("lang")).withField(
        "role", F.when(F.col("doc_id") % 2 == 0, "val").otherwise("train"))
    return d.withColumn("meta", meta).select(F.col("doc_id").alias("uid"), "meta.task_key", "meta.split", "meta.group_id", "meta.role")


@query("recommended_signal", "SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'N' THEN 'method_native' WHEN 'R' THEN 'binary_error' ELSE 'correct_option_nll' END AS signal FROM lineitem")
def recommended_signal(spark, sf):
    """Each result row's recommended signal, from a small method dimension."""
    dim = spark.createDataFrame([("N", "method_native"), ("R", "binary_error")], "l_returnflag string, signal string")
    li = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag").join(F.broadcast(dim), "l_returnflag", "left")  # fixed two rows
    return li.select("l_orderkey", "l_linenumber", F.coalesce("signal", F.lit("correct_option_nll")).alias("signal"))


@query("norm_profile", """SELECT p_partkey, p_retailprice / 10 AS throughput, CASE WHEN p_partkey % 3 = 0 THEN p_size::DOUBLE END AS peak_memory, CASE WHEN p_partkey % 2 = 0 THEN p_size * 2.0 ELSE p_size * 3.0 END AS avg_power, 1.0 AS token_retention, 'none' AS roi FROM part""")
def norm_profile(spark, sf):
    """Alias columns of two profile sources folded into one schema by first-present value, with defaults."""
    p = table(spark, sf, "part", "p_partkey", "p_size", "p_retailprice")
    even = F.col("p_partkey") % 2 == 0
    a = p.where(even).select("p_partkey", (F.col("p_retailprice") / 10).alias("throughput_samples_per_s"), (F.col("p_size") * 2.0).alias("avg_power_watts"),
                             F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("double")).alias("peak_vram_gb"))
    b = p.where(~even).select("p_partkey", (F.col("p_retailprice") / 10).alias("throughput_samples_per_sec"), (F.col("p_size") * 3.0).alias("power_watts"),
                              F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("double")).alias("peak_memory_gib"))
    u = readers.union_wide(a, b)
    return u.select(
        "p_partkey", F.coalesce("throughput_samples_per_s", "throughput_samples_per_sec").alias("throughput"), F.coalesce("peak_vram_gb", "peak_memory_gib").alias("peak_memory"),
        F.coalesce("avg_power_watts", "power_watts").alias("avg_power"), F.lit(1.0).alias("token_retention"), F.lit("none").alias("roi"),
    )


@query("limit_resource", """WITH c AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) SELECT l_partkey, l_suppkey FROM c JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
WHERE coalesce(CASE WHEN p_partkey % 7 <> 0 THEN p_size END + CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal / 200 END <= 50, true) AND coalesce(p_retailprice / 10 + s_acctbal / 100 <= 170, true)""")
def limit_resource(spark, sf):
    """Candidate profile pairs under memory and power caps; a missing value or cap passes."""
    pairs = table(spark, sf, "lineitem", "l_partkey", "l_suppkey").distinct()
    a = table(spark, sf, "part", F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")).alias("mem"), (F.col("p_retailprice") / 10).alias("pow"))
    b = table(spark, sf, "supplier", F.col("s_suppkey").alias("l_suppkey"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_acctbal") / 200).alias("mem2"), (F.col("s_acctbal") / 100).alias("pow2"))
    ok = pr.within_limits(None, {"memory": (F.col("mem"), F.col("mem2")), "power": (F.col("pow"), F.col("pow2")), "thermal": (F.col("pow"), F.col("mem"))}, {"memory": 50.0, "power": 170.0, "thermal": None})
    return pairs.join(a, "l_partkey").join(b, "l_suppkey").where(ok).select("l_partkey", "l_suppkey")


@query("image_pixel_filter", "SELECT doc_id, n_chars FROM documents WHERE (n_chars * (doc_id % 50 + 1))::BIGINT <= 40000")
def image_pixel_filter(spark, sf):
    """Rows whose width x height from the metadata columns stays within the cap."""
    d = table(spark, sf, "documents", "doc_id", "n_chars")
    return d.where(F.col("n_chars").cast("bigint") * (F.col("doc_id") % 50 + 1) <= 40000)


# ------------------------------------------------------------------ readers and sinks


def scratch(spark, name) -> str:
    return scratch_path(spark, name)


@query("scan_split_json", "SELECT doc_id::VARCHAR AS uid, (doc_id % 12)::INT AS task_id, CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 1 END AS images, lang AS ground_truth FROM documents WHERE doc_id % 6 <> 0")
def scan_split_json(spark, sf):
    """Sample JSON files (written from the documents) read with an explicit schema; rows without an image are dropped."""
    key, out = F.col("doc_id").cast("string"), scratch(spark, "samples")
    table(spark, sf, "documents", "doc_id", "lang").select(
        key.alias("uid"), (F.col("doc_id") % 12).cast("int").alias("task_id"), F.col("lang").alias("ground_truth"),
        F.when(F.col("doc_id") % 6 == 0, "").otherwise(F.concat(F.lit("a_"), key)).alias("image_path"),
        F.when((F.col("doc_id") % 4 == 0) & (F.col("doc_id") % 6 != 0), F.concat(F.lit("b_"), key)).alias("pre_image_path"),
    ).write.json(out)
    return readers.read_samples(spark, out, lines=True).select("uid", "task_id", F.size("image_paths").alias("images"), "ground_truth")


@query("scan_task_json", "SELECT CASE WHEN doc_id % 3 = 0 THEN 'cache' ELSE 'json' END AS source, lang AS task, count(*) AS n FROM documents GROUP BY 1, 2")
def scan_task_json(spark, sf):
    """Rows of several task files tagged with the kind of source and the task parsed from the file's path."""
    out = scratch(spark, "tasks")
    kind = F.when(F.col("doc_id") % 3 == 0, "cache").otherwise("json").alias("kind")
    table(spark, sf, "documents", "doc_id", "lang").select("doc_id", kind, F.col("lang").alias("task")).write.partitionBy("kind", "task").json(out)
    rows = readers.read_reports(spark, out, "doc_id bigint", r"/kind=([a-z]+)/task=([a-z]+)/", ["source", "task"], lines=True)
    return rows.groupBy("source", "task").agg(F.count("doc_id").alias("n"))


def json_lines(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "lang", "n_chars")
    key = F.col("doc_id")
    text = (
        F.when(key % 10 == 0, "").when(key % 10 == 1, F.concat(F.lit("# note "), key.cast("string"))).when(key % 10 == 2, F.concat(F.lit('{"uid": "'), key.cast("string")))
        .otherwise(F.to_json(F.struct(key.cast("string").alias("uid"), F.col("n_chars").cast("double").alias("loss"))))
    )
    return d.select(text.alias("value"))


@query("scan_jsonl_tolerant", """SELECT CASE WHEN doc_id % 10 <> 2 THEN doc_id::VARCHAR END AS uid, CASE WHEN doc_id % 10 <> 2 THEN n_chars::DOUBLE END AS loss,
  CASE WHEN doc_id % 10 = 2 THEN '{"uid": "' || doc_id END AS bad, true AS placed FROM documents WHERE doc_id % 10 >= 2""")
def scan_jsonl_tolerant(spark, sf):
    """Parsed rows and all bad lines of JSON-lines files, each with file and line number; blanks and comments are skipped."""
    out = scratch(spark, "lines")
    json_lines(spark, sf).write.text(out)
    good, bad = readers.read_jsonl(spark, out, "uid string, loss double")
    both = good.unionByName(bad.withColumnRenamed("text", "bad"), allowMissingColumns=True)
    return both.select("uid", "loss", "bad", (F.col("file").isNotNull() & (F.col("line") >= 1)).alias("placed"))


@query("scan_jsonl_last_wins", "SELECT o_custkey AS uid, arg_max(o_totalprice, (o_orderstatus <> 'P', o_orderkey)) AS loss, arg_max(o_orderstatus, (o_orderstatus <> 'P', o_orderkey)) = 'P' AS failed FROM orders GROUP BY 1")
def scan_jsonl_last_wins(spark, sf):
    """Loss rows appended to JSON-lines files, a uid always to the same one; of a uid's lines the last one that did not fail counts."""
    out = scratch(spark, "losses")
    o = table(spark, sf, "orders", F.col("o_custkey").alias("uid"), "o_orderkey", F.col("o_totalprice").alias("loss"), (F.col("o_orderstatus") == "P").alias("failed"))
    o.repartition("uid").sortWithinPartitions("o_orderkey").select(F.to_json(F.struct("uid", "loss", "failed")).alias("value")).write.text(out)
    rows, _ = readers.read_jsonl(spark, out, "uid bigint, loss double, failed boolean")
    return res.last_wins(rows, "uid", ~F.col("failed"), F.col("line")).select("uid", "loss", "failed")


@query("scan_csv_wide", "SELECT n_nationkey AS k, n_name AS name, NULL AS acct FROM nation UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier UNION ALL SELECT c_custkey, NULL, c_acctbal FROM customer")
def scan_csv_wide(spark, sf):
    """Headed CSV files of unlike columns read under the union of their columns."""
    parts = {
        "nation": (["n_nationkey AS k", "n_name AS name"], "k bigint, name string"),
        "supplier": (["s_suppkey AS k", "s_name AS name", "s_acctbal AS acct"], "k bigint, name string, acct double"),
        "customer": (["c_custkey AS k", "c_acctbal AS acct"], "k bigint, acct double"),
    }
    frames = []
    for name, (cols, schema) in parts.items():
        out = scratch(spark, name)
        table(spark, sf, name).selectExpr(*cols).write.option("header", True).csv(out)
        frames.append(readers.read_csv(spark, out, schema))
    return readers.union_wide(*frames)


@query("scan_feature_cache", "SELECT label, count(*) AS n, max(len(embedding)) AS dim, round(sum(list_sum(embedding::DOUBLE[])), 4) AS total FROM embeddings GROUP BY 1")
def scan_feature_cache(spark, sf):
    f = readers.read_features(spark, f"{sf}/embeddings.parquet")
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    return f.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max("dim").alias("dim"), F.round(F.sum(total), 4).alias("total"))


def host():
    return F.regexp_extract("url", "//([^/]+)/", 1)


@query("scan_discover", "SELECT trim(regexp_replace(lower(regexp_extract(url, '//([^/]+)/', 1)), '[^a-z0-9]+', '_', 'g'), '_') AS task_key, count(*) AS files FROM pages GROUP BY 1")
def scan_discover(spark, sf):
    """Task tables found by walking a folder; the key is the slug of the directory, the count its records."""
    out = scratch(spark, "found")
    table(spark, sf, "pages", "page_id", "url").select("page_id", host().alias("dir")).write.partitionBy("dir").json(out)
    found = readers.read_reports(spark, out, "page_id bigint", r"/dir=([^/]+)/", ["dir"], lines=True)
    return found.groupBy(fn.slug("dir").alias("task_key")).agg(F.count(F.lit(1)).alias("files"))


@query("scan_report_index", r"SELECT nullif(regexp_extract(url, '//([^/]+)/([a-z]+)/(\d+)', 1), '') AS grp, nullif(regexp_extract(url, '//([^/]+)/([a-z]+)/(\d+)', 2), '') AS config, nullif(regexp_extract(url, '//([^/]+)/([a-z]+)/(\d+)', 3), '') AS adapter, count(*) AS reports FROM pages GROUP BY 1, 2, 3")
def scan_report_index(spark, sf):
    """Report files indexed by the group and configuration in their path and the adapter in their record."""
    out = scratch(spark, "reports")
    parts = readers.path_parts(F.col("url"), r"//([^/]+)/([a-z]+)/(\d+)", ["grp", "config", "adapter"])
    table(spark, sf, "pages", "url").select(*parts).write.partitionBy("grp", "config").json(out)
    index = readers.read_reports(spark, out, "adapter string", r"/grp=([^/]+)/config=([^/]+)/", ["grp", "config"], lines=True)
    return index.groupBy("grp", "config", "adapter").agg(F.count(F.lit(1)).alias("reports"))


@query("scan_rate_index", r"WITH m AS (SELECT regexp_extract(url, '//([^/]+)/', 1) AS dir, min(page_id) / 10.0 AS rate FROM pages GROUP BY 1) SELECT page_id, rate FROM pages JOIN m ON m.dir = regexp_extract(url, '//([^/]+)/', 1)")
def scan_rate_index(spark, sf):
    """Result rows keyed by the rate in the manifest file of the same directory (joined on the parent path)."""
    results, manifests = scratch(spark, "rated"), scratch(spark, "manifests")
    p = table(spark, sf, "pages", "page_id", "url").select("page_id", host().alias("dir"))
    p.write.partitionBy("dir").json(results)
    p.groupBy("dir").agg((F.min("page_id") / 10.0).alias("rate")).write.partitionBy("dir").json(manifests)
    rows = readers.read_reports(spark, results, "page_id bigint", r"/(dir=[^/]+)/", ["parent"], lines=True)
    manifest = readers.read_reports(spark, manifests, "rate double", r"/(dir=[^/]+)/", ["parent"], lines=True)
    return rows.join(manifest.select("parent", "rate"), "parent").select("page_id", "rate")


@query("scan_category_records", "SELECT p_brand || '_' || p_partkey || '_' || p_partkey AS uid, 'B' AS answer, lower(p_type) AS label FROM part WHERE p_partkey % 4 NOT IN (0, 1)")
def scan_category_records(spark, sf):
    """Question records from JSON files with options text; rows without options or a readable answer are skipped."""
    p, out = table(spark, sf, "part", "p_partkey", "p_brand", "p_name", "p_type"), scratch(spark, "questions")
    p.select(
        "p_partkey", "p_brand", F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit("A) "), "p_name", F.lit(" B) "), "p_type")).alias("options"),
        F.when(F.col("p_partkey") % 4 == 1, "unknown answer").otherwise(F.col("p_type")).alias("answer_text"), F.col("p_partkey").alias("ord"),
    ).write.json(out)
    raw = spark.read.schema("p_partkey bigint, p_brand string, options string, answer_text string, ord bigint").json(out)
    return readers.category_rows(raw, "options", ["answer_text"], "p_brand", "p_partkey", "ord").select("uid", "answer", "label")


@query("sink_accept_reject", f"WITH {SAMPLE_SQL} SELECT CASE WHEN coalesce(accepted AND pseudo IS NOT NULL, false) THEN 'accepted' ELSE 'rejected' END AS route, CASE WHEN coalesce(accepted AND pseudo IS NOT NULL, false) THEN pseudo ELSE truth END AS answer, count(*) AS n FROM j GROUP BY 1, 2")
def sink_accept_reject(spark, sf):
    """Accepted and rejected rows written to their own folders and read back."""
    ok, no = sinks.route_accepted(joined(spark, sf), F.col("accepted") & F.col("pseudo").isNotNull(), "truth", "pseudo")
    out = scratch(spark, "routed")
    for route, rows in (("accepted", ok), ("rejected", no)):
        sinks.write_results(rows.select("truth"), f"{out}/route={route}", "json")
    both = readers.read_reports(spark, out, "truth string", r"/route=([a-z]+)/", ["route"], lines=True)
    return both.groupBy("route", F.col("truth").alias("answer")).agg(F.count(F.lit(1)).alias("n"))


@query("resume_antijoin", "SELECT event_id, user_id FROM events WHERE event_id NOT IN (SELECT doc_id FROM labels)")
def resume_antijoin(spark, sf):
    done = table(spark, sf, "labels", F.col("doc_id").alias("event_id"))
    return sinks.pending(table(spark, sf, "events", "event_id", "user_id"), done, "event_id")


@query("sink_results", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2")
def sink_results(spark, sf):
    """A result table written partitioned to the shared folder and read back."""
    out = scratch(spark, "results")
    li = table(spark, sf, "lineitem", "l_returnflag", "l_linestatus", "l_quantity")
    sinks.write_results(li.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")), out, by=["l_returnflag"])
    return spark.read.parquet(out).select("l_returnflag", "l_linestatus", "n", "quantity")
