"""Answer parsing, option scores, prompts and caption scores over the text tables and rows derived from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.core.session import scratch_path, table
from tidegauge.functions import answers as fn
from tidegauge.operators import captions as cap
from tidegauge.operators import signals as sig
from tidegauge.plans.registry import query
from tidegauge.sources import readers

B0, B1 = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


@query("yes_no", f"""WITH s AS (SELECT doc_id, lower(trim(text)) AS s FROM documents), t AS (SELECT *, regexp_extract(s, '{B0}(yes|no|true|false|y|n){B1}', 1) AS t FROM s)
SELECT doc_id, CASE WHEN t IN ('yes', 'y', 'true') THEN 'Yes' WHEN t IN ('no', 'n', 'false') THEN 'No' WHEN starts_with(s, 'yes') THEN 'Yes' WHEN starts_with(s, 'no') THEN 'No' ELSE '' END AS answer FROM t""")
def yes_no(spark, sf):
    return table(spark, sf, "documents", "doc_id", "text").select("doc_id", fn.yes_no(F.col("text")).alias("answer"))


@query("option_letter", f"""WITH s AS (SELECT doc_id, upper(trim(text)) AS s FROM documents),
t AS (SELECT *, regexp_extract(s, '(ANSWER|FINAL|OPTION)\\s*[:\\-]?\\s*([A-E]){B1}', 2) AS a, regexp_extract(s, '{B0}([A-E]){B1}', 1) AS b, regexp_extract(s, '([A-E])', 1) AS c FROM s)
SELECT doc_id, CASE WHEN a <> '' THEN a WHEN b <> '' THEN b ELSE c END AS letter FROM t""")
def option_letter(spark, sf):
    return table(spark, sf, "documents", "doc_id", "text").select("doc_id", fn.option_letter(F.col("text"), "ABCDE").alias("letter"))


@query("option_letters", """SELECT page_id, (SELECT string_agg(c, ',' ORDER BY p) FROM (SELECT c, min(p) AS p FROM (SELECT unnest(string_split(s, '')) AS c, unnest(range(len(s))) AS p) GROUP BY c)) AS letters
FROM (SELECT page_id, regexp_replace(upper(html), '[^A-H]', '', 'g') AS s FROM pages)""")
def option_letters(spark, sf):
    return table(spark, sf, "pages", "page_id", "html").select("page_id", fn.option_letters(F.col("html"), "ABCDEFGH").alias("letters"))


@query("normalize_label", """SELECT p_partkey, lower(trim(' ' || p_type || ' ')) AS single, upper(trim(p_brand)) || ',' || upper(trim(p_name)) AS multi FROM part""")
def normalize_label(spark, sf):
    p = table(spark, sf, "part", "p_partkey", "p_type", "p_brand", "p_name")
    return p.select(
        "p_partkey", fn.normalize_label(F.concat(F.lit(" "), "p_type", F.lit(" "))).alias("single"),
        fn.normalize_label_list(F.array("p_brand", F.concat("p_name", F.lit(" ")))).alias("multi"),
    )


RAW_SQL = """ex AS (SELECT event_id, (props->>'k')::INT AS k FROM events),
raw AS (SELECT event_id, ['a', 'B ', ' c'][event_id % 3 + 1] AS target, '{"method":"' || CASE WHEN k % 10 = 0 THEN 'greedy' ELSE 'logprob' END || '","scores":{"A":-' || k % 7 || '.5,"B":-' || k % 5 || '.25,"C":-' || k % 3 || '.75}}' AS raw FROM ex),
sc AS (SELECT event_id, lower(trim(target)) AS t, (raw->'scores'->>'A')::DOUBLE AS a, (raw->'scores'->>'B')::DOUBLE AS b, (raw->'scores'->>'C')::DOUBLE AS c FROM raw WHERE raw->>'method' = 'logprob')"""


def raw_scores(spark, sf):
    """Stored option scores as JSON text, built from the events; a tenth has another decoding method."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf, "events", "event_id", "props").withColumn("k", k)
    target = F.get(F.array(F.lit("a"), F.lit("B "), F.lit(" c")), (F.col("event_id") % 3).cast("int"))
    method = F.when(F.col("k") % 10 == 0, "greedy").otherwise("logprob")
    raw = F.concat(
        F.lit('{"method":"'), method, F.lit('","scores":{"A":-'), (F.col("k") % 7).cast("string"), F.lit('.5,"B":-'),
        (F.col("k") % 5).cast("string"), F.lit('.25,"C":-'), (F.col("k") % 3).cast("string"), F.lit(".75}}"),
    )
    return e.select("event_id", target.alias("target"), fn.parse_scores(raw).alias("scores"))


@query("parse_scores", f"WITH {RAW_SQL} SELECT event_id, a, b, c FROM sc")
def parse_scores(spark, sf):
    s = F.col("scores")
    return raw_scores(spark, sf).where(s.isNotNull()).select("event_id", s["A"].alias("a"), s["B"].alias("b"), s["C"].alias("c"))


@query("option_nll", f"WITH {RAW_SQL} SELECT event_id, round(ln(exp(a) + exp(b) + exp(c)) - CASE t WHEN 'a' THEN a WHEN 'b' THEN b ELSE c END, 6) AS nll FROM sc")
def option_nll(spark, sf):
    rows = raw_scores(spark, sf).where(F.col("scores").isNotNull())
    return rows.select("event_id", F.round(fn.option_nll(F.col("scores"), F.col("target")), 6).alias("nll"))


@query("margin_loss", f"WITH {RAW_SQL} SELECT event_id, CASE t WHEN 'a' THEN greatest(b, c) - a WHEN 'b' THEN greatest(a, c) - b ELSE greatest(a, b) - c END AS margin FROM sc")
def margin_loss(spark, sf):
    rows = raw_scores(spark, sf).where(F.col("scores").isNotNull())
    return rows.select("event_id", fn.margin_loss(F.col("scores"), F.col("target")).alias("margin"))


KIND_SQL = """kd AS (SELECT p_partkey, p_size % 12 AS task, p_partkey % 5 AS type_id, CASE WHEN p_partkey % 7 = 0 THEN 'yesno' ELSE '' END AS kind FROM part)"""


def kinds(spark, sf):
    p = table(spark, sf, "part", "p_partkey", "p_size", "p_name", "p_type", "p_retailprice")
    return p.withColumn("task", F.col("p_size") % 12).withColumn("type_id", F.col("p_partkey") % 5).withColumn(
        "kind", F.when(F.col("p_partkey") % 7 == 0, "yesno").otherwise("")
    )


@query("answer_format", f"""WITH {KIND_SQL}, f AS (SELECT p_partkey, CASE WHEN task = 1 AND (type_id = 4 OR kind = 'yesno') THEN 'yes_no' WHEN task = 4 THEN 'yes_no' WHEN task IN (1, 3, 5, 6, 7, 8, 9) THEN 'mcq'
  WHEN task = 10 THEN 'caption' WHEN task = 11 THEN 'open_short' WHEN task = 2 THEN 'long_report' ELSE 'unknown' END AS format FROM kd)
SELECT p_partkey, format, CASE WHEN format IN ('mcq', 'yes_no') THEN 'closed_set' WHEN format IN ('caption', 'long_report') THEN 'long_generation' ELSE format END AS "group" FROM f""")
def answer_format(spark, sf):
    f = kinds(spark, sf).select("p_partkey", fn.answer_format(F.col("task"), F.col("type_id"), F.col("kind")).alias("format"))
    return f.withColumn("group", sig.format_group(F.col("format")))


@query("format_group", f"""WITH {KIND_SQL} SELECT CASE WHEN task IN (1, 3, 4, 5, 6, 7, 8, 9) THEN 'closed_set' WHEN task IN (2, 10) THEN 'long_generation' WHEN task = 11 THEN 'open_short' ELSE 'unknown' END AS "group", count(*) AS n FROM kd GROUP BY 1""")
def format_group(spark, sf):
    return answer_format(spark, sf).groupBy("group").agg(F.count(F.lit(1)).alias("n"))


PREDICTION_SQL = f"""{KIND_SQL}, pr AS (SELECT k.*, p_retailprice, CASE WHEN task = 1 AND type_id = 3 THEN 'multi_mcq' WHEN task = 1 AND (type_id = 4 OR kind = 'yesno') THEN 'yes_no' WHEN task = 4 THEN 'yes_no'
  WHEN task = 10 THEN 'caption' WHEN task IN (2, 11) THEN 'freeform' ELSE 'mcq' END AS tk, CASE WHEN p_partkey % 11 = 0 THEN '' WHEN task = 4 AND p_partkey % 3 = 0 THEN 'well, yes.' WHEN task = 4 AND p_partkey % 3 = 1 THEN 'never!' ELSE p_name || ' ' || p_type END AS answer FROM kd k JOIN part USING (p_partkey)),
np AS (SELECT *, upper(trim(answer)) AS up, CASE WHEN tk = 'yes_no' THEN ['Yes', 'No'] WHEN tk IN ('mcq', 'multi_mcq') THEN ['A', 'B', 'C', 'D'] ELSE [] END AS labels FROM pr),
nq AS (SELECT *, CASE tk WHEN 'multi_mcq' THEN coalesce((SELECT string_agg(c, ',' ORDER BY p) FROM (SELECT c, min(p) AS p FROM (SELECT unnest(string_split(up, '')) AS c, unnest(range(len(up))) AS p) WHERE c IN ('A', 'B', 'C', 'D') GROUP BY c)), '')
  WHEN 'mcq' THEN CASE WHEN regexp_extract(up, '([A-D])', 1) <> '' THEN regexp_extract(up, '([A-D])', 1) ELSE left(up, 1) END
  WHEN 'yes_no' THEN CASE WHEN regexp_matches(lower(answer), '{B0}yes{B1}') THEN 'Yes' WHEN regexp_matches(lower(answer), '{B0}no{B1}') THEN 'No' ELSE regexp_replace(trim(answer), '[.,!?;:]+$', '') END ELSE trim(answer) END AS prediction FROM np)"""


def predictions(spark, sf):
    k = kinds(spark, sf).withColumn("tk", fn.task_kind(F.col("task"), F.col("type_id"), F.col("kind")))
    key = F.col("p_partkey")
    answer = (
        F.when(key % 11 == 0, "").when((F.col("task") == 4) & (key % 3 == 0), "well, yes.").when((F.col("task") == 4) & (key % 3 == 1), "never!")
        .otherwise(F.concat_ws(" ", "p_name", "p_type"))
    )
    labels = (
        F.when(F.col("tk") == "yes_no", F.array(F.lit("Yes"), F.lit("No")))
        .when(F.col("tk").isin("mcq", "multi_mcq"), F.array(*[F.lit(c) for c in "ABCD"])).otherwise(F.array().cast("array<string>"))
    )
    k = k.withColumn("answer", answer).withColumn("labels", labels)
    return k.withColumn("prediction", fn.normalize_prediction(F.col("answer"), F.col("tk"), F.col("labels")))


@query("normalize_prediction", f"WITH {PREDICTION_SQL} SELECT p_partkey, tk AS kind, prediction FROM nq")
def normalize_prediction(spark, sf):
    return predictions(spark, sf).select("p_partkey", F.col("tk").alias("kind"), "prediction")


@query("accept_prediction", f"""WITH {PREDICTION_SQL} SELECT p_partkey, CASE WHEN prediction = '' THEN 'empty_prediction'
  WHEN tk = 'multi_mcq' AND len(list_filter(string_split(prediction, ','), lambda x: x NOT IN ('A', 'B', 'C', 'D'))) > 0 THEN 'invalid_label_not_in_A,B,C,D'
  WHEN tk IN ('mcq', 'yes_no') AND NOT list_contains(labels, prediction) THEN 'invalid_label_not_in_' || array_to_string(labels, ',')
  WHEN tk IN ('caption', 'freeform') AND length(trim(prediction)) < 3 THEN 'freeform_too_short' WHEN p_retailprice / 1000 < 0.95 THEN 'confidence_below_0.95' ELSE 'accepted' END AS reason FROM nq""")
def accept_prediction(spark, sf):
    reason = fn.acceptance(F.col("prediction"), F.col("tk"), F.col("labels"), F.col("p_retailprice") / 1000, 0.95)
    return predictions(spark, sf).select("p_partkey", reason.alias("reason"))


@query("answer_canonical", """SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(replace(p_type || '; ' || p_brand || ',,' || p_name, ';', ','), ','), lambda x: upper(trim(x))), lambda x: x <> ''), ',') AS answer FROM part""")
def answer_canonical(spark, sf):
    p = table(spark, sf, "part", "p_partkey", "p_type", "p_brand", "p_name")
    text = F.concat("p_type", F.lit("; "), "p_brand", F.lit(",,"), "p_name")
    return p.select("p_partkey", fn.answer_canonical(text).alias("answer"))


@query("clean_answer", """WITH w AS (SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN '<|im_start|>user' || chr(10) || text || '<|im_end|><|im_start|>assistant' || chr(10) || text || ' <|im_end|>'
  WHEN 1 THEN '<think>' || text || '</think> ' || role ELSE text || '</s>' || role END AS raw FROM conversations)
SELECT conv_id, turn, md5(CASE conv_id % 3 WHEN 0 THEN trim(regexp_extract(raw, '(?s)assistant\n(.*?)<\\|im_end\\|>', 1), chr(10) || ' ' || chr(9) || chr(13)) WHEN 1 THEN trim(raw, chr(10) || ' ' || chr(9) || chr(13)) ELSE trim(split_part(raw, '</s>', 1), chr(10) || ' ' || chr(9) || chr(13)) END) AS cleaned,
  CASE WHEN contains(raw, '</think>') THEN role ELSE '' END AS final FROM w JOIN conversations USING (conv_id, turn)""")
def clean_answer(spark, sf):
    c = table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    m = F.col("conv_id") % 3
    raw = (
        F.when(m == 0, F.concat(F.lit("<|im_start|>user\n"), "text", F.lit("<|im_end|><|im_start|>assistant\n"), "text", F.lit(" <|im_end|>")))
        .when(m == 1, F.concat(F.lit("<think>"), "text", F.lit("</think> "), "role")).otherwise(F.concat("text", F.lit("</s>"), "role"))
    )
    return c.withColumn("raw", raw).select("conv_id", "turn", F.md5(fn.clean_answer(F.col("raw"))).alias("cleaned"), fn.after_think(F.col("raw")).alias("final"))


@query("clean_label", r"""SELECT p_partkey, regexp_replace(translate(lower(trim(p_name || '_' || p_type || '-X')), '_-', '  '), '\s+', ' ', 'g') AS label FROM part""")
def clean_label(spark, sf):
    p = table(spark, sf, "part", "p_partkey", "p_name", "p_type")
    return p.select("p_partkey", fn.clean_label(F.concat("p_name", F.lit("_"), "p_type", F.lit("-X"))).alias("label"))


@query("slug", "SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM pages")
def slug(spark, sf):
    return table(spark, sf, "pages", "page_id", "url").select("page_id", fn.slug(F.col("url")).alias("slug"))


@query("parse_options", """SELECT p_partkey, p_name AS a, p_type AS b, p_brand AS c, CASE p_partkey % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'C' ELSE 'A' END AS answer FROM part""")
def parse_options(spark, sf):
    """Options text "A. .. B) .. C: .." and an answer given as a letter or as option text."""
    p = table(spark, sf, "part", "p_partkey", "p_name", "p_type", "p_brand")
    text = F.concat(F.lit("A. "), "p_name", F.lit(" B) "), "p_type", F.lit(" C: "), "p_brand")
    given = F.when(F.col("p_partkey") % 3 == 0, F.lower("p_type")).when(F.col("p_partkey") % 3 == 1, "c").otherwise(F.upper("p_name"))
    o = p.select("p_partkey", fn.parse_options(text).alias("o"), given.alias("given"))
    m = F.col("o")
    return o.select("p_partkey", m["A"].alias("a"), m["B"].alias("b"), m["C"].alias("c"), fn.answer_key(m, [F.col("given")]).alias("answer"))


TOK_SQL = "list_filter(string_split(regexp_replace(lower({t}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"


@query("tokenize", f"SELECT doc_id, len(tk) AS n_tokens, md5(array_to_string(tk, ' ')) AS digest FROM (SELECT doc_id, {TOK_SQL.format(t='text')} AS tk FROM documents)")
def tokenize(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text").withColumn("tk", fn.tokens(F.col("text")))
    return d.select("doc_id", F.size("tk").alias("n_tokens"), F.md5(F.array_join("tk", " ")).alias("digest"))


PAIR_SQL = f"""pr AS (SELECT a.conv_id || ':' || a.turn AS uid, {TOK_SQL.format(t='b.text')} AS h, {TOK_SQL.format(t='a.text')} AS r FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
  WHERE a.role = 'user' AND b.role = 'assistant'),
ks AS (SELECT unnest([1, 2, 3, 4]) AS k),
g AS (SELECT uid, k, side, unnest([array_to_string(w[i + 1:i + k], ' ') FOR i IN range(greatest(len(w) - k + 1, 0))]) AS g FROM (SELECT uid, 'h' AS side, h AS w FROM pr UNION ALL SELECT uid, 'r', r FROM pr), ks),
c AS (SELECT uid, k, g, count(*) FILTER (side = 'h')::DOUBLE AS h, count(*) FILTER (side = 'r')::DOUBLE AS r FROM g GROUP BY 1, 2, 3),
s AS (SELECT uid, k, sum(h * r) AS dot, sqrt(sum(h * h)) AS nh, sqrt(sum(r * r)) AS nr, sum(h) AS len, sum(r) AS rl, coalesce(sum(h) FILTER (r > 0), 0) AS hits FROM c GROUP BY 1, 2),
sc AS (SELECT pr.uid, coalesce(sum(CASE WHEN nh * nr > 0 THEN dot / (nh * nr) ELSE 0 END), 0) * 2.5 AS cider, coalesce(max(len) FILTER (k = 1), 0)::BIGINT AS pred_len, coalesce(max(rl) FILTER (k = 1), 0)::BIGINT AS ref_len,
  coalesce(max(hits) FILTER (k = 1 AND len > 0) / max(len) FILTER (k = 1 AND len > 0), 0) AS bleu1 FROM pr LEFT JOIN s ON s.uid = pr.uid GROUP BY 1)"""


def pairs(spark, sf):
    """A user turn as reference, the next assistant turn as prediction."""
    c = table(spark, sf, "conversations")
    ref = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("ref"))
    hyp = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("pred"))
    return ref.join(hyp, ["conv_id", "turn"]).select(F.concat_ws(":", "conv_id", "turn").alias("uid"), "pred", "ref")


@query("bleu1_fallback", f"WITH {PAIR_SQL} SELECT uid, round(bleu1, 6) AS bleu1 FROM sc")
def bleu1_fallback(spark, sf):
    return cap.ngram_scores(pairs(spark, sf), "uid", "pred", "ref", 1).select("uid", F.round("bleu1", 6).alias("bleu1"))


@query("cider_tf", f"WITH {PAIR_SQL} SELECT uid, round(cider, 6) AS cider FROM sc")
def cider_tf(spark, sf):
    return cap.ngram_scores(pairs(spark, sf), "uid", "pred", "ref").select("uid", F.round("cider", 6).alias("cider"))


@query("rouge_l")
def rouge_l(spark, sf):
    return pairs(spark, sf).select("uid", F.round(cap.rouge_l(F.col("pred"), F.col("ref")), 6).alias("rouge_l"))


@query("caption_metrics", f"WITH {PAIR_SQL} SELECT count(*) AS n, round(avg(bleu1), 6) AS bleu1, round(avg(cider), 6) AS cider, round(avg(pred_len), 6) AS pred_len, round(avg(ref_len), 6) AS ref_len FROM sc")
def caption_metrics(spark, sf):
    s = cap.ngram_scores(pairs(spark, sf), "uid", "pred", "ref")
    return s.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("bleu1", "cider", "pred_len", "ref_len")])


@query("caption_rouge")
def caption_rouge(spark, sf):
    """Dataset mean of the subsequence score, the remaining caption metric."""
    return rouge_l(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("rouge_l"), 6).alias("rouge_l"))


def listed(spark, sf):
    """An assistant turn as prediction, the user turns on both sides of it as references."""
    c = table(spark, sf, "conversations")
    hyp = c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("pred"))
    user = c.where("role = 'user'")
    refs = user.select("conv_id", (F.col("turn") + 1).alias("turn"), "text").unionByName(user.select("conv_id", (F.col("turn") - 1).alias("turn"), "text"))
    refs = refs.groupBy("conv_id", "turn").agg(F.collect_list("text").alias("refs"))
    return hyp.join(refs, ["conv_id", "turn"], "left").select(F.concat_ws(":", "conv_id", "turn").alias("uid"), "pred", "refs")


BEST_SQL = f"""a AS (SELECT conv_id || ':' || turn AS uid, conv_id, turn, {TOK_SQL.format(t='text')} AS w FROM conversations WHERE role = 'assistant'),
b AS (SELECT a.uid, u.turn AS ref, {TOK_SQL.format(t='u.text')} AS w FROM a JOIN conversations u ON u.conv_id = a.conv_id AND u.role = 'user' AND abs(u.turn - a.turn) = 1),
ks AS (SELECT unnest([1, 2, 3, 4]) AS k),
g AS (SELECT uid, ref, k, unnest([array_to_string(w[i + 1:i + k], ' ') FOR i IN range(greatest(len(w) - k + 1, 0))]) AS g FROM (SELECT uid, -9 AS ref, w FROM a UNION ALL SELECT uid, ref, w FROM b), ks),
c AS (SELECT uid, ref, k, g, count(*)::DOUBLE AS n FROM g GROUP BY ALL), l AS (SELECT uid, ref, k, sqrt(sum(n * n)) AS l FROM c GROUP BY ALL),
d AS (SELECT h.uid, r.ref, h.k, sum(h.n * r.n) AS dot FROM c h JOIN c r ON h.uid = r.uid AND h.k = r.k AND h.g = r.g AND h.ref = -9 AND r.ref <> -9 GROUP BY ALL),
e AS (SELECT d.uid, d.k, max(dot / (lh.l * lr.l)) AS best FROM d JOIN l lh ON lh.uid = d.uid AND lh.k = d.k AND lh.ref = -9 JOIN l lr ON lr.uid = d.uid AND lr.k = d.k AND lr.ref = d.ref GROUP BY ALL)"""


@query("cider_best", f"WITH {BEST_SQL} SELECT a.uid, round(coalesce(sum(best), 0) * 2.5, 6) AS cider FROM a LEFT JOIN e ON e.uid = a.uid GROUP BY 1")
def cider_best(spark, sf):
    """The n-gram cosine against a list of references, the best for each length."""
    return cap.best_over_references(listed(spark, sf), "uid", "pred", "refs").select("uid", F.round("cider", 6).alias("cider"))


@query("rouge_best")
def rouge_best(spark, sf):
    """The subsequence score against a list of references, the best of them."""
    return cap.best_over_references(listed(spark, sf), "uid", "pred", "refs").select("uid", F.round("rouge_l", 6).alias("rouge_l"))


@query("render_prompt", """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'Which ' || p_name || '?' || chr(10) || chr(10) || 'Provide a concise answer based on the image.'
  ELSE 'Which ' || p_name || '?' || chr(10) || chr(10) || 'Options:' || chr(10) || 'A: ' || p_type || chr(10) || 'B: ' || p_brand || chr(10) || chr(10) || 'Answer with just the letter.' END AS prompt FROM part""")
def render_prompt(spark, sf):
    p = table(spark, sf, "part", "p_partkey", "p_name", "p_type", "p_brand")
    options = F.when(F.col("p_partkey") % 5 != 0, F.create_map(F.lit("B"), F.col("p_brand"), F.lit("A"), F.col("p_type")))
    return p.select("p_partkey", fn.render_prompt(F.concat(F.lit("Which "), "p_name", F.lit("?")), options).alias("prompt"))


@query("uncertainty_features", """WITH l AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT *, list_max(v) AS m, list_sum([exp(q - list_max(v)) FOR q IN v]) AS t FROM l)
SELECT vec_id, round(list_sum(list_reverse_sort(v)[1:50]), 6) AS top_sum, round(1 / t, 6) AS max_prob, round(m + ln(t), 6) AS energy FROM s""")
def uncertainty_features(spark, sf):
    e = table(spark, sf, "embeddings", "vec_id", "embedding")
    u = e.select("vec_id", fn.uncertainty(F.col("embedding").cast("array<double>")).alias("u"))
    top = F.aggregate("u.top", F.lit(0.0), lambda s, x: s + x)
    return u.select("vec_id", F.round(top, 6).alias("top_sum"), F.round("u.max_prob", 6).alias("max_prob"), F.round("u.energy", 6).alias("energy"))


@query("duration_seconds", "SELECT o_orderkey, (o_orderkey % 5) * 3600 + (o_custkey % 60) * 60 + (o_orderkey % 7) + 0.5 AS seconds FROM orders")
def duration_seconds(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey")
    k = F.col("o_orderkey")
    text = F.concat((k % 5).cast("string"), F.lit("h "), (F.col("o_custkey") % 60).cast("string"), F.lit(" m, "), (k % 7).cast("string"), F.lit(".5s"))
    return o.select("o_orderkey", fn.duration_seconds(text).alias("seconds"))


@query("metric_log_extract", """WITH l AS (SELECT user_id, event_id, ts, event_type, value, (props->>'k')::INT AS k FROM events)
SELECT user_id, max_by(value, (ts, event_id)) FILTER (event_type = 'purchase') AS train_runtime, max_by(k / 10.0, (ts, event_id)) FILTER (event_type = 'signup') AS train_speed,
  coalesce(max(k) FILTER (event_type IN ('purchase', 'signup')), 0) + 0.5 AS peak_memory FROM l GROUP BY 1""")
def metric_log_extract(spark, sf):
    """Log files, one folder per user, with metric dictionaries among other lines: last runtime and speed, largest memory per log."""
    e = table(spark, sf, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k")
    line = (
        F.when(F.col("event_type") == "purchase", F.concat(F.lit("{'train_runtime': "), F.col("value").cast("string"), F.lit(", 'memory(GiB)': "), k, F.lit(".5}")))
        .when(F.col("event_type") == "signup", F.concat(F.lit(" {'train_speed(s/it)': "), (k.cast("int") / 10.0).cast("string"), F.lit(", 'memory(GiB)': "), k, F.lit(".5} ")))
        .otherwise(F.concat(F.lit("step "), k))
    )
    out = scratch_path(spark, "logs")
    ordered = e.select("user_id", "ts", "event_id", line.alias("value")).repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id")
    # version 2: each task moves its own folders into place; version 1 leaves them all to the driver, one after the other
    ordered.select("user_id", "value").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("user_id").text(out)
    logs = readers.numbered_lines(spark, out).withColumn("user_id", F.regexp_extract("file", r"/user_id=(-?[0-9]+)/", 1).cast("long"))
    text = F.trim("value")
    kept = logs.withColumn("t", F.when(text.startswith("{") & text.endswith("}"), text))

    def metric(name):
        return F.regexp_extract("t", rf"'{name}': ([-0-9.eE]+)", 1).try_cast("double")

    m = kept.select("user_id", "line", metric("train_runtime").alias("run"), metric(r"train_speed\(s/it\)").alias("speed"), metric(r"memory\(GiB\)").alias("mem"))
    return m.groupBy("user_id").agg(
        F.max_by("run", F.when(F.col("run").isNotNull(), F.col("line"))).alias("train_runtime"),
        F.max_by("speed", F.when(F.col("speed").isNotNull(), F.col("line"))).alias("train_speed"),
        F.coalesce(F.max("mem"), F.lit(0.5)).alias("peak_memory"),
    )


@query("json_object_extract", """SELECT event_id, least(greatest((props->>'k')::INT * 2 - 30, 0), 100) AS score FROM events""")
def json_object_extract(spark, sf):
    """Judge reply with prose around a JSON object; the score is clamped to 0..100."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf, "events", "event_id", "props")
    reply = F.concat(F.lit("Sure, here it is:\n{\"score\": "), (k * 2 - 30).cast("string"), F.lit(", \"why\": \"ok\"}\nBye"))
    got = fn.json_object(reply, "score int, why string")
    return e.select("event_id", F.least(F.greatest(got["score"], F.lit(0)), F.lit(100)).alias("score"))
