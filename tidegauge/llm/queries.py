"""The registered queries of the operators and their SQL twins (DuckDB), where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import (
    backoff, chat_masks, collocation, html_layout, mixing, order_minhash, permutation_index, quality_ftrl, secret_ledger, tiling, toxicity, warc, whitening,
)
from tidegauge.llm.tables import bucket_of, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            TWINS[name] = sql
        return fn

    return add


@query("op1_permutation_index")
def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20."""
    return permutation_index.nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), every=20, k=20)


def _judged(scores: DataFrame, modulus: int, remainder: int, least: float) -> DataFrame:
    held = bucket_of("doc_id", modulus) == remainder
    return scores.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document by a lexicon learnt outside the held-out fold."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return _judged(toxicity.score(docs, model), 3, 1, 0.7)


@query("op3_html_layout")
def op3_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    return html_layout.visible_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))


@query("op4_string_tiling")
def op4_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item where tiles cover at least half of the item."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return tiling.contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


CHAT_SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT * FROM (VALUES (-7::BIGINT, 0::BIGINT, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
e AS (SELECT *, length(replace(replace(text, '<\\', '<\\\\'), '<|', '<\\|')) AS t_len,
             length(replace(replace(replace(replace(role, '<\\', '<\\\\'), '<|', '<\\|'), '%', '%25'), chr(10), '%0A')) AS r_len FROM c),
g AS (SELECT conv_id, count(*)::BIGINT AS n_turns,
             string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, encode(role), encode(text)) AS turns,
             coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, encode(role), encode(text)) FILTER (role = 'assistant'), '') AS loss,
             sum(12 + r_len + 1 + t_len + 11)::BIGINT AS formatted_chars
      FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""


@query("op5_chat_masks", CHAT_SQL)
def op5_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests read back from every formatted conversation and its loss mask."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat_masks.format_chats(rows.unionByName(probe)).mapInArrow(chat_masks.digest_rows, chat_masks.DIGEST)


@query("op6_stupid_backoff", backoff.BACKOFF_SQL)
def op6_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document against the counts of all the others."""
    return backoff.score(table(spark, sf_dir, "documents", "doc_id", "text"))


# Positions in SQL: the pieces between matches and the matches alternate, so running lengths give the spans.
_SPANS_SQL = """SELECT doc_id, {nth} AS nth, '{kind}' AS kind, unnest(generate_series(1, len(m))) AS i, m, p FROM
  (SELECT doc_id, regexp_extract_all(text, '{re}') AS m, regexp_split_to_array(text, '{re}') AS p FROM d) WHERE len(m) > 0"""


def _secrets_sql() -> str:
    parts = []
    for nth, rule in enumerate(secret_ledger.RULES):
        parts.append(_SPANS_SQL.format(nth=nth, kind=rule.kind, re=rule.pattern.replace("'", "''")))
    least = " ".join(f"WHEN '{r.kind}' THEN {r.least}" for r in secret_ledger.RULES)
    assign = secret_ledger.RULES[0].pattern.replace("'", "''")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
x AS ({' UNION ALL '.join(parts)}),
y AS (SELECT doc_id, nth, kind, m[i] AS hit,
             (list_sum(list_transform(p[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:i-1], lambda z: length(z))), 0))::BIGINT AS s FROM x),
z AS (SELECT doc_id, nth, kind, s, s + length(hit) AS e FROM y
      WHERE CASE WHEN kind = 'assign' THEN length(regexp_extract(hit, '{assign}', 2)) ELSE length(hit) END >= CASE kind {least} END),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, nth) FILTER (nth < 3), '') AS base,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, nth) AS spans FROM z GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""


@query("op7_secret_ledger", _secrets_sql())
def op7_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every document by way of an empty ledger, digested per document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found, _ = secret_ledger.scan(docs)
    base = ("assign", "access", "hex")
    told = "concat(x.kind, ':', x.start, ':', x.end)"
    counts = [F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in base]
    listed = F.expr(f"array_join(transform(filter(spans, x -> x.kind IN {base}), x -> {told}), ',')")
    return found.select(
        F.col("path").alias("doc_id"), *counts, F.sha2(listed.cast("binary"), 256).alias("base_sha256"),
        F.expr(f"array_join(transform(spans, x -> {told}), ',')").alias("spans"),
    )


@query("op8_order_minhash")
def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-copy class of every document."""
    return order_minhash.near_classes(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op9_mix_sources", mixing.MIX_SQL)
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's part in the mix."""
    return mixing.mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


@query("op10_quality_ftrl")
def op10_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document by a model learnt outside the held-out fold."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    weights = quality_ftrl.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return _judged(quality_ftrl.score(docs, weights), 5, 0, 0.3)


COLLOCATION_SQL = r"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
said AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
gram AS (SELECT lang, m, array_to_string(w[i:i+m-1], ' ') AS phrase, count(*) AS c
         FROM (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM said WHERE len(w) > 0), (VALUES (1), (2), (3)) s(m) WHERE i + m - 1 <= len(w) GROUP BY ALL),
total AS (SELECT lang, sum(c)::BIGINT AS n FROM gram WHERE m = 1 GROUP BY lang),
cand AS (SELECT lang, m, phrase, c AS a, string_split(phrase, ' ') AS w FROM gram WHERE m > 1 AND c >= 10),
inside AS (SELECT lang, phrase, max(a) AS held FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM cand WHERE m = 3) GROUP BY ALL),
kept AS (SELECT c.* FROM cand c LEFT JOIN inside i USING (lang, phrase) WHERE i.held IS NULL OR c.m = 3 OR 100 * i.held < 50 * c.a),
cut AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS h, array_to_string(w[k+1:m], ' ') AS t FROM kept, (VALUES (1), (2)) s(k) WHERE k < m),
scored AS (SELECT cut.*, x.c AS l, y.c AS r, ((1000000::HUGEINT * a * a) // (x.c::HUGEINT * y.c))::BIGINT AS score FROM cut
           JOIN gram x ON x.lang = cut.lang AND x.phrase = h JOIN gram y ON y.lang = cut.lang AND y.phrase = t),
least AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM least WHERE nth = 1)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


@query("op11_collocations", COLLOCATION_SQL)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of every language."""
    return collocation.collocations(table(spark, sf_dir, "documents", "lang", "text"))


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 32 whitened components of every vector."""
    return whitening.whiten(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
b AS (SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes, unhex(sha1(t))::BIT::VARCHAR AS bits, max(page_id) OVER (PARTITION BY t) AS kept FROM p)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT
             + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> kept THEN kept END AS refers_to
FROM b
"""


@query("op13_warc_members", WARC_SQL)
def op13_warc_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it is read back from its normalised archive."""
    return warc.archive_round_trip(table(spark, sf_dir, "pages", "page_id", "url", "html"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
