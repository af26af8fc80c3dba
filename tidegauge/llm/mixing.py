"""Mixing sources to target weights: hash-random keys, distributed prefix sums, exact cuts, repeated epochs.

Every document gets a key that is random but fixed (md5 of a seed and its id). Inside a source, documents stand in key order;
the key's leading digits cut that order into equal ranges, so a source with a third of all rows is spread over as many
ranges as any other frame. Running word counts are taken inside (source, range) and shifted by the totals of the ranges
before it. A source whose target is e times its size plus a rest gives every document e times, and once more the documents
whose running count is inside the rest; the document at the cut gives exactly the words that are missing.

Defined results: a null text has size 0 and takes nothing; a null source is a source of its own, the last one; rows with
equal ids or equal rows all count, each on its own; an empty table gives an empty result; columns of the input whose
names start with ``_`` or match an output name are not carried along unless asked for, and never clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 4096  # ranges of the key order inside a source: three hex digits
SEED = "mix"


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Targets per source from (source, source_size): shares by weight, none above ``most`` times its size.

    Sources in code point order (null last) weigh ``weights``, repeating, and share the total. With sources ordered by
    how soon they reach their cap, the first k are capped and the others share what they leave; the right k is the one with the
    highest level. The frame has one row per source: only that table passes through one task, never documents.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    nth = (F.row_number().over(order) - 1) % len(weights)
    ranked = sizes.select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), nth + 1).alias("_w"))
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    by_cap = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    levels = ranked.withColumn("_level", level)
    final = F.max("_level").over(Window.partitionBy())  # the level rises with k up to the right k and falls after it
    target = F.least(F.col("_cap"), F.col("_w") * final)
    return levels.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, seed: str = SEED, carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted) and the columns in ``carry``."""
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    kept = [F.col(c).alias(f"_carry_{i}") for i, c in enumerate(carry)]
    base = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("_key"), *kept)
    base = base.withColumn("_range", F.conv(F.substring("_key", 1, 3), 16, 10).cast("int"))
    ranges = base.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    sizes = ranges.groupBy("source").agg(F.sum("_sum").alias("source_size"))
    targets = source_targets(sizes, weights, most)
    earlier = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = ranges.select("source", "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_shift"))
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    plan = shifts.alias("s").join(targets.alias("t"), same("s", "t")).select("s.*", "t.source_size", "t.target")
    inside = Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ran = base.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    at = ran.alias("d").join(plan.alias("p"), same("d", "p") & (F.col("d._range") == F.col("p._range")))
    words = F.floor("p.target").cast("long")
    epochs = F.when(F.col("p.source_size") > 0, F.floor(words / F.col("p.source_size"))).otherwise(0).cast("long")
    rest = words - epochs * F.col("p.source_size")
    last = F.least(F.greatest(rest - F.col("p._shift") - F.col("d._before"), F.lit(0)), F.col("d.size"))
    taken = (epochs * F.col("d.size") + last).cast("long")
    out = [F.col("d.doc_id"), F.col("d.size"), F.col("p.source_size"), F.col("p.target"), taken.alias("taken")]
    return at.select(*out, *[F.col(f"d._carry_{i}").alias(c if c != "doc_id" else "_doc_id") for i, c in enumerate(carry) if c != "doc_id"])


MIX_SQL = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
                  md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3.0::DOUBLE * source_size AS cap,
             ((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::DOUBLE AS w FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY cap / w, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, w * max(level) OVER ()) AS target FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS words,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS epochs FROM r)
SELECT doc_id, size, source_size, target,
       (epochs * size + least(greatest(words - epochs * source_size - before, 0), size))::BIGINT AS taken FROM e
"""
