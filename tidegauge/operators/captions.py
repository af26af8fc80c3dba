"""Caption scores of (prediction, reference) pairs: unigram precision, n-gram cosine, longest common subsequence."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.answers import tokens


def ngram_cosines(h: list[str], r: list[str], n: int) -> list[float]:
    """Cosines of the k-gram counts for k = 1..n; 0.0 where a side has none."""
    out = []
    for k in range(1, n + 1):
        a, b = (Counter(zip(*(t[i:] for i in range(k)))) for t in (h, r))
        dot = sum(c * b[g] for g, c in a.items() if g in b)
        out.append(dot / math.sqrt(sum(c * c for c in a.values()) * sum(c * c for c in b.values())) if dot else 0.0)
    return out


def _pair_scores(n: int):
    @F.pandas_udf("cosines array<double>, pred_len long, ref_len long, bleu1 double")
    def score(h: pd.Series, r: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(h, r):
            x, y = list(x), list(y)
            known = set(y)
            rows.append((ngram_cosines(x, y, n), len(x), len(y), sum(t in known for t in x) / len(x) if x else 0.0))
        return pd.DataFrame(rows, columns=["cosines", "pred_len", "ref_len", "bleu1"])

    return score


def ngram_scores(pairs: DataFrame, uid: str, pred: str, ref: str, n: int = 4) -> DataFrame:
    """Unigram precision, the TF n-gram cosine score (x 10, mean over 1..n) and both lengths, over whole texts.

    A pair is scored where it lies: hash counts are linear in the texts, and no n-gram is shuffled.
    """
    s = pairs.select(uid, _pair_scores(n)(tokens(F.col(pred)), tokens(F.col(ref))).alias("s"))
    cider = F.aggregate("s.cosines", F.lit(0.0), lambda a, x: a + x) * (10.0 / n)
    return s.select(uid, cider.alias("cider"), "s.pred_len", "s.ref_len", "s.bleu1")


def best_over_references(pairs: DataFrame, uid: str, pred: str, refs: str, n: int = 4) -> DataFrame:
    """(uid, cider, rouge_l) against a list of references: the best cosine for each k, the best subsequence score.

    References are scored as rows of their own and combined by maxima, so one prediction may have any number of them; without
    references both scores are 0.
    """
    each = pairs.select(uid, pred, F.explode_outer(refs).alias("_ref")).select(uid, pred, F.coalesce("_ref", F.lit("")).alias("_ref"))
    scored = each.select(uid, _pair_scores(n)(tokens(F.col(pred)), tokens(F.col("_ref"))).alias("s"), rouge_l(F.col(pred), F.col("_ref")).alias("_rouge"))
    tops = [F.max(F.get("s.cosines", F.lit(k))).alias(f"_c{k}") for k in range(n)]
    best = scored.groupBy(uid).agg(*tops, F.max("_rouge").alias("rouge_l"))
    return best.select(uid, (sum((F.col(f"_c{k}") for k in range(n)), F.lit(0.0)) * (10.0 / n)).alias("cider"), "rouge_l")


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence over whole token lists, one bit per token of ``b``."""
    where: dict[str, int] = {}
    for i, t in enumerate(b):
        where[t] = where.get(t, 0) | (1 << i)
    full = (1 << len(b)) - 1
    row = full
    for t in a:
        hit = row & where.get(t, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def rouge_l(pred: Column, ref: Column) -> Column:
    """LCS F1 x 100 of two texts."""

    @F.pandas_udf("double")
    def score(p: pd.Series, r: pd.Series) -> pd.Series:
        def one(x: list[str], y: list[str]) -> float:
            common = lcs_length(list(x), list(y)) if len(x) and len(y) else 0
            if not common:
                return 0.0
            precision, recall = common / len(x), common / len(y)
            return 100.0 * 2 * precision * recall / (precision + recall)

        return pd.Series([one(x, y) for x, y in zip(p, r)], dtype="float64")

    return score(tokens(pred), tokens(ref))
