"""Window scorers against direct numpy computations and invariants."""

import numpy as np
import pytest

from tidegauge.operators import vectors as vec
from tidegauge.operators.captions import best_over_references, lcs_length, ngram_cosines

RNG = np.random.default_rng(5)
REF, WIN = RNG.normal(size=(120, 6)), RNG.normal(0.4, 1.2, size=(40, 6))


def test_frechet_against_eigen_root():
    mean, cov = REF.mean(0), np.cov(REF, rowvar=False)
    got = vec.frechet_scorer(mean, cov, 1e-6)(WIN)
    a, b = cov + 1e-6 * np.eye(6), np.cov(WIN, rowvar=False) + 1e-6 * np.eye(6)
    cross = np.sqrt(np.maximum(np.linalg.eigvals(a @ b).real, 0)).sum()
    want = ((mean - WIN.mean(0)) ** 2).sum() + np.trace(a) + np.trace(b) - 2 * cross
    assert got == pytest.approx(want, rel=1e-9)
    assert vec.frechet_scorer(mean, cov, 1e-6)(REF) == pytest.approx(0.0, abs=1e-9)


def test_mmd_and_lsdd_direct():
    gamma = vec.rbf_gamma(REF)

    def k(x, y):
        return np.array([[np.exp(-gamma * ((a - b) ** 2).sum()) for b in y] for a in x])

    assert vec.mmd_scorer(REF)(WIN) == pytest.approx(k(REF, REF).mean() + k(WIN, WIN).mean() - 2 * k(REF, WIN).mean(), abs=1e-12)
    c = REF[:64]
    kr, kw = k(REF, c), k(WIN, c)
    h = kr.mean(0) - kw.mean(0)
    m = 0.5 * (kr.T @ kr / len(REF) + kw.T @ kw / len(WIN))
    alpha = np.linalg.solve(m + 1e-3 * np.eye(64), h)
    assert vec.lsdd_scorer(REF)(WIN) == pytest.approx(max(h @ alpha - 0.5 * alpha @ m @ alpha, 0), rel=1e-6)
    assert vec.lsdd_scorer(REF)(REF) == pytest.approx(0.0, abs=1e-9)


def coded(ref, w):
    """Rank codes of a window and the tie sums of the reference, from plain sorts."""
    out, ties = [], []
    for i in range(ref.shape[1]):
        a, both = np.sort(ref[:, i]), np.unique(np.r_[ref[:, i], w[:, i]])
        out.append((np.searchsorted(a, w[:, i], "right"), np.searchsorted(a, w[:, i], "left"), np.searchsorted(both, w[:, i])))
        sizes = np.unique(a, return_counts=True)[1].astype(float)
        ties.append((sizes * (sizes**2 - 1)).sum() / 12)
    return np.hstack([np.column_stack([c[j] for c in out]) for j in range(3)]).astype(float), np.array(ties)


def test_rank_codes_over_buckets(spark, tiny_buckets):
    ref, win = np.round(RNG.normal(size=(300, 4)), 1), np.round(RNG.normal(size=(50, 4)), 1)
    rows = [("fit", i, [float(x) for x in v[:3]], [float(v[3])]) for i, v in enumerate(ref)] + [("w", i, [float(x) for x in v[:3]], [float(v[3])]) for i, v in enumerate(win)]
    df = spark.createDataFrame(rows, "split string, idx int, A array<double>, B array<double>")
    got, ties = vec.rank_codes(df, df["split"] == "fit", {"A": 3, "B": 1}, ["split", "idx"])
    picked = sorted(got.collect(), key=lambda r: r["idx"])
    for stream, cols in (("A", slice(0, 3)), ("B", slice(3, 4))):
        codes, sums = coded(ref[:, cols], win[:, cols])
        d, mine = codes.shape[1] // 3, np.array([r[stream] for r in picked])
        assert np.array_equal(mine[:, : 2 * d], codes[:, : 2 * d]) and np.allclose(ties[stream], sums)
        assert all(np.array_equal(np.unique(mine[:, 2 * d + i], return_inverse=True)[1], np.unique(codes[:, 2 * d + i], return_inverse=True)[1]) for i in range(d))


def test_ks_and_cvm_with_ties():
    a, b = np.round(REF, 1), np.round(WIN, 1)
    ks = max(max(abs((a[:, i] <= t).mean() - (b[:, i] <= t).mean()) for t in np.r_[a[:, i], b[:, i]]) for i in range(6))
    codes, ties = coded(a, b)
    assert vec.ks_scorer(len(a))(codes) == pytest.approx(ks)
    best = -1.0
    for i in range(6):
        x, y = np.sort(a[:, i]), np.sort(b[:, i])
        z = np.r_[x, y]
        rank = np.array([(z < t).sum() + ((z == t).sum() + 1) / 2 for t in z])
        n, m = len(x), len(y)
        u = n * ((rank[:n] - np.arange(1, n + 1)) ** 2).sum() + m * ((rank[n:] - np.arange(1, m + 1)) ** 2).sum()
        best = max(best, u / (n * m * (n + m)) - (4 * n * m - 1) / (6 * (n + m)))
    assert vec.cvm_scorer(len(a), ties)(codes) == pytest.approx(best)


def test_row_order_does_not_matter():
    mixed = WIN[RNG.permutation(len(WIN))]
    for scorer in (vec.mmd_scorer(REF), vec.lsdd_scorer(REF)):
        assert scorer(mixed) == pytest.approx(scorer(WIN), abs=1e-9)
    codes, ties = coded(REF, WIN)
    for scorer in (vec.ks_scorer(len(REF)), vec.cvm_scorer(len(REF), ties)):
        assert scorer(codes[::-1]) == pytest.approx(scorer(codes), abs=1e-9)


def test_pca_and_moments(spark):
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(REF)], "id int, x array<double>").repartition(5)
    n, mean, cov = vec.fit_moments(df, "x", 6)
    assert n == 120 and np.allclose(mean, REF.mean(0)) and np.allclose(cov, np.cov(REF, rowvar=False))
    model = vec.fit_pca(df, "x", 6, 6)
    z = np.array([r["z"] for r in df.orderBy("id").select(vec.project(df["x"], model).alias("z")).collect()])
    assert np.allclose(np.cov(z, rowvar=False), np.diag(model.variances), atol=1e-9)
    full = np.sqrt((WIN.mean(0) - mean) @ np.linalg.inv(cov) @ (WIN.mean(0) - mean))
    p = (WIN.mean(0) - model.mean) @ model.components.T
    assert np.sqrt((p * p / model.variances).sum()) == pytest.approx(full)


def lcs_table(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
    return t[-1, -1]


def test_lcs_against_table():
    for n in (1, 3, 17, 90):
        for _ in range(20):
            a = [str(v) for v in RNG.integers(0, 6, n)]
            b = [str(v) for v in RNG.integers(0, 6, RNG.integers(1, 80))]
            assert lcs_length(a, b) == lcs_table(a, b)
    assert lcs_length(["a"] * 5000, ["a"] * 4000) == 4000


def test_same_text_has_full_cosine():
    words = "a b c d e f".split()
    assert ngram_cosines(words, words, 4) == pytest.approx([1.0] * 4)
    assert ngram_cosines(words, ["x"], 4) == [0.0] * 4


def test_window_distance_wide_vectors_and_windows_over_batches(spark):
    rng = np.random.default_rng(8)
    d = 2048
    rows = [(float(w % 2), w, rng.normal(size=d)) for w in range(40) for _ in range(7)]
    models = {"A": vec.Pca(np.zeros(d), np.eye(d), rng.uniform(0.5, 2.0, d), 10)}
    df = spark.createDataFrame([(r, w, x.tolist()) for r, w, x in rows], "ratio double, window_id int, A array<double>").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = {(r["ratio"], r["window_id"]): r["score"] for r in vec.window_distance(df, ["ratio", "window_id"], models, 1e-3).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 40
    for r, w in got:
        m = np.mean([x for a, b, x in rows if (a, b) == (r, w)], axis=0)
        assert got[r, w] == pytest.approx(np.sqrt((m * m / (models["A"].variances + 1e-3)).sum()))


def test_best_over_references(spark):
    rows = [(1, "a b c d", ["x y", "a b c e", "d c b a"]), (2, "a b", []), (3, "a b", None), (4, "", ["a"])]
    got = {r["uid"]: r for r in best_over_references(spark.createDataFrame(rows, "uid int, pred string, refs array<string>"), "uid", "pred", "refs").collect()}
    each = [ngram_cosines("a b c d".split(), r.split(), 4) for r in rows[0][2]]
    assert got[1]["cider"] == pytest.approx(2.5 * sum(max(c) for c in zip(*each)))
    assert got[1]["rouge_l"] == pytest.approx(75.0)
    assert [(got[i]["cider"], got[i]["rouge_l"]) for i in (2, 3, 4)] == [(0.0, 0.0)] * 3


def test_permuted_scores_hold_a_batch_and_the_open_window(spark, capsys):
    import hashlib

    rng = np.random.default_rng(8)
    data = [(r, w, s, rng.normal(size=3).tolist()) for r in (0.0, 0.5) for w in range(6) for s in range(5 + w)]
    drawn = spark.createDataFrame(data, "ratio double, window_id long, slot int, A array<double>").repartition(3)
    model = vec.Pca(np.zeros(3), np.eye(3), np.array([1.0, 2.0, 3.0]), 10)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # windows go on over several batches
    try:
        out = vec.permuted_scores(drawn, ["ratio", "window_id"], "slot", {"A": model}, 0.1, 3)
        out.explain()
        got = {(r["ratio"], r["window_id"], r["perm"], r["stream"]): r["score"] for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "collect_list" not in capsys.readouterr().out  # no window is gathered into one value
    want = {}
    for r in (0.0, 0.5):
        for w in range(6):
            rows = {s: np.array(v) for a, b, s, v in data if (a, b) == (r, w)}
            for perm in range(3):
                total = np.zeros(3)
                for s in sorted(rows, key=lambda s: (hashlib.md5(f"{perm}:{w}:{s}".encode()).hexdigest(), s)):
                    total = total + rows[s]
                z = total / len(rows)
                want[r, w, perm, "A"] = float(np.sqrt((z * z / (model.variances + 0.1)).sum()))
    assert got == pytest.approx(want, rel=1e-12)


def test_the_grid_broadcasts_no_plan(spark, monkeypatch, capsys):
    from conftest import SF

    from tidegauge.plans import vectors as plans

    stored, cut = [], plans.cut_lineage
    monkeypatch.setattr(plans, "cut_lineage", lambda df: stored.append(df) or cut(df))
    assert plans.reference_drift_grid(spark, SF).count() > 0
    stored[-1].explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin [label" in plan and "pool_idx" in plan.split("SortMergeJoin [label", 1)[1].splitlines()[0]
