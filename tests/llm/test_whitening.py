"""Whitening against plain numpy over all rows, and its edge cases."""

import math

import numpy as np
import pytest

from tidegauge.llm import whitening

SF = "/root/testdata/sf0.001"


def plain(rows, components=32, weights=None):
    ids, x = [r[0] for r in rows], np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in r[1]] for r in rows], np.int64)
    n, s = len(x), x.sum(axis=0)
    y = x - s / n
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    top = np.argsort(-e)[:components]
    z = y @ u[:, top] / np.sqrt(e[top])
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x]
    return {i: (d, np.abs(w)) for i, d, w in zip(ids, deviation, z)}, e[top] / np.trace(v), n


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, digest string, n int")


def gathered(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["vec_id"], {})[r["component"]] = r
    return out


def test_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, explained, n = plain(rows)
    got = gathered(whitening.whiten(spark.read.parquet(f"{SF}/embeddings.parquet")))
    assert set(got) == set(want)
    signs = {}
    for i, comps in got.items():
        assert sorted(comps) == list(range(1, 33))
        for c, r in comps.items():
            assert r["n"] == n and r["deviation"] == want[i][0] and r["identity_error"] < 1e-9
            assert abs(abs(r["whitened"]) - want[i][1][c - 1]) < 1e-8 and abs(r["explained"] / explained[c - 1] - 1) < 1e-9
            signs.setdefault(c, []).append(r["whitened"])
    z = np.array([signs[c] for c in sorted(signs)])
    assert np.abs(z @ z.T / n - np.eye(32)).max() < 1e-9  # one sign for all rows


@pytest.mark.parametrize("repeats", [True, False])
def test_copies_weigh_as_often_as_they_stand(spark, repeats):
    rng = np.random.default_rng(5)
    base = [(i, [float(c) for c in rng.normal(size=4)]) for i in range(200)]
    rows = base + [(1000 + i, base[3][1]) for i in range(150)] + [(5000 + i, base[i % 7][1]) for i in range(20)]
    want, explained, n = plain(rows if repeats else base)
    got = gathered(whitening.whiten(frame(spark, rows), repeats=repeats))
    assert set(got) == {i for i, _ in rows}
    for i, _ in (rows if repeats else base):
        assert got[i][1]["n"] == n and got[i][1]["deviation"] == want[i][0] and got[i][1]["identity_error"] < 1e-9
        assert np.allclose([abs(got[i][c]["whitened"]) for c in (1, 2, 3, 4)], want[i][1], atol=1e-9)
    assert got[1000][2]["whitened"] == got[3][2]["whitened"]


def test_rows_that_drop_out(spark):
    ok = [(i, [float(i % 3), float(i % 5), float(i * i % 7)]) for i in range(30)]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [float("nan"), 1.0, 2.0]), (104, [float("inf"), 0.0, 0.0]), (105, [1.0, 2.0]), (106, [3e30, 1.0, 1.0])]
    got = gathered(whitening.whiten(frame(spark, ok + bad + [(None, ok[4][1]), (7, ok[7][1])])))
    assert set(got) == {*range(30), None} and got[0][1]["n"] == 32
    assert len(whitening.whiten(frame(spark, ok + [(7, ok[7][1])])).where("vec_id = 7").collect()) == 6


def test_flat_components_and_small_tables(spark):
    flat = gathered(whitening.whiten(frame(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(10)])))
    assert abs(flat[0][1]["whitened"]) > 1 and flat[0][2]["whitened"] is None and flat[0][3]["whitened"] is None and flat[0][1]["identity_error"] < 1e-9
    one = gathered(whitening.whiten(frame(spark, [(1, [1.0, 2.0])])))
    assert one[1][1]["whitened"] is None and one[1][1]["deviation"] == 0 and one[1][1]["explained"] is None and one[1][1]["identity_error"] is None
    assert whitening.whiten(frame(spark, [])).collect() == [] and whitening.whiten(frame(spark, [(1, None)])).collect() == []


def test_deviations_beyond_64_bits():
    x = np.array([[1_000_000 + (1 << 40), 1_000_000], [1_000_000, 1_000_000], [1_000_000, 1_000_000]], np.int64)
    sums = [int(c) for c in x.sum(axis=0)]
    assert whitening._deviation(x, 3, sums)[0] is None and whitening._deviation(x // (1 << 12), 3, [int(c) for c in (x // (1 << 12)).sum(axis=0)]) == [
        sum((3 * int(a) - int(s)) ** 2 for a, s in zip(r, (x // (1 << 12)).sum(axis=0))) for r in x // (1 << 12)]
