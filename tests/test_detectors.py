"""Sequential detectors: native folds against plain updates, window detectors against direct tests, tails."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import steps
from tidegauge.functions import blocks as bl
from tidegauge.functions import sequential as seq


def streams(seed=0, n=24, size=180):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        p = np.where(np.arange(size) < size // 2, 0.15, 0.15 + 0.03 * i)
        out.append((i, [float(x) for x in (rng.random(size) < np.minimum(p, 1.0))], [float(x) for x in rng.normal(p * 10, 3.0)]))
    return out


PARAMS = {
    "ddm": {"warm": 10, "drift": 1.5}, "eddm": {"warm": 4, "beta": 0.9}, "hddm_w": {"conf": 0.05}, "page_hinkley": {"threshold": 20.0},
}


@pytest.mark.parametrize("method", list(PARAMS))
def test_fold_equals_updates(spark, method):
    rows = streams()
    df = spark.createDataFrame(rows, "id int, bits array<double>, vals array<double>")
    f, p = seq.fold(method, PARAMS[method]), seq.settings(method, PARAMS[method])
    xs = "vals" if method == "page_hinkley" else "bits"
    got = {
        r["id"]: r for r in df.select(
            "id", seq.alarm_trace(f, xs).alias("at"), seq.warm_state(f, xs).alias("w"),
            seq.onset_detection(f, f"slice({xs}, 1, 90)", f"slice({xs}, 91, 90)", f.start()).alias("o"),
            seq.first_detection(f, xs, f.start()).alias("first"),
        ).collect()
    }
    alarms = 0
    for i, bits, vals in rows:
        v = vals if xs == "vals" else bits
        trace, warm = steps.run(method, p, v)
        alarms += len(trace)
        assert got[i]["at"] == trace
        assert got[i]["first"] == (trace or [None])[0]
        for k, value in warm.items():
            assert got[i]["w"][k] == pytest.approx(value, rel=1e-12)
        pre, before = steps.run(method, p, v[:90])
        assert got[i]["o"]["prechange"] == len(pre)
        assert got[i]["o"]["delay"] == (steps.run(method, p, v[90:], before, most=1)[0] or [None])[0]
    assert alarms > 0


def adwin_direct(p, values):
    """Every cut tried with plain means."""
    w, hits, n = [], [], 0
    for pos, x in enumerate(values, 1):
        n += 1
        w = (w + [x])[-int(p["max_window"]):]
        if len(w) < p["grace"] or n % p["clock"]:
            continue
        m, var = len(w), float(np.var(w))
        lt = math.log(max(2 * math.log(max(m, 2)) / p["delta"], 1.0000001))
        for c in range(int(p["min_len"]), m - int(p["min_len"]) + 1, int(p["step"])):
            h = 1 / c + 1 / (m - c)
            if abs(np.mean(w[c:]) - np.mean(w[:c])) > math.sqrt(2 * var * h * lt) + 2 * h * lt / 3:
                hits.append(pos)
                w, n = [], 0  # an alarm resets the detector in a trace
                break
    return hits


def test_adwin_against_direct():
    p = seq.settings("adwin", {"delta": 0.3, "clock": 4, "min_len": 5, "grace": 15})
    total = 0
    for _, bits, vals in streams(1):
        assert bl.trace("adwin", p, bits)[0] == adwin_direct(p, bits)
        total += len(adwin_direct(p, bits))
    assert total > 0


def test_kswin_against_direct():
    p = seq.settings("kswin", {"alpha": 0.05, "window": 60, "stat": 20, "clock": 3})
    total = 0
    for _, _, vals in streams(2):
        hits, w, n = [], [], 0
        for pos, x in enumerate(vals, 1):
            n += 1
            w = (w + [x])[-60:]
            if len(w) < 60 or n % 3:
                continue
            old, new = [w[i] for i in bl.kswin_picks(n, 40, 20)], w[-20:]
            d = max(abs(np.mean(np.array(old) <= t) - np.mean(np.array(new) <= t)) for t in old + new)
            if bl.ks_equal_pvalue(round(d * 20), 20) <= 0.05 and d > 0.1:
                hits.append(pos)
                w, n = [], 0
        assert bl.trace("kswin", p, vals)[0] == hits
        total += len(hits)
    assert total > 0 and len(set(bl.kswin_picks(17, 40, 20))) == 20


def optwin_direct(p, values):
    """Every cut tested with full t and F tails, no early rejection."""
    w, hits, n = [], [], 0
    for pos, x in enumerate(values, 1):
        n += 1
        w = (w + [x])[-int(p["max_window"]):]
        m, least = len(w), int(p["min_len"])
        if m < 2 * least or n % p["clock"]:
            continue
        cuts = range(least, m - least + 1, int(p["step"]))
        level = p["delta"] / (len(cuts) * max(math.ceil(p["max_window"] / p["clock"]), 1))
        for c in cuts:
            old, new = np.array(w[:c]), np.array(w[c:])
            va, vb = old.var(ddof=1), new.var(ddof=1)
            rise = new.mean() - old.mean()
            eff = abs(rise) if p["two_sided"] else rise
            if not (eff > 0 and eff >= p["rigor"] * math.sqrt(max(va, 1e-12)) / math.sqrt(len(new))):
                continue
            ra, rb = va / len(old), vb / len(new)
            t_p = f_p = 1.0
            if ra + rb > 1e-12:
                dof = (ra + rb) ** 2 / (ra**2 / (len(old) - 1) + rb**2 / (len(new) - 1))
                t = rise / math.sqrt(ra + rb)
                t_p = 2 * bl.t_sf(abs(t), dof) if p["two_sided"] else bl.t_sf(t, dof)
            if p["f_test"] and va > 1e-12 and vb > 1e-12:
                up = bl.f_sf(vb / va, len(new) - 1, len(old) - 1)
                f_p = min(1.0, 2 * min(up, 1 - up)) if p["two_sided"] else up
            if t_p <= level or f_p <= level:
                hits.append(pos)
                w, n = [], 0
                break
    return hits


@pytest.mark.parametrize("f_test,two_sided", [(0, 1), (1, 0), (1, 1), (0, 0)])
def test_optwin_against_direct(f_test, two_sided):
    p = seq.settings("optwin", {"delta": 0.5, "min_len": 10, "f_test": f_test, "two_sided": two_sided})
    total = 0
    for _, _, vals in streams(3):
        want = optwin_direct(p, vals)
        assert bl.trace("optwin", p, vals)[0] == want
        total += len(want)
    assert total > 0


def integral(f, lo, hi, n=200_000):
    x = np.linspace(lo, hi, n)
    return float(np.trapezoid(f(x), x))


def test_tails_against_quadrature():
    for t, df in [(0.5, 3.0), (2.0, 10.0), (-1.0, 7.5), (4.0, 40.0)]:
        c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
        head = integral(lambda x: c * (1 + x * x / df) ** (-(df + 1) / 2), 0.0, abs(t))
        assert bl.t_sf(t, df) == pytest.approx(0.5 - math.copysign(head, t), abs=1e-8)
    for x, d1, d2 in [(0.7, 4.0, 9.0), (2.0, 5.0, 10.0), (3.5, 20.0, 15.0)]:
        c = math.exp(math.lgamma((d1 + d2) / 2) - math.lgamma(d1 / 2) - math.lgamma(d2 / 2)) * (d1 / d2) ** (d1 / 2)
        head = integral(lambda v: c * v ** (d1 / 2 - 1) * (1 + d1 * v / d2) ** (-(d1 + d2) / 2), 1e-12, x)
        assert bl.f_sf(x, d1, d2) == pytest.approx(1 - head, abs=1e-6)


def test_exact_ks_pvalue_by_enumeration():
    from itertools import combinations

    m = 5
    stats = []
    for pick in combinations(range(2 * m), m):
        a = np.zeros(2 * m)
        a[list(pick)] = 1
        stats.append(int(np.abs(np.cumsum(a) - np.cumsum(1 - a)).max()))
    for k in range(1, m + 1):
        assert bl.ks_equal_pvalue(k, m) == pytest.approx(np.mean(np.array(stats) >= k))


def test_budget_recall_is_monotone(spark):
    from tidegauge.operators.signals import budget_recall, trial_summary

    rows = [(i, None if i % 4 == 0 else (i * 7) % 50 + 1, i % 2, i % 3, 9) for i in range(40)]
    df = spark.createDataFrame(rows, "trial int, delay int, prechange int, alarm_windows int, windows int")
    r = [x["recall"] for x in budget_recall(df, [], [5, 10, 20, 50], F.lit(50)).orderBy("budget").collect()]
    assert r == sorted(r)
    s = trial_summary(df, [], 50, [10]).first()
    assert s["r50"] + s["miss_rate"] == pytest.approx(1.0)


@pytest.mark.parametrize("method", list(PARAMS))
def test_blocks_equal_steps(method):
    rng, p, alarms = np.random.default_rng(11), seq.settings(method, PARAMS[method]), 0
    for trial in range(40):
        size = int(rng.integers(1, 3000))
        rate = np.where(np.arange(size) < size // 2, 0.15, 0.15 + 0.02 * trial)
        x = rng.normal(rate * 10, 3.0) if method == "page_hinkley" else (rng.random(size) < np.minimum(rate, 1.0)).astype(float)
        cut = int(rng.integers(0, size))
        want, end = steps.run(method, p, x)
        got, state = bl.trace(method, p, x)
        head, middle = bl.trace(method, p, x[:cut])
        tail, last = bl.trace(method, p, x[cut:], middle)
        assert got == want == head + [cut + a for a in tail]
        assert state == pytest.approx(list(end.values()), rel=1e-9, abs=1e-12) and last == pytest.approx(state, rel=1e-9, abs=1e-12)
        alarms += len(want)
    assert alarms > 0


def test_parts_move_a_state_over_blocks_without_alarm():
    """An element, or two composed ones, move any state as reading the values does."""
    rng = np.random.default_rng(12)
    quiet = {"ddm": {"drift": 1e9}, "eddm": {"beta": -1.0}, "hddm_w": {"conf": 1e-200}, "page_hinkley": {"threshold": 1e9}, "adwin": {"delta": 1e-300}, "kswin": {"alpha": -1.0}, "optwin": {"delta": 1e-300}}
    ends = {"ddm": [2, 5], "eddm": [5, 6], "hddm_w": [3, 6, 9], "page_hinkley": [2, 4, 6]}
    for method, given in quiet.items():
        p = seq.settings(method, given)
        for sizes in ((0, 40, 60), (1, 1, 1), (500, 30, 7), (90, 700, 450), (3, 100, 0)):
            a, b, c = (rng.random(n) < 0.2 for n in sizes)
            begin = bl.trace(method, p, a.astype(float))[1]
            want = bl.trace(method, p, np.concatenate([b, c]).astype(float), begin)[1]
            state, lo = begin, 0
            for part, hi in zip(bl.PARTS[method], ends.get(method, [None])):
                b1 = part.element(p, b.astype(float), state)
                joined = b1
                if len(c):
                    middle = bl.trace(method, p, b.astype(float), begin)[1]  # earlier parts at the second block's start
                    joined = part.compose(p, b1, part.element(p, c.astype(float), middle))
                moved = part.apply(p, begin, joined)
                state = moved if hi is None else [*state[:lo], *begin[lo:]]
                if hi is not None:
                    assert moved[lo:hi] == pytest.approx(want[lo:hi], rel=1e-9, abs=1e-12), (method, sizes)
                    lo = hi
                else:
                    assert moved == want
