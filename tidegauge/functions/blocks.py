"""Sequential detectors on whole blocks of values in numpy.

A detector reads a block in strides: all values up to the next alarm are worked on at once, from running sums, running extremes and
decaying sums; the four fold methods give the same levels as their step-by-step definitions up to rounding. The window methods test
all clock ticks of a stride together: ADWIN and OPTWIN as a matrix of ticks by cuts from prefix sums, KSWIN as a matrix of ticks by
sorted samples. An alarm resets a detector, and a new stride begins behind it.

A state is a plain list of numbers: the fields of FIELDS in that order; for a window method the number of values read since the last
reset and then the values of its window. ``PARTS`` describes how a state moves over a block in which no alarm falls: each
part of the state is moved by an element that can be composed, so the state at the start of any block of a stream
follows from a scan over elements instead of a run over all values before it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import lru_cache
from statistics import NormalDist
from typing import Any, NamedTuple

import numpy as np

Params = dict[str, Any]
State = list[float]
INF = math.inf

FIELDS: dict[str, dict[str, float]] = {  # state fields of a fold method and their values after a reset
    "ddm": {"n": 0.0, "mean": 0.0, "best": INF, "bp": INF, "bs": 0.0},
    "eddm": {"n": 0.0, "k": 0.0, "last": 0.0, "mean": 0.0, "m2": 0.0, "top": -1.0},
    "hddm_w": {"n": 0.0, "t": 0.0, "ti": 1.0, "cut": INF, "a": 0.0, "ai": 1.0, "b": 0.0, "bi": 1.0, "bn": 0.0},
    "page_hinkley": {"n": 0.0, "mean": 0.0, "up": 0.0, "down": 0.0, "lo": INF, "hi": -INF},
}
WINDOWED = ("kswin", "adwin", "optwin")
STRIDE, LONGEST = 256, 8192  # values of the first stride after a reset, and of the longest one
CELLS = 1 << 18  # cells of one matrix of ticks


def start(method: str) -> State:
    return [0.0] if method in WINDOWED else list(FIELDS[method].values())


# ---------------------------------------------------------------- running values


def decayed(x: np.ndarray, keep: float, begin: float = 0.0) -> np.ndarray:
    """y[i] = keep * y[i - 1] + x[i], with y[-1] = begin, in pieces short enough for the powers of ``keep``."""
    out = np.empty(len(x))
    piece = max(1, min(len(x), int(20.0 / -math.log(keep)) if 0.0 < keep < 1.0 else len(x)))
    powers = keep ** np.arange(1, piece + 1)
    for lo in range(0, len(x), piece):
        part = x[lo : lo + piece]
        up = powers[: len(part)]
        out[lo : lo + piece] = (np.cumsum(part / up) + begin) * up
        begin = out[min(lo + piece, len(x)) - 1]
    return out


@lru_cache(maxsize=64)
def _spread(lam: float) -> np.ndarray:
    """lam**2 + (1 - lam)**2 * v from v = 1 on, until it moves no more: the variance factor after that many values."""
    out, keep = [1.0], 1 - lam
    while len(out) < 2 or (out[-1] != out[-2] and len(out) < 1_000_000):
        out.append(lam * lam + keep * keep * out[-1])
    return np.array(out)


def _spread_at(lam: float, n: np.ndarray) -> np.ndarray:
    table = _spread(lam)
    return table[np.minimum(n.astype(np.int64), len(table) - 1)]


def _last(marks: np.ndarray) -> np.ndarray:
    """Index of the last mark up to each place, -1 where there is none yet."""
    return np.maximum.accumulate(np.where(marks, np.arange(len(marks)), -1))


def _before(values: np.ndarray, first: float) -> np.ndarray:
    return np.concatenate([[first], values[:-1]])


def _first(mask: np.ndarray) -> int | None:
    at = np.flatnonzero(mask)
    return int(at[0]) if at.size else None


# ---------------------------------------------------------------- fold methods: (alarm mask, state columns) of a stride


def _ddm(p: Params, s: State, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    n = s[0] + np.arange(1, len(x) + 1)
    mean = (s[0] * s[1] + np.cumsum(x)) / n
    sd = np.sqrt(np.maximum(mean * (1 - mean) / n, 0.0))
    level, warm = mean + sd, n > p["warm"]
    best = np.minimum.accumulate(np.concatenate([[s[2]], np.where(warm, level, INF)]))
    at = _last(warm & (level <= best[:-1]))
    bp, bs = np.where(at >= 0, mean[at], s[3]), np.where(at >= 0, sd[at], s[4])
    return warm & (level > bp + p["drift"] * bs), [n, mean, best[1:], bp, bs]


def _eddm(p: Params, s: State, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    n = s[0] + np.arange(1, len(x) + 1)
    hit = x == 1
    gap = np.where(hit, n - np.where(_before(_last(hit), -1) >= 0, n[_before(_last(hit), -1).astype(int)], s[2]), 0.0)
    k = s[1] + np.cumsum(hit)
    at = _last(hit)
    last = np.where(at >= 0, n[at], s[2])
    squares = s[4] + s[1] * s[3] ** 2 + np.cumsum(gap * gap)
    some = np.maximum(k, 1)
    mean = last / some
    m2 = np.maximum(squares - last * last / some, 0.0)
    score = np.where(hit & (n > p["warm"]) & (k >= 2), mean + 2.0 * np.sqrt(m2 / np.maximum(k - 1, 1)), -INF)
    top = np.maximum.accumulate(np.concatenate([[s[5]], score]))
    old = top[:-1]
    alarm = (score > -INF) & (score <= old) & (k > p["warm"]) & (old > 0) & (score < p["beta"] * old)
    return alarm, [n, k, last, mean, m2, top[1:]]


def _hddm_w(p: Params, s: State, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    lam, keep = p["lam"], 1 - p["lam"]
    scale = math.log(1.0 / p["conf"]) / 2.0
    steps = np.arange(1, len(x) + 1)
    n = s[0] + steps
    t = decayed(lam * x, keep, x[0] if s[0] == 0 else s[1])
    ti = _spread_at(lam, n)
    level = t + np.sqrt(ti * scale)
    cut = np.minimum.accumulate(np.concatenate([[s[3]], level]))
    here = level < cut[:-1]
    at = _last(here)
    inside = at >= 0
    a, ai = np.where(inside, t[at], s[4]), np.where(inside, ti[at], s[5])
    bn = np.where(inside, np.arange(len(x)) - at, s[8] + steps)
    # the newer part: a decaying sum that begins behind the last cut with its first value
    plain = decayed(lam * x, keep)
    nxt = np.minimum(at + 1, len(x) - 1)
    since = keep ** np.maximum(np.arange(len(x)) - nxt, 0)
    fresh = plain - since * plain[nxt] + since * x[nxt]
    older = decayed(lam * x, keep, x[0] if s[8] == 0 else s[6])
    b = np.where(inside, np.where(here, 0.0, fresh), older)
    bi = _spread_at(lam, bn)
    alarm = (bn > 0) & ~here & (b - a > np.sqrt((ai + bi) * scale))
    return alarm, [n, t, ti, cut[1:], a, ai, b, bi, bn]


def _page_hinkley(p: Params, s: State, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    n = s[0] + np.arange(1, len(x) + 1)
    mean = (s[0] * s[1] + np.cumsum(x)) / n
    up = decayed(x - mean - p["delta"], p["alpha"], s[2])
    down = decayed(x - mean + p["delta"], p["alpha"], s[3])
    lo, hi = np.minimum(np.minimum.accumulate(up), s[4]), np.maximum(np.maximum.accumulate(down), s[5])
    mode = p.get("mode", "both")
    moved = np.zeros(len(x), bool)
    if mode in ("up", "both"):
        moved |= up - lo > p["threshold"]
    if mode in ("down", "both"):
        moved |= hi - down > p["threshold"]
    return (n >= p["min_n"]) & moved, [n, mean, up, down, lo, hi]


_FOLDED: dict[str, Callable[[Params, State, np.ndarray], tuple[np.ndarray, list[np.ndarray]]]] = {
    "ddm": _ddm, "eddm": _eddm, "hddm_w": _hddm_w, "page_hinkley": _page_hinkley,
}


# ---------------------------------------------------------------- window methods: first alarming tick of a stride


def ks_equal_pvalue(steps: int, m: int) -> float:
    """Exact two-sided p-value of the KS distance steps/m for two samples of the same size m."""
    if steps <= 0:
        return 1.0
    total = math.comb(2 * m, m)
    tail = sum((-1) ** (i + 1) * math.comb(2 * m, m - i * steps) for i in range(1, m // steps + 1))
    return min(1.0, 2.0 * tail / total)


@lru_cache(maxsize=256)
def _ks_table(m: int) -> np.ndarray:
    return np.array([ks_equal_pvalue(k, m) for k in range(m + 1)])


def kswin_step(older: int) -> int:
    """Multiplier of the sampling rule: the first number from 37 on without a common factor with the older part."""
    return next(a for a in range(37, 37 + older + 1) if math.gcd(a, older) == 1)


def kswin_picks(n: int | np.ndarray, older: int, stat: int) -> np.ndarray:
    """Distinct positions sampled from the older part, from a rule both engines can repeat; one row for each n."""
    return (kswin_step(older) * np.arange(stat) + 11 * np.asarray(n)[..., None]) % older


FEW = 4  # different values up to which KSWIN counts instead of sorting


def _kswin(p: Params, seen: np.ndarray, ends: np.ndarray, sizes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Ticks where the sampled older part and the newest values differ by the exact KS test."""
    size, stat = int(p["window"]), int(p["stat"])
    old, new = (ends - size)[:, None] + kswin_picks(n, size - stat, stat), ends[:, None] - stat + np.arange(stat)
    gap = np.zeros((len(seen), len(ends)), np.int64)
    values = _different(seen)
    if values is not None:  # the gap is largest behind one of the values; the last one has everything up to it
        for v in values[:-1]:
            upto = (seen <= v).astype(np.int32)
            before = np.hstack([np.zeros((len(seen), 1), np.int64), upto.cumsum(axis=1, dtype=np.int64)])
            apart = -(before[:, ends] - before[:, ends - stat])
            for at in old.T:
                apart += upto.take(at, axis=1)
            gap = np.maximum(gap, np.abs(apart))
    else:
        both = np.concatenate([seen[:, old], seen[:, new]], axis=2)
        by = np.argsort(both, axis=2, kind="stable")
        ranked = np.take_along_axis(both, by, axis=2)
        ahead = np.cumsum(np.where(by < stat, 1, -1), axis=2)
        whole = np.concatenate([ranked[:, :, 1:] != ranked[:, :, :-1], np.ones((*ranked.shape[:2], 1), bool)], axis=2)  # behind the last of equal values
        gap = np.where(whole, np.abs(ahead), 0).max(axis=2)
    return (_ks_table(stat)[gap] <= p["alpha"]) & (gap / stat > 0.1)


def _different(seen: np.ndarray) -> list[float] | None:
    """The different values in order where they are at most FEW and all known, else None."""
    out, low = [], -INF
    if np.isnan(seen).any():
        return None
    left = seen.ravel()
    while left.size:
        if len(out) == FEW:
            return None
        low = left.min()
        out.append(float(low))
        left = left[left > low]
    return out


class Split(NamedTuple):
    """Windows (rows of values by ticks) seen as an older and a newer part at many cuts (last axis) at once; ``real`` marks the cuts a window has."""

    older: np.ndarray
    newer: np.ndarray
    rise: np.ndarray
    older_var: np.ndarray | None
    newer_var: np.ndarray | None
    real: np.ndarray
    spread: np.ndarray  # variance of each whole window, over all its values


def _split(p: Params, seen: np.ndarray, ends: np.ndarray, sizes: np.ndarray, variances: bool = True) -> Split:
    least = int(p["min_len"])
    cuts = np.arange(least, max(least, int(sizes.max()) - least) + 1, int(p["step"]))
    z = seen - seen.mean(axis=1, keepdims=True)
    nought = np.zeros((len(z), 1))
    sums, squares = (np.hstack([nought, v.cumsum(axis=1)]) for v in (z, z * z))
    begin = (ends - sizes)[:, None]
    real = cuts <= (sizes - least)[:, None]
    mid = np.where(real, begin + cuts, begin + least)
    older = (mid - begin).astype(np.float64)
    newer = sizes[:, None] - older

    def parts(run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = run.take(mid, axis=1)
        return at - run[:, begin], run[:, ends][:, :, None] - at

    def variance(total: np.ndarray, square: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.clip((square - total**2 / n) / np.maximum(n - 1, 1), 0.0, None)

    head, tail = parts(sums)
    if variances:
        head2, tail2 = parts(squares)
        by_part = variance(head, head2, older), variance(tail, tail2, newer)
    else:
        by_part = None, None
    first, second = ((run[:, ends] - run[:, begin[:, 0]]) / sizes for run in (sums, squares))
    spread = np.clip(second - first**2, 0.0, None)
    return Split(older, newer, tail / newer - head / older, *by_part, real, spread)


def _adwin(p: Params, seen: np.ndarray, ends: np.ndarray, sizes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Ticks where the means of the parts differ at some cut by more than the bound of adaptive windowing.

    With m the harmonic size of the parts and L = ln(2 / delta'), the bound is sqrt(2 v L / m) + 2 L / (3 m).
    """
    part = _split(p, seen, ends, sizes, variances=False)
    log_term = np.maximum(np.log(2.0 * np.log(sizes) / p["delta"]), 1e-7)[:, None]
    per_m = sizes[:, None] / (part.older * part.newer)
    bound = np.sqrt(2.0 * part.spread[:, :, None] * log_term * per_m) + 2.0 / 3.0 * log_term * per_m
    return (part.real & ((np.abs(part.rise) if p["two_sided"] else part.rise) > bound)).any(axis=2)


@lru_cache(maxsize=4096)
def _normal_limit(tail: float) -> float:
    """Slightly below the normal quantile of the tail, so rounding never rejects a passing cut."""
    return -INF if tail >= 1.0 else -NormalDist().inv_cdf(tail) - 1e-6


BETA_TERMS = 60  # terms of the continued fraction; below the mean it is exact to rounding with far fewer


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function of arrays, by its continued fraction evaluated from the last term back."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=np.float64) for v in (a, b, x)))
    swap = x > (a + 1.0) / (a + b + 2.0)  # the fraction converges fast below the mean; use the symmetry above it
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.clip(np.where(swap, 1.0 - x, x), 0.0, 1.0)
    tail = np.ones_like(y)
    for m in range(BETA_TERMS, 0, -1):
        odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        tail = 1.0 + even / (1.0 + odd / tail)
    first = 1.0 - (p + q) * y / (p + 1.0) / tail
    logs = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore"):
        front = np.exp(logs(p + q) - logs(p) - logs(q) + p * np.log(y) + q * np.log1p(-y)) / p
    part = np.where(y <= 0.0, 0.0, np.where(y >= 1.0, 1.0, front / first))
    return np.where(swap, 1.0 - part, part)


def t_sf(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """Upper tail of Student's t."""
    half = 0.5 * beta_inc(dof / 2.0, 0.5, dof / (dof + t * t))
    return np.where(t >= 0, half, 1.0 - half)


def f_sf(ratio: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    """Upper tail of Fisher's F."""
    return beta_inc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * ratio))


def _optwin(p: Params, seen: np.ndarray, ends: np.ndarray, sizes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Ticks where at some cut the newer part lies above the older by Welch's t test (or spreads wider by the F test).

    Every window is tested at many cuts and many times while it fills, so the level is shared among them. A rise below
    ``rigor`` standard errors of the older part is no drift however sure the tests are. The exact tails are worked out for the cells of
    all ticks together, and only for those beyond a limit that every passing cell exceeds.
    """
    part, sides = _split(p, seen, ends, sizes), 2.0 if p["two_sided"] else 1.0
    level = p["delta"] / (part.real.sum(axis=1) * max(math.ceil(p["max_window"] / p["clock"]), 1))
    limit = np.array([_normal_limit(v / sides) for v in level.tolist()])
    shape = part.rise.shape
    levels, older, newer = (np.broadcast_to(v, shape) for v in (level[:, None], part.older, part.newer))
    height = np.abs(part.rise) if p["two_sided"] else part.rise

    def wide(cells: tuple | np.ndarray) -> np.ndarray:
        return height[cells] * np.sqrt(newer[cells]) >= p["rigor"] * np.sqrt(np.maximum(part.older_var[cells], 1e-12))

    by_old, by_new = part.older_var / part.older, part.newer_var / part.newer
    error = by_old + by_new
    found = np.zeros(shape, bool)
    # Student's tails are never below the normal ones: only cells beyond the normal limit need the exact tail.
    t = np.divide(height, np.sqrt(error), out=np.zeros_like(height), where=error > 1e-12)
    rises = part.real & (height > 0.0)
    near = rises & (error > 1e-12) & (t >= limit[:, None])
    near[near] = wide(near)
    if near.any():
        spread = by_old[near] ** 2 / np.maximum(older[near] - 1, 1) + by_new[near] ** 2 / np.maximum(newer[near] - 1, 1)
        dof = np.divide(error[near] ** 2, spread, out=np.ones(int(near.sum())), where=spread > 1e-18)
        found[near] = sides * t_sf(t[near], dof) <= levels[near]
    if p["f_test"]:
        open_f = rises & wide(...) & ~found & (part.older_var > 1e-12) & (part.newer_var > 1e-12)
        open_f[np.maximum.accumulate(found.any(axis=2), axis=1)] = False  # ticks at or behind one that is decided
        if open_f.any():
            above = f_sf(part.newer_var[open_f] / part.older_var[open_f], newer[open_f] - 1, older[open_f] - 1)
            found[open_f] = (np.minimum(1.0, 2.0 * np.minimum(above, 1.0 - above)) if p["two_sided"] else above) <= levels[open_f]
    return found.any(axis=2)


_TICKS: dict[str, Callable[[Params, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]] = {
    "kswin": _kswin, "adwin": _adwin, "optwin": _optwin,
}


def window_size(method: str, p: Params) -> int:
    return int(p["window"] if method == "kswin" else p["max_window"])


def _needed(method: str, p: Params) -> int:
    """Values a window must hold before it is tested."""
    if method == "kswin":
        return int(p["window"])
    return max(int(p.get("grace", 0)), 2 * int(p["min_len"])) if method == "optwin" else max(int(p["grace"]), 2 * int(p["min_len"]))


# ---------------------------------------------------------------- strides


def advance(method: str, p: Params, s: State, x: np.ndarray) -> tuple[int | None, State]:
    """Read a stride: 0-based position of the first alarm and the state there, or None and the state behind the stride."""
    if not len(x):
        return None, s
    if method in WINDOWED:
        return _advance_window(method, p, s, x)
    alarm, columns = _FOLDED[method](p, s, x)
    hit = _first(alarm)
    at = len(x) - 1 if hit is None else hit
    return hit, [float(c[at]) for c in columns]


def _advance_window(method: str, p: Params, s: State, x: np.ndarray) -> tuple[int | None, State]:
    n, kept = int(s[0]), np.asarray(s[1:], dtype=np.float64)
    size, clock = window_size(method, p), int(p["clock"])
    seen = np.concatenate([kept, x])
    ticks = np.arange(clock - n % clock, len(x) + 1, clock)  # values of the stride read at each tick
    ends = len(kept) + ticks
    sizes = np.minimum(ends, size)
    due = sizes >= _needed(method, p)
    ticks, ends, sizes = ticks[due], ends[due], sizes[due]
    across = int(p["stat"]) * 2 if method == "kswin" else max(1, size // int(p["step"]))
    lo, rows = 0, 32  # the first alarm often comes soon: few ticks first, then more at a time
    while lo < len(ticks):
        part = slice(lo, lo + rows)
        begin = int((ends[part] - sizes[part]).min())
        hit = _first(_TICKS[method](p, seen[None, begin : int(ends[part][-1])], ends[part] - begin, sizes[part], n + ticks[part])[0])
        if hit is not None:
            at = int(ticks[lo + hit])
            return at - 1, [float(n + at), *seen[max(0, len(kept) + at - size) : len(kept) + at].tolist()]
        lo, rows = lo + rows, min(2 * rows, max(1, CELLS // across))
    return None, [float(n + len(x)), *seen[max(0, len(seen) - size) :].tolist()]


def trace(method: str, p: Params, values: Sequence[float] | np.ndarray, begin: State | None = None, most: int | None = None) -> tuple[list[int], State]:
    """1-based positions of the alarms (at most ``most``), reset after each, and the state at the end, from a given state."""
    x = np.asarray(values, dtype=np.float64)
    s, hits, at, stride = list(begin) if begin is not None else start(method), [], 0, STRIDE
    while at < len(x):
        hit, s = advance(method, p, s, x[at : at + stride])
        if hit is None:
            at, stride = at + stride, min(2 * stride, LONGEST)
        else:
            at, stride, s = at + hit + 1, STRIDE, start(method)
            hits.append(at)
            if len(hits) == most:
                break
    return hits, s


def joined_trace(
    method: str, p: Params, values: Sequence[float] | np.ndarray, begin: State, fresh: Sequence[int], end: State
) -> tuple[list[int], State]:
    """``trace`` from ``begin``, given the alarms ``fresh`` and the state ``end`` of a run of the same values from a reset detector.

    An alarm resets the detector, so behind the first alarm that both runs have they do the same and nothing more needs to be read.
    """
    x, known, hits, at = np.asarray(values, dtype=np.float64), set(fresh), [], 0
    s = list(begin)
    while at < len(x):
        hit, s = trace(method, p, x[at:], s, most=1)
        if not hit:
            break
        at += hit[0]
        hits.append(at)
        if at in known:
            return hits + [int(a) for a in fresh if a > at], list(end)
    return hits, s


# ---------------------------------------------------------------- many short windows at once


Step = tuple[np.ndarray, list[np.ndarray]]  # (alarm, state fields) behind one value of every window and candidate


def _ddm_step(p: Params, s: list[np.ndarray], x: np.ndarray) -> Step:
    n, mean, best, bp, bs = s
    n = n + 1
    mean = mean + (x - mean) / n
    sd = np.sqrt(np.maximum(mean * (1 - mean) / n, 0.0))
    level, warm = mean + sd, n > p["warm"]
    better = warm & (level <= best)
    best, bp, bs = np.where(better, level, best), np.where(better, mean, bp), np.where(better, sd, bs)
    return warm & (level > bp + p["drift"] * bs), [n, mean, best, bp, bs]


def _eddm_step(p: Params, s: list[np.ndarray], x: np.ndarray) -> Step:
    n, k, last, mean, m2, top = s
    n, hit = n + 1, x == 1
    k, d = k + hit, n - last
    gap, mean = d - mean, np.where(hit, mean + (d - mean) / np.maximum(k, 1), mean)
    m2, last = np.where(hit, m2 + gap * (d - mean), m2), np.where(hit, n, last)
    score, known = mean + 2.0 * np.sqrt(np.maximum(m2 / np.maximum(k - 1, 1), 0.0)), hit & (n > p["warm"]) & (k >= 2)
    alarm = known & (score <= top) & (k > p["warm"]) & (top > 0) & (score < p["beta"] * top)
    return alarm, [n, k, last, mean, m2, np.where(known, np.maximum(top, score), top)]


def _hddm_w_step(p: Params, s: list[np.ndarray], x: np.ndarray) -> Step:
    lam, keep, scale = p["lam"], 1 - p["lam"], np.log(1.0 / p["conf"])
    n, t, ti, cut, a, ai, b, bi, bn = s
    t, ti, n = np.where(n == 0, x, lam * x + keep * t), lam * lam + keep * keep * ti, n + 1
    level = t + np.sqrt(np.maximum(ti, 0.0) * scale / 2.0)
    here = level < cut
    b = np.where(here, 0.0, np.where(bn == 0, x, lam * x + keep * b))
    cut, a, ai = np.where(here, level, cut), np.where(here, t, a), np.where(here, ti, ai)
    bi, bn = np.where(here, 1.0, lam * lam + keep * keep * bi), np.where(here, 0.0, bn + 1)
    return (bn > 0) & (b - a > np.sqrt(np.maximum(ai + bi, 0.0) * scale / 2.0)), [n, t, ti, cut, a, ai, b, bi, bn]


def _page_hinkley_step(p: Params, s: list[np.ndarray], x: np.ndarray) -> Step:
    n, mean, up, down, lo, hi = s
    n = n + 1
    mean = mean + (x - mean) / n
    up, down = p["alpha"] * up + (x - mean) - p["delta"], p["alpha"] * down + (x - mean) + p["delta"]
    lo, hi = np.minimum(lo, up), np.maximum(hi, down)
    mode, moved = p.get("mode", "both"), np.zeros(mean.shape, bool)
    if mode in ("up", "both"):
        moved |= up - lo > p["threshold"]
    if mode in ("down", "both"):
        moved |= hi - down > p["threshold"]
    return (n >= p["min_n"]) & moved, [n, mean, up, down, lo, hi]


_STEPS: dict[str, Callable[[Params, list[np.ndarray], np.ndarray], Step]] = {
    "ddm": _ddm_step, "eddm": _eddm_step, "hddm_w": _hddm_w_step, "page_hinkley": _page_hinkley_step,
}
ACROSS = 1 << 12  # windows times candidates that take a step of a fold together


def _fold_alarms(method: str, fixed: Params, varied: str, values: Sequence[float], states: Sequence[State], heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """Step by step over all windows and candidates side by side, with the arithmetic of the native folds."""
    p, fresh = {**fixed, varied: np.asarray(values, dtype=np.float64)}, list(FIELDS[method].values())
    first = np.zeros((len(tails), len(states)), np.int32)
    s = [np.tile(np.asarray(column, dtype=np.float64), (len(tails), 1)) for column in zip(*states)]
    lost = np.isnan(s).any(axis=0)  # behind a missing value, also of the warm-up, no level is known any more
    with np.errstate(invalid="ignore"):
        for x in heads.T[:, :, None]:
            lost |= np.isnan(x)
            alarm, s = _STEPS[method](p, s, x)
            alarm &= ~lost
            if alarm.any():
                for field, value in zip(s, fresh):
                    field[alarm] = value
        for i, x in enumerate(tails.T[:, :, None]):
            lost |= np.isnan(x)
            alarm, s = _STEPS[method](p, s, x)
            first[alarm & ~lost & (first == 0)] = i + 1
    return first


def _first_ticks(method: str, p: Params, n: int, kept: np.ndarray, x: np.ndarray) -> np.ndarray:
    """First alarm in each row of values behind n values of which ``kept`` are in the window, 0 where there is none."""
    size, clock = window_size(method, p), int(p["clock"])
    ticks = np.arange(clock - n % clock, x.shape[1] + 1, clock)
    ends = kept.shape[1] + ticks
    sizes = np.minimum(ends, size)
    due = sizes >= _needed(method, p)
    ticks, ends, sizes = ticks[due], ends[due], sizes[due]
    out = np.zeros(len(x), np.int32)
    if len(ticks) and len(x):
        begin, end = int((ends - sizes).min()), int(ends[-1])
        rows = max(1, (CELLS >> 3) // (len(ticks) * (int(p["stat"]) * 2 if method == "kswin" else max(1, size // int(p["step"])))))
        for lo in range(0, len(x), rows):
            seen = np.hstack([kept[lo : lo + rows], x[lo : lo + rows]])[:, begin:end]
            hit = _TICKS[method](p, seen, ends - begin, sizes, n + ticks)
            out[lo : lo + rows] = np.where(hit.any(axis=1), ticks[hit.argmax(axis=1)], 0)
    return out


def _window_alarms(method: str, p: Params, n: int, kept: np.ndarray, heads: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first alarm in each tail behind its head, whether there was any alarm); rows go on together as long as they alarm at the same places."""
    at = _first_ticks(method, p, n, kept, heads)
    out, quiet = np.zeros(len(tails), np.int32), at == 0
    if quiet.any():
        seen = np.hstack([kept[quiet], heads[quiet]])
        out[quiet] = _first_ticks(method, p, n + heads.shape[1], seen[:, max(0, seen.shape[1] - window_size(method, p)) :], tails[quiet])
    for a in np.unique(at[~quiet]):
        rows = at == a
        out[rows] = _window_alarms(method, p, 0, kept[rows, :0], heads[rows, a:], tails[rows])[0]
    return out, ~quiet | (out > 0)


STRICT = {"kswin": "alpha", "adwin": "delta", "optwin": "delta"}  # the lower it is, the fewer ticks alarm: none but those of a higher one


def _grid_alarms(method: str, fixed: Params, varied: str, values: Sequence[float], states: Sequence[State], heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """Candidates that start from the same window follow each other, least strict first: only rows in which one alarms are read for the next."""
    out, alike = np.zeros((len(tails), len(states)), np.int32), {}
    turn = math.lcm(int(fixed["clock"]), int(fixed["window"]) - int(fixed["stat"])) if method == "kswin" else int(fixed["clock"])
    for i, s in enumerate(states):  # beyond the ticks and the sampled places, the number of values read does not matter
        key = (int(s[0]) % turn, np.asarray(s[1:], dtype=np.float64).tobytes(), 0 if varied == STRICT[method] else i)
        alike.setdefault(key, []).append(i)
    for same in alike.values():
        rows = np.arange(len(tails))
        for i in sorted(same, key=lambda i: -values[i]):
            n, kept = int(states[i][0]), np.tile(np.asarray(states[i][1:], dtype=np.float64), (len(rows), 1))
            first, any_alarm = _window_alarms(method, {**fixed, varied: values[i]}, n, kept, heads[rows], tails[rows])
            out[rows, i] = first
            rows = rows[any_alarm]
            if not len(rows):
                break
    return out


def first_alarms(
    method: str, fixed: Params, varied: str, values: Sequence[float], states: Sequence[State], heads: Sequence[Sequence[float]], tails: Sequence[Sequence[float]]
) -> np.ndarray:
    """First alarm (1-based, 0 where none) in each tail, from every candidate's state and read behind the window's head with resets: windows by candidates.

    A candidate is a value of the setting ``varied`` and a state, None or NaN where a missing value made it unknown; windows are short arrays, NaN where a value is missing.
    """
    out, shapes = np.zeros((len(tails), len(states)), np.int32), {}
    for i, (head, tail) in enumerate(zip(heads, tails)):
        shapes.setdefault((len(head), len(tail)), []).append(i)
    run = _grid_alarms if method in WINDOWED else _fold_alarms
    step = 1 << 10 if method in WINDOWED else max(1, ACROSS // max(1, len(states)))
    for (before, behind), at in shapes.items():
        for lo in range(0, len(at) if len(states) else 0, step):
            part = at[lo : lo + step]
            a, b = (np.array([rows[i] for i in part], dtype=np.float64).reshape(len(part), size) for rows, size in ((heads, before), (tails, behind)))
            out[part] = run(method, fixed, varied, values, states, a, b)
    return out


# ---------------------------------------------------------------- composition over blocks without an alarm


class Part(NamedTuple):
    """One part of a state: the element a block gives, given the parts before it at the block's start; how two elements in a row make one; and
    the state after an element."""

    element: Callable[[Params, np.ndarray, State], list[float]]
    compose: Callable[[Params, list[float], list[float]], list[float]]
    apply: Callable[[Params, State, list[float]], State]


def _summed(p: Params, e: list[float], f: list[float]) -> list[float]:
    return [e[0] + f[0], e[1] + f[1]]


def _mean_after(p: Params, s: State, e: list[float]) -> State:
    n = s[0] + e[0]
    return [n, (s[0] * s[1] + e[1]) / n, *s[2:]]


COUNTED = Part(lambda p, x, s: [float(len(x)), float(x.sum())], _summed, _mean_after)


def _quiet(method: str, p: Params, s: State, x: np.ndarray, **fresh: float) -> dict[str, float]:
    """Fields at the end of a block read without resets, from a state some of whose fields are given."""
    fields = dict(zip(FIELDS[method], s)) | fresh
    return dict(zip(FIELDS[method], (float(c[-1]) for c in _FOLDED[method](p, list(fields.values()), x)[1])))


def _ddm_best(p: Params, x: np.ndarray, s: State) -> list[float]:
    end = _quiet("ddm", p, s, x, best=INF, bp=INF, bs=0.0)
    return [end["best"], end["bp"], end["bs"]]


def _lower_late(p: Params, e: list[float], f: list[float]) -> list[float]:
    return f if f[0] <= e[0] else e


def _eddm_gaps(p: Params, x: np.ndarray, s: State) -> list[float]:
    hits = np.flatnonzero(x == 1) + 1.0
    if not len(hits):
        return [float(len(x)), 0.0, 0.0, 0.0, 0.0]
    return [float(len(x)), float(len(hits)), hits[0], hits[-1], float((np.diff(hits) ** 2).sum())]


def _gaps_joined(p: Params, e: list[float], f: list[float]) -> list[float]:
    if not f[1]:
        return [e[0] + f[0], *e[1:]]
    if not e[1]:
        return [e[0] + f[0], f[1], e[0] + f[2], e[0] + f[3], f[4]]
    return [e[0] + f[0], e[1] + f[1], e[2], e[0] + f[3], e[4] + f[4] + (e[0] + f[2] - e[3]) ** 2]


def _gaps_after(p: Params, s: State, e: list[float]) -> State:
    n, k, last, mean, m2, top = s
    if not e[1]:
        return [n + e[0], k, last, mean, m2, top]
    squares = m2 + k * mean * mean + (n + e[2] - last) ** 2 + e[4]
    new_k, new_last = k + e[1], n + e[3]
    return [n + e[0], new_k, new_last, new_last / new_k, max(squares - new_last * new_last / new_k, 0.0), top]


def _decay_element(p: Params, x: np.ndarray, s: State) -> list[float]:
    keep = 1 - p["lam"]
    return [float(len(x)), keep ** len(x), float(decayed(p["lam"] * x, keep)[-1]), float(x[0])]


def _decay_joined(p: Params, e: list[float], f: list[float]) -> list[float]:
    return [e[0] + f[0], e[1] * f[1], f[1] * e[2] + f[2], e[3]]


def _level_after(p: Params, s: State, e: list[float]) -> State:
    n = s[0] + e[0]
    return [n, e[1] * (e[3] if s[0] == 0 else s[1]) + e[2], float(_spread_at(p["lam"], np.array([n]))[0]), *s[3:]]


def _hddm_cut(p: Params, x: np.ndarray, s: State) -> list[float]:
    end = _quiet("hddm_w", p, s, x, cut=INF)
    return [end["cut"], end["a"], end["ai"]]


def _lower_first(p: Params, e: list[float], f: list[float]) -> list[float]:
    return f if f[0] < e[0] else e


def _hddm_newer(p: Params, x: np.ndarray, s: State) -> list[float]:
    """[1, b, bn] where the block holds a new cut, else [0, *decay element]."""
    end = _quiet("hddm_w", p, s, x)
    return [1.0, end["b"], end["bn"], 0.0, 0.0] if end["cut"] < s[3] else [0.0, *_decay_element(p, x, s)]


def _newer_moved(b: float, bn: float, f: list[float]) -> tuple[float, float]:
    return f[2] * (f[4] if bn == 0 else b) + f[3], bn + f[1]


def _newer_joined(p: Params, e: list[float], f: list[float]) -> list[float]:
    if f[0]:
        return f
    if e[0]:
        return [1.0, *_newer_moved(e[1], e[2], f), 0.0, 0.0]
    return [0.0, *_decay_joined(p, e[1:], f[1:])]


def _newer_after(p: Params, s: State, e: list[float]) -> State:
    b, bn = (e[1], e[2]) if e[0] else _newer_moved(s[6], s[8], e)
    return [*s[:6], b, float(_spread_at(p["lam"], np.array([bn]))[0]), bn]


def _ph_decay(p: Params, x: np.ndarray, s: State) -> list[float]:
    end = _quiet("page_hinkley", p, s, x, up=0.0, down=0.0)
    return [p["alpha"] ** len(x), end["up"], end["down"]]


def _ph_extremes(p: Params, x: np.ndarray, s: State) -> list[float]:
    end = _quiet("page_hinkley", p, s, x, lo=INF, hi=-INF)
    return [end["lo"], end["hi"]]


def _window_part(method: str) -> Part:
    def last(p: Params, values: list[float]) -> list[float]:
        return values[max(0, len(values) - window_size(method, p)) :]

    def joined(p: Params, e: list[float], f: list[float]) -> list[float]:
        return [e[0] + f[0], *last(p, e[1:] + f[1:])]

    return Part(lambda p, x, s: [float(len(x)), *last(p, x.tolist())], joined, joined)


PARTS: dict[str, list[Part]] = {
    "ddm": [COUNTED, Part(_ddm_best, _lower_late, lambda p, s, e: [*s[:2], *_lower_late(p, s[2:], e)])],
    "eddm": [
        Part(_eddm_gaps, _gaps_joined, _gaps_after),
        Part(lambda p, x, s: [_quiet("eddm", p, s, x, top=-1.0)["top"]], lambda p, e, f: [max(e[0], f[0])], lambda p, s, e: [*s[:5], max(s[5], e[0])]),
    ],
    "hddm_w": [
        Part(_decay_element, _decay_joined, _level_after),
        Part(_hddm_cut, _lower_first, lambda p, s, e: [*s[:3], *_lower_first(p, s[3:6], e), *s[6:]]),
        Part(_hddm_newer, _newer_joined, _newer_after),
    ],
    "page_hinkley": [
        COUNTED,
        Part(_ph_decay, lambda p, e, f: [e[0] * f[0], f[0] * e[1] + f[1], f[0] * e[2] + f[2]],
             lambda p, s, e: [*s[:2], e[0] * s[2] + e[1], e[0] * s[3] + e[2], *s[4:]]),
        Part(_ph_extremes, lambda p, e, f: [min(e[0], f[0]), max(e[1], f[1])], lambda p, s, e: [*s[:4], min(s[4], e[0]), max(s[5], e[1])]),
    ],
    **{m: [_window_part(m)] for m in WINDOWED},
}
