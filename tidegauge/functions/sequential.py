"""Settings of the sequential change detectors, and the four with a state of fixed size as native folds over bounded arrays.

``functions.blocks`` has all seven on whole blocks of values, for long streams and for live ones.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

Params = dict[str, float]

DEFAULTS: dict[str, Params] = {
    "ddm": {"warm": 30, "drift": 3.0},
    "eddm": {"warm": 30, "beta": 0.9},
    "hddm_w": {"conf": 0.001, "lam": 0.05},
    "page_hinkley": {"min_n": 30, "delta": 0.005, "threshold": 50.0, "alpha": 0.9999},
    "kswin": {"alpha": 0.005, "window": 100, "stat": 30, "clock": 5},
    "adwin": {"delta": 0.002, "clock": 16, "min_len": 10, "grace": 30, "max_window": 400, "step": 5, "two_sided": 1},
    "optwin": {
        "delta": 0.001, "rigor": 0.5, "max_window": 200, "min_len": 20, "clock": 5, "step": 5, "f_test": 1, "two_sided": 0,
    },
}

# Candidate settings tried during calibration (fixed values, least to most strict within a method).
GRIDS: dict[str, tuple[str, list[float]]] = {
    "ddm": ("drift", [1.5, 2.0, 2.5, 3.0, 3.5, 4.0]),
    "eddm": ("beta", [0.97, 0.95, 0.92, 0.9, 0.85, 0.8, 0.75]),
    "adwin": ("delta", [0.1, 0.05, 0.02, 0.01, 0.005, 0.002, 0.001]),
    "hddm_w": ("conf", [0.1, 0.05, 0.02, 0.01, 0.005, 0.001, 0.0005]),
    "page_hinkley": ("threshold", [2.0, 3.0, 4.0, 5.0, 7.5, 10.0, 15.0, 20.0, 30.0, 50.0]),
    "kswin": ("alpha", [0.1, 0.05, 0.02, 0.01, 0.005, 0.002, 0.001, 0.0005, 0.0001, 0.00001, 0.000001]),
    "optwin": ("delta", [0.1, 0.05, 0.02, 0.01, 0.005, 0.002, 0.001, 0.0005, 0.0001, 0.00001, 0.000001]),
}
GRID_BASE: dict[str, Params] = {"adwin": {"clock": 8}, "optwin": {"f_test": 0, "two_sided": 1}}

# ---------------------------------------------------------------- native folds
# Written as SQL lambda text: one parse instead of thousands of single expression calls.

INF = "double('infinity')"
Stages = list[dict[str, str]]


class Fold:
    """Start state and update stages of one detector. Stage expressions read fields as ``r.name``; the last sets alarm."""

    def __init__(self, init: dict[str, str], stages: Stages):
        self.init, self.stages = init, stages

    def start(self) -> str:
        return _struct(self.init)

    def step(self, state: str, x: str, then: str) -> str:
        """``then`` (text over r.alarm and ``self.kept()``) after reading ``x`` in ``state``."""
        fields = {**{k: f"{state}.{k}" for k in self.init}, "x": x}
        layers, known = [fields], list(fields)
        for stage in self.stages:
            known = list(dict.fromkeys([*known, *stage]))
            layers.append({k: stage.get(k, f"r.{k}") for k in known})
        text = then
        for layer in reversed(layers):
            text = f"get(transform(array({_struct(layer)}), r -> {text}), 0)"
        return text

    def kept(self) -> str:
        return _struct({k: f"r.{k}" for k in self.init})

    def kept_or_reset(self) -> str:
        return f"if(r.alarm, {self.start()}, {self.kept()})"


def _struct(fields: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def _ddm(p: dict[str, str]) -> Fold:
    init = {"n": "0", "mean": "0.0D", "best": INF, "bp": INF, "bs": "0.0D"}
    return Fold(init, [
        {"n": "r.n + 1", "mean": "r.mean + (r.x - r.mean) / (r.n + 1)"},
        {"sd": "sqrt(greatest(r.mean * (1 - r.mean) / r.n, 0.0D))"},
        {"better": f"r.n > {p['warm']} AND r.mean + r.sd <= r.best"},
        {
            "best": "if(r.better, r.mean + r.sd, r.best)",
            "bp": "if(r.better, r.mean, r.bp)",
            "bs": "if(r.better, r.sd, r.bs)",
        },
        {"alarm": f"r.n > {p['warm']} AND r.mean + r.sd > r.bp + {p['drift']} * r.bs"},
    ])


def _eddm(p: dict[str, str]) -> Fold:
    init = {"n": "0", "k": "0", "last": "0", "mean": "0.0D", "m2": "0.0D", "top": "-1.0D"}
    score = "r.mean + 2.0D * sqrt(greatest(r.m2 / greatest(r.k - 1, 1), 0.0D))"
    return Fold(init, [
        {"n": "r.n + 1", "hit": "r.x = 1"},
        {"k": "r.k + int(r.hit)", "d": "double(r.n - r.last)"},
        {"gap": "r.d - r.mean", "mean": "if(r.hit, r.mean + (r.d - r.mean) / r.k, r.mean)"},
        {"m2": "if(r.hit, r.m2 + r.gap * (r.d - r.mean), r.m2)", "last": "if(r.hit, r.n, r.last)"},
        {"score": f"if(r.hit AND r.n > {p['warm']} AND r.k >= 2, {score}, NULL)"},
        {
            "alarm": f"coalesce(r.score <= r.top AND r.k > {p['warm']} AND r.top > 0 AND r.score < {p['beta']} * r.top, false)",
            "top": "greatest(r.top, r.score)",
        },
    ])


def _hddm_w(p: dict[str, str]) -> Fold:
    lam, keep = p["lam"], f"(1 - {p['lam']})"

    def bound(ibc: str) -> str:
        return f"sqrt(greatest({ibc}, 0.0D) * ln(1.0D / {p['conf']}) / 2.0D)"

    init = {
        "n": "0", "t": "0.0D", "ti": "1.0D", "cut": INF, "a": "0.0D", "ai": "1.0D", "b": "0.0D", "bi": "1.0D", "bn": "0",
    }
    return Fold(init, [
        {
            "t": f"if(r.n = 0, r.x, {lam} * r.x + {keep} * r.t)",
            "ti": f"{lam} * {lam} + {keep} * {keep} * r.ti",
            "n": "r.n + 1",
        },
        {"level": f"r.t + {bound('r.ti')}"},
        {"here": "r.level < r.cut"},
        {
            "cut": "if(r.here, r.level, r.cut)",
            "a": "if(r.here, r.t, r.a)",
            "ai": "if(r.here, r.ti, r.ai)",
            "b": f"if(r.here, 0.0D, if(r.bn = 0, r.x, {lam} * r.x + {keep} * r.b))",
            "bi": f"if(r.here, 1.0D, {lam} * {lam} + {keep} * {keep} * r.bi)",
            "bn": "if(r.here, 0, r.bn + 1)",
        },
        {"alarm": f"r.bn > 0 AND r.b - r.a > {bound('r.ai + r.bi')}"},
    ])


def _page_hinkley(p: dict[str, str]) -> Fold:
    init = {"n": "0", "mean": "0.0D", "up": "0.0D", "down": "0.0D", "lo": INF, "hi": f"-{INF}"}
    limit, mode = p["threshold"], p.get("mode", "both")
    sides = {"up": f"r.up - r.lo > {limit}", "down": f"r.hi - r.down > {limit}"}  # which way a change counts
    return Fold(init, [
        {"n": "r.n + 1", "mean": "r.mean + (r.x - r.mean) / (r.n + 1)"},
        {
            "up": f"{p['alpha']} * r.up + (r.x - r.mean) - {p['delta']}",
            "down": f"{p['alpha']} * r.down + (r.x - r.mean) + {p['delta']}",
        },
        {"lo": "least(r.lo, r.up)", "hi": "greatest(r.hi, r.down)"},
        {"alarm": f"r.n >= {p['min_n']} AND ({' OR '.join(sides[m] for m in ('up', 'down') if mode in (m, 'both'))})"},
    ])


FOLDS: dict[str, Callable[[dict[str, str]], Fold]] = {
    "ddm": _ddm, "eddm": _eddm, "hddm_w": _hddm_w, "page_hinkley": _page_hinkley,
}


def settings(method: str, params: Params | None = None) -> Params:
    return {**DEFAULTS[method], **(params or {})}


def fold(method: str, params: dict[str, Any] | None = None) -> Fold:
    """Fold of a method; a parameter is a number or the name of a column, e.g. of a candidate table."""
    merged = {**DEFAULTS[method], **(params or {})}
    return FOLDS[method]({k: v if isinstance(v, str) else f"{float(v)!r}D" for k, v in merged.items()})


def warm_state(f: Fold, values: str) -> Column:
    """State after reading calibration values (SQL text of an array), reset after every alarm."""
    return F.expr(f"aggregate({values}, {f.start()}, (s, x) -> {f.step('s', 'x', f.kept_or_reset())})")


def alarm_trace(f: Fold, values: str, start: str | None = None) -> Column:
    """1-based positions of all alarms, reset after each."""
    begin = _struct({"s": start or f.start(), "i": "0", "at": "cast(array() as array<int>)"})
    after = _struct({"s": f.kept_or_reset(), "i": "a.i + 1", "at": "if(r.alarm, concat(a.at, array(a.i + 1)), a.at)"})
    return F.expr(f"aggregate({values}, {begin}, (a, x) -> {f.step('a.s', 'x', after)}, a -> a.at)")


def _first(f: Fold, values: str, start: str) -> str:
    begin = _struct({"s": start, "i": "0", "hit": "cast(NULL as int)"})
    after = _struct({"s": f.kept(), "i": "a.i + 1", "hit": "if(r.alarm, a.i + 1, NULL)"})
    return f"aggregate({values}, {begin}, (a, x) -> if(a.hit IS NOT NULL, a, {f.step('a.s', 'x', after)}), a -> a.hit)"


def first_detection(f: Fold, values: str, start: str) -> Column:
    """1-based position of the first alarm from a warmed state, NULL if none; later values are not read."""
    return F.expr(_first(f, values, start))


def onset_detection(f: Fold, clean: str, drift: str, start: str) -> Column:
    """Struct (prechange, delay): alarms in the clean prefix (with resets), then the first alarm in the suffix."""
    begin = _struct({"s": start, "alarms": "0"})
    after = _struct({"s": f.kept_or_reset(), "alarms": "a.alarms + int(r.alarm)"})
    prefix = f"aggregate({clean}, {begin}, (a, x) -> {f.step('a.s', 'x', after)})"
    both = _struct({"prechange": "pre.alarms", "delay": _first(f, drift, "pre.s")})
    return F.expr(f"get(transform(array({prefix}), pre -> {both}), 0)")
