"""The fold detectors one value at a time, straight from their definitions: what folds, blocks and chains are compared with."""

import math

from tidegauge.functions import sequential as seq

INF = math.inf


def start(method):
    if method == "ddm":
        return {"n": 0, "mean": 0.0, "best": INF, "bp": INF, "bs": 0.0}
    if method == "eddm":
        return {"n": 0, "k": 0, "last": 0, "mean": 0.0, "m2": 0.0, "top": -1.0}
    if method == "hddm_w":
        return {"n": 0, "t": 0.0, "ti": 1.0, "cut": INF, "a": 0.0, "ai": 1.0, "b": 0.0, "bi": 1.0, "bn": 0}
    return {"n": 0, "mean": 0.0, "up": 0.0, "down": 0.0, "lo": INF, "hi": -INF}


def ddm(p, s, x):
    s["mean"] += (x - s["mean"]) / s["n"]
    sd = math.sqrt(max(s["mean"] * (1 - s["mean"]) / s["n"], 0.0))
    if s["n"] <= p["warm"]:
        return False
    if s["mean"] + sd <= s["best"]:
        s.update(best=s["mean"] + sd, bp=s["mean"], bs=sd)
    return s["mean"] + sd > s["bp"] + p["drift"] * s["bs"]


def eddm(p, s, x):
    if x != 1:
        return False
    s["k"] += 1
    d = float(s["n"] - s["last"])
    gap = d - s["mean"]
    s["mean"] += gap / s["k"]
    s["m2"] += gap * (d - s["mean"])
    s["last"] = s["n"]
    if s["n"] <= p["warm"] or s["k"] < 2:
        return False
    score = s["mean"] + 2.0 * math.sqrt(max(s["m2"] / (s["k"] - 1), 0.0))
    if score > s["top"]:
        s["top"] = score
        return False
    return s["k"] > p["warm"] and s["top"] > 0 and score < p["beta"] * s["top"]


def hddm_w(p, s, x):
    lam, keep = p["lam"], 1 - p["lam"]
    scale = math.log(1.0 / p["conf"]) / 2.0
    s["t"] = x if s["n"] == 1 else lam * x + keep * s["t"]
    s["ti"] = lam * lam + keep * keep * s["ti"]
    level = s["t"] + math.sqrt(s["ti"] * scale)
    if level < s["cut"]:
        s.update(cut=level, a=s["t"], ai=s["ti"], b=0.0, bi=1.0, bn=0)
        return False
    s["b"] = x if s["bn"] == 0 else lam * x + keep * s["b"]
    s["bi"] = lam * lam + keep * keep * s["bi"]
    s["bn"] += 1
    return s["b"] - s["a"] > math.sqrt((s["ai"] + s["bi"]) * scale)


def page_hinkley(p, s, x):
    s["mean"] += (x - s["mean"]) / s["n"]
    s["up"] = p["alpha"] * s["up"] + (x - s["mean"]) - p["delta"]
    s["down"] = p["alpha"] * s["down"] + (x - s["mean"]) + p["delta"]
    s["lo"], s["hi"] = min(s["lo"], s["up"]), max(s["hi"], s["down"])
    moved = {"up": s["up"] - s["lo"], "down": s["hi"] - s["down"]}
    return s["n"] >= p["min_n"] and any(d > p["threshold"] for m, d in moved.items() if p.get("mode", "both") in (m, "both"))


STEPS = {"ddm": ddm, "eddm": eddm, "hddm_w": hddm_w, "page_hinkley": page_hinkley}


def run(method, p, values, state=None, most=None):
    """(alarm positions, state at the end), reset after each alarm."""
    s, hits = dict(state or start(method)), []
    for i, x in enumerate(values, 1):
        s["n"] += 1
        if STEPS[method](p, s, float(x)):
            hits.append(i)
            s = start(method)
            if len(hits) == most:
                break
    return hits, s


def params(method, given=None):
    return seq.settings(method, given)
