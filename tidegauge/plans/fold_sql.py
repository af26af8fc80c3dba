"""SQL text for sequential folds, used only for the SQL twins (recursive CTE, one step per position)."""

from __future__ import annotations


def fold_sql(
    init: dict[str, str], stages: list[dict[str, str]], reset: bool = True, name: str = "f", seq: str = "seq", start: str = ""
) -> str:
    """CTE ``name(k, pos, alarm, state...)`` over ``seq(k, pos, x)``; the last stage must define ``alarm``.

    ``start`` is a condition-free source of warmed state columns joined to every key.
    """
    cols = ", ".join(f"f.{c}" for c in init)
    body = f"SELECT f.k, s.pos, s.x, {cols} FROM {name} f JOIN {seq} s ON s.k = f.k AND s.pos = f.pos + 1"
    known = {"k", "pos", "x", *init}
    for stage in stages:
        over = [c for c in stage if c in known]
        star = f"* EXCLUDE ({', '.join(over)})" if over else "*"
        body = f"SELECT {star}, {', '.join(f'{e} AS {c}' for c, e in stage.items())} FROM ({body})"
        known |= set(stage)
    nxt = ", ".join(f"CASE WHEN alarm THEN {e} ELSE {c} END" if reset else c for c, e in init.items())
    first = ", ".join(c if start else f"{e} AS {c}" for c, e in init.items())
    keys = f"(SELECT DISTINCT k FROM {seq}) q"
    return (
        f"{name} AS (SELECT q.k, 0::BIGINT AS pos, false AS alarm, {first} FROM {keys}{' ' + start if start else ''} "
        f"UNION ALL SELECT k, pos, alarm, {nxt} FROM ({body}))"
    )


INF = "'infinity'::DOUBLE"


def ddm(warm: int, drift: str) -> tuple[dict[str, str], list[dict[str, str]]]:
    init = {"n": "0", "mean": "0.0::DOUBLE", "best": INF, "bp": INF, "bs": "0.0::DOUBLE"}
    stages = [
        {"n": "n + 1", "mean": "mean + (x - mean) / (n + 1)"},
        {"sd": "sqrt(greatest(mean * (1 - mean) / n, 0.0))"},
        {"better": f"n > {warm} AND mean + sd <= best"},
        {
            "best": "CASE WHEN better THEN mean + sd ELSE best END",
            "bp": "CASE WHEN better THEN mean ELSE bp END",
            "bs": "CASE WHEN better THEN sd ELSE bs END",
        },
        {"alarm": f"n > {warm} AND mean + sd > bp + {drift} * bs"},
    ]
    return init, stages


def hddm_w(conf: float, lam: float) -> tuple[dict[str, str], list[dict[str, str]]]:
    init = {
        "n": "0", "t": "0.0::DOUBLE", "ti": "1.0::DOUBLE", "cut": INF, "a": "0.0::DOUBLE", "ai": "1.0::DOUBLE",
        "b": "0.0::DOUBLE", "bi": "1.0::DOUBLE", "bn": "0",
    }
    keep = f"(1 - {lam}::DOUBLE)"
    scale = f"ln(1.0::DOUBLE / {conf}::DOUBLE) / 2.0"
    stages = [
        {
            "t": f"CASE WHEN n = 0 THEN x ELSE {lam}::DOUBLE * x + {keep} * t END",
            "ti": f"{lam}::DOUBLE * {lam}::DOUBLE + {keep} * {keep} * ti",
            "n": "n + 1",
        },
        {"lev": f"t + sqrt(ti * {scale})"},
        {"here": "lev < cut"},
        {
            "cut": "CASE WHEN here THEN lev ELSE cut END",
            "a": "CASE WHEN here THEN t ELSE a END",
            "ai": "CASE WHEN here THEN ti ELSE ai END",
            "b": f"CASE WHEN here THEN 0.0 WHEN bn = 0 THEN x ELSE {lam}::DOUBLE * x + {keep} * b END",
            "bi": f"CASE WHEN here THEN 1.0 ELSE {lam}::DOUBLE * {lam}::DOUBLE + {keep} * {keep} * bi END",
            "bn": "CASE WHEN here THEN 0 ELSE bn + 1 END",
        },
        {"alarm": f"bn > 0 AND b - a > sqrt((ai + bi) * {scale})"},
    ]
    return init, stages


def page_hinkley(threshold: str, min_n: int = 30, delta: float = 0.005, alpha: float = 0.9999, mode: str = "both"):
    sides = {"up": f"up - lo > {threshold}", "down": f"hi - down > {threshold}"}
    init = {
        "n": "0", "mean": "0.0::DOUBLE", "up": "0.0::DOUBLE", "down": "0.0::DOUBLE", "lo": INF,
        "hi": "'-infinity'::DOUBLE",
    }
    stages = [
        {"n": "n + 1", "mean": "mean + (x - mean) / (n + 1)"},
        {"up": f"{alpha}::DOUBLE * up + (x - mean) - {delta}::DOUBLE", "down": f"{alpha}::DOUBLE * down + (x - mean) + {delta}::DOUBLE"},
        {"lo": "least(lo, up)", "hi": "greatest(hi, down)"},
        {"alarm": f"n >= {min_n} AND ({' OR '.join(v for k, v in sides.items() if mode in (k, 'both'))})"},
    ]
    return init, stages


def eddm(warm: int, beta: str) -> tuple[dict[str, str], list[dict[str, str]]]:
    init = {"n": "0", "kk": "0", "last": "0", "mean": "0.0::DOUBLE", "m2": "0.0::DOUBLE", "top": "-1.0::DOUBLE"}
    stages = [
        {"n": "n + 1", "hit": "x = 1"},
        {"kk": "kk + CASE WHEN hit THEN 1 ELSE 0 END", "d": "(n - last)::DOUBLE"},
        {"gap": "d - mean", "mean": "CASE WHEN hit THEN mean + (d - mean) / kk ELSE mean END"},
        {"m2": "CASE WHEN hit THEN m2 + gap * (d - mean) ELSE m2 END", "last": "CASE WHEN hit THEN n ELSE last END"},
        {"score": f"CASE WHEN hit AND n > {warm} AND kk >= 2 THEN mean + 2.0 * sqrt(greatest(m2 / greatest(kk - 1, 1), 0.0)) END"},
        {
            "alarm": f"coalesce(score <= top AND kk > {warm} AND top > 0 AND score < {beta} * top, false)",
            "top": "CASE WHEN score > top THEN score ELSE top END",
        },
    ]
    return init, stages


def adwin(delta: float, clock: int, min_len: int, grace: int, max_window: int, step: int):
    init = {"n": "0", "w": "[]::DOUBLE[]"}
    log_term = f"ln(greatest(2.0 * ln(greatest(len(w), 2)::DOUBLE) / {delta}::DOUBLE, 1.0000001))"
    stages = [
        {"n": "n + 1", "w": f"(list_append(w, x))[-{max_window}:]"},
        {"due": f"len(w) >= {grace} AND n % {clock} = 0"},
        {"lt": f"CASE WHEN due THEN {log_term} END", "var": "CASE WHEN due THEN list_var_pop(w) END"},
        {
            "cuts": f"CASE WHEN due THEN [c FOR c IN range({min_len}, len(w) - {min_len} + 1, {step}) IF "
            "abs(list_avg(w[c+1:]) - list_avg(w[:c])) > sqrt(2.0 * var * (1.0/c + 1.0/(len(w)-c)) * lt) "
            "+ 2.0 * (1.0/c + 1.0/(len(w)-c)) * lt / 3.0] ELSE []::BIGINT[] END"
        },
        {"alarm": "len(cuts) > 0", "w": "CASE WHEN len(cuts) > 0 THEN w[cuts[1]+1:] ELSE w END"},
    ]
    return init, stages


def kswin(alpha: float, window: int, stat: int, clock: int, pvalues: list[float], mult: int):
    """``pvalues`` are the exact two-sided p-values for distances 1/stat, 2/stat, ..."""
    older = window - stat
    table = "[" + ", ".join(f"{v!r}::DOUBLE" for v in pvalues) + "]"
    below = "len([v FOR v IN {} IF v <= t])"
    init = {"n": "0", "w": "[]::DOUBLE[]"}
    stages = [
        {"n": "n + 1", "w": f"(list_append(w, x))[-{window}:]"},
        {"due": f"len(w) = {window} AND n % {clock} = 0"},
        {
            "old": f"CASE WHEN due THEN [w[({mult} * j + 11 * n) % {older} + 1] FOR j IN range({stat})] END",
            "new": f"CASE WHEN due THEN w[{older + 1}:{window}] END",
        },
        {"gap": f"CASE WHEN due THEN list_max([abs({below.format('old')} - {below.format('new')}) FOR t IN list_concat(old, new)]) END"},
        {"alarm": f"coalesce(due AND gap > 0 AND ({table})[gap] <= {alpha} AND gap / {float(stat)} > 0.1, false)"},
    ]
    return init, stages
