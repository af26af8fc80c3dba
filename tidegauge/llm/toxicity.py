"""Toxicity: a lexicon trie met by Levenshtein automata, scored in context windows.

The lexicon is learnt from labelled documents outside the held-out fold: words, and stems of words (any ending), whose log-odds
for toxic texts are high beyond doubt. The forms of a stem that the sample holds stand beside it, so that they can be misspelt. All words of a text run through one automaton, the product of the lexicon's trie with "at most d edits" (no edit for
stems and terms under five characters, one up to eight, two beyond), which is built state by state as words ask for it. A term's
misspellings count less where words that close also stand in clean texts. Each mention is weighed in its window: inside
quotation marks or after a word of reporting it counts a quarter, near other mentions it counts more. A logistic function of
the mentions' sum, largest weight and density, fitted on the same bounded sample, is the score.

Defined results: a null or empty text has no mention and gets the score of the intercept; equal texts get equal scores; every
row gets one result row; without training rows of both classes no word is toxic and every score is 0; other columns are not read.
"""

from __future__ import annotations

import functools
import math
import operator
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import words
from tidegauge.llm.order_minhash import shingles
from tidegauge.llm.samples import training_rows
from tidegauge.llm.tables import stored

PER_CLASS, LEXICON = 5000, 2000
STEMS = (4, 5, 6, 7)  # lengths of stems; a stem is written with a star
WINDOW = 8
QUOTED, CLOSE = 0.25, 0.25

_WORD = re.compile(r"\w+")
# Words that report what others say.
REPORTING = frozenset("said says say saying wrote writes quote quotes quoted quoting word words term terms called citing cited reported allegedly".split())
_OPEN, _SHUT = "“„«‹", "”»›"


def edits_for(term: str) -> int:
    return 0 if len(term) < 5 or term.endswith("*") else 1 if len(term) < 9 else 2


class Fuzzy:
    """Terms within their edit distance of a word, by a lazily determinised product of trie and Levenshtein automaton."""

    MEMO = 300_000  # memoised steps and words; beyond it the memory is emptied, results stay the same

    def __init__(self, terms: list[str]) -> None:
        self.terms = terms
        self.next: list[dict[str, int]] = [{}]
        self.end: list[int] = [-1]
        self.stem: list[int] = [-1]
        self.most = [0]  # edits that some term below the node allows
        for i, term in enumerate(terms):
            node = 0
            allow = edits_for(term)
            self.most[0] = max(self.most[0], allow)
            for c in term.rstrip("*"):
                node = self.next[node].setdefault(c, len(self.next))
                if node == len(self.next):
                    self.next.append({}), self.end.append(-1), self.stem.append(-1), self.most.append(0)
                self.most[node] = max(self.most[node], allow)
            (self.stem if term.endswith("*") else self.end)[node] = i
        self.clear()

    def clear(self) -> None:
        self.states: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.step: list[dict[str, int]] = []
        self.words: dict[str, tuple[int, int] | None] = {}
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """The state of a node set closed under missing letters; -1 for the empty one."""
        todo = list(nodes.items())
        while todo:
            node, e = todo.pop()
            if nodes[node] < e:
                continue
            for child in self.next[node].values():
                if e + 1 <= self.most[child] and nodes.get(child, 9) > e + 1:
                    nodes[child] = e + 1
                    todo.append((child, e + 1))
        if not nodes:
            return -1
        key = tuple(sorted(nodes.items()))
        at = self.states.get(key)
        if at is None:
            at = self.states[key] = len(self.sets)
            self.sets.append(key), self.step.append({})
        return at

    def _move(self, state: int, c: str) -> int:
        nodes: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.most[node] and nodes.get(node, 9) > e:
                nodes[node] = e

        for node, e in self.sets[state]:
            reach(node, 0 if self.stem[node] >= 0 and e == 0 else e + 1)  # a stem takes any ending
            for x, child in self.next[node].items():
                reach(child, e if x == c else e + 1)
        to = self._state(nodes)
        self.step[state][c] = to
        return to

    def find(self, word: str) -> tuple[int, int] | None:
        """(term number, edits) of the nearest term, the first of equals; None if there is none."""
        if word in self.words:
            return self.words[word]
        if len(self.words) > self.MEMO or len(self.sets) > self.MEMO // 10:
            self.clear()
        state = self.start
        for c in word:
            to = self.step[state].get(c)
            state = self._move(state, c) if to is None else to
            if state < 0:
                break
        best = None
        if state >= 0:
            for node, e in self.sets[state]:
                for term in (self.end[node], self.stem[node]):
                    if term >= 0 and e <= edits_for(self.terms[term]) and (best is None or (e, term) < (best[1], best[0])):
                        best = (term, e)
        self.words[word] = best
        return best


_READY: dict[tuple[str, ...], Fuzzy] = {}


def fuzzy(terms: tuple[str, ...]) -> Fuzzy:
    """One automaton per worker process."""
    if terms not in _READY:
        _READY.clear()
        _READY[terms] = Fuzzy(list(terms))
    return _READY[terms]


def quoted(text: str, begin: int) -> bool:
    """Whether a position is inside quotation marks that opened on its line."""
    line = text[text.rfind("\n", 0, begin) + 1 : begin]
    if line.count('"') % 2:
        return True
    return max((line.rfind(c) for c in _OPEN), default=-1) > max((line.rfind(c) for c in _SHUT), default=-1)


def mentions(text: str, auto: Fuzzy, exact: list[float], near: list[float]) -> tuple[list[float], int]:
    """Weights of the mentions in context, and the number of words."""
    low = text.lower()
    found = _WORD.findall(low)
    hits = {w: m for w in set(found) if (m := auto.find(w)) is not None}
    if not hits:
        return [], len(found)
    at = [i for i, w in enumerate(found) if w in hits]
    wanted = set(at)
    begins = {i: m.start() for i, m in enumerate(_WORD.finditer(low)) if i in wanted}
    out = []
    for k, i in enumerate(at):
        term, e = hits[found[i]]
        weight = near[term] if e else exact[term]
        if weight <= 0:
            continue
        reported = not REPORTING.isdisjoint(found[max(0, i - 4) : i])
        if reported or quoted(low, begins[i]):
            weight *= QUOTED
        close = sum(1 for j in (k - 2, k - 1, k + 1, k + 2) if 0 <= j < len(at) and abs(at[j] - i) <= WINDOW)
        out.append(weight * (1 + CLOSE * min(2, close)))
    return out, len(found)


def signals(weights: list[float], count: int) -> tuple[float, float, float]:
    total = sum(weights)
    return math.log1p(total), max(weights, default=0.0), math.log1p(100.0 * total / max(20, count))


def _signal_batches(terms: tuple[str, ...], exact: list[float], near: list[float], model: list[float] | None):
    """Scores with a model; the three signals and the label without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = fuzzy(terms)
        for batch in batches:
            made = [signals(*mentions(t.as_py() or "", auto, exact, near)) for t in batch["text"]]
            cols = np.array(made, float).reshape(-1, 3)
            if model is None:
                yield pa.RecordBatch.from_arrays([batch["y"], *[pa.array(cols[:, j]) for j in range(3)]], ["y", "a", "b", "c"])
            else:
                dot = model[3] + cols @ np.array(model[:3])
                p = 1 / (1 + np.exp(-np.clip(dot, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.where(np.isfinite(p), p, 0.0)), pa.array(cols[:, 0])], ["doc_id", "score", "strength"])

    return run


def _thin_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Three least shingle hashes per text: near copies share most of them."""
    for batch in batches:
        keys = [[], [], []]
        for lo, hi in words.slices(batch["text"]):
            w = words.split(batch["text"].slice(lo, hi - lo))
            for i in range(hi - lo):
                seq = shingles(w.text(i))
                for j in range(3):
                    keys[j].append(int(words.mix(seq, 40 + j).min().view(np.int64)) if len(seq) else None)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text"], batch["y"], *[pa.array(k, pa.int64()) for k in keys]], ["doc_id", "text", "y", "k0", "k1", "k2"])


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of either class with each word or stem, added up per batch."""
    for batch in batches:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for y, text in zip(batch["y"].to_pylist(), batch["text"]):
            own = set(_WORD.findall(text.as_py().lower()))
            seen[y].update(own)
            seen[y].update({w[:k] + "*" for w in own for k in STEMS if len(w) > k})
        all_words = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(all_words, pa.string()), *[pa.array([c[w] for w in all_words], pa.int64()) for c in seen]], ["word", "d0", "d1"])


def _near_batches(terms: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = fuzzy(terms)
        for batch in batches:
            got = [auto.find(w) for w in batch["word"].to_pylist()]
            keep = [i for i, m in enumerate(got) if m is not None and m[1] > 0]
            at = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([got[i][0] for i in keep], pa.int32()), batch["d0"].take(at), batch["d1"].take(at)], ["term", "d0", "d1"])

    return run


def fit(rows: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> list[float]:
    """Logistic regression by Newton steps, both classes weighing the same; coefficients, then the intercept."""
    x = np.column_stack([rows, np.ones(len(rows))])
    share = y.mean()
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / len(y)
    w = np.zeros(x.shape[1])
    keep = ridge * np.array([1.0] * (x.shape[1] - 1) + [0.0]) / 10
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + keep * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(keep) + 1e-9 * np.eye(len(w))
        move = np.linalg.solve(hess, grad)
        w -= move * min(1.0, 5.0 / (np.abs(move).max() + 1e-12))
    return w.tolist()


class Model:
    """Terms, weights of exact and near mentions, and the logistic coefficients."""

    def __init__(self, terms: tuple[str, ...], exact: list[float], near: list[float], logistic: list[float]) -> None:
        self.terms, self.exact, self.near, self.logistic = terms, exact, near, logistic


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """A model from labelled rows outside the held-out fold; near copies in the sample count once."""
    rows = training_rows(docs, labels, "toxic", (3, 1), 1, per_class)
    thin = rows.mapInArrow(_thin_batches, "doc_id bigint, text string, y int, k0 bigint, k1 bigint, k2 bigint").where("k0 IS NOT NULL")
    for k in ("k0", "k1", "k2"):
        thin = thin.groupBy(k).agg(F.min(F.struct("doc_id", "text", "y", "k0", "k1", "k2")).alias("r")).select("r.*")
    sample = stored(thin.select("doc_id", "text", "y"))
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return Model((), [], [], [0.0, 0.0, 0.0, -30.0])
    counted = sample.mapInArrow(_word_batches, "word string, d0 bigint, d1 bigint").groupBy("word").agg(F.sum("d0").alias("d0"), F.sum("d1").alias("d1"))
    counted = stored(counted)
    odds = F.log((F.col("d1") + 0.5) / (n1 + 1)) - F.log((F.col("d0") + 0.5) / (n0 + 1))
    doubt = F.sqrt(1 / (F.col("d1") + 0.5) + 1 / (F.col("d0") + 0.5))
    sure = odds - 2 * doubt  # of the many words, some stand in three toxic texts by chance: the lower bound decides
    least = max(3, math.ceil(0.002 * n1))
    chosen = counted.where((F.col("d1") >= F.when(F.col("word").endswith("*"), 2 * least).otherwise(least)) & (odds >= 2.0) & (sure >= 1.0))
    best = chosen.orderBy(F.desc(sure), "word").limit(LEXICON).select("word", odds.alias("odds"), "d1").collect()
    ranked = {r["word"]: (r["odds"], r["d1"]) for r in best}
    # a stem needs several words to show it, and then speaks for longer stems and words unless they say clearly more
    most: dict[str, int] = {}
    for w, (_, d1) in ranked.items():
        if not w.endswith("*"):
            for k in STEMS:
                most[w[:k] + "*"] = max(most.get(w[:k] + "*", 0), d1)
    ranked = {w: x for w, x in ranked.items() if not w.endswith("*") or x[1] >= 1.5 * most.get(w, 0)}
    ranked = {w: o for w, (o, _) in ranked.items()}
    terms = tuple(w for w, o in ranked.items() if all(ranked.get(w[:k] + "*", -9.0) < o - 0.5 for k in STEMS if k < len(w.rstrip("*"))))
    exact = [min(6.0, ranked[w]) for w in terms]
    # a stem takes no edit: its forms follow as terms with their own edits; an exact form still meets the stem, which comes first
    stems = {w[:-1]: e for w, e in zip(terms, exact) if w.endswith("*")}
    if stems:
        begins = [F.substring("word", 1, k).isin([x for x in stems if len(x) == k]) for k in sorted({len(x) for x in stems})]
        forms = counted.where(~F.col("word").endswith("*") & (odds >= 1.0) & functools.reduce(operator.or_, begins)).select("word").collect()
        more = sorted({r["word"] for r in forms} - set(terms))
        terms += tuple(more)
        exact += [next(stems[w[:k]] for k in STEMS if w[:k] in stems) for w in more]
    seen = counted.where(~F.col("word").endswith("*")).mapInArrow(_near_batches(terms), "term int, d0 bigint, d1 bigint").groupBy("term").agg(F.sum("d0").alias("d0"), F.sum("d1").alias("d1")).collect()
    near = [0.6 * e for e in exact]
    for r in seen:  # misspellings that the sample holds are judged by it
        own = math.log((r["d1"] + 0.5) / (n1 + 1)) - math.log((r["d0"] + 0.5) / (n0 + 1))
        near[r["term"]] = min(0.6 * exact[r["term"]], max(0.0, own)) if own > 1.0 else 0.0
    got = np.array([tuple(r) for r in sample.mapInArrow(_signal_batches(terms, exact, near, None), "y int, a double, b double, c double").collect()], float)
    return Model(terms, exact, near, fit(got[:, 1:], got[:, 0]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, strength) of every row; strength is the logarithm of the summed mentions."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(_signal_batches(model.terms, model.exact, model.near, model.logistic), "doc_id bigint, score double, strength double")


def drop_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """The documents below ``least``, with all their columns: the score is taken row by row beside them."""
    model = train(docs, labels)
    terms, exact, near, logistic = model.terms, model.exact, model.near, model.logistic

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = fuzzy(terms)
        for batch in batches:
            made = np.array([signals(*mentions(t.as_py() or "", auto, exact, near)) for t in batch["text"]], float).reshape(-1, 3)
            p = 1 / (1 + np.exp(-np.clip(logistic[3] + made @ np.array(logistic[:3]), -30, 30)))
            yield batch.filter(pa.array(p < least))

    return docs.mapInArrow(keep, docs.schema)
