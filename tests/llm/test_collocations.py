"""Collocations against a plain count of every phrase, and their edge cases."""

import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from tidegauge.llm import collocation

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, order=3, least=10, share=50, top=2000):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII_LOWER)):
            said = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            totals[lang] += len(said)
            for m in range(1, order + 1):
                for i in range(len(said) - m + 1):
                    counts.setdefault(lang, Counter())[tuple(said[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        held = Counter()
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    held[p[i : i + m]] = max(held[p[i : i + m]], a)
        scored = []
        for p, a in found.items():
            if 100 * held[p] >= share * a:
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def got(spark, rows, **kw):
    docs = spark.createDataFrame([(lang, text, 1, "x") for lang, text in rows], "lang string, text string, n int, w1 string")
    return sorted(tuple(r) for r in collocation.collocations(docs, **kw).collect())


def test_brute_force(spark):
    rows = [("en", "New York is big, new york is New. a b a b a b; a b") for _ in range(7)] + [(None, "x y x y z " * 9), ("en", "so new york\tis\nnot old")] * 3
    rows += [("fr", None), ("fr", ""), ("de", "Ä ä Ä ä " * 30), ("de", "!!!"), ("", "p q " * 20)]
    for kw in ({}, {"order": 2, "least": 3}, {"order": 4, "least": 2, "share": 80, "top": 5}):
        assert got(spark, rows, **kw) == plain(rows, **kw)


def test_many_runs_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(collocation, "BUCKET_BYTES", 64)
    rows = [("en" if i % 5 else "de", " ".join(f"w{(i * i + 7 * j) % 9}" for j in range(40)) + ("." if i % 2 else "")) for i in range(60)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert sorted(tuple(r) for r in collocation.collocations(docs).collect()) == plain(rows)


def test_runs_within_one_text(monkeypatch):
    """Windows that reach over the end of a run are counted once, where they begin."""
    import pyarrow as pa

    monkeypatch.setattr(collocation, "RUN", 7)
    text = " ".join(f"w{(i * i) % 5}" for i in range(100)) + ". end of it"
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "en"]), pa.array([text, "W1 w0"])], ["lang", "text"])
    packed = pa.Table.from_batches(list(collocation._packer(3, 2)(iter([batch])))).sort_by("bucket")
    merged = pa.Table.from_batches(list(collocation._merger(3, 1)(iter(packed.to_batches()))))
    want = Counter()
    for piece in (text.split(". ")[0].split(), ["end", "of", "it"], ["w1", "w0"]):
        for i in range(len(piece)):
            want[tuple((*piece[i : i + 3], "", "")[:3])] += 1
    assert Counter({(r["w1"], r["w2"], r["w3"]): r["n"] for r in merged.to_pylist()}) == want


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text("abAB .,\t\nß\"", max_size=60), max_size=5))
def test_windows_of_any_text(texts):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["x"] * len(texts), pa.string()), pa.array(texts, pa.string())], ["lang", "text"])
    packed = list(collocation._packer(3, 1)(iter([batch])))
    merged = [r for b in collocation._merger(3, 1)(iter(packed)) for r in b.to_pylist()]
    words = sum(len(re.findall(r"[^\x20\x09]+", p)) for t in texts for p in re.split(r"[.,;:!?\x0A-\x0D]", t))
    assert sum(r["n"] for r in merged) == words


def test_empty_table(spark):
    assert got(spark, []) == [] and got(spark, [("en", None), (None, " , ")]) == []
