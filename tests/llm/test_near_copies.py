import random

import numpy as np
import pyarrow as pa
import pytest

from tidegauge.llm import order_minhash as om
from tidegauge.llm import words
from tidegauge.llm.components import components


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            keep, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
            last = keep
    return row[-1]


def seq_of(text):
    return om.shingles(words.split(pa.array([text])).text(0))


def edited(rng, tokens, n):
    t = list(tokens)
    for _ in range(n):
        i = rng.randrange(len(t))
        kind = rng.random()
        if kind < 0.5:
            t[i] = f"new{rng.random()}"
        elif kind < 0.75:
            t.insert(i, f"ins{rng.random()}")
        else:
            del t[i]
    return t


def test_banded_alignment_is_exact_where_it_matters():
    rng = random.Random(3)
    for trial in range(60):
        base = [f"w{rng.randrange(40 if trial % 2 else 4000)}" for _ in range(rng.randrange(5, 160))]
        a, b = seq_of(" ".join(base)), seq_of(" ".join(edited(rng, base, rng.randrange(6)) or ["x"]))
        got, full = om.similarity(a, b), lcs(a.tolist(), b.tolist())
        exact = full / (len(a) + len(b) - full)
        assert got == pytest.approx(exact) if exact >= om.SIMILAR else got < om.SIMILAR


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    vocab = [f"v{i}" for i in range(3000)]
    passage = rng.choices(vocab, k=60)
    docs, n = {}, 0
    for g in range(60):
        base = rng.choices(vocab, k=rng.choice([6, 12, 40, 150, 400]))
        if g % 4 == 0:
            base = base[:40] + passage
        for c in range(rng.choice([1, 1, 2, 3, 90 if g == 5 else 4])):
            docs[n] = " ".join(edited(rng, base, 0 if c == 0 else max(0, len(base) // 60)))
            n += 1
    docs[n], docs[n + 1], docs[n + 2], docs[n + 3], docs[n + 4] = docs[0], docs[0].upper(), None, "", "a b"
    docs[n + 5], docs[n + 6] = "A  b", "!!! ..."
    return docs


def brute(docs):
    seqs = {i: seq_of(t or "") for i, t in docs.items()}
    root = {i: i for i in docs}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if len(seqs[i]) and len(seqs[j]) and om.similarity(seqs[i], seqs[j]) >= om.SIMILAR:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("chunk", [256, 3])
def test_classes_match_brute_force(spark, corpus, chunk):
    df = spark.createDataFrame([(i, t, "c") for i, t in corpus.items()], "doc_id long, text string, n string").repartition(5)
    got = {r["doc_id"]: r["class_id"] for r in om.near_classes(df, chunk=chunk).collect()}
    assert got == brute(corpus)


def test_repeats_nulls_and_empty_tables(spark):
    schema = "doc_id long, text string, keys int"
    rows = [(1, "one two three four five six", 0), (1, "one two three four five six", 0), (None, "one two three four five six", 0), (4, "one two three four five six", 0), (5, None, 0)]
    df = spark.createDataFrame(rows, schema)
    got = sorted((str(r["doc_id"]), str(r["class_id"]), r["copies"]) for r in om.near_classes(df).collect())
    assert got == [("1", "1", 2), ("4", "1", 2), ("5", "5", 1), ("None", "None", 1)]
    assert sorted(str(r["doc_id"]) for r in om.keep_first(df).collect()) == ["1", "1", "5", "None"]
    assert om.near_classes(df.limit(0)).count() == 0


def test_sketch_depends_on_order():
    a = np.arange(1, 400, dtype=np.uint64)
    assert len(set(om.sketch(a).tolist()) & set(om.sketch(a[::-1].copy()).tolist())) < 3
    assert (om.sketch(a) == om.sketch(a)).all()


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(30)] + [(500, x) for x in range(501, 560)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def top(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    assert got == {i: top(i) for a, b in edges if a != b for i in (a, b)}


def test_short_texts_lose_no_pair(spark):
    rng = random.Random(4)
    docs, n = {}, 0
    for size in [8, 9, 10, 12, 14, 16, 18, 24, 32, 33, 34, 38, 40, 41] * 8:
        base = [f"t{n}w{i}" for i in range(size)]
        docs[n] = " ".join(base)
        docs[n + 1] = " ".join([*base, "more"])  # 8 against 9 words, 9 against 10 and so on
        docs[n + 2] = " ".join(["w0", *base, *["z"] * rng.randrange(1 + size // 6)])
        n += 3
    want = brute(docs)
    assert want[1] == 0 and want[4] == 3  # 4 against 5 shingles, 5 against 6
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    for chunk in (256, 2):
        assert {r["doc_id"]: r["class_id"] for r in om.near_classes(df, chunk=chunk).collect()} == want


def ids_of(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_every_text_of_a_repeated_id_is_searched(spark):
    t = " ".join(f"w{i}" for i in range(60))
    near, changed, unlike = t + " x", t.replace("w0 ", "other "), "a b c d e f g h i j k l m n o"
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    linked = frame([(1, t), (2, near), (2, unlike), (3, unlike + " p q r s"), (4, "quite another text of a few words")])
    assert {r["doc_id"]: (r["class_id"], r["copies"]) for r in om.near_classes(linked).collect()} == {1: (1, 2), 2: (1, 2), 3: (3, 1), 4: (4, 1)}
    both = frame([(1, t), (2, near), (2, unlike), (3, unlike)])
    assert {r["doc_id"]: (r["class_id"], r["copies"]) for r in om.near_classes(both).collect()} == {1: (1, 3), 2: (1, 3), 3: (1, 3)}
    assert ids_of(om.keep_first(frame([(1, t), (2, changed), (2, unlike)]))) == [(1, t), (2, unlike)]  # only the copy goes
    assert ids_of(om.keep_first(frame([(2, near), (2, unlike), (2, t), (2, ""), (2, unlike)]))) in (
        [(2, ""), (2, unlike), (2, unlike), (2, x)] for x in (t, near))
    two = frame([(5, t), (5, unlike), (6, near), (6, unlike)])
    assert ids_of(om.keep_first(two)) == [(5, unlike), (5, t)]
