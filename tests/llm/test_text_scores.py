import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tidegauge.llm import backoff, quality_ftrl, tiling, toxicity, words
from tidegauge.llm.tables import bucket_of

SF = "/root/testdata/sf0.01"


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_matches_plain_distances():
    rng = random.Random(5)
    terms = ["idiot", "worthless", "scum", "disgusting", "abcde", "abcdf", "stem*", "über"]
    auto = toxicity.Fuzzy(terms)
    seen = [*terms, "idiots", "idot", "iidoit", "worthles", "wothles", "stemming", "stem", "ste", "scun", "disgstin", ""]
    seen += ["".join(rng.choices("abcdefistuo", k=rng.randrange(1, 8))) for _ in range(2000)]
    for w in seen:
        want = None
        for i, t in enumerate(terms):
            e = (0 if w.startswith(t[:-1]) else 9) if t.endswith("*") else levenshtein(w, t)
            if e <= toxicity.edits_for(t) and (want is None or e < want[1]):
                want = (i, e)
        assert auto.find(w) == want, w
    auto.MEMO = 10
    assert [auto.find(w) for w in seen[:50]] == [toxicity.Fuzzy(terms).find(w) for w in seen[:50]]


def test_quotation_weighs_less_than_abuse():
    auto = toxicity.Fuzzy(["idiot"])
    weigh = lambda t: sum(toxicity.mentions(t, auto, [4.0], [2.0])[0])
    plain = weigh("you are an idiot and more words follow here")
    assert weigh('the reader wrote "you are an idiot" in a letter') < plain / 2
    assert weigh("they reported the term idiot in the minutes") < plain / 2
    assert weigh("you are an idiott and more words follow here") == pytest.approx(plain / 2)
    assert weigh("idiot idiot idiot") > 3 * plain
    assert weigh("") == 0


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark")}


def accuracy(tables, scores, label, modulus, remainder, least):
    rows = scores.join(tables["labels"], "doc_id").where(bucket_of("doc_id", modulus) == remainder).select("score", label).collect()
    return sum((r["score"] >= least) == bool(r[label]) for r in rows) / len(rows)


def odd_rows(spark):
    return spark.createDataFrame([(None, "x y", 1), (-1, None, 1), (-2, "", 1), (-2, "", 1), (-3, "word " * 200_000, 1)], "doc_id long, text string, score int")


def test_toxicity_held_out(spark, tables):
    model = toxicity.train(tables["documents"], tables["labels"])
    scores = toxicity.score(tables["documents"], model)
    assert scores.count() == tables["documents"].count()
    assert accuracy(tables, scores, "toxic", 3, 1, 0.7) >= 0.93  # of 113 labels four are of texts that lost their words
    odd = toxicity.score(odd_rows(spark), model).collect()
    assert len(odd) == 5 and all(0 <= r["score"] < 0.5 for r in odd)
    none = toxicity.train(tables["documents"].limit(0), tables["labels"])
    assert {r["score"] < 1e-9 for r in toxicity.score(odd_rows(spark), none).collect()} == {True}
    kept = toxicity.drop_toxic(tables["documents"], tables["labels"])
    assert kept.columns == tables["documents"].columns
    want = {r["doc_id"] for r in scores.where("score < 0.7").collect()}
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == want


def test_misspelt_forms_of_a_stem_are_found(spark):
    rng = random.Random(6)
    vocab = [f"{a}{b}{c}" for a in ("lor", "mip", "sud", "dal") for b in ("ema", "oru", "ipi") for c in ("te", "no", "ra", "sk")]
    rows = [(i, " ".join([*rng.choices(vocab, k=30), *([rng.choice(["idiots", "idiotic", "idiotism"])] if i % 2 else []), *rng.choices(vocab, k=9)])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int"))
    assert any(t.endswith("*") for t in model.terms)
    filler = " ".join(rng.choices(vocab, k=39))
    tried = ["idiots", "idiotry", "idyots", "iditic", "idiptism", "vdiotic", "idyot", "zebra"]
    got = {r["doc_id"]: r for r in toxicity.score(spark.createDataFrame([(i, f"{filler} {w}") for i, w in enumerate(tried)], "doc_id long, text string"), model).collect()}
    assert [got[i]["strength"] > 0 for i in range(len(tried))] == [True] * 6 + [False] * 2
    assert got[0]["strength"] == got[1]["strength"] > got[2]["strength"] and got[2]["score"] > got[7]["score"]


def test_quality_held_out(spark, tables):
    weights = quality_ftrl.train(tables["documents"], tables["labels"])
    scores = quality_ftrl.score(tables["documents"], weights)
    assert accuracy(tables, scores, "quality", 5, 0, 0.3) >= 0.95
    odd = quality_ftrl.score(odd_rows(spark), weights).collect()
    blank = 1 / (1 + math.exp(-float(np.float32(weights[-1]))))
    assert len(odd) == 5 and sum(abs(r["score"] - blank) < 1e-6 for r in odd) == 3
    none = quality_ftrl.train(tables["documents"].limit(0), tables["labels"])
    assert {round(r["score"], 9) for r in quality_ftrl.score(odd_rows(spark), none).collect()} == {0.5}


def test_ftrl_dot_products_match_the_vectors():
    text = "Some Words!! again again 12 | x"
    made = list(quality_ftrl.features(words.split(pa.array([text, ""]), marks=True, lower=False)))
    assert [int(b[1]) for _, b in made] == [8, 7, 6] and all(b[2] == b[1] for _, b in made)


def greedy(text, item, least=tiling.MATCH):
    """Greedy string tiling by plain comparison."""
    mt, mi, covered = [False] * len(text), [False] * len(item), 0
    while True:
        best, spots = least - 1, []
        for p in range(len(item)):
            for q in range(len(text)):
                n = 0
                while p + n < len(item) and q + n < len(text) and item[p + n] == text[q + n] and not mi[p + n] and not mt[q + n]:
                    n += 1
                if n > best:
                    best, spots = n, [(p, q)]
                elif n == best and n >= least:
                    spots.append((p, q))
        if not spots:
            return covered
        for p, q in spots:
            if not any(mi[p : p + best]) and not any(mt[q : q + best]):
                mi[p : p + best] = mt[q : q + best] = [True] * best
                covered += best


def test_tiles_match_plain_tiling():
    rng = random.Random(9)
    for _ in range(120):
        item = [rng.randrange(12) for _ in range(rng.randrange(5, 40))]
        parts = [item[i : i + 8] for i in range(0, len(item), 8)]
        rng.shuffle(parts)
        text = [x for p in parts for x in [*p, *[rng.randrange(100, 200) for _ in range(rng.randrange(4))]]] + item[3:11]
        got = tiling.tiles(np.array(text, np.uint64) + np.uint64(7), np.array(item, np.uint64) + np.uint64(7))
        assert sum(n for _, _, n in got) == greedy(text, item)
        assert all(text[q : q + n] == item[p : p + n] for q, p, n in got)


def test_contaminated_catches_reordered_passages(spark, tables):
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron"), (2, "one two three"), (3, None), (4, "red green blue white black grey pink brown gold silver")]
    bench = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, coverage string")
    texts = [
        (1, "x y " + items[0][1] + " z"), (2, "lamda mu nu xi omikron - zeta eta theta iota kappa; ALPHA beta gamma delta epsilon"), (3, "alpha beta gamma delta epsilon only"), (4, None), (5, ""),
        (6, "one two three"), (None, items[3][1]), (8, "fill " * 100_000 + items[3][1]), (8, "fill " * 10 + items[3][1]),
    ]
    docs = spark.createDataFrame([(*x, "z") for x in texts], "doc_id long, text string, item_id string")
    got = sorted((str(r["doc_id"]), r["item_id"], round(r["coverage"], 3)) for r in tiling.contaminated(docs, bench).collect())
    assert got == [("1", 1, 1.0), ("2", 1, 1.0), ("8", 4, 1.0), ("8", 4, 1.0), ("None", 4, 1.0)]
    assert sorted(map(str, tiling.contaminated(docs, bench, block_words=5).collect())) == sorted(map(str, tiling.contaminated(docs, bench).collect()))
    assert tiling.contaminated(docs, bench.limit(0)).count() == 0 and tiling.contaminated(docs.limit(0), bench).count() == 0
    kept = tiling.drop_contaminated(docs, bench)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "4", "5", "6", "None"] and kept.columns == docs.columns


def test_contaminated_brute_force(spark, tables):
    docs, bench = tables["documents"].where("doc_id < 150"), tables["benchmark"]
    got = {(r["doc_id"], r["item_id"]): r["coverage"] for r in tiling.contaminated(docs, bench).collect()}
    want = {}
    items = [(r["item_id"], words.split(pa.array([r["text"]])).text(0)) for r in bench.collect()]
    for r in docs.collect():
        own = words.split(pa.array([r["text"]])).text(0)
        for i, item in items:
            if len(set(words.grams(own, 5).tolist()) & set(words.grams(item, 5).tolist())) >= 4:
                share = sum(n for _, _, n in tiling.tiles(own, item)) / len(item)
                if share >= 0.5:
                    want[r["doc_id"], i] = share
    assert got == pytest.approx(want) and got


def test_backoff_brute_force(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randrange(1, 12))) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, None), (101, "!"), (102, "Q q Q zz"), (5, "a b"), (None, "a c")]
    got = {r["doc_id"]: r for r in backoff.score(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n int")).collect()}
    toks = [(i, (t or "").lower().replace("!", " ").split()) for i, t in rows]
    want = collections.defaultdict(lambda: [0, 0.0])
    for n, (i, ws) in enumerate(toks):
        pair, one, two = collections.Counter(), collections.Counter(), collections.Counter()
        total = 0
        for m, (_, other) in enumerate(toks):
            if m != n:
                pair.update(zip(["<s>", *other], other)), one.update((["<s>", *other])[: len(other)]), two.update(other)
                total += len(other)
        want[i][0] += len(ws)
        for u, w in zip(["<s>", *ws], ws):
            if pair[u, w]:
                want[i][1] += math.log(pair[u, w] / one[u])
            else:
                want[i][1] += math.log(0.4 * two[w] / total) if two[w] else math.log(0.16 / total)
    assert {k: (r["words"], round(r["log_score"], 6)) for k, r in got.items()} == {k: (a, round(b, 6)) for k, (a, b) in want.items()}
    assert got[100]["mean_log"] is None


def exchanged(df):
    """Bytes that the exchanges of a collected frame's plan have sent, before compression."""
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        elif name == "Exchange":
            total += node.metrics().apply("dataSize").value()
    return total


def test_backoff_sends_a_few_bytes_a_pair(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [rng.choices(vocabulary, k=300) for _ in range(1000)]
    pairs = sum(len(set(zip(["", *t], t))) for t in texts)
    df = backoff.score(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2))
    assert len(df.collect()) == len(texts)
    assert 0 < exchanged(df) < 16 * pairs


def test_backoff_chunks_and_partitions_do_not_change_scores(spark):
    rng = random.Random(3)
    rows = [(i % 40, " ".join(rng.choices("abcdefgh", k=rng.randrange(0, 12)))) for i in range(60)] + [(None, "a b"), (None, "a b"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [{r["doc_id"]: r for r in backoff.score(docs, *sizes).collect()} for sizes in ((), (16, 4, 1), (1, 1, 1))]
    assert {k: r["words"] for k, r in got[0].items()} == {k: sum(len((t or "").split()) for i, t in rows if i == k) for k, _ in rows}
    for other in got[1:]:
        assert {k: (r["words"], r["log_score"]) for k, r in other.items()} == {k: (r["words"], pytest.approx(r["log_score"])) for k, r in got[0].items()}


def test_backoff_of_no_rows(spark):
    assert backoff.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    one = backoff.score(spark.createDataFrame([(1, "a a")], "doc_id long, text string")).collect()
    assert [(r["words"], round(r["log_score"], 9)) for r in one] == [(2, round(2 * math.log(0.16), 9))]


def test_packed_numbers_come_back():
    for x in ([], [0], [1, 2**64 - 1, 2**40], range(1000)):
        x = np.array(x, np.uint64)
        assert (backoff._unpacked(backoff._packed(x), len(x)) == x).all()
    assert len(backoff._packed(np.ones(100_000, np.int64))) < 1000
