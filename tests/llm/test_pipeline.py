import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidegauge.llm import order_minhash, secret_ledger, tiling, toxicity, words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    """Documents with planted cases beside clean ones."""
    rng = random.Random(6)
    vocab = [f"word{i}" for i in range(2000)]
    item = " ".join(rng.choices(vocab, k=30))
    rows, labels = [], []

    def add(text, toxic=None):
        rows.append((len(rows), text, "en", f"s{len(rows) % 4}", len(text or "")))
        if toxic is not None:
            labels.append((rows[-1][0], 1, toxic))

    for i in range(240):
        text = " ".join(rng.choices(vocab, k=rng.randrange(20, 120)))
        if i % 3 == 0:
            add(text + " you idiot and moron " + rng.choice(vocab), 1)
        else:
            add(text, 0)
    clean = [r[1] for r in rows if "idiot" not in r[1]]
    add(clean[0]), add(clean[1] + " " + "tail"), add(item + " " + clean[2]), add(" ".join(item.split()[15:] + item.split()[:15])), add("my password=hunter2hunter2 " + clean[3] + " extra words here to differ a lot " * 9)
    add(None), add("")
    d = tmp_path_factory.mktemp("sf")
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    pq.write_table(pa.table({c: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate(zip(COLUMNS, kinds))}), d / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([x[0] for x in labels], pa.int64()), "quality": pa.array([x[1] for x in labels], pa.int32()), "toxic": pa.array([x[2] for x in labels], pa.int32())}), d / "labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1], pa.int64()), "text": pa.array([item])}), d / "benchmark.parquet")
    return str(d), rows, item


def test_stages_against_brute_force(spark, small):
    sf, rows, item = small
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    auto = toxicity.Fuzzy(list(model.terms))
    import math

    kept = {}
    for i, text, *_ in rows:
        x = toxicity.signals(*toxicity.mentions(text or "", auto, model.exact, model.near))
        if 1 / (1 + math.exp(-(model.logistic[3] + sum(a * b for a, b in zip(x, model.logistic))))) < 0.7:
            kept[i] = text
    assert all("idiot" not in (t or "") for t in kept.values()) and len(kept) == sum("idiot" not in (r[1] or "") for r in rows)
    seqs = {i: order_minhash.shingles(words.split(pa.array([t or ""])).text(0)) for i, t in kept.items()}
    unique = {}
    for i in sorted(kept):
        if not any(len(seqs[i]) and len(seqs[j]) and order_minhash.similarity(seqs[i], seqs[j]) >= 0.8 for j in unique):
            unique[i] = kept[i]
    own = words.split(pa.array([item])).text(0)
    free = {i: t for i, t in unique.items() if sum(n for _, _, n in tiling.tiles(words.split(pa.array([t or ""])).text(0), own)) < 0.5 * len(own)}
    assert len(kept) - len(unique) == 2 and len(unique) - len(free) == 2

    def clean(text):
        if text is None:
            return None
        cut = sorted(s for r in secret_ledger.RULES for s in secret_ledger.find(r, text))
        for s, e in reversed(cut):
            text = text[:s] + "[SECRET]" + text[e:]
        return text

    got = docs
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        got = stage(spark, got, sf)
        assert got.columns == COLUMNS, name
    got = {r["doc_id"]: r["text"] for r in got.collect()}
    assert got == {i: clean(t) for i, t in free.items()} and any("[SECRET]" in (t or "") for t in got.values())


def test_run_mixes_what_is_left(spark, small):
    sf, rows, _ = small
    out = corpus_pipeline.run(spark, sf)
    assert set(COLUMNS) < set(out.columns)
    sums = out.groupBy("source").agg(F.sum("taken").alias("taken"), F.min("target").alias("target")).collect()
    assert len(sums) == 4 and all(abs(r["taken"] - r["target"]) < 1 for r in sums)
    assert out.where("taken <= 0 OR text IS NULL").count() == 0


def test_empty_tables(spark, small, tmp_path):
    sf, _, _ = small
    for t in ("documents", "labels", "benchmark"):
        pq.write_table(pq.read_table(f"{sf}/{t}.parquet").slice(0, 0), tmp_path / f"{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
