"""Readers and writers on real files."""

import json

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import answers as fn
from tidegauge.operators import predictions as pr
from tidegauge.operators import vectors as vec
from tidegauge.sources import readers, sinks


def test_samples_and_jsonl(spark, tmp_path):
    (tmp_path / "data.json").write_text(json.dumps([
        {"uid": "a", "task_id": 1, "question": "", "prompts": ["Q?"], "image_path": "x.png", "options": {"A": "1"}},
        {"uid": "b", "task_id": 2, "pre_image_path": "p.png", "post_image_path": "q.png", "image_path": ""},
        {"uid": "c", "task_id": 3, "image_path": ""},
    ]))
    got = {r["uid"]: r for r in readers.read_samples(spark, str(tmp_path / "data.json")).collect()}
    assert set(got) == {"a", "b"} and got["a"]["question"] == "Q?" and got["b"]["image_paths"] == ["p.png", "q.png"]
    (tmp_path / "x.jsonl").write_text('﻿{"uid": "a", "loss": 1.5}\n\n# note\n{broken\n{"uid": "b", "loss": 2}\n')
    good, bad = readers.read_jsonl(spark, str(tmp_path / "x.jsonl"), "uid string, loss double")
    assert sorted((r["uid"], r["loss"]) for r in good.collect()) == [("a", 1.5), ("b", 2.0)]
    assert [r["text"] for r in bad.collect()] == ["{broken"]


def test_results_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, 2), ("b", 2.5, 3)], "k string, v double, n int")
    for fmt in ("parquet", "json", "csv"):
        sinks.write_results(df, str(tmp_path / fmt), fmt)
    assert readers.read_csv(spark, str(tmp_path / "csv"), "k string, v double, n int").count() == 2
    assert sorted(spark.read.json(str(tmp_path / "json")).columns) == ["k", "n", "v"]


def test_models_round_trip(spark, tmp_path):
    df = spark.createDataFrame([([float(i % 5), float(i % 3), float(i)],) for i in range(30)], "x array<double>")
    model = vec.fit_pca(df, "x", 3, 2)
    sinks.write_models(spark, {"s": model}, spark.createDataFrame([("s", 1.5)], "stream string, threshold double"), str(tmp_path / "m"))
    back = sinks.read_models(spark, str(tmp_path / "m"))["s"]
    assert (back.components == model.components).all() and (back.mean == model.mean).all() and back.rows == 30


def test_strict_join_reports(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "uid int, gt string")
    with pytest.raises(pr.AlignmentError, match="no data row"):
        pr.aligned(a, spark.createDataFrame([(3, "x")], "uid int, gt string"), "uid")
    with pytest.raises(pr.AlignmentError, match="different answers"):
        pr.aligned(a, spark.createDataFrame([(1, "z")], "uid int, gt string"), "uid", "gt")


CASES = [
    ("Yes, it is", "Yes"), ("well no", "No"), ("TRUE", "Yes"), ("nothing", "No"), ("yesterday", "Yes"), ("maybe", ""), (None, ""), ("é y é", "Yes"),
]


def test_yes_no_cases(spark):
    df = spark.createDataFrame([(t,) for t, _ in CASES], "t string")
    assert [r[0] for r in df.select(fn.yes_no(F.col("t"))).collect()] == [w for _, w in CASES]


def test_option_parsing(spark):
    df = spark.createDataFrame([("Answer: b",), ("it is (C)",), ("bad",), ("zzz",)], "t string")
    assert [r[0] for r in df.select(fn.option_letter(F.col("t"), "ABCD")).collect()] == ["B", "C", "B", ""]
    o = spark.createDataFrame([("A. red B) blue A: green C:",), ("none",)], "t string").select(fn.parse_options(F.col("t")).alias("o")).collect()
    assert o[0]["o"] == {"A": "green", "B": "blue"} and o[1]["o"] is None


def test_durations_and_scores(spark):
    row = spark.range(1).select(
        fn.duration_seconds(F.lit("1h 2.5m, 3s")).alias("d"),
        fn.option_nll(F.create_map(F.lit("A"), F.lit(-1.0), F.lit("B"), F.lit(-2.0)), F.lit(" a")).alias("nll"),
        fn.option_nll(F.create_map(F.lit("A"), F.lit(-1.0)), F.lit("z")).alias("none"),
        fn.parse_scores(F.lit('{"method":"logprob","scores":{"A":"NaN"}}')).alias("nan"),
    ).first()
    assert row["d"] == 3753.0 and row["nll"] == pytest.approx(0.3132616875) and row["none"] is None and row["nan"] is None


def test_all_bad_lines_keep_their_place(spark, tmp_path):
    lines = [f'{{"uid": "{i}", "loss": 1.5}}' if i % 3 else "{broken" for i in range(1, 601)]
    (tmp_path / "many").mkdir()
    (tmp_path / "many" / "a.jsonl").write_text("\n".join(lines))
    (tmp_path / "many" / "b.jsonl").write_text("# note\n\n{broken\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        good, bad = readers.read_jsonl(spark, str(tmp_path / "many"), "uid string, loss double")
        places = {(r["file"][-7], r["line"]) for r in bad.collect()}
        assert {(r["line"], r["uid"]) for r in good.collect()} == {(i, str(i)) for i in range(1, 601) if i % 3}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert places == {("a", i) for i in range(3, 601, 3)} | {("b", 3)}


def test_log_folders_are_put_in_place_by_the_tasks(spark, monkeypatch):
    from conftest import SF
    from pyspark.sql import DataFrameWriter

    from tidegauge.plans import answers

    given, option = {}, DataFrameWriter.option
    monkeypatch.setattr(DataFrameWriter, "option", lambda self, k, v: given.update({k: v}) or option(self, k, v))
    users = spark.read.parquet(f"{SF}/events.parquet").select("user_id").distinct().count()
    assert answers.metric_log_extract(spark, SF).count() == users
    assert given["mapreduce.fileoutputcommitter.algorithm.version"] == "2"
