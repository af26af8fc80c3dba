"""Live operators over several micro-batches equal the batch forms."""

import pandas as pd
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tidegauge.functions import blocks as bl
from tidegauge.functions import sequential as seq
from tidegauge.operators import vectors as vec
from tidegauge.streaming import live


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """State is kept by partition; small tables need few."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def split_files(spark, tmp_path, parts=4):
    """The events in event order as several files with rising modification times."""
    import os

    ev = pd.read_parquet(f"{SF}/events.parquet").sort_values(["ts", "event_id"])
    folder = tmp_path / "in"
    folder.mkdir()
    step = len(ev) // parts + 1
    for i in range(parts):
        path = folder / f"events.parquet.{i}"
        ev.iloc[i * step:(i + 1) * step].to_parquet(path, coerce_timestamps="us")
        os.utime(path, (1_700_000_000 + i * 10, 1_700_000_000 + i * 10))
    return ev, str(folder)


def one_file_stream(spark, folder):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


METHODS = [
    ("ddm", {"warm": 8, "drift": 1.0}), ("eddm", {"warm": 4, "beta": 0.95}), ("hddm_w", {"conf": 0.3}), ("page_hinkley", {"threshold": 2.0, "min_n": 10}),
    ("adwin", {"delta": 0.9, "clock": 2, "min_len": 5, "grace": 10}), ("kswin", {"alpha": 0.3, "window": 24, "stat": 8, "clock": 1}),
    ("optwin", {"delta": 0.9, "min_len": 5, "clock": 1, "step": 1, "max_window": 100, "f_test": 0, "two_sided": 1}),
]


def traces(ev, method, params):
    p = seq.settings(method, params)
    return {(u, a) for u, g in ev.groupby("user_id") for a in bl.trace(method, p, signal_of(g, method))[0]}


def signal_of(g, method):
    return g["value"].astype(float) if method in ("kswin", "optwin", "page_hinkley") else (g["event_type"] == "error").astype(float)


def signal(method):
    return F.col("value") if method in ("kswin", "optwin", "page_hinkley") else (F.col("event_type") == "error").cast("double")


@pytest.mark.parametrize("method,params", METHODS)
def test_seven_detectors_over_batches(spark, tmp_path, method, params):
    ev, folder = split_files(spark, tmp_path, 2)
    out = live.detector_alarms(one_file_stream(spark, folder), "user_id", ["ts", "event_id"], signal(method), method, params)
    got, _ = live.run_to_table(out, spark, str(tmp_path / method))
    rows = got.collect()
    want = traces(ev, method, params)
    assert {(r["user_id"], r["at"]) for r in rows} == want and len(rows) == len(want) and want
    assert all(r["late"] == 0 for r in rows)


def test_window_scores_over_batches(spark, tmp_path):
    import numpy as np

    ev, folder = split_files(spark, tmp_path)
    vecs = F.array(F.col("value"), F.col("event_id") % 7, F.col("event_id") % 11).cast("array<double>")
    batch = spark.read.parquet(folder).withColumn("x", vecs)
    model = vec.fit_pca(batch, "x", 3, 3)
    out = live.window_scores(one_file_stream(spark, folder).withColumn("x", vecs), "user_id", "event_id", "x", model, 1e-6, 20, 5)
    got, _ = live.run_to_table(out, spark, str(tmp_path / "w"))
    table = {(r["user_id"], r["endpoint"]): r["score"] for r in got.collect()}
    x = ev.assign(a=ev["event_id"] % 7, b=ev["event_id"] % 11)
    count = 0
    for u, g in x.groupby("user_id"):
        m = g[["value", "a", "b"]].to_numpy(float)
        for e in range(20, len(m) + 1, 5):
            z = (m[e - 20:e].mean(0) - model.mean) @ model.components.T
            assert abs(table[(u, e)] - np.sqrt((z * z / (model.variances + 1e-6)).sum())) < 1e-9
            count += 1
    assert count == len(table) > 0


def test_resume_adds_nothing_twice(spark, tmp_path):
    ev, folder = split_files(spark, tmp_path)
    for _ in range(2):
        out, _ = live.run_to_table(live.unseen(one_file_stream(spark, folder), "event_id").select("event_id"), spark, str(tmp_path / "r"))
    assert out.count() == len(ev)


def shuffled_table(tmp_path, parts=5):
    """The events as a directory of part files whose arrival order is not the event order."""
    import os

    ev = pd.read_parquet(f"{SF}/events.parquet").sort_values(["ts", "event_id"])
    folder = tmp_path / "mixed" / "events.parquet"
    folder.mkdir(parents=True)
    step = len(ev) // parts + 1
    for arrival, i in enumerate([3, 0, 4, 1, 2]):
        path = folder / f"part-{arrival}.parquet"
        ev.iloc[i * step:(i + 1) * step].sample(frac=1, random_state=i).to_parquet(path, coerce_timestamps="us")
        os.utime(path, (1_700_000_000 + arrival * 10, 1_700_000_000 + arrival * 10))
    return ev, str(tmp_path / "mixed")


def test_directory_and_shuffled_files_lose_nothing(spark, tmp_path):
    ev, folder = shuffled_table(tmp_path)
    pieces = lambda: live.stream_parquet(spark, folder, "events", 1)  # noqa: E731  one file per micro-batch
    out, _ = live.run_to_table(live.unseen(pieces(), "event_id").select("event_id"), spark, str(tmp_path / "u"))
    assert sorted(r["event_id"] for r in out.collect()) == sorted(ev["event_id"])
    rates, _ = live.error_rate(pieces(), spark, "ts", F.col("event_type") == "error", "1 day", folder=str(tmp_path / "e"))
    assert rates.agg(F.sum("n"), F.sum("errors")).first() == (len(ev), int((ev["event_type"] == "error").sum()))
    p = {"warm": 8, "drift": 1.0}
    alarms = live.detector_alarms(live.stream_parquet(spark, folder, "events"), "user_id", ["ts", "event_id"], (F.col("event_type") == "error").cast("double"), "ddm", p)
    got, _ = live.run_to_table(alarms, spark, str(tmp_path / "d"))
    assert {(r["user_id"], r["at"]) for r in got.collect()} == traces(ev, "ddm", p) and got.where("late > 0").count() == 0
    late, _ = live.run_to_table(live.detector_alarms(pieces(), "user_id", ["ts", "event_id"], (F.col("event_type") == "error").cast("double"), "ddm", p), spark, str(tmp_path / "l"))
    assert late.where("late > 0").count() > 0


def test_late_rows_are_told_by_typed_order(spark, tmp_path):
    """At one timestamp, event 10 stands behind event 9 whatever their text."""
    import os

    folder = tmp_path / "in"
    folder.mkdir()
    for i, ids in enumerate(([8, 9], [10, 11], [7, 12])):
        pd.DataFrame({"user_id": 1, "ts": pd.Timestamp("2024-01-01"), "event_id": ids, "x": 1.0}).to_parquet(folder / f"{i}.parquet", coerce_timestamps="us")
        os.utime(folder / f"{i}.parquet", (1_700_000_000 + i * 10, 1_700_000_000 + i * 10))
    stream = spark.readStream.schema("user_id long, ts timestamp_ntz, event_id long, x double").option("maxFilesPerTrigger", 1).parquet(str(folder))
    out = live.detector_alarms(stream, "user_id", ["ts", "event_id"], F.col("x"), "page_hinkley", {"min_n": 1, "threshold": -1.0}, ttl=3_600_000)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # states that expire would keep a bounded run going
    try:
        got, _ = live.run_to_table(out, spark, str(tmp_path / "o"))
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert sorted((r["at"], r["alarm_no"], r["late"]) for r in got.collect()) == [(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 0), (5, 5, 1), (6, 6, 1)]


def test_replays_come_in_ordered_slices_read_by_many_tasks(spark, tmp_path):
    ev, folder = shuffled_table(tmp_path)
    rows = spark.read.parquet(f"{folder}/events.parquet")
    seen, files = [], []

    def build(stream):
        files.append(len(stream.sparkSession.read.parquet(str(tmp_path / "r" / "feed")).inputFiles()))
        return stream.select("ts", "event_id", "user_id")

    most = len(ev) // 3
    out, base = live.run_replay(rows, "user_id", ["ts", "event_id"], build, most, str(tmp_path / "r"))
    assert sorted(r["event_id"] for r in out.collect()) == sorted(ev["event_id"])
    slices = spark.read.parquet(f"{base}/slices").toPandas()
    bounds = slices.groupby("_slice").agg(lo=("ts", "min"), hi=("ts", "max"), n=("ts", "size")).sort_index()
    assert len(bounds) >= 3 and (bounds["lo"].to_numpy()[1:] >= bounds["hi"].to_numpy()[:-1]).all() and bounds["n"].max() < 2 * most
    assert files[0] > 1 and files == sorted(files)
    none, _ = live.run_replay(rows.limit(0), "user_id", ["ts", "event_id"], lambda s: s, None, str(tmp_path / "none"))
    assert none.count() == 0


def test_queries_replay_in_small_batches(spark, monkeypatch):
    from tidegauge.plans import live as plans

    whole = {q: sorted(map(tuple, getattr(plans, q)(spark, SF).collect())) for q in ("stream_detector", "stream_window_score", "stream_fused_alarm")}
    n = 170  # vectors and events of a slice
    sizes = []
    step = live.run_to_table

    def watched(stream, spark, folder=None):
        table, base = step(stream, spark, folder)
        sizes.append(sum(1 for _ in __import__("pathlib").Path(base.replace("file:", ""), "progress", "commits").glob("[0-9]*")))
        return table, base

    monkeypatch.setattr(live, "run_to_table", watched)
    spark.conf.set(live.BATCH_KEY, str(n))
    try:
        got = {q: sorted(map(tuple, getattr(plans, q)(spark, SF).collect())) for q in whole}
    finally:
        spark.conf.unset(live.BATCH_KEY)
    assert got == whole and max(sizes) >= 3


def test_slices_grow_with_the_number_of_keys(spark, tmp_path, monkeypatch):
    """Every slice costs a call for each key in it: with many keys of few rows, keys times slices stays in step with the rows."""
    rows = spark.range(400).select((F.col("id") % 50).alias("user_id"), F.col("id").alias("event_id"))
    monkeypatch.setattr(live, "BATCH_ROWS", 20)
    monkeypatch.setattr(live, "KEY_ROWS", 4)
    runs, run = [], live.run_to_table
    monkeypatch.setattr(live, "run_to_table", lambda *a: runs.append(1) or run(*a))
    out, _ = live.run_replay(rows, "user_id", ["event_id"], lambda s: s, None, str(tmp_path / "r"))
    assert out.count() == 400 and len(runs) == 2  # 200 rows each, not 20


def test_small_chunks_are_put_in_order_like_frames():
    d = live.DetectorState("ddm", seq.settings("ddm"), ["timestamp_ntz", "bigint"])
    ts = pd.to_datetime(["2024-01-02", "2024-01-01", "2024-01-01", None])
    for chunk in (pd.DataFrame({"p0": ts[:3], "p1": [5, 9, 7], "x": [1.0, 2.0, 3.0]}), pd.DataFrame({"p0": ts, "p1": [5, 9, 7, 1], "x": 0.0}),
                  pd.DataFrame({"p0": ts[:3], "p1": [5, None, 7], "x": 0.0})):
        got = d._in_order([chunk])
        assert got.equals(chunk.sort_values(["p0", "p1"]))
        for place in ([pd.Timestamp("2024-01-01").to_pydatetime(), 7], [pd.Timestamp("2024-01-01").to_pydatetime(), 8], [pd.Timestamp("2024-02-01").to_pydatetime(), None], [None, None]):
            assert d._first_late(got, place) == (d._late(got, tuple(place)) > 0)
