"""Draws by keyed permutations: every place once, unrelated between windows, the same in SQL."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import sampling as smp
from tidegauge.plans.samples import draw_sql


def drawn(spark, n, windows, size=None):
    rows = spark.range(windows).select(F.col("id").alias("w"), F.explode(F.sequence(F.lit(0), F.lit((size or n) - 1))).alias("j"))
    out = rows.withColumn("i", smp.draw_index(F.col("w"), F.col("j"), n, 3, 1)).toPandas().sort_values(["w", "j"])
    return out["i"].to_numpy().reshape(windows, -1)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_every_place_comes_once(spark, n):
    for row in drawn(spark, n, 5):
        assert sorted(row) == list(range(n))


def test_a_pool_that_is_too_small_begins_again(spark):
    row = drawn(spark, 4, 1, 10)[0]
    assert sorted(row[:4]) == [0, 1, 2, 3] and list(row[4:8]) == list(row[:4])


def test_windows_are_unrelated(spark):
    n, rows = 997, drawn(spark, 997, 34, 80)
    for a, b in ((0, 16), (1, 17), (0, 32), (4, 5)):
        shifts = (rows[a] - rows[b]) % n
        assert np.unique(shifts).size > 60  # no window is a shift of another
    counts = np.bincount(rows.ravel(), minlength=n)
    assert counts.max() <= 12 and abs(np.corrcoef(rows[0], rows[16])[0, 1]) < 0.4


def test_large_pools_do_not_overflow(spark):
    n = 2**40 + 15
    rows = drawn(spark, n, 3, 200)
    assert rows.min() >= 0 and rows.max() < n and np.unique(rows).size == 600


@pytest.mark.parametrize("n", [1, 5, 997, 2**33])
def test_all_places_of_a_window_at_once(spark, n):
    sizes = spark.createDataFrame([(0, 0), (1, 30), (2, 7)], "w long, size int")
    got = sizes.select("w", smp.draw_all(smp.draw_turns(F.col("w"), 3, 1), F.col("size"), n).alias("at")).orderBy("w").collect()
    want = drawn(spark, n, 3, 30)
    assert [r["at"] for r in got] == [[], want[1].tolist(), want[2][:7].tolist()]


def test_sql_draws_the_same(spark, duck):
    for n in (5, 1000, 2**33):
        want = duck.execute(f"SELECT {draw_sql('w', 'j', str(n), 3, 1)} FROM range(4) a(w), range(30) b(j) ORDER BY w, j").fetchall()
        assert [x[0] for x in want] == drawn(spark, n, 4, 30).ravel().tolist()


def test_plans_are_never_broadcast(spark, capsys):
    pool = spark.range(1000).select(F.lit("clean").alias("source"), F.col("id").alias("pool_idx"), F.rand(1).alias("level"))
    plan = smp.window_plan(spark, 40, 20, [0.0, 0.5], 500, 500, 1)  # estimated as a few rows, but it grows with the data
    smp.materialize(plan, pool, ["ratio", "window_id"], ["level"]).explain()
    assert "Broadcast" not in capsys.readouterr().out
