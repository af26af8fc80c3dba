"""Every query with a SQL twin gives the twin's rows; the others give rows."""

import pytest
from check import compare
from conftest import SF

from tidegauge.plans import load_all
from tidegauge.plans.registry import QUERIES, TWINS

load_all()


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, duck, name):
    assert compare(QUERIES[name](spark, SF), duck, TWINS[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(TWINS)))
def test_rows(spark, name):
    assert len(QUERIES[name](spark, SF).take(1)) == 1


BUCKETED = [
    "running_var", "ddm", "eddm", "count_sliding", "ecdf", "format_ecdf", "latency_summary", "linear_quantile", "pareto", "stable_order",
    "chained_split", "join_nearest_rate", "topk_distance", "phased_accuracy", "budget_grid_choice", "nearest_rank_pct", "step_timeline",
]


@pytest.mark.parametrize("name", BUCKETED)
def test_twin_in_buckets(spark, duck, tiny_buckets, name):
    assert compare(QUERIES[name](spark, SF), duck, TWINS[name]) is None


def test_twins_belong_to_queries():
    assert set(TWINS) <= set(QUERIES)
