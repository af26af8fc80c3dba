"""Every registered operator query against its SQL twin, or its row count where SQL has none."""

import pytest

import corpus_pipeline
from check import compare
from tidegauge.llm import queries

SF = "/root/testdata/sf0.001"
ROWS = {"op2_toxicity": "documents", "op3_html_layout": "pages", "op8_order_minhash": "documents", "op10_quality_ftrl": "documents"}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    if name in queries.TWINS:
        assert compare(df, duck, queries.TWINS[name]) is None
    elif name in ROWS:
        assert df.count() == spark.read.parquet(f"{SF}/{ROWS[name]}.parquet").count()
    else:
        assert df.count() > 0


def test_thirteen_operators_and_the_pipeline():
    assert sorted(q.split("_")[0] for q in queries.QUERIES) == sorted([*(f"op{n}" for n in range(1, 14)), "pipeline"])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "decontamination", "secrets", "mixing"] and corpus_pipeline.ORACLE_SQL is None
