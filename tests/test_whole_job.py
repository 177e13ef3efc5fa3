"""Operators that must take whole tables: any number of queries, all benchmark items."""

import os

import numpy as np
import pytest

import __spark_entry__ as contract
from tessera.operators import retrieval

FOLDER = "/root/testdata/sf0.001"


def test_dense_takes_any_number_of_queries(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 4)
    points = np.random.default_rng(2).standard_normal((30, 6))
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, embedding array<double>")
    got = {(r.q, r.rank): r.id for r in retrieval.dense(rows, rows.withColumnRenamed("id", "q"), "id", "q", 3).collect()}
    order = np.argsort(-(points @ points.T), axis=1)
    assert got == {(q, k + 1): order[q, k] for q in range(30) for k in range(3)}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_whole_vs_chunk_asks_all_items(spark):
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet").count()
    assert items > 20 and {r.cases for r in contract.queries()["whole_vs_chunk"](spark, FOLDER).collect()} == {items}
