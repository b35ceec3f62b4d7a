"""Nearest means and neighbours by exact search."""

import numpy as np
import pytest

import __spark_entry__ as entry
from ledgerloom.operators import retrieval


def test_more_than_256_labels(spark, tmp_path):
    rng = np.random.default_rng(3)
    at = rng.normal(size=(300, 64)) * 10
    rows = [(i, at[i % 300].astype("float32").tolist(), i % 300) for i in range(600)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = entry.queries()["rt_centroids"](spark, str(tmp_path)).collect()
    assert sorted((r["vec_id"], r["cluster"]) for r in got) == [(i, i % 300) for i in range(600)]


def test_ties_and_repeated_rows(spark):
    means = spark.createDataFrame([(i, [float(i % 7), 0.0]) for i in range(40)], "label int, m array<double>")
    v = spark.createDataFrame([(1, [3.2, 0.0]), (1, [3.2, 0.0]), (2, [0.0, 1.0])], "vec_id int, embedding array<float>")
    got = retrieval.nearest_mean(v, means, "label", "m", block=4).collect()
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in got) == [(1, 3, pytest.approx(0.04)), (1, 3, pytest.approx(0.04)), (2, 0, 1.0)]


def test_redelivered_queries_and_zero_cosines(spark):
    rows = [(0, [1.0, 0.0])] * 5 + [(1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, [-1.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [])]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    queries = v.where("vec_id in (0, 4)").dropDuplicates(["vec_id"])
    got = retrieval.dense_top_k(v, queries, 3).collect()
    assert sorted((r["rank"], r["query_id"], r["vec_id"]) for r in got) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]
    assert [r["score"] for r in got if r["vec_id"] == 2] == [0.0]
