"""The stored vector index against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import ann, vector
from tests.unit.test_catalogue import plan

SF = "/root/testdata/sf0.01"


def test_recall_and_scores(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    odd = spark.createDataFrame([(-1, None), (-2, [0.0] * 64), (-3, [1.0, 2.0])], "vec_id long, embedding array<float>")
    index = ann.VectorIndex.build(rows.unionByName(odd), f"{tmp_path}/i", lists=16)
    assert index.rows().count() == rows.count()
    asked = rows.unionByName(odd).where(F.col("vec_id") % 50 == 0).unionByName(odd).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    found = index.search(asked, 10, probes=13, refine=300)
    exact = vector.knn_batch(rows, asked.where("query_id >= 0"), 10)
    told = ann.recall(found, exact).first()
    assert told.queries == 10 and told.recall >= 0.9
    scores = {(r.query_id, r.vec_id): r.score for r in vector.knn_batch(rows, asked.where("query_id >= 0"), 1000).collect()}
    got = found.collect()
    assert all(abs(scores[r.query_id, r.vec_id] - r.score) < 1e-9 for r in got) and {r["rank"] for r in got} == set(range(1, 11))
    # with all lists probed and enough refined it is exact
    whole = index.search(asked, 10, probes=16, refine=1000)
    assert ann.recall(whole, exact).first().recall == 1.0
    ann.QUERY_BLOCK, block = 3, ann.QUERY_BLOCK
    try:
        assert {tuple(r) for r in index.search(asked, 10, probes=13, refine=300).collect()} == {tuple(r) for r in got}
    finally:
        ann.QUERY_BLOCK = block
    text = plan(index.search(asked.limit(1), 5, probes=2))
    assert "dynamicpruning" in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_odd_tables(spark, tmp_path):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    index = ann.VectorIndex.build(none, f"{tmp_path}/e", lists=4)
    few = spark.createDataFrame([(1, [1.0] * 16)], "vec_id long, embedding array<float>")
    assert index.rows().count() == 0
    index = ann.VectorIndex.build(few, f"{tmp_path}/f", lists=4)
    assert [r.vec_id for r in index.search(few.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), 3).collect()] == [1]
    with pytest.raises(ValueError):
        ann.VectorIndex.build(few, f"{tmp_path}/g", parts=5)


def test_recall_holds_where_candidates_are_a_small_share(spark, tmp_path):
    x = np.random.default_rng(3).normal(size=(6000, 64))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    index = ann.VectorIndex.build(rows, f"{tmp_path}/i", lists=4)
    asked = rows.where("vec_id % 300 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    found = {(r.query_id, r.vec_id) for r in index.search(asked, 10, probes=4, refine=60).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    exact = {(q, int(i)) for q in range(0, 6000, 300) for i in np.argsort(-(unit @ unit[q]))[:10]}
    assert len(found & exact) >= 0.9 * len(exact)


def test_index_search_is_a_scan_without_shuffled_vectors(spark, tmp_path):
    """Shares and exact scores of many rows are products of matrices in the tasks that read them; only ids and numbers are shuffled."""
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    index = ann.VectorIndex.build(rows, f"{tmp_path}/i", lists=4)
    asked = rows.where("vec_id < 40").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    found = index.search(asked, 3, probes=4, refine=200)
    text = plan(found)
    assert "MapInArrow" in text and not any(x in text for x in ("zip_with", "transform(", "SortMergeJoin", "Inner"))
    exact = vector.knn_batch(rows, asked, 3)
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in exact.collect()}
