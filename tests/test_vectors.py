import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators.retrieval import nearest_vectors
from quern.operators.vectors import VectorIndex

SCHEMA = "vec_id long, tenant_id string, embedding array<float>"


@pytest.fixture(scope="module")
def rows(spark):
    """Clusters, ties, and vectors without a direction."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16))
    made = [(k, f"T{k % 2}", (centres[k % 20] + rng.normal(scale=0.1, size=16)).tolist()) for k in range(1200)]
    made += [(2000 + k, "T0", made[7][2]) for k in range(8)] + [(3000, "T0", [0.0] * 16), (3001, "T1", None), (3002, "T1", [float("inf")] + [1.0] * 15), (3003, "T2", made[3][2])]
    return spark.createDataFrame(made, SCHEMA).cache()


@pytest.mark.parametrize("cells,probes,k", [(20, 1, 5), (2, 4, 5), (40, 2, 30)])
def test_cells_find_what_a_comparison_with_all_finds(rows, cells, probes, k):
    asked = rows.where("vec_id % 20 = 0 or vec_id >= 2000").select(F.col("vec_id").alias("query_id"), "tenant_id", F.col("embedding").alias("q"))
    found = lambda df: sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in df.collect())
    real = rows.where("vec_id <> 3002")
    assert found(VectorIndex(rows, cells).nearest(asked, k, probes)) == found(nearest_vectors(asked.where("query_id <> 3002"), real, k))


def test_most_cells_are_ruled_out(rows):
    asked = rows.where("vec_id % 20 = 0 and vec_id < 1200").select(F.col("vec_id").alias("query_id"), "tenant_id", F.col("embedding").alias("q"))
    share = VectorIndex(rows, 20).visited(asked, 5, 1).first()
    assert share.visited < 0.2 * share.pairs


def test_an_index_of_nothing(rows):
    index = VectorIndex(rows.limit(0))
    assert index.nearest(rows.limit(0).select(F.col("vec_id").alias("query_id"), "tenant_id", F.col("embedding").alias("q"))).count() == 0


def test_vectors_of_length_one(spark):
    rows = spark.createDataFrame([(k, "T", [float(k - 3)]) for k in range(7)], SCHEMA)
    asked = rows.select(F.col("vec_id").alias("query_id"), "tenant_id", F.col("embedding").alias("q"))
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in VectorIndex(rows, 2).nearest(asked, 2).collect()}
    assert found[0, 1] == (1, 1.0) and found[6, 2] == (5, 1.0) and not any(q == 3 for q, _ in found)
