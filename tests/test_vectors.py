"""TF-IDF and principal components against plain numpy."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from voxmill.operators import vectors

TEXTS = ["The cat, the dog", "a cat sat", "dog dog dog", "...", "ünï_1 x yz"]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "id long, content string")


def test_terms(spark):
    found = vectors.document_terms(docs(spark), "id").collect()
    assert {(r.doc_id, r.term, r.tf) for r in found} == {
        (0, "the", 2), (0, "cat", 1), (0, "dog", 1),
        (1, "cat", 1), (1, "sat", 1), (2, "dog", 3), (4, "ünï_1", 1), (4, "yz", 1),
    }


def test_vocabulary_is_cut_by_count_then_term(spark):
    terms = vectors.document_terms(docs(spark), "id")
    found = vectors.vocabulary(terms, 3).orderBy("term_id").collect()
    assert [(r.term, r["count"], r.docs) for r in found] == [("cat", 2, 2), ("dog", 4, 2), ("the", 2, 1)]


def test_weights_and_vectors_agree(spark):
    idf = {"cat": math.log(6 / 3) + 1, "dog": math.log(6 / 3) + 1, "the": math.log(6 / 2) + 1}
    raw = {"the": 2 * idf["the"], "cat": idf["cat"], "dog": idf["dog"]}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    found = vectors.vectorize(docs(spark), "id", width=3).orderBy("id")
    rows = [r.w for r in found.select(vector_to_array("vector").alias("w")).collect()]
    assert np.allclose(rows[0], [raw["cat"] / norm, raw["dog"] / norm, raw["the"] / norm])
    assert np.allclose(rows[2], [0, 1, 0])
    assert np.allclose(rows[3], 0)
    terms = vectors.document_terms(docs(spark), "id")
    weights = vectors.tfidf_weights(terms, vectors.vocabulary(terms, 3), F.lit(5))
    for r in weights.collect():
        assert math.isclose(rows[r.doc_id][r.term_id], r.weight)


def test_no_terms_at_all(spark):
    found = vectors.vectorize(docs(spark, ["!", "?"]), "id", width=4)
    assert [r.w for r in found.select(vector_to_array("vector").alias("w")).collect()] == [[0.0] * 4] * 2


def test_projection_keeps_the_distances_of_the_best_plane(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 6)) * [5, 3, 1, 0.5, 0.2, 0.0]
    table = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id long, a array<double>")
    rows = vectors.reduce_dimensions(vectors.with_vector(table, "a"), components=3).orderBy("id")
    found = np.array([r.point for r in rows.collect()])
    centred = x - x.mean(axis=0)
    _, _, axes = np.linalg.svd(centred)
    want = centred @ axes[:3].T

    def distances(p):
        return np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))

    assert found.shape == (40, 3)
    assert np.allclose(distances(found), distances(want))


def test_few_rows_are_not_projected(spark):
    table = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [2.0, 2.0, 3.0])], "id long, a array<double>")
    rows = vectors.reduce_dimensions(vectors.with_vector(table, "a")).orderBy("id").collect()
    assert [r.point for r in rows] == [[1.0, 2.0, 3.0], [2.0, 2.0, 3.0]]


def test_axes_of_sparse_and_dense_vectors_agree(spark):
    """Rows of no, few and all entries; stored zeros; the means taken off afterwards."""
    rng = np.random.default_rng(2)
    x = np.where(rng.random((80, 12)) < 0.3, rng.random((80, 12)), 0.0)
    x[:5] = 0.0
    x[5:10] = rng.random((5, 12)) + 0.1
    sparse = [Vectors.sparse(12, [(i, v) for i, v in enumerate(row) if v or i == 3]) for row in x.tolist()]
    dense = [Vectors.dense(row) for row in x.tolist()]
    mixed = [d if k % 3 else s for k, (s, d) in enumerate(zip(sparse, dense, strict=True))]
    _, want = np.linalg.eigh(np.cov(x.T))
    for rows in (sparse, dense, mixed):
        table = spark.createDataFrame([(v,) for v in rows], ["vector"]).repartition(3)
        axes = vectors.principal_axes(table, "vector", 4)
        assert np.allclose(np.abs((axes * want[:, ::-1][:, :4]).sum(axis=0)), 1.0)
    assert vectors.principal_axes(table.limit(0), "vector", 4) is None
    assert vectors.principal_axes(table.limit(2), "vector", 4) is None
