"""Checks of TF-IDF, principal components, centroids and the clustering fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.checks import view as v
from voxmill.checks.registry import check
from voxmill.operators import density, vectors
from voxmill.operators.spanning_tree import BLOCK_ROWS, spanning_tree
from voxmill.session import cut_lineage

DOC_TERMS = f"""
words AS (SELECT doc_id, unnest(regexp_extract_all(lower({v.strip_sql('text')}), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM documents),
terms AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
top AS (SELECT term, sum(tf)::BIGINT AS "count", count(*) AS docs FROM terms GROUP BY term
        ORDER BY "count" DESC, term LIMIT 1536),
vocab AS (SELECT *, (row_number() OVER (ORDER BY term) - 1)::INT AS term_id FROM top)"""


def _terms(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.document_terms(v.texts(spark, sf), "doc_id", "text")


@check("tfidf_vocab", f'WITH {DOC_TERMS} SELECT term, term_id, "count", docs FROM vocab')
def tfidf_vocab(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.vocabulary(_terms(spark, sf))


@check(
    "tfidf_weights",
    f"""WITH {DOC_TERMS},
    weighted AS (SELECT doc_id, term_id, term,
      tf * (ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + docs)) + 1) AS w
      FROM terms JOIN vocab USING (term))
    SELECT doc_id, term_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM weighted""",
)
def tfidf_weights(spark: SparkSession, sf: str) -> DataFrame:
    terms = _terms(spark, sf)
    total = v.table(spark, sf, "documents").agg(F.count("*")).scalar()
    weights = vectors.tfidf_weights(terms, vectors.vocabulary(terms), total)
    return weights.withColumn("weight", F.round("weight", 6))


@check(
    "tfidf_vectors",
    f"""WITH {DOC_TERMS},
    weighted AS (SELECT doc_id, tf * (ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + docs)) + 1) AS w
      FROM terms JOIN vocab USING (term)),
    norms AS (SELECT doc_id, sum(w) / sqrt(sum(w * w)) AS total, count(*) AS terms FROM weighted GROUP BY doc_id)
    SELECT doc_id, 1536 AS width, coalesce(terms, 0) AS terms, round(coalesce(total, 0), 6) AS total
    FROM documents LEFT JOIN norms USING (doc_id)""",
)
def tfidf_vectors(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    rows = vectors.vectorize(v.texts(spark, sf), "doc_id", "text")
    weights = vector_to_array("vector")
    return rows.select("doc_id", weights.alias("w")).select(
        "doc_id",
        F.size("w").alias("width"),
        F.size(F.filter("w", lambda x: x != 0)).cast("bigint").alias("terms"),
        F.round(F.aggregate("w", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
    )


def _points(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors.with_vector(v.table(spark, sf, "embeddings"), "embedding")
    return vectors.reduce_dimensions(rows).select("vec_id", "point")


@check("pca_project")
def pca_project(spark: SparkSession, sf: str) -> DataFrame:
    rounded = F.transform("point", lambda x: F.round(F.abs(x), 6))
    return _points(spark, sf).select("vec_id", rounded.alias("abs_point"))


@check("density_clusters")
def density_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return density.cluster(_points(spark, sf), "vec_id", min_size=5)


@check(
    "fallback_halves",
    """SELECT vec_id, CASE WHEN row_number() OVER (ORDER BY vec_id) - 1 < (SELECT count(*) FROM embeddings) // 2
    THEN 0 ELSE 1 END::INT AS cluster_id FROM embeddings""",
)
def fallback_halves(spark: SparkSession, sf: str) -> DataFrame:
    return density.halves(v.table(spark, sf, "embeddings").select("vec_id"), "vec_id")


@check(
    "cluster_centroids",
    """SELECT label, dim::INT AS dim, round(avg(x), 6) AS value FROM (
      SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)
    GROUP BY label, dim""",
)
def cluster_centroids(spark: SparkSession, sf: str) -> DataFrame:
    found = vectors.centroids(v.table(spark, sf, "embeddings"), "label", "embedding")
    return found.withColumn("value", F.round("value", 6))


@check(
    "spanning_tree_line",
    """WITH points AS (SELECT min(event_id) AS vid, floor(value * 1000)::DOUBLE AS x FROM events GROUP BY x),
    steps AS (SELECT vid, x, lag(vid) OVER (ORDER BY x) AS before, lag(x) OVER (ORDER BY x) AS below FROM points)
    SELECT least(vid, before) AS lo, greatest(vid, before) AS hi, x - below AS w FROM steps WHERE before IS NOT NULL""",
)
def spanning_tree_line(spark: SparkSession, sf: str) -> DataFrame:
    """On a line the tree joins neighbours; some eight boxes or more, as with large tables."""
    events = v.table(spark, sf, "events")
    place = F.floor(F.col("value") * 1000).cast("double")
    points = events.groupBy(place.alias("_x")).agg(F.min("event_id").alias("vid")).select("vid", F.array("_x").alias("x"))
    points = cut_lineage(points)
    return spanning_tree(points, block_rows=min(points.count() // 8 + 1, BLOCK_ROWS))


@check(
    "density_blocks",
    "SELECT event_id, (event_id % 20)::INT AS cluster_id FROM events",
)
def density_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty evenly filled stretches far apart, in several boxes and pieces of the hierarchy."""
    event = F.col("event_id")
    point = F.array((event % 20 * 1_000_000 + F.floor(event / 20)).cast("double"), F.lit(0.0))
    rows = v.table(spark, sf, "events").select(event, point.alias("point"))
    count = rows.count()
    # What a task holds does not grow with a large table.
    block_rows, piece_rows = min(count // 8 + 1, BLOCK_ROWS), min(count // 5 + 1, density.PIECE_ROWS)
    return density.cluster(rows, "event_id", 5, block_rows=block_rows, piece_rows=piece_rows)


_FIVE = ("c_custkey % 97", "3 * (c_custkey * 7 % 89)", "5 * (c_custkey * 11 % 83)", "c_custkey * 13 % 41", "2 * (c_custkey * 17 % 61)")


@check(
    "pca_distances",
    f"""WITH five AS (SELECT c_custkey, {", ".join(f"({x})::DOUBLE AS x{i}" for i, x in enumerate(_FIVE))} FROM customer),
    wide AS (SELECT c_custkey, [x0, x1, x0 + x1, x2, x3, x4, x2 - x3, 0.0] AS v FROM five),
    pairs AS (SELECT c_custkey, v, lead(v) OVER (ORDER BY c_custkey) AS after FROM wide)
    SELECT c_custkey, round(list_distance(v, after), 6) AS distance FROM pairs WHERE after IS NOT NULL""",
)
def pca_distances(spark: SparkSession, sf: str) -> DataFrame:
    """Eight coordinates that lie in five dimensions: five components keep every distance."""
    five = v.table(spark, sf, "customer").selectExpr("c_custkey", *(f"CAST({x} AS DOUBLE) AS x{i}" for i, x in enumerate(_FIVE)))
    wide = five.selectExpr("c_custkey", "array(x0, x1, x0 + x1, x2, x3, x4, x2 - x3, 0D) AS v")
    points = cut_lineage(vectors.reduce_dimensions(vectors.with_vector(wide, "v")).select("c_custkey", "point"))
    after = points.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("point").alias("after"))
    apart = F.zip_with("point", "after", lambda a, b: (a - b) * (a - b))
    length = F.sqrt(F.aggregate(apart, F.lit(0.0), lambda total, x: total + x))
    return points.join(after, "c_custkey").select("c_custkey", F.round(length, 6).alias("distance"))
