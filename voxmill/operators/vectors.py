"""TF-IDF, principal components and centroids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxmill.functions import lexicons as lex
from voxmill.functions.text import strip_space
from voxmill.session import ship_with_tasks

ship_with_tasks(__name__)

MAX_COMPONENTS = 5


def tokens(text: Column) -> Column:
    """Lower-case words of at least two word characters."""
    pattern = F.lit(f"(?U){lex.TOKEN_PATTERN}")
    return F.regexp_extract_all(F.lower(strip_space(text)), pattern, F.lit(0))


def document_terms(docs: DataFrame, doc_id: str, text: str = "content") -> DataFrame:
    """Rows ``(doc_id, term, tf)``.

    Tokens are sorted within their row, so equal ones lie next to each other
    and are counted in the map task: no shuffle.
    """
    words = docs.select(
        F.col(doc_id).alias("doc_id"), F.sort_array(tokens(F.col(text))).alias("_w")
    )
    starts = F.when(
        F.size("_w") > 0,
        F.filter(
            F.sequence(F.lit(0), F.size("_w") - 1),
            lambda i: (i == 0) | (F.get("_w", i - 1) != F.get("_w", i)),
        ),
    )
    counted = F.transform(
        "_s",
        lambda start, n: F.struct(
            F.get("_w", start).alias("term"),
            (F.coalesce(F.get("_s", n + 1), F.size("_w")) - start).cast("bigint").alias("tf"),
        ),
    )
    # The outer form keeps Spark from adding a filter that counts a second time.
    rows = words.withColumn("_s", starts).select("doc_id", F.inline_outer(counted))
    return rows.where(F.col("term").isNotNull())


def vocabulary(terms: DataFrame, width: int = lex.VECTOR_WIDTH) -> DataFrame:
    """The ``width`` most frequent terms, ``(term, term_id, count, docs)``.

    Equal counts go by term.  Ids follow the terms' order; that window sees
    ``width`` rows.
    """
    return (
        terms.groupBy("term")
        .agg(F.sum("tf").alias("count"), F.count("*").alias("docs"))
        .orderBy(F.col("count").desc(), "term")
        .limit(width)
        .withColumn(
            "term_id",
            (F.row_number().over(W.partitionBy(F.lit(0)).orderBy("term")) - 1).cast("int"),
        )
    )


def smooth_idf(documents: Column, docs_with_term: Column) -> Column:
    return F.log((1 + documents) / (1 + docs_with_term)) + 1


def tfidf_weights(terms: DataFrame, vocab: DataFrame, documents: Column) -> DataFrame:
    """L2-normalised weights as rows ``(doc_id, term_id, term, weight)``.

    The vocabulary has at most ``width`` rows, so broadcasting it is safe; the
    one shuffle brings each document's few weights together for its norm.
    """
    weighted = terms.join(F.broadcast(vocab), "term").withColumn(
        "_w", F.col("tf") * smooth_idf(documents, F.col("docs"))
    )
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(W.partitionBy("doc_id")))
    return weighted.select("doc_id", "term_id", "term", (F.col("_w") / norm).alias("weight"))


def vectorize(
    docs: DataFrame,
    doc_id: str,
    text: str = "content",
    width: int = lex.VECTOR_WIDTH,
    vector: str = "vector",
) -> DataFrame:
    """Add the TF-IDF row of each document as a sparse vector column.

    Only the vocabulary (at most ``width`` terms with their idf) visits the
    driver.  Applying it is one pass without a shuffle.  A text without a known
    term gets the zero vector.
    """
    total = docs.agg(F.count("*")).scalar()
    known = (
        vocabulary(document_terms(docs, doc_id, text), width)
        .select("term", smooth_idf(total, F.col("docs")).alias("idf"))
        .orderBy("term")
        .collect()
    )
    if not known:
        empty = F.array_repeat(F.lit(0.0), width)
        return docs.withColumn(vector, array_to_vector(empty))
    counter = CountVectorizerModel.from_vocabulary(
        [row["term"] for row in known], inputCol="_tokens", outputCol="_tf"
    )
    scale = ElementwiseProduct(
        scalingVec=Vectors.dense([row["idf"] for row in known]), inputCol="_tf", outputCol="_tfidf"
    )
    unit = Normalizer(p=2.0, inputCol="_tfidf", outputCol=vector)
    counted = counter.transform(docs.withColumn("_tokens", tokens(F.col(text))))
    return unit.transform(scale.transform(counted)).drop("_tokens", "_tf", "_tfidf")


def with_vector(rows: DataFrame, array: str, vector: str = "vector") -> DataFrame:
    """A given ``array<float>`` column as a vector column."""
    return rows.withColumn(vector, array_to_vector(F.col(array).cast("array<double>")))


def reduce_dimensions(
    rows: DataFrame, vector: str = "vector", components: int = MAX_COMPONENTS, point: str = "point"
) -> DataFrame:
    """Project onto the first principal components, ``point: array<double>``.

    At most ``rows - 1`` components; below two the vectors stay as they are.
    The signs of the axes are free, so only distances between points mean
    anything.
    """
    axes = principal_axes(rows, vector, components)
    if axes is None:
        return rows.withColumn(point, vector_to_array(vector))

    @F.pandas_udf("array<double>")
    def project(vectors: pd.DataFrame) -> pd.Series:
        # A sparse vector comes as its few indices and values, a dense one without indices.
        values = vectors["values"].to_numpy()
        places = [
            np.arange(len(v)) if i is None else np.asarray(i)
            for i, v in zip(vectors["indices"], values, strict=True)
        ]
        sizes = np.array([len(i) for i in places])
        terms = axes[np.concatenate(places).astype(int)] * np.concatenate(values)[:, None]
        out = np.zeros((len(values), axes.shape[1]))
        filled = np.flatnonzero(sizes)
        if len(filled):
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])[filled]
            out[filled] = np.add.reduceat(terms, starts)
        return pd.Series(list(out))

    parts = F.unwrap_udt(F.col(vector))
    return rows.withColumn(point, project(F.struct(parts["indices"].alias("indices"), parts["values"].alias("values"))))


def _second_moments(width: int):
    """Per task: for each coordinate the sums of its products with itself and later ones; -1 has the sums.

    A sparse vector costs the square of its stored entries, whatever the width.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums, rows = np.zeros(width * width), np.zeros(width), 0
        for batch in batches:
            places, values = batch.column("indices"), batch.column("values")
            rows += batch.num_rows
            stored = values.flatten().to_numpy(zero_copy_only=False)
            if batch.num_rows and places.null_count == batch.num_rows:  # dense vectors
                x = stored.reshape(batch.num_rows, width)
                total += (x.T @ x).ravel()
                sums += x.sum(axis=0)
                continue
            sizes = values.value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            given = [np.arange(width) if i is None else i for i in places.to_pylist()]
            index = np.concatenate([np.empty(0, np.int64), *given]).astype(np.int64)
            np.add.at(sums, index, stored)
            for size in np.unique(sizes[sizes > 0]):  # vectors of as many entries go together
                same = (ends[sizes == size] - size)[:, None] + np.arange(size)
                for part in np.array_split(same, max(1, same.size * int(size) // 4_000_000)):
                    i, x = index[part], stored[part]
                    np.add.at(total, i[:, :, None] * width + i[:, None, :], x[:, :, None] * x[:, None, :])
        if not rows:
            return
        matrix = total.reshape(width, width)
        used = np.flatnonzero(np.diag(matrix))
        lines = [np.concatenate([[rows], sums]), *(matrix[i, i:] for i in used)]
        numbers = pa.array([-1, *used.tolist()], pa.int32())
        yield pa.RecordBatch.from_arrays([numbers, pa.array(lines, pa.list_(pa.float64()))], ["i", "line"])

    return add


def _added(lines: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(len(lines["line"].iloc[0]))
    for line in lines["line"]:
        total += line
    return pd.DataFrame({"i": [lines["i"].iloc[0]], "line": [total]})


def principal_axes(rows: DataFrame, vector: str, components: int) -> np.ndarray | None:
    """Axes of largest variance as columns, or None if there are fewer than two.

    One pass: the tasks add up products of the vectors' stored entries, and the
    mean is taken off at the end.  The driver sees one matrix of width squared,
    however many rows there are.
    """
    parts = F.unwrap_udt(F.col(vector))
    sized = F.coalesce(parts["size"], F.size(parts["values"])).alias("width")
    first = rows.where(F.col(vector).isNotNull()).select(sized).first()
    if first is None:
        return None
    width = first["width"]
    stored = rows.select(parts["indices"].alias("indices"), parts["values"].alias("values"))
    moments = stored.mapInArrow(_second_moments(width), "i int, line array<double>")
    lines = {r.i: np.array(r.line) for r in moments.groupBy("i").applyInPandas(_added, "i int, line array<double>").collect()}
    count, sums = int(lines[-1][0]), lines[-1][1:]
    usable = min(components, count - 1)
    if usable < 2:
        return None
    products = np.zeros((width, width))
    for i, line in lines.items():
        if i >= 0:
            products[i, i:] = products[i:, i] = line
    covariance = (products - np.outer(sums, sums) / count) / (count - 1)
    _, axes = np.linalg.eigh(covariance)
    return np.ascontiguousarray(axes[:, ::-1][:, :usable])


def centroids(rows: DataFrame, label: str, array: str) -> DataFrame:
    """Mean vector per label as rows ``(label, dim, value)``.

    Vectors are averaged whole in the map tasks; only one vector per label and
    task is shuffled.
    """
    return (
        with_vector(rows.select(label, array), array, "_v")
        .groupBy(label)
        .agg(Summarizer.mean(F.col("_v")).alias("_mean"))
        .select(label, F.posexplode(vector_to_array("_mean")).alias("dim", "value"))
    )
