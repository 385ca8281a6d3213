"""Text summary table and retrieval over given vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom import vocab
from caseloom.functions.text import language_guess, normalize_text, token_count


def text_summaries(parsed: DataFrame, id_col: str = "ID") -> DataFrame:
    """``(decision_id, question, raw_text, normalized_text, token_count, language)``."""
    cells = F.array(*[
        F.struct(F.lit(q).alias("question"), F.col("answers")[q].alias("raw_text")) for q in vocab.TEXT_QUESTIONS
    ])
    rows = parsed.select(F.col(id_col).alias("decision_id"), F.explode(cells).alias("c")).select("decision_id", "c.*")
    staged = rows.filter(F.col("raw_text").isNotNull()).withColumn("normalized_text", normalize_text(F.col("raw_text")))
    text = F.col("normalized_text")
    return staged.withColumns({"token_count": token_count(text), "language": language_guess(text)})


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def cosine(a: Column, b: Column) -> Column:
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def mean_vector(vectors: DataFrame, vector_col: str) -> DataFrame:
    """One row: the mean of all vectors, from per-dimension sums."""
    means = vectors.select(F.posexplode(vector_col).alias("d", "x")).groupBy("d").agg(
        F.avg(F.col("x").cast("double")).alias("m")
    )
    ordered = F.array_sort(F.collect_list(F.struct("d", "m")))
    return means.agg(F.transform(ordered, lambda e: e["m"]).alias("mean"))


def most_similar(vectors: DataFrame, query: Column | list[float], k: int, id_col: str, vector_col: str) -> DataFrame:
    """The ``k`` vectors closest to one query vector (cosine, ties by id).

    Exact: every vector is scored where it lies and each task keeps its best
    ``k``; only those travel.  ``query`` is a list or a one-row ``scalar()``.
    """
    q = F.array(*[F.lit(float(x)) for x in query]) if isinstance(query, list) else query
    scored = vectors.withColumn("_q", q).select(id_col, cosine(F.col(vector_col), F.col("_q")).alias("similarity"))
    return scored.orderBy(F.desc_nulls_last("similarity"), id_col).limit(k)
