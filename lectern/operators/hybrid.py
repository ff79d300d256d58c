"""Fusion of vector and keyword hits, threshold, reranking and pages of results.

Where only one leg finds anything, its rows keep a final score by the rule for one-sided hits, so a
keyword hit is never lost for want of a vector (and the other way round).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import vectors as V


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame, vector_weight: float = 0.6, keyword_weight: float = 0.4, key: str = "doc_id", by: str | None = None) -> DataFrame:
    """(key, raw_vector_score, vector_score, keyword_score, final_score, search_type, fusion_info), with `by` for each question apart.

    vector_hits: (key, score), spread to 0.1-0.9 over the hits; keyword_hits: (key, keyword_score).
    Both legs: weighted sum; one: 0.8 of it; neither above 0.05: half of the larger.
    """
    keys = [key] if by is None else [by, key]
    if by is None:
        ends = vector_hits.where("score > 0").agg(F.min("score").alias("__low"), F.max("score").alias("__top"))
        ranged = vector_hits.join(F.broadcast(ends))
    else:  # a question's hits are its k best
        own, positive = Window.partitionBy(by), F.when(F.col("score") > 0, F.col("score"))
        ranged = vector_hits.withColumns({"__low": F.min(positive).over(own), "__top": F.max(positive).over(own)})
    span = F.when(F.col("__top") > F.col("__low"), F.col("__top") - F.col("__low")).otherwise(F.lit(1.0))
    spread = F.when(F.col("score") > 0, V.clamp(F.lit(0.1) + (F.col("score") - F.col("__low")) / span * F.lit(0.8), 0.05, 0.95)).otherwise(F.lit(0.05))
    left = ranged.select(*keys, F.col("score").alias("raw_vector_score"), spread.alias("vector_score"))
    both = left.join(keyword_hits.select(*keys, "keyword_score"), keys, "full")
    v, k = F.coalesce("vector_score", F.lit(0.0)), F.coalesce("keyword_score", F.lit(0.0))
    final = F.when((v > 0.05) & (k > 0.05), v * vector_weight + k * keyword_weight).when(v > 0.05, v * 0.8).when(k > 0.05, k * 0.8).otherwise(F.greatest(v, k) * 0.5)
    kinds = F.array_compact(F.array(F.when(F.col("vector_score").isNotNull(), F.lit("vector")), F.when(F.col("keyword_score").isNotNull(), F.lit("bm25"))))
    out = both.select(*keys, "raw_vector_score", v.alias("vector_score"), k.alias("keyword_score"), V.clamp(final, 0.05, 0.95).alias("final_score"), kinds.alias("search_type"))
    info = F.struct(F.lit(vector_weight).alias("vector_weight"), F.lit(keyword_weight).alias("keyword_weight"), *[F.round(c, 4).alias(c) for c in ("vector_score", "keyword_score", "final_score")])
    return out.withColumn("fusion_info", info)


def ranked(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The k best by score, with rank; ties by key."""
    order = [F.desc_nulls_last(score), F.col(key)]
    best = df.orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def hybrid_search(vector_hits: DataFrame, keyword_hits: DataFrame, top_k: int = 5, vector_weight: float = 0.6, keyword_weight: float = 0.4, threshold: float = 0.3, key: str = "doc_id") -> DataFrame:
    """Fused hits with final_score >= threshold, the top_k best of them."""
    return ranked(fuse(vector_hits, keyword_hits, vector_weight, keyword_weight, key).where(F.col("final_score") >= threshold), "final_score", key, top_k)


def rerank_cosine(hits: DataFrame, query: list[float], top_k: int = 5, prior: str = "final_score", vector_col: str = "embedding", key: str = "doc_id") -> DataFrame:
    """Hits in the order of their cosine with the query; without a usable vector the prior score stands."""
    from lectern.operators.vector import literal

    size = sum(x * x for x in map(float, query)) ** 0.5
    score = V.dot(F.col(vector_col), literal(query)) / (V.norm(F.col(vector_col)) * F.lit(size) + F.lit(1e-8))
    usable = F.col(vector_col).isNotNull() & (F.size(vector_col) == len(query))
    return ranked(hits.withColumn("rerank_score", F.when(usable, score).otherwise(F.col(prior))), "rerank_score", key, top_k)


class Reranker:
    """Reranking by the first provider given (remote, then cross-encoder), else by cosine.

    A provider is a function of (query, list of texts) to scores and runs on Arrow batches; where it
    fails, the prior score stands, and `rerank_failed` of a hit says so.
    """

    def __init__(self, remote=None, cross_encoder=None):
        self.remote, self.cross_encoder = remote, cross_encoder

    def available_method(self) -> str:
        return "remote" if self.remote else "cross_encoder" if self.cross_encoder else "vector_similarity"

    def rerank(self, hits: DataFrame, query: str, query_vector: list[float] | None = None, top_k: int = 5, prior: str = "final_score", text_col: str = "content", vector_col: str = "embedding", key: str = "doc_id") -> DataFrame:
        provider = self.remote or self.cross_encoder
        if provider is None:
            return rerank_cosine(hits, query_vector or [], top_k, prior, vector_col, key)
        @F.pandas_udf("double")
        def given(texts: pd.Series) -> pd.Series:
            try:
                return pd.Series([float(x) for x in provider(query, texts.fillna("").tolist())])
            except Exception:  # an unavailable model must not fail the search
                return pd.Series([None] * len(texts), dtype="float64")

        told = hits.withColumn("rerank_score", given(F.col(text_col))).withColumn("rerank_failed", F.col("rerank_score").isNull())
        return ranked(told.withColumn("rerank_score", F.coalesce("rerank_score", F.col(prior))), "rerank_score", key, top_k)


def linear_similarity(token: Column, vector: Column, token_weight: float = 0.3, vector_weight: float = 0.7) -> Column:
    return F.lit(token_weight) * token + F.lit(vector_weight) * vector


def weighted_terms(content: Column, title: Column, important: Column) -> Column:
    """Terms for reranking: a title's count twice, important ones five times."""
    return F.concat(content, *[title] * 2, *[important] * 5)


def page(hits: DataFrame, score: str, key: str, number: int = 1, size: int = 10, threshold: float = 0.1) -> DataFrame:
    """One page of the hits with score >= threshold, with their rank over all pages."""
    kept = hits.where(F.col(score) >= threshold).orderBy(F.desc(score), key).limit(number * size)
    placed = kept.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)))
    return placed.where((F.col("rank") > (number - 1) * size) & (F.col("rank") <= number * size))


def in_reading_order(hits: DataFrame, page_col: str = "page_num", top_col: str = "top", time_col: str = "create_time", by: str | None = None, key: str | None = None) -> DataFrame:
    """Page and place upwards, newest first where both are equal; with `by` each group's hits are numbered so in `place`, ties by key."""
    order = [F.asc(page_col), F.asc(top_col), F.desc(time_col), *([F.asc(key)] if key else [])]
    if by is None:
        return hits.orderBy(*order)
    return hits.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def document_counts(hits: DataFrame, name: str = "document_name") -> DataFrame:
    """How many hits each document has, most first, over all hits."""
    return hits.groupBy(name).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), name)


def compare(first: DataFrame, second: DataFrame, question: str = "question", score: str = "score") -> DataFrame:
    """Per question: hits and mean score of two methods and the differences."""
    a = first.groupBy(question).agg(F.count(F.lit(1)).alias("n_first"), F.avg(score).alias("mean_first"))
    b = second.groupBy(question).agg(F.count(F.lit(1)).alias("n_second"), F.avg(score).alias("mean_second"))
    both = a.join(b, question, "full").fillna(0, ["n_first", "n_second", "mean_first", "mean_second"])
    return both.withColumn("n_diff", F.col("n_second") - F.col("n_first")).withColumn("mean_diff", F.col("mean_second") - F.col("mean_first"))
