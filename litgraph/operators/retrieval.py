"""Retrieval over scored rows: reranking, context within a token budget, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .relational import context_budget


def with_cosine(rows: DataFrame, query: DataFrame) -> DataFrame:
    """Adds ``cosine`` of each row's embedding to the one vector of ``query`` (null where there is none)."""
    one = query.select(F.col("embedding").alias("_query")).limit(1)
    return rows.crossJoin(F.broadcast(one)).withColumn("cosine", S.cosine_similarity(F.col("embedding"), F.col("_query"))).drop("_query")


def rerank(rows: DataFrame, query: DataFrame, k: int, score_weight: float = 0.3, vector_weight: float = 0.7) -> DataFrame:
    """The ``k`` best of ``rows`` (id, score, embedding) by weighted score and cosine; without a vector the score alone counts, without a score a half."""
    score = F.coalesce("score", F.lit(0.5))
    final = F.when(F.col("cosine").isNull(), score).otherwise(score_weight * score + vector_weight * F.col("cosine"))
    return with_cosine(rows, query).select("id", final.alias("final_score")).orderBy(F.desc("final_score"), "id").limit(k)


def retrieval_context(chunks: DataFrame, query: DataFrame, k: int = 10, max_tokens: int = 4000) -> DataFrame:
    """The ``k`` chunks (id, text, embedding) nearest to the query vector, cut to the token budget: (id, score, tokens)."""
    best = with_cosine(chunks, query).filter("cosine is not null").select("id", "text", F.col("cosine").alias("score")).orderBy(F.desc("score"), "id").limit(k)
    return context_budget(best, [], max_tokens).select("id", "score", S.token_estimate(F.col("text")).alias("tokens"))


def provenance_warning(counts: DataFrame, count_col: str = "n_results") -> DataFrame:
    """Adds ``warning``: none without results, few under three, else null."""
    n = F.coalesce(F.col(count_col), F.lit(0))
    return counts.withColumn("warning", F.when(n == 0, "none").when(n < 3, "few"))
