"""Weighted term search and goal ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.exprs import goal_terms, inverse_document_frequency, literal_count
from lodestone.functions.scores import search_score

# Weights of the fields of a module in goal ranking.
WEIGHTS = {"path": 7.0, "stem": 8.0, "summary": 3.0, "symbols": 4.0, "semantic": 2.5}


def search(df: DataFrame, query: str, path: str, text: str, limit: int = 50) -> DataFrame:
    """Rows by ``8 x path hits + 3 x text hits + 10 where the path is the query``, ties by path."""
    terms = [t for t in query.lower().split() if t]
    hits = lambda c: sum((literal_count(F.lower(c), t) for t in terms), F.lit(0))
    scored = df.withColumn("score", search_score(hits(F.col(path)), hits(F.coalesce(text, F.lit(""))), F.lower(path) == query.lower()))
    return scored.where("score > 0").orderBy(F.col("score").desc(), path).limit(limit)


def document_frequency(df: DataFrame, haystack: Column, terms: Sequence[str]) -> dict[str, int]:
    """In how many rows each term stands: one pass, one row to the driver."""
    row = df.select(haystack.alias("h")).agg(F.count("*").alias("n"), *[F.count_if(F.contains("h", F.lit(t))).alias(f"t{i}") for i, t in enumerate(terms)]).first()
    return {"": row["n"]} | {t: row[f"t{i}"] for i, t in enumerate(terms)}


def tfidf(df: DataFrame, terms: Sequence[str], fields: dict[str, float]) -> DataFrame:
    """``score``: sum over terms of idf times the weighted hits in each field; rows of score 0 go.

    Document frequency is the number of rows any of whose fields holds the term."""
    low = {f: F.lower(F.coalesce(f, F.lit(""))) for f in fields}
    known = document_frequency(df, F.concat_ws(" ", *low.values()), terms)
    n = F.lit(float(known[""]))
    score = F.lit(0.0)
    for t in terms:
        hits = sum((w * literal_count(low[f], t) for f, w in fields.items()), F.lit(0.0))
        score = score + inverse_document_frequency(n, F.lit(float(known[t]))) * hits
    return df.withColumn("score", score).where("score > 0")


def rank_goal(modules: DataFrame, goal: str, is_test: Column) -> DataFrame:
    """Modules by relevance to a goal: TF-IDF, 30 more where the path holds the phrase, tests at 45 %."""
    terms = modules.sparkSession.range(1).select(goal_terms(F.lit(goal)).alias("t")).first()["t"]
    phrase = "_".join(goal.lower().split())
    scored = tfidf(modules, terms, WEIGHTS)
    boosted = F.col("score") + F.when(F.contains(F.lower("path"), F.lit(phrase)), 30).otherwise(0)
    return scored.withColumn("score", boosted * F.when(is_test, 0.45).otherwise(1.0)).orderBy(F.col("score").desc(), "path")
