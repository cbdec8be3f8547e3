"""Ranking evaluation: precision at 1, mean reciprocal rank, and the sweep over methods and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.index import Index
from quarry.operators.ranking import METHODS, narrowed, normalised, per_query, relevance
from quarry.plans.session import cut

CUTOFF = 10
SWEEP = tuple(round(i * 0.05, 2) for i in range(21))


def matched(judgments: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query, url) to (query_id, doc_id) of urls in the corpus, and the queries of which none is."""
    last = docs.groupBy("url").agg(F.max("doc_id").alias("doc_id"))
    found = judgments.join(last, "url").select(F.col("query").alias("query_id"), "doc_id").distinct()
    return found, judgments.select(F.col("query").alias("query_id")).distinct().join(found, "query_id", "left_anti")


def hits(candidates: DataFrame, judged: DataFrame, scores: dict[str, Column], on: list[str], queries: int) -> DataFrame:
    """(on..., and for each of ``scores`` the rank of the query's best judged document): one more than the number of candidates that beat it, by score and
    then doc_id. No ranking of the candidates is made; they are counted where they are."""
    rows = candidates.select(*on, "doc_id", *[c.alias(k) for k, c in scores.items()])
    first = lambda k: F.max(F.struct(F.col(k).alias("score"), (-F.col("doc_id")).alias("back"))).alias(f"best_{k}")
    best = rows.join(judged.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi").groupBy(*on).agg(*[first(k) for k in scores])
    beats = lambda k: (F.col(k) > F.col(f"best_{k}")["score"]) | ((F.col(k) == F.col(f"best_{k}")["score"]) & (-F.col("doc_id") > F.col(f"best_{k}")["back"]))
    return per_query(rows, best, on, queries).groupBy(*on).agg(*[(F.count(F.when(beats(k), 1)) + 1).alias(k) for k in scores])


def metrics(found: DataFrame, judged: DataFrame, by: list[str] | None = None, cutoff: int = CUTOFF) -> DataFrame:
    """found: (by..., query_id, rank) of the best judged document, or of several. One row for each value of ``by``: n_queries, p_at_1, mrr; without queries both are null."""
    by = by or []
    first = found.groupBy(*by, "query_id").agg(F.min("rank").alias("at"))
    queries = judged.select("query_id").distinct()
    every = queries.crossJoin(F.broadcast(found.select(*by).distinct())) if by else queries  # by: the configurations of a sweep
    rows = every.join(first, [*by, "query_id"], "left")
    return rows.groupBy(*by).agg(F.count("*").alias("n_queries"), F.avg(F.when(F.col("at") == 1, 1.0).otherwise(0.0)).alias("p_at_1"), F.avg(F.when(F.col("at") <= cutoff, 1.0 / F.col("at")).otherwise(0.0)).alias("mrr"))


def evaluate(scores: DataFrame, judged: DataFrame, cutoff: int = CUTOFF, digits: int | None = None) -> DataFrame:
    """(query_id, doc_id, score) of all candidates to one row: n_queries, p_at_1, mrr."""
    score = F.round("score", digits) if digits is not None else F.col("score")
    found = hits(scores, judged, {"rank": score}, ["query_id"], judged.select("query_id").distinct().count())
    return metrics(found, judged, cutoff=cutoff)


def sweep(index: Index, wanted: DataFrame, authority: DataFrame, judged: DataFrame, weights: tuple[float, ...] = SWEEP, digits: int | None = None) -> DataFrame:
    """(method, weight, n_queries, p_at_1, mrr), best first; of equals the smaller weight, then bm25. All weights are counted in one pass over the candidates."""
    index, on = narrowed(index, wanted), ["method", "query_id"]
    queries = len(METHODS) * wanted.select("query_id").distinct().count()
    both = None
    for m in METHODS:
        rows = relevance(index, wanted, m).withColumn("method", F.lit(m))
        both = rows if both is None else both.unionByName(rows)
    rows = cut(normalised(both, authority, on, queries))
    score = lambda w: (1.0 - w) * F.col("r") + w * F.col("a")
    at = {f"w{i}": F.round(score(F.lit(w)), digits) if digits is not None else score(F.lit(w)) for i, w in enumerate(weights)}
    found = hits(rows, judged, at, on, queries)
    each = F.explode(F.array(*[F.struct(F.lit(w).alias("weight"), F.col(f"w{i}").alias("rank")) for i, w in enumerate(weights)])).alias("x")
    return metrics(found.select(*on, each).select(*on, "x.weight", "x.rank"), judged, ["method", "weight"]).orderBy(F.desc("p_at_1"), F.desc("mrr"), "weight", "method")
