"""The link graph and its PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.session import cut, pieces

DAMPING, MAX_ROUNDS, TOLERANCE = 0.85, 100, 1e-6


def link_graph(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Distinct (src, dst) between documents of the table; of documents with one url the last id stands for it. ``parts``: to how many partitions links are dealt, if there are many."""
    by = lambda df, key: df.repartition(parts, key) if parts else df
    target = docs.groupBy("url").agg(F.max("doc_id").alias("dst"))
    out = docs.select(F.col("doc_id").alias("src"), F.explode("links").alias("url"))
    return by(by(out, "url").join(by(target, "url"), "url").where("src <> dst").select("src", "dst"), "src").distinct()


def inbound(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, n_inbound), also where it is 0."""
    n = edges.groupBy(F.col("dst").alias("doc_id")).agg(F.count("*").alias("n_inbound"))
    return nodes.select("doc_id").join(n, "doc_id", "left").fillna(0, ["n_inbound"])


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = DAMPING, max_rounds: int = MAX_ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, score), summing to 1. Each round joins the edges with the scores, adds up by target, and spreads the share of dangling nodes evenly; it ends
    with the round whose changes add up to less than the tolerance. Only sums reach the driver. Edges are written first and dealt by their number, so that what a task
    holds doesn't grow with them."""
    edges = cut(edges)
    parts = pieces(edges.sparkSession, edges.count())
    edges = edges.repartition(parts, "src")
    degree = edges.groupBy(F.col("src").alias("doc_id")).agg(F.count("*").alias("out"))
    nodes = nodes.select("doc_id").join(degree, "doc_id", "left")
    links = edges.join(degree.withColumnRenamed("doc_id", "src"), "src").select("src", "dst", "out")
    links, ranks = cut(links), cut(nodes)
    n = ranks.count()
    ranks = ranks.withColumn("score", F.lit(1.0 / max(n, 1)))
    lost = ranks.where("out is null").agg(F.sum("score")).first()[0] or 0.0
    for _ in range(max_rounds if n else 0):
        base = (1.0 - damping) / n + damping * lost / n
        given = links.join(ranks.select(F.col("doc_id").alias("src"), "score"), "src").groupBy(F.col("dst").alias("doc_id")).agg(F.sum(F.lit(damping) * F.col("score") / F.col("out")).alias("given"))
        new = ranks.join(given, "doc_id", "left").select("doc_id", "out", (F.lit(base) + F.coalesce("given", F.lit(0.0))).alias("next"), F.col("score"))
        new = cut(new)
        delta, lost = new.agg(F.sum(F.abs(F.col("next") - F.col("score"))), F.sum(F.when(F.col("out").isNull(), F.col("next")).otherwise(0.0))).first()
        ranks = new.select("doc_id", "out", F.col("next").alias("score"))
        if delta < tolerance:
            break
    return ranks.select("doc_id", "score")
