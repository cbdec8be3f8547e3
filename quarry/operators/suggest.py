"""Query suggestions mined from the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.index import Index
from quarry.operators.ranking import B, K1, bm25_idf

LEAST_LENGTH, LEAST_DF = 4, 2


def suggest(index: Index, limit: int = 4, digits: int | None = None) -> DataFrame:
    """(term, doc_id, score): terms of middling frequency, each with the document it scores best in, the best one for each document. A
    limit of 0 gives all."""
    n = F.col("n_docs").cast("double")
    most = F.greatest(F.lit(LEAST_DF), F.floor(F.col("n_docs") / 2))
    rows = (index.postings if index.whole is None else index.whole).where((F.length("term") >= LEAST_LENGTH) & ~F.col("term").rlike("^[0-9]+$"))
    rows = rows if "length" in rows.columns else rows.join(index.lengths, "doc_id")
    # one shuffle by term, in which the documents are counted and the best one is found; a term has a row for each document at most
    rows = rows.withColumn("df", F.count("*").over(Window.partitionBy("term"))).crossJoin(F.broadcast(index.stats))  # one row
    rows = rows.where(F.col("df").between(F.lit(LEAST_DF), most))
    tf = F.col("tf").cast("double")
    ratio = F.when(F.col("avgdl") == 0, F.lit(1.0)).otherwise(F.col("length") / F.col("avgdl"))
    score = bm25_idf(n, F.col("df")) * tf * F.lit(K1 + 1.0) / (tf + F.lit(K1) * (F.lit(1.0 - B) + F.lit(B) * ratio))
    rows = rows.select("term", "doc_id", (F.round(score, digits) if digits is not None else score).alias("score"))
    best = rows.groupBy("term").agg(F.max(F.struct("score", (-F.col("doc_id")).alias("back"))).alias("best"))
    best = best.select("term", (-F.col("best.back")).alias("doc_id"), "best.score")
    first = best.withColumn("at", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "term"))).where("at = 1").drop("at")
    ordered = first.orderBy(F.desc("score"), "term")
    return ordered.limit(limit) if limit else ordered
