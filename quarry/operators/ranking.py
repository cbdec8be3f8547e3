"""Retrieval and ranking: OR retrieval, TF-IDF, BM25, blending with authority, top k. All for many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import tokenize
from quarry.operators.index import Index, corpus_stats
from quarry.plans.session import cut

K1, B, AUTHORITY_WEIGHT = 1.5, 0.75, 0.2
METHODS = ("bm25", "tfidf")
#: Up to so many rows, one for each query (and method, or term), are broadcast; more are joined.
BROADCAST_QUERIES = 100_000


def query_terms(spark: SparkSession, queries: dict[str, str]) -> DataFrame:
    """(query_id, term, qtf): repeated words of a query count repeatedly in its scores, and retrieve once."""
    rows = spark.createDataFrame(list(queries.items()) or [("", "")], "query_id string, query string")
    return terms_of(rows)


def terms_of(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(tokenize(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def needed(posted: DataFrame, wanted: DataFrame) -> DataFrame:
    """The postings of the queries' terms. Spark takes the semi-join below an aggregation, and to postings before a shuffle, only if it is a broadcast."""
    terms = wanted.select("term").distinct()
    few = wanted.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES
    return posted.join(F.broadcast(terms) if few else terms, "term", "left_semi")


def retrieve(posted: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query_id, doc_id): documents with at least one of the query's terms."""
    return needed(posted, wanted).join(wanted, "term").select("query_id", "doc_id").distinct()


def narrowed(index: Index, wanted: DataFrame) -> Index:
    """The index as far as some queries need it, materialised: for several rankings of the same queries, which would read the corpus again each time."""
    sizes = cut(index.lengths)
    return Index(index.documents, cut(needed(index.postings, wanted)), index.terms, sizes, corpus_stats(sizes))


def classic_idf(n: Column, df: Column) -> Column:
    return F.when(df > 0, F.log(n / df)).otherwise(F.lit(0.0))


def bm25_idf(n: Column, df: Column) -> Column:
    return F.when(df > 0, F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))).otherwise(F.lit(0.0))


def relevance(index: Index, wanted: DataFrame, method: str = "bm25", k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, relevance) for every candidate, also where the score is 0."""
    if method not in METHODS:
        raise ValueError(f"method has to be one of {METHODS}")
    posted = needed(index.postings, wanted)  # only the queries' terms are shuffled
    hits, df = posted.join(wanted, "term"), posted.groupBy("term").agg(F.count("*").alias("df"))
    rows = hits.join(df, "term").join(index.lengths, "doc_id").crossJoin(F.broadcast(index.stats))  # one row
    n, tf, size = F.col("n_docs").cast("double"), F.col("tf").cast("double"), F.col("length").cast("double")
    if method == "tfidf":
        part = tf / size * classic_idf(n, F.col("df"))
    else:
        ratio = F.when(F.col("avgdl") == 0, F.lit(1.0)).otherwise(size / F.col("avgdl"))
        part = bm25_idf(n, F.col("df")) * tf * F.lit(k1 + 1.0) / (tf + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * ratio))
    return rows.groupBy("query_id", "doc_id").agg(F.sum(F.col("qtf") * part).alias("relevance"))


def per_query(rows: DataFrame, small: DataFrame, on: list[str], queries: int) -> DataFrame:
    """``rows`` with the columns of a side that has one row for each query."""
    return rows.join(F.broadcast(small) if queries <= BROADCAST_QUERIES else small, on)


def share(value: Column, most: Column) -> Column:
    """Of the largest of the query's candidates; all 0 where that is 0."""
    return F.when(most == 0, F.lit(0.0)).otherwise(value / most)


def normalised(scored: DataFrame, authority: DataFrame, on: list[str], queries: int) -> DataFrame:
    """(on..., doc_id, r, a): relevance and authority as shares of the largest of the query's candidates. The largest are aggregated, which combines before it
    shuffles, and come back as one row for each query."""
    rows = scored.join(authority.select("doc_id", F.col("score").alias("authority")), "doc_id", "left").fillna(0.0, ["authority"])
    most = rows.groupBy(*on).agg(F.max("relevance").alias("most_r"), F.max("authority").alias("most_a"))
    return per_query(rows, most, on, queries).select(*on, "doc_id", share(F.col("relevance"), F.col("most_r")).alias("r"), share(F.col("authority"), F.col("most_a")).alias("a"))


def blend(scored: DataFrame, authority: DataFrame | None, weight: float = AUTHORITY_WEIGHT, queries: int = BROADCAST_QUERIES + 1) -> DataFrame:
    """(query_id, doc_id, score). Without authority the relevance itself; with it both are normalised over the query's candidates. ``queries``: how many there are, if that is known."""
    if authority is None:
        return scored.select("query_id", "doc_id", F.col("relevance").alias("score"))
    rows = normalised(scored, authority, ["query_id"], queries)
    return rows.select("query_id", "doc_id", (F.lit(1.0 - weight) * F.col("r") + F.lit(weight) * F.col("a")).alias("score"))


def ranked(scores: DataFrame, limit: int | None = None, digits: int | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score): by score, then doc_id. With ``digits`` scores are rounded before they are ordered."""
    score = F.round("score", digits) if digits is not None else F.col("score")
    rows = scores.withColumn("score", score)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")).cast("long"))
    return rows.where(F.col("rank") <= limit) if limit is not None else rows


def top(scores: DataFrame, limit: int) -> DataFrame:
    """The best of one query, without a window: every task keeps ``limit`` rows."""
    return scores.orderBy(F.desc("score"), "doc_id").limit(limit)


def search(index: Index, wanted: DataFrame, authority: DataFrame | None = None, limit: int | None = 10, method: str = "bm25", weight: float = AUTHORITY_WEIGHT, k1: float = K1, b: float = B, digits: int | None = None) -> DataFrame:
    queries = wanted.select("query_id").distinct().count() if authority is not None else 0
    return ranked(blend(relevance(index, wanted, method, k1, b), authority, weight, queries), limit, digits)


def compare(index: Index, wanted: DataFrame, limit: int = 5, digits: int | None = None) -> DataFrame:
    """(query_id, rank, tfidf_doc, bm25_doc, moved): both scorers' rankings side by side."""
    index = narrowed(index, wanted)
    a, b = (search(index, wanted, None, limit, m, digits=digits).select("query_id", "rank", F.col("doc_id").alias(f"{m}_doc")) for m in ("tfidf", "bm25"))
    return a.join(b, ["query_id", "rank"]).withColumn("moved", F.col("tfidf_doc") != F.col("bm25_doc"))
