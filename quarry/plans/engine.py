"""The search engine: corpus facts made once, queries as plans over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import highlight, make_snippet, tokenize
from quarry.operators import graph, ranking
from quarry.operators.index import Index
from quarry.operators.suggest import suggest
from quarry.plans.session import cut


class Engine:
    """Boot cuts what queries share: postings, lengths, authority."""

    def __init__(self, index: Index, authority: DataFrame | None = None):
        docs = index.documents
        self.spark: SparkSession = docs.sparkSession
        self.index = Index(docs, cut(index.postings), index.terms, cut(index.lengths), index.stats)
        if authority is None and "links" in docs.columns:
            authority = graph.pagerank(docs, graph.link_graph(docs))
        self.authority = authority

    def search(self, q: str, limit: int = 10, method: str = "bm25") -> DataFrame:
        """id, url, title, score, snippet (segments) of the best documents, best first. Text is joined to the best only."""
        if not 1 <= limit <= 50:
            raise ValueError("limit has to be from 1 to 50")
        terms = ranking.query_terms(self.spark, {"q": q})
        best = ranking.top(ranking.blend(ranking.relevance(self.index, terms, method), self.authority, queries=1), limit)
        words = tokenize(F.lit(q))
        rows = self.index.documents.join(F.broadcast(best), "doc_id")  # at most 50 rows
        title, url = (F.col(c) if c in self.index.documents.columns else F.lit("") for c in ("title", "url"))
        return rows.select(F.col("doc_id").alias("id"), url.alias("url"), title.alias("title"), "score", highlight(make_snippet(F.col("text"), words), words).alias("snippet")).orderBy(F.desc("score"), "id").withColumn("score", F.round("score", 4))

    def search_json(self, q: str, limit: int = 10, method: str = "bm25") -> DataFrame:
        """One row, ``response``. A query without tokens has an empty answer without method."""
        if method not in ranking.METHODS:
            raise ValueError(f"method has to be one of {ranking.METHODS}")
        head = [F.lit(q).alias("query"), tokenize(F.lit(q)).alias("tokens")]
        one = self.spark.range(1)
        if not one.select(F.size(head[1])).first()[0]:
            return one.select(F.to_json(F.struct(*head, F.lit(0).alias("count"), F.array().alias("results"))).alias("response"))
        found = self.search(q, limit, method).coalesce(1).agg(F.collect_list(F.struct("id", "url", "title", "score", "snippet")).alias("results"))
        return found.select(F.to_json(F.struct(*head, F.lit(method).alias("method"), F.size("results").alias("count"), "results")).alias("response"))

    def suggestions(self, limit: int = 5) -> DataFrame:
        return suggest(self.index, limit)

    def pages(self) -> DataFrame:
        """id, url, title, length, authority and its share of the largest, by authority."""
        rows = self.index.documents.join(self.authority.select("doc_id", F.col("score").alias("authority")), "doc_id", "left").fillna(0.0, ["authority"])
        most = rows.agg(F.max("authority").alias("most"))
        rows = rows.crossJoin(F.broadcast(most))  # one row
        bar = F.col("authority") / F.when(F.col("most") > 0, F.col("most")).otherwise(1.0)
        return rows.orderBy(F.desc("authority"), "doc_id").select(F.col("doc_id").alias("id"), "url", "title", "length", F.round("authority", 4).alias("authority"), bar.alias("bar"))

    def stats_json(self, suggestions: int = 5, pages: int = 100) -> DataFrame:
        """One row, ``response``: documents, terms, suggestions and the pages of most authority, as many as asked for."""
        told = self.suggestions(suggestions).coalesce(1).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "term"))), lambda x: x["term"]).alias("suggestions"))
        most = self.pages().limit(pages).coalesce(1).agg(F.array_sort(F.collect_list(F.struct((-F.col("bar")).alias("s"), "id", "url", "title", "length", "authority"))).alias("p"))
        page = lambda x: F.struct(*[x[c].alias(c) for c in ("id", "url", "title", "length", "authority")])
        row = self.stats().crossJoin(F.broadcast(told)).crossJoin(F.broadcast(most))  # one row each
        return row.select(F.to_json(F.struct("documents", "terms", "suggestions", F.transform("p", page).alias("pages"))).alias("response"))

    def stats(self) -> DataFrame:
        """One row: documents, terms."""
        return self.index.stats.select(F.col("n_docs").alias("documents")).crossJoin(F.broadcast(self.index.terms.agg(F.count("*").alias("terms"))))
