"""The inverted index as long-form tables: postings, terms, lengths, corpus statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import equal_runs, token_count, tokenize
from quarry.plans.session import cut


@dataclass
class Index:
    documents: DataFrame  #: doc_id, url, title, text, length, links (those that the source has)
    postings: DataFrame  #: term, doc_id, tf
    terms: DataFrame  #: term, df
    lengths: DataFrame  #: doc_id, length
    stats: DataFrame  #: one row: n_docs, avgdl
    whole: DataFrame | None = None  #: the postings as what reads all of them does best; of documents with unique ids also length


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id, tf) of (doc_id, text)."""
    return (sized_postings(docs) if unique_ids(docs) else merged_postings(docs)).select("term", "doc_id", "tf")


def unique_ids(docs: DataFrame) -> bool:
    return not docs.groupBy("doc_id").count().where("count > 1").take(1)


def sized_postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id, tf, length) of documents with unique ids. A row's tokens are sorted and taken as runs of equal ones, so that nothing is aggregated or shuffled."""
    rows = docs.select("doc_id", tokenize(F.col("text")).alias("tokens"))
    rows = rows.select("doc_id", F.size("tokens").cast("long").alias("length"), F.explode(equal_runs(F.col("tokens"))).alias("run"))
    term = F.substring_index("run", " ", 1)
    return rows.select(term.alias("term"), "doc_id", (F.length("run") / (F.length(term) + 1)).cast("long").alias("tf"), "length")


def merged_postings(docs: DataFrame) -> DataFrame:
    """The same without length where rows share an id: their tokens are counted together."""
    tokens = docs.select("doc_id", F.explode(tokenize(F.col("text"))).alias("term"))
    return tokens.groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", token_count(F.col("text")).alias("length"))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(sizes: DataFrame) -> DataFrame:
    """One row; the average of no documents is 0."""
    return sizes.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("avgdl"))


def build(docs: DataFrame) -> Index:
    # of a query's terms few tokens are left below the aggregation of merged postings; all postings are cheaper without it
    posted, sizes = merged_postings(docs), lengths(docs)
    whole = sized_postings(docs) if unique_ids(docs) else posted
    return Index(docs.join(sizes, "doc_id") if "length" not in docs.columns else docs, posted, document_frequency(whole), sizes, corpus_stats(sizes), whole)


#: Rows that ``with_ids`` gives to a range at least.
RANGE_ROWS = 50_000


def with_ids(rows: DataFrame, order: str) -> DataFrame:
    """Number rows from 0 in the order of a unique column, by ranges: the counts of the ranges are summed, not the rows gathered. The rows are written first, as
    the ranges are sampled: they would be made twice."""
    spark = rows.sparkSession
    rows = cut(rows)
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS)))
    ranged = cut(rows.repartitionByRange(parts, order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = sorted((r["_part"], r["count"]) for r in ranged.groupBy("_part").count().collect())  # one row a partition
    before, done = {}, 0
    for p, n in counts:
        before[p], done = done, done + n
    start = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("_part")] if before else F.lit(0)
    return ranged.withColumn("doc_id", (F.col("_at") + start).cast("long")).drop("_part", "_at")
