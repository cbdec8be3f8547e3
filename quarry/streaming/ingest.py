"""Streaming ingestion: pages arriving in a folder, parsed and stored once for each content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.functions.html import parse
from quarry.functions.text import content_digest
from quarry.functions.urls import normalize_url, slugify


def page_stream(spark: SparkSession, folder: str, schema: str = "page_id long, url string, html string", per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def parsed_once(pages: DataFrame) -> DataFrame:
    """Pages of a stream, parsed, the first of each content; the state holds a digest for each content."""
    url = normalize_url(F.col("url"))
    rows = pages.select(url.alias("url"), parse(F.col("html"), url).alias("p"))
    rows = rows.select("url", slugify(F.col("url")).alias("filename"), "p.title", "p.text", "p.links", content_digest(F.col("p.text")).alias("digest"))
    return rows.dropDuplicates(["digest"])


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    return parsed_once(page_stream(spark, source)).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
