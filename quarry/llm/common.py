"""Expressions that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.session import cut, shared_dir, spread

__all__ = ["BLANKS", "WORD", "cut", "let", "read", "shared_dir", "word_array", "word_count"]

#: What separates words, as a Java regular expression; in Python ``bytes.split()`` cuts at the same bytes.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def word_array(text: Column) -> Column:
    """The words of a text, unchanged; none for a null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)``, with the value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
