"""Tokens: lower case, split at whatever is neither a letter nor a number."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

PATTERN = r"[\p{IsAlphabetic}\p{N}]+"


def tokens(text: Column) -> Column:
    """The tokens of a text in order; none for null.  Runs without spaces, such as CJK, are one token."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(PATTERN), F.lit(0)), F.array().cast("array<string>"))


def query_tokens(spark: SparkSession, text: str) -> list[str]:
    """The tokens of a query, by the very expression that texts are split with."""
    return list(spark.range(1).select(tokens(F.lit(text)).alias("t")).first().t)
