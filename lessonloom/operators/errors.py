"""Classes of error messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lessonloom.functions.lookups import pick

# What a message must contain for each class, tried in order,
# and the title and detail shown for it.
KEYWORDS = {
    "quota": ["rate limit", "429", "quota"],
    "network": ["network", "fetch", "failed to fetch"],
    "timeout": ["timeout", "504", "timed out"],
    "api_key": ["invalid", "401", "403", "api key", "unauthorized"],
}
TITLES = {
    "quota": "API quota reached",
    "network": "Network issue",
    "timeout": "Generation timed out",
    "api_key": "API key issue",
    "other": "Generation failed",
}
DETAILS = {
    "quota": "The AI service is busy. Wait a moment and retry — it usually resolves quickly.",
    "network": "Check your internet connection and retry.",
    "timeout": "The AI took too long to respond. Retrying almost always fixes this.",
    "api_key": "There's a problem with the API credentials. Please contact support.",
    "other": "Something went wrong on our end. Please try again.",
}


def error_class(col: Column) -> Column:
    """The first class any of whose keywords the message contains, else other."""
    low = F.lower(col)
    out = F.lit("other")
    for name, words in reversed(KEYWORDS.items()):
        hit = F.lit(False)
        for word in words:
            hit = hit | low.contains(word)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def error_counts(df: DataFrame, message: str = "message") -> DataFrame:
    """Messages per class, with its title and detail."""
    return (
        df.select(error_class(F.col(message)).alias("error_class"))
        .groupBy("error_class")
        .agg(F.count(F.lit(1)).alias("messages"))
        .withColumn("title", pick(F.col("error_class"), TITLES, TITLES["other"]))
        .withColumn("detail", pick(F.col("error_class"), DETAILS, DETAILS["other"]))
    )
