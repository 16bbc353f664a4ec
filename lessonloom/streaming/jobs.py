"""Streaming forms of the validation, sectioning and lesson-count jobs.

All run until the source is drained when ``available_now`` (the default here),
or continuously with a processing-time trigger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lessonloom.operators.quality import with_status
from lessonloom.operators.sections import section_responses
from lessonloom.streaming.live_count import live_count, read_state, stream_saved_count

__all__ = ["drain", "live_count", "read_state", "read_validated", "stream_saved_count", "stream_sections", "stream_validate"]


def _trigger(writer, every: str | None):
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def stream_validate(
    requests: DataFrame, required: list[str], path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Requests with ``valid`` and ``error`` in one sink, partitioned by ``valid``.

    The source is read and checked once; readers of either kind prune to its folder.
    """
    writer = (
        with_status(requests, required)
        .writeStream.format("parquet")
        .partitionBy("valid")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    return _trigger(writer, every).start()


def read_validated(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and quarantined rows with their error; ``schema`` is that of the requests."""
    rows = spark.read.schema(f"{schema}, error STRING, valid BOOLEAN").parquet(path)
    return rows.where("valid").drop("valid", "error"), rows.where("NOT valid").drop("valid")


def stream_sections(
    responses: DataFrame, path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Responses sectioned as they arrive, well-formed and failed alike."""
    writer = (
        section_responses(responses)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    return _trigger(writer, every).start()


def drain(queries: list[StreamingQuery]) -> None:
    """Wait until every query has worked off what was available."""
    for query in queries:
        query.awaitTermination()
