"""JSON sources: nested standards documents and request lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lessonloom.schemas import LESSON_BODY, LESSON_REQUEST, MALFORMED, STANDARDS_DOC


def read_standards(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Nested subject documents. A multi-line file is one split, so at volume
    write one document per line and pass ``multi_line=False``."""
    return spark.read.schema(STANDARDS_DOC).json(path, multiLine=multi_line)


def _lines(reader, schema: str):
    """Request lines; one that is not JSON keeps its text in ``MALFORMED``, all other
    fields being null, so that it can be told from a request without fields."""
    return reader.schema(f"{schema}, {MALFORMED} STRING").option("columnNameOfCorruptRecord", MALFORMED)


def read_lesson_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Lesson-save request bodies, one JSON object per line."""
    return _lines(spark.read, LESSON_BODY).json(path)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Generation request bodies, one JSON object per line."""
    return _lines(spark.read, LESSON_REQUEST).json(path)


def stream_lesson_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Lesson-save request bodies as a file stream."""
    return _lines(spark.readStream, LESSON_BODY).json(path)
