"""Streaming jobs run until drained over the test tables, with their reference SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lessonloom.plans import bindings as b
from lessonloom.plans.lesson_queries import SECTIONS_SQL, ORACLES as LESSON_ORACLES
from lessonloom.schemas import GENERATE_REQUIRED
from lessonloom.session import fresh_dir
from lessonloom.sources.tables import read_table, stream_table
from lessonloom.streaming import jobs


# The log arrives in this many parts, and the second of them once more at the end.
PARTS = 4


def saved_count(spark, folder) -> DataFrame:
    """Five micro-batches over restarts of the query, one of them a re-delivery."""
    home = fresh_dir(spark, "count")
    schema = b.change_log(read_table(spark, folder, "events")).schema
    for part in [*range(PARTS), 1]:
        events = read_table(spark, folder, "events").where(F.col("event_id") % PARTS == part)
        b.change_log(events).write.mode("append").parquet(f"{home}/log")
        log = spark.readStream.schema(schema).parquet(f"{home}/log")
        jobs.drain([jobs.stream_saved_count(log, f"{home}/out", f"{home}/checkpoint")])
    return jobs.live_count(spark, f"{home}/out")


def validate(spark, folder) -> DataFrame:
    home = fresh_dir(spark, "validate")
    requests = b.requests(stream_table(spark, folder, "part"))
    jobs.drain(
        [jobs.stream_validate(requests, GENERATE_REQUIRED, f"{home}/out", f"{home}/checkpoint")]
    )
    columns = ", ".join(f"{name} {kind}" for name, kind in requests.dtypes)
    accepted, quarantined = jobs.read_validated(spark, f"{home}/out", columns)
    return accepted.selectExpr("request_id", "true AS valid", "CAST(NULL AS STRING) AS error").unionByName(
        quarantined.selectExpr("request_id", "false AS valid", "error")
    )


def sections(spark, folder) -> DataFrame:
    home = fresh_dir(spark, "sections")
    responses = b.responses(stream_table(spark, folder, "documents"))
    jobs.drain([jobs.stream_sections(responses, f"{home}/out", f"{home}/checkpoint")])
    return spark.read.schema(
        "doc_id BIGINT, teacherNotes STRING, visualPrompts STRING, studentReading STRING, "
        "status STRING, error STRING, rawText STRING"
    ).parquet(f"{home}/out")


QUERIES = {
    "stream_saved_count": saved_count,
    "stream_validate": validate,
    "stream_sections": sections,
}

ORACLES = {
    "stream_saved_count": f"""WITH {b.LOG_SQL}
        SELECT count(*) AS lessons FROM (
          SELECT arg_max(op, (ts, seq)) AS op FROM log GROUP BY id) WHERE op = 'save'""",
    "stream_validate": LESSON_ORACLES["validate_generate"].replace(
        "THEN 'Missing required fields' END",
        "THEN 'Missing required fields: ' || array_to_string(m, ', ') END",
    ),
    "stream_sections": f"""WITH {b.RESPONSES_SQL}, {SECTIONS_SQL}
        SELECT doc_id, CASE WHEN ok THEN notes END AS "teacherNotes",
          CASE WHEN ok THEN visual END AS "visualPrompts",
          CASE WHEN ok THEN reading END AS "studentReading",
          CASE WHEN ok THEN 'ok' ELSE 'failed' END AS status,
          CASE WHEN NOT ok THEN 'Failed to parse lesson sections from response' END AS error,
          CASE WHEN NOT ok THEN text END AS "rawText"
        FROM sectioned JOIN responses USING (doc_id)""",
}
