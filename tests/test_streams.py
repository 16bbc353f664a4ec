"""Streaming jobs give what their batch forms give, through repeats and restarts."""

from __future__ import annotations

import datetime as dt
import json

import pytest

from lessonloom.operators import lessons, quality, sections
from lessonloom.plans import bindings as b
from lessonloom.schemas import LESSON_REQUIRED
from lessonloom.sources.json_docs import read_lesson_bodies, stream_lesson_bodies
from lessonloom.sources.tables import read_table
from lessonloom.streaming import jobs, live_count

LOG = "id STRING, op STRING, ts TIMESTAMP_NTZ, seq BIGINT"


def _row(key, op, hour, seq):
    return (key, op, dt.datetime(2024, 1, 1, hour), seq)


BATCHES = [
    [_row("a", "save", 1, 1), _row("b", "delete", 1, 2)],
    [_row("a", "delete", 3, 4), _row("c", "save", 2, 3), _row("c", "save", 2, 3)],
    [_row("a", "save", 1, 1), _row("a", "delete", 3, 4)],  # delivered again
    [_row("a", "save", 2, 9), _row("b", "save", 4, 5)],  # the first is late
    [_row("zz", "delete", 5, 6)],  # unknown id
    [_row("a", "save", 6, 7), _row("c", "delete", 7, 8)],
]


@pytest.mark.parametrize("buckets", [1, 5])
def test_count_over_batches_and_restarts(spark, tmp_path, buckets):
    source, home = str(tmp_path / "log"), str(tmp_path / "out")
    seen, counts = [], []
    for rows in BATCHES:
        seen += rows
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(source)
        log = spark.readStream.schema(LOG).parquet(source)
        # a new query each time: state comes from the checkpoint and the tables
        jobs.drain([jobs.stream_saved_count(log, home, str(tmp_path / "cp"), buckets=buckets)])
        counts.append(jobs.live_count(spark, home).first().lessons)
        batch = lessons.lesson_state(spark.createDataFrame(seen, LOG))
        assert counts[-1] == batch.count()
    assert counts == [1, 1, 1, 2, 2, 2]
    final = jobs.read_state(spark, home, len(BATCHES) - 1)
    assert {(r.id, r.op) for r in final.collect()} == {
        ("a", "save"), ("b", "save"), ("c", "delete"), ("zz", "delete"),
    }
    kept = sorted(p.name for p in (tmp_path / "out" / "index").iterdir())
    assert kept == [f"epoch={len(BATCHES) - n}" for n in (2, 1)]


def feed(spark, tmp_path, batches, **how):
    """Runs the count over the batches one by one; the count after each."""
    source, home, counts = str(tmp_path / "log"), str(tmp_path / "out"), []
    for rows in batches:
        rows.coalesce(1).write.mode("append").parquet(source)
        log = spark.readStream.schema(LOG).parquet(source)
        jobs.drain([jobs.stream_saved_count(log, home, str(tmp_path / "cp"), **how)])
        counts.append(jobs.live_count(spark, home).first().lessons)
    return home, counts


def saves(spark, first, end):
    return spark.range(first, end).selectExpr(
        "CAST(id AS STRING) AS id", "'save' AS op", "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS ts", "id AS seq"
    )


def test_a_small_batch_reads_and_writes_only_its_buckets(spark, tmp_path, monkeypatch):
    read = []
    inner = live_count._read_runs
    monkeypatch.setattr(live_count, "_read_runs", lambda s, p, r: read.append([b for b in r if r[b]]) or inner(s, p, r))
    home, counts = feed(spark, tmp_path, [saves(spark, 0, 500), spark.createDataFrame([_row("7", "delete", 5, 900)], LOG)], buckets=16)
    assert counts == [500, 499]
    assert [len(buckets) for buckets in read] == [0, 1]
    assert len(list((tmp_path / "out" / "state" / "epoch=1" / "changed").glob("bucket=*"))) == 1
    assert spark.read.schema(LOG).parquet(f"{home}/state/epoch=1").count() == 1


def test_a_batch_writes_in_proportion_to_its_ids(spark, tmp_path):
    """Ids in all buckets of a large state: only they are written, and re-deliveries write nothing."""
    few = spark.createDataFrame([_row(str(i), "delete", 5, 900 + i) for i in range(0, 3000, 100)], LOG)
    home, counts = feed(spark, tmp_path, [saves(spark, 0, 3000), few, few], buckets=8)
    assert counts == [3000, 2970, 2970]
    assert spark.read.schema(LOG).parquet(f"{home}/state/epoch=1").count() == 30
    assert not (tmp_path / "out" / "state" / "epoch=2" / "changed").exists() or not list(
        (tmp_path / "out" / "state" / "epoch=2" / "changed").glob("bucket=*")
    )


def test_runs_merge_and_buckets_split(spark, tmp_path):
    batches = [saves(spark, 40 * n, 40 * n + 60) for n in range(9)]  # each overlaps the next
    batches.append(spark.createDataFrame([_row(str(i), "delete", 5, 9000 + i) for i in range(50)], LOG))
    batches.append(batches[3])  # delivered again
    home, counts = feed(spark, tmp_path, batches, buckets=2, most=100)
    assert counts == [60 + 40 * n for n in range(9)] + [330, 330]
    index = live_count._index(spark, home, len(batches) - 1)
    assert min(depth for depth, _ in index) >= 2 and sum(lessons for lessons, _ in index.values()) == 330
    assert all(sum(size for _, _, size in runs) <= 100 for _, runs in index.values())
    assert all(len(live_count._to_merge(runs)) == 0 for _, runs in index.values())
    assert sum(2.0**-depth for depth, _ in index) == 1  # the buckets part all hashes
    state = jobs.read_state(spark, home, len(batches) - 1)
    assert state.count() == 380 and state.where("op = 'save'").count() == 330
    valid = {live_count._run_path(home, b, run) for n in (1, 2) for b, (_, runs) in live_count._index(spark, home, len(batches) - n).items() for run in runs}
    stored = {str(p.parent) for p in (tmp_path / "out" / "state").rglob("*.parquet")}
    assert stored == valid


def test_a_batch_run_again_counts_once(spark, tmp_path):
    home, counts = feed(spark, tmp_path, [saves(spark, 0, 300), saves(spark, 200, 400)], buckets=2, most=120)
    assert counts == [300, 400]
    placed = saves(spark, 200, 400)
    for _ in range(2):
        live_count._settle(spark, home, placed, 1, 2, 120)
        assert jobs.live_count(spark, home).first().lessons == 400
        assert jobs.read_state(spark, home, 1).count() == 400


def test_tiers():
    assert [live_count._tier(n) for n in (0, 1, 3, 4, 15, 16, 64)] == [0, 0, 0, 1, 1, 2, 3]
    runs = [(0, True, 100), (1, False, 1), (2, False, 2), (3, False, 3)]
    assert live_count._to_merge(runs) == []
    assert live_count._to_merge([*runs, (4, False, 3)]) == [*runs[1:], (4, False, 3)]


def test_validation_stream(spark, tmp_path):
    bodies = [
        {"indicatorCode": "C", "subject": "S", "grade": "B7", "strand": "T",
         "teacherNotes": "n", "visualPrompts": "v", "studentReading": "r", "extra": 1},
        {"indicatorCode": "C", "subject": "", "grade": "B7", "strand": "T"},
    ]
    source = tmp_path / "in"
    source.mkdir()
    for i, body in enumerate(bodies):
        (source / f"{i}.json").write_text(json.dumps(body))
    stream = stream_lesson_bodies(spark, str(source))
    (source / "2.json").write_text("no json")
    jobs.drain([jobs.stream_validate(stream, LESSON_REQUIRED, str(tmp_path / "out"), str(tmp_path / "cp"))])
    batch_good, batch_bad = quality.validate(read_lesson_bodies(spark, str(source)), LESSON_REQUIRED)
    good, bad = jobs.read_validated(
        spark, str(tmp_path / "out"), ", ".join(f"{n} {t}" for n, t in stream.dtypes)
    )
    assert good.collect() == batch_good.collect()
    assert set(bad.collect()) == set(batch_bad.collect())
    assert {(r.error, r.malformed) for r in bad.collect()} == {
        ("Missing required fields: subject, teacherNotes, visualPrompts, studentReading", None),
        (quality.NOT_JSON, "no json"),
    }


def test_section_stream(spark, sf, tmp_path):
    documents = read_table(spark, sf, "documents")
    source = str(tmp_path / "docs")
    documents.repartition(3).write.parquet(source)
    stream = b.responses(
        spark.readStream.schema(documents.schema).option("maxFilesPerTrigger", 1).parquet(source)
    )
    jobs.drain([jobs.stream_sections(stream, str(tmp_path / "out"), str(tmp_path / "cp"))])
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {tuple(r) for r in sections.section_responses(b.responses(documents)).collect()}
