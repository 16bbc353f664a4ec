"""Deletes and concurrent loads of the stored tree, the compacted lesson log, the search index."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lessonloom.operators import lessons, quality, search_index, tree
from lessonloom.schemas import LESSON_LOG, STANDARDS_DOC
from lessonloom.sources import commits, lesson_log, store
from tests.test_ingest import documents


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("docs") / "standards.json"
    path.write_text("\n".join(json.dumps(d) for d in documents()))
    return spark.read.schema(STANDARDS_DOC).json(str(path)).withColumn("n", F.monotonically_increasing_id())


def sizes(spark, home):
    return [df.count() for df in store.read_tree(spark, home).values()]


def ids_of(spark, home, *slugs):
    return store.read_tree(spark, home)["subjects"].where(F.col("slug").isin(*slugs)).select("id")


def test_deleted_subjects_go_whole_and_can_come_back(spark, docs, tmp_path):
    home = str(tmp_path / "tree")
    store.load_standards(spark, docs, home, "n", "a")
    before = store.read_tree(spark, home)
    maths = ids_of(spark, home, "mathematics").collect()[0]["id"]
    gone = spark.createDataFrame([(maths,), (maths,), ("unknown",), (None,)], "id STRING")
    assert store.delete_subjects(spark, home, gone, "d")
    assert sizes(spark, home) == [6, 19, 19, 51]
    assert [df.count() for df in before.values()] == [7, 22, 23, 67]  # a table read before is unchanged
    after = store.read_tree(spark, home)
    assert quality.constraint_audit(after).where("violations > 0").count() == 0
    store.load_standards(spark, docs, home, "n", "b")
    assert sizes(spark, home) == [7, 22, 23, 67]
    assert not store.delete_subjects(spark, home, gone, "d")  # a retry spares what was loaded since
    assert sizes(spark, home) == [7, 22, 23, 67]
    store.load_standards(spark, docs, home, "n", "a")  # repeated: it no longer brings what b has
    assert sizes(spark, home) == [7, 22, 23, 67]


def test_a_delete_that_breaks_off_is_not_seen(spark, docs, tmp_path, monkeypatch):
    home = str(tmp_path / "tree")
    store.load_standards(spark, docs, home, "n", "a")

    def broken(*args, **how):
        raise OSError("stop")

    monkeypatch.setattr(store, "append_commit", broken)
    with pytest.raises(OSError, match="stop"):
        store.delete_subjects(spark, home, ids_of(spark, home, "science"), "d")
    assert sizes(spark, home) == [7, 22, 23, 67]


def interleaved(monkeypatch, meanwhile):
    """Runs ``meanwhile`` once, just before the next commit is made."""
    inner, done = store.publish, []

    def publish(*args, **how):
        if not done:
            done.append(True)
            meanwhile()
        return inner(*args, **how)

    monkeypatch.setattr(store, "publish", publish)


@pytest.mark.parametrize("common", [True, False])
def test_interleaved_loads_leave_a_common_slug_once(spark, docs, tmp_path, monkeypatch, common):
    home = str(tmp_path / "tree")
    slug = F.col("subject.slug")
    mine = docs.where(slug.isin("science", "rme"))
    theirs = docs.where(slug.isin("rme", "computing") if common else slug.isin("computing"))
    attempts = []
    inner = store._attempt
    monkeypatch.setattr(store, "_attempt", lambda *a: attempts.append(a[4]) or inner(*a))
    interleaved(monkeypatch, lambda: store.load_standards(spark, theirs, home, "n", "theirs"))
    assert store.load_standards(spark, mine, home, "n", "mine") == 1
    assert attempts == (["mine", "theirs", "mine"] if common else ["mine", "theirs"])
    slugs = sorted(r.slug for r in store.read_tree(spark, home)["subjects"].collect())
    assert slugs == ["computing", "rme", "science"]
    stored = store.read_tree(spark, home)
    assert quality.constraint_audit(stored).where("violations > 0").count() == 0
    assert stored["indicators"].count() == 10 + 6 + 12


def test_a_delete_made_meanwhile_repeats_the_load(spark, docs, tmp_path, monkeypatch):
    """The load skipped a subject that was deleted before the load's commit."""
    home = str(tmp_path / "tree")
    store.load_standards(spark, docs, home, "n", "a")
    interleaved(monkeypatch, lambda: store.delete_subjects(spark, home, ids_of(spark, home, "rme"), "d"))
    store.load_standards(spark, docs, home, "n", "b")
    assert sizes(spark, home) == [7, 22, 23, 67]


def test_a_number_is_given_once(spark, tmp_path):
    home = str(tmp_path / "log")
    assert commits.history(spark, home) == []
    assert commits.publish(spark, home, 0, kind="load", name="a", attempt="x")
    assert not commits.publish(spark, home, 0, kind="load", name="b", attempt="y")
    assert commits.append_commit(spark, home, kind="load", name="c", attempt="z") == 1
    assert [(c["n"], c["name"]) for c in commits.history(spark, home)] == [(0, "a"), (1, "c")]
    assert [c["n"] for c in commits.history(spark, home, 0)] == [1]


def events(spark, rows):
    return spark.createDataFrame(rows, "id STRING, op STRING, t INT, seq BIGINT").selectExpr(
        "id", "op", "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, t) AS ts", "seq",
        *(f"CASE WHEN op = 'save' THEN concat(id, '-', seq) END AS {c.split()[0]}" for c in LESSON_LOG.split(", ")[4:]),
    )


def test_a_compacted_log_has_the_same_state(spark, tmp_path):
    home = str(tmp_path / "log")
    assert lesson_log.read_state(spark, home).count() == 0
    assert lesson_log.compact(spark, home) is None and lesson_log.vacuum(spark, home) == 0
    batches = [
        [("a", "save", 1, 1), ("b", "save", 1, 2), ("c", "save", 1, 3)],
        [("a", "delete", 5, 4), ("a", "save", 1, 1), ("b", "save", 2, 5)],
        [("a", "save", 3, 9), ("d", "save", 1, 6)],  # a's save is older than its delete
        [("c", "delete", 9, 7), ("e", "delete", 1, 8), ("b", "save", 2, 5)],
        [("a", "save", 7, 10), ("c", "save", 8, 11)],
    ]
    whole = events(spark, [row for batch in batches for row in batch])
    for at, batch in enumerate(batches):
        lesson_log.append(events(spark, batch), home)
        if at in (1, 3):
            assert lesson_log.compact(spark, home) is not None
            assert lesson_log.compact(spark, home) is None
        so_far = events(spark, [row for b in batches[: at + 1] for row in b])
        assert sorted(lesson_log.read_state(spark, home).collect()) == sorted(lessons.lesson_state(so_far).collect())
    read = lesson_log.read_latest(spark, home).inputFiles()
    assert len({f.split("/snapshots/")[1].split("/")[0] for f in read if "/snapshots/" in f}) == 1
    assert len({f.split("/parts/")[1].split("/")[0] for f in read if "/parts/" in f}) == 1
    assert lesson_log.vacuum(spark, home) == 5  # four appends, one snapshot
    assert sorted(lesson_log.read_state(spark, home).collect()) == sorted(lessons.lesson_state(whole).collect())
    assert lesson_log.append(events(spark, [("z", "save", 1, 1)]), home) == 7


def test_appends_made_during_a_compaction_stay(spark, tmp_path, monkeypatch):
    home = str(tmp_path / "log")
    lesson_log.append(events(spark, [("a", "save", 1, 1)]), home)
    inner = lesson_log.append_commit
    late = events(spark, [("a", "delete", 2, 2), ("b", "save", 1, 3)])

    def commit(*args, **how):
        monkeypatch.setattr(lesson_log, "append_commit", inner)
        lesson_log.append(late, home)
        return inner(*args, **how)

    monkeypatch.setattr(lesson_log, "append_commit", commit)
    assert lesson_log.compact(spark, home) == 2
    assert [r.id for r in lesson_log.read_state(spark, home).collect()] == ["b"]
    assert lesson_log.vacuum(spark, home) == 1
    assert [r.id for r in lesson_log.read_state(spark, home).collect()] == ["b"]


ROWS = "indicator_code STRING, indicator_text STRING"


@pytest.mark.parametrize("term", ["count", "COUNT on", "b7.1", "un", "é", "ünd", "zzz", "cou\nnt", " ", "t %_"])
def test_indexed_search_finds_what_a_scan_finds(spark, indexed, term):
    home, rows = indexed
    found = search_index.search_indexed(spark, home, term, ROWS).collect()
    assert sorted(map(str, found)) == sorted(map(str, tree.search(rows, term).collect()))


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    home = str(tmp_path_factory.mktemp("index") / "home")
    texts = ["Count to TEN", "Count on", "count back", "", None, "Gründe und Äpfel", "ab", "cou\nnt", "100 % of it_ %_"]
    rows = [(f"B{7 + i % 3}.{i}", t) for i, t in enumerate(texts)] + [(None, "count"), ("B7.1", "Count on")]
    rows += [(f"X{i}", f"filler {i % 7} line") for i in range(300)]
    table = spark.createDataFrame(rows, ROWS)
    search_index.build_index(table, home)
    return home, table


def test_a_search_tests_few_rows(spark, indexed):
    home, rows = indexed
    assert search_index.candidates(spark, home, "count on").count() == 2
    assert search_index.candidates(spark, home, "nowhere to be seen").count() == 0
    assert search_index.candidates(spark, home, "li") is None
    assert rows.count() == 311
