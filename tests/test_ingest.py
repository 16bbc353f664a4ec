"""Loading nested documents, insert-ignore and cascades."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lessonloom.operators import ingest, quality, tree
from lessonloom.plans import tree_queries
from lessonloom.session import scratch_scope
from lessonloom.sources.json_docs import read_standards

# Indicators per sub-strand of each strand, per subject: 7 subjects, 22 strands,
# 23 sub-strands, 67 indicators, of which 8 in 3 strands are Mathematics B7.
SHAPE = {
    "mathematics": [[2, 6], [4], [4]],
    "science": [[4], [3], [3]],
    "english-language": [[3], [3], [2]],
    "computing": [[4], [4], [2], [2]],
    "social-studies": [[3], [3], [3]],
    "rme": [[2], [2], [2]],
    "career-technology": [[2], [2], [2]],
}
MATHS_B7 = {"1.1": 2, "1.2": 2, "2.1": 2, "3.1": 2}


def documents():
    docs = []
    for s, (slug, strands) in enumerate(SHAPE.items(), 1):
        out = []
        for t, subs in enumerate(strands, 1):
            names = []
            for u, n in enumerate(subs, 1):
                b7 = MATHS_B7[f"{t}.{u}"] if slug == "mathematics" else n // 2
                grades = ["B7"] * b7 + ["B8"] * (n - b7)
                names.append(
                    {
                        "name": f"Sub {s}.{t}.{u}",
                        "indicators": [
                            {"code": f"{g}.{s}.{t}.{u}{i}", "text": f"Do {i}", "bloomsLevel": "Apply", "grade": g}
                            for i, g in enumerate(grades)
                        ],
                    }
                )
            out.append({"name": f"Strand {s}.{t}", "subStrands": names})
        docs.append({"subject": {"name": slug.title(), "slug": slug}, "strands": out})
    return docs


@pytest.fixture(scope="module")
def seed(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("seed") / "standards.json"
    path.write_text(json.dumps(documents(), indent=1))
    return read_standards(spark, str(path))


def test_level_counts(seed):
    tables = ingest.normalize_tree(seed)
    assert {k: df.count() for k, df in tables.items()} == {
        "subjects": 7, "strands": 22, "sub_strands": 23, "indicators": 67,
    }
    rows = tree.tree_rows(tables, "mathematics", "B7")
    assert rows.count() == 8
    assert rows.select("strand_id").distinct().count() == 3
    audit = quality.constraint_audit(tables | {"indicators": tables["indicators"].drop("source_order")})
    assert audit.where("violations > 0").count() == 0


def test_exploded_rows_are_not_stored(seed):
    with scratch_scope() as made:
        tables = ingest.normalize_tree(seed)
        assert tables["indicators"].count() == 67
    assert made == []


def test_standards_are_stored_compressed_in_files_of_bounded_rows(spark, sf, monkeypatch):
    monkeypatch.setattr(tree_queries, "JSON_ROWS", 11)
    with scratch_scope() as made:
        found = tree_queries.json_standards(spark, sf)
    assert [label for label, _ in made] == ["standards"]
    files = spark.read.format("binaryFile").load(made[0][1]).select("path").collect()
    assert all(f["path"].endswith(".json.gz") for f in files)
    lines = [len(spark.read.text(f["path"]).collect()) for f in files]
    assert max(lines) == 11 and sum(lines) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert sorted(map(str, found.collect())) == sorted(map(str, tree_queries.tree_normalize(spark, sf).collect()))


def test_equal_sibling_names_get_their_own_keys(spark):
    doc = documents()[1]
    for strand in doc["strands"]:
        strand["name"] = "Same"
    df = spark.read.schema(read_schema()).json(spark.sparkContext.parallelize([json.dumps(doc)]))
    strands = ingest.normalize_tree(df)["strands"]
    assert strands.select("id").distinct().count() == 3


def read_schema():
    from lessonloom.schemas import STANDARDS_DOC

    return STANDARDS_DOC


def test_inserting_twice_is_inserting_once(seed):
    docs = seed.withColumn("n", F.monotonically_increasing_id())
    none = ingest.normalize_tree(seed)["subjects"].where("false")
    first = ingest.insert_new_subtrees(none, docs, "n")
    assert first["indicators"].count() == 67
    again = ingest.insert_new_subtrees(first["subjects"], docs, "n")
    assert all(df.count() == 0 for df in again.values())
    part = ingest.insert_new_subtrees(first["subjects"].where("slug != 'rme'"), docs, "n")
    assert [part[k].count() for k in ("subjects", "strands", "indicators")] == [1, 3, 6]


def test_first_of_repeated_subject_and_code(spark):
    frame = spark.createDataFrame(
        [(2, "s", "c", "late"), (1, "s", "c", "early"), (3, "t", "c", "other")],
        "n INT, slug STRING, code STRING, text STRING",
    )
    docs = frame.selectExpr(
        "n",
        "named_struct('name', slug, 'slug', slug) AS subject",
        "array(named_struct('name', 'x', 'subStrands', array(named_struct('name', 'y', 'indicators',"
        " array(named_struct('code', code, 'text', text, 'bloomsLevel', 'Apply', 'grade', 'B7'))))))"
        " AS strands",
    )
    none = spark.createDataFrame([], "slug STRING")
    tables = ingest.insert_new_subtrees(none, docs, "n")
    assert tables["subjects"].count() == 2
    assert [r.text for r in tables["indicators"].collect()] == ["early"]


def test_insert_ignore_with_a_hot_key(spark):
    new = spark.range(3000).selectExpr("IF(id % 3 = 0, 0, id) AS k", "id AS pos", "id * 2 AS v")
    existing = spark.createDataFrame([(1,), (1,)], "k BIGINT")
    got = {r.k: (r.pos, r.v) for r in ingest.insert_ignore(existing, new, ["k"], ["pos"]).collect()}
    assert got[0] == (0, 0) and 1 not in got and len(got) == 2000


def test_cascade_delete(seed):
    tables = ingest.normalize_tree(seed)
    gone = tables["subjects"].where("slug = 'mathematics'").select("id")
    kept = ingest.cascade_delete(tables, gone)
    assert [kept[k].count() for k in ("subjects", "strands", "sub_strands", "indicators")] == [
        6, 19, 19, 51,
    ]


def test_stored_loads(spark, seed, tmp_path):
    from lessonloom.sources.store import load_standards, read_tree

    docs = seed.withColumn("n", F.monotonically_increasing_id())
    home = str(tmp_path / "tree")
    first = docs.where("subject.slug != 'rme'")
    load_standards(spark, first, home, "n", "a")
    load_standards(spark, docs, home, "n", "b")  # adds the one subject that is new
    sizes = {k: df.count() for k, df in read_tree(spark, home).items()}
    assert sizes == {"subjects": 7, "strands": 22, "sub_strands": 23, "indicators": 67}
    load_standards(spark, docs, home, "n", "b")  # the same load again changes nothing
    assert {k: df.count() for k, df in read_tree(spark, home).items()} == sizes
    stored = read_tree(spark, home)
    assert quality.constraint_audit(stored).where("violations > 0").count() == 0
    clash = docs.where("subject.slug = 'rme'").withColumn(
        "subject", F.struct(F.lit("Other").alias("name"), F.lit("other").alias("slug"))
    )
    load_standards(spark, clash, home, "n", "c")  # new subject, but every code is taken
    after = read_tree(spark, home)
    assert after["subjects"].count() == 8 and after["indicators"].count() == 67


def test_a_load_that_breaks_off_hides_nothing(spark, seed, tmp_path, monkeypatch):
    from lessonloom.sources import store

    docs = seed.withColumn("n", F.monotonically_increasing_id())
    home = str(tmp_path / "tree")
    whole = store.insert_new_subtrees

    def broken(*args, **how):
        return whole(*args, **how) | {"sub_strands": spark.range(1).selectExpr("raise_error('stop') AS id")}

    monkeypatch.setattr(store, "insert_new_subtrees", broken)
    with pytest.raises(Exception, match="stop"):
        store.load_standards(spark, docs, home, "n", "a")
    assert all(df.count() == 0 for df in store.read_tree(spark, home).values())
    monkeypatch.setattr(store, "insert_new_subtrees", whole)
    store.load_standards(spark, docs, home, "n", "b")
    sizes = {k: df.count() for k, df in store.read_tree(spark, home).items()}
    assert sizes == {"subjects": 7, "strands": 22, "sub_strands": 23, "indicators": 67}


def test_rows_without_a_key_are_rejected_not_merged(spark, tmp_path):
    from lessonloom.sources import store

    leaf = "named_struct('code', code, 'text', text, 'bloomsLevel', 'Apply', 'grade', 'B7')"
    docs = spark.createDataFrame(
        [(1, "s", None, "x"), (2, "t", None, "y"), (3, None, "c", "z"), (4, "u", "c", "w")],
        "n INT, slug STRING, code STRING, text STRING",
    ).selectExpr(
        "n",
        "named_struct('name', text, 'slug', slug) AS subject",
        "array(named_struct('name', 'x', 'subStrands', array(named_struct('name', 'y', 'indicators',"
        f" array({leaf}))))) AS strands",
    )
    home = str(tmp_path / "tree")
    store.load_standards(spark, docs, home, "n", "a")
    tree_read = store.read_tree(spark, home)
    assert [tree_read[k].count() for k in ("subjects", "indicators")] == [3, 1]
    rejected = {tuple(r) for r in store.read_rejected(spark, home).select("level", "parent", "name").collect()}
    assert rejected == {("indicators", "s", "x"), ("indicators", "t", "y"), ("subjects", None, "z")}


def test_parents_without_children_stay(spark):
    docs = spark.read.schema(read_schema()).json(
        spark.createDataFrame(
            [
                (json.dumps({"subject": {"name": "A", "slug": "a"}, "strands": []}),),
                (json.dumps({"subject": {"name": "B", "slug": "b"}, "strands": [
                    {"name": "S", "subStrands": []},
                    {"name": "T", "subStrands": [{"name": "U", "indicators": []}, {"name": "V", "indicators": None}]},
                ]}),),
            ],
            "value STRING",
        ).rdd.map(lambda r: r[0])
    )
    tables = ingest.normalize_tree(docs)
    assert {k: sorted(r.name for r in tables[k].collect()) for k in ("subjects", "strands", "sub_strands")} == {
        "subjects": ["A", "B"], "strands": ["S", "T"], "sub_strands": ["U", "V"],
    }
    assert tables["indicators"].count() == 0
