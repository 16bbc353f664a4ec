"""One key with a third of all rows, with broadcasts off and small skew thresholds."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from lessonloom.functions.lookups import left_match, lookup
from lessonloom.operators import ingest, lessons, tree

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.shuffle.partitions": "16",
}
ROWS = 60_000


@pytest.fixture
def big(spark):
    """Spark as it behaves when no side is small."""
    old = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


@pytest.fixture
def hot_tree(big, tmp_path):
    """Sub-strand 7 of strand 1 holds a third of the indicators."""
    frames = {
        "subjects": big.range(3).selectExpr("id", "concat('S', id) AS name", "concat('s', id) AS slug"),
        "strands": big.range(30).selectExpr("id", "id % 3 AS subject_id", "concat('T', id) AS name"),
        "sub_strands": big.range(600).selectExpr("id", "id % 30 AS strand_id", "concat('U', id) AS name"),
        "indicators": big.range(0, ROWS, 1, 8).selectExpr(
            "id", "IF(id % 3 = 0, 7, id % 600) AS sub_strand_id", "concat('C', lpad(id, 8, '0')) AS code",
            "concat('text ', sha2(string(id), 256)) AS text", "'Apply' AS blooms_level",
            "concat('B', 7 + id % 3) AS grade",
        ),
    }
    for name, df in frames.items():
        df.write.parquet(str(tmp_path / name))
    return {name: big.read.parquet(str(tmp_path / name)) for name in frames}


def final_plan(df) -> str:
    """The plan as adaptive execution left it, after running."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_sub_strand_is_split_in_the_join(hot_tree):
    rows = tree.tree_rows(hot_tree)
    assert "skew=true" in final_plan(rows)
    assert rows.count() == ROWS


def test_hot_strand_is_nested_in_bounded_parts(hot_tree):
    docs = tree.nest(hot_tree, page_size=500).collect()
    sizes = [sum(len(s.indicators) for s in d.subStrands) for d in docs]
    assert sum(sizes) == ROWS and max(sizes) <= 500
    hot = [d for d in docs if d.strand_id == 7]
    codes = [i.code for d in sorted(hot, key=lambda d: d.part) for s in d.subStrands for i in s.indicators
             if s.name == "U7"]
    assert codes == sorted(codes) and len(codes) > ROWS / 3


def test_counts_of_a_hot_key(hot_tree):
    counted = {r.sub_strand_id: r.indicators for r in tree.counts(hot_tree, "sub_strand").collect()}
    expected = Counter(7 if i % 3 == 0 else i % 600 for i in range(ROWS))
    assert counted == dict(expected)


def test_rows_without_a_key_do_not_meet(big):
    df = big.range(ROWS).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN '' WHEN id % 3 = 1 THEN CAST(NULL AS STRING) "
        "ELSE string(id) END AS k",
    )
    dim = big.range(ROWS).selectExpr("string(id) AS code", "id AS v")
    joined = left_match(df, dim.groupBy("code").agg(F.max("v").alias("v")), "k", "code")
    sizes = joined.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
    assert sizes[1] == ROWS and sizes[0] < ROWS / 4
    assert joined.where("v IS NOT NULL").count() == ROWS / 3
    assert joined.where("v IS NOT NULL AND v != id").count() == 0


def test_hot_lookup_key_is_split(big):
    pad = "sha2(string(id), 256) AS pad"
    df = big.range(0, ROWS, 1, 8).selectExpr("IF(id % 3 = 0, 'hot', string(id)) AS k", pad)
    dim = big.range(1000).selectExpr("string(id) AS code", "concat('v', id) AS v")
    out = lookup(df, dim, "k", "code", "v", "label")
    assert "skew=true" in final_plan(out)
    assert out.where("label = 'hot'").count() == ROWS / 3


def test_hot_ids_combine_before_the_shuffle(big):
    """Each task sends one row of the hot id, whatever its share."""
    log = big.range(0, ROWS, 1, 8).selectExpr(
        "IF(id % 3 = 0, 0, id) AS id", "IF(id % 7 = 0, 'delete', 'save') AS op",
        "timestamp_seconds(id) AS ts", "id AS seq",
    )
    for df in (lessons.latest_per_id(log), ingest.first_per_key(log, ["id"], ["ts"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("partial_m") == 1 and plan.count("Exchange") == 1
    last = lessons.latest_per_id(log).where("id = 0").first()
    assert last.seq == max(i for i in range(ROWS) if i % 3 == 0)
