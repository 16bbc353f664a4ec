"""Tables that grow with the input are not broadcast where Spark takes them for small."""

from __future__ import annotations

import random

import pytest

from lessonloom.llm import graph, simhash
from tests.llm.test_dedup import roots, variants

WORDS = [f"a{n}" for n in range(150)]


@pytest.fixture
def plans(spark, monkeypatch):
    """(label, plan) of every table that near dedup and components write, as planned before it ran."""
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    seen = []

    def recorded(write):
        def run(df, label):
            seen.append((label, df._jdf.queryExecution().executedPlan().toString()))
            return write(df, label)

        return run

    for module in (simhash, graph):
        for name in ("written", "lasting"):
            monkeypatch.setattr(module, name, recorded(getattr(module, name)))
    return seen


def sent(plan: str) -> list[str]:
    """What lies below each broadcast of a plan."""
    lines, found = plan.splitlines(), []
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            found.append("\n".join(lines[i:end]))
    return found


def stored(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "rows"))
    return spark.read.parquet(str(tmp_path / "rows"))


def test_near_dedup_broadcasts_no_visits_and_no_sets(spark, tmp_path, plans):
    rng = random.Random(7)
    made = [" ".join(f"v{rng.randrange(5000)}" for _ in range(60)) for _ in range(20)]
    # Texts of one passage that are alike in two ways only stay apart and meet anew.
    for g in range(3):
        made += variants(WORDS + [f"g{g}_{n}" for n in range(45)], 8, g)
    docs = stored(spark, tmp_path, list(enumerate(made)), "doc_id BIGINT, text STRING")
    sets = [set(simhash.shingles(t, 5)) for t in made]
    close = [(a, b) for b in range(len(sets)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = roots(range(len(sets)), close)
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()}
    assert kept == {i for i in root if root[i] == i} and len(kept) < len(made)
    below = [(label, x) for label, plan in plans for x in sent(plan)]
    assert below  # small tables still are
    assert not [label for label, x in below if "MapInArrow" in x]
    assert not [label for label, x in below if "fp:array<bigint>" in x]
    others = "struct<s:bigint,_row:bigint,n:int,at:int,root:bigint>"
    assert [plan for _, plan in plans if others in plan] and not [label for label, x in below if others in x]


def test_simhash_broadcasts_no_visits(spark, tmp_path, plans):
    rng = random.Random(8)
    made = [" ".join(f"v{rng.randrange(5000)}" for _ in range(60)) for _ in range(30)] + [" ".join(WORDS), " ".join([*WORDS, "a149"])]
    docs = stored(spark, tmp_path, list(enumerate(made)), "doc_id BIGINT, text STRING")
    found = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.simhash_components(docs).collect()}
    close = [(a, b) for b in found for a in range(b) if (found[a][0] ^ found[b][0]).bit_count() <= 2]
    root = roots(range(len(made)), close)
    assert close and {i: c for i, (_, c) in found.items()} == root
    edges = [plan for label, plan in plans if label == "edges" and "MapInArrow" in plan]
    assert edges and not [x for plan in edges for x in sent(plan) if "MapInArrow" in x]
