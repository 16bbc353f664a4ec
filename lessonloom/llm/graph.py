"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lessonloom.session import lasting, scratch, written


def _starred(edges: DataFrame, small: bool) -> DataFrame:
    """One star step over edges (u > v): hang neighbours below the smallest one.

    The large step moves the larger neighbours of every node, the small step
    the node itself and its smaller neighbours. The minimum per node combines
    before its shuffle; the join back is an ordinary equi-join whose hot keys
    adaptive execution can split.
    """
    if small:
        pairs = edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
    else:
        pairs = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(
            edges.select(F.col("v"), F.col("u"))
        )
    least = pairs.groupBy("x").agg(F.min("y").alias("low")).select(
        "x", F.least("x", "low").alias("low")
    )
    joined = pairs.join(least, "x")
    if small:
        moved = joined.select(F.col("y").alias("u"), F.col("low").alias("v")).union(
            least.select(F.col("x").alias("u"), F.col("low").alias("v"))
        )
    else:
        moved = joined.where(F.col("y") > F.col("x")).select(
            F.col("y").alias("u"), F.col("low").alias("v")
        )
    return moved.where(F.col("u") > F.col("v")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of ``links``; root is its component's smallest node.

    Alternates the two star steps until the edges stop changing, which takes
    about log(nodes) rounds even on a chain. Each round is written to the
    shared folder, so lineage stays short. Self links and nulls are ignored.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    with scratch(links.sparkSession):
        edges = written(
            links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
            .select(u.alias("u"), v.alias("v"))
            .distinct(),
            "edges",
        )
        state = None
        while True:
            now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if now == state or now[0] == 0:
                break
            state = now
            edges = written(_starred(_starred(edges, small=False), small=True), "edges")
        stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        return lasting(stars.union(edges.select(F.col("v"), F.col("v")).distinct()), "components")
