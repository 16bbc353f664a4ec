"""Exact ranks within groups that are too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lessonloom.session import written

_PART_BITS = 33  # how monotonically_increasing_id packs partition and row


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def global_rank(df: DataFrame, group: list[str], order: list[str], rank: str = "rank") -> DataFrame:
    """``df`` with each row's position from 0 within ``group`` by ``order``.

    A ranking window would put a whole group in one task. Here the rows are
    range partitioned on (group, order), so a group spreads over as many
    partitions as its size asks for, and written once with their position in
    the partition. The rows per (group, partition) are a table of at most
    groups + partitions rows; its running sums give each partition's start.
    Ranks therefore depend on neither the partition count nor the data size.
    That table is written first, so Spark knows its size and broadcasts it where it
    is small: the rows themselves are then shuffled once. Rows equal in group and
    order take their ranks in any order. A column of ``df`` named ``rank`` is replaced.
    """
    df = df.drop(rank) if rank not in (*group, *order) else df
    place, p = unused(df, "_place"), unused(df, "_p")
    shift = unused(df, "_shift")
    names = [unused(df, f"_g{i}") for i in range(len(group))]
    keys = [F.col(c) for c in [*group, *order]]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = written(ranged.withColumn(place, F.monotonically_increasing_id()), "rank")
    part: Column = F.shiftright(place, _PART_BITS)
    runs = placed.groupBy(*[F.col(c).alias(n) for c, n in zip(group, names)], part.alias(p)).agg(
        F.count(F.lit(1)).alias("_n"), F.min(place).alias("_first")
    )
    before = Window.partitionBy(*names).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    starts = written(
        runs.select(*names, p, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias(shift)), "starts"
    )
    same = part == F.col(p)
    for c, n in zip(group, names):
        same = same & F.col(c).eqNullSafe(F.col(n))
    ranked = placed.join(starts, same).withColumn(rank, F.col(place) + F.col(shift))
    return ranked.select(*df.columns, rank)
