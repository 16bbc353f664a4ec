"""Exact top-k inner products by a three-phase uniform threshold.

A vector is cut into ``slices`` runs of components; each slice is a list of
its own in which an entry's local score is the inner product of that slice.
Phase 1 gathers the k best entries of every block of every list and scores the
best of each list whole; the k-th best score is a safe lower bound. Phase 2 sends each list the uniform cutoff (bound /
slices, above the list's smallest score) and collects all entries that reach
it: no vector of the answer can miss it in every list. Phase 3 resolves the
scores that are still partly unknown and could yet belong to the answer.

Queries and vectors meet as packed blocks: each block of vectors goes to one
group, each block of queries to all groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lessonloom.llm.tasks import block_batches, map_batches
from lessonloom.session import with_rows, written

VECTORS_PER_BLOCK, QUERIES_PER_BLOCK = 2048, 512
# Entries of each list that are scored whole for the bound, as a multiple of k. It
# changes how many entries phase 2 collects, never the result.
TRIED = 4
_EXACT = 2**53


def integer_vectors(df: DataFrame, vec_id: str, embedding: str, scale: int = 1024) -> DataFrame:
    """``_row, id, v``: components as floor(scale * x); vectors that are null or hold
    null or non-finite components are left out, and so are null ids."""
    x: Column = F.col(embedding)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    good = df.where(x.isNotNull() & F.col(vec_id).isNotNull() & ~F.coalesce(bad, F.lit(False)))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("bigint"))
    return with_rows(good.select(F.col(vec_id).cast("bigint").alias("id"), v.alias("v")), "vectors")


def _packed(df: DataFrame, size: int, slices: int, width: int, extra: list[str]) -> DataFrame:
    """Blocks of up to ``size`` rows, one row per block and slice: rows, ids, the
    slice's components and for queries the slice's least score, all as binary."""

    def run(batches):
        part, n, held = TaskContext.get().partitionId(), 0, []

        def blocks():
            rows = [r for r, _, _, _ in held]
            ids = [i for _, i, _, _ in held]
            whole = np.zeros((len(held), slices * width), dtype=np.int64)
            for at, (_, _, v, _) in enumerate(held):
                whole[at, : len(v)] = v
            for s in range(slices):
                cut = [e[s] for _, _, _, e in held] if extra else []
                yield (
                    s,
                    part * (1 << 32) + n,
                    np.array(rows, dtype="<i8").tobytes(),
                    np.array(ids, dtype="<i8").tobytes(),
                    np.ascontiguousarray(whole[:, s * width : (s + 1) * width]).astype("<i8").tobytes(),
                    np.array(cut, dtype="<i8").tobytes(),
                )

        def batch_of(made):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*made), (pa.int32(), pa.int64(), *[pa.binary()] * 4))],
                names=["slice", "block", "rows", "ids", "v", "cuts"],
            )

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for at in range(batch.num_rows):
                held.append((columns[0][at], columns[1][at], columns[2][at], columns[3][at] if extra else None))
                if len(held) == size:
                    yield batch_of(list(blocks()))
                    held, n = [], n + 1
        if held:
            yield batch_of(list(blocks()))

    schema = "slice INT, block BIGINT, rows BINARY, ids BINARY, v BINARY, cuts BINARY"
    return map_batches(df.select("_row", "id", "v", *extra), run, schema)


def _met(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Every query block beside every vector block of the same slice."""
    groups = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = queries.select(
        F.col("slice").alias("qs"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("qg"),
        F.col("rows").alias("q_rows"),
        F.col("ids").alias("q_ids"),
        F.col("v").alias("q"),
        "cuts",
    )
    dealt = vectors.drop("cuts").withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    return dealt.join(spread, (F.col("slice") == F.col("qs")) & (F.col("g") == F.col("qg"))).select(
        "slice", "rows", "ids", "v", "q_rows", "q_ids", "q", "cuts"
    )


def _product(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    most = max(1, np.abs(q).max(initial=0)) * max(1, np.abs(v).max(initial=0)) * max(1, q.shape[1])
    if most < _EXACT:  # every sum is exact in doubles, which multiply faster
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return q @ v.T


_ENTRY = "q_row BIGINT, q_id BIGINT, row BIGINT, id BIGINT, slice INT, part BIGINT, least BIGINT"


def _scan(met: DataFrame, width: int, k: int | None) -> DataFrame:
    """Local entries: the ``k`` best of each block per query, or without ``k`` all
    that reach the query's cutoff. ``least`` is the block's smallest score."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                rows, ids = (np.frombuffer(r[c], dtype="<i8") for c in ("rows", "ids"))
                q_rows, q_ids = (np.frombuffer(r[c], dtype="<i8") for c in ("q_rows", "q_ids"))
                scores = _product(
                    np.frombuffer(r["q"], dtype="<i8").reshape(-1, width),
                    np.frombuffer(r["v"], dtype="<i8").reshape(-1, width),
                )
                least = scores.min(axis=1)
                other = q_rows[:, None] != rows[None, :]
                if k is not None:
                    hidden = np.where(other, scores, np.iinfo(np.int64).min)
                    top = min(k, len(rows))
                    at = np.argpartition(-hidden if top < len(rows) else hidden, top - 1, axis=1)[:, :top]
                    i = np.repeat(np.arange(len(q_rows)), top)
                    j = at.reshape(-1)
                    keep = other[i, j]
                    i, j = i[keep], j[keep]
                else:
                    cuts = np.frombuffer(r["cuts"], dtype="<i8")
                    i, j = np.nonzero((scores >= cuts[:, None]) & other)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(q_rows[i]),
                        pa.array(q_ids[i]),
                        pa.array(rows[j]),
                        pa.array(ids[j]),
                        pa.array(np.full(len(i), r["slice"], dtype=np.int32)),
                        pa.array(scores[i, j]),
                        pa.array(least[i]),
                    ],
                    names=["q_row", "q_id", "row", "id", "slice", "part", "least"],
                )

    return map_batches(met, run, _ENTRY)


def _exact(pairs: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """``pairs`` (q_row, q_id, row, id) with their whole inner product as ``score``."""
    dot = F.aggregate(
        F.zip_with("qv", "vv", lambda a, b: F.coalesce(a * b, F.lit(0).cast("bigint"))),
        F.lit(0).cast("bigint"),
        lambda n, x: n + x,
    )
    return (
        pairs.join(vectors.select(F.col("_row").alias("row"), F.col("v").alias("vv")), "row")
        .join(queries.select(F.col("_row").alias("q_row"), F.col("v").alias("qv")), "q_row")
        .select("q_row", "q_id", "row", "id", dot.alias("score"))
    )


def top_k(
    df: DataFrame, is_query: Column, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 10, slices: int = 2
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows with the highest integer inner
    product for each query row, over all rows but the query's own.

    ``is_query`` is a condition on the column ``id``. Ties go to the smaller
    id. With fewer than ``k`` candidates all are returned. Vectors of unequal
    length are compared as if padded with zeros. Repeated rows take part one
    by one. An empty table gives no rows. Scores must fit 64 bits.
    """
    vectors = integer_vectors(df, vec_id, embedding)
    longest = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    width = max(1, -(-longest // slices))
    queries = vectors.where(is_query)
    lists = written(_packed(vectors, VECTORS_PER_BLOCK, slices, width, []), "lists")

    # Phase 1: local score lists, their least scores and the safe bound.
    asked = _packed(queries, QUERIES_PER_BLOCK, slices, width, [])
    with block_batches(df.sparkSession):
        local = written(_scan(_met(asked, lists), width, k), "local")
    least = local.groupBy("q_row", "slice").agg(F.min("least").alias("low"))
    lows = least.groupBy("q_row").agg(
        F.map_from_entries(F.collect_list(F.struct("slice", "low"))).alias("lows"), F.sum("low").alias("floor")
    )
    highest = Window.partitionBy("q_row", "slice").orderBy(F.desc("part"))
    tried = local.withColumn("n", F.row_number().over(highest)).where(F.col("n") <= TRIED * k)
    scored = _exact(tried.select("q_row", "q_id", "row", "id").distinct(), queries, vectors)
    best = Window.partitionBy("q_row").orderBy(F.desc("score"))
    ranked = scored.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k)
    reached = ranked.groupBy("q_row").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("reached"))
    bound = F.coalesce(F.col("reached") - F.col("floor"), F.lit(0).cast("bigint"))
    known = written(reached.join(lows, "q_row").select("q_row", "lows", bound.alias("bound")), "bounds")

    # Phase 2: the uniform cutoff, and all entries that reach it.
    cuts = F.transform(
        F.sequence(F.lit(0), F.lit(slices - 1)),
        lambda s: F.element_at("lows", s) + F.ceil(F.col("bound") / F.lit(slices)).cast("bigint"),
    )
    told = queries.join(known, queries["_row"] == known["q_row"]).select("_row", "id", "v", cuts.alias("cuts"))
    found = _scan(_met(_packed(told, QUERIES_PER_BLOCK, slices, width, ["cuts"]), lists), width, None)
    above = F.ceil(F.col("bound") / F.lit(slices)).cast("bigint")
    gathered = (
        found.join(known, "q_row")
        .groupBy("q_row", "q_id", "row", "id")
        .agg(
            F.sum(F.col("part") - F.element_at("lows", F.col("slice"))).alias("sum"),
            F.sum("part").alias("score"),
            F.count(F.lit(1)).alias("seen"),
            F.max(above).alias("above"),
            F.max("bound").alias("bound"),
        )
    )
    # What a list did not send is below the cutoff there.
    most = F.col("sum") + (F.lit(slices) - F.col("seen")) * F.greatest(F.col("above") - 1, F.lit(0))
    with block_batches(df.sparkSession):
        able = written(gathered.where(most >= F.col("bound")), "gathered")

    # Phase 3: exact scores of what is only partly known.
    partly = able.where(F.col("seen") < slices)
    resolved = _exact(partly.select("q_row", "q_id", "row", "id"), queries, vectors)
    whole = able.where(F.col("seen") == slices).select("q_row", "q_id", "row", "id", "score").union(resolved)
    order = Window.partitionBy("q_row").orderBy(F.desc("score"), "id", "row")
    return (
        whole.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select(F.col("q_id").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
    )
