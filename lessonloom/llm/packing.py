"""Packing documents into batches of like length.

Bucket boundaries have the least padding over the whole corpus: a dynamic
program over the global histogram of exact lengths. A corpus of T tokens has
at most sqrt(2 T) different lengths, so the histogram that reaches the driver,
in Arrow columns, is small whatever the corpus; the best cut before a length
never moves back as lengths grow, so the program halves its way through them.
Within a bucket documents take global ranks in an order hashed from their ids,
and every token budget's worth of consecutive ranks is a batch.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lessonloom.functions.ranks import global_rank, unused

WORD = r"[^\x20\x09-\x0D]+"


def token_count(text: Column) -> Column:
    """Words of a text and one end token; null and empty texts have the end token only."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint") + 1


def _least(best: np.ndarray, size: np.ndarray, docs: np.ndarray, tokens: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """For every end ``j`` from ``first`` on, the least padding with one more bucket over
    lengths ``i`` to ``j - 1``, and the smallest such ``i``.

    Middle ends are solved first; the cuts of the ends on either side then lie on
    either side of theirs. All middles of a level are solved together.
    """
    n = len(size)
    found, cut = np.full(n + 1, np.iinfo(np.int64).max // 4), np.zeros(n + 1, dtype=np.int64)
    low, high = np.array([first]), np.array([n])
    left, right = np.array([first - 1]), np.array([n - 1])
    while len(low):
        middle = (low + high) // 2
        widths = np.minimum(right, middle - 1) - left + 1
        starts = np.concatenate([[0], np.cumsum(widths)[:-1]])
        i = np.arange(widths.sum()) + np.repeat(left - starts, widths)
        j = np.repeat(middle, widths)
        cost = best[i] + size[j - 1] * (docs[j] - docs[i]) - (tokens[j] - tokens[i])
        least = np.minimum.reduceat(cost, starts)
        hits = np.flatnonzero(cost == np.repeat(least, widths))
        at = i[hits[np.searchsorted(hits, starts)]]
        found[middle], cut[middle] = least, at
        below, above = middle > low, middle < high
        low, high, left, right = (
            np.concatenate([low[below], middle[above] + 1]),
            np.concatenate([middle[below] - 1, high[above]]),
            np.concatenate([left[below], at[above]]),
            np.concatenate([at[below], right[above]]),
        )
    return found, cut


def boundaries(lengths, counts, buckets: int) -> list[int]:
    """The at most ``buckets`` boundaries (largest lengths) with the least padding.

    ``lengths`` ascend; ``counts`` are the documents of each. Of equally good
    boundaries the smallest are taken, from the last bucket down.
    """
    size, many = np.asarray(lengths, dtype=np.int64), np.asarray(counts, dtype=np.int64)
    n = len(size)
    if n == 0:
        return []
    buckets = min(buckets, n)
    docs = np.concatenate([[0], np.cumsum(many)])
    tokens = np.concatenate([[0], np.cumsum(size * many)])
    best = np.full(n + 1, np.iinfo(np.int64).max // 4)
    best[0] = 0
    cuts = []
    for b in range(1, buckets + 1):
        best, cut = _least(best, size, docs, tokens, b)
        cuts.append(cut)
    ends, j = [], n
    for cut in reversed(cuts):
        ends.append(int(size[j - 1]))
        j = int(cut[j])
    return ends[::-1]


def pack(
    docs: DataFrame,
    buckets: int = 8,
    budget: int = 65536,
    seed: int = 23,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``docs`` with ``n_tokens, bucket_len, batch, slot, padding``.

    A batch is named by ``bucket_len`` and ``batch``; it holds up to ``budget //
    bucket_len`` documents (one, if a document alone exceeds the budget) in
    slots from 0, each padded to ``bucket_len``. Columns of these names in
    ``docs`` are replaced. Repeated rows are packed one by one. An empty table
    gives no rows. ``docs`` are read more than once and should be stored if they are
    costly to make.
    """
    added = ["n_tokens", "bucket_len", "batch", "slot", "padding"]
    own = [c for c in docs.columns if c not in added]
    # Counting words again takes less than a further copy of all texts on disk.
    counted = docs.select(*own).withColumn("n_tokens", token_count(F.col(text)))
    order, rank = unused(counted, "_order"), unused(counted, "_rank")
    histogram = counted.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).orderBy("n_tokens").toArrow()
    ends = boundaries(histogram.column("n_tokens").to_numpy(), histogram.column("n").to_numpy(), buckets)
    bucket: Column = F.lit(ends[-1] if ends else 1).cast("bigint")
    for end in reversed(ends[:-1]):
        bucket = F.when(F.col("n_tokens") <= end, F.lit(end).cast("bigint")).otherwise(bucket)
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    placed = counted.withColumn("bucket_len", bucket).withColumn(order, F.md5(F.concat_ws("|", F.lit(str(seed)), name)))
    ranked = global_rank(placed, ["bucket_len"], [order, doc_id], rank)
    per_batch = F.greatest(F.lit(1).cast("bigint"), F.floor(F.lit(budget) / F.col("bucket_len")))
    return ranked.select(
        *own,
        "n_tokens",
        "bucket_len",
        F.floor(F.col(rank) / per_batch).alias("batch"),
        (F.col(rank) % per_batch).alias("slot"),
        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    )
