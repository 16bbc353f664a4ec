"""Vector codes: one small codebook per part of a vector, searched by equal averages.

A vector is cut into equal parts, and each part is replaced by the index of the
nearest entry of its position's codebook. Entries are sorted by the sum of their
components. The squared distance of two vectors is at least the square of the
gap between their sums over their dimension, so the search starts at the part's
own sum and goes outward; a side is done once that bound strictly exceeds the
best distance. Entries at equal distance are all reached, and the lowest index
wins.

Training is a fixed number of rounds over all vectors: tasks sum the parts of
each entry, Spark adds the sums up, and the driver holds nothing but the
codebooks (parts x entries x components numbers). Arithmetic is in whole numbers
throughout.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lessonloom.llm.tasks import map_batches
from lessonloom.session import lasting, scratch, written

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
# Below this size squares of parts of up to 1,024 components fit 64 bits; larger numbers
# take Python's own, which have no bound.
_SMALL = 1 << 20
_ROWS = 4096


def whole_numbers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite numbers, as 64-bit integers where they are small."""
    doubles = values.astype(np.float64)
    if not doubles.size or np.abs(doubles).max() < _SMALL / scale:
        return np.floor(doubles * scale).astype(np.int64)
    exact = [math.floor(x * scale) if abs(x) < 2.0**900 else int(x) * scale for x in doubles.ravel().tolist()]
    return np.array(exact, dtype=object).reshape(doubles.shape)


def _fitted(numbers: np.ndarray) -> np.ndarray:
    """Python's numbers as 64-bit integers where all are small."""
    small = not numbers.size or max(abs(x) for x in numbers.ravel().tolist()) < _SMALL
    return numbers.astype(np.int64) if small else numbers


@dataclass
class Codebook:
    """The entries of one part position, in the order of their component sums."""

    entries: np.ndarray  # by index
    order: np.ndarray
    sums: np.ndarray  # ascending

    @classmethod
    def of(cls, entries: np.ndarray) -> Codebook:
        sums = entries.sum(axis=1)
        order = np.array(sorted(range(len(entries)), key=lambda i: (sums[i], i)), dtype=np.int64)
        return cls(entries, order, sums[order])

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of every part."""
        rows, width = parts.shape
        if parts.dtype != self.entries.dtype:
            parts = parts.astype(object)
        sums = parts.sum(axis=1)
        k = len(self.order)
        best = np.zeros(rows, dtype=parts.dtype)
        index = np.full(rows, -1, dtype=np.int64)
        right = np.searchsorted(self.sums, sums, side="left")
        left = right - 1
        open_rows = np.arange(rows)
        while len(open_rows):
            # the nearer of the two sides comes next, so both are done once it is
            lo, hi, s = left[open_rows], right[open_rows], sums[open_rows]
            below = np.abs(s - self.sums[np.maximum(lo, 0)])
            above = np.abs(self.sums[np.minimum(hi, k - 1)] - s)
            to_left = (lo >= 0) & ((hi >= k) | (below <= above))
            gap = np.where(to_left, below, above)
            found = index[open_rows] >= 0
            past = (lo < 0) & (hi >= k) | found & (gap * gap > best[open_rows] * width)
            open_rows, to_left = open_rows[~past], to_left[~past]
            if not len(open_rows):
                break
            at = np.where(to_left, left[open_rows], right[open_rows])
            left[open_rows] -= to_left
            right[open_rows] += ~to_left
            entry = self.order[at]
            apart = parts[open_rows] - self.entries[entry]
            distance = (apart * apart).sum(axis=1)
            old, old_index = best[open_rows], index[open_rows]
            better = (old_index < 0) | (distance < old) | ((distance == old) & (entry < old_index))
            won = open_rows[better]
            best[won], index[won] = distance[better], entry[better]
        return index, best


def _numbers(batch: pa.RecordBatch, at: int, width: int) -> np.ndarray:
    """Column ``at`` (lists without nulls) as a matrix of whole numbers, short ones filled with 0."""
    column = batch.column(at)
    sizes = np.diff(column.offsets.to_numpy())
    flat = whole_numbers(column.flatten().to_numpy(zero_copy_only=False))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=flat.dtype)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _slices(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield batch.slice(at, _ROWS)


def _partial_sums(books: list[Codebook], width: int):
    step = width // len(books)

    def run(batches):
        sums, counts = {}, {}
        for batch in _slices(batches):
            numbers = _numbers(batch, 0, width)
            for p, book in enumerate(books):
                parts = numbers[:, p * step : (p + 1) * step]
                index, _ = book.nearest(parts)
                for e in np.unique(index).tolist():
                    mine = parts[index == e]
                    sums[p, e] = [a + b for a, b in zip(sums.get((p, e), [0] * step), mine.sum(axis=0).tolist())]
                    counts[p, e] = counts.get((p, e), 0) + len(mine)
        yield _sums_batch(sums, counts)

    return run


def _sums_batch(sums: dict, counts: dict) -> pa.RecordBatch:
    keys = sorted(sums)
    columns = [
        pa.array([p for p, _ in keys], pa.int32()),
        pa.array([e for _, e in keys], pa.int32()),
        pa.array([counts[k] for k in keys], pa.int64()),
        pa.array([[str(x) for x in sums[k]] for k in keys], pa.list_(pa.string())),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", "sums"])


def _total_sums(batches):
    """One row per part and entry: sums are added as Python's numbers, which have no bound."""
    sums, counts = {}, {}
    for batch in batches:
        for p, e, n, values in zip(*(c.to_pylist() for c in batch.columns)):
            now = [int(x) for x in values]
            sums[p, e] = [a + b for a, b in zip(sums[p, e], now)] if (p, e) in sums else now
            counts[p, e] = counts.get((p, e), 0) + n
    yield _sums_batch(sums, counts)


_SUMS = "part INT, entry INT, n BIGINT, sums ARRAY<STRING>"


def _trained(vectors: DataFrame, entries: np.ndarray, rounds: int) -> np.ndarray:
    """``entries`` (part, entry, component) after ``rounds`` of assignment and averaging."""
    width = entries.shape[0] * entries.shape[2]
    for _ in range(rounds):
        books = [Codebook.of(e) for e in entries]
        partial = map_batches(vectors.select("embedding"), _partial_sums(books, width), _SUMS)
        totals = map_batches(partial.repartition("part", "entry"), _total_sums, _SUMS)
        entries = entries.astype(object)
        for row in totals.collect():  # at most parts x entries rows
            entries[row["part"], row["entry"]] = [int(x) // row["n"] for x in row["sums"]]
        entries = _fitted(entries)
    return entries


def _coded(books: list[Codebook], width: int):
    step = width // len(books) if books else 0

    def run(batches):
        for batch in _slices(batches):
            numbers = _numbers(batch, 2, width)
            found = [book.nearest(numbers[:, p * step : (p + 1) * step]) for p, book in enumerate(books)]
            codes = np.stack([index for index, _ in found], axis=1).astype(np.uint8)
            errors = [sum(int(d) for d in each) for each in zip(*(distance.tolist() for _, distance in found))]
            columns = [
                batch.column(0),
                batch.column(1),
                pa.array([row.tobytes().hex() for row in codes], pa.string()),
                pa.array([e if e < 1 << 63 else None for e in errors], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error"])

    return run


def usable(vector: Column) -> Column:
    """True for vectors that are neither null nor hold null or non-finite components."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def digest(entries: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for x in entries.ravel().tolist()).encode()).hexdigest()


def vector_codes(
    df: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every usable vector.

    Vectors that are null or hold null or non-finite components give no row. The
    codebooks start from the ``entries`` (at most 256) usable vectors with the
    smallest ids; null ids come last, and equal ids are ordered by their vectors.
    With fewer vectors there are fewer entries. Repeated rows count and are
    returned each. Vectors shorter than the longest one, or than a multiple of
    ``parts``, count as filled up with zeros. Null labels are one label. An
    ``error`` or ``label_error`` that does not fit 64 bits is null. Other columns
    are not read. An empty table gives no rows.
    """
    spark = df.sparkSession
    x = F.col(embedding)
    with scratch(spark):
        kept = df.where(usable(x)).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), x.alias("embedding"))
        vectors = written(kept, "vectors")
        longest = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
        step = -(-longest // parts)
        first = vectors.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).collect()
        start = np.zeros((len(first), parts * step))
        for at, row in enumerate(first):
            start[at, : len(row["embedding"])] = row["embedding"]
        book = whole_numbers(start).reshape(len(first), parts, step).transpose(1, 0, 2)
        if len(first):
            book = _trained(vectors, book, rounds)
        books = [Codebook.of(e) for e in book] if len(first) else []
        schema = f"vec_id {df.schema[vec_id].dataType.simpleString()}, label {df.schema[label].dataType.simpleString()}, code STRING, error BIGINT"
        coded = lasting(map_batches(vectors, _coded(books, parts * step), schema), "codes")
    totals = coded.groupBy(F.col("label").alias("_label")).agg(
        F.expr("try_cast(sum(cast(error as decimal(38,0))) as bigint)").alias("label_error")
    )
    met = coded.join(totals, F.col("label").eqNullSafe(F.col("_label")))
    return met.select("vec_id", "code", "error", "label_error", F.lit(digest(book)).alias("codebooks_sha256"))
