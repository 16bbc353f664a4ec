"""Near duplicates by MinHash bands and sequential Bayesian verification.

Every text's set of word shingles gets a MinHash signature. Texts that agree in a
whole band of it are candidates. Candidates are compared by their signatures,
one batch of hashes after the other: after k hashes with m agreements the
similarity has the posterior Beta(m + 1, k - m + 1) under an even prior, and a
pair is dropped once its chance of reaching the wanted similarity falls below
``MISS``. The pairs that survive all batches are verified on their whole sets.

Texts with equal sets are one class, so copies cost one row. In a bucket all
classes are first compared with one of them, which joins large groups without
all their pairs. Then classes that are still apart are compared with each other in
groups of bounded size that carry their signatures and sets: no table of pairs is
made, and a group returns only the links that join what it holds apart.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lessonloom.llm.graph import components
from lessonloom.llm.tasks import block_batches, map_batches
from lessonloom.session import lasting, scratch, with_rows, written

# At similarity 0.85 a pair agrees in no band with a chance of 2 in 10^8.
BANDS, BAND_ROWS = 30, 5
HASHES = BANDS * BAND_ROWS
BATCH, MISS = 25, 1e-8
BLOCK = 1024  # classes of a bucket that are compared with as many others in one group
_AT_ONCE = 1 << 18
_KNOWN_WORDS = 1 << 20
_M1, _M2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
_HALF = np.uint64(32)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word, 7)
        return found


def shingle_set(text: bytes | None, width: int, known: _WordHashes) -> np.ndarray:
    """Distinct hashes of the shingles of ``width`` words, ascending.

    A-Z are lower-cased and words split at ASCII white space. Fewer words are one
    shingle, no words none.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(known) > _KNOWN_WORDS:
        known.clear()
    width = min(width, len(w))
    h = np.full(len(w) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        h = (h ^ (h >> _HALF)) * _M1 + w[i : len(w) - width + 1 + i] * _M2
    h = (h ^ (h >> _HALF)) * _M1
    return np.unique(h ^ (h >> _HALF))


@lru_cache(maxsize=1)
def _family() -> tuple[np.ndarray, np.ndarray]:
    numbers = np.random.default_rng(20).integers(0, 1 << 64, size=(2, HASHES), dtype=np.uint64, endpoint=False)
    return numbers[0][:, None] | np.uint64(1), numbers[1][:, None]


def signature(found: np.ndarray) -> bytes:
    """The least value of each hash function over a set that is not empty, 16 mixed bits of each."""
    times, plus = _family()
    least = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), 1024):  # bounded memory on long texts
        np.minimum(least, (times * found[at : at + 1024] + plus).min(axis=1), out=least)
    mixed = (least ^ (least >> _HALF)) * _M1
    return (mixed >> np.uint64(48)).astype("<u2").tobytes()


@lru_cache(maxsize=4)
def least_agreements(percent: int, miss: float = MISS) -> list[tuple[int, int]]:
    """Per batch, the hashes compared by then and the agreements below which the
    posterior chance of the similarity being reached is under ``miss``.

    P(Beta(m + 1, k - m + 1) >= t) is the chance of at most m successes in k + 1
    draws at t.
    """
    t, found = percent / 100, []
    for k in range(BATCH, HASHES + 1, BATCH):
        chance, m = 0.0, -1
        while chance < miss:
            m += 1
            chance += comb(k + 1, m) * t**m * (1 - t) ** (k + 1 - m)
        found.append((k, m))
    return found


def plausible(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Positions of the signature pairs that no batch rules out."""
    alive, agreed, done = np.arange(len(a)), np.zeros(len(a), dtype=np.int64), 0
    for upto, least in least_agreements(percent):
        agreed[alive] += (a[alive, done:upto] == b[alive, done:upto]).sum(axis=1)
        alive, done = alive[agreed[alive] >= least], upto
        if not len(alive):
            break
    return alive


def _scanned(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """``doc_id, key, n, digest, signature`` per document; the last two are null for empty sets."""
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[doc_id].dataType),
            T.StructField("key", T.BinaryType()),
            T.StructField("n", T.LongType()),
            T.StructField("digest", T.BinaryType()),
            T.StructField("signature", T.BinaryType()),
        ]
    )

    def run(batches):
        known = _WordHashes()
        for batch in batches:
            n, digests, signatures = [], [], []
            for t in batch.column(2).to_pylist():
                found = shingle_set(t, width, known)
                n.append(len(found))
                some = len(found) > 0
                digests.append(hashlib.blake2b(found.astype("<u8").tobytes(), digest_size=16).digest() if some else None)
                signatures.append(signature(found) if some else None)
            columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return map_batches(docs.select(doc_id, _key(text), F.col(text).cast("binary")), run, schema)


def _key(text: str) -> Column:
    """Names a text: the bytes of its SHA-256."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)).alias("key")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """``c, s``: the shingle set of each class."""

    def run(batches):
        known = _WordHashes()
        for batch in batches:
            made = [np.sort(shingle_set(t, width, known).view(np.int64)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64()))], names=["c", "s"])

    return map_batches(texts.select("c", F.col("_t").cast("binary")), run, "c BIGINT, s ARRAY<BIGINT>")


def _size_allows(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _portions(at: np.ndarray, n: np.ndarray):
    """``at`` in runs whose sets hold about ``_AT_ONCE`` shingles in all."""
    part = np.cumsum(n[at]) // _AT_ONCE
    return np.split(at, np.flatnonzero(np.diff(part)) + 1)


def joining_links(lo: int, hi: int, rows: list, percent: int) -> pa.RecordBatch:
    """Links among the rows ``(band, block, class, size, root, signature, set)`` of a
    bucket that join different roots, and none that joins what they already do.

    A pair belongs to the first band it agrees in, and to the two blocks it lies in.
    """
    band, blocks = rows[0][0], np.array([r[1] for r in rows])
    c, n, root = (np.array([r[at] for r in rows], dtype=np.int64) for at in (2, 3, 4))
    marks = np.frombuffer(b"".join(r[5] for r in rows), "<u2").reshape(-1, HASHES)
    found = []
    for i in range(len(rows) - 1):
        others = np.arange(i + 1, len(rows))
        small, large = np.minimum(n[others], n[i]), np.maximum(n[others], n[i])
        others = others[(root[others] != root[i]) & (small * 100 >= large * percent) & ((lo == hi) | (blocks[others] != blocks[i]))]
        if not len(others):
            continue
        agree = (marks[others, : band * BAND_ROWS] == marks[i, : band * BAND_ROWS]).reshape(len(others), band, BAND_ROWS)
        others = others[~agree.all(axis=2).any(axis=1)]
        others = others[plausible(marks[others], np.broadcast_to(marks[i], (len(others), HASHES)), percent)]
        if not len(others):
            continue
        for some in _portions(others, n):
            sets = [rows[j][6] for j in some]
            met = np.concatenate(sets)
            at = np.minimum(np.searchsorted(rows[i][6], met), n[i] - 1)
            both = np.add.reduceat((rows[i][6][at] == met).astype(np.int64), np.cumsum([0, *map(len, sets[:-1])]))
            for j in some[both * 100 >= (n[some] + n[i] - both) * percent]:
                if root[j] != root[i]:
                    root[root == root[j]] = root[i]
                    found.append((min(c[i], c[j]), max(c[i], c[j])))
    columns = [pa.array([pair[k] for pair in found], pa.int64()) for k in (0, 1)]
    return pa.RecordBatch.from_arrays(columns, names=["x", "y"])


class _Verifier:
    """Turns candidate pairs of classes into links.

    The texts of all classes that share a bucket are fetched once, one per class.
    What is wanted of them grows with the input, so it is never broadcast.
    """

    def __init__(self, docs: DataFrame, text: str, classes: DataFrame, members: DataFrame, width: int, percent: int):
        self.classes, self.width, self.percent = classes, width, percent
        wanted = classes.join(members.select("c").distinct(), "c", "left_semi").select("c", "key")
        whole = docs.select(_key(text), F.coalesce(F.col(text), F.lit("")).alias("_t"))
        found = whole.join(wanted.hint("merge"), "key").groupBy("key").agg(F.first("c").alias("c"), F.first("_t").alias("_t"))
        self.texts = written(found.select("c", "_t"), "texts")

    def sets(self, wanted: DataFrame) -> DataFrame:
        """``c, s``: the shingle sets of the classes ``wanted``."""
        return written(_sets(self.texts.join(wanted.hint("merge"), "c", "left_semi"), self.width), "sets")

    def links(self, pairs: DataFrame) -> DataFrame:
        """``x, y`` of the pairs that no signature rules out and that reach the similarity."""
        with scratch(pairs.sparkSession):
            survivors = written(self._survivors(written(pairs.distinct(), "pairs")), "survivors")
            sets = self.sets(survivors.select(F.col("x").alias("c")).union(survivors.select("y")).distinct())
            met = survivors.join(sets.select(F.col("c").alias("x"), "s"), "x").join(
                sets.select(F.col("c").alias("y"), F.col("s").alias("t")), "y"
            )
            both = met.withColumn("both", F.size(F.array_intersect("s", "t")).cast("bigint"))
            either = F.size("s") + F.size("t") - F.col("both")
            return lasting(both.where(F.col("both") * 100 >= either * self.percent).select("x", "y"), "links")

    def links_within(self, apart: DataFrame) -> DataFrame:
        """``x, y``: links that join all classes of ``apart`` that are linked in a bucket.

        A bucket's classes are dealt to blocks by a hash, and every two blocks meet
        in a group of their own of about twice ``BLOCK`` rows.
        """
        percent = self.percent
        many = apart.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        placed = apart.join(many, "bucket").withColumn("i", F.pmod(F.xxhash64("c", "bucket"), F.col("blocks")).cast("int"))
        met = placed.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        sets = self.sets(apart.select("c").distinct())
        whole = met.join(self.classes.select("c", "signature"), "c").join(sets, "c")
        grouped = whole.select("bucket", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "b", "i", "c", "n", "root", "signature", "s")
        dealt = grouped.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")

        def run(batches):
            key, rows = None, []
            for batch in batches:
                columns = [column.to_pylist() for column in batch.columns[:-1]]
                ends, flat = batch.column(9).offsets.to_numpy(), batch.column(9).values.to_numpy()
                for at, (bucket, lo, hi, *rest) in enumerate(zip(*columns)):
                    if (bucket, lo, hi) != key:
                        if len(rows) > 1:
                            yield joining_links(key[1], key[2], rows, percent)
                        key, rows = (bucket, lo, hi), []
                    rows.append((*rest, flat[ends[at] : ends[at + 1]]))
            if len(rows) > 1:
                yield joining_links(key[1], key[2], rows, percent)

        with block_batches(apart.sparkSession):
            return written(map_batches(dealt, run, "x BIGINT, y BIGINT"), "links")

    def _survivors(self, pairs: DataFrame) -> DataFrame:
        percent = self.percent

        def run(batches):
            for batch in batches:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, HASHES) for i in (2, 3))
                yield batch.select(["x", "y"]).take(pa.array(plausible(a, b, percent)))

        signed = self.classes.select("c", "signature")
        met = pairs.join(signed.toDF("x", "a"), "x").join(signed.toDF("y", "b"), "y")
        return map_batches(met.select("x", "y", "a", "b"), run, "x BIGINT, y BIGINT")


def _apart(members: DataFrame, links: DataFrame) -> DataFrame:
    """``bucket, b, c, n, root`` of the buckets whose classes are not all joined by ``links``."""
    joined = components(links, "x", "y").select(F.col("node").alias("c"), "root")
    named = members.join(joined, "c", "left").withColumn("root", F.coalesce("root", "c"))
    open_ = named.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    return written(named.join(open_.select("bucket"), "bucket", "left_semi").select("bucket", "b", "c", "n", "root"), "apart")


def _class_links(docs: DataFrame, text: str, classes: DataFrame, width: int, percent: int) -> DataFrame:
    size = 2 * BAND_ROWS
    band = F.expr(f"substring(signature, b * {size} + 1, {size})")
    banded = classes.select("c", "n", "signature", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("b"))
    buckets = banded.select(F.xxhash64("b", band).alias("bucket"), "b", "c", "n")
    firsts = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("many"), F.min(F.struct("c", "n")).alias("first"))
    shared = written(buckets.join(firsts.where("many > 1"), "bucket"), "shared")
    verifier = _Verifier(docs, text, classes, shared, width, percent)

    others = shared.where(F.col("c") != F.col("first.c"))
    star = others.where(_size_allows(F.col("n"), F.col("first.n"), percent))
    links = verifier.links(star.select(F.col("first.c").alias("x"), F.col("c").alias("y")))
    # A bucket's first class has met the others, which may still be apart from each other.
    apart = _apart(others.where("many > 2").select("bucket", "b", "c", "n"), links)
    return links.union(verifier.links_within(apart))


def near_duplicate_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 85
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Two texts are linked if the intersection of their sets of ``width``-word
    shingles is at least ``percent`` hundredths of the union. ``component_id`` is
    the smallest id reachable over links, null if all of them are null; a row is
    ``kept`` if it has its component's id. Null, empty and wordless texts have no
    shingles and are linked with nothing, so their id is their component's.
    Repeated rows stay repeated. Other columns are not read. An empty table gives
    no rows. No row is left out and no bucket cut; a pair at just the wanted
    similarity is missed with a chance of about one in ten million.
    """
    spark = docs.sparkSession
    with scratch(spark):
        scanned = written(_scanned(docs, doc_id, text, width), "scanned")
        full = scanned.where("n > 0")
        classes = with_rows(
            full.groupBy("digest").agg(F.min("doc_id").alias("low"), F.first("key").alias("key"), F.max("n").alias("n"), F.first("signature").alias("signature")),
            "classes",
            "c",
        )
        roots = components(_class_links(docs, text, classes, width, percent), "x", "y")
        linked = roots.join(classes.select(F.col("c").alias("node"), "low"), "node")
        lowest = linked.groupBy("root").agg(F.min("low").alias("least"))
        per_class = linked.join(lowest, "root").select(F.col("node").alias("c"), "least")
        named = classes.select("c", "digest", "low").join(per_class, "c", "left")
        named = named.select("digest", F.coalesce("least", "low").alias("component_id"))
        alone = scanned.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
        rows = full.join(named, "digest").select("doc_id", "n", "component_id").union(alone)
        return lasting(
            rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")),
            "groups",
        )
