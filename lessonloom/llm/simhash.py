"""SimHash fingerprints and near-duplicate links by anchor-point covering.

Anchors are the codewords of a covering code on the fingerprint's bits: the
perfect binary Golay code (23 bits, covering radius 3) on bits 0-22 and again
on bits 23-45; the other bits are free. Within a block every value lies at
most 3 from exactly one codeword, its home. A fingerprint is replicated to
every anchor that exceeds the covering radius of the two blocks by no more
than the threshold in all: whatever differs from it in ``threshold`` bits has
its home among these. Fingerprints are compared at each anchor only. There are
2^24 anchors, so a bucket stays small until there are billions of distinct
fingerprints, and copies count once because fingerprints are made distinct
first. No link within the threshold is lost.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lessonloom.llm.graph import components
from lessonloom.llm.tasks import map_batches, set_aside
from lessonloom.session import lasting, scratch, with_rows, written

# Fixed values of the code: length, covering radius, generator polynomial.
BLOCK, RADIUS, GENERATOR = 23, 3, 0b110001110101
_CHECKS = 11
_MASK = (1 << BLOCK) - 1
_NEVER = 99
STAR_TURNS = 3
GROUP = 1024  # texts of a shingle that are compared with as many others in one group
MARK_BITS = 1024


def shingles(text: str | None, width: int):
    """Word shingles as bytes: A-Z lower-cased, words split at ASCII white space,
    ``width`` words joined by one space; fewer words give one shingle, none give none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    if len(words) < width:
        return [b" ".join(words)]
    return map(b" ".join, zip(*(words[i:] for i in range(width))))


def hashed(items, seed: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, items, repeat(seed)), dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes, as a signed 64-bit number; 0 for none."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):  # bounded memory on long texts
        part = hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = counts * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame, keys: list[str], text: str, make, kind: str) -> DataFrame:
    """``keys`` and a column ``fp`` holding ``make(text)``; keys pass through untouched."""
    schema = T.StructType([*[docs.schema[k] for k in keys], T.StructField("fp", T._parse_datatype_string(kind))])
    arrow = {"bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64()), "binary": pa.binary()}[kind]

    def run(batches):
        for batch in batches:
            made = pa.array([make(t) for t in batch.column(len(keys)).to_pylist()], arrow)
            columns = [batch.column(i) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*columns, made], names=[*keys, "fp"])

    return map_batches(docs.select(*keys, F.col(text).alias("_text")), run, schema)


@lru_cache(maxsize=4)
def _patterns(reach: int):
    """Per syndrome, the error patterns of weight up to RADIUS + reach and by how
    much each exceeds the radius, padded to equal length."""
    single = np.zeros(BLOCK, dtype=np.int64)
    for i in range(BLOCK):
        rest = 1 << i
        for bit in range(BLOCK - 1, _CHECKS - 1, -1):
            if rest >> bit & 1:
                rest ^= GENERATOR << (bit - _CHECKS)
        single[i] = rest
    lists: list[list[tuple[int, int]]] = [[] for _ in range(1 << _CHECKS)]
    for weight in range(RADIUS + reach + 1):
        for chosen in combinations(range(BLOCK), weight):
            syndrome = word = 0
            for i in chosen:
                syndrome ^= int(single[i])
                word |= 1 << i
            lists[syndrome].append((word, max(0, weight - RADIUS)))
    most = max(map(len, lists))
    words = np.zeros((1 << _CHECKS, most), dtype=np.int64)
    excess = np.full((1 << _CHECKS, most), _NEVER, dtype=np.int8)
    for s, found in enumerate(lists):
        for j, (word, over) in enumerate(found):
            words[s, j], excess[s, j] = word, over
    tables = []
    for shift in (0, 8, 16):
        values = np.zeros(256, dtype=np.int64)
        for v in range(256):
            for i in range(8):
                if v >> i & 1 and shift + i < BLOCK:
                    values[v] ^= single[shift + i]
        tables.append(values)
    return words, excess, tables


def anchors(fps: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``fps`` and anchors: every anchor within the covering radius
    plus ``reach``, the excess being shared by the two blocks. Reach 0 gives homes."""
    words, excess, tables = _patterns(reach)
    where, found = [], []
    for at in range(0, len(fps), 1024):
        part = fps[at : at + 1024]
        low, high = part & _MASK, (part >> BLOCK) & _MASK
        s = [tables[0][v & 255] ^ tables[1][v >> 8 & 255] ^ tables[2][v >> 16] for v in (low, high)]
        fits = excess[s[0]][:, :, None] + excess[s[1]][:, None, :] <= reach
        i, j, k = np.nonzero(fits)
        where.append(i + at)
        found.append((low[i] ^ words[s[0][i], j]) | ((high[i] ^ words[s[1][i], k]) << BLOCK))
    if not where:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(where), np.concatenate(found)


def at_anchors(fps: DataFrame, reach: int) -> DataFrame:
    """``fps`` (whose last column is ``fp``) replicated to its anchors."""
    names = fps.columns
    schema = T.StructType([*fps.schema.fields, T.StructField("anchor", T.LongType())])

    def run(batches):
        for batch in batches:
            values = batch.column(len(names) - 1).to_numpy(zero_copy_only=False)
            for at in range(0, len(values), 8192):
                where, found = anchors(values[at : at + 8192].astype(np.int64), reach)
                if len(where):
                    rows = batch.take(pa.array(where + at))
                    yield pa.RecordBatch.from_arrays(
                        [*rows.columns, pa.array(found)], names=[*names, "anchor"]
                    )

    return map_batches(fps, run, schema)


def fingerprint_links(fps: DataFrame, threshold: int) -> DataFrame:
    """``a, b`` (a < b) for all distinct fingerprints that differ in 1 to ``threshold`` bits.

    ``fps`` has one column ``fp`` of distinct non-null values. The home of the
    smaller one meets the visits of the larger one, so each link comes once.
    """
    homes = at_anchors(fps, 0).withColumnRenamed("fp", "a")
    visits = at_anchors(fps, threshold).withColumnRenamed("fp", "b")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold
    # Spark sizes visits as it does homes, whatever their number, so they are never broadcast.
    return homes.join(visits.hint("merge"), "anchor").where((F.col("a") < F.col("b")) & close).select("a", "b")


def simhash_components(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, threshold: int = 2, seed: int = 42
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row.

    The fingerprint sums the XXH64 hashes of the word shingles, repeats
    included. ``component_id`` is the smallest id reachable over links of at
    most ``threshold`` differing bits, null if the whole component has null
    ids. Null and wordless texts have fingerprint 0 and are linked like any
    other. Repeated rows stay repeated. Other columns are not read. An empty
    table gives no rows.
    """
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t"))
    fps = written(
        with_fingerprints(keyed, ["doc_id"], "_t", lambda t: majority(hashed(shingles(t, width), seed)), "bigint"),
        "fingerprints",
    )
    firsts = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = components(fingerprint_links(firsts.select("fp"), threshold))
    linked = roots.join(firsts, roots["node"] == firsts["fp"]).select("fp", "root", "first_id")
    lowest = linked.groupBy("root").agg(F.min("first_id").alias("low"))
    per_fp = linked.join(lowest, "root").select("fp", "low")
    named = firsts.join(per_fp, "fp", "left").select(
        "fp", F.coalesce("low", "first_id").alias("component_id")
    )
    return fps.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _shingle_sets(rows: DataFrame, width: int) -> DataFrame:
    return with_fingerprints(
        rows, ["_row"], "_t", lambda t: np.unique(hashed(shingles(t, width), 42)).view(np.int64), "array<bigint>"
    )


def _common(docs: DataFrame, text: str, width: int, share: int = 8, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that repeat most in every ``share``-th text, sorted, and their counts.

    They only order shingles, so that hot ones come last; results do not depend on them.
    """

    def run(batches):
        for batch in batches:
            for t in batch.column(0).to_pylist():
                made = np.unique(hashed(shingles(t, width), 42)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(made)], names=["s"])

    some = docs.where(F.pmod(F.xxhash64("_row"), F.lit(share)) == 0).select(F.col(text))
    counts = map_batches(some, run, "s BIGINT").groupBy("s").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    top = written(counts.orderBy(F.desc("c"), "s").limit(most), "common")
    s, c = top.agg(F.collect_list("s"), F.collect_list("c")).first()  # at most ``most`` numbers each
    found, times = np.array(s, np.int64), np.array(c, np.int64)
    order = np.argsort(found)
    return found[order], times[order]


def prefix(found: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first shingles of a set under one order for all sets, rare ones first: two
    sets at ``similarity`` or more share at least one of them."""
    keep = len(found) - int(np.ceil(similarity * len(found) - 1e-9)) + 1
    hot, times = common
    if len(hot):
        at = np.minimum(np.searchsorted(hot, found), len(hot) - 1)
        found = found[np.lexsort((found, np.where(hot[at] == found, times[at], 0)))]
    return found[:keep]


def _prefixes(docs: DataFrame, text: str, width: int, similarity: float) -> DataFrame:
    """``s, _row, n, at``: the prefix shingles of every text, the size of its set and
    their places in the order. Wordless texts have one row of size 0."""
    common = _common(docs, text, width)
    schema = "s BIGINT, _row BIGINT, n INT, at INT"

    def run(batches):
        for batch in batches:
            ids, sizes, made = [], [], []
            for row, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = np.unique(hashed(shingles(t, width), 42)).view(np.int64)
                made.append(prefix(found, common, similarity) if len(found) else np.zeros(1, np.int64))
                ids.append(row)
                sizes.append(len(found))
            each = [len(m) for m in made]
            columns = [
                np.concatenate(made) if made else np.zeros(0, np.int64),
                np.repeat(np.array(ids, np.int64), each),
                np.repeat(np.array(sizes, np.int32), each),
                np.concatenate([np.arange(k, dtype=np.int32) for k in each]) if each else np.zeros(0, np.int32),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["s", "_row", "n", "at"])

    return map_batches(docs.select("_row", F.col(text)), run, schema)


def _may_reach(n: Column, at: Column, m: Column, to: Column, similarity: float) -> Column:
    """False only if sets of ``n`` and ``m`` shingles whose first common one has places
    ``at`` and ``to`` cannot reach ``similarity``."""
    most = F.least(n - at, m - to)
    return most * (1 + similarity) >= (n + m) * similarity - 1e-6


def _verified(pairs: DataFrame, keyed: DataFrame, width: int, similarity: float) -> DataFrame:
    """``x, y`` of the ``pairs`` that reach ``similarity``, by their whole shingle sets."""
    with scratch(pairs.sparkSession):
        pairs = written(pairs.distinct(), "pairs")
        # These grow with the input, so they are never broadcast.
        wanted = pairs.select(F.col("x").alias("_row")).union(pairs.select("y")).distinct()
        sets = written(_shingle_sets(keyed.join(wanted.hint("merge"), "_row", "left_semi"), width), "shingles")
        links = (
            pairs.join(sets.select(F.col("_row").alias("x"), F.col("fp").alias("s")).hint("merge"), "x")
            .join(sets.select(F.col("_row").alias("y"), F.col("fp").alias("t")).hint("merge"), "y")
            .withColumn("both", F.size(F.array_intersect("s", "t")))
            .withColumn("any", F.size("s") + F.size("t") - F.col("both"))
            .where(F.col("both") >= F.lit(similarity) * F.col("any"))
        )
        return lasting(links.select("x", "y"), "links")


def fingerprint_pairs(keyed: DataFrame, width: int, threshold: int) -> DataFrame:
    """``x, y``: the texts that SimHash takes for near duplicates, to be verified.

    Each text is paired with the first one of its fingerprint, and the first text of
    each fingerprint with that of the smallest other one within ``threshold`` bits,
    found at the anchors. So there are at most two pairs per text.
    """
    make = lambda t: majority(hashed(shingles(t, width), 42))
    fps = written(with_fingerprints(keyed, ["_row"], "_t", make, "bigint"), "fingerprints")
    firsts = written(fps.groupBy("fp").agg(F.min("_row").alias("first")), "distinct")
    copies = fps.join(firsts, "fp").where(F.col("_row") != F.col("first")).select(F.col("first").alias("x"), F.col("_row").alias("y"))
    nearest = fingerprint_links(firsts.select("fp"), threshold).groupBy("b").agg(F.min("a").alias("a"))
    named = nearest.join(firsts.toDF("a", "x"), "a").join(firsts.toDF("b", "y"), "b")
    return copies.union(named.select(F.least("x", "y"), F.greatest("x", "y")))


def _rooted(places: DataFrame, links: DataFrame) -> DataFrame:
    """``places`` with ``root``, the smallest text that ``links`` join a text with."""
    joined = components(links, "x", "y").select(F.col("node").alias("_row"), "root")
    return places.join(joined, "_row", "left").withColumn("root", F.coalesce("root", "_row"))


def _apart(places: DataFrame, links: DataFrame) -> DataFrame:
    """``places`` with ``root``, without the shingles whose texts are all joined by
    ``links``; ``c`` is the number of texts of a shingle."""
    named = _rooted(places, links)
    ends = [F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("c")]
    mixed = named.groupBy("s").agg(*ends).where("low < high")
    return written(named.join(mixed.select("s", "c"), "s"), "apart")


def mark(found: np.ndarray) -> bytes:
    """Which of ``MARK_BITS`` cells the shingles of a set fall into, a bit per cell."""
    cells = np.zeros(MARK_BITS, dtype=bool)
    cells[found % MARK_BITS] = True
    return np.packbits(cells).tobytes()


def close_pairs(rows: list, within: bool, similarity: float) -> pa.RecordBatch:
    """``x, y``: the pairs among rows ``(block, _row, n, at, root, mark)`` of different
    roots that marks, sizes and places allow to reach ``similarity``; without
    ``within`` only those of different blocks.

    Every cell that one set fills and the other does not holds a shingle of the one
    alone, so the marks bound the intersection from above and rule out no link.
    """
    block, row, n, at, root = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(5))
    marks = np.frombuffer(b"".join(r[5] for r in rows), np.uint64).reshape(len(rows), -1)
    x, y = [], []
    for i in range(len(rows) - 1):
        least = (n[i + 1 :] + n[i]) * similarity - 1e-6
        room = np.minimum(n[i + 1 :] - at[i + 1 :], n[i] - at[i]) * (1 + similarity) >= least
        others = i + 1 + np.flatnonzero(room & (root[i + 1 :] != root[i]) & (within | (block[i + 1 :] != block[i])))
        alone = np.bitwise_count(marks[i] & ~marks[others]).sum(axis=1, dtype=np.int64)
        theirs = np.bitwise_count(marks[others] & ~marks[i]).sum(axis=1, dtype=np.int64)
        both = np.minimum(n[i] - alone, n[others] - theirs)
        others = others[both * (1 + similarity) >= least[others - i - 1]]
        x.append(np.minimum(row[others], row[i]))
        y.append(np.maximum(row[others], row[i]))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (x, y)], names=["x", "y"])


def _close(apart: DataFrame, keyed: DataFrame, width: int, similarity: float) -> DataFrame:
    """``x, y``: pairs of texts of ``apart`` that share a shingle there and that
    :func:`close_pairs` keeps.

    A shingle's texts are dealt to blocks by a hash, and every two blocks meet in a
    group of their own of about twice ``GROUP`` rows, so no group grows with the input.
    """
    places = apart.groupBy("_row", "n", "root").agg(F.collect_list(F.struct("s", "at", "c")).alias("places"))
    keys = ["_row", "n", "root", "places"]
    # These grow with the input, so they are never broadcast.
    texts = keyed.join(places.hint("merge"), "_row")
    marked = with_fingerprints(texts, keys, "_t", lambda t: mark(np.unique(hashed(shingles(t, width), 42))), "binary")
    each = marked.select("_row", "n", "root", F.col("fp").alias("mark"), F.inline("places"))
    blocks = F.ceil(F.col("c") / GROUP).cast("int")
    dealt = each.withColumn("i", F.pmod(F.xxhash64("_row", "s"), blocks).cast("int"))
    met = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), blocks - 1)))
    named = met.select("s", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "_row", "n", "at", "root", "mark")
    grouped = named.repartition("s", "lo", "hi").sortWithinPartitions("s", "lo", "hi")

    def run(batches):
        key, rows = None, []
        for batch in batches:
            for s, lo, hi, *rest in zip(*(column.to_pylist() for column in batch.columns)):
                if (s, lo, hi) != key:
                    if len(rows) > 1:
                        yield close_pairs(rows, key[1] == key[2], similarity)
                    key, rows = (s, lo, hi), []
                rows.append(rest)
        if len(rows) > 1:
            yield close_pairs(rows, key[1] == key[2], similarity)

    return map_batches(grouped, run, "x BIGINT, y BIGINT")


def _repeated(keyed: DataFrame, width: int, similarity: float) -> DataFrame:
    """The prefix rows whose shingle is in the prefix of more than one text. Repeated
    shingles are found on hashes alone, before the wider rows are shuffled."""
    with scratch(keyed.sparkSession):
        places = written(_prefixes(keyed, "_t", width, similarity), "prefixes")
        often = places.groupBy("s").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("s")
        return lasting(places.join(written(often, "often"), "s", "left_semi"), "repeated")


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    width: int = 5,
    similarity: float = 0.8,
    threshold: int = 2,
) -> tuple[DataFrame, DataFrame]:
    """``(rows, groups)``: ``docs`` with a ``_row`` number, and ``_row, root`` of every
    row that belongs to a group of near duplicates.

    Two texts are near duplicates if the Jaccard similarity of their word
    shingle sets is at least ``similarity``; groups are the components. Texts whose
    SimHash fingerprints are equal or differ in at most ``threshold`` bits are found
    at the anchors, verified on whole sets and joined first
    (``fingerprint_pairs``). Fingerprints of texts at that similarity may differ in
    more bits, so an exact search for the texts still apart follows. No link
    is lost: sets that similar share a shingle of their prefixes (``prefix``),
    and every pair that does is verified, unless sizes and places rule it out or
    it is already joined. In it each text is compared with one text of each of
    its prefix shingles, ``STAR_TURNS`` times anew with another one, which
    joins large groups without all their pairs; then all pairs of texts that are
    still apart meet in bounded groups (``_close``), and those that marks of their
    sets do not rule out are compared.
    Wordless texts are near duplicates of each other only.
    """
    rows = with_rows(docs, "documents")
    with scratch(docs.sparkSession):
        keyed = rows.select("_row", F.col(text).alias("_t"))
        groups = components(_links(keyed, width, similarity, threshold), "x", "y")
        return rows, lasting(groups.select(F.col("node").alias("_row"), "root"), "groups")


def _links(keyed: DataFrame, width: int, similarity: float, threshold: int) -> DataFrame:
    """Links that join every group of :func:`near_duplicates`."""
    alike = _verified(fingerprint_pairs(keyed, width, threshold), keyed, width, similarity)
    places = _rooted(_repeated(keyed, width, similarity), alike)
    firsts = places.groupBy("s").agg(F.min(F.struct("_row", "n", "at", "root")).alias("first"), F.count(F.lit(1)).alias("c"))
    shared = written(places.join(firsts, "s"), "shared")

    reach = _may_reach(F.col("n"), F.col("at"), F.col("first.n"), F.col("first.at"), similarity)
    star = shared.where((F.col("root") != F.col("first.root")) & reach)
    links = alike.union(_verified(star.select(F.col("first._row").alias("x"), F.col("_row").alias("y")), keyed, width, similarity))

    # A shingle's first text has met the others; they may still be apart from each other.
    met = shared.where((F.col("c") > 2) & (F.col("_row") != F.col("first._row"))).select("s", "_row", "n", "at")
    others = _apart(met, links)
    for turn in range(STAR_TURNS):
        # One member, another one per shingle, of the group with most texts there.
        order = F.struct(F.xxhash64("_row", "s", F.lit(turn)).alias("o"), "_row", "n", "at")
        each = others.groupBy("s", "root").agg(F.count(F.lit(1)).alias("c"), F.min(order).alias("o"))
        firsts = each.groupBy("s").agg(F.max(F.struct("c", "root", "o")).alias("f")).select("s", "f.root", "f.o").toDF("s", "r", "f")
        reach = _may_reach(F.col("n"), F.col("at"), F.col("f.n"), F.col("f.at"), similarity)
        # Repeated values take less in files than in memory, so ``others`` are never broadcast.
        star = others.hint("merge").join(firsts, "s").where((F.col("root") != F.col("r")) & reach)
        star = star.select(F.least("_row", "f._row").alias("x"), F.greatest("_row", "f._row").alias("y"))
        more = _verified(star, keyed, width, similarity)
        if more.isEmpty():
            break
        links = links.union(more)
        others = _apart(others.drop("root", "c"), links)
    return links.union(_verified(_close(others, keyed, width, similarity), keyed, width, similarity))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", **how) -> DataFrame:
    """``docs`` without all but the row with the smallest id of each near-duplicate group.

    Null ids come after all others; among equal ids the first row stays. The
    columns are those of ``docs``, whatever their names.
    """
    docs, own = set_aside(docs, "_row")
    rows, groups = near_duplicates(docs, **how)
    ids = rows.select("_row", F.col(doc_id).alias("_id")).join(groups, "_row")
    order = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_row").alias("_row"))
    kept = ids.groupBy("root").agg(F.min(order).alias("o")).select(F.col("o._row").alias("_row"))
    dropped = groups.select("_row").join(kept, "_row", "left_anti")
    return rows.join(dropped, "_row", "left_anti").select(*own)
