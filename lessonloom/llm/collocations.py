"""Phrase collocations by top-order marginalisation.

Each word of a piece starts one window: the word and the two that follow it
there, padded at the piece's end. These windows are the only thing counted in
the texts. Tasks combine theirs and send them on as blocks, dealt by a hash of
their first two words, so all windows of a pair meet. There a window too rare to
be a phrase loses its third word, and then its second, as it only counts for what
it begins with. A phrase occurs as often as windows begin with it: a ROLLUP over
the window's columns gives the counts of pairs, of words, and of all words of a
language.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lessonloom.llm.tasks import map_batches
from lessonloom.session import lasting, scratch, written

LEAST, SHARE, TOP = 10, 50, 2000
WORDS = ("w1", "w2", "w3")
_SLICE = 1 << 21  # bytes split at once, so at most 2^20 words
_HELD = 1 << 22  # windows combined before they leave
_BITS = 21  # of a word's number within a task's windows
_OUT, _BLOCKS_OUT = 1 << 16, 64
_TEXT_PER_BLOCK = 1 << 22  # bytes of text whose windows meet in one block
_MIX = np.uint64(0x9E3779B97F4A7C15)
_EDGE = b"\xff"  # in no UTF-8 text
_LETTERS = bytearray(range(256))
for _b in range(ord("A"), ord("Z") + 1):
    _LETTERS[_b] += 32
for _b in b".,;:!?\n\x0b\x0c\r":
    _LETTERS[_b] = _EDGE[0]
_LETTERS = bytes(_LETTERS)


def word_slices(data: bytes):
    """``(words, hold)`` of a text with marked edges, in bounded slices: the last
    ``hold`` words start no window there, since they come again in the next slice."""
    at, tail = 0, []
    while at < len(data):
        cut = min(at + _SLICE, len(data))
        if cut < len(data):
            back = data.rfind(b" ", at + 1, cut)
            cut = back if back > 0 else data.find(b" ", cut)
            cut = cut if cut > 0 else len(data)
        words = tail + data[at:cut].split()
        tail = [] if cut == len(data) else words[-2:]
        yield words, len(tail)
        at = cut


class WindowCounts:
    """Counts of the padded windows of many texts, by language and block."""

    def __init__(self, blocks: int):
        self.blocks = np.uint64(blocks)
        self._clear()

    def _clear(self):
        self.numbers = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.numbers[_EDGE]  # is 0, and so is what lies beyond a piece
        self.windows = defaultdict(list)
        self.held = 0

    def add(self, lang: str, texts: list[bytes]):
        """Count the texts of a language; yields batches when much is held."""
        data = _EDGE.join(texts).translate(_LETTERS).replace(_EDGE, b" \xff ")
        for words, hold in word_slices(data):
            ids = np.zeros(len(words) + 2, dtype=np.int64)
            ids[: len(words)] = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
            first, second, third = ids[: len(words) - hold], ids[1 : len(words) - hold + 1], ids[2 : len(words) - hold + 2]
            packed = first << 2 * _BITS | second << _BITS | np.where(second == 0, 0, third)
            self.windows[lang].append(packed[first != 0])
            self.held += len(packed)
            if self.held >= _HELD or len(self.numbers) >= 1 << (_BITS - 1):
                yield from self.flush()

    def flush(self):
        """Batches of ``lang, block, phrases, counts``: a line per window, and its count."""
        listed = [b"", *list(self.numbers)[1:]]
        words = pa.array(listed, pa.large_binary())
        marks = np.fromiter(map(xxhash.xxh64_intdigest, listed), np.uint64, len(listed))
        small = (1 << _BITS) - 1
        for lang, parts in self.windows.items():
            packed, counts = np.unique(np.concatenate(parts), return_counts=True)
            if not len(packed):
                continue
            first, second = packed >> 2 * _BITS, packed >> _BITS & small
            mixed = (marks[first] ^ (marks[second] >> np.uint64(7))) * _MIX + marks[second]
            block = (mixed ^ (mixed >> np.uint64(32))) % self.blocks
            order = np.argsort(block, kind="stable")
            first, second, third = (words.take(pa.array(x[order])) for x in (first, second, packed & small))
            nothing, space, end = (pa.scalar(x, pa.large_binary()) for x in (b"", b" ", b"\n"))
            lines = pc.binary_join_element_wise(first, second, pc.binary_join_element_wise(third, end, nothing), space)
            ends = np.frombuffer(lines.buffers()[1], np.int64)[: len(lines) + 1]
            letters, counts, block = memoryview(lines.buffers()[2]), counts[order], block[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
            squeezed = zstandard.ZstdCompressor(level=1)
            for at in range(0, len(cuts) - 1, _BLOCKS_OUT):
                spans = list(zip(cuts[at : at + _BLOCKS_OUT], cuts[at + 1 : at + 1 + _BLOCKS_OUT]))
                columns = [
                    pa.array([lang] * len(spans), pa.string()),
                    pa.array([int(block[i]) for i, _ in spans], pa.int64()),
                    pa.array([squeezed.compress(letters[ends[i] : ends[j]]) for i, j in spans], pa.binary()),
                    pa.array([squeezed.compress(counts[i:j].astype("<i8").tobytes()) for i, j in spans], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "block", "phrases", "counts"])
        self._clear()


def window_blocks(docs: DataFrame, text: str, lang: str, blocks: int) -> DataFrame:
    """Padded windows with their counts in part of the texts, packed by language and block."""

    def run(batches):
        counts = WindowCounts(blocks)
        for batch in batches:
            by_lang = defaultdict(list)
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_lang[name].append(data)
            for name, texts in by_lang.items():
                yield from counts.add(name, texts)
        yield from counts.flush()

    whole = F.make_valid_utf8(F.coalesce(F.col(text), F.lit(""))).cast("binary")
    named = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), whole.alias("text"))
    return map_batches(named, run, "lang STRING, block BIGINT, phrases BINARY, counts BINARY")


def _unpacked(phrases: bytes, counts: bytes):
    plain = zstandard.ZstdDecompressor()
    lines = plain.decompress(phrases).split(b"\n")  # the last line is empty
    return zip(lines, np.frombuffer(plain.decompress(counts), "<i8").tolist())


def trimmed(lang: str, windows: dict, least: int):
    """The windows of a whole block as batches of ``lang, w1, w2, w3, f``, their rare ends left out."""
    pairs, longer, kept = defaultdict(int), defaultdict(int), []
    for phrase, f in windows.items():
        pair, _, third = phrase.rpartition(b" ")
        if third and f >= least:
            kept.append((*pair.split(b" "), third, f))
            pairs[pair] += 0
            longer[pair] += f
        else:
            pairs[pair] += f
    rest = defaultdict(int)
    for pair, f in pairs.items():
        first, _, second = pair.partition(b" ")
        if second and f + longer.get(pair, 0) >= least:
            if f:
                kept.append((first, second, None, f))
        else:
            rest[first] += f
    kept += [(first, None, None, f) for first, f in rest.items()]
    for at in range(0, len(kept), _OUT):
        some = kept[at : at + _OUT]
        columns = [pa.array([row[i] for row in some], pa.binary()).cast(pa.string()) for i in range(3)]
        names = pa.array([lang] * len(some), pa.string())
        yield pa.RecordBatch.from_arrays([names, *columns, pa.array([row[3] for row in some], pa.int64())], names=["lang", *WORDS, "f"])


def windows(docs: DataFrame, text: str, lang: str, least: int) -> DataFrame:
    """``lang, w1, w2, w3, f``: windows whose sums over any prefix are those of all texts,
    without the third and second words of phrases that occur less than ``least`` times."""
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    packed = window_blocks(docs, text, lang, 1 + size // _TEXT_PER_BLOCK)
    dealt = packed.repartition("lang", "block").sortWithinPartitions("lang", "block")

    def run(batches):
        key, held = None, defaultdict(int)
        for batch in batches:
            for name, block, phrases, counts in zip(*(column.to_pylist() for column in batch.columns)):
                if (name, block) != key:
                    if key is not None:
                        yield from trimmed(key[0], held, least)
                    key, held = (name, block), defaultdict(int)
                for phrase, f in _unpacked(phrases, counts):
                    held[phrase] += f
        if key is not None:
            yield from trimmed(key[0], held, least)

    return map_batches(dealt, run, "lang STRING, w1 STRING, w2 STRING, w3 STRING, f BIGINT")


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST) -> DataFrame:
    """``lang, w1, w2, w3, f, level``: phrases of 3 words (level 0), 2 words (1) and
    words (3) that occur at least ``least`` times, and all words per language (7)."""
    longest = written(windows(docs, text, lang, least), "windows")
    sums = longest.rollup("lang", *WORDS).agg(F.sum("f").alias("f"), F.grouping_id().alias("level"))
    phrase = (
        (F.col("level") == 0) & F.col("w3").isNotNull()
        | (F.col("level") == 1) & F.col("w2").isNotNull()
        | (F.col("level") == 3)
    )
    return written(sums.where(phrase & (F.col("f") >= least) | (F.col("level") == 7)), "phrases")


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)) in decimals of 38 digits, which the products fit while
    counts stay below 10^15."""
    wide = [f"cast({x} as decimal(15,0))" for x in (a, left, right)]
    return F.expr(f"({wide[0]} * {wide[0]} * cast(1000000 as decimal(7,0))) div ({wide[1]} * {wide[2]})")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, share: int = SHARE, top: int = TOP
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases of 2 and 3 words.

    A-Z are lower-cased, pieces end at ``.,;:!?`` and line ends, words at spaces
    and tabs; no phrase crosses a piece. ``a`` counts the phrase, ``l`` and ``r``
    the two parts of its lowest-scoring cut (ties: the first), ``n`` all words.
    Phrases rarer than ``least``, and those inside a longer one that has at least
    ``share`` hundredths of their count, are left out. The first ``top`` by score,
    count and phrase are returned. A null language is ``und``, null texts are
    empty, repeated rows count each, invalid UTF-8 is replaced. Other columns are
    not read. An empty table gives no rows.
    """
    with scratch(docs.sparkSession):
        sums = phrase_counts(docs, text, lang, least)
        words = sums.where("level = 3").select("lang", "w1", "f")
        pairs = sums.where("level = 1").select("lang", "w1", "w2", "f")
        triples = sums.where("level = 0").select("lang", *WORDS, F.col("f").alias("a"))
        total = sums.where("level = 7").select("lang", F.col("f").alias("n"))

        two = (
            pairs.withColumnRenamed("f", "a")
            .join(words.toDF("lang", "w1", "l"), ["lang", "w1"])
            .join(words.toDF("lang", "w2", "r"), ["lang", "w2"])
        )
        longer = triples.select("lang", "w1", "w2", "a").union(triples.select("lang", "w2", "w3", "a"))
        longest = longer.groupBy("lang", "w1", "w2").agg(F.max("a").alias("inside"))
        two = two.join(longest, ["lang", "w1", "w2"], "left").where(
            F.coalesce(F.col("inside") * 100 < F.col("a") * share, F.lit(True))
        )
        two = two.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", _score("a", "l", "r").alias("score"))

        three = (
            triples.join(words.toDF("lang", "w1", "l1"), ["lang", "w1"])
            .join(pairs.toDF("lang", "w2", "w3", "r1"), ["lang", "w2", "w3"])
            .join(pairs.toDF("lang", "w1", "w2", "l2"), ["lang", "w1", "w2"])
            .join(words.toDF("lang", "w3", "r2"), ["lang", "w3"])
            .withColumn("s1", _score("a", "l1", "r1"))
            .withColumn("s2", _score("a", "l2", "r2"))
        )
        later = F.col("s2") < F.col("s1")
        three = three.select(
            "lang",
            F.concat_ws(" ", *WORDS).alias("phrase"),
            "a",
            F.when(later, F.col("l2")).otherwise(F.col("l1")).alias("l"),
            F.when(later, F.col("r2")).otherwise(F.col("r1")).alias("r"),
            F.least("s1", "s2").alias("score"),
        )
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        best = two.union(three).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        best = best.join(total, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
        return lasting(best, "collocations")
