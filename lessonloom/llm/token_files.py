"""Token ids in Huffman-coded block files.

A file set has two Parquet tables. ``codebook`` holds (id, length): a canonical
length-limited Huffman code of the ids from their global counts, so codes
follow from lengths alone. ``blocks`` holds one row per block of whole
documents: shard (range of document ids), offset (ids before it in the shard),
the documents' ids and lengths, the bit payload, and the bit offset of every
STRIDE-th id. Blocks are decoded independently of each other, and within a
block all strides at once, by one table lookup per id.
"""

from __future__ import annotations

import json
import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lessonloom.llm.tasks import map_batches
from lessonloom.llm.text_hash import PIECE, Hashed
from lessonloom.session import fresh_dir, written

LIMIT = 18  # longest code in bits; more only if the ids could not all have a code
BLOCK_IDS, STRIDE = 1 << 16, 256
MEMO_WORDS = 1 << 20  # words whose ids a worker remembers
TEXTS_AT_ONCE = 512
WORDS_AT_ONCE = 1 << 12  # new words that are handed to the library in one call
PLAIN_END = 0x250  # the characters of Encoder.PLAIN lie below
_GAP, _LETTER, _DIGIT, _SIGN, _ODD = range(5)


class Encoder:
    """The library's ids of whole texts, each distinct word encoded once.

    For a tokenizer that normalises by NFC and lower case, splits by ``PRE_TOKEN``
    and works on bytes, which its file is checked for: a word's ids then do not
    depend on its neighbours. Texts of any other tokenizer are encoded whole. Words
    of plain Latin letters, digits and signs go to the library's model by pre-token,
    many in one call, which is told apart by the ids that end a pre-token; any other
    word goes through the whole tokenizer. Two generations of remembered words keep
    the frequent ones in bounded memory.
    """

    PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    # Characters on which normalising and splitting are the same everywhere.
    PLAIN = regex.compile("[!-~\u00a1-\u012f\u0131-\u024f]+")

    def __init__(self, path: str, end_id: int, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.pieces = Tokenizer(self.model)  # takes pre-tokens that are ready, a space between them
        self.pieces.pre_tokenizer = WhitespaceSplit()
        self.kind, self.end = kind, np.array([end_id], dtype=kind).tobytes()
        self.by_word = self._splits_by_word(path)
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.marks = {ord(m): self._ids(m) for m in ".,"}
        # How byte-level vocabularies spell bytes: printable ones as themselves.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}
        self.spelt = np.array([32 if b == 32 else ord(self.letters[b]) for b in range(256)], dtype="<u4")
        suffix = getattr(self.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.closes[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.kinds = np.array([self._kind(chr(c)) for c in range(PLAIN_END)] + [_ODD], dtype=np.int8)

    @classmethod
    def _splits_by_word(cls, path: str) -> bool:
        """Whether the tokenizer of this file is of the kind described above."""
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        steps = [
            {"type": "NFC"},
            {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
            {"type": "Lowercase"},
        ]
        splits = [
            {"type": "Split", "pattern": {"Regex": cls.PRE_TOKEN.pattern}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ]
        return (
            parts["normalizer"] == {"type": "Sequence", "normalizers": steps}
            and parts["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": splits}
            and parts["model"]["type"] == "BPE"
            and not parts["model"].get("dropout")
            and not parts.get("truncation")
            and not parts.get("padding")
            and all(t["content"].startswith("<|") for t in parts["added_tokens"])
        )

    def _ids(self, text: str) -> bytes:
        found = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.array(found, dtype=self.kind).tobytes()

    @classmethod
    def _kind(cls, c: str) -> int:
        """What a lower-cased character is to ``PRE_TOKEN``."""
        if c == "\n":
            return _GAP
        if c == "'" or not cls.PLAIN.fullmatch(c):  # an apostrophe may begin a pre-token of its own
            return _ODD
        return _LETTER if regex.match(r"\p{L}", c) else _DIGIT if regex.match(r"\p{N}", c) else _SIGN

    def _learn(self, words: list[bytes]) -> None:
        fresh: list[bytes] = []
        old, new = self.old, self.new
        for word, known in zip(words, map(old.get, words)):
            if known is None:
                mark = self.marks.get(word[-1])
                if mark is not None and word[-2:-1].isalpha():  # a sign after a letter stands alone
                    known = new.get(word[:-1]) or old.get(word[:-1])
                    if known is not None:
                        known += mark
            if known is None:
                fresh.append(word)
            else:
                new[word] = known
        for at in range(0, len(fresh), WORDS_AT_ONCE):
            self._learn_new(fresh[at : at + WORDS_AT_ONCE])

    def _learn_new(self, words: list[bytes]) -> None:
        new = self.new
        codes = np.frombuffer(b"\n".join([*words, b""]).decode("utf-8").lower().encode("utf-32-le"), dtype="<u4")
        kinds = self.kinds[np.minimum(codes, PLAIN_END)]
        ends = np.flatnonzero(kinds == _GAP) + 1
        odd = np.zeros(len(words), dtype=bool)
        odd[np.searchsorted(ends, np.flatnonzero(kinds == _ODD), side="right")] = True
        if odd.any():
            for n in np.flatnonzero(odd).tolist():
                new[words[n]] = self._alone(words[n])
            words = [word for word, is_odd in zip(words, odd.tolist()) if not is_odd]
            if not words:
                return
            keep = np.repeat(~odd, np.diff(ends, prepend=0))
            codes, kinds = codes[keep], kinds[keep]
            ends = np.flatnonzero(kinds == _GAP) + 1
        # Every digit, and every run of letters or signs, is a pre-token.
        begins = (kinds != np.concatenate([kinds[-1:], kinds[:-1]])) | (kinds == _DIGIT)
        begins[kinds == _GAP] = False
        counts = np.diff(np.cumsum(begins)[ends - 1], prepend=0)
        inner = begins.copy()
        inner[ends[:-1]] = inner[0] = False  # a gap is before these already
        spaced = np.insert(np.where(kinds == _GAP, np.uint32(32), codes).astype("<u4"), np.flatnonzero(inner), 32)
        text = spaced.tobytes().decode("utf-32-le")
        if not text.isascii():
            text = self.spelt[np.frombuffer(text.encode("utf-8"), dtype=np.uint8)].tobytes().decode("utf-32-le")
        found = np.array(self.pieces.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.int64)
        last = np.flatnonzero(self.closes[found])
        if len(last) != counts.sum():  # a vocabulary without such ids
            for word in words:
                new[word] = self._alone(word)
            return
        width = np.dtype(self.kind).itemsize
        to = ((last[np.cumsum(counts) - 1] + 1) * width).tolist()
        raw = found.astype(self.kind).tobytes()
        new.update(zip(words, [raw[a:b] for a, b in zip([0, *to], to)]))

    def _alone(self, word: bytes) -> bytes:
        text = word.decode("utf-8")
        if not self.PLAIN.fullmatch(text):
            return self._ids(text)
        ids: list[int] = []
        for part in self.PRE_TOKEN.findall(text.lower()):
            if not part.isascii():
                part = part.encode("utf-8").decode("latin-1").translate(self.letters)
            ids += [t.id for t in self.model.tokenize(part)]
        return np.array(ids, dtype=self.kind).tobytes()

    def _known(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word."""
        if len(self.new) > MEMO_WORDS // 2:
            self.old, self.new = self.new, {}
        new = self.new
        found = list(map(new.get, words))
        missing = [n for n, ids in enumerate(found) if ids is None]
        if missing:
            wanted = [words[n] for n in missing]
            self._learn(list(dict.fromkeys(wanted)))
            for n, word in zip(missing, wanted):
                found[n] = new[word]
        return found

    def _together(self, texts: list[bytes]) -> list[bytes]:
        """Ids of several lower-cased texts. Equal words are found by their hashes, and
        each is compared byte by byte with the one that stands for it."""
        h = Hashed([(n, t, 0, False) for n, t in enumerate(texts)], lower=False)
        distinct, which = np.unique(h.words, return_inverse=True)
        first = np.zeros(len(distinct), dtype=np.int64)
        first[which] = np.arange(len(which))  # any one of them
        sizes = h.ends - h.starts
        seen = np.flatnonzero(~h.blank).astype(np.int32)
        shift = np.repeat((h.starts[first][which] - h.starts).astype(np.int32), sizes)
        if (sizes[first][which] != sizes).any() or (h.raw.take(seen) != h.raw.take(seen + shift)).any():
            return [b"".join(self._known(t.split())) for t in texts]
        raw = h.raw.tobytes()
        found = self._known([raw[a:b] for a, b in zip(h.starts[first].tolist(), h.ends[first].tolist())])
        flat = np.frombuffer(b"".join(found), dtype=self.kind)
        each = np.fromiter(map(len, found), np.int64, len(found)) // np.dtype(self.kind).itemsize
        begins, many = np.cumsum(each) - each, each[which]
        ends = np.concatenate([[0], np.cumsum(many)])
        ids = flat[np.repeat(begins[which] - ends[:-1], many) + np.arange(ends[-1])]
        return [ids[a:b].tobytes() for a, b in zip(ends[h.firsts].tolist(), ends[h.firsts + h.counts].tolist())]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text and the end id. A text that might hold a special
        token is encoded in one piece, and so is every text if the tokenizer is of another kind."""
        if not self.by_word:
            return [self._ids(text or "") + self.end for text in texts]
        made: list[bytes] = [b""] * len(texts)
        group, held = [], 0

        def flush():
            for n, ids in zip([n for n, _ in group], self._together([d for _, d in group])):
                made[n] = ids + self.end

        for n, text in enumerate(texts):
            data = (text or "").encode("utf-8").lower()
            if b"<|" in data:
                made[n] = self._ids(text) + self.end
            elif len(data) >= PIECE:
                made[n] = b"".join(self._known(data.split())) + self.end
            else:
                if held + len(data) > PIECE:
                    flush()
                    group, held = [], 0
                group.append((n, data))
                held += len(data) + 1
        if group:
            flush()
        return made


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int, kind: str) -> Encoder:
    return Encoder(path, end_id, kind)


def token_ids(docs: DataFrame, doc_id: str, text: str, path: str, end_id: int = 1, small: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids`` with ids packed, in 16 bits if ``small``. Null texts are empty."""
    kind = "<u2" if small else "<u4"

    size = np.dtype(kind).itemsize

    def run(batches):
        encode = encoder(path, end_id, kind).encode
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                packed = encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(m) // size for m in packed], pa.int64()), pa.array(packed, pa.binary())],
                    names=["doc_id", "n_tokens", "ids"],
                )

    return map_batches(
        docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("_text")),
        run,
        "doc_id BIGINT, n_tokens BIGINT, ids BINARY",
    )


def id_counts(tokens: DataFrame, small: bool = True) -> DataFrame:
    """``id, n`` over all documents, summed within each task first."""
    kind = "<u2" if small else "<u4"

    def run(batches):
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            joined = b"".join(x.as_buffer() for x in batch.column(0))
            seen = np.bincount(np.frombuffer(joined, dtype=kind), minlength=len(total))
            seen[: len(total)] += total
            total = seen
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "n"])

    return map_batches(tokens.select("ids"), run, "id BIGINT, n BIGINT").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for positive counts (package-merge)."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, dtype=np.int64)
    limit = max(limit, int(n - 1).bit_length())
    order = np.argsort(counts, kind="stable")
    leaves = np.asarray(counts, dtype=np.float64)[order]
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        weights = np.concatenate([leaves, packages])
        rank = np.argsort(weights, kind="stable")
        levels.append(rank < n)
        weights = weights[rank]
        packages = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(axis=1)
    lengths, take = np.zeros(n, dtype=np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        leaf = int(is_leaf[:take].sum())
        lengths[:leaf] += 1
        take = 2 * (take - leaf)
    out = np.zeros(n, dtype=np.int64)
    out[order] = lengths
    return out


class Code:
    """Canonical code tables from ids and lengths."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        ids, lengths = ids[order].astype(np.int64), lengths[order].astype(np.int64)
        self.bits = int(lengths.max(initial=1))
        spans = np.int64(1) << (self.bits - lengths)
        starts = np.concatenate([[0], np.cumsum(spans)[:-1]]) if len(ids) else np.zeros(0, np.int64)
        top = int(ids.max(initial=0)) + 1
        self.code, self.length = np.zeros(top, dtype=np.uint64), np.zeros(top, dtype=np.int64)
        self.code[ids] = (starts >> (self.bits - lengths)).astype(np.uint64)
        self.length[ids] = lengths
        table = np.zeros(1 << self.bits, dtype=np.int64)
        filled = np.repeat(ids << 6 | lengths, spans)
        table[: len(filled)] = filled
        self.table = table

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits, and the bit offset of every STRIDE-th id."""
        lengths = self.length[ids]
        ends = np.cumsum(lengths)
        at = ends - lengths
        words = np.zeros(int(ends[-1]) // 64 + 2, dtype=np.uint64)
        code, word, room = self.code[ids], at >> 6, 64 - (at & 63) - lengths
        inside = np.where(
            room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64)
        )
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[first]] = np.bitwise_or.reduceat(inside, first)
        over = np.flatnonzero(room < 0)  # at most one code runs over the end of each word
        words[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
        size = (int(ends[-1]) + 7) // 8
        return words.astype(">u8").tobytes()[:size], at[::STRIDE]

    def decode(self, blocks: list[tuple[bytes, np.ndarray, int]]) -> list[np.ndarray]:
        """Ids of several blocks of (bits, offsets, number of ids); all strides in step."""
        base, begins, counts = 0, [], []
        for bits, offsets, n in blocks:
            begins.append(offsets + base * 8)
            counts.append(np.minimum(STRIDE, n - STRIDE * np.arange(len(offsets))))
            base += len(bits)
        raw = np.frombuffer(b"".join(b for b, _, _ in blocks) + b"\0" * 4, dtype=np.uint8).astype(np.uint32)
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        position, left = np.concatenate(begins), np.concatenate(counts)
        out = np.zeros((len(position), STRIDE), dtype=np.uint32)
        live = np.arange(len(position))
        for step in range(STRIDE):
            live = live[left[live] > step]
            if not len(live):
                break
            at = position[live]
            seen = window[at >> 3].astype(np.int64) << (at & 7) & 0xFFFFFFFF
            entry = self.table[seen >> (32 - self.bits)]
            out[live, step] = entry >> 6
            position[live] = at + (entry & 63)
        ids, row = [], 0
        for _, offsets, n in blocks:
            ids.append(out[row : row + len(offsets)].reshape(-1)[:n])
            row += len(offsets)
        return ids


_BLOCK = (
    "shard INT, seq INT, offset BIGINT, doc_ids ARRAY<BIGINT>, doc_lens ARRAY<BIGINT>, "
    "n_tokens BIGINT, checkpoints BINARY, payload BINARY"
)


def write_files(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 1, vocabulary: int = 49408) -> None:
    """Encode every text and write the file set to ``path``, documents in ascending id order.

    Null ids come first; rows with equal ids are ordered by their ids of tokens.
    """
    spark = docs.sparkSession
    small = max(vocabulary, end_id + 1) <= 1 << 16
    kind = "<u2" if small else "<u4"
    tokens = written(token_ids(docs, doc_id, text, tokenizer, end_id, small), "tokens")
    counted = sorted(id_counts(tokens, small).collect())  # one row per id of the vocabulary
    ids = np.array([r[0] for r in counted], dtype=np.int64)
    lengths = code_lengths(np.array([r[1] for r in counted], dtype=np.float64))
    book = [(int(i), int(n)) for i, n in zip(ids, lengths)]
    spark.createDataFrame(book, "id BIGINT, length INT").coalesce(1).write.parquet(f"{path}/codebook")

    def run(batches):
        code = Code(ids, lengths)
        shard, state = TaskContext.get().partitionId(), {"seq": 0, "offset": 0}

        def block(names, parts):
            sizes = [len(p) for p in parts]
            bits, offsets = code.encode(np.concatenate(parts))
            made = [shard, state["seq"], state["offset"], names, sizes, sum(sizes), offsets.astype("<u4").tobytes() if offsets[-1] < 2**32 else offsets.astype("<i8").tobytes(), bits]
            state["seq"] += 1
            state["offset"] += sum(sizes)
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(made, kinds)],
                names=["shard", "seq", "offset", "doc_ids", "doc_lens", "n_tokens", "checkpoints", "payload"],
            )

        names, parts, held = [], [], 0
        for batch in batches:
            for name, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                names.append(name)
                parts.append(np.frombuffer(packed, dtype=kind))
                held += len(parts[-1])
                if held >= BLOCK_IDS:
                    yield block(names, parts)
                    names, parts, held = [], [], 0
        if parts:
            yield block(names, parts)

    ranged = tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids").select("doc_id", "ids")
    map_batches(ranged, run, _BLOCK).write.parquet(f"{path}/blocks")


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (and ``ids``) decoded from a file set.

    ``start`` counts the ids of all documents before it: shards are ranges of
    document ids, so running sums over their totals, one row per shard, place
    each. The checksum covers the ids as little-endian unsigned 32-bit numbers.
    """
    book = sorted(spark.read.schema("id BIGINT, length INT").parquet(f"{path}/codebook").collect())
    ids = np.array([r[0] for r in book], dtype=np.int64)
    lengths = np.array([r[1] for r in book], dtype=np.int64)
    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks")

    def run(batches):
        code = Code(ids, lengths) if len(ids) else None
        for batch in batches:
            rows = batch.to_pylist()
            at = 0
            while at < len(rows):
                group, held = [], 0
                while at < len(rows) and (not group or held + rows[at]["n_tokens"] <= 16 * BLOCK_IDS):
                    group.append(rows[at])
                    held += rows[at]["n_tokens"]
                    at += 1
                yield decoded(code, group)

    def decoded(code, group):
        ready = []
        for r in group:
            wide = len(r["checkpoints"]) == 8 * -(-r["n_tokens"] // STRIDE)
            offsets = np.frombuffer(r["checkpoints"], dtype="<i8" if wide else "<u4").astype(np.int64)
            ready.append((r["payload"], offsets, r["n_tokens"]))
        columns = [[], [], [], [], [], []]
        for r, found in zip(group, code.decode(ready)):
            at = 0
            for name, size in zip(r["doc_ids"], r["doc_lens"]):
                raw = found[at : at + size].astype("<u4").tobytes()
                for c, v in zip(columns, (name, r["shard"], r["offset"] + at, size, zlib.crc32(raw), raw if with_ids else None)):
                    c.append(v)
                at += size
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds)],
            names=["doc_id", "shard", "at", "n_tokens", "ids_crc32", "ids"],
        )

    documents = map_batches(blocks, run, "doc_id BIGINT, shard INT, at BIGINT, n_tokens BIGINT, ids_crc32 BIGINT, ids BINARY")
    before = Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy(F.col("shard").alias("of")).agg(F.sum("n_tokens").alias("n"))
    starts = totals.select("of", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    placed = documents.join(starts, documents["shard"] == starts["of"])
    columns = ["doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"]
    return placed.select(*columns, *(["ids"] if with_ids else []))


def round_trip(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``docs`` as a file set in the shared folder and read it back."""
    path = fresh_dir(docs.sparkSession, "token-files")
    write_files(docs, path, tokenizer, doc_id, text)
    return read_documents(docs.sparkSession, path)
