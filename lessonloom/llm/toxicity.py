"""Toxicity by a convolutional text classifier.

Every word is embedded as the sum of three rows of hashed tables: one for the
word, one each for its first four and six bytes, which inflected forms share.
A word that shares one row with a telling word by chance gets part of its
weight only. Filters
of widths 1 to 3 run over the words; each is max-pooled over the whole text and
a linear layer scores the pooled values. The embeddings start from the smoothed
log odds of each hash bucket. All weights are then trained together in numpy, the
embedding rows under the peaks of filters of every width by plain gradient steps,
the rest by Adam. Decision thresholds are set on rows apart from those, weighted to
the label shares of all labelled rows, per language as recognised from the text's
own function words, and scores are shifted so that each threshold comes to lie at
``CUT``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lessonloom.llm.tasks import map_batches
from lessonloom.llm.text_hash import Hashed, pieces
from lessonloom.llm.training import fitted, held_out, labelled_sample

CUT = 0.3
SAMPLE_ROWS = 4000  # most labelled rows that are learned from
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 17, 8, (1, 2, 3), 6
STEMS = (4, 6)
TABLES = 1 + len(STEMS)
FUNCTION_WORDS = {
    "en": "the and of to in is that was for with",
    "de": "der die das und ist nicht ein zu den von",
    "fr": "le la les et des est une dans pour qui",
    "es": "el los las y que del una por con para",
}
LANGUAGES = [*FUNCTION_WORDS, "other"]


@dataclass
class Model:
    rows: np.ndarray  # embedding rows that differ from zero
    values: np.ndarray
    filters: np.ndarray  # (DIM, sum of widths * FILTERS)
    bias: np.ndarray
    out: np.ndarray
    base: float
    thresholds: np.ndarray  # one logit per language

    def table(self) -> np.ndarray:
        full = np.zeros((TABLES * BUCKETS, DIM), dtype=np.float32)
        full[self.rows] = self.values
        return full


def _language_hashes() -> tuple[np.ndarray, np.ndarray]:
    words, which = [], []
    for n, listed in enumerate(FUNCTION_WORDS.values()):
        h = _hashed([(0, listed.encode(), 0, False)]).words
        words.append(h)
        which.append(np.full(len(h), n))
    words, which = np.concatenate(words), np.concatenate(which)
    order = np.argsort(words)
    return words[order], which[order]


def _buckets(h: Hashed) -> np.ndarray:
    """Table rows of every word, one column per table."""
    kinds = [h.words, *(h.stems(n) for n in STEMS)]
    mask = np.uint64(BUCKETS - 1)
    return np.stack([(k & mask).astype(np.int32) + n * BUCKETS for n, k in enumerate(kinds)], axis=1)


def _hashed(group) -> Hashed:
    return Hashed(group, lower=True, bare=True)


def _pieces(texts):
    return pieces(texts, overlap=max(WIDTHS) - 1, bare=True)


def _responses(table, filters, ids, counts):
    """Filter responses at every word, texts kept apart by two zero vectors."""
    place = np.arange(len(ids)) + 2 * np.repeat(np.arange(len(counts)), counts)
    vectors = np.zeros((len(ids) + 2 * len(counts) + 2, DIM), dtype=np.float32)
    vectors[place] = sum(table[ids[:, n]] for n in range(TABLES))
    product = vectors @ filters
    found, at = [], 0
    for width in WIDTHS:
        total = 0
        for k in range(width):
            total = total + product[place + k, at : at + FILTERS]
            at += FILTERS
        found.append(total)
    return np.concatenate(found, axis=1), vectors, place


def logits(model: Model, table: np.ndarray, texts: list, speech=None) -> tuple[np.ndarray, np.ndarray]:
    """Raw logits and language numbers of whole texts."""
    speech = speech or _language_hashes()
    pooled = np.full((len(texts), len(WIDTHS) * FILTERS), -np.inf, dtype=np.float32)
    tongue = np.zeros((len(texts), len(FUNCTION_WORDS)), dtype=np.int64)
    for group in _pieces(texts):
        h = _hashed(group)
        full = h.counts > 0
        if not full.any():
            continue
        found, _, _ = _responses(table, model.filters, _buckets(h), h.counts)
        number = np.repeat(np.arange(len(h.counts)), h.counts)
        left = (h.firsts + h.counts)[number] - np.arange(len(h.words))
        for n, width in enumerate(WIDTHS):
            # A window that passes the end of a piece is met whole in the next one.
            found[h.more[number] & (left < width), n * FILTERS : (n + 1) * FILTERS] = -np.inf
        np.maximum.at(pooled, h.owner[full], np.maximum.reduceat(found, h.firsts[full], axis=0))
        at = np.minimum(np.searchsorted(speech[0], h.words), len(speech[0]) - 1)
        known = (speech[0][at] == h.words) & (np.arange(len(h.words)) >= h.fresh[number])
        owners = h.owner[number]
        np.add.at(tongue, (owners[known], speech[1][at[known]]), 1)
    pooled = np.where(np.isinf(pooled), 0, pooled)
    z = np.maximum(pooled + model.bias, 0) @ model.out + model.base
    language = np.where(tongue.sum(axis=1) > 0, tongue.argmax(axis=1), len(FUNCTION_WORDS))
    return z, language


def _log_odds(words: list[np.ndarray], y: np.ndarray, strength: float = 4.0) -> np.ndarray:
    seen, hits = np.zeros(TABLES * BUCKETS), np.zeros(TABLES * BUCKETS)
    for w, label in zip(words, y):
        ids = np.unique(w)
        seen[ids] += 1
        hits[ids] += label
    prior = y.mean()
    p = (hits + strength * prior) / (seen + strength)
    return np.where(seen > 0, np.log(p / (1 - p)) - np.log(prior / (1 - prior)), 0)


def _threshold(z: np.ndarray, y: np.ndarray, weights: np.ndarray) -> float:
    """The logit with the best weighted F1; between perfectly parted classes, the middle."""
    order = np.argsort(-z, kind="stable")
    z, hits, picked = z[order], np.cumsum((weights * y)[order]), np.cumsum(weights[order])
    f1 = 2 * hits / (picked + (weights * y).sum())
    best = int(np.argmax(f1))
    after = z[best + 1] if best + 1 < len(z) else z[best] - 1
    return float((z[best] + after) / 2)


def fit(y: list[int], texts: list[str], weights: list[float] | None = None, epochs: int = 4, rate: float = 0.005, seed: int = 5) -> Model:
    """Train on three quarters of the rows, set thresholds on the rest. Without
    both labels every score is the same low one."""
    y = np.array(y, dtype=np.float64)
    weights = np.ones(len(y)) if weights is None else np.array(weights, dtype=np.float64)
    rng = np.random.default_rng(seed)
    columns = sum(WIDTHS) * FILTERS
    width = len(WIDTHS) * FILTERS
    filters = rng.normal(0, 0.1, (DIM, columns)).astype(np.float32)
    empty = Model(np.zeros(0, np.int64), np.zeros((0, DIM), np.float32), filters, np.zeros(width, np.float32), np.zeros(width, np.float32), -5.0, np.zeros(len(LANGUAGES)))
    part = np.arange(len(y)) % 4 != 3
    if len(y) < 8 or len(np.unique(y[part])) < 2 or len(np.unique(y[~part])) < 2:
        return empty
    nothing = np.zeros((0, TABLES), np.int32)
    words = [np.concatenate([_buckets(_hashed(g)) for g in pieces([t])]) if t else nothing for t in texts]
    train = np.flatnonzero(part)
    odds = _log_odds([words[i] for i in train], y[train])
    table = np.zeros((TABLES * BUCKETS, DIM), dtype=np.float32)
    live = np.flatnonzero(odds)
    table[live] = rng.normal(0, 0.02, (len(live), DIM))
    table[live, 0] = odds[live] / 6
    filters[0, 0] = 1.0
    bias, out, base = np.zeros(width, np.float32), np.full(width, 0.1, np.float32), np.float32(-2.0)
    out[0] = 2.0
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in (("f", filters), ("b", bias), ("o", out))}
    step = 0

    def adam(key, value, grad):
        m, v = moment[key]
        m += 0.1 * (grad - m)
        v += 0.001 * (grad * grad - v)
        value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    for _ in range(epochs):
        turn = rng.permutation(train)
        for at in range(0, len(train), 64):
            batch = [i for i in turn[at : at + 64] if len(words[i])]
            if not batch:
                continue
            step += 1
            counts = np.array([len(words[i]) for i in batch])
            found, vectors, place = _responses(table, filters, np.concatenate([words[i] for i in batch]), counts)
            ends = np.cumsum(counts)
            peak = np.stack([e - c + found[e - c : e].argmax(axis=0) for e, c in zip(ends, counts)])
            pooled = found[peak, np.arange(width)]
            active = np.maximum(pooled + bias, 0)
            p = 1 / (1 + np.exp(-(active @ out + base)))
            error = ((p - y[batch]) / len(batch)).astype(np.float32)
            back = error[:, None] * out * (pooled + bias > 0)
            grad = np.zeros_like(filters)
            all_words = np.concatenate([words[i] for i in batch])
            column, moves = 0, []
            for n, w in enumerate(WIDTHS):
                cols = slice(n * FILTERS, (n + 1) * FILTERS)
                for k in range(w):
                    weight = filters[:, column : column + FILTERS]
                    at_word = peak[:, cols] + k
                    seen = vectors[place[peak[:, cols]] + k]  # (batch, FILTERS, DIM)
                    grad[:, column : column + FILTERS] = np.einsum("bf,bfd->df", back[:, cols], seen)
                    # Behind a text's last word lie zero vectors, which have no rows to move.
                    real = at_word < ends[:, None]
                    pull = np.einsum("bf,df->bfd", back[:, cols], weight)[real]
                    moves += [(ids, 0.5 * pull) for ids in all_words[at_word[real]].T]
                    column += FILTERS
            for ids, pull in moves:
                np.subtract.at(table, ids, pull)
            adam("f", filters, grad)
            adam("b", bias, back.sum(axis=0))
            adam("o", out, active.T @ error)
            base -= rate * 10 * error.sum()
    rows = np.flatnonzero(np.abs(table).max(axis=1) > 0)
    model = Model(rows, table[rows], filters, bias, out, float(base), np.zeros(len(LANGUAGES)))
    test = np.flatnonzero(~part)
    z, language = logits(model, table, [texts[i] for i in test])
    model.thresholds[:] = _threshold(z, y[test], weights[test])
    for n in range(len(LANGUAGES)):
        own = language == n
        if (y[test][own] == 1).sum() >= 20 and (y[test][own] == 0).sum() >= 20:
            model.thresholds[n] = _threshold(z[own], y[test][own], weights[test][own])
    return model


def score_texts(model: Model, table: np.ndarray, texts: list) -> np.ndarray:
    z, language = logits(model, table, texts)
    shifted = z - model.thresholds[language] + np.log(CUT / (1 - CUT))
    return 1 / (1 + np.exp(-np.clip(shifted, -30, 30)))


def scored(docs: DataFrame, keys: list[str], text: str, model, make) -> DataFrame:
    """``keys`` and ``score``: ``make(model)`` gives the function from texts to scores."""
    schema = T.StructType([*[docs.schema[k] for k in keys], T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        score = make(shared.value)
        for batch in batches:
            texts = batch.column(len(keys))
            for at in range(0, batch.num_rows, 256):
                found = score(texts.slice(at, 256).to_pylist())
                columns = [batch.column(i).slice(at, 256) for i in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.float64())], names=[*keys, "score"])

    return map_batches(docs.select(*keys, F.col(text).alias("_text")), run, schema)


def _make(model: Model):
    table = model.table()
    return lambda texts: score_texts(model, table, texts)


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE_ROWS, doc_id: str = "doc_id", text: str = "text") -> Model:
    """A model from at most ``sample`` labelled rows outside the held-out fold."""
    return fitted(labelled_sample(docs, labels, label, sample, doc_id, text), fit)


def toxicity_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row and whole text.

    Only the text enters a score. Null and empty texts score as a text without
    any word; null ids are kept and not held out.
    """
    model = train_toxicity(docs, labels, doc_id=doc_id, text=text, **how)
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t"))
    return scored(keyed, ["doc_id"], "_t", model, _make).select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that score below ``CUT``, all columns kept."""
    model = train_toxicity(docs, labels, doc_id=doc_id, text=text, **how)
    schema = docs.schema
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at_text = docs.columns.index(text)

    def run(batches):
        score = _make(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                clean = score(part.column(at_text).to_pylist()) < CUT
                yield part.filter(pa.array(clean))

    return map_batches(docs, run, schema)
