"""Quality by supervised subword embeddings.

Words and character n-grams of a text are hashed to learned vectors; so is a
mark per word that tells whether it repeats the word before. Their average,
one share for each kind, goes through a softmax layer. ``PRIOR`` null vectors
in every average keep short texts near the middle. Training is stochastic gradient descent in numpy. As
the layer is linear, a trained model scores a text by averaging one number per
bucket.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lessonloom.llm.text_hash import Hashed, pieces
from lessonloom.llm.toxicity import scored
from lessonloom.llm.training import fitted, held_out, labelled_sample

CUT = 0.7
SAMPLE_ROWS = 3000  # most labelled rows that are learned from
BUCKETS, DIM, GRAMS = 1 << 18, 8, (3, 4)
KINDS, PRIOR = 2 + len(GRAMS), 10


def _pieces(texts):
    return pieces(texts, overlap=1, back=max(GRAMS) - 1)


def _features(group):
    """For each kind of feature: bucket ids, first that each piece adds, number that it adds."""
    h = Hashed(group, lower=False)
    mask = np.uint64(BUCKETS - 1)
    yield h, (h.words & mask).astype(np.int64), h.fresh, h.added
    again = np.concatenate([[0], (h.words[1:] == h.words[:-1]).astype(np.int64)])[: len(h.words)]
    again[h.firsts[h.counts > 0]] = 0
    yield h, BUCKETS + again, h.fresh, h.added
    for n in GRAMS:
        found, firsts, counts = h.grams(n)
        yield h, (found & mask).astype(np.int64), firsts, counts


def _shares(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares of its average."""
    kinds: list[list[np.ndarray]] = [[] for _ in range(KINDS)]
    for group in _pieces([text]):
        for kind, (_, ids, firsts, counts) in enumerate(_features(group)):
            kinds[kind] += [ids[f : f + c] for f, c in zip(firsts, counts)]
    ids, shares = [], []
    for parts in kinds:
        joined = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        if len(joined):
            found, n = np.unique(joined, return_counts=True)
            ids.append(found.astype(np.int32))
            shares.append((n / (len(joined) + PRIOR) / KINDS).astype(np.float32))
    if not ids:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    return np.concatenate(ids), np.concatenate(shares)


def fit(y: list[int], texts: list[str], weights: list[float] | None = None, epochs: int = 5, rate: float = 2.0, seed: int = 5) -> tuple[np.ndarray, float]:
    """Per-bucket numbers and a constant whose sum is the logit of label 1.

    Without both labels the constant gives the one label there is. ``weights`` are not
    used: the score's middle is that of rows taken evenly from both labels.
    """
    y = np.array(y, dtype=np.int64)
    if len(np.unique(y)) < 2:
        return np.zeros(BUCKETS + 2, np.float32), (4.0 if y.sum() else -4.0)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS + 2, DIM)).astype(np.float32)
    layer = np.zeros((DIM, 2), dtype=np.float32)
    bias = np.zeros(2, dtype=np.float32)
    shares = [_shares(t) for t in texts]
    used = np.zeros(BUCKETS + 2, dtype=bool)
    for ids, _ in shares:
        used[ids] = True
    vectors[~used] = 0
    steps, step = epochs * len(y), 0
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            ids, share = shares[i]
            pace = rate * (1 - step / steps)
            step += 1
            mean = share @ vectors[ids]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            error = p / p.sum()
            error[y[i]] -= 1
            back = layer @ error
            layer -= pace * np.outer(mean, error)
            bias -= 0.1 * pace * error
            # Shares are small; vectors move as if a text had about a hundred features.
            vectors[ids] -= pace * 100 * np.minimum(share, 0.01)[:, None] * back
    return vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0])


def score_texts(model: tuple[np.ndarray, float], texts: list) -> np.ndarray:
    weights, constant = model
    sums = np.zeros((KINDS, len(texts)))
    counts = np.zeros((KINDS, len(texts)))
    for group in _pieces(texts):
        for kind, (h, ids, firsts, many) in enumerate(_features(group)):
            running = np.concatenate([[0.0], np.cumsum(weights[ids], dtype=np.float64)])
            np.add.at(sums[kind], h.owner, running[firsts + many] - running[firsts])
            np.add.at(counts[kind], h.owner, many)
    z = (sums / (counts + PRIOR)).sum(axis=0) / KINDS + constant
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _make(model):
    return lambda texts: score_texts(model, texts)


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE_ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row and whole text.

    Only the text enters a score. Null and empty texts get the constant alone;
    null ids are kept and not held out.
    """
    model = fitted(labelled_sample(docs, labels, label, sample, doc_id, text), fit)
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t"))
    return scored(keyed, ["doc_id"], "_t", model, _make).select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )
