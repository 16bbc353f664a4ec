"""Classifiers: held-out accuracy, odd rows; the pipeline's stages; word hashes."""

from __future__ import annotations

import os
import random
import re

import numpy as np

import corpus_pipeline
from lessonloom.llm import quality, toxicity
from lessonloom.llm.text_hash import Hashed, pieces
from lessonloom.llm.training import labelled_sample
from lessonloom.session import path_exists, shared_dir, written


def test_hashes_agree_with_words():
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(60))) for _ in range(50)] + ["", " ", "é ü"]
    seen = {}
    for group in pieces(texts, size=200):
        h = Hashed(group, lower=True)
        assert h.counts.tolist() == [len(data.split()) for _, data, *_ in group]
        words = [w for _, data, *_ in group for w in data.split()]
        for w, x in zip(words, h.words.tolist()):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    long = "word " * 1000
    assert sum(Hashed(g, lower=True).counts.sum() for g in pieces([long], size=300)) == 1000


def odd_texts(rows=200):
    rng = random.Random(7)
    words = ["the", "und", "vile", "Vile!!", "ab", "x", "longer-word", "été", "--", "42", "der", "bad"]
    gaps = [" ", "  ", "\n", "\t", "\r\n"]
    texts = ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(40))) for _ in range(rows)]
    return texts + [None, "", " ", "\n".join(["line"] * 300), "z" * 900, "the\t" * 200]


def test_pieces_lose_and_add_nothing():
    """Words, spans and repeats of texts cut into small pieces are those of whole texts."""

    def counted(size):
        seen = {}
        for group in pieces(odd_texts(), overlap=1, back=3, size=size):
            h = Hashed(group, lower=False)
            grams, firsts, many = h.grams(4)
            for p, owner in enumerate(h.owner.tolist()):
                words, spans = seen.setdefault(owner, ([], []))
                words += h.words[h.fresh[p] : h.fresh[p] + h.added[p]].tolist()
                spans += grams[firsts[p] : firsts[p] + many[p]].tolist()
        return seen

    assert counted(50) == counted(1 << 20)
    long = "word\n" * 60000 + "last"
    assert sum(Hashed(g, lower=True).added.sum() for g in pieces([long], overlap=2)) == 60001


def plain_hash(word, lower=False, bare=False):
    return int(Hashed([(0, word, 0, False)], lower, bare).words[0])


def plain_quality(model, text):
    """One text by counting its features one at a time."""
    weights, constant = model
    data = (text or "").encode()
    words = data.split()
    kinds = [
        [weights[plain_hash(w) % quality.BUCKETS] for w in words],
        [weights[quality.BUCKETS + int(i > 0 and words[i - 1] == w)] for i, w in enumerate(words)],
    ]
    for n in quality.GRAMS:
        spans = [data[i : i + n] for i in range(len(data) - n + 1)]
        kinds.append([weights[int(Hashed([(0, g, 0, False)], False).grams(n)[0][0]) % quality.BUCKETS] for g in spans])
    z = sum(float(sum(map(float, k))) / (len(k) + quality.PRIOR) for k in kinds) / quality.KINDS + constant
    return 1 / (1 + np.exp(-z))


def plain_toxicity(model, table, text):
    """One text by every filter at every word."""
    words = [w.lower().encode() for w in re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
    zero = np.zeros(toxicity.DIM)
    vectors = []
    for w in words:
        parts = [w, *(w[:n] for n in toxicity.STEMS)]
        vectors.append(sum(table[plain_hash(p, True, True) % toxicity.BUCKETS + n * toxicity.BUCKETS].astype(float) for n, p in enumerate(parts)))
    pooled, column = [], 0
    for width in toxicity.WIDTHS:
        for f in range(toxicity.FILTERS):
            at = [column + k * toxicity.FILTERS + f for k in range(width)]
            values = [
                sum((vectors[i + k] if i + k < len(vectors) else zero) @ model.filters[:, c] for k, c in enumerate(at))
                for i in range(len(vectors))
            ]
            pooled.append(max(values, default=0.0))
        column += width * toxicity.FILTERS
    z = np.maximum(np.array(pooled) + model.bias, 0) @ model.out + model.base
    counts = [sum(w.decode() in listed.split() for w in words) for listed in toxicity.FUNCTION_WORDS.values()]
    language = int(np.argmax(counts)) if any(counts) else len(counts)
    shifted = z - model.thresholds[language] + np.log(toxicity.CUT / (1 - toxicity.CUT))
    return 1 / (1 + np.exp(-np.clip(shifted, -30, 30)))


def test_scores_are_those_of_a_plain_scorer(monkeypatch):
    texts = odd_texts()
    y = [int("ile" in (t or "")) for t in texts]
    model = toxicity.fit(y, [t or "" for t in texts], [1.0] * len(y))
    table = model.table()
    good = quality.fit(y, [t or "" for t in texts])
    whole = toxicity.pieces
    for size in (1 << 18, 64):
        for module in (toxicity, quality):
            monkeypatch.setattr(module, "pieces", lambda texts, size=size, **how: whole(texts, size=size, **how))
        found = toxicity.score_texts(model, table, texts)
        assert np.allclose(found, [plain_toxicity(model, table, t) for t in texts], atol=1e-4)
        found = quality.score_texts(good, texts)
        assert np.allclose(found, [plain_quality(good, t) for t in texts], atol=1e-4)


def corpus(spark, rows=500):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(rows):
        words = [f"t{rng.randrange(800)}" for _ in range(rng.randrange(3, 60))]
        toxic, good = int(rng.random() < 0.3), int(rng.random() < 0.7)
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["vile", "vilest", "nasty"])
        if not good:
            words = [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words), "en", "s", 0, 0.5))
        labels.append((i, good, toxic))
    docs += [(None, None, None, None, None, 0.5), (rows, "", "en", "s", 0, 0.5), (rows + 1, "x " * 300000, "en", "s", 0, 0.5), (0, docs[0][1], "en", "s", 0, 0.5)]
    labels += [(None, 1, 1), (1, None, None)]
    return (
        spark.createDataFrame(docs, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, score DOUBLE"),
        spark.createDataFrame(labels, "doc_id BIGINT, quality INT, toxic INT"),
        labels,
    )


def test_held_out_accuracy(spark):
    docs, table, labels = corpus(spark)
    for function, at in ((toxicity.toxicity_scores, 2), (quality.quality_scores, 1)):
        found = function(docs, table).collect()
        assert len(found) == docs.count()
        assert all(0 <= r["score"] <= 1 for r in found)
        truth = {row[0]: row[at] for row in labels}
        held = [r for r in found if r["held_out"] and truth.get(r["doc_id"]) is not None]
        assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) >= 0.9
        empty = function(docs.limit(0), table)
        assert empty.count() == 0
        assert function(docs, table.limit(0)).count() == docs.count()


def test_pipeline_stages_keep_their_contract(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, before, sf), name)
        ids, old = [r[0] for r in after.select("doc_id").collect()], [r[0] for r in before.select("doc_id").collect()]
        if name == "toxicity":
            assert np.mean([labels.get(i, 0) == 0 for i in ids]) > 0.9 and len(ids) > 0.7 * len(old)
        if name == "exact_dedup":
            assert len(ids) == before.selectExpr(r"regexp_replace(text, '[ \t-\r]+', ' ') AS t").distinct().count()
        if name in ("exact_dedup", "near_dedup"):
            assert set(ids) <= set(old) and len(set(ids)) == len(ids)
        if name == "mixing":
            assert set(ids) <= set(old) and after.columns == before.columns
        if name == "packing":
            assert sorted(ids) == sorted(old)
        before = after
    assert corpus_pipeline.run(spark, sf).count() == len(ids)


def test_fitting_without_both_labels():
    model = toxicity.fit([0, 0], ["a", "b"])
    assert toxicity.score_texts(model, model.table(), ["", "x"]).max() < 0.3
    assert quality.score_texts(quality.fit([1, 1], ["a", "b"]), ["", "x"]).min() > 0.7


def test_two_runs_leave_only_what_their_results_read(spark, sf):
    def folders():
        where = shared_dir(spark)
        return set(os.listdir(where.removeprefix("file:"))) if path_exists(spark, where) else set()

    before = folders()
    first, second = corpus_pipeline.run(spark, sf), corpus_pipeline.run(spark, sf)
    rows = sorted(str(r) for r in first.collect())
    assert rows and rows == sorted(str(r) for r in second.collect())
    left = folders() - before
    assert not [name for name in left if re.search("scratch|toxicity|dedup", name)], left


def test_the_sample_is_bounded_whatever_repeats(spark):
    docs = spark.range(20000).selectExpr("id % 3 AS doc_id", "concat('t', id % 5) AS text").union(
        spark.range(50).selectExpr("id AS doc_id", "'x' AS text")
    )
    labels = spark.range(50).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS toxic").union(
        spark.range(900).selectExpr("0 AS doc_id", "1 AS toxic")
    )
    rows = labelled_sample(docs, labels, "toxic", 40, "doc_id", "text").collect()
    assert 20 <= len(rows) <= 40 and len({r["_id"] for r in rows}) == len(rows)
    again = labelled_sample(docs.repartition(7), labels, "toxic", 40, "doc_id", "text").collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
