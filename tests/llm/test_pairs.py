"""MinHash groups, collocations and vector codes against plain recomputation."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lessonloom.llm import bayes_dedup, collocations, vector_codes
from tests.llm.test_dedup import roots, variants

DOCS = "doc_id BIGINT, text STRING, lang STRING, c INT, x INT, bucket STRING, key STRING, n STRING, level INT, f INT"


def docs(spark, rows):
    """Documents with extra columns named like internal ones."""
    return spark.createDataFrame([(i, t, g, 1, 2, "b", "k", "n", 3, 4) for i, t, g in rows], DOCS)


def plain_groups(rows, percent=85, width=5):
    def shingles(t):
        words = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()

    sets = [shingles(t) for _, t, _ in rows]
    links = [
        (a, b)
        for a in range(len(sets))
        for b in range(a)
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    root = roots(range(len(sets)), links)
    low = {}
    for at, (i, _, _) in enumerate(rows):
        if i is not None:
            low[root[at]] = min(i, low.get(root[at], i))
    return sorted(
        (str(i), len(sets[at]), str(low.get(root[at])), i == low.get(root[at])) for at, (i, _, _) in enumerate(rows)
    ), len(links)


def test_minhash_groups_match_all_pairs(spark):
    rng = random.Random(11)
    word = lambda: f"v{rng.randrange(4000)}"
    texts = [" ".join(word() for _ in range(rng.randrange(1, 150))) for _ in range(80)]
    passage = [word() for _ in range(60)]
    texts += [" ".join([*passage, *(word() for _ in range(rng.randrange(0, 40)))]) for _ in range(40)]
    base = [f"a{n}" for n in range(200)]
    texts += variants(base, 25, 5)
    for n in range(40):  # runs appended, replaced or cut, around the wanted similarity
        own = [word() for _ in range(rng.randrange(60, 300))]
        run = [word() for _ in range(len(own) * rng.randrange(2, 22) // 100)]
        texts += [" ".join(own), " ".join([own + run, own[len(run) :], run + own[len(run) :]][n % 3])]
    texts += ["", None, " \t\r\n", "One", "one", "a b", "A b", "a b c d", "é É ß", "long " * 40000, "a b c d e " * 20000]
    texts += texts[:6]
    rows = [(i * 7, t, "en") for i, t in enumerate(texts)] + [(0, texts[0], "en"), (None, "one", None), (None, "by itself", None)]
    expected, links = plain_groups(rows)
    found = bayes_dedup.near_duplicate_groups(docs(spark, rows)).collect()
    assert links > 300
    assert sorted((str(r[0]), r[1], str(r[2]), bool(r[3])) for r in found) == expected
    assert bayes_dedup.near_duplicate_groups(docs(spark, [])).count() == 0


def test_texts_of_a_bucket_that_stay_apart(spark):
    """Thousands of links, and groups that meet in one bucket without being alike."""
    rng = random.Random(12)
    shared = [f"s{n}" for n in range(120)]
    rows = []
    for g in range(6):
        own = shared + [f"g{g}_{n}" for n in range(40)]
        rows += [(len(rows) + n, t, "en") for n, t in enumerate(variants(own, 12, g))]
    rng.shuffle(rows)
    expected, links = plain_groups(rows)
    assert links > 200
    found = bayes_dedup.near_duplicate_groups(docs(spark, rows)).collect()
    assert sorted((str(r[0]), r[1], str(r[2]), bool(r[3])) for r in found) == expected


def test_posterior_bounds():
    for k, m in bayes_dedup.least_agreements(85):
        def chance(agreed):
            grid = (np.arange(200_000) + 0.5) / 200_000
            posterior = grid**agreed * (1 - grid) ** (k - agreed)
            return posterior[grid >= 0.85].sum() / posterior.sum()

        assert chance(m) >= bayes_dedup.MISS * 0.99
        assert m == 0 or chance(m - 1) < bayes_dedup.MISS * 1.01


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    rates = []
    for _ in range(40):
        whole = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
        a, b = np.unique(whole[:1000]), np.unique(whole[81:1081])  # Jaccard 0.85
        x, y = (np.frombuffer(bayes_dedup.signature(s), "<u2") for s in (a, b))
        rates.append((x == y).mean())
        assert len(bayes_dedup.plausible(x[None, :], y[None, :], 85)) == 1
    assert abs(np.mean(rates) - 0.85) < 0.02
    far = np.frombuffer(bayes_dedup.signature(whole[2000:]), "<u2")
    assert len(bayes_dedup.plausible(x[None, :], far[None, :], 85)) == 0


def plain_collocations(rows, least, share, top):
    phrases, totals = defaultdict(Counter), Counter()
    for _, t, g in rows:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        for piece in re.split("[.,;:!?\n-\r]", t):
            w = re.findall("[^ \t]+", piece)
            g = g if g is not None else "und"
            totals[g] += len(w)
            for k in (1, 2, 3):
                phrases[g].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for g, f in phrases.items():
        wanted = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        made = []
        for p, a in wanted.items():
            if any(len(q) > len(p) and p in (q[:2], q[1:]) and 100 * b >= share * a for q, b in wanted.items()):
                continue
            cuts = [(1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            s, k = min(cuts)
            made.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(made)[:top], 1):
            out.append((g, rank, p.decode(), -a, left, right, totals[g], -s))
    return sorted(out)


@pytest.mark.parametrize("least,top", [(10, 2000), (3, 7)])
def test_collocations_match_plain_counts(spark, least, top):
    rng = random.Random(13)
    words = [f"w{n}" for n in range(9)] + ["Über", "über", "A b", "x\x1cy", "\x00", "日本"]
    stop = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\r\n", "!", " ?", "\x0b"]
    texts = ["".join(rng.choice(words) + rng.choice(stop) for _ in range(rng.randrange(0, 80))) for _ in range(500)]
    texts += ["", None, " \t ", "...", "w1", "w1 w2", "one long run " * 9000, "x" * 50000, texts[0], texts[0]]
    rows = [(i, t, rng.choice(["en", "de", None, ""])) for i, t in enumerate(texts)]
    expected = plain_collocations(rows, least, 50, top)
    assert len(expected) > 20
    found = collocations.collocations(docs(spark, rows), least=least, top=top).collect()
    assert sorted(tuple(r) for r in found) == expected
    assert collocations.collocations(docs(spark, [])).count() == 0


def test_slices_lose_no_window(monkeypatch):
    rng = random.Random(14)
    text = "".join(rng.choice(["ab", "c", "déf", "x" * 90]) + rng.choice([" ", "  ", "\t", ". ", "\n"]) for _ in range(3000)).encode()

    def counted():
        counts, found = collocations.WindowCounts(5), Counter()
        for batch in [*counts.add("en", [text, b"", text]), *counts.flush()]:
            for row in batch.to_pylist():
                for phrase, f in collocations._unpacked(row["phrases"], row["counts"]):
                    found[phrase, row["block"]] += f
        return found

    whole = counted()
    for size, held in ((64, 1 << 22), (200, 50), (7, 1)):
        monkeypatch.setattr(collocations, "_SLICE", size)
        monkeypatch.setattr(collocations, "_HELD", held)
        assert counted() == whole


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    step = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    whole = [[math.floor(4096 * x) for x in v] + [0] * (parts * step - len(v)) for _, v, _ in kept]
    cut = [[v[p * step : (p + 1) * step] for p in range(parts)] for v in whole]
    start = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][1]))[:entries]
    books = [[cut[r][p] for r in start] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        assigned = [[nearest(p, v[p])[1] for v in cut] for p in range(parts)]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [v[p] for v, at in zip(cut, assigned[p]) if at == e]
                if mine:
                    books[p] = [*books[p][:e], [sum(c) // len(mine) for c in zip(*mine)], *books[p][e + 1 :]]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    coded = [[nearest(p, v[p]) for p in range(parts)] for v in cut]
    fits = lambda n: n if n < 1 << 63 else None
    total = defaultdict(int)
    for (_, _, label), c in zip(kept, coded):
        total[label] += fits(sum(d for d, _ in c)) or 0
    return sorted(
        (str(i), "".join(f"{e:02x}" for _, e in c), str(fits(sum(d for d, _ in c))), total[label], sha)
        for (i, _, label), c in zip(kept, coded)
    )


@pytest.mark.parametrize("spread", [1.0, 0.001, 1e12])
def test_vector_codes_match_plain_search(spark, spread):
    rng = np.random.default_rng(15)
    rows = [(int(i), (rng.normal(size=24) * spread).tolist(), int(i) % 3) for i in rng.permutation(150)]
    rows += [(3, rows[0][1], 1), (None, rows[1][1], None), (None, rows[2][1], None), rows[5], rows[5]]
    rows += [(900, None, 1), (901, [1.0, None] * 12, 1), (902, [math.nan] * 24, 1), (903, [math.inf] + [0.0] * 23, 1), (904, [0.0] * 24, 2), (905, [0.5] * 20, 2)]
    table = spark.createDataFrame([(i, v, g, "p", 1) for i, v, g in rows], "vec_id BIGINT, embedding ARRAY<DOUBLE>, label INT, part STRING, n INT")
    found = vector_codes.vector_codes(table).collect()
    if spread < 1e6:
        assert sorted((str(r[0]), r[1], str(r[2]), r[3], r[4]) for r in found) == plain_codes(rows)
    else:
        assert sorted((str(r[0]), r[1], str(r[2]), r[4]) for r in found) == [(a, b, c, e) for a, b, c, _, e in plain_codes(rows)]


def test_vector_codes_of_few_or_no_vectors(spark):
    kind = "vec_id BIGINT, embedding ARRAY<FLOAT>, label STRING"
    assert vector_codes.vector_codes(spark.createDataFrame([], kind)).count() == 0
    few = [(5, [1.0] * 8, None), (4, [1.0] * 8, None), (9, [2.0] * 8, "a")]
    found = vector_codes.vector_codes(spark.createDataFrame(few, kind)).collect()
    assert sorted((r[0], r[1], r[2], r[3]) for r in found) == [(4, "00" * 8, 0, 0), (5, "00" * 8, 0, 0), (9, "02" * 8, 0, 0)]


def test_search_outward_finds_the_nearest_entry():
    rng = np.random.default_rng(16)
    for width in (1, 2, 7):
        entries = rng.integers(-9, 9, size=(16, width))
        parts = rng.integers(-12, 12, size=(500, width))
        index, best = vector_codes.Codebook.of(entries).nearest(parts)
        apart = ((parts[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        assert (best == apart.min(axis=1)).all() and (index == apart.argmin(axis=1)).all()


