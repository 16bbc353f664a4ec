"""SimHash, near duplicates, components and radix deduplication against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from lessonloom.llm import graph, radix, simhash

SCHEMA = "doc_id BIGINT, text STRING, fp STRING, anchor INT, _group INT"


def table(spark, rows):
    """Documents with extra columns named like internal ones."""
    return spark.createDataFrame([(i, t, "x", None, 1) for i, t in rows], SCHEMA)


def roots(nodes, pairs):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def variants(words, count, seed):
    rng = random.Random(seed)
    made = []
    for _ in range(count):
        own = list(words)
        own[rng.randrange(len(own))] = f"w{rng.randrange(10**6)}"
        made.append(" ".join(own))
    return made


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    plain = [" ".join(f"v{rng.randrange(5000)}" for _ in range(rng.randrange(1, 120))) for _ in range(60)]
    near = variants([f"a{n}" for n in range(150)], 12, 4)
    odd = ["", None, " \t", "One", "one", "a b", "long " * 30000, "é ü ß  x"]
    return plain + near + odd + plain[:5]


def test_components_are_whole(spark):
    chain = [(n, n + 1) for n in range(200)] + [(1000, n) for n in range(1001, 1100)] + [(7, 7), (None, 3)]
    found = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(chain, "a BIGINT, b BIGINT")).collect()}
    links = [(a, b) for a, b in chain if a is not None and a != b]
    assert found == roots({n for pair in links for n in pair}, links)
    assert graph.components(spark.createDataFrame([], "a BIGINT, b BIGINT")).count() == 0


@pytest.mark.parametrize("reach", [0, 1, 2])
def test_anchors_cover(reach):
    rng = np.random.default_rng(reach)
    x = rng.integers(0, 1 << 62, 300)
    y = x.copy()
    for _ in range(reach):
        y ^= np.int64(1) << rng.integers(0, 62, 300)
    at, home = simhash.anchors(x, 0)
    assert at.tolist() == list(range(300))
    where, found = simhash.anchors(y, reach)
    visits = [set() for _ in x]
    for i, a in zip(where, found):
        visits[i].add(int(a))
    assert all(int(h) in v for h, v in zip(home, visits))


def test_simhash_matches_all_pairs(spark, texts):
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(None, "one"), (0, texts[0])]

    def fingerprint(t):
        words = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [simhash.xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    fps = {t: fingerprint(t) for _, t in rows}
    distinct = sorted(set(fps.values()))
    close = [(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 2]
    root = roots(distinct, close)
    lowest = {}
    for i, t in rows:
        r = root[fps[t]]
        if i is not None:
            lowest[r] = min(i, lowest.get(r, i))
    expected = sorted((str(i), f"{fps[t]:016x}", lowest.get(root[fps[t]])) for i, t in rows)
    found = simhash.simhash_components(table(spark, rows)).collect()
    assert sorted((str(r[0]), r[1], r[2]) for r in found) == expected
    assert simhash.simhash_components(table(spark, [])).count() == 0


def test_near_duplicates_match_all_pairs(spark, texts):
    rows = list(enumerate(dict.fromkeys(texts)))
    sets = {i: set(simhash.shingles(t, 5)) for i, t in rows}

    def similar(a, b):
        whole = len(sets[a] | sets[b])
        return len(sets[a] & sets[b]) >= 0.8 * whole

    root = roots(sets, [(a, b) for a in sets for b in sets if a < b and similar(a, b)])
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(table(spark, rows)).collect()}
    assert kept == {i for i in sets if root[i] == i}


def test_near_duplicates_of_like_fingerprints_are_joined_by_simhash(spark, monkeypatch):
    """Without the exact search that follows, the fingerprints' own links remain."""
    words = [f"a{n}" for n in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "a399"])), (3, "other words that nothing else here holds"), (4, ""), (5, None)]
    prints = {r["doc_id"]: int(r["fingerprint"], 16) for r in simhash.simhash_components(table(spark, rows), width=5).collect()}
    assert (prints[1] ^ prints[2]).bit_count() <= 2 < (prints[1] ^ prints[3]).bit_count()
    found = simhash._repeated
    monkeypatch.setattr(simhash, "_repeated", lambda *how: found(*how).where("false"))
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(table(spark, rows)).collect()}
    assert kept == {1, 3, 4}


def test_fingerprints_alone_join_nothing(spark):
    """Equal fingerprints of texts that have few shingles in common are verified first."""
    text = "one two three four five six seven"
    rows = [(1, text), (2, " ".join([text] * 3)), (3, text.upper())]
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(table(spark, rows), threshold=2).collect()}
    assert kept == {1, 2}


def test_one_of_repeated_rows_stays(spark):
    twice = table(spark, [(1, "the same words stand here twice"), (1, "the same words stand here twice"), (None, None)])
    assert simhash.drop_near_duplicates(twice).count() == 2
    assert simhash.drop_near_duplicates(twice).columns == twice.columns
    assert simhash.drop_near_duplicates(table(spark, [])).count() == 0


def test_radix_groups_match_plain_grouping(spark, texts):
    long = "x" * 5000
    rows = list(enumerate(texts)) + [(900, long), (901, long + "y"), (902, long), (None, "a  b"), (5, long)]
    key = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(key(t), []).append(i)
    expected = sorted(
        (str(i), min((x for x in groups[key(t)] if x is not None), default=None), len(groups[key(t)]), hashlib.sha256(key(t).encode()).hexdigest())
        for i, t in rows
    )
    found = radix.exact_groups(table(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["keep_id"], r["group_size"], r["text_sha256"]) for r in found) == expected
    assert len({r["keep_row"] for r in found}) == len(groups)
    dropped = radix.drop_exact_duplicates(table(spark, rows))
    assert dropped.count() == len(groups)
    assert radix.exact_groups(table(spark, [])).count() == 0


def brute_kept(rows):
    """Ids that stay at five words and Jaccard 0.8, and the number of similar pairs."""
    sets = {i: set(simhash.shingles(t, 5)) for i, t in rows}
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = roots(sets, near)
    return {i for i in sets if root[i] == i}, len(near)


def test_runs_appended_and_replaced_are_near_duplicates(spark):
    rng = random.Random(8)
    word = lambda: f"v{rng.randrange(3000)}"
    rows = []
    for n in range(60):
        base = [word() for _ in range(rng.randrange(100, 400))]
        run = [word() for _ in range(len(base) * rng.randrange(4, 26) // 100)]
        cut = rng.randrange(len(base) - len(run))
        other = base + run if n % 2 else base[:cut] + run[: len(run) // 2] + base[cut + len(run) // 2 :]
        rows += [(2 * n, " ".join(base)), (2 * n + 1, " ".join(other))]
    expected, pairs = brute_kept(rows)
    assert pairs > 30
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(table(spark, rows)).collect()} == expected


def test_texts_of_the_same_words_in_another_order(spark):
    """The smallest row is unlike two near copies over the same words."""
    rng = random.Random(9)
    words = [f"a{n}" for n in range(40)]
    first = words * 7
    rng.shuffle(first)
    near = [w for _ in range(7) for w in rng.sample(words, 40)]
    other = near[:-3] + near[-2:] + near[-3:-2]
    rows = [(0, " ".join(first)), (1, " ".join(near)), (2, " ".join(other))]
    expected, pairs = brute_kept(rows)
    assert pairs == 1 and expected == {0, 1}
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(table(spark, rows)).collect()} == expected


def test_texts_of_a_shingle_that_stay_apart(spark, monkeypatch):
    """Groups smaller than the texts of one shingle: blocks meet, and no link is lost."""
    monkeypatch.setattr(simhash, "GROUP", 7)
    monkeypatch.setattr(simhash, "STAR_TURNS", 0)
    rng = random.Random(12)
    common = [f"c{n}" for n in range(40)]
    rows = []
    for n in range(60):
        own = [f"u{n}x{k}" for k in range(rng.randrange(12, 60))]
        rows += [(3 * n + k, " ".join(common + own[: len(own) - k])) for k in range(3)]
    expected, pairs = brute_kept(rows)
    assert pairs > 150 and len(expected) > 20
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(table(spark, rows)).collect()} == expected


def test_marks_rule_out_no_link():
    rng = np.random.default_rng(5)
    sets = []
    for size in (1, 5, 40, 300, 3000, 20000):
        base = rng.integers(0, 2**63, size, dtype=np.uint64)
        for share in (0.02, 0.1, 0.13, 0.3):
            other = base[: size - int(size * share)]
            sets += [np.unique(base), np.unique(other), np.unique(np.concatenate([other, rng.integers(0, 2**63, max(1, size // 20), dtype=np.uint64)]))]
    rows = [(k % 2, k, len(s), 0, k, simhash.mark(s)) for k, s in enumerate(sets)]
    found = {tuple(p.values()) for p in simhash.close_pairs(rows, True, 0.8).to_pylist()}
    ways = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets))]
    both = {(a, b): len(np.intersect1d(sets[a], sets[b])) for a, b in ways}
    links = {(a, b) for a, b in ways if both[a, b] >= 0.8 * (len(sets[a]) + len(sets[b]) - both[a, b])}
    assert len(links) > 50 and links <= found and len(found) < len(ways) // 2
    across = {tuple(p.values()) for p in simhash.close_pairs(rows, False, 0.8).to_pylist()}
    assert across == {(a, b) for a, b in found if (a + b) % 2}
