"""Top-k, token files, mixing, packing, licenses and fixity on small tables."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lessonloom.llm import fixity, licenses, mixing, packing, token_files, topk
from lessonloom.session import scratch_scope

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 16)], "x") for i in range(400)]
    rows += [(900, rows[3][1], "x"), (900, rows[3][1], "x"), (1000, None, "x"), (1100, [1.0, None], "x"), (1200, [float("nan")], "x"), (1300, [float("inf")], "x"), (None, [1.0], "x"), (1400, [], "x")]
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>, slice STRING")
    good = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v, _ in rows[:402]] + [(1400, [])]
    expected = []
    for q, (i, v) in enumerate(good):
        if i % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j, n) for n, (j, w) in enumerate(good) if n != q)[:10]
            expected += [(i, r + 1, j, -s) for r, (s, j, _) in enumerate(scores)]
    for slices in (1, 2, 5):
        found = topk.top_k(df, F.col("id") % 100 == 0, slices=slices).collect()
        assert sorted(tuple(r) for r in found) == sorted(expected)
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0
    assert topk.top_k(df.where("vec_id in (0, 100)"), F.lit(True)).count() == 2


def test_huffman_round_trip_and_limit():
    rng = np.random.default_rng(2)
    counts = np.array([2**n for n in range(40)], dtype=np.float64)
    lengths = token_files.code_lengths(counts, 12)
    assert lengths.max() <= 12 and sum(2.0 ** -int(n) for n in lengths) == 1
    free = token_files.code_lengths(np.array([1, 1, 2, 4.0]), 18)
    assert free.tolist() == [3, 3, 2, 1]
    code = token_files.Code(np.arange(40) * 7, lengths)
    blocks = [rng.integers(0, 40, n) * 7 for n in (1, 255, 256, 257, 5000)]
    packed = [(*code.encode(b), len(b)) for b in blocks]
    assert all((a == b).all() for a, b in zip(blocks, code.decode(packed)))
    one = token_files.Code(np.array([5]), token_files.code_lengths(np.array([9.0])))
    assert one.decode([(*one.encode(np.full(300, 5)), 300)])[0].tolist() == [5] * 300


@pytest.mark.parametrize("vocabulary", [VOCABULARY, VOCABULARY.replace("word_bpe_49k", "byte_bpe_50k")])
def test_token_files_match_the_library(spark, vocabulary):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)
    assert token_files.Encoder(vocabulary, 1, "<u2").by_word == (vocabulary == VOCABULARY)
    texts = [None, "", "I'll don't it's 'S x's, a.b, c.", "İstanbul ǅ ſ ΣΑΣ", "á é́ क़ ﬁ", "<|endoftext|> hi <|x", "１２ ½ x²y 3a4", "\x85x\x1cy z　a", "中文 にほん 한국", "''''s", "😀👍🏽 a😀b", "​x y‍", "word " * 40000, "z" * 3000, "Été,. naïve!! ñandú's ¿qué?… º² ª1 don't,"]
    rows = [(9 - i, t, i) for i, t in enumerate(texts)] + [(3, "twice", 0), (None, "no id", 0)]
    found = token_files.round_trip(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, ids INT"), vocabulary).collect()
    ids = {(i, t): np.array(library.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4") for i, t, _ in rows}
    assert sorted((str(i), len(x), zlib.crc32(x.tobytes())) for (i, _), x in ids.items()) == sorted((str(r[0]), r[2], r[3]) for r in found)
    at = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(found, key=lambda r: r["start"])]
    assert order == [None, *sorted(i for i, _, _ in rows if i is not None)]
    assert token_files.round_trip(spark.createDataFrame([], "doc_id BIGINT, text STRING"), VOCABULARY).count() == 0


def test_new_words_go_to_the_library_many_at_once():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    encode = token_files.Encoder(VOCABULARY, 1, "<u2")
    rng = random.Random(5)
    signs = [chr(c) for c in range(33, token_files.PLAIN_END) if token_files.Encoder.PLAIN.fullmatch(chr(c))]
    words = ["".join(rng.choices(signs if n % 2 else signs[64:90], k=rng.randrange(1, 9))) for n in range(12000)]
    words += ["\x7f", "a\x01b", "\u0130x", "'tis", "it's", "12ab3.4", "e\u0301", "\u03a3\u0391\u03a3", "\u4e2d.", "x", "7", "."]
    rng.shuffle(words)
    calls = []

    class Counted:
        def encode_batch_fast(self, texts, **how):
            calls.append(texts)
            return library_pieces.encode_batch_fast(texts, **how)

    library_pieces, encode.pieces = encode.pieces, Counted()
    made = encode.encode([" ".join(words)])[0]
    assert np.frombuffer(made, "<u2").tolist() == [*library.encode(" ".join(words), add_special_tokens=False).ids, 1]
    assert 1 <= len(calls) <= 1 + len(set(words)) // token_files.WORDS_AT_ONCE
    encode.closes[:] = False  # a vocabulary that does not tell where pre-tokens end
    encode.new.clear()
    assert encode.encode([" ".join(words)])[0] == made


def test_poisson_mixing(spark):
    assert mixing.poisson_counts(np.array([0.0, 0.36, 0.37, 0.9, 0.999999]), np.ones(5)).tolist() == [0, 0, 1, 2, 9]
    assert mixing.poisson_counts(np.array([0.5]), np.zeros(1)).tolist() == [0]
    big = mixing.poisson_counts(np.linspace(0.001, 0.999, 999), np.full(999, 5000.0))
    assert abs(big.mean() - 5000) < 5
    rows = [(i, "s" if i % 3 else None, "word " * 5, 1) for i in range(3000)] + [(None, "t", None, 2)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, source STRING, text STRING, _rate INT").drop("_rate")
    mixed = mixing.mix(docs, weights={"s": 3.0, "": 1.0, "t": 0.0}).collect()
    shares = {s: sum(r["source"] == s for r in mixed) for s in ("s", None, "t")}
    assert shares["t"] == 0 and abs(shares["s"] / shares[None] - 3) < 0.5 and abs(len(mixed) - 3000) < 200
    again = mixing.mix(docs.repartition(5), weights={"s": 3.0, "": 1.0, "t": 0.0}).collect()
    assert sorted((str(r["doc_id"]), r["_copy"], r["_key"]) for r in mixed) == sorted((str(r["doc_id"]), r["_copy"], r["_key"]) for r in again)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_boundaries_are_optimal():
    from itertools import combinations

    rng = random.Random(5)
    for _ in range(40):
        lengths = sorted(rng.sample(range(1, 60), 9))
        counts = [rng.randrange(1, 4) for _ in lengths]

        def padding(ends):
            return sum(c * (min(e for e in ends if e >= n) - n) for n, c in zip(lengths, counts))

        def last_first(ends):
            return padding(ends), ends[::-1]

        for buckets in (1, 2, 4):
            every = [[*e, lengths[-1]] for e in combinations(lengths[:-1], buckets - 1)]
            assert packing.boundaries(lengths, counts, buckets) == min(every, key=last_first)
    assert packing.boundaries([], [], 3) == [] and packing.boundaries([4], [2], 3) == [4]
    many = np.arange(1, 200_001)
    assert packing.boundaries(many, np.ones(len(many)), 2) == [100_000, 200_000]


def test_packing_stores_texts_once(spark):
    docs = spark.createDataFrame([(n, "word " * (n % 9)) for n in range(40)], "doc_id BIGINT, text STRING")
    with scratch_scope() as made:
        packing.pack(docs, buckets=3, budget=64)
    stored = [path for _, path in made if "text" in spark.read.parquet(path).columns]
    assert len(stored) == 1


def test_packing_fills_batches(spark):
    rows = [(i % 50, "w " * (i % 37), "x") for i in range(600)] + [(None, None, "x"), (1, "w " * 700, "x")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, batch STRING")
    packed = packing.pack(docs, buckets=4, budget=128).collect()
    assert len(packed) == len(rows)
    places = [(r["bucket_len"], r["batch"], r["slot"]) for r in packed]
    assert len(set(places)) == len(rows) and len({p[0] for p in places}) == 4
    for end in {p[0] for p in places}:
        size = max(1, 128 // end)
        ranks = sorted(b * size + s for e, b, s in places if e == end)
        assert ranks == list(range(len(ranks))) and all(s < size for e, _, s in places if e == end)
    assert all(r["n_tokens"] + r["padding"] == r["bucket_len"] for r in packed)
    assert packing.pack(docs.limit(0)).count() == 0


def test_license_scan_and_inheritance(spark):
    prose = "the quick brown fox and the lazy dog\n" * 30
    rows = [
        ("a/LICENSE", "Released under the MIT License."),
        ("a/b/x.txt", prose),
        ("a/b/c/COPYING", prose + "This work is licensed under the GNU General Public License, version 3.\n" + prose),
        ("a/b/c/d/y.txt", None),
        ("a/b/z.txt", prose + "Licensed under CC BY-NC 4.0."),
        ("LICENSED/x", prose),
        ("q.txt", ""),
        ("a/b/LICENSE.old", prose),
        (None, "Released under the MIT License."),
        (None, prose),
    ]
    files = spark.createDataFrame(rows, "path STRING, text STRING")
    found = licenses.license_scan(files).collect()
    got = {r["path"]: (r["license"], r["license_from"]) for r in found if r["path"]}
    assert got["a/b/x.txt"] == ("MIT", "a/LICENSE")
    assert got["a/b/c/d/y.txt"] == ("GPL-3.0", "a/b/c/COPYING")
    assert got["a/b/z.txt"] == ("CC-BY-NC-4.0", "a/b/z.txt")
    assert got["LICENSED/x"] == (None, None) and got["q.txt"] == (None, None)
    assert sorted(str(r["license"]) for r in found if r["path"] is None) == ["MIT", "None"]
    # The skipping of lines without a telling term loses nothing.
    lines, counts = licenses.line_statistics(files, "text")
    scanner = licenses.Scanner(lines, counts)
    every = licenses.Scanner(lines, counts)
    every.telling = set(every.idf)
    for _, text in rows:
        for line in (text or "").split("\n"):
            assert scanner.best(line) == every.best(line)
    assert licenses.license_scan(files.limit(0)).count() == 0


def test_fixity_finds_exactly_the_damage(spark):
    rows = [(i % 190, f"http://h/{i}", "<p>" + "z" * (i * 37 % 3000) + "</p>", i) for i in range(600)] + [(None, None, None, 0)]
    pages = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING, hash INT")
    one = fixity.stored(pages, per_file=200)
    assert one.table().groupBy("file").count().count() == 4
    assert fixity.audit(one, one).count() == 0
    two = fixity.damaged(one, F.col("page_id") == 17, F.col("page_id") == 99)
    found = fixity.audit(one, two).collect()
    assert sorted((r["page_id"], r["status"]) for r in found) == sorted([(17, "changed")] * 4 + [(99, "missing")] * 3)
    assert {r["status"] for r in fixity.audit(two, one).collect()} == {"changed", "extra"}
    lengths = one.table().orderBy("file", "offset").collect()
    assert all(b["offset"] == (a["offset"] + a["length"] if a["file"] == b["file"] else 0) for a, b in zip(lengths, lengths[1:]))
    three = fixity.damaged(one, F.col("page_id") == 17, F.lit(False), F.col("page_id") == 17, F.col("page_id") == 5)
    places = {(r["file"], r["offset"]): r["page_id"] for r in lengths}
    found = sorted((r["status"], r["page_id"], (r["file"], r["offset"] - 2) in places, (r["file"], r["offset"] - 1) in places) for r in fixity.audit(one, three).collect())
    assert found == [("extra", 5, False, True)] * 4 + [("extra", 17, True, False)] * 4 + [("missing", 17, False, False)] * 4
    assert fixity.audit(fixity.stored(pages.limit(0)), fixity.stored(pages.limit(0))).count() == 0


def test_license_blocks_and_counted_weights(spark):
    """Notices over several lines, headings of license files, and notices among common words."""
    prose = "see the file for details on use, copyright 2019 the project authors\n" * 200
    rows = [
        ("a/x.py", prose + "# Permission is hereby granted, free of\n# charge, to any person obtaining a copy of\n# this software and associated\n# documentation files\n"),
        ("b/x.py", prose + "Licensed under the Apache License, Version 2.0, see the file for details on use."),
        ("c/x.py", prose),
        ("d/LICENSE", "Redistribution and use in source\nand binary forms,\nwith or\nwithout\nmodification,\nare permitted\nprovided that\nthe following\nconditions\nare met\n\n" + prose),
    ]
    found = licenses.license_scan(spark.createDataFrame(rows, "path STRING, text STRING")).collect()
    got = {r["path"]: (r["own_license"], round(r["score"] or 0, 2)) for r in found}
    assert got["a/x.py"] == ("MIT", 1.0) and got["d/LICENSE"] == ("BSD-3-Clause", 1.0)
    assert got["b/x.py"][0] == "Apache-2.0" and got["c/x.py"][0] is None


def test_reserved_rights_and_sibling_licenses(spark):
    """An own notice stops inheritance; siblings are not taken for their near neighbour."""
    prose = "the quick brown fox and the lazy dog\n" * 100
    notices = {
        "Proprietary": "All rights reserved.",
        "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
        "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
        "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
        "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
        "CC-BY-4.0": "Licensed under CC BY 4.0.",
        "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
        "MPL-2.0": "Licensed under the Mozilla Public License, Version 2.0.",
        "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    }
    rows = [("a/LICENSE", "Released under the MIT License."), ("a/both", prose + "All rights reserved.\nReleased under the MIT License.")]
    rows += [(f"a/{name}", prose + notice + "\n" + prose) for name, notice in notices.items()]
    found = licenses.license_scan(spark.createDataFrame(rows, "path STRING, text STRING")).collect()
    got = {r["path"]: (r["license"], r["license_from"]) for r in found}
    assert got.pop("a/LICENSE")[0] == "MIT" and got.pop("a/both") == ("MIT", "a/both")
    assert got == {f"a/{name}": (name, f"a/{name}") for name in notices}


def test_identifier_lines_stop_inheritance(spark):
    prose = "some words about nothing at all in this line\n" * 30
    rows = [("a/LICENSE", "Released under the MIT License.\n"), ("a/plain.py", prose), ("a/free.c", prose + "# This is free and unencumbered software released into the public domain.\n")]
    names = {
        "GPL-3.0-only": "GPL-3.0", "GPL-2.0-or-later": "GPL-2.0", "Apache-2.0": "Apache-2.0", "LGPL-2.1-only": "LGPL-2.1",
        "BSD-2-Clause": "BSD-2-Clause", "BSD-3-Clause": "BSD-3-Clause", "ISC": "ISC", "CC0-1.0": "CC0-1.0", "MPL-2.0": "MPL-2.0",
        "MIT": "MIT", "Zlib": "NOASSERTION", "LicenseRef-Own": "NOASSERTION",
    }
    rows += [(f"a/{name}.py", f"# SPDX-License-Identifier: {name}\n" + prose) for name in names]
    found = licenses.license_scan(spark.createDataFrame(rows, "path STRING, text STRING")).collect()
    got = {r["path"]: (r["license"], r["license_from"]) for r in found}
    assert {name: got[f"a/{name}.py"][0] for name in names} == names
    assert all(got[f"a/{name}.py"][1] in (f"a/{name}.py", None) or got[f"a/{name}.py"][1] != "a/LICENSE" for name in names)
    assert got["a/plain.py"][0] == "MIT" and got["a/free.c"][0] == "Unlicense"


def test_nearest_ancestor_matches_brute_force(spark):
    rng = random.Random(11)
    names = ["MIT", "ISC", None]
    rows = []
    for n in range(300):
        path = "/".join([rng.choice("abc") for _ in range(rng.randrange(5))] + [rng.choice(["LICENSE", "COPYING", "x.py", "y.py"]) + (f".{n % 7}" if n % 2 else "")])
        own = rng.choice(names)
        rows.append((n, path, own, rng.choice([0.7, 0.9]) if own else None, "kept", 1, "b"))
    rows.append((300, None, None, None, "kept", 1, "b"))
    schema = "i INT, path STRING, own_license STRING, score DOUBLE, _dir STRING, n INT, _of STRING"
    found = {r["i"]: r for r in licenses.inherit(spark.createDataFrame(rows, schema)).collect()}
    assert all((r["_dir"], r["n"], r["_of"]) == ("kept", 1, "b") for r in found.values())
    import re

    for i, path, own, *_ in rows:
        expected = (own, path if own else None)
        parts = path.split("/")[:-1] if path else []
        for depth in range(len(parts), -1, -1) if path and not own else ():
            here = [(-s, p, o) for _, p, o, s, *_ in rows if p and o and p.split("/")[:-1] == parts[:depth] and re.search(licenses.LICENSE_FILE, p.split("/")[-1])]
            if here:
                expected = (min(here)[2], min(here)[1])
                break
        assert (found[i]["license"], found[i]["license_from"]) == expected, path


def test_long_headers_are_scored_whole_in_linear_time(spark):
    """A header over more lines than a window, in any file; very long texts; clashing names."""
    header = "Redistribution and use in source\nand binary forms,\nwith or\nwithout\nmodification,\nare permitted\nprovided that\nthe following\nconditions\nare met\n\n"
    rows = [("a/x.c", header + "int main\n" * 50, 1, 2), ("a/x.c", header + "int main\n" * 50, 1, 2), ("b/none", None, 1, 2), ("c/" , "   \n", 1, 2)]
    found = licenses.license_scan(spark.createDataFrame(rows, "path STRING, text STRING, _row INT, _best INT")).collect()
    assert sorted((r["path"], r["license"], r["_row"], r["_best"]) for r in found if r["license"]) == [("a/x.c", "BSD-3-Clause", 1, 2)] * 2
    assert len(found) == 4
    scanner = licenses.Scanner(100, {})
    calls = []
    scanner.candidate = lambda found: calls.append(len(found))
    scanner.candidates("Released under the MIT License\n" * 3000)
    assert sum(calls) < 3000 * 200


def test_clashing_names_are_kept(spark):
    from lessonloom.llm import radix, simhash

    docs = spark.createDataFrame(
        [(i, "s", f"text of row {i % 6} " * 9, 7, 8, 9, 10, 11) for i in range(30)],
        "doc_id BIGINT, source STRING, text STRING, _row INT, _rate INT, _n INT, _source INT, _order INT",
    )
    for kept in (radix.drop_exact_duplicates(docs), simhash.drop_near_duplicates(docs), mixing.mix(docs).drop("_copy", "_key")):
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert rows and all(tuple(r)[3:] == (7, 8, 9, 10, 11) for r in rows)
    assert sorted(r["doc_id"] for r in radix.drop_exact_duplicates(docs).collect()) == list(range(6))
    assert all(tuple(r[c] for c in ("_row", "_order")) == (7, 11) for r in packing.pack(docs).collect())
