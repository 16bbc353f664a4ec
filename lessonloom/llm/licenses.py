"""License scans: TF-IDF cosine to templates, then inheritance along directories.

Every line, every window of up to ``WINDOW`` lines and every paragraph of a
license file is a candidate. Terms are weighted by how rare they are among all
lines of the corpus: template terms on the driver, all others by a join of the
few candidates that could reach the threshold if their other terms had the
least weight. A candidate can reach the threshold only if it shares enough of a
template's weight; terms that could never do that alone are found beforehand,
and candidates without any other template term are skipped without loss.

A file without a notice of its own takes the license of the nearest ancestor
directory that holds a license file.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lessonloom.functions.ranks import unused
from lessonloom.llm.tasks import map_batches
from lessonloom.session import with_rows, written

THRESHOLD = 0.6
WINDOW = 6
RESERVED = "Proprietary"
LICENSE_FILE = r"(?i)^(LICEN[SC]E|COPYING)\b"
# Usual notices of well-known licenses, by SPDX name.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    (RESERVED, "All rights reserved."),
    (RESERVED, "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited."),
]
# Identifier lines, by the license they name. An identifier that is none of these is most
# like the line without any, so it is found as unknown and stops inheritance as well.
UNKNOWN = "NOASSERTION"
IDENTIFIERS = [
    "MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "BSD-2-Clause",
    "BSD-3-Clause", "ISC", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "Unlicense",
]
TEMPLATES += [(UNKNOWN, "SPDX-License-Identifier:")]
TEMPLATES += [
    (name, f"SPDX-License-Identifier: {name}{ending}")
    for name in IDENTIFIERS
    for ending in (("", "-only", "-or-later") if "GPL" in name else ("",))
]
_TERM = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


def terms(line: str) -> list[str]:
    return _TERM.findall(line.lower())


def _vocabulary(templates) -> set[str]:
    return {t for _, text in templates for t in terms(text)}


def term_counts(docs: DataFrame, text: str) -> DataFrame:
    """``term, n``: in how many lines of all texts each term stands; the empty term has the number of lines."""

    def run(batches):
        for batch in batches:
            lines, seen = 0, Counter()
            for value in batch.column(0).to_pylist():
                for line in (value or "").split("\n"):
                    lines += 1
                    seen.update(set(terms(line)))
            found = [("", lines), *seen.items()]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found]), pa.array([n for _, n in found])], names=["term", "n"])

    counts = map_batches(docs.select(F.col(text).alias("_t")), run, "term STRING, n BIGINT")
    return counts.groupBy("term").agg(F.sum("n").alias("n"))


def _of_templates(counts: DataFrame, templates) -> tuple[int, dict[str, int]]:
    rows = counts.where(F.col("term").isin(["", *sorted(_vocabulary(templates))])).collect()
    found = {r["term"]: r["n"] for r in rows}
    return found.pop("", 0), found


def line_statistics(docs: DataFrame, text: str, templates=TEMPLATES) -> tuple[int, dict[str, int]]:
    """The number of lines of all texts, and in how many of them each template term
    stands. The result is as small as the templates."""
    return _of_templates(term_counts(docs, text), templates)


class Scanner:
    """Cosines of lines to templates under given corpus statistics."""

    def __init__(self, lines: int, counts: dict[str, int], templates=TEMPLATES, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.unknown = log(1 + lines) + 1
        self.idf = {t: log((1 + lines) / (1 + counts.get(t, 0))) + 1 for t in _vocabulary(templates)}
        self.templates = []
        for name, text in templates:
            weights: dict[str, float] = {}
            for t in terms(text):
                weights[t] = weights.get(t, 0) + self.idf[t]
            self.templates.append((name, weights, sqrt(sum(w * w for w in weights.values()))))
        # The commonest terms whose joint weight stays short of the threshold in every template.
        common: set[str] = set()
        for t in sorted(self.idf, key=lambda t: (self.idf[t], t)):
            grown = common | {t}
            if any(sum(w[x] ** 2 for x in grown if x in w) >= (threshold * norm) ** 2 * (1 - 1e-9) for _, w, norm in self.templates):
                break
            common = grown
        self.telling = set(self.idf) - common

    def candidate(self, found: list[str]) -> tuple[str, float, float, dict[str, int]] | None:
        """Best template, its cosine times the norm of ``found``, the squared norm of
        template terms, and the other terms with their numbers; None if even other
        terms of the least weight, 1, leave it below the threshold."""
        if self.telling.isdisjoint(found):
            return None
        own: dict[str, float] = {}
        rest: dict[str, int] = {}
        for t in found:
            if t in self.idf:
                own[t] = own.get(t, 0) + self.idf[t]
            else:
                rest[t] = rest.get(t, 0) + 1
        square = sum(w * w for w in own.values())
        least = self.threshold * sqrt(square + sum(n * n for n in rest.values())) * (1 - 1e-9)
        top = None
        for name, weights, size in self.templates:
            part = sum(w * weights[t] for t, w in own.items() if t in weights) / size
            if part >= least and (top is None or part > top[1]):
                top = (name, part, square, rest)
        return top

    def best(self, line: str) -> tuple[float, str] | None:
        """Cosine and license of a line whose other terms stand in no line of the corpus."""
        found = self.candidate(terms(line))
        if found is None:
            return None
        name, part, square, rest = found
        score = part / sqrt(square + sum(n * n for n in rest.values()) * self.unknown**2)
        return (score, name) if score >= self.threshold else None

    def candidates(self, text: str | None) -> list[dict]:
        """All candidates of a text: windows of a few lines that begin and end with a
        template term, and whole paragraphs (runs of lines that hold terms)."""
        lines = [terms(line) for line in (text or "").split("\n")]
        spans, end = set(), 0
        for i, found in enumerate(lines):
            if self.telling.isdisjoint(found):
                continue
            for start in range(max(0, i - WINDOW + 1), i + 1):
                for stop in range(i + 1, min(len(lines), start + WINDOW) + 1):
                    if not (self.idf.keys().isdisjoint(lines[start]) or self.idf.keys().isdisjoint(lines[stop - 1])):
                        spans.add((start, stop))
            if i >= end:  # not in the paragraph found last, so every line is passed once
                start, end = i, i + 1
                while start and lines[start - 1]:
                    start -= 1
                while end < len(lines) and lines[end]:
                    end += 1
                spans.add((start, end))
        made = []
        for start, end in sorted(spans):
            if found := self.candidate([t for line in lines[start:end] for t in line]):
                name, part, square, rest = found
                made.append({"line": start, "lines": end - start, "name": name, "part": part, "square": square, "rest": list(rest.items())})
        return made


_CANDIDATES = "array<struct<line:int,lines:int,name:string,part:double,square:double,rest:array<struct<term:string,k:int>>>>"
_ARROW = pa.list_(
    pa.struct(
        [("line", pa.int32()), ("lines", pa.int32()), ("name", pa.string()), ("part", pa.float64()), ("square", pa.float64())]
        + [("rest", pa.list_(pa.struct([("term", pa.string()), ("k", pa.int32())])))]
    )
)


def scan_texts(files: DataFrame, text: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD, path: str = "path") -> DataFrame:
    """``files`` without ``text`` and with ``own_license, score, line``: the best
    candidate, of equals the first and shortest. A reservation of rights counts
    only where no license is granted.

    Null, empty and blank texts have no license of their own. Repeated rows are scanned
    one by one, whole texts whatever their length, in time linear in their lines. Columns
    of ``files`` named like the added ones are replaced, all others kept."""
    counts = written(term_counts(files, text), "terms")
    total, known = _of_templates(counts, templates)
    scanner = Scanner(total, known, templates, threshold)
    keep = [c for c in files.columns if c not in (text, "own_license", "score", "line")]
    row, candidates, top = (unused(files, name) for name in ("_row", "_found", "_best"))
    schema = files.select(*keep).schema.add(candidates, T._parse_datatype_string(_CANDIDATES))

    def run(batches):
        for batch in batches:
            found = pa.array([scanner.candidates(t) for t in batch.column(len(keep)).to_pylist()], _ARROW)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), found], names=[*keep, candidates])

    texts = files.select(*keep, F.col(text).alias(unused(files, "_t")))
    rows = with_rows(map_batches(texts, run, schema), "candidates", row)
    each = rows.select(F.col(row).alias("_row"), F.explode(candidates).alias("f")).select("_row", "f.*")
    idf = F.log(F.lit(1.0 + total) / (1 + F.col("n"))) + 1
    others = each.select("_row", "line", "lines", F.explode("rest").alias("o")).select("_row", "line", "lines", "o.term", "o.k")
    weights = others.join(counts, "term").groupBy("_row", "line", "lines").agg(F.sum((F.col("k") * idf) ** 2).alias("w"))
    score = F.col("part") / F.sqrt(F.col("square") + F.coalesce("w", F.lit(0.0)))
    scored = each.join(weights, ["_row", "line", "lines"], "left").withColumn("score", score).where(F.col("score") >= threshold)
    order = F.struct(
        (F.col("name") == RESERVED).alias("r"), (-F.round("score", 12)).alias("o"), "line", "lines", F.col("name").alias("own_license"), "score"
    )
    best = scored.groupBy(F.col("_row").alias(row)).agg(F.min(order).alias(top))
    return rows.join(best, row, "left").select(*keep, *[F.col(top)[c].alias(c) for c in ("own_license", "score", "line")])


def inherit(scanned: DataFrame, path: str = "path") -> DataFrame:
    """``scanned`` with ``license`` and ``license_from``.

    A file's own license comes first. Otherwise the nearest directory on its
    path, its own included, that holds a license file with a recognised notice
    decides; of several in one directory the best match, then the smallest
    path. Null paths inherit nothing. Only distinct directories are expanded
    to their ancestors, not files. Columns named ``license`` or ``license_from``
    in ``scanned`` are replaced, all others kept.
    """
    keep = [c for c in scanned.columns if c not in ("license", "license_from")]
    home, of, near = (unused(scanned, name) for name in ("_dir", "_of", "_near"))
    folder = F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).when(F.col(path).isNotNull(), "")
    files = scanned.select(*keep, folder.alias(home))
    name = F.element_at(F.split(path, "/"), -1)
    holders = files.where(name.rlike(LICENSE_FILE) & F.col("own_license").isNotNull())
    order = F.struct((-F.col("score")).alias("s"), F.col(path).alias("p"), F.col("own_license").alias("l"))
    licensed = holders.groupBy(F.col(home).alias("_at")).agg(F.min(order).alias("o")).select(
        "_at", F.col("o.l").alias("_l"), F.col("o.p").alias("_p")
    )
    parts = F.split("_dir", "/")
    up = F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda n: F.struct(n.alias("d"), F.concat_ws("/", F.slice(parts, F.lit(1), n)).alias("a")),
    )
    folders = files.select(F.col(home).alias("_dir")).where(F.col("_dir").isNotNull()).distinct()
    steps = folders.select("_dir", F.explode(up).alias("u")).select("_dir", F.col("u.d").alias("_d"), F.col("u.a").alias("_at"))
    nearest = steps.join(licensed, "_at").groupBy(F.col("_dir").alias(of)).agg(
        F.max(F.struct("_d", "_l", "_p")).alias(near)
    )
    met = files.join(nearest, F.col(home) == F.col(of), "left")
    own = F.col("own_license").isNotNull()
    return met.select(
        *keep,
        F.coalesce(F.col("own_license"), F.col(near)["_l"]).alias("license"),
        F.when(own, F.col(path)).otherwise(F.col(near)["_p"]).alias("license_from"),
    )


def license_scan(files: DataFrame, path: str = "path", text: str = "text", **how) -> DataFrame:
    """Scan and inheritance; the scanned rows are written once in between."""
    return inherit(written(scan_texts(files, text, path=path, **how), "scanned"), path)
