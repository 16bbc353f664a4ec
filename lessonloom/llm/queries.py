"""Registered queries of the training-data operators, and their reference SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lessonloom.llm import (
    bayes_dedup,
    collocations,
    fixity,
    licenses,
    mixing,
    packing,
    quality,
    radix,
    simhash,
    token_files,
    topk,
    toxicity,
    vector_codes,
)


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_components(_read(spark, folder, "documents"), width=3, threshold=2)


def op2_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files: two levels of directories per source, every fifth file a license
    file, which lie at all three levels."""
    docs = _read(spark, folder, "documents")
    is_license = F.col("doc_id") % 5 == 0
    level = F.when(is_license, F.floor(F.col("doc_id") / 5) % 3).otherwise(2)
    name = F.when(is_license, F.concat(F.lit("LICENSE."), "doc_id")).otherwise(F.concat("doc_id", F.lit(".txt")))
    outer = F.when(level > 0, F.concat(F.lit("d"), F.col("doc_id") % 3))
    inner = F.when(level > 1, F.concat(F.lit("e"), F.floor(F.col("doc_id") / 64)))
    path = F.concat_ws("/", "source", outer, inner, name)
    found = licenses.license_scan(docs.select("doc_id", path.alias("path"), "text"))
    return found.select("doc_id", "path", "own_license", F.round("score", 6).alias("score"), "line", "license", "license_from")


def op3_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(_read(spark, folder, "embeddings"), F.col("id") % 100 == 0, k=10)


def op4_tokens(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return token_files.round_trip(_read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, folder, "documents"))
    text = F.md5(F.coalesce("text", F.lit("")))
    return mixed.select("doc_id", "source", F.col("_copy").alias("copy"), F.col("_key").alias("shuffle_key"), text.alias("text_md5"))


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(_read(spark, folder, "documents"))
    text = F.md5(F.coalesce("text", F.lit("")))
    return packed.select("doc_id", "n_tokens", "bucket_len", "batch", "slot", "padding", text.alias("text_md5"))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_scores(_read(spark, folder, "documents"), _read(spark, folder, "labels"))


def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    groups = radix.exact_groups(_read(spark, folder, "documents"))
    kept = F.col("_row") == F.col("keep_row")
    return groups.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def op9_warc_fixity(spark: SparkSession, folder: str) -> DataFrame:
    return fixity.audit_damaged(_read(spark, folder, "pages"))


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(_read(spark, folder, "documents"), _read(spark, folder, "labels"))


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(_read(spark, folder, "documents"))


def op12_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return bayes_dedup.near_duplicate_groups(_read(spark, folder, "documents"))


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.vector_codes(_read(spark, folder, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash,
        op2_licenses,
        op3_topk,
        op4_tokens,
        op5_mixing,
        op6_packing,
        op7_toxicity,
        op8_exact_dedup,
        op9_warc_fixity,
        op10_quality,
        op11_collocations,
        op12_minhash,
        op13_vector_codes,
    )
}

MIXED = """
sizes AS (
  SELECT source, sum(length(coalesce(text, '')) + 1) AS size FROM {docs} GROUP BY source),
rates AS (
  SELECT source, pow(size, 0.5) / (SELECT sum(pow(size, 0.5)) FROM sizes)
    * (SELECT sum(size) FROM sizes) / size AS rate FROM sizes),
masses AS (
  SELECT source, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS mass
  FROM rates, LATERAL (SELECT unnest(range(0, CAST(rate + 20 * sqrt(rate) + 50 AS BIGINT))) AS k)),
cumulative AS (
  SELECT source, k, sum(mass) OVER (PARTITION BY source ORDER BY k) AS upto FROM masses),
drawn AS (
  SELECT d.*, (CAST('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT)
    / 4503599627370496.0) AS u FROM {docs} d),
counted AS (
  SELECT d.*, (SELECT count(*) FROM cumulative c
    WHERE c.source IS NOT DISTINCT FROM d.source AND c.upto <= d.u) AS n FROM drawn d),
mixed AS (
  SELECT * EXCLUDE (u, n, copy), copy FROM counted, LATERAL (SELECT unnest(range(0, n)) AS copy))"""

LENGTHS = """
lengths AS (
  SELECT d.*, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) + 1 AS n_tokens FROM {docs} d),
cells AS (
  SELECT row_number() OVER (ORDER BY n_tokens) AS j, n_tokens AS longest,
    sum(n) OVER (ORDER BY n_tokens) AS docs, sum(n * n_tokens) OVER (ORDER BY n_tokens) AS tokens
  FROM (SELECT n_tokens, count(*) AS n FROM lengths GROUP BY n_tokens)),
edges AS (SELECT j, longest, docs, tokens FROM cells UNION ALL SELECT 0, 0, 0, 0),
best AS (
  SELECT 0 AS b, 0 AS j, CAST(0 AS HUGEINT) AS cost
  UNION ALL
  SELECT b + 1, c.j, min(best.cost + c.longest * (c.docs - e.docs) - (c.tokens - e.tokens))
  FROM best JOIN edges e ON e.j = best.j JOIN cells c ON c.j > best.j
  WHERE b < (SELECT least(8, count(*)) FROM cells)
  GROUP BY b, c.j),
walk AS (
  SELECT (SELECT least(8, count(*)) FROM cells) AS b, (SELECT max(j) FROM cells) AS j
  UNION ALL
  SELECT w.b - 1, (SELECT min(p.j) FROM best p JOIN edges e ON e.j = p.j, best q, cells c
    WHERE p.b = w.b - 1 AND p.j < w.j AND q.b = w.b AND q.j = w.j AND c.j = w.j
      AND p.cost + c.longest * (c.docs - e.docs) - (c.tokens - e.tokens) = q.cost)
  FROM walk w WHERE w.b > 1),
ends AS (SELECT longest FROM walk JOIN cells USING (j)),
bucketed AS (
  SELECT l.*, (SELECT min(longest) FROM ends WHERE longest >= n_tokens) AS bucket_len FROM lengths l),
ranked AS (
  SELECT *, greatest(1, 65536 // bucket_len) AS per_batch,
    row_number() OVER (PARTITION BY bucket_len ORDER BY md5('23|' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS r
  FROM bucketed)"""

PACKED = """
SELECT doc_id, n_tokens, bucket_len, r // per_batch AS batch, r % per_batch AS slot,
  bucket_len - n_tokens AS padding, md5(coalesce(text, '')) AS text_md5 FROM ranked"""



def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Assignments and averages round by round; each round is three more tables."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
distance{r} AS (
  SELECT c.rn, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x)) AS d
  FROM components c JOIN book{r} b USING (part, pos) GROUP BY ALL),
assigned{r} AS (
  SELECT rn, part, arg_min(entry, d * {entries} + entry) AS entry, min(d) AS d FROM distance{r} GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""
averaged{r} AS (
  SELECT part, entry, pos, sum(x) AS s, count(*) AS n
  FROM components JOIN assigned{r} USING (rn, part) GROUP BY ALL),
book{r + 1} AS (
  SELECT part, entry, pos, coalesce(CAST((s - ((s % n) + n) % n) // n AS BIGINT), b.x) AS x
  FROM book{r} b LEFT JOIN averaged{r} USING (part, entry, pos))""")
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS rn, vec_id, label,
    [CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
components AS MATERIALIZED (
  SELECT rn, i // (len(v) // {parts}) AS part, i % (len(v) // {parts}) AS pos, v[i + 1] AS x
  FROM kept, LATERAL (SELECT unnest(range(0, len(v))) AS i)),
book0 AS (SELECT part, rn AS entry, pos, x FROM components WHERE rn < {entries}),{",".join(steps)},
coded AS (
  SELECT rn, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM assigned{rounds} GROUP BY rn),
labelled AS (SELECT vec_id, label, code, error FROM coded JOIN kept USING (rn))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM book{rounds}) AS codebooks_sha256
FROM labelled"""


_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

COLLOCATIONS = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex({_LOWERED.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
phrases AS (
  SELECT lang, k, array_to_string(g, ' ') AS phrase, count(*) AS f FROM (
    SELECT lang, k, unnest([w[i : i + k - 1] FOR i IN range(1, len(w) - k + 2)]) AS g
    FROM lists, LATERAL (SELECT unnest([1, 2, 3]) AS k)) GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM lists GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM phrases WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.phrase, c.k, c.a, cut, l.f AS l, r.f AS r,
    CAST(1000000 * CAST(a AS HUGEINT) * a // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) c
  JOIN phrases l ON l.lang = c.lang AND l.phrase = array_to_string(w[1 : cut], ' ')
  JOIN phrases r ON r.lang = c.lang AND r.phrase = array_to_string(w[cut + 1 : c.k], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM candidates WHERE k = 3
    UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM candidates WHERE k = 3) GROUP BY ALL),
ranked AS (
  SELECT c.lang, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, c.a DESC, phrase) AS rank,
    phrase, c.a, l, r, n, score
  FROM lowest c JOIN totals USING (lang) LEFT JOIN inside i USING (lang, phrase)
  WHERE c.k = 3 OR i.a IS NULL OR 100 * i.a < 50 * c.a)
SELECT * FROM ranked WHERE rank <= 2000"""

NEAR_GROUPS = f"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all({_LOWERED.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT row, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM words),
shingles AS (SELECT row, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.row AS x, b.row AS y FROM shingles a JOIN shingles b ON a.g = b.g AND a.row <> b.row
  GROUP BY a.row, b.row, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reached AS (SELECT row AS x, row AS y FROM sets UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x),
lowest AS (SELECT r.x AS row, min(s.doc_id) AS component_id FROM reached r JOIN sets s ON s.row = r.y GROUP BY r.x)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM sets JOIN lowest USING (row)"""

ORACLES = {
    "op11_collocations": COLLOCATIONS,
    "op12_minhash": NEAR_GROUPS,
    "op13_vector_codes": _codes_sql(),
    "op5_mixing": "WITH" + MIXED.format(docs="documents") + """
SELECT doc_id, source, copy, md5('17-order|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || copy) AS shuffle_key,
  md5(coalesce(text, '')) AS text_md5 FROM mixed""",
    "op6_packing": "WITH RECURSIVE" + LENGTHS.format(docs="documents") + PACKED,
    "op8_exact_dedup": """
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)""",
    "op3_topk": """
WITH v AS (
  SELECT vec_id, [CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 10""",
    "op9_warc_fixity": """
WITH r AS (
  SELECT page_id, (row_number() OVER (ORDER BY page_id, url, html) - 1) AS n,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:'
    || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
    || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM pages),
o AS (
  SELECT page_id, n // 500 AS file, encode(record) AS record, coalesce(sum(strlen(record)) OVER (
    PARTITION BY n // 500 ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r),
h AS (
  SELECT file, CAST(before AS BIGINT) AS a, page_id, sha256(record) AS hash_a,
    CASE WHEN page_id % 50 = 7 THEN sha256(record[:octet_length(record) - 5] || '\\x00'::BLOB
      || record[octet_length(record) - 3:]) ELSE sha256(record) END AS hash_b,
    coalesce(page_id % 50 = 7, false) AS changed, coalesce(page_id % 211 = 5, false) AS lost,
    coalesce(page_id % 197 = 3, false) AS moved, coalesce(page_id % 199 = 1, false) AS doubled FROM o),
b AS (SELECT *, a + CASE WHEN moved THEN 2 ELSE 0 END AS b FROM h WHERE NOT lost)
SELECT file, a AS "offset", page_id, 'missing' AS status, hash_a, NULL AS hash_b FROM h WHERE lost OR moved
UNION ALL SELECT file, a, page_id, 'changed', hash_a, hash_b FROM b WHERE changed AND NOT moved
UNION ALL SELECT file, b, page_id, 'extra', NULL, hash_b FROM b WHERE moved
UNION ALL SELECT file, b + 1, page_id, 'extra', NULL, hash_b FROM b WHERE doubled""",
}
