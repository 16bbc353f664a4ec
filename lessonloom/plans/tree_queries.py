"""Queries over the standards tree, with their reference SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lessonloom.functions.lookups import lookup
from lessonloom.operators import ingest, quality, search_index, tree
from lessonloom.operators.prompts import BLOOM_DEFAULT, BLOOM_EXPECTATIONS, bloom_expectation
from lessonloom.plans import bindings as b
from lessonloom.session import fresh_dir
from lessonloom.sources import store
from lessonloom.sources.json_docs import read_standards
from lessonloom.sources.tables import read_table, read_texts

JSON_ROWS = 8192  # documents in a file of JSON lines, which is one split when compressed
SLUG, GRADE, STRAND, TERM = "asia", "1-URGENT", "NATION_7", "Urgent"

TREE_COLUMNS = (
    "subject, slug, strand_id, strand_name, sub_strand_id, sub_strand_name, indicator_code, "
    "indicator_text, indicator_blooms, indicator_grade"
)


def _tree_query(build):
    return lambda spark, folder: build(b.tree(spark, folder))


def _as_json(tree_docs: DataFrame, grade: str | None) -> DataFrame:
    return tree_docs.select(
        "subject",
        F.lit(grade or "all").alias("grade"),
        "strand_id",
        "name",
        "part",
        F.to_json("subStrands").alias("sub_strands_json"),
    )


def _levels(tables: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    parts = [df.select(F.lit(level).alias("level"), *columns) for level, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def _labels(spark, folder) -> DataFrame:
    """Labels for all subjects but two, which fall back to their slug."""
    region = read_table(spark, folder, "region")
    return region.where(~F.col("r_name").isin("AFRICA", "EUROPE")).select(
        F.lower("r_name").alias("slug"), F.initcap("r_name").alias("label")
    )


LABELS_SQL = """
labels_dim AS (
  SELECT lower(r_name) AS slug,
    array_to_string(list_transform(string_split(lower(r_name), ' '),
      lambda w: upper(w[1]) || w[2:]), ' ') AS label
  FROM region WHERE r_name NOT IN ('AFRICA', 'EUROPE'))
"""


def label_lookup(spark, folder) -> DataFrame:
    rows = tree.counts(b.tree(spark, folder), "strand").select("strand_id", "indicators")
    strands = b.tree(spark, folder)["strands"].withColumnRenamed("id", "strand_id")
    subjects = b.tree(spark, folder)["subjects"].select(F.col("id").alias("subject_id"), "slug")
    keyed = rows.join(strands, "strand_id").join(subjects, "subject_id")
    return lookup(keyed, _labels(spark, folder), "slug", "slug", "label", "subject_label").select(
        "strand_id", "slug", "subject_label", "indicators"
    )


def request_rows(spark, folder) -> DataFrame:
    return tree.to_requests(tree.tree_rows(b.tree(spark, folder)), _labels(spark, folder))


def bloom_lookup(spark, folder) -> DataFrame:
    return b.requests(read_table(spark, folder, "part")).select(
        "request_id", "bloomsLevel", bloom_expectation(F.col("bloomsLevel")).alias("expectation")
    )


def tree_normalize(spark, folder) -> DataFrame:
    """Four tables of one corpus of nested documents, each level in turn."""
    return _normalized(_corpus(spark, folder))


def json_standards(spark, folder) -> DataFrame:
    """The same corpus as JSON documents, one per line, written and read back."""
    path = fresh_dir(spark, "standards")
    # Copies of a text at three levels compress well; small files keep the reading tasks small.
    whole = _corpus(spark, folder).select("subject", "strands")
    whole.write.option("maxRecordsPerFile", JSON_ROWS).json(path, compression="gzip")
    return _normalized(read_standards(spark, path, multi_line=False))


def _corpus(spark, folder) -> DataFrame:
    docs = b.subject_docs(read_texts(spark, folder, "documents", "doc_id"))
    slug = F.concat_ws("-", "subject.slug", F.col("doc_id").cast("string"))
    return docs.withColumn("subject", F.struct(F.col("subject.name").alias("name"), slug.alias("slug")))


def _normalized(docs: DataFrame) -> DataFrame:
    t = ingest.normalize_tree(docs)
    none = F.lit(None).cast("string")
    levels = {
        "subjects": t["subjects"].select("id", none.alias("parent_id"), F.col("slug").alias("name")),
        "strands": t["strands"].select("id", F.col("subject_id").alias("parent_id"), "name"),
        "sub_strands": t["sub_strands"].select("id", F.col("strand_id").alias("parent_id"), "name"),
        "indicators": t["indicators"].select(
            "id", F.col("sub_strand_id").alias("parent_id"), F.concat("code", "text").alias("name")
        ),
    }
    return _levels(levels, ["id", "parent_id", "name"])


_NORMALIZE_SQL = f"""
WITH documents_1 AS (SELECT doc_id, text, lang, source || '-' || doc_id AS source FROM documents),
{b.SUBJECT_DOCS_SQL.replace("FROM documents,", "FROM documents_1,")},
ids AS (
  SELECT *, sha256(slug) AS subject_key,
    sha256(slug || chr(31) || sp || chr(31) || strand) AS strand_key
  FROM d_ind),
ids2 AS (
  SELECT *, sha256(strand_key || chr(31) || bp || chr(31) || sub) AS sub_key FROM ids)
SELECT 'subjects' AS level, sha256(lang || '-' || source) AS id, NULL AS parent_id,
       lang || '-' || source AS name FROM documents_1
UNION ALL
SELECT 'strands', sha256(slug || chr(31) || sp || chr(31) || strand), sha256(slug), strand
FROM d_strand
UNION ALL
SELECT DISTINCT 'sub_strands', sub_key, strand_key, sub FROM ids2
UNION ALL
SELECT 'indicators', sha256(sub_key || chr(31) || ip || chr(31) || code), sub_key, code || clause
FROM ids2
"""


def insert_subtrees(spark, folder) -> DataFrame:
    """Subjects already there are skipped whole; of equal new ones the first counts."""
    docs = b.subject_docs(read_texts(spark, folder, "documents", "doc_id"))
    existing = docs.select(F.col("subject.slug").alias("slug")).where(F.col("slug").startswith("de"))
    t = ingest.insert_new_subtrees(existing, docs, "doc_id")
    return _levels(
        {
            "subjects": t["subjects"].select(F.col("slug").alias("name")),
            "strands": t["strands"].select("name"),
            "sub_strands": t["sub_strands"].select("name"),
            "indicators": t["indicators"].select(F.concat_ws("|", "code", "text").alias("name")),
        },
        ["name"],
    )


_SUBTREES_SQL = f"""
WITH {b.SUBJECT_DOCS_SQL},
winners AS (
  SELECT min(doc_id) AS doc_id FROM documents
  WHERE lang <> 'de' GROUP BY lang, source)
SELECT 'subjects' AS level, lang || '-' || source AS name FROM documents
WHERE doc_id IN (SELECT doc_id FROM winners)
UNION ALL
SELECT 'strands', strand FROM d_strand WHERE doc_id IN (SELECT doc_id FROM winners)
UNION ALL
SELECT 'sub_strands', sub FROM d_sub WHERE doc_id IN (SELECT doc_id FROM winners)
UNION ALL
SELECT 'indicators', code || '|' || clause FROM (
  SELECT *, row_number() OVER (PARTITION BY code ORDER BY slug, sp, bp, ip) AS rn
  FROM d_ind WHERE doc_id IN (SELECT doc_id FROM winners)) WHERE rn = 1
"""


def load_tree(spark, folder) -> DataFrame:
    """Two stored loads: all but one language, then everything, of which only new
    subjects and new codes are added."""
    home = fresh_dir(spark, "stored")
    docs = b.subject_docs(read_texts(spark, folder, "documents", "doc_id"))
    store.load_standards(spark, docs.where(~F.col("subject.slug").startswith("de")), home, "doc_id", "first")
    store.load_standards(spark, docs, home, "doc_id", "second")
    t = store.read_tree(spark, home)
    levels = {level: t[level].select("name") for level in ("subjects", "strands", "sub_strands")}
    return _levels(levels | {"indicators": t["indicators"].select(F.concat_ws("|", "code", "text").alias("name"))}, ["name"])


_LOADED_SQL = f"""
WITH {b.SUBJECT_DOCS_SQL},
winners AS (SELECT min(doc_id) AS doc_id, lang = 'de' AS second FROM documents GROUP BY lang, source)
SELECT 'subjects' AS level, 'Subject ' || lang || '-' || source AS name FROM documents
WHERE doc_id IN (SELECT doc_id FROM winners)
UNION ALL
SELECT 'strands', strand FROM d_strand WHERE doc_id IN (SELECT doc_id FROM winners)
UNION ALL
SELECT 'sub_strands', sub FROM d_sub WHERE doc_id IN (SELECT doc_id FROM winners)
UNION ALL
SELECT 'indicators', code || '|' || clause FROM (
  SELECT *, row_number() OVER (PARTITION BY code ORDER BY second, slug, sp, bp, ip) AS rn
  FROM d_ind JOIN winners USING (doc_id)) WHERE rn = 1
"""


def delete_tree(spark, folder) -> DataFrame:
    """A stored load; the subjects of two languages are deleted, those of one loaded again."""
    home = fresh_dir(spark, "stored")
    docs = b.subject_docs(read_texts(spark, folder, "documents", "doc_id"))
    store.load_standards(spark, docs, home, "doc_id", "first")
    slug = F.col("slug")
    gone = store.read_tree(spark, home)["subjects"].where(slug.startswith("en") | slug.startswith("fr"))
    store.delete_subjects(spark, home, gone.select("id"), "two languages")
    store.load_standards(spark, docs.where(F.col("subject.slug").startswith("en")), home, "doc_id", "again")
    t = store.read_tree(spark, home)
    levels = {level: t[level].select("name") for level in ("subjects", "strands", "sub_strands")}
    return _levels(levels | {"indicators": t["indicators"].select(F.concat_ws("|", "code", "text").alias("name"))}, ["name"])


_DELETED_SQL = f"""
WITH {b.SUBJECT_DOCS_SQL},
winners AS (SELECT min(doc_id) AS doc_id, lang FROM documents GROUP BY lang, source),
kept AS (SELECT * FROM winners WHERE lang <> 'fr'),
firsts AS (
  SELECT *, row_number() OVER (PARTITION BY code ORDER BY slug, sp, bp, ip) AS rn FROM d_ind JOIN winners USING (doc_id))
SELECT 'subjects' AS level, 'Subject ' || lang || '-' || source AS name FROM documents
WHERE doc_id IN (SELECT doc_id FROM kept)
UNION ALL
SELECT 'strands', strand FROM d_strand WHERE doc_id IN (SELECT doc_id FROM kept)
UNION ALL
SELECT 'sub_strands', sub FROM d_sub WHERE doc_id IN (SELECT doc_id FROM kept)
UNION ALL
SELECT 'indicators', code || '|' || clause FROM (
  SELECT *, row_number() OVER (PARTITION BY code ORDER BY lang = 'en', slug, sp, bp, ip) AS again
  FROM firsts f JOIN kept USING (doc_id, lang)
  WHERE lang = 'en' OR rn = 1) WHERE again = 1
"""


def tree_search_indexed(spark, folder) -> DataFrame:
    """The keyword search over stored postings of the whole tree."""
    home = fresh_dir(spark, "index")
    rows = tree.tree_rows(b.tree(spark, folder))
    search_index.build_index(rows, home)
    schema = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
    return search_index.search_indexed(spark, home, TERM, schema)


LINE_KEY = ["l_orderkey", "l_linenumber"]
LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey"]


def dedupe_first(spark, folder) -> DataFrame:
    return ingest.first_per_key(read_table(spark, folder, "lineitem"), LINE_KEY, LINE_ORDER)


def insert_ignore(spark, folder) -> DataFrame:
    """Returned lines are in the table already; the others are inserted."""
    lines = read_table(spark, folder, "lineitem")
    existing = lines.where(F.col("l_returnflag") == "R")
    new = lines.where(F.col("l_returnflag") != "R")
    return ingest.insert_ignore(existing, new, LINE_KEY, LINE_ORDER)


_LINE_RANK = """
row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
           l_returnflag, l_linestatus)
"""


def cascade_delete(spark, folder) -> DataFrame:
    tables = b.tree(spark, folder)
    ids = tree.subject_by_slug(tables["subjects"], SLUG).select("id")
    kept = ingest.cascade_delete(tables, ids)
    return _levels(
        {level: df.select(F.col("id").cast("bigint").alias("id")) for level, df in kept.items()},
        ["id"],
    )


def nested_search(tables) -> DataFrame:
    return _as_json(tree.search_nested(tree.nest(tables, SLUG), TERM), None)


def _json_sql(where: str, grade: str, after: str = "true") -> str:
    """``after`` filters rows that already have their pages."""
    return f"""
WITH {b.TREE_SQL},
paged AS (
  SELECT *, (row_number() OVER (PARTITION BY strand_id
    ORDER BY sub_strand_id, indicator_code, indicator_text) - 1) // {tree.PAGE_SIZE} AS part
  FROM tree WHERE {where}),
subs AS (
  SELECT subject, strand_id, strand_name, part, sub_strand_id, sub_strand_name,
    list({{'code': indicator_code, 'text': indicator_text, 'bloomsLevel': indicator_blooms,
          'grade': indicator_grade}} ORDER BY indicator_code) AS indicators
  FROM paged WHERE {after} GROUP BY ALL)
SELECT subject, '{grade}' AS grade, strand_id, strand_name AS name, part,
  CAST(to_json(list({{'name': sub_strand_name, 'indicators': indicators}} ORDER BY sub_strand_id))
    AS VARCHAR) AS sub_strands_json
FROM subs GROUP BY subject, strand_id, strand_name, part
"""


_SEARCH = "contains(lower(indicator_text), 'urgent') OR contains(lower(indicator_code), 'urgent')"
_PLURAL = "|| ' indicator' || CASE WHEN count(*) <> 1 THEN 's' ELSE '' END AS label"
_BLOOM_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in BLOOM_EXPECTATIONS.items())
_AUDIT_NULLS = " UNION ALL ".join(
    f"SELECT '{level}.{column} not null' AS \"check\", "
    f"count(*) FILTER (WHERE {column} IS NULL) AS violations FROM {level}"
    for level, columns in {
        "subjects": ["id", "name", "slug", "created_at"],
        "strands": ["id", "subject_id", "name"],
        "sub_strands": ["id", "strand_id", "name"],
        "indicators": ["id", "sub_strand_id", "code", "text", "blooms_level", "grade"],
    }.items()
    for column in columns
)

QUERIES = {
    "subjects_all": _tree_query(lambda t: t["subjects"]),
    "subject_by_slug": _tree_query(lambda t: tree.subject_by_slug(t["subjects"], SLUG)),
    "tree_rows": _tree_query(tree.tree_rows),
    "tree_filter": _tree_query(lambda t: tree.tree_rows(t, SLUG, GRADE)),
    "tree_search": _tree_query(lambda t: tree.search(tree.tree_rows(t), TERM)),
    "tree_search_indexed": tree_search_indexed,
    "tree_search_nested": _tree_query(nested_search),
    "strand_indicators": _tree_query(
        lambda t: tree.strand_indicators(t, SLUG, GRADE, STRAND)
    ),
    "curriculum_tree": _tree_query(tree.nest),
    "curriculum_tree_json": _tree_query(
        lambda t: _as_json(tree.nest(t, SLUG, GRADE), GRADE)
    ),
    "curriculum_tree_all_json": _tree_query(lambda t: _as_json(tree.nest(t), None)),
    "tree_flatten": _tree_query(lambda t: tree.flatten(tree.nest(t))),
    "count_by_substrand": _tree_query(lambda t: tree.counts(t, "sub_strand")),
    "count_by_strand": _tree_query(lambda t: tree.counts(t, "strand")),
    "tree_totals": _tree_query(tree.totals),
    "coverage": _tree_query(tree.coverage),
    "label_lookup": label_lookup,
    "request_rows": request_rows,
    "bloom_expectation": bloom_lookup,
    "tree_normalize": tree_normalize,
    "json_standards": json_standards,
    "insert_subtrees": insert_subtrees,
    "load_tree": load_tree,
    "delete_tree": delete_tree,
    "dedupe_first": dedupe_first,
    "insert_ignore": insert_ignore,
    "cascade_delete": cascade_delete,
    "constraint_audit": lambda spark, folder: quality.constraint_audit(
        b.broken_tree(spark, folder)
    ),
}

ORACLES = {
    "subjects_all": f"WITH {b.TREE_SQL} SELECT * FROM subjects",
    "subject_by_slug": f"WITH {b.TREE_SQL} SELECT * FROM subjects WHERE slug = '{SLUG}'",
    "tree_rows": f"WITH {b.TREE_SQL} SELECT {TREE_COLUMNS} FROM tree",
    "tree_filter": f"""WITH {b.TREE_SQL} SELECT {TREE_COLUMNS} FROM tree
        WHERE slug = '{SLUG}' AND indicator_grade = '{GRADE}'""",
    "tree_search": f"WITH {b.TREE_SQL} SELECT {TREE_COLUMNS} FROM tree WHERE {_SEARCH}",
    "tree_search_indexed": f"WITH {b.TREE_SQL} SELECT {TREE_COLUMNS} FROM tree WHERE {_SEARCH}",
    "tree_search_nested": _json_sql(f"slug = '{SLUG}'", "all", _SEARCH),
    "strand_indicators": f"""WITH {b.TREE_SQL}
        SELECT indicator_code AS code, indicator_text AS text, indicator_blooms AS blooms_level,
          indicator_grade AS grade, sub_strand_name AS sub_strand
        FROM tree
        WHERE slug = '{SLUG}' AND indicator_grade = '{GRADE}' AND strand_name = '{STRAND}'""",
    "curriculum_tree_json": _json_sql(f"slug = '{SLUG}' AND indicator_grade = '{GRADE}'", GRADE),
    "curriculum_tree_all_json": _json_sql("true", "all"),
    "tree_flatten": f"""WITH {b.TREE_SQL}
        SELECT {TREE_COLUMNS.replace(" sub_strand_id,", "")} FROM tree""",
    "count_by_substrand": f"""WITH {b.TREE_SQL}
        SELECT strand_id, strand_name, sub_strand_id, sub_strand_name, count(*) AS indicators,
          count(*) {_PLURAL} FROM tree GROUP BY ALL""",
    "count_by_strand": f"""WITH {b.TREE_SQL}
        SELECT strand_id, strand_name, count(*) AS indicators, count(*) {_PLURAL}
        FROM tree GROUP BY ALL""",
    "tree_totals": f"""WITH {b.TREE_SQL}
        SELECT count(DISTINCT strand_id) AS strands, count(*) AS indicators FROM tree""",
    "coverage": f"""WITH {b.TREE_SQL}
        SELECT slug, CASE WHEN grouping(slug) = 0 THEN max(subject) END AS subject,
          indicator_grade AS grade, count(DISTINCT strand_id) AS strands, count(*) AS indicators,
          grouping_id(slug, indicator_grade) AS level
        FROM tree GROUP BY ROLLUP (slug, indicator_grade)""",
    "label_lookup": f"""WITH {b.TREE_SQL}, {LABELS_SQL}
        SELECT t.strand_id, t.slug, coalesce(d.label, t.slug) AS subject_label,
          count(*) AS indicators
        FROM tree t LEFT JOIN labels_dim d ON t.slug = d.slug GROUP BY ALL""",
    "request_rows": f"""WITH {b.TREE_SQL}, {LABELS_SQL}
        SELECT indicator_code AS code, indicator_text AS text,
          coalesce(d.label, t.slug) AS subject, indicator_grade AS grade, strand_name AS strand,
          sub_strand_name AS "subStrand", indicator_blooms AS "bloomsLevel"
        FROM tree t LEFT JOIN labels_dim d ON t.slug = d.slug""",
    "bloom_expectation": f"""WITH {b.REQUESTS_SQL}
        SELECT request_id, "bloomsLevel",
          CASE lower(coalesce("bloomsLevel", 'Understand')) {_BLOOM_CASES}
          ELSE '{BLOOM_DEFAULT.replace("'", "''")}' END AS expectation
        FROM requests""",
    "tree_normalize": _NORMALIZE_SQL,
    "json_standards": _NORMALIZE_SQL,
    "insert_subtrees": _SUBTREES_SQL,
    "load_tree": _LOADED_SQL,
    "delete_tree": _DELETED_SQL,
    "dedupe_first": f"""SELECT * EXCLUDE (rn) FROM (SELECT *, {_LINE_RANK} AS rn FROM lineitem)
        WHERE rn = 1""",
    "insert_ignore": f"""SELECT * EXCLUDE (rn) FROM (
          SELECT *, {_LINE_RANK} AS rn FROM lineitem WHERE l_returnflag <> 'R') n
        WHERE rn = 1 AND NOT EXISTS (
          SELECT 1 FROM lineitem e WHERE e.l_returnflag = 'R'
            AND e.l_orderkey = n.l_orderkey AND e.l_linenumber = n.l_linenumber)""",
    "cascade_delete": f"""WITH {b.TREE_SQL}
        SELECT 'subjects' AS level, CAST(id AS BIGINT) AS id FROM subjects WHERE slug <> '{SLUG}'
        UNION ALL
        SELECT 'strands', t.id FROM strands t JOIN subjects s ON t.subject_id = s.id
        WHERE slug <> '{SLUG}'
        UNION ALL
        SELECT 'sub_strands', b.id FROM sub_strands b JOIN strands t ON b.strand_id = t.id
          JOIN subjects s ON t.subject_id = s.id WHERE slug <> '{SLUG}'
        UNION ALL
        SELECT 'indicators', i.id FROM indicators i JOIN sub_strands b ON i.sub_strand_id = b.id
          JOIN strands t ON b.strand_id = t.id JOIN subjects s ON t.subject_id = s.id
        WHERE slug <> '{SLUG}'""",
    "constraint_audit": f"""WITH {b.BROKEN_SQL} {_AUDIT_NULLS}
        UNION ALL SELECT 'subjects.slug unique', count(*) FROM (
          SELECT slug FROM subjects WHERE slug IS NOT NULL GROUP BY slug HAVING count(*) > 1)
        UNION ALL SELECT 'indicators.code unique', count(*) FROM (
          SELECT code FROM indicators WHERE code IS NOT NULL GROUP BY code HAVING count(*) > 1)
        UNION ALL SELECT 'strands.subject_id references subjects', count(*) FROM strands
          WHERE subject_id IS NOT NULL AND subject_id NOT IN (SELECT id FROM subjects)
        UNION ALL SELECT 'sub_strands.strand_id references strands', count(*) FROM sub_strands
          WHERE strand_id IS NOT NULL AND strand_id NOT IN (SELECT id FROM strands)
        UNION ALL SELECT 'indicators.sub_strand_id references sub_strands', count(*)
          FROM indicators
          WHERE sub_strand_id IS NOT NULL AND sub_strand_id NOT IN (SELECT id FROM sub_strands)""",
}
