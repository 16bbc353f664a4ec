"""Merkle fixity audit of WARC replicas.

Every record is hashed; records whose offsets fall in the same fixed range of
a file form a leaf range, hashed over its records in offset order, and each
FANOUT consecutive ranges form a range of the next level, up to one root per
file. Two replicas are compared root by root, and only branches that differ
are descended to the records. A replica is stored as its records and an index of the
places they have in files; what is hashed is what is read back from it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lessonloom.functions.ranks import global_rank
from lessonloom.session import lasting, scratch, written

RANGE_BYTES, FANOUT = 1 << 16, 16
RECORDS_PER_FILE = 500


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC/1.0 response record as bytes; nulls are empty."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n")).cast("binary")


@dataclass
class Replica:
    """``records`` (place, page_id, record) and ``index`` (place, page_id, file, offset), both stored.

    The index is narrow, so records are neither shuffled nor copied to find their offsets.
    """

    records: DataFrame
    index: DataFrame

    def table(self) -> DataFrame:
        """``file, offset, length, page_id, record``."""
        length = F.octet_length("record").cast("bigint").alias("length")
        return self.index.drop("page_id").join(self.records, "place").select("file", "offset", length, "page_id", "record")


def stored(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", per_file: int = RECORDS_PER_FILE) -> Replica:
    """Pages as WARC records in id order, ``per_file`` to a file, nulls first and repeated
    rows one by one. Records of one id and url come in the order of their hashes; other
    columns of ``pages`` are left out."""
    made = _records(pages, page_id, url, html).withColumn("hash", F.sha2("record", 256))
    ranked = global_rank(made, [], ["page_id", "url", "hash"], "place")
    filed = ranked.select("place", F.floor(F.col("place") / per_file).alias("file"), "length", "page_id")
    before = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0).cast("bigint"))
    index = filed.select("place", "page_id", "file", offset.alias("offset"))
    return Replica(ranked.select("place", "page_id", "record"), written(index, "index"))


def _records(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    record = warc_record(F.col(page_id), F.col(url), F.col(html)).alias("record")
    made = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), record)
    return made.withColumn("length", F.octet_length("record").cast("bigint"))


def record_hashes(replica: Replica) -> DataFrame:
    """``file, offset, length, page_id, hash``, written once.

    Records are hashed and measured where they are read. An entry of the index without
    its record is not there.
    """
    length = F.octet_length("record").cast("bigint").alias("length")
    hashed = replica.records.select("place", length, F.sha2("record", 256).alias("hash"))
    return written(replica.index.join(hashed, "place").select("file", "offset", "length", "page_id", "hash"), "records")


def _parents(nodes: DataFrame, idx: Column, part: Column, order: str) -> DataFrame:
    """Nodes of the next level; a parent has a bounded number of children."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("p"))))
    joined = F.concat_ws("|", F.transform(listed, lambda c: c["p"]))
    return nodes.groupBy("file", idx.alias("idx")).agg(F.sha2(joined, 256).alias("hash"))


def levels(hashes: DataFrame, count: int) -> list[DataFrame]:
    """The tree's levels from leaf ranges to roots, each written once."""
    leaf = F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), "hash")
    at = F.floor(F.col("offset") / RANGE_BYTES).cast("bigint")
    made = [written(_parents(hashes, at, leaf, "offset"), "tree")]
    while len(made) < count:
        up = F.floor(F.col("idx") / FANOUT).cast("bigint")
        part = F.concat_ws(":", F.col("idx").cast("string"), "hash")
        made.append(written(_parents(made[-1], up, part, "idx"), "tree"))
    return made


def _differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    left = a.withColumnRenamed("hash", "hash_a")
    right = b.withColumnRenamed("hash", "hash_b")
    return left.join(right, keys, "full_outer").where(~F.col("hash_a").eqNullSafe(F.col("hash_b")))


def audit(first: Replica, second: Replica) -> DataFrame:
    """``file, offset, page_id, status, hash_a, hash_b`` of all records in which two
    replicas differ.

    ``status`` is changed, missing (not in the second) or extra. A record that
    sits at another offset is missing at one and extra at the other. Equal
    replicas and empty tables give no rows.
    """
    a, b = record_hashes(first), record_hashes(second)
    last = a.union(b).agg(F.max("offset")).first()[0] or 0
    count, ranges = 1, last // RANGE_BYTES + 1
    while ranges > 1:
        count, ranges = count + 1, -(-ranges // FANOUT)
    trees = [levels(x, count) for x in (a, b)]
    bad = _differing(trees[0][-1], trees[1][-1], ["file", "idx"]).select("file", "idx")
    for n in range(count - 2, -1, -1):
        parents = bad.select("file", F.col("idx").alias("_up"))
        down = [
            t[n].withColumn("_up", F.floor(F.col("idx") / FANOUT).cast("bigint")).join(parents, ["file", "_up"], "left_semi").drop("_up")
            for t in trees
        ]
        bad = _differing(*down, ["file", "idx"]).select("file", "idx")
    bad = written(bad, "ranges")
    inside = [
        x.withColumn("idx", F.floor(F.col("offset") / RANGE_BYTES).cast("bigint")).join(bad, ["file", "idx"], "left_semi")
        for x in (a, b)
    ]
    left = inside[0].select("file", "offset", F.col("page_id").alias("_pa"), F.concat_ws(":", F.col("length").cast("string"), "hash").alias("_ka"), F.col("hash").alias("hash_a"))
    right = inside[1].select("file", "offset", F.col("page_id").alias("_pb"), F.concat_ws(":", F.col("length").cast("string"), "hash").alias("_kb"), F.col("hash").alias("hash_b"))
    met = left.join(right, ["file", "offset"], "full_outer").where(~F.col("_ka").eqNullSafe(F.col("_kb")))
    status = F.when(F.col("_kb").isNull(), "missing").when(F.col("_ka").isNull(), "extra").otherwise("changed")
    return met.select("file", "offset", F.coalesce("_pa", "_pb").alias("page_id"), status.alias("status"), "hash_a", "hash_b")


def damaged(replica: Replica, changed: Column, lost: Column, moved: Column | None = None, doubled: Column | None = None) -> Replica:
    """A stored copy that went wrong where the conditions on ``page_id`` hold (null is no):
    the last byte before the record's end marker altered (``changed``), the record gone
    (``lost``), two bytes further on (``moved``), or there once more one byte further on
    (``doubled``)."""
    def survivors(df: DataFrame) -> DataFrame:
        copies = F.array(F.lit(0)) if doubled is None else F.when(doubled, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        kept = df.where(~F.coalesce(lost, F.lit(False))).select("*", F.explode(copies).alias("copy"))
        return kept.withColumn("place", F.col("place") * 2 + F.col("copy"))

    records, index = survivors(replica.records), survivors(replica.index)
    by = F.col("copy") if moved is None else F.col("copy") + F.when(moved, 2).otherwise(0)
    return Replica(
        written(records.select("place", "page_id", _altered(changed).alias("record")), "replica"),
        written(index.select("place", "page_id", "file", (F.col("offset") + by).alias("offset")), "index"),
    )


def _altered(changed: Column) -> Column:
    cut = F.concat(
        F.expr("substring(record, 1, octet_length(record) - 5)"),
        F.unhex(F.lit("00")),
        F.expr("substring(record, octet_length(record) - 3)"),
    )
    hit = F.coalesce(changed, F.lit(False)) & (F.octet_length("record") > 5)
    return F.when(hit, cut).otherwise(F.col("record"))


def audit_damaged(pages: DataFrame) -> DataFrame:
    """Audit of a stored replica of ``pages`` against a second one, in which every 50th
    record is altered, every 211th lost, every 197th moved and every 199th there twice.

    Both replicas are written to the shared folder and read back; they go when the
    audit's rows are written.
    """
    with scratch(pages.sparkSession):
        first, page = stored(pages), F.col("page_id")
        second = damaged(first, page % 50 == 7, page % 211 == 5, page % 197 == 3, page % 199 == 1)
        return lasting(audit(first, second), "audit")
