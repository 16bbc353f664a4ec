"""The live lesson count: a state of one row per lesson id in runs that are only added to.

A bucket holds the ids whose hash ends in its ``prefix`` of ``depth`` bits. A batch is
reduced to the latest row per id and writes one run per bucket with just the ids it
changes. ``FANOUT`` runs of a bucket that are of like size are merged into one, so a
row is rewritten about once per power of ``FANOUT`` that its bucket grows by. A bucket
of more than ``most`` rows is split by one more bit of the hash, or as many as it
takes. An index, one row per bucket, names the valid runs and the number of existing
lessons of each.

A batch reads the index before it and writes under its own number. Run again after a
failure it overwrites its own output, and an event delivered again changes nothing, so
neither counts twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lessonloom.operators.lessons import latest_per_id
from lessonloom.session import drop_dir, path_exists

# Buckets of a new state, a power of two; rows from which a bucket is split; runs of
# like size that are merged into one.
BUCKETS, BUCKET_ROWS, FANOUT = 32, 1_000_000, 4
_MOST_BITS = 30
STATE_SCHEMA = "id STRING, op STRING, ts TIMESTAMP_NTZ, seq BIGINT"
_RUN = "STRUCT<version: BIGINT, merged: BOOLEAN, size: BIGINT>"
INDEX_SCHEMA = f"depth INT, prefix INT, lessons BIGINT, runs ARRAY<{_RUN}>"

Bucket = tuple[int, int]  # depth, prefix
Run = tuple[int, bool, int]  # batch, whether merged, rows
Index = dict[Bucket, tuple[int, list[Run]]]  # lessons, runs


def _index(spark: SparkSession, path: str, epoch: int) -> Index:
    """Lessons and runs of each bucket after batch ``epoch``; one entry per bucket."""
    if epoch < 0:
        return {}
    rows = spark.read.schema(INDEX_SCHEMA).parquet(f"{path}/index/epoch={epoch}")
    entries = rows.agg(F.collect_list(F.struct("depth", "prefix", "lessons", "runs"))).first()[0]
    return {(r["depth"], r["prefix"]): (r["lessons"], [tuple(run) for run in r["runs"]]) for r in entries}


def _write_index(spark: SparkSession, path: str, epoch: int, index: Index) -> None:
    rows = [(*bucket, lessons, runs) for bucket, (lessons, runs) in sorted(index.items())]
    spark.createDataFrame(rows, INDEX_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/index/epoch={epoch}")


def _run_path(path: str, bucket: Bucket, run: Run) -> str:
    kind = "merged" if run[1] else "changed"
    return f"{path}/state/epoch={run[0]}/{kind}/bucket={bucket[0]}-{bucket[1]}"


def _read_runs(spark: SparkSession, path: str, runs: dict[Bucket, list[Run]]) -> DataFrame:
    """All rows of the given runs; an id can have one in each run of its bucket."""
    folders = [_run_path(path, bucket, run) for bucket, own in runs.items() for run in own]
    if not folders:
        return spark.createDataFrame([], STATE_SCHEMA)
    return spark.read.schema(STATE_SCHEMA).parquet(*folders)


def read_state(spark: SparkSession, path: str, epoch: int) -> DataFrame:
    """Latest row per id after batch ``epoch``, the last or the one before it."""
    index = _index(spark, path, epoch)
    return latest_per_id(_read_runs(spark, path, {bucket: runs for bucket, (_, runs) in index.items()}))


def _placed(df: DataFrame, buckets: list[Bucket]) -> DataFrame:
    """``df`` with ``bucket``, the name of the bucket that its id belongs to."""
    depths = sorted({depth for depth, _ in buckets})
    prefix = F.expr("cast(xxhash64(id) & (shiftleft(1L, depth) - 1) as int)")
    tried = df.withColumn("depth", F.explode(F.array(*map(F.lit, depths)))).withColumn("prefix", prefix)
    known = df.sparkSession.createDataFrame(buckets, "depth INT, prefix INT")
    return tried.join(known, ["depth", "prefix"]).withColumn("bucket", F.concat_ws("-", "depth", "prefix")).drop("depth", "prefix")


def _by_bucket(rows: DataFrame, *totals) -> dict[Bucket, tuple]:
    """Aggregates per bucket; one entry per bucket."""
    found = rows.groupBy("bucket").agg(*(t.alias(f"t{i}") for i, t in enumerate(totals)))
    entries = found.agg(F.collect_list(F.struct(*found.columns))).first()[0]
    return {tuple(map(int, r[0].split("-"))): tuple(r[1:]) for r in entries}


def _write_runs(rows: DataFrame, folder: str) -> DataFrame:
    """Write ``rows`` in one folder per bucket and read them back with it."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("bucket").schema)
    # Ids are one row each, so buckets of like size give even tasks.
    dealt = rows.repartition("bucket")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(folder)
    return rows.sparkSession.read.schema(f"{schema}, bucket STRING").parquet(folder)


def _changes(fresh: DataFrame, before: DataFrame) -> DataFrame:
    """Rows of ``fresh`` that are later than what ``before`` has of their ids, and whether
    the lesson existed before."""
    old = before.select(F.col("id").alias("_id"), F.col("op").alias("_op"), F.struct("ts", "seq").alias("_at"))
    met = fresh.join(old, F.col("id").eqNullSafe(F.col("_id")), "left")
    later = F.col("_at").isNull() | (F.struct("ts", "seq") > F.col("_at"))
    return met.where(later).select("bucket", "id", "op", "ts", "seq", F.coalesce(F.col("_op") == "save", F.lit(False)).alias("had"))


def _tier(size: int) -> int:
    tier = 0
    while size >= FANOUT:
        size, tier = size // FANOUT, tier + 1
    return tier


def _to_merge(runs: list[Run]) -> list[Run]:
    """Runs of the smallest tier that holds ``FANOUT`` of them, with all smaller ones."""
    tiers = [_tier(run[2]) for run in runs]
    full = [t for t in sorted(set(tiers)) if tiers.count(t) >= FANOUT]
    return [run for run, t in zip(runs, tiers) if full and t <= full[0]]


def _settle(spark: SparkSession, path: str, fresh: DataFrame, epoch: int, buckets: int, most: int) -> None:
    depth = max(buckets - 1, 0).bit_length()
    index = _index(spark, path, epoch - 1) or {(depth, p): (0, []) for p in range(1 << depth)}
    placed = _placed(fresh, list(index)).persist()
    try:
        touched = _by_bucket(placed, F.count(F.lit(1)))
        before = _read_runs(spark, path, {bucket: index[bucket][1] for bucket in touched})
        here = f"{path}/state/epoch={epoch}"
        drop_dir(spark, here)
        if touched:
            changed = _write_runs(_changes(placed, latest_per_id(before)), f"{here}/changed")
            gained = F.count_if(F.col("op") == "save") - F.count_if("had")
            for bucket, (size, more) in _by_bucket(changed, F.count(F.lit(1)), gained).items():
                lessons, runs = index[bucket]
                index[bucket] = (lessons + more, [*runs, (epoch, False, size)])
            _compact(spark, path, index, list(touched), epoch, most)
    finally:
        placed.unpersist()
    _write_index(spark, path, epoch, index)


def _compact(spark: SparkSession, path: str, index: Index, touched: list[Bucket], epoch: int, most: int) -> None:
    """Merge the runs that are due among ``touched`` and split the buckets that are too large."""
    merged: dict[Bucket, list[Run]] = {}
    for bucket in touched:
        runs = index[bucket][1]
        depth, prefix = bucket
        more = min((sum(size for _, _, size in runs) // (most + 1)).bit_length(), _MOST_BITS - depth)
        if more > 0:
            merged[bucket] = runs
            del index[bucket]
            for ending in range(1 << more):
                index[depth + more, prefix | ending << depth] = (0, [])
        elif due := _to_merge(runs):
            merged[bucket] = due
    if not merged:
        return
    rows = _placed(latest_per_id(_read_runs(spark, path, merged)), list(index))
    written = _write_runs(rows, f"{path}/state/epoch={epoch}/merged")
    for bucket, (size, lessons) in _by_bucket(written, F.count(F.lit(1)), F.count_if(F.col("op") == "save")).items():
        known, runs = index[bucket]
        split = bucket not in merged
        left = [] if split else [run for run in runs if run not in merged[bucket]]
        index[bucket] = (lessons if split else known, [*left, (epoch, True, size)])
    for bucket, runs in merged.items():
        for run in runs:
            if run[0] == epoch:  # written for this batch and merged at once: no index names it
                drop_dir(spark, _run_path(path, bucket, run))


def _clear(spark: SparkSession, path: str, epoch: int) -> None:
    """Delete what batch ``epoch``, even when run again, does not read: the index two
    batches back and the runs that only it names."""
    if epoch < 2 or not path_exists(spark, f"{path}/index/epoch={epoch - 2}"):
        return
    valid = {(b, run[:2]) for b, (_, runs) in _index(spark, path, epoch - 1).items() for run in runs}
    for bucket, (_, runs) in _index(spark, path, epoch - 2).items():
        for run in runs:
            if (bucket, run[:2]) not in valid:
                drop_dir(spark, _run_path(path, bucket, run))
    drop_dir(spark, f"{path}/index/epoch={epoch - 2}")


def stream_saved_count(
    log: DataFrame,
    path: str,
    checkpoint: str,
    every: str | None = None,
    buckets: int = BUCKETS,
    most: int = BUCKET_ROWS,
) -> StreamingQuery:
    """Keep the number of existing lessons up to date from the change log.

    Ids are stored as text, whatever their type in the stream. Deleting an unknown
    id changes the count by zero. Runs that the index before the running batch no
    longer names are deleted.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        _clear(spark, path, epoch)
        fresh = latest_per_id(batch.select(F.col("id").cast("string").alias("id"), "op", "ts", "seq"))
        _settle(spark, path, fresh, epoch, buckets, most)

    writer = log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def live_count(spark: SparkSession, path: str) -> DataFrame:
    """The count after the last batch, from the last index alone (two are kept)."""
    per_epoch = (
        spark.read.schema(INDEX_SCHEMA + ", epoch BIGINT")
        .parquet(f"{path}/index")
        .groupBy("epoch")
        .agg(F.sum("lessons").alias("lessons"))
    )
    last = F.max_by("lessons", "epoch")
    return per_epoch.agg(F.coalesce(last, F.lit(0).cast("bigint")).alias("lessons"))
