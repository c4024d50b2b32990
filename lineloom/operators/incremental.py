"""Keeping an index up to date: what changed, what is removed, what is stale, exclusion lists, and the sinks.

``disk``: ``relpath, file_size, file_mtime_ns, file_hash`` as found; ``known``: the same as recorded. Each is one row a file.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The share of the indexed files from which removals are held back, and that of outdated ones from which all is rebuilt.
HOLD_SHARE, REBUILD_SHARE, COMPACT_SHARE = 0.5, 0.5, 0.25
FILTER_COLUMNS = ("media", "name", "reason", "keep", "date", "origin", "size", "mtime", "evidence", "reviewed")


def plan_changes(known: DataFrame, disk: DataFrame) -> DataFrame:
    """``relpath, state``: same (size and time recorded, not hashed), touched (hash equal), changed, new or gone."""
    k = known.select("relpath", F.col("file_size").alias("ks"), F.col("file_mtime_ns").alias("kt"), F.col("file_hash").alias("kh"), F.lit(1).alias("k"))
    both = disk.withColumn("d", F.lit(1)).join(k, "relpath", "full")
    alike = (F.col("file_size") == F.col("ks")) & (F.col("file_mtime_ns") == F.col("kt")) & F.col("kh").isNotNull()
    state = F.when(F.col("d").isNull(), "gone").when(F.col("k").isNull(), "new").when(F.coalesce(alike, F.lit(False)), "same").when(F.coalesce(F.col("file_hash") == F.col("kh"), F.lit(False)), "touched").otherwise("changed")
    return both.select("relpath", state.alias("state"))


def held_removals(known: DataFrame, disk: DataFrame, filtered: DataFrame, allow: bool = False) -> DataFrame:
    """``relpath, held`` of the files gone from disk: those not filtered out by the user are held back where they are more than half
    of the indexed files, unless ``allow``."""
    gone = known.select("relpath").join(disk.select("relpath"), "relpath", "left_anti")
    gone = gone.join(filtered.select(F.col("name").alias("relpath")).distinct().withColumn("f", F.lit(True)), "relpath", "left").withColumn("f", F.coalesce("f", F.lit(False)))
    if allow:
        return gone.select("relpath", F.lit(False).alias("held"))
    # one row of totals, joined by a constant
    totals = known.agg(F.count("*").alias("n")).withColumn("one", F.lit(1))
    missing = gone.agg(F.count_if(~F.col("f")).alias("m")).withColumn("one", F.lit(1))
    both = F.broadcast(totals.join(missing, "one"))
    return gone.withColumn("one", F.lit(1)).join(both, "one").select("relpath", (~F.col("f") & (F.col("m") > HOLD_SHARE * F.col("n"))).alias("held"))


def outdated(sources: DataFrame, required: dict[str, int], scoped: dict[tuple[str, int], tuple[str, ...]] | None = None) -> DataFrame:
    """Sources indexed in an older form than required; ``scoped``: versions that only files of some endings need."""
    out = F.lit(False)
    for media, newest in required.items():
        needed = F.lit(1)
        for version in range(2, newest + 1):
            ends = (scoped or {}).get((media, version))
            hit = F.lit(True) if ends is None else F.lower("relpath").rlike("(?:" + "|".join(e.replace(".", r"\.") for e in ends) + ")$")
            needed = F.when(hit, F.lit(version)).otherwise(needed)
        out = out | ((F.col("media") == media) & (F.col("format_version") < needed))
    return sources.filter(out)


def wants_rebuild(sources: DataFrame, old: DataFrame) -> DataFrame:
    """``media, rebuild``: whether half or more of the sources are outdated."""
    stale = old.groupBy("media").agg(F.count("*").alias("m"))
    return sources.groupBy("media").agg(F.count("*").alias("n")).join(stale, "media", "left").select("media", (F.coalesce("m", F.lit(0)) >= REBUILD_SHARE * F.col("n")).alias("rebuild"))


def worth_compacting(before: int, deleted: int) -> bool:
    """Whether so much was deleted that the files should be written anew."""
    return before > 0 and deleted / before >= COMPACT_SHARE


def without_sources(lines: DataFrame, removed: DataFrame) -> DataFrame:
    """Lines, or rows of a side table, without those of some sources."""
    return lines.join(removed.select("media", "source_id").distinct(), ["media", "source_id"], "left_anti")


def upsert(lines: DataFrame, fresh: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """Lines with the rows of fresh sources in place of theirs, and without removed sources."""
    gone = fresh.select("media", "source_id").distinct()
    if removed is not None:
        gone = gone.union(removed.select("media", "source_id")).distinct()
    return without_sources(lines, gone).unionByName(fresh, allowMissingColumns=True)


def drift(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """The rows that are stored but not computed (extra), and computed but not stored (missing), with repetitions."""
    columns = stored.columns
    extra = stored.exceptAll(computed.select(*columns)).withColumn("side", F.lit("extra"))
    return extra.unionByName(computed.select(*columns).exceptAll(stored).withColumn("side", F.lit("missing")))


def changed_works(sources: DataFrame, recorded: DataFrame) -> DataFrame:
    """``media, folder, signature`` of the works whose sources, hashes or ranges are not those recorded.

    A signature is the sum of the hashes of a work's sources, so no work is gathered.
    """
    each = sources.withColumn("h", F.xxhash64("source_id", "file_hash", "n_lines").cast("decimal(38,0)"))
    now = each.groupBy("media", "folder").agg(F.sum("h").cast("string").alias("signature"))
    return now.join(recorded.select("media", "folder", "signature"), ["media", "folder", "signature"], "left_anti")


# ------------------------------------------------------------------ exclusion lists


def append_filtered(rows: DataFrame, new: DataFrame) -> DataFrame:
    """The list with new entries that it does not hold yet, by medium and name with either slash."""
    key = lambda df: df.withColumn("__k", F.regexp_replace("name", r"\\", "/"))
    fresh = key(new.filter((F.coalesce("name", F.lit("")) != "") & (F.coalesce("media", F.lit("")) != "")))
    first = fresh.groupBy("media", "__k").agg(F.min(F.struct(*new.columns)).alias("r")).select("media", "__k", *[F.col(f"r.{c}").alias(c) for c in new.columns if c != "media"])
    added = first.join(key(rows).select("media", "__k"), ["media", "__k"], "left_anti").drop("__k")
    return rows.unionByName(added, allowMissingColumns=True)


def refresh_filtered(rows: DataFrame, disk: DataFrame, media: str) -> DataFrame:
    """The list without automatic entries whose file is gone or has another size or time."""
    now = disk.select(F.regexp_replace("relpath", r"\\", "/").alias("__k"), F.col("file_size").cast("string").alias("__s"), F.col("file_mtime_ns").cast("string").alias("__t"))
    both = rows.withColumn("__k", F.regexp_replace("name", r"\\", "/")).join(now, "__k", "left")
    keep = (F.col("media") != media) | (F.coalesce("origin", F.lit("")) != "auto") | F.coalesce((F.col("size") == F.col("__s")) & (F.col("mtime") == F.col("__t")), F.lit(False))
    return both.filter(keep).select(*rows.columns)


def unfilter(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """The list without the named entries."""
    return rows.join(entries.select("media", "name").distinct(), ["media", "name"], "left_anti")


def keep_left_out(rows: DataFrame, entries: DataFrame, stamp: Column) -> DataFrame:
    """The list with the named entries marked as reviewed."""
    named = entries.select("media", "name").distinct().withColumn("__r", F.lit(True))
    return rows.join(named, ["media", "name"], "left").withColumn("reviewed", F.when(F.col("__r"), stamp).otherwise(F.col("reviewed"))).select(*rows.columns)


def write_filtered(rows: DataFrame, path: str) -> None:
    """The list as tab-separated text with a header; tabs and line breaks within become spaces."""
    out = rows.select(*[F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[\t\r\n]", " ").alias(c) if c in rows.columns else F.lit("").alias(c) for c in FILTER_COLUMNS])
    out.coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)


def read_filtered(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"{c} string" for c in FILTER_COLUMNS)
    return spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path).fillna("").filter("name <> ''")


def apply_choices(groups: DataFrame, choices: DataFrame, measures: DataFrame, threshold: float = 0.9) -> DataFrame:
    """New exclusion rows from choices ``keeper, member, generation``: those whose pair and generation the report ``groups``
    (``keeper, member, share, generation``) holds at the threshold, and whose files still have the hashes it was made from."""
    held = groups.filter(F.col("share") >= threshold).join(choices, ["keeper", "member", "generation"], "left_semi")
    now = measures.select(F.col("relpath").alias("member"), F.col("sha").alias("sha_now"), "media")
    ok = held.join(now, "member").filter(F.col("sha_now") == F.col("sha"))
    return ok.select("media", F.col("member").alias("name"), F.lit("duplicate").alias("reason"), F.col("keeper").alias("keep"))


# ------------------------------------------------------------------ sinks


def write_index(lines: DataFrame, path: str, buckets: int = 16) -> None:
    """Lines as Parquet by medium and bucket of the source, rows of a file sorted, so that a scan for a folder skips row groups.

    Only the partitions that the rows touch are replaced.
    """
    spark = lines.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        bucketed = lines.withColumn("bucket", F.pmod(F.xxhash64("source_id"), F.lit(buckets)).cast("int"))
        # a salt parts large sources, so that no task writes a whole one alone
        spread = bucketed.repartition("media", "bucket", F.floor(F.col("row_id") / 1_000_000)).sortWithinPartitions("media", "bucket", "folder", "file", "row_id")
        spread.write.mode("overwrite").partitionBy("media", "bucket").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def update_index(spark: SparkSession, path: str, fresh: DataFrame, removed: DataFrame, buckets: int = 16) -> None:
    """Replace the sources of ``fresh`` and drop ``removed`` (``media, source_id``) in a written index, touched buckets alone."""
    bucket = F.pmod(F.xxhash64("source_id"), F.lit(buckets)).cast("int")
    touched = fresh.select("media", "source_id").union(removed.select("media", "source_id")).select("media", bucket.alias("bucket")).distinct()
    stored = spark.read.parquet(path)
    part = stored.join(F.broadcast(touched), ["media", "bucket"], "left_semi").drop("bucket")
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    touched = touched.persist()
    upsert(part, fresh, removed).write.parquet(staged)
    rows = spark.read.parquet(staged)
    # a bucket that lost all its rows is written by nobody; there are no more of them than media times buckets
    empty = touched.join(rows.select("media", bucket.alias("bucket")).distinct(), ["media", "bucket"], "left_anti").collect()
    write_index(rows, path, buckets)
    for r in empty:
        fs, place = _hadoop_path(spark, f"{path.rstrip('/')}/media={r['media']}/bucket={r['bucket']}")
        fs.delete(place, True)
    touched.unpersist()
    fs, place = _hadoop_path(spark, staged)
    fs.delete(place, True)


def _hadoop_path(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def swap(spark: SparkSession, staged: str, path: str, allow_loss: bool = False) -> None:
    """Put a rebuilt index in the place of the old one; refused where it lacks sources of the old one."""
    fs, old = _hadoop_path(spark, path)
    _, new = _hadoop_path(spark, staged)
    if fs.exists(old):
        lost = spark.read.parquet(path).select("media", "source_id").distinct().join(spark.read.parquet(staged).select("media", "source_id").distinct(), ["media", "source_id"], "left_anti")
        if not allow_loss and not lost.isEmpty():
            raise ValueError(f"the new index lacks {lost.count()} sources of the old one")
        aside = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + f".old-{uuid.uuid4().hex}")
        fs.rename(old, aside)
        fs.rename(new, old)
        fs.delete(aside, True)
    else:
        fs.rename(new, old)


class WriterLease:
    """One writer per index: a lock file that is made only if it is not there."""

    def __init__(self, path: str):
        self.path = path

    def __enter__(self) -> WriterLease:
        try:
            os.close(os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        except FileExistsError as error:
            raise RuntimeError("another writer holds this index") from error
        return self

    def __exit__(self, *_) -> None:
        os.unlink(self.path)


def convert_to_utf8(path: str, digest: str, backup: str) -> str:
    """Write a caption file anew in UTF-8, its bytes kept in ``backup``; only if they still have ``digest`` and come back exactly.

    Returns the encoding that it had.
    """
    import hashlib

    from lineloom.sources.decode import decode_bytes

    with open(path, "rb") as handle:
        raw = handle.read()
    if hashlib.sha256(raw).hexdigest() != digest:
        raise ValueError("the file has changed")
    text, encoding = decode_bytes(raw)
    if encoding.endswith("-damaged") or text.encode(encoding) != raw:
        raise ValueError("the text does not give the same bytes back")
    with open(backup, "xb") as handle:
        handle.write(raw)
    staged = f"{path}.{uuid.uuid4().hex}"
    with open(staged, "wb") as handle:
        handle.write(text.encode("utf-8"))
    os.replace(staged, path)
    return encoding
