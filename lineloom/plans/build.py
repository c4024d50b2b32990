"""Building an index from files: only what changed is read; derived columns and tables are made from the lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.functions.measure import shown_length, without_ruby
from lineloom.functions.ruby import index_extras, lexicon
from lineloom.functions.script import distinct_kanji, fold_compat, has_readable
from lineloom.operators import incremental, library, windows
from lineloom.sources import books, captions, scans, texts
from lineloom.sources.decode import scan_files

from .analyzers import Analyzer, SpacedAnalyzer, analyze_column

ENDINGS = {"subs": (".srt", ".ass", ".ssa"), "epub": (".epub",), "manga": (".mokuro",), "custom": (".txt", ".md")}
#: The form of the rows of each medium; older ones are read anew.
FORMATS = {"subs": 5, "epub": 9, "manga": 2, "custom": 7}
DERIVED = ("chapters", "lexicon", "repeats", "folders")


def source_id(path: Column) -> Column:
    return F.xxhash64(path)


def row_ids(source: Column, place: Column) -> Column:
    """Row numbers that rise within a source: 24 bits of place below the bits of the source."""
    return F.shiftleft(source.bitwiseAND(F.lit((1 << 39) - 1)), 24).bitwiseOR(place.cast("long"))


def read_media(media: str, files: DataFrame) -> DataFrame:
    """``relpath, file, folder, place, line, page, section_no, heading, gap_before, fault`` of the files of a medium."""
    none = lambda kind: F.lit(None).cast(kind)
    first = F.split("relpath", r"[\\/]")[0]
    if media == "subs":
        found = captions.read_files(files).select("relpath", F.col("relpath").alias("file"), first.alias("folder"), "place", "line")
    elif media == "epub":
        found = books.read_books(files)
        file = F.concat(F.col("title"), F.lit("\\"), F.lpad((F.col("chapter") + 1).cast("string"), 2, "0"), F.lit("."), F.col("label"))
        # places go on over the chapters of a book
        place = (F.shiftleft(F.col("chapter").cast("long"), 14) + F.col("place")).alias("place")
        found = found.select("relpath", file.alias("file"), F.col("title").alias("folder"), place, "line", "fault")
    elif media == "manga":
        found = scans.read_volumes(files).select("relpath", "file", F.col("series").alias("folder"), "place", "line", "page", "fault")
    else:
        found = texts.read_texts(files).select("relpath", F.col("relpath").alias("file"), first.alias("folder"), "place", "line", "section_no", "heading", "gap_before", "fault")
    wanted = {"page": "int", "section_no": "int", "heading": "string", "gap_before": "boolean", "fault": "string"}
    return found.select("relpath", "file", "folder", F.col("place").cast("long").alias("place"), "line", *[F.col(c) if c in found.columns else none(k).alias(c) for c, k in wanted.items()])


def derive(read: DataFrame, media: str, analyzer: Analyzer | None = None) -> DataFrame:
    """Rows of an index from read lines: clean text, tokens with those of the ruby, length, kanji; quiet lines have no tokens."""
    source = source_id(F.concat(F.lit(media), F.lit("/"), F.col("relpath")))
    rows = read.filter("line is not null").withColumn("clean_text", fold_compat(without_ruby("line")))
    tokens = analyze_column(F.when(has_readable("clean_text"), F.col("clean_text")), analyzer or SpacedAnalyzer())
    rows = rows.withColumn("__t", tokens)
    base, said = (F.array_join(F.col(f"__t.{k}"), " ") for k in ("base", "reading"))
    base, said = index_extras("line", base, said)
    return rows.select(
        F.lit(media).alias("media"), source.alias("source_id"), row_ids(source, F.col("place")).alias("row_id"), "file", "folder", "line", "clean_text",
        F.nullif(base, F.lit("")).alias("base_forms"), F.nullif(said, F.lit("")).alias("readings"), shown_length("line").alias("chars"), distinct_kanji("clean_text").alias("kanji"),
        "page", "section_no", "heading", "gap_before", "relpath",
    )


def index_medium(spark: SparkSession, media: str, root: str, path: str, known: DataFrame | None = None, filtered: DataFrame | None = None,
                 analyzer: Analyzer | None = None, allow_removal: bool = False, force: bool = False) -> dict[str, DataFrame]:
    """Bring the index at ``path`` up to date with the files below ``root``; what is unchanged is not parsed.

    ``known``: ``relpath, file_size, file_mtime_ns, file_hash`` as recorded. Filtered files are left out and their rows removed;
    removals of more than half of the index are held back unless allowed. A file that cannot be read keeps its old rows and is
    read again next time. Gives ``sources`` to record, ``states``, ``faults`` and ``held``.
    """
    files = scan_files(spark, root, ENDINGS[media])
    none = spark.createDataFrame([], "relpath string, file_size long, file_mtime_ns long, file_hash string")
    known = none if known is None else known
    names = filtered.filter(F.col("media") == media) if filtered is not None else spark.createDataFrame([], "media string, name string")
    kept = files.join(names.select(F.col("name").alias("relpath")).distinct(), "relpath", "left_anti")
    disk = kept.select("relpath", "file_size", "file_mtime_ns", F.sha2("content", 256).alias("file_hash"))
    states = incremental.plan_changes(none if force else known, disk)
    states = states.unionByName(known.join(disk, "relpath", "left_anti").select("relpath", F.lit("gone").alias("state"))) if force else states
    changed = kept.join(states.filter("state in ('new', 'changed')").select("relpath"), "relpath", "left_semi")
    read = read_media(media, changed)
    faults = read.filter("fault is not null").select("relpath", "fault").distinct()
    fresh = derive(read, media, analyzer)
    removals = incremental.held_removals(known, disk, names, allow_removal)
    gone = removals.filter("not held").select(F.lit(media).alias("media"), source_id(F.concat(F.lit(media), F.lit("/"), F.col("relpath"))).alias("source_id"))
    _, place = incremental._hadoop_path(spark, path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        incremental.update_index(spark, path, fresh, gone)
    else:
        incremental.write_index(fresh, path)
    good = disk.join(faults.select("relpath"), "relpath", "left_anti")
    sources = good.withColumn("media", F.lit(media)).withColumn("format_version", F.lit(FORMATS[media]))
    return {"sources": sources, "states": states, "faults": faults, "held": removals.filter("held").select("relpath")}


def derived(name: str, lines: DataFrame) -> DataFrame:
    """A derived table: chapters, lexicon, repeats or folders."""
    if name == "chapters":
        return library.chapter_spans(lines)
    if name == "lexicon":
        return lexicon(lines.select("media", "source_id", "folder", "line")).distinct()
    if name == "repeats":
        return windows.repeat_marks(lines)
    counted = lines.groupBy("media", "file").agg(F.countDistinct("row_id").cast("int").alias("n_lines"), F.min("row_id").cast("string").alias("order_key"))
    return library.folder_tree(counted, F.col("file"))


def missing_tables(spark: SparkSession, folder: str, version: str) -> list[str]:
    """The derived tables below a folder that are not there in this version."""
    out = []
    for name in DERIVED:
        fs, place = incremental._hadoop_path(spark, f"{folder}/{name}-{version}/_SUCCESS")
        if not fs.exists(place):
            out.append(name)
    return out


def build_tables(spark: SparkSession, lines: DataFrame, folder: str, version: str) -> list[str]:
    """Build the derived tables that are missing; their names."""
    missing = missing_tables(spark, folder, version)
    for name in missing:
        derived(name, lines).write.mode("overwrite").parquet(f"{folder}/{name}-{version}")
    return missing


def table_drift(spark: SparkSession, lines: DataFrame, folder: str, name: str, version: str) -> DataFrame:
    """What a stored derived table has too much or too little against one made anew."""
    return incremental.drift(spark.read.parquet(f"{folder}/{name}-{version}"), derived(name, lines))


def valid_queue(queue: DataFrame, sources: DataFrame) -> DataFrame:
    """Of files to be read again (``media, relpath, file_hash``) those that are still recorded with that hash."""
    return queue.join(sources.select("media", "relpath", "file_hash").distinct(), ["media", "relpath", "file_hash"], "left_semi")


def repair_candidates(stored: DataFrame, parsed: DataFrame) -> DataFrame:
    """``media, source_id, fault`` where the lines stored of a source are not those that its unchanged file gives: their number, or
    their text by digest. Both are ``media, source_id, lines, digest``."""
    both = stored.alias("s").join(parsed.alias("p"), ["media", "source_id"])
    fault = F.when(F.col("s.lines") != F.col("p.lines"), "lines").when(F.col("s.digest") != F.col("p.digest"), "text")
    return both.select("media", "source_id", fault.alias("fault")).filter("fault is not null")
