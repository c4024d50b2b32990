"""The tables of lines as one DataFrame of one schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.session import table

#: The order of media where all else is equal.
MEDIA_ORDER = {"subs": 0, "epub": 1, "manga": 2, "custom": 3}


def media_rank():
    return F.coalesce(F.create_map(*[F.lit(x) for kv in MEDIA_ORDER.items() for x in kv])[F.col("media")], F.lit(9))


def subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(table(spark, sf_dir, "subtitles"), "subs")


def manga(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(table(spark, sf_dir, "manga"), "manga")


def custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(table(spark, sf_dir, "custom"), "custom")


def _lines(df: DataFrame, media: str) -> DataFrame:
    """``media, source_id, row_id, file, folder, line, clean_text, base_forms, readings, chars``; what a table lacks is null.

    Rows given twice stay; operators that count or rank take each ``(media, row_id)`` once.
    """
    column = lambda name, kind: F.col(name) if name in df.columns else F.lit(None).cast(kind)
    folder = F.col("folder") if "folder" in df.columns else F.split("file", r"[\\/]")[0]
    clean = F.col("clean_text") if "clean_text" in df.columns else F.col("line")
    return df.select(
        F.lit(media).alias("media"), F.col("source_id").cast("long").alias("source_id"), F.col("row_id").cast("long").alias("row_id"), "file", folder.alias("folder"),
        "line", clean.alias("clean_text"), column("base_forms", "string").alias("base_forms"), column("readings", "string").alias("readings"), column("chars", "int").alias("chars"),
    )


def all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions, scanned lines and text lines together."""
    return subtitles(spark, sf_dir).unionByName(manga(spark, sf_dir)).unionByName(custom(spark, sf_dir))


def document_lines(documents: DataFrame) -> DataFrame:
    """One row per line of a document that is not blank: ``media, source_id, row_id, file, folder, line, clean_text, gap_before``.

    The folder is the document's source, the file its number; ``row_id`` is the position from 0 in the document;
    ``gap_before``: a blank line, or several, stand before. Base forms are the lower-case words. A null text has no lines.
    """
    split = F.split(F.col("text"), r"\r\n|[\n\r]")
    # each line beside the one before it; looking that up by number would split the text again for every line
    beside = F.arrays_zip(split.alias("line"), F.concat(F.array(F.lit("-")), split).alias("before"))
    rows = documents.select(F.col("doc_id").alias("source_id"), F.col("source").alias("folder"), F.posexplode(beside).alias("row_id", "c")).filter("trim(c.line) <> ''")
    rows = rows.withColumn("row_id", F.col("row_id").cast("long")).withColumn("gap_before", F.trim("c.before") == "")
    words = F.array_join(F.transform(F.regexp_extract_all(F.col("c.line"), F.lit(r"([\p{L}\p{M}\p{N}_]+)"), 1), F.lower), " ")
    return rows.select(
        F.lit("custom").alias("media"), "source_id", "row_id", F.col("source_id").cast("string").alias("file"), "folder", "c.line", F.col("c.line").alias("clean_text"),
        words.alias("base_forms"), F.lit(None).cast("string").alias("readings"), F.lit(None).cast("int").alias("chars"), "gap_before",
    )


def newest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The newest row of each key, by the columns of ``order``; exact duplicates once."""
    rest = [c for c in df.columns if c not in keys]
    ordered = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest if c not in order])
    return df.groupBy(*keys).agg(F.max(ordered).alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest]).select(*df.columns)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of each source."""
    return newest(table(spark, sf_dir, "sources"), ["media", "source_id"], "format_version", "file_mtime_ns", "indexed_at")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest measure of each file."""
    return newest(table(spark, sf_dir, "files"), ["media", "relpath"], "file_mtime_ns", "format_version")
