"""The health of a corpus: kinds of lines per file, verdicts on language and encoding, digests of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineloom.functions.measure import text_digest
from lineloom.functions.script import line_kind, mojibake

from .running import positions

#: Lines from which a verdict is given, and the shares and counts that decide it.
LEAST_LINES, BILINGUAL, JAPANESE, BOOK_JAPANESE, GARBLED = 50, 0.02, 0.5, 0.3, 10


def kind_counts(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n, ja, zh, mix, en, garbled``: kinds of the lines of each file, rows delivered twice once."""
    once = lines.dropDuplicates(["media", "row_id"]).withColumn("kind", line_kind("line"))
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in ("ja", "zh", "mix", "en")]
    counted = once.groupBy(*keys).agg(F.count("*").alias("n"), *counts)
    # only lines with such characters go to Python; a condition around the function would not keep the others from it
    odd = lines.filter(F.coalesce(F.col("line"), F.lit("")).rlike(r"[\x{80}-\x{ff}]")).dropDuplicates(["media", "row_id"])
    bad = odd.groupBy(*keys).agg(F.count_if(mojibake("line")).alias("garbled"))
    return counted.join(bad, keys, "left").fillna(0, ["garbled"])


def language_verdict(media: Column, n: Column, ja: Column, zh: Column, mix: Column, en: Column, utf8: Column, garbled: Column) -> Column:
    """other_language, language_review, encoding, bilingual, or null where nothing is the matter or lines are too few."""
    named = ja + zh + mix + en
    book = F.when(named < LEAST_LINES, None).when(ja / named < BOOK_JAPANESE, "other_language").when(ja / named < JAPANESE, "language_review")
    base = F.when(named >= LEAST_LINES, named).otherwise(n)
    other = F.when(garbled >= GARBLED, "encoding").when((zh + mix) / n >= BILINGUAL, "bilingual").when(
        ja / base < JAPANESE, F.when(F.coalesce(~utf8, F.lit(False)), "encoding").otherwise("other_language")
    )
    return F.when(n < LEAST_LINES, None).when(media == "epub", book).otherwise(other)


def garbled_book(lines_bad: Column, chars_bad: Column, chars: Column) -> Column:
    """Whether replacement characters stand in 20 lines or more and are a twentieth of all characters."""
    return (lines_bad >= 20) & (chars > 0) & (chars_bad >= 0.05 * chars)


def verdict(media: Column, fault: Column, n: Column, language: Column, garbled: Column | None = None, locked: Column | None = None) -> Column:
    """The finding for a file: its fault, no line, garbled, or the verdict on its language."""
    empty = F.when(media == "subs", "no_japanese").when(locked if locked is not None else F.lit(False), "drm").when(media == "custom", "empty_or_wall").otherwise("image_only")
    bad = garbled if garbled is not None else F.lit(False)
    return F.when(fault.isNotNull(), "unreadable").when(n == 0, empty).when(bad, "garbled").otherwise(language)


def finding_counts(findings: DataFrame) -> DataFrame:
    """``media, finding, files``."""
    return findings.groupBy("media", "finding").agg(F.count("*").alias("files"))


#: Lines of a source that are digested together.
DIGEST_LINES = 1 << 16


def stored_counts(lines: DataFrame) -> DataFrame:
    """``media, source_id, lines, japanese, digest`` of what is stored of each source.

    The digest is that of the lines in order, each with a newline; that of a source of more than DIGEST_LINES lines is the digest
    of the digests of so many lines at a time, so that no source is gathered.
    """
    once = lines.dropDuplicates(["media", "row_id"]).select("media", "source_id", "row_id", "clean_text", line_kind("line").isin("ja", "mix").alias("ja"))
    placed = positions(once, ["media", "source_id"], "row_id", "at").withColumn("part", F.floor((F.col("at") - 1) / DIGEST_LINES))
    parts = placed.groupBy("media", "source_id", "part").agg(F.count("*").alias("n"), F.count_if("ja").alias("j"), text_digest(F.col("row_id"), F.col("clean_text")).alias("d"))
    whole = parts.groupBy("media", "source_id").agg(F.sum("n").alias("lines"), F.sum("j").alias("japanese"), F.array_sort(F.collect_list(F.struct("part", "d"))).alias("ds"))
    joined = F.sha2(F.array_join(F.transform("ds", lambda x: x["d"]), "\n"), 256)
    return whole.select("media", "source_id", "lines", "japanese", F.when(F.size("ds") == 1, F.col("ds")[0]["d"]).otherwise(joined).alias("digest"))
