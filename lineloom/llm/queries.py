"""Queries of this subpackage: pN_found and what else each problem asks for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.session import settle, table

from . import empty_texts, garbled, language, leaks, lookalike, markup, packing, repeated_lines, scanned, term_counts


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines.repeated_rows(table(spark, sf_dir, "subtitles"), "folder", "file", "line")


def p1_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines.repeated_blocks(table(spark, sf_dir, "subtitles"), "folder", "file", "line").select(
        "depth", "example", "in_documents", "documents"
    )


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "subtitles").dropDuplicates(["row_id"])
    return repeated_lines.remove_repeated_lines(rows, "folder", "file", "line").select("row_id", "file", "line")


def _volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned.volume_rows(table(spark, sf_dir, "manga"), table(spark, sf_dir, "manga_pages"), table(spark, sf_dir, "sources"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned.find_noise(_volumes(spark, sf_dir))


def p2_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned.paragraphs(_volumes(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = term_counts.marked_terms(table(spark, sf_dir, "subtitles"), ("base_forms", "readings"))
    return found.filter("mark is not null").select("field", "term", "mark")


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_counts.term_counts(table(spark, sf_dir, "subtitles"), ("base_forms", "readings")).select(
        "field", "term", "occurrences", "records"
    )


def p3_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = term_counts.term_counts(table(spark, sf_dir, "subtitles"), ("base_forms",), max_n=3)
    return found.filter("n > 1 and records > 2").select("n", "term", "occurrences", "records")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "subtitles")
    return lookalike.same_looking_pairs(rows, "source_id", "line", ("clean_text",), leave_out=p1_found(spark, sf_dir))


def p4_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.uniform_texts(table(spark, sf_dir, "subtitles"), "row_id", {"line": "uniform_line", "clean_text": "uniform_text"})


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled.find_garbled(table(spark, sf_dir, "subtitles"), "line").select("row_id")


def p5_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled.find_garbled(table(spark, sf_dir, "subtitles"), "line")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for tab in ("subtitles", "custom"):
        found = markup.markup_rows(table(spark, sf_dir, tab), "file", "line", captions=tab == "subtitles")
        parts.append(found.select(F.lit(tab).alias("tab"), "row_id"))
    return parts[0].unionByName(parts[1])


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for tab in ("subtitles", "custom"):
        found = markup.clean_documents(table(spark, sf_dir, tab), "file", "line", captions=tab == "subtitles")
        parts.append(found.select(F.lit(tab).alias("tab"), "*"))
    return parts[0].unionByName(parts[1])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.train_on(table(spark, sf_dir, "documents"))
    return language.wrong_counts(table(spark, sf_dir, "files"), table(spark, sf_dir, "subtitles"), model)


def p7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.train_on(table(spark, sf_dir, "documents"))
    return language.count_languages(table(spark, sf_dir, "subtitles"), "file", "line", model)


def p7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.train_on(table(spark, sf_dir, "documents"))
    rows = table(spark, sf_dir, "subtitles").select("row_id", "line").dropDuplicates(["row_id"])
    return language.label_lines(rows, "line", model)


def p7_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.train_on(table(spark, sf_dir, "documents"))
    rows = table(spark, sf_dir, "subtitles").select("row_id", "line").dropDuplicates(["row_id"])
    found = language.label_lines(rows, "line", model, parts=True)
    return found.select("row_id", "lang", F.posexplode("parts").alias("part", "p")).select("row_id", "lang", "part", "p.lang", "p.text", "p.confidence").toDF("row_id", "line_lang", "part", "lang", "text", "confidence")


def p7_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return language.label_documents(documents, language.train_on(documents))


def p7_heldout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.held_out(table(spark, sf_dir, "documents"))


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_sizes"))


def p8_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_totals(settle(p8_pack(spark, sf_dir), "packs")).select("pack_id", "capacity", "documents", "chars", "cut", "over")


def p8_waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.packed_totals(settle(p8_pack(spark, sf_dir), "packs"))
    return found.select("pack_id", "containers", F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("unused"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return empty_texts.empty_texts(documents, empty_texts.train_on(documents)).select("doc_id")


def p10_heldout(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = empty_texts.validation(table(spark, sf_dir, "documents"))
    return spark.createDataFrame(found, "label string, pieces long, found long, right long")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(f)}
