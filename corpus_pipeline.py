"""The stages from raw documents to packed containers; each reads what the one before wrote."""

from __future__ import annotations

import importlib.util

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.session import ship, table

_found = importlib.util.find_spec("lineloom.llm")
HERE = _found is not None and bool(_found.origin)  # without that subpackage there are no stages
if HERE:
    from lineloom.llm import empty_texts, garbled, language, leaks, lookalike, packing


def restored(spark: SparkSession, df: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return garbled.restore_texts(df, "text")


def uniform(spark: SparkSession, df: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return lookalike.with_readable(df, {"text": "__text"}).withColumn("text", F.col("__text")).drop("__text")


def without_empty(spark: SparkSession, df: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return df.join(empty_texts.empty_texts(df, empty_texts.train_on(df)).select("doc_id"), "doc_id", "left_anti")


def labelled(spark: SparkSession, df: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    found = language.label_documents(df, language.train_on(df)).select("doc_id", F.col("lang").alias("found"), F.col("confidence").alias("lang_confidence"))
    return df.join(found, "doc_id", "left").withColumn("lang", F.coalesce("found", "lang")).drop("found")


def without_leaks(spark: SparkSession, df: DataFrame, sf_dir: str) -> DataFrame:
    return df.join(leaks.leaked_items(df, table(spark, sf_dir, "eval_items")).select("doc_id").distinct(), "doc_id", "left_anti")


def packed(spark: SparkSession, df: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(df, table(spark, sf_dir, "pack_sizes"))


STAGES = [
    ("p5 restored", restored),
    ("p4 uniform", uniform),
    ("p10 without empty texts", without_empty),
    ("p7 labelled", labelled),
    ("p9 without leaked passages", without_leaks),
    ("p8 packed", packed),
] if HERE else []
