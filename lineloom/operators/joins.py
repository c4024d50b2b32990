"""Joins that equality alone does not give: points in ranges, and the last start before a point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import running


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, keys: list[str] | None = None, width: int = 1 << 12, how: str = "inner") -> DataFrame:
    """Points with the ranges, both ends included, that hold them; ``keys`` must be equal besides.

    Each range stands in every bucket of ``width`` that it touches, so the join is one of equality on (keys, bucket) and never
    compares all points with all ranges. ``how`` is inner or left. Null points and bounds lie in no range.
    """
    keys = keys or []
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    spread = ranges.filter(F.col(low) <= F.col(high)).withColumn("__b", F.explode(F.sequence(bucket(low), bucket(high))))
    left = points.withColumn("__b", bucket(at))
    other = spread.select(*[F.col(c).alias(f"__r_{c}") for c in spread.columns])
    on = (F.col("__b") == F.col("__r___b")) & F.col(at).between(F.col(f"__r_{low}"), F.col(f"__r_{high}"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__r_{k}"))
    joined = left.join(other, on, how)
    own = [c for c in ranges.columns if c not in keys]
    return joined.select(*points.columns, *[F.col(f"__r_{c}").alias(c) for c in own])


def as_of(points: DataFrame, starts: DataFrame, at: str, start: str, values: list[str], keys: list[str] | None = None) -> DataFrame:
    """``points`` with the ``values`` of the last start at or before each, within equal ``keys``; null where there is none.

    Starts and points are ordered together and the last start is carried on, so neither side is repeated. Of starts at one
    place the one of the greatest values counts.
    """
    keys = keys or []
    best = starts.groupBy(*keys, start).agg(F.max(F.struct(*values)).alias("__v"))
    kind = best.schema["__v"].dataType
    key_columns = [F.col(k) for k in keys]
    marks = best.select(*key_columns, (F.col(start) * 2).cast("long").alias("__o"), "__v", F.lit(None).cast(points.select(F.struct(*points.columns).alias("x")).schema["x"].dataType).alias("__p"))
    rows = points.select(*key_columns, (F.col(at) * 2 + 1).cast("long").alias("__o"), F.lit(None).cast(kind).alias("__v"), F.struct(*points.columns).alias("__p"))
    group = keys or ["__all"]
    both = marks.unionByName(rows)
    if not keys:
        both = both.withColumn("__all", F.lit(0))
    found = running(both.filter("__o is not null"), group, "__o", lasts={"__last": F.col("__v")}).filter("__p is not null")
    return found.select("__p.*", *[F.col(f"__last.{v}").alias(v) for v in values])


def left_with_sums(left: DataFrame, sums: DataFrame, on: list[str], zeros: list[str]) -> DataFrame:
    """Every row of ``left`` with its sums, 0 where there are none."""
    return left.join(sums, on, "left").fillna(0, zeros)


def orphans(side: DataFrame, content: DataFrame, on: list[str]) -> DataFrame:
    """Rows of a side table whose key is not in the content."""
    return side.join(content.select(*on).distinct(), on, "left_anti")


def with_rows_like(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``left`` for which there is a row of ``right`` with the same keys, null agreeing with null."""
    other = right.select(*[F.col(c).alias(f"__{c}") for c in on]).distinct()
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return left.join(other, cond, "left_semi")


def dictionary_lookup(rows: DataFrame, lexicon: DataFrame, on: list[str], value: str, name: str = "readings") -> DataFrame:
    """``rows`` with the sorted distinct values of the lexicon for its keys; empty where it has none."""
    found = lexicon.groupBy(*on).agg(F.array_sort(F.collect_set(value)).alias(name))
    return rows.join(found, on, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def late(page: DataFrame, table: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """The rows of a page with columns read only for them."""
    return page.join(table.select(*on, *columns).dropDuplicates(on), on, "left")
