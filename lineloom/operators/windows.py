"""Operators along the order of rows: repeats, islands, neighbours, sections, values carried on."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineloom.functions.measure import without_ruby

from .running import positions, running


def repeat_marks(lines: DataFrame, keys: tuple[str, ...] = ("media", "folder", "line")) -> DataFrame:
    """``media, row_id, is_repeat``: whether the line stood in its folder before, by the text itself and not a hash of it."""
    once = lines.select("media", "row_id", *[k for k in keys if k != "media"]).dropDuplicates(["media", "row_id"])
    first = once.groupBy(*keys).agg(F.min("row_id").alias("__first"))
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return once.alias("a").join(first.alias("b"), cond).select("a.media", "a.row_id", (F.col("a.row_id") > F.col("__first")).alias("is_repeat"))


def collapse_consecutive(lines: DataFrame, group: list[str], order: str = "row_id", text: str = "line") -> DataFrame:
    """Of neighbours that are equal but for ruby the longest, at the place of the first; the earliest of equally long ones."""
    plain = without_ruby(text)
    seen = running(lines.withColumn("__plain", plain), group, order, lasts={"__before": F.col("__plain")}, inclusive=False)
    new = F.when(F.col("__before").eqNullSafe(F.col("__plain")) & F.col("__before").isNotNull(), 0).otherwise(1)
    numbered = running(seen.withColumn("__new", new), group, order, sums={"__island": F.col("__new")})
    best = F.max_by(text, F.struct(F.length(text), -F.col(order)))
    return numbered.groupBy(*group, "__island").agg(F.min(order).alias(order), best.alias(text)).drop("__island")


def islands(df: DataFrame, group: list[str], order: str) -> DataFrame:
    """``group, first, last, rows`` of the runs of consecutive values of ``order`` in each group."""
    once = df.select(*group, order).distinct()
    runs = positions(once, group, order, "__at").withColumn("__island", F.col(order) - F.col("__at"))
    return runs.groupBy(*group, "__island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("rows")).drop("__island")


def merge_ranges(ranges: DataFrame, low: str = "first", high: str = "last", group: list[str] | None = None) -> DataFrame:
    """Ranges joined where one begins within, or right after, those before it: ``group, low, high``."""
    from pyspark.sql import Window

    group = group or []
    before = Window.partitionBy(*group).orderBy(low, high).rowsBetween(Window.unboundedPreceding, -1)
    new = F.when(F.col(low) <= F.max(high).over(before) + 1, 0).otherwise(1)
    upto = Window.partitionBy(*group).orderBy(low, high).rowsBetween(Window.unboundedPreceding, 0)
    return ranges.withColumn("__new", new).withColumn("__run", F.sum("__new").over(upto)).groupBy(*group, "__run").agg(F.min(low).alias(low), F.max(high).alias(high)).drop("__run")


def numbered_sections(df: DataFrame, group: list[str], order: str, heading: Column) -> DataFrame:
    """``df`` with ``section``: the headings up to and with the row."""
    return running(df, group, order, sums={"section": F.when(heading, 1).otherwise(0)})


def carried(df: DataFrame, group: list[str], order: str, value: Column, name: str) -> DataFrame:
    """``df`` with the last value, not null, at or before each row."""
    return running(df, group, order, lasts={name: value})


def fold_starts(df: DataFrame, group: list[str], order: str, section: str) -> DataFrame:
    """``df`` with ``fold``: whether its section differs from that of the row before; the first row of a group folds."""
    seen = running(df.withColumn("__s", F.struct(F.col(section))), group, order, lasts={"__before": F.col("__s")}, inclusive=False)
    return seen.withColumn("fold", ~F.col("__before").eqNullSafe(F.col("__s"))).drop("__before", "__s")


def beside_other_script(df: DataFrame, group: list[str], order: str, own: Column, other: Column, name: str = "paired") -> DataFrame:
    """``df`` with ``name``: the row is ``own`` and a neighbour is ``other``."""
    marked = df.withColumn("__own", own).withColumn("__mark", F.when(other, "o").otherwise("n"))
    back = running(marked, group, order, lasts={"__before": F.col("__mark")}, inclusive=False)
    both = running(back, group, order, lasts={"__after": F.col("__mark")}, backward=True, inclusive=False)
    return both.withColumn(name, F.col("__own") & (F.coalesce(F.col("__before") == "o", F.lit(False)) | F.coalesce(F.col("__after") == "o", F.lit(False)))).drop("__own", "__mark", "__before", "__after")


def counting_chains(df: DataFrame, group: str, order: str, number: str, least: int = 3, gap: int = 2) -> DataFrame:
    """``group, order, number`` of the longest chain of headings 1, 2, 3 … in each group, each ``gap`` rows or more after the
    one before; chains shorter than ``least`` are none. ``df`` holds the numbered headings only, which are few."""
    schema = f"`{group}` {df.schema[group].dataType.simpleString()}, `{order}` long, `{number}` int"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        best: dict[int, list[int]] = {}  # the chain that ends with each number, the earliest end first
        frame = frame.sort_values(order)
        for at, n in zip(frame[order], frame[number], strict=True):
            if n == 1:
                best.setdefault(1, [at])
            elif n - 1 in best and n not in best and at - best[n - 1][-1] >= gap:
                best[n] = [*best[n - 1], at]
        chain = max(best.values(), key=len, default=[])
        chain = chain if len(chain) >= least else []
        return pd.DataFrame({group: [frame[group].iloc[0]] * len(chain), order: chain, number: range(1, len(chain) + 1)})

    return df.select(group, F.col(order).cast("long").alias(order), F.col(number).cast("int").alias(number)).groupBy(group).applyInPandas(run, schema)
