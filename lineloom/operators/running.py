"""Running sums, last values and positions within groups of any size.

A window over a group reads the group in one task. Here rows of a group are cut into buckets by their order key;
windows run within buckets, and what each bucket hands on comes from a window over one small row per bucket. A group
that holds a third of all rows is so spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a bucket in values of the order key.
BUCKET = 1 << 16


def running(
    df: DataFrame,
    group: list[str],
    order: str,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    backward: bool = False,
    inclusive: bool = True,
    bucket: int = BUCKET,
) -> DataFrame:
    """``df`` with running sums and last non-null values of expressions, by ``group`` in ``order``.

    ``backward``: from the group's end; ``inclusive``: with the row itself. ``order`` is an integer column, unique
    within its group, not null. Null group keys are one group. The rows are read twice, so settle what is dear.
    """
    sums, lasts = sums or {}, lasts or {}
    keyed = df.withColumn("__g", F.xxhash64(*group)).withColumn("__b", F.floor(F.col(order) / bucket).cast("long"))
    for name, expr in (sums | lasts).items():
        keyed = keyed.withColumn(f"__e_{name}", expr)
    sort = F.desc(order) if backward else F.asc(order)
    near = Window.partitionBy("__g", "__b").orderBy(sort).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    inner = keyed
    for name in sums:
        inner = inner.withColumn(f"__w_{name}", F.coalesce(F.sum(f"__e_{name}").over(near), F.lit(0)))
    for name in lasts:
        inner = inner.withColumn(f"__w_{name}", F.last(f"__e_{name}", ignorenulls=True).over(near))
    pick = F.min_by if backward else F.max_by
    whole = keyed.groupBy("__g", "__b").agg(
        F.count("*").alias("__n"),
        *[F.sum(f"__e_{n}").alias(f"__e_{n}") for n in sums],
        *[pick(f"__e_{n}", F.when(F.col(f"__e_{n}").isNotNull(), F.col(order))).alias(f"__e_{n}") for n in lasts],
    )
    far = Window.partitionBy("__g").orderBy(F.desc("__b") if backward else F.asc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select(
        "__g", "__b",
        *[F.coalesce(F.sum(f"__e_{n}").over(far), F.lit(0)).alias(f"__c_{n}") for n in sums],
        *[F.last(f"__e_{n}", ignorenulls=True).over(far).alias(f"__c_{n}") for n in lasts],
    )
    out = inner.join(carried, ["__g", "__b"])
    for name in sums:
        out = out.withColumn(name, F.col(f"__w_{name}") + F.col(f"__c_{name}"))
    for name in lasts:
        out = out.withColumn(name, F.coalesce(F.col(f"__w_{name}"), F.col(f"__c_{name}")))
    return out.drop("__g", "__b", *[f"__{k}_{n}" for n in (*sums, *lasts) for k in "ewc"])


def positions(df: DataFrame, group: list[str], order: str, name: str = "at", bucket: int = BUCKET) -> DataFrame:
    """``df`` with the position, from 1, of each row in its group; rows with one order value must be one row already."""
    return running(df, group, order, sums={name: F.lit(1).cast("long")}, bucket=bucket)
