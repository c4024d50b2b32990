"""The reader: rows around a row, positions within files, and rows found again after a new index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineloom.session import settle


def context(lines: DataFrame, focus: DataFrame, before: int = 4, after: int = 4, bounds: tuple[str, ...] = ("source_id", "file")) -> DataFrame:
    """``focus_id`` and the rows from ``before`` rows before it to ``after`` after it within the same bounds.

    ``focus`` has ``row_id``; bounds that are null agree with null. Both counts are held within 0 to 10. Rows stand by
    their ``row_id``: a join on the id range asked for, not a window over whole files.
    """
    before, after = (max(0, min(10, n)) for n in (before, after))
    ids = focus.select("row_id").distinct()
    here = lines.join(ids, "row_id", "left_semi").select("row_id", *bounds).dropDuplicates(["row_id"])
    steps = F.explode(F.sequence(F.col("row_id") - before, F.col("row_id") + after))
    asked = here.select(F.col("row_id").alias("focus_id"), steps.alias("row_id"), *[F.col(b).alias(f"__{b}") for b in bounds])
    joined = lines.join(asked, "row_id")  # few rows are asked for: only they are moved, and taken once
    for b in bounds:
        joined = joined.filter(F.col(f"__{b}").eqNullSafe(F.col(b)))
    return joined.select("focus_id", *lines.columns).dropDuplicates(["focus_id", "row_id"])


def offsets(lines: DataFrame, group: tuple[str, ...] = ("source_id", "file")) -> DataFrame:
    """``row_id, offset``: how many rows of its file stand before each row."""
    from .running import positions

    rows = lines.select("row_id", *group).dropDuplicates(["row_id"])
    return positions(rows, list(group), "row_id", "offset").select("row_id", (F.col("offset") - 1).alias("offset"))


def episode_order(files: DataFrame, show: str = "folder", file: str = "file") -> DataFrame:
    """``files`` with ``kind``, ``group_rank`` and ``episode``: films first where others are numbered, then season, OVA, special,
    film and other, in order of name. Names are matched by pattern, see ``functions.titles``."""
    from lineloom.functions.titles import group_columns, numbered

    named = group_columns(files, file)
    own = Window.partitionBy(show)
    counted = named.withColumn("__any", F.max(numbered(file).cast("int")).over(own))
    grouped = counted.withColumn("__split", F.max((F.col("kind") != "other").cast("int")).over(own))
    film = F.when((F.col("__any") == 1) & (F.col("kind") == "film") & ~numbered(file), 0).otherwise(1)
    rank = F.when(F.col("__split") == 1, F.col("group_rank")).otherwise(F.lit(0.0))
    order = Window.partitionBy(show).orderBy(rank, film, file)
    return grouped.withColumn("episode", F.row_number().over(order)).drop("__any", "__split")


def _nearest(points: DataFrame, rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``points`` with the row of equal keys that is nearest to ``r``, the one before it where two are: as-of joins from both
    sides, so that a text which stands in a million rows is not paired with each of them."""
    from .joins import as_of

    starts = rows.select(*keys, F.col("row_id").alias("start"), F.col("row_id").alias(f"{name}_before"))
    # each join reads its points twice, so they are settled in between
    back = settle(as_of(points, starts, "r", "start", [f"{name}_before"], keys), "before")
    ends = rows.select(*keys, (-F.col("row_id")).alias("start"), F.col("row_id").alias(f"{name}_after"))
    both = as_of(back.withColumn("__m", -F.col("r")), ends, "__m", "start", [f"{name}_after"], keys).drop("__m")
    a, b = F.col(f"{name}_before"), F.col(f"{name}_after")
    near = F.when(b.isNull() | (F.col("r") - a <= b - F.col("r")), a).otherwise(b)
    return settle(both.withColumn(name, F.coalesce(near, b)).drop(f"{name}_before", f"{name}_after"), "nearest")


def relocate(lines: DataFrame, saved: DataFrame) -> DataFrame:
    """Saved rows found again: ``saved_id, row_id, how``; ``saved`` has ``saved_id, media, folder, file, row_id, text``.

    The same row with the same text (same), else the nearest row of the work with that text, its file first (moved), else
    the first row, by medium and id, anywhere with that text (elsewhere), else none (gone). Null texts are gone.
    """
    columns = ["media", "folder", "file", "text"]
    rows = lines.select("media", "folder", "file", "row_id", F.col("line").alias("text")).filter("text is not null")
    once = saved.dropDuplicates(["saved_id"]).select("saved_id", *columns, F.col("row_id").cast("long").alias("r"))
    same = once.join(rows.select("media", "folder", "text", F.col("row_id").alias("r")).distinct(), ["media", "folder", "text", "r"], "left_semi").select("saved_id", F.col("r").alias("row_id"), F.lit("same").alias("how"))
    left = settle(once.join(same.select("saved_id"), "saved_id", "left_anti"), "saved")
    rows = settle(rows.join(left.select("text").distinct(), "text", "left_semi"), "candidates")
    near = _nearest(_nearest(left, rows, columns, "in_file"), rows, ["media", "folder", "text"], "in_work")
    first = rows.groupBy("text").agg(F.min(F.struct("media", "row_id"))["row_id"].alias("anywhere"))
    found = near.join(first, "text", "left")
    moved = F.coalesce("in_file", "in_work")
    how = F.when(moved.isNotNull(), "moved").when(F.col("anywhere").isNotNull(), "elsewhere").otherwise("gone")
    return same.unionByName(found.select("saved_id", F.coalesce(moved, F.col("anywhere")).alias("row_id"), how.alias("how")))


def page_edges(starts: list[int], total: int, offset: int, limit: int) -> tuple[int, int]:
    """The bounds of a page, moved to the section starts nearest after them within four pages."""
    snap = lambda at: next((s for s in starts if at <= s < at + 4 * limit), at)
    begin = 0 if offset <= 0 else min(snap(offset), total)
    return begin, min(max(snap(begin + limit), begin), total)


def folder_page(tree: DataFrame, files: DataFrame, path: str, sort: str = "name", limit: int | None = None, offset: int = 0) -> DataFrame:
    """``kind, name, path, lines`` of what a folder holds: folders first, then files. ``tree`` is ``library.folder_tree``, ``files`` has
    ``path, n_lines, order_key``."""
    inside = tree.filter(F.col("parent") == path).select(F.lit(0).alias("k"), F.lit("folder").alias("kind"), "name", "path", F.col("lines").cast("long").alias("lines"), "order_key")
    base = F.regexp_replace("path", r"\\", "/")
    above = F.regexp_replace(base, "/?[^/]*$", "")
    own = files.filter(above == path).select(F.lit(1).alias("k"), F.lit("file").alias("kind"), F.regexp_extract(base, "([^/]*)$", 1).alias("name"), base.alias("path"), F.col("n_lines").cast("long").alias("lines"), "order_key")
    keys = {"lines_desc": [F.desc("lines")], "lines_asc": [F.asc("lines")]}.get(sort, [F.asc("order_key")])
    rows = inside.unionByName(own).orderBy("k", *keys, "name")
    rows = rows.offset(offset) if offset else rows
    return (rows.limit(limit) if limit else rows).drop("k", "order_key")


def file_page(lines: DataFrame, file: str, limit: int, offset: int = 0, hits=None) -> DataFrame:
    """A page of a file's rows in order with ``fold``, where its section changes, and ``hit``; with ``hits`` rows that match only."""
    from .windows import fold_starts

    rows = lines.filter(F.col("file") == file).dropDuplicates(["row_id"])
    rows = fold_starts(rows, ["source_id"], "row_id", "section_no")
    rows = rows.withColumn("hit", hits if hits is not None else F.lit(False))
    if hits is not None:
        rows = rows.filter("hit")
    return rows.orderBy("row_id").offset(offset).limit(limit)


def place_of(lines: DataFrame, file: str, row_id: int, text: str) -> DataFrame:
    """``row_id, offset`` of a saved position, if the row still stands there with its text."""
    rows = lines.filter(F.col("file") == file).dropDuplicates(["row_id"])
    found = rows.filter((F.col("row_id") == row_id) & (F.col("line") == text)).select("row_id").withColumn("one", F.lit(1))
    before = rows.filter(F.col("row_id") < row_id).agg(F.count("*").alias("offset")).withColumn("one", F.lit(1))
    return found.join(before, "one").select("row_id", "offset")


def nearest_row(lines: DataFrame, text: str, file: str, row_id: int) -> DataFrame:
    """The row with a text that is nearest to a position, its file first."""
    return lines.filter(F.col("line") == text).orderBy((F.col("file") != file).cast("int"), F.abs(F.col("row_id") - row_id), "row_id").limit(1)
