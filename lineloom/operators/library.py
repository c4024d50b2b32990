"""The library: works with their parts and lines, totals, folders, title clashes, small works, pages of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineloom.functions.script import fold_title

LIBRARY_SORTS = {"name": ("folder", True), "parts_desc": ("parts", False), "parts_asc": ("parts", True), "lines_desc": ("lines", False), "lines_asc": ("lines", True)}


def work_of(media: Column, relpath: Column, title: Column, category: Column) -> Column:
    """The work to which a source belongs."""
    first = F.split(relpath, r"[\\/]")[0]
    return F.when(media == "subs", first).when(media == "custom", F.coalesce(category, first)).otherwise(F.coalesce(title, F.regexp_replace(relpath, r"(?i)\.(epub|mokuro)$", "")))


def chapter_spans(lines: DataFrame) -> DataFrame:
    """``media, source_id, file, first, last, lines`` of each file, rows delivered twice once."""
    once = lines.select("media", "source_id", "file", "row_id").distinct()
    return once.groupBy("media", "source_id", "file").agg(F.min("row_id").alias("first"), F.max("row_id").alias("last"), F.count("*").alias("lines"))


def media_library(sources: DataFrame, lines: DataFrame) -> DataFrame:
    """``media, folder, author, parts, lines`` of each work: its sources, and the lines they have."""
    counted = chapter_spans(lines).groupBy("media", "source_id").agg(F.sum("lines").alias("lines"))
    named = sources.withColumn("folder", work_of(F.col("media"), F.col("relpath"), F.col("title"), F.col("category")))
    both = named.join(counted, ["media", "source_id"], "left")
    return both.groupBy("media", "folder").agg(F.coalesce(F.max("author"), F.lit("")).alias("author"), F.count("*").alias("parts"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"))


def library_page(items: DataFrame, needle: str = "", media: str = "all", sort: str = "name", limit: int | None = None, offset: int = 0, inner: DataFrame | None = None) -> DataFrame:
    """Works whose folded name or author holds the folded needle, in order, and after them the names within works that do."""
    rows = items if media == "all" else items.filter(F.col("media") == media)
    wanted = fold_title(F.lit(needle.strip()))
    rows = rows.withColumn("inner", F.lit(False))
    if needle.strip():
        rows = rows.filter(F.contains(fold_title("folder"), wanted) | F.contains(fold_title("author"), wanted))
        if inner is not None:
            own = F.replace(fold_title("title"), fold_title("folder"), F.lit("\n"))
            more = inner.filter(F.contains(own, wanted)) if media == "all" else inner.filter((F.col("media") == media) & F.contains(own, wanted))
            rows = rows.unionByName(more.withColumn("inner", F.lit(True)), allowMissingColumns=True)
    column, up = LIBRARY_SORTS.get(sort, LIBRARY_SORTS["name"])
    key = fold_title(column) if column == "folder" else F.col(column)
    ordered = rows.orderBy("inner", key.asc() if up else key.desc(), fold_title("folder"), "media", *(["title"] if "title" in rows.columns else []))
    ordered = ordered.offset(offset) if offset else ordered
    return ordered.limit(limit) if limit else ordered


def inner_names(sources: DataFrame) -> DataFrame:
    """``media, folder, title, file`` of the files and folders within works."""
    named = sources.withColumn("folder", work_of(F.col("media"), F.col("relpath"), F.col("title"), F.col("category"))).withColumn("path", F.regexp_replace("relpath", r"\\", "/"))
    files = named.select("media", "folder", F.regexp_extract("path", r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1).alias("title"), F.col("relpath").alias("file"))
    parts = F.split("path", "/")
    inside = F.when(F.size(parts) > 2, F.slice(parts, 2, F.size(parts) - 2)).otherwise(F.array().cast("array<string>"))
    folders = named.select("media", "folder", F.explode(inside).alias("title"), "relpath").groupBy("media", "folder", "title").agg(F.min("relpath").alias("file"))
    return files.unionByName(folders)


def folder_tree(sources: DataFrame, path: Column) -> DataFrame:
    """``path, parent, name, files, lines, order_key`` of every folder above a source, the root with an empty path."""
    parts = F.split(path, r"[\\/]")
    own = sources.select(parts.alias("p"), F.coalesce(F.col("n_lines"), F.lit(0)).cast("long").alias("n"), "order_key")
    steps = F.transform(F.sequence(F.lit(0), F.size("p") - 1), lambda k: F.array_join(F.slice(F.col("p"), 1, k), "/"))
    rows = own.select(F.explode(steps).alias("path"), "n", "order_key")
    out = rows.groupBy("path").agg(F.count("*").alias("files"), F.sum("n").alias("lines"), F.min("order_key").alias("order_key"))
    parent = F.when(F.col("path") == "", None).when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    return out.select("path", parent.alias("parent"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "files", "lines", "order_key")


def lone_files(tree_sources: DataFrame) -> DataFrame:
    """``category, relpath`` of the categories of exactly one file that bears their name."""
    stem = F.regexp_extract(F.regexp_replace("relpath", r"\\", "/"), r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1)
    each = tree_sources.groupBy("category").agg(F.count("*").alias("n"), F.min("relpath").alias("relpath"), F.min(stem).alias("stem"))
    return each.filter((F.col("n") == 1) & (F.col("stem") == F.col("category"))).select("category", "relpath")


def title_clashes(sources: DataFrame, title: str = "title", key: str = "relpath") -> DataFrame:
    """``title, n, members``: titles of several sources."""
    each = sources.groupBy(title).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(key)), "|").alias("members"))
    return each.filter((F.col("n") > 1) & F.col(title).isNotNull())


def small_sources(sources: DataFrame, spans: DataFrame, most: int = 200) -> DataFrame:
    """``media, source_id`` without a line, or with at most ``most`` of them."""
    small = spans.groupBy("media", "source_id").agg(F.sum(F.col("last") - F.col("first") + 1).alias("n")).filter(F.col("n") <= most)
    without = sources.select("media", "source_id").subtract(spans.select("media", "source_id"))
    return without.union(small.select("media", "source_id")).distinct()


def summaries(sources: DataFrame, spans: DataFrame, required: dict[str, int]) -> DataFrame:
    """``media, files, lines, outdated``: per medium, and how many files were indexed in a form older than required."""
    counted = spans.groupBy("media").agg(F.sum("lines").alias("lines"))
    least = F.create_map(*[F.lit(x) for kv in required.items() for x in kv])
    per = sources.groupBy("media").agg(F.count("*").alias("files"), F.count_if(F.col("format_version") < least[F.col("media")]).alias("outdated"))
    return per.join(counted, "media", "left").select("media", "files", F.coalesce("lines", F.lit(0)).alias("lines"), "outdated")


def report_pages(rows: DataFrame, order: list[str], section: str, size: int = 200) -> DataFrame:
    """``rows`` with ``page`` and ``place`` within its section of a report."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(section).orderBy(*order)) - 1
    return rows.withColumn("place", place).withColumn("page", F.floor(F.col("place") / size).cast("int"))


def estimate(new_files: DataFrame, sample: DataFrame, bytes_per_char: float = 33.5) -> DataFrame:
    """``media, files, lines, bytes`` expected of new files, carried on from measured samples by bytes of file.

    ``sample``: ``media, file_size, lines, chars``; ``new_files``: ``media, file_size``.
    """
    rate = sample.groupBy("media").agg((F.sum("lines") / F.sum("file_size")).alias("lines_rate"), (F.sum("chars") / F.sum("file_size")).alias("chars_rate"))
    new = new_files.groupBy("media").agg(F.count("*").alias("files"), F.sum("file_size").alias("size"))
    return new.join(rate, "media", "left").select(
        "media", "files", F.round(F.col("size") * F.col("lines_rate")).cast("long").alias("lines"), F.round(F.col("size") * F.col("chars_rate") * bytes_per_char).cast("long").alias("bytes")
    )
