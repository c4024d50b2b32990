"""The search: rows that match a query, scored, taken once per folder and line, ordered and paged, with counts per folder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineloom.functions.measure import known_score, sentence_score, shown_length
from lineloom.plans.analyzers import Analyzer, SpacedAnalyzer
from lineloom.plans.query import Plan, chosen_media, chosen_sort, plan
from lineloom.sources.tables import media_rank

from . import predicates as P


def with_scores(rows: DataFrame, exact: Column) -> DataFrame:
    """``rows`` with ``exact``, ``chars`` (kept where stored) and ``score``."""
    return (
        rows.withColumn("exact", exact)
        .withColumn("chars", F.coalesce(F.col("chars"), shown_length("line")))
        .withColumn("score", sentence_score(F.col("chars"), F.col("exact")))
    )


def first_rows(rows: DataFrame, keys: tuple[str, ...] = ("media", "folder", "line")) -> DataFrame:
    """The row of the smallest ``row_id`` for each key. It is an aggregate with partial sums, not a window, so that a line
    which stands a million times in a folder is reduced before it is moved."""
    rest = [c for c in rows.columns if c not in keys and c != "row_id"]
    taken = rows.groupBy(*keys).agg(F.min(F.struct("row_id", *rest)).alias("__r"))
    return taken.select(*keys, "__r.row_id", *[F.col(f"__r.{c}").alias(c) for c in rest]).select(*rows.columns)


def order_of(sort: str, seed: int | None = None, ranks: Column | None = None) -> list[Column]:
    """The sort keys of a search, ties broken by medium, line and row, so that pages never overlap."""
    ties = [media_rank(), F.col("line"), F.col("row_id")]
    if sort == "desc":
        return [F.col("chars").desc(), *ties]
    if sort == "asc":
        return [F.col("chars").asc(), *ties]
    if sort == "random":
        return [F.md5(F.concat_ws("|", F.lit(str(seed or 0)), "media", F.col("row_id").cast("string"))), *ties]
    if sort == "chrono":
        return [media_rank(), F.col("file") if ranks is None else ranks, F.col("row_id")]
    return [F.col("score").desc(), *ties]


def page(rows: DataFrame, keys: list[Column], limit: int | None, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of an order; all of them without a limit."""
    ordered = rows.orderBy(*keys)
    if offset:
        ordered = ordered.offset(offset)
    return ordered if limit is None else ordered.limit(limit)


def folder_counts(rows: DataFrame) -> DataFrame:
    """``folder, hits``: rows per folder, to be ordered by hits and first row."""
    return rows.groupBy("folder").agg(F.count("*").alias("hits"), F.min("row_id").alias("first"))


@dataclass
class SearchResult:
    page: DataFrame
    folder_counts: DataFrame
    rows: DataFrame
    plan: Plan
    limit: int | None
    offset: int

    def total(self) -> int:
        return self.rows.count()

    def has_more(self) -> bool:
        """Whether rows stand after the page; one row beyond it is looked for, not all counted."""
        return self.limit is not None and not self.rows.offset(self.offset + self.limit).limit(1).isEmpty()


class Engine:
    """Searches over lines of the schema of ``sources.tables``."""

    def __init__(self, lines: DataFrame, analyzer: Analyzer | None = None, sources: DataFrame | None = None):
        self.lines, self.analyzer, self.sources = lines, analyzer or SpacedAnalyzer(), sources

    def scope(self, media: str | None = "all", folders: list[str] | None = None, file: str | None = None) -> DataFrame:
        rows = self.lines.filter(F.col("media").isin(*chosen_media(media)))
        if folders:
            rows = rows.filter(F.col("folder").isin(*folders))
        return rows.filter(F.col("file") == file) if file else rows

    def matches(self, text: str, media: str | None = "all", folders=None, file=None, exact=False, ruby_only=False) -> tuple[DataFrame, Plan]:
        """Verified rows with scores, each row once, before lines are taken once; and the plan of the query."""
        wanted = plan(text, self.analyzer, exact)
        rows = self.scope(media, folders, file)
        if wanted.empty:
            return with_scores(rows.limit(0), F.lit(False)), wanted
        found = rows.filter(P.verified(wanted, ruby_only))
        if ruby_only and wanted.parsed.terms:
            found = found.join(P.works_with_ruby(rows), ["media", "folder"], "left_semi")
        # filtered first: only matches are moved to drop rows delivered twice
        return with_scores(found.dropDuplicates(["media", "row_id"]), P.is_exact(wanted)), wanted

    def search(self, text: str, media: str | None = "all", folders=None, file=None, sort: str = "recommended", seed: int | None = None,
               exact: bool = False, ruby_only: bool = False, limit: int | None = 500, offset: int = 0, learn=None) -> SearchResult:
        """Rows of a query in order. ``learn``: (``known.Vocabulary``, "first" or "only"), see ``known.classify``."""
        sort = chosen_sort(sort)
        found, wanted = self.matches(text, media, folders, file, exact, ruby_only)
        rows = found if sort == "chrono" else first_rows(found)
        keys = order_of(sort, seed)
        if learn:
            from .known import classify

            vocabulary, mode = learn
            rows = classify(rows, self.target(wanted), vocabulary)
            if mode == "only":
                rows = rows.filter("i1")
            else:
                rows = rows.withColumn("score", known_score(F.col("score"), F.col("i1"), F.col("known"), F.col("total")))
                if sort != "recommended":
                    keys = [F.when(F.col("score") > 0.5, 0).when(F.col("score") >= -0.5, 1).otherwise(2), *keys]
        return SearchResult(page(rows, keys, limit, offset), folder_counts(rows).orderBy(F.desc("hits"), "first"), rows, wanted, limit, offset)

    def target(self, wanted: Plan) -> tuple[str, ...]:
        """The units that a query asks to learn: its base forms without trailing particles."""
        units = [t for t in self.analyzer.tokens(wanted.query)]
        while len(units) > 1 and units[-1].pos in ("助詞", "助動詞"):
            units.pop()
        return tuple(t.base for t in units)

    def counts(self, text: str, media: str | None = "all", sort: str = "recommended") -> DataFrame | None:
        """``folder, hits`` from the index alone, unverified; None where the index cannot answer alone."""
        wanted = plan(text, self.analyzer)
        p = wanted.parsed
        if wanted.empty or wanted.exact or wanted.excluded or p.terms or p.excluded_terms or p.literals or wanted.bound or not wanted.clauses:
            return None
        rows = self.scope(media).filter(P.candidates(wanted))
        # each line once per folder, or each row once; both are aggregates with partial sums
        keys = ["media", "folder", "row_id"] if chosen_sort(sort) == "chrono" else ["media", "folder", "line"]
        return rows.select(*keys).distinct().groupBy("folder").agg(F.count("*").alias("hits"))

    def browse(self, folder: str, file: str | None = None, media: str | None = "all", limit: int | None = None, offset: int = 0) -> DataFrame:
        """The rows of a folder or file in order, each with score 1."""
        rows = self.scope(media, [folder], file).dropDuplicates(["media", "row_id"])
        rows = rows.withColumn("chars", F.coalesce(F.col("chars"), shown_length("line"))).withColumn("score", F.lit(1.0))
        return page(rows, [media_rank(), F.col("file"), F.col("row_id")], limit, offset)

    def folders(self, media: str | None = "all") -> DataFrame:
        """``folder, media``: the works and the media in which each stands."""
        return self.scope(media).groupBy("folder").agg(F.array_sort(F.collect_set("media")).alias("media"))

    def total(self, media: str | None = "all") -> DataFrame:
        """The number of lines of each chosen medium, rows delivered twice once."""
        return self.scope(media).select("media", "row_id").distinct().groupBy("media").agg(F.count("*").alias("lines"))

    def media_of(self, file: str, row_id: int | None = None) -> DataFrame:
        """The media that hold a file, and a row of it."""
        rows = self.lines.filter(F.col("file") == file)
        return (rows if row_id is None else rows.filter(F.col("row_id") == row_id)).select("media").distinct()

    def locate(self, texts: list[str], limit: int = 500) -> DataFrame:
        """The shortest lines of each medium that hold all texts."""
        from pyspark.sql import Window

        found = self.lines.filter(P.locate(texts)).dropDuplicates(["media", "row_id"]).withColumn("size", F.length("clean_text"))
        place = F.row_number().over(Window.partitionBy("media").orderBy("size", "row_id"))
        return found.withColumn("place", place).filter(F.col("place") <= limit)


def with_pages(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """``rows`` with the page of scanned lines; others have none."""
    once = pages.select("row_id", "page").dropDuplicates(["row_id"]).withColumn("media", F.lit("manga"))
    return rows.join(once, ["media", "row_id"], "left")


def cache_key(text: str, sort: str, seed, media: str, exact: bool, folders, version: str, ruby_only: bool = False, learn: str = "") -> str:
    """The identity of a search over one version of the index."""
    import hashlib
    import json

    parts = [text, chosen_sort(sort), seed if sort == "random" else None, sorted(chosen_media(media)), exact, sorted(folders or ()), version, ruby_only, learn]
    return hashlib.sha256(json.dumps(parts, ensure_ascii=False).encode()).hexdigest()
