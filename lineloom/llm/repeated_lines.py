"""Problem 1: lines repeated across the documents of one source.

The lines of a source's documents are identifiers (hashes of the normalised line), joined to one sequence per
document with a separator after it. Suffix ranks over all of them are built by prefix doubling: a place has a rank
for the 2^k lines that begin there, made of the ranks of its two halves. Ranks are hashes, so no task needs the
sequence of a whole source and a source of any size is spread over all tasks; a place is kept at a level only while
the lines that begin there stand in enough documents, as every longer common prefix is at most as frequent. Going
back down the levels gives each place its longest common prefix in enough documents. Places that only continue the
block of the place before are dropped; the rest are the repeated blocks, of any length, and the rows that they cover
are deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineloom.operators.running import positions
from lineloom.session import settle

from .visible import letters_only


def line_ids(df: DataFrame, source: str, document: str, line: str, row_id: str = "row_id") -> DataFrame:
    """``row_id, src, doc, name``: hashes of source, document and normalised line of each row, once each.

    ``name`` is null for a null line or one without a letter. A null source or document is one of its own; rows
    without a ``row_id`` are left out. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [letters_only(x) if x else "" for x in batch.column(3).to_pylist()]
            # a signed number, as the JVM reads it
            names = [(xxhash.xxh64_intdigest(k) ^ 1 << 63) - (1 << 63) if k else None for k in keys]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(names, pa.int64())], names=["row_id", "src", "doc", "name"])

    taken = df.select(
        F.col(row_id).cast("long").alias("row_id"),
        F.xxhash64(F.lit("s"), F.col(source)).alias("src"),
        F.xxhash64(F.lit("d"), F.col(source), F.col(document)).alias("doc"),
        F.col(line).cast("string").alias("line"),
    ).filter("row_id is not null")
    return taken.mapInArrow(run, "row_id long, src long, doc long, name long").dropDuplicates(["row_id"])


def _documents(ids: DataFrame) -> DataFrame:
    """Number of documents of each source."""
    return ids.select("src", "doc").distinct().groupBy("src").agg(F.count("*").alias("documents"))


def _frequent(places: DataFrame, name: str, documents: DataFrame, min_documents: int, min_share: float) -> DataFrame:
    """``src, name, in_documents`` of the names that stand in enough documents of their source."""
    return (
        places.select("src", "doc", name)
        .distinct()
        .groupBy("src", name)
        .agg(F.count("*").alias("in_documents"))
        .filter(F.col("in_documents") >= min_documents)
        .join(documents, "src")
        .filter(F.col("in_documents") >= F.col("documents") * min_share)
        .drop("documents")
    )


class Blocks:
    """The repeated blocks of a table and the places they cover."""

    def __init__(self, ids: DataFrame, min_documents: int, min_share: float):
        self.documents = settle(_documents(ids), "documents")
        self._least = (min_documents, min_share)
        lettered = ids.filter("name is not null")
        single = lettered.join(_frequent(lettered, "name", self.documents, *self._least).drop("in_documents"), ["src", "name"], "left_semi")
        # positions count all rows of a document, so that a line which is not repeated parts its neighbours
        placed = positions(ids.select("doc", "row_id"), ["doc"], "row_id").select("row_id", "at")
        self.places = settle(single.join(placed, "row_id").select("src", "doc", "at", "row_id", "name"), "places")
        self.levels = [self.places.select("src", "doc", "at", "name")]
        while True:
            width, last = 1 << (len(self.levels) - 1), self.levels[-1]
            joined = self._joined(last, last, F.lit(width), "name").drop("name").withColumnRenamed("longer", "name")
            level = settle(joined.join(_frequent(joined, "name", self.documents, *self._least).drop("in_documents"), ["src", "name"], "left_semi"), "level")
            if level.isEmpty():
                break
            self.levels.append(level.select("src", "doc", "at", "name"))
        self.starts = settle(self._starts(), "starts")

    @staticmethod
    def _joined(places: DataFrame, level: DataFrame, ahead, name: str) -> DataFrame:
        """Places whose block is followed, ``ahead`` lines on, by a block of ``level``; ``longer`` names the two together."""
        after = level.select(F.col("doc").alias("__doc"), F.col("at").alias("__at"), F.col("name").alias("__name"))
        both = places.join(after, (F.col("doc") == F.col("__doc")) & (F.col("at") + ahead == F.col("__at")))
        return both.withColumn("longer", F.xxhash64(name, "__name")).drop("__doc", "__at", "__name")

    def _starts(self) -> DataFrame:
        """``src, doc, at, depth, name, parts``: the longest repeated block of each place that does not lie in the one before.

        ``parts`` has the rank of each of the halves it is made of, the longest first.
        """
        top = len(self.levels) - 1
        at = self.levels[top].select("src", "doc", "at", F.lit(1 << top).cast("long").alias("depth"), "name", F.array("name").alias("parts"))
        for k in range(top - 1, -1, -1):
            # places that have no block yet begin with this level, others try to grow by it
            fresh = self.levels[k].join(at, ["doc", "at"], "left_anti").select("src", "doc", "at", F.lit(1 << k).cast("long").alias("depth"), "name", F.array("name").alias("parts"))
            after = self.levels[k].select(F.col("doc").alias("__doc"), F.col("at").alias("__at"), F.col("name").alias("__name"))
            grown = at.join(after, (F.col("doc") == F.col("__doc")) & (F.col("at") + F.col("depth") == F.col("__at")))
            grown = grown.select("src", "doc", "at", (F.col("depth") + (1 << k)).alias("depth"), F.xxhash64("name", "__name").alias("name"), F.concat("parts", F.array("__name")).alias("parts"))
            grown = grown.join(_frequent(grown, "name", self.documents, *self._least).drop("in_documents"), ["src", "name"], "left_semi").select("src", "doc", "at", "depth", "name", "parts")
            at = settle(at.join(grown, ["doc", "at"], "left_anti").unionByName(grown).unionByName(fresh), "longest")
        before = at.select("doc", (F.col("at") + 1).alias("at"), F.col("depth").alias("before"))
        return at.join(before, ["doc", "at"], "left").filter(F.col("before").isNull() | (F.col("before") < F.col("depth") + 1)).drop("before")

    def covered(self) -> DataFrame:
        """``row_id`` of all rows in the blocks."""
        inside = self.starts.select("doc", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("depth") - 1)).alias("at")).distinct()
        return self.places.join(inside, ["doc", "at"], "left_semi").select("row_id")

    def blocks(self) -> DataFrame:
        """``depth, block, src, in_documents, documents, example`` of each block, counted wherever it stands."""
        named = self.starts.select("src", "depth", "name", "parts").dropDuplicates(["src", "depth", "name"])
        found = None
        for k, level in enumerate(self.levels):
            here = named.filter((F.col("depth") >= 1 << k) & (F.col("depth") < 2 << k))
            first = level.select("src", "doc", F.col("at").alias("begin"), F.col("name").alias("__first"))
            hits = here.join(first.withColumnRenamed("src", "__src"), (F.col("src") == F.col("__src")) & (F.col("parts")[0] == F.col("__first"))).drop("__src", "__first")
            hits = hits.withColumn("held", F.lit(1 << k).cast("long")).withColumn("part", F.lit(1))
            for lower in range(k - 1, -1, -1):
                bit = F.floor(F.col("depth") / (1 << lower)) % 2 == 1
                after = self.levels[lower].select(F.col("doc").alias("__doc"), F.col("at").alias("__at"), F.col("name").alias("__name"))
                grown = hits.filter(bit).join(after, (F.col("doc") == F.col("__doc")) & (F.col("begin") + F.col("held") == F.col("__at")) & (F.expr("parts[part]") == F.col("__name")), "left_semi")
                hits = grown.withColumn("held", F.col("held") + (1 << lower)).withColumn("part", F.col("part") + 1).unionByName(hits.filter(~bit))
            found = hits if found is None else found.unionByName(hits)
        rows = found.join(self.places.select("doc", F.col("at").alias("begin"), "row_id"), ["doc", "begin"])
        each = rows.groupBy("src", "depth", "name", "doc").agg(F.min("row_id").alias("row_id"))
        counted = each.groupBy("src", "depth", "name").agg(F.count("*").alias("in_documents"), F.min("row_id").alias("example"))
        return counted.join(self.documents, "src").select(F.col("depth").cast("int").alias("depth"), F.col("name").alias("block"), "src", "in_documents", "documents", "example")


def find_blocks(
    df: DataFrame, source: str, document: str, line: str, row_id: str = "row_id", min_documents: int = 4, min_share: float = 0.3
) -> Blocks:
    """The blocks of lines in at least ``min_documents`` documents and ``min_share`` of those of their source.

    Lines without a letter, and null ones, are in no block and part their neighbours. Rows given twice count once. An
    empty table has no blocks. Cases else as in ``line_ids``.
    """
    return Blocks(settle(line_ids(df, source, document, line, row_id), "lines"), min_documents, min_share)


def repeated_blocks(df: DataFrame, source: str, document: str, line: str, row_id: str = "row_id", **kw) -> DataFrame:
    """``depth, block, src, in_documents, documents, example``: blocks that are the longest at some place and do not only
    continue another there; counted in all documents that hold them. ``example`` is the smallest row at which it begins."""
    return find_blocks(df, source, document, line, row_id, **kw).blocks()


def repeated_rows(df: DataFrame, source: str, document: str, line: str, row_id: str = "row_id", **kw) -> DataFrame:
    """``row_id`` of the rows that lie in a repeated block."""
    return find_blocks(df, source, document, line, row_id, **kw).covered()


def remove_repeated_lines(df: DataFrame, source: str, document: str, line: str, row_id: str = "row_id", **kw) -> DataFrame:
    """``df`` without the rows of repeated blocks; all other rows and columns stay as they are."""
    gone = repeated_rows(df, source, document, line, row_id, **kw).withColumnRenamed("row_id", "__gone")
    return df.join(gone, F.col(row_id) == F.col("__gone"), "left_anti")
