"""Problem 3: how often each term and each sequence of terms occurs, and in how many records.

A task joins the terms of its records to one integer sequence, each record ended by a separator of its own,
and builds the suffix array. An interval of depth n holds the occurrences of one n-gram; its width is the
number of occurrences, and the width less the adjacencies of two occurrences of one record is the number of
records. Records are whole within a task, so the counts of all tasks are added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .suffix import SuffixIndex

#: Records that a task joins to one sequence.
SEQUENCE_ROWS = 60_000

_OUT = pa.schema(
    [("field", pa.string()), ("n", pa.int32()), ("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())]
)


def _count(field: str, texts: pa.Array, separators: str, max_n: int | None) -> Iterator[pa.RecordBatch]:
    texts = texts.cast(pa.large_string()).combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts.cast(pa.large_string())
    split = pc.split_pattern_regex(texts, f"[{separators}]+")
    terms, record = pc.list_flatten(split), pc.list_parent_indices(split)
    full = pc.greater(pc.binary_length(terms), 0)
    terms, record = terms.filter(full), record.filter(full).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(terms):
        return
    coded = terms.dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    codes, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    ends = np.flatnonzero(np.append(record[1:] != record[:-1], True))
    seq = np.insert(codes, ends + 1, -1 - np.arange(len(ends)))
    owner = np.insert(record, ends + 1, -1 - np.arange(len(ends)))
    longest = int(np.diff(np.append(-1, ends)).max())
    most = longest if max_n is None else min(max_n, longest)
    index = SuffixIndex(seq, most)
    for n in range(1, most + 1):
        starts, occurrences, records = index.counts(n, owner)
        at = index.order[starts]
        ok = at + n <= len(seq)
        for step in range(n):
            inside = at + step < len(seq)
            ok &= inside
            ok[inside] &= seq[at[inside] + step] >= 0
        at, occurrences, records = at[ok], occurrences[ok], records[ok]
        parts = [words.take(pa.array(seq[at + step])) for step in range(n)]
        term = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))
        yield pa.record_batch(
            [pa.array([field] * len(at), pa.string()), pa.array(np.full(len(at), n, np.int32)), term.cast(pa.string()),
             pa.array(occurrences), pa.array(records)],
            schema=_OUT,
        )


def term_counts(
    df: DataFrame, fields: tuple[str, ...], row_id: str = "row_id", separators: str = " \t\u3000", max_n: int | None = 1
) -> DataFrame:
    """``field, n, term, occurrences, records`` of every n-gram of up to ``max_n`` terms, or of any length, in each of ``fields``.

    Without ``max_n`` the rows of the result are as many as the squares of the lengths of the records; that is for short ones.

    A term is a run of characters without a separator, taken as written; n-grams never cross records. Rows with
    the same ``row_id`` count once. Null, empty and blank texts have no terms; an empty table gives no rows;
    other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held)
            for field in fields:
                yield from _count(field, whole[field], separators, max_n)

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= SEQUENCE_ROWS:
                yield from flush()
                held, rows = [], 0
        if held:
            yield from flush()

    once = df.select(row_id, *fields).dropDuplicates([row_id]).select(*fields)
    once = once.filter(" or ".join(f"`{f}` is not null" for f in fields))
    return (
        once.mapInArrow(run, "field string, n int, term string, occurrences long, records long")
        .groupBy("field", "n", "term")
        .agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    )


def marked_terms(
    df: DataFrame, fields: tuple[str, ...], row_id: str = "row_id", rare_records: int = 2, common_share: float = 0.04, **kw
) -> DataFrame:
    """``term_counts`` with ``mark``: rare (in at most ``rare_records``), common (in more than ``common_share`` of all
    rows, rows with null included), else null. A term that is both, as in tiny tables, is rare."""
    total = df.select(row_id).distinct().agg(F.count("*").alias("__total")).withColumn("__one", F.lit(1))  # one row
    mark = F.when(F.col("records") <= rare_records, "rare").when(F.col("records") > common_share * F.col("__total"), "common")
    counted = term_counts(df, fields, row_id, **kw).withColumn("__one", F.lit(1))
    return counted.join(F.broadcast(total), "__one").withColumn("mark", mark).drop("__one", "__total")
