"""Lengths, scores, overlaps, times and digests of lines, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ruby in bar notation: base between bar and bracket, reading in the bracket.
BAR_RUBY = r"｜([^｜()\n]+)\(([^()\n]*)\)"
#: The length at which a sentence scores best, and its spread.
BEST_LENGTH, SPREAD, EXACT_BONUS = 27.0, 15.0, 0.5
#: How far groups of the known-words order lie apart: more than any score.
GROUP_STEP, OTHER_READING = 10.0, 100


def without_ruby(col: Column | str) -> Column:
    """A line without the readings written in bar notation."""
    col = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(col, BAR_RUBY, "$1")


def shown_length(col: Column | str) -> Column:
    """Characters that count as shown: without readings, spaces, punctuation and signs. Null counts 0."""
    bare = F.regexp_replace(without_ruby(col), r"[ 　。…―～！？”“!?]", "")
    return F.coalesce(F.length(F.regexp_replace(bare, r"[^\p{L}\p{N}_、.,]", "")), F.lit(0))


def sentence_score(length: Column, exact: Column | None = None) -> Column:
    """Nearness to the best length, and a bonus where the searched text stands as typed."""
    away = (length - F.lit(BEST_LENGTH)) / F.lit(SPREAD)
    score = F.exp(F.lit(-0.5) * away * away)
    return score if exact is None else score + F.when(exact, F.lit(EXACT_BONUS)).otherwise(F.lit(0.0))


def known_score(score: Column, only_new: Column, known: Column, total: Column, other_reading: Column | None = None) -> Column:
    """A score shifted down by group: 0 for sentences whose one new word is the searched one, else unknown words."""
    group = F.when(only_new, F.lit(0)).otherwise(F.greatest(F.lit(1), total - known))
    if other_reading is not None:
        group = group + F.when(other_reading, F.lit(OTHER_READING)).otherwise(F.lit(0))
    return score - F.lit(GROUP_STEP) * group


def overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two boxes (left, top, right, bottom)."""
    width, height = F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    inside = width * height
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inside
    return F.when((width <= 0) | (height <= 0), F.lit(0.0)).otherwise(inside / F.greatest(F.lit(1), union))


def milliseconds(hours: Column, minutes: Column, seconds: Column, fraction: Column) -> Column:
    """A time of day in milliseconds; ``fraction`` is the text of the decimals."""
    part = F.rpad(F.substring(fraction, 1, 3), 3, "0").cast("long")
    return ((hours.cast("long") * 60 + minutes.cast("long")) * 60 + seconds.cast("long")) * 1000 + part


def caption_time(ms: Column) -> Column:
    """Milliseconds as hh:mm:ss,mmm."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(
        two(F.floor(ms / 3600000)), F.lit(":"), two(F.floor(ms / 60000) % 60), F.lit(":"), two(F.floor(ms / 1000) % 60), F.lit(","),
        F.lpad((ms % 1000).cast("string"), 3, "0"),
    )


def text_digest(position: Column, text: Column) -> Column:
    """An aggregate: SHA-256 of the texts in order of position, a newline after each. Groups must be small (a file)."""
    ordered = F.array_sort(F.collect_list(F.struct(position.alias("p"), F.coalesce(text, F.lit("")).alias("t"))))
    return F.sha2(F.concat(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n"), F.lit("\n")), 256)


def line_key(col: Column | str, least: int, keep: str = r"[^\p{L}\p{N}]") -> Column:
    """CRC-32 of what a line keeps, or null where that is shorter than ``least``. ``keep``: what is taken off."""
    col = F.lower(F.regexp_replace(F.col(col) if isinstance(col, str) else col, keep, ""))
    return F.when(F.length(col) >= least, F.crc32(col.cast("binary")))
