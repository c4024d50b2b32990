"""Bytes of caption files to text: encodings tried in order, damaged files saved where little is broken."""

from __future__ import annotations

import hashlib
import math

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

#: The share of lines that may be broken in a saved file, and that of kana its text must have.
MOST_BROKEN, LEAST_KANA = 0.05, 0.01
_KANA = regex.compile("[ぁ-ゖァ-ヺ]")
_BINARY = regex.compile(rb"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
TIMECODE = regex.compile(r"\d{2,}(?::\d{2}){2,3}[,.]\S+\s*-->\s*\d{2,}(?::\d{2}){2,3}[,.]\S+")
_ASS = regex.compile(r"(?im)^\s*\[(?:script info|events|v4\+? styles)\]\s*$")
_HTML = regex.compile(r"(?i)^\s*(?:<!doctype\s+html|<html\b)")


class Unreadable(ValueError):
    """A file that is no captions; ``reason`` is unreadable, html_error or unsupported."""

    def __init__(self, reason: str):
        super().__init__(reason)
        self.reason = reason


def _decoded(raw: bytes, encoding: str) -> str | None:
    try:
        return raw.decode(encoding)
    except UnicodeDecodeError:
        return None


def salvage(raw: bytes) -> tuple[str, str] | None:
    """(text, encoding) of a damaged file in the encoding that breaks fewer of its lines; binary lines are left out."""
    lines = raw.removeprefix(b"\xef\xbb\xbf").splitlines(keepends=True) or [b""]
    broken = {e: sum(_decoded(x, e) is None for x in lines) for e in ("utf-8", "cp932")}
    encoding = min(broken, key=broken.get)
    text = "".join(x.decode(encoding, "replace") for x in lines if not _BINARY.search(x))
    if broken[encoding] > MOST_BROKEN * len(lines) or len(_KANA.findall(text)) < LEAST_KANA * len(text):
        return None
    return text, f"{encoding}-damaged"


def decode_bytes(raw: bytes) -> tuple[str, str]:
    """(text, encoding): by byte order mark, escape sequences, then UTF-8, cp932, EUC-JP, and as damaged."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        order = ["utf-16"]
    else:
        order = (["iso2022_jp"] if b"\x1b$" in raw or b"\x1b(" in raw else []) + ["utf-8-sig", "cp932", "euc_jp"]
    for encoding in order:
        text = _decoded(raw, encoding)
        if text is not None:
            return text, encoding
    saved = None if order == ["utf-16"] else salvage(raw)
    if saved is None:
        raise Unreadable("unreadable")
    return saved


_NUMERIC = regex.compile(r"(?i)\\(?:fscx|fscy|fsp|fs|frx|fry|frz|p|an)(?![a-z])([^\\})]*)")
_PLACED = regex.compile(r"(?i)\\(pos|org|move)\(([^)]*)\)")


def _is_number(text: str) -> bool:
    try:
        return math.isfinite(float(text))
    except ValueError:
        return False


def sanitize_ass(text: str) -> tuple[str, list[str]]:
    """(text without override tags whose numbers are malformed, those tags)."""
    warned = set()

    def keep(hit, good):
        if not good:
            warned.add(hit[0])
        return hit[0] if good else ""

    def placed(hit):
        values = hit[2].split(",")
        return keep(hit, len(values) in ((4, 6) if hit[1].lower() == "move" else (2,)) and all(map(_is_number, values)))

    def block(hit):
        return _PLACED.sub(placed, _NUMERIC.sub(lambda h: keep(h, _is_number(h[1])), hit[0]))

    return regex.sub(r"\{[^}]*\}", block, text), sorted(warned)


def read_captions(raw: bytes) -> dict:
    """``text, format, encoding, warnings, sha, bytes`` of a caption file; the format is ass, srt or empty."""
    text, encoding = decode_bytes(raw)
    if _HTML.search(text):
        raise Unreadable("html_error")
    kind = "ass" if _ASS.search(text) else "srt" if TIMECODE.search(text) else "empty" if not text.strip() else None
    if kind is None:
        raise Unreadable("unsupported")
    warnings = [f"{n} broken lines"] if encoding.endswith("-damaged") and (n := sum("�" in x for x in text.splitlines())) else []
    if kind == "ass":
        text, more = sanitize_ass(text)
        warnings += more
    return {"text": text, "format": kind, "encoding": encoding, "warnings": warnings, "sha": hashlib.sha256(raw).hexdigest(), "bytes": len(raw), "error": None}


READ = StructType(
    [StructField("text", StringType()), StructField("format", StringType()), StructField("encoding", StringType()), StructField("warnings", ArrayType(StringType())),
     StructField("sha", StringType()), StructField("bytes", LongType()), StructField("error", StringType())]
)


@F.pandas_udf(READ)
def read_column(contents: pd.Series) -> pd.DataFrame:
    """``read_captions`` of file contents; ``error`` is the reason where a file cannot be read. Null is unreadable."""
    rows, none = [], dict.fromkeys(READ.names)
    for raw in contents:
        try:
            rows.append(read_captions(bytes(raw)) if raw is not None else none | {"error": "unreadable"})
        except Unreadable as error:
            rows.append(none | {"error": error.reason, "sha": hashlib.sha256(bytes(raw)).hexdigest(), "bytes": len(raw)})
    return pd.DataFrame({c: pd.Series([r[c] for r in rows], dtype="Int64" if c == "bytes" else object) for c in READ.names})


@F.pandas_udf(BooleanType())
def is_utf8(contents: pd.Series) -> pd.Series:
    return contents.map(lambda raw: raw is not None and _decoded(bytes(raw), "utf-8") is not None)


def scan_files(spark, root: str, endings: tuple[str, ...]) -> DataFrame:
    """``relpath, file_size, file_mtime_ns, content`` of the files below a root with one of the endings, hidden twins left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^file:", "")
    path = F.regexp_replace(F.col("path"), "^file:/*", "/")
    named = found.select(F.substr(path, F.length(base) + 2).alias("relpath"), F.col("length").alias("file_size"), (F.unix_micros("modificationTime") * 1000).alias("file_mtime_ns"), "content")
    ends = "|".join(e.replace(".", r"\.") for e in endings)
    return named.filter(F.lower("relpath").rlike(f"(?:{ends})$") & ~F.col("relpath").rlike(r"(?:^|/)\._[^/]*$"))


def scan_roots(spark, roots: list[str], endings: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(files, doubles): of one relative path in several roots the first root's file counts; the others are doubles."""
    found = None
    for index, root in enumerate(roots):
        own = scan_files(spark, root, endings).withColumn("root", F.lit(root)).withColumn("root_rank", F.lit(index))
        found = own if found is None else found.unionByName(own)
    first = found.groupBy("relpath").agg(F.min("root_rank").alias("root_rank"))
    return found.join(first, ["relpath", "root_rank"], "left_semi"), found.join(first, ["relpath", "root_rank"], "left_anti").drop("content").withColumn("reason", F.lit("duplicate_path"))


def show_path(relpath):
    """The path of a caption file within its show: a file that lies in no folder gets one named like it."""
    from pyspark.sql.functions import pandas_udf

    from lineloom.functions.titles import clean_stem

    @pandas_udf(StringType())
    def run(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: p if p is None or "/" in p or "\\" in p else f"{clean_stem(p).strip(' ._') or p}/{p}")

    return run(relpath)
