"""Titles, numbers of episodes and order keys from the names of files."""

from __future__ import annotations

import posixpath
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .script import number_of, to_hiragana

_SEASON = r"(?i)(?:(?<![A-Za-z0-9])S(\d{1,2})(?:E\d|[\s_.-]|$)|(?<![A-Za-z])Season[\s_.-]*(\d{1,2})|第?([0-9一二三四五六七八九十]{1,3})(?:期|季|シリーズ)|シーズン\s*(\d{1,2})|(\d+)(?:st|nd|rd|th) Season)"
_EPISODE = r"(?i)(?:(?<![A-Za-z0-9])S\d{1,2}[\s._-]*EP?(\d{1,4})|(?<![A-Za-z0-9])EP?[\s._]*(\d{1,4})(?![A-Za-z0-9])|第\s*([0-9０-９一二三四五六七八九十百]{1,5})\s*[話回幕]|[#＃]\s*(\d{1,4})|\s-\s(\d{1,3})(?:\s|\.|$))"
_FILM = r"(?i)劇場版|映画(?![一-鿿々])|\[映\]|(?<![A-Za-z0-9])(?:Movie|Film)(?![A-Za-z0-9])"
_OVA = r"(?i)(?<![A-Za-z0-9])(?:OVA|OAD|OAV)s?(?![A-Za-z])"
_SPECIAL = r"(?i)(?<![A-Za-z0-9])(?:SP\d{0,3}(?![A-Za-z])|S00E\d)|スペシャル|特別[編篇]|番外編|特番|(?<![A-Za-z0-9])Specials?(?![A-Za-z])"
#: Ranks of the groups of a show after its seasons.
GROUP_RANKS = {"ova": 1001.0, "special": 1001.5, "film": 1002.0, "other": 1003.0}


def _after_show(file: str | Column) -> Column:
    col = F.col(file) if isinstance(file, str) else file
    return F.regexp_replace(col, r"^[^\\/]*[\\/]", "")


def numbered(file: str | Column) -> Column:
    """Whether the name holds the number of an episode."""
    return _after_show(file).rlike(_EPISODE)


def group_columns(df: DataFrame, file: str = "file") -> DataFrame:
    """``df`` with ``kind`` (season, ova, special, film, other), ``season`` and ``group_rank`` of each file."""
    name = _after_show(file)
    digits = F.coalesce(*[F.nullif(F.regexp_extract(name, _SEASON, k), F.lit("")) for k in range(1, 6)])
    kanji = F.create_map(*[F.lit(x) for k, v in {n: number_of(n) for n in (*"一二三四五六七八九十", *(f"十{c}" for c in "一二三四五六七八九"))}.items() for x in (k, v)])
    season = F.coalesce(F.expr("try_cast(__s as int)"), kanji[F.col("__s")])
    ok = (F.col("season") >= 1) & (F.col("season") <= 99)
    out = df.withColumn("__s", digits).withColumn("season", season)
    kind = F.when(name.rlike(_OVA), "ova").when(ok, "season").when(name.rlike(_FILM), "film").when(name.rlike(_SPECIAL), "special").otherwise("other")
    out = out.withColumn("kind", kind).withColumn("season", F.when(F.col("kind") == "season", F.col("season")))
    ranks = F.create_map(*[F.lit(x) for kv in GROUP_RANKS.items() for x in kv])
    return out.withColumn("group_rank", F.coalesce(F.col("season").cast("double"), ranks[F.col("kind")])).drop("__s")


def _stem(name: str) -> str:
    name = regex.sub(r"(?i)\.(?:srt|ass|ssa|epub|mokuro|txt|md)$", "", posixpath.basename(name.replace("\\", "/")))
    name = regex.sub(r"(?i)[._-](?:ja|jp|jpn|ja-jp|ja-en|zh|en|eng|chs|cht)(?:[._-](?:sdh|cc|hi|forced))?$", "", name)
    name = regex.sub(r"\s*[\[(（][0-9A-Fa-f]{8}[\])）]", "", name)
    rest = regex.sub(r"^\s*\[[^\]]*\]\s*", "", name)
    return rest or name


def clean_stem(name: str) -> str:
    """The name of a caption file without ending, language, checksum and leading group."""
    return _stem(name)


def episode_title(path: str) -> str:
    """The title shown for a caption file: show, season, episode, and what else its name says."""
    parts = path.replace("\\", "/").split("/")
    show, stem = parts[0], _stem(parts[-1])
    season = regex.search(_SEASON, stem)
    episode = regex.search(_EPISODE, stem)
    out = [_stem(show) if len(parts) > 1 else regex.split(_EPISODE, stem)[0].strip(" ._-") or stem]
    if season and (number := number_of(next(g for g in season.groups() if g))):
        out.append(f"{number}期")
    if episode and (number := number_of(next(g for g in episode.groups() if g))) is not None:
        out.append(f"{number}話")
        tail = regex.sub(r"[\[(（][^\])）]*[\])）]", "", stem[episode.end() :]).strip(" ._-「」")
        if tail:
            out.append(tail)
    elif len(parts) > 1 and stem != out[0]:
        out.append(stem.replace(".", " ").replace("_", " ").strip())
    return " ".join(out)


def book_title(file: str, author: str | None = None) -> str:
    """The title shown for a chapter: book and chapter with a bar between, author in brackets."""
    book, _, chapter = file.replace("/", "\\").rpartition("\\")
    chapter = regex.sub(r"^\d+\.", "", chapter)
    book = book or chapter
    shown = f"{book}（{author}）" if author else book
    return shown if book == chapter else f"{shown}｜{chapter}"


def volume_title(file: str) -> str:
    """The title shown for a volume of scanned pages."""
    return "｜".join(p for p in regex.split(r"[\\/]", regex.sub(r"(?i)\.mokuro$", "", file)) if p)


def text_title(file: str) -> str:
    """The title shown for a text file: its name without ending."""
    return posixpath.splitext(posixpath.basename(file.replace("\\", "/")))[0]


# What brackets in titles of books hold that is no part of the title, and roles after a name.
_EDITION = regex.compile(r"(?i)文庫|新書|ブックス|books|ノベル|novel|comic|出版|書房|書店|選書|叢書|シリーズ|レーベル|限定|特典|電子|無料|合本|試し読み|版$|付$")
_VOLUME = regex.compile(r"(?i)^(?:上|中|下|前|後|[前中後][編篇]|[上中下]巻|第?[0-9０-９一二三四五六七八九十百]+(?:巻|話|部|編|篇|章|回|冊|集|幕)?|(?:vol|volume|part)\.?\s*[0-9０-９IVX]+)$")
_ROLE = regex.compile(r"(?:[(（](?:編|編集|著|訳|監修|原作|イラスト|漫画)[)）]|[・\s]+(?:編|著|訳|監修)$)")


def clean_title(title: str | None) -> str:
    """The title of a book without the brackets of series and edition; the number of the volume stays. Null is empty."""
    if not title:
        return ""
    text = regex.sub("[​-‍⁠﻿]", "", title).strip()
    whole = regex.fullmatch(r"[\[［]([^\[\]［］]+)[\]］]", text)
    text = whole[1].strip() if whole else text

    def one(hit):
        inner = hit[2].strip()
        if _VOLUME.match(inner):
            return f" {inner} "
        sentence = hit.start() > 0 and regex.match("[のにをがはとでやもへ]", text[hit.end() :])
        return hit[0] if sentence and not _EDITION.search(inner) else ""

    text = regex.sub(r"([(（\[［【〔])([^(（\[［【〔)）\]］】〕]*)[)）\]］】〕]", one, text)
    text = regex.sub(r"[〈《]([^〉》]*)[〉》]", lambda m: "" if _EDITION.search(m[1]) else m[0], text)
    text = regex.sub(r"\s+-\s*$|\s*[:：]\s*$", "", text.replace("_", " ").replace("/", "／"))
    return close_spacing(text)


def close_spacing(text: str) -> str:
    """Spaces between single characters of Japanese taken out; other runs of spaces are one space."""
    parts = regex.split(r"[ \t　]+", text.strip())
    out: list[str] = []
    single = regex.compile(r"[一-鿿぀-ヿ々0-9０-９]")
    joined = False
    for part in parts:
        one = bool(single.fullmatch(part))
        if one and joined and not regex.fullmatch(r"第[一二三四五六七八九十百0-9０-９]+[部章巻節話篇]", out[-1]):
            out[-1] += part
        else:
            out.append(part)
        joined = one
    return " ".join(out).strip()


def title_and_author(path: str, title: str | None, author: str | None) -> tuple[str, str]:
    """(title, author) of a book from its metadata, and from its file's name ``[author] title`` or ``author - title`` where they lack."""
    name = regex.sub(r"(?i)\.epub$", "", posixpath.basename(path.replace("\\", "/")))
    hit = regex.match(r"\[([^\]]*)\]\s*(\S.*)$", name) or regex.match(r"(.+?)\s+-\s+(.+)$", name)
    named_author, named_title = (hit[1].strip(), hit[2].strip()) if hit else ("", name)
    if title and regex.search(r"(?i)^\d{4,}_|draft|titlepage|\*{3,}", title):
        title = None
    who = "" if not author or author.lower() == "unknown" else author
    who = who or ("" if _EDITION.search(named_author) else named_author)
    return clean_title(title) or clean_title(named_title), close_spacing(_ROLE.sub("", who).strip() or who)


def distinct_titles(df: DataFrame, title: str = "title", author: str = "author", key: str = "relpath") -> DataFrame:
    """``df`` with ``shown``: the title made unique by author, then folder, then a number in order of ``key``."""
    from pyspark.sql import Window

    again = lambda c: F.count("*").over(Window.partitionBy(c))
    out = df.withColumn("shown", F.col(title)).withColumn("__n", again("shown"))
    who = F.concat(F.col(title), F.lit("（"), F.col(author), F.lit("）"))
    out = out.withColumn("shown", F.when((F.col("__n") > 1) & (F.coalesce(F.col(author), F.lit("")) != ""), who).otherwise(F.col("shown"))).withColumn("__n", again("shown"))
    folder = F.regexp_extract(F.regexp_replace(F.col(key), r"\\", "/"), r"([^/]+)/[^/]+$", 1)
    out = out.withColumn("shown", F.when((F.col("__n") > 1) & (folder != ""), F.concat("shown", F.lit("（"), folder, F.lit("）"))).otherwise(F.col("shown")))
    place = F.row_number().over(Window.partitionBy("shown").orderBy(key))
    return out.withColumn("__n", place).withColumn("shown", F.when(F.col("__n") > 1, F.concat("shown", F.lit("（"), F.col("__n").cast("string"), F.lit("）"))).otherwise(F.col("shown"))).drop("__n")


def collation_bytes(text: str | None) -> bytes:
    """The order of titles: kana folded, as bytes of the Japanese encoding; characters it lacks come last by code point."""
    out = b""
    for char in to_hiragana(unicodedata.normalize("NFKC", text or "")):
        try:
            out += char.encode("cp932")
        except UnicodeEncodeError:
            out += b"\xff" + char.encode("utf-32-be", "surrogatepass")
    return out


@F.pandas_udf(StringType())
def collation_key(texts: pd.Series) -> pd.Series:
    """``collation_bytes`` in hexadecimal, which orders alike."""
    return texts.map(lambda t: collation_bytes(t).hex())


def natural_order(text: str) -> str:
    """A key under which numbers in names order by value: their length stands before their digits."""
    out = []
    for piece in regex.split(r"([0-9]+)", text):
        out.append(f"1{len(str(int(piece))):08d}{int(piece)}" if piece.isdigit() else "0" + collation_bytes(piece).hex())
    return "/".join(out)


@F.pandas_udf(StringType())
def natural_key(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else natural_order(t))


# Names of services in the names of caption files.
SERVICES = {"Netflix": "netflix nf", "Amazon": "amazon amzn primevideo", "Hulu": "hulu", "Disney+": "disney+ dsnp", "AppleTV": "appletv atvp", "TVer": "tver", "Bandai": "bandai"}
FIRST_SERVICES = ("Netflix", "Amazon")


def release_hints(name: str) -> tuple[str | None, bool, bool]:
    """(service, made by a machine, captions for the deaf) as the tags of a file's name say."""
    base = posixpath.basename(name.replace("\\", "/"))
    tags = {t.lower() for t in regex.findall(r"[A-Za-z0-9+]+", " ".join(regex.findall(r"\[[^\]]*\]|[._\-][A-Za-z0-9+]+", base)))}
    service = next((s for s, words in SERVICES.items() if tags & set(words.split())), None)
    machine = bool(regex.search(r"(?i)(?<!\w)(?:ocr|asr|whisper)(?!\w)", base))
    caption = bool(regex.search(r"(?i)(?<!\w)(?:cc|sdh)(?!\w)|\[字\]", base))
    return service, machine, caption
