"""Character width, kana, scripts and the kind of a line, as column expressions that stay in the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

#: Ranges of kanji, in the notation of a character class.
KANJI = "一-鿿㐀-䶿\uf900-\ufaff" + r"\x{20000}-\x{323AF}々"
#: The same with the characters themselves.
KANJI_LITERAL = "一-鿿㐀-䶿\uf900-\ufaff\U00020000-\U000323af々"
# Characters that only Chinese lines hold.
CHINESE_MARKS = "們们这說说麼么吗嗎沒谁给哪呢吧啊你妳"


@lru_cache
def half_kana() -> tuple[dict[str, str], dict[str, str]]:
    """(pairs with a sound mark, single signs): half-width kana and their full forms, from the Unicode tables."""
    single = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0xFF66, 0xFF9E)} | {"ﾞ": "゛", "ﾟ": "゜"}
    pairs = {}
    for c in range(0xFF66, 0xFF9E):
        for mark in "ﾞﾟ":
            joined = unicodedata.normalize("NFKC", chr(c) + mark)
            if len(joined) == 1:
                pairs[chr(c) + mark] = joined
    return pairs, single


def full_kana(col: Column | str) -> Column:
    """Half-width katakana in full width; a sound mark joins its kana. Null stays null."""
    col = F.col(col) if isinstance(col, str) else col
    pairs, single = half_kana()
    joined = reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs.items(), col)
    return F.when(col.rlike("[ｦ-ﾟ]"), F.translate(joined, "".join(single), "".join(single.values()))).otherwise(col)


def hiragana(col: Column | str) -> Column:
    """Katakana as hiragana."""
    col = F.col(col) if isinstance(col, str) else col
    kata = "".join(chr(c) for c in range(0x30A1, 0x30F7))
    return F.translate(col, kata, "".join(chr(ord(c) - 0x60) for c in kata))


def to_hiragana(text: str) -> str:
    """Katakana of a Python string as hiragana."""
    return "".join(chr(ord(c) - 0x60) if "ァ" <= c <= "ヶ" else c for c in text)


@lru_cache
def _compatibility() -> tuple[str, str]:
    """CJK compatibility ideographs and the single character each composes to."""
    found = {}
    for code in (*range(0xF900, 0xFB00), *range(0x2F800, 0x2FA20)):
        plain = unicodedata.normalize("NFC", chr(code))
        if len(plain) == 1 and plain != chr(code):
            found[chr(code)] = plain
    return "".join(found), "".join(found.values())


def fold_compat(col: Column | str) -> Column:
    """Compatibility ideographs replaced by the ideograph they stand for."""
    col = F.col(col) if isinstance(col, str) else col
    old, new = _compatibility()
    return F.when(col.rlike("[\uf900-\ufaff\\x{2F800}-\\x{2FA1F}]"), F.translate(col, old, new)).otherwise(col)


@lru_cache
def _width() -> tuple[str, str]:
    found = {}
    for code in (0x3000, *range(0xFF01, 0xFF66), *range(0xFFE0, 0xFFE7)):
        plain = unicodedata.normalize("NFKC", chr(code))
        if len(plain) == 1:
            found[chr(code)] = plain
    return "".join(found), "".join(found.values())


def fold_title(col: Column | str) -> Column:
    """A title as titles are compared: one width, hiragana, lower case. Null becomes empty."""
    col = F.col(col) if isinstance(col, str) else col
    old, new = _width()
    return F.lower(hiragana(full_kana(F.translate(F.coalesce(col, F.lit("")), old, new))))


def caption_marks(col: Column | str) -> Column:
    """Question and exclamation marks in full width, as captions hold them."""
    col = F.col(col) if isinstance(col, str) else col
    return F.translate(col, "?!", "？！")


def script_of(col: Column | str) -> Column:
    """kanji, katakana, hiragana or romaji: the first of these that a text holds."""
    col = F.col(col) if isinstance(col, str) else col
    return (
        F.when(col.rlike(f"[{KANJI}]"), "kanji")
        .when(col.rlike("[ァ-ヺ]"), "katakana")
        .when(col.rlike("[ぁ-ゖ]"), "hiragana")
        .otherwise("romaji")
    )


READABLE = rf"[぀-ヿㇰ-ㇿｦ-ﾝ{KANJI}A-Za-zＡ-Ｚａ-ｚ]"


def has_readable(col: Column | str) -> Column:
    """Whether a text holds a kana, kanji or Latin letter; null holds none."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col.rlike(READABLE), F.lit(False))


def has_html_ruby(col: Column | str) -> Column:
    """Whether a text holds HTML ruby elements, plain or escaped."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col.rlike(r"(?i)(?:[<＜]|&lt;)\s*/?\s*(?:ruby|rb|rt|rp)\b"), F.lit(False))


def distinct_kanji(col: Column | str) -> Column:
    """The distinct kanji of a text in order, the kanji index of a row."""
    col = F.col(col) if isinstance(col, str) else col
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(f"([{KANJI}])"), 1)))


@lru_cache
def simplified_only() -> str:
    """The characters of GB 2312 that neither cp932 nor Big5 holds: only simplified Chinese writes them."""
    found = []
    for code in range(0x4E00, 0xA000):
        char = chr(code)
        if _held(char, "gb2312") and not _held(char, "cp932") and not _held(char, "big5"):
            found.append(char)
    return "".join(found)


def _held(char: str, codec: str) -> bool:
    try:
        return bool(char.encode(codec))
    except UnicodeEncodeError:
        return False


_KANA = "[ぁ-ゖァ-ヺー]"


def _chinese(text: Column) -> Column:
    """Whether a piece of text without kana is Chinese."""
    bare = F.regexp_replace(text, "[（(][^）)]*[）)]", "")
    body = F.when(F.trim(bare) == "", text).otherwise(bare)
    marked = body.rlike(f"[{CHINESE_MARKS}]")
    odd = body.rlike(f"[{simplified_only()}]") & (F.length(F.regexp_replace(body, "[^一-鿿]", "")) >= 3)
    return (F.trim(text) != "") & ~text.rlike(_KANA) & (marked | odd)


def line_kind(col: Column | str) -> Column:
    """ja, mix, zh, en or other. Null and empty lines are other.

    A line with kana is ``mix`` if one of its spaced pieces is Chinese, else ``ja``; without kana it is ``zh`` with
    five or more kanji and a Chinese mark or a simplified character, ``en`` without kanji and with three or more
    Latin words of two letters.
    """
    col = F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
    pieces = F.split(col, r"[\s　]+")
    kanji = F.length(F.regexp_replace(col, "[^一-鿿]", ""))
    zh = (kanji >= 5) & (col.rlike(f"[{CHINESE_MARKS}]") | col.rlike(f"[{simplified_only()}]"))
    words = F.size(F.regexp_extract_all(col, F.lit("([A-Za-z]{2,})"), 1))
    return (
        F.when(col.rlike(_KANA), F.when(F.exists(pieces, _chinese), "mix").otherwise("ja"))
        .when(zh, "zh")
        .when((kanji == 0) & (words >= 3), "en")
        .otherwise("other")
    )


def kind_of(line: str) -> str:
    """``line_kind`` for one Python string."""
    import regex

    if regex.search(_KANA, line):
        return "mix" if any(_chinese_piece(p) for p in regex.split(r"[\s　]+", line)) else "ja"
    kanji = regex.findall("[一-鿿]", line)
    odd = set(simplified_only())
    if len(kanji) >= 5 and (set(line) & set(CHINESE_MARKS) or odd & set(kanji)):
        return "zh"
    return "en" if not kanji and len(regex.findall("[A-Za-z]{2,}", line)) >= 3 else "other"


def _chinese_piece(text: str) -> bool:
    import regex

    if not text.strip() or regex.search(_KANA, text):
        return False
    bare = regex.sub("[（(][^）)]*[）)]", "", text).strip() or text
    return bool(set(bare) & set(CHINESE_MARKS)) or bool(set(bare) & set(simplified_only())) and len(regex.findall("[一-鿿]", bare)) >= 3


def reads_as_japanese(line: str | None) -> bool:
    """Whether the bytes of a line in a Western encoding are Japanese in UTF-8 or cp932."""
    if not line or not any("\x80" <= c <= "\xff" for c in line):
        return False
    for wrong in ("cp1252", "latin-1"):
        for right in ("utf-8", "cp932"):
            try:
                if kind_of(line.encode(wrong).decode(right)) == "ja":
                    return True
            except UnicodeError:
                continue
    return False


@F.pandas_udf(BooleanType())
def mojibake(lines: pd.Series) -> pd.Series:
    """``reads_as_japanese`` of each line; guard it with a cheap pattern for bytes above 127."""
    return lines.map(reads_as_japanese).astype(bool)


def unescape_references(col: Column | str) -> Column:
    """Numeric character references as characters; those of controls, surrogates or beyond Unicode stay."""
    col = F.col(col) if isinstance(col, str) else col
    return F.when(col.contains("&#"), _references(col)).otherwise(col)


@F.pandas_udf(StringType())
def _references(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else references(t))


def references(text: str) -> str:
    """``unescape_references`` for one Python string."""
    import regex

    def one(hit):
        code = int(hit[1]) if hit[1] else int(hit[2], 16)
        if code < 0x20 or 0xD800 <= code <= 0xDFFF or code > 0x10FFFF:
            return hit[0]
        return " " if code == 0xA0 else chr(code)

    return regex.sub(r"&#(?:([0-9]{1,7})|[xX]([0-9a-fA-F]{1,6}));", one, text)


def number_of(text: str | None) -> int | None:
    """The value of a numeral in ASCII, full-width or kanji digits; None where there is none."""
    if not text:
        return None
    text = unicodedata.normalize("NFKC", text)
    if text.isdecimal():
        return int(text)
    total, digit = 0, 0
    for char in text:
        if char in "十百":
            total += max(digit, 1) * (10 if char == "十" else 100)
            digit = 0
        elif char in "一二三四五六七八九":
            digit = "一二三四五六七八九".index(char) + 1
        else:
            return None
    return total + digit or None
