"""Readings: equality up to sound changes, and the parts of a reading that fall to the kanji of a word."""

from __future__ import annotations

import regex

from .script import KANJI_LITERAL, to_hiragana

# Kana and their voiced and half-voiced forms, kana that become っ, small kana and their full forms, rows of vowels.
VOICED = {a: b for a, *b in "かが きぎ くぐ けげ こご さざ しじ すず せぜ そぞ ただ ちぢ つづ てで とど はばぱ ひびぴ ふぶぷ へべぺ ほぼぽ うゔ".split()}
SOKUON = "つくちきいりふ"
SMALL = dict(zip("ぁぃぅぇぉっゃゅょゎ", "あいうえおつやゆよわ"))
ROWS = "あいうえお かきくけこ がぎぐげご さしすせそ ざじずぜぞ たちつてと だぢづでど なにぬねの はひふへほ ばびぶべぼ まみむめも らりるれろ".split()

_KANA = regex.compile("[ぁ-ゖァ-ヺー]")
_IDEOGRAPH = regex.compile(f"[{KANJI_LITERAL}]")


def is_kana(char: str) -> bool:
    return bool(_KANA.match(char))


def is_kanji(char: str) -> bool:
    return bool(_IDEOGRAPH.match(char))


def large(text: str) -> str:
    """Small kana as full ones."""
    return "".join(SMALL.get(c, c) for c in text)


def variants(reading: str, slang: bool = False) -> frozenset[str]:
    """The readings that count as ``reading``: first sound voiced, last one doubled, or (slang) in another vowel of its row."""
    reading = to_hiragana(reading)
    if not reading:
        return frozenset()
    firsts = [reading[0], *VOICED.get(reading[0], ())]
    lasts = [reading[-1]] + (["っ"] if reading[-1] in SOKUON else [])
    if slang:
        lasts += [c for row in ROWS if reading[-1] in row for c in row]
    if len(reading) == 1:
        return frozenset(firsts + lasts)
    return frozenset(a + reading[1:-1] + z for a in firsts for z in lasts)


def same_reading(found: str | None, wanted: str | None, slang: bool = False) -> bool:
    """Whether a reading found in a text is the wanted one up to sound changes and the size of kana. Null is no reading."""
    if not found or not wanted:
        return found == wanted
    found, wanted = to_hiragana(found), to_hiragana(wanted)
    return found in variants(wanted, slang) or large(found) in variants(large(wanted), slang)


def splits(base: str, reading: str, table: dict[str, set[str]], most: int = 256) -> list[tuple[str, ...]] | None:
    """Every way to give each character of a word a part of its reading; None if there are more than ``most``.

    ``table`` has the readings of each kanji; they count with their sound changes. Kana stand for themselves, and 々 for
    the kanji before it.
    """
    reading = to_hiragana(reading)
    ways: list[tuple[int, tuple[str, ...]]] = [(0, ())]
    for k, char in enumerate(base):
        if is_kana(char):
            options = {to_hiragana(char)}
        else:
            own = table.get(base[k - 1] if char == "々" and k else char, ())
            options = {v for r in own for v in variants(r)}
        ways = [(at + len(o), (*parts, o)) for at, parts in ways for o in options if reading.startswith(o, at)]
        if len(ways) > 64 * most:
            return None
    found = [parts for at, parts in ways if at == len(reading)]
    return None if len(found) > most else found


def part_reading(base: str, reading: str, begin: int, end: int, table: dict[str, set[str]]) -> str | None:
    """The reading of ``base[begin:end]`` within ``base``, if all splits agree on it; small kana are tried as full ones too."""
    found = splits(base, reading, table)
    if found == []:
        found = splits(base, large(to_hiragana(reading)), {k: {large(to_hiragana(r)) for r in v} for k, v in table.items()})
    parts = {"".join(p[begin:end]) for p in found or ()}
    return parts.pop() if len(parts) == 1 else None
