"""Ruby: readings written over words, in bar notation, HTML and brackets, and the lexicon that they make."""

from __future__ import annotations

from functools import lru_cache

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .measure import BAR_RUBY
from .reading import is_kana, is_kanji, same_reading
from .script import KANJI_LITERAL, to_hiragana

_BAR = regex.compile(BAR_RUBY)
_READING = "[ぁ-ゖァ-ヺーゝゞヽヾ・]+"
_WRITTEN = regex.compile(rf"(?:｜([^｜()（）《》\n]+?)|([{KANJI_LITERAL}〆ヶ]+))(?:\(({_READING})\)|（({_READING})）|《({_READING})》)")


def written_ruby(line: str) -> tuple[str, list[tuple[int, int, str]], list[str]]:
    """(the line without readings, marks of (begin, end, reading), readings) of a text that writes a reading in brackets after its word."""
    out, marks, at, size = [], [], 0, 0
    for hit in _WRITTEN.finditer(line):
        base, reading = hit[1] or hit[2], hit[3] or hit[4] or hit[5]
        gap = line[at : hit.start()]
        marks.append((size + len(gap), size + len(gap) + len(base), reading))
        out += [gap, base]
        size += len(gap) + len(base)
        at = hit.end()
    return "".join([*out, line[at:]]), marks, [m[2] for m in marks]


def html_ruby(line: str) -> str:
    """HTML ruby as bar notation; marks without a reading, and readings without a word, are text."""

    def one(hit):
        inner = regex.sub(r"(?is)<rp\b[^>]*>.*?</rp\s*>", "", hit[1])
        out, last = [], 0
        for rt in regex.finditer(r"(?is)<rt\b[^>]*>(.*?)(?:</rt\s*>|$|(?=<rb\b))", inner):
            base, reading = _bare(inner[last : rt.start()]), _bare(rt[1])
            out.append(f"｜{base}({reading})" if base and reading else base or reading)
            last = rt.end()
        return "".join(out) + _bare(inner[last:])

    line = regex.sub(r"(?is)&lt;(/?\s*(?:ruby|rb|rt|rp)\b.*?)&gt;", r"<\1>", line)
    return regex.sub(r"(?is)<ruby\b[^>]*>(.*?)</ruby\s*>", one, line)


def _bare(text: str) -> str:
    return regex.sub(r"<[^>]*>", "", text).strip()


def lexicon(lines: DataFrame, line: str = "line") -> DataFrame:
    """``lines``' other columns with ``base, reading, alone`` of each ruby; alone: no kanji stands beside the word.

    In the JVM: the line is cut at its rubies, and what stands before and after each is looked at.
    """
    col = F.coalesce(F.col(line), F.lit(""))
    found = F.arrays_zip(F.regexp_extract_all(col, F.lit(BAR_RUBY), 1).alias("base"), F.regexp_extract_all(col, F.lit(BAR_RUBY), 2).alias("reading"))
    gaps = F.split(col, BAR_RUBY)
    rows = lines.filter(col.contains("｜")).select(*[c for c in lines.columns if c != line], found.alias("__f"), gaps.alias("__g"))
    kanji = f"[{KANJI_LITERAL}]"
    each = rows.select("*", F.posexplode("__f").alias("__k", "__r"))
    before, after = F.element_at("__g", F.col("__k") + 1), F.coalesce(F.try_element_at("__g", F.col("__k") + 2), F.lit(""))
    left = F.when(before != "", before.rlike(f"{kanji}$")).when(F.col("__k") > 0, F.try_element_at("__f", F.col("__k"))["base"].rlike(f"{kanji}$")).otherwise(F.lit(False))
    right = F.when(after != "", after.rlike(f"^{kanji}")).otherwise(F.coalesce(F.try_element_at("__f", F.col("__k") + 2)["base"].rlike(f"^{kanji}"), F.lit(False)))
    return each.select(*[c for c in lines.columns if c != line], F.col("__r.base").alias("base"), F.regexp_replace("__r.reading", "[ 　]", "").alias("reading"), (~(left | right)).alias("alone"))


def index_extras(line: Column | str, base_forms: Column | str, readings: Column | str) -> tuple[Column, Column]:
    """Token columns with the readings of a line's ruby of two characters or more added, and its kanji words that are no token."""
    line, base_forms, readings = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in (line, base_forms, readings))
    own = F.transform(F.regexp_extract_all(line, F.lit(BAR_RUBY), 2), lambda r: F.regexp_replace(r, "[ 　]", ""))
    long_ones = F.filter(own, lambda r: F.length(r) >= 2)
    from .script import hiragana

    bases = F.filter(F.array_distinct(F.regexp_extract_all(line, F.lit(BAR_RUBY), 1)), lambda b: b.rlike(f"^[{KANJI_LITERAL}]{{2,}}$"))
    new = F.array_except(bases, F.split(base_forms, "[ \\t　]+"))
    add = lambda col, more: F.when(F.size(more) > 0, F.concat_ws(" ", col, F.array_join(more, " "))).otherwise(col)
    return F.when(F.size(long_ones) > 0, add(add(base_forms, long_ones), new)).otherwise(base_forms), add(readings, F.transform(long_ones, lambda r: hiragana(r)))


def merge_single(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Ruby over single kanji that stand side by side, joined to one over the word."""
    out: list[tuple[int, int, str]] = []
    for begin, end, reading in sorted(spans):
        single = end - begin == 1 and is_kanji(text[begin])
        if out and single and out[-1][1] == begin and all(is_kanji(c) for c in text[out[-1][0] : begin]):
            out[-1] = (out[-1][0], end, out[-1][2] + reading)
        else:
            out.append((begin, end, reading))
    return out


def trimmed_base(base: str, reading: str, known: dict[str, set[str]]) -> int:
    """How many characters at the front of a run of kanji the reading does not cover: as few as leave a word known with it."""
    for cut in range(len(base)):
        if any(same_reading(to_hiragana(reading), r) for r in known.get(base[cut:], ())):
            return cut
    return 0


@lru_cache(maxsize=64)
def _fused(pairs: frozenset[tuple[str, str]]) -> dict[str, str]:
    forms: dict[str, set[str]] = {}
    for base, reading in pairs:
        if len(base) >= 2 and len(reading) >= 2 and all(map(is_kanji, base)) and all(map(is_kana, reading)):
            for form in (reading + base, base + reading):
                forms.setdefault(form, set()).add(f"｜{base}({reading})")
    return {form: ways.pop() for form, ways in forms.items() if len(ways) == 1}


def unfuse(text: str, pairs: frozenset[tuple[str, str]]) -> str:
    """Readings that a scan read into the text beside their words, as ruby; only where the form has one solution."""
    forms = _fused(pairs)
    if not forms:
        return text
    search = regex.compile("|".join(regex.escape(f) for f in sorted(forms, key=len, reverse=True)))
    out, last = [], 0
    for ruby in [*_BAR.finditer(text), None]:
        end = ruby.start() if ruby else len(text)
        out.append(search.sub(lambda m: forms[m[0]], text[last:end]))
        if ruby:
            out.append(ruby[0])
            last = ruby.end()
    return "".join(out)


def drawn(text: str, marks: list[tuple[int, int, str]]) -> str:
    """HTML of a text with its marks as ruby elements; overlapping marks after the first are left out."""
    import html

    out, at = [], 0
    for begin, end, reading in sorted(marks):
        if begin < at or end > len(text):
            continue
        out += [html.escape(text[at:begin]), f"<ruby>{html.escape(text[begin:end])}<rt>{html.escape(reading)}</rt></ruby>"]
        at = end
    return "".join([*out, html.escape(text[at:])])


def highlighted(line: str, words: list[str], tag: str = "b") -> str:
    """HTML of a line in bar notation: ruby drawn, and the words set off wherever they stand in the text without readings."""
    text, marks = "", []
    last = 0
    for hit in _BAR.finditer(line):
        text += line[last : hit.start()]
        marks.append((len(text), len(text) + len(hit[1]), hit[2]))
        text += hit[1]
        last = hit.end()
    text += line[last:]
    hits = sorted({m.span() for w in words if w for m in regex.finditer(regex.escape(w), text, overlapped=True)})
    joined: list[list[int]] = []
    for a, b in hits:
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    # a highlight that cuts a ruby takes it in whole
    for span in joined:
        for a, b, _ in marks:
            if a < span[1] and span[0] < b:
                span[0], span[1] = min(span[0], a), max(span[1], b)
    out, at = [], 0
    for a, b in joined:
        if b <= at:
            continue
        a = max(a, at)
        out.append(drawn(text[at:a], [(x - at, y - at, r) for x, y, r in marks if at <= x and y <= a]))
        out.append(f"<{tag}>" + drawn(text[a:b], [(x - a, y - a, r) for x, y, r in marks if a <= x and y <= b]) + f"</{tag}>")
        at = b
    return "".join([*out, drawn(text[at:], [(x - at, y - at, r) for x, y, r in marks if at <= x])])
