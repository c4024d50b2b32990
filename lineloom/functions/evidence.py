"""Readings of parts of a line, from the best evidence there is: ruby, the work's own ruby, tokens, the readings of kanji."""

from __future__ import annotations

import csv
from collections.abc import Iterable
from dataclasses import dataclass, field

import regex

from lineloom.plans.analyzers import Analyzer

from .measure import BAR_RUBY
from .reading import is_kanji, part_reading, same_reading
from .script import to_hiragana


@dataclass
class Evidence:
    """What is known of readings: ``own`` and ``corpus`` from ruby, ``dictionary``, and ``table`` of single kanji.

    Rank 0 is the work's own ruby, 1 the corpus, 2 the dictionary; ``rulings`` decide (base, reading) before all of them.
    """

    own: dict[tuple[str, str], set[str]] = field(default_factory=dict)
    corpus: dict[str, set[str]] = field(default_factory=dict)
    dictionary: dict[str, set[str]] = field(default_factory=dict)
    table: dict[str, set[str]] = field(default_factory=dict)
    rulings: dict[tuple[str, str], bool] = field(default_factory=dict)

    @staticmethod
    def of(rows: Iterable[tuple[str, str, str]], **more) -> Evidence:
        """From rows of a ruby lexicon: work, base, reading."""
        out = Evidence(**more)
        for work, base, reading in rows:
            out.own.setdefault((work, base), set()).add(to_hiragana(reading))
            out.corpus.setdefault(base, set()).add(to_hiragana(reading))
        return out

    def rank(self, work: str, base: str, reading: str) -> int | None:
        """0, 1 or 2 by the source that has the reading for the base, or None."""
        ruled = self.rulings.get((base, to_hiragana(reading)))
        if ruled is not None:
            return 0 if ruled else None
        for rank, known in enumerate((self.own.get((work, base)), self.corpus.get(base), self.dictionary.get(base))):
            if known and any(same_reading(to_hiragana(reading), r) for r in known):
                return rank
        return None

    def split_spaced(self, work: str, before: str, base: str, reading: str) -> str | None:
        """Which of two words, a space between, a reading over the second covers: "second", "both", or None where it is not known.

        The better rank decides; at equal ranks it stays with the second.
        """
        one, both = self.rank(work, base, reading), self.rank(work, before + base, reading)
        if one is None and both is None:
            return None
        return "second" if both is None or one is not None and one <= both else "both"


@dataclass(frozen=True)
class Analysis:
    """A line taken apart: ``text`` without readings, ``spans`` of ruby (begin, end, reading), ``tokens`` (begin, end, base, reading, pos)."""

    text: str
    spans: tuple[tuple[int, int, str], ...]
    tokens: tuple[tuple[int, int, str, str, str], ...]


def analyze_line(line: str | None, analyzer: Analyzer) -> Analysis:
    """The analysis of a line in bar notation; a null line is empty."""
    text, spans, at = "", [], 0
    for hit in regex.finditer(BAR_RUBY, line or ""):
        text += line[at : hit.start()]
        spans.append((len(text), len(text) + len(hit[1]), regex.sub("[ 　]", "", hit[2])))
        text += hit[1]
        at = hit.end()
    text += (line or "")[at:]
    tokens, at = [], 0
    for token in analyzer.tokens(text):
        at = text.find(token.surface, at)
        if at < 0:
            break
        tokens.append((at, at + len(token.surface), token.base, token.reading, token.pos))
        at += len(token.surface)
    return Analysis(text, tuple(spans), tuple(tokens))


def span_reading(line: Analysis, begin: int, end: int, evidence: Evidence, work: str = "") -> tuple[str, str] | None:
    """(reading, source) of ``line.text[begin:end]``; the source is ruby, split, work, token or table, or None where nothing tells.

    Author's ruby inside the span first, kana between standing for themselves; then the part of a ruby that reaches over it; then
    the one reading of the word in its own work; then whole tokens; then the readings of its kanji, if only one fits.
    """
    inside = [s for s in line.spans if begin <= s[0] and s[1] <= end]
    if inside:
        out, at = "", begin
        for a, b, reading in inside:
            gap = line.text[at:a]
            if any(map(is_kanji, gap)):
                out = None
                break
            out += to_hiragana(gap) + to_hiragana(reading)
            at = b
        if out is not None and not any(map(is_kanji, line.text[at:end])):
            return out + to_hiragana(line.text[at:end]), "ruby"
    for a, b, reading in line.spans:
        if a <= begin and end <= b:
            found = part_reading(line.text[a:b], reading, begin - a, end - a, evidence.table)
            return (found, "split") if found else None
    word = line.text[begin:end]
    own = evidence.own.get((work, word))
    if own and len(own) == 1:
        return next(iter(own)), "work"
    whole = [t for t in line.tokens if begin <= t[0] and t[1] <= end]
    if whole and whole[0][0] == begin and whole[-1][1] == end and all(x[1] == y[0] for x, y in zip(whole, whole[1:], strict=False)):
        return "".join(t[3] for t in whole), "token"
    readings = [evidence.table.get(c, set()) for c in word]
    if word and all(len(r) == 1 for r in readings):
        return "".join(next(iter(r)) for r in readings), "table"
    return None


def occurrences(line: Analysis, word: str, reading: str, evidence: Evidence, work: str = "", ruby_only: bool = False) -> list[tuple[int, int, bool, bool]]:
    """(begin, end, whether it is read so, whether that is guessed) of every place where a word stands in a line."""
    out = []
    for hit in regex.finditer(regex.escape(word), line.text, overlapped=True):
        found = span_reading(line, *hit.span(), evidence, work)
        guessed = found is not None and found[1] in ("token", "table", "split")
        ok = found is not None and same_reading(found[0], to_hiragana(reading)) and not (ruby_only and (guessed or found[1] == "work"))
        out.append((*hit.span(), ok, guessed))
    return out


def gloss_spans(text: str, accepted) -> list[tuple[int, int, str]]:
    """(begin, end, reading) of kanji followed by kana in brackets that ``accepted(base, reading)`` takes for its reading."""
    found = regex.finditer(r"(?<!｜)([一-鿿々]+)[（(]([ぁ-ゖァ-ヺー・ 　]+)[）)]", text)
    return [(m.start(1), m.end(1), m[2]) for m in found if accepted(m[1], m[2])]


def read_table(path: str, columns: int) -> list[tuple[str, ...]]:
    """The rows of a tab-separated table; comments are left out, and a row of another width is a fault that names its line."""
    out = []
    with open(path, encoding="utf-8", newline="") as handle:
        for number, row in enumerate(csv.reader(handle, delimiter="\t", quoting=csv.QUOTE_NONE), 1):
            if not row or row[0].startswith("#"):
                continue
            if len(row) != columns:
                raise ValueError(f"{path}:{number}: {len(row)} columns, not {columns}")
            out.append(tuple(row))
    return out
