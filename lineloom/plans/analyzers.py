"""Analyzers: text to tokens of surface, base form, reading and part of speech."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple, Protocol

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lineloom.functions.script import to_hiragana

#: Bytes of UTF-8 that one call of an analyzer takes.
PIECE_BYTES = 49_149
#: Parts of speech that are grammar, and those that are signs.
PARTICLES, SIGNS = frozenset({"助詞", "助動詞"}), frozenset({"補助記号", "記号", "空白"})


class Token(NamedTuple):
    surface: str
    base: str
    reading: str
    pos: str


class Analyzer(Protocol):
    name: str

    def tokens(self, text: str) -> list[Token]: ...


def text_pieces(text: str, most: int = PIECE_BYTES) -> list[str]:
    """A text in pieces of at most ``most`` bytes of UTF-8, none of which parts a character."""
    out, begin, size = [], 0, 0
    for at, char in enumerate(text):
        n = len(char.encode("utf-8", "surrogatepass"))
        if size + n > most:
            out.append(text[begin:at])
            begin, size = at, 0
        size += n
    return [*out, text[begin:]]


class SimpleAnalyzer:
    """Lower-case runs of letters and digits; base and reading are the token itself."""

    name = "simple"
    _WORD = regex.compile(r"[\p{L}\p{M}\p{N}_]+")

    def tokens(self, text: str) -> list[Token]:
        return [Token(m[0], m[0].lower(), m[0].lower(), "word") for m in self._WORD.finditer(text)]

    @staticmethod
    def column(text: Column) -> Column:
        """The base forms as an array, in the JVM."""
        return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([\p{L}\p{M}\p{N}_]+)"), 1), F.lower)


class SpacedAnalyzer:
    """Tokens set apart by spaces, as the columns of base forms hold them."""

    name = "spaced"

    def tokens(self, text: str) -> list[Token]:
        return [Token(w, w, to_hiragana(w), "word") for w in regex.split(r"[ \t　]+", text) if w]


class LexiconAnalyzer:
    """The longest match in a lexicon of (surface, base, reading, pos); what it lacks is taken character by character."""

    name = "lexicon"

    def __init__(self, entries: Iterable[tuple[str, str, str, str]]):
        self.entries: dict[str, Token] = {}
        for surface, base, reading, pos in entries:
            self.entries.setdefault(surface, Token(surface, base, to_hiragana(reading), pos))
        self.longest = max(map(len, self.entries), default=1)

    def tokens(self, text: str) -> list[Token]:
        out, at = [], 0
        while at < len(text):
            size = next((n for n in range(min(self.longest, len(text) - at), 0, -1) if text[at : at + n] in self.entries), 1)
            piece = text[at : at + size]
            out.append(self.entries.get(piece) or Token(piece, piece, piece, "空白" if piece.isspace() else "記号" if not regex.match(r"[\p{L}\p{N}]", piece) else "名詞"))
            at += size
        return out


def sudachi(dictionary: str = "core"):
    """The morphological analyzer, where its package is installed; never replaced by another silently."""
    try:
        from sudachipy import Dictionary, SplitMode
    except ImportError as error:
        raise RuntimeError("sudachipy is not installed; choose another analyzer") from error
    tagger = Dictionary(dict=dictionary).create(SplitMode.A)

    class Sudachi:
        name = f"sudachi-{dictionary}"

        def tokens(self, text: str) -> list[Token]:
            found = [m for piece in text_pieces(text) for m in tagger.tokenize(piece)]
            return [Token(m.surface(), m.normalized_form(), to_hiragana(m.reading_form()) or m.surface(), m.part_of_speech()[0]) for m in found]

    return Sudachi()


TOKENS = ArrayType(StructType([StructField(n, StringType()) for n in Token._fields]))


def analyze_column(text: Column, analyzer: Analyzer) -> Column:
    """The tokens of a text column, whole Arrow batches at a time. Null gives no tokens."""

    @F.pandas_udf(TOKENS)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [x._asdict() for x in analyzer.tokens(t)] if t else [])

    return run(text)
