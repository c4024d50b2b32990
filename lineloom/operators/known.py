"""Known words: rows by how many of their words are known, and rows whose one new word is the searched one."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .predicates import tokens

#: Most entries of a vocabulary, which goes to every worker.
MOST_ENTRIES = 200_000
_LETTER = "[ぁ-ヿ㐀-鿿\uf900-\ufaffA-Za-zＡ-Ｚａ-ｚ]"


def is_grammar(form: str, grammar: frozenset[str] = frozenset()) -> bool:
    """Whether a form is no vocabulary: without a letter, or a particle or auxiliary."""
    return not regex.search(_LETTER, form) or form in grammar


@dataclass(frozen=True)
class Vocabulary:
    """Known units: single forms, and phrases of several; ``grammar``: forms that are no vocabulary."""

    singles: frozenset[str]
    phrases: frozenset[tuple[str, ...]] = frozenset()
    grammar: frozenset[str] = frozenset()
    fingerprint: str = field(default="", compare=False)

    @staticmethod
    def of(units, grammar=()) -> Vocabulary:
        grammar = frozenset(grammar)
        kept = {tuple(u) for u in units if u and any(not is_grammar(x, grammar) for x in u)}
        if len(kept) > MOST_ENTRIES:
            raise ValueError(f"{len(kept)} units, more than {MOST_ENTRIES}")
        digest = hashlib.sha256(json.dumps(sorted(kept), ensure_ascii=False).encode()).hexdigest()[:16]
        return Vocabulary(frozenset(u[0] for u in kept if len(u) == 1), frozenset(u for u in kept if len(u) > 1), grammar, digest)

    def joined(self, other: Vocabulary) -> Vocabulary:
        """The union of two vocabularies."""
        units = [(s,) for s in self.singles | other.singles] + list(self.phrases | other.phrases)
        return Vocabulary.of(units, self.grammar | other.grammar)

    def knows(self, unit: tuple[str, ...]) -> bool:
        return unit[0] in self.singles if len(unit) == 1 else tuple(unit) in self.phrases

    def check(self, token: str) -> str:
        """The mode of a token ``mode:fingerprint``, if it was made for this vocabulary."""
        mode, _, mark = token.partition(":")
        if mark != self.fingerprint or mode not in ("first", "only"):
            raise ValueError("the vocabulary has changed since")
        return mode


def _uncovered(vocabulary: Vocabulary):
    """A function of tokens and unknown forms: the forms of which a place lies in no known phrase."""
    by_first: dict[str, list[tuple[str, ...]]] = {}
    for phrase in vocabulary.phrases:
        by_first.setdefault(phrase[0], []).append(phrase)

    def left(words: list[str], unknown: list[str]) -> list[str]:
        covered = set()
        for i, w in enumerate(words):
            for phrase in by_first.get(w, ()):
                if tuple(words[i : i + len(phrase)]) == phrase:
                    covered.update(range(i, i + len(phrase)))
        open_ones = {w for i, w in enumerate(words) if i not in covered}
        return [u for u in unknown if u in open_ones]

    @F.pandas_udf(ArrayType(StringType()))
    def run(words: pd.Series, unknown: pd.Series) -> pd.Series:
        return pd.Series([left(list(w), list(u)) if u is not None and len(u) else [] for w, u in zip(words, unknown, strict=True)])

    return run


def _forms(words: Column, grammar: frozenset[str], target: tuple[str, ...]) -> Column:
    """The distinct forms of a row that are vocabulary and not the single target."""
    out = F.filter(F.array_distinct(words), lambda x: x.rlike(_LETTER))
    drop = sorted(grammar) + (list(target) if len(target) == 1 else [])
    return F.array_except(out, F.array(*[F.lit(d) for d in drop])) if drop else out


def classify(rows: DataFrame, target: tuple[str, ...], vocabulary: Vocabulary, keys: tuple[str, ...] = ("media", "row_id")) -> DataFrame:
    """``rows`` with ``known, total, i1``: over the distinct forms of a row that are vocabulary.

    A target not known: ``i1`` where it stands in the row and all else is known; one known: where one other form is not.
    Forms covered by a known phrase wherever they stand count as known. The vocabulary is held to MOST_ENTRIES and joined by
    broadcast; rows are only moved to put their counts back.
    """
    spark = rows.sparkSession
    words = tokens("base_forms")
    kept = rows.withColumn("__words", words).withColumn("__forms", _forms(F.col("__words"), vocabulary.grammar, target))
    singles = spark.createDataFrame([(s,) for s in sorted(vocabulary.singles)], "form string").withColumn("__known", F.lit(True))
    each = kept.select(*keys, F.explode("__forms").alias("form")).join(F.broadcast(singles), "form", "left")
    unknown = each.filter("__known is null").groupBy(*keys).agg(F.collect_list("form").alias("__unknown"))
    out = kept.join(unknown, list(keys), "left").withColumn("__unknown", F.coalesce("__unknown", F.array().cast("array<string>")))
    if vocabulary.phrases:
        out = out.withColumn("__unknown", _uncovered(vocabulary)(F.col("__words"), F.col("__unknown")))
    if len(target) > 1:
        text = " " + " ".join(target) + " "
        found = F.contains(F.concat(F.lit(" "), F.array_join("__words", " "), F.lit(" ")), F.lit(text))
        inside = F.array(*[F.lit(t) for t in target])
        out = out.withColumn("__forms", F.when(found, F.array_except("__forms", inside)).otherwise(F.col("__forms")))
        out = out.withColumn("__unknown", F.when(found, F.array_except("__unknown", inside)).otherwise(F.col("__unknown")))
    else:
        found = F.array_contains("__words", target[0]) if target else F.lit(False)
    out = out.withColumn("__found", found.cast("int"))
    missing, total = F.size("__unknown"), F.size("__forms") + F.col("__found")
    if target and vocabulary.knows(target):
        known, i1 = total - missing, (F.col("__found") == 1) & (missing == 1)
    else:
        known, i1 = total - missing - F.col("__found"), (F.col("__found") == 1) & (missing == 0)
    return out.withColumn("known", known).withColumn("total", total).withColumn("i1", i1).drop("__words", "__forms", "__unknown", "__found")


def other_reading(target: str, typed: str, other_kana: tuple[str, ...]) -> Column:
    """The row has the target, written neither with its kanji nor as typed, but in kana of another of its readings."""
    text = F.coalesce(F.col("clean_text"), F.lit(""))
    kanji = [c for c in target if regex.match("[㐀-鿿\uf900-\ufaff々]", c)][:1]
    has = F.array_contains(tokens("base_forms"), target)
    written = text.contains(kanji[0]) if kanji else F.lit(False)
    others = F.lit(False)
    for kana in other_kana:
        others = others | text.contains(kana)
    return has & ~written & ~text.contains(typed) & others
