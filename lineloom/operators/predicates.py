"""Predicates of a query over lines, as column expressions that stay in the JVM.

Lines have ``line``, ``clean_text`` and the token columns ``base_forms`` and ``readings``, whose tokens are set apart by
spaces. A phrase matches tokens that stand side by side in one of the two columns, never across them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineloom.functions.measure import BAR_RUBY
from lineloom.functions.reading import variants
from lineloom.plans.query import Near, Phrase, Plan, ReadingTerm, fold_for

TOKEN_COLUMNS = ("base_forms", "readings")
_SPACES = "[ \\t　]+"


def padded(column: str | Column) -> Column:
    """Tokens with one space before, between and after them; null has none."""
    col = F.col(column) if isinstance(column, str) else column
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), _SPACES, " ")), F.lit(" "))


def tokens(column: str) -> Column:
    """Tokens as an array, empty for null."""
    return F.filter(F.split(F.lower(F.coalesce(F.col(column), F.lit(""))), _SPACES), lambda x: x != "")


def phrase(words: tuple[str, ...], column: str | None = None) -> Column:
    """The words stand side by side in the column, or in either token column."""
    text = " " + " ".join(words).lower() + " "
    columns = (column,) if column else TOKEN_COLUMNS
    return reduce(lambda a, b: a | b, [padded(c).contains(text) for c in columns])


def near(words: tuple[str, ...], between: int, column: str | None = None) -> Column:
    """All words lie in a stretch of tokens with at most ``between`` tokens from its first to its last."""
    wanted = list(dict.fromkeys(w.lower() for w in words))
    columns = (column,) if column else TOKEN_COLUMNS

    def one(name: str) -> Column:
        found = tokens(name)
        inside = lambda i: reduce(lambda a, b: a & b, [F.array_contains(F.slice(found, i, between + 2), w) for w in wanted])
        begins = lambda i: F.element_at(found, i).isin(wanted)
        places = F.sequence(F.lit(1), F.size(found))
        cheap = reduce(lambda a, b: a & b, [padded(name).contains(f" {w} ") for w in wanted])
        return cheap & F.exists(F.when(F.size(found) > 0, places).otherwise(F.array().cast("array<int>")), lambda i: begins(i) & inside(i))

    return reduce(lambda a, b: a | b, [one(c) for c in columns])


def clause(ways: tuple[Phrase | Near, ...]) -> Column:
    return reduce(lambda a, b: a | b, [phrase(w.tokens, w.column) if isinstance(w, Phrase) else near(w.tokens, w.between) for w in ways])


def literal(text: str, column: str = "clean_text") -> Column:
    """The text stands in the column; = and ＝ are one."""
    col = F.coalesce(F.col(column), F.lit(""))
    return F.replace(col, F.lit("="), F.lit("＝")).contains(text.replace("=", "＝")) if "=" in text or "＝" in text else col.contains(text)


def like(text: str, column: str = "line") -> Column:
    """The text stands in the column, ASCII letters in either case."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.translate(F.coalesce(F.col(column), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").contains(text.translate(lower))


def by_media(make) -> Column:
    """An expression made for captions, or for other lines, by ``make(media)``."""
    subs, other = make("subs"), make("custom")
    return F.when(F.col("media") == "subs", subs).otherwise(other)


def excluded(plan: Plan) -> Column:
    """No excluded term stands in the text or the line, nor its tokens side by side among the base forms."""
    out = F.lit(True)
    for term, sequence in zip(plan.excluded, plan.sequences, strict=True):
        hit = by_media(lambda m, t=term.term: F.coalesce(F.col("clean_text"), F.lit("")).contains(fold_for(t, m)) | F.coalesce(F.col("line"), F.lit("")).contains(fold_for(t, m)))
        if sequence:
            hit = hit | phrase(sequence, "base_forms")
        out = out & ~hit
    return out


def bound_auxiliary(lemma: str, reading: str) -> Column:
    """A token with this lemma whose reading begins so, where the token columns align; else both anywhere."""
    bases, reads = tokens("base_forms"), tokens("readings")
    aligned = F.exists(F.arrays_zip(bases.alias("b"), reads.alias("r")), lambda x: (x["b"] == lemma) & x["r"].startswith(reading))
    apart = F.array_contains(bases, lemma) & F.exists(reads, lambda r: r.startswith(reading))
    return F.when(F.size(bases) == F.size(reads), aligned).otherwise(apart)


def groups_adjacent(groups: tuple[tuple[str, ...], ...], column: str = "base_forms") -> Column:
    """One of the groups stands side by side among the tokens."""
    return reduce(lambda a, b: a | b, [phrase(g, column) for g in groups], F.lit(False))


def shown_text() -> Column:
    """The text that a line shows: glosses after the paragraph separator left out."""
    return F.element_at(F.split(F.coalesce(F.col("clean_text"), F.lit("")), " "), 1)


def is_exact(plan: Plan) -> Column:
    """The query stands in the text as typed, or its readings in a row among the row's readings."""
    typed = by_media(lambda m: shown_text().contains(fold_for(plan.query, m)))
    joined = "".join(plan.readings)
    spoken = F.regexp_replace(F.coalesce(F.col("readings"), F.lit("")), _SPACES, "").contains(joined) if joined else F.lit(False)
    return typed | spoken


def reading_keys(term: ReadingTerm) -> tuple[str, ...]:
    """The forms of a term's stem that the readings of a matching row hold, a necessary condition."""
    return tuple(sorted(variants(term.stem)))


def reading_prefilter(term: ReadingTerm) -> Column:
    """A necessary condition for ``reads_as``: the stem in one of its forms among the readings, or ruby in the line."""
    joined = F.regexp_replace(F.coalesce(F.col("readings"), F.lit("")), _SPACES, "")
    return reduce(lambda a, b: a | b, [joined.contains(k) for k in reading_keys(term)], F.lit(False)) | F.coalesce(F.col("line").rlike(BAR_RUBY), F.lit(False))


def reads_as(term: ReadingTerm, ruby_only: bool = False) -> Column:
    """The word stands in the row with the wanted reading: by the author's ruby, or else by its token.

    Ruby over the word decides where there is any; ``ruby_only`` asks for it.
    """
    forms = sorted(variants(term.reading))
    line = F.coalesce(F.col("line"), F.lit(""))
    stem = term.word[: len(term.word) - len(term.tail)] if term.tail else term.word
    rubies = F.regexp_extract_all(line, F.lit(rf"｜{_quoted(stem)}\(([^()]*)\)"), 1)
    said = F.exists(F.transform(rubies, lambda r: F.regexp_replace(r, "[ 　]", "")), lambda r: r.isin(sorted(variants(term.stem)) + forms))
    if ruby_only:
        return said
    pairs = F.arrays_zip(tokens("base_forms").alias("b"), tokens("readings").alias("r"))
    token = F.exists(pairs, lambda x: (x["b"] == term.word.lower()) & (x["r"].isin(forms) | x["r"].isin(sorted(variants(term.stem)))))
    return F.when(F.size(rubies) > 0, said).otherwise(token)


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in text)


def works_with_ruby(lines: DataFrame) -> DataFrame:
    """``media, folder`` of the works that have any ruby: only there can a search for ruby alone find a row."""
    return lines.filter(F.col("line").rlike(BAR_RUBY)).select("media", "folder").distinct()


def candidates(plan: Plan) -> Column:
    """The rows that the index gives for a query, before they are verified."""
    out = F.lit(True)
    for ways in plan.clauses:
        out = out & clause(ways)
    if not plan.clauses:
        out = by_media(lambda m: like(fold_for(plan.query, m)))
    if plan.exact:
        out = out & by_media(lambda m: literal(fold_for(plan.query, m)))
    for term in plan.parsed.terms:
        out = out & F.coalesce(F.col("clean_text"), F.lit("")).contains(term.word[: len(term.word) - len(term.tail)] or term.word)
    for text in plan.parsed.literals:
        out = out & by_media(lambda m, t=text: literal(fold_for(t, m)))
    return out


def verified(plan: Plan, ruby_only: bool = False) -> Column:
    """The whole test of a row, cheap parts first."""
    out = candidates(plan) & excluded(plan)
    if plan.bound:
        out = out & bound_auxiliary(*plan.bound)
    several = any(len(g) > 1 for g in plan.groups)
    if not plan.exact and not plan.parsed.terms and " " not in plan.query and several:
        stands = by_media(lambda m: F.coalesce(F.col("line"), F.lit("")).contains(fold_for(plan.query, m)))
        out = out & (stands | groups_adjacent(plan.groups))
    for term in plan.parsed.terms:
        out = out & reading_prefilter(term) & reads_as(term, ruby_only)
    for term in plan.parsed.excluded_terms:
        out = out & ~reads_as(term, ruby_only)
    return out


def in_folder(folder: str, column: str = "file") -> Column:
    """The path lies in the folder."""
    return F.col(column).startswith(folder + "/") | F.col(column).startswith(folder + "\\")


def locate(texts: list[str], column: str = "clean_text") -> Column:
    """All texts stand in the column; a non-breaking space is a space."""
    col = F.translate(F.coalesce(F.col(column), F.lit("")), " ", " ")
    return reduce(lambda a, b: a & b, [col.contains(t.replace(" ", " ")) for t in texts], F.lit(True))
