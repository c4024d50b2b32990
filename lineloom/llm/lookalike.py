"""Problem 4: one form for texts that look the same.

DuckDB runs inside the Arrow partitions, with two embedded SQL expressions. Both remove invisible characters, map width and
compatibility forms and kinds of space by ``translate``, compose by ``nfc_normalize`` and cut trailing space. The *look* of a
text then maps every look-alike letter to one: texts that look the same have one look, which is a key and no text to read. Its
*readable* form changes a look-alike only towards the script of its own word: among Latin letters to the Latin one, between
katakana to the katakana; 一人 stays, and so does a word wholly Cyrillic or Greek. What a reader sees as different stays
different: letter case, accents and voicing marks, small kana, raised, lowered and circled figures.

Of the readable forms of one look the most frequent in the corpus is the uniform text of all of them (``uniform_texts``).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lineloom.session import settle

from .garbled import is_garbled
from .markup import find_syntax
from .visible import INVISIBLE

# Letters that look like the letter before the colon.
LOOKALIKES = """
A:АΑᎪ B:ВΒᏴ C:СϹⅭᏟ D:ᎠⅮ E:ЕΕᎬ F:Ϝ G:Ԍ H:НΗ I:ІΙⅠ J:ЈᎫ K:КΚᏦK L:ᏞⅬ M:МΜⅯᎷ N:Ν O:ОΟ P:РΡᏢ Q:Ԛ R:Ꭱ S:ЅᏚ T:ТΤᎢ U:Ս V:ⅤᏙ W:ᏔԜ X:ХΧⅩ Y:ΥҮ Z:ΖᏃ
a:аα c:сϲⅽ d:ԁⅾ e:е g:ɡ h:һ i:іⅰ j:ј k:κ l:ӏⅼ m:ⅿ n:ո o:оοօ p:рρ q:ԛ r:г s:ѕ u:υս v:νѵⅴ w:ԝ x:хⅹ y:уүγ
ë:ё ï:ї Ë:Ё
ヘ:へ ベ:べ ペ:ぺ カ:力 タ:夕 ト:卜 エ:工 ロ:口 ハ:八 ニ:二 オ:才 ミ:彡 ム:厶 チ:千 メ:乄 リ:り 日:曰
ー:一─━―—
~:〜∼ ・:·‧•∙ -:−‒–‐‑⁃
"""  # fmt: skip


def _tables() -> tuple[str, str, str, str]:
    """The two translations, as (from, to) each: width and compatibility forms, then look-alike letters."""
    width: dict[str, str] = {}
    for code in (*range(0x2E80, 0x2FE0), *range(0xFE30, 0xFE70), *range(0xFF01, 0xFFF0), 0x2160, 0x2164, 0x2169, *range(0x216C, 0x2170)):
        plain = unicodedata.normalize("NFKC", chr(code))
        if len(plain) == 1 and plain != chr(code):
            width[chr(code)] = plain
    width |= {"ﾞ": "゙", "ﾟ": "゚", "゛": "゙", "゜": "゚"}
    for a, b in ((0x09, 0x0E), (0x85, 0x86), (0xA0, 0xA1), (0x1680, 0x1681), (0x2000, 0x200B), (0x2028, 0x202A), (0x202F, 0x2030), (0x205F, 0x2060), (0x3000, 0x3001)):
        width |= {chr(c): " " for c in range(a, b)}
    alike: dict[str, str] = {}
    for entry in LOOKALIKES.split():
        one, others = entry.split(":")
        alike |= {c: one for c in others}
    return "".join(width), "".join(width.values()), "".join(alike), "".join(alike.values())


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@lru_cache
def _touched() -> str:
    """A character class of all that the expressions may change; texts without any only lose trailing space.

    By rule: what is mapped, what shows nothing, and what composition changes or takes in.
    """
    width_from, _, alike_from, _ = _tables()
    codes = {ord(c) for c in width_from + alike_from + "…‥"}
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x32400), *range(0xE0000, 0xE1000)):
        char = chr(code)
        if unicodedata.category(char)[0] == "M" or unicodedata.normalize("NFC", char) != char or 0x1100 <= code < 0x1200:
            codes.add(code)
    ranges: list[list[int]] = []
    for code in sorted(codes):
        if ranges and code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + INVISIBLE + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + "]"


def _mapped(step: str, old: str, new: str) -> str:
    """``translate`` in parts, each only where the text holds a character of it: the map is made anew for every text."""
    common = [i for i, c in enumerate(old) if "\uff01" <= c <= "\uff20" or c == "\u3000"]
    letters = [i for i, c in enumerate(old) if "\uff21" <= c <= "\uff5e"]
    rest = [i for i in range(len(old)) if i not in set(common) | set(letters)]
    for part in (common, letters, rest):
        if part:
            a, b = "".join(old[i] for i in part), "".join(new[i] for i in part)
            held = "[" + "".join(rf"\x{{{ord(c):X}}}" for c in a) + "]"
            step = f"list_transform([{step}], lambda m: CASE WHEN regexp_matches(m, '{held}') THEN translate(m, {_quoted(a)}, {_quoted(b)}) ELSE m END)[1]"
    return step


def _if_touched(column: str, step: str) -> str:
    return f"CASE WHEN regexp_matches({column}, {_quoted(_touched())}) THEN {step} ELSE rtrim({column}) END"


def uniform_sql(column: str) -> str:
    """The SQL expression that brings ``column`` to its uniform form."""
    width_from, width_to, alike_from, alike_to = _tables()
    step = f"regexp_replace({column}, {_quoted('[' + INVISIBLE + ']')}, '', 'g')"
    step = _mapped(step, width_from, width_to)
    step = f"replace(replace({step}, '…', '...'), '‥', '..')"
    step = _mapped(f"nfc_normalize({step})", alike_from, alike_to)
    return _if_touched(column, f"rtrim(nfc_normalize({step}))")


# Letters of a word that may hold Latin look-alikes.
_LETTERS = "A-Za-z\u00c0-\u024f\u0370-\u03ff\u0400-\u052f\u0531-\u0587\u13a0-\u13f5\u2160-\u217f\u0300-\u036f"
_KATA = "".join(chr(c) for c in (*range(0x30A1, 0x30FB), 0x30FC))


def _script_tables() -> tuple[str, str, str, str]:
    """The look-alikes of Latin letters, and of katakana, as (from, to) each."""
    latin: dict[str, str] = {}
    kana: dict[str, str] = {}
    for entry in LOOKALIKES.split():
        one, others = entry.split(":")
        into = latin if one.isascii() and one.isalpha() or one in "ëïË" else kana if one in _KATA else None
        if into is not None:
            into |= {c: one for c in others}
    return "".join(latin), "".join(latin.values()), "".join(kana), "".join(kana.values())


def readable_sql(column: str) -> str:
    """The SQL expression for the readable form of ``column``."""
    width_from, width_to, *_ = _tables()
    latin_from, latin_to, kana_from, kana_to = _script_tables()
    step = f"regexp_replace({column}, {_quoted('[' + INVISIBLE + ']')}, '', 'g')"
    step = f"rtrim(nfc_normalize({_mapped(step, width_from, width_to)}))"
    words = f"regexp_extract_all(s, '[{_LETTERS}]+|[^{_LETTERS}]+')"
    latin = f"""CASE WHEN regexp_matches(s, '[A-Za-z]') AND regexp_matches(s, {_quoted('[' + latin_from + ']')}) THEN
      array_to_string(list_transform({words}, lambda x: CASE WHEN regexp_matches(x, '[A-Za-z]') THEN translate(x, {_quoted(latin_from)}, {_quoted(latin_to)}) ELSE x END), '') ELSE s END"""
    true_kata, any_kata = _quoted(_KATA), _quoted(_KATA + kana_from)
    # neighbours are looked at within runs of katakana and what looks like them, which are short however long the text is
    at = lambda i, held: f"(length(x[{i}:{i}]) > 0 AND contains({held}, x[{i}:{i}]))"
    between = f"(({at('i - 1', true_kata)} AND {at('i + 1', any_kata)}) OR ({at('i - 1', any_kata)} AND {at('i + 1', true_kata)}))"
    either = _KATA + kana_from
    mended = f"""array_to_string(list_transform(generate_series(1, length(x)), lambda i: CASE WHEN i > 1 AND contains({_quoted(kana_from)}, x[i:i]) AND {between}
        THEN translate(x[i:i], {_quoted(kana_from)}, {_quoted(kana_to)}) ELSE x[i:i] END), '')"""
    has_kata, has_alike = f"regexp_matches({{0}}, {_quoted('[' + _KATA + ']')})", f"regexp_matches({{0}}, {_quoted('[' + kana_from + ']')})"
    kana = f"""CASE WHEN {has_kata.format('s')} AND {has_alike.format('s')} THEN
      array_to_string(list_transform(regexp_extract_all(s, {_quoted(f'[{either}]+|[^{either}]+')}), lambda x: CASE WHEN {has_kata.format('x')} AND {has_alike.format('x')} THEN {mended} ELSE x END), '') ELSE s END"""
    # a list of one binds the text that a step goes on with
    step = f"list_transform([{step}], lambda s: {latin})[1]"
    return _if_touched(column, f"list_transform([{step}], lambda s: {kana})[1]")


def _with_sql(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with new text columns by SQL expressions of DuckDB over each Arrow batch."""
    clash = [new for new in columns if new in df.columns]
    if clash:
        raise ValueError(f"columns already there: {clash}")
    sql = "SELECT " + ", ".join(f"{expr} AS {_ident(new)}" for new, expr in columns.items()) + " FROM batch"
    schema = StructType(list(df.schema.fields))
    for new in columns:
        schema = schema.add(new, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "preserve_insertion_order": "true"})
        con.sql("SET TimeZone = 'UTC'")
        for held in batches:
            con.register("batch", pa.Table.from_batches([held]))
            out = con.sql(sql).to_arrow_table()
            con.unregister("batch")
            # the columns that DuckDB was not asked to change go on as they were
            arrays = [held.column(i) for i in range(held.num_columns)]
            arrays += [out.column(n).combine_chunks().cast(pa.string()) for n in columns]
            arrays = [a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays]
            yield pa.RecordBatch.from_arrays(arrays, names=[*held.schema.names, *columns])

    return df.mapInArrow(run, schema)


def with_uniform(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with the look of text columns; ``columns``: name of the new column by that of the text.

    Null stays null; an empty text, or one of invisible characters only, becomes empty; texts of any length are
    taken whole. A new name must not stand in ``df`` yet. Rows are neither merged nor dropped.
    """
    return _with_sql(df, {new: uniform_sql(_ident(text)) for text, new in columns.items()})


def with_readable(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with the readable form of text columns. Cases as in ``with_uniform``."""
    return _with_sql(df, {new: readable_sql(_ident(text)) for text, new in columns.items()})


def uniform_texts(df: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """``key`` and the uniform text of text columns: of the readable forms that look the same the most frequent, over all columns.

    Rows of one key count once. Null stays null. Forms are counted before they come together, and only looks with several
    forms are joined back. Ties go to the form that is first in order.
    """
    once = df.filter(F.col(key).isNotNull()).select(key, *columns).dropDuplicates([key])
    sql = {f"__look{i}": uniform_sql(_ident(c)) for i, c in enumerate(columns)} | {f"__form{i}": readable_sql(_ident(c)) for i, c in enumerate(columns)}
    rows = settle(_with_sql(once, sql).drop(*columns), "forms")
    pairs = None
    for i in range(len(columns)):
        own = rows.filter(f"__form{i} is not null").groupBy(F.xxhash64(f"__look{i}").alias("look"), F.col(f"__form{i}").alias("form")).agg(F.count("*").alias("n"))
        pairs = own if pairs is None else pairs.unionByName(own)
    counted = pairs.groupBy("look", "form").agg(F.sum("n").alias("n"))
    best = counted.groupBy("look").agg(F.count("*").alias("forms"), F.min(F.struct(-F.col("n"), "form"))["form"].alias("best")).filter("forms > 1").drop("forms")
    best = settle(best, "best")
    out = rows
    for i, new in enumerate(columns.values()):
        out = out.withColumn("look", F.xxhash64(f"__look{i}")).join(best.withColumnRenamed("best", f"__best{i}"), "look", "left").drop("look")
        out = out.withColumn(new, F.when(F.col(f"__form{i}").isNotNull(), F.coalesce(f"__best{i}", f"__form{i}")))
    return out.select(key, *columns.values())


def _ident(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def clear_rows(df: DataFrame, text: str) -> DataFrame:
    """``df`` without the rows whose text is garbled or holds formatting syntax."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            keep = [not is_garbled(t) and find_syntax(t, True) is None for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def same_looking_pairs(df: DataFrame, group: str, text: str, others: tuple[str, ...], leave_out: DataFrame | None = None, row_id: str = "row_id") -> DataFrame:
    """Pairs ``row_id_a < row_id_b`` of one ``group`` whose texts look the same while they, or ``others``, differ.

    Rows with one ``row_id`` count once; rows of ``leave_out`` (a column ``row_id``), garbled rows and rows with
    formatting syntax are left out. Null or empty texts, and rows of a null group, are in no pair; ``others`` that are
    null on one side only do not count as different. Every pair is given, as the cases are pairs; rows that agree in
    all texts are no pair and are never compared. An empty table gives no rows.
    """
    names = ["__id", "__group", "__text", *(f"__o{i}" for i in range(len(others)))]
    taken = df.select(row_id, group, text, *others).toDF(*names).filter("__id is not null and __group is not null and __text is not null")
    keyed = with_uniform(taken, {"__text": "__look"}).filter("__look <> ''")
    keyed = settle(keyed.withColumn("__key", F.xxhash64("__group", "__look")).withColumn("__form", F.xxhash64(*names[2:])), "looks")
    several = keyed.groupBy("__key").agg(F.min("__form").alias("a"), F.max("__form").alias("b")).filter("a <> b").select("__key")
    rows = clear_rows(keyed.join(several, "__key", "left_semi").dropDuplicates(["__id"]), "__text")
    if leave_out is not None:
        rows = rows.join(leave_out.select(F.col("row_id").alias("__id")), "__id", "left_anti")
    rows = settle(rows, "rows")
    # pairs of different forms first, each form once however many rows have it; then the rows of both
    texts = names[1:]
    forms = rows.groupBy("__key", "__form").agg(F.min(F.struct(*texts, "__look")).alias("t"))
    a, b = (forms.select("__key", F.col("__form").alias(f"form_{x}"), F.col("t").alias(f"t_{x}")) for x in "ab")
    differ = F.col("t_a.__text") != F.col("t_b.__text")
    for name in names[3:]:
        differ = differ | F.coalesce(F.col(f"t_a.{name}") != F.col(f"t_b.{name}"), F.lit(False))
    same = (F.col("t_a.__group") == F.col("t_b.__group")) & (F.col("t_a.__look") == F.col("t_b.__look"))
    pairs = a.join(b, "__key").filter((F.col("form_a") < F.col("form_b")) & same & differ).select("__key", "form_a", "form_b")
    ids = rows.select("__key", "__form", "__id")
    left = pairs.join(ids.select("__key", F.col("__form").alias("form_a"), F.col("__id").alias("x")), ["__key", "form_a"])
    both = left.join(ids.select("__key", F.col("__form").alias("form_b"), F.col("__id").alias("y")), ["__key", "form_b"])
    return both.select(F.least("x", "y").alias("row_id_a"), F.greatest("x", "y").alias("row_id_b"))
