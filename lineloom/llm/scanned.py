"""Problem 2: repairing text read from scanned pages.

1. Page edges: edge rows that are numbers are read in spite of misread digits and kept as page numbers where they continue the
   numbering of the volume, by vote of all its pages. The first rows of pages are compared, fuzzily as misread, with the title,
   with chapter headings, and with the heads that stand on many pages of the volume.
2. The corpus vocabulary: words and runs of katakana of the running text are counted over all volumes.
3. A mark at a row's end is taken off where the joined word is in the vocabulary rather than the compound.
4. A word is misread where exchanges of signs often mistaken for each other give a word many times as frequent: words with the
   same key, under which such signs are one, are compared. A sign that stands for one of another script is judged by the scripts
   beside it. For kanji the exchanges are learned: a kanji most of whose places, by the kanji beside it or by both neighbours, are
   places of one other kanji that is many times as frequent there and everywhere, was misread for it.
5. ``paragraphs`` joins what remains and puts right what was misread.

Volumes of any length are spread: positions and the rows before are running values, and the running text is read in blocks that
overlap by some rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import groupby

import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineloom.operators.running import positions, running
from lineloom.session import settle

from .visible import words_only

#: Rows of running text that are read together, and rows before and after them read as context.
BLOCK_ROWS, CONTEXT_ROWS = 4096, 8
#: How many times as frequent as a word, sign or kanji its correction must be; the least places and share of them that tell of a kanji.
WORD_RATIO, SIGN_RATIO, KANJI_RATIO, KANJI_PLACES, KANJI_SHARE = 8, 6, 8, 3, 0.6
#: Paragraphs that are joined together.
PARAGRAPHS = 128
#: Pages in a bucket of the order of rows: the page stands above the row number.
_PAGE, _BUCKET = 40, 1 << 46

MARKS = "-‐‑¬­"
# Latin letters as misread, and what they were.
LATIN_SLIPS = (("0", "o"), ("1", "l"), ("1", "i"), ("|", "l"), ("|", "i"), ("c", "e"), ("rn", "m"), ("m", "rn"), ("li", "h"), ("cl", "d"), ("vv", "w"), ("5", "s"), ("l", "i"), ("8", "b"))
# Signs of another script as misread, and the kana they were.
KANA_SLIPS = dict(zip("力夕卜八口工二一三千才厶", "カタトハロエニーミチオム")) | {"─": "ー", "―": "ー"}
# Kana mistaken for each other.
KANA_PAIRS = ("ソン", "ンソ", "ツシ", "シツ", "ッシ", "ヌス", "スヌ", "ワク", "クワ", "ラテ", "コユ", "ユコ", "ウワ", "ワウ")

_NUMBER = regex.compile(r"(?i)^[^\w|]*(?:p(?:age)?\.?\s*)?([0-9lio|sbz]{1,5}|[〇一二三四五六七八九十百]{1,5})\s*頁?[^\w|]*$")
_ENDED = regex.compile(r"[。！？…!?.」』”\"]\s*$")
_CHAPTER = regex.compile(r"(?i)^\W*(?:第\s*[〇一二三四五六七八九十百0-9lio|]{1,4}\s*[章話回部節巻]|(?:chapter|part|book)\s+[0-9lioxv|]+\b)")
_JA = regex.compile(r"[ぁ-ヿ一-鿿]")
_WORD = regex.compile(r"[A-Za-z0-9|']+(?:-[A-Za-z0-9|']+)*")
_RUN = regex.compile(rf"[ァ-ヺー{''.join(KANA_SLIPS)}]{{2,}}")
_KATA = regex.compile(r"[ァ-ヺ]")
_DIGITS = str.maketrans("lIi|OoSsBbZz", "111100558822")
_SHAPES = str.maketrans("01|5", "olls")


def _value(text: str) -> int | None:
    """The number a row shows, misread digits taken for what they were."""
    if text.isascii():
        plain = text.translate(_DIGITS)
        return int(plain) if plain.isdigit() else None
    if "十" in text or "百" in text:
        total, digit = 0, 0
        for c in text:
            if c in "十百":
                total, digit = total + max(digit, 1) * (10 if c == "十" else 100), 0
            else:
                digit = "〇一二三四五六七八九".index(c)
        return total + digit
    return int("".join(str("〇一二三四五六七八九".index(c)) for c in text))


def page_number(line: str) -> int | None:
    """The page number that a row could be, or None."""
    text = unicodedata.normalize("NFKC", line).strip()
    hit = _NUMBER.match(text)
    if not hit or (_ENDED.search(line) and not regex.match(r"[-‐–—―\[(・|]", text)):
        return None
    if not any(c.isdigit() or c in "lI|Oo〇一二三四五六七八九十百" for c in hit[1]):
        return None
    return _value(hit[1])


def _shape(text: str) -> str:
    return words_only(text).translate(_SHAPES).replace("rn", "m").replace("cl", "d").replace("li", "h").replace("i", "l").replace("c", "e")


def _similar(a: str, b: str, least: float = 0.75) -> bool:
    if a == b:
        return True
    if not a or not b or min(len(a), len(b)) < 2 or 2 * min(len(a), len(b)) < least * (len(a) + len(b)):
        return False
    return SequenceMatcher(None, a, b, autojunk=False).ratio() >= least


_TAIL = regex.compile(r"(?i)[\s　]+[\W_]*(?:p\.?\s*)?(?:[0-9lio|]{1,5}|[〇一二三四五六七八九十百]{1,5})\s*頁?[\W_]*$|^[\W_]*(?:p\.?\s*)?[0-9lio|]{1,5}\s*頁?[\W_]*[\s　]+")


def rows_indented(line: str) -> bool:
    return line.startswith(("　", "  "))


def _class(char: str) -> str:
    if not char:
        return "_"
    o = ord(char)
    return "h" if 0x3041 <= o <= 0x309F else "k" if 0x30A1 <= o <= 0x30FC else "c" if 0x4E00 <= o <= 0x9FFF else "d" if char.isdigit() else "l" if char.isalpha() else "p"




# ---------------------------------------------------------------- page edges


def _edge_facts(rows: DataFrame) -> DataFrame:
    """Rows at the edges of pages with what they look like: ``value`` of a page number, ``shape``, and whether they have ended,
    name a chapter, are like the title, are indented."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row, volume, page, top, bottom, line, title in frame[["row_id", "volume", "page", "top", "bottom", "line", "title"]].itertuples(index=False):
                line = line if isinstance(line, str) else ""
                text = unicodedata.normalize("NFKC", line).strip()
                shape = _shape(_TAIL.sub("", text) or text)
                name = _shape(title) if isinstance(title, str) else ""
                ended = bool(_ENDED.search(text))
                chapter = bool(_CHAPTER.match(text)) and len(text) <= 40 and not ended
                like = bool(name) and _similar(shape, name)
                out.append((row, volume, page, top, bottom, page_number(line), shape, ended, chapter, like, like and len(text) <= 40 and not ended, rows_indented(line)))
            columns = ["row_id", "volume", "page", "top", "bottom", "value", "shape", "ended", "chapter", "like", "like_short", "indented"]
            yield pd.DataFrame(out, columns=columns).astype({"value": "Int64"})

    schema = "row_id long, volume string, page int, top long, bottom long, value long, shape string, ended boolean, chapter boolean, like boolean, like_short boolean, indented boolean"
    return rows.filter("top <= 3 or bottom < 2").mapInPandas(run, schema)


def _near_heads(tops: DataFrame) -> DataFrame:
    """``volume, shape, near``: on how many other pages of its volume a head of this shape, or of one like it, stands again and again.

    Shapes are compared only where they share two letters in a row, as all that are so alike do.
    """
    shapes = tops.filter(F.length("shape") >= 3).groupBy("volume", "shape").agg(F.count("*").alias("n"))
    grams = lambda df: df.withColumn("gram", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("shape") - 1), lambda i: F.substr(F.col("shape"), i, F.lit(2))))))
    often = grams(shapes.filter("n > 1")).select("volume", "gram", F.col("shape").alias("head"), F.col("n").alias("times"))
    fits = (F.length("shape") + F.length("head")) * 0.8 <= 2 * F.least(F.length("shape"), F.length("head"))
    pairs = grams(shapes).join(often, ["volume", "gram"]).filter(fits).select("volume", "shape", "n", "head", "times").distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[[_similar(a, b, 0.8) for a, b in zip(frame["shape"], frame["head"], strict=True)]]

    alike = pairs.mapInPandas(run, pairs.schema)
    return alike.groupBy("volume", "shape", "n").agg(F.sum("times").alias("near")).select("volume", "shape", (F.col("near") - (F.col("n") > 1).cast("int")).alias("near"))


def page_edges(rows: DataFrame) -> DataFrame:
    """``row_id, noise`` of running heads and page numbers; ``rows``: row_id, volume, page, line, title, each row once."""
    placed = positions(rows, ["volume", "page"], "row_id", "top")
    size = rows.groupBy("volume", "page").agg(F.count("*").alias("size"))
    both = placed.withColumn("__v", F.coalesce("volume", F.lit(""))).join(size.withColumn("__v", F.coalesce("volume", F.lit(""))).select("__v", "page", "size"), ["__v", "page"])
    edges = settle(_edge_facts(both.withColumn("bottom", F.col("size") - F.col("top"))).withColumn("v", F.coalesce("volume", F.lit(""))), "edges")
    found = edges.filter("value is not null and (top <= 2 or bottom < 2)").withColumn("off", F.col("value") - F.col("page"))
    votes = found.groupBy("v", "off").agg(F.count("*").alias("n"), F.min("page").alias("first"))
    best = votes.groupBy("v").agg(F.max_by("off", F.struct("n", -F.col("first"))).alias("off"), F.max("n").alias("support"), F.sum("n").alias("total"))
    numbers = found.join(best, ["v", "off"]).filter("support > 1 or total = 1").groupBy("v", "page").agg(F.min(F.struct("top", "row_id")).alias("r")).select("r.row_id")
    numbers = settle(numbers, "numbers")
    free = edges.filter("top <= 3").join(numbers, "row_id", "left_anti")
    tops = free.filter("top + bottom > 1").groupBy("v", "page").agg(F.min(F.struct("top", "row_id", "shape", "ended", "chapter", "like", "indented")).alias("r")).select("v", "page", "r.*")
    near = _near_heads(tops.select(F.col("v").alias("volume"), "shape")).withColumnRenamed("volume", "v")
    pages = rows.select(F.coalesce("volume", F.lit("")).alias("v"), "page").distinct().groupBy("v").agg(F.count("*").alias("pages"))
    judged = tops.join(near, ["v", "shape"], "left").join(pages, "v")
    again = ~F.col("ended") & ~F.col("indented") & (F.coalesce("near", F.lit(0)) >= F.greatest(F.lit(2.0), 0.1 * F.col("pages")))
    heads = settle(judged.filter(F.col("like") | F.col("chapter") | again).select("v", "page", "top", "row_id"), "heads")
    # title and chapter, one below the other
    under = free.filter("chapter or like_short").join(heads.select("v", "page", (F.col("top") + 1).alias("top")), ["v", "page", "top"], "left_semi")
    marked = heads.select("row_id").union(under.select("row_id")).distinct().select("row_id", F.lit("running_head").alias("noise"))
    return marked.union(numbers.select("row_id", F.lit("page_number").alias("noise")))


# ---------------------------------------------------------------- the running text


_CONTEXT_SIGNS = set(KANA_SLIPS) | set(KANA_SLIPS.values()) - {"ー"}
_KANJI = regex.compile("[一-鿿々]")

_SCHEMA = "rec string, row_id long, row_id2 long, a string, b string, c string, n int"


def _read_block(frame: pd.DataFrame) -> Iterator[tuple]:
    """Records of one block: word, split (a left, b right, c mark), run (n: signs in the first row), sign and kanji (a, b, c:
    before, itself, after)."""
    frame = frame.sort_values("at")
    own = dict(zip(frame["row_id"].tolist(), frame["own"].tolist(), strict=True))
    text = list(zip(frame["row_id"].tolist(), frame["line"].tolist(), strict=True))
    # words in Latin letters, and words broken at the end of a row
    skip_first = False
    for at, (key, line) in enumerate(text):
        if _JA.search(line):
            skip_first = False
            continue
        found = [m for m in _WORD.finditer(line)]
        bare = line.rstrip()
        following = text[at + 1] if at + 1 < len(text) else None
        broken = bool(found) and len(bare) > 1 and bare[-1] in MARKS and found[-1].end() >= len(bare) - 1 and following and not _JA.search(following[1])
        first = _WORD.match(following[1].lstrip()) if broken else None
        words = [m.group().lower().strip("'") for m in found]
        if skip_first and words:
            words = words[1:]
        if first:
            if own[key]:
                yield ("split", key, following[0], words[-1] if words else found[-1].group().lower(), first.group().lower().strip("'"), bare[-1], None)
            words = words[:-1]
        skip_first = bool(first)
        if own[key]:
            for w in words:
                if any(c.isalpha() for c in w):
                    yield ("word", key, None, w, None, None, None)
    # Japanese text runs on from row to row; an indented row begins a paragraph
    flow, where = [], []
    for key, line in text:
        if not _JA.search(line) and flow and not _JA.search("".join(flow[-3:])):
            continue
        body = line.strip()
        if rows_indented(line):
            flow.append("\n")
            where.append(key)
        flow += list(body)
        where += [key] * len(body)
    whole = "".join(flow)
    if not _JA.search(whole):
        return
    for hit in _RUN.finditer(whole):
        if not _KATA.search(hit.group()) or not own[where[hit.start()]]:
            continue
        rows = where[hit.start() : hit.end()]
        inside = rows.count(rows[0])
        yield ("run", rows[0], rows[inside] if inside < len(rows) else None, hit.group(), None, None, inside)
    for i, char in enumerate(whole):
        if own[where[i]]:
            before, after = whole[i - 1] if i else "", whole[i + 1] if i + 1 < len(whole) else ""
            if char in _CONTEXT_SIGNS:
                yield ("sign", where[i], None, _class(before), char, _class(after), None)
            elif _KANJI.match(char):
                yield ("kanji", where[i], None, before, char, after, None)


def read_text(text: DataFrame) -> DataFrame:
    """Records of the running text of all volumes; ``text``: row_id, volume, line, at (position in the volume)."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(list(_read_block(frame)), columns=["rec", "row_id", "row_id2", "a", "b", "c", "n"])
        return out.astype({"row_id": "Int64", "row_id2": "Int64", "n": "Int32"})

    block, inside = F.floor(F.col("at") / BLOCK_ROWS), F.pmod("at", F.lit(BLOCK_ROWS))
    copies = [F.struct(block.alias("block"), F.lit(True).alias("own"))]
    copies += [F.when(inside < CONTEXT_ROWS, F.struct((block - 1).alias("block"), F.lit(False).alias("own")))]
    copies += [F.when(inside >= BLOCK_ROWS - CONTEXT_ROWS, F.struct((block + 1).alias("block"), F.lit(False).alias("own")))]
    spread = text.withColumn("c", F.explode(F.filter(F.array(*copies), lambda x: x.isNotNull()))).select("row_id", "volume", "line", "at", "c.block", "c.own")
    return spread.groupBy("volume", "block").applyInPandas(run, _SCHEMA)


# ---------------------------------------------------------------- words


_ONE_KANA: dict[str, str] = {}
for _pair in [*KANA_SLIPS.items(), *KANA_PAIRS]:
    _old, _new = _pair
    _left, _right = _ONE_KANA.get(_old, _old), _ONE_KANA.get(_new, _new)
    _ONE_KANA = {k: _right if v == _left else v for k, v in (_ONE_KANA | {_old: _left, _new: _right}).items()}


#: Letters by the letters that they, and what they are mistaken for, have in common.
_ONE_LETTER = str.maketrans({"0": "o", "1": "l", "|": "l", "i": "l", "c": "e", "5": "s", "8": "b", "m": "rn", "h": "ll", "d": "el", "w": "vv"})


def word_key(word: str) -> str:
    """A word with all signs that may be mistaken for each other as one: a word and its correction have one key."""
    if word.isascii():
        return word.translate(_ONE_LETTER)
    return "".join(_ONE_KANA.get(c, c) for c in word)


def exchanges(word: str, new: str) -> tuple[int, int] | None:
    """(fewest exchanges, place of the first) by which a word becomes ``new``, each sign as misread to what it was; None if by none."""
    if word.isascii():
        slips = LATIN_SLIPS
    else:
        slips = (*KANA_SLIPS.items(), *KANA_PAIRS)
    front: dict[int, dict[int, tuple[int, int]]] = {0: {0: (0, len(word))}}
    for i in range(len(word)):
        for j, (n, first) in front.pop(i, {}).items():
            steps = [(1, 1, 0)] if new[j : j + 1] == word[i] else []
            steps += [(len(a), len(b), 1) for a, b in slips if word.startswith(a, i) and new.startswith(b, j)]
            for da, db, cost in steps:
                state = (n + cost, min(first, i) if cost else first)
                here = front.setdefault(i + da, {})
                if j + db not in here or state < here[j + db]:
                    here[j + db] = state
    found = front.get(len(word), {}).get(len(new))
    return found if found and found[0] else None


def _keyed(words: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(key=[word_key(w) for w in frame["word"]])

    return words.mapInPandas(run, "word string, times long, key string")


def wrong_words(counted: DataFrame, joined: DataFrame) -> DataFrame:
    """``word, new, at, new_times``: words, and ``joined`` ones, with the most frequent correction that is frequent enough."""
    asked = counted.unionByName(joined.join(counted.select("word"), "word", "left_anti").withColumn("times", F.lit(0).cast("long")))
    keyed = settle(_keyed(asked), "keys")
    # only keys with a word that is frequent enough can give a correction
    top = keyed.groupBy("key").agg(F.max("times").alias("top")).filter("top >= 3")
    rare = keyed.join(top, "key").filter(F.col("top") >= WORD_RATIO * F.col("times"))
    known = keyed.filter("times >= 3").select("key", F.col("word").alias("new"), F.col("times").alias("new_times"))
    pairs = rare.join(known, "key").filter((F.col("word") != F.col("new")) & (F.col("new_times") >= WORD_RATIO * F.col("times"))).select("word", "new", "new_times")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for word, new, times in frame[["word", "new", "new_times"]].itertuples(index=False):
                found = exchanges(word, new)
                # letters alone are mistaken once; signs that are no letters, and kana, as often as they stand
                if found and (found[0] == 1 or not word.isascii() or any(c in "01|58" for c in word)):
                    out.append((word, new, found[1], times))
            yield pd.DataFrame(out, columns=["word", "new", "at", "new_times"]).astype({"at": "int32"})

    checked = pairs.mapInPandas(run, "word string, new string, at int, new_times long")
    best = F.max(F.struct("new_times", "new", "at")).alias("b")
    return checked.groupBy("word").agg(best).select("word", F.col("b.new").alias("new"), F.col("b.at").alias("at"), F.col("b.new_times").alias("new_times"))


# ---------------------------------------------------------------- signs


def wrong_signs(signs: DataFrame) -> DataFrame:
    """``a, b, c, d``: signs that between these scripts are much rarer than the one they look like."""
    counts = settle(signs.groupBy("a", "b", "c").agg(F.count("*").alias("times")), "signs")  # a few hundred rows at any size
    pairs = [(k, v) for k, v in KANA_SLIPS.items() if k not in "─―"] + [(v, k) for k, v in KANA_SLIPS.items() if v != "ー"] + [("─", "ー"), ("―", "ー")]
    looks = signs.sparkSession.createDataFrame(pairs, "b string, d string")
    other = counts.select("a", F.col("b").alias("d"), "c", F.col("times").alias("d_times"))
    runs = counts.join(F.broadcast(looks), "b").join(F.broadcast(other), ["a", "d", "c"]).filter((F.col("d_times") >= 5) & (F.col("d_times") >= SIGN_RATIO * F.col("times")))
    return runs.groupBy("a", "b", "c").agg(F.max_by("d", F.struct("d_times", "d")).alias("d"))


def wrong_kanji(kanji: DataFrame) -> DataFrame:
    """``a, b, c, d``: places (before, kanji, after) of kanji misread for another, learned from the corpus alone.

    A place is explained by a kanji d that is KANJI_RATIO times as frequent as b beside the same kanji, or between the same two
    signs, and everywhere. b was misread for d if d explains KANJI_PLACES of its places or more, and KANJI_SHARE of all.
    What is compared are counts of signs in context, whose number the writing bounds, not the corpus.
    """
    counts = settle(kanji.groupBy("a", "b", "c").agg(F.count("*").alias("n")), "kanji")
    every = settle(counts.groupBy("b").agg(F.sum("n").alias("all")), "each")
    hit = lambda c: F.col(c).rlike("^[一-鿿々]$")
    sides = [(counts.filter(hit("a")), ["a"]), (counts.filter(hit("c")), ["c"]), (counts, ["a", "c"])]
    found = None
    for part, keys in sides:
        near = part.groupBy("b", *keys).agg(F.sum("n").alias("n"))
        top = near.groupBy(*keys).agg(F.max("n").alias("top"))
        few = near.join(top, keys).filter(F.col("top") >= F.greatest(F.lit(5), KANJI_RATIO * F.col("n"))).drop("top")
        many = near.filter("n >= 5").select(*keys, F.col("b").alias("d"), F.col("n").alias("m"))
        pairs = few.join(many, keys).filter(F.col("m") >= KANJI_RATIO * F.col("n")).select("b", "d", *keys)
        places = part.join(pairs, ["b", *keys]).select("a", "b", "c", "d", "n")
        found = places if found is None else found.unionByName(places)
    found = settle(found.distinct(), "places")
    told = found.groupBy("b", "d").agg(F.sum("n").alias("told"))
    told = told.join(every, "b").join(every.select(F.col("b").alias("d"), F.col("all").alias("d_all")), "d")
    ok = told.filter((F.col("told") >= KANJI_PLACES) & (F.col("told") >= KANJI_SHARE * F.col("all")) & (F.col("d_all") >= KANJI_RATIO * F.col("all")))
    best = ok.groupBy("b").agg(F.max_by("d", F.struct("told", "d_all", "d")).alias("d"))
    return found.join(best, ["b", "d"]).select("a", "b", "c", "d").distinct()


# ---------------------------------------------------------------- all of it


class Reading:
    """What was found in the pages: ``edges``, ``text`` with positions, ``records``, and the corrections."""

    def __init__(self, rows: DataFrame):
        base = rows.select(
            F.col("row_id").cast("long").alias("row_id"), F.col("volume").cast("string").alias("volume"), F.coalesce(F.col("page").cast("int"), F.lit(0)).alias("page"),
            F.col("line").cast("string").alias("line"), F.col("title").cast("string").alias("title"),
        ).filter("row_id is not null")
        base = settle(base.dropDuplicates(["row_id"]), "rows")
        self.edges = settle(page_edges(base), "edges")
        key = F.shiftleft(F.col("page").cast("long"), _PAGE).bitwiseOR(F.col("row_id").bitwiseAND(F.lit((1 << _PAGE) - 1)))
        text = base.join(self.edges.select("row_id"), "row_id", "left_anti").filter("trim(coalesce(line, '')) <> ''").withColumn("key", key)
        self.text = settle(positions(text.drop("title"), ["volume"], "key", "at", _BUCKET), "text")
        self.records = settle(read_text(self.text), "records")
        self.split = self.records.filter("rec = 'split'")
        counted = self.records.filter("rec in ('word', 'run')").groupBy(F.col("a").alias("word")).agg(F.count("*").alias("times"))
        self.counted = settle(counted, "words")
        self.wrong = settle(wrong_words(self.counted, self.split.select(F.concat("a", "b").alias("word")).union(self.split.select(F.concat_ws("-", "a", "b"))).distinct()), "wrong")
        self.judged = settle(self._splits(), "splits")
        self.signs = settle(wrong_signs(self.records.filter("rec = 'sign'")), "wrong-signs")
        self.kanji = settle(wrong_kanji(self.records.filter("rec = 'kanji'")), "wrong-kanji")

    def _splits(self) -> DataFrame:
        """The broken words, with ``is_split``: whether the mark at the break does not belong to the word."""
        parts = self.split.select("row_id", "row_id2", F.col("a").alias("left"), F.col("b").alias("right"), F.col("c").alias("mark"))
        roles = {"word": F.concat("left", "right"), "compound": F.concat_ws("-", "left", "right"), "left": F.col("left"), "right": F.col("right")}
        asked = parts.select("row_id", F.explode(F.map_from_arrays(F.array(*[F.lit(r) for r in roles]), F.array(*roles.values()))).alias("role", "word"))
        known = asked.join(self.counted, "word", "left").join(self.wrong.select("word", "new_times", "at"), "word", "left")
        sums = known.groupBy("row_id").agg(
            *[F.coalesce(F.max(F.when(F.col("role") == r, F.col("times"))), F.lit(0)).alias(f"{r}_times") for r in roles],
            *[F.coalesce(F.max(F.when(F.col("role") == r, F.col("new_times"))), F.lit(0)).alias(f"{r}_fixed") for r in ("word", "compound")],
            F.max(F.when(F.col("role") == "word", F.col("at"))).alias("at"),
        )
        judged = parts.join(sums, "row_id")
        as_word, as_compound = F.greatest("word_times", "word_fixed"), F.greatest("compound_times", "compound_fixed")
        both = (F.col("left_times") >= 3) & (F.col("right_times") >= 3)
        told = F.when((as_word > 0) | (as_compound > 0), as_word >= as_compound).when(F.col("mark").isin("-", "‐", "‑"), ~both).otherwise(True)
        return judged.withColumn("is_split", told)

    def misread(self) -> DataFrame:
        """``row_id`` of rows with a wrongly recognised sign."""
        records, wrong = self.records, self.wrong
        by_word = records.filter("rec = 'word'").select("row_id", F.col("a").alias("word")).join(wrong, "word", "left_semi").select("row_id")
        by_run = records.filter("rec = 'run'").select("row_id", "row_id2", "n", F.col("a").alias("word")).join(wrong.select("word", "at"), "word")
        by_run = by_run.select(F.when(F.col("row_id2").isNotNull() & (F.col("at") >= F.col("n")), F.col("row_id2")).otherwise(F.col("row_id")).alias("row_id"))
        by_split = self.judged.filter("is_split and word_fixed > 0").select(F.when(F.col("at") >= F.length("left"), F.col("row_id2")).otherwise(F.col("row_id")).alias("row_id"))
        # compounds broken at their own mark are judged by their halves
        halves = self.judged.filter("not is_split")
        by_half = halves.select("row_id", F.col("left").alias("word")).union(halves.select("row_id2", "right")).join(wrong, "word", "left_semi").select("row_id")
        by_sign = records.filter("rec = 'sign'").join(F.broadcast(self.signs), ["a", "b", "c"], "left_semi").select("row_id")
        by_kanji = records.filter("rec = 'kanji'").join(self.kanji, ["a", "b", "c"], "left_semi").select("row_id")
        return by_word.union(by_run).union(by_split).union(by_half).union(by_sign).union(by_kanji).distinct()

    def noise(self) -> DataFrame:
        """``row_id, noise`` of every noisy row."""
        splits = self.judged.filter("is_split").select("row_id").distinct().select("row_id", F.lit("split_word").alias("noise"))
        return self.edges.union(splits).union(self.misread().select("row_id", F.lit("misread").alias("noise")))

    def fixes(self) -> DataFrame:
        """``row_id, fixes``: what is to be put right in the text to which a row belongs: (before, old, after, new); for words, and
        runs of katakana, before and after are null."""
        named = lambda df, old: df.select("row_id", F.lit(None).cast("string").alias("before"), F.col(old).alias("old"), F.lit(None).cast("string").alias("after"), "new")
        wrong = self.wrong.select("word", "new")
        words = named(self.records.filter("rec in ('word', 'run')").select("row_id", F.col("a").alias("word")).join(wrong, "word"), "word")
        joined = self.judged.select("row_id", F.when(F.col("is_split"), F.concat("left", "right")).otherwise(F.concat_ws("-", "left", "right")).alias("word"))
        parts = named(joined.join(wrong, "word"), "word")
        places = lambda rec, table: self.records.filter(f"rec = '{rec}'").join(table, ["a", "b", "c"]).select("row_id", F.col("a").alias("before"), F.col("b").alias("old"), F.col("c").alias("after"), F.col("d").alias("new"))
        found = words.union(parts).union(places("kanji", self.kanji)).union(places("sign", F.broadcast(self.signs)))
        return found.groupBy("row_id").agg(F.collect_set(F.struct("before", "old", "after", "new")).alias("fixes"))


def find_noise(rows: DataFrame) -> DataFrame:
    """``row_id, noise`` of every noisy row: running_head, page_number, split_word, misread.

    ``rows`` has row_id, volume, page, line, title. Rows with one ``row_id`` count once; a null line is text without
    words, a null page is page 0, a null volume one of its own, a null title unknown. Empty tables give no rows;
    other columns are not read. Volumes and rows of any length are read whole.
    """
    return Reading(rows).noise()


def volume_rows(manga: DataFrame, pages: DataFrame, sources: DataFrame) -> DataFrame:
    """The rows that ``find_noise`` reads, from the tables of this project."""
    order = Window.partitionBy("source_id").orderBy(F.desc("format_version"), F.desc("file_mtime_ns"))
    titles = sources.filter("media = 'manga'").withColumn("__n", F.row_number().over(order)).filter("__n = 1").select("source_id", "title")
    rows = manga.select("row_id", "source_id", F.col("file").alias("volume"), "line").dropDuplicates(["row_id"])
    return rows.join(pages.select("row_id", "page").dropDuplicates(["row_id"]), "row_id", "left").join(titles, "source_id", "left")



def put_right(text: str, fixes: list[tuple]) -> str:
    """A text with its misread words, runs, signs and kanji replaced; case is kept."""
    words = {f[1]: f[3] for f in fixes if f[0] is None}
    places = {(f[0], f[1], f[2]): f[3] for f in fixes if f[0] is not None}

    def word(hit):
        old = hit.group()
        new = words.get(old.lower().strip("'"))
        if new is None:
            return old
        new = old[: len(old) - len(old.lstrip("'"))] + new + old[len(old.rstrip("'")) :]
        return new.upper() if len(old) > 1 and old.isupper() else new[:1].upper() + new[1:] if old[:1].isupper() else new

    if words:
        text = _RUN.sub(lambda m: words.get(m.group(), m.group()), _WORD.sub(word, text))
    if not places:
        return text
    out = list(text)
    for i, char in enumerate(text):
        before, after = text[i - 1] if i else "", text[i + 1] if i + 1 < len(text) else ""
        new = places.get((before, char, after)) or places.get((_class(before), char, _class(after)))
        if new:
            out[i] = new
    return "".join(out)


def paragraphs(rows: DataFrame) -> DataFrame:
    """``volume, paragraph, first_row, page, text``: the running text of each volume as paragraphs, in page order.

    Heads and page numbers are left out, broken words joined, misread signs put right. An indented row begins a paragraph; in
    volumes without indents one ends with a row that ends a sentence well short of the volume's longest row. ``paragraph``
    counts from 0 in the volume. Cases as in ``find_noise``.
    """
    found = Reading(rows)
    split = found.judged.filter("is_split").select("row_id", F.lit(True).alias("split")).distinct()
    text = found.text.withColumn("indented", F.col("line").startswith("　") | F.col("line").startswith("  "))
    ended = F.rtrim("line").rlike("[。！？…!?.」』”\"]$")
    facts = text.groupBy(F.coalesce("volume", F.lit("")).alias("v")).agg(F.max(F.length("line")).alias("longest"), F.max("indented").alias("indents"))
    marked = text.withColumn("v", F.coalesce("volume", F.lit(""))).join(facts, "v")
    marked = settle(marked.withColumn("ends", F.when(ended & (F.length("line") < 0.8 * F.col("longest")), "e").otherwise("n")), "marks")
    seen = running(marked, ["volume"], "key", lasts={"before": F.col("ends")}, inclusive=False, bucket=_BUCKET)
    begins = F.when(F.col("indents"), F.col("indented")).otherwise(F.coalesce(F.col("before") == "e", F.lit(False)))
    seen = settle(seen.withColumn("begins", F.when(begins & (F.col("at") > 1), 1).otherwise(0)), "begins")
    numbered = running(seen, ["volume"], "key", sums={"paragraph": F.col("begins")}, bucket=_BUCKET)
    rows = numbered.join(split, "row_id", "left").join(found.fixes(), "row_id", "left")

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        done = []
        frame = frame.sort_values("at")
        columns = [frame[c].tolist() for c in ("paragraph", "row_id", "page", "line", "split", "fixes")]
        for number, own in groupby(zip(*columns, strict=True), key=lambda r: r[0]):
            parts, fixes, glue, first = [], [], False, None
            for _, row, page, line, broken, fix in own:
                first = first or (row, page)
                body = line.strip()
                if broken is True:
                    body = body.rstrip(MARKS)
                if parts and not glue and not _JA.search(body[:1] + parts[-1][-1:]):
                    parts.append(" ")
                parts.append(body)
                glue = broken is True or body.endswith("-")
                if fix is not None and not isinstance(fix, float):
                    fixes += [(f["before"], f["old"], f["after"], f["new"]) for f in fix]
            done.append((frame["volume"].iloc[0], number, *first, put_right("".join(parts).strip(), fixes)))
        return pd.DataFrame(done, columns=["volume", "paragraph", "first_row", "page", "text"])

    # some paragraphs at a time: a group costs more than a paragraph
    rows = rows.withColumn("some", F.floor(F.col("paragraph") / PARAGRAPHS))
    return rows.groupBy("volume", "some").applyInPandas(run, "volume string, paragraph long, first_row long, page int, text string")
