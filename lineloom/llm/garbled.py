"""Problem 5: text decoded with the wrong character encoding.

For every ordered pair (true encoding, encoding it was read with) the sequences that come out of the characters of
real text, the whole first level of each national standard, are computed once per worker and put into one Aho-Corasick
automaton. A line is searched once;
at each hit the longest span that goes back to bytes in the wrong encoding and from there to valid text in
the true one is taken, and only that span is replaced. Text around it stays as it is. Spans read twice with
a wrong encoding are taken back twice. Bytes that were lost to the replacement character cannot come back:
such a line is reported without a restored text.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOST = "�"
PRIVATE = "\ue000-\uf8ff"  # private use: bytes that a wide encoding leaves to its users
NEXT_LINE = "\x85"  # a control character that real text may hold

SINGLE = ("cp1252", "latin-1", "cp1250", "mac_roman", "cp437", "cp850", "cp1251", "koi8-r", "cp866")
WIDE = ("cp932", "gb18030", "big5", "cp949", "euc-jp")
CYRILLIC = ("cp1251", "koi8-r", "cp866")
#: (true encoding, encoding it was read with). Cyrillic text read as a wide encoding cannot be told from text.
PAIRS = tuple(
    [("utf-8", w) for w in (*SINGLE, *WIDE)]
    + [(t, w) for t in WIDE for w in SINGLE]
    + [(t, w) for t in CYRILLIC for w in SINGLE if w not in CYRILLIC]
    + [(t, w) for t in WIDE for w in WIDE if t != w]
    + [("cp1252", w) for w in (*WIDE, "cp437", "cp1251", "koi8-r", "cp866")]
)
#: Wide encodings read as wide ones, and Western as wide: a single sign tells little, so several are asked for.
WEAK = {i for i, (t, w) in enumerate(PAIRS) if w in WIDE and t != "utf-8" and (t, w) not in {("cp932", "gb18030"), ("euc-jp", "cp932"), ("euc-jp", "gb18030")}}

_KANA = [chr(c) for c in (*range(0x3041, 0x3094), *range(0x30A1, 0x30F7), 0x30FC)]
_MARKS = list("、。「」『』！？（）・〜ー♪：\u3000")


@lru_cache
def _level(codec: str, first: int, last: int) -> tuple[str, ...]:
    """The characters of a national standard in these rows."""
    out = []
    for lead in range(first, last + 1):
        for trail in (*range(0x40, 0x7F), *range(0xA1, 0xFF)) if codec == "big5" else range(0xA1, 0xFF):
            try:
                char = bytes([lead, trail]).decode(codec)
            except UnicodeDecodeError:
                continue
            if len(char) == 1:
                out.append(char)
    return tuple(out)


@lru_cache
def first_level(true: str) -> tuple[str, ...]:
    """The common characters of the languages written in an encoding."""
    japanese = (*_KANA, *_MARKS, *_level("euc-jp", 0xB0, 0xCF))
    chinese = {"gb18030": _level("gb2312", 0xB0, 0xD7), "big5": _level("big5", 0xA4, 0xC6)}
    korean = _level("euc-kr", 0xB0, 0xC8)
    if true == "utf-8":
        return tuple(dict.fromkeys((*japanese, *chinese["gb18030"], *chinese["big5"], *korean)))
    return japanese if true in ("cp932", "euc-jp") else (*chinese[true], *"，。？！、") if true in chinese else korean


@lru_cache
def _chars(wrong: str) -> tuple[str, ...]:
    """The 256 characters of a one-byte encoding; a byte it leaves open stands for itself, as readers do."""
    return tuple(bytes([b]).decode(wrong, "ignore") or chr(b) for b in range(256))


@lru_cache
def _byte_table(wrong: str) -> dict[str, int]:
    """Character to byte of a one-byte encoding; control characters of the upper half stand for themselves."""
    return {chr(b): b for b in range(0x80, 0xA0)} | {c: b for b, c in enumerate(_chars(wrong))}


def _read(raw: bytes, wrong: str) -> str:
    if wrong in SINGLE:
        chars = _chars(wrong)
        return "".join([chars[b] for b in raw])
    return raw.decode(wrong)


def _sequences(true: str, wrong: str) -> Iterator[str]:
    """What characters of real text look like when read with the wrong encoding."""
    if true == "utf-8" and wrong in SINGLE:
        for lead in range(0xE0, 0xF0):  # three bytes: the first two tell
            for second in range(0x80, 0xC0):
                if lead > 0xE2 or (lead < 0xE2 and second >= 0xA0) or (lead == 0xE2 and second in (0x80, 0x84, 0x86, 0x88, 0x94, 0x96, 0x97, 0x98, 0x99)):
                    yield _read(bytes([lead, second]), wrong)
        yield _read(b"\xf0\x9f", wrong)  # signs beyond the first plane
        for c in (*range(0xA0, 0x180), *range(0x370, 0x530)):
            seq = _read(chr(c).encode(), wrong)
            if wrong not in CYRILLIC or 0x400 <= c < 0x460 and not seq[1].isspace():
                yield seq
    elif true == "utf-8":
        # the first two signs hold one character and the first byte of the next
        leads = [bytes([b]) for b in (0xE3, *range(0xE4, 0xEE), 0xEF)]
        for a in first_level(true):
            for b in leads:
                seq = (a.encode() + b + b"\x81").decode(wrong, "ignore")[:2]
                if len(seq) == 2 and not seq.isascii():
                    yield seq
    elif true in CYRILLIC:
        low = "абвгдежзийклмнопрстуфхцчшщъыьэюя"
        for a in low + low.upper():
            for b in low:
                yield _read((a + b).encode(true), wrong)
    elif true == "cp1252":
        for c in map(chr, range(0xC0, 0x100)):
            if wrong in SINGLE:
                seq = _read(c.encode(true), wrong)
                if not seq.isalpha() or not _WEST.match(seq):
                    yield seq
            else:
                for after in "abcdefghijklmnopqrstuvwxyz":
                    seq = (c + after).encode(true).decode(wrong, "ignore")
                    if len(seq) == 1 and not seq.isascii():
                        yield seq
    elif wrong in SINGLE:
        for a in first_level(true):
            try:
                seq = _read(a.encode(true), wrong)
            except UnicodeError:
                continue
            # quotation marks and dashes stand before letters in real text too
            if len(seq) == 2 and not seq.isascii() and not (seq[0] in _TYPOGRAPHIC and (seq[1].isalpha() or seq[1] in " '")) and not (wrong in CYRILLIC and seq[1].isascii()):
                yield seq
    else:
        weak = PAIRS.index((true, wrong)) in WEAK
        for a in first_level(true) if weak else _KANA + _MARKS:
            # in a wide encoding a character's last byte may join the next one's first, so two stand together
            for b in [""] if weak else ["の", "ノ", "る"]:
                try:
                    seq = (a + b).encode(true).decode(wrong)[: 1 if weak else 2]
                except UnicodeError:
                    continue
                if weak and seq and not _plausible([seq]) and not regex.match("[ぁ-ゖァ-ーｦ-ﾟ]", seq) or not weak and len(seq) > 1 and not seq.isascii():
                    yield seq


_WEST = regex.compile(r"[A-Za-zÀ-ÖØ-öø-ž]")
_TYPOGRAPHIC = "‘’“”•–—…„‚«»‹›"


def _ordinary(seq: str) -> bool:
    """Whether a sequence of kana, marks, plain or Cyrillic letters could stand in real text: then it is no evidence."""
    return bool(regex.fullmatch(r"[ぁ-んァ-ヴー、。「」！？…・\u3000A-Za-z0-9 ]*|[А-Яа-яЁё]*|[Α-Ωα-ωά-ώ]*", seq))


@lru_cache
def automaton():
    """The automaton over the sequences of all pairs; each carries the numbers of its pairs."""
    import ahocorasick

    found: dict[str, set[int]] = {LOST: set()}
    for number, (true, wrong) in enumerate(PAIRS):
        for seq in _sequences(true, wrong):
            if not _ordinary(seq) and not (len(seq) == 1 and seq in _LOOKS):
                found.setdefault(seq, set()).add(number)
    narrow = {i for i, (t, w) in enumerate(PAIRS) if w in ("cp1252", "latin-1", "cp1250", "mac_roman", "cp437", "cp850") and t in ("utf-8", *WIDE)}
    for c in map(chr, range(0x80, 0xA0)):
        if c != NEXT_LINE:
            found.setdefault(c, set()).update(narrow)
    machine = ahocorasick.Automaton()
    held: dict[tuple[int, ...], tuple[int, ...]] = {}  # equal sets of pairs are one
    for seq, pairs in found.items():
        key = tuple(sorted(pairs))
        machine.add_word(_bytes_of(seq), (len(seq), held.setdefault(key, key)))
    machine.make_automaton()
    return machine


def _bytes_of(text: str) -> str:
    """A text as its bytes of UTF-8, one character each: the automaton tries the children of a node in turn, so nodes must have few."""
    return text.encode("utf-8", "surrogatepass").decode("latin-1")


def _hits(text: str) -> list[tuple[int, int, tuple[int, ...]]]:
    """(begin, end, pairs) of the sequences in a text, in order of their ends."""
    found = list(automaton().iter(_bytes_of(text)))
    if not found:
        return []
    ends, at = {}, 0
    for i, char in enumerate(text):
        code = ord(char)
        at += 1 if code < 0x80 else 2 if code < 0x800 else 3 if code < 0x10000 else 4
        ends[at - 1] = i + 1
    return [(ends[last] - size, ends[last], pairs) for last, (size, pairs) in found]


#: Letters that stand for others that look the same are no sign of a wrong encoding.
_LOOKS = frozenset("АВЕЗІЈКМНОРСТУХЅаеорсухѕіјһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοινκργυα")

_KANA_RE = regex.compile(r"[ぁ-ゖァ-ー]")
_HAN_RE = regex.compile(r"[一-鿿]")
_HANGUL_RE = regex.compile(r"[가-힣]")
#: What text of the languages at hand is made of, with spaces and invisible characters; all else in a line is residue.
_FINE = (
    r" -~\u3000-ヿ一-鿿가-힣！-～…―“”‘’–—♪★☆※～→←①-⑳«»¿¡À-ÖØ-öø-ž"
    r"А-яЁёΑ-ωά-ώ\U0001f300-\U0001faff"
    r"\u00a0\u00ad\u2000-\u200f\u202f\u2060\ufeff\ufe00-\ufe0f\U000e0100-\U000e01ef°·²³¹½"
)
_RESIDUE = regex.compile(f"[^{_FINE}]")
_PRIVATE = regex.compile(f"[{PRIVATE}]")


def _to_bytes(text: str, wrong: str) -> bytes | None:
    if wrong in SINGLE:
        table = _byte_table(wrong)
        try:
            return bytes([table[c] for c in text])
        except KeyError:
            return None
    try:
        return text.encode(wrong)
    except UnicodeEncodeError:
        return None


@lru_cache(1 << 16)
def _is_common(char: str, true: str) -> bool:
    standard, first, last = ("euc-jp", 0xB0, 0xCF) if true in ("cp932", "euc-jp") else ("big5", 0xA4, 0xC6) if true == "big5" else ("euc-kr", 0xB0, 0xC8) if true == "cp949" else ("gb2312", 0xB0, 0xD7)
    try:
        return first <= char.encode(standard)[0] <= last
    except UnicodeEncodeError:
        return False


def _plausible(chars) -> int:
    """How many characters are among the common ones of any national standard."""
    return sum(any(_is_common(c, t) for t in ("cp932", "gb18030", "big5", "cp949")) for c in chars)


def _common(han, true: str) -> int:
    """How many characters are among the common ones (first level) of the national standard."""
    return sum(_is_common(c, true) for c in han)


def _odd_text(old: str) -> bool:
    """Whether a text in wide characters can hardly be meant: most of them are uncommon in every standard."""
    own = [c for c in old if not c.isascii() and c.isalpha()]
    return len(own) >= 3 and 5 * _plausible(own) <= 2 * len(own) and not regex.search("[ぁ-ゖァ-ーｦ-ﾟ]", old)


def _real(new: str, old: str, true: str, wrong: str) -> bool:
    """Whether a decoded span is real text of the languages written in its encoding."""
    if new.isascii():
        return False
    left = _RESIDUE.findall(new)
    if left:
        again = _byte_table(wrong) if true == "utf-8" and wrong in SINGLE else ()  # it may have been read so twice
        if not all(c in again for c in left):
            return False
    han, kana = _HAN_RE.findall(new), len(_KANA_RE.findall(new))
    signs = [c for c in old if not c.isascii()]
    if true != "utf-8" and true != "cp1252" and wrong in SINGLE and len(set(signs)) < 3:
        return False  # a row of one ornament
    if true in CYRILLIC:
        letters = regex.findall(r"[А-Яа-яЁё]+", new)
        mixed = regex.search(r"[A-Za-zÀ-ž][А-яЁё]|[А-яЁё][A-Za-zÀ-ž]|[а-яё][А-ЯЁ]", new)
        return sum(map(len, letters)) >= 4 and not mixed and len(max(letters, key=len)) >= 3 and (wrong in SINGLE or _odd_text(old))
    if true == "cp1252":
        # one letter within a Latin word, or at its end
        return bool(regex.search(r"[a-z][À-öø-þ]|[À-öø-þ][a-z]", new)) and not regex.search(r"[^A-Za-zÀ-öø-þ'’ \-]", new) and bool(regex.search("[A-Za-z]{2}", new))
    if true == "utf-8":
        return wrong in SINGLE or len(new) >= 2
    if true == "cp949":
        hangul = _HANGUL_RE.findall(new)
        ok = len(hangul) >= 2 and _common(hangul, true) >= 0.8 * len(hangul)
    elif _HANGUL_RE.search(new) or (true == "big5" and kana) or (true == "gb18030" and kana and (kana < 2 or wrong in WIDE)):
        return False
    else:
        ok = kana >= 2 or (len(han) >= 2 and _common(han, true) >= 0.5 * len(han))
    if ok and wrong in SINGLE and regex.search("[a-z][ぁ-ヺ一-鿿가-힣][a-z]", new):
        return False
    if ok and (true, wrong) not in _STRONG:
        # letters of words between the signs of a quotation are no bytes of characters
        signs = len(han) + kana + len(_HANGUL_RE.findall(new))
        ok = 2 * len(_JOINED.findall(new)) < signs
        if ok and wrong in WIDE:
            # what stands there must be uncommon in its own encoding, and what comes out common
            ok = _odd_text(old) and signs >= 3 and _common(han + _HANGUL_RE.findall(new), true) + kana == signs
    return ok


#: Pairs whose hits alone tell enough.
_STRONG = {(t, w) for t in ("cp932", "euc-jp") for w in ("gb18030", "cp932")}


@lru_cache
def _holds(wrong: str):
    if wrong in SINGLE:
        return _byte_table(wrong).__contains__
    return lru_cache(1 << 15)(lambda c: c.isascii() or _to_bytes(c, wrong) is not None)


def _segments(raw: bytes, true: str):
    """(first byte, end) of the longest valid stretches of some bytes."""
    at = 0
    while at < len(raw):
        try:
            raw[at:].decode(true)
            yield at, len(raw)
            return
        except UnicodeDecodeError as e:
            if e.start:
                yield at, at + e.start
            at += e.start + 1


def _spans(text: str, hits: list[tuple[int, int]], number: int):
    """(begin, end, true text) of the spans around the hits that the pair explains."""
    true, wrong = PAIRS[number]
    holds, done = _holds(wrong), 0
    for first, last in hits:
        if first < done:
            continue
        lo, end = first, first
        while lo > done and holds(text[lo - 1]):
            lo -= 1
        while end < len(text) and holds(text[end]):
            end += 1
        run = text[lo:end]
        if wrong in SINGLE:
            raw, starts = _to_bytes(run, wrong), range(len(run) + 1)
        else:
            sizes = [len(_to_bytes(c, wrong)) for c in run]
            raw, starts, total = b"".join(_to_bytes(c, wrong) for c in run), [0], 0
            for size in sizes:
                total += size
                starts.append(total)
        inside = [a - lo for a, b in hits if lo <= a < end]
        for a, b in _segments(raw, true):
            begin = bisect_left(starts, a)
            finish = bisect_right(starts, b) - 1
            while begin < finish and run[begin].isascii() and true != "cp1252":
                begin += 1
            while wrong in SINGLE and true == "utf-8" and begin < finish and run[finish - 1].isascii():
                finish -= 1
            if begin >= finish or not any(begin <= x < finish for x in inside):
                continue
            try:
                new = raw[starts[begin] : starts[finish]].decode(true)
            except UnicodeDecodeError:
                continue
            if _real(new, run[begin:finish], true, wrong):
                yield lo + begin, lo + finish, new
        done = end


def _residue(text: str) -> int:
    return len(_RESIDUE.findall(text))


_JOINED = regex.compile(r"(?<=[A-Za-zÀ-ž])[一-鿿가-힣]|[一-鿿가-힣](?=[A-Za-zÀ-ž])")


def _odd(new: str, true: str) -> int:
    """How many characters of a reading are uncommon in its encoding, or joined to Latin letters."""
    han = _HAN_RE.findall(new)
    trues = ("euc-jp", "gb18030", "big5") if true == "utf-8" else (true,)
    count = len(han) - max(_common(han, t) for t in trues) + len(_JOINED.findall(new))
    # the standard holds a syllable in two bytes, any other one only as a sequence of its letters
    return count + sum(len(c.encode("euc-kr")) != 2 for c in _HANGUL_RE.findall(new))


# Characters that most text of their language holds.
_OFTEN = frozenset(
    "的一是不了我有他这這来來个個们們说說到没沒在为為要你妈媽还還让讓对對请請那里裡妹爸她哥老从從找邻鄰告诉訴昨今明天很，。？！、"
    "이가을를은는에의도지고서로우리누구것입니까해요었어있없다한하너무내일"
)


def _by_pair(text: str, hits: list[tuple[int, int, tuple[int, ...]]], number: int) -> tuple[str, int]:
    """The text with every span that one pair explains taken back, and the number of such spans."""
    own = [(a, b) for a, b, pairs in hits if number in pairs]
    if number in WEAK and PAIRS[number][0] != "cp1252" and len(own) < 2:
        return text, 0
    pieces, done, spans = [], 0, 0
    for begin, end, new in _spans(text, own, number):
        pieces += [text[done:begin], new]
        done, spans = end, spans + 1
    return "".join([*pieces, text[done:]]), spans


def _certain(text: str, hits: list[tuple[int, int, tuple[int, ...]]]) -> bool:
    """Whether a lost byte, a control character or one for private use tells without a reading."""
    return bool(_PRIVATE.search(text)) or any(b - a == 1 and (text[a] == LOST or "\x80" <= text[a] < "\xa0") for a, b, _ in hits)


def _in_order(hits: list[tuple[int, int, tuple[int, ...]]]) -> list[int]:
    """The pairs of which a sequence is there, those that cover most of the text first."""
    covers: dict[int, int] = {}
    for a, b, pairs in hits:
        for number in pairs:
            covers[number] = covers.get(number, 0) + b - a
    return sorted(covers, key=lambda k: (-covers[k], k))


def repair(text: str | None) -> tuple[bool, str | None, str | None]:
    """(garbled, restored text or None, "true<wrong") of one line.

    Null, empty and clean texts are (False, None, None). A garbled text of which bytes are lost, or that no
    pair explains wholly, is (True, None, pair or None).
    """
    if not text or text.isascii():
        return False, None, None
    hits = _hits(text)
    certain = _certain(text, hits)
    best = None
    for number in _in_order(hits):
        new, spans = _by_pair(text, hits, number)
        if not spans:
            continue
        for _ in range(len(text)):  # read wrongly again and again
            if PAIRS[number][0] != "utf-8" or not _RESIDUE.search(new):
                break
            again, more = _by_pair(new, _hits(new), number)
            if not more:
                break
            new = again
        often = len(_KANA_RE.findall(new)) + sum(c in _OFTEN for c in new)
        mixed = PAIRS[number][0] == "gb18030" and bool(_KANA_RE.search(new))
        score = (-_residue(new), -mixed, often, -_odd(new, PAIRS[number][0]), len(_HAN_RE.findall(new)) + len(_HANGUL_RE.findall(new)), -number)
        if best is None or score > best[0]:
            best = (score, new, number)
    if best is None:
        return certain, None, None
    _, new, number = best
    return True, None if _residue(new) else new, "<".join(PAIRS[number])


def is_garbled(text: str | None) -> bool:
    """Whether ``repair`` would report the text, without restoring it."""
    if not text or text.isascii():
        return False
    hits = _hits(text)
    return _certain(text, hits) or any(_by_pair(text, hits, number)[1] for number in _in_order(hits))


def find_garbled(df: DataFrame, text: str, keys: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """The garbled rows: ``keys``, the garbled text, ``restored`` (null where bytes are lost) and ``reading``.

    One row for each input row that is garbled, rows given twice with equal keys once. Null, empty and ASCII
    texts are never garbled; an empty table gives no rows; other columns are not read.
    """
    fields = [df.schema[k] for k in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", `garbled` string, `restored` string, `reading` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keys)).to_pylist()
            found = [(i, *r[1:]) for i, t in enumerate(texts) if (r := repair(t))[0]]
            rows = pa.array([i for i, *_ in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(k).take(rows) for k in range(len(keys))]
                + [batch.column(len(keys)).take(rows).cast(pa.string()), pa.array([r for _, r, _ in found], pa.string()), pa.array([p for *_, p in found], pa.string())],
                names=[*keys, "garbled", "restored", "reading"],
            )

    taken = df.select(*keys, F.col(text).cast("string").alias("__text")).filter("__text is not null")
    return taken.mapInArrow(run, schema).dropDuplicates(list(keys))


def restore_texts(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the garbled lines of a text column restored where all of a line can be; other lines stay as they are.

    Null stays null; all other columns and all rows stay.
    """

    def one(whole: str | None) -> str | None:
        if whole is None or whole.isascii():
            return whole
        return "\n".join(repair(line)[1] or line for line in whole.split("\n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            new = pa.array([one(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == at else batch.column(i) for i in range(batch.num_columns)], names=batch.schema.names)

    return df.mapInArrow(run, df.schema)
