"""Problem 7: the language of texts, of their lines and of the parts of mixed lines, with a confidence.

A line is cut into words (runs of one script). A linear-chain conditional random field labels them: features of
a word are its characters and pairs of them, its first and last ones, and which national character sets hold it
(the lexicon); two transition matrices are learned, within a clause and across a gap of space or punctuation.
Forward-backward gives the probability of each language for each word. The field is trained here, on a bounded
sample of lines of labelled documents and on lines joined from them, as no labelled mixed text is at hand; lines made of the
lexicon's words teach it languages that the documents lack, which get the label other. ``held_out`` trains without a fifth of
the sources and tells how well it labels theirs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineloom.session import settle

from .garbled import is_garbled
from .lookalike import LOOKALIKES
from .markup import clean_line, find_syntax
from .visible import shown

LABELS = ("ja", "zh", "en", "fr", "de", "es", "ko", "other")
#: Labelled documents (about) from whose lines training chooses, and the characters of the longest of them.
TRAIN_DOCUMENTS, TRAIN_CHARS = 2000, 20_000
#: Lines of one language, joined lines of two, lines made of lexicon words, and words of the longest line that training takes.
TRAIN_LINES, TRAIN_JOINED, TRAIN_MADE, TRAIN_WORDS = 500, 250, 120, 60
#: Of the sources, one in so many is held out by ``held_out``.
HELD_OUT = 5
SLOTS = 1 << 15
ROUNDS = 45

# Frequent short words of languages written in Latin letters.
FUNCTION_WORDS = {
    "en": "the of and to in is was by with for on at from that this it are be or not an as had has have you we they he she his her "
    "their there where when why who which what would could should must will can us me my our your so if then than i am do did been "
    "were but about into out up down all some any very just because while through these those don't i'm it's",
    "fr": "le la les un une des du de et est était dans pour avec sur que qui ne pas au aux ce cette il elle nous vous ils où sont son "
    "sa ses je tu suis es mais donc comme tout plus bien être avoir fait très aussi chez sans sous mon ma mes leur quand pourquoi "
    "aujourd'hui c'est j'ai qu'il n'est d'un l'on ont avez sommes elles ça",
    "de": "der die das den dem des ein eine einen und ist war nicht mit für auf von zu im am dass ich er sie wir ihr über hinter warum "
    "als es du bin bist sind sein haben hat auch noch nur aber oder wenn wie was wer wo nach bei aus um durch gegen ohne sehr schon "
    "mein dein kein heute immer wird werden",
    "es": "el la los las un una unos y es era en para con por que no del al este esta donde su sus lo se muy qué dónde él ella yo tú "
    "estoy está están son soy pero como más todo sin sobre entre cuando porque hay tiene había mi tu nos les también hoy siempre",
    # Italian, Portuguese, Dutch, Swedish, Polish, Turkish, Russian and Indonesian
    "other": "il lo gli uno di che non sono è nella della degli questo questa come più ma anche perché molto sempre oggi io mio tua "
    "o os um uma não em na no da dos das com para você eu meu são está isso mas também muito quando porque "
    "het een van niet met voor op dat deze ik jij wij zijn heeft maar ook hoe waar wat wie naar geen mijn "
    "och att det som på är inte jag du vi har för med till av om kan hur var när mitt "
    "i w na nie się jest to że jak ale czy co tak dla tylko już mój był ma "
    "ve bir bu da ne için çok ama ben sen değil gibi daha mi var yok olan "
    "и в не на я что он с как это но по из мы вы она у так же был "
    "yang dan di ini itu dengan untuk tidak dari saya kami akan pada ada",
}

_WORD = regex.compile(r"[ぁ-ゖゝゞ]+|[ァ-ヺー]+|[一-鿿㐀-䶿々〆]+|[가-힣]+|[\p{Latin}\p{M}]+(?:['’]\p{Latin}+)*|[\p{Cyrillic}\p{Greek}]+")
_KANA = regex.compile(r"[ぁ-ゖァ-ヺ]")
_HIRA = regex.compile(r"[ぁ-ゖ]")
_HAN = regex.compile(r"[一-鿿㐀-䶿]")
_HANGUL = regex.compile(r"[가-힣]")
_LATIN = regex.compile(r"\p{Latin}")
_TO_LATIN = {ord(o): e[0] for e in LOOKALIKES.split() if e[0].isascii() and e[0].isalpha() for o in e[2:]}
_FULL = {c: c - 0xFEE0 for c in (*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B))}
_HALF = regex.compile(r"[ｦ-ﾟ]+")


def plain(text: str) -> str:
    """A line as the labels see it: without invisible characters and syntax, letters in one width and script."""
    if not text.isascii():
        text = shown(text)
        if _HALF.search(text):
            import unicodedata

            text = _HALF.sub(lambda m: unicodedata.normalize("NFKC", m.group()), text)
        text = text.translate(_FULL)
        if _LATIN.search(text):
            text = text.translate(_TO_LATIN)
    return clean_line(text) if find_syntax(text, True) else text


def words(text: str) -> tuple[list[str], list[bool]]:
    """The words of a line, and of each whether a gap stands before it."""
    found, gaps, end = [], [], -1
    for hit in _WORD.finditer(text):
        found.append(hit.group())
        gaps.append(hit.start() != end)
        end = hit.end()
    return found, gaps


_FUNCTION = {lang: frozenset(own.split()) for lang, own in FUNCTION_WORDS.items()}


def _held(char: str, codec: str) -> bool:
    try:
        char.encode(codec)
        return True
    except UnicodeEncodeError:
        return False


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode()) % SLOTS


def features(word: str) -> list[int]:
    """The slots of a word's features."""
    script = "h" if _HIRA.match(word) else "k" if _KANA.match(word) or word[0] == "ー" else "c" if _HAN.match(word) or word[0] in "々〆" else "g" if _HANGUL.match(word) else "l"
    out = [f"s{script}"]
    if script == "l":
        low = word.lower()
        padded = f"^{low}$"
        out += [f"w{low}", f"u{word.isupper()}{min(len(word), 4)}"]
        out += [f"n{padded[i : i + k]}" for k in (2, 3, 4) for i in range(len(padded) - k + 1)]
        out += [f"x{c}" for c in set(low) if not c.isascii()]
        out += [f"L{lang}" for lang, own in _FUNCTION.items() if low in own]
    elif script == "c":
        out += [f"c{c}" for c in set(word)] + [f"b{word[i : i + 2]}" for i in range(len(word) - 1)]
        out += [f"f{word[0]}", f"e{word[-1]}", f"l{min(len(word), 6)}"]
        for c in word:
            jis, gb, big = _held(c, "euc-jp"), _held(c, "gb2312"), _held(c, "big5")
            if not (jis and gb and big):
                out.append(f"m{jis:d}{gb:d}{big:d}")
    else:
        out.append(f"e{word[-1]}")
    return [_slot(f) for f in out]


_JA, _ZH = LABELS.index("ja"), LABELS.index("zh")


@dataclass
class Field:
    """A trained field: weights of feature slots, and transitions without and with a gap."""

    weights: np.ndarray
    moves: np.ndarray
    starts: np.ndarray
    _known: dict[str, int] = field(default_factory=dict)
    _table: np.ndarray | None = None

    def __getstate__(self):
        return {"weights": self.weights, "moves": self.moves, "starts": self.starts, "_known": {}, "_table": None}

    def _ids(self, found: list[str]) -> list[int]:
        """Rows of the table of emissions for some words; new ones are added."""
        known = self._known
        if len(known) > 400_000:
            known.clear()
        new = [w for w in dict.fromkeys(found) if w not in known]
        if new or self._table is None:
            lists = [features(w) for w in new]
            add = np.zeros((len(new), len(LABELS)), np.float32)
            if new:
                np.add.at(add, np.repeat(np.arange(len(new)), [len(f) for f in lists]), self.weights[[x for f in lists for x in f]])
            if self._table is None or not known:
                self._table, size = np.zeros((max(1024, 2 * len(new)), len(LABELS)), np.float32), 0
            else:
                size = len(known)
            while size + len(new) > len(self._table):
                self._table = np.concatenate([self._table, np.zeros_like(self._table)])
            self._table[size : size + len(new)] = add
            for k, w in enumerate(new):
                known[w] = size + k
        return [known[w] for w in found]

    def decode(self, lines: list[tuple[list[str], list[bool]]]) -> list[tuple[list[int], list[float]]]:
        """For each line, the likeliest label of each word and its probability, by forward-backward."""
        out: list[tuple[list[int], list[float]]] = [([], [])] * len(lines)
        ids = self._ids([w for ws, _ in lines for w in ws])
        gaps = [g for _, gs in lines for g in gs]
        begins = np.concatenate(([0], np.cumsum([len(ws) for ws, _ in lines])))
        ids, gaps = np.array(ids, np.int64), np.array(gaps, np.int8)
        order = sorted((i for i in range(len(lines)) if lines[i][0]), key=lambda i: len(lines[i][0]))
        at = 0
        while at < len(order):
            longest, stop = len(lines[order[at]][0]), at
            while stop < len(order) and (stop == at or (stop - at) * len(lines[order[stop]][0]) <= 65_536) and len(lines[order[stop]][0]) <= max(longest + 2, longest * 5 // 4):
                stop += 1
            part = order[at:stop]
            size = np.array([len(lines[i][0]) for i in part])
            place = begins[part][:, None] + np.arange(size.max())[None, :]
            live = np.arange(size.max())[None, :] < size[:, None]
            place = np.where(live, place, 0)
            emit = np.where(live[..., None], self._table[ids[place]], 0)
            marginal = _forward_backward(emit, gaps[place], size, self.moves, self.starts, False)[0]
            best, top = marginal.argmax(2).tolist(), marginal.max(2).tolist()
            for i, n, b, t in zip(part, size.tolist(), best, top):
                out[i] = (b[:n], t[:n])
            at = stop
        return out


def _forward_backward(emit, gap, sizes, moves, starts, expect=True):
    """(marginals, expected transitions, log of the normaliser) of padded lines, with scaled messages."""
    n, length, k = emit.shape
    top = emit.max(2, keepdims=True)
    local = np.exp(emit - top)
    step = np.exp(moves - moves.max())
    forward, scale = np.zeros_like(local), np.ones((n, length), local.dtype)
    alpha = local[:, 0] * np.exp(starts - starts.max())
    for t in range(length):
        if t:
            via = np.where(gap[:, t, None] > 0, forward[:, t - 1] @ step[1], forward[:, t - 1] @ step[0])
            alpha = via * local[:, t]
        total = alpha.sum(1, keepdims=True) + 1e-30
        forward[:, t] = alpha / total
        scale[:, t] = total[:, 0]
    backward = np.ones_like(local)
    pairs = np.zeros((2, k, k))
    live = np.arange(length)[None, :] < sizes[:, None]
    for t in range(length - 2, -1, -1):
        nxt = local[:, t + 1] * backward[:, t + 1]
        via = np.where(gap[:, t + 1, None] > 0, nxt @ step[1].T, nxt @ step[0].T) / scale[:, t + 1, None]
        inside = live[:, t + 1]
        backward[:, t] = np.where(inside[:, None], via, 1.0)
        for g in (0, 1) if expect else ():
            rows = inside & (gap[:, t + 1] == g)
            if rows.any():
                pairs[g] += np.einsum("ni,nj->ij", forward[rows, t], nxt[rows] / scale[rows, t + 1, None]) * step[g]
    marginal = forward * backward
    marginal /= marginal.sum(2, keepdims=True) + 1e-30
    return marginal, pairs, scale


def train(samples: Iterable[tuple[str, str]], seed: int = 7) -> Field:
    """Train a field on (line, language) samples; lines joined from two languages are made of them.

    Script decides where it can: a line with kana is Japanese, with hangul Korean, whatever its label; a line whose
    script does not go with its label is not taken. Labels with no sample are never found.
    """
    rng = np.random.default_rng(seed)
    pool: dict[str, list[tuple[list[str], list[bool]]]] = {lab: [] for lab in LABELS}
    for text, label in samples:
        text = plain(text)
        kana, han, hangul, latin = (len(p.findall(text)) for p in (_KANA, _HAN, _HANGUL, _LATIN))
        if kana >= 2:
            label = "ja"
        elif hangul >= 2:
            label = "ko"
        elif (label in ("ja", "zh") and han < 2) or (label in ("en", "fr", "de", "es") and (han or latin < 8)) or label == "ko" or label not in pool:
            continue
        w, g = words(text)
        if w and len(w) <= TRAIN_WORDS:
            pool[label].append((w, g))
    if not any(pool.values()):
        return Field(np.zeros((SLOTS, len(LABELS)), np.float32), np.zeros((2,) + (len(LABELS),) * 2, np.float32), np.zeros(len(LABELS), np.float32))
    # lines of lexicon words: the sample need not hold them
    for label, own in _FUNCTION.items():
        listed = sorted(own)
        for _ in range(TRAIN_MADE):
            made = [listed[i] for i in rng.integers(len(listed), size=6)]
            pool[label].append((made, [True] * len(made)))
    lines, golds = [], []
    for label, own in pool.items():
        keep = [own[i] for i in rng.permutation(len(own))[:TRAIN_LINES]]
        if label == "ja":  # lines of kanji alone are few, and what must be told from Chinese
            rare = [x for x in own if not any(_KANA.search(w) for w in x[0])][:TRAIN_LINES]
            keep += rare
        for w, g in keep:
            lines.append((w, g))
            golds.append([LABELS.index(label)] * len(w))
    have = [lab for lab in LABELS if pool[lab]]
    for a in have:
        for b in have:
            if a != b and ("ja" in (a, b) or "zh" in (a, b)):
                for _ in range(TRAIN_JOINED // (1 if {a, b} == {"ja", "zh"} else 8)):
                    (wa, ga), (wb, gb) = pool[a][rng.integers(len(pool[a]))], pool[b][rng.integers(len(pool[b]))]
                    lines.append((wa + wb, ga + [True] + gb[1:]))
                    golds.append([LABELS.index(a)] * len(wa) + [LABELS.index(b)] * len(wb))
    k = len(LABELS)
    model = Field(np.zeros((SLOTS, k), np.float32), np.zeros((2, k, k), np.float32), np.zeros(k, np.float32))
    model.moves += 2 * np.eye(k, dtype=np.float32)
    vocab: dict[str, int] = {}
    coded = [[vocab.setdefault(w, len(vocab)) for w in ws] for ws, _ in lines]
    lists = [features(w) for w in vocab]
    owner = np.repeat(np.arange(len(lists)), [len(f) for f in lists])
    slots = np.concatenate([np.array(f) for f in lists])
    groups = []
    order = sorted(range(len(lines)), key=lambda i: len(coded[i]))
    for at in range(0, len(order), 700):
        part = order[at : at + 700]
        size = np.array([len(coded[i]) for i in part])
        ids, gap, gold = (np.zeros((len(part), size.max()), np.int64) for _ in range(3))
        for row, i in enumerate(part):
            ids[row, : size[row]], gap[row, : size[row]], gold[row, : size[row]] = coded[i], lines[i][1], golds[i]
        groups.append((ids, gap, gold, size))
    squared_w, squared_m, squared_s = np.full((SLOTS, k), 1e-3, np.float32), np.full((2, k, k), 1e-3), np.full(k, 1e-3)
    eye = np.eye(k)
    for _ in range(ROUNDS):
        table = np.zeros((len(lists), k), np.float32)
        np.add.at(table, owner, model.weights[slots])
        grad_t, grad_m, grad_s = np.zeros_like(table), np.zeros((2, k, k)), np.zeros(k)
        for ids, gap, gold, size in groups:
            live = np.arange(ids.shape[1])[None, :] < size[:, None]
            emit = np.where(live[..., None], table[ids], 0)
            marginal, pairs, _ = _forward_backward(emit, gap, size, model.moves, model.starts)
            diff = (eye[gold] - marginal) * live[..., None]
            np.add.at(grad_t, ids[live], diff[live])
            true = np.zeros((2, k, k))
            inside = live[:, 1:]
            np.add.at(true, (gap[:, 1:][inside], gold[:, :-1][inside], gold[:, 1:][inside]), 1)
            grad_m += true - pairs
            grad_s += diff[:, 0].sum(0)
        grad_w = np.zeros_like(model.weights)
        np.add.at(grad_w, slots, grad_t[owner])
        grad_w -= 0.02 * model.weights
        squared_w += grad_w**2
        squared_m += grad_m**2
        squared_s += grad_s**2
        model.weights += 0.5 * grad_w / np.sqrt(squared_w)
        model.moves += (0.3 * grad_m / np.sqrt(squared_m)).astype(np.float32)
        model.starts += (0.3 * grad_s / np.sqrt(squared_s)).astype(np.float32)
    return model


def _samples(documents: DataFrame, text: str, label: str, key: str, host: str | None, out: bool) -> list[tuple[str, str]]:
    """(line, label) of about TRAIN_DOCUMENTS documents taken by hash; ``out``: of the held-out sources, else of the others.

    Lines are chosen in Spark, by hash, for each label; what comes to the driver has a fixed bound.
    """
    known = documents.filter(F.col(label).isin(*LABELS) & F.col(text).isNotNull() & (F.length(text) <= TRAIN_CHARS))
    if host is not None:
        known = known.filter((F.pmod(F.xxhash64(host), F.lit(HELD_OUT)) == 0) == F.lit(out))
    every = max(1, known.count() // TRAIN_DOCUMENTS)
    lines = (
        known.filter(F.pmod(F.xxhash64(key), F.lit(every)) == 0)
        .select(F.col(label).alias("label"), F.explode(F.split(text, "\n")).alias("line"))
        .filter("trim(line) <> ''")
        .distinct()
        .withColumn("h", F.xxhash64("line"))
    )
    lines = settle(lines, "lines")
    # kanji alone are few among Japanese lines, and what must be told from Chinese
    bare = (F.col("label") == "ja") & ~F.col("line").rlike("[ぁ-ゖァ-ヺ]")
    wanted = [F.col("label") == x for x in LABELS] + [bare]
    rows = {(r["line"], r["label"]) for w in wanted for r in lines.filter(w).orderBy("h", "line").limit(4 * TRAIN_LINES).collect()}
    return sorted(rows)


def train_on(documents: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id") -> Field:
    """Train a field on a bounded sample of lines of labelled documents."""
    return train(_samples(documents, text, label, key, None, False))


def held_out(documents: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", host: str = "source") -> DataFrame:
    """``lang, lines, right, confidence``: lines of held-out sources by their document's label, how many a field trained on the
    other sources labels so, and the mean confidence it gives."""
    model = train(_samples(documents, text, label, key, host, False))
    rows = [(x, y) for x, y in _samples(documents, text, label, key, host, True) if len(words(plain(x))[0]) > 1]
    cut = [words(plain(x)) for x, _ in rows]
    tally: dict[str, list[float]] = {}
    for (_, y), (w, _), m in zip(rows, cut, model.decode(cut), strict=True):
        found, sure, _ = line_language(w, *m)
        t = tally.setdefault(y, [0, 0, 0.0])
        t[0], t[1], t[2] = t[0] + 1, t[1] + (found == y), t[2] + sure
    out = [(y, int(n), int(right), round(sure / n, 4)) for y, (n, right, sure) in sorted(tally.items())]
    return documents.sparkSession.createDataFrame(out, "lang string, lines long, right long, confidence double")


def line_language(w: list[str], best: list[int], top: list[float], parts: bool = False) -> tuple[str | None, float, list[tuple[str, str, float]]]:
    """(language of a line or mix or None, confidence, parts) from its words, their labels and probabilities.

    A part is (language, text, confidence): words in a row with one label.
    """
    if not w:
        return None, 0.0, []
    sizes = [len(x) * (1 if x[0] < "\u0250" else 2) for x in w]
    weights: dict[int, int] = {}
    total = sure = 0.0
    for label, size, chance in zip(best, sizes, top):
        weights[label] = weights.get(label, 0) + size
        total += size
        sure += size * chance
    found: list[tuple[str, str, float]] = []
    if parts:
        begin = 0
        for i in range(1, len(w) + 1):
            if i == len(w) or best[i] != best[begin]:
                mass = sum(sizes[begin:i])
                found.append((LABELS[best[begin]], " ".join(w[begin:i]), sum(s * t for s, t in zip(sizes[begin:i], top[begin:i])) / mass))
                begin = i
    sure /= total
    if weights.get(_JA, 0) >= 4 and weights.get(_ZH, 0) >= 4:
        return "mix", sure, found
    if _JA in weights and any("\u3041" <= x[0] <= "\u3096" for x in w):
        return "ja", sure, found
    return LABELS[max(weights, key=lambda k: weights[k])], sure, found


def label_lines(df: DataFrame, text: str, model: Field, keys: tuple[str, ...] = ("row_id",), parts: bool = False) -> DataFrame:
    """``keys, lang, confidence`` (and ``parts``: the language, text and confidence of each part) of every line.

    ``lang`` is a language, mix (a part Japanese and a part Chinese), or null for null, empty or garbled lines and
    such without words. Each input row gives one row. The model is a few megabytes and goes with the task.
    """
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    schema = kinds + ", `lang` string, `confidence` double" + (", `parts` array<struct<lang:string,text:string,confidence:double>>" if parts else "")
    kind = pa.list_(pa.struct([("lang", pa.string()), ("text", pa.string()), ("confidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keys)).to_pylist()
            cut = [([], []) if not t or is_garbled(t) else words(plain(t)) for t in texts]
            found = [line_language(w, *m, parts) for (w, _), m in zip(cut, model.decode(cut))]
            arrays = [batch.column(i) for i in range(len(keys))]
            arrays += [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            if parts:
                arrays.append(pa.array([[{"lang": a, "text": b, "confidence": c} for a, b, c in f[2]] for f in found], kind))
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "lang", "confidence"] + ["parts"] * parts)

    return df.select(*keys, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def count_languages(df: DataFrame, document: str, text: str, model: Field, row_id: str = "row_id") -> DataFrame:
    """``document, lines``, the counts of mix and of each language, ``confidence``, ``lang`` and ``lang_confidence``.

    ``confidence`` is the mean of the lines. ``lang`` is the language (or mix) of the greatest sum of line confidences,
    ``lang_confidence`` its share of the sums of all; both are null if no line has a language. Rows with one ``row_id``
    count once.
    """
    found = label_lines(df.select(row_id, document, text), text, model, (row_id, document)).dropDuplicates([row_id])
    return _by_document(found, document)


def _by_document(found: DataFrame, document: str) -> DataFrame:
    kinds = ("ja", "zh", "mix", "en", *(x for x in LABELS if x not in ("ja", "zh", "en")))
    counts = [F.count_if(F.col("lang") == lab).alias(lab) for lab in kinds]
    sums = [F.sum(F.when(F.col("lang") == lab, F.col("confidence")).otherwise(0.0)).alias(f"__{lab}") for lab in kinds]
    mean = F.avg(F.when(F.col("lang").isNotNull(), F.col("confidence"))).alias("confidence")
    best = F.greatest(*[F.struct(F.col(f"__{lab}").alias("s"), F.lit(lab).alias("lang")) for lab in kinds])
    total = sum((F.col(f"__{lab}") for lab in kinds), F.lit(0.0))
    return (
        found.groupBy(document)
        .agg(F.count("*").alias("lines"), *counts, mean, *sums)
        .withColumn("lang", F.when(total > 0, best["lang"]))
        .withColumn("lang_confidence", F.when(total > 0, best["s"] / total))
        .drop(*[f"__{lab}" for lab in kinds])
    )


def label_documents(df: DataFrame, model: Field, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """``doc_id, recorded, lang, confidence, lines, fault``: the language of each document; ``fault``: missing, wrong or null.

    The language is that of the greatest sum of line confidences. Rows of one key count once; null and blank texts, and such
    without words, have none. A record is wrong where another language was found.
    """
    once = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(label).alias("recorded")).dropDuplicates(["doc_id"])
    lines = once.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter("trim(line) <> ''")
    found = _by_document(label_lines(lines, "line", model, ("doc_id",)), "doc_id").select("doc_id", "lines", "lang", F.col("lang_confidence").alias("confidence"))
    both = once.select("doc_id", "recorded").join(found, "doc_id", "left")
    fault = F.when(F.col("lang").isNull(), None).when(F.col("recorded").isNull(), "missing").when(F.col("recorded") != F.col("lang"), "wrong")
    return both.select("doc_id", "recorded", "lang", "confidence", F.coalesce("lines", F.lit(0)).alias("lines"), fault.alias("fault"))


def newest_rows(files: DataFrame) -> DataFrame:
    """The newest row of each file: highest ``file_mtime_ns``, exact duplicates once."""
    order = Window.partitionBy("media", "relpath").orderBy(F.desc("file_mtime_ns"), F.desc("format_version"))
    return files.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def wrong_counts(files: DataFrame, lines: DataFrame, model: Field, media: str = "subs") -> DataFrame:
    """``relpath, lang`` where a recorded count of a file is off by more than a quarter of its lines."""
    newest = newest_rows(files.filter(F.col("media") == media)).filter("utf8 is null or utf8")
    counted = count_languages(lines, "file", "line", model).select("file", "lines", *[F.col(c).alias(f"c_{c}") for c in ("ja", "zh", "mix", "en")])
    both = newest.join(counted, F.col("relpath") == F.col("file"), "left")
    each = F.explode(
        F.array(*[F.struct(F.lit(c).alias("lang"), F.abs(F.coalesce(F.col(c), F.lit(0)) - F.coalesce(F.col(f"c_{c}"), F.lit(0))).alias("off")) for c in ("ja", "zh", "mix", "en")])
    )
    return both.select("relpath", F.coalesce("n", "lines").alias("n"), each.alias("e")).filter("e.off * 4 > n").select("relpath", "e.lang")
