"""Problem 10: error messages, demands for scripts or login, filler and unfilled templates in place of content.

Labelling functions (response status numbers, phrases of notices, forms of slots, filler) vote on the pieces, lines and
sentences, of a bounded sample of documents. From these weak labels a linear classifier is trained on the driver: softmax
regression with an L2 penalty over hashed runs of two to four characters, the length of a piece and its title (whether the
piece is the title, and whether the title names an error). Every piece of every document is then scored, whole arrays at a
time. Lines that the classifier suspects are checked by the labelling functions; a document is a case if a suspected line
has a slot that no sentence about slots explains, or if notices and filler are most of it, chrome of the page (a title, a row
of links) left out. ``validation`` trains without a fifth of the sources and tells how well their pieces are labelled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineloom.session import settle

from .visible import shown

LABELS = ("text", "slot", "notice", "filler")
#: Documents (about), and pieces of each label, from which is trained; bits of a hashed feature; rounds of training; the L2 penalty.
TRAIN_DOCUMENTS, TRAIN_PIECES, SLOT_BITS, ROUNDS, PENALTY = 20_000, 1500, 15, 120, 1e-5
SLOTS = 1 << SLOT_BITS
#: Share of a text's lines, by characters, that must be notice or filler, the least certainty of a line no phrase decides,
#: and the chance of being no text from which a line is suspected.
MOST, CERTAIN, SUSPECT = 0.5, 0.8, 0.1
#: Of the sources, one in so many is held out for validation.
HELD_OUT = 5

_NAME = r"[\p{L}_][\p{L}\p{N}_. ]{0,40}"
# Forms in which templates name their slots.
_SLOT = regex.compile(
    rf"\{{\{{\s*{_NAME}\}}\}}|｛｛[^｛｝]{{1,40}}｝｝|\$\{{\s*{_NAME}\}}|#\{{\s*{_NAME}\}}|\{{%\s*{_NAME}%\}}|<%=?\s*{_NAME}%>|%\({_NAME}\)s"
    rf"|%%{_NAME}%%|%[A-Za-z_.]{{3,40}}%|###{_NAME}###|<<{_NAME}>>|\$[A-Z_]{{3,40}}\$|__[A-Z_]{{3,40}}__|@[A-Z_]{{3,40}}@|\[\[[A-Z_]{{3,40}}\]\]"
    rf"|\{{[A-Za-z_.]{{3,40}}\}}|【ここに[^【】]*】|〔未設定[^〔〕]*〕|\[[^\[\]]{{1,20}}(?:を入力|请填写|請填寫)\]|【(?:请|請)[^【】]*】|\[(?i:insert|your|enter)\b[^\[\]]*\]|<(?i:your|insert)\b[^<>]{1,40}>|\([A-Z_]{3,40} TO COME\)|（[^（）]{1,12}(?:後日|入力|待补|待補)）|\[object Object\]"
    r"|(?<![\p{Latin}\p{N}])(?:undefined|null|NaN)(?![\p{Latin}\p{N}])",
)
_FIELD = regex.compile(r"^[^：:]{1,16}[：:]\s*(?:N/A|--+|null|undefined|None|TBD|未設定|—+)?\s*$")
# Words of sentences that speak of slots.
_SPOKEN = regex.compile(r"mail merge|template|placeholder(?! copy)|you would (?:type|write)|manual|印刷では|差し込み|のように書く|テンプレート|占位|模板|写作|寫作", regex.I)
# Phrases of notices.
_NOTICE = regex.compile(
    r"^(?:HTTP )?(?:Error )?[45]\d\d(?: エラー| Error| Not Found| Forbidden|$)|^Error [45]\d\d|Access denied|blocked by|could not be (?:located|found)|page you (?:asked|requested|are looking)|^Traceback|KeyError|Exception\b"
    r"|(?:enable|needs?|requires?|turn on) (?:JavaScript|scripting|cookies)|JavaScript (?:is )?(?:disabled|required)|(?:log|sign) ?in to (?:continue|read|view)|try again later|not available in your (?:region|country)|under maintenance|session (?:has )?expired|^Loading"
    r"|お探しのページ|ページが存在しない|ページは見つかり|公開を終了しました|スクリプトが無効|JavaScriptを有効|設定を変更して再読み込み|アクセス権がありません|ログインしてから|この地域からは|メンテナンス中です|^終了予定|URLをご確認|しばらくしてから|(?:クッキー|Cookie)を有効|タイムアウト|サーバーエラー"
    r"|没有访问权限|沒有存取權限|请先登录|請先登入|页面不存在|頁面不存在|找不到(?:您|你)?(?:要|请求)?的?(?:页面|頁面)|启用\s*(?:JavaScript|脚本|Cookie)|啟用\s*(?:JavaScript|腳本|Cookie)|系统维护|系統維護|服务器错误|稍后(?:再试|重试)|稍後再試|已被(?:删除|刪除)|系统繁忙|系統繁忙|错误代码|錯誤代碼"
    r"|^Bad gateway|Too many requests|Service Unavailable|Gateway Time-?out|Internal Server Error|^Forbidden|switch on JavaScript|JavaScript in your browser|NullReference"
    r"|(?:クッキー|Cookie)を有効|セッションの有効期限|ブラウザの(?:スクリプト)?設定|不正なリクエスト|内部エラーが発生|管理者に連絡|(?:取得|表示|読み込み)に失敗しました|タイムアウトしました",
)
# Phrases of filler.
_FILLER = regex.compile(r"Lorem ipsum|(?<!\w)asdf\b|ghjk|\bTBD\.|Body text|テキストテキスト|仮組みです|見本の文です|サンプルの文章|ここに表示されます|ダミー(?:テキスト|の文)|(.)\1{11,}|(?:\bx{3,}\b\W*){2,}|[〇○●]{4,}|示例文字|占位文字|此处为|測試文字|测试文字|いろは見本|仮の文章|後で差し替え|ほげほげ|ふがふが|××××|Your paragraph here|Sample text|Placeholder copy|(?:text|text here)(?:, body text)")
_DIGITS = regex.compile(r"\p{N}+")
_SAID = regex.compile(r"(?:sa(?:id|ys)|笑った|muttered|待つ|taught|wrote|授業|課題|[「『“\"][^」』”\"]*(?:エラー|error)[^」』”\"]*[」』”\"])", regex.I)
_SENTENCE = regex.compile(r"(?<!\.\.)[。．.!?！？…](?!\.)")


def vote(line: str) -> int | None:
    """The label on which the labelling functions agree, or None."""
    slot, field, notice, filler = bool(_SLOT.search(line)), bool(_FIELD.match(line)), bool(_NOTICE.search(line)), bool(_FILLER.search(line))
    found = slot or notice or filler
    if not found and not field and _SENTENCE.search(line):
        return 0
    if _SPOKEN.search(line) or _SAID.search(line):
        return 0 if found or _SENTENCE.search(line) else None
    if notice and filler or field and not slot:
        return None
    # a bare null beside an error, or a slot in filler, belongs to those
    return 2 if notice else 3 if filler else 1 if slot else 0


_TITLE_ERROR = regex.compile(r"(?<!\d)[45]\d\d(?!\d)|error|not found|denied|forbidden|エラー|错误|錯誤", regex.I)
_ENDERS = np.array([ord(c) for c in "。！？!?"], np.uint32)
#: Slots of features that are no runs: classes of length, and those of the title.
_EXTRA = 16


def pieces(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all texts, piece of each, first code point of each piece, text of each piece).

    A piece ends with its line, or with a sign that ends a sentence. Every text is followed by a newline.
    """
    codes = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    if not len(codes):
        return codes, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    lengths = np.array([len(t) + 1 for t in texts])
    begins = np.ones(len(codes), bool)
    ended = (codes[:-1] == 10) | np.isin(codes[:-1], _ENDERS) & ~np.isin(codes[1:], _ENDERS) & (codes[1:] != 10)
    begins[1:] = ended | (codes[:-1] == ord(".")) & (codes[1:] == 32)
    starts = np.flatnonzero(begins)
    owner = np.repeat(np.arange(len(texts)), lengths)[starts]
    return codes, np.cumsum(begins) - 1, starts, owner


def features(codes: np.ndarray, piece: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pieces, slots) of the runs of two, three and four characters of each piece; figures count as one."""
    plain = codes.astype(np.uint64)
    plain[(codes >= 0x30) & (codes <= 0x39) | (codes >= 0xFF10) & (codes <= 0xFF19)] = 0x30
    run = plain.copy()
    with np.errstate(over="ignore"):
        for n in (2, 3, 4):
            if len(run) < 2:
                return
            run = run[:-1] * np.uint64(0x9E3779B97F4A7C15) + plain[n - 1 :]
            inside = piece[: len(run)] == piece[n - 1 :]
            mixed = (run[inside] ^ (run[inside] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            yield piece[: len(run)][inside], (mixed >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def extras(texts: list[str], titles: list[str | None], codes: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pieces, slots) of the features of length and title."""
    if not len(starts):
        return
    size = np.diff(np.append(starts, len(codes)))
    yield np.arange(len(starts)), SLOTS + np.minimum(np.log2(np.maximum(size, 1)).astype(np.int64), 9)
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    named = [bool(t) and x.startswith(t) for x, t in zip(texts, titles, strict=True)]
    wrong = np.array([bool(t) and bool(_TITLE_ERROR.search(t)) for t in titles], bool)
    at = first[np.array(named, bool)[owner[first]]]
    yield at, np.full(len(at), SLOTS + 10)
    at = np.flatnonzero(wrong[owner])
    yield at, np.full(len(at), SLOTS + 11)
    yield first, np.full(len(first), SLOTS + 12)


class Model:
    """The linear classifier: one weight for each feature and label, and for each label alone."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray):
        self.weights, self.bias = weights.astype(np.float32), bias

    def scores(self, texts: list[str], titles: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(chances of each label, first code point within its text, text) of each piece."""
        codes, piece, starts, owner = pieces(texts)
        total, count = np.zeros((len(starts), len(LABELS))), np.ones(len(starts))
        for at, slot in features(codes, piece, starts):
            if len(at):
                # the pieces come in order, so each is one stretch
                first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                total[at[first]] += np.add.reduceat(self.weights[slot], first, axis=0)
                count[at[first]] += np.diff(np.append(first, len(at)))
        total /= np.sqrt(count)[:, None]
        for at, slot in extras(texts, titles, codes, starts, owner):
            total[at] += self.weights[slot]
        total += self.bias
        total = np.exp(total - total.max(axis=1, keepdims=True))
        begin = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))[:-1]
        return total / total.sum(axis=1, keepdims=True), starts - begin[owner], owner


def train(samples: list[tuple[str, str | None, int]]) -> Model:
    """Softmax regression on (piece, title of its text, label) by steps of AdaGrad; labels weigh alike."""
    weights, bias = np.zeros((SLOTS + _EXTRA, len(LABELS))), np.zeros(len(LABELS))
    if not samples:
        return Model(weights, bias)
    # a sample may be parted further; all parts keep its label
    texts, titles, labels = [x for x, _, _ in samples], [t for _, t, _ in samples], np.array([y for *_, y in samples])
    codes, piece, starts, owner = pieces(texts)
    runs = [(owner[at], slot) for at, slot in features(codes, piece, starts)]
    rest = [(owner[at], slot) for at, slot in extras(texts, titles, codes, starts, owner)]
    n = len(texts)
    count = 1.0 + sum(np.bincount(at, minlength=n) for at, _ in runs)
    row = np.concatenate([at for at, _ in (*runs, *rest)])
    slot = np.concatenate([s for _, s in (*runs, *rest)])
    scale = np.concatenate([1 / np.sqrt(count[at]) for at, _ in runs] + [np.ones(len(at)) for at, _ in rest])
    truth = np.eye(len(LABELS))[labels]
    weigh = (truth / np.maximum(truth.sum(axis=0), 1)).sum(axis=1) / (truth.sum(axis=0) > 0).sum()
    seen, seen_bias = np.full(weights.shape, 1e-8), np.full(bias.shape, 1e-8)
    for _ in range(ROUNDS):
        score = np.stack([np.bincount(row, weights[slot, k] * scale, n) for k in range(len(LABELS))], axis=1) + bias
        score = np.exp(score - score.max(axis=1, keepdims=True))
        off = (score / score.sum(axis=1, keepdims=True) - truth) * weigh[:, None]
        step = np.stack([np.bincount(slot, off[row, k] * scale, len(weights)) for k in range(len(LABELS))], axis=1) + PENALTY * weights
        seen += step**2
        weights -= 0.5 * step / np.sqrt(seen)
        seen_bias += (total := off.sum(axis=0)) ** 2
        bias -= 0.5 * total / np.sqrt(seen_bias)
    return Model(weights, bias)


def _samples(df: DataFrame, text: str, title: str, host: str) -> list[tuple[str, str | None, int, bool]]:
    """(piece, title, weak label, whether its source is held out) of about TRAIN_DOCUMENTS documents, taken by hash."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = set()
            for whole, name, out in zip(frame["text"], frame["title"], frame["out"], strict=True):
                whole = shown(whole)
                codes, _, starts, _ = pieces([whole])
                for a, b in zip(starts, np.append(starts[1:], len(codes)), strict=True):
                    part = whole[a:b].strip()
                    if part and len(part) <= 2000 and (y := vote(part)) is not None:
                        rows.add((part, name if a == 0 else None, y, out))
            yield pd.DataFrame(sorted(rows, key=str), columns=["piece", "title", "label", "out"]).astype({"label": "int32", "out": "bool"})

    every = max(1, df.count() // TRAIN_DOCUMENTS)
    taken = df.select(
        F.col(text).cast("string").alias("text"), F.col(title).cast("string").alias("title"), (F.pmod(F.xxhash64(host), F.lit(HELD_OUT)) == 0).alias("out")
    ).filter(F.col("text").isNotNull() & (F.pmod(F.xxhash64("text"), F.lit(every)) == 0))
    found = settle(taken.mapInPandas(run, "piece string, title string, label int, out boolean"), "pieces")
    # the smallest hashes of each label, chosen in every partition before they come together
    once = found.groupBy("piece", "label", "out").agg(F.min("title").alias("title")).withColumn("h", F.xxhash64("piece"))
    rows = []
    for label in range(len(LABELS)):
        rows += once.filter(F.col("label") == label).orderBy("h", "piece", "out").limit(2 * TRAIN_PIECES).collect()
    return [(r["piece"], r["title"], r["label"], r["out"]) for r in rows]


def train_on(df: DataFrame, text: str = "text", title: str = "title", host: str = "source") -> Model:
    """The classifier from the weak labels of a bounded sample of documents."""
    kept: dict[int, list] = {}
    for piece, name, label, _ in _samples(df, text, title, host):
        kept.setdefault(label, []).append((piece, name, label))
    return train([x for k in sorted(kept) for x in kept[k][:TRAIN_PIECES]])


def validation(df: DataFrame, text: str = "text", title: str = "title", host: str = "source") -> list[tuple[str, int, int, int]]:
    """(label, pieces, found, right) for the pieces of held-out sources: how many bear it, were given it, and both."""
    samples = _samples(df, text, title, host)
    known = [(p, t, y) for p, t, y, out in samples if not out]
    unseen = [(p, t, y) for p, t, y, out in samples if out]
    if not known or not unseen:
        return []
    model = train(known)
    chances, _, owner = model.scores([p for p, *_ in unseen], [t for _, t, _ in unseen])
    best = np.zeros((len(unseen), len(LABELS)))
    np.maximum.at(best, owner, chances)
    guess, truth = best.argmax(axis=1), np.array([y for *_, y in unseen])
    return [(name, int((truth == k).sum()), int((guess == k).sum()), int(((truth == k) & (guess == k)).sum())) for k, name in enumerate(LABELS)]


def _judge(text: str, suspects: list[tuple[int, np.ndarray]]) -> str | None:
    """slot, notice or filler if that stands in a text in place of content; ``suspects``: (place, chances) of its suspected pieces."""
    weight = dict.fromkeys(LABELS, 0)
    fields = lines = at = 0
    suspects = sorted(suspects, key=lambda x: x[0])
    k = 0
    for whole in text.split("\n"):
        end, best = at + len(whole), None
        while k < len(suspects) and suspects[k][0] <= end:
            if best is None or suspects[k][1][0] < best[0]:
                best = suspects[k][1]
            k += 1
        at = end + 1
        line = whole.strip()
        if not line:
            continue
        lines += 1
        kind = 0
        if best is not None:
            kind = vote(line)
            if not kind:  # no phrase is known: the classifier decides
                guess = int(best.argmax())
                if kind is None or best[guess] >= CERTAIN and not _SPOKEN.search(line) and not _SAID.search(line):
                    kind = guess
            if kind == 1 and _SLOT.search(line):
                return "slot"
            fields += bool(_FIELD.match(line))
        if kind or _SENTENCE.search(line):
            weight[LABELS[kind]] += len(line)
    if lines and fields * 2 > lines:
        return "slot"
    bad = weight["notice"] + weight["filler"]
    if bad and bad >= MOST * sum(weight.values()):
        return "notice" if weight["notice"] >= weight["filler"] else "filler"
    return None


def judge(texts: list[str | None], titles: list[str | None], model: Model) -> list[str | None]:
    """slot, notice or filler for each text where that stands in place of content, else None. Null and blank texts are None."""
    bare = [shown(t or "") for t in texts]
    chances, place, owner = model.scores(bare, titles)
    suspects: dict[int, list] = {}
    for i in np.flatnonzero(chances[:, 0] <= 1 - SUSPECT):
        suspects.setdefault(int(owner[i]), []).append((int(place[i]), chances[i]))
    return [_judge(t, suspects[i]) if i in suspects else None for i, t in enumerate(bare)]


def empty_texts(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", title: str = "title") -> DataFrame:
    """``doc_id, kind``: the documents without content of their own. Rows of one key count once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            titles = [t if isinstance(t, str) else None for t in frame["title"]]
            texts, rows, begin = frame["text"].tolist(), [], 0
            while begin < len(texts):  # some millions of characters at a time
                end, size = begin, 0
                while end < len(texts) and size < 2_000_000:
                    size += len(texts[end])
                    end += 1
                kinds = judge(texts[begin:end], titles[begin:end], model)
                rows += [(d, k) for d, k in zip(frame["doc_id"].iloc[begin:end], kinds, strict=True) if k]
                begin = end
            yield pd.DataFrame(rows, columns=["doc_id", "kind"]).astype({"doc_id": "int64"})

    taken = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(title).cast("string").alias("title"))
    return taken.filter("doc_id is not null and text is not null").mapInPandas(run, "doc_id long, kind string").dropDuplicates(["doc_id"])
