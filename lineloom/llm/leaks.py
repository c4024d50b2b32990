"""Problem 9: passages of held-out tests that stand in documents, found by winnowing.

Texts are reduced to letters and digits of one width and case. Of the hashes of all runs of ``k`` characters the
least one in each window is kept (winnowing), so a common stretch of ``k + w - 1`` characters shares one. A document
that shares kept hashes with a passage is then compared wholly: a place of the passage counts as held if a run
around it stands in the document, or if it lies in a short gap between two such runs that are as far apart there.
Runs that stand in several passages (instructions, set phrases) say nothing and are left out on both sides.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .visible import words_only

#: Characters of a run and hashes of a window, for writing without and with spaces.
SHAPES = {"wide": (5, 4), "narrow": (10, 6)}
#: Different passages in which a run may stand to tell of one, and the longest gap that a changed word makes, in characters.
TELLING, GAP = 2, 12
#: Share of a passage that a document must hold.
HELD = 0.5
#: Characters of all passages together, up to which they may go to every worker.
PASSAGE_CHARS = 20_000_000
_WIDE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}ー]")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def run_hashes(text: str, k: int) -> np.ndarray:
    """The hash of the run of ``k`` characters at each place."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * _BASE + codes[j : j + n]
        out ^= out >> np.uint64(31)
        return out * np.uint64(0xBF58476D1CE4E5B9)


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """The least hash of every window of ``w``, once each."""
    if len(hashes) <= w:
        return np.unique(hashes.min(keepdims=True)) if len(hashes) else hashes
    return np.unique(np.lib.stride_tricks.sliding_window_view(hashes, w).min(axis=1))


class Passages:
    """The passages, what is told by each run of them, and the fingerprints by which they are found."""

    def __init__(self, items: list[tuple[int, str | None]]):
        heads: dict[str, set[str]] = defaultdict(set)
        for _, p in items:
            first, _, rest = (p or "").strip().partition("\n")
            if rest:
                heads[words_only(first)].add(words_only(rest))
        self.items: dict[str, list[int]] = defaultdict(list)
        for number, p in items:
            first, _, rest = (p or "").strip().partition("\n")
            key = words_only(rest if rest and len(heads[words_only(first)]) > TELLING else p or "")
            if key:
                self.items[key].append(number)
        self.texts = list(self.items)
        self.shape = ["wide" if len(_WIDE.findall(t)) * 3 > len(t) else "narrow" for t in self.texts]
        self.runs, self.tells, self.prints = [], [], {s: defaultdict(list) for s in SHAPES}
        known = {s: defaultdict(set) for s in SHAPES}
        for i, (text, shape) in enumerate(zip(self.texts, self.shape, strict=True)):
            self.runs.append(run_hashes(text, SHAPES[shape][0]))
            for h in self.runs[-1].tolist():
                known[shape][h].add(i)
        for i, (hashes, shape) in enumerate(zip(self.runs, self.shape, strict=True)):
            tells = np.array([len(known[shape][h]) <= TELLING for h in hashes.tolist()], bool)
            self.tells.append(tells if tells.any() else np.ones(len(hashes), bool))
            # all runs that tell are looked up; the document's side is winnowed
            for h in np.unique(hashes[self.tells[-1]]).tolist():
                self.prints[shape][h].append(i)
        self.sorted = {s: np.array(sorted(self.prints[s]), np.uint64) for s in SHAPES}

        self.asked = []
        for shape, tells, text in zip(self.shape, self.tells, self.texts, strict=True):
            asked = np.zeros(len(text), bool)
            for p in np.flatnonzero(tells):
                asked[p : p + SHAPES[shape][0]] = True
            self.asked.append(int(asked.sum()))

    def _known(self, hashes: np.ndarray, shape: str) -> np.ndarray:
        known = self.sorted[shape]
        return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes

    def held(self, i: int, places: dict[int, list[int]]) -> float:
        """The share of passage ``i`` that a document holds: ``places`` has the places of each of its runs."""
        k, hashes, tells = SHAPES[self.shape[i]][0], self.runs[i], self.tells[i]
        asked = np.zeros(len(self.texts[i]), bool)
        for p in np.flatnonzero(tells):
            asked[p : p + k] = True
        found = np.zeros(len(asked), bool)
        last: dict[int, int] = {}  # end in the passage of the newest run, by its distance from the document's place
        for p in np.flatnonzero(tells).tolist():
            for q in places.get(int(hashes[p]), ()):
                found[p : p + k] = True
                for d in range(-4, 5):
                    end = last.get(q - p + d)
                    if end is not None and 0 < p - end <= GAP:
                        found[end:p] = True
                last[q - p] = p + k
        return float((found & asked).sum() / max(asked.sum(), 1))

    def search(self, text: str) -> Iterator[tuple[int, float]]:
        """(item, share) of the passages of which a text may hold half."""
        bare = words_only(text)
        for shape, (k, w) in SHAPES.items():
            hashes = run_hashes(bare, k)
            if not len(hashes) or not len(self.sorted[shape]):
                continue
            kept = winnow(hashes, w)
            kept = kept[self._known(kept, shape)]
            if not len(kept):
                continue
            near = {i for h in kept.tolist() for i in self.prints[shape][h]}
            places: dict[int, list[int]] = defaultdict(list)
            at = np.flatnonzero(self._known(hashes, shape))
            for q, h in zip(at.tolist(), hashes[at].tolist(), strict=True):
                places[h].append(q)
            runs = Counter(i for h in places for i in self.prints[shape][h])
            for i in sorted(near):
                if runs[i] * (k + GAP) < HELD * self.asked[i]:  # even with every gap filled it is not half
                    continue
                share = self.held(i, places)
                for number in self.items[self.texts[i]]:
                    yield number, share


def leaked_items(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, item_id, held``: the documents that hold at least half of a passage. Rows of one key count once.

    Null and empty texts and passages hold nothing. The passages go to every worker: more than PASSAGE_CHARS of them
    are refused, not cut; give them in several calls.
    """
    size = items.agg(F.sum(F.length("passage")).alias("n")).first()["n"] or 0
    if size > PASSAGE_CHARS:
        raise ValueError(f"{size} characters of passages, more than {PASSAGE_CHARS}")
    passages = Passages([(int(r[0]), r[1]) for r in items.select("item_id", "passage").filter("item_id is not null").distinct().collect()])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(d, i, s) for d, t in zip(frame["doc_id"], frame["text"], strict=True) if t for i, s in passages.search(t) if s >= HELD]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "held"]).astype({"doc_id": "int64", "item_id": "int64", "held": "float64"})

    taken = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter("doc_id is not null and text is not null")
    return taken.mapInPandas(run, "doc_id long, item_id long, held double").dropDuplicates(["doc_id", "item_id"])
