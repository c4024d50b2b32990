"""Problem 8: texts put into containers of a fixed number of tokens (after Martello and Toth).

A text longer than a container is cut into pieces at characters, all but its last one filling a container of
their own. Texts are spread by hash over groups of a bounded number, each packed by itself: the reduction
procedure fixes a container where one set of at most three texts dominates all others with its largest text;
every other container takes the largest text left and the completion that leaves least space, found by a
subset sum over bits. Texts of containers that stay below ``FULL`` of a first round are gathered and packed again.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineloom.session import settle

#: Texts that are packed together, texts among which a completion is searched, and the share from which a container is full.
GROUP_TEXTS, SEARCHED, FULL = 4096, 48, 0.98


def lower_bound(sizes: list[int], capacity: int) -> int:
    """The bound L2 of Martello and Toth on the number of containers."""
    if not sizes:
        return 0
    sizes = sorted(sizes)
    best = -(-sum(sizes) // capacity)
    sums = [0]
    for s in sizes:
        sums.append(sums[-1] + s)
    half = bisect_right(sizes, capacity // 2)
    for k in sorted({s for s in sizes[:half]} | {0}):
        big = bisect_right(sizes, capacity - k)  # sizes above capacity - k stand alone
        middle = big - half
        first = next((i for i in range(half) if sizes[i] >= k), half)
        free = middle * capacity - (sums[big] - sums[half])
        best = max(best, len(sizes) - half + max(0, -(-(sums[half] - sums[first] - free) // capacity)))
    return best


def _completion(sizes: list[int], room: int) -> list[int]:
    """Places (in the ascending ``sizes``) of some texts that fill ``room`` best, among those searched."""
    fits = bisect_right(sizes, room)
    step = max(1, fits // SEARCHED)
    places = list(range(fits - 1, -1, -step))[:SEARCHED]
    mask, reach, states = (1 << (room + 1)) - 1, 1, []
    for p in places:
        states.append(reach)
        reach |= (reach << sizes[p]) & mask
        if reach >> room & 1:
            break
    total, taken = reach.bit_length() - 1, []
    for p, before in zip(reversed(places[: len(states)]), reversed(states), strict=True):
        if not before >> total & 1:
            taken.append(p)
            total -= sizes[p]
    return taken


def pack(items: list[tuple[int, int]], capacity: int) -> list[list[int]]:
    """Containers of the numbers of ``items`` (size, number); every size is at most ``capacity``."""
    left = sorted(items)
    out = []
    while left:
        size, number = left.pop()
        room, held = capacity - size, [number]
        fits = bisect_right(left, room, key=lambda x: x[0])
        if fits:
            # a text that fits exactly, or the largest where no two fit beside, dominates all completions
            if left[fits - 1][0] == room or fits == 1 or left[0][0] + left[1][0] > room:
                held.append(left.pop(fits - 1)[1])
            else:
                for p in sorted(_completion([s for s, _ in left[:fits]], room), reverse=True):
                    held.append(left[p][1])
                    room -= left.pop(p)[0]
                while (fits := bisect_right(left, room, key=lambda x: x[0])) > 0:
                    room -= left[fits - 1][0]
                    held.append(left.pop(fits - 1)[1])
        out.append(held)
    return out


def token_pieces(text: str, capacity: int) -> list[tuple[int, int, int]]:
    """(first character, characters, tokens) of the pieces of a text: one token per byte of UTF-8 and one for the end."""
    if len(text.encode("utf-8", "surrogatepass")) + 1 <= capacity:
        return [(0, len(text), len(text.encode("utf-8", "surrogatepass")) + 1)]
    out, begin, used = [], 0, 1
    for at, c in enumerate(text):
        n = 1 if c < "\x80" else 2 if c < "ࠀ" else 3 if c < "\U00010000" else 4
        if used + n > capacity:
            out.append((begin, at - begin, used))
            begin, used = at, 1
        used += n
    return [*out, (begin, len(text) - begin, used)]


_ITEM = "pack_id int, capacity long, doc_id long, piece int, first_char long, n_chars long, tokens long"


def _packed(items: DataFrame, salt: str) -> DataFrame:
    """The items with ``container`` (a name unique within the pack) and ``fill``, group by group."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "piece"]).reset_index(drop=True)
        capacity, group = int(frame["capacity"].iloc[0]), int(frame["grp"].iloc[0])
        sizes = frame["tokens"].tolist()
        name, fill = [""] * len(frame), [0.0] * len(frame)
        for k, held in enumerate(pack([(s, i) for i, s in enumerate(sizes)], capacity)):
            share = sum(sizes[i] for i in held) / capacity
            for i in held:
                name[i], fill[i] = f"{salt}{group}-{k}", share
        return frame.drop(columns="grp").assign(container=name, fill=fill)

    count = items.groupBy("pack_id").agg(F.ceil(F.count("*") / GROUP_TEXTS).alias("groups"))
    spread = items.join(F.broadcast(count), "pack_id").withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece"), F.col("groups"))).drop("groups")
    return spread.groupBy("pack_id", "grp").applyInPandas(run, _ITEM + ", container string, fill double")


def pack_documents(df: DataFrame, packs: DataFrame) -> DataFrame:
    """``pack_id, capacity, container, doc_id, piece, first_char, n_chars, tokens``: each text of each pack exactly once.

    Rows of one ``doc_id`` count once; a null text has one token. A text is cut only if it alone exceeds the
    capacity. An empty table gives no rows.
    """
    sizes = [(int(r[0]), int(r[1])) for r in packs.select("pack_id", "capacity").distinct().collect()]
    if any(c < 5 for _, c in sizes):
        raise ValueError("a container must hold at least one character and the end")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, text in zip(frame["doc_id"], frame["text"], strict=True):
                for pack_id, capacity in sizes:
                    for piece, (first, chars, tokens) in enumerate(token_pieces(text or "", capacity)):
                        rows.append((pack_id, capacity, doc, piece, first, chars, tokens))
            yield pd.DataFrame(rows, columns=["pack_id", "capacity", "doc_id", "piece", "first_char", "n_chars", "tokens"])

    taken = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = taken.filter("doc_id is not null").dropDuplicates(["doc_id"]).mapInPandas(cut, _ITEM)
    once = settle(_packed(settle(items, "items"), "a"), "packed")
    again = _packed(settle(once.filter(F.col("fill") < FULL).drop("container", "fill"), "again"), "b")
    return once.filter(F.col("fill") >= FULL).unionByName(again).drop("fill")


def packed_totals(packed: DataFrame) -> DataFrame:
    """``pack_id, capacity, documents, chars, cut, over, containers``: what the containers of each pack hold together.

    ``cut``: texts in several pieces; ``over``: containers above their capacity, which must be 0.
    """
    texts = packed.groupBy("pack_id", "capacity", "doc_id").agg(F.sum("n_chars").alias("chars"), F.count("*").alias("pieces"))
    whole = texts.groupBy("pack_id", "capacity").agg(F.count("*").alias("documents"), F.sum("chars").alias("chars"), F.count_if(F.col("pieces") > 1).alias("cut"))
    held = packed.groupBy("pack_id", "capacity", "container").agg(F.sum("tokens").alias("tokens"))
    full = held.groupBy("pack_id").agg(F.count_if(F.col("tokens") > F.col("capacity")).alias("over"), F.count("*").alias("containers"), F.sum("tokens").alias("tokens"))
    return whole.join(full, "pack_id")
