"""Scanned pages with recognised boxes: order of reading, ruby beside words, doubles."""

from __future__ import annotations

import json
from statistics import median

import pandas as pd
import regex
from pyspark.sql import DataFrame

from lineloom.functions.rewrite import page_marks
from lineloom.functions.ruby import unfuse
from lineloom.functions.script import to_hiragana

#: The overlap from which two boxes of one text are doubles.
DOUBLE = 0.5
_KANA_BOX = regex.compile("[ぁ-ゖァ-ヶー]{2,}")


def _box(block: dict) -> list[float]:
    box = block.get("box") or []
    return box if len(box) == 4 else [0, 0, 0, 0]


def box_overlap(a, b) -> float:
    """Intersection over union of two boxes."""
    width, height = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if width <= 0 or height <= 0:
        return 0.0
    return width * height / max(1, (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - width * height)


def _bands(boxes: list, low: int, high: int) -> list[list]:
    """Boxes parted where a gap runs through all of them."""
    out: list[list] = []
    end = None
    for box in sorted(boxes, key=lambda b: b[0][low]):
        if end is None or box[0][low] >= end:
            out.append([])
            end = box[0][high]
        out[-1].append(box)
        end = max(end, box[0][high])
    return out


def _ordered(boxes: list) -> list:
    """Bands from the top; within one, columns from the right; what no gap parts from the right edge, then from the top."""
    if len(boxes) < 2:
        return boxes
    rows = _bands(boxes, 1, 3)
    if len(rows) > 1:
        return [b for row in rows for b in _ordered(row)]
    columns = _bands(boxes, 0, 2)
    if len(columns) > 1:
        return _ordered(columns[-1]) + _ordered([b for c in columns[:-1] for b in c])
    return sorted(boxes, key=lambda b: (-b[0][2], b[0][1]))


def reading_order(page: dict) -> list[dict]:
    """The blocks of a page as they are read: a page wider than high is two, the right one first."""
    boxes = [(_box(b), k) for k, b in enumerate(page.get("blocks") or [])]
    width, height = page.get("img_width") or 0, page.get("img_height") or 0
    halves = [boxes]
    if width > height:
        right = [b for b in boxes if (b[0][0] + b[0][2]) / 2 >= width / 2]
        halves = [right, [b for b in boxes if b not in right]]
    return [page["blocks"][k] for half in halves for _, k in _ordered(half)]


def attach_ruby(page: dict, pairs: frozenset[tuple[str, str]]) -> dict[int, str]:
    """The text of each block (by ``id``) with the reading of a small box of kana over the one known word in a large box beside it."""
    blocks = page.get("blocks") or []
    texts = {id(b): "".join(b.get("lines") or []).strip() for b in blocks}
    sizes = [b["font_size"] for b in blocks if b.get("font_size")]
    middle = median(sizes) if sizes else 0
    for small in blocks:
        size, text = small.get("font_size") or 0, texts[id(small)]
        if not size or size > 0.62 * middle or not _KANA_BOX.fullmatch(text):
            continue
        x1, y1, x2, y2 = _box(small)
        hits = []
        for large in blocks:
            wide = large.get("font_size") or 0
            if wide < 1.6 * size or bool(large.get("vertical")) != bool(small.get("vertical")):
                continue
            a, c, d, e = _box(large)
            shared, gap = ((min(y2, e) - max(y1, c)) / max(1, y2 - y1), x1 - d) if small.get("vertical") else ((min(x2, d) - max(x1, a)) / max(1, x2 - x1), c - y2)
            if shared >= 0.6 and -size <= gap <= 1.2 * wide:
                hits += [(large, base) for base, reading in pairs if len(base) > 1 and to_hiragana(text) == to_hiragana(reading) and texts[id(large)].count(base) == 1]
        if len(hits) == 1:
            large, base = hits[0]
            texts[id(large)] = texts[id(large)].replace(base, f"｜{base}({text})")
            texts[id(small)] = ""
    return texts


def volume_lines(doc: dict, pairs: frozenset[tuple[str, str]] = frozenset()) -> list[tuple[int, str]]:
    """(page from 1, text) of a volume in the order of reading; of doubled boxes the longer text, at the first's place."""
    out: list[tuple[int, str]] = []
    for number, page in enumerate(doc.get("pages") or [], 1):
        texts, kept = attach_ruby(page, pairs), []
        for block in reading_order(page):
            raw = texts[id(block)]
            if block.get("vertical"):
                raw = regex.sub("(?<![0-9A-Za-z０-９Ａ-Ｚａ-ｚ])：(?![0-9A-Za-z０-９Ａ-Ｚａ-ｚ])", "…", raw)
            text = unfuse(page_marks(raw), pairs)
            if not regex.search(r"\w", text):
                continue
            key = regex.sub(r"[．…ー～―\s]", "", text)
            twin = next((at for box, k, at in kept if k == key and box_overlap(box, _box(block)) >= DOUBLE), None)
            if twin is not None:
                out[twin] = (number, max(out[twin][1], text, key=len))
                continue
            kept.append((_box(block), key, len(out)))
            out.append((number, text))
    return out


def volume_name(path: str, title: str | None) -> tuple[str, str, str]:
    """(series, volume, file) of a volume from its path, or its own title where it lies in no folder."""
    parts = regex.split(r"[\\/]", regex.sub(r"(?i)\.mokuro$", "", path))
    series = (title or "").strip() or parts[0] if len(parts) == 1 else parts[0]
    volume = parts[0] if len(parts) == 1 else "｜".join(parts[1:])
    return series, volume, f"{series}\\{volume}"


def read_volumes(files: DataFrame, pairs: frozenset[tuple[str, str]] = frozenset()) -> DataFrame:
    """``relpath, series, volume, file, page, place, line, fault`` of volumes in JSON (``relpath, content``)."""

    def run(frames):
        for frame in frames:
            rows = []
            for path, raw in zip(frame["relpath"], frame["content"], strict=True):
                try:
                    doc = json.loads(bytes(raw).decode("utf-8-sig"))
                    if not isinstance(doc, dict) or not isinstance(doc.get("pages"), list):
                        raise ValueError("no pages")
                    rows += [(path, *volume_name(path, doc.get("title")), page, k, line, None) for k, (page, line) in enumerate(volume_lines(doc, pairs))]
                except (ValueError, TypeError, AttributeError):
                    rows.append((path, None, None, None, None, None, None, "unreadable"))
            yield pd.DataFrame(rows, columns=["relpath", "series", "volume", "file", "page", "place", "line", "fault"]).astype({"page": "Int32", "place": "Int32"})

    return files.select("relpath", "content").mapInPandas(run, "relpath string, series string, volume string, file string, page int, place int, line string, fault string")
