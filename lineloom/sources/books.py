"""E-books: the container, the order of pages, the table of contents, and the sentences of each chapter."""

from __future__ import annotations

import io
import posixpath
import zipfile
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineloom.functions.rewrite import book_marks
from lineloom.functions.titles import title_and_author

_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 div ul ol blockquote li dt dd table tr td th section article aside header footer nav figure figcaption pre hr form fieldset address main body".split())
_DROPPED = frozenset("script style svg audio video head".split())
#: Algorithms that only hide fonts, and the endings of what a book's text is made of.
_FONT_ONLY = ("http://www.idpf.org/2008/embedding", "http://ns.adobe.com/pdf/enc#RC")
_CONTENT = (".xhtml", ".html", ".htm", ".ncx", ".opf")
_GENERIC = frozenset("image img figure fig picture photo illustration イラスト 写真 挿絵 ロゴ logo icon spacer dummy cover page".split())


def generic_alt(alt: str) -> bool:
    """Whether the text in place of an image says nothing: empty, the name of a file or a kind, or long."""
    core = regex.sub(r"^[（(［\[【〔〈《「『\s]+|[）)］\]】〕〉》」』\s]+$", "", alt.strip().lower())
    return bool(
        not core or core in _GENERIC or len(alt.strip()) > 30 or regex.match(r"(?:fig|figure|image|img|photo|page)[\s_\-.:\d]", core)
        or regex.search(r"\.(?:png|jpe?g|gif|webp|svg|bmp)$", core) or regex.fullmatch(r"[a-z]{3,}(?:[_-][a-z]+)*[_-]?\d+[a-z]?", core)
        or regex.search(r"(?:画像|表紙|大?扉|^挿絵|^イラスト|^代替テキスト)[\s　]*[0-9０-９]*$", core)
    )


class _Page(HTMLParser):
    """Blocks of a page: (tag, text with ruby in bar notation, lines at <br>, share of text in links, anchors before it)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[dict] = []
        self.stack: list[str] = []
        self.skip = 0
        self.ruby: list[list[str]] | None = None
        self.reading = self.hidden = self.link = 0
        self.ids: list[str] = []
        self._new("p")

    def _new(self, tag: str) -> None:
        self.now = {"tag": tag, "parts": [""], "linked": [0], "ids": self.ids}
        self.ids = []
        self.blocks.append(self.now)

    def _add(self, text: str) -> None:
        self.now["parts"][-1] += text
        if self.link:
            self.now["linked"][-1] += len(text.strip())

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if given.get("id"):
            self.ids.append(given["id"])
        if tag in _DROPPED:
            self.skip += 1
        elif self.skip:
            return
        elif tag == "ruby":
            self.ruby = [[], []]
        elif tag == "rt":
            self.reading += 1
        elif tag == "rp":
            self.hidden += 1
        elif tag == "a":
            self.link += 1
        elif tag == "br":
            self.now["parts"].append("")
            self.now["linked"].append(0)
        elif tag == "img":
            alt = (given.get("alt") or "").strip()
            if not generic_alt(alt):
                self.handle_data(alt)
            elif self.ruby is not None or self.now["parts"][-1].strip():
                self.handle_data("〓")
        elif tag in _BLOCKS:
            self._new(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in _DROPPED:
            self.skip -= 1

    def handle_endtag(self, tag):
        if tag in _DROPPED:
            self.skip = max(0, self.skip - 1)
        elif self.skip:
            return
        elif tag == "rt":
            self.reading = max(0, self.reading - 1)
        elif tag == "rp":
            self.hidden = max(0, self.hidden - 1)
        elif tag == "a":
            self.link = max(0, self.link - 1)
        elif tag == "ruby" and self.ruby is not None:
            base, said = ("".join(p).strip() for p in self.ruby)
            self.ruby = None
            self._add(f"｜{base}({said})" if base and said else base or said)
        elif tag in _BLOCKS:
            self._new("p")

    def handle_data(self, data):
        if self.skip or self.hidden:
            return
        if self.ruby is not None:
            self.ruby[1 if self.reading else 0].append(data.strip())
        else:
            self._add(regex.sub(r"[\n\r\t]+", "", data))


def html_blocks(text: str) -> list[dict]:
    """``tag, text, ids`` of the blocks of a page that hold text. Lines at <br> are joined, but for lines of speech, each in its
    quotes, lists of links and code."""
    page = _Page()
    page.feed(text)
    page.close()
    out = []
    for block in page.blocks:
        rows = [(p.strip(" \t"), n) for p, n in zip(block["parts"], block["linked"], strict=True) if p.strip()]
        if not rows:
            if out and block["ids"]:
                out[-1].setdefault("after", []).extend(block["ids"])
            elif block["ids"]:
                page.blocks[0].setdefault("lost", []).extend(block["ids"])
            continue
        contents = sum(n >= len(p) for p, n in rows)
        whole = [rows[0][0]]
        for (before, _), (row, _) in zip(rows, rows[1:], strict=False):
            speech = before[-1:] in "」』" and row[:1] in "「『"
            code = regex.search(r"[;{}]$|^#include", before) and sum(c < "\x80" for c in before) > 0.6 * len(before)
            if speech or code or contents >= 3 and contents * 2 >= len(rows):
                whole.append(row)
            else:
                whole[-1] += row
        for k, row in enumerate(whole):
            out.append({"tag": block["tag"], "text": row, "ids": block["ids"] if not k else []})
    return out


def html_text(text: str) -> str:
    """The text of a page with ruby in bar notation, a line per block."""
    return "\n".join(b["text"] for b in html_blocks(text))


def sentences(text: str) -> list[tuple[str, bool]]:
    """(sentence, whether it is speech that follows speech) of a paragraph.

    A sentence ends with 。！？ outside brackets, and after a closing quote whose speech ended, where another quote opens next.
    """
    out, begin, depth, speech = [], 0, 0, False
    for i, char in enumerate(text):
        if char in "「『（(":
            depth += 1
        cut = follows = False
        if char in "」』）)" and depth:
            depth -= 1
            rest = text[i + 1 :].lstrip(" 　")
            cut = follows = not depth and char in "」』" and i > begin and text[i - 1] in "。！？!?…‥―─" and rest[:1] in ("「", "『")
        elif char in "。！？!?" and not depth:
            cut = True
        if cut:
            piece = text[begin : i + 1].strip()
            if piece:
                out.append((piece, speech))
            begin, speech = i + 1, follows
    last = text[begin:].strip()
    return [*out, (last, speech)] if last else out


def locked(raw: bytes) -> bool:
    """Whether text of a book is encrypted; hidden fonts alone are not."""
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            root = ElementTree.fromstring(z.read("META-INF/encryption.xml"))
    except (KeyError, zipfile.BadZipFile, ElementTree.ParseError):
        return False
    for data in root.iter():
        if data.tag.endswith("}EncryptedData"):
            method = next((e.get("Algorithm") for e in data.iter() if e.tag.endswith("}EncryptionMethod")), None)
            parts = [unquote(e.get("URI") or "").lower() for e in data.iter() if e.tag.endswith("}CipherReference")]
            if method not in _FONT_ONLY and any(p.endswith(_CONTENT) for p in parts):
                return True
    return False


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


class _Contents(HTMLParser):
    """(depth, href, label) of the links in nested lists."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.toc, self.href, self.label, self.found = 0, 0, None, "", []

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag == "nav" and (given.get("epub:type") in (None, "toc") or given.get("id") == "toc"):
            self.toc += 1
        elif tag == "ol":
            self.depth += 1
        elif tag in ("a", "span") and self.toc and self.depth:
            self.href, self.label = given.get("href", ""), ""

    def handle_endtag(self, tag):
        if tag == "nav":
            self.toc = max(0, self.toc - 1)
        elif tag == "ol":
            self.depth -= 1
        elif tag in ("a", "span") and self.href is not None:
            self.found.append((self.depth, self.href, self.label.strip()))
            self.href = None

    def handle_data(self, data):
        if self.href is not None:
            self.label += data


def contents(read, names: list[str], manifest: dict[str, tuple[str, str, str]], base: str) -> list[tuple[str, str, str]]:
    """(page, anchor, label) in order from the navigation document, else the NCX, else a page of three links or more; labels of
    parts stand before those within them, with a bar between."""
    found: list[tuple[int, str, str]] = []
    home = base
    nav = next((h for h, kind, properties in manifest.values() if "nav" in properties.split()), None)
    ncx = next((h for h, kind, _ in manifest.values() if kind == "application/x-dtbncx+xml"), None)
    if nav:
        parser = _Contents()
        parser.feed(read(posixpath.join(base, nav)))
        found, home = parser.found, posixpath.dirname(posixpath.join(base, nav))
    if not found and ncx:
        home = posixpath.dirname(posixpath.join(base, ncx))

        def walk(node, depth):
            for child in node:
                if _local(child.tag) == "navPoint":
                    label = "".join(t.text or "" for t in child.iter() if _local(t.tag) == "text" and t in [x for y in child if _local(y.tag) == "navLabel" for x in y.iter()])
                    src = next((c.get("src", "") for c in child if _local(c.tag) == "content"), "")
                    found.append((depth, src, label.strip()))
                    walk(child, depth + 1)

        root = ElementTree.fromstring(read(posixpath.join(base, ncx)).encode())
        for node in root.iter():
            if _local(node.tag) == "navMap":
                walk(node, 1)
    out, parts = [], {}
    for depth, href, label in found:
        parts = {d: x for d, x in parts.items() if d < depth} | {depth: label}
        path, _, anchor = href.partition("#")
        above = [x for d, x in sorted(parts.items()) if x]
        named = "｜".join(dict.fromkeys(above))
        if path:
            out.append((posixpath.normpath(posixpath.join(home, unquote(path))), anchor, named))
    return out


_CHAPTER = regex.compile(r"(?:第\s*[0-9０-９一二三四五六七八九十百]+\s*[部巻篇章話回幕節課]|[0-9０-９]+\s*章|プロローグ|エピローグ|序章|終章|幕間|あとがき|まえがき|目次)")


def is_heading(tag: str, text: str) -> bool:
    """Whether a block names a chapter."""
    bare = regex.sub(r"｜([^｜()]+)\([^()]*\)", r"\1", text.strip())
    if tag in ("td", "th") or not bare or len(bare) > 40 or regex.match("[「『（【※・…―]", bare) or regex.search("[。？！]|について|による|から|における", bare):
        return False
    return bool(_CHAPTER.match(bare))


def read_book(raw: bytes, path: str = "") -> dict:
    """``title, author, chapters`` of an e-book; each chapter is ``(label, sentences)``.

    A chapter begins where the table of contents points, or, in pages that it does not name, at a block that names one; its
    label is carried on over pages. Of neighbouring equal sentences the first stays, unless they are speech. A chapter that
    holds only its own title is left out. Raises ValueError for what is no book, and for one that is locked.
    """
    if locked(raw):
        raise ValueError("drm")
    try:
        z = zipfile.ZipFile(io.BytesIO(raw))
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf_path = next(e.get("full-path") for e in container.iter() if _local(e.tag) == "rootfile")
        opf = ElementTree.fromstring(z.read(opf_path))
    except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError) as error:
        raise ValueError("no book") from error
    base = posixpath.dirname(opf_path)
    read = lambda name: z.read(name).decode("utf-8", "replace")
    meta = {_local(e.tag): (e.text or "").strip() for e in reversed(list(opf.iter())) if _local(e.tag) in ("title", "creator")}
    manifest = {e.get("id"): (e.get("href", ""), e.get("media-type", ""), e.get("properties") or "") for e in opf.iter() if _local(e.tag) == "item"}
    spine = [manifest[e.get("idref")][0] for e in opf.iter() if _local(e.tag) == "itemref" and e.get("idref") in manifest]
    names = z.namelist()
    title, author = title_and_author(path or "book.epub", meta.get("title"), meta.get("creator"))
    begins: dict[str, list[tuple[str, str]]] = {}
    for page, anchor, label in contents(read, names, manifest, base):
        begins.setdefault(page, []).append((anchor, label))
    chapters: list[tuple[str, list[str]]] = [("", [])]
    last = None
    for href in spine:
        page = posixpath.normpath(posixpath.join(base, unquote(href)))
        if page not in names:
            continue
        own = begins.get(page, [])
        anchors = {a: x for a, x in own if a}
        if whole := [x for a, x in own if not a]:
            chapters.append((whole[0], []))
        for block in html_blocks(read(page)):
            for anchor in block["ids"]:
                if anchor in anchors:
                    chapters.append((anchors[anchor], []))
            if not own and is_heading(block["tag"], block["text"]):
                chapters.append((block["text"].strip(), []))
                continue
            for sentence, speech in sentences(block["text"]):
                line = book_marks(sentence)
                if line and not (line == last and not speech):
                    chapters[-1][1].append(line)
                last = line
    squeeze = lambda x: regex.sub(r"[\s　｜]", "", x)
    kept = [(label or title, lines) for label, lines in chapters if lines and not (len(lines) == 1 and squeeze(lines[0]) == squeeze(label))]
    return {"title": title, "author": author, "chapters": kept}


def read_books(files: DataFrame) -> DataFrame:
    """``relpath, title, author, chapter, label, place, line, fault`` of e-books (``relpath, content``); one without a sentence has one
    row that names its fault: drm, image_only or unreadable."""

    def run(frames):
        columns = ["relpath", "title", "author", "chapter", "label", "place", "line", "fault"]
        for frame in frames:
            rows = []
            for path, raw in zip(frame["relpath"], frame["content"], strict=True):
                try:
                    book = read_book(bytes(raw), path)
                    found = [(path, book["title"], book["author"], c, label, p, line, None) for c, (label, lines) in enumerate(book["chapters"]) for p, line in enumerate(lines)]
                    rows += found or [(path, book["title"], book["author"], None, None, None, None, "image_only")]
                except (ValueError, TypeError) as error:
                    rows.append((path, None, None, None, None, None, None, "drm" if str(error) == "drm" else "unreadable"))
            yield pd.DataFrame(rows, columns=columns).astype({"chapter": "Int32", "place": "Int32"})

    return files.select("relpath", "content").mapInPandas(run, "relpath string, title string, author string, chapter int, label string, place int, line string, fault string")


def chapter_rows(books: DataFrame) -> DataFrame:
    """Rows of an index from ``read_books``: ``file`` is the title and the numbered chapter with a backslash between."""
    file = F.concat(F.col("title"), F.lit("\\"), F.lpad((F.col("chapter") + 1).cast("string"), 2, "0"), F.lit("."), F.col("label"))
    return books.filter("fault is null").select(file.alias("file"), F.col("title").alias("folder"), "relpath", "place", "line")
