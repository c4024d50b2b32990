"""Problem 6: formatting syntax left in lines of text, and clean text that keeps its structure.

A line is read by one pattern for the syntax of HTML, Markdown, wiki text, LaTeX and subtitle styling. The lines of one
document are read as a tree: document, sections by heading, and below them lists, tables, quotes, code and paragraphs. A
paragraph passes points for its length and its commas to the container it stands in and half of them to the section, less
its share of linked text. The best section and those siblings whose points come near it are the content; the rest
(navigation, link lists) is marked.

What a line is by itself is found line by line, without moving it. What depends on the lines before it (inside code, number
of the section, of the container) is a running value within the document, and points are sums by container and section, so
a document of any length is spread over many tasks.
"""

from __future__ import annotations

import html
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineloom.operators.running import running
from lineloom.session import settle

from .garbled import repair
from .visible import shown

# Element names of HTML, WebVTT and wiki extensions.
TAGS = (
    "a abbr acronym address article aside audio b base bdi bdo big blockquote body br button c canvas caption center cite code col "
    "colgroup dd del details dfn div dl dt em embed fieldset figcaption figure font footer form frame gallery h1 h2 h3 h4 h5 h6 "
    "head header hr html i iframe img input ins kbd label lang li link main map mark math menu meta mfrac mi mn mo mrow msub msup "
    "nav noscript nowiki object ol option p param poem pre q rb ref references rp rt rtc ruby s samp script section select small "
    "source span strike strong style sub summary sup svg syntaxhighlight table tbody td template textarea tfoot th thead time title "
    "tr tt u ul v var video wbr"
).split()
# Tags in square brackets.
BRACKET_TAGS = "b i u s url img color size quote code font spoiler center left right list sub sup".split()

_TAG = rf"</?(?i:{'|'.join(TAGS)})(?:[\s./:][^<>]*)?/?>|</(?i:{'|'.join(TAGS)})\s*$|<\d\d:\d\d(?::\d\d)?[.,]\d+>|<!--|-->|<!DOCTYPE|<\?xml"
_ENTITY = r"&(?:#\d{2,7}|#[xX][0-9A-Fa-f]{2,6}|[A-Za-z][A-Za-z0-9]{1,30});"
_INLINE = "|".join(
    (
        rf"(?P<tag>{_TAG})",
        rf"(?P<entity>{_ENTITY})",
        rf"(?P<bracket>\[/?(?i:{'|'.join(BRACKET_TAGS)})(?:=[^\]]*)?\](?!\([^)\s]*[./#:]))",
        r"(?P<style>\{\\[^}]*(?:\}|$))",
        r"(?P<bold>\*\*(?=\S)[^*]+?(?<=\S)\*\*|(?<![A-Za-z0-9_])__(?=[^_\s])[^_]+?(?<=[^_\s])__(?![A-Za-z0-9_]))",
        r"(?P<strike>~~(?=\S)[^~]+~~)",
        r"(?P<quotes>'''?(?=[^'\s])[^']+'''?)",
        r"(?P<image>!\[[^\]]*\]\([^)\s]*(?:\s[^)]*)?\))",
        r"(?P<anchor>\[[^\]]*\]\((?=[^)]*[./#:])[^)\s]*(?:\s\"[^)]*)?\))",
        r"(?P<note>\[\^[^\]\s]+\]:?)",
        r"(?P<wikilink>\[\[[^\[\]]+\]\])",
        r"(?P<template>\{\{[^{}]+\}\})",
        r"(?P<tick>`[^`\s](?:[^`]*[^`\s])?`)",
        r"(?P<escape>\\[*_#`\[\]~|>$%&{}](?!\w*\\))",
        r"(?P<display>\$\$.+?\$\$|\\\[.*?\\\]|\\\(.*?\\\))",
        r"(?P<formula>\$(?=[^\s$])(?=[^$]*[\\^_={}+])[^$]*[^\s$]\$)",
        r"(?P<command>~?\\[A-Za-z]{2,}\*?(?:\[[^\]]*\])?(?:\{[^{}]*\})*|\\[a-z]\{)",
        r"(?P<linebreak>\\[Nnh](?![a-z]{2,}\b)|\\\\\s*$)",
    )
)
_BLOCK = "|".join(
    (
        r"(?P<fence>^\s{0,3}(?:```+|~~~+)\s*[\w+#-]*\s*$)",
        r"(?P<heading>^\s{0,3}#{1,6}\s+\S)",
        r"(?P<wikiheading>^(?P<eq>={2,6})[^=].*[^=](?P=eq)\s*$)",
        r"(?P<tableline>^\s*\{\|.*|^\s*\|[}+-].*|^\s*\|.*\|\s*$|^\s*\|.*\|\|.*|^\s*!.*!!.*|^\s*\|\s+\S.*)",
        r"(?P<define>^;[^:：]+:)",
        r"(?P<redirect>^#(?:REDIRECT|転送)\b)",
    )
)
#: Marks that begin a line of running text as often as syntax (a speaker's dash) count in text files only.
_LISTS = r"(?P<item>^\s*[-*+]\s+\S|^[*#:]+\s+\S|^\s*\d{1,3}[.)]\s+\S)|(?P<quote>^\s{0,3}>+\s*\S)|(?P<rule>^\s*(?:-{3,}|\*{3,}|_{3,}|={3,})\s*$)"

_CAPTION = regex.compile(f"{_BLOCK}|{_INLINE}")
_FILE = regex.compile(f"{_BLOCK}|{_LISTS}|{_INLINE}")
_WEAK = {"tick", "command", "linebreak", "escape", "tableline", "formula", "display", "define", "strike", "quotes"}
_MAYBE = regex.compile(r"[<>&\[\]{}\\*_~'`$#=|;!+\-:.)]")
_PATH = regex.compile(r"(?<![A-Za-z])[A-Za-z]:\\[^\s\"'<>|]*")
_OPENS = regex.compile(r"^\s*(?:<(?i:pre|code|syntaxhighlight|source|script|style)\b[^<>]*>\s*)+|\\begin\{(?:verbatim|lstlisting|minted)\*?\}")
_CLOSES = regex.compile(r"(?:</(?i:pre|code|syntaxhighlight|source|script|style)\s*>)|\\end\{(?:verbatim|lstlisting|minted)\*?\}")


def find_syntax(line: str | None, captions: bool = False) -> str | None:
    """The name of the first piece of syntax in a line, or None. Null and empty lines have none."""
    if not line or not _MAYBE.search(line):
        return None
    text = shown(line)
    if "\\" in text:
        text = _PATH.sub("", text)
    for hit in (_CAPTION if captions else _FILE).finditer(text):
        kind = hit.lastgroup if hit.lastgroup != "eq" else "wikiheading"
        if kind == "entity" and html.unescape(hit.group()) == hit.group():
            continue
        if kind in _WEAK and not line.isascii():
            garbled, restored, _ = repair(line)
            if garbled:  # what a wrong encoding made of a letter is no syntax
                if restored:
                    return find_syntax(restored, captions)
                continue
        return kind
    return None


def code_event(line: str, kind: str | None) -> str | None:
    """fence (a mark that opens or closes), open or close, or None. A block opened and closed in one line is none."""
    if kind == "fence":
        return line.strip()[:3]
    opens, closes = bool(_OPENS.search(line)), bool(_CLOSES.search(line))
    return None if opens == closes else "open" if opens else "close"


# ---------------------------------------------------------------- clean text and structure

_STRIP = regex.compile(_INLINE)
_LINK = regex.compile(r"<a\b[^<>]*>(.*?)</a>|(?<!!)\[([^\]]*)\]\([^)]*\)|\[\[(?:[^\]|]*\|)?([^\]]*)\]\]")


# LaTeX commands that show nothing, those that show their last argument, and templates that show their first.
HIDDEN = "cite citep citet label ref eqref pageref vspace hspace includegraphics item begin end noindent maketitle tableofcontents newpage clearpage usepackage documentclass centering par".split()
SHOWN = "textbf textit emph underline texttt textsc textsf textrm textsl text mbox section subsection subsubsection paragraph chapter title author caption footnote href textcolor colorbox uline".split()
FIRST_ARGUMENT = "ruby ふりがな 読み仮名 r".split()


def _inline(hit: regex.Match) -> str:
    kind, text = hit.lastgroup, hit.group()
    if kind == "entity":
        return html.unescape(text)
    if kind in ("bold", "strike"):
        return text[2:-2]
    if kind == "quotes":
        return text.strip("'")
    if kind == "image":
        return regex.match(r"!\[([^\]]*)", text)[1]
    if kind == "anchor":
        return regex.match(r"\[([^\]]*)", text)[1]
    if kind == "wikilink":
        inner = text[2:-2]
        return "" if regex.match(r"(?i)(?:category|file|image|カテゴリ|ファイル|画像)\s*:", inner) else inner.split("|")[-1]
    if kind == "template":
        name, *rest = text[2:-2].split("|")
        shown_ones = [x for x in rest if "=" not in x]
        if not shown_ones or regex.match(r"(?i)\s*(?:cite|citation|infobox|出典)", name):
            return ""
        return shown_ones[0] if name.strip().lower() in FIRST_ARGUMENT else shown_ones[-1]
    if kind == "tick":
        return text[1:-1]
    if kind == "escape":
        return text[1:]
    if kind in ("display", "formula"):
        return text
    if kind == "command":
        name = regex.match(r"~?\\([A-Za-z]+)", text)
        given = regex.findall(r"\{([^{}]*)\}", text)
        if not name or name[1] in HIDDEN:
            return ""
        if given and (name[1] in SHOWN or len(given) == 1 and len(name[1]) > 2 and name[1] not in ("sqrt", "frac", "hat", "bar", "vec")):
            return given[-1]
        return text  # a formula
    if kind == "linebreak":
        return "" if text.startswith("\\\\") else "\n" if text[1] in "Nn" else " "
    return ""


_STARS = regex.compile(r"(?<![\w*\\])(\*{1,3})(?=[^\s*])([^*\n]+?)(?<=[^\s*])\1(?![\w*])|(?<![\w\\])_(?=[^\s_])([^_\n]+?)(?<=[^\s_])_(?!\w)")


def clean_line(line: str, stars: bool = False) -> str:
    """The text of one line without inline syntax; formulas stay. ``stars``: also marks of emphasis by one star or line."""
    while True:  # escaped tags become tags first
        if stars:
            line = _STARS.sub(lambda m: m[2] or m[3], line)
        new = _STRIP.sub(_inline, line)
        if new == line:
            return line.strip()
        line = new


_ITEM = r"\s*(?:[-*+]|\d{1,3}[.)])\s+\S|[*#:]+\s+\S|\s*<li\b|\s*\\item\b"
_CAPTION_ITEM = r"\s*<li\b|\s*\\item\b"
_CAPTION_MARK = r"^\s{0,3}#{1,6}\s+|^={2,}\s*|\s*={2,}\s*$|^\s*#+\s*$|\s#+\s*$"
_MARK = r"^\s{0,3}(?:#{1,6}\s+|>+\s*)|^\s*[-*+]\s+(?:\[[ x]\]\s*)?|^=+\s*|\s*=+\s*$|^\s*#+\s*$|\s#+\s*$"


def read_line(line: str, captions: bool = False) -> tuple[str | None, str | None, str, str, int, float]:
    """(syntax, code event, kind, clean text, heading or list depth, points) of a line that does not stand inside code.

    ``captions``: a leading dash, star, number or angle is what a caption says, no list or quote.
    """
    if not _MAYBE.search(line):  # none of the signs that syntax is made of
        bare = line.strip()
        if not bare:
            return None, None, "blank", "", 0, 0.0
        return None, None, "paragraph", bare, 0, 1 + sum(bare.count(c) for c in ",，、") + min(len(bare) / 50, 3)
    syntax = find_syntax(line, captions)
    event = code_event(line, syntax) if line else None
    kind, depth = "paragraph", 0
    if hit := regex.match(r"\s{0,3}(#{1,6})\s+|(={2,6})[^=].*\2\s*$|\s*<h([1-6])\b|\\((?:sub)*)section", line):
        kind = "heading"
        depth = len(hit[1] or hit[2] or "") or int(hit[3] or 0) or (len(hit[4] or "") // 3 + 1)
    elif regex.match(_CAPTION_ITEM if captions else _ITEM, line):
        kind, depth = "list", (len(line) - len(line.lstrip())) // 2 + 1
    elif regex.match(r"\s*(?:\||\{\||!.*!!)|.*<t[dhr]\b", line):
        kind = "table"
    elif not captions and regex.match(r"\s{0,3}>", line):
        kind = "quote"
    elif regex.search(r"\$\$|\\\[|\\begin\{(?:equation|align)|<math\b", line):
        kind = "formula"
    elif not line.strip():
        kind = "blank"
    elif event in ("```", "~~~") or syntax and not clean_line(line):
        kind = "syntax"
    if event in ("```", "~~~"):
        bare = line.strip(" \t`~")  # the name of the language
    elif kind == "table":
        cells = clean_line(regex.sub(r"</?t[dhr]\b[^<>]*>", "|", line))
        bare = " | ".join(p.strip() for p in regex.split(r"\|\|?|!!?", cells) if p.strip(" -:{}"))
    else:
        bare = clean_line(regex.sub(_CAPTION_MARK if captions else _MARK, "", line), not captions)
    points = 0.0
    if kind in ("paragraph", "list", "quote") and bare.strip():
        linked = sum(len(a or b or c) for a, b, c in _LINK.findall(line))
        points = (1 + sum(bare.count(c) for c in ",，、") + min(len(bare) / 50, 3)) * (1 - min(1, linked / len(bare.replace(" ", ""))))
    return syntax, event, kind, bare, depth, points


def _read(df: DataFrame, document: str, line: str, row_id: str, captions: bool) -> DataFrame:
    """``read_line`` of every row, once each, with ``inside``: whether it stands inside a code block that is closed."""
    schema = "row_id long, document string, line string, syntax string, event string, kind string, text string, depth int, points double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 4 + [pa.int32(), pa.float64()]
        for batch in batches:
            found = [read_line(x or "", captions) for x in batch.column(2).to_pylist()]
            columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)] if found else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=["row_id", "document", "line", "syntax", "event", "kind", "text", "depth", "points"])

    taken = df.select(F.col(row_id).cast("long").alias("row_id"), F.col(document).cast("string").alias("document"), F.col(line).cast("string").alias("line"))
    rows = settle(taken.filter("row_id is not null").dropDuplicates(["row_id"]).mapInArrow(run, schema), "lines")
    # what holds after each event; events are few beside the lines
    named = F.when(F.col("event").isin("open", "close"), F.col("event"))
    fences = {name: F.when(F.col("event") == mark, 1).otherwise(0) for name, mark in (("ticks", "```"), ("tildes", "~~~"))}
    events = settle(rows.filter("event is not null"), "events")
    events = running(events, ["document"], "row_id", sums=fences, lasts={"last": named})
    events = running(settle(events, "events"), ["document"], "row_id", sums={f"{n}_after": e for n, e in fences.items()}, lasts={"next": named}, backward=True, inclusive=False)
    holds = F.lit(False)
    for name in fences:
        holds = holds | ((F.col(name) % 2 == 1) & (F.col(f"{name}_after") > 0))
    holds = holds | F.coalesce((F.col("last") == "open") & (F.col("next") == "close"), F.lit(False))
    events = events.withColumn("holds", holds).select(*rows.columns, "holds")
    whole = settle(rows.filter("event is null").withColumn("holds", F.lit(None).cast("boolean")).unionByName(events), "states")
    return running(whole, ["document"], "row_id", lasts={"inside": F.col("holds")}, inclusive=False).withColumn("inside", F.coalesce("inside", F.lit(False)))


#: Sections with this share of the best one's points belong to the content.
NEAR = 0.2


def read_trees(df: DataFrame, document: str, line: str, row_id: str = "row_id", captions: bool = False) -> DataFrame:
    """``row_id, document, syntax, kind, text, depth, section, container, main`` of every line.

    ``kind``: paragraph, heading, list, table, quote, code, code_begin, code_end, formula, syntax or blank; ``main``: it
    belongs to the best section or a sibling near it. ``syntax`` is null for lines without any and for those inside a code
    block, its marks left out; a block that is never closed is none. Rows with one ``row_id`` come out once, those without
    are left out. A null line is blank; null documents are one document; an empty table gives no rows. Lines and documents
    of any length are read whole. ``captions`` as in ``read_line``.
    """
    rows = _read(df, document, line, row_id, captions)
    begins = ~F.col("inside") & F.coalesce(F.col("holds"), F.lit(False))
    ends = F.col("inside") & F.coalesce(~F.col("holds"), F.lit(False)) & F.col("event").isin("```", "~~~", "close")
    kind = F.when(begins, "code_begin").when(ends, "code_end").when(F.col("inside"), "code").otherwise(F.col("kind"))
    marks = F.col("event").isin("```", "~~~", "close")
    rows = rows.withColumn("syntax", F.when(F.col("inside") & ~F.coalesce(marks, F.lit(False)), None).otherwise(F.col("syntax")))
    rows = rows.withColumn("code", F.col("inside") & ~ends).withColumn("kind", kind).withColumn("text", F.when(F.col("code"), F.col("line")).otherwise(F.col("text")))
    rows = rows.withColumn("points", F.when(F.col("kind").isin("paragraph", "list", "quote"), F.col("points")).otherwise(0.0))
    rows = rows.withColumn("depth", F.when(F.col("kind").isin("heading", "list"), F.col("depth")).otherwise(0))
    group = F.when(F.col("kind").isin("blank", "heading"), "").when(F.col("kind").isin("list", "table", "quote"), F.col("kind")).when(F.col("kind").startswith("code"), "code").otherwise("flow")
    heading = F.when(F.col("kind") == "heading", 1).otherwise(0)
    rows = settle(rows.withColumn("group", group).drop("line", "code", "holds", "inside", "event"), "kinds")
    rows = running(rows, ["document"], "row_id", sums={"section": heading}, lasts={"before": F.col("group")}, inclusive=False)
    rows = settle(rows.withColumn("section", F.col("section") + heading), "sections")
    new = F.when((F.col("group") != "") & (F.coalesce(F.col("before"), F.lit("")) != F.col("group")), 1).otherwise(0)
    rows = settle(running(rows, ["document"], "row_id", sums={"container": new}).withColumn("__d", F.xxhash64("document")), "containers")
    own = rows.filter("group <> ''").groupBy("__d", "container").agg(F.sum("points").alias("own"), F.min("section").alias("section"))
    sections = own.groupBy("__d", "section").agg((F.sum("own") / 2).alias("total"))
    best = sections.groupBy("__d").agg(F.max("total").alias("best"))
    near = sections.join(best, "__d").select("__d", "section", (F.col("total") >= NEAR * F.col("best")).alias("near"))
    rows = rows.join(near, ["__d", "section"], "left").join(own.select("__d", "container", "own"), ["__d", "container"], "left")
    dead = F.col("group").isin("flow", "list") & F.col("kind").isin("paragraph", "list") & (F.coalesce("own", F.lit(0.0)) <= 0)
    main = F.coalesce("near", F.lit(True)) & ~dead
    return rows.select("row_id", "document", "syntax", "kind", "text", "depth", "section", F.when(F.col("group") != "", F.col("container")).alias("container"), main.alias("main"))


def markup_rows(df: DataFrame, document: str, line: str, row_id: str = "row_id", captions: bool = False) -> DataFrame:
    """Rows whose line holds formatting syntax: ``row_id, syntax``, from the trees. Cases as in ``read_trees``."""
    return read_trees(df, document, line, row_id, captions).filter("syntax is not null").select("row_id", "syntax")


def clean_documents(df: DataFrame, document: str, line: str, row_id: str = "row_id", captions: bool = False) -> DataFrame:
    """``row_id, document, kind, text, depth, main``: each line cleaned, with its part in the structure of its document."""
    return read_trees(df, document, line, row_id, captions).select("row_id", "document", "kind", "text", "depth", "main")
