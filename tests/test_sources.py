"""Readers of files, on files made here."""

import io
import json
import zipfile

import pytest

from lineloom.sources import books, captions, decode, scans, texts, words

SENTENCE = "これは昼寝の話です。猫がいる。"


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "utf-16", "cp932", "euc_jp", "iso2022_jp"])
def test_encodings(encoding):
    assert decode.decode_bytes(SENTENCE.encode(encoding))[0] == SENTENCE


def test_damaged_and_binary_files():
    lines = [SENTENCE.encode() + b"\n"] * 40
    lines[3] = b"\xff\xfe\x80" + lines[3]
    text, encoding = decode.decode_bytes(b"".join(lines))
    assert encoding == "utf-8-damaged" and "�" in text
    for raw, reason in ((bytes(range(256)) * 9, "unreadable"), (b"<html><body>x</body>", "html_error"), (b"plain text", "unsupported")):
        with pytest.raises(decode.Unreadable) as error:
            decode.read_captions(raw)
        assert error.value.reason == reason
    assert decode.sanitize_ass("{\\fs2x\\an8\\pos(1,2)\\move(1,2)}a") == ("{\\an8\\pos(1,2)}a", ["\\fs2x", "\\move(1,2)"])


SRT = """1
00:00:01,000 --> 00:00:02,000
（太郎）
昼寝した

2
00:00:03,000 --> 00:00:04,000
♪～

3
00:00:05,000 --> 00:00:06,000
漢字だ

4
00:00:06,000 --> 00:00:07,000
｜漢字(かんじ)だ

5
00:00:08,000 --> 00:00:09,000
<i>我们走吧</i>
"""


def test_srt():
    assert captions.srt_lines(SRT) == ["（太郎）昼寝した", "｜漢字(かんじ)だ"]
    assert captions.caption_lines("1\n00:00:01,000 --> 00:00:02,000\nhello\n", "srt") == []


ASS = """[Script Info]
[V4+ Styles]
Format: Name, Fontname, Fontsize
Style: Main,x,40
Style: Ruby,x,15
[Events]
Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text
Dialogue: 0,0:00:01.00,0:00:02.50,Main,,0,0,0,,{\\fs40\\pos(100,100)}漢字だ
Dialogue: 0,0:00:01.00,0:00:02.50,Ruby,,0,0,0,,{\\pos(80,60)}かんじ
Dialogue: 0,0:00:03.00,0:00:03.00,Main,,0,0,0,,消える
Dialogue: 0,0:00:04.00,0:00:05.00,Main,,0,0,0,,{\\p1}m 0 0
Dialogue: 0,0:00:04.00,0:00:05.00,Main,,0,0,0,,二行\\N目だ
Dialogue: 0,0:00:04.00,0:00:05.00,Staff,,0,0,0,,字幕だ
"""


def test_ass():
    events, why = captions.ass_events(ASS)
    assert dict(why) == {"zero-duration": 1, "kept": 2, "ruby-style": 1, "drawing": 1, "credits": 1}
    assert captions.caption_lines(ASS, "ass") == ["｜漢字(かんじ)だ", "二行目だ".replace("行目", "行 目")]
    assert captions.ass_time("1:02:03.5") == 3723500 and captions.ass_time("x") is None and captions.srt_time(3723500) == "01:02:03,500"


def test_caption_files(spark, tmp_path):
    show = tmp_path / "lib" / "show"
    show.mkdir(parents=True)
    (show / "a.srt").write_text(SRT, encoding="utf-8")
    (show / "b.ass").write_text(ASS, encoding="cp932")
    (show / "._a.srt").write_text("x")
    (tmp_path / "lib" / "c.srt").write_text("no captions")
    other = tmp_path / "more" / "show"
    other.mkdir(parents=True)
    (other / "a.srt").write_text("later root")
    files, doubles = decode.scan_roots(spark, [str(tmp_path / "lib"), str(tmp_path / "more")], (".srt", ".ass"))
    assert sorted(r.relpath for r in files.collect()) == ["c.srt", "show/a.srt", "show/b.ass"]
    assert [r.relpath for r in doubles.collect()] == ["show/a.srt"]
    rows = captions.read_files(files).orderBy("relpath", "place").collect()
    assert [(r.relpath, r.line) for r in rows][:2] == [("show/a.srt", "（太郎）昼寝した"), ("show/a.srt", "｜漢字(かんじ)だ")]
    assert {r.error for r in files.select(decode.read_column("content").alias("r")).select("r.error").collect()} == {None, "unsupported"}
    named = files.select(decode.show_path(files["relpath"]).alias("p"))
    assert "c/c.srt" in {r.p for r in named.collect()}


def _epub(pages: dict[str, str], extra: dict[str, str] | None = None, manifest: str = "") -> bytes:
    out = io.BytesIO()
    items = "".join(f'<item id="{n}" href="{n}" media-type="application/xhtml+xml"/>' for n in pages)
    spine = "".join(f'<itemref idref="{n}"/>' for n in pages)
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>')
        z.writestr("OEBPS/content.opf", f'<package xmlns:dc="d"><metadata><dc:title>猫の本</dc:title><dc:creator>人（著）</dc:creator></metadata><manifest>{items}{manifest}</manifest><spine>{spine}</spine></package>')
        for name, body in pages.items():
            z.writestr(f"OEBPS/{name}", f"<html><head><title>x</title></head><body>{body}</body></html>")
        for name, body in (extra or {}).items():
            z.writestr(name, body)
    return out.getvalue()


def test_books(spark):
    pages = {"a.xhtml": "<p>前書き。</p>", "b.xhtml": '<h2 id="c1">一</h2><p>地図を<ruby>見<rt>み</rt></ruby>た。「はい。」「いいえ。」と言う。</p><p>終わり<br/>だ。</p><p>終わりだ。</p>'}
    nav = '<nav epub:type="toc"><ol><li><span>部</span><ol><li><a href="b.xhtml#c1">章</a></li></ol></li></ol></nav>'
    raw = _epub(pages, {"OEBPS/nav.xhtml": nav}, '<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>')
    book = books.read_book(raw, "x.epub")
    assert (book["title"], book["author"]) == ("猫の本", "人")
    assert book["chapters"] == [("猫の本", ["前書き。"]), ("部｜章", ["一地図を".replace("一地図を", "一"), "地図を｜見(み)た。", "「はい。」", "「いいえ。」と言う。", "終わりだ。"])]
    ncx = '<ncx><navMap><navPoint><navLabel><text>甲</text></navLabel><content src="a.xhtml"/></navPoint></navMap></ncx>'
    raw = _epub(pages, {"OEBPS/toc.ncx": ncx}, '<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>')
    assert books.read_book(raw)["chapters"][0][0] == "甲"
    lock = '<encryption><e xmlns="x"/><q:EncryptedData xmlns:q="q"><q:EncryptionMethod Algorithm="aes"/><q:CipherReference URI="OEBPS/a.xhtml"/></q:EncryptedData></encryption>'
    assert books.locked(_epub(pages, {"META-INF/encryption.xml": lock})) and not books.locked(raw)
    files = spark.createDataFrame([("a.epub", bytearray(raw)), ("b.epub", bytearray(b"x")), ("c.epub", bytearray(_epub({"a.xhtml": "<p></p>"}))), ("d.epub", bytearray(_epub(pages, {"META-INF/encryption.xml": lock})))], "relpath string, content binary")
    found = books.read_books(files)
    assert {(r.relpath, r.fault) for r in found.collect()} == {("a.epub", None), ("b.epub", "unreadable"), ("c.epub", "image_only"), ("d.epub", "drm")}
    assert books.chapter_rows(found).first().file.startswith("猫の本\\")


def test_sentences_and_blocks():
    assert books.sentences("「どこ？」「ここ。」と言う。（本当？）うん。 ") == [("「どこ？」", False), ("「ここ。」と言う。", True), ("（本当？）うん。", False)]
    assert books.sentences("") == []
    assert books.html_text("<p>外字<img alt=''>だ</p><script>x</script><div>a<br>b</div>") == "外字〓だ\nab"
    assert books.is_heading("h2", "第一章　始まり") and not books.is_heading("td", "第一章") and not books.is_heading("p", "第一章について。")
    assert books.generic_alt("image_01.png") and not books.generic_alt("辻")


def test_volumes(spark):
    block = lambda box, text, size=20, vertical=True: {"box": box, "lines": [text], "vertical": vertical, "font_size": size}
    page = {"img_width": 800, "img_height": 1000, "blocks": [block([100, 100, 150, 400], "左だ．．．"), block([600, 100, 650, 400], "駅前だ"), block([655, 100, 670, 200], "えきまえ", 8), block([602, 102, 652, 402], "駅前だ…"), block([300, 600, 350, 700], "…")]}
    spread = {"img_width": 1600, "img_height": 1000, "blocks": [block([100, 0, 200, 100], "後"), block([1000, 0, 1100, 100], "先")]}
    doc = {"title": "題", "pages": [page, spread]}
    found = scans.volume_lines(doc, frozenset({("駅前", "えきまえ")}))
    assert found == [(1, "えきまえ"), (1, "駅前だ…"), (1, "左だ…"), (2, "先"), (2, "後")]
    alone = {"pages": [page | {"blocks": page["blocks"][:3]}]}
    assert scans.volume_lines(alone, frozenset({("駅前", "えきまえ")}))[0] == (1, "｜駅前(えきまえ)だ")
    assert scans.volume_name("a/b/c.mokuro", None) == ("a", "b｜c", "a\\b｜c") and scans.volume_name("c.mokuro", "題") == ("題", "c", "題\\c")
    files = spark.createDataFrame([("s/1.mokuro", bytearray(json.dumps(doc).encode())), ("s/2.mokuro", bytearray(b"{}"))], "relpath string, content binary")
    assert {(r.relpath, r.fault) for r in scans.read_volumes(files).collect()} == {("s/1.mokuro", None), ("s/2.mokuro", "unreadable")}


MARKDOWN = """---
a: b
---
# 題名
<!-- x
y -->
段落[リンク](http://a.example)と**太字**。

## 節 ##
- [ ] 項目
> 引用
| a | b |
|---|---|
| 1 | 2 |
```
# code
```
![絵](x.png)
https://example.com
見出し
===
[[頁|名]]だ[^1]
[^1]: 注
[子](child.md)
"""


def test_markdown():
    found = texts.markdown_lines(MARKDOWN, "題名", frozenset({"child.md"}))
    assert found == [
        ("段落リンクと太字。", True, 0, None), ("項目", False, 1, "節"), ("引用", False, 1, "節"), ("a　b", False, 1, "節"), ("1　2", False, 1, "節"), ("# code", False, 1, "節"),
        ("名だ", False, 2, "見出し"), ("注", False, 2, "見出し"),
    ]
    assert texts.markdown_lines("") == [] and texts.text_lines("a\n\n 漢字(かんじ)", ruby=True) == [("a", False, []), ("漢字", True, [(0, 2, "かんじ")])]
    assert [x[2:] for x in texts.scan_links("a ![x](y) [b [c]](d(e)) \\[n](m)")] == [(True, "x", "y"), (False, "b [c]", "d(e)")]
    assert texts.markdown_links("[a](b.md)\n```\n[c](d)\n```\n[r][]\n\n[r]: z") == [("a", "b.md", True), ("r", "z", True)]


def test_lists_of_navigation_are_no_text():
    text = "- 目次\n  - [一](a.md)\n  - https://e.example\n- 本文\n  - [二](b.md)の話\n- 追加\n"
    assert [x[0] for x in texts.markdown_lines(text, "", frozenset({"a.md", "b.md"}))] == ["本文", "の話"]


def test_trees():
    tag = " " + "0123456789abcdef" * 2
    pages = {f"本{tag}.md": f"[二](本{tag}/二{tag}.md)\n[一](本{tag}/一{tag}.md)", f"本{tag}/一{tag}.md": "x", f"本{tag}/二{tag}.md": "y", f"本{tag}/三{tag}.md": "z"}
    found = texts.page_orders(pages)
    assert [found[p]["title"] for p in sorted(found, key=lambda p: found[p]["order_key"])] == ["本", "二", "一", "三"]
    assert found[f"本{tag}.md"]["folder_page"] and texts.clean_path(f"a{tag}/b{tag}.md") == "a/b.md"
    assert texts.target_path("a/b.md", "../c%20d.md") == "c d.md" and texts.target_path("a.md", "../x.md") is None


def test_text_files(spark):
    files = spark.createDataFrame([("a.txt", bytearray("一\n\n二".encode())), ("b.md", bytearray(b"# h\nx")), ("c.txt", bytearray(bytes(range(128, 256)) * 9))], "relpath string, content binary")
    rows = texts.read_texts(files).orderBy("relpath", "place").collect()
    assert [(r.relpath, r.line, r.gap_before, r.section_no, r.fault) for r in rows] == [("a.txt", "一", False, None, None), ("a.txt", "二", True, None, None), ("b.md", "x", False, 1, None), ("c.txt", None, None, None, "unreadable")]


def test_word_lists(tmp_path):
    assert words.read_list("# c\n猫\n漢字[かんじ]\n".encode()).entries == [("猫", ""), ("漢字", "かんじ")]
    found = words.read_list("word,reading\n猫,ねこ\n<b>犬</b>,いぬ\n".encode(), "x.csv")
    assert found.entries == [("猫", "ねこ"), ("犬", "いぬ")] and (found.column, found.reading_column) == (0, 1)
    assert words.read_list("#separator:tab\n猫\tねこ\n犬\tいぬ\n".encode()).reading_column == 1
    states = words.read_list("=== MASTERED ===\n猫\n=== YOUNG ===\n犬\n".encode())
    assert states.entries == [("猫", "")] and states.skipped == 1
    envelope = json.dumps({"schema": words.ENVELOPE, "version": 1, "entries": [{"expression": "猫", "reading": "ねこ"}, {"expression": "犬", "state": "new"}]})
    assert words.read_list(envelope.encode()).entries == [("猫", "ねこ")]
    for data, code in ((b"", "empty"), (b"x" * (words.MOST_BYTES + 1), "too_large"), (b"\xff\xfa", "not_utf8"), (b"dictForm,secondary,hasCard\nx,y,1", "cards_confirm"), ("猫" * 3000).encode() and (("猫" * 3000).encode(), "entry_too_long")):
        with pytest.raises(words.ListError, match=code):
            words.read_list(data)
    assert words.clean_field("<ruby>漢<rt>かん</rt></ruby>[sound:a.mp3]<br>x") == ("漢 x", "かん")
    from lineloom.plans.analyzers import SpacedAnalyzer

    lists = words.Lists(str(tmp_path), SpacedAnalyzer(), {"を"})
    lists.put("one", "猫\nを\n".encode())
    lists.put("two", "犬 小屋\n".encode())
    assert lists.vocabulary().singles == {"猫"} and lists.vocabulary().phrases == {("犬", "小屋")}
    assert lists.remove("one") and not lists.remove("one") and lists.vocabulary().singles == frozenset()


def test_conversion_keeps_the_bytes(tmp_path):
    import hashlib

    from lineloom.operators.incremental import convert_to_utf8

    path, raw = tmp_path / "a.srt", SENTENCE.encode("cp932")
    path.write_bytes(raw)
    with pytest.raises(ValueError):
        convert_to_utf8(str(path), "0", str(tmp_path / "b"))
    assert convert_to_utf8(str(path), hashlib.sha256(raw).hexdigest(), str(tmp_path / "b")) == "cp932"
    assert path.read_bytes() == SENTENCE.encode() and (tmp_path / "b").read_bytes() == raw


def test_stream_keeps_the_index(spark, tmp_path):
    from lineloom.streaming.ingest import caption_stream, keep_index, running_counts

    root = tmp_path / "in"
    (root / "show").mkdir(parents=True)
    index = str(tmp_path / "index")
    for n in range(2):
        (root / "show" / f"{n}.srt").write_text(SRT)
        keep_index(caption_stream(spark, str(root)), index, str(tmp_path / "check"), once=True).awaitTermination()
        assert spark.read.parquet(index).count() == 2 * (n + 1)
    stream = spark.readStream.format("rate").load().selectExpr("timestamp as at", "'f' as folder")
    assert running_counts(stream).isStreaming
