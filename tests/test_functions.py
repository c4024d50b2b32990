"""Scalar functions against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from lineloom.functions import measure, reading, rewrite, ruby, script, titles


def _one(spark, expr, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expr.alias("x")).first().x


def test_script_columns(spark):
    one = lambda f, t: _one(spark, f("t"), t=t)
    assert one(script.full_kana, "ｶﾞｲﾄﾞｰ") == "ガイドー" and one(script.full_kana, None) is None
    assert one(script.hiragana, "カタヴー") == "かたゔー"
    assert one(script.fold_compat, "神福") == "神福"
    assert one(script.fold_title, "ＡＢＣ ガｲﾄﾞ") == "abc がいど" and one(script.fold_title, None) == ""
    assert [one(script.script_of, t) for t in ("漢か", "カか", "か", "x")] == ["kanji", "katakana", "hiragana", "romaji"]
    assert [one(script.line_kind, t) for t in ("今日は 我们走吧", "今日は晴れ", "我们现在走吧", "This is English", "ok", None, "")] == ["mix", "ja", "zh", "en", "other", "other", "other"]
    assert one(script.has_readable, "…！？") is False and one(script.has_readable, None) is False
    assert one(script.has_html_ruby, "<ruby>漢<rt>かん</rt></ruby>") is True
    assert one(script.distinct_kanji, "日本日々") == ["々", "日", "本"]
    assert one(script.unescape_references, "&#x3042;&#1;&#160;|") == "あ&#1; |"
    garbled = "これは駅です".encode().decode("latin-1")
    assert _one(spark, script.mojibake("t"), t=garbled) is True and _one(spark, script.mojibake("t"), t="café") is False
    assert [script.number_of(x) for x in ("１２", "二十三", "百", "x", "", None)] == [12, 23, 100, None, None, None]


def test_measures(spark):
    assert _one(spark, measure.shown_length("t"), t="｜漢字(かんじ)、です。 ！") == 5
    assert _one(spark, measure.shown_length("t"), t=None) == 0
    assert abs(_one(spark, measure.sentence_score(F.lit(27), F.lit(True))) - 1.5) < 1e-9
    assert _one(spark, measure.known_score(F.lit(1.0), F.lit(False), F.lit(2), F.lit(5), F.lit(True))) == 1.0 - 10 * 103
    assert _one(spark, measure.caption_time(F.lit(3723004))) == "01:02:03,004"
    assert _one(spark, measure.milliseconds(F.lit(1), F.lit(2), F.lit(3), F.lit("5"))) == 3723500
    import zlib

    assert _one(spark, measure.line_key("t", 4), t="Ab, cd!") == zlib.crc32(b"abcd") and _one(spark, measure.line_key("t", 5), t="abcd") is None


def test_readings():
    assert reading.same_reading("がくせい", "かくせい") and reading.same_reading("がっ", "がく") and not reading.same_reading("きせい", "かくせい")
    assert reading.same_reading("きょう", "きよう") and reading.same_reading(None, None) and not reading.same_reading(None, "か")
    table = {"学": {"がく"}, "校": {"こう"}, "人": {"ひと"}}
    assert reading.splits("学校", "がっこう", table) == [("がっ", "こう")] and reading.splits("人々", "ひとびと", table) == [("ひと", "びと")]
    assert reading.part_reading("学校", "がっこう", 1, 2, table) == "こう" and reading.part_reading("学校", "そら", 0, 1, table) is None


@pytest.mark.parametrize(
    "rule, given, wanted",
    [
        (rewrite.caption_marks, "ﾈｺ? ... 「 はい」 ", "ネコ？…「はい」"), (rewrite.caption_marks, "", ""), (rewrite.book_marks, "…… （ 猫 ）。 ", "…（猫）。"),
        (rewrite.page_marks, "ウォ一ターと口ビ二ャ", "ウォーターと口ビニャ"), (rewrite.finish_caption, "ア·イ―――だ", "ア・イ――だ"), (rewrite.private_use, "日", "日〓"),
        (rewrite.clean_caption, "{\\an8}<i>猫だ</i>[音] 我们走吧&amp;", "猫だ"), (rewrite.clean_caption, "www.example.com", ""), (rewrite.join_rows, ["（太郎）", "はい", "元気"], "（太郎）はい 元気"), (rewrite.join_rows, [], ""),
    ],
)
def test_rewriting(rule, given, wanted):
    assert rule(given) == wanted


def test_rewriting_of_files():
    assert rewrite.until_fixed("aaab", [("aa", "a")]) == "ab"
    assert rewrite.without_chinese("我们走吧") == ("", "chinese") and rewrite.without_chinese("猫だ 我们走吧") == ("猫だ", "part") and rewrite.without_chinese("猫だ") == ("猫だ", None)
    assert rewrite.without_word_spaces(["今 日 は"] * 20) == ["今日は"] * 20 and rewrite.without_word_spaces(["今 日"] * 3) == ["今 日"] * 3
    assert rewrite.all_in_brackets(["[猫]"] * 20) and not rewrite.all_in_brackets(["[猫]"] * 19)
    assert rewrite.only_music("♪〜") and rewrite.only_brackets("（猫）") and rewrite.only_signs("--->")


def test_ruby(spark):
    assert ruby.written_ruby("漢字(かんじ)と｜刃文《もん》") == ("漢字と刃文", [(0, 2, "かんじ"), (3, 5, "もん")], ["かんじ", "もん"])
    assert ruby.html_ruby("<ruby>漢<rp>(</rp><rt>かん</rt>字<rt>じ</rt></ruby>だ") == "｜漢(かん)｜字(じ)だ"
    rows = [(1, "｜駅(えき)前の｜猫(ねこ)"), (2, "新｜駅(えき)"), (3, None)]
    found = ruby.lexicon(spark.createDataFrame(rows, "row_id long, line string"))
    assert sorted(map(tuple, found.collect())) == [(1, "猫", "ねこ", True), (1, "駅", "えき", False), (2, "駅", "えき", False)]
    extra = spark.createDataFrame([("｜駅前(えき まえ)", "駅 前", "えき まえ"), ("x", "a", None)], "line string, b string, r string").select(*ruby.index_extras("line", "b", "r")).collect()
    assert [tuple(r) for r in extra] == [("駅 前 えきまえ 駅前", "えき まえ えきまえ"), ("a", "")]
    assert ruby.merge_single("学校だ", [(0, 1, "がっ"), (1, 2, "こう")]) == [(0, 2, "がっこう")]
    assert ruby.trimmed_base("盲目的刃文", "もん", {"刃文": {"もん"}}) == 3
    assert ruby.unfuse("ねこ猫とえきまえ駅前だ", frozenset({("駅前", "えきまえ")})) == "ねこ猫と｜駅前(えきまえ)だ"
    assert ruby.highlighted("｜学(がっ)校<です", ["学校"]) == "<b><ruby>学<rt>がっ</rt></ruby>校</b>&lt;です"


def test_titles(spark):
    assert titles.clean_stem("[Group] Show - 01 [ABCD1234].ja.srt") == "Show - 01"
    assert titles.episode_title("Show/S02E05 Name.srt") == "Show 2期 5話 Name" and titles.episode_title("番組/第三話.ass") == "番組 3話"
    assert titles.clean_title("[猫の本（上）【特典付】]") == "猫の本 上" and titles.clean_title(None) == ""
    assert titles.title_and_author("x/[作者] 題名.epub", None, "Unknown") == ("題名", "作者")
    assert titles.close_spacing("第 一 章 は じ め") == "第一章 はじめ"
    assert titles.book_title("題\\01.章", "人") == "題（人）｜章" and titles.volume_title("a\\b.mokuro") == "a｜b" and titles.text_title("x/y.md") == "y"
    assert titles.natural_order("a2") < titles.natural_order("a10") and titles.collation_bytes("ア") == titles.collation_bytes("あ")
    assert titles.release_hints("Show [Netflix][cc] ocr.srt") == ("Netflix", True, True) and titles.release_hints("nf.srt") == (None, False, False)
    rows = [("本", "甲", "a/1"), ("本", "乙", "b/1"), ("本", "乙", "b/2"), ("独", None, "c/1")]
    found = titles.distinct_titles(spark.createDataFrame(rows, "title string, author string, relpath string")).orderBy("relpath").collect()
    assert [r.shown for r in found] == ["本（甲）", "本（乙）（b）", "本（乙）（b）（2）", "独"]
