"""p5: every pair of encodings, texts of every language, and texts that are not garbled."""

import pytest

from lineloom.llm.garbled import SINGLE, _read, find_garbled, is_garbled, repair
from lineloom.session import local_session, ship


def _misread(text: str, true: str, wrong: str) -> str:
    return _read(text.encode(true), wrong) if wrong in SINGLE else text.encode(true).decode(wrong)


@pytest.mark.parametrize(
    "text, true, wrong",
    [
        ("Привет мир", "utf-8", "cp1252"), ("Привет мир", "utf-8", "cp1251"), ("Привет мир", "cp1251", "latin-1"), ("Привет мир", "koi8-r", "cp1252"), ("Καλημέρα κόσμε", "utf-8", "cp1252"), ("😀 ok", "utf-8", "cp1252"),
        ("国家重点实验室", "gb18030", "latin-1"), ("今日は天気がいい", "gb18030", "latin-1"), ("谢谢大家", "gb18030", "cp1252"), ("안녕하세요", "cp949", "latin-1"), ("為什麼哥哥", "big5", "latin-1"), ("入口", "cp932", "cp1252"),
        ("森橋機発見現場", "utf-8", "cp932"), ("森橋の駅だ", "euc-jp", "latin-1"), ("これは駅です", "cp932", "mac_roman"), ("これは駅です。", "utf-8", "cp437"), ("café crème", "utf-8", "cp1252"), ("これは駅です", "utf-8", "koi8-r"),
    ],
)
def test_texts_come_back(text, true, wrong):
    found, restored, _ = repair(_misread(text, true, wrong))
    assert found and restored == text


def test_only_the_garbled_span_is_replaced():
    assert repair("駅で" + _misread("これは", "utf-8", "latin-1") + "と言った。")[1] == "駅でこれはと言った。"
    twice = _misread(_misread("これは駅だ", "utf-8", "latin-1"), "utf-8", "latin-1")
    assert repair(twice)[1] == "これは駅だ"
    assert repair("これ\ufffdは") == (True, None, None)


def test_a_kanji_only_line_is_restored_by_a_pair_of_low_rank():
    assert repair("\x92¹\x92r\x90}\x8f\x91\x8aÙ\x93ü\x8cû")[:2] == (True, "鳥池図書館入口")


@pytest.mark.parametrize(
    "text",
    [
        None, "", "plain", "縺れた糸のような駅だ。", "Où as-tu caché la fenêtre, “mon frère” ?", "“I don’t know—it’s ‘fine’”", "Привет, как дела?", "这个医生是谁的？那个铁桥对船长来说很重要。", "“Über” alles – ‘naïve’",
        "Καλημέρα", "X線とCD盤", "鸚鵡と麒麟と薔薇", "pаper аbc", "안녕하세요", "créée à l’été", "Dvořák žije", "瓊瑤與饕餮", "――――■■□□××××", "ｶﾀｶﾅ ﾊﾝｶｸ", "夕方キベンは水港の庭を読んだ。", "Ｏù ａｓ-ｔｕ ｃａｃｈé", "it\u00a0is",
    ],
)
def test_a_line_without_garbling_stays(text):
    assert repair(text) == (False, None, None) and not is_garbled(text)


def test_rows_given_twice_nulls_and_long_texts():
    spark = local_session(2, 8)
    ship(spark)
    bad = _misread("これは駅です", "utf-8", "latin-1")
    rows = [(1, bad, "x"), (1, bad, "x"), (2, None, "x"), (3, "", "x"), (4, "駅" * 30_000 + bad, "x"), (5, "駅", "x")]
    df = spark.createDataFrame(rows, "row_id long, line string, garbled int".replace("int", "string"))
    assert sorted((r.row_id, len(r.restored)) for r in find_garbled(df, "line").collect()) == [(1, 6), (4, 30_006)]
    assert find_garbled(df.limit(0), "line").count() == 0


def test_texts_are_restored_line_by_line():
    from lineloom.llm.garbled import restore_texts

    spark = local_session(2, 8)
    ship(spark)
    bad = _misread("これは駅です", "utf-8", "latin-1")
    df = spark.createDataFrame([(1, f"駅\n{bad}\nabc", "x"), (2, None, "y"), (3, "lost \ufffd", "z")], "doc_id long, text string, lang string")
    assert [tuple(r) for r in restore_texts(df, "text").orderBy("doc_id").collect()] == [(1, "駅\nこれは駅です\nabc", "x"), (2, None, "y"), (3, "lost \ufffd", "z")]
