"""The query language and the plans made of it."""

import pytest

from lineloom.operators import predicates, search
from lineloom.plans.analyzers import LexiconAnalyzer, SpacedAnalyzer, text_pieces
from lineloom.plans.query import Excluded, Near, Phrase, chosen_media, chosen_sort, normalize, parse_readings, plan, resolve_term, split_excluded

LEXICON = LexiconAnalyzer(
    [("猫", "猫", "ネコ", "名詞"), ("が", "が", "ガ", "助詞"), ("を", "を", "ヲ", "助詞"), ("見る", "見る", "ミル", "動詞"), ("見た", "見る", "ミタ", "動詞"), ("た", "た", "タ", "助動詞"), ("つらい", "辛い", "ツライ", "形容詞"), ("た", "た", "タ", "助動詞")]
)


@pytest.mark.parametrize(
    "given, wanted",
    [("  a   b ", "a b"), ("--x y", "-x y"), ("ーx y", "－x y"), ("－－x", "－x"), ("- x", "-x"), ("a -", "a -"), ("a ーー", "a ーー"), ("辛い = つらい", "辛い=つらい"), ('"a  =  b"', '"a  =  b"'), ("", ""), (None, "")],
)
def test_normalize(given, wanted):
    assert normalize(given) == wanted


def test_excluded_terms():
    assert split_excluded('猫 -犬 －"a b" -') == ("猫 -", (Excluded("犬"), Excluded("a b", True)))


def test_reading_terms():
    found = parse_readings("辛い=からい -家=うち a=b 猫=x")
    assert [(t.word, t.reading, t.stem) for t in found.terms] == [("辛い", "からい", "から")]
    assert [t.word for t in found.excluded_terms] == ["家"] and found.literals == ("a=b", "猫=x")
    assert parse_readings("辛い=からむ").dropped == ("辛い",)
    assert resolve_term("お茶", "ちゃ").reading == "おちゃ"
    assert resolve_term("ねこ", "ねこ") is None


def test_plans():
    assert plan("猫", LEXICON).clauses == ((Phrase(("猫",)),),)
    assert plan("猫が見る", LEXICON).clauses == ((Near(("猫", "見る"), 3), Phrase(("猫が見る",))),)
    assert plan("ネコ", LEXICON).clauses[0][0] == Phrase(("ネコ",), "base_forms")
    assert plan('"猫が"', LEXICON).exact and not plan("猫が", LEXICON).exact
    assert plan("-犬", LEXICON).empty and plan("た", LEXICON).bound == ("た", "た")
    assert plan("…", LEXICON).clauses == ()
    assert chosen_media("manga, subs") == ("subs", "manga") and chosen_media(None) == ("subs", "epub", "manga", "custom")
    assert chosen_sort("x") == "recommended"


def test_pieces_part_no_character():
    assert text_pieces("あいう", 7) == ["あい", "う"] and text_pieces("") == [""]


SCHEMA = "media string, source_id long, row_id long, file string, folder string, line string, clean_text string, base_forms string, readings string, chars int"


def _lines(spark):
    rows = [
        (1, "a b c d", "p q", "a-b c d"), (2, "p q", "r s", "p q r s"), (3, "a x b", None, "a x b"), (4, None, "a b", "AB"), (5, "が", "が", "が"), (6, "か", "か", "か"),
        (7, "a  b　c", "x", "a b c"), (8, None, None, None),
    ]
    return spark.createDataFrame([("subs", 1, i, "s/1", "s", t, t, b, r, None) for i, b, r, t in rows], SCHEMA)


def test_phrases_stay_in_one_column_and_near_counts_tokens(spark):
    lines = _lines(spark)
    found = lambda p: sorted(r.row_id for r in lines.filter(p).collect())
    assert found(predicates.phrase(("q", "r"))) == []
    assert found(predicates.phrase(("a", "b"))) == [1, 4, 7]
    assert found(predicates.near(("a", "d"), 2)) == [1] and found(predicates.near(("d", "a"), 1)) == []
    assert found(predicates.near(("a", "b"), 1)) == [1, 3, 4, 7]
    assert found(predicates.phrase(("か",))) == [6]
    assert found(predicates.like("ab")) == [4]


def test_search_orders_pages_and_counts(spark):
    rows = [("subs", 1, i, f"s/{i % 3}", f"show{i % 2}", f"駅 {'あ' * (i % 7)}", f"駅 {'あ' * (i % 7)}", "駅 あ", "えき", None) for i in range(40)]
    engine = search.Engine(spark.createDataFrame(rows + rows[:5], SCHEMA), SpacedAnalyzer())
    for sort in ("recommended", "desc", "asc", "random", "chrono"):
        every = [(r.folder, r.row_id) for r in engine.search("駅", sort=sort, seed=3, limit=None).page.collect()]
        paged = [(r.folder, r.row_id) for k in range(0, 60, 7) for r in engine.search("駅", sort=sort, seed=3, limit=7, offset=k).page.collect()]
        assert every == paged and len(set(every)) == len(every) == (40 if sort == "chrono" else 14)
    result = engine.search("駅", limit=7)
    assert result.total() == 14 and result.has_more() and not engine.search("駅", limit=14).has_more()
    assert sum(r.hits for r in result.folder_counts.collect()) == 14
    assert engine.search("-駅").page.count() == 0 and engine.search(None).total() == 0
    assert engine.counts("駅 -x") is None and engine.counts('"駅"') is None


def test_reading_search_and_ruby(spark):
    rows = [("subs", 1, 1, "f", "w", "辛い味", "辛い味", "辛い 味", "からい あじ", None), ("subs", 1, 2, "f", "w", "辛い日", "辛い日", "辛い 日", "つらい ひ", None), ("subs", 1, 3, "f", "v", "｜辛(つら)い", "辛い", "辛い", "からい", None)]
    engine = search.Engine(spark.createDataFrame(rows, SCHEMA), SpacedAnalyzer())
    ids = lambda q, **kw: sorted(r.row_id for r in engine.search(q, **kw).page.collect())
    assert ids("辛い=つらい") == [2, 3] and ids("辛い=からい") == [1] and ids("辛い -辛い=つらい") == [1]
    assert ids("辛い=つらい", ruby_only=True) == [3]
