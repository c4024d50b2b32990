"""p4: looks and readable forms, and pairs against brute force."""

import itertools
import random

import pytest

from lineloom.llm.lookalike import same_looking_pairs, uniform_texts, with_uniform
from lineloom.session import local_session, ship


@pytest.fixture(scope="module")
def spark():
    spark = local_session(2, 8)
    ship(spark)
    return spark


def test_readable_text_is_not_damaged(spark):
    kept = ["一人で二人の口に力", "千円と八百屋", "日曜日の工事", "Москва", "トカゲ二匹", "一カ月", "テスト一つ", "é ガ", "①²"]
    mended = {"カ一ド": "カード", "エレベ一ター": "エレベーター", "Ｈｅllo": "Hello", "pаper": "paper", "ｶﾞｲﾄﾞ": "ガイド", "ガ": "ガ", "a\u200bb\u00a0c \u3000": "ab c"}
    rows = list(enumerate([*kept, *mended]))
    found = {r.row_id: r.u for r in uniform_texts(spark.createDataFrame(rows, "row_id long, t string"), "row_id", {"t": "u"}).collect()}
    assert [found[i] for i, _ in rows] == [*kept, *mended.values()]


def test_the_most_frequent_form_of_a_look_is_uniform(spark):
    rows = [(1, "工事"), (2, "工事"), (3, "エ事"), (4, None), (5, ""), (5, ""), (None, "x")]
    found = {r.row_id: r.u for r in uniform_texts(spark.createDataFrame(rows, "row_id long, t string"), "row_id", {"t": "u"}).collect()}
    assert found == {1: "工事", 2: "工事", 3: "工事", 4: None, 5: ""}


def test_pairs_agree_with_brute_force(spark):
    rng = random.Random(2)
    texts = ["カード", "カ一ド", "カｰド", "abc", "аbc", "abc ", "ABC", "が", None, ""]
    rows = [(i, rng.randrange(3), rng.choice(texts), rng.choice(["x", "y", None]), "extra") for i in range(60)]
    df = spark.createDataFrame(rows + rows[:4], "row_id long, g long, t string, o string, __key string")
    looks = {r.row_id: r.look for r in with_uniform(df.select("row_id", "t"), {"t": "look"}).collect()}
    wanted = set()
    for a, b in itertools.combinations(rows, 2):
        differ = a[2] != b[2] or (a[3] is not None and b[3] is not None and a[3] != b[3])
        if a[1] == b[1] and a[2] and b[2] and looks[a[0]] == looks[b[0]] and differ:
            wanted.add((a[0], b[0]))
    found = [tuple(r) for r in same_looking_pairs(df, "g", "t", ("o",)).collect()]
    assert len(found) == len(set(found)) and set(found) == wanted
    out = spark.createDataFrame([(rows[0][0],)], "row_id long")
    assert all(rows[0][0] not in tuple(r) for r in same_looking_pairs(df, "g", "t", ("o",), leave_out=out).collect())
    assert same_looking_pairs(df.limit(0), "g", "t", ("o",)).count() == 0


def test_a_name_that_is_taken_is_refused(spark):
    with pytest.raises(ValueError):
        with_uniform(spark.createDataFrame([("a", "b")], "t string, look string"), {"t": "look"})


def test_a_long_text_is_mended_throughout(spark):
    from lineloom.llm.lookalike import with_readable

    text = "カ一ドと一人。pаper " * 20_000
    found = with_readable(spark.createDataFrame([(text,), (None,)], "t string"), {"t": "u"}).collect()
    assert found[0].u == ("カードと一人。paper " * 20_000).rstrip() and found[1].u is None
