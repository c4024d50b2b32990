"""Problems 8, 9 and 10 on small cases of known answer."""

from lineloom.llm import empty_texts, leaks, packing
from lineloom.session import local_session, ship


def test_every_query_is_registered():
    from __spark_entry__ import queries

    assert {"p8_pack", "p9_found", "p10_found"} <= set(queries())


def test_packing_meets_the_bound_and_keeps_every_text():
    items = [(s, i) for i, s in enumerate([60, 50, 50, 40, 30, 30, 20, 20])]
    held = packing.pack(items, 100)
    assert sorted(i for h in held for i in h) == list(range(8))
    assert all(sum(items[i][0] for i in h) <= 100 for h in held)
    assert len(held) == packing.lower_bound([s for s, _ in items], 100) == 3


def test_only_a_text_longer_than_the_container_is_cut():
    assert packing.token_pieces("あい", 7) == [(0, 2, 7)]
    pieces = packing.token_pieces("あいう", 7)
    assert [p[:2] for p in pieces] == [(0, 2), (2, 1)] and all(p[2] <= 7 for p in pieces)


PASSAGE = "The Dokenost beetle lays 869 eggs beneath an orchestra, and its larvae migrate towards Galvortastas at thaw."


def test_half_of_a_passage_is_found_also_where_changed():
    passages = leaks.Passages([(1, PASSAGE), (2, "作家兰戈晚年住在兰塔，留下了短文和一部关于日记的剧本，并把它们登记在册。")])
    found = lambda text: {i for i, s in passages.search(text) if s >= leaks.HELD}
    assert found("Before. " + PASSAGE.upper().replace(" ", "\n").replace("869", "12") + " After.") == {1}
    assert found(PASSAGE[:30]) == set()


def test_empty_texts_but_not_those_that_speak_of_them():
    model = empty_texts.train([("Access denied.", None, 2), ("Lorem ipsum", None, 3), ("{{name}}", None, 1), ("The wind rose again.", None, 0)])
    judge = lambda t: empty_texts.judge([t], [None], model)[0]
    assert judge("Title\nAccess denied. Your request was blocked by the gateway.") == "notice"
    assert judge("暑い日だった。\n丸い椅子だな、{series_name}？") == "slot"
    assert judge("著者：N/A\n巻数：--") == "slot"
    assert judge("In a mail merge you would type {{name}} and the clerk fills it in, the manual explains.\nThe wind rose again.") is None
    assert judge(None) is None and judge("") is None and judge("\n \n") is None


def test_a_long_text_is_read_to_its_end():
    model = empty_texts.train([("{{name}}", None, 1), ("The wind rose again.", None, 0)] * 5)
    assert empty_texts.judge(["The wind rose again. " * 20_000 + "It was {{weather}}."], [None], model) == ["slot"]


def test_held_out_sources_are_labelled():
    spark = local_session(2, 8)
    ship(spark)
    rows = []
    for i in range(400):
        text = ["The wind rose again over the harbour.", "Access denied. Please log in to continue.", "Lorem ipsum dolor sit amet.", "Dear {{name}}, your {{item}} waits."][i % 4]
        rows.append((i, f"Chapter {i}\n{text} Number {i}.", f"source {i % 23}", f"Title {i}"))
    found = empty_texts.validation(spark.createDataFrame(rows, "doc_id long, text string, source string, title string"))
    assert len(found) == 4 and all(right >= 0.9 * max(pieces, guessed) for _, pieces, guessed, right in found)


def test_empty_table_and_rows_given_twice():
    spark = local_session(2, 8)
    ship(spark)
    schema = "doc_id long, text string, source string, title string, kind string"
    empty = spark.createDataFrame([], schema)
    assert empty_texts.empty_texts(empty, empty_texts.train_on(empty)).count() == 0
    rows = [(1, "Access denied.", "s", None, "x")] * 2 + [(2, None, None, None, None), (None, "Lorem ipsum", "s", "t", "y")]
    df = spark.createDataFrame(rows, schema)
    assert [tuple(r) for r in empty_texts.empty_texts(df, empty_texts.train_on(df)).collect()] == [(1, "notice")]
