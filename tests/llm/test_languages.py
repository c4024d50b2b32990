"""p7: a file has a language with a confidence, every line has a row, and no language is left out of the counts."""

from lineloom.llm.language import count_languages, train
from lineloom.session import local_session, ship


def test_a_french_file_has_its_language_and_count():
    spark = local_session(2, 8)
    ship(spark)
    french = "Le tiroir était déjà fermé quand nous avons oublié la fenêtre."
    english = "There was something cheerful about the morning that the harbour kept."
    model = train([(french, "fr"), (english, "en")] * 20)
    df = spark.createDataFrame([(1, "a", french), (2, "a", french), (3, "a", "..."), (4, "b", None)], "row_id long, file string, line string")
    a, b = count_languages(df, "file", "line", model).orderBy("file").collect()
    assert (a.lines, a.fr, a.en, a.lang) == (3, 2, 0, "fr") and 0.5 < a.lang_confidence <= 1
    assert (b.lines, b.lang, b.lang_confidence) == (1, None, None)


def test_there_is_a_query_of_lines():
    from __spark_entry__ import queries

    assert "p7_lines" in queries()


def test_languages_that_the_sample_lacks_are_other():
    from lineloom.llm.language import line_language, plain, words

    model = train([("The quick brown fox jumps over the lazy dog.", "en"), ("Le renard brun saute par-dessus le chien.", "fr")] * 20)
    for text, lang in (("Sono molto stanco oggi", "other"), ("Je suis fatigué aujourd'hui", "fr"), ("I am very tired today", "en")):
        cut = words(plain(text))
        assert line_language(cut[0], *model.decode([cut])[0])[0] == lang


def test_documents_get_a_language_and_wrong_records_are_told():
    from lineloom.llm.language import held_out, label_documents, train_on

    spark = local_session(2, 8)
    ship(spark)
    texts = {"fr": "Où as-tu caché la rivière, mon frère {} ?", "en": "There was something cheerful about morning {}.", "ja": "今朝から駅が古いままだ。その{}は妹に渡した。"}
    rows = [(i, texts[x].format(i) + "\n" + texts[x].format(i + 1), x, f"s{i % 11}") for i, x in enumerate(list(texts) * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert all(r.right >= 0.9 * r.lines for r in held_out(df).collect())
    model = train_on(df)
    asked = [(1, texts["fr"].format(9), "en"), (2, texts["ja"].format(9), None), (2, texts["ja"].format(9), None), (3, None, "fr"), (4, "...", "de")]
    found = label_documents(spark.createDataFrame(asked, "doc_id long, text string, lang string"), model).orderBy("doc_id").collect()
    assert [(r.doc_id, r.lang, r.fault) for r in found] == [(1, "fr", "wrong"), (2, "ja", "missing"), (3, None, None), (4, None, None)]


def test_an_empty_table():
    spark = local_session(2, 8)
    ship(spark)
    df = spark.createDataFrame([], "row_id long, file string, line string")
    assert count_languages(df, "file", "line", train([])).count() == 0
