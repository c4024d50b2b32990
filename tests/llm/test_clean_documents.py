"""p6: documents are read as trees, wherever their rows stand and however long they are."""

import pytest

from lineloom.llm.markup import clean_documents, clean_line, markup_rows, read_line
from lineloom.session import local_session, ship

LINES = ["# Title", "", "Text, with commas, and more.", "```python", "# no heading", "- no list", "```", "- item", "- [link](http://a.example)", "~~~", "open to the end", "<pre>x", "y = 1", "</pre>"]
KINDS = ["heading", "blank", "paragraph", "code_begin", "code", "code", "code_end", "list", "list", "syntax", "paragraph", "code_begin", "code", "code_end"]


@pytest.fixture(scope="module")
def spark():
    spark = local_session(2, 8)
    ship(spark)
    return spark


@pytest.mark.parametrize("shift", [0, 65530, 65533])
def test_a_document_reads_alike_wherever_its_rows_stand(spark, shift):
    df = spark.createDataFrame([(shift + i, "a.md", x) for i, x in enumerate(LINES)], "row_id long, file string, line string")
    assert [r.kind for r in clean_documents(df, "file", "line").orderBy("row_id").collect()] == KINDS
    assert sorted(r.row_id - shift for r in markup_rows(df, "file", "line").collect()) == [0, 3, 6, 7, 8, 9, 11, 13]


def test_a_speakers_dash_is_no_list_in_captions():
    assert read_line("- <i>Where</i> to?", captions=True)[2:5] == ("paragraph", "- Where to?", 0)
    assert read_line("- Where to?")[2:5] == ("list", "Where to?", 1)


@pytest.mark.parametrize(
    "line, clean",
    [
        (r"\href{https://e.example}{the text}", "the text"),
        (r"\frac{1}{2} and \alpha x", r"\frac{1}{2} and \alpha x"),
        (r"\textbf{bold} \cite{x}", "bold"),
        ("{{ruby|漢字|かんじ}}と{{nowrap|10 km}}", "漢字と10 km"),
        ("{{cite web|url=x|title=y}}", ""),
        ("***bold*** and snake__case__name", "bold and snake__case__name"),
        ("&amp;amp;amp;amp;lt;", "<"),
        ("[[File:a.png]][[page|name]]", "name"),
        ("", ""),
    ],
)
def test_cleaning_keeps_what_is_shown(line, clean):
    assert clean_line(line, stars=True) == clean


def test_navigation_is_no_content(spark):
    lines = ["[a](http://a.example) [b](http://b.example)", "# One", "A long paragraph, with commas, and with much to say about many things."]
    df = spark.createDataFrame([(i, "f", x) for i, x in enumerate(lines)], "row_id long, file string, line string")
    assert [r.main for r in clean_documents(df, "file", "line").orderBy("row_id").collect()] == [False, True, True]


def test_empty_and_null_input(spark):
    schema = "row_id long, file string, line string, kind string, main int"
    assert clean_documents(spark.createDataFrame([], schema), "file", "line").count() == 0
    df = spark.createDataFrame([(1, None, None, "x", 1), (1, None, None, "x", 1), (2, None, "<b>x</b>" * 5000, "x", 1), (None, "a", "b", "c", 2)], schema)
    found = clean_documents(df, "file", "line").orderBy("row_id").collect()
    assert [(r.row_id, r.kind, len(r.text)) for r in found] == [(1, "blank", 0), (2, "paragraph", 5000)]
