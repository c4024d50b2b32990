"""p2: noise planted in volumes made here, and its repair, over block borders too."""

import pytest

from lineloom.llm import scanned
from lineloom.session import local_session, ship

SCHEMA = "row_id long, volume string, page int, line string, title string, extra string"


@pytest.fixture(scope="module")
def spark():
    spark = local_session(2, 8)
    ship(spark)
    return spark


def _volumes():
    rows, marks = [], set()

    def add(volume, page, line, title, *noise):
        rows.append((len(rows) + 1, volume, page, line, title, "x"))
        marks.update((len(rows), n) for n in noise)

    for page in range(1, 301):
        add("en", page, f"The Ancient Harbour {page}" if page % 2 else f"The Ancicnt Harbour {page}", "The Ancient Harbour", "running_head")
        add("en", page, "Every apartment was ancient and every window stood open", "The Ancient Harbour")
        if page in (40, 256):
            add("en", page, "when the ancicnt gov-", "The Ancient Harbour", "split_word", "misread")
        else:
            add("en", page, "when the ancient gov-", "The Ancient Harbour", "split_word")
        add("en", page, "ernment met the well-known merchant of the ancient harbour.", "The Ancient Harbour")
        add("en", page, str(page + 4).replace("1", "l") if page % 3 else f"- {page + 4} -", "The Ancient Harbour", "page_number")
    for page in range(1, 61):
        add("ja", page, "　今日も図書館を探してエレベーターに乗った。" if page % 9 else "　今日も図書舘を探してエレベ一ターに乗った。", "鳥の話", *([] if page % 9 else ["misread"]))
        add("ja", page, "そして電話を待った。", "鳥の話")
        add("ja", page, f"{page}", "鳥の話", "page_number")
    return rows, marks


def test_planted_noise_is_found(spark):
    rows, marks = _volumes()
    found = {tuple(r) for r in scanned.find_noise(spark.createDataFrame(rows + rows[:9], SCHEMA)).collect()}
    assert found == marks


def test_paragraphs_are_repaired_and_numbered_in_their_volume(spark):
    rows, _ = _volumes()
    found = scanned.paragraphs(spark.createDataFrame(rows, SCHEMA)).collect()
    keys = [(r.volume, r.paragraph) for r in found]
    assert len(set(keys)) == len(keys)
    text = " ".join(r.text for r in sorted(found, key=lambda r: r.first_row))
    assert "ancicnt" not in text and "舘" not in text and "エレベ一" not in text and "gov-" not in text
    assert text.count("when the ancient government met the well-known merchant") == 300
    assert sum(r.volume == "ja" for r in found) == 60 and "Harbour 7" not in text


def test_a_text_without_paragraphs_is_one(spark):
    rows = [(i, "v", i // 3, f"word{i} and more", None, None) for i in range(30)]
    assert [r.paragraph for r in scanned.paragraphs(spark.createDataFrame(rows, SCHEMA)).collect()] == [0]


def test_exchanges_of_any_number_and_length():
    assert scanned.exchanges("1antern", "lantern") == (1, 0) and scanned.exchanges("lantern", "1antern") is None
    assert scanned.exchanges("modem", "modern") == (1, 4) and scanned.word_key("modem") == scanned.word_key("modern")
    long = "エレベーター" * 30
    assert scanned.exchanges(long.replace("エ", "工").replace("タ", "夕"), long) == (60, 0)
    assert scanned.word_key(long.replace("タ", "夕")) == scanned.word_key(long)


def test_empty_and_null_input(spark):
    assert scanned.find_noise(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, None, None, None, None, None), (1, None, None, None, None, None), (2, "v", None, "", None, None), (3, None, 1, "x" * 50_000, None, None), (None, "v", 1, "y", None, None)]
    assert scanned.find_noise(spark.createDataFrame(rows, SCHEMA)).count() == 0
    assert [len(r.text) for r in scanned.paragraphs(spark.createDataFrame(rows, SCHEMA)).collect()] == [50_000]
