"""p3: counts of terms and n-grams against brute force."""

import random
from collections import Counter

import pytest

from lineloom.llm.term_counts import marked_terms, term_counts
from lineloom.session import local_session, ship


@pytest.fixture(scope="module")
def spark():
    spark = local_session(2, 8)
    ship(spark)
    return spark


@pytest.mark.parametrize("most", [1, 3, None])
def test_counts_agree_with_brute_force(spark, most):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, "", " \u3000", *[" ".join(rng.choice("abc") for _ in range(rng.randint(1, 7)))] * 9])) for i in range(80)]
    times, records = Counter(), Counter()
    for _, text in rows:
        words = (text or "").split()
        grams = [(n, " ".join(words[i : i + n])) for n in range(1, (most or 99) + 1) for i in range(len(words) - n + 1)]
        times.update(grams)
        records.update(set(grams))
    df = spark.createDataFrame(rows + rows[:5], "row_id long, t string")
    found = {(r.n, r.term): (r.occurrences, r.records) for r in term_counts(df, ("t",), max_n=most).collect()}
    assert found == {g: (times[g], records[g]) for g in times}


def test_marks_and_empty_tables(spark):
    rows = [(i, "all" + (" few" if i < 2 else "") + (" some" if i < 5 else "")) for i in range(100)] + [(200 + i, None) for i in range(20)]
    df = spark.createDataFrame(rows, "row_id long, t string")
    assert {r.term: r.mark for r in marked_terms(df, ("t",)).collect()} == {"all": "common", "few": "rare", "some": "common"}
    assert marked_terms(df, ("t",), common_share=0.05).filter("term = 'some'").first().mark is None
    assert marked_terms(df.limit(0), ("t",)).count() == 0
    assert term_counts(spark.createDataFrame([(1, "x " * 30_000)], "row_id long, t string"), ("t",)).first().occurrences == 30_000
