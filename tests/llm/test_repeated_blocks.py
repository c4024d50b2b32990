"""p1: blocks against brute force, and the same blocks however the documents are spread."""

import random

import pytest

from lineloom.llm.repeated_lines import find_blocks, repeated_blocks, repeated_rows
from lineloom.session import local_session, ship


@pytest.fixture(scope="module")
def spark():
    spark = local_session(2, 8)
    ship(spark)
    return spark


def _brute(rows, min_documents=4, min_share=0.3):
    """({(depth, in_documents, documents, example)}, {row_id}) of (row_id, folder, file, line)."""
    docs, total = {}, {}
    for row, folder, file, line in sorted(set(rows)):
        docs.setdefault((folder, file), []).append((row, line))
    for folder, _ in docs:
        total[folder] = total.get(folder, 0) + 1
    stands = {}
    for (folder, file), lines in docs.items():
        for i in range(len(lines)):
            for d in range(1, len(lines) - i + 1):
                part = tuple(x[1] for x in lines[i : i + d])
                if not all(part):
                    break
                stands.setdefault((folder, part), {}).setdefault(file, lines[i][0])
    often = {k for k, v in stands.items() if len(v) >= min_documents and len(v) >= total[k[0]] * min_share}
    blocks, covered = set(), set()
    for (folder, file), lines in docs.items():
        depths = []
        for i in range(len(lines)):
            depths.append(max((d for d in range(1, len(lines) - i + 1) if (folder, tuple(x[1] for x in lines[i : i + d])) in often), default=0))
        for i, d in enumerate(depths):
            covered |= {lines[i + k][0] for k in range(d)}
            if d and (i == 0 or depths[i - 1] < d + 1):
                key = (folder, tuple(x[1] for x in lines[i : i + d]))
                blocks.add((d, len(stands[key]), total[folder], min(stands[key].values())))
    return blocks, covered


def _frame(spark, rows):
    return spark.createDataFrame(rows, "row_id long, folder string, file string, line string")


def test_a_block_over_spread_documents_is_found_whole(spark):
    block = ["opening song", "first verse", "second verse", "third verse", "last verse"]
    rows, names = [], "abcdefgh"
    for f in range(8):
        for text in ["talk " + names[f], *block, "more " + names[f], "opening song", "end " + names[f]]:
            rows.append((len(rows), "show", f"show/{f}", text))
    found = {(r.depth, r.in_documents, r.documents, r.example) for r in repeated_blocks(_frame(spark, rows), "folder", "file", "line").collect()}
    assert found == {(5, 8, 8, 1), (1, 8, 8, 1)}


@pytest.mark.parametrize("partitions", [1, 8, 64])
def test_random_documents_agree_with_brute_force(spark, partitions):
    rng, rows = random.Random(5), []
    for folder in ("one", "two"):
        for f in range(9):
            for _ in range(rng.randint(1, 14)):
                rows.append((len(rows) * 9000, folder, f"{folder}/{f}", rng.choice(["alpha", "beta", "gamma", "delta", "", "epsilon"])))
    rows += rows[:7]  # delivered twice
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        blocks, covered = _brute(rows)
        found = find_blocks(_frame(spark, rows), "folder", "file", "line")
        assert {(r.depth, r.in_documents, r.documents, r.example) for r in found.blocks().collect()} == blocks
        assert {r.row_id for r in found.covered().collect()} == covered
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_empty_and_null_input(spark):
    assert repeated_blocks(_frame(spark, []), "folder", "file", "line").count() == 0
    assert repeated_rows(_frame(spark, [(i, None, None, None) for i in range(5)]), "folder", "file", "line").count() == 0
    rows = [(i, None, str(i), "same line") for i in range(4)]  # a null source is one of its own
    assert repeated_rows(_frame(spark, rows), "folder", "file", "line").count() == 4
