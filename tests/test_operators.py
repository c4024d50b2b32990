"""Operators against small cases worked out by hand, and invariants."""

import pytest
from pyspark.sql import functions as F

from lineloom.operators import context, duplicates, incremental, joins, known, library, windows
from lineloom.operators.running import positions, running


def test_running_values_over_buckets(spark):
    rows = [("g", i * 3, i % 4) for i in range(200)] + [(None, 5, 1), (None, 7, 0)]
    df = spark.createDataFrame(rows, "g string, o long, v int")
    mark = F.when(F.col("v") == 0, F.col("o"))
    for backward in (False, True):
        for inclusive in (False, True):
            found = {(r.g, r.o): (r.s, r.last) for r in running(df, ["g"], "o", {"s": F.col("v")}, {"last": mark}, backward, inclusive, bucket=16).collect()}
            for g, o, _ in rows:
                own = sorted((x for x in rows if x[0] == g), key=lambda x: x[1], reverse=backward)
                upto = own[: [x[1] for x in own].index(o) + inclusive]
                marks = [x[1] for x in upto if x[2] == 0]
                assert found[(g, o)] == (sum(x[2] for x in upto), marks[-1] if marks else None)
    assert positions(df.limit(0), ["g"], "o").count() == 0


def test_context_is_held_to_its_file(spark):
    lines = spark.createDataFrame([(i, 1 if i < 5 else 2, "a" if i < 5 else "b") for i in range(10)], "row_id long, source_id long, file string")
    found = context.context(lines, spark.createDataFrame([(4,)], "row_id long"), 2, 99).collect()
    assert sorted(r.row_id for r in found) == [2, 3, 4]
    assert context.page_edges([0, 12, 30], 100, 10, 10) == (12, 30)


def test_episode_order_puts_films_first_and_seasons_in_order(spark):
    names = ["s/S02E01.srt", "s/S01E02.srt", "s/S01E01.srt", "s/OVA 1.srt", "s/劇場版.srt", "s/第二期/第1話.srt"]
    found = context.episode_order(spark.createDataFrame([("s", n) for n in names], "folder string, file string")).orderBy("episode").collect()
    assert [r.file for r in found] == ["s/S01E01.srt", "s/S01E02.srt", "s/S02E01.srt", "s/第二期/第1話.srt", "s/OVA 1.srt", "s/劇場版.srt"]


def test_range_and_as_of_joins_agree_with_brute_force(spark):
    points = [(k, i) for k in "ab" for i in range(0, 60, 7)] + [("a", None)]
    ranges = [("a", 0, 13, "x"), ("a", 10, 30, "y"), ("b", 50, 55, "z"), ("b", 9, 3, "bad")]
    p, r = spark.createDataFrame(points, "k string, at long"), spark.createDataFrame(ranges, "k string, lo long, hi long, n string")
    found = sorted((x.k, x.at, x.n) for x in joins.range_join(p, r, "at", "lo", "hi", ["k"], width=8).collect())
    assert found == sorted((k, i, n) for k, i in points for kk, lo, hi, n in ranges if i is not None and k == kk and lo <= i <= hi)
    starts = [("a", 7, 1), ("a", 30, 2), ("b", 0, 3), ("a", 7, 9)]
    s = spark.createDataFrame(starts, "k string, start long, v int")
    found = {(x.k, x.at): x.v for x in joins.as_of(p, s, "at", "start", ["v"], ["k"]).collect()}
    for k, i in points[:-1]:
        before = [(st, v) for kk, st, v in starts if kk == k and st <= i]
        assert found[(k, i)] == (max(before)[1] if before else None)


def test_counting_chains(spark):
    rows = [("f", at, n) for at, n in [(1, 1), (2, 1), (5, 2), (6, 7), (9, 3), (12, 2)]]
    found = windows.counting_chains(spark.createDataFrame(rows, "file string, row_id long, number int"), "file", "row_id", "number").collect()
    assert sorted((r.row_id, r.number) for r in found) == [(1, 1), (5, 2), (9, 3)]


def test_known_words(spark):
    words = known.Vocabulary.of([("a",), ("b",), ("c", "d"), ("…",)], {"p"})
    assert words.singles == {"a", "b"} and words.phrases == {("c", "d")} and words.check(f"only:{words.fingerprint}") == "only"
    with pytest.raises(ValueError):
        words.check("only:x")
    rows = [("subs", i, t) for i, t in enumerate(["t a b", "t a x", "t a c d", "t c x", "a b", "t p … a", "t x x", None])]
    found = known.classify(spark.createDataFrame(rows, "media string, row_id long, base_forms string"), ("t",), words).orderBy("row_id").collect()
    assert [(r.known, r.total, r.i1) for r in found] == [(2, 3, True), (1, 3, False), (3, 4, True), (0, 3, False), (2, 2, False), (1, 2, True), (0, 2, False), (0, 0, False)]
    found = known.classify(spark.createDataFrame(rows, "media string, row_id long, base_forms string"), ("a",), words).orderBy("row_id").collect()
    assert [r.i1 for r in found] == [True, False, True, False, False, True, False, False]
    assert words.joined(known.Vocabulary.of([("z",)])).singles == {"a", "b", "z"} and known.is_grammar("…") and not known.is_grammar("a")
    two = known.classify(spark.createDataFrame([("subs", 1, "t u a")], "media string, row_id long, base_forms string"), ("t", "u"), words).first()
    assert (two.known, two.total, two.i1) == (1, 2, True)


def test_similar_pairs_lose_none(spark):
    import random

    rng, docs = random.Random(3), {}
    for d in range(40):
        base = docs[rng.randrange(d)] if d and rng.random() < 0.6 else set()
        docs[d] = {k for k in base if rng.random() < 0.9} | {rng.randrange(60) for _ in range(rng.randint(1, 12))} | {999}
    keys = spark.createDataFrame([(d, k) for d, ks in docs.items() for k in ks], "doc long, key long")
    for t in (0.3, 0.5, 0.8, 1.0):
        wanted = {(a, b, len(docs[a] & docs[b])) for a in docs for b in docs if a < b and len(docs[a] & docs[b]) >= t * max(len(docs[a]), len(docs[b]))}
        assert {(r.a, r.b, r.shared) for r in duplicates.similar_pairs(keys, t).collect()} == wanted


def test_classes_copies_and_leaders(spark):
    sets = {1: "abcdefghij", 2: "abcdefghij", 3: "abcdefghik", 4: "abcdefghlk", 5: "zyxw", 6: "q"}
    keys = spark.createDataFrame([(d, ord(c)) for d, s in sets.items() for c in s], "doc long, key long")
    found = {r.doc: (r.leader, r["class"], r.links) for r in duplicates.classes(keys, 0.9).collect()}
    assert found == {1: (1, 1, 1), 2: (1, 1, 1), 3: (3, 1, 2), 4: (4, 1, 1), 5: (5, 5, 0), 6: (6, 6, 0)}
    files = spark.createDataFrame([(d, "s", d) for d in sets], "doc long, scope string, rank long")
    assert {(r.doc, r.keeper) for r in duplicates.leaders_in_scope(files, keys, "scope", "rank", 0.9).collect()} == {(2, 1), (3, 1)}
    pairs = spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long")
    assert {r.component for r in duplicates.components(pairs).collect()} == {0}
    groups = spark.createDataFrame([("a", "b"), ("b", "c")], "keeper string, member string")
    assert [tuple(r) for r in duplicates.actionable(groups).collect()] == [("a", "b")]
    names = spark.createDataFrame([(n,) for n in ("d/x.ja.srt", "d/x.en.srt", "d/y.ja.srt")], "relpath string")
    assert {(r.relpath, r.keep) for r in duplicates.track_families(names).collect()} == {("d/x.ja.srt", True), ("d/x.en.srt", False)}


def test_sketch_is_the_smallest_keys(spark):
    keys = spark.createDataFrame([(1, k) for k in range(-500, 500)] + [(2, k) for k in range(0, 500)], "doc long, key long")
    a, b = duplicates.sketch(keys).orderBy("doc").collect()
    assert a["keys"] == list(range(-500, -244)) and a.distinct_keys == 1000 and b.distinct_keys == 500
    both = spark.createDataFrame([(list(range(256)), list(range(128)) + list(range(300, 428)))], "a array<long>, b array<long>")
    share = both.select(duplicates.containment(F.col("a"), F.col("b"), F.lit(256), F.lit(256)).alias("x")).first().x
    assert 0.6 < share < 0.7


def test_index_round_trip_and_incremental_equals_rebuild(spark, tmp_path):
    rows = [("subs", s, s * 100 + i, f"w{s % 3}/{s}", f"w{s % 3}", f"line {i}") for s in range(12) for i in range(5)]
    schema = "media string, source_id long, row_id long, file string, folder string, line string"
    lines, path = spark.createDataFrame(rows, schema), str(tmp_path / "index")
    incremental.write_index(lines, path, 4)
    fresh = spark.createDataFrame([("subs", 3, 300, "w0/3", "w0", "new")], schema)
    removed = spark.createDataFrame([("subs", 5)], "media string, source_id long")
    incremental.update_index(spark, path, fresh, removed, 4)
    wanted = incremental.upsert(lines, fresh, removed)
    assert sorted(map(tuple, spark.read.parquet(path).select(*wanted.columns).collect())) == sorted(map(tuple, wanted.collect()))
    staged = str(tmp_path / "staged")
    incremental.write_index(lines.filter("source_id > 0"), staged, 4)
    with pytest.raises(ValueError):
        incremental.swap(spark, staged, path)
    incremental.swap(spark, staged, path, allow_loss=True)
    assert spark.read.parquet(path).count() == 55
    with incremental.WriterLease(str(tmp_path / "lock")), pytest.raises(RuntimeError), incremental.WriterLease(str(tmp_path / "lock")):
        pass


def test_filter_lists(spark, tmp_path):
    rows = spark.createDataFrame([("subs", "a\tb", "", "auto", "1", "2", None)], "media string, name string, reason string, origin string, size string, mtime string, reviewed string")
    incremental.write_filtered(rows, str(tmp_path / "f"))
    back = incremental.read_filtered(spark, str(tmp_path / "f")).first()
    assert (back.media, back.name, back.origin, back.keep) == ("subs", "a b", "auto", "")
    names = rows.select("media", "name")
    assert incremental.unfilter(rows, names).count() == 0
    assert incremental.keep_left_out(rows, names, F.lit("now")).first().reviewed == "now"
    groups = spark.createDataFrame([("k", "m", 0.95, 1, "h")], "keeper string, member string, share double, generation int, sha string")
    choices = spark.createDataFrame([("k", "m", 1)], "keeper string, member string, generation int")
    ok = spark.createDataFrame([("m", "h", "subs")], "relpath string, sha string, media string")
    assert incremental.apply_choices(groups, choices, ok).count() == 1
    assert incremental.apply_choices(groups, choices, ok.withColumn("sha", F.lit("other"))).count() == 0
    assert incremental.worth_compacting(100, 25) and not incremental.worth_compacting(100, 24)


def test_library_names(spark):
    src = spark.createDataFrame([("subs", 1, "show/sub/e1.srt", None, None), ("custom", 2, "cat/cat.txt", None, "cat")], "media string, source_id long, relpath string, title string, category string")
    assert {(r.folder, r.title) for r in library.inner_names(src).collect()} == {("show", "e1"), ("cat", "cat"), ("show", "sub")}
    assert library.lone_files(src.filter("media = 'custom'")).first().relpath == "cat/cat.txt"
