"""Near-duplicate files: line keys, exact copies, pairs above a threshold, classes, and the member to keep."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineloom.session import settle

#: Keys of a sketch.
SKETCH = 256


def line_keys(lines: DataFrame, doc: str, text: str, least: int = 4, keep: str = r"[^\p{L}\p{N}]") -> DataFrame:
    """``doc, key``: the distinct normalised lines of each document, by hash; shorter ones than ``least`` are none."""
    norm = F.lower(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), keep, ""))
    return lines.select(F.col(doc).alias("doc"), norm.alias("norm")).filter(F.length("norm") >= least).select("doc", F.xxhash64("norm").alias("key")).distinct()


def sketch(keys: DataFrame, size: int = SKETCH) -> DataFrame:
    """``doc, keys, distinct_keys``: the ``size`` smallest keys of each document, and how many it has.

    The smallest are chosen in every partition before they come together, so no document is gathered whole.
    """
    salted = keys.withColumn("s", F.pmod("key", F.lit(64)))
    part = salted.groupBy("doc", "s").agg(F.slice(F.array_sort(F.collect_set("key")), 1, size).alias("ks"), F.count("*").alias("n"))
    return part.groupBy("doc").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ks"))), 1, size).alias("keys"), F.sum("n").alias("distinct_keys"))


def containment(a: Column, b: Column, na: Column, nb: Column, of_larger: bool = False, size: int = SKETCH) -> Column:
    """The share of the smaller (or larger) document that both have, estimated from two sketches."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, size)
    j = F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.size(union)
    base = F.greatest(na, nb) if of_larger else F.least(na, nb)
    return F.when((F.size(union) == 0) | (base == 0), F.lit(0.0)).otherwise(F.least(F.lit(1.0), j * (na + nb) / ((1 + j) * base)))


def copies(keys: DataFrame) -> DataFrame:
    """``doc, leader, size``: documents of equal key sets, and the smallest of them. The sets are compared by count and by two sums
    of mixed keys, so that no set is gathered."""
    mixed = keys.withColumn("x", F.xxhash64(F.lit("a"), "key")).withColumn("y", F.xxhash64(F.lit("b"), "key"))
    each = mixed.groupBy("doc").agg(F.count("*").alias("size"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    first = each.groupBy("size", "x", "y").agg(F.min("doc").alias("leader"))
    return each.join(first, ["size", "x", "y"]).select("doc", "leader", "size")


def similar_pairs(keys: DataFrame, threshold: float) -> DataFrame:
    """``a, b, shared, size_a, size_b`` (a < b): all pairs of documents that share at least ``threshold`` of both sets of keys.

    Exact, with no cap on how often a key may stand: two such sets agree in one of their rarest keys, as many as the
    threshold lets them lack and one more, so only those are joined (frequent keys stand last and drop out of the prefix);
    the shared keys of the pairs found are then counted.
    """
    often = keys.groupBy("key").agg(F.count("*").alias("n"))
    ranked = keys.join(often, "key").filter("n > 1")
    sizes = keys.groupBy("doc").agg(F.count("*").alias("size"))
    # keys of one document only are the rarest: they stand before the others, and are counted, not joined
    lone = sizes.join(ranked.groupBy("doc").agg(F.count("*").alias("shared_keys")), "doc").withColumn("lone", F.col("size") - F.col("shared_keys"))
    # how many keys of a document are rarer than those that stand n times: a sum over the few values of n, not a sort of its keys;
    # of equally rare keys all are taken, which only adds to the prefix
    from pyspark.sql import Window

    by_n = ranked.groupBy("doc", "n").agg(F.count("*").alias("have"))
    rarer = F.coalesce(F.sum("have").over(Window.partitionBy("doc").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = by_n.withColumn("rarer", rarer).join(lone, "doc").filter(F.col("rarer") + F.col("lone") < F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1)
    prefix = ranked.join(wanted.select("doc", "n", "size"), ["doc", "n"]).select("doc", "key", "size")
    a, b = (prefix.select(F.col("doc").alias(x), "key", F.col("size").alias(f"size_{x}")) for x in "ab")
    fits = (F.least("size_a", "size_b") >= threshold * F.greatest("size_a", "size_b") - 1e-9) & (F.col("a") < F.col("b"))
    pairs = settle(a.join(b, "key").filter(fits).select("a", "b", "size_a", "size_b").distinct(), "pairs")
    has = keys.select(F.col("doc"), "key")
    both = pairs.join(has.withColumnRenamed("doc", "a"), "a").join(has.withColumnRenamed("doc", "b"), ["b", "key"])
    counted = both.groupBy("a", "b", "size_a", "size_b").agg(F.count("*").alias("shared"))
    return counted.filter(F.col("shared") >= threshold * F.greatest("size_a", "size_b") - 1e-9).select("a", "b", "shared", "size_a", "size_b")


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: the smallest node that links reach. Each round every node takes the smallest label beside it, and then
    the label of its label; lineage is cut by a written table, and rounds end when nothing changes."""
    edges = settle(pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).union(pairs.select(F.col(b), F.col(a))).distinct(), "edges")
    labels = settle(edges.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")).withColumnRenamed("x", "node"), "labels")
    while True:
        seen = edges.join(labels.select(F.col("node").alias("y"), F.col("label").alias("l")), "y").groupBy("x").agg(F.min("l").alias("l"))
        near = labels.join(seen, labels["node"] == seen["x"], "left").select("node", "label", F.least("label", F.coalesce("l", "label")).alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        new = settle(near.join(jump, "low", "left").select("node", "label", F.least("low", F.coalesce("far", "low")).alias("new")), "labels")
        if new.filter("new <> label").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
        labels = new.select("node", F.col("new").alias("label"))


def classes(keys: DataFrame, threshold: float) -> DataFrame:
    """``doc, leader, class, links``: every document with its exact copies' first member, its class, and how many other texts
    are linked to its own. Documents without keys are left out."""
    same = settle(copies(keys), "copies")
    leaders = keys.join(same.filter("doc = leader").select("doc"), "doc", "left_semi")
    pairs = settle(similar_pairs(leaders, threshold), "links")
    links = pairs.select(F.col("a").alias("leader")).union(pairs.select("b")).groupBy("leader").agg(F.count("*").alias("links"))
    found = components(pairs).select(F.col("node").alias("leader"), F.col("component").alias("class"))
    out = same.join(found, "leader", "left").join(links, "leader", "left")
    return out.select("doc", "leader", F.coalesce("class", "leader").alias("class"), F.coalesce("links", F.lit(0)).alias("links"))


def keepers(members: DataFrame, group: str, rank: list[Column]) -> DataFrame:
    """``members`` with ``keep``: whether it is the best of its group by rank; the order must be total."""
    best = members.groupBy(group).agg(F.min(F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)])).alias("__best"))
    return members.join(best, group).withColumn("keep", F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)]).eqNullSafe(F.col("__best"))).drop("__best")


def leaders_in_scope(files: DataFrame, keys: DataFrame, scope: str, rank: str, threshold: float = 0.9) -> DataFrame:
    """``doc, keeper, share``: within each scope, in order of rank, a file joins the best-ranked keeper with which it shares at least
    ``threshold`` of both sets, or becomes one.

    The links above the threshold come from ``similar_pairs`` over all files; only these few are gathered per scope for the
    greedy pass, never the keys.
    """
    pairs = similar_pairs(keys, threshold)
    where = files.select("doc", scope, rank)
    linked = (
        pairs.join(where.select(F.col("doc").alias("a"), F.col(scope).alias("sa"), F.col(rank).alias("ra")), "a")
        .join(where.select(F.col("doc").alias("b"), F.col(scope).alias("sb"), F.col(rank).alias("rb")), "b")
        .filter("sa = sb")
        .withColumn("share", F.col("shared") / F.greatest("size_a", "size_b"))
    )
    first = F.col("ra") < F.col("rb")
    edges = linked.select(F.col("sa").alias("scope"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("better"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("worse"), F.least("ra", "rb").alias("rank_better"), F.greatest("ra", "rb").alias("rank_worse"), "share")
    kind = files.schema["doc"].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        joined: dict = {}
        for worse, part in frame.sort_values(["rank_worse", "rank_better"]).groupby("worse", sort=False):
            for better, share in zip(part["better"], part["share"], strict=True):
                if better not in joined:
                    joined[worse] = (better, share)
                    break
        return pd.DataFrame([(d, k, s) for d, (k, s) in joined.items()], columns=["doc", "keeper", "share"])

    return edges.groupBy("scope").applyInPandas(run, f"doc {kind}, keeper {kind}, share double")


def track_families(files: DataFrame, name: str = "relpath") -> DataFrame:
    """``directory, stem, relpath, track, keep``: files of one stem with several language tracks, the best of which is kept."""
    tracks = "ja ae av as ak az ab en".split()
    path = F.regexp_replace(F.col(name), r"\\", "/")
    found = files.select(F.col(name).alias("relpath"), F.regexp_extract(path, "^(.*?)[^/]*$", 1).alias("directory"), F.regexp_extract(path, rf"(?i)([^/]*)\.({'|'.join(tracks)})\.srt$", 1).alias("stem"), F.lower(F.regexp_extract(path, rf"(?i)\.({'|'.join(tracks)})\.srt$", 1)).alias("track"))
    found = found.filter("stem <> ''").withColumn("rank", F.array_position(F.array(*[F.lit(t) for t in tracks]), F.col("track")))
    many = found.groupBy("directory", "stem").agg(F.count("*").alias("n"), F.min(F.struct("rank", "relpath")).alias("best")).filter("n > 1")
    return found.join(many, ["directory", "stem"]).select("directory", "stem", "relpath", "track", (F.col("relpath") == F.col("best.relpath")).alias("keep"))


def actionable(groups: DataFrame) -> DataFrame:
    """Groups (``keeper, member``) whose keeper is not itself dropped for another's."""
    return groups.join(groups.select(F.col("member").alias("keeper")).distinct(), "keeper", "left_anti")


def text_duplicates(files: DataFrame, lines: DataFrame, threshold: float = 0.8, least_keys: int = 5) -> DataFrame:
    """``doc, keeper, how``: files of the same bytes, else of the same trimmed text, else alike in ``threshold`` of both key sets.

    ``files``: ``doc, sha, text_sha, rank`` (unique); ``lines``: ``doc, line``. The keeper is the best-ranked of its class; a chain
    of copies leads to one keeper.
    """
    links = None
    for column, how in (("sha", "same_bytes"), ("text_sha", "same_text")):
        best = files.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min(F.struct("rank", "doc"))["doc"].alias("keeper"))
        own = files.join(best, column).filter("doc <> keeper").select("doc", "keeper", F.lit(how).alias("how"))
        links = own if links is None else links.unionByName(own)
    first = links.groupBy("doc").agg(F.min(F.struct(F.when(F.col("how") == "same_bytes", 0).otherwise(1).alias("o"), "keeper", "how")).alias("r")).select("doc", "r.keeper", "r.how")
    first = settle(first, "copies")
    keys = line_keys(lines, "doc", "line").join(first.select("doc"), "doc", "left_anti")
    many = keys.groupBy("doc").agg(F.count("*").alias("n")).filter(F.col("n") >= least_keys)
    pairs = settle(similar_pairs(keys.join(many.select("doc"), "doc", "left_semi"), threshold), "pairs")
    member = components(pairs).join(files.select(F.col("doc").alias("node"), "rank"), "node").join(many.withColumnRenamed("doc", "node"), "node")
    best = member.groupBy("component").agg(F.min(F.struct(-F.col("n"), "rank", "node"))["node"].alias("keeper"))
    near = member.join(best, "component").filter("node <> keeper").select(F.col("node").alias("doc"), "keeper", F.lit("similar_text").alias("how"))
    near = settle(near, "near")
    moved = near.select(F.col("doc").alias("keeper"), F.col("keeper").alias("moved"))
    return first.join(moved, "keeper", "left").select("doc", F.coalesce("moved", "keeper").alias("keeper"), "how").unionByName(near)


def recommend(files: DataFrame, keys: DataFrame, threshold: float = 0.9) -> DataFrame:
    """``doc, keeper, how`` for caption files ``doc, relpath, scope, sha, rank``: language tracks of one stem, then copies of the same
    bytes within a show, then files of a show that share ``threshold`` of both key sets with a better one."""
    tracks = track_families(files).filter("keep").select("directory", "stem", F.col("relpath").alias("best"))
    family = track_families(files).filter("not keep").join(tracks, ["directory", "stem"]).select("relpath", "best")
    names = files.select("doc", "relpath")
    one = family.join(names, "relpath").join(names.select(F.col("doc").alias("keeper"), F.col("relpath").alias("best")), "best").select("doc", "keeper", F.lit("tracks").alias("how"))
    left = files.join(one.select("doc"), "doc", "left_anti")
    best = left.filter("sha is not null").groupBy("scope", "sha").agg(F.min(F.struct("rank", "doc"))["doc"].alias("keeper"))
    two = left.join(best, ["scope", "sha"]).filter("doc <> keeper").select("doc", "keeper", F.lit("same_bytes").alias("how"))
    rest = left.join(two.select("doc"), "doc", "left_anti")
    three = leaders_in_scope(rest, keys.join(rest.select("doc"), "doc", "left_semi"), "scope", "rank", threshold).select("doc", "keeper", F.lit("same_lines").alias("how"))
    return one.unionByName(two).unionByName(three)


def has_author_ruby(line: Column) -> Column:
    """Whether a line that is no song has kana over kanji in bar notation."""
    return F.coalesce(~line.rlike("[♪♬]") & line.rlike(r"｜[^｜()\n]*[一-鿿々][^｜()\n]*\([ぁ-ゖァ-ヺー・ 　]+\)"), F.lit(False))


def sample_files(files: DataFrame, share_of: int, key: str = "relpath") -> DataFrame:
    """About one file in ``share_of``, the same ones each time: those of certain hashes."""
    return files.filter(F.pmod(F.xxhash64(key), F.lit(share_of)) == 0)
