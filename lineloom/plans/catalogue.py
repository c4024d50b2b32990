"""The catalogue: each operator as a query over the tables, with SQL that states the same where SQL can.

``@query(sql)`` registers a function of (spark, sf_dir) under its name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.functions import measure, script
from lineloom.operators import context, duplicates, health, incremental, joins, known, library, predicates, search, windows
from lineloom.plans.analyzers import SimpleAnalyzer
from lineloom.plans.query import plan
from lineloom.session import table
from lineloom.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# ------------------------------------------------------------------ pieces of SQL

SUBS = """subs AS (SELECT DISTINCT 'subs' AS media, source_id, row_id, file, folder, line, clean_text, base_forms, readings, CAST(chars AS INTEGER) AS chars FROM subtitles)"""
LINES = f"""{SUBS}, lines AS (SELECT * FROM subs
  UNION ALL SELECT DISTINCT 'manga', source_id, row_id, file, folder, line, line, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(chars AS INTEGER) FROM manga
  UNION ALL SELECT DISTINCT 'custom', source_id, row_id, file, string_split_regex(file, '[\\\\/]')[1], line, clean_text, NULL, NULL, CAST(NULL AS INTEGER) FROM custom)"""
SOURCES = """src AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY media, source_id ORDER BY format_version DESC, file_mtime_ns DESC, indexed_at DESC) AS rn
  FROM (SELECT DISTINCT * FROM sources)) WHERE rn = 1)"""
FILES = """newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY media, relpath ORDER BY file_mtime_ns DESC, format_version DESC, source_id DESC, file_size DESC, sha DESC) AS rn
  FROM (SELECT DISTINCT * FROM files)) WHERE rn = 1)"""


def pad(column: str) -> str:
    return f"(' ' || trim(regexp_replace(lower(coalesce({column}, '')), '[ \\t　]+', ' ', 'g')) || ' ')"


def has(words: str) -> str:
    return f"(contains({pad('base_forms')}, ' {words} ') OR contains({pad('readings')}, ' {words} '))"


def shown(column: str = "line") -> str:
    bare = f"regexp_replace({column}, '｜([^｜()\\n]+)\\(([^()\\n]*)\\)', '\\1', 'g')"
    return f"CAST(coalesce(length(regexp_replace(regexp_replace({bare}, '[ 　。…―～！？”“!?]', '', 'g'), '[^\\p{{L}}\\p{{N}}_、.,]', '', 'g')), 0) AS INTEGER)"


def scored(where: str, term: str, spoken: str | None = None) -> str:
    """Matches with exact, chars and score."""
    typed = f"contains(string_split(coalesce(clean_text, ''), chr(8233))[1], '{term}')"
    said = f" OR contains(regexp_replace(coalesce(readings, ''), '[ \\t　]+', '', 'g'), '{spoken or term}')"
    return f"""hits AS (SELECT *, ({typed}{said}) AS exact, coalesce(chars, {shown()}) AS c FROM lines WHERE {where}),
scored AS (SELECT media, source_id, row_id, file, folder, line, c AS chars, exact, exp(-0.5 * ((c - 27) / 15.0) * ((c - 27) / 15.0)) + CASE WHEN exact THEN 0.5 ELSE 0 END AS score FROM hits),
first AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY media, folder, line ORDER BY row_id) = 1)"""


RANK = "CASE media WHEN 'subs' THEN 0 WHEN 'epub' THEN 1 WHEN 'manga' THEN 2 ELSE 3 END"
SHOWN_COLUMNS = ["media", "folder", "row_id", "line", "chars", "exact", "score"]


def _engine(spark: SparkSession, sf_dir: str) -> search.Engine:
    return search.Engine(tables.all_lines(spark, sf_dir))


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select(*SHOWN_COLUMNS[:-1], F.round("score", 6).alias("score"))


def _first(where: str, term: str, spoken: str | None = None, tail: str = "") -> str:
    return f"WITH {LINES}, {scored(where, term, spoken)} SELECT media, folder, row_id, line, chars, exact, round(score, 6) AS score FROM first {tail}"


# ------------------------------------------------------------------ search


@query(_first(has("駅"), "駅"))
def search_rows(spark, sf_dir):
    return _shown(_engine(spark, sf_dir).search("駅", limit=None).rows)


@query(_first(has("駅"), "駅", None, f"ORDER BY first.score DESC, {RANK}, line, row_id LIMIT 200"))
def search_recommended(spark, sf_dir):
    return _shown(_engine(spark, sf_dir).search("駅", limit=200).page)


@query(_first(has("駅"), "駅", None, f"ORDER BY chars DESC, {RANK}, line, row_id LIMIT 100 OFFSET 50"))
def sort_length_desc(spark, sf_dir):
    return _shown(_engine(spark, sf_dir).search("駅", sort="desc", limit=100, offset=50).page)


@query(_first(has("駅"), "駅", None, f"ORDER BY chars, {RANK}, line, row_id LIMIT 100"))
def sort_length_asc(spark, sf_dir):
    return _shown(_engine(spark, sf_dir).search("駅", sort="asc", limit=100).page)


@query(f"WITH {LINES}, {scored(has('駅'), '駅')} SELECT media, folder, row_id, line, chars, exact, round(score, 6) AS score FROM scored ORDER BY {RANK}, file, row_id LIMIT 150 OFFSET 20")
def sort_chrono(spark, sf_dir):
    return _shown(_engine(spark, sf_dir).search("駅", sort="chrono", limit=150, offset=20).page)


@query(_first(has("駅"), "駅", None, f"ORDER BY md5('7|' || media || '|' || row_id), {RANK}, line, row_id LIMIT 100"))
def sort_random_seeded(spark, sf_dir):
    return _shown(_engine(spark, sf_dir).search("駅", sort="random", seed=7, limit=100).page)


@query(_first(f"{has('駅')} AND {has('描く')}", "駅 描く", "駅描く"))
def search_two_words(spark, sf_dir):
    return _shown(_engine(spark, sf_dir).search("駅 描く", limit=None).rows)


@query(f"WITH {LINES} SELECT media, row_id FROM lines WHERE {has('駅 を')}")
def adjacent_phrase(spark, sf_dir):
    rows = tables.all_lines(spark, sf_dir).filter(predicates.phrase(("駅", "を")))
    return rows.select("media", "row_id").distinct()


@query(_first("contains(coalesce(clean_text, ''), '駅を') AND " + has("駅を").replace("(contains", "(true OR contains"), "駅を"))
def exact_phrase(spark, sf_dir):
    engine = _engine(spark, sf_dir)
    wanted = plan('"駅を"', engine.analyzer)
    rows = engine.scope().filter(predicates.by_media(lambda m: predicates.literal(wanted.query)))
    return _shown(search.first_rows(search.with_scores(rows.dropDuplicates(["media", "row_id"]), predicates.is_exact(wanted))))


def _near_sql(column: str) -> str:
    return f"""SELECT a.row_id FROM pos a JOIN pos b ON a.row_id = b.row_id AND a.col = b.col AND a.col = '{column}' AND abs(a.i - b.i) <= 3 WHERE a.w = '駅' AND b.w = '描く'"""


@query(f"""WITH {SUBS}, pos AS (SELECT row_id, 'b' AS col, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT row_id, list_filter(string_split_regex(lower(coalesce(base_forms, '')), '[ \\t　]+'), lambda x: x <> '') AS l FROM subs)
UNION ALL SELECT row_id, 'r', unnest(l), generate_subscripts(l, 1) FROM (SELECT row_id, list_filter(string_split_regex(lower(coalesce(readings, '')), '[ \\t　]+'), lambda x: x <> '') AS l FROM subs))
SELECT DISTINCT row_id FROM ({_near_sql('b')} UNION ALL {_near_sql('r')})""")
def near_tokens(spark, sf_dir):
    rows = tables.subtitles(spark, sf_dir).filter(predicates.near(("駅", "描く"), 2))
    return rows.select("row_id").distinct()


@query(_first(f"{has('駅')} AND NOT (contains(coalesce(clean_text, ''), '船') OR contains(coalesce(line, ''), '船') OR contains({pad('base_forms')}, ' 船 '))", "駅"))
def negation(spark, sf_dir):
    return _shown(_engine(spark, sf_dir).search("駅 -船", limit=None).rows)


@query(f"WITH {LINES} SELECT media, row_id FROM lines WHERE contains(lower(coalesce(line, '')), 'vip')")
def like_fallback(spark, sf_dir):
    return tables.all_lines(spark, sf_dir).filter(predicates.like("VIP")).select("media", "row_id").distinct()


@query(f"WITH {LINES} SELECT media, row_id FROM lines WHERE contains(replace(coalesce(clean_text, ''), '=', '＝'), 'a＝')")
def literal_equals(spark, sf_dir):
    return tables.all_lines(spark, sf_dir).filter(predicates.literal("a=")).select("media", "row_id").distinct()


@query(f"""WITH {SUBS} SELECT row_id FROM (SELECT row_id, list_filter(string_split_regex(lower(coalesce(base_forms, '')), '[ \\t　]+'), lambda x: x <> '') AS b,
list_filter(string_split_regex(lower(coalesce(readings, '')), '[ \\t　]+'), lambda x: x <> '') AS r FROM subs)
WHERE CASE WHEN len(b) = len(r) THEN len(list_filter(list_zip(b, r), lambda x: x[1] = '居る' AND starts_with(x[2], 'い'))) > 0
ELSE list_contains(b, '居る') AND len(list_filter(r, lambda x: starts_with(x, 'い'))) > 0 END""")
def bound_auxiliary(spark, sf_dir):
    return tables.subtitles(spark, sf_dir).filter(predicates.bound_auxiliary("居る", "い")).select("row_id").distinct()


READ_SO = """CASE WHEN len(regexp_extract_all(coalesce(line, ''), '｜駅\\(([^()]*)\\)', 1)) > 0 THEN len(list_filter(regexp_extract_all(coalesce(line, ''), '｜駅\\(([^()]*)\\)', 1), lambda r: regexp_replace(r, '[ 　]', '', 'g') IN ('えき', 'えっ'))) > 0
ELSE len(list_filter(list_zip(list_filter(string_split_regex(lower(coalesce(base_forms, '')), '[ \\t　]+'), lambda x: x <> ''), list_filter(string_split_regex(lower(coalesce(readings, '')), '[ \\t　]+'), lambda x: x <> '')), lambda x: x[1] = '駅' AND x[2] IN ('えき', 'えっ'))) > 0 END"""
PREFILTER = "(contains(regexp_replace(coalesce(readings, ''), '[ \\t　]+', '', 'g'), 'えき') OR contains(regexp_replace(coalesce(readings, ''), '[ \\t　]+', '', 'g'), 'えっ') OR coalesce(regexp_matches(line, '｜([^｜()\\n]+)\\(([^()\\n]*)\\)'), false))"


@query(_first(f"{has('駅')} AND contains(coalesce(clean_text, ''), '駅') AND {PREFILTER} AND {READ_SO}", "駅"))
def reading_search(spark, sf_dir):
    return _shown(_engine(spark, sf_dir).search("駅=えき", limit=None).rows)


@query(f"WITH {LINES} SELECT DISTINCT media, folder FROM lines WHERE regexp_matches(line, '｜([^｜()\\n]+)\\(([^()\\n]*)\\)')")
def works_with_ruby(spark, sf_dir):
    return predicates.works_with_ruby(tables.all_lines(spark, sf_dir))


@query(f"WITH {LINES}, {scored(has('駅'), '駅')} SELECT folder, count(*) AS hits FROM first GROUP BY folder")
def folder_counts(spark, sf_dir):
    return _engine(spark, sf_dir).search("駅", limit=None).folder_counts.select("folder", "hits")


@query(f"WITH {LINES} SELECT folder, count(*) AS hits FROM (SELECT DISTINCT media, folder, line FROM lines WHERE {has('駅')}) GROUP BY folder")
def counts_folded(spark, sf_dir):
    return _engine(spark, sf_dir).counts("駅")


@query(f"WITH {LINES} SELECT folder, count(*) AS hits FROM lines WHERE {has('駅')} GROUP BY folder")
def counts_chrono(spark, sf_dir):
    return _engine(spark, sf_dir).counts("駅", sort="chrono")


@query(f"WITH {LINES} SELECT media, row_id, coalesce(chars, {shown()}) AS chars FROM lines WHERE folder = '雨丘物語' ORDER BY file, row_id")
def browse_folder(spark, sf_dir):
    return _engine(spark, sf_dir).browse("雨丘物語").select("media", "row_id", "chars")


@query(f"WITH {LINES} SELECT folder, array_to_string(list_sort(list(DISTINCT media)), ',') AS media FROM lines GROUP BY folder")
def folder_list(spark, sf_dir):
    return _engine(spark, sf_dir).folders().select("folder", F.array_join("media", ",").alias("media"))


@query(f"WITH {LINES} SELECT media, count(DISTINCT row_id) AS lines FROM lines GROUP BY media")
def media_totals(spark, sf_dir):
    return _engine(spark, sf_dir).total()


@query(f"WITH {LINES} SELECT DISTINCT media FROM lines WHERE file = '雨丘物語/E00003.srt'")
def media_of_file(spark, sf_dir):
    return _engine(spark, sf_dir).media_of("雨丘物語/E00003.srt")


@query(f"""WITH {LINES} SELECT media, row_id, place FROM (SELECT media, row_id, CAST(row_number() OVER (PARTITION BY media ORDER BY length(clean_text), row_id) AS INTEGER) AS place
FROM lines WHERE contains(replace(coalesce(clean_text, ''), chr(160), ' '), '駅') AND contains(replace(coalesce(clean_text, ''), chr(160), ' '), '描いた')) WHERE place <= 500""")
def locate_text(spark, sf_dir):
    return _engine(spark, sf_dir).locate(["駅", "描いた"]).select("media", "row_id", "place")


@query("""WITH m AS (SELECT DISTINCT * FROM manga), p AS (SELECT DISTINCT * FROM manga_pages)
SELECT m.row_id, p.page FROM m LEFT JOIN p ON m.row_id = p.row_id""")
def manga_pages_joined(spark, sf_dir):
    rows = tables.manga(spark, sf_dir).dropDuplicates(["media", "row_id"])
    return search.with_pages(rows, table(spark, sf_dir, "manga_pages")).select("row_id", "page")


# documents as lines, words by the simple analyzer

DOCS = r"""cells AS (SELECT doc_id, source, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS row_id, l FROM (SELECT doc_id, source, string_split_regex(text, '\r\n|[\n\r]') AS l FROM documents)),
dl AS (SELECT doc_id, source, CAST(row_id AS BIGINT) AS row_id, line, (row_id > 0 AND trim(l[row_id], ' ') = '') AS gap_before FROM cells WHERE trim(line, ' ') <> ''),
dw AS (SELECT *, ' ' || array_to_string(list_transform(regexp_extract_all(line, '[\p{L}\p{M}\p{N}_]+'), lambda x: lower(x)), ' ') || ' ' AS words FROM dl)"""


@query(f"WITH {DOCS} SELECT doc_id AS source_id, row_id, line, gap_before FROM dl")
def lines_from_documents(spark, sf_dir):
    return tables.document_lines(table(spark, sf_dir, "documents")).select("source_id", "row_id", "line", "gap_before")


@query(f"""WITH {DOCS}, hits AS (SELECT *, {shown()} AS c FROM dw WHERE contains(words, ' harbour ')),
first AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY source, line ORDER BY row_id, doc_id) = 1)
SELECT source AS folder, line, c AS chars, round(exp(-0.5 * ((c - 27) / 15.0) * ((c - 27) / 15.0)) + CASE WHEN contains(line, 'harbour') THEN 0.5 ELSE 0 END, 6) AS score FROM first""")
def kwic_documents(spark, sf_dir):
    engine = search.Engine(tables.document_lines(table(spark, sf_dir, "documents")), SimpleAnalyzer())
    wanted = plan("harbour", engine.analyzer)
    rows = engine.lines.filter(predicates.phrase(("harbour",), "base_forms"))
    scored_rows = search.with_scores(rows, F.col("clean_text").contains(wanted.query))
    return search.first_rows(scored_rows, ("folder", "line")).select("folder", "line", "chars", F.round("score", 6).alias("score"))


# ------------------------------------------------------------------ reader


@query(f"""WITH {SUBS}, focus AS (SELECT row_id, source_id, file FROM subs WHERE contains(coalesce(clean_text, ''), '火鉢'))
SELECT f.row_id AS focus_id, s.row_id FROM focus f JOIN subs s ON s.source_id IS NOT DISTINCT FROM f.source_id AND s.file IS NOT DISTINCT FROM f.file AND s.row_id BETWEEN f.row_id - 4 AND f.row_id + 4""")
def context_window(spark, sf_dir):
    lines = tables.subtitles(spark, sf_dir)
    return context.context(lines, lines.filter(F.col("clean_text").contains("火鉢"))).select("focus_id", "row_id")


@query("""WITH c AS (SELECT DISTINCT * FROM custom), focus AS (SELECT row_id, source_id, section_no FROM c WHERE gap_before)
SELECT f.row_id AS focus_id, s.row_id FROM focus f JOIN c s ON s.source_id = f.source_id AND s.section_no IS NOT DISTINCT FROM f.section_no AND s.row_id BETWEEN f.row_id - 3 AND f.row_id + 3""")
def context_in_section(spark, sf_dir):
    rows = table(spark, sf_dir, "custom")
    return context.context(rows, rows.filter("gap_before"), 3, 3, ("source_id", "section_no")).select("focus_id", "row_id")


@query(f"WITH {SUBS} SELECT row_id, row_number() OVER (PARTITION BY source_id, file ORDER BY row_id) - 1 AS \"offset\" FROM subs")
def reader_offsets(spark, sf_dir):
    return context.offsets(tables.subtitles(spark, sf_dir))


@query(None)
def episodes(spark, sf_dir):
    files = tables.subtitles(spark, sf_dir).select("folder", "file").distinct()
    return context.episode_order(files).select("folder", "file", "kind", "group_rank", "episode")


SAVED = f"""saved AS (SELECT row_id AS saved_id, media, folder, file, row_id + (row_id % 3) AS row_id, line AS text FROM subs WHERE row_id % 20 = 0
UNION ALL SELECT -row_id, media, folder || '?', file, row_id, CASE WHEN row_id % 40 = 0 THEN 'no such line' ELSE line END FROM subs WHERE row_id % 20 = 0)"""


@query(f"""WITH {SUBS}, {SAVED}, hits AS (SELECT v.saved_id, s.media, s.row_id, CASE WHEN v.media = s.media AND v.folder = s.folder THEN CASE WHEN v.row_id = s.row_id THEN 0 ELSE 1 END ELSE 2 END AS how,
  CASE WHEN v.media = s.media AND v.folder = s.folder THEN CAST(v.file <> s.file AS INTEGER) ELSE 0 END AS f, CASE WHEN v.media = s.media AND v.folder = s.folder THEN abs(v.row_id - s.row_id) ELSE 0 END AS d
  FROM saved v JOIN subs s ON v.text = s.line),
best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY saved_id ORDER BY how, f, d, media, row_id) = 1)
SELECT v.saved_id, b.row_id, CASE WHEN b.saved_id IS NULL THEN 'gone' WHEN how = 0 THEN 'same' WHEN how = 1 THEN 'moved' ELSE 'elsewhere' END AS how FROM saved v LEFT JOIN best b ON v.saved_id = b.saved_id""")
def relocate_rows(spark, sf_dir):
    lines = tables.subtitles(spark, sf_dir)
    part = lines.filter("row_id % 20 = 0").dropDuplicates(["row_id"])
    moved = part.select(F.col("row_id").alias("saved_id"), "media", "folder", "file", (F.col("row_id") + F.col("row_id") % 3).alias("row_id"), F.col("line").alias("text"))
    away = part.select((-F.col("row_id")).alias("saved_id"), "media", F.concat("folder", F.lit("?")).alias("folder"), "file", "row_id", F.when(F.col("row_id") % 40 == 0, "no such line").otherwise(F.col("line")).alias("text"))
    return context.relocate(lines, moved.unionByName(away))


@query("""WITH c AS (SELECT DISTINCT * FROM custom), f AS (SELECT row_id, line, row_number() OVER w AS n, section_no, lag(section_no) OVER w AS p FROM c WHERE file = (SELECT min(file) FROM custom) WINDOW w AS (PARTITION BY source_id ORDER BY row_id))
SELECT row_id, n = 1 OR section_no IS DISTINCT FROM p AS fold FROM f ORDER BY row_id LIMIT 20 OFFSET 5""")
def custom_file_page(spark, sf_dir):
    rows = table(spark, sf_dir, "custom")
    file = rows.agg(F.min("file").alias("f")).first().f
    return context.file_page(rows, file, 20, 5).select("row_id", "fold")


@query("""WITH s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY media, source_id ORDER BY format_version DESC, file_mtime_ns DESC, indexed_at DESC) AS rn FROM (SELECT DISTINCT * FROM sources)) WHERE rn = 1 AND media = 'custom')
SELECT 'folder' AS kind, split_part(relpath, '/', 1) AS name, CAST(sum(coalesce(n_lines, 0)) AS BIGINT) AS lines FROM s WHERE contains(relpath, '/') GROUP BY ALL UNION ALL SELECT 'file', relpath, CAST(n_lines AS BIGINT) FROM s WHERE NOT contains(relpath, '/')""")
def custom_folder_page(spark, sf_dir):
    src = tables.sources(spark, sf_dir).filter("media = 'custom'").withColumn("path", F.col("relpath"))
    return context.folder_page(library.folder_tree(src, F.col("relpath")), src, "").select("kind", "name", "lines")


@query(f"WITH {SUBS} SELECT row_id FROM subs WHERE line = 'ありがとう。' ORDER BY file <> '松港の海 0000h/E006.ja.srt', abs(row_id - 7800), row_id LIMIT 1")
def nearest_row(spark, sf_dir):
    rows = tables.subtitles(spark, sf_dir).dropDuplicates(["row_id"])
    return context.nearest_row(rows, "ありがとう。", "松港の海 0000h/E006.ja.srt", 7800).select("row_id")


# ------------------------------------------------------------------ library

WORK = """CASE media WHEN 'subs' THEN string_split_regex(relpath, '[\\\\/]')[1] WHEN 'custom' THEN coalesce(category, string_split_regex(relpath, '[\\\\/]')[1]) ELSE coalesce(title, regexp_replace(relpath, '(?i)\\.(epub|mokuro)$', '')) END"""
SPANS = "spans AS (SELECT media, source_id, file, min(row_id) AS first, max(row_id) AS last, count(DISTINCT row_id) AS lines FROM lines GROUP BY media, source_id, file)"
LIBRARY = f"""{LINES}, {SOURCES}, {SPANS}, counted AS (SELECT media, source_id, sum(lines) AS lines FROM spans GROUP BY media, source_id),
library AS (SELECT s.media, {WORK.replace('media', 's.media')} AS folder, coalesce(max(author), '') AS author, count(*) AS parts, CAST(coalesce(sum(lines), 0) AS BIGINT) AS lines
  FROM src s LEFT JOIN counted c ON s.media = c.media AND s.source_id = c.source_id GROUP BY ALL)"""


def _library(spark, sf_dir):
    return library.media_library(tables.sources(spark, sf_dir), tables.all_lines(spark, sf_dir))


@query(f"WITH {LIBRARY} SELECT media, folder, author, parts, lines FROM library")
def media_library(spark, sf_dir):
    return _library(spark, sf_dir)


@query(f"WITH {LIBRARY} SELECT media, folder, lines FROM library WHERE contains(folder, '橋') OR contains(author, '橋')")
def library_filter(spark, sf_dir):
    return library.library_page(_library(spark, sf_dir), "橋", sort="lines_desc").select("media", "folder", "lines")


@query(f"WITH {LINES}, {SPANS} SELECT * FROM spans")
def chapter_spans(spark, sf_dir):
    return library.chapter_spans(tables.all_lines(spark, sf_dir))


@query(f"""WITH {SOURCES}, parts AS (SELECT string_split_regex(relpath, '[\\\\/]') AS p, n_lines, order_key FROM src),
steps AS (SELECT array_to_string(p[1:k], '/') AS path, n_lines, order_key FROM (SELECT p, n_lines, order_key, unnest(range(0, len(p))) AS k FROM parts))
SELECT path, count(*) AS files, CAST(sum(coalesce(n_lines, 0)) AS BIGINT) AS lines, min(order_key) AS order_key FROM steps GROUP BY path""")
def folder_tree(spark, sf_dir):
    return library.folder_tree(tables.sources(spark, sf_dir), F.col("relpath")).select("path", "files", "lines", "order_key")


@query(f"WITH {SOURCES} SELECT title, count(*) AS n, array_to_string(list_sort(list(DISTINCT relpath)), '|') AS members FROM src WHERE title IS NOT NULL GROUP BY title HAVING count(*) > 1")
def title_clashes(spark, sf_dir):
    return library.title_clashes(tables.sources(spark, sf_dir))


@query(f"""WITH {LINES}, {SOURCES}, {SPANS} SELECT media, source_id FROM (SELECT media, source_id FROM src EXCEPT SELECT media, source_id FROM spans)
UNION SELECT media, source_id FROM spans GROUP BY media, source_id HAVING sum("last" - "first" + 1) <= 30""")
def small_sources(spark, sf_dir):
    return library.small_sources(tables.sources(spark, sf_dir), library.chapter_spans(tables.all_lines(spark, sf_dir)), 30)


@query(f"""WITH {LINES}, {SOURCES}, {SPANS} SELECT s.media, files, CAST(coalesce(l.lines, 0) AS BIGINT) AS lines, outdated FROM
(SELECT media, count(*) AS files, count(*) FILTER (WHERE format_version < CASE media WHEN 'subs' THEN 5 WHEN 'manga' THEN 2 ELSE 7 END) AS outdated FROM src GROUP BY media) s
LEFT JOIN (SELECT media, sum(lines) AS lines FROM spans GROUP BY media) l ON s.media = l.media""")
def library_summaries(spark, sf_dir):
    return library.summaries(tables.sources(spark, sf_dir), library.chapter_spans(tables.all_lines(spark, sf_dir)), {"subs": 5, "manga": 2, "custom": 7})


@query(f"""WITH {FILES}, placed AS (SELECT media, relpath, CAST(row_number() OVER (PARTITION BY media ORDER BY relpath) - 1 AS INTEGER) AS place FROM newest)
SELECT *, CAST(place // 200 AS INTEGER) AS page FROM placed""")
def report_pages(spark, sf_dir):
    return library.report_pages(tables.files(spark, sf_dir).select("media", "relpath"), ["relpath"], "media")


@query(f"""WITH {FILES}, {LINES}, sample AS (SELECT n.media, n.file_size, count(l.row_id) AS lines, coalesce(sum(length(l.line)), 0) AS chars FROM newest n LEFT JOIN lines l ON n.media = l.media AND n.source_id = l.source_id WHERE n.source_id % 7 = 0 GROUP BY n.media, n.relpath, n.file_size),
rate AS (SELECT media, sum(lines) / sum(file_size) AS lr, sum(chars) / sum(file_size) AS cr FROM sample GROUP BY media)
SELECT f.media, files, CAST(round(size * lr) AS BIGINT) AS lines, CAST(round(size * cr * 33.5::DOUBLE) AS BIGINT) AS bytes FROM (SELECT media, count(*) AS files, sum(file_size) AS size FROM newest GROUP BY media) f LEFT JOIN rate r ON f.media = r.media""")
def estimate_index(spark, sf_dir):
    files, lines = tables.files(spark, sf_dir), tables.all_lines(spark, sf_dir).dropDuplicates(["media", "row_id"])
    # a sample is what the operator is about: every seventh source
    part = files.filter("source_id % 7 = 0").join(lines.select("media", "source_id", "row_id", "line"), ["media", "source_id"], "left")
    sample = part.groupBy("media", "relpath", "file_size").agg(F.count("row_id").alias("lines"), F.coalesce(F.sum(F.length("line")), F.lit(0)).alias("chars"))
    return library.estimate(files, sample)


@query(f"""WITH {SOURCES}, named AS (SELECT media, {WORK} AS folder, replace(relpath, chr(92), '/') AS path, relpath FROM src)
SELECT media, folder, regexp_extract(path, '([^/]+?)(?:\\.[A-Za-z0-9]+)?$', 1) AS title, relpath AS file FROM named
UNION ALL SELECT media, folder, title, min(relpath) FROM (SELECT media, folder, relpath, unnest(p[2:len(p) - 1]) AS title FROM (SELECT *, string_split(path, '/') AS p FROM named) WHERE len(p) > 2) GROUP BY media, folder, title""")
def inner_names(spark, sf_dir):
    return library.inner_names(tables.sources(spark, sf_dir))


@query(f"WITH {SOURCES} SELECT category, min(relpath) AS relpath FROM src WHERE media = 'custom' GROUP BY category HAVING count(*) = 1 AND min(regexp_extract(relpath, '([^/]+?)(?:\\.[A-Za-z0-9]+)?$', 1)) = category")
def lone_files(spark, sf_dir):
    return library.lone_files(tables.sources(spark, sf_dir).filter("media = 'custom'"))


@query(f"WITH {SOURCES} SELECT DISTINCT title, author FROM src WHERE author IS NOT NULL")
def folder_authors(spark, sf_dir):
    return tables.sources(spark, sf_dir).filter("author is not null").select("title", "author").distinct()


# ------------------------------------------------------------------ order of rows


@query(f"WITH {LINES} SELECT media, row_id, row_number() OVER (PARTITION BY media, folder, line ORDER BY row_id) > 1 AS is_repeat FROM lines")
def repeat_marks(spark, sf_dir):
    return windows.repeat_marks(tables.all_lines(spark, sf_dir))


PLAIN = "regexp_replace(line, '｜([^｜()\\n]+)\\(([^()\\n]*)\\)', '\\1', 'g')"


@query(f"""WITH {SUBS}, p AS (SELECT file, row_id, line, {PLAIN} AS plain FROM subs), f AS (SELECT *, CASE WHEN plain = lag(plain) OVER (PARTITION BY file ORDER BY row_id) THEN 0 ELSE 1 END AS fresh FROM p),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY file ORDER BY row_id) AS island FROM f)
SELECT file, min(row_id) AS row_id, arg_max(line, struct_pack(a := length(line), b := -row_id)) AS line FROM i GROUP BY file, island""")
def collapse_consecutive(spark, sf_dir):
    lines = tables.subtitles(spark, sf_dir).select("file", "row_id", "line").dropDuplicates(["row_id"])
    return windows.collapse_consecutive(lines, ["file"])


@query(f"""WITH {SUBS}, i AS (SELECT source_id, row_id, row_id - row_number() OVER (PARTITION BY source_id ORDER BY row_id) AS g FROM (SELECT DISTINCT source_id, row_id FROM subs))
SELECT source_id, min(row_id) AS first, max(row_id) AS last, count(*) AS rows FROM i GROUP BY source_id, g""")
def source_ranges(spark, sf_dir):
    return windows.islands(tables.subtitles(spark, sf_dir), ["source_id"], "row_id")


@query(f"""WITH {SUBS}, s AS (SELECT folder, min(row_id) AS first, max(row_id) AS last FROM subs GROUP BY folder, source_id),
f AS (SELECT *, CASE WHEN first <= max(last) OVER (PARTITION BY folder ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM s),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY folder ORDER BY first, last ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT folder, min(first) AS first, max(last) AS last FROM r GROUP BY folder, run""")
def merged_ranges(spark, sf_dir):
    spans = tables.subtitles(spark, sf_dir).groupBy("folder", "source_id").agg(F.min("row_id").alias("first"), F.max("row_id").alias("last"))
    return windows.merge_ranges(spans, group=["folder"])


@query("""WITH c AS (SELECT DISTINCT * FROM custom) SELECT row_id, CAST(sum(CASE WHEN starts_with(line, '#') THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY row_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS section FROM c""")
def numbered_sections(spark, sf_dir):
    rows = table(spark, sf_dir, "custom").dropDuplicates(["row_id"])
    return windows.numbered_sections(rows, ["source_id"], "row_id", F.coalesce(F.col("line").startswith("#"), F.lit(False))).select("row_id", "section")


@query("""WITH c AS (SELECT DISTINCT * FROM custom) SELECT row_id, last_value(CASE WHEN starts_with(line, '#') THEN line END IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY row_id ROWS UNBOUNDED PRECEDING) AS heading FROM c""")
def carried_headings(spark, sf_dir):
    rows = table(spark, sf_dir, "custom").dropDuplicates(["row_id"])
    return windows.carried(rows, ["source_id"], "row_id", F.when(F.col("line").startswith("#"), F.col("line")), "heading").select("row_id", "heading")


@query("""WITH c AS (SELECT DISTINCT * FROM custom), f AS (SELECT row_id, row_number() OVER w AS n, section_no, lag(section_no) OVER w AS p FROM c WINDOW w AS (PARTITION BY source_id ORDER BY row_id))
SELECT row_id, n = 1 OR section_no IS DISTINCT FROM p AS fold FROM f""")
def fold_starts(spark, sf_dir):
    rows = table(spark, sf_dir, "custom").dropDuplicates(["row_id"])
    return windows.fold_starts(rows, ["source_id"], "row_id", "section_no").select("row_id", "fold")


@query(f"""WITH {SUBS}, k AS (SELECT row_id, file, regexp_matches(line, '[ぁ-ゖァ-ヺ]') AS own, NOT regexp_matches(line, '[ぁ-ゖァ-ヺ]') AND regexp_matches(line, '[一-鿿]') AS other FROM subs)
SELECT row_id, own AND (coalesce(lag(other) OVER w, false) OR coalesce(lead(other) OVER w, false)) AS paired FROM k WINDOW w AS (PARTITION BY file ORDER BY row_id)""")
def bilingual_neighbours(spark, sf_dir):
    rows = tables.subtitles(spark, sf_dir).dropDuplicates(["row_id"])
    kana = F.col("line").rlike("[ぁ-ゖァ-ヺ]")
    return windows.beside_other_script(rows, ["file"], "row_id", kana, ~kana & F.col("line").rlike("[一-鿿]")).select("row_id", "paired")


@query(None)
def heading_chains(spark, sf_dir):
    rows = table(spark, sf_dir, "custom").dropDuplicates(["row_id"])
    number = F.expr("try_cast(regexp_extract(line, '([0-9]+)', 1) as int)")
    return windows.counting_chains(rows.withColumn("number", number).filter("number is not null"), "source_id", "row_id", "number")


# ------------------------------------------------------------------ joins and sets


@query(f"""WITH {LINES}, {SPANS}, e AS (SELECT DISTINCT row_id, page FROM manga_pages)
SELECT e.row_id, e.page, s.source_id, s.file FROM e JOIN spans s ON s.media = 'manga' AND e.row_id BETWEEN s."first" AND s."last\"""")
def range_join_runs(spark, sf_dir):
    spans = library.chapter_spans(tables.manga(spark, sf_dir)).select("source_id", "file", "first", "last")
    points = table(spark, sf_dir, "manga_pages").dropDuplicates(["row_id"])
    return joins.range_join(points, spans, "row_id", "first", "last").select("row_id", "page", "source_id", "file")


@query(f"""WITH {SUBS}, starts AS (SELECT min(row_id) AS start, source_id FROM subs GROUP BY source_id), points AS (SELECT DISTINCT row_id FROM subs)
SELECT p.row_id, s.source_id FROM points p ASOF JOIN starts s ON p.row_id >= s.start""")
def as_of_source(spark, sf_dir):
    lines = tables.subtitles(spark, sf_dir)
    starts = lines.groupBy("source_id").agg(F.min("row_id").alias("start"))
    return joins.as_of(lines.select("row_id").distinct(), starts, "row_id", "start", ["source_id"])


@query("""SELECT e.event_id, (SELECT max(s.event_id) FROM events s WHERE s.user_id = e.user_id AND s.event_type = 'error' AND s.ts = (SELECT max(t.ts) FROM events t WHERE t.user_id = e.user_id AND t.event_type = 'error' AND t.ts <= e.ts)) AS last_error
FROM events e""")
def as_of_by_key(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    errors = events.filter("event_type = 'error'").select("user_id", F.col("at").alias("start"), F.col("event_id").alias("last_error"))
    return joins.as_of(events.select("event_id", "user_id", "at"), errors, "at", "start", ["last_error"], ["user_id"]).select("event_id", "last_error")


@query(f"""WITH {SOURCES}, {LINES} SELECT s.media, s.source_id, count(l.row_id) AS lines FROM src s LEFT JOIN lines l ON s.media = l.media AND s.source_id = l.source_id GROUP BY s.media, s.source_id""")
def lines_per_source(spark, sf_dir):
    counted = library.chapter_spans(tables.all_lines(spark, sf_dir)).groupBy("media", "source_id").agg(F.sum("lines").alias("lines"))
    return joins.left_with_sums(tables.sources(spark, sf_dir).select("media", "source_id"), counted, ["media", "source_id"], ["lines"])


@query(f"WITH {SOURCES}, {SUBS} SELECT u.row_id, s.title, s.kind FROM subs u JOIN src s ON s.media = 'subs' AND u.source_id = s.source_id")
def lines_with_source(spark, sf_dir):
    # the sources of a library are a dimension; their size decides whether Spark sends them to all tasks
    src = tables.sources(spark, sf_dir).filter("media = 'subs'").select("source_id", "title", "kind")
    return tables.subtitles(spark, sf_dir).select("row_id", "source_id").distinct().join(src, "source_id").select("row_id", "title", "kind")


@query("SELECT DISTINCT p.row_id, p.page FROM manga_pages p WHERE NOT EXISTS (SELECT 1 FROM manga m WHERE m.row_id = p.row_id AND m.chars IS NOT NULL)")
def orphan_pages(spark, sf_dir):
    return joins.orphans(table(spark, sf_dir, "manga_pages").distinct(), table(spark, sf_dir, "manga").filter("chars is not null"), ["row_id"])


@query("SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')")
def exists_semi(spark, sf_dir):
    open_orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(open_orders, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def customers_without_orders(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("WITH c AS (SELECT DISTINCT * FROM custom), w AS (SELECT DISTINCT source_id, section_no FROM c WHERE gap_before) SELECT row_id FROM c WHERE EXISTS (SELECT 1 FROM w WHERE w.source_id = c.source_id AND w.section_no IS NOT DISTINCT FROM c.section_no)")
def null_safe_semi(spark, sf_dir):
    rows = table(spark, sf_dir, "custom").dropDuplicates(["row_id"])
    return joins.with_rows_like(rows, rows.filter("gap_before"), ["source_id", "section_no"]).select("row_id")


LEXICON = f"""lexicon AS (SELECT folder, x[1] AS base, x[2] AS reading FROM (SELECT folder, unnest(list_zip(regexp_extract_all(line, '｜([^｜()\\n]+)\\(([^()\\n]*)\\)', 1), regexp_extract_all(line, '｜([^｜()\\n]+)\\(([^()\\n]*)\\)', 2))) AS x FROM subs))"""


def _lexicon(spark, sf_dir):
    line = F.coalesce(F.col("line"), F.lit(""))
    pairs = F.arrays_zip(F.regexp_extract_all(line, F.lit(measure.BAR_RUBY), 1).alias("base"), F.regexp_extract_all(line, F.lit(measure.BAR_RUBY), 2).alias("reading"))
    return tables.subtitles(spark, sf_dir).dropDuplicates(["row_id"]).select("folder", F.explode(pairs).alias("p")).select("folder", "p.base", "p.reading")


@query(f"WITH {SUBS}, {LEXICON} SELECT folder, base, array_to_string(list_sort(list(DISTINCT reading)), ',') AS readings FROM lexicon GROUP BY folder, base")
def ruby_lexicon(spark, sf_dir):
    return _lexicon(spark, sf_dir).groupBy("folder", "base").agg(F.array_join(F.array_sort(F.collect_set("reading")), ",").alias("readings"))


@query(f"WITH {SUBS}, {LEXICON}, c AS (SELECT base, array_to_string(list_sort(list(DISTINCT reading)), ',') AS readings FROM lexicon GROUP BY base) SELECT s.folder, w.base, coalesce(c.readings, '') AS readings FROM (SELECT DISTINCT folder FROM subs) s, (VALUES ('駅'), ('船')) w(base) LEFT JOIN c ON c.base = w.base")
def dictionary_lookup(spark, sf_dir):
    asked = tables.subtitles(spark, sf_dir).select("folder").distinct().withColumn("base", F.explode(F.array(F.lit("駅"), F.lit("船"))))
    return joins.dictionary_lookup(asked, _lexicon(spark, sf_dir), ["base"], "reading").select("folder", "base", F.array_join("readings", ",").alias("readings"))


@query(f"WITH {LINES}, {scored(has('駅'), '駅')}, page AS (SELECT media, row_id FROM first ORDER BY score DESC, {RANK}, line, row_id LIMIT 50) SELECT p.media, p.row_id, l.clean_text FROM page p JOIN lines l ON p.media = l.media AND p.row_id = l.row_id")
def late_materialisation(spark, sf_dir):
    lines = tables.all_lines(spark, sf_dir)
    top = search.Engine(lines).search("駅", limit=50).page.select("media", "row_id")
    return joins.late(top, lines, ["media", "row_id"], ["clean_text"])


@query("SELECT folder FROM (SELECT DISTINCT folder FROM subtitles UNION ALL SELECT DISTINCT folder FROM manga)")
def union_all_folders(spark, sf_dir):
    return table(spark, sf_dir, "subtitles").select("folder").distinct().unionByName(table(spark, sf_dir, "manga").select("folder").distinct())


@query("SELECT source_id FROM files WHERE media = 'subs' INTERSECT SELECT source_id FROM subtitles")
def intersect_sources(spark, sf_dir):
    return table(spark, sf_dir, "files").filter("media = 'subs'").select("source_id").intersect(table(spark, sf_dir, "subtitles").select("source_id"))


# ------------------------------------------------------------------ known words

GRAMMAR = "を た の は が て に と だ で か ます ない も です か ば さ まで から".split()
KNOWN = "駅 船 描く 見る 探す 時間 人形 鍵 今日 昨日".split()
G = ", ".join(f"'{g}'" for g in GRAMMAR)
K = ", ".join(f"'{k}'" for k in KNOWN)
CLASSIFIED = f"""forms AS (SELECT row_id, list_filter(list_distinct(list_filter(string_split_regex(lower(coalesce(base_forms, '')), '[ \\t　]+'), lambda x: x <> '')), lambda x: regexp_matches(x, '[ぁ-ヿ㐀-鿿\uf900-\ufaffA-Za-zＡ-Ｚａ-ｚ]') AND x NOT IN ({G}) AND x <> '駅') AS f FROM subs WHERE {has('駅')}),
classed AS (SELECT row_id, len(f) + 1 AS total, len(list_filter(f, lambda x: x NOT IN ({K}))) AS missing FROM forms)"""


def _vocabulary():
    return known.Vocabulary.of([(k,) for k in KNOWN], GRAMMAR)


@query(f"WITH {SUBS}, {CLASSIFIED} SELECT row_id, CAST(total - missing AS INTEGER) AS known, CAST(total AS INTEGER) AS total, missing = 1 AS i1 FROM classed WHERE row_id IN (SELECT row_id FROM subs WHERE contains({pad('base_forms')}, ' 駅 '))")
def known_words(spark, sf_dir):
    rows = tables.subtitles(spark, sf_dir).filter(predicates.phrase(("駅",), "base_forms")).dropDuplicates(["media", "row_id"])
    return known.classify(rows, ("駅",), _vocabulary()).select("row_id", "known", "total", "i1")


@query(f"WITH {SUBS}, {CLASSIFIED} SELECT row_id FROM classed WHERE missing = 1 AND row_id IN (SELECT row_id FROM subs WHERE contains({pad('base_forms')}, ' 駅 '))")
def learn_only(spark, sf_dir):
    rows = tables.subtitles(spark, sf_dir).filter(predicates.phrase(("駅",), "base_forms")).dropDuplicates(["media", "row_id"])
    return known.classify(rows, ("駅",), _vocabulary()).filter("i1").select("row_id")


@query(f"""WITH {SUBS}, lines AS (SELECT * FROM subs), {scored(has('駅'), '駅')}, {CLASSIFIED.replace("AND x <> '駅'", "AND x <> '駅'")}
SELECT f.media, f.folder, f.row_id, f.line, f.chars, f.exact, round(f.score - 10 * CASE WHEN c.missing = 1 THEN 0 ELSE greatest(1, c.missing) END, 6) AS score FROM first f JOIN classed c ON f.row_id = c.row_id""")
def learn_first(spark, sf_dir):
    return _shown(search.Engine(tables.subtitles(spark, sf_dir)).search("駅", limit=None, learn=(_vocabulary(), "first")).rows)


# ------------------------------------------------------------------ health

KIND = f"""CASE WHEN regexp_matches(line, '[ぁ-ゖァ-ヺー]') THEN CASE WHEN len(list_filter(string_split_regex(line, '[\\s　]+'), lambda x: trim(x) <> '' AND NOT regexp_matches(x, '[ぁ-ゖァ-ヺー]')
 AND (regexp_matches(CASE WHEN trim(regexp_replace(x, '[（(][^）)]*[）)]', '', 'g')) = '' THEN x ELSE regexp_replace(x, '[（(][^）)]*[）)]', '', 'g') END, '[{script.CHINESE_MARKS}]')
 OR (regexp_matches(CASE WHEN trim(regexp_replace(x, '[（(][^）)]*[）)]', '', 'g')) = '' THEN x ELSE regexp_replace(x, '[（(][^）)]*[）)]', '', 'g') END, '[{script.simplified_only()}]')
  AND length(regexp_replace(CASE WHEN trim(regexp_replace(x, '[（(][^）)]*[）)]', '', 'g')) = '' THEN x ELSE regexp_replace(x, '[（(][^）)]*[）)]', '', 'g') END, '[^一-鿿]', '', 'g')) >= 3)))) > 0 THEN 'mix' ELSE 'ja' END
WHEN length(regexp_replace(line, '[^一-鿿]', '', 'g')) >= 5 AND (regexp_matches(line, '[{script.CHINESE_MARKS}]') OR regexp_matches(line, '[{script.simplified_only()}]')) THEN 'zh'
WHEN NOT regexp_matches(line, '[一-鿿]') AND len(regexp_extract_all(line, '[A-Za-z]{{2,}}')) >= 3 THEN 'en' ELSE 'other' END"""


@query(f"WITH {SUBS} SELECT row_id, {KIND} AS kind FROM (SELECT row_id, coalesce(line, '') AS line FROM subs)")
def line_kinds(spark, sf_dir):
    return tables.subtitles(spark, sf_dir).dropDuplicates(["row_id"]).select("row_id", script.line_kind("line").alias("kind"))


@query(f"""WITH {SUBS}, k AS (SELECT file, {KIND} AS kind FROM (SELECT file, coalesce(line, '') AS line FROM subs))
SELECT file, count(*) AS n, count(*) FILTER (WHERE kind = 'ja') AS ja, count(*) FILTER (WHERE kind = 'zh') AS zh, count(*) FILTER (WHERE kind = 'mix') AS mix, count(*) FILTER (WHERE kind = 'en') AS en FROM k GROUP BY file""")
def line_kind_counts(spark, sf_dir):
    return health.kind_counts(tables.subtitles(spark, sf_dir), ["file"]).select("file", "n", "ja", "zh", "mix", "en")


@query(None)
def garbled_counts(spark, sf_dir):
    return health.kind_counts(tables.subtitles(spark, sf_dir), ["file"]).filter("garbled > 0").select("file", "n", "garbled")


@query(f"""WITH {FILES}, m AS (SELECT media, relpath, n, coalesce(ja, 0) AS ja, coalesce(zh, 0) AS zh, coalesce(mix, 0) AS mix, coalesce(en, 0) AS en, utf8 FROM newest)
SELECT media, relpath, CASE WHEN n IS NULL OR n < 50 THEN NULL WHEN (zh + mix) / n >= 0.02 THEN 'bilingual'
WHEN ja / (CASE WHEN ja + zh + mix + en >= 50 THEN ja + zh + mix + en ELSE n END) < 0.5 THEN CASE WHEN utf8 = false THEN 'encoding' ELSE 'other_language' END END AS finding FROM m""")
def language_verdicts(spark, sf_dir):
    files = tables.files(spark, sf_dir).fillna(0, ["ja", "zh", "mix", "en"])
    c = {x: F.col(x) for x in ("media", "n", "ja", "zh", "mix", "en", "utf8")}
    return files.select("media", "relpath", health.language_verdict(**c, garbled=F.lit(0)).alias("finding"))


@query(f"WITH {FILES} SELECT media, coalesce(fault, 'none') AS finding, count(*) AS files FROM newest GROUP BY ALL")
def finding_counts(spark, sf_dir):
    return health.finding_counts(tables.files(spark, sf_dir).withColumn("finding", F.coalesce("fault", F.lit("none"))))


@query(f"WITH {SUBS} SELECT source_id, count(*) AS lines, sha256(string_agg(coalesce(clean_text, ''), chr(10) ORDER BY row_id) || chr(10)) AS digest FROM subs GROUP BY source_id")
def stored_digests(spark, sf_dir):
    return health.stored_counts(tables.subtitles(spark, sf_dir)).select("source_id", "lines", "digest")


# ------------------------------------------------------------------ duplicates

KEYS = DOCS + r""", keys AS (SELECT DISTINCT doc_id AS doc, lower(regexp_replace(line, '[^\p{L}\p{N}]', '', 'g')) AS key FROM dl WHERE length(regexp_replace(line, '[^\p{L}\p{N}]', '', 'g')) >= 4)"""
PAIRS = f"""{KEYS}, sizes AS (SELECT doc, count(*) AS size FROM keys GROUP BY doc),
pairs AS (SELECT a.doc AS a, b.doc AS b, count(*) AS shared FROM keys a JOIN keys b ON a.key = b.key AND a.doc < b.doc GROUP BY a.doc, b.doc)"""


def _keys(spark, sf_dir):
    return duplicates.line_keys(tables.document_lines(table(spark, sf_dir, "documents")), "source_id", "line")


@query(f"WITH {KEYS} SELECT doc, count(*) AS distinct_keys FROM keys GROUP BY doc")
def distinct_line_keys(spark, sf_dir):
    return duplicates.sketch(_keys(spark, sf_dir)).select("doc", "distinct_keys")


@query(f"WITH {PAIRS} SELECT a, b, shared, x.size AS size_a, y.size AS size_b FROM pairs JOIN sizes x ON x.doc = a JOIN sizes y ON y.doc = b WHERE shared >= 0.5 * greatest(x.size, y.size) - 1e-9")
def line_overlap_pairs(spark, sf_dir):
    return duplicates.similar_pairs(_keys(spark, sf_dir), 0.5)


@query(f"""WITH RECURSIVE {PAIRS}, good AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc = a JOIN sizes y ON y.doc = b WHERE shared >= 0.5 * greatest(x.size, y.size) - 1e-9),
edges AS (SELECT a AS x, b AS y FROM good UNION SELECT b, a FROM good), reach AS (SELECT doc AS x, doc AS y FROM sizes UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x)
SELECT x AS doc, min(y) AS class FROM reach GROUP BY x""")
def similar_classes(spark, sf_dir):
    return duplicates.classes(_keys(spark, sf_dir), 0.5).select("doc", "class")


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS keeper FROM documents WHERE text IS NOT NULL QUALIFY count(*) OVER (PARTITION BY sha256(text)) > 1")
def exact_copies(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("sha"))
    best = documents.groupBy("sha").agg(F.count("*").alias("n"), F.min("doc_id").alias("keeper")).filter("n > 1")
    return documents.join(best, "sha").select("doc_id", "keeper")


@query(f"WITH {FILES} SELECT relpath, row_number() OVER (PARTITION BY media, sha ORDER BY n DESC NULLS LAST, relpath) = 1 AS keep FROM newest")
def keepers_by_rank(spark, sf_dir):
    files = tables.files(spark, sf_dir).withColumn("copies", F.xxhash64("media", "sha"))
    return duplicates.keepers(files, "copies", [-F.coalesce(F.col("n"), F.lit(-1)), F.col("relpath")]).select("relpath", "keep")


@query(f"""WITH {PAIRS}, links AS (SELECT a, b, shared / greatest(x.size, y.size) AS share FROM pairs JOIN sizes x ON x.doc = a JOIN sizes y ON y.doc = b JOIN documents d ON d.doc_id = a JOIN documents e ON e.doc_id = b AND e.source = d.source
  WHERE shared >= 0.5 * greatest(x.size, y.size) - 1e-9)
SELECT b AS doc, min(a) AS keeper, round(arg_min(share, a), 6) AS share FROM links l WHERE NOT EXISTS (SELECT 1 FROM links m WHERE m.b = l.a) GROUP BY b""")
def duplicate_leaders(spark, sf_dir):
    return _leaders(spark, sf_dir).withColumn("share", F.round("share", 6))


def _leaders(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("scope"), F.col("doc_id").alias("rank"))
    return duplicates.leaders_in_scope(files, _keys(spark, sf_dir), "scope", "rank", 0.5)


@query(f"""WITH {SOURCES}, t AS (SELECT relpath, regexp_extract(relpath, '^(.*?)[^/]*$', 1) AS directory, regexp_extract(relpath, '(?i)([^/]*)\\.(ja|ae|av|as|ak|az|ab|en)\\.srt$', 1) AS stem FROM src)
SELECT relpath FROM t WHERE stem <> '' QUALIFY count(*) OVER (PARTITION BY directory, stem) > 1""")
def track_families(spark, sf_dir):
    return duplicates.track_families(tables.sources(spark, sf_dir)).select("relpath")


@query(None)
def sketched_containment(spark, sf_dir):
    sketches = duplicates.sketch(_keys(spark, sf_dir))
    pairs = duplicates.similar_pairs(_keys(spark, sf_dir), 0.5).select("a", "b")
    a, b = (sketches.select(F.col("doc").alias(x), F.col("keys").alias(f"k{x}"), F.col("distinct_keys").alias(f"n{x}")) for x in "ab")
    share = duplicates.containment(F.col("ka"), F.col("kb"), F.col("na"), F.col("nb"), True)
    return pairs.join(a, "a").join(b, "b").select("a", "b", F.round(share, 6).alias("share"))


@query("""WITH t AS (SELECT doc_id, sha256(text) AS sha FROM documents WHERE text IS NOT NULL), b AS (SELECT sha, min(doc_id) AS keeper FROM t GROUP BY sha) SELECT doc_id AS doc, keeper FROM t JOIN b ON t.sha = b.sha WHERE doc_id <> keeper""")
def same_text_duplicates(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").alias("doc"), F.sha2("text", 256).alias("text_sha"), F.lit(None).cast("string").alias("sha"), F.col("doc_id").alias("rank"))
    none = spark.createDataFrame([], "doc long, line string")
    return duplicates.text_duplicates(documents, none).select("doc", "keeper")


@query(f"WITH {SUBS} SELECT row_id, coalesce(NOT regexp_matches(line, '[♪♬]') AND regexp_matches(line, '｜[^｜()\\n]*[一-鿿々][^｜()\\n]*\\([ぁ-ゖァ-ヺー・ 　]+\\)'), false) AS ruby FROM subs")
def author_ruby(spark, sf_dir):
    return tables.subtitles(spark, sf_dir).dropDuplicates(["row_id"]).select("row_id", duplicates.has_author_ruby(F.col("line")).alias("ruby"))


# ------------------------------------------------------------------ keeping the index up to date


@query(f"WITH {SOURCES} SELECT media, relpath FROM src WHERE source_id % 4 = 0")
def reread_queue(spark, sf_dir):
    from lineloom.plans import build

    src = tables.sources(spark, sf_dir)
    queue = src.select("media", "relpath", F.when(F.expr("source_id % 4 = 0"), F.col("file_hash")).otherwise("old").alias("file_hash"))
    return build.valid_queue(queue, src).select("media", "relpath")


@query(f"WITH {LINES} SELECT media, source_id, CASE WHEN source_id % 3 = 0 THEN 'lines' ELSE 'text' END AS fault FROM lines WHERE media = 'subs' AND (source_id % 3 = 0 OR source_id % 5 = 0) GROUP BY ALL")
def repair_candidates(spark, sf_dir):
    from lineloom.plans import build

    stored = health.stored_counts(tables.subtitles(spark, sf_dir)).select("media", "source_id", "lines", "digest")
    parsed = stored.withColumn("lines", F.when(F.expr("source_id % 3 = 0"), F.col("lines") + 1).otherwise(F.col("lines"))).withColumn("digest", F.when(F.expr("source_id % 5 = 0"), F.lit("x")).otherwise(F.col("digest")))
    return build.repair_candidates(stored, parsed)

#: The index as it was before: every ninth source unknown, every seventh with another hash, every fifth touched; every eleventh file gone.
KNOWN_SQL = f"""{SOURCES}, known AS (SELECT relpath, file_size, CASE WHEN source_id % 5 = 0 THEN file_mtime_ns + 1 ELSE file_mtime_ns END AS file_mtime_ns, CASE WHEN source_id % 7 = 0 THEN 'old' ELSE file_hash END AS file_hash FROM src WHERE media = 'subs' AND source_id % 9 <> 0),
disk AS (SELECT relpath, file_size, CASE WHEN source_id % 7 = 0 THEN file_mtime_ns + 2 ELSE file_mtime_ns END AS file_mtime_ns, file_hash FROM src WHERE media = 'subs' AND source_id % 11 <> 0)"""


def _known_and_disk(spark, sf_dir):
    src = tables.sources(spark, sf_dir).filter("media = 'subs'")
    time = F.col("file_mtime_ns")
    known_rows = src.filter("source_id % 9 <> 0").select("relpath", "file_size", F.when(F.expr("source_id % 5 = 0"), time + 1).otherwise(time).alias("file_mtime_ns"), F.when(F.expr("source_id % 7 = 0"), "old").otherwise(F.col("file_hash")).alias("file_hash"))
    disk = src.filter("source_id % 11 <> 0").select("relpath", "file_size", F.when(F.expr("source_id % 7 = 0"), time + 2).otherwise(time).alias("file_mtime_ns"), "file_hash")
    return known_rows, disk


@query(f"""WITH {KNOWN_SQL} SELECT coalesce(k.relpath, d.relpath) AS relpath, CASE WHEN d.relpath IS NULL THEN 'gone' WHEN k.relpath IS NULL THEN 'new' WHEN k.file_size = d.file_size AND k.file_mtime_ns = d.file_mtime_ns AND k.file_hash IS NOT NULL THEN 'same'
WHEN k.file_hash = d.file_hash THEN 'touched' ELSE 'changed' END AS state FROM known k FULL JOIN disk d ON k.relpath = d.relpath""")
def incremental_plan(spark, sf_dir):
    return incremental.plan_changes(*_known_and_disk(spark, sf_dir))


@query(f"""WITH {KNOWN_SQL}, gone AS (SELECT relpath FROM known WHERE relpath NOT IN (SELECT relpath FROM disk)), f AS (SELECT relpath, contains(relpath, 'S01') AS f FROM gone)
SELECT relpath, NOT f AND (SELECT count(*) FROM f WHERE NOT f) > 0.5 * (SELECT count(*) FROM known) AS held FROM f""")
def held_removals(spark, sf_dir):
    known_rows, disk = _known_and_disk(spark, sf_dir)
    filtered = known_rows.filter(F.col("relpath").contains("S01")).select(F.col("relpath").alias("name"))
    return incremental.held_removals(known_rows, disk, filtered)


@query(f"WITH {SOURCES} SELECT media, source_id FROM src WHERE (media = 'subs' AND format_version < CASE WHEN regexp_matches(lower(relpath), '\\.(ass|ssa)$') THEN 6 ELSE 5 END) OR (media = 'custom' AND format_version < 7)")
def outdated_sources(spark, sf_dir):
    return incremental.outdated(tables.sources(spark, sf_dir), {"subs": 6, "custom": 7}, {("subs", 6): (".ass", ".ssa")}).select("media", "source_id")


@query(f"WITH {SOURCES} SELECT media, 2 * count(*) FILTER (WHERE media = 'custom' AND format_version < 7) >= count(*) AS rebuild FROM src GROUP BY media")
def rebuild_wanted(spark, sf_dir):
    src = tables.sources(spark, sf_dir)
    return incremental.wants_rebuild(src, incremental.outdated(src, {"custom": 7}))


MARKED = f"marked AS (SELECT DISTINCT row_id, coalesce(is_repeat, false) AS is_repeat FROM subtitles), fresh AS (SELECT row_id, row_number() OVER (PARTITION BY folder, line ORDER BY row_id) > 1 AS is_repeat FROM subs)"


@query(f"WITH {SUBS}, {MARKED} SELECT row_id, is_repeat, 'extra' AS side FROM (SELECT * FROM marked EXCEPT ALL SELECT * FROM fresh) UNION ALL SELECT row_id, is_repeat, 'missing' FROM (SELECT * FROM fresh EXCEPT ALL SELECT * FROM marked)")
def drift_of_marks(spark, sf_dir):
    stored = table(spark, sf_dir, "subtitles").select("row_id", F.coalesce("is_repeat", F.lit(False)).alias("is_repeat")).distinct()
    return incremental.drift(stored, windows.repeat_marks(tables.subtitles(spark, sf_dir)).select("row_id", "is_repeat"))


@query(f"WITH {LINES} SELECT media, source_id, count(*) AS n FROM (SELECT media, source_id FROM lines WHERE NOT (media = 'subs' AND source_id % 3 = 0) UNION ALL SELECT media, source_id FROM lines WHERE media = 'subs' AND source_id % 6 = 0) GROUP BY ALL")
def upsert_sources(spark, sf_dir):
    lines = tables.all_lines(spark, sf_dir).dropDuplicates(["media", "row_id"])
    third = lines.filter("media = 'subs' and source_id % 3 = 0")
    return incremental.upsert(lines, third.filter("source_id % 6 = 0"), third.filter("source_id % 6 <> 0")).groupBy("media", "source_id").agg(F.count("*").alias("n"))


@query(f"WITH {FILES}, old AS (SELECT media, relpath AS name FROM newest WHERE fault IS NOT NULL), new AS (SELECT DISTINCT media, relpath AS name FROM newest WHERE utf8 = false OR fault IS NOT NULL) SELECT * FROM old UNION ALL SELECT * FROM new WHERE (media, name) NOT IN (SELECT media, name FROM old)")
def append_filtered(spark, sf_dir):
    files = tables.files(spark, sf_dir).withColumn("name", F.col("relpath"))
    old = files.filter("fault is not null").select("media", "name")
    return incremental.append_filtered(old, files.filter("utf8 = false or fault is not null").select("media", "name"))


@query(f"WITH {FILES}, old AS (SELECT media, relpath AS name, CASE WHEN source_id % 2 = 0 THEN 'auto' ELSE '' END AS origin, file_size + source_id % 3 AS s FROM newest) SELECT o.media, o.name FROM old o JOIN newest n ON o.name = n.relpath AND o.media = n.media WHERE o.media <> 'subs' OR origin <> 'auto' OR o.s = n.file_size")
def refresh_filtered(spark, sf_dir):
    files = tables.files(spark, sf_dir)
    rows = files.select("media", F.col("relpath").alias("name"), F.when(F.expr("source_id % 2 = 0"), "auto").otherwise("").alias("origin"), (F.col("file_size") + F.col("source_id") % 3).cast("string").alias("size"), F.col("file_mtime_ns").cast("string").alias("mtime"))
    return incremental.refresh_filtered(rows, files, "subs").select("media", "name")


@query(f"WITH {SOURCES}, w AS (SELECT media, {WORK} AS folder FROM src WHERE source_id % 10 = 0) SELECT DISTINCT media, folder FROM w")
def changed_works(spark, sf_dir):
    src = tables.sources(spark, sf_dir)
    src = src.withColumn("folder", library.work_of(F.col("media"), F.col("relpath"), F.col("title"), F.col("category")))
    changed = src.withColumn("file_hash", F.when(F.expr("source_id % 10 = 0"), F.concat("file_hash", F.lit("x"))).otherwise(F.col("file_hash")))
    recorded = incremental.changed_works(src, spark.createDataFrame([], "media string, folder string, signature string"))
    return incremental.changed_works(changed, recorded).select("media", "folder")


# ------------------------------------------------------------------ functions over columns


@query(f"WITH {SUBS} SELECT row_id, {shown()} AS n FROM subs")
def shown_lengths(spark, sf_dir):
    return tables.subtitles(spark, sf_dir).dropDuplicates(["row_id"]).select("row_id", measure.shown_length("line").alias("n"))


@query(f"WITH {SUBS} SELECT row_id, CASE WHEN regexp_matches(line, '[{script.KANJI_LITERAL}]') THEN 'kanji' WHEN regexp_matches(line, '[ァ-ヺ]') THEN 'katakana' WHEN regexp_matches(line, '[ぁ-ゖ]') THEN 'hiragana' ELSE 'romaji' END AS script FROM subs")
def scripts(spark, sf_dir):
    return tables.subtitles(spark, sf_dir).dropDuplicates(["row_id"]).select("row_id", script.script_of("line").alias("script"))


@query(f"WITH {SUBS} SELECT row_id, array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(clean_text, ''), '[{script.KANJI_LITERAL}]'))), '') AS kanji FROM subs")
def kanji_index(spark, sf_dir):
    return tables.subtitles(spark, sf_dir).dropDuplicates(["row_id"]).select("row_id", F.array_join(script.distinct_kanji("clean_text"), "").alias("kanji"))


HIRA = ("".join(chr(c) for c in range(0x30A1, 0x30F7)), "".join(chr(c - 0x60) for c in range(0x30A1, 0x30F7)))
WIDTH = script._width()


@query(f"SELECT DISTINCT folder, lower(translate(translate(coalesce(folder, ''), '{WIDTH[0]}', '{WIDTH[1].replace(chr(39), chr(39) * 2)}'), '{HIRA[0]}', '{HIRA[1]}')) AS folded FROM subtitles WHERE NOT regexp_matches(folder, '[ｦ-ﾟ]')")
def folded_titles(spark, sf_dir):
    names = table(spark, sf_dir, "subtitles").select("folder").distinct().filter(~F.col("folder").rlike("[ｦ-ﾟ]"))
    return names.select("folder", script.fold_title("folder").alias("folded"))


@query(f"WITH {SUBS} SELECT row_id FROM subs WHERE NOT regexp_matches(coalesce(line, ''), '[぀-ヿㇰ-ㇿｦ-ﾝ{script.KANJI_LITERAL}A-Za-zＡ-Ｚａ-ｚ]')")
def quiet_lines(spark, sf_dir):
    return tables.subtitles(spark, sf_dir).filter(~script.has_readable("line")).select("row_id").distinct()


@query(f"WITH {SUBS} SELECT row_id FROM subs WHERE regexp_matches(coalesce(line, ''), '(?i)(?:[<＜]|&lt;)\\s*/?\\s*(?:ruby|rb|rt|rp)\\b')")
def html_ruby_lines(spark, sf_dir):
    return tables.subtitles(spark, sf_dir).filter(script.has_html_ruby("line")).select("row_id").distinct()


@query("""SELECT event_id, lpad(CAST(epoch_us(ts) // 1000 // 3600000 % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(epoch_us(ts) // 1000 // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(epoch_us(ts) // 1000 // 1000 % 60 AS VARCHAR), 2, '0') || ',' || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') AS stamp FROM events""")
def caption_times(spark, sf_dir):
    ms = F.unix_millis(F.col("ts").cast("timestamp")) % F.lit(86400000).cast("long")
    return table(spark, sf_dir, "events").select("event_id", measure.caption_time(ms).alias("stamp"))


@query("""SELECT a.l_orderkey, a.l_linenumber, round(CASE WHEN least(a.l_quantity + 10, b.l_quantity + 10) <= greatest(a.l_quantity, b.l_quantity) THEN 0 ELSE (least(a.l_quantity, b.l_quantity) + 10 - greatest(a.l_quantity, b.l_quantity)) * 10 /
 greatest(1, 100 + 100 - (least(a.l_quantity, b.l_quantity) + 10 - greatest(a.l_quantity, b.l_quantity)) * 10) END, 6) AS share FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1""")
def box_overlap(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    after = items.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_quantity").alias("q"))
    box = lambda c: (F.col(c), F.lit(0.0), F.col(c) + 10, F.lit(10.0))
    return items.join(after, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", F.round(measure.overlap(box("l_quantity"), box("q")), 6).alias("share"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
