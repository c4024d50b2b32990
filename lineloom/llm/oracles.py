"""DuckDB SQL for those queries of this subpackage that SQL can state."""

from __future__ import annotations

_TERMS = """
WITH once AS (SELECT row_id, any_value(base_forms) AS base_forms, any_value(readings) AS readings FROM subtitles GROUP BY row_id),
terms AS (
  SELECT 'base_forms' AS field, row_id, unnest(string_split_regex(base_forms, '[ \\t\u3000]+')) AS term FROM once
  UNION ALL
  SELECT 'readings' AS field, row_id, unnest(string_split_regex(readings, '[ \\t\u3000]+')) AS term FROM once),
counted AS (
  SELECT field, term, count(*) AS occurrences, count(DISTINCT row_id) AS records FROM terms WHERE term <> '' GROUP BY field, term)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_counts": _TERMS + "SELECT field, term, occurrences, records FROM counted",
        "p3_found": _TERMS
        + """SELECT field, term, CASE WHEN records <= 2 THEN 'rare' ELSE 'common' END AS mark FROM counted
        WHERE records <= 2 OR records > 0.04 * (SELECT count(*) FROM once)""",
        "p8_totals": """
WITH once AS (SELECT doc_id, any_value(text) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id)
SELECT pack_id, capacity, count(*) AS documents, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS chars,
  count(*) FILTER (WHERE strlen(text) + 1 > capacity) AS cut, CAST(0 AS BIGINT) AS over
FROM once, pack_sizes GROUP BY pack_id, capacity""",
        "p3_ngrams": """
WITH once AS (SELECT row_id, any_value(base_forms) AS t FROM subtitles GROUP BY row_id),
lists AS (SELECT row_id, list_filter(string_split_regex(t, '[ \\t\u3000]+'), lambda x: x <> '') AS l FROM once WHERE t IS NOT NULL),
grams AS (
  SELECT row_id, n, array_to_string(list_slice(l, i, i + n - 1), ' ') AS term
  FROM (SELECT row_id, l, unnest([2, 3]) AS n FROM lists) a, unnest(range(1, (SELECT max(len(l)) FROM lists) + 1)) r(i) WHERE i + n - 1 <= len(l))
SELECT CAST(n AS INTEGER) AS n, term, count(*) AS occurrences, count(DISTINCT row_id) AS records
FROM grams GROUP BY n, term HAVING count(DISTINCT row_id) > 2""",
    }
