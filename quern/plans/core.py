"""Queries of the core's general data problems and their SQL."""

from __future__ import annotations

from quern.operators.heavy_keys import heavy_pages, page_summary
from quern.sources.tables import table

_CURRENT = """cur AS (
  SELECT page_id, coalesce(count_of_page, len(pos), 0) AS cnt, list_min(pos) AS lo, list_max(pos) AS hi FROM (
    SELECT *, row_number() OVER (PARTITION BY word, page_id ORDER BY indexed_at DESC NULLS LAST) AS rn
    FROM postings_list WHERE word IS NOT NULL AND page_id IS NOT NULL) WHERE rn = 1)"""

QUERIES = {
    "p6_found": lambda s, d: heavy_pages(table(s, d, "postings_list")).select("page_id"),
    "p6_summary": lambda s, d: page_summary(table(s, d, "postings_list")),
}

SQL = {
    "p6_found": f"""WITH {_CURRENT}
SELECT page_id FROM cur GROUP BY 1 HAVING count(*) > 0.02 * (SELECT count(*) FROM cur)""",
    "p6_summary": f"""WITH {_CURRENT}
SELECT page_id, count(*) AS n_rows, sum(cnt)::BIGINT AS occurrences, min(lo) AS first_pos, max(hi) AS last_pos FROM cur GROUP BY 1""",
}
