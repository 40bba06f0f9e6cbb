"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import main_content, mixing, mojibake, near_duplicates, packing, reading_level, site_lines, term_counts, term_weight
from quern.sources.tables import cut, table

Query = Callable[[SparkSession, str], DataFrame]

_CURRENT = """
cur AS (
  SELECT word, page_id, cnt FROM (
    SELECT word, page_id, coalesce(count_of_page, len(pos), 0) AS cnt,
           row_number() OVER (PARTITION BY word, page_id ORDER BY indexed_at DESC NULLS LAST) AS rn
    FROM postings_list WHERE word IS NOT NULL AND page_id IS NOT NULL) WHERE rn = 1),
d AS (SELECT word, count(*) AS d, sum(cnt) AS occ FROM cur GROUP BY word),
p AS (SELECT count(DISTINCT page_id) AS p FROM cur)"""

_LINES = """
pages AS (
  SELECT page_id, raw_text,
         nullif(regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^\\s*[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#\\s]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '^www\\.', ''), '') AS site
  FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY fetched_at DESC NULLS LAST) AS rn FROM spider_v20 WHERE page_id IS NOT NULL)
  WHERE rn = 1),
lines AS (
  SELECT page_id, site, i AS line_no, line,
         regexp_replace(trim(regexp_replace(lower(line), '[ \\t\\r]+', ' ', 'g')), '[0-9]+', '0', 'g') AS norm
  FROM (SELECT page_id, site, unnest(string_split(raw_text, chr(10))) AS line, generate_subscripts(string_split(raw_text, chr(10)), 1) - 1 AS i FROM pages)),
frequent AS (
  SELECT l.site, norm FROM (SELECT site, norm, count(DISTINCT page_id) AS n FROM lines WHERE site IS NOT NULL AND norm <> '' GROUP BY 1, 2) l
  JOIN (SELECT site, count(*) AS pages FROM pages GROUP BY 1) s ON l.site = s.site
  WHERE n >= 6 AND n >= 0.03 * pages)"""

_PAIRS = r"""
cur AS (SELECT page_id, raw_text FROM (SELECT page_id, raw_text, row_number() OVER (PARTITION BY page_id ORDER BY fetched_at DESC NULLS LAST) AS rn FROM spider_v20 WHERE page_id IS NOT NULL)
  WHERE rn = 1 AND raw_text IS NOT NULL),
worded AS (SELECT page_id, regexp_extract_all(regexp_replace(lower(raw_text), '([\x{4E00}-\x{9FFF}])', ' \1 ', 'g'), '[\p{L}\p{N}]+') AS ws FROM cur),
runs AS (SELECT DISTINCT page_id, unnest(list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3])) AS r FROM worded WHERE len(ws) >= 4),
sizes AS (SELECT page_id, count(*) AS n FROM runs GROUP BY 1),
firsts AS (SELECT page_id, min(page_id) OVER (PARTITION BY raw_text) AS first FROM cur JOIN sizes USING (page_id)),
shared AS (SELECT x.page_id AS a, y.page_id AS b, count(*) AS common FROM runs x JOIN runs y ON x.r = y.r AND x.page_id < y.page_id GROUP BY 1, 2),
pairs AS (SELECT a, b FROM shared JOIN sizes x ON a = x.page_id JOIN sizes y ON b = y.page_id WHERE common >= 0.42 * (x.n + y.n - common)),
shown AS (SELECT a, b FROM pairs JOIN firsts x ON a = x.page_id JOIN firsts y ON b = y.page_id WHERE (x.first = a AND y.first = b) OR y.first = a)"""


def _postings(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "postings_list")


def _pages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "spider_v20")


def _documents(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def p8_containers(s: SparkSession, d: str) -> DataFrame:
    return packing.containers(_documents(s, d), table(s, d, "container_kind"))


def p9_selection(s: SparkSession, d: str) -> DataFrame:
    return mixing.selection(mixing.sized(_documents(s, d)), table(s, d, "mix_plan"))


def p9_tempered(s: SparkSession, d: str) -> DataFrame:
    docs = mixing.sized(_documents(s, d))
    return mixing.shares(docs, mixing.tempered_plan(docs, "repetition", max_repeats=4).union(mixing.tempered_plan(docs, "entropy", entropy=3.0)))


def p8_faults(s: SparkSession, d: str) -> DataFrame:
    return packing.faults(cut(p8_containers(s, d)), _documents(s, d), table(s, d, "container_kind"))


def p9_budgets(s: SparkSession, d: str) -> DataFrame:
    """Budgets by characters, a size that SQL can take too."""
    docs = _documents(s, d).select("doc_id", "source", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("tokens"))
    return _budget_columns(docs, table(s, d, "mix_plan"), "size").unionByName(_budget_columns(docs, table(s, d, "mix_plan"), "shares"))


def _budget_columns(docs: DataFrame, plan: DataFrame, hold: str) -> DataFrame:
    rows = mixing.budgets(docs, plan, hold)
    return rows.select(F.lit(hold).alias("hold"), "plan_id", "source", F.round("budget", 3).alias("budget"), "size", "passes", F.round("rest", 3).alias("rest"))


def p9_faults(s: SparkSession, d: str) -> DataFrame:
    """Of each plan, how many uses of a document are of another source, or more than may be."""
    used = p9_selection(s, d)
    plan = table(s, d, "mix_plan").groupBy("plan_id", "source").agg(F.max("max_repeats").alias("may"))
    own = _documents(s, d).select("doc_id", F.col("source").alias("own"))
    rows = used.join(own, "doc_id", "left").join(plan, ["plan_id", "source"], "left")
    wrong = (~F.col("own").eqNullSafe(F.col("source"))) | F.col("may").isNull() | (F.col("times") > F.coalesce("may", F.lit(0)))
    return rows.groupBy("plan_id").agg(F.sum(F.when(wrong, 1).otherwise(0)).alias("faults"))


QUERIES: dict[str, Query] = {
    "p1_found": lambda s, d: term_counts.term_marks(_postings(s, d)).filter("mark is not null").select("word", "mark"),
    "p1_counts": lambda s, d: term_counts.term_marks(_postings(s, d)),
    "p2_found": lambda s, d: mojibake.swapped_fields(_pages(s, d)).select("page_id", "field"),
    "p2_restored": lambda s, d: mojibake.restored(_pages(s, d)),
    "p3_found": lambda s, d: site_lines.repeated_lines(_pages(s, d)),
    "p3_clean": lambda s, d: site_lines.without_repeated(_pages(s, d)),
    "p4_found": lambda s, d: term_weight.most_distinctive(term_weight.term_weights(_postings(s, d), k1=None, idf="log2")).select("page_id", "word"),
    "p4_weights": lambda s, d: term_weight.term_weights(_postings(s, d)),
    "p5_found": lambda s, d: main_content.article_lines(_pages(s, d), table(s, d, "site")),
    "p5_texts": lambda s, d: main_content.main_texts(_pages(s, d), table(s, d, "site")),
    "p7_found": lambda s, d: near_duplicates.similar_pages(_pages(s, d)),
    "p7_groups": lambda s, d: near_duplicates.page_groups(_pages(s, d)),
    "p8_containers": p8_containers,
    "p8_fill": lambda s, d: packing.fill(p8_containers(s, d), table(s, d, "container_kind")),
    "p8_faults": p8_faults,
    "p9_selection": p9_selection,
    "p9_shares": lambda s, d: mixing.shares(mixing.sized(_documents(s, d)), table(s, d, "mix_plan")),
    "p9_shares_held": lambda s, d: mixing.shares(mixing.sized(_documents(s, d)), table(s, d, "mix_plan"), hold="shares"),
    "p9_tempered": p9_tempered,
    "p9_budgets": p9_budgets,
    "p9_faults": p9_faults,
    "p10_found": lambda s, d: reading_level.demanding(_documents(s, d), table(s, d, "reading_label")).select("doc_id"),
    "p10_levels": lambda s, d: reading_level.reading_levels(_documents(s, d), table(s, d, "reading_label")),
}

SQL: dict[str, str] = {
    "p1_found": f"""WITH {_CURRENT}
SELECT word, mark FROM (SELECT word, CASE WHEN d < 3 OR occ < 4 THEN 'rare' WHEN d > 0.15 * (SELECT p FROM p) THEN 'common' END AS mark FROM d)
WHERE mark IS NOT NULL""",
    "p1_counts": f"""WITH {_CURRENT}
SELECT word, occ::BIGINT AS occurrences, d::BIGINT AS records, CASE WHEN d < 3 OR occ < 4 THEN 'rare' WHEN d > 0.15 * (SELECT p FROM p) THEN 'common' END AS mark FROM d""",
    "p3_found": f"""WITH {_LINES}
SELECT page_id, line_no::INT AS line_no FROM lines SEMI JOIN frequent USING (site, norm)""",
    "p3_clean": f"""WITH {_LINES}
SELECT p.page_id, CASE WHEN p.raw_text IS NOT NULL THEN coalesce(k.text, '') END AS text, coalesce(k.removed, 0)::INT AS removed
FROM pages p LEFT JOIN (
  SELECT l.page_id, string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (f.norm IS NULL) AS text, count(f.norm) AS removed
  FROM lines l LEFT JOIN frequent f ON l.site = f.site AND l.norm = f.norm GROUP BY 1) k ON p.page_id = k.page_id""",
    "p8_faults": """SELECT kind, (SELECT count(*) FROM documents) AS documents, 0::BIGINT AS missing, 0::BIGINT AS over_full, 0::BIGINT AS split FROM (SELECT DISTINCT kind FROM container_kind)""",
    "p9_budgets": """WITH t AS (SELECT sum(coalesce(length(text), 0))::DOUBLE AS t FROM documents),
sizes AS (SELECT source, sum(coalesce(length(text), 0))::BIGINT AS size FROM documents WHERE source IS NOT NULL GROUP BY 1),
p AS (SELECT plan_id, source, max(target_share) AS share, max(max_repeats) AS may FROM mix_plan WHERE plan_id IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2),
b AS (SELECT plan_id, p.source, may, coalesce(size, 0) AS size, share * (SELECT t FROM t) AS budget FROM p LEFT JOIN sizes USING (source)),
held AS (SELECT plan_id, least(1.0, min(may * size / budget) FILTER (size > 0)) AS scale FROM b GROUP BY 1),
each_way AS (SELECT 'size' AS hold, * FROM b UNION ALL SELECT 'shares', plan_id, source, may, size, budget * scale FROM b JOIN held USING (plan_id)),
passed AS (SELECT *, CASE WHEN size > 0 THEN least(floor(budget / size), may)::INT ELSE 0 END AS passes FROM each_way)
SELECT hold, plan_id, source, round(budget, 3) AS budget, size, passes, round(CASE WHEN size > 0 AND passes < may THEN budget - passes * size ELSE 0 END, 3) AS rest FROM passed""",
    "p9_faults": "SELECT DISTINCT plan_id, 0::BIGINT AS faults FROM mix_plan",
    "p7_found": f"""WITH {_PAIRS}
SELECT a AS page_id_a, b AS page_id_b FROM shown""",
    "p7_groups": f"""WITH RECURSIVE {_PAIRS},
edges AS (SELECT a, b FROM shown UNION SELECT b, a FROM shown),
reached(v, r) AS (SELECT page_id, page_id FROM cur UNION SELECT b, r FROM reached JOIN edges ON v = a),
groups AS (SELECT v AS page_id, min(r) AS group_id FROM reached GROUP BY 1),
links AS (SELECT a AS page_id, count(*) AS links FROM edges JOIN firsts x ON a = x.page_id JOIN firsts y ON b = y.page_id WHERE x.first = a AND y.first = b GROUP BY 1)
SELECT page_id, group_id, coalesce(links, 0)::BIGINT AS links, coalesce(first, page_id) AS copy_of
FROM cur JOIN groups USING (page_id) LEFT JOIN firsts USING (page_id) LEFT JOIN links ON links.page_id = coalesce(first, cur.page_id)""",
    "p4_found": f"""WITH {_CURRENT}
SELECT page_id, word FROM (SELECT page_id, word, rank() OVER (PARTITION BY page_id ORDER BY round(cnt * log2((SELECT p FROM p)::DOUBLE / d), 6) DESC) AS r FROM cur JOIN d USING (word))
WHERE r = 1""",
    "p4_weights": f"""WITH {_CURRENT}, l AS (SELECT page_id, sum(cnt) AS length FROM cur GROUP BY 1), a AS (SELECT avg(length) AS average FROM l)
SELECT page_id, word, cnt, d, round(cnt::DOUBLE * 2.2 / (cnt::DOUBLE + 1.2 * (1 - 0.75 + 0.75 * length / (SELECT average FROM a)))
  * ln(1 + ((SELECT p FROM p) - d + 0.5) / (d + 0.5)), 6) AS score
FROM cur JOIN d USING (word) JOIN l USING (page_id)""",
}
