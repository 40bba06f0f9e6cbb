"""Queries of the search engine and their SQL.

Documents are the table documents; pages are the current rows of spider_v20 (the greatest fetched_at of a page_id).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.functions import urls
from quern.operators import blocks, crawl, index, search, tokens
from quern.operators.latest import current_pages
from quern.operators.order import ranked
from quern.sources import files
from quern.sources.tables import exists, scratch, spread, table, version
from quern.streaming.index_stream import index_stream, read_stream_index

Query = Callable[[SparkSession, str], DataFrame]


def _docs(s: SparkSession, d: str) -> DataFrame:
    return spread(table(s, d, "documents").select("doc_id", "text"))


def _pages(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return current_pages(table(s, d, "spider_v20"), *columns)


def _index(s: SparkSession, d: str) -> DataFrame:
    return index.postings(tokens.bigram_hits(_docs(s, d)))


_stored_at: dict[tuple, str] = {}


def _stored(s: SparkSession, d: str, tokenized: Callable[[DataFrame], DataFrame] = tokens.bigram_hits) -> DataFrame:
    """The stored index of the documents under d: built by the first search of the session and read by all others, until the table
    is another or the index is gone."""
    key = (s.sparkContext.applicationId, tokenized.__name__, version(s, f"{d}/documents.parquet"))
    path = _stored_at.get(key)
    if path is None or not exists(s, path):
        path = _stored_at[key] = scratch(s)
        index.write_index(index.postings(tokenized(_docs(s, d))), path)
    return index.read_index(s, path)


def _page_index(s: SparkSession, d: str) -> DataFrame:
    store = files.page_files(files.page_store(_pages(s, d, "url", "title", "raw_text")))
    return index.postings(tokens.bigram_hits(store.withColumnRenamed("page_id", "doc_id")))


def _matches(s: SparkSession, d: str, words: list[str]) -> DataFrame:
    return search.matches(_stored(s, d), words)


def _tables_to_lines(s: SparkSession, d: str) -> DataFrame:
    return _pages(s, d, "html").select("page_id", tx.tags_to_lines(F.col("html")).alias("t"))


def _result_pages(s: SparkSession, d: str) -> DataFrame:
    found = search.search(_page_index(s, d), "the library").withColumnRenamed("doc_id", "page_id")
    return search.with_pages(found, files.page_store(_pages(s, d, "url", "title", "raw_text")))


def _graph(s: SparkSession, d: str) -> DataFrame:
    return crawl.link_graph(_pages(s, d, "url", "html"))


def _seen(s: SparkSession, d: str) -> DataFrame:
    return _pages(s, d, "url").filter("url is not null").select("url").distinct()


def _seeds(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "seed_list").select(F.lower(F.trim("url")).alias("url"))


def _crawled(s: SparkSession, d: str, cap: int) -> DataFrame:
    """A crawl over the links of the pages. The tables have no front pages, which seeds name, so these link to all of their site's."""
    pages = _pages(s, d, "url").filter("url is not null")
    front = F.concat(F.lit("http://"), urls.site(F.col("url")), F.lit("/"))
    graph = pages.select(front.alias("source"), F.col("url").alias("target")).union(_graph(s, d)).distinct()
    return crawl.crawl_levels(graph, _seeds(s, d), cap)


def incremental(s: SparkSession, d: str) -> DataFrame:
    """The postings of the index of one half of the documents merged with that of the other half, and with that once more."""
    docs = _docs(s, d).withColumn("h", F.pmod(F.hash("doc_id"), F.lit(2)))
    first, second = (index.postings(tokens.bigram_hits(docs.filter(F.col("h") == k).drop("h"))) for k in (0, 1))
    return index.merged(index.merged(first, second), second).select("word", "doc_id", "tf")


def compacted(s: SparkSession, d: str) -> DataFrame:
    """Two stored indexes, of all documents but with some texts cut and of those once more as they are, written as one."""
    docs = _docs(s, d).withColumn("h", F.pmod(F.hash("doc_id"), F.lit(2)))
    older = docs.select("doc_id", F.when(F.col("h") == 0, F.substring("text", 1, 40)).otherwise(F.col("text")).alias("text"))
    parts = []
    for texts, folders in ((older, 8), (docs.filter("h = 0").drop("h"), 16)):
        parts.append(scratch(s))
        index.write_index(index.postings(tokens.bigram_hits(texts)), parts[-1], folders)
    path = scratch(s)
    index.compacted(s, parts, path)
    return index.read_index(s, path).select("word", "doc_id", "tf", F.array_min("pos").alias("first_pos"))


def stored(s: SparkSession, d: str) -> DataFrame:
    """A lookup in an index that was written and is read again."""
    path = scratch(s)
    index.write_index(_index(s, d), path, 16)
    return index.lookup(index.read_index(s, path), ["that", "with"]).select("word", "doc_id", "tf", F.array_min("pos").alias("first_pos"))


def stored_search(s: SparkSession, d: str) -> DataFrame:
    """A search in an index that was written into more folders than usual and is read again."""
    path = scratch(s)
    index.write_index(_index(s, d), path, 200)
    return search.search(index.read_index(s, path), "the library")


def stored_pages(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s)
    files.write_page_store(files.page_store(_pages(s, d, "url", "title", "raw_text")), path)
    return files.read_page_store(s, path).select("page_id", "url", "title", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"))


def page_text_files(s: SparkSession, d: str) -> DataFrame:
    """The pages' texts written as files named by their ids, and read again as a directory of texts."""
    path = scratch(s)
    files.write_texts(files.page_files(files.page_store(_pages(s, d, "url", "title", "raw_text"))), path)
    return files.text_directory(s, path).select(F.col("doc_id").alias("page_id"), F.md5("text").alias("text_md5"))


def html_files(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s)
    files.write_texts(_pages(s, d, "html").filter("html is not null"), path, ".html")
    return files.html_directory(s, path).select("page_id", F.md5("html").alias("html_md5"))


def seed_file(s: SparkSession, d: str) -> DataFrame:
    """The seeds written as a file of lines and read as a seed list."""
    path = scratch(s)
    table(s, d, "seed_list").select("url").write.text(path)
    return files.seeds(s, path)


def visited_log(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s)
    files.write_visited(_seen(s, d), path)
    return s.read.text(path).select(F.col("value").alias("url"))


def stream(s: SparkSession, d: str) -> DataFrame:
    """The index a stream of the documents' files leaves behind."""
    at = scratch(s)
    source = table(s, d, "documents")
    index_stream(s, f"{d}/documents.parque[t]", source.schema, f"{at}/index", f"{at}/checkpoint").awaitTermination()
    return read_stream_index(s, f"{at}/index").select("word", "doc_id", "tf")


def main_lines(s: SparkSession, d: str) -> DataFrame:
    return blocks.main_text(blocks.block_lines(_pages(s, d, "raw_text"), "raw_text"))


QUERIES: dict[str, Query] = {
    "clean_text": lambda s, d: _docs(s, d).select("doc_id", tx.clean(F.col("text")).alias("cleaned")),
    "strip_html": lambda s, d: _pages(s, d, "html").select("page_id", tx.strip_html(F.col("html")).alias("body")),
    "page_text": lambda s, d: _pages(s, d, "html").select("page_id", F.md5(tx.page_text(F.col("html"))).alias("text_md5")),
    "page_title": lambda s, d: _pages(s, d, "html").select("page_id", tx.title(F.col("html")).alias("title")),
    "page_links_strict": lambda s, d: crawl.page_links(_pages(s, d, "html"), strict=True),
    "page_links": lambda s, d: crawl.page_links(_pages(s, d, "html"), pattern="html?$"),
    "page_hosts": lambda s, d: crawl.host_counts(_pages(s, d, "url")),
    "page_sites": lambda s, d: _pages(s, d, "url").groupBy(urls.site(F.col("url")).alias("site")).agg(F.count(F.lit(1)).alias("n_pages")),
    "link_graph": lambda s, d: _graph(s, d).groupBy("source").agg(F.count(F.lit(1)).alias("n_targets")),
    "frontier_new_links": lambda s, d: crawl.new_links(_graph(s, d), _seen(s, d)),
    "crawl_levels": lambda s, d: _crawled(s, d, 1_000_000_000),
    "crawl_capped": lambda s, d: _crawled(s, d, 100),
    "seed_file": seed_file,
    "visited_log": visited_log,
    "page_text_files": page_text_files,
    "html_files": html_files,
    "host_schedule": lambda s, d: crawl.host_schedule(_pages(s, d, "url"), delay=2.0),
    "page_ids": lambda s, d: crawl.assigned_ids(_seen(s, d), ["url"]),
    "page_store": stored_pages,
    "id_keys": lambda s, d: _pages(s, d).select("page_id", tx.id_key(F.col("page_id")).alias("id_key")),
    "main_block": lambda s, d: blocks.densest(blocks.block_lines(_tables_to_lines(s, d), "t")).select("page_id", "block_no", "lo", "hi", "weight"),
    "main_text": main_lines,
    "top_half_blocks": lambda s, d: blocks.top_half(_tables_to_lines(s, d), "t").select("page_id", "block_no", "weight", "rank"),
    "tokenize_bigram": lambda s, d: tokens.bigram_hits(_docs(s, d)),
    "tokenize_unigram": lambda s, d: tokens.unigram_hits(_docs(s, d)),
    "postings": lambda s, d: _index(s, d).select("word", "doc_id", "tf", F.array_min("pos").alias("first_pos"), F.array_max("pos").alias("last_pos")),
    "index_counters": lambda s, d: _index(s, d).agg(F.count_distinct("word").alias("n_words"), F.count(F.lit(1)).alias("n_postings"), F.sum("tf").alias("n_hits")),
    "doc_freq": lambda s, d: index.doc_freq(_index(s, d)),
    "running_df": lambda s, d: index.running_doc_freq(_index(s, d)),
    "idf": lambda s, d: index.inverse_doc_freq(_index(s, d)),
    "posting_records": lambda s, d: index.decoded(index.encoded(_index(s, d))).select("word", "doc_id", "tf", F.array_min("pos").alias("first_pos"), F.size("pos").alias("n_pos")),
    "posting_record_text": lambda s, d: index.encoded(_index(s, d)).select("word", "doc_id", F.md5(F.translate("record", "\x00", ".")).alias("record_md5")),
    "word_order": lambda s, d: ranked(index.doc_freq(_index(s, d)), [F.col("word")]),
    "query_requests": lambda s, d: table(s, d, "search_query").select("query_id", tx.percent_decoded(tx.parameter(F.col("request"))).alias("query")).distinct(),
    "query_tokens": lambda s, d: s.createDataFrame(list(enumerate(tokens.query_words("你好世界 foo bar 中"))), "ord int, word string"),
    "term_lookup": lambda s, d: search.term_postings(_stored(s, d), ["library"]),
    "single_character_lookup": lambda s, d: search.term_postings(_stored(s, d, tokens.unigram_hits), ["的"]),
    "search_all_terms": lambda s, d: _matches(s, d, ["the", "library"]).filter("tier <= 2").select("doc_id"),
    "search_phrase": lambda s, d: search.phrase_starts(tokens.bigram_hits(_docs(s, d)), ["the", "library"]),
    "search_any_term": lambda s, d: index.lookup(_stored(s, d), ["the", "library"]).select("doc_id").distinct(),
    "search_just_about": lambda s, d: _matches(s, d, ["the", "library"]).filter("tier = 3").select("doc_id"),
    "about_anchor": lambda s, d: _matches(s, d, ["library", "the"]).filter("tier = 3").select("doc_id", "anchor_pos"),
    "rarest_first": lambda s, d: search.word_counts(_stored(s, d), ["the", "library", "zzz"]),
    "tfidf_scores": lambda s, d: _matches(s, d, ["that", "with"]).select("doc_id", "score"),
    "tfidf_running_compat": lambda s, d: search.running_scores(_stored(s, d), ["that", "with"]),
    "search_two_words": lambda s, d: search.search(_stored(s, d), "the library"),
    "search_cjk": lambda s, d: search.search(_stored(s, d), "图书馆"),
    "search_single_character": lambda s, d: search.search_either(_stored(s, d), _stored(s, d, tokens.unigram_hits), "的"),
    "search_missing_term": lambda s, d: search.search(_stored(s, d), "library zzz"),
    "search_no_match": lambda s, d: search.search(_stored(s, d), "zzz yyy"),
    "search_code": lambda s, d: search.result_code(_matches(s, d, ["the", "library"]), ["the", "library"]),
    "search_topk": lambda s, d: search.search(_stored(s, d), "the library", limit=20),
    "snippets": lambda s, d: _matches(s, d, ["the", "library"]).join(_docs(s, d), "doc_id").select("doc_id", tx.snippet(F.col("text"), F.col("anchor_pos")).alias("snippet")),
    "search_pages_result": lambda s, d: _result_pages(s, d).select("rank", "page_id", "url", "title", "snippet"),
    "result_page_lines": lambda s, d: search.rendered(_result_pages(s, d)),
    "stored_index_lookup": stored,
    "stored_search": stored_search,
    "incremental_append": incremental,
    "compacted_index": compacted,
    "stream_index": stream,
}

_C = r"\x{3192}-\x{FABF}"
_PAGES = """pages AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY fetched_at DESC NULLS LAST) AS rn FROM spider_v20 WHERE page_id IS NOT NULL) WHERE rn = 1)"""
_HOST = r"nullif(lower(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\s]*)', 1)), '')"
_SITE = rf"nullif(regexp_replace(regexp_replace(regexp_replace({_HOST}, '^.*@', ''), ':[0-9]*$', ''), '^www\.', ''), '')"
_NO_SCRIPT = r"regexp_replace(regexp_replace(html, '(?s)<script[^>]*>.*?(?:</script>|\z)', '', 'g'), '(?s)<style[^>]*>.*?(?:</style>|\z)', '', 'g')"


def _hits(source: str) -> str:
    """Common table expressions of the hits of (doc_id, text)."""
    return f"""cleaned AS (SELECT doc_id, string_split(regexp_replace(text, '[^A-Za-z ' || chr(10) || '{_C}]', '', 'g'), chr(10)) AS ls FROM ({source}) WHERE text IS NOT NULL),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS ln, len(ls) AS n FROM cleaned),
worded AS (SELECT doc_id, ln, n, regexp_matches(line, '[^ ]$') AS open,
  flatten(list_transform(regexp_extract_all(line, '[A-Za-z]+|[{_C}]+'), lambda w: CASE WHEN length(w) = 1 OR w < '{{' THEN [w] ELSE list_transform(range(1, length(w)), lambda i: substr(w, i, 2)) END)) AS words FROM lines),
based AS (SELECT *, coalesce(sum(len(words) - CASE WHEN open AND len(words) > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM worded),
cutoff AS (SELECT doc_id, before, CASE WHEN ln = n AND open AND len(words) > 0 THEN words[1:len(words) - 1] ELSE words END AS words FROM based),
hits AS (SELECT doc_id, unnest(words) AS word, (before + generate_subscripts(words, 1) - 1)::INT AS pos FROM cutoff),
postings AS (SELECT doc_id, word, count(*)::INT AS tf, list_sort(list(pos)) AS pos FROM hits GROUP BY ALL),
freq AS (SELECT word, count(*) AS df FROM postings GROUP BY word)"""


_DOC_HITS = _hits("SELECT doc_id, text FROM documents")
_PAGE_HITS = _hits("SELECT page_id AS doc_id, coalesce(CASE WHEN length(trim(title)) > 0 THEN title END, '') || coalesce(raw_text, '') AS text FROM pages")


def _found(words: list[str]) -> str:
    """Common table expressions of the matches of a query."""
    n = len(set(words))
    query = ", ".join(f"({i}, '{w}')" for i, w in enumerate(words))
    return f"""query(ord, word) AS (VALUES {query}),
scores AS (SELECT doc_id, count(*) AS n_words, round(sum(round(tf * log2(100.0 / df), 9)::DECIMAL(30, 9))::DOUBLE, 6) AS score FROM postings JOIN freq USING (word) WHERE word IN (SELECT word FROM query) GROUP BY doc_id),
starts AS (SELECT doc_id, pos - ord AS start_pos FROM hits JOIN query USING (word) GROUP BY ALL HAVING count(DISTINCT ord) = {len(words)}),
phrases AS (SELECT doc_id, min(start_pos) AS phrase_pos FROM starts GROUP BY doc_id),
firsts AS (SELECT doc_id, arg_min(pos[1], ord) AS first_pos FROM postings JOIN query USING (word) GROUP BY doc_id),
found AS (SELECT doc_id, CASE WHEN phrase_pos IS NOT NULL THEN 1 WHEN n_words = {n} THEN 2 ELSE 3 END AS tier, coalesce(phrase_pos, first_pos)::INT AS anchor_pos, score
  FROM scores LEFT JOIN phrases USING (doc_id) LEFT JOIN firsts USING (doc_id)),
ranked AS (SELECT row_number() OVER (ORDER BY tier, score DESC, doc_id) AS rank, doc_id, tier, anchor_pos, score FROM found)"""


def _search(words: list[str], select: str, base: str = _DOC_HITS) -> str:
    return f"WITH {base}, {_found(words)} {select}"


_THE = ["the", "library"]
_RANKED = "SELECT rank, doc_id, tier, anchor_pos, score FROM ranked"
_BLOCKS = f"""{_PAGES},
txt AS (SELECT page_id, string_split(regexp_replace({_NO_SCRIPT}, '<[^>]*>', chr(10), 'g'), chr(10)) AS ls FROM pages WHERE html IS NOT NULL),
lines AS (SELECT page_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM txt)"""
_NUMBERED = """numbered AS (SELECT *, coalesce(sum(CASE WHEN line = '' AND line_no > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS block_no FROM lines),
blocks AS (SELECT page_id, block_no, min(line_no)::INT AS lo, max(line_no)::INT AS hi, sum(length(replace(line, ' ', '')))::BIGINT AS weight FROM numbered GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY weight DESC, block_no) AS r FROM blocks) WHERE r = 1)"""
_LINKS = r"""links AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*href\s*=\s*["'']([^"''<>]*)["'']', 1)) AS link FROM pages)"""
_GRAPH = rf"""{_PAGES}, {_LINKS},
graph AS (SELECT DISTINCT url AS source, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*:)', 1) || '//' || regexp_extract(url, '://([^/?#]*)', 1) || trim(link) AS target FROM links WHERE url IS NOT NULL AND trim(link) LIKE '/%')"""
_CRAWL = rf"""WITH RECURSIVE {_GRAPH},
seeds AS (SELECT DISTINCT lower(trim(url)) AS url FROM seed_list WHERE trim(url) <> ''),
links_all AS (SELECT source, target FROM graph UNION SELECT 'http://' || {_SITE} || '/', url FROM pages WHERE url IS NOT NULL),
reached(url, depth) AS (SELECT url, 0 FROM seeds UNION SELECT target, depth + 1 FROM reached JOIN links_all ON source = url WHERE depth < 8),
levels AS (SELECT url, min(depth)::INT AS depth FROM reached GROUP BY 1)"""
_RESULTS = f"""WITH {_PAGES}, {_PAGE_HITS}, {_found(_THE)},
results AS (SELECT rank, doc_id AS page_id, url, CASE WHEN length(trim(title)) > 0 THEN title END AS title,
  substr(raw_text, greatest(anchor_pos - 100, 0) + 1, anchor_pos + 51 - greatest(anchor_pos - 100, 0)) AS snippet FROM ranked LEFT JOIN pages ON page_id = doc_id)"""

SQL: dict[str, str] = {
    "clean_text": f"SELECT doc_id, regexp_replace(text, '[^A-Za-z ' || chr(10) || '{_C}]', '', 'g') AS cleaned FROM documents",
    "strip_html": f"WITH {_PAGES} SELECT page_id, regexp_replace(regexp_replace({_NO_SCRIPT}, '<[^>]*>', '', 'g'), '[^A-Za-z {_C}]', '', 'g') AS body FROM pages",
    "page_text": f"WITH {_PAGES} SELECT page_id, md5(regexp_replace({_NO_SCRIPT}, '<[^>]*>', '', 'g')) AS text_md5 FROM pages",
    "page_title": f"WITH {_PAGES} SELECT page_id, nullif(regexp_extract(html, '<title[^>]*>([^<]*)<', 1), '') AS title FROM pages",
    "page_links_strict": rf"""WITH {_PAGES} SELECT page_id, unnest(regexp_extract_all(html, '<a[^>]href=["'']([^ ]+(?:{"|".join(tx.LINK_ENDINGS)})|[^ ]tech)["'']', 1)) AS link FROM pages""",
    "page_links": f"WITH {_PAGES}, {_LINKS} SELECT page_id, link FROM links WHERE regexp_matches(link, 'html?$')",
    "page_hosts": f"WITH {_PAGES} SELECT {_HOST} AS host, count(*) AS n_pages FROM pages WHERE {_HOST} IS NOT NULL GROUP BY 1",
    "page_sites": f"WITH {_PAGES} SELECT {_SITE} AS site, count(*) AS n_pages FROM pages GROUP BY 1",
    "link_graph": f"WITH {_GRAPH} SELECT source, count(*) AS n_targets FROM graph GROUP BY 1",
    "frontier_new_links": f"WITH {_GRAPH} SELECT DISTINCT target AS link FROM graph WHERE target NOT IN (SELECT url FROM pages WHERE url IS NOT NULL)",
    "crawl_levels": f"{_CRAWL} SELECT url, depth FROM levels",
    "crawl_capped": f"{_CRAWL} SELECT url, depth FROM levels ORDER BY depth, url LIMIT 100",
    "seed_file": "SELECT rtrim(coalesce(url, '')) AS url FROM seed_list",
    "visited_log": f"WITH {_PAGES} SELECT DISTINCT url FROM pages WHERE url IS NOT NULL",
    "page_text_files": f"WITH {_PAGES} SELECT page_id, md5(coalesce(CASE WHEN length(trim(title)) > 0 THEN title END, '') || coalesce(raw_text, '')) AS text_md5 FROM pages",
    "html_files": f"WITH {_PAGES} SELECT page_id, md5(html) AS html_md5 FROM pages WHERE html IS NOT NULL",
    "host_schedule": f"""WITH {_PAGES}, h AS (SELECT page_id, {_HOST} AS host FROM pages), r AS (SELECT page_id, host, row_number() OVER (PARTITION BY host ORDER BY page_id) AS slot FROM h WHERE host IS NOT NULL)
SELECT page_id, host, slot::INT AS slot, (slot - 1) * 2.0::DOUBLE AS at FROM r""",
    "page_ids": f"WITH {_PAGES} SELECT url, row_number() OVER (ORDER BY url) - 1 AS page_id FROM (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL)",
    "page_store": f"WITH {_PAGES} SELECT page_id, url, CASE WHEN length(trim(title)) > 0 THEN title END AS title, coalesce(length(raw_text), 0)::INT AS n_chars FROM pages",
    "id_keys": f"WITH {_PAGES} SELECT page_id, rpad(page_id::VARCHAR, 10, ' ') AS id_key FROM pages",
    "main_block": f"WITH {_BLOCKS}, {_NUMBERED} SELECT page_id, block_no, lo, hi, weight FROM best",
    "main_text": f"""WITH {_PAGES}, lines AS (SELECT page_id, unnest(string_split(raw_text, chr(10))) AS line, generate_subscripts(string_split(raw_text, chr(10)), 1) - 1 AS line_no FROM pages WHERE raw_text IS NOT NULL), {_NUMBERED},
stops AS (SELECT b.page_id, max(CASE WHEN o.block_no < b.block_no THEN o.block_no END) AS low, min(CASE WHEN o.block_no > b.block_no THEN o.block_no END) AS high
  FROM best b LEFT JOIN blocks o ON o.page_id = b.page_id AND o.weight = 0 AND (o.block_no - b.block_no) % 2 = 0 GROUP BY 1),
near AS (SELECT o.page_id, o.block_no FROM blocks o JOIN best b USING (page_id) JOIN stops s USING (page_id)
  WHERE (o.block_no - b.block_no) % 2 = 0 AND o.block_no > coalesce(s.low, -1) AND o.block_no < coalesce(s.high, 2147483647))
SELECT page_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM numbered JOIN near USING (page_id, block_no) GROUP BY 1""",
    "top_half_blocks": f"""WITH {_BLOCKS},
marked AS (SELECT *, CASE WHEN line <> '' AND coalesce(lag(line) OVER (PARTITION BY page_id ORDER BY line_no), '') = '' THEN 1 ELSE 0 END AS starts FROM lines),
paragraphs AS (SELECT page_id, block_no, sum(length(line) + 1)::BIGINT AS weight FROM (SELECT *, (sum(starts) OVER (PARTITION BY page_id ORDER BY line_no) - 1)::INT AS block_no FROM marked) WHERE line <> '' GROUP BY ALL),
r AS (SELECT *, (row_number() OVER (PARTITION BY page_id ORDER BY weight DESC, block_no))::INT AS rank, count(*) OVER (PARTITION BY page_id) AS n FROM paragraphs)
SELECT page_id, block_no, weight, rank FROM r WHERE rank <= floor(n * 0.5)""",
    "tokenize_bigram": f"WITH {_DOC_HITS} SELECT doc_id, word, pos FROM hits",
    "tokenize_unigram": f"""WITH c AS (SELECT doc_id, regexp_replace(text, '[^A-Za-z ' || chr(10) || '{_C}]', '', 'g') AS c FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, regexp_extract_all(c, '[A-Za-z]+|[{_C}]') AS words, regexp_matches(c, '[^ ' || chr(10) || ']$') AS open FROM c),
k AS (SELECT doc_id, CASE WHEN open THEN words[1:len(words) - 1] ELSE words END AS words FROM w)
SELECT doc_id, unnest(words) AS word, (generate_subscripts(words, 1) - 1)::INT AS pos FROM k""",
    "postings": f"WITH {_DOC_HITS} SELECT word, doc_id, tf, pos[1] AS first_pos, pos[len(pos)] AS last_pos FROM postings",
    "index_counters": f"WITH {_DOC_HITS} SELECT count(DISTINCT word) AS n_words, count(*) AS n_postings, sum(tf)::BIGINT AS n_hits FROM postings",
    "doc_freq": f"WITH {_DOC_HITS} SELECT word, df FROM freq",
    "running_df": f"WITH {_DOC_HITS} SELECT word, doc_id, row_number() OVER (PARTITION BY word ORDER BY doc_id) AS df_so_far FROM postings",
    "idf": f"WITH {_DOC_HITS} SELECT word, round(log2(100.0 / df), 6) AS idf FROM freq",
    "posting_records": f"WITH {_DOC_HITS} SELECT word, doc_id, tf, pos[1] AS first_pos, len(pos)::INT AS n_pos FROM postings",
    "posting_record_text": f"""WITH {_DOC_HITS}, so_far AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY doc_id) AS n FROM postings)
SELECT word, doc_id, md5(rpad(n::VARCHAR, 11, '.') || rpad(doc_id::VARCHAR, 11, '.') || rpad(tf::VARCHAR, 7, '.') || array_to_string(list_transform(pos, lambda p: rpad(p::VARCHAR, 7, '.')), '') || '*') AS record_md5 FROM so_far""",
    "word_order": f"WITH {_DOC_HITS} SELECT word, df, row_number() OVER (ORDER BY word) AS rank FROM freq",
    "query_requests": r"""WITH r AS (SELECT DISTINCT query_id, CASE WHEN contains(request, '=') THEN regexp_extract(request, '(?s)^[^=]*=(.*)$', 1) END AS q FROM search_query),
whole AS (SELECT query_id, regexp_replace(q, '%([0-9A-Fa-f]?)([^0-9A-Fa-f]|$)', '%25\1\2', 'g') AS q FROM r),
valid AS (SELECT query_id, regexp_replace(q, '(?i)(?:%[CD][0-9A-F]|%E[0-9A-F](?:%[89AB][0-9A-F])?)(%[0-7]|[^%]|$)', '%EF%BF%BD\1', 'g') AS q FROM whole)
SELECT DISTINCT query_id, url_decode(replace(q, '+', '%20')) AS query FROM valid""",
    "query_tokens": "SELECT * FROM (VALUES (0, '你好'), (1, '好世'), (2, '世界'), (3, 'foo'), (4, 'bar'), (5, '中')) t(ord, word)",
    "term_lookup": f"WITH {_DOC_HITS} SELECT doc_id, tf FROM postings WHERE word = 'library'",
    "single_character_lookup": f"""WITH c AS (SELECT doc_id, regexp_replace(text, '[^A-Za-z ' || chr(10) || '{_C}]', '', 'g') AS c FROM documents WHERE text IS NOT NULL)
SELECT doc_id, tf::INT AS tf FROM (SELECT doc_id, length(c) - length(replace(c, '的', '')) - CASE WHEN suffix(c, '的') THEN 1 ELSE 0 END AS tf FROM c) WHERE tf > 0""",
    "search_all_terms": _search(_THE, "SELECT doc_id FROM found WHERE tier <= 2"),
    "search_phrase": _search(_THE, "SELECT doc_id, start_pos::INT AS start_pos FROM starts"),
    "search_any_term": f"WITH {_DOC_HITS} SELECT DISTINCT doc_id FROM postings WHERE word IN ('the', 'library')",
    "search_just_about": _search(_THE, "SELECT doc_id FROM found WHERE tier = 3"),
    "about_anchor": _search(_THE[::-1], "SELECT doc_id, anchor_pos FROM found WHERE tier = 3"),
    "rarest_first": f"WITH {_DOC_HITS}, query(ord, word) AS (VALUES (0, 'the'), (1, 'library'), (2, 'zzz')) SELECT ord, word, coalesce(df, 0) AS n_pages FROM query LEFT JOIN freq USING (word)",
    "tfidf_scores": _search(["that", "with"], "SELECT doc_id, score FROM found"),
    "tfidf_running_compat": _search(["that", "with"], "SELECT doc_id, (sum(score::DECIMAL(30, 6)) OVER (ORDER BY doc_id))::DOUBLE AS running_score FROM found"),
    "search_two_words": _search(_THE, _RANKED),
    "search_cjk": _search(["图书", "书馆"], _RANKED),
    "search_single_character": f"""WITH c AS (SELECT doc_id, regexp_replace(text, '[^A-Za-z ' || chr(10) || '{_C}]', '', 'g') AS c FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, regexp_extract_all(c, '[A-Za-z]+|[{_C}]') AS words, regexp_matches(c, '[^ ' || chr(10) || ']$') AS open FROM c),
k AS (SELECT doc_id, CASE WHEN open THEN words[1:len(words) - 1] ELSE words END AS words FROM w),
f AS (SELECT doc_id, list_position(words, '的') - 1 AS anchor_pos, len(list_filter(words, lambda x: x = '的')) AS tf FROM k WHERE list_contains(words, '的'))
SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS rank, doc_id, 1 AS tier, anchor_pos::INT AS anchor_pos, score
FROM (SELECT doc_id, anchor_pos, round(tf * log2(100.0 / (SELECT count(*) FROM f)), 6) AS score FROM f)""",
    "search_missing_term": _search(["library", "zzz"], _RANKED),
    "search_no_match": _search(["zzz", "yyy"], _RANKED),
    "search_code": _search(_THE, "SELECT CASE min(tier) WHEN 1 THEN 0 WHEN 2 THEN -3 WHEN 3 THEN -2 ELSE -1 END AS code FROM found"),
    "search_topk": _search(_THE, _RANKED + " WHERE rank <= 20"),
    "snippets": _search(_THE, "SELECT doc_id, substr(text, greatest(anchor_pos - 100, 0) + 1, anchor_pos + 51 - greatest(anchor_pos - 100, 0)) AS snippet FROM found JOIN documents USING (doc_id)"),
    "search_pages_result": f"{_RESULTS} SELECT rank, page_id, url, title, snippet FROM results",
    "result_page_lines": _RESULTS + " SELECT rank, '<a href=\"' || {0} || '\">' || rank || ': ' || {1} || '</a><br>' || {2} || '<br>' AS line FROM results".format(
        *[f"replace(replace(replace(replace(coalesce({c}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')" for c in ("url", "title", "snippet")]),
    "stored_index_lookup": f"WITH {_DOC_HITS} SELECT word, doc_id, tf, pos[1] AS first_pos FROM postings WHERE word IN ('that', 'with')",
    "stored_search": _search(_THE, _RANKED),
    "incremental_append": f"WITH {_DOC_HITS} SELECT word, doc_id, tf FROM postings",
    "compacted_index": f"WITH {_DOC_HITS} SELECT word, doc_id, tf, pos[1] AS first_pos FROM postings",
    "stream_index": f"WITH {_DOC_HITS} SELECT word, doc_id, tf FROM postings",
}
