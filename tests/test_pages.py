"""Blocks, crawling, sources, streaming, settings and the facade."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quern import facade
from quern.operators import blocks, crawl
from quern.operators.heavy_keys import heavy_pages, page_summary
from quern.operators.index import postings
from quern.operators.tokens import bigram_hits
from quern.sources import config, files, tables
from quern.streaming.index_stream import index_stream, read_stream_index

TEXT = "page_id bigint, t string"


def test_blocks_by_hand(spark):
    lines = blocks.block_lines(spark.createDataFrame([(1, "aa\n\nbbbb bb\ncc\n\n\nd")], TEXT), "t")
    got = sorted(tuple(r) for r in blocks.blocks(lines).select("block_no", "lo", "hi", "weight").collect())
    assert got == [(0, 0, 1, 2), (1, 2, 4, 8), (2, 5, 5, 0), (3, 6, 6, 1)]
    assert blocks.densest(lines).first()["block_no"] == 1


def brute_main(text: str) -> str:
    found, lines = [[]], text.split("\n")
    for i, x in enumerate(lines):
        found[-1].append(x)
        if x == "" and i > 0:
            found.append([])
    if not found[-1] and len(found) > 1 and sum(map(len, found)) == len(lines):
        found.pop()
    weight = [sum(len(x.replace(" ", "")) for x in b) for b in found]
    best = weight.index(max(weight))
    kept = {best}
    for step in (-2, 2):
        k = best + step
        while 0 <= k < len(found) and weight[k] != 0:
            kept.add(k)
            k += step
    return "\n".join(x for k in sorted(kept) for x in found[k])


def test_main_text_brute_force(spark):
    rnd = random.Random(3)
    texts = [(i, "\n".join(rnd.choice(["", "", "a", "bb b", " "]) for _ in range(rnd.randrange(1, 14)))) for i in range(150)] + [(900, "")]
    got = {r["page_id"]: r["text"] for r in blocks.main_text(blocks.block_lines(spark.createDataFrame(texts, TEXT), "t")).collect()}
    assert got == {i: brute_main(t) for i, t in texts}


def test_top_half(spark):
    df = spark.createDataFrame([(1, "long line here\nmore\n\nb\n\n\nmiddle\n\nc"), (2, None), (3, "one")], TEXT)
    rows = blocks.top_half(df, "t").orderBy("rank").collect()
    assert [(r["page_id"], r["block_no"], r["rank"]) for r in rows] == [(1, 0, 1), (1, 2, 2)]
    assert blocks.top_half_text(df, "t").first()["text"] == "long line here\nmore middle"


def test_crawl(spark):
    graph = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("d", "a"), ("x", "y")], "source string, target string")
    seeds = spark.createDataFrame([("a",), ("a",), ("",)], "url string")
    assert sorted(tuple(r) for r in crawl.crawl_levels(graph, seeds).collect()) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert sorted(tuple(r) for r in crawl.crawl_levels(graph, seeds, cap=2).collect()) == [("a", 0), ("b", 1)]
    assert crawl.crawl_levels(graph, seeds, cap=1).count() == 1 and crawl.crawl_levels(graph, seeds.limit(0)).count() == 0
    path = spark.createDataFrame([(str(i), str(i + 1)) for i in range(12)], "source string, target string")
    assert crawl.crawl_levels(path, spark.createDataFrame([("0",)], "url string")).agg({"depth": "max"}).first()[0] == 12
    assert sorted(r["link"] for r in crawl.new_links(graph, spark.createDataFrame([("b",), ("y",)], "url string")).collect()) == ["a", "c", "d"]


def test_host_schedule_over_blocks(spark):
    pages = spark.createDataFrame([(i * 10**12, f"http://h{i % 2}.test/{i}") for i in range(20)] + [(99, None)], "page_id bigint, url string")
    got = {r["page_id"]: (r["host"], r["slot"], r["at"]) for r in crawl.host_schedule(pages, delay=1.5).collect()}
    assert got == {i * 10**12: (f"h{i % 2}.test", i // 2 + 1, (i // 2) * 1.5) for i in range(20)}


def test_links_of_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.test/x/", '<a href="y.html"></a><a href="http://b.test/z.pdf"></a>'), (2, None, '<a href="q">'), (3, "http://a.test/", None)], "page_id bigint, url string, html string")
    assert sorted(r["target"] for r in crawl.link_graph(pages).collect()) == ["http://a.test/x/y.html", "http://b.test/z.pdf"]
    assert [r["target"] for r in crawl.link_graph(pages, within_site=True).collect()] == ["http://a.test/x/y.html"]
    assert sorted(r["link"] for r in crawl.page_links(pages, pattern="html$").collect()) == ["y.html"]


def test_files(spark, tmp_path):
    (tmp_path / "texts").mkdir()
    for name, text in (("0", "foo bar "), ("12", "中文 \nx "), (".hidden", "no")):
        (tmp_path / "texts" / name).write_text(text)
    got = {r["doc_id"]: r["text"] for r in files.text_directory(spark, str(tmp_path / "texts")).collect()}
    assert got == {0: "foo bar ", 12: "中文 \nx "}
    (tmp_path / "html").mkdir()
    (tmp_path / "html" / "7.html").write_text("<p>é</p>")
    assert [tuple(r) for r in files.html_directory(spark, str(tmp_path / "html")).collect()] == [(7, "<p>é</p>")]
    (tmp_path / "seeds").write_text("http://a.test/ \nhttp://b.test\n")
    assert [r["url"] for r in files.seeds(spark, str(tmp_path / "seeds")).collect()] == ["http://a.test/", "http://b.test"]


def test_page_store(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", " ", "text"), (2, None, "T", None)], "page_id bigint, url string, title string, raw_text string")
    store = files.page_store(pages)
    files.write_page_store(store, str(tmp_path / "s"))
    assert sorted(map(str, files.read_page_store(spark, str(tmp_path / "s")).collect())) == sorted(map(str, store.collect()))
    assert sorted(tuple(r) for r in files.page_files(store).collect()) == [(1, "text"), (2, "T")]
    files.write_texts(files.page_files(store), str(tmp_path / "texts"))
    files.write_texts(files.page_files(store), str(tmp_path / "texts"))
    assert sorted(tuple(r) for r in files.text_directory(spark, str(tmp_path / "texts")).collect()) == [(1, "text"), (2, "T")]
    files.write_visited(store.filter("url is not null"), str(tmp_path / "log"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "log")).collect()] == ["u"]


def test_config():
    got = config.read_config("port=8080\nback = 7\nother=1\n#port=1\nhomedir=/srv\n\nport=81")
    assert got == config.Config(port=81, backlog=7, interface="lo", home="/srv")
    assert config.read_config("") == config.Config()


def test_facade(spark):
    assert facade.request_path("GET /s?q=%E4%BD%A0+a HTTP/1.1") == "/s?q=%E4%BD%A0+a" and facade.request_path("POST / HTTP/1.1") is None and facade.request_path("") is None
    assert facade.route("/s?q=%E4%BD%A0+a") == ("search", "你 a") and facade.route("/") == ("file", "/index.html") and facade.route("/x.css") == ("file", "/x.css")
    pages = [(1, "http://a.test/?a&b", "A <b>", "foo bar here "), (2, None, None, "foo ")]
    store = files.page_store(spark.createDataFrame(pages, "page_id bigint, url string, title string, raw_text string"))
    index = postings(bigram_hits(store, "page_id"), "page_id")
    page = facade.results_page(index, store, "foo bar")
    assert '<a href="http://a.test/?a&amp;b">1: A &lt;b&gt;</a><br>foo bar here ' in page and '<a href="">2: </a>' in page
    assert "no record" in facade.results_page(index, store, "zzz")


def test_stream_equals_one_build(spark, tmp_path):
    schema = "doc_id bigint, text string"
    source = str(tmp_path / "in")
    first = [(1, "foo bar "), (2, "bar "), (3, "gone ")]
    spark.createDataFrame(first, schema).write.parquet(source)

    def run():
        df = spark.createDataFrame([], schema)
        index_stream(spark, source, df.schema, str(tmp_path / "i"), str(tmp_path / "c")).awaitTermination()
        return sorted((r["doc_id"], r["word"], r["tf"]) for r in read_stream_index(spark, str(tmp_path / "i")).collect())

    assert run() == [(1, "bar", 1), (1, "foo", 1), (2, "bar", 1), (3, "gone", 1)]
    assert run() == [(1, "bar", 1), (1, "foo", 1), (2, "bar", 1), (3, "gone", 1)]
    spark.createDataFrame([(2, "new new "), (3, ""), (4, "foo ")], schema).write.mode("append").parquet(source)
    assert run() == [(1, "bar", 1), (1, "foo", 1), (2, "new", 2), (4, "foo", 1)]
    for k, text in enumerate(("zoo ", "act ")):  # both in one batch: the later file's text holds, not the greater
        spark.createDataFrame([(9, text)], schema).coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.05)
    assert [r for r in run() if r[0] == 9] == [(9, "act", 1)]


def test_fetching(spark):
    import gzip
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from quern.sources.fetch import download, fetched

    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append((self.path, self.headers["User-Agent"]))
            if self.path == "/bad":
                self.send_response(404)
            elif self.path == "/flaky" and len(asked) < 3:
                self.send_response(503)
            else:
                self.send_response(200)
            body = gzip.compress("é ok".encode())
            self.send_header("Content-Encoding", "gzip")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{server.server_port}"
    assert download(f"{root}/flaky", "me") == "é ok" and [a for _, a in asked] == ["me"] * 3
    assert download(f"{root}/bad") is None and download("http://127.0.0.1:1/") is None and download("no url") is None
    rows = fetched(spark.createDataFrame([(f"{root}/a",), (f"{root}/bad",), (None,)], "url string"), delay=0.05).collect()
    assert {r["url"]: r["html"] for r in rows} == {f"{root}/a": "é ok", f"{root}/bad": None, None: None}
    server.shutdown()


def test_cut_and_shared_dir(spark):
    df = tables.cut(spark.range(10))
    assert df.count() == 10 and tables.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    with tables.freed():
        inside = tables.cut(spark.range(3))
        path = inside.inputFiles()[0].rsplit("/", 1)[0]
        assert inside.count() == 3 and tables.exists(spark, path)
    assert not tables.exists(spark, path) and df.count() == 10
    assert tables.spread(spark.range(3, numPartitions=1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


POSTINGS = "word string, page_id bigint, count_of_page int, pos array<int>, indexed_at timestamp, cnt string, at int"


def test_heavy_keys(spark):
    rows = [
        ("a", 1, 3, [4, 2, 9], "2024-01-02", "x", 1), ("a", 1, 3, [4, 2, 9], "2024-01-02", "x", 1), ("a", 1, 7, [0], "2024-01-01", "x", 1), ("a", 1, 8, [0], None, "x", 1),
        ("b", 1, None, [5, 6], "2024-01-02", None, None), ("c", 1, 2, None, "2024-01-02", None, None), ("d", 2, None, None, "2024-01-02", None, None),
        (None, 1, 9, [1], "2024-01-02", None, None), ("e", None, 9, [1], "2024-01-02", None, None), ("f", 3, 1, [], "2024-01-02", None, None),
    ]
    df = spark.createDataFrame([(*r[:4], None, *r[5:]) for r in rows], POSTINGS)
    times = spark.createDataFrame([(i, r[4]) for i, r in enumerate(rows)], "i int, t string")
    df = df.coalesce(1).withColumn("i", F.monotonically_increasing_id().cast("int")).join(times, "i").withColumn("indexed_at", F.col("t").cast("timestamp")).drop("i", "t")
    got = {r["page_id"]: tuple(r)[1:] for r in page_summary(df).collect()}
    assert got == {1: (3, 7, 2, 9), 2: (1, 0, None, None), 3: (1, 1, None, None)}
    assert [r["page_id"] for r in heavy_pages(df, 0.5).collect()] == [1]
    assert page_summary(df.limit(0)).count() == 0 and heavy_pages(df.limit(0)).count() == 0


def test_heavy_key_shuffles_states_only(spark):
    df = spark.range(0, 200_000, numPartitions=8).select(F.concat(F.lit("w"), F.col("id") % 50_000).alias("word"), F.when(F.col("id") % 3 == 0, F.col("id") % 9).otherwise(0).alias("page_id"), F.lit(1).alias("count_of_page"), F.array(F.lit(1)).alias("pos"), F.current_timestamp().alias("indexed_at"))
    plan = page_summary(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") >= 4 and "SortAggregate" not in plan
    assert page_summary(df).agg(F.sum("n_rows")).first()[0] == df.select("word", "page_id").distinct().count()
