"""Tokenizers, index and search, against a plain Python reading of the same rules and against cases worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import index, search, tokens
from quern.operators.order import ranked, running_sum

PAGES = [(0, "foo bar，你好世界 café9x\nend Ｋ中\n"), (1, "bar foo\nbaz 中文abc 中 tail")]
DOCS = "doc_id bigint, text string"


def brute_bigrams(text: str) -> list[tuple[str, int]]:
    """A walk over the characters, as an automaton would make it."""
    kept = [c for c in text if c in " \n" or c.isascii() and c.isalpha() or 0x3192 <= ord(c) <= 0xFABF]
    out, pos, run = [], 0, ""

    def cjk(c):
        return ord(c) >= 0x3192

    for c in kept:
        if c in " \n":
            if run:
                out.append((run, pos))
                pos += c == " "
            run = ""
        elif not run:
            run = c
        elif cjk(c) != cjk(run[-1]):
            out.append((run, pos))
            pos, run = pos + 1, c
        elif cjk(c) and len(run) == 2:
            out.append((run, pos))
            pos, run = pos + 1, run[-1] + c
        else:
            run += c
    return out  # what is pending at the end isn't a word


def hits(spark, pages, f=tokens.bigram_hits, **more):
    rows = f(spark.createDataFrame(pages, DOCS), **more).collect()
    return sorted((r["doc_id"], r["pos"], r["word"]) for r in rows)


def test_bigrams_by_hand(spark):
    got = hits(spark, PAGES)
    assert [(w, p) for d, p, w in got if d == 0] == [("foo", 0), ("bar", 1), ("你好", 2), ("好世", 3), ("世界", 4), ("cafx", 5), ("end", 5), ("中", 6)] or sorted((w, p) for d, p, w in got if d == 0) == sorted([("foo", 0), ("bar", 1), ("你好", 2), ("好世", 3), ("世界", 4), ("cafx", 5), ("end", 5), ("中", 6)])
    assert sorted((w, p) for d, p, w in got if d == 1) == sorted([("bar", 0), ("foo", 1), ("baz", 1), ("中文", 2), ("abc", 3), ("中", 4)])


def test_bigrams_brute_force(spark):
    rnd = random.Random(4)
    pages = [(i, "".join(rnd.choice("ab  \n中文字-9") for _ in range(rnd.randrange(40)))) for i in range(300)]
    pages += [(300, ""), (301, None), (302, "\n\n"), (303, " a"), (304, "x" * 5000 + " " + "中" * 3000 + " "), (305, "a \nb ")]
    want = sorted((i, p, w) for i, t in pages if t for w, p in brute_bigrams(t))
    assert hits(spark, pages) == want


def test_unigrams_by_hand(spark):
    assert hits(spark, [(0, "你好 ab\nc ")], tokens.unigram_hits) == [(0, 0, "你"), (0, 1, "好"), (0, 2, "ab"), (0, 3, "c")]
    assert hits(spark, [(0, "你好")], tokens.unigram_hits) == [(0, 0, "你")]
    assert hits(spark, [(0, "你好")], tokens.unigram_hits, flush_tail=True) == [(0, 0, "你"), (0, 1, "好")]


def test_flush_tail(spark):
    assert hits(spark, [(0, "a b")], flush_tail=True) == [(0, 0, "a"), (0, 1, "b")]


@pytest.mark.parametrize("query,words", [("你好世界", ["你好", "好世", "世界"]), ("你", ["你"]), ("foo bar", ["foo", "bar"]), ("foo ", ["foo"]), ("web2", ["web"]), ("", []), ("。", [])])
def test_query_words(query, words):
    assert tokens.query_words(query) == words


@pytest.mark.parametrize("query,words", [("foo ", ["foo", ""]), ("a-b0c", ["abc"]), ("web2", ["web2"]), ("", [""])])
def test_query_words_as_written(query, words):
    assert tokens.query_words(query, keep_all=True) == words


def test_single_character_queries():
    assert tokens.uses_single_characters(["你"]) and not tokens.uses_single_characters(["你好"]) and not tokens.uses_single_characters(["a"])


def built(spark, pages=PAGES):
    return index.postings(tokens.bigram_hits(spark.createDataFrame(pages, DOCS)))


@pytest.mark.parametrize("query,phrase,every,some,code", [
    ("foo bar", {0}, {1}, set(), 0), ("bar baz", {1}, set(), {0}, 0), ("foo baz", set(), {1}, {0}, -3), ("foo abc cafx", set(), set(), {0, 1}, -2),
    ("foo zzz", set(), set(), {0, 1}, -2), ("zzz yyy", set(), set(), set(), -1), ("bar", {0, 1}, set(), set(), 7), ("", set(), set(), set(), -1),
])
def test_tiers(spark, query, phrase, every, some, code):
    words = tokens.query_words(query)
    found = search.matches(built(spark), words)
    tiers = {r["doc_id"]: r["tier"] for r in found.collect()}
    assert [{d for d, t in tiers.items() if t == k} for k in (1, 2, 3)] == [phrase, every, some]
    assert search.result_code(found, words).first()["code"] == code


def test_scores_anchors_and_ranks(spark):
    pages = [(i, "the rare thing is here ") for i in range(3)] + [(i, "the thing ") for i in range(3, 8)]
    rows = search.search(built(spark, pages), "rare thing").orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 9))
    assert [r["doc_id"] for r in rows] == list(range(8))
    assert rows[0]["anchor_pos"] == 1 and rows[5]["anchor_pos"] == 1 and rows[0]["score"] == pytest.approx(8.702750, abs=1e-5)
    assert [r["doc_id"] for r in search.search(built(spark, pages), "rare thing", limit=2).orderBy("rank").collect()] == [0, 1]


def test_fixed_phrase_anchor_and_choice_of_index(spark):
    found = {r["doc_id"]: r["anchor_pos"] for r in search.matches(built(spark), ["foo", "bar"], phrase_anchor=1).collect()}
    assert found == {0: 1, 1: 1} and {r["doc_id"]: r["anchor_pos"] for r in search.matches(built(spark), ["foo", "bar"]).collect()} == {0: 0, 1: 1}
    singles = index.postings(tokens.unigram_hits(spark.createDataFrame(PAGES, DOCS)))
    assert [r["doc_id"] for r in search.search_either(built(spark), singles, "世").collect()] == [0]
    assert [r["doc_id"] for r in search.search_either(built(spark), singles, "世界").collect()] == [0]


def test_repeated_query_words_count_once(spark):
    once = {r["doc_id"]: r["score"] for r in search.matches(built(spark), ["foo"]).collect()}
    twice = {r["doc_id"]: r["score"] for r in search.matches(built(spark), ["foo", "foo"]).collect()}
    assert once == twice


def test_phrases_brute_force(spark):
    rnd = random.Random(9)
    pages = [(i, "".join(rnd.choice(["a ", "b ", "c ", "a\n"]) for _ in range(30))) for i in range(60)]
    at = {i: {} for i, _ in pages}
    for i, t in pages:
        for w, p in brute_bigrams(t):
            at[i].setdefault(w, set()).add(p)
    words = ["a", "b", "a"]
    want = sorted((i, p) for i, m in at.items() for p in m.get("a", ()) if p + 1 in m.get("b", ()) and p + 2 in m["a"])
    got = search.phrase_starts(tokens.bigram_hits(spark.createDataFrame(pages, DOCS)), words).collect()
    assert sorted((r["doc_id"], r["start_pos"]) for r in got) == want
    tiers = {r["doc_id"]: r["phrase_pos"] for r in search.matches(built(spark, pages), words).collect()}
    assert {d: p for d, p in tiers.items() if p is not None} == {d: min(p for e, p in want if e == d) for d in {e for e, _ in want}}


def test_properties(spark):
    rows = built(spark)
    assert rows.agg(F.sum("tf")).first()[0] == tokens.bigram_hits(spark.createDataFrame(PAGES, DOCS)).count()
    assert all(r["pos"] == sorted(r["pos"]) and len(r["pos"]) == r["tf"] for r in rows.collect())
    assert rows.repartition(7).count() == rows.count()


def test_records_round_trip(spark):
    rows = built(spark)
    records = index.encoded(rows)
    assert {len(r["record"]) for r in records.collect() if r["word"] == "foo"} == {37}
    want = sorted(map(tuple, rows.select("doc_id", "word", "tf", "pos").collect()))
    assert sorted(map(tuple, index.decoded(records).select("doc_id", "word", "tf", "pos").collect())) == want


def test_stored_index_and_pruning(spark, tmp_path):
    index.write_index(built(spark), str(tmp_path / "i"), 8)
    stored = index.read_index(spark, str(tmp_path / "i"))
    got = index.lookup(stored, ["foo", "中"])
    assert sorted((r["word"], r["doc_id"]) for r in got.collect()) == [("foo", 0), ("foo", 1), ("中", 0), ("中", 1)]
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "PushedFilters: [In(word" in plan
    assert index.lookup(stored, []).count() == 0
    with pytest.raises(ValueError, match="folders"):
        index.lookup(built(spark).withColumn("bucket", F.lit(1)), ["foo"])


def test_any_number_of_folders_gives_the_same_search(spark, tmp_path):
    want = [tuple(r) for r in search.search(built(spark), "foo bar").collect()]
    for n in (1, 16, 64, 200, None):
        path = str(tmp_path / str(n))
        index.write_index(built(spark), path, n)
        stored = index.read_index(spark, path)
        assert [tuple(r) for r in search.search(stored, "foo bar").collect()] == want and want
        assert search.word_counts(stored, ["foo"]).first()["n_pages"] == 2


def test_compacted_indexes_keep_the_last_postings(spark, tmp_path):
    parts = []
    for k, rows in enumerate([[(1, "old old "), (2, "foo ")], [(1, "new "), (3, "bar ")], [(3, "bar bar ")]]):
        parts.append(str(tmp_path / f"p{k}"))
        index.write_index(built(spark, rows), parts[-1], 4 + k)
    index.compacted(spark, parts, str(tmp_path / "all"))
    rows = index.read_index(spark, str(tmp_path / "all")).collect()
    assert sorted((r["doc_id"], r["word"], r["tf"]) for r in rows) == [(1, "new", 1), (2, "foo", 1), (3, "bar", 2)]


def test_merging_twice_changes_nothing(spark):
    first, second = built(spark, PAGES[:1]), built(spark, PAGES[1:])
    merged = index.merged(index.merged(first, second), second)
    assert sorted(map(str, merged.collect())) == sorted(map(str, built(spark).select(*merged.columns).collect()))


def test_empty_tables(spark):
    empty = built(spark, [(1, None)])
    assert empty.count() == 0 and index.doc_freq(empty).count() == 0 and index.running_doc_freq(empty).count() == 0
    assert search.search(empty, "a b").count() == 0 and search.running_scores(empty, ["a"]).count() == 0


def test_running_sum_and_rank_over_blocks(spark):
    df = spark.createDataFrame([(k, i, i % 3) for k in "xy" for i in range(50)], "k string, i bigint, v int")
    got = {(r["k"], r["i"]): r["s"] for r in running_sum(df, F.col("v"), "i", "s", "k").collect()}
    assert got == {(k, i): sum(j % 3 for j in range(i + 1)) for k in "xy" for i in range(50)}
    sparse = spark.range(0, 40, numPartitions=3).select(F.xxhash64("id").alias("i"))
    got = {r["i"]: r["s"] for r in running_sum(sparse, F.lit(1), "i", "s").collect()}
    assert got == {i: k + 1 for k, i in enumerate(sorted(got))}
    rows = ranked(df.repartition(5), [F.col("v").desc(), F.col("k"), F.col("i")]).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 101))
    assert [(-r["v"], r["k"], r["i"]) for r in rows] == sorted((-r["v"], r["k"], r["i"]) for r in rows)
