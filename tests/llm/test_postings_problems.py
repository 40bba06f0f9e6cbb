"""Term counts, term weights and repeated site lines on dirty rows, against brute force."""

import math
import random
from datetime import datetime

import pytest

from quern.llm import site_lines, term_counts, term_weight

#: Two columns more than the table has, with names that the operators use inside.
POSTINGS = "word string, page_id bigint, count_of_page int, pos array<int>, indexed_at timestamp, cnt string, salt string, d int"
PAGES = "page_id bigint, url string, raw_text string, fetched_at timestamp, site string, h int, n int, html string, title string"


def day(n):
    return None if n is None else datetime(2024, 1, n)


def some_postings(seed=1, rows=600):
    rnd = random.Random(seed)
    out = []
    for _ in range(rows):
        word = "hot" if rnd.random() < 0.35 else rnd.choice(["a", "b", "c", "D", "d", "ü", "中文", "", None])
        page = 1 if rnd.random() < 0.35 else rnd.choice([None, *range(2, 40)])
        pos = rnd.choice([None, [], [3], [5, 1, 9]])
        out.append((word, page, rnd.choice([None, 1, 2, 7]), pos, day(rnd.choice([None, 1, 2, 3]))))
    # rows that tie are equal
    seen = {}
    out = [seen.setdefault((r[0], r[1], r[4]), r) for r in out]
    return [(*r, "x", "y", 5) for r in out + out[:50]]


def current(rows):
    best = {}
    for w, p, c, pos, at, *_ in rows:
        if w is not None and p is not None:
            key = at or datetime(1, 1, 1)
            if (w, p) not in best or best[w, p][0] < key:
                best[w, p] = (key, c if c is not None else len(pos) if pos is not None else 0)
    return {k: v[1] for k, v in best.items()}


def test_copies_open_no_record_and_leave_before_the_shuffle(spark):
    at = datetime(2024, 1, 1)
    rows = [("a", 1, 3, None, at)] * 500 + [("a", 1, 9, None, datetime(2023, 1, 1))] * 300 + [("a", 2, None, [4, 5], at), ("b", 1, 1, None, None)]
    df = spark.createDataFrame(rows, "word string, page_id bigint, count_of_page int, pos array<int>, indexed_at timestamp").repartition(4)
    got = {r["word"]: (r["occurrences"], r["records"]) for r in term_counts.term_counts(df).collect()}
    assert got == {"a": (5, 2), "b": (1, 1)}
    plan = term_counts.new_records(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # on the map side and behind the shuffle


def test_term_counts_brute_force(spark):
    rows = some_postings()
    cur = current(rows)
    want = {}
    for (w, _), c in cur.items():
        occ, n = want.get(w, (0, 0))
        want[w] = (occ + c, n + 1)
    df = spark.createDataFrame(rows, POSTINGS).repartition(5)
    assert {r["word"]: (r["occurrences"], r["records"]) for r in term_counts.term_counts(df).collect()} == want
    pages = len({p for _, p in cur})
    marks = {w: "rare" if n < 3 or o < 4 else "common" if n > 0.15 * pages else None for w, (o, n) in want.items()}
    assert {r["word"]: r["mark"] for r in term_counts.term_marks(df).collect()} == marks


def test_term_weights_brute_force(spark):
    rows = some_postings(2)
    cur = current(rows)
    pages = len({p for _, p in cur})
    d = {}
    for w, _ in cur:
        d[w] = d.get(w, 0) + 1
    df = spark.createDataFrame(rows, POSTINGS)
    plain = {k: round(c * math.log2(pages / d[k[0]]), 6) for k, c in cur.items()}
    got = term_weight.term_weights(df, k1=None, idf="log2")
    assert {(r["word"], r["page_id"]): r["score"] for r in got.collect()} == pytest.approx(plain)
    top = {p: max(s for (_, q), s in plain.items() if q == p) for p in {p for _, p in cur}}
    assert {(r["word"], r["page_id"]) for r in term_weight.most_distinctive(got).collect()} == {k for k, s in plain.items() if s == top[k[1]]}
    length = {}
    for (_, p), c in cur.items():
        length[p] = length.get(p, 0) + c
    average = sum(length.values()) / len(length)
    bm = {(w, p): round(c * 2.2 / (c + 1.2 * (0.25 + 0.75 * length[p] / average)) * math.log(1 + (pages - d[w] + 0.5) / (d[w] + 0.5)), 6) if c else 0.0 for (w, p), c in cur.items()}
    assert {(r["word"], r["page_id"]): r["score"] for r in term_weight.term_weights(df).collect()} == pytest.approx(bm, abs=2e-6)


def test_empty_postings(spark):
    df = spark.createDataFrame([], POSTINGS)
    assert term_counts.term_marks(df).count() == 0
    assert term_weight.most_distinctive(term_weight.term_weights(df)).count() == 0
    null = spark.createDataFrame([(None, 1, 1, [1], day(1), None, None, None), ("a", None, 1, [1], day(1), None, None, None)], POSTINGS)
    assert term_counts.term_counts(null).count() == 0


def brute_lines(pages, least=6, share=0.03):
    import re

    cur = {}
    for p in pages:
        if p[0] is not None and (p[0] not in cur or (cur[p[0]][3] or datetime(1, 1, 1)) < (p[3] or datetime(1, 1, 1))):
            cur[p[0]] = p

    def site(u):
        m = re.match(r"\s*[A-Za-z][\w+.\-]*://([^/?#\s]*)", u or "")
        s = re.sub(r"^www\.", "", re.sub(r":\d*$", "", re.sub("^.*@", "", m[1].lower()))) if m else ""
        return s or None

    def norm(x):
        return re.sub("[0-9]+", "0", re.sub("[ \t\r]+", " ", x.lower()).strip(" "))

    of = {i: (site(p[1]), [norm(x) for x in p[2].split("\n")] if p[2] is not None else []) for i, p in cur.items()}
    n, sizes = {}, {}
    for s, lines in of.values():
        sizes[s] = sizes.get(s, 0) + 1
        for x in set(lines):
            n[s, x] = n.get((s, x), 0) + 1
    found = {(i, k) for i, (s, lines) in of.items() if s for k, x in enumerate(lines) if x and n[s, x] >= least and n[s, x] >= share * sizes[s]}
    texts = {i: None if p[2] is None else "\n".join(x for k, x in enumerate(p[2].split("\n")) if (i, k) not in found) for i, p in cur.items()}
    return found, texts


def some_pages(seed=5):
    rnd = random.Random(seed)
    lines = ["Share  this\tPAGE", "share this page\r", "Seen 12 times", "seen 7 TIMES", "", "  ", "one", "two", "three", "四 行", "© 2019"]
    out = []
    for i in range(260):
        host = "http://WWW.Big.test:80/" if rnd.random() < 0.4 else rnd.choice(["https://small.test/", "http://u@mid.test?x", None, "", "nohost"])
        text = None if rnd.random() < 0.05 else "\n".join(rnd.choice(lines) if rnd.random() < 0.6 else f"line {rnd.choice('abcdefgh')}{rnd.choice('klmnop')}" for _ in range(rnd.randrange(0, 9)))
        out.append((i if rnd.random() > 0.02 else None, host and host + str(i) if host and host.endswith("/") else host, text, day(rnd.choice([1, 2, None])), "s", 1, 2, None, None))
    return out + [(*p[:2], "Share this page", day(3), *p[4:]) for p in out[:30]] + out[40:60]


@pytest.mark.parametrize("least,share", [(6, 0.03), (2, 0.2)])
def test_site_lines_brute_force(spark, least, share):
    pages = some_pages()
    df = spark.createDataFrame(pages, PAGES).repartition(6)
    found, texts = brute_lines(pages, least, share)
    assert {(r["page_id"], r["line_no"]) for r in site_lines.repeated_lines(df, least, share).collect()} == found
    assert {r["page_id"]: r["text"] for r in site_lines.without_repeated(df, least, share).collect()} == texts


def test_site_lines_empty_and_long(spark):
    assert site_lines.without_repeated(spark.createDataFrame([], PAGES)).count() == 0
    long = "\n".join(["same line"] * 20_000 + ["x" * 300_000])
    pages = [(i, "http://a.test/", long, day(1), None, None, None, None, None) for i in range(6)]
    assert site_lines.repeated_lines(spark.createDataFrame(pages, PAGES)).count() == 6 * 20_001
