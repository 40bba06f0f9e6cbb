"""Packing and mixing: round trips, limits, and what is reached."""

import collections
import math
import os
import random

import numpy as np
import pytest

from quern.llm import mixing, packing, tokens

pytestmark = pytest.mark.skipif(not os.path.isdir(tokens.FOLDER), reason="no tokenizers")
DOCS = "doc_id bigint, text string, source string, tokens string, shard int, kind string"
KINDS = "kind string, capacity_tokens int, doc_id int"


def documents(spark, seed=1, n=400):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else rnd.choice(["a", "b", "rare", None]) if i % 50 else "tiny"
        text = rnd.choice([None, ""]) if rnd.random() < 0.05 else "word " * rnd.randrange(1, 120)
        rows.append((i, text, source, "x", 1, "y"))
    rows += [(1000, "many words here " * 3000, "a", "x", 1, "y"), (None, "no id", "b", "x", 1, "y"), rows[7], rows[7]]
    return spark.createDataFrame(rows, DOCS).repartition(3), rows


def count(text):
    return len(tokens.encoding(f"{tokens.FOLDER}/{tokens.VOCABULARY}").encode_ordinary(text)) if text else 0


def test_token_counts_round_trip():
    e = tokens.encoding(f"{tokens.FOLDER}/{tokens.VOCABULARY}")
    for text in ("Hello world's end", "你好 世界\n\n  x", "a" * 5000, "<|endoftext|>", "\x00�"):
        assert e.decode(e.encode_ordinary(text)) == text


@pytest.mark.parametrize("shard", [10_000, 60])
def test_containers_hold_everything_once(spark, shard):
    df, rows = documents(spark)
    kinds = spark.createDataFrame([("small", 64, 1), ("large", 500, 1), ("large", 500, 2), ("none", 0, 1), (None, 10, 1), ("null", None, 1)], KINDS)
    got = packing.containers(df, kinds, shard=shard).collect()
    for kind, capacity in (("small", 64), ("large", 500)):
        mine = [r for r in got if r["kind"] == kind]
        inside, pieces = collections.Counter(), collections.defaultdict(list)
        for r in mine:
            assert (r["container_id"] is None) == (r["tokens"] == 0)
            if r["container_id"] is not None:
                inside[r["container_id"]] += r["tokens"]
            pieces[r["doc_id"]].append((r["piece_no"], r["tokens"]))
        assert max(inside.values()) <= capacity
        want = collections.Counter()
        for r in rows:
            want[r[0]] += count(r[1])
        assert {i: sum(t for _, t in p) for i, p in pieces.items()} == dict(want)
        for r in rows:
            if rows.count(r) == 1:
                own = sorted(pieces[r[0]])
                assert len(own) == max(1, math.ceil(count(r[1]) / capacity))
                assert all(t == capacity for _, t in own[:-1])
        if shard > 1000:
            assert sum(inside.values()) / (capacity * len(inside)) > 0.97
    assert {r["kind"] for r in got} == {"small", "large"}


def brute_pack(sizes, capacity):
    """The rule as it is said: try every open gap and a new container, take the least sum of squares, then the least gap."""
    gaps, placed = [], []
    for s in sizes:
        def cost(g):
            c = collections.Counter(x for x in gaps if 0 < x < capacity)
            if g < capacity:
                c[g] -= 1
            if g - s > 0:
                c[g - s] += 1
            return sum(v * v for v in c.values())
        choices = sorted({g for g in gaps if s <= g < capacity} | {capacity}, key=lambda g: (cost(g), g))
        g = choices[0]
        if g == capacity:
            gaps.append(capacity - s)
            placed.append(len(gaps) - 1)
        else:
            k = max((k for k in range(len(gaps)) if gaps[k] == g), key=lambda k: max((i for i, b in enumerate(placed) if b == k)))
            gaps[k] -= s
            placed.append(k)
    return placed


@pytest.mark.parametrize("seed", range(6))
def test_sum_of_squares_brute_force(seed):
    rnd = random.Random(seed)
    sizes = [rnd.randrange(1, 21) for _ in range(120)]
    if seed % 2:
        sizes.sort(reverse=True)
    assert packing.pack(np.array(sizes), 20).tolist() == brute_pack(sizes, 20)


def test_packing_empty(spark):
    kinds = spark.createDataFrame([("k", 10, 1)], KINDS)
    df, _ = documents(spark)
    assert packing.containers(df.limit(0), kinds).count() == 0
    assert packing.containers(df, kinds.limit(0)).count() == 0
    assert packing.fill(packing.containers(df, kinds), kinds).first()["fill"] > 0.9


PLAN = "plan_id string, source string, target_share double, max_repeats int, tokens int, size int"


def test_mixing_reaches_targets(spark):
    df, rows = documents(spark, 2, 3000)
    plan = spark.createDataFrame([
        ("p", "hot", 0.3, 1, 0, 0), ("p", "a", 0.4, 3, 0, 0), ("p", "tiny", 0.2, 2, 0, 0), ("p", "absent", 0.1, 5, 0, 0),
        ("q", "b", 1.0, None, 0, 0), ("p", "hot", 0.3, 1, 0, 0), (None, "a", 1.0, 1, 0, 0), ("q", None, 0.5, 1, 0, 0), ("q", "rare", None, 1, 0, 0),
    ], PLAN)
    docs = mixing.sized(df)
    size, total = collections.Counter(), 0
    for r in rows:
        total += count(r[1])
        size[r[2]] += count(r[1])
    got = mixing.selection(docs, plan).collect()
    reached, most = collections.Counter(), collections.Counter()
    for r in got:
        reached[r["plan_id"], r["source"]] += r["tokens"] * r["times"]
        most[r["plan_id"], r["source"]] = max(most[r["plan_id"], r["source"]], r["times"])
    longest = max(count(r[1]) for r in rows)
    assert abs(reached["p", "hot"] - 0.3 * total) <= 120 and most["p", "hot"] == 1
    assert abs(reached["p", "a"] - min(0.4 * total, 3 * size["a"])) <= longest and most["p", "a"] <= 3
    assert reached["p", "tiny"] == 2 * size["tiny"] and most["p", "tiny"] == 2
    assert reached["q", "b"] == size["b"] and most["q", "b"] == 1
    assert ("p", "absent") not in reached and {r["plan_id"] for r in got} == {"p", "q"}
    report = {(r["plan_id"], r["source"]): r for r in mixing.shares(docs, plan).collect()}
    assert report["p", "absent"]["tokens"] == 0 and report["p", "hot"]["tokens"] == reached["p", "hot"]
    assert sum(r["share"] for k, r in report.items() if k[0] == "p") == pytest.approx(1, abs=1e-5)
    again = mixing.selection(docs.repartition(7), plan).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_held_shares(spark):
    df, rows = documents(spark, 2, 3000)
    plan = spark.createDataFrame([("p", "hot", 0.3, 1, 0, 0), ("p", "a", 0.5, 3, 0, 0), ("p", "tiny", 0.1, 2, 0, 0), ("p", "absent", 0.1, 5, 0, 0)], PLAN)
    docs = mixing.sized(df)
    got = {r["source"]: r for r in mixing.shares(docs, plan, hold="shares").collect()}
    tokens = sum(r["tokens"] for r in got.values())
    assert 0 < tokens and got["absent"]["tokens"] == 0
    for s, target in (("hot", 0.3), ("a", 0.5), ("tiny", 0.1)):
        assert abs(got[s]["tokens"] - target / 0.9 * tokens) <= max(0.02 * tokens, 130)
        assert got[s]["most_repeats"] <= {"hot": 1, "a": 3, "tiny": 2}[s]
    with pytest.raises(ValueError):
        mixing.budgets(docs, plan, "else")


def test_faults_are_counted(spark):
    kinds = spark.createDataFrame([("k", 10, 1)], KINDS)
    docs = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "doc_id bigint, text string")
    packed = spark.createDataFrame([("k", 1, 1, 0, 8), ("k", 1, 2, 0, 3), ("k", 2, 2, 1, 1)], packing.SCHEMA)
    assert tuple(packing.faults(packed, docs, kinds).first()) == ("k", 2, 1, 1, 1)


def test_mixing_empty(spark):
    df, _ = documents(spark)
    plan = spark.createDataFrame([("p", "hot", 0.3, 1, 0, 0)], PLAN)
    assert mixing.selection(mixing.sized(df.limit(0)), plan).count() == 0
    assert mixing.selection(mixing.sized(df), plan.limit(0)).count() == 0
    assert [r["tokens"] for r in mixing.shares(mixing.sized(df.limit(0)), plan).collect()] == [0]


def test_tempering():
    sizes = {"a": 1000, "b": 100, "c": 10, "none": 0}
    x, w = mixing.tempered(sizes, max_repeats=3)
    whole = 1110
    assert max(w[s] * whole / sizes[s] for s in w) == pytest.approx(3, abs=1e-6) and 0 < x < 1 and sum(w.values()) == pytest.approx(1)
    x, w = mixing.tempered(sizes, entropy=0.8)
    assert -sum(v * math.log(v) for v in w.values()) == pytest.approx(0.8, abs=1e-6)
    assert mixing.tempered(sizes, max_repeats=1000)[0] == pytest.approx(0)
    assert mixing.tempered(sizes, max_repeats=0.5)[0] == pytest.approx(1)
    assert mixing.tempered(sizes, entropy=9)[0] == pytest.approx(0)
    assert mixing.tempered({}, entropy=1) == (1.0, {})
