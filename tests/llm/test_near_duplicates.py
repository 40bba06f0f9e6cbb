"""Near-duplicates against all pairs, on texts with copies, edits, blocks moved, and nothing in common."""

import random
from datetime import datetime

import numpy as np
import pytest

from quern.llm import near_duplicates as nd

PAGES = "page_id bigint, raw_text string, fetched_at timestamp, id int, rep int, keys string"


def shingles(text):
    w = nd.words(text or "")
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 0.0


def corpus(seed=3, families=30):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(2000)] + list("中文字样多少")
    out = []
    for _ in range(families):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randrange(60, 260))]
        for k in range(rnd.randrange(1, 5)):
            t = list(base)
            for _ in range(int(len(t) * rnd.choice([0, 0.02, 0.05, 0.08]))):
                i = rnd.randrange(len(t))
                t[i : i + 1] = rnd.choice([[], [rnd.choice(vocabulary)], [t[i], rnd.choice(vocabulary)]])
            if k == 2:
                t = t[len(t) // 2 :] + t[: len(t) // 2]
            out.append(" ".join(t).upper() if k == 1 else "\n".join([" ".join(t[:20]), ", ".join(t[20:])]))
    out += [None, "", "one two three", "one two three four", "ONE, two three\nfour", "one two three four five"]
    return out


def frame(spark, texts):
    old = [(i, "an older fetch with other words in it", datetime(2023, 1, 1), 1, 2, "x") for i in range(0, len(texts), 7)]
    rows = [(i, t, datetime(2024, 1, 1), 1, 2, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + old + rows[:5] + [(None, "a b c d e f", None, 1, 2, "x")], PAGES).repartition(4)


def wanted(texts, threshold=nd.SIMILARITY):
    sets = [shingles(t) for t in texts]
    return {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if sets[i] and sets[j] and jaccard(sets[i], sets[j]) >= threshold}


def test_pairs_and_groups_brute_force(spark):
    texts = corpus()
    want = wanted(texts)
    got = {(r["page_id_a"], r["page_id_b"]) for r in nd.similar_pages(frame(spark, texts)).collect()}
    assert got <= want and len(got) >= 0.98 * len(want)
    clear = wanted(texts, 0.5)
    assert clear <= got
    group = {r["page_id"]: r["group_id"] for r in nd.page_groups(frame(spark, texts)).collect()}
    assert set(group) == {i for i, t in enumerate(texts) if t is not None}
    root = {i: i for i in group}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in sorted(got):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert group == {i: find(i) for i in group}


def test_copies_letter_for_letter_come_with_the_first(spark):
    base = "the very same words in each of them stand here again"
    texts = [base] * 20 + [base.upper(), base.replace(" ", "\n"), base + "!"] + ["the very same words in each of them stand here today"] * 2
    got = {(r["page_id_a"], r["page_id_b"]) for r in nd.similar_pages(frame(spark, texts)).collect()}
    firsts = [0, 20, 21, 22, 23]
    assert got == {(0, i) for i in range(1, 20)} | {(23, 24)} | {(i, j) for i in firsts for j in firsts if i < j}
    rows = nd.page_groups(frame(spark, texts)).collect()
    copy_of = {r["page_id"]: r["copy_of"] for r in rows}
    assert copy_of == {i: 0 if i < 20 else 23 if i == 24 else i for i in range(25)}
    assert {r["links"] for r in rows} == {4} and {r["group_id"] for r in rows} == {0}
    # what copy_of leaves to be written out is what expand_copies writes
    linked = got | {(b, a) for a, b in got} | {(a, a) for a in firsts}
    shown = {(i, j) for i in range(25) for j in range(i + 1, 25) if (copy_of[i], copy_of[j]) in linked}
    assert shown == wanted(texts)
    assert shown == {(r["page_id_a"], r["page_id_b"]) for r in nd.similar_pages(frame(spark, texts), expand_copies=True).collect()}


def test_empty(spark):
    assert nd.similar_pages(frame(spark, [])).count() == 0
    assert nd.page_groups(frame(spark, ["", None])).count() == 1


def test_keys_meet_within_the_distance():
    rnd = np.random.default_rng(1)
    a = rnd.integers(0, 2**32, (200, nd.SYMBOLS), dtype=np.uint32)
    b = a.copy()
    for row in b:
        at = rnd.choice(nd.SYMBOLS, 2 * nd.CHUNKS - 1, replace=False)
        row[at] = rnd.integers(0, 2**32, len(at), dtype=np.uint32)
    assert all(np.intersect1d(x, y).size for x, y in zip(nd.chunk_keys(a), nd.chunk_keys(b)))
    far = rnd.integers(0, 2**32, (200, nd.SYMBOLS), dtype=np.uint32)
    assert not any(np.intersect1d(x, y).size for x, y in zip(nd.chunk_keys(a), nd.chunk_keys(far)))


@pytest.mark.parametrize("similarity,least", [(0.42, 0.985), (0.5, 0.998)])
def test_measured_recall_of_the_index(similarity, least):
    rnd = np.random.default_rng(5)
    found = 0
    n, size = 1500, 300
    common = round(2 * size * similarity / (1 + similarity))
    sets = []
    for _ in range(n):
        x = rnd.integers(0, 2**63, 2 * size - common, dtype=np.uint64)
        sets += [np.unique(x[:size]), np.unique(x[size - common :])]
    sig = nd.signatures(sets)
    keys, two, eight = nd.chunk_keys(sig), nd.sketches(sig).view(np.uint64), nd.packed(sig).view(np.uint8)
    for i in range(0, 2 * n, 2):
        x = two[i] ^ two[i + 1]
        differ = sum(int(v).bit_count() for v in (x | x >> np.uint64(1)) & np.uint64(0x5555555555555555))
        found += bool(np.intersect1d(keys[i], keys[i + 1]).size) and differ <= nd.SKETCH_DISTANCE and (eight[i] != eight[i + 1]).sum() <= nd.SIGNATURE_DISTANCE
    assert found / n >= least


def test_the_sketch_loses_less_than_one_in_a_thousand():
    rnd = np.random.default_rng(6)
    a = rnd.integers(0, 2**32, (20_000, nd.SYMBOLS), dtype=np.uint32)
    b = np.where(rnd.random(a.shape) < nd.SIMILARITY, a, rnd.integers(0, 2**32, a.shape, dtype=np.uint32)).astype(np.uint32)
    x = (nd.sketches(a) ^ nd.sketches(b)).view(np.uint64)
    differ = np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(axis=1)
    assert (differ > nd.SKETCH_DISTANCE).mean() < 0.001


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 102), (101, 102)]
    got = {r["v"]: r["component"] for r in nd.linked(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


def test_symbol_distance_in_columns(spark):
    rnd = np.random.default_rng(2)
    a = rnd.integers(0, 256, (40, nd.SYMBOLS), dtype=np.uint8)
    b = np.where(rnd.random(a.shape) < 0.5, a, rnd.integers(0, 256, a.shape, dtype=np.uint8)).astype(np.uint8)
    rows = [(x.view(np.int64).tolist(), y.view(np.int64).tolist()) for x, y in zip(a, b)]
    got = spark.createDataFrame(rows, "x array<bigint>, y array<bigint>").coalesce(1).select(nd._differing_symbols("x", "y").alias("n")).collect()
    assert [r["n"] for r in got] == (a != b).sum(axis=1).tolist()
