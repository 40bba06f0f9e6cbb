"""Near-duplicate texts with small edits (problem 7).

Each text becomes the set of its hashed runs of WORDS consecutive words. A signature of SYMBOLS minimum hashes, SYMBOL_BITS bits
each, agrees in a symbol about as often as the Jaccard similarity of two sets says, so similar texts are close in Hamming distance
over symbols. The join on signatures is multi-index: the signature is split into CHUNKS chunks of four symbols, and each chunk
is indexed once for every way to leave ERRORS = 1 symbol out. By the pigeonhole principle two signatures with fewer than
CHUNKS * (ERRORS + 1) differing symbols (GUARANTEED) meet under at least one key; pairs beyond that distance meet under a key with the
probabilities given in the README (0.996 at a similarity of 0.42, 0.999 at 0.46). Pairs that meet are first compared by a sketch
of two bits per symbol that travels with the keys, those that remain by signatures of eight bits per symbol, and the few left by
their whole sets: every pair that comes out is similar, while of the similar pairs near the threshold a few never meet or are lost by
a filter (at 0.42: 0.43 % never meet, the sketch loses 0.03 %, the signature 0.03 %).

Texts with equal sets are one class from the start and only a class's representative is indexed; what comes out has every text of
it, of copies letter for letter the first page alone. The key join is a sort-merge join that AQE splits where a key or partition is hot; no group is gathered into one row or task.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.latest import current_pages
from quern.sources.tables import cut

WORDS, SIMILARITY = 4, 0.42
CHUNKS, CHUNK, SYMBOL_BITS = 24, 4, 32
SYMBOLS = CHUNKS * CHUNK
#: Of the two-bit symbols of the sketch, as many may differ; a pair of similarity 0.42 differs in 41.8 +- 4.9 of 96.
SKETCH_DISTANCE = 58
#: Of the eight-bit symbols, as many may differ; a pair of similarity 0.42 differs in 55.5 +- 4.8 of 96.
SIGNATURE_DISTANCE = 71
#: Signatures that differ in no more symbols are sure to meet under a key.
GUARANTEED = CHUNKS * 2 - 1
_WORD = re.compile("[一-鿿]|[^\\W_一-鿿]+")
_SET_SCHEMA = "id bigint, shingles array<bigint>, same bigint, copy bigint, keys array<bigint>, sig array<bigint>, s0 bigint, s1 bigint, s2 bigint"


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _constants(n: int, seed: int) -> np.ndarray:
    return _mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_A, _B, _K = _constants(SYMBOLS, 1) | np.uint64(1), _constants(SYMBOLS, 2), _constants(SYMBOLS, 3)


def words(text: str) -> list[str]:
    """Lower-cased runs of letters and digits; each character U+4E00-U+9FFF is a word of its own."""
    return _WORD.findall(text.lower())


def shingle_sets(texts: list[str | None], known: dict[str, int], n: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's runs of n words; empty for texts with fewer words and nulls."""
    import xxhash

    out = []
    for t in texts:
        ws = words(t) if t else []
        if len(ws) < n:
            out.append(np.empty(0, dtype=np.uint64))
            continue
        ids = np.empty(len(ws), dtype=np.uint64)
        for i, w in enumerate(ws):
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            ids[i] = h
        mix = np.zeros(len(ws) - n + 1, dtype=np.uint64)
        for k in range(n):
            mix = _mixed(mix * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ws) - n + 1 + k])
        out.append(np.unique(mix))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The SYMBOLS minimum hashes of each set (rows of zeros for empty ones)."""
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), SYMBOLS), dtype=np.uint32)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.concatenate([sets[i] for i in full])
        starts = np.cumsum(sizes[full]) - sizes[full]
        for k in range(SYMBOLS):
            h = ((flat * _A[k] + _B[k]) >> np.uint64(32)).astype(np.uint32)
            out[full, k] = np.minimum.reduceat(h, starts)
    return out


def chunk_keys(signature: np.ndarray) -> np.ndarray:
    """Per signature the CHUNKS * CHUNK keys: chunk by chunk, leaving out each symbol in turn."""
    s = _mixed(signature.astype(np.uint64) + _K)
    by = s.reshape(len(s), CHUNKS, CHUNK)
    rest = by.sum(axis=2, keepdims=True) - by
    return _mixed(rest + _K.reshape(CHUNKS, CHUNK)).reshape(len(s), SYMBOLS).view(np.int64)


def sketches(signature: np.ndarray) -> np.ndarray:
    """Two bits of every symbol in three longs."""
    two = (_mixed(signature.astype(np.uint64) + _B) & np.uint64(3)).reshape(len(signature), 3, 32)
    shifts = (np.arange(32, dtype=np.uint64) * np.uint64(2)).reshape(1, 1, 32)
    return np.bitwise_or.reduce(two << shifts, axis=2).view(np.int64)


def packed(signature: np.ndarray) -> np.ndarray:
    """Eight bits of every symbol in SYMBOLS / 8 longs."""
    eight = (_mixed(signature.astype(np.uint64) + _A) & np.uint64(255)).reshape(len(signature), SYMBOLS // 8, 8)
    shifts = (np.arange(8, dtype=np.uint64) * np.uint64(8)).reshape(1, 1, 8)
    return np.bitwise_or.reduce(eight << shifts, axis=2).view(np.int64)


def _described(batches):
    import xxhash

    known: dict[str, int] = {}
    for pdf in batches:
        if len(known) > 2_000_000:
            known.clear()
        for at in range(0, len(pdf), 512):
            part = pdf.iloc[at : at + 512]
            sets = shingle_sets([t if isinstance(t, str) else None for t in part["text"]], known)
            keep = [i for i, s in enumerate(sets) if len(s)]
            if not keep:
                continue
            sets = [sets[i] for i in keep]
            sig = signatures(sets)
            sketch = sketches(sig)
            same = [int(np.bitwise_xor.reduce(_mixed(s))) ^ len(s) for s in sets]
            copy = [xxhash.xxh64_intdigest(part["text"].iloc[i].encode("utf-8", "surrogatepass")) for i in keep]
            yield pd.DataFrame({
                "id": part["id"].to_numpy()[keep], "shingles": [s.view(np.int64) for s in sets],
                "same": np.array(same, dtype=np.uint64).view(np.int64), "copy": np.array(copy, dtype=np.uint64).view(np.int64),
                "keys": list(chunk_keys(sig)), "sig": list(packed(sig)), "s0": sketch[:, 0], "s1": sketch[:, 1], "s2": sketch[:, 2],
            })


def described(texts: DataFrame) -> DataFrame:
    """(id, shingles, same, copy, keys, sig, s0, s1, s2) of (id, text), for texts with at least WORDS words; written once."""
    return cut(texts.mapInPandas(_described, _SET_SCHEMA))


def classes(sets: DataFrame) -> DataFrame:
    """(id, rep, n, first, copies): texts whose sets of runs are equal have one representative, the smallest id, and n is how many
    they are; first and copies are the same of those that are equal letter for letter."""
    rep = sets.groupBy("same").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = sets.groupBy("same", "copy").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    rows = sets.select("id", "same", "copy").join(rep, "same", "left").join(first, ["same", "copy"], "left")
    one = F.lit(1).cast("bigint")
    return rows.select("id", F.coalesce("rep", "id").alias("rep"), F.coalesce("n", one).alias("n"), F.coalesce("first", "id").alias("first"), F.coalesce("copies", one).alias("copies"))


def _differing(a: str, b: str) -> Column:
    """How many two-bit symbols of the sketches differ."""
    odd = F.lit(0x5555555555555555)
    total = F.lit(0)
    for k in range(3):
        x = F.col(f"{a}.s{k}").bitwiseXOR(F.col(f"{b}.s{k}"))
        total = total + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(odd))
    return total


def _differing_symbols(a: str, b: str) -> Column:
    """How many eight-bit symbols of the signatures differ."""
    total = F.lit(0)
    for k in range(SYMBOLS // 8):
        x = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        for shift in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return total


def similar_representatives(sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b, jaccard), a < b: representatives whose sets have at least the similarity."""
    reps = sets.join(sets.groupBy("same").agg(F.min("id").alias("id")).select("id"), "id", "left_semi")
    keys = reps.select("id", F.explode("keys").alias("key"), "s0", "s1", "s2")
    a, b = keys.alias("a"), keys.alias("b")
    near = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & (_differing("a", "b") <= SKETCH_DISTANCE))
    pairs = near.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    signed = sets.select("id", "sig")
    pairs = pairs.join(signed.select(F.col("id").alias("a"), F.col("sig").alias("x")), "a").join(signed.select(F.col("id").alias("b"), F.col("sig").alias("y")), "b")
    pairs = cut(pairs.filter(_differing_symbols("x", "y") <= SIGNATURE_DISTANCE).select("a", "b"))
    needed = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    whole = sets.select("id", "shingles").join(needed, "id", "left_semi")
    pairs = pairs.join(whole.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(whole.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    pairs = pairs.withColumn("jaccard", common / (F.size("x") + F.size("y") - common))
    return pairs.filter(F.col("jaccard") >= similarity).select("a", "b", "jaccard")


def similar_pages(pages: DataFrame, similarity: float = SIMILARITY, expand_copies: bool = False) -> DataFrame:
    """(page_id_a, page_id_b), a < b: the pairs of different texts of current pages with at least the similarity, and every copy of
    a text, letter for letter, with the first page that has it, the smallest.

    Pages with null raw_text or fewer than WORDS words have no runs and no pair; older fetches and copies of a row are left
    out; very long texts are taken whole; an empty table gives no rows; further columns don't matter. The first page of a text
    stands for it in all pairs with other texts, those with equal sets too, however many copies there are, as pairs of copies grow as
    the square of the rows; page_groups has the first of every page (copy_of), from which they follow. With expand_copies they
    are written out.
    """
    sets = described(current_pages(pages, "raw_text").select(F.col("page_id").alias("id"), F.col("raw_text").alias("text")))
    of = cut(classes(sets))
    shown = of if expand_copies else of.filter("id = first")
    reps = similar_representatives(sets, similarity).select("a", "b")
    x, y = shown.select(F.col("id").alias("p"), F.col("rep").alias("a")), shown.select(F.col("id").alias("q"), F.col("rep").alias("b"))
    between = reps.join(x, "a").join(y, "b").select(F.least("p", "q").alias("page_id_a"), F.greatest("p", "q").alias("page_id_b"))
    many = shown.filter("n > 1")
    inside = many.select("rep", F.col("id").alias("page_id_a")).join(many.select("rep", F.col("id").alias("page_id_b")), "rep")
    inside = inside.filter("page_id_a < page_id_b").select("page_id_a", "page_id_b")
    if expand_copies:
        return between.unionByName(inside)
    return between.unionByName(inside).unionByName(of.filter("id > first").select(F.col("first").alias("page_id_a"), F.col("id").alias("page_id_b")))


def linked(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(v, component) of every vertex of the edges (a, b): the smallest vertex it is connected with.

    Alternates large-star and small-star steps on tables in the shared folder until nothing changes; the number of steps is
    logarithmic in the longest path.
    """
    e = cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v").distinct())
    seen = None
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        e = cut(small.filter("u <> v").distinct())
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    roots = e.select(F.col("v").alias("v"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("v"), F.col("v").alias("component")).union(roots)


def page_groups(pages: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(page_id, group_id, links, copy_of): every current page with text, the smallest page_id of its group, the number of different
    texts it is directly linked with, and the smallest page_id with the very same text. Pages without a run of WORDS words are groups
    of their own, and copies of none."""
    all_ids = current_pages(pages, "raw_text").select(F.col("page_id").alias("id"), F.col("raw_text").alias("text"))
    sets = described(all_ids)
    of = cut(classes(sets))
    edges = cut(similar_representatives(sets, similarity).select("a", "b"))
    groups = linked(edges)
    texts = of.filter("id = first").groupBy("rep").agg(F.count(F.lit(1)).alias("texts"))
    ends = edges.select(F.col("a").alias("near"), F.col("b").alias("rep")).union(edges.select(F.col("b").alias("near"), F.col("a").alias("rep")))
    links = ends.join(texts, "rep").groupBy("near").agg(F.sum("texts").alias("links")).withColumnRenamed("near", "rep")
    rows = all_ids.filter("text is not null").select("id").join(of, "id", "left").withColumn("rep", F.coalesce("rep", "id"))
    rows = rows.join(groups.withColumnRenamed("v", "rep"), "rep", "left").join(links, "rep", "left").join(texts, "rep", "left")
    others = F.coalesce("links", F.lit(0)) + F.coalesce(F.col("texts") - 1, F.lit(0))
    return rows.select(F.col("id").alias("page_id"), F.coalesce("component", "rep").alias("group_id"), others.alias("links"), F.coalesce("first", "id").alias("copy_of"))
