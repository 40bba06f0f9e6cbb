"""Mixing sources to target weights (problem 9).

Weights are given by a plan, or come from tempering: each source's share of the tokens is raised to an exponent that is
bisected until the weights have a target entropy, or until no source is used more often than a limit. The weights are then
realised as budgeted block permutations: a source's documents stand in an order given by a seeded hash, in blocks by the
hash's leading bits; a budget is met by whole passes over the source and a prefix of the permutation. Documents longer than LONG
tokens have a permutation of their own and get their part of the budget first; the others fill what is left, so that a long
document at the end of a prefix doesn't spoil it. Only block sums are added up across a source (at most 2^BLOCK_BITS rows
each); documents are ordered within their block, so a source with a third of all rows is spread over thousands of blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.tokens import FOLDER, VOCABULARY, token_count
from quern.sources.tables import cut, spread

BLOCK_BITS = 12
#: Documents of more tokens than this are long, if nothing else is said.
LONG = 1024
#: More sources than this are refused by tempering, as the driver holds one number for each.
MAX_SOURCES = 1_000_000


def sized(documents: DataFrame, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens), written once, as tokenizing is the dear part."""
    return cut(spread(documents.select("doc_id", "source", "text")).select("doc_id", "source", token_count(F.col("text"), folder, vocabulary).alias("tokens")))


def source_sizes(docs: DataFrame, long: int = LONG) -> DataFrame:
    """(source, size, long_size): the tokens of each source's documents, and of its long ones."""
    return docs.filter("source is not null").groupBy("source").agg(F.sum("tokens").alias("size"), F.sum(F.when(F.col("tokens") > long, F.col("tokens")).otherwise(0)).alias("long_size"))


def budgets(docs: DataFrame, plan: DataFrame, hold: str = "size", long: int = LONG) -> DataFrame:
    """(plan_id, source, target_share, max_repeats, budget, size, passes, rest, long_rest) per row of the plan.

    budget is target_share of the size aimed at: with hold `size` all documents' tokens, of which a source that has too few gives
    all it may, so that the others have more than their shares of what is selected; with hold `shares` as much less as it takes
    for every source that has documents to reach its budget, so that their shares of what is selected hold. passes are the whole passes over the source and rest the tokens still
    to take then, both within max_repeats; long_rest is the long documents' part of it. A source without documents has size 0 and gets nothing; rows with null plan_id,
    source or share are left out, a null max_repeats is 1, repeated (plan, source) rows are one.
    """
    total = docs.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).scalar()
    p = plan.filter("plan_id is not null and source is not null and target_share is not null")
    p = p.groupBy("plan_id", "source").agg(F.max("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    p = p.join(source_sizes(docs, long), "source", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    p = p.withColumn("budget", F.col("target_share") * total)
    if hold == "shares":
        enough = F.when((F.col("size") > 0) & (F.col("budget") > 0), F.col("max_repeats") * F.col("size") / F.col("budget"))
        scale = p.groupBy("plan_id").agg(F.least(F.min(enough), F.lit(1.0)).alias("scale"))
        p = p.join(scale, "plan_id").withColumn("budget", F.col("budget") * F.coalesce("scale", F.lit(1.0))).drop("scale")
    elif hold != "size":
        raise ValueError("hold is `size` or `shares`")
    p = p.withColumn("passes", F.when(F.col("size") > 0, F.least(F.floor(F.col("budget") / F.col("size")), F.col("max_repeats"))).otherwise(0).cast("int"))
    rest = F.when((F.col("size") > 0) & (F.col("passes") < F.col("max_repeats")), F.col("budget") - F.col("passes") * F.col("size"))
    p = p.withColumn("rest", F.coalesce(rest, F.lit(0.0)))
    return p.withColumn("long_rest", F.when(F.col("size") > 0, F.col("rest") * F.col("long_size") / F.col("size")).otherwise(0.0)).drop("long_size")


def permuted(docs: DataFrame, seed: int = 7, bits: int = BLOCK_BITS, long: int = LONG) -> DataFrame:
    """(doc_id, source, tokens, long, upto): each document's place in the permutation of its source's long documents, or of the
    others, as the tokens up to and with it."""
    h = F.xxhash64(F.lit(seed), "doc_id")
    kind = ["source", "long"]
    rows = docs.filter("source is not null").select("doc_id", "source", (F.col("tokens") > long).alias("long"), "tokens", h.alias("h"), F.shiftrightunsigned(h, 64 - bits).alias("block"))
    sums = rows.groupBy(*kind, "block").agg(F.sum("tokens").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy(*kind).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = Window.partitionBy(*kind, "block").orderBy("h", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("inside", F.sum("tokens").over(inside))
    rows = rows.join(sums.select(*kind, "block", before.alias("before")), [*kind, "block"])
    return rows.select("doc_id", *kind, "tokens", (F.col("before") + F.col("inside")).alias("upto"))


def selection(docs: DataFrame, plan: DataFrame, seed: int = 7, hold: str = "size", long: int = LONG) -> DataFrame:
    """(plan_id, source, doc_id, tokens, times): how often each document is used by each plan, if at all.

    A prefix ends at the document whose middle passes its part of the rest, so a source misses its target by half a document of
    `long` tokens at most, unless max_repeats holds it down or it has few documents that aren't long. Documents without source belong to none but count in the size aimed at; empty texts
    have no tokens and come along; an empty table gives no rows; further columns don't matter.
    """
    goals, order = budgets(docs, plan, hold, long), permuted(docs, seed, long=long)

    def within(rest: str) -> Column:
        return (F.col(rest) > 0) & (F.col("upto") - F.col("tokens") / 2 <= F.col(rest))

    taken = order.filter("long").join(goals, "source").filter(within("long_rest")).groupBy("plan_id", "source").agg(F.sum("tokens").alias("taken"))
    goals = goals.join(taken, ["plan_id", "source"], "left").withColumn("short_rest", F.col("rest") - F.coalesce("taken", F.lit(0)))
    rows = order.join(goals, "source")
    extra = F.when(F.when(F.col("long"), within("long_rest")).otherwise(within("short_rest")), 1).otherwise(0)
    rows = rows.withColumn("times", (F.col("passes") + extra).cast("int")).filter("times > 0")
    return rows.select("plan_id", "source", "doc_id", "tokens", "times")


def shares(docs: DataFrame, plan: DataFrame, seed: int = 7, hold: str = "size", long: int = LONG) -> DataFrame:
    """(plan_id, source, target_share, aimed_tokens, tokens, share, share_of_aim, most_repeats): what a plan really reaches.

    share is of the plan's selected tokens, share_of_aim of the size aimed at.
    """
    got = selection(docs, plan, seed, hold, long).groupBy("plan_id", "source").agg(F.sum(F.col("tokens") * F.col("times")).alias("tokens"), F.max("times").alias("most_repeats"))
    rows = budgets(docs, plan, hold, long).join(got, ["plan_id", "source"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    whole = F.sum("tokens").over(Window.partitionBy("plan_id"))
    return rows.select(
        "plan_id", "source", "target_share", F.round("budget").cast("bigint").alias("aimed_tokens"), "tokens",
        F.round(F.when(whole > 0, F.col("tokens") / whole), 6).alias("share"),
        F.round(F.when(F.col("budget") > 0, F.col("tokens") / F.col("budget") * F.col("target_share")), 6).alias("share_of_aim"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
    )


def _weights(sizes: dict[str, float], exponent: float) -> dict[str, float]:
    logs = {s: exponent * math.log(t) for s, t in sizes.items()}
    top = max(logs.values())
    raw = {s: math.exp(x - top) for s, x in logs.items()}
    whole = math.fsum(raw.values())
    return {s: x / whole for s, x in raw.items()}


def tempered(sizes: dict[str, float], entropy: float | None = None, max_repeats: float | None = None) -> tuple[float, dict[str, float]]:
    """The exponent in 0 .. 1 and its weights: the largest with at least `entropy` (in nats), or the smallest by which no source
    is used more than max_repeats times when as much is drawn as there is. At 1 the weights are the sources' own shares, at 0
    they are equal; a limit that neither end meets gives the nearer end. Sources without tokens get no weight.
    """
    sizes = {s: float(t) for s, t in sizes.items() if t and t > 0}
    if not sizes:
        return 1.0, {}
    whole = math.fsum(sizes.values())

    def flat_enough(x: float) -> bool:
        w = _weights(sizes, x)
        if entropy is not None:
            return -math.fsum(v * math.log(v) for v in w.values() if v > 0) >= entropy
        return max(w[s] * whole / sizes[s] for s in w) > max_repeats

    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if flat_enough(mid) else (lo, mid)
    exponent = lo if entropy is not None else hi
    return exponent, _weights(sizes, exponent)


def tempered_plan(docs: DataFrame, plan_id: str, entropy: float | None = None, max_repeats: int = 4) -> DataFrame:
    """A plan as in mix_plan whose shares are tempered to an entropy, or to the repetition limit where none is given."""
    rows = source_sizes(docs).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    _, w = tempered({r["source"]: r["size"] for r in rows}, entropy, max_repeats)
    schema = "plan_id string, source string, target_share double, max_repeats int"
    return docs.sparkSession.createDataFrame([(plan_id, s, x, max_repeats) for s, x in sorted(w.items())], schema)
