"""Reading level of each text (problem 10).

A linear ranker is learnt from pairs of graded documents: a pair is a document and one of a lower grade, and the ranker is the
logistic model of the difference of their features. Features are means over the sentences of the whole text: of syntax (length,
length of words, each against what is usual in the sentence's script) and of vocabulary. As few words occur in graded documents,
vocabulary enters as registers: a mixture of word distributions, one for each of easy, plain and demanding writing, that starts
from the sentences of graded documents and is fitted by expectation-maximization on those and all other texts, so that languages
with few graded texts get their words too. Where documents have a lang, each language of enough texts has its own mixture, as one for
all may end with a register that is a language; a text is judged by the language whose words fit it best, whatever its lang says.
Isotonic regression turns scores into levels: of medians, so that grades that are one off don't bend it, and on scores that each
graded document gets from a ranker fitted without it. Between two grades a few graded documents leave the place of the cut open, so it
is set where few grades are on the wrong side and few of all texts lie.

Texts are split into words once and kept as blocks of coded sentences in the shared folder; document counts, the rounds of the
mixture and the scores read those. A word is one of SLOTS slots by hash, so the model and what the driver gets of a round have a
fixed size. The ranker and the levels are fitted on the driver, on at most MAX_GRADED graded texts and MAX_PAIRS of their pairs.
"""

from __future__ import annotations

import copy
import re
import zlib
from itertools import islice
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.sources.tables import cut, spread

#: Bounds of the graded documents and of the pairs that are fitted on, and in how many texts a word must be to count.
MAX_GRADED, MAX_PAIRS, LEAST_TEXTS = 4000, 100_000, 3
DEMANDING = 3.5
#: Grades at which easy, plain and demanding writing is purest.
PURE = np.array([1.0, 2.7, 5.0])
SLOT_BITS, MOST_LETTERS = 18, 63
SLOTS = 1 << SLOT_BITS
_TOKEN = re.compile("[㐀-鿿]|[^\\W\\d_㐀-鿿]+|[.!?;。！？；\n]")
_ENDS = frozenset(".!?;。！？；\n")
#: A sentence of more words than LONG is taken as pieces of PIECE words.
LONG, PIECE = 120, 24
#: Sentences of a block, about, and texts that are split at once.
BLOCK, STEP = 50_000, 256
#: What a sentence of a graded document counts in the registers; others count 1.
GRADED = 3.0
#: The share of all texts a language must have for registers of its own.
LEAST_SHARE = 0.02
#: A cut between grades: steps of the score, width of the smoothing in steps, sentences of a text that count at most, and the
#: grades on the wrong side that weigh as much as e times the texts near the cut.
STEPS, WIDTH, MOST_SENTENCES, EASE = 200, 3.0, 50, 3.0
#: Rounds of the mixture at most, and the change of a register's word distribution (as a sum over words) at which they end.
ROUNDS, SETTLED = 30, 0.02


class _Codes(dict):
    """The code of each token: the word's slot and its number of letters (0 for Chinese characters); -1 for ends of sentences."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        if token in _ENDS:
            code = -1
        else:
            low = token.lower()
            letters = 0 if "㐀" <= token <= "鿿" else min(len(low), MOST_LETTERS)
            code = zlib.crc32(low.encode("utf-8", "surrogatepass")) % SLOTS | letters << SLOT_BITS
        self[token] = code
        return code


class Sentences(NamedTuple):
    """words: codes, sentence after sentence; size: words of each sentence."""

    words: np.ndarray
    size: np.ndarray


def chosen_of(s: Sentences, numbers: np.ndarray, ends: np.ndarray) -> Sentences:
    """The sentences of these numbers; ends: where each sentence ends."""
    size = s.size[numbers]
    return Sentences(s.words[np.arange(size.sum()) + np.repeat(ends[numbers] - np.cumsum(size), size)], size)


def split(texts: list[str | None], codes: _Codes) -> tuple[Sentences, np.ndarray]:
    """The sentences of texts, without empty ones, and how many each text has."""
    tokens, n = [], []
    for t in texts:
        found = _TOKEN.findall(t) if t else []
        tokens += found
        tokens.append("\n")
        n.append(len(found) + 1)
    ids = np.array([codes[t] for t in tokens], dtype=np.int32)
    ends = ids < 0
    words, place = ids[~ends], np.cumsum(ends)[~ends]
    if not len(words):
        return Sentences(words, np.empty(0, dtype=np.int64)), np.zeros(len(texts), dtype=np.int64)
    start = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    size = np.diff(np.r_[start, len(place)])
    if size.max() > LONG:
        inside = np.arange(len(place)) - np.repeat(start, size)
        place = place * 1_000_000_000 + np.where(np.repeat(size, size) > LONG, inside // PIECE, 0)
        start = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        size = np.diff(np.r_[start, len(place)])
    text = np.repeat(np.arange(len(texts)), n)[~ends]
    return Sentences(words, size), np.bincount(text[start], minlength=len(texts))


class Model:
    """known: which slots have a word of enough texts; logp: log probability of each slot by register; log_prior: of the registers;
    shape: means and deviations of (log words, letters a word) by script and register; usual: the same by script; weights: of the
    ranker; at and level: the isotonic steps; rows: scores and grades these are of; cuts: (score, level) that hold besides them; parts:
    models of the languages, whose registers hold instead of this one's."""

    def __init__(self, known: np.ndarray | None = None):
        self.known = np.zeros(SLOTS, dtype=bool) if known is None else known
        self.logp = np.zeros((SLOTS, len(PURE)), dtype=np.float32)
        self.log_prior = np.zeros(len(PURE))
        self.shape = np.zeros((2, len(PURE), 2, 2))
        self.usual = np.zeros((2, 2, 2))
        self.weights, self.at, self.level = np.zeros(5), np.empty(0), np.empty(0)
        self.rows, self.cuts, self.parts = (np.empty(0), np.empty(0)), np.empty((0, 2)), []

    def fits(self, s: Sentences) -> np.ndarray:
        """How well the words of all registers together fit each sentence: log probability, against that of a word by chance."""
        slots = s.words & (SLOTS - 1)
        at = np.cumsum(s.size) - s.size
        if not hasattr(self, "_word"):
            word = np.log(np.maximum(np.exp(self.logp + self.log_prior.astype(np.float32)).sum(axis=1), 1e-7))
            self._word = np.where(self.known, word, np.log(1e-7)).astype(np.float32)
        return np.add.reduceat(self._word[slots], at) if len(at) else np.empty(0)

    def syntax(self, s: Sentences) -> tuple[np.ndarray, np.ndarray]:
        """Script (1: Chinese) and (log words, letters a word) of each sentence."""
        letters = np.add.reduceat(s.words >> SLOT_BITS, np.cumsum(s.size) - s.size)
        return (letters < s.size).astype(int), np.stack([np.log(s.size), letters / s.size], axis=1)

    def registers(self, s: Sentences, log_prior=None) -> np.ndarray:
        """The probability of each register for each sentence."""
        slots = s.words & (SLOTS - 1)
        keep = self.known[slots]
        place = np.repeat(np.arange(len(s.size)), s.size)[keep]
        log = np.zeros((len(s.size), len(PURE)))
        if len(place):
            first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            log[place[first]] = np.add.reduceat(self.logp[slots[keep]], first, axis=0)
        log /= np.maximum(1.0, s.size / 12)[:, None]
        script, x = self.syntax(s)
        mean, dev = self.shape[script][..., 0], self.shape[script][..., 1]
        log += -0.5 * (((x[:, None, :] - mean) / dev) ** 2).sum(2) - np.log(dev).sum(2)
        log += self.log_prior if log_prior is None else log_prior
        p = np.exp(log - log.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def features(self, s: Sentences, numbers: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of each text the means over its sentences of at least two words: registers, log words, letters a word; NaN without any.
        numbers: the sentences of all texts, text after text; n: how many each has."""
        out = np.full((len(n), len(PURE) + 2), np.nan)
        if self.parts and len(numbers):
            of = np.repeat(np.arange(len(n)), n)
            best = np.argmax([np.bincount(of, part.fits(s)[numbers], len(n)) for part in self.parts], axis=0)
            for k in np.unique(best[n > 0]):
                mine = np.flatnonzero((best == k) & (n > 0))
                some, own = np.unique(numbers[best[of] == k], return_inverse=True)
                out[mine] = self.parts[k].features(chosen_of(s, some, np.cumsum(s.size)), own, n[mine])
        elif len(s.size):
            script, x = self.syntax(s)
            x = 0.2 * (x - self.usual[script][..., 0]) / self.usual[script][..., 1]
            each = np.concatenate([self.registers(s), x], axis=1)
            many = s.size[numbers] >= 2
            of, numbers = np.repeat(np.arange(len(n)), n)[many], numbers[many]
            count = np.bincount(of, minlength=len(n))
            some = count > 0
            for k in range(out.shape[1]):
                out[some, k] = (np.bincount(of, each[numbers, k], len(n)) / np.maximum(count, 1))[some]
        return out

    def grade(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores, levels): NaN for texts without a sentence, and where nothing was graded."""
        if not len(self.at):
            return np.full(len(features), np.nan), np.full(len(features), np.nan)
        score, at, level = features @ self.weights, self.at, self.level
        for cut_at, half in self.cuts:
            at = np.where(level < half, np.minimum(at, cut_at), np.where(level > half, np.maximum(at, cut_at), cut_at))
            k = np.searchsorted(level, half)
            at, level = np.insert(at, k, cut_at), np.insert(level, k, half)
        return score, np.where(np.isnan(score), np.nan, np.interp(score, at, level))

    def settle(self, texts: np.ndarray, edges: np.ndarray) -> None:
        """The cut of each two neighbouring grades, between the middle scores of both, given how much text lies between the edges."""
        score, y = self.rows
        near = np.exp(-0.5 * (np.arange(-len(texts), len(texts) + 1) / WIDTH) ** 2)
        dense = np.convolve(texts / max(texts.mean(), 1e-9), near / near.sum())[len(texts) : 2 * len(texts)]
        place, cuts = (edges[1:] + edges[:-1]) / 2, []
        for half in np.arange(np.floor(y.min()), y.max()) + 0.5 if len(y) else []:
            low, high = y[y < half], y[y > half]
            if len(low) and len(high):
                a, b = np.median(score[y == low.max()]), np.median(score[y == high.min()])
                some = np.flatnonzero((place >= a) & (place <= b))
                if len(some):
                    wrong = (score[y > half] < place[some, None]).sum(axis=1) + (score[y < half] >= place[some, None]).sum(axis=1)
                    cuts.append((place[some[np.argmin(wrong + EASE * np.log(dense[some] + 0.02))]], half))
        self.cuts = np.array([(max(c[0] for c in cuts[: k + 1]), half) for k, (_, half) in enumerate(cuts)]).reshape(-1, 2)


def register_sums(model: Model, s: Sentences, n: np.ndarray | float = 1.0, p: np.ndarray | None = None, log_prior=None) -> np.ndarray:
    """By register: the mass of each slot, then for each script that of its sentences and the sums of (log words, letters a word)
    and of their squares. n: how often each sentence counts; p: their probabilities, where the model's registers don't give them."""
    mass = (model.registers(s, log_prior) if p is None else p) * np.reshape(n, (-1, 1))
    script, x = model.syntax(s)
    x = np.concatenate([np.ones((len(x), 1)), x, x**2], axis=1)
    slots = s.words & (SLOTS - 1)
    place = np.repeat(np.arange(len(s.size)), s.size)
    each = [np.bincount(slots, mass[place, r], SLOTS) for r in range(len(PURE))]
    return np.concatenate([np.stack(each, axis=1) * model.known[:, None]] + [x[script == c].T @ mass[script == c] for c in (0, 1)])


def _moments(x: np.ndarray, least: tuple[float, float]) -> np.ndarray:
    mean = x[1:3] / (x[0] + 1e-9)
    return np.stack([mean, np.maximum(np.sqrt(np.maximum(x[3:] / (x[0] + 1e-9) - mean**2, 0)), least)], axis=1)


def _rounds(model: Model, graded: list[tuple[Sentences, float]], rounds: int, shared: np.ndarray | None):
    """fit_registers as a generator: yields when it needs the register_sums of all other texts, which it is sent; returns the rounds."""
    graded = [(s, g) for s, g in graded if len(s.size)]
    word = None
    if graded:
        every = Sentences(np.concatenate([s.words for s, _ in graded]), np.concatenate([s.size for s, _ in graded]))
        prior = -((np.repeat([g for _, g in graded], [len(s.size) for s, _ in graded])[:, None] - PURE) ** 2)
        first = np.exp(prior) / np.exp(prior).sum(axis=1, keepdims=True)
    for k in range(rounds if graded else 0):
        sums = register_sums(model, every, GRADED, first if k == 0 else None, prior)
        if k:
            sums = sums + (yield)
        mass = (sums[:SLOTS] + 0.2) * model.known[:, None]
        last, word = word, mass / np.maximum(mass.sum(axis=0), 1e-12)
        model.logp = np.where(model.known[:, None], np.log(np.maximum(word, 1e-30)), 0.0).astype(np.float32)
        scripts = sums[SLOTS:].reshape(2, 5, len(PURE))
        for c in (0, 1):
            for r in range(len(PURE)):
                # nothing of this script yet: what holds for both, or what holds for other languages
                both = scripts[:, :, r].sum(0)
                if shared is not None and both[0] < 5:
                    both = shared[c, :, r] if shared[c, 0, r] >= 5 else shared[:, :, r].sum(0)
                model.shape[c, r] = _moments(scripts[c, :, r] if scripts[c, 0, r] >= 5 else both, (0.35, 0.6))
            model.usual[c] = _moments(scripts[c].sum(1), (0.05, 0.05))
        share = scripts[:, 0].sum(0)
        model.log_prior = np.log((share + 1) / (share.sum() + 3))
        if k > 1 and np.abs(word - last).sum(axis=0).max() < SETTLED:
            return k + 1
    return rounds


def fit_registers(model: Model, graded: list[tuple[Sentences, float]], ungraded, rounds: int = ROUNDS) -> int:
    """Expectation-maximization over the sentences of all texts; a grade gives its sentences their prior. ungraded(model): the
    register_sums of all other texts. The number of rounds it took."""
    return fit_languages([model], [graded], lambda models: {0: ungraded(models[0])}, rounds)[0]


def fit_languages(models: list[Model], graded: list[list[tuple[Sentences, float]]], ungraded, rounds: int = ROUNDS) -> list[int]:
    """fit_registers of the models of several languages, side by side; ungraded(models): by number, the register_sums of the models
    that aren't None."""
    shared = None
    if len(models) > 1:
        sums = [x for m, part in zip(models, graded) if (x := _first_shapes(m, part)) is not None]
        shared = sum(sums) if sums else None
    runs, took = [_rounds(m, part, rounds, shared) for m, part in zip(models, graded)], [0] * len(models)
    sent: dict[int, np.ndarray | None] = dict.fromkeys(range(len(models)))
    while sent:
        open_ = []
        for k, x in sent.items():
            try:
                runs[k].send(x)
                open_.append(k)
            except StopIteration as end:
                took[k] = end.value
        got = ungraded([m if k in open_ else None for k, m in enumerate(models)]) if open_ else {}
        sent = {k: got[k] for k in open_}
    return took


def _first_shapes(model: Model, graded: list[tuple[Sentences, float]]) -> np.ndarray | None:
    """What _rounds starts its shapes from."""
    graded = [(s, g) for s, g in graded if len(s.size)]
    if not graded:
        return None
    total = np.zeros((2, 5, len(PURE)))
    for s, g in graded:
        p = np.exp(-((g - PURE) ** 2))
        script, x = model.syntax(s)
        x = np.concatenate([np.ones((len(x), 1)), x, x**2], axis=1)
        total += np.stack([GRADED * x[script == c].sum(axis=0)[:, None] * (p / p.sum()) for c in (0, 1)])
    return total


def fit_pairs(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 500, most: int = MAX_PAIRS) -> np.ndarray:
    """Weights of the logistic model of feature differences over pairs of different grade, each weighing as its difference, by
    gradient descent; of more than `most` pairs a seeded sample."""
    a, b = np.nonzero(y[:, None] > y[None, :])
    if len(a) > most:
        some = np.random.default_rng(7).choice(len(a), most, replace=False)
        a, b = a[some], b[some]
    w = np.zeros(x.shape[1])
    if len(a):
        d, share = x[a] - x[b], (y[a] - y[b]) / (y[a] - y[b]).sum()
        for _ in range(steps):
            w += 5.0 * ((share / (1 + np.exp(np.clip(d @ w, -30, 30)))) @ d - l2 * w)
    return w


def cross_scores(x: np.ndarray, y: np.ndarray, doc: np.ndarray, weights: np.ndarray, folds: int = 5) -> np.ndarray:
    """Scores of the rows by rankers fitted without their document, each brought to the scale of weights by its own rows' scores."""
    score, order = x @ weights, np.random.default_rng(7).permutation(np.unique(doc))
    if len(order) < 2 * folds:
        return score
    fold = dict(zip(order.tolist(), (np.arange(len(order)) % folds).tolist()))
    of = np.array([fold[d] for d in doc.tolist()])
    out = score.copy()
    for k in range(folds):
        rest = of != k
        mine = x @ fit_pairs(x[rest], y[rest])
        if np.ptp(mine[rest]) > 0:
            out[~rest] = np.polyval(np.polyfit(mine[rest], score[rest], 1), mine[~rest])
    return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators by medians, which is isotonic regression by absolute differences; the least and greatest score of
    each pool and its level."""
    pools: list[tuple[float, float, list[float]]] = []
    for s, g in sorted(zip(score.tolist(), y.tolist())):
        pools.append((s, s, [g]))
        while len(pools) > 1 and (pools[-2][1] == pools[-1][0] or np.median(pools[-2][2]) >= np.median(pools[-1][2])):
            _, high, grades = pools.pop()
            pools[-1] = (pools[-1][0], high, pools[-1][2] + grades)
    return np.array([s for p in pools for s in p[:2]]), np.array([float(np.median(p[2])) for p in pools for _ in "ab"])


def ranked(model: Model, graded: list[tuple[Sentences, list[float]]]) -> Model:
    """The model, whose registers are fitted, with its ranker and levels; every grade of a document is a row."""
    f = [model.features(s, np.arange(len(s.size)), np.array([len(s.size)]))[0] for s, _ in graded]
    rows = [(k, x, g) for k, (x, (_, grades)) in enumerate(zip(f, graded)) if not np.isnan(x).any() for g in grades]
    if rows:
        doc, x, y = (np.array(column) for column in zip(*rows))
        model.weights = fit_pairs(x, y)
        model.rows = cross_scores(x, y, doc, model.weights), y
        model.at, model.level = isotonic(*model.rows)
    return model


_CODED = "part int, ids binary, null_id binary, n_chars binary, per_doc binary, numbers binary, words binary, size binary, n binary"


def coded(batches, graded: set, block: int = BLOCK):
    """Blocks of (doc_id, text, part) rows, each of one part: ids and n_chars of the texts (-1 where the text is null), how many
    sentences each has, and their numbers among the block's distinct sentences; of these the words, size, and n: how often texts that
    aren't graded have them."""
    codes, open_ = _Codes(), {}

    def packed(part, rows, seen, n):
        ids, chars, numbers = (list(c) for c in zip(*rows))
        return (
            part, np.array([0 if i is None else i for i in ids], dtype=np.int64).tobytes(), np.array([i is None for i in ids]).tobytes(), np.array(chars, dtype=np.int64).tobytes(),
            np.array([len(x) for x in numbers], dtype=np.int32).tobytes(), np.array([x for each in numbers for x in each], dtype=np.int32).tobytes(),
            b"".join(seen), np.array([len(x) // 4 for x in seen], dtype=np.int32).tobytes(), np.array(n, dtype=np.int32).tobytes(),
        )

    def blocks():
        return pd.DataFrame([packed(k, *open_[k]) for k in sorted(open_)], columns=[c.split()[0] for c in _CODED.split(", ")])

    for pdf in batches:
        docs = [None if pd.isna(doc) else int(doc) for doc in pdf["doc_id"].astype(object)]
        texts, parts = [t if isinstance(t, str) else None for t in pdf["text"]], pdf["part"].tolist()
        for first in range(0, len(docs), STEP):
            some = texts[first : first + STEP]
            sentences, per_text = split(some, codes)
            raw, at, ends = sentences.words.tobytes(), 0, iter((4 * np.cumsum(sentences.size)).tolist())
            for doc, text, part, many in zip(docs[first : first + STEP], some, parts[first : first + STEP], per_text.tolist()):
                rows, seen, n = open_.setdefault(part, ([], {}, []))
                counts, numbers = doc not in graded, []
                for end in islice(ends, many):
                    k = seen.setdefault(raw[at:end], len(seen))
                    at = end
                    if k == len(n):
                        n.append(0)
                    n[k] += counts
                    numbers.append(k)
                rows.append((doc, -1 if text is None else len(text), numbers))
            if sum(len(seen) for _, seen, _ in open_.values()) >= block or sum(len(rows) for rows, _, _ in open_.values()) >= block:
                yield blocks()
                open_.clear()
    if open_:
        yield blocks()


def _sentences(words: bytes, size: bytes) -> Sentences:
    return Sentences(np.frombuffer(words, dtype=np.int32), np.frombuffer(size, dtype=np.int32).astype(np.int64))


def known_slots(blocks: DataFrame, parts: int = 1, least: int = LEAST_TEXTS) -> np.ndarray:
    """By part, which slots have words of at least `least` texts; the driver gets at most SLOTS sums a part."""

    def count(batches):
        total = {}
        for pdf in batches:
            for part, words, size, per_doc, numbers in zip(pdf["part"], pdf["words"], pdf["size"], pdf["per_doc"], pdf["numbers"]):
                mine, s, n = total.setdefault(part, np.zeros(SLOTS, dtype=np.int64)), _sentences(words, size), np.frombuffer(per_doc, dtype=np.int32)
                number, ends, at = np.frombuffer(numbers, dtype=np.int32), np.cumsum(s.size), 0
                for k in n.tolist():
                    if k:
                        mine[np.unique(chosen_of(s, number[at : at + k], ends).words & (SLOTS - 1))] += 1
                    at += k
        for part, mine in total.items():
            some = np.flatnonzero(mine)
            yield pd.DataFrame({"part": np.full(len(some), part), "slot": some, "n": mine[some]})

    found = blocks.filter(F.col("part") >= 0).select("part", "words", "size", "per_doc", "numbers").mapInPandas(count, "part int, slot bigint, n bigint")
    rows = found.groupBy("part", "slot").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).toPandas()
    known = np.zeros((parts, SLOTS), dtype=bool)
    known[rows["part"].to_numpy(dtype=np.int64), rows["slot"].to_numpy(dtype=np.int64)] = True
    return known


def _ungraded(blocks: DataFrame):
    """The function that gives fit_languages the sums of all blocks; the driver gets at most SLOTS + 10 of them a part and round."""
    every = blocks.select("part", "words", "size", "n")
    spark = blocks.sparkSession

    def sums(models: list[Model | None]) -> dict[int, np.ndarray]:
        going = [k for k, m in enumerate(models) if m is not None]
        sent = spark.sparkContext.broadcast({k: copy.copy(models[k]) for k in going})

        def add(batches):
            total = {}
            for pdf in batches:
                for part, words, size, n in zip(pdf["part"], pdf["words"], pdf["size"], pdf["n"]):
                    if len(size):
                        got = register_sums(sent.value[part], _sentences(words, size), np.frombuffer(n, dtype=np.int32))
                        total[part] = total[part] + got if part in total else got
            for part, got in total.items():
                at = np.flatnonzero(got.any(axis=1))
                yield pd.DataFrame({"part": np.full(len(at), part), "id": at, "r0": got[at, 0], "r1": got[at, 1], "r2": got[at, 2]})

        found = every.filter(F.col("part").isin(going)).mapInPandas(add, "part int, id bigint, r0 double, r1 double, r2 double")
        got = found.groupBy("part", "id").agg(*[F.sum(r).alias(r) for r in ("r0", "r1", "r2")]).toPandas()
        sent.destroy()
        out = {k: np.zeros((SLOTS + 10, len(PURE))) for k in going}
        for k in going:
            mine = got[got["part"] == k]
            out[k][mine["id"].to_numpy(dtype=np.int64)] = mine[["r0", "r1", "r2"]].to_numpy()
        return out

    return sums


def _lang() -> Column:
    return F.lower(F.trim(F.coalesce(F.col("lang").cast("string"), F.lit(""))))


def graded_texts(documents: DataFrame, labels: DataFrame, max_graded: int = MAX_GRADED) -> list:
    """Rows (doc_id, text, lang, grades) of at most max_graded documents, chosen by hash; a rater's grades of a document are one, their
    mean; lang is in lower case, empty where there is none."""
    one = labels.filter("doc_id is not null and grade is not null").groupBy("doc_id", "rater").agg(F.avg("grade").alias("grade"))
    grades = one.groupBy("doc_id").agg(F.sort_array(F.collect_list("grade")).alias("grades"))
    lang = _lang() if "lang" in documents.columns else F.lit("")
    rows = documents.select("doc_id", "text", lang.alias("lang")).filter("text <> ''").join(grades, "doc_id")
    return sorted(rows.orderBy(F.xxhash64("doc_id"), "text").limit(max_graded).collect(), key=lambda r: (r["doc_id"], r["text"]))


def languages(documents: DataFrame, some: set[str]) -> list[str]:
    """Those of some values of lang that at least LEAST_SHARE of all texts have; without the column one that all have."""
    if "lang" not in documents.columns:
        return [""]
    total = documents.filter("text <> ''").count()
    n = documents.filter("text <> ''").groupBy(_lang().alias("lang")).count().filter(F.col("count") >= max(1.0, LEAST_SHARE * total))
    return sorted(r["lang"] for r in n.collect() if r["lang"] in some)


def fitted(documents: DataFrame, labels: DataFrame, max_graded: int = MAX_GRADED) -> tuple[Model, DataFrame]:
    """The model of the labels' documents and all others, and the blocks of all documents."""
    graded = graded_texts(documents, labels, max_graded)
    codes = _Codes()
    texts = [(split([r["text"]], codes)[0], list(r["grades"]), r["lang"]) for r in graded]
    chosen, langs = {r["doc_id"] for r in graded}, languages(documents, {lang for s, _, lang in texts if len(s.size)})
    part = F.lit(0)
    if len(langs) > 1:
        part = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in langs]), _lang()) - 1, F.lit(-1)).cast("int")
    blocks = cut(spread(documents.select("doc_id", "text", part.alias("part"))).mapInPandas(lambda batches: coded(batches, chosen), _CODED))
    if not graded:
        return Model(), blocks
    parts = [Model(known) for known in known_slots(blocks, max(1, len(langs)))]
    fit_languages(parts, [[(s, float(np.mean(g))) for s, g, lang in texts if len(parts) == 1 or lang == langs[k]] for k in range(len(parts))], _ungraded(blocks))
    model = parts[0]
    if len(parts) > 1:
        model = Model()
        model.parts = parts
    return ranked(model, [(s, g) for s, g, _ in texts]), blocks


def reading_levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_chars, score, level) of every document; level is on the labels' scale, rounded to 3 digits.

    Texts that are null or have no sentence of two words have null score and level; n_chars is counted here, null for null
    texts; very long texts are read whole; repeated documents get a row each; labels of unknown documents don't matter, and
    without any usable label every level is null; an empty table gives no rows; further columns don't matter.
    """
    fit, blocks = fitted(documents, labels)
    context = documents.sparkSession.sparkContext
    model = context.broadcast(fit)
    names = [f"f{k}" for k in range(len(fit.weights))]

    def describe(batches):
        for pdf in batches:
            for b in pdf.itertuples(index=False):
                ids, null = pd.Series(np.frombuffer(b.ids, dtype=np.int64)).astype("Int64"), np.frombuffer(b.null_id, dtype=bool)
                chars, n = pd.Series(np.frombuffer(b.n_chars, dtype=np.int64)).astype("Int64"), np.frombuffer(b.per_doc, dtype=np.int32)
                f = model.value.features(_sentences(b.words, b.size), np.frombuffer(b.numbers, dtype=np.int32), n)
                yield pd.DataFrame({"doc_id": ids.mask(null), "n_chars": chars.mask(chars < 0), "n": n} | dict(zip(names, f.T)))

    texts = cut(blocks.drop("n").mapInPandas(describe, "doc_id bigint, n_chars bigint, n int, " + ", ".join(f"{x} double" for x in names)))
    if len(fit.at):
        edges = np.linspace(fit.rows[0].min(), fit.rows[0].max() + 1e-6, STEPS + 1)
        weights = fit.weights

        def lie(batches):
            total = np.zeros(STEPS)
            for pdf in batches:
                score = pdf[names].to_numpy() @ weights
                ok = ~np.isnan(score)
                total += np.histogram(np.clip(score[ok], edges[0], edges[-1]), edges, weights=np.minimum(pdf["n"].to_numpy()[ok], MOST_SENTENCES))[0]
            yield pd.DataFrame({"step": np.arange(STEPS), "n": total})

        got = texts.select("n", *names).mapInPandas(lie, "step int, n double").groupBy("step").agg(F.sum("n").alias("n")).toPandas()
        here = np.zeros(STEPS)
        here[got["step"].to_numpy(dtype=np.int64)] = got["n"].to_numpy()
        fit.settle(here, edges)
    levels = copy.copy(fit)
    levels.parts, levels.known, levels.logp = [], None, None

    def score(batches):
        for pdf in batches:
            scores, level = levels.grade(pdf[names].to_numpy())
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_chars": pdf["n_chars"].astype("Int64"), "score": _nullable(scores, 6), "level": _nullable(level, 3)})

    return texts.drop("n").mapInPandas(score, "doc_id bigint, n_chars bigint, score double, level double")


def _nullable(x: np.ndarray, digits: int) -> pd.Series:
    return pd.Series([None if np.isnan(v) else v for v in x.round(digits).tolist()], dtype="Float64")


def demanding(documents: DataFrame, labels: DataFrame, least_chars: int = 200, least_level: float = DEMANDING) -> DataFrame:
    """reading_levels of texts with at least least_chars characters and least_level."""
    return reading_levels(documents, labels).filter((F.col("n_chars") >= least_chars) & (F.col("level") >= least_level))
