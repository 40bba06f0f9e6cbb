"""Text decoded in the wrong encoding (problem 2).

A code-page swap is a substitution cipher: what is shown stands for bytes, and groups of bytes stand for letters. For each source
(host) its ciphers are learnt by expectation-maximization against language bigrams:

* The bigrams are counted over all current texts, without lines whose look alone says that they are swapped, into a table of fixed size.
* Lines that look swapped or are unlikely as they stand are read by starting points: pairs of a shown and a true code page.
  Those that gain likelihood are candidates.
* Of each source and family of ciphers, the candidates' symbols are counted as bigrams and the source's mapping from symbols to
  letters is learnt by EM, see mappings.py. Candidates are read again by their source's mapping, with translate(); the gain is
  the log-likelihood of that reading less that of the line as it stands.
* The share of each family in each source and the probability that a page's field is swapped are then fitted in turns (mixture EM over
  the few candidate fields).
* Lines that are unlikely as they stand and that no starting point explains are collected by source as bigram counts, and a
  byte-to-letter mapping without starting point is learnt for them by EM over pairs of letters, applied and judged in the same way.

U+FFFD marks bytes that were lost, so a field that has it is reported, and restored as far as it can be. Restoring reads those pieces
of a field (what lies between line ends and tag brackets) that gain by it, and leaves all others byte for byte.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.urls import site
from quern.llm.mappings import HIGH, LOST, SINGLE, bytes_of, double_runs, family_of, groups, learn, read, shown_class, symbols
from quern.operators.latest import current_pages
from quern.sources.tables import cut

BITS = 20
#: Log-likelihood a reading must gain in a field, the least prior share of a cipher, the mean log-likelihood below which a line is
#: read under all ciphers, and below which it may be a cipher of its own.
LEAST_GAIN, LEAST_SHARE, PLAIN, STRANGE = 3.0, 1e-3, -4.0, -9.0
#: The mean log-likelihood that a reading only suggested by likelihood must reach.
BELIEVED = -5.0
LOST_BYTES, LEARNT = "lost bytes", "learnt"
#: Letters, the most frequent ones, that a mapping without starting point chooses from.
MOST_LETTERS = 80
#: A task forgets the pieces it has read when it has more than this.
KNOWN = 200_000
_PIECES, _CUTS = re.compile(r"[<>\n]"), re.compile(r"([<>\n])")
_ENTITY = re.compile(r"&#(\d{3,6});")


def _read_utf8(line: str, shown: str) -> str:
    of = bytes_of(shown)

    def letter(m: re.Match) -> str:
        try:
            return m[0].translate(of).encode("latin-1").decode("utf-8")
        except UnicodeError:
            return m[0]

    return groups(shown).sub(letter, line)


def _read_run(line: str, shown: str, true: str, errors: str = "strict") -> str:
    def run(m: re.Match) -> str:
        try:
            return m[0].encode(shown).decode(true, errors)
        except UnicodeError:
            return m[0]

    return HIGH.sub(run, line)


def _read_lossy(line: str, shown: str) -> str:
    """UTF-8 shown in a multi-byte page: what lies between lost bytes is read on its own."""

    def run(m: re.Match) -> str:
        try:
            return re.sub(f"{LOST}+", LOST, LOST.join(x.encode(shown).decode("utf-8", "replace") for x in m[0].split(LOST)))
        except UnicodeError:
            return m[0]

    return HIGH.sub(run, line)


def _read_pairs(line: str, true: str) -> str:
    of = bytes_of("western")

    def run(m: re.Match) -> str:
        try:
            return m[0].translate(of).encode("latin-1").decode(true)
        except UnicodeError:
            return m[0]

    return double_runs().sub(run, line)


def _read_single(line: str, shown: str, true: str) -> str:
    return line.translate(_swap(shown, true))


@lru_cache(maxsize=None)
def _swap(shown: str, true: str) -> dict[int, str]:
    out = {}
    for c, b in bytes_of(shown).items():
        try:
            out[c] = bytes([b]).decode(true)
        except UnicodeDecodeError:
            pass
    return out


#: Ciphers that a line's look suggests, and those tried on lines that are unlikely as they stand.
BY_LOOK = {
    "utf-8 as western": lambda x: _read_utf8(x, "western"),
    "utf-8 as western, twice": lambda x: _read_utf8(_read_utf8(x, "western"), "western"),
    "utf-8 as cp1251": lambda x: _read_utf8(x, "cp1251"),
    "utf-8 as koi8-r": lambda x: _read_utf8(x, "koi8-r"),
    "utf-8 as cp1250": lambda x: _read_utf8(x, "cp1250"),
    "utf-8 as mac-roman": lambda x: _read_utf8(x, "mac_roman"),
    "utf-8 as gbk": lambda x: _read_lossy(x, "gb18030") if LOST in x else _read_run(x, "gb18030", "utf-8"),
    "utf-8 as big5": lambda x: _read_run(x, "big5", "utf-8"),
    "gbk as western": lambda x: _read_pairs(x, "gbk"),
    "big5 as western": lambda x: _read_pairs(x, "big5"),
}
BY_SCORE = {f"{true} as {shown}": (lambda x, s=shown, t=true: _read_single(x, s, t)) for true, shown in SINGLE}
_MULTI = {"gbk as big5": lambda x: _read_run(x, "big5", "gbk"), "big5 as gbk": lambda x: _read_run(x, "gbk", "big5")}
CIPHERS = BY_LOOK | BY_SCORE | _MULTI
_ALPHABETIC = re.compile("[\x80-ӿ]")


_MAC_MORE = shown_class("mac_roman", 0x80, 0xBF)
#: UTF-8 letters shown in a single-byte page, and control characters. In cp866 only box characters before others, in mac_roman only
#: three bytes, or two after a sign that texts hardly have, look odd.
_LOOKS = re.compile("|".join([*(groups(p).pattern for p in ("western", "cp1251", "cp1250", "koi8-r")), "[\x80-\x9f]", "[─-▟]" + shown_class("cp866", 0x80, 0xBF), f"[¬√]{_MAC_MORE}", f"{shown_class('mac_roman', 0xE0, 0xEF)}{_MAC_MORE}{{2}}"]))


def looks_swapped(line: str) -> bool:
    """Whether the line's look alone says that it may be swapped: such lines don't teach the language."""
    if LOST in line or _LOOKS.search(line):
        return True
    if m := double_runs().search(line):
        if len(m[0]) >= 6:
            return True
    for run in HIGH.findall(line):
        if len(run) > 1 or "一" <= run <= "鿿":
            try:
                run.encode("gb18030").decode("utf-8")
                return True
            except UnicodeError:
                pass
    return False


#: ASCII as the bigrams see it: letters as they are, digits as 0, all else as a blank.
_ASCII = np.array([c if chr(c).isalpha() else 48 if chr(c).isdigit() else 32 for c in range(128)], dtype=np.int64)


def _codes(text: str) -> np.ndarray:
    codes = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4"), 0xFFFF).astype(np.int64)
    low = codes < 128
    codes[low] = _ASCII[codes[low]]
    return codes


def _slots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a << 16 | b).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - BITS)).astype(np.int64)


class Bigrams:
    """In how many pages a bigram with a non-ASCII character is, hashed into 2^BITS slots, and a single character (2^16).

    One page is taken off each, so that a page's own text doesn't speak for itself.
    """

    def __init__(self, pairs: np.ndarray, singles: np.ndarray):
        self.pairs, self.singles = np.maximum(pairs - 1, 0), np.maximum(singles - 1, 0)
        self.share = (singles + 0.02) / (singles.sum() + 1)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Log probability of b after a."""
        return np.log((self.pairs[_slots(a, b)] + 2 * self.share[b]) / (self.singles[a] + 2))

    def each(self, codes: np.ndarray) -> np.ndarray:
        a, b = codes[:-1], codes[1:]
        return np.where((a > 127) | (b > 127), self.pair(a, b), 0.0)

    def score(self, text: str) -> float:
        return float(self.each(_codes(f" {text} ")).sum())

    def score_and_mean(self, text: str) -> tuple[float, float]:
        """score, and the mean of it over bigrams that have a non-ASCII character."""
        codes = _codes(f" {text} ")
        each, high = self.each(codes), (codes[:-1] > 127) | (codes[1:] > 127)
        return float(each.sum()), float(each.sum() / max(int(high.sum()), 1))

    def means(self, texts: list[str]) -> np.ndarray:
        """The mean log-likelihood of each text's bigrams that have a non-ASCII character."""
        joined = "  ".join(texts)
        codes = _codes(f" {joined} ")
        start = np.cumsum([0] + [len(t) + 2 for t in texts[:-1]])
        high = (codes[:-1] > 127) | (codes[1:] > 127)
        return np.add.reduceat(self.each(codes), start) / np.maximum(np.add.reduceat(high, start), 1)


def _count(batches):
    pairs, singles = np.zeros(1 << BITS, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
    for pdf in batches:
        for text in pdf["raw_text"]:
            if not isinstance(text, str) or text.isascii():
                continue
            plain = [f" {x} " for x in text.split("\n") if not x.isascii() and not looks_swapped(x)]
            if plain:
                c = _codes("".join(plain))
                pairs[np.unique(_slots(c[:-1], c[1:])[(c[:-1] > 127) | (c[1:] > 127)])] += 1
                singles[np.unique(c)] += 1
    for kind, counts in ((0, pairs), (1, singles)):
        at = np.flatnonzero(counts)
        for k in range(0, len(at), 100_000):
            part = at[k : k + 100_000]
            yield pd.DataFrame({"kind": kind, "slot": part, "n": counts[part]})


def bigrams(texts: DataFrame) -> Bigrams:
    """The language's bigrams over all rows of (raw_text); the driver gets at most 2^BITS + 2^16 sums."""
    rows = texts.select("raw_text").mapInPandas(_count, "kind int, slot bigint, n bigint")
    got = rows.groupBy("kind", "slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << BITS, dtype=np.float32), np.zeros(1 << 16, dtype=np.float32)
    for kind in (0, 1):
        part = got[got["kind"] == kind]
        out[kind][part["slot"].to_numpy()] = part["n"].to_numpy()
    return Bigrams(*out)


def _plain_text(text: str) -> str:
    return _ENTITY.sub(lambda m: chr(int(m[1])) if 127 < int(m[1]) < 0x110000 else m[0], text) if "&#" in text else text


class Reader:
    """Reads pieces of text (what lies between line ends and tag brackets) under the ciphers, keeping what it found for those it meets again."""

    def __init__(self, language: Bigrams):
        self.language, self.known = language, {}

    def _learn(self, pieces: list[str]) -> None:
        for piece, mean in zip(pieces, self.language.means(pieces)):
            gains, as_is = {}, None
            looks = looks_swapped(piece)
            unlikely = mean < PLAIN and (looks or _ALPHABETIC.search(piece) or len(piece) > 3)
            for name, read in (CIPHERS if unlikely and _ALPHABETIC.search(piece) else BY_LOOK | _MULTI if unlikely else BY_LOOK if looks else {}).items():
                out = read(piece)
                if out != piece:
                    as_is = self.language.score(piece) if as_is is None else as_is
                    score, now = self.language.score_and_mean(out)
                    if score > as_is and now > mean + 0.5 and (name in BY_LOOK or now > BELIEVED):
                        gains[name] = score - as_is
            strange = mean < STRANGE and not looks and max(gains.values(), default=0) < LEAST_GAIN and sum(c > "\x7f" for c in piece) >= 8
            self.known[piece] = (gains, strange)

    def read(self, fields: dict[str, str]) -> dict[str, tuple[dict[tuple[str, str], float], list[str]]]:
        """Of each field, the gain of each (cipher, piece), the best cipher of each family, and the pieces that are unlikely but gain by none."""
        if len(self.known) > KNOWN:
            self.known.clear()  # before the page's own pieces are looked up, so that all of them are read
        pieces = {f: {x for x in _PIECES.split(_plain_text(t)) if not x.isascii()} for f, t in fields.items()}
        new = [x for x in set().union(*pieces.values()) if x not in self.known] if pieces else []
        if new:
            self._learn(new)
        out = {}
        for f in fields:
            gains: dict[tuple[str, str], float] = {}
            strange = []
            for x in pieces[f]:
                found, odd = self.known[x]
                best: dict[str, str] = {}
                for k in sorted(found):
                    family = family_of(k)
                    if family not in best or found[k] > found[best[family]]:
                        best[family] = k
                for k in best.values():
                    gains[k, x] = found[k]
                if odd:
                    strange.append(x)
            out[f] = gains, strange
        return out


def _candidates(language):
    def run(batches):
        reader = Reader(language.value)
        for pdf in batches:
            rows = []
            for page, source, html, raw in zip(pdf["page_id"], pdf["source"], pdf["html"], pdf["raw_text"]):
                fields = {f: t for f, t in (("html", html), ("raw_text", raw)) if isinstance(t, str) and not (t.isascii() and "&#" not in t)}
                for field, (gains, strange) in reader.read(fields).items():
                    rows += [(page, field, source, family_of(k), g, x) for (k, x), g in gains.items()]
                    rows += [(page, field, source, None, 0.0, x) for x in strange]
                    if LOST in fields[field]:
                        rows.append((page, field, source, LOST_BYTES, 0.0, None))
            yield pd.DataFrame(rows, columns=["page_id", "field", "source", "cipher", "gain", "line"])

    return run


_CANDIDATE = "page_id bigint, field string, source string, cipher string, gain double, line string"


def candidates(pages: DataFrame, language) -> DataFrame:
    """(page_id, field, source, cipher, gain, line): each piece that gains by a starting point, with its family as cipher; or, without
    a cipher, a piece that none explains."""
    return pages.mapInPandas(_candidates(language), _CANDIDATE)


def learn_mapping(counts: dict[tuple[str, str], float], language: Bigrams, letters: str, rounds: int = 30) -> dict[str, str]:
    """A symbol-to-letter mapping for bigram counts of symbols, by EM over pairs of letters.

    letters are those of the language, in which ASCII characters stand for themselves. The start is what the single-byte code
    pages say, mixed with every letter.
    """
    symbols = sorted({s for pair in counts for s in pair if ord(s) > 127})
    if not symbols:
        return {}
    hidden = sorted(set(letters))
    fixed = sorted({s for pair in counts for s in pair if ord(s) <= 127})
    states, seen = hidden + fixed, symbols + fixed
    row, col = {s: i for i, s in enumerate(states)}, {s: i for i, s in enumerate(seen)}
    theta = np.zeros((len(states), len(seen)))
    theta[: len(hidden), : len(symbols)] = 0.2 / len(symbols)
    for read in BY_SCORE.values():
        for s in symbols:
            if (x := read(s)) in row and x != s:
                theta[row[x], col[s]] += 0.1
    for s in fixed:
        theta[row[s], col[s]] = 1.0
    theta /= np.maximum(theta.sum(1, keepdims=True), 1e-12)
    c = np.array([ord(s) for s in states])
    joint = language.pairs[_slots(c[:, None] + 0 * c[None, :], c[None, :] + 0 * c[:, None])] + 0.05
    joint /= joint.sum()
    a, b = (np.array([col[p[k]] for p in counts]) for k in (0, 1))
    n = np.array(list(counts.values()), dtype=float)
    for _ in range(rounds):
        new = np.full_like(theta, 1e-9)
        for i in range(0, len(n), 256):
            at = slice(i, i + 256)
            p = theta[:, a[at]].T[:, :, None] * joint[None] * theta[:, b[at]].T[:, None, :]
            p *= (n[at] / np.maximum(p.sum((1, 2)), 1e-300))[:, None, None]
            np.add.at(new.T, a[at], p.sum(2))
            np.add.at(new.T, b[at], p.sum(1))
        new[: len(hidden), len(symbols) :] = 0
        new[len(hidden) :, : len(symbols)] = 0
        mass = new.copy()
        theta = new / np.maximum(new.sum(1, keepdims=True), 1e-12)
    return {s: states[int(mass[:, col[s]].argmax())] for s in symbols}


def _learnt(language, letters: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mapping = learn_mapping({(a, b): n for a, b, n in zip(pdf["a"], pdf["b"], pdf["n"])}, language.value, letters)
        return pd.DataFrame({"source": [pdf["source"].iloc[0]], "shown": ["".join(mapping)], "letters": ["".join(mapping.values())]})

    return run


def learnt_mappings(strange: DataFrame, language, letters: str, least: int = 40) -> DataFrame:
    """(source, shown, letters): of each source the mapping learnt from its strange lines; lines without source are those of ''.

    Only bigrams of symbols are gathered, summed by source, so a group has at most the square of the symbols. Symbols are those of
    alphabets: what lies from U+2E80 on (Chinese and the like) parts a line as a blank does. A source with fewer than `least`
    bigrams gets none.
    """
    line = F.regexp_replace("line", r"[^\x{0}-\x{2E7F}]+", " ")
    chars = F.split(F.concat(F.lit(" "), line, F.lit(" ")), "")
    two = F.transform(F.sequence(F.lit(0), F.size(chars) - 2), lambda i: F.struct(F.get(chars, i).alias("a"), F.get(chars, i + 1).alias("b")))
    counts = strange.select(F.coalesce("source", F.lit("")).alias("source"), F.explode(two).alias("p")).select("source", "p.a", "p.b")
    counts = counts.filter("length(a) = 1 and length(b) = 1 and (ascii(a) > 127 or ascii(b) > 127)").groupBy("source", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    some = counts.groupBy("source").agg(F.sum("n").alias("all")).filter(F.col("all") >= least).select("source")
    return counts.join(some, "source").groupBy("source").applyInPandas(_learnt(language, letters), "source string, shown string, letters string")


def _pairs_of(batches):
    for pdf in batches:
        counts: Counter[tuple[str, str, str, str]] = Counter()
        for key, family, line in zip(pdf["key"], pdf["cipher"], pdf["line"]):
            cut_up = [" ", *symbols(line, family), " "]
            counts.update((key, family, a, b) for a, b in zip(cut_up, cut_up[1:]) if len(a) > 1 or len(b) > 1)
        keys = list(counts)
        yield pd.DataFrame({c: [k[i] for k in keys] for i, c in enumerate(("key", "cipher", "a", "b"))}).assign(n=list(counts.values())).astype({"n": "int64"})


def family_mappings(found: DataFrame, language) -> DataFrame:
    """(key, cipher, base, shown, letters): the mapping of each source (key; '' without one) and family that has candidates.

    Only bigrams of symbols are gathered, summed by source and family, so a group has at most the square of the symbols.
    """
    rows = found.filter("line is not null and cipher is not null").select(F.coalesce("source", F.lit("")).alias("key"), "cipher", "line")
    counts = rows.mapInPandas(_pairs_of, "key string, cipher string, a string, b string, n bigint").groupBy("key", "cipher", "a", "b").agg(F.sum("n").alias("n"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        family = pdf["cipher"].iloc[0]
        base, differ = learn({(a, b): n for a, b, n in zip(pdf["a"], pdf["b"], pdf["n"])}, family, language.value.pair)
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "cipher": [family], "base": [base], "shown": [list(differ)], "letters": [list(differ.values())]})

    return counts.groupBy("key", "cipher").applyInPandas(fit, _MAPPING)


_MAPPING = "key string, cipher string, base string, shown array<string>, letters array<string>"


def reading(piece: str, cipher: str, base: str | None, shown, letters) -> str:
    """A piece by a mapping; base is null for one that was learnt without starting point."""
    if base is None:
        return piece.translate({ord(a): b for a, b in zip(shown, letters)})
    return read(piece, cipher, base, dict(zip(shown, letters)))


def _judged(language):
    def run(batches):
        for pdf in batches:
            lm, gain = language.value, []
            for x, *mapping in zip(pdf["line"], pdf["cipher"], pdf["base"], pdf["shown"], pdf["letters"]):
                out = reading(x, *mapping)
                gain.append(lm.score(out) - lm.score(x) if out != x else 0.0)
            out = pdf[["page_id", "field", "source", "cipher"]].assign(gain=gain)
            yield out[out["gain"] > 0]

    return run


_JUDGED = "page_id bigint, field string, source string, cipher string, gain double"


def fitted(found: DataFrame, rounds: int = 4) -> DataFrame:
    """(page_id, field, source, cipher, gain): the likeliest cipher of each field that is swapped.

    In turns, each field's probabilities of its ciphers and of being plain, and each source's shares of them, smoothed by all
    sources'. The rows are the few candidate fields; shares are sums by (source, cipher).
    """
    rows = found.groupBy("page_id", "field", "source", "cipher").agg(F.sum("gain").alias("gain"))
    lost = F.col("cipher") == LOST_BYTES
    rows = cut(rows.withColumn("gain", F.when(lost, LEAST_GAIN).otherwise(F.col("gain"))))
    share = None
    for k in range(rounds):
        if share is None:
            weighed = rows.withColumn("log", F.col("gain") + F.when(lost, 0.0).otherwise(F.log(F.lit(0.01))))
        else:
            key = F.coalesce("source", F.lit(""))
            weighed = rows.withColumn("key", key).join(share, ["key", "cipher"], "left").withColumn("log", F.col("gain") + F.when(lost, 0.0).otherwise(F.log(F.greatest("share", F.lit(LEAST_SHARE)))))
        best = weighed.groupBy("page_id", "field").agg(F.max("log").alias("top"))
        weighed = weighed.join(best, ["page_id", "field"]).withColumn("p", F.exp(F.col("log") - F.greatest("top", F.lit(0.0))))
        if k == rounds - 1:
            return weighed.filter((F.col("log") == F.col("top")) & (F.col("log") > 0) & (F.col("gain") >= LEAST_GAIN)).groupBy("page_id", "field", "source").agg(F.min("cipher").alias("cipher"), F.max("gain").alias("gain"))
        sums = weighed.groupBy(F.coalesce("source", F.lit("")).alias("key"), "cipher").agg(F.sum(F.least("p", F.lit(1.0))).alias("n"))
        whole = sums.groupBy("key").agg(F.sum("n").alias("whole"))
        share = cut(sums.join(whole, "key").select("key", "cipher", ((F.col("n") + 0.01) / (F.col("whole") + 20)).alias("share")))


def swapped_fields(pages: DataFrame) -> DataFrame:
    """(page_id, field, source, cipher, gain, base, shown, letters): the html and raw_text fields of current pages that hold text
    decoded in a wrong encoding; cipher is the family, LEARNT, or LOST_BYTES where only U+FFFD says so; base is the starting point
    of the source's mapping, null for LEARNT, and shown and letters where the mapping differs from it.

    Null and empty fields are plain; pages without url form one source of their own; very long texts are read whole; older
    fetches and copies are left out; an empty table gives no rows; further columns don't matter.
    """
    return _swapped(pages)[0]


def _swapped(pages: DataFrame):
    """swapped_fields, the current pages and the language."""
    current = cut(current_pages(pages, "url", "html", "raw_text").select("page_id", site(F.col("url")).alias("source"), "html", "raw_text"))
    counted = bigrams(current)
    language = pages.sparkSession.sparkContext.broadcast(counted)
    found = cut(candidates(current, language))
    singles = counted.singles
    order = np.argsort(-singles, kind="stable").tolist()
    letters = "".join([chr(c) for c in order if singles[c] > 0 and 127 < c < 0x2E80 and chr(c).isalpha()][:MOST_LETTERS])
    strange = found.filter("cipher is null")
    free = learnt_mappings(strange, language, letters)
    free = free.select(F.col("source").alias("key"), F.lit(LEARNT).alias("cipher"), F.lit(None).cast("string").alias("base"), *[F.filter(F.split(c, ""), lambda x: x != "").alias(c) for c in ("shown", "letters")])
    mappings = cut(family_mappings(found, language).unionByName(free))
    pieces = found.filter("line is not null").select("page_id", "field", "source", F.coalesce("cipher", F.lit(LEARNT)).alias("cipher"), "line")
    judged = pieces.withColumn("key", F.coalesce("source", F.lit(""))).join(mappings, ["key", "cipher"]).mapInPandas(_judged(language), _JUDGED)
    lost = found.filter(F.col("cipher") == LOST_BYTES).select("page_id", "field", "source", "cipher", "gain")
    out = fitted(judged.unionByName(lost)).withColumn("key", F.coalesce("source", F.lit("")))
    return out.join(mappings, ["key", "cipher"], "left").select("page_id", "field", "source", "cipher", "gain", "base", "shown", "letters"), current, language


def restored_text(text: str, mapping: tuple, language: Bigrams) -> str:
    """The text with those pieces read by the mapping that gain by it; all else stays as it is."""
    out = []
    for piece in _CUTS.split(text):
        plain = _plain_text(piece)
        if not plain.isascii():
            letter = reading(plain, *mapping)
            if letter != plain and language.score(letter) > language.score(plain) and language.means([letter])[0] > language.means([plain])[0]:
                piece = letter
        out.append(piece)
    return "".join(out)


def restored(pages: DataFrame) -> DataFrame:
    """(page_id, field, cipher, text): swapped_fields with the text read piece by piece by their source's mapping; null where only
    bytes are lost."""
    found, current, language = _swapped(pages)

    def run(batches):
        for pdf in batches:
            texts = []
            for text, cipher, base, shown, letters in zip(pdf["text"], pdf["cipher"], pdf["base"], pdf["shown"], pdf["letters"]):
                texts.append(None if shown is None else restored_text(text, (cipher, base, shown, letters), language.value))
            yield pdf[["page_id", "field", "cipher"]].assign(text=texts)

    fields = current.select("page_id", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in ("html", "raw_text")])).alias("f")).select("page_id", "f.*")
    rows = fields.join(found, ["page_id", "field"]).select("page_id", "field", "text", "cipher", "base", "shown", "letters")
    return rows.mapInPandas(run, "page_id bigint, field string, cipher string, text string")
