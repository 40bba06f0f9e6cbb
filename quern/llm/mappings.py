"""Byte-to-letter mappings of wrongly decoded text, learnt by expectation-maximization (problem 2).

A family of ciphers is a way to cut what is shown into symbols, groups of bytes that stand for one letter each; within a family a
symbol may stand for one of several letters, those of the code pages that are its starting points. Which one it stands for in
a source is learnt by EM over bigrams of the source's symbols against the language's. A mapping is kept as the starting point that
it is nearest to and the symbols for which it differs, so it stays small whatever the alphabet, and is applied with translate().
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

LOST = "�"
HIGH = re.compile(r"[^\x00-\x7f]+")
CYRILLIC = ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic")
#: (true, shown) of single-byte text: Cyrillic in other Cyrillic pages and in western ones, western text in all others.
SINGLE = [(t, s) for s in (*CYRILLIC, "western") for t in CYRILLIC if t != s] + [("cp1252", s) for s in (*CYRILLIC, "cp1250", "mac_roman")]
DOUBLE = ("gbk", "big5")
_UNIT = re.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}|[\x00-\xff]")
#: First of the private characters that stand for symbols while they are translated.
PRIVATE = 0xF0000


@lru_cache(maxsize=None)
def bytes_of(shown: str) -> dict[int, int]:
    """For str.translate: each non-ASCII character of a single-byte code page to its byte. `western` takes cp1252 and latin-1 at once."""
    table = {}
    for code in range(0x80, 0x100):
        for page in ("latin-1", "cp1252") if shown == "western" else (shown,):
            try:
                table[ord(bytes([code]).decode(page))] = code
            except UnicodeDecodeError:
                pass
    return table


def shown_class(shown: str, lo: int, hi: int) -> str:
    """A regular expression of the characters that show the bytes lo .. hi."""
    return "[" + "".join(re.escape(chr(c)) for c, b in bytes_of(shown).items() if lo <= b <= hi) + "]"


@lru_cache(maxsize=None)
def groups(shown: str) -> re.Pattern:
    """Shown characters that stand for the bytes of one UTF-8 letter."""
    two, three, four, more = (shown_class(shown, lo, hi) for lo, hi in ((0xC2, 0xDF), (0xE0, 0xEF), (0xF0, 0xF4), (0x80, 0xBF)))
    return re.compile(f"{two}{more}|{three}{more}{{2}}|{four}{more}{{3}}")


@lru_cache(maxsize=None)
def double_runs() -> re.Pattern:
    """Runs of two and more double-byte letters, shown in a western page."""
    of = bytes_of("western")
    lead = "".join(re.escape(chr(c)) for c, b in of.items() if 0x81 <= b <= 0xFE)
    return re.compile(f"(?:[{lead}][{lead}@-~\x80]){{2,}}")


def _decoded(symbol: str, encoding: str) -> str:
    try:
        return symbol.encode("latin-1").decode(encoding)
    except UnicodeError:
        return ""


def family_of(cipher: str) -> str:
    """Of a listed cipher `true as shown`, or `utf-8 as shown, twice`, the family `how as shown`."""
    true, _, shown = cipher.partition(" as ")
    if true in DOUBLE:
        return f"pairs as {shown}"
    return cipher if true == "utf-8" else f"letters as {shown}"


@lru_cache(maxsize=100_000)
def starts(symbol: str, family: str) -> tuple[tuple[str, str], ...]:
    """(listed cipher, letter) of what a symbol may stand for. Symbols are bytes, written as latin-1."""
    how, _, shown = family.partition(" as ")
    if how == "utf-8":
        letter = _decoded(symbol, "utf-8")
        return ((family, letter),) if letter else ()
    true = [t for t in DOUBLE if t != shown] if how == "pairs" else [t for t, s in SINGLE if s == shown]
    found = ((f"{t} as {shown}", _decoded(symbol, t)) for t in true)
    return tuple((c, x) for c, x in found if len(x) == 1 and x > "\x7f")


def _utf8_groups(text: str, shown: str) -> list[tuple[str, str]]:
    """(shown characters, their letter, or the same character) all along the text."""
    of, out, at = bytes_of(shown), [], 0
    for m in groups(shown).finditer(text):
        letter = _decoded(m[0].translate(of), "utf-8")
        if letter:
            out += [(c, c) for c in text[at : m.start()]]
            out.append((m[0], letter))
            at = m.end()
    return out + [(c, c) for c in text[at:]]


def symbols(piece: str, family: str) -> list[str]:
    """The piece cut into symbols and characters that stand for themselves; a symbol is marked by a leading U+0001."""
    how, _, shown = family.partition(" as ")
    out: list[str] = []
    if how == "utf-8" and shown in ("gb18030", "gbk", "big5"):
        return _of_runs(piece, "gb18030" if shown == "gbk" else shown, _UNIT)
    if how == "pairs" and shown in DOUBLE:
        return _of_runs(piece, shown, re.compile("..", re.S))
    if how == "utf-8":
        twice = shown.endswith(", twice")
        shown = shown.removesuffix(", twice")
        of, once = bytes_of(shown), _utf8_groups(piece, shown)
        if not twice:
            return ["\x01" + a.translate(of) if a != b else a for a, b in once]
        first, at = "".join(b for _, b in once), 0
        if len(first) != len(once):
            return list(piece)
        for a, b in _utf8_groups(first, shown):
            whole = "".join(x for x, _ in once[at : at + len(a)])
            # the bytes of the second cut are what starts() reads; what was garbled once only stays a letter of its own
            out.append("\x01" + a.translate(of) if a != b else "\x01" + whole.translate(of) if whole != a else a)
            at += len(a)
        return out
    of = bytes_of(shown)
    if how == "pairs":
        at = 0
        for m in double_runs().finditer(piece):
            out += list(piece[at : m.start()])
            data = m[0].translate(of)
            out += ["\x01" + data[k : k + 2] for k in range(0, len(data), 2)]
            at = m.end()
        return out + list(piece[at:])
    return ["\x01" + chr(of[ord(c)]) if ord(c) in of and c > "\x7f" else c for c in piece]


def _of_runs(piece: str, shown: str, unit: re.Pattern) -> list[str]:
    """Symbols of a multi-byte page: the bytes of each run of non-ASCII characters between lost ones, cut into units."""
    out: list[str] = []
    at = 0
    for m in HIGH.finditer(piece):
        out += list(piece[at : m.start()])
        at = m.end()
        try:
            parts = [x.encode(shown).decode("latin-1") for x in m[0].split(LOST)]
        except UnicodeError:
            out += list(m[0])
            continue
        run: list[str] = []
        for k, part in enumerate(parts):
            run += [LOST] * (k > 0)
            run += [x if x < "\x80" and len(x) == 1 else LOST if unit is _UNIT and len(x) == 1 else "\x01" + x for x in unit.findall(part)]
        if unit is _UNIT and LOST not in m[0] and LOST in run:
            out += list(m[0])  # not UTF-8 throughout
        else:
            out += [x for k, x in enumerate(run) if x != LOST or k == 0 or run[k - 1] != LOST]
    return out + list(piece[at:])


def read(piece: str, family: str, base: str, learnt: dict[str, str]) -> str:
    """The piece by a mapping: its symbols as private characters, translated. Symbols without a letter stay as they were shown."""
    numbers: dict[str, int] = {}
    table: dict[int, str] = {}
    coded = []
    for s in symbols(piece, family):
        if s[0] == "\x01" and len(s) > 1:
            if s not in numbers:
                letter = learnt.get(s[1:]) or dict(starts(s[1:], family)).get(base)
                if not letter:
                    return piece
                numbers[s] = PRIVATE + len(numbers)
                table[numbers[s]] = letter
            s = chr(numbers[s])
        coded.append(s)
    return "".join(coded).translate(table)


#: What a symbol's letter by the likeliest starting point counts, beside how often the symbol was seen.
PRIOR = 4.0


def learn(counts: dict[tuple[str, str], float], family: str, likelihood, rounds: int = 15) -> tuple[str, dict[str, str]]:
    """(base, letters of the symbols that differ from it) from counts of bigrams of symbols and characters, by EM.

    likelihood(a, b): log probabilities of letter b after a, as arrays of code points. The chances of the starting points come from
    their likelihood for the source as a whole, and are where the letters of each symbol start from.
    """
    names = sorted({x for pair in counts for x in pair})
    row = {x: i for i, x in enumerate(names)}
    of = [dict(starts(x[1:], family)) if x[0] == "\x01" and len(x) > 1 else None for x in names]
    ciphers = sorted({c for o in of if o for c in o})
    if not ciphers:
        return "", {}
    a, b = (np.array([row[p[k]] for p in counts]) for k in (0, 1))
    n = np.array(list(counts.values()), dtype=float)

    def codes(letters: list[str]) -> np.ndarray:
        return np.array([min(ord(x[0]), 0xFFFF) for x in letters], dtype=np.int64)

    whole = []
    for c in ciphers:
        code = codes([x if o is None else o.get(c, LOST) for x, o in zip(names, of)])
        whole.append((n * likelihood(code[a], code[b])).sum())
    weight = np.exp(np.array(whole) - max(whole))
    base = ciphers[int(weight.argmax())]
    options = [[x] if o is None else list(dict.fromkeys(o.values())) or [LOST] for x, o in zip(names, of)]
    wide = max(map(len, options))
    if wide == 1:
        return base, {}
    code = np.stack([codes([o[min(k, len(o) - 1)] for o in options]) for k in range(wide)], axis=1)
    prior = np.array([[1.0 if o is None else sum(w for c, w in zip(ciphers, weight) if o.get(c) == x[k]) if k < len(x) else 0.0 for k in range(wide)] for o, x in zip(of, options)])
    prior[[o is None for o in of], 1:] = 0.0
    prior /= np.maximum(prior.sum(1, keepdims=True), 1e-300)
    open_to = np.array([[k < len(x) for k in range(wide)] for x in options], dtype=float)
    chance = 0.9 * prior + 0.1 * open_to / open_to.sum(1, keepdims=True)
    joint = np.exp(likelihood(code[a][:, :, None] + 0 * code[b][:, None, :], code[b][:, None, :] + 0 * code[a][:, :, None]))
    for _ in range(rounds):
        p = chance[a][:, :, None] * joint * chance[b][:, None, :]
        p *= (n / np.maximum(p.sum((1, 2)), 1e-300))[:, None, None]
        mass = PRIOR * prior
        np.add.at(mass, a, p.sum(2))
        np.add.at(mass, b, p.sum(1))
        chance = mass / mass.sum(1, keepdims=True)
    found = {x[1:]: choice[int(chance[i, : len(choice)].argmax())] for i, (x, o, choice) in enumerate(zip(names, of, options)) if o}
    return base, {x: letter for x, letter in found.items() if letter != dict(starts(x, family)).get(base)}
