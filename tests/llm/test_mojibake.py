"""Wrong encodings: made by swapping clean text, found and read back; decoys stay."""

import collections
import os
import random
from datetime import datetime

import numpy as np
import pytest

from quern.llm import mappings as mp
from quern.llm import mojibake as mb

PAGES = "page_id bigint, url string, html string, raw_text string, fetched_at timestamp, source string, cipher string, gain int"
FRENCH = "La fenêtre était récente près du marché où l’élève a trouvé une clé dans la forêt voisine à côté de l’église"
RUSSIAN = "В этом году новая библиотека открыла большую выставку возле вокзала и местная газета знает что улица находится на берегу реки"
CHINESE = "记者在码头附近看到冬季的居民前排起长队正在登记音乐会的报名系统而图书馆的读者每天都要检查最新的课程表"


def sentence(text, rnd):
    parts = list(text) if text is CHINESE else text.split(" ")
    k = rnd.randrange(len(parts))
    return ("" if text is CHINESE else " ").join(parts[k:] + parts[:k])


SWAPS = [
    (FRENCH, lambda t: t.encode().decode("latin-1")), (FRENCH, lambda t: t.encode().decode("latin-1").encode().decode("latin-1")), (FRENCH, lambda t: t.encode().decode("cp1251", "ignore")),
    (CHINESE, lambda t: t.encode().decode("latin-1")), (CHINESE, lambda t: t.encode("gbk").decode("latin-1")), (CHINESE, lambda t: t.encode().decode("gb18030", "replace")),
    (RUSSIAN, lambda t: t.encode("cp1251").decode("koi8-r")), (RUSSIAN, lambda t: t.encode("koi8-r").decode("cp1251")), (RUSSIAN, lambda t: t.encode("cp866").decode("cp1251", "ignore")),
    (FRENCH, lambda t: t.encode("latin-1", "ignore").decode("utf-8", "replace")),
]
DECOYS = ["CHÂTEAU, PÂTÉ, Ä–Z, ©2020®", "A CÂMARA E A REGIÃO NÃO ABREM", "N° 7 · ¿Qué? · «ÃO» · ±3 µm", "plain ascii", "ОРСИН ГУГУВЕ", "", None]


def corpus(seed=1):
    rnd = random.Random(seed)
    clean, swapped = [], []
    for i in range(260):
        base = (FRENCH, RUSSIAN, CHINESE)[i % 3]
        clean.append("\n".join([sentence(base, rnd), sentence(base, rnd), rnd.choice(DECOYS[:-1])]))
    for base, swap in SWAPS:
        original = "\n".join(sentence(base, rnd) for _ in range(3))
        swapped.append((original, "\n".join(map(swap, original.split("\n")))))
    return clean, swapped


def frame(spark, clean, swapped):
    day = datetime(2024, 1, 2)
    rows = [(i, f"http://www.s{i % 3}.test/{i}", f"<p>{t}</p>", t, day) for i, t in enumerate(clean)]
    rows += [(1000 + i, "http://s0.test/x" if i % 2 else None, f"<html><p>{o}</p>" if i % 3 else None, t, day) for i, (o, t) in enumerate(swapped)]
    rows += [(2000 + i, "http://s1.test/", t, None, day) for i, t in enumerate(DECOYS)]
    rows += [(0, "http://s0.test/", "Ã©Ã©Ã©", "Ã©tÃ©", datetime(2020, 1, 1)), rows[3], (None, None, "Ã©tÃ©", "Ã©tÃ©", day)]
    return spark.createDataFrame([(*r, "s", "c", 1) for r in rows], PAGES).repartition(4)


def test_swapped_fields_are_found_and_restored(spark):
    clean, swapped = corpus()
    df = frame(spark, clean, swapped)
    found = {(r["page_id"], r["field"]): r["cipher"] for r in mb.swapped_fields(df).collect()}
    assert set(found) == {(1000 + i, "raw_text") for i in range(len(swapped))}
    texts = {r["page_id"]: r["text"] for r in mb.restored(df).collect()}
    exact = [0, 1, 3, 4, 6, 7]
    assert {i: texts[1000 + i] for i in exact} == {i: swapped[i][0] for i in exact}
    assert found[1009, "raw_text"] == mb.LOST_BYTES and texts[1009] is None


def test_a_field_swapped_in_part_keeps_its_clean_lines(spark):
    clean, _ = corpus()
    rnd = random.Random(9)
    for base, swap in (SWAPS[0], SWAPS[3], SWAPS[4], SWAPS[6]):
        lines = [sentence(base, rnd) for _ in range(4)]
        shown = [lines[0], swap(lines[1]), "R&#233;sum&#233; of 2020 &amp; more", swap(lines[2]), lines[3]]
        rows = [(i, "http://a.test/", None, t, datetime(2024, 1, 2), "s", "c", 1) for i, t in enumerate(clean)]
        rows.append((900, "http://a.test/", None, "\n".join(shown), datetime(2024, 1, 2), "s", "c", 1))
        got = {r["page_id"]: r["text"] for r in mb.restored(spark.createDataFrame(rows, PAGES)).collect()}
        assert got == {900: "\n".join([lines[0], lines[1], shown[2], lines[2], lines[3]])}


def test_western_letters_in_a_cyrillic_page_and_quotes_in_a_mac_page(spark):
    rnd = random.Random(8)
    clean = ["\n".join([sentence(FRENCH, rnd), sentence(RUSSIAN, rnd), "“Quoted” words aren’t rare – here"]) for _ in range(200)]
    french, quotes = sentence(FRENCH, rnd), "“Quoted” words aren’t rare – here\nplain"
    rows = [(900, french.encode("cp1252").decode("cp1251")), (901, quotes.encode().decode("mac_roman"))]
    df = spark.createDataFrame([(i, None, None, t, datetime(2024, 1, 2), "s", "c", 1) for i, t in [*enumerate(clean), *rows]], PAGES)
    found = {r["page_id"]: (r["cipher"], r["base"]) for r in mb.swapped_fields(df).collect()}
    assert found == {900: ("letters as cp1251", "cp1252 as cp1251"), 901: ("utf-8 as mac-roman", "utf-8 as mac-roman")}
    assert {r["page_id"]: r["text"] for r in mb.restored(df).collect()} == {900: french, 901: quotes}


def test_a_mapping_is_learnt_from_several_starting_points():
    rnd = random.Random(2)
    texts = [" ".join(rnd.sample(RUSSIAN.lower().split(" "), 12)) for _ in range(300)]
    lm = language(texts)
    half = set("абвгдежз")
    # some letters are as in koi8-r and the others as in cp1251, both shown in mac_cyrillic: no code page has all
    shown = {c: c.encode("koi8-r" if c in half else "cp1251").decode("mac_cyrillic") for c in sorted(set("".join(texts))) if c > "\x7f"}
    if len(set(shown.values())) < len(shown):
        shown = {c: x for c, x in shown.items() if list(shown.values()).count(x) == 1}
    lines = ["".join(shown.get(c, c) for c in t) for t in texts[:100]]
    counts = collections.Counter()
    for x in lines:
        s = [" ", *mp.symbols(x, "letters as mac_cyrillic"), " "]
        counts.update((a, b) for a, b in zip(s, s[1:]) if len(a) > 1 or len(b) > 1)
    base, differ = mp.learn(counts, "letters as mac_cyrillic", lm.pair)
    got = mp.read(lines[0], "letters as mac_cyrillic", base, differ)
    assert base == "cp1251 as mac_cyrillic" and differ
    size = sum(c in shown for c in texts[0])
    assert sum(a == b for a, b, c in zip(got, texts[0], texts[0]) if c in shown) > 0.8 * size


def test_symbols_read_back_what_the_swap_did():
    for base, swap in SWAPS[:9]:
        g = swap(base)
        for cipher, reader in mb.CIPHERS.items():
            out = reader(g)
            if out == base and mb.LOST not in g:
                assert mp.read(g, mp.family_of(cipher), cipher, {}) == base


def test_empty_and_null(spark):
    df = frame(spark, [], [])
    assert mb.swapped_fields(df.limit(0)).count() == 0
    assert mb.restored(df.filter("html is null")).count() == 0


def language(texts):
    import pandas as pd

    pairs, singles = np.zeros(1 << mb.BITS, np.float32), np.zeros(1 << 16, np.float32)
    for part in mb._count([pd.DataFrame({"raw_text": texts})]):
        (pairs if part["kind"].iloc[0] == 0 else singles)[part["slot"].to_numpy()] += part["n"].to_numpy()
    return mb.Bigrams(pairs, singles)


def test_a_cipher_that_no_table_has_is_learnt():
    rnd = random.Random(2)
    texts = [" ".join(rnd.sample(RUSSIAN.lower().split(" "), 12)) for _ in range(400)]
    lm = language(texts)
    letters = sorted({c for c in "".join(texts) if ord(c) > 127})
    # half of the letters as in koi8-r read as cp1251, the others exchanged at will, as no listed page has them
    shown = {c: c.encode("koi8-r").decode("cp1251") for c in letters}
    odd = letters[::4]
    for c, d in zip(odd, odd[1:] + odd[:1]):
        shown[c] = d.encode("koi8-r").decode("cp1251")
    garbled = [t.translate(str.maketrans(shown)) for t in texts[:200]]
    counts = collections.Counter((a, b) for t in garbled for a, b in zip(f" {t} ", f" {t} "[1:]) if not (a.isascii() and b.isascii()))
    mapping = mb.learn_mapping(counts, lm, "".join(letters))
    size = sum(len(t) for t in garbled)
    right = sum(a == b for g, t in zip(garbled, texts) for a, b in zip(g.translate(str.maketrans(mapping)), t))
    assert right / size > 0.9
    assert all(lm.score(g.translate(str.maketrans(mapping))) > lm.score(g) for g in garbled)


def test_a_mapping_is_learnt_beside_rare_chinese_and_without_url(spark):
    rnd = random.Random(2)
    texts = [" ".join(rnd.sample(RUSSIAN.lower().split(" "), 12)) for _ in range(300)]
    lm = language(texts)
    letters = sorted({c for c in "".join(texts) if ord(c) > 127})
    shown = {c: c.encode("koi8-r").decode("cp1251") for c in letters}
    lines = [t.translate(str.maketrans(shown)) for t in texts[:150]]
    rows = [(s, x) for s in ("a.test", None) for x in lines] + [("a.test", "".join(chr(0x4E00 + 7 * k) for k in range(600))), ("b.test", "".join(chr(0x4E00 + k) for k in range(90)))]
    strange = spark.createDataFrame(rows, "source string, line string")
    got = {r["source"]: str.maketrans(r["shown"], r["letters"]) for r in mb.learnt_mappings(strange, spark.sparkContext.broadcast(lm), "".join(letters)).collect()}
    assert set(got) == {"a.test", ""}
    for table in got.values():
        assert sum(a == b for g, t in zip(lines, texts) for a, b in zip(g.translate(table), t)) > 0.9 * sum(map(len, lines))


def test_a_page_keeps_its_known_pieces_when_the_reader_forgets():
    reader = mb.Reader(language([FRENCH] * 50))
    line = FRENCH.encode().decode("latin-1")
    first = reader.read({"raw_text": line})
    assert first["raw_text"][0]["utf-8 as western", line] > mb.LEAST_GAIN
    reader.known.update({f"é{k}": ({}, False) for k in range(mb.KNOWN + 1)})
    again = reader.read({"raw_text": line + "\nune ligne très nouvelle"})
    assert again["raw_text"][0] == first["raw_text"][0] and len(reader.known) == 2


def test_mapping_of_nothing():
    assert mb.learn_mapping({}, language(["é à"]), "éà") == {}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_share_of_swapped_fields_is_small(spark):
    from quern.llm import entry

    assert entry.QUERIES["p2_found"](spark, "/root/testdata/sf0.001").count() < 40
