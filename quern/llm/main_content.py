"""The lines of a page's own article (problem 5).

Gradient-boosted trees over features of DOM nodes judge every line: of the line itself, of its element and of the container it
stands in (size and share of links of its own lines and of its subtree, the learnt odds of its tag and attribute tokens and of its
ancestors', depth, place among its siblings and share of their text), of the
page's title, and of how many pages of the site have the same line. Decoding is hierarchical: containers are judged from the leaves
up and accepted from the body down, so a line can't contradict any ancestor, and a list within the article is judged with it.

The trees are trained here, without given labels: pages that mark their headline with <h1> say by their own elements which lines
are the article's (headings, paragraphs, items and quotations in the headline's container), and are fitted on twice, once with the
elements hidden, so that pages of bare lines are judged by the other features; and half of them once more as if they had no
html, for trees of their own that judge pages without. At most MAX_PAGES pages are fitted on.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.boosting import Trees
from quern.llm.site_lines import page_lines
from quern.operators.latest import current_pages
from quern.sources.tables import cut

#: Bound of the pages that are fitted on.
MAX_PAGES = 900
_TAG = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)>", re.S | re.I)
_BODY = re.compile(r"^.*?<body[^>]*>", re.S | re.I)
_CONTAINERS = frozenset("div td section article main aside nav footer header body table ul ol form".split())
_LISTS = frozenset(("ul", "ol"))
_TEXTUAL = {"p": 1, "li": 2, "h1": 3, "h2": 3, "h3": 3, "h4": 3, "blockquote": 4, "span": 5}
_TOKENS = re.compile("[a-z]+")
_TIME = re.compile(r"\d{1,4}[-./]\d{1,2}[-./]\d{1,4}|\d{1,2}:\d{2}")
_WORDS = re.compile("[㐀-鿿]|[^\\W\\d_㐀-鿿]+|[^\\w\\s]|\\d+")
_ENDS = frozenset(".!?。！？…")
_CLOSERS = "\"'”’»）)]“"
_ODD = frozenset("|>·•★→©×✓›»=[]{};/_")
#: Columns that tell the element of a line; hidden in the second copy of the training lines.
ELEMENT = slice(0, 2)


def dom_lines(page: str) -> list[tuple[str, int, int, int]]:
    """(text, element, is link, container) of each non-blank line of the page's body; see containers for the numbers."""
    lines, _ = parse(page)
    return lines


def parse(page: str) -> tuple[list[tuple[str, int, int, int]], list[list]]:
    """The non-blank lines, and the containers as [tag, attributes, parent, depth]. Containers without end tag close with their parent."""
    body = _BODY.sub("", page, count=1)
    nodes: list[list] = [["body", "", -1, 0]]
    stack = [0]
    element, link, at = 0, 0, 0
    runs: list[tuple[str, int, int, int]] = []  # text between tags
    for m in _TAG.finditer(body):
        if m.start() > at:
            runs.append((body[at : m.start()], element, link, stack[-1]))
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if m[2]:
            if tag in _CONTAINERS:
                for k in range(len(stack) - 1, 0, -1):
                    if nodes[stack[k]][0] == tag:
                        del stack[k:]
                        break
            elif tag in _TEXTUAL:
                element = 0
            elif tag == "a":
                link = 0
        elif tag in _CONTAINERS:
            nodes.append([tag, m[4], stack[-1], len(stack)])
            stack.append(len(nodes) - 1)
        elif tag == "tr":
            while nodes[stack[-1]][0] == "td":
                stack.pop()
        elif tag in _TEXTUAL:
            element = _TEXTUAL[tag]
        elif tag == "a":
            link = 1
    if at < len(body):
        runs.append((body[at:], element, link, stack[-1]))
    lines: list[tuple[str, int, int, int]] = []
    text, first = "", None
    for run, e, a, c in runs:
        parts = run.split("\n")
        for i, part in enumerate(parts):
            if i:
                if text.strip():
                    lines.append((entities.unescape(text).strip(), *first))
                text, first = "", None
            if part:
                if first is None or (not text.strip() and part.strip()):
                    first = (e, a, c)
                text += part
    if text.strip():
        lines.append((entities.unescape(text).strip(), *first))
    return lines, nodes


def _norm(text: str) -> str:
    return " ".join(text.lower().split())


class Page:
    """A page's non-blank lines with their features; number: where each stands in raw_text; container and label per line."""

    def __init__(self, title, page, raw, counts, pages, name):
        self.without_dom = (title, None, raw, counts, pages, name)
        raw_lines = raw.replace("\r", "").split("\n")
        self.number = [i for i, x in enumerate(raw_lines) if x.strip()]
        texts = [raw_lines[i].strip() for i in self.number]
        n = len(texts)
        lines, nodes = parse(page) if page else ([], [])
        self.aligned = len(lines) == n and n > 0
        if not self.aligned:  # blocks of lines between blank ones stand for containers
            block, lines, nodes = 0, [], [["none", "", -1, 0]]
            for k, i in enumerate(self.number):
                if k and i > self.number[k - 1] + 1:
                    nodes.append(["none", "", -1, 0])
                lines.append((texts[k], 0, 0, len(nodes) - 1))
        self.texts, self.lines, self.nodes = texts, lines, nodes
        self.container = np.array([x[3] for x in lines], dtype=np.int64)
        self.element = np.array([x[1] for x in lines], dtype=np.int64)
        self.link = np.array([x[2] for x in lines], dtype=np.int64)
        self.title, self.name = _norm(title or ""), _norm(name or "")
        self.counts, self.pages = counts, max(pages or 1, 1)

    def labels(self) -> np.ndarray | None:
        """1 for lines of article elements in the headline's container; None where no headline is marked."""
        heads = [k for k, x in enumerate(self.element) if x == 3]
        if not self.aligned or not heads:
            return None
        main = self.container[heads[0]]
        ok = np.array([e in (1, 2, 3, 4) for e in self.element]) & (self.link == 0)
        inside = self.container == main
        for c in set(self.container.tolist()):  # lists and the like within it
            k = c
            while k > 0 and k != main:
                k = self.nodes[k][2]
            if k == main:
                inside |= self.container == c
        return (ok & inside).astype(float)

    def attributes(self) -> list[str]:
        """Of each line the tag and attribute tokens of its container, and after `>` those of its ancestors, all but the body's."""
        own = [" ".join([tag, *_TOKENS.findall(attr.lower())]) if parent >= 0 else "" for tag, attr, parent, _ in self.nodes]
        chain: list[str] = []
        for c, (_, _, parent, _) in enumerate(self.nodes):
            above = " ".join(chain[parent].replace(" > ", " ").split()) if parent >= 0 else ""
            chain.append(f"{own[c]} > {above}" if parent >= 0 else own[c])
        return [chain[c] for c in self.container]

    def features(self, odds: dict[str, float], attribute_odds: dict[str, float]) -> np.ndarray:
        n = len(self.texts)
        size = np.array([len(t) for t in self.texts], dtype=float)
        whole = size.sum() or 1.0
        groups = self.container
        m = int(groups.max()) + 1 if n else 1
        in_size = np.bincount(groups, size, m)
        in_link = np.bincount(groups, size * self.link, m)
        in_lines = np.bincount(groups, minlength=m).astype(float)
        longest = np.zeros(m)
        np.maximum.at(longest, groups, size * (1 - self.link))
        of_tree = np.stack([in_size, in_link, in_lines], axis=1)  # with all containers within
        for c in range(m - 1, 0, -1):
            if self.nodes[c][2] >= 0:
                of_tree[self.nodes[c][2]] += of_tree[c]
        tree_size, tree_link, tree_lines = of_tree.T
        plain = in_size - in_link
        order = np.argsort(-plain)
        rank = np.empty(m)
        rank[order] = np.arange(m)
        present = np.flatnonzero(in_lines)
        place = np.zeros(m)
        place[present] = (np.arange(len(present)) + 0.5) / max(len(present), 1)
        beside = np.zeros(m)  # the text of a container among that of all within its parent
        attrs = np.zeros((m, 6))
        for c, chain in zip(groups.tolist(), self.attributes()):
            if attrs[c, -2]:
                continue
            tag, attr, parent, depth = self.nodes[c]
            beside[c] = tree_size[c] / max(tree_size[parent], 1) if parent >= 0 else 1.0
            own, _, above = chain.partition(" > ")
            known = [attribute_odds[t] for t in own.split() if t in attribute_odds]
            higher = [attribute_odds[t] for t in above.split() if t in attribute_odds]
            attrs[c, 0] = sum(known) / len(known) if known else 0.0
            attrs[c, 1], attrs[c, 2] = min([*known, *higher, 0.0]), max([*known, *higher, 0.0])
            attrs[c, -3] = depth
            attrs[c, -2] = {"none": 0.5, "body": 1, "div": 2, "td": 3, "section": 4, "article": 5, "main": 5, "aside": 6, "nav": 7, "ul": 7, "ol": 7, "footer": 8, "header": 9}.get(tag, 1)
            attrs[c, -1] = 1.0 if "colspan" in attr else 0.0
        head = -1
        rows = np.zeros((n, 16))
        title = self.title
        log_pages = math.log(self.pages + 1)
        for k, t in enumerate(self.texts):
            low = _norm(t)
            same = 1.0 if title and (low == title or title.endswith(low) and len(low) > 8 or low.endswith(title)) else 0.0
            if same and low == title or (same and head < 0 and ">" not in low):
                head = k if head < 0 else head
            tokens = _WORDS.findall(low)
            known = [odds[w] for w in tokens if w in odds]
            count = self.counts.get(self.number[k], 1)
            tail = low.rstrip(_CLOSERS)
            digits = sum(map(str.isdigit, low))
            rows[k] = (
                same, math.log(len(low) + 1), len(tokens), 1.0 if tail and tail[-1] in _ENDS else 0.0, digits / len(low), sum(c in _ODD for c in low),
                1.0 if ":" in low or "：" in low else 0.0, 1.0 if _TIME.search(low) else 0.0, 1.0 if self.name and self.name in low else 0.0,
                math.log(count), count / self.pages, log_pages,
                sum(known) / (len(known) + 2) if known else 0.0, min(known) if known else 0.0, (k + 0.5) / n, 0.0,
            )
        rows[:, 15] = 0 if head < 0 else np.where(self.container != self.container[head], 3, np.where(np.arange(n) < head, 1, 2))
        g = groups
        return np.concatenate([
            np.stack([self.element, np.full(n, 1.0 if self.aligned else 0.0)], axis=1), rows,
            np.stack([self.link, in_link[g] / np.maximum(in_size[g], 1), in_size[g] / whole, plain[g] / max(plain.sum(), 1), np.log(in_lines[g]), np.log(longest[g] + 1), rank[g], place[g], in_size[g] / in_lines[g]], axis=1),
            attrs[g],
            np.stack([tree_link[g] / np.maximum(tree_size[g], 1), tree_size[g] / whole, np.log(tree_lines[g]), tree_size[g] / tree_lines[g], beside[g]], axis=1),
        ], axis=1)


def word_odds(pages: list[tuple[list[str], np.ndarray]], least: int = 3) -> dict[str, float]:
    """Log odds of each token to stand in article lines, from (texts, labels) of pages; each page counts a token once."""
    good, bad = Counter(), Counter()
    for texts, y in pages:
        a, b = set(), set()
        for t, v in zip(texts, y):
            (a if v else b).update(_WORDS.findall(_norm(t)))
        good.update(a)
        bad.update(b)
    n = len(pages) + 1
    return {w: math.log((good[w] / n + 0.02) / (bad[w] / n + 0.02)) for w in good.keys() | bad.keys() if good[w] + bad[w] >= least}


class Model:
    """trees judge lines of pages with html, blocks those of pages without; odds are those of words, attribute_odds those of tags and
    attribute tokens."""

    def __init__(self, trees: Trees | None, blocks: Trees | None, odds: dict[str, float], attribute_odds: dict[str, float]):
        self.trees, self.blocks, self.odds, self.attribute_odds = trees, blocks, odds, attribute_odds

    def article(self, pages: list[Page]) -> list[np.ndarray]:
        """Which lines of each page are the article's."""
        filled = [p for p in pages if p.texts]
        if not filled or self.trees is None:
            return [np.zeros(len(p.texts), dtype=bool) for p in pages]
        out = {}
        for trees, some in ((self.trees, [p for p in filled if p.aligned]), (self.blocks, [p for p in filled if not p.aligned])):
            if some:
                logit, at = trees.logit(np.concatenate([p.features(self.odds, self.attribute_odds) for p in some])), 0
                for p in some:
                    out[id(p)] = decode(p, logit[at : at + len(p.texts)])
                    at += len(p.texts)
        return [out.get(id(p), np.zeros(0, dtype=bool)) for p in pages]


def decode(page: Page, logit: np.ndarray) -> np.ndarray:
    """The likeliest labels in which lines are article only in containers that are, within ancestors that allow it.

    A container's own lines speak for it by the sum of their logits, weighed by the root of their length and limited to +-4 each.
    From the leaves up, a container's subtree has its own sum and those of the subtrees within that are positive; from the body
    down, a container is open if its parent is and its subtree is positive, and article if its own sum is positive too. A list
    shares the sum of the article that it stands in.
    """
    weight = np.sqrt([len(t) for t in page.texts])
    own = np.bincount(page.container, np.clip(logit, -4, 4) * weight, len(page.nodes))
    tree = own.copy()
    for c in range(len(own) - 1, 0, -1):
        parent = page.nodes[c][2]
        if parent >= 0:
            tree[parent] += max(tree[c], 0.0)
    is_open, total = np.ones(len(own), dtype=bool), own.copy()
    for c, (tag, _, parent, _) in enumerate(page.nodes):
        if parent < 0:  # the body, or a block of a page without html, has nothing above it
            continue
        shared = max(total[parent], 0.0) if tag in _LISTS and is_open[parent] else 0.0
        total[c] += shared
        is_open[c] = is_open[parent] and tree[c] + shared > 0
    return (logit > 0) & (is_open & (total > 0))[page.container]


def fit(pages: list[Page]) -> Model:
    """A model of those pages that mark their headline; without any it calls nothing article."""
    known = [(p, y) for p in pages if p.texts and (y := p.labels()) is not None and 0 < y.sum() < len(y)]
    if len(known) < 4:
        return Model(None, None, {}, {})
    halves = [_odds([pair for k, pair in enumerate(known) if k % 2 != h]) for h in (0, 1)]
    x = np.concatenate([p.features(*halves[k % 2]) for k, (p, _) in enumerate(known)])
    y = np.concatenate([y for _, y in known])
    hidden = x.copy()
    hidden[:, ELEMENT.start] = 0
    trees = Trees().fit(np.concatenate([x, hidden]), np.concatenate([y, y]))
    bare = [(Page(*p.without_dom).features(*halves[k % 2]), y) for k, (p, y) in enumerate(known) if k % 4 < 2]
    blocks = Trees().fit(np.concatenate([b for b, _ in bare]), np.concatenate([v for _, v in bare]))
    return Model(trees, blocks, *_odds(known))


def _odds(known: list[tuple[Page, np.ndarray]]) -> tuple[dict[str, float], dict[str, float]]:
    """The log odds of words and of tags and attribute tokens."""
    return word_odds([(p.texts, y) for p, y in known]), word_odds([(p.attributes(), y) for p, y in known])


def _pages(pdf: pd.DataFrame) -> list[Page]:
    out = []
    for title, page, raw, counts, pages, name in zip(pdf["title"], pdf["html"], pdf["raw_text"], pdf["counts"], pdf["pages"], pdf["site_name"]):
        of = {c["line_no"]: c["n"] for c in counts} if counts is not None else {}
        known = pages if pages == pages and pages is not None else 1
        out.append(Page(*(x if isinstance(x, str) else None for x in (title, page)), raw, of, int(known), name if isinstance(name, str) else None))
    return out


def _described(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """(page_id, title, html, raw_text, counts, pages, site_name) of the current pages with text: counts are the lines that other
    pages of the site have too, and on how many pages; pages is the number of the site's pages."""
    lines = cut(page_lines(pages))
    known = lines.filter("site is not null")
    counts = known.select("site", F.explode(F.array_distinct("hashes")).alias("h")).filter("h is not null")
    counts = counts.groupBy("site", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    each = known.select("page_id", "site", F.posexplode("hashes").alias("line_no", "h")).filter("h is not null").join(counts, ["site", "h"])
    by_page = each.groupBy("page_id").agg(F.collect_list(F.struct("line_no", "n")).alias("counts"))
    sizes = known.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    names = sites.filter("host is not null").groupBy("host").agg(F.min("site_name").alias("site_name")).withColumnRenamed("host", "site")
    of_page = lines.select("page_id", "site").join(sizes.join(names, "site", "left"), "site", "left").drop("site")
    current = current_pages(pages, "title", "html", "raw_text").filter("raw_text is not null")
    return current.join(by_page, "page_id", "left").join(of_page, "page_id", "left")


def fitted(described: DataFrame, max_pages: int = MAX_PAGES) -> Model:
    """The model of a sample by hash of the pages that mark their headline."""
    marked = described.filter(F.lower("html").contains("<h1")).withColumn("order", F.xxhash64("page_id"))
    last = marked.select("order").orderBy("order").limit(max_pages).agg(F.max("order")).first()[0]
    if last is None:
        return Model(None, None, {}, {})
    return fit(_pages(marked.filter(F.col("order") <= last).orderBy("order").limit(max_pages).drop("order").toPandas()))


def article_lines(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """(page_id, line_no): the lines of each current page's raw_text that are its own article.

    Pages with null raw_text have none; without html, or with html that has other lines than raw_text, blocks of lines between
    blank ones stand for containers; pages without url or title are judged without them; very long texts are read whole; older
    fetches and copies are left out; an empty table, or one without any page that marks its headline, gives no rows; further
    columns don't matter.
    """
    rows = cut(_described(pages, sites))
    model = pages.sparkSession.sparkContext.broadcast(fitted(rows))

    def found(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                some = _pages(part)
                ids, numbers = [], []
                for page_id, p, y in zip(part["page_id"], some, model.value.article(some)):
                    at_lines = np.array(p.number, dtype=np.int64)[y]
                    ids.append(np.full(len(at_lines), page_id, dtype=np.int64))
                    numbers.append(at_lines)
                yield pd.DataFrame({"page_id": np.concatenate(ids), "line_no": np.concatenate(numbers).astype(np.int32)})

    return rows.mapInPandas(found, "page_id bigint, line_no int")


def main_texts(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """(page_id, text, n_lines): the article of every current page with text, its lines joined by line ends; empty where there is none."""
    kept = article_lines(pages, sites).groupBy("page_id").agg(F.collect_set("line_no").alias("kept"))
    rows = current_pages(pages, "raw_text").filter("raw_text is not null").join(kept, "page_id", "left")
    lines = F.filter(F.split("raw_text", "\n", -1), lambda x, i: F.coalesce(F.array_contains("kept", i), F.lit(False)))
    return rows.select("page_id", F.array_join(lines, "\n").alias("text"), F.when(F.col("kept").isNull(), 0).otherwise(F.size("kept")).alias("n_lines"))
