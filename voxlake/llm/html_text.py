"""Main text of web pages by minimum cut.

A page is read as a row of text blocks. A naive Bayes classifier gives each block its cost of being content or boilerplate,
from figures of its text (length, share of links, headings, punctuation, case) and from the names around it (semantic elements
and the words of class, id and role attributes). Names are figures like the others, with learned weights: those of one
element add up and are clipped, and an outer element counts `OUTER` of the one inside it. All costs have one scale and are
the terminal capacities; edges between neighbours, and between a block and the last one of its parent element, are the
stronger the nearer both lie in the tree and the less their names differ. The minimum cut, found by maximum flow, keeps the
blocks on the side of the source. No block goes by its name alone: running text with an odd name in an article stays, a block of
doubtful text goes with its neighbours. Only an advert's span within a line is left out where it stands.

Trained here on at most about `sample` pages (a documented bound, for the classifier only), by counts in one aggregate:
on a page with an article or main element, blocks outside of it count as boilerplate and those inside as content, unless
a name known for boilerplate stands between. What is seen rarely keeps its prior weight. A quarter of the sample is held
out: on it names are hidden, and the strength of the edges is the one of `STRENGTHS` with the most blocks right. Every page
is cut over its whole html, in Spark tasks; a page's graph has as many nodes as it has blocks and twice as many edges.

Defined cases: null or empty html, or a page without content, gives an empty text; unclosed or stray tags are taken as
they come (an unclosed script reaches to the end of the page); repeated rows and null ids are extracted each; without any
page to learn from the prior weights decide; of several minimum cuts the one that keeps most is taken; of elements nested
deeper than `DEEP` around a block only the innermost ones tell how near blocks lie; other columns are not looked at.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, deque
from collections.abc import Iterator
from math import exp, log, tanh

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed, sampled

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|[^<]+|<", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORD = re.compile(r"[a-z]+")
#: Elements whose content is no text of the page.
SILENT = frozenset("script style noscript template svg iframe select option textarea button title head audio video annotation annotation-xml".split())
RAW = frozenset("script style noscript template svg iframe textarea title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br canvas cite code data del dfn em font i img ins kbd label mark object q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input meta link base "
    "math semantics mi mn mo ms mtext mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Prior weights of names, for names that are seen rarely: sure, doubtful and good ones.
SURE, DOUBTFUL, GOOD = -8.0, -4.0, 1.5
PRIOR = (
    {f"<{t}>": SURE for t in "nav footer aside header form menu dialog".split()}
    | dict.fromkeys(
        "ad ads advert adverts advertisement advertising sponsor sponsored banner nav navbar navigation menu breadcrumb breadcrumbs footer masthead sidebar aside cookie cookies consent gdpr notice popup "
        "modal newsletter comment comments commentlist disqus pagination pager toolbar complementary contentinfo".split(),
        SURE,
    )
    | dict.fromkeys("header widget promo promotion related recommended share sharing social alert subscribe subscription signup login form search reply replies respond responses copyright legal".split(), DOUBTFUL)
    | {"<article>": 2.2, "<main>": 2.2}
    | dict.fromkeys("article main content post entry story body text".split(), GOOD)
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are a block each: their names say less than those of an element around many blocks.
LINES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th".split())
ADVERT = frozenset("ad ads advert adverts advertisement advertising sponsored".split())
LAYOUT = frozenset("with without has no".split())
#: Prior weights of figures of the text.
TEXT_PRIOR = {"words 1": -1.5, "words 3": -0.8, "words 8": 0.8, "words 20": 1.4, "words 60": 1.8, "links most": -2.0, "links some": -0.2, "links none": 0.8, "heading True": 0.8, "end True": 0.8, "end False": -0.4, "comma True": 0.6, "sign True": -0.6}
#: A figure of the text counts for FIGURE at most, all of them bend towards TEXT; names of an element are cut to LEAST and MOST.
FIGURE, TEXT, LEAST, MOST = 2.0, 2.5, -4.0, 2.2
#: What an element's names count for those inside it, and how often a name is seen when prior and counts weigh the same.
OUTER, TRUST = 0.25, 20
DEEP, SIBLING = 8, 0.3
STRENGTHS = (1.0, 0.5, 2.0, 0.25, 0.0)  # of equal ones the first


class Scope:
    """What the names of an element and those around it say of a block in it; `side` is 1 within an article, -1 beside it in boilerplate."""

    __slots__ = ("outer", "names", "weight", "side")

    def __init__(self, outer: Scope | None, names: tuple[str, ...], weight: float, side: int):
        self.outer, self.names, self.weight, self.side = outer, names, weight, side


class Block:
    __slots__ = ("text", "links", "tag", "path", "scope")

    def __init__(self, text: str, links: int, tag: str, path: tuple[int, ...], scope: Scope):
        self.text, self.links, self.tag, self.path, self.scope = text, links, tag, path, scope


def _words(attributes: str) -> list[str]:
    """The words of an element's names; `with-sidebar` and the like tell of a page's layout, not of the element."""
    if "=" not in attributes:
        return []
    values = [t for m in NAMES.finditer(attributes) for t in (m[1] or m[2] or m[3] or "").lower().split()]
    found = (WORD.findall(t) for t in values)
    return [w for ws in found if ws and ws[0] not in LAYOUT for w in ws]


def _inside(tag: str, attributes: str, outer: Scope, names: dict[str, float]) -> Scope:
    """The scope of an element: that around it, if it has no name of weight."""
    tags = [f"<{tag}>"] if f"<{tag}>" in PRIOR and not (tag == "header" and outer.side == 1) else []
    words = _words(attributes) if tag not in ("html", "body") else []
    own = tags + words
    if not own:
        return outer
    # each name for itself is bounded, and an element's tag takes nothing from its classes: a reader's comment may be an article
    total = lambda of, weights: sum(max(LEAST, min(MOST, weights.get(w, 0.0))) for w in {*of})
    by_tag, by_words = total(tags, names), total(words, names)
    weight = (by_words if by_tag > 0 > by_words else by_words + by_tag) / (2 if tag in LINES else 1)
    weight = max(LEAST, min(MOST, weight))
    said = total(words, PRIOR)
    bad = said < 0 or said + total(tags, PRIOR) < 0
    side = -1 if bad else 1 if tag in ("article", "main") and outer.side >= 0 else outer.side
    if weight > 0 > outer.side:
        weight = outer.weight + OUTER * weight  # a teaser within a sidebar is named article too
    elif weight:
        weight += OUTER * outer.weight
    return Scope(outer, (*own,), weight or outer.weight, side)


def blocks(page: str | None, names: dict[str, float] = PRIOR) -> list[Block]:
    """The text blocks of a page in order; `names` are the weights of names."""
    out: list[Block] = []
    stack: list[tuple[str, int, Scope]] = [("", 0, Scope(None, (), 0.0, 0))]  # tag, number, names
    spans: list[bool] = []  # open spans: whether within an advert
    texts, links, in_link, silent, number = [], 0, 0, "", 0

    def flush() -> None:
        nonlocal texts, links
        text = " ".join("".join(texts).split())
        if text:
            out.append(Block(text, links, stack[-1][0], tuple(x[1] for x in stack[-DEEP:]), stack[-1][2]))
        texts, links = [], 0

    at, page = 0, page or ""
    while m := TOKEN.match(page, at):
        at = m.end()
        tag = m[2]
        if tag is None:
            t = m[0]
            if t.startswith(("<!", "<?")) or silent:
                continue
            t = entities.unescape(t)
            if spans and spans[-1]:
                continue  # an advert within a line is no block of its own
            texts.append(t)
            if in_link:
                links += len(t.strip())
            continue
        tag = tag.lower()
        closing = bool(m[1])
        if silent:
            if closing and tag == silent:
                silent = ""
            elif silent == "head" and tag == "body" and not closing:
                silent = ""
            else:
                continue
            if silent or tag != "body":
                continue
        if tag in SILENT and not closing:
            if m[3].rstrip().endswith("/"):
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            else:
                silent = tag
            continue
        if tag == "a":
            in_link = 0 if closing else 1
            continue
        if tag in INLINE:
            if tag in ("br", "img", "wbr"):
                texts.append(" ")
            elif tag == "span":
                if not closing:
                    spans.append(bool(spans and spans[-1]) or not ADVERT.isdisjoint(_words(m[3])))
                elif spans:
                    spans.pop()
            continue
        flush()
        spans.clear()
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        elif tag not in VOID:
            if tag in CLOSES_P and stack[-1][0] == "p" or tag == "li" and stack[-1][0] == "li":
                stack.pop()
            number += 1
            if not m[3].rstrip().endswith("/"):
                stack.append((tag, number, _inside(tag, m[3], stack[-1][2], names)))
    flush()
    return out


def figures(b: Block) -> list[str]:
    """The names of what holds for a block."""
    n, share = b.text.count(" ") + 1, b.links / len(b.text)
    upper = sum(c.isupper() for c in b.text) / len(b.text)
    return [
        "words " + ("1" if n < 3 else "3" if n < 8 else "8" if n < 20 else "20" if n < 60 else "60"),
        "links " + ("none" if not share else "some" if share < 0.4 else "most"),
        "heading " + str(b.tag in HEADINGS),
        "end " + str(b.text[-1] in ".!?:;\"'”’)"),
        "comma " + str("," in b.text),
        "upper " + ("low" if upper < 0.1 else "high"),
        "sign " + str(bool(re.search("[©®|·»]", b.text))),
    ]


def _seen(page: list[Block]) -> Iterator[tuple[str, int]]:
    """(figure or name, side) of the blocks whose side is known: those of a page with an article or main element."""
    if not any(b.scope.side == 1 for b in page):
        return
    for b in page:
        side, scope, names = b.scope.side, b.scope, set()
        while scope:
            names.update(f"name {w}" for w in scope.names)
            if side == -1 and scope.side == 1:
                side = 0  # doubtful names within an article
            scope = scope.outer
        side = -1 if not side and b.scope.side == 0 else side
        if side:
            for f in ("", *figures(b), *names):
                yield f, side


def fit(pages: DataFrame, sample: int = 2000) -> dict:
    """The model from about `sample` pages at most: weights of figures and names, and the strength of the edges."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen = Counter(x for page in pdf["html"] for x in _seen(blocks(page)))
            yield pd.DataFrame([(f, side, k) for (f, side), k in seen.items()], columns=["figure", "side", "n"])

    n = pages.select("page_id").count()
    chosen = pages.filter(sampled("page_id", sample / max(n, 1))).select("html", (hashed("page_id") % 4 == 0).alias("held"))
    got = chosen.filter("not held").select("html").mapInPandas(count, "figure string, side int, n long").groupBy("figure", "side").agg(F.sum("n").alias("n"))
    model = weighed({(r["figure"], r["side"]): r["n"] for r in got.collect()})

    def right(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hits = [0] * len(STRENGTHS)
            for page in pdf["html"]:
                found = blocks(page)
                known = [b.scope.side if any(x.scope.side == 1 for x in found) else 0 for b in found]
                bare = [Block(b.text, b.links, b.tag, b.path, Scope(None, (), 0.0, 0)) for b in found]
                for k, strength in enumerate(STRENGTHS):
                    keep = kept(bare, model | {"strength": strength})
                    hits[k] += sum(x == (y > 0) for x, y in zip(keep, known, strict=True) if y)
            yield pd.DataFrame({"k": range(len(hits)), "n": hits})

    hits = {r["k"]: r["n"] for r in chosen.filter("held").select("html").mapInPandas(right, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}
    return model | {"strength": STRENGTHS[max(range(len(STRENGTHS)), key=lambda k: (hits.get(k, 0), -k))]}


def weighed(counts: dict[tuple[str, int], int]) -> dict:
    """Weights from counts of figures and names among content (1) and boilerplate (-1): log odds, drawn to the prior by `TRUST`."""
    good, bad = counts.get(("", 1), 0), counts.get(("", -1), 0)
    prior = TEXT_PRIOR | {f"name {w}": x for w, x in PRIOR.items()}
    out = dict(prior)
    for f in sorted({f for f, _ in counts} - {""}):
        a, b = counts.get((f, 1), 0), counts.get((f, -1), 0)
        seen = log((a + 1) / (good + 2)) - log((b + 1) / (bad + 2))
        out[f] = (seen * (a + b) + prior.get(f, 0.0) * TRUST) / (a + b + TRUST) if good and bad else prior.get(f, 0.0)
    names = {f[5:]: x for f, x in out.items() if f.startswith("name ")}
    return {"text": {f: max(-FIGURE, min(FIGURE, x)) for f, x in out.items() if not f.startswith("name ")}, "names": names, "strength": STRENGTHS[0]}


def costs(page: list[Block], model: dict) -> list[float]:
    """How much better each block is as content than as boilerplate, from -TEXT + LEAST * (1 + OUTER) upwards."""
    learned = [sum(model["text"].get(f, 0.0) for f in figures(b)) for b in page]
    return [TEXT * tanh(x / (2 * TEXT)) + b.scope.weight for x, b in zip(learned, page, strict=True)]


def edges(page: list[Block], strength: float) -> dict[tuple[int, int], float]:
    """Smoothness: between neighbours by nearness in the tree, and between a block and the last one of the same parent."""
    out: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(page):
        if not strength:
            break
        parent = b.path[-2] if len(b.path) > 1 else -1
        alike = lambda j: strength * exp(-abs(page[j].scope.weight - b.scope.weight) / 2)  # noqa: B023, E731
        if i:
            other = page[i - 1].path
            common = {*b.path} & {*other}
            steps = max(next((k for k, x in enumerate(reversed(p)) if x in common), DEEP) for p in (b.path, other))
            out[i - 1, i] = alike(i - 1) / max(1, steps) ** 2
        if parent in last and (j := last[parent]) != i - 1:
            out[j, i] = SIBLING * alike(j)
        last[parent] = i
    return out


def minimum_cut(gains: list[float], links: dict[tuple[int, int], float]) -> list[bool]:
    """Whether each node stays with the source; capacities are gains (source) or losses (sink) and the links, both ways.

    Of several minimum cuts the one with the most nodes at the source, found from the sink's side of the residual graph.
    """
    n = len(gains)
    if all(g >= 0 for g in gains) or all(g < 0 for g in gains):
        return [g >= 0 for g in gains]
    source, sink = n, n + 1
    cap: list[dict[int, float]] = [{} for _ in range(n + 2)]
    for i, g in enumerate(gains):
        if g > 0:
            cap[source][i], cap[i][source] = g, 0.0
        elif g < 0:
            cap[i][sink], cap[sink][i] = -g, 0.0
    for (i, j), c in links.items():
        cap[i][j] = cap[i].get(j, 0.0) + c
        cap[j][i] = cap[j].get(i, 0.0) + c
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for v, c in cap[u].items():
                if c > 1e-9 and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            break
        rest = {u: list(cap[u]) for u in level}
        path, u = [], source
        while True:  # a blocking flow along the levels
            if u == sink:
                push = min(cap[a][b] for a, b in path)
                for a, b in path:
                    cap[a][b] -= push
                    cap[b][a] += push
                cut = next(k for k, (a, b) in enumerate(path) if cap[a][b] <= 1e-9)
                u = path[cut][0]
                del path[cut:]
                continue
            while rest[u]:
                v = rest[u][-1]
                if cap[u][v] > 1e-9 and level.get(v) == level[u] + 1:
                    break
                rest[u].pop()
            if rest[u]:
                path.append((u, rest[u][-1]))
                u = rest[u][-1]
            elif u == source:
                break
            else:
                u, v = path.pop()
                rest[u].pop()
    lost, queue = {sink}, deque([sink])
    while queue:
        v = queue.popleft()
        for u in cap[v]:
            if u not in lost and cap[u].get(v, 0.0) > 1e-9:
                lost.add(u)
                queue.append(u)
    return [i not in lost for i in range(n)]


def kept(page: list[Block], model: dict) -> list[bool]:
    return minimum_cut(costs(page, model), edges(page, model["strength"]))


def main_text(page: str | None, model: dict) -> str:
    found = blocks(page, model["names"])
    return "\n".join(b.text for b, k in zip(found, kept(found, model), strict=True) if k)


def turned(page: str | None, model: dict, names: bool = True) -> tuple[int, int]:
    """Blocks that the cut puts on another side than their own cost does, and all blocks; without `names` those are hidden."""
    found = blocks(page, model["names"] if names else {})
    return sum(k != (x >= 0) for k, x in zip(kept(found, model), costs(found, model), strict=True)), len(found)


def extract(pages: DataFrame, model: dict) -> DataFrame:
    """page_id, url and text (the content blocks, one a line) of every row of `pages`."""

    @F.pandas_udf("string")
    def udf(column: pd.Series) -> pd.Series:
        return column.map(lambda p: main_text(p, model))

    return pages.select("page_id", "url", udf("html").alias("text"))
