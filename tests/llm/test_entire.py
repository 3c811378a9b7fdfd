"""The licence and main-text operators on entire texts and blocks."""

import itertools
import random
import re
import textwrap
from collections import Counter

import pytest

from voxlake.llm import html_text, licenses


def test_entire_licences_wrapped_anew(spark):
    names, texts = [], []
    for name, text in licenses.entire_texts():
        for width in (25, 40, 60, 61, 63, 70, 72, 76, 79, 80, 100):
            parts = re.split(r"\n\s*\n", text)  # lines of a statement or a title stay as they are
            parts = [p if re.search(r"(?i)copyright +(\(c\)|\[yyyy)|^ *all rights", p) else textwrap.fill(" ".join(p.split()), width, break_long_words=False) for p in parts]
            names.append(name)
            texts.append("Copyright (c) 2020 Me & Co.\nCopyright Someone Else\nAll rights reserved.\n\n" + "\n\n".join(parts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["license_id"] for r in licenses.scan(df).orderBy("doc_id").collect()]
    assert got == names and {*names} == {"MIT", "ISC", *licenses.ENTIRE}
    one = "copyright notice and this permission notice appear in all copies."
    assert [bool(re.search(licenses.STATEMENT, x.strip("."))) for x in (one, "copyright holders be liable", "copyright the software and", "copyright c 2020 me", "copyright 2020", "copyright me", "c 2020 me")] == [False] * 3 + [True] * 4


def test_capitals_of_a_whole_block():
    block = html_text.Block("x " * 1000 + "LOUD " * 1000, 0, "p", (), html_text.Scope(None, (), 0.0, 0))
    assert "upper high" in html_text.figures(block)


RUN = "This is a running text, with a comma and enough words to be read as such."
NAV = '<html><body><nav><ul><li><a href="/">Home</a><li><a href="/x">More</a></ul></nav><div class="ad">Buy this, it is a very good thing.</div>'


def model(pages=()):
    return html_text.weighed(Counter(x for p in pages for x in html_text._seen(html_text.blocks(p))))


@pytest.mark.parametrize("pages", [(), [f"{NAV}<article><h1>A title</h1><p>{RUN}<p>{RUN}</article><footer>&copy; us</footer>"] * 300], ids=["prior", "learned"])
def test_what_an_article_keeps(pages):
    m = model(pages)
    keeps = [
        (f'<p class="story-related">{RUN}</p>', RUN),
        (f'<p id="related">{RUN}</p>', RUN),
        (f'<div class="entry text alert-content">{RUN}</div>', RUN),
        (f'<p class="share price">{RUN}</p>', RUN),
        ("<p>Formula <math><mi>x</mi><mo>=</mo><mn>2</mn></math> here</p>", "Formula x=2 here"),
        ("<p>See <object>the fall-back</object> here</p>", "See the fall-back here"),
        ("<ul><li>One item<li>Two items<li>Three</ul>", "One item\nTwo items\nThree"),
        ("<table><tr><td>a cell<td>b</table>", "a cell\nb"),
        ("<header><p>by Someone</p></header>", "by Someone"),
        (f'<p>{RUN} <span class="ad">Buy now.</span></p>', RUN),
    ]
    drops = [f"<{x}<p>{RUN}</p></{x.split()[0].rstrip('>')}>" for x in ("aside>", "form>", "footer>", "nav>", 'div class="ad">', 'div class="cookie-notice">', 'section class="comments">', 'div id="sidebar-left">', 'section class="related">')]
    drops += ["<script>var x = '</p>" + RUN + "'</script>", "<style>p{}</style>", f'<section class="related"><article><p>{RUN}</article></section>']
    for inner, want in [*keeps, *((d, "") for d in drops)]:
        page = f"{NAV}<article><h1>A title</h1><p>{RUN}</p>{inner}<p>{RUN}</p></article><footer>&copy; us"
        assert html_text.main_text(page, m) == "\n".join(x for x in ("A title", RUN, want, RUN) if x), inner


def test_extraction_of_unnamed_pages_equals_brute_force():
    rng, m = random.Random(4), model([f"{NAV}<article><h1>A title</h1><p>{RUN}<p>Short.</article><footer>&copy; us</footer>"] * 100)
    texts = [RUN, "Short.", "<a href=x>Home</a>", "A few words, not more", "<a href=x>All</a> | <a href=y>About</a>", RUN + " " + RUN]
    turned = 0
    for _ in range(120):
        page = "".join(f"<div>{''.join(f'<p>{rng.choice(texts)}</p>' for _ in range(rng.randint(1, 4)))}</div>" for _ in range(rng.randint(1, 3)))
        found = html_text.blocks(page, m["names"])
        gains, links = html_text.costs(found, m), html_text.edges(found, m["strength"])
        cost = lambda x: sum(max(0, -g) if k else max(0, g) for g, k in zip(gains, x, strict=True)) + sum(w for (i, j), w in links.items() if x[i] != x[j])  # noqa: B023, E731
        best = min(itertools.product([True, False], repeat=len(found)), key=cost)
        assert html_text.main_text(page, m) == "\n".join(b.text for b, k in zip(found, best, strict=True) if k)
        turned += html_text.turned(page, m)[0]
    assert turned > 20  # the cut decides, not each block's own cost


def test_odd_pages():
    m = model()
    assert html_text.main_text('<div class="x">' * 3000 + "<p>" + RUN, m) == RUN  # nested deeply, never closed
    assert html_text.main_text(f"<p>{RUN}</p><script>var x = 1; <p>{RUN}", m) == RUN  # an unclosed script takes the rest
    assert html_text.main_text(f"<p>{RUN}</p>" * 4000, m) == "\n".join([RUN] * 4000)
    assert html_text.main_text(" <p> </p> <br>", m) == "" and html_text.main_text(None, m) == ""
