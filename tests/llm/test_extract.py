"""Main text of pages: hand-made pages of many layouts, defined cases, and held-out pages of other words and lengths."""

import random
import time

import numpy as np
import pytest

from veracity.llm import extract as ex

MENU = "<ul><li><a href=/a>Home</a><li><a href=/b>About us</a></ul>"


@pytest.fixture(scope="module")
def tree(spark):
    return ex.train(ex.text_blocks(ex.labelled_table(spark)))


def text(tree, page):
    found = ex.blocks(page)
    return "\n".join(b.text for b, k in zip(found, tree.keeps(ex.describe(found)), strict=True) if k)


LONG = "The river rose through the night and by morning the lower fields lay under water, so that nobody could reach the mill."
PAGES = {
    "short blocks of an article stay": (f"<nav>{MENU}</nav><article><h1>Flood</h1><p>{LONG}<p>Yes.<p>No</article><footer>&copy; 2020 The Paper of Record and all its contributors everywhere</footer>", f"Flood\n{LONG}\nYes.\nNo"),
    "advert, share, sidebar, form inside": (f"<article><p>{LONG}</p><div class='ad-slot'>Buy our fine umbrellas today</div><aside>{LONG}</aside><form><p>{LONG}</p><input><textarea>x</textarea></form><ul class=share><li>Post</ul><p>End.</p></article>", f"{LONG}\nEnd."),
    "reader comments": (f"<main><p>{LONG}</p><section id='comments'><h2>2 comments</h2><article class='comment'><p>{LONG}</p></article><p>{LONG}</p></section></main>", LONG),
    "notices and hidden": (f"<div class='cookieNotice'>{LONG}</div><div hidden>{LONG}</div><p style='display: none'>{LONG}</p><main><p>{LONG}</p></main>", LONG),
    "scripts and styles": ("<head><title>T</title><style>p{}</style><script>if (a<b) document.write('</p><p>no')</script></head><article>a<script>x</script>b<SCRIPT>y</SCRIPT >c<noscript>d</noscript><!-- <p>e -->f<template>g</template></article>", "abcf"),
    "references": ("<article><p>a &lt;b&gt; &amp;amp; &copy;&nbsp;2020 &#x41;&#66; &eacute &am &bogus; AT&T</p></article>", "a <b> &amp; © 2020 AB é &am &bogus; AT&T"),
    "white space and line breaks": ("<article><p> a\n\tb<br>c  <b>d</b>e <i> f</i> </p>\n\n<p> </p>g</article>", "a b c de f\ng"),
    "attributes with signs": ("<article><p title='a > b' data-x=\"<p>\">one</p><p title=>two</p><img alt='x>y'>three<a href=x>four</a></article>", "one\ntwo\nthreefour"),
    "never closed": (f"<nav><a href=/>x<article><p>{LONG}<p><b>Bold<p>more", f"{LONG}\nBold\nmore"),
    "cut off": ("<article><p>one</p><p>two <a hre", "one\ntwo"),
    "open comment": ("<article><p>one</p><!-- <p>two</p>", "one"),
    "not a tag": ("<article><p>1 < 2 <3 </> <? php> <!doctype x> 4</p></article>", "1 < 2 <3 4"),
    "no article": (f"<div>{MENU}</div><h1>A flood in the lower valley</h1><p>{LONG} {LONG}</p><p>{LONG}</p><div><a href=/>More</a> <a href=/>Next</a></div><div>All rights</div>", f"A flood in the lower valley\n{LONG} {LONG}\n{LONG}"),
    "content by name": (f"<div id=top-menu>{MENU}</div><div class='post-content'><p>Hello.</p><p>{LONG}</p></div><div id=sidebar>{LONG}</div><div class=footer>{LONG}</div>", f"Hello.\n{LONG}"),
    "a form around all": (f"<form id=aspnetForm><div class=menu>{MENU}</div><article><p>{LONG}</p></article></form>", LONG),
    "article's own header": (f"<header><h1>The Site</h1><p>Est. 1900</p></header><article><header><h1>Flood</h1><p>By A. Person</p></header><p>{LONG}</p></article>", f"Flood\n{LONG}"),
    "only boilerplate": (f"<nav>{MENU}</nav><footer>{LONG}</footer>", ""),
    "nested same inline tags": (f"<article><p>a <span class=ad>x <span>y</span> z</span> b</p><p>{LONG}</p></article>", f"a\nb\n{LONG}"),
    "no markup": (LONG, LONG),
    "blank": (" \n ", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(tree, name):
    page, want = PAGES[name]
    assert text(tree, page) == want


def test_held_out_layouts(tree):
    """Pages put together from other lengths and words than the labelled table's."""
    rnd, right, total = random.Random(3), 0, 0
    around = ["<nav>{}</nav>", "<footer><p>{}</p></footer>", "<div class='ads top'>{}</div>", "<aside><p>{}</p></aside>", "<div class='cookie-bar'>{}</div>", "<section class='comments'><p>{}</p></section>", "<div role=banner>{}</div>", "<form><p>{}</p></form>", "<div class='related-posts'><a href=/>{}</a></div>"]
    for _ in range(300):
        words = lambda: " ".join(rnd.choice("lorem ipsum dolor sit amet".split()) for _ in range(rnd.choice([1, 2, 5, 9, 20, 60, 150])))
        kept = [words() for _ in range(rnd.randint(1, 9))]
        inner = "".join(f"<{t}>{w}</{t}>" + (rnd.choice(around).format(words()) if rnd.random() < 0.2 else "") for w in kept for t in [rnd.choice(["p", "div", "h2", "li", "blockquote"])])
        shell = rnd.choice(["<article>{}</article>", "<main>{}</main>", "<div role=main>{}</div>", "<div class=entry-content>{}</div>"])
        outer = [rnd.choice(around).format(words()) for _ in range(4)]
        right += text(tree, "".join(outer[:2]) + shell.format(inner) + "".join(outer[2:])) == "\n".join(kept)
        total += 1
    assert right == total


def test_rows(spark, tree):
    rows = [(1, "u", PAGES["cut off"][0], 9), (1, "u", PAGES["cut off"][0], 9), (None, None, None, None), (2, "v", "", 1), (3, None, "<article><p>é\U0001f600</p></article>", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in ex.extract(df, tree).collect()), key=repr)
    assert got == sorted([(1, "u", "one\ntwo", 7), (1, "u", "one\ntwo", 7), (None, None, "", 0), (2, "v", "", 0), (3, None, "é\U0001f600", 2)], key=repr)
    assert ex.extract(df.limit(0), tree).count() == 0 and ex.text_blocks(df).count() == 5


def test_time_is_linear(tree):
    began = time.time()
    for part in ("<p>word ", "<b><div>", "<!-- ", "<a href='", "</div>", "<div class=ad>", "&am", "<x =\"'", "<script>", "<"):
        text(tree, part * 60_000)
    assert time.time() - began < 40


def test_tree():
    """Against every single split, and exact on what splits can tell."""
    rnd = np.random.default_rng(0)
    x = rnd.integers(0, 6, (400, 12)).astype(float)
    y = (x[:, 3] > 2) ^ (x[:, 7] > 3)
    assert (ex.Tree.fit(x, y, depth=12, leaf=1).keeps(x) == y).all()
    stump = ex.Tree.fit(x, x[:, 5] > 1, depth=1)
    assert stump.feature[0] == 5 and stump.threshold[0] == 1.5
    empty = ex.Tree.fit(x[:0], y[:0])
    assert not empty.keeps(x).any() and len(empty.keeps(x[:0])) == 0
