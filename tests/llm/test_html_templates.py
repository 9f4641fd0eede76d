"""Hand-made pages of independent templates, with misleading words on their outer tags."""

import pytest

pytest.importorskip("decidra.llm")
from decidra.llm import html_extract  # noqa: E402
from decidra.llm.html_blocks import blocks, vectors  # noqa: E402

MAIN = ["How the old mill was saved"] + [
    f"{a} the people of the valley {b}, and for that they needed more than money and patience." for a, b in
    zip(["In spring", "Later", "By summer,", "After that", "For years", "At last"], ["met at the river", "wrote to the council", "repaired the wheel", "found the plans", "told each other stories", "opened the doors"])
]
P = "".join(f"<p>{x}</p>" for x in MAIN[1:])
H = f"<h1>{MAIN[0]}</h1>"
NAV = '<ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/c">Contact</a></li></ul>'
FOOT = "<p>&copy; 2024 Valley Times &middot; All rights reserved</p>"
ASIDE = '<h3>Related</h3><ul><li><a href="/1">Ten bridges</a></li><li><a href="/2">The mayor speaks</a></li></ul>'
COMMENTS = '<h2>Comments</h2><div class="comment"><b>anna</b><p>What a lovely story, thank you.</p></div><div class="comment"><b>ben</b><p>I was there when it opened!</p></div>'
TEMPLATES = {
    "article": f"<nav>{NAV}</nav><article>{H}{P}</article><footer>{FOOT}</footer>",
    "main": f"<nav>{NAV}</nav><main>{H}{P}</main><footer>{FOOT}</footer>",
    "wrapped": f'<div class="OUTER"><nav>{NAV}</nav><article>{H}{P}</article><footer>{FOOT}</footer></div>',
    "twice": f'<div id="OUTER"><div class="site"><header><nav>{NAV}</nav></header><main class="OUTER"><article>{H}{P}</article></main></div><footer>{FOOT}</footer></div>',
    "aside": f'<nav>{NAV}</nav><div class="OUTER"><article>{H}{P}</article><aside class="sidebar">{ASIDE}</aside></div><footer>{FOOT}</footer>',
    "div post": f'<div class="menu">{NAV}</div><div class="post">{H}{P}</div><div class="footer">{FOOT}</div>',
    "div entry": f'<div class="OUTER"><div class="nav">{NAV}</div><div class="entry"><div class="text">{H}{P}</div></div><div class="copyright">{FOOT}</div></div>',
    "comments": f'<nav>{NAV}</nav><article>{H}{P}</article><section class="comments">{COMMENTS}</section><footer>{FOOT}</footer>',
    "section": f'<header><nav>{NAV}</nav></header><main class="OUTER"><section>{H}{P}</section></main><footer>{FOOT}</footer>',
    "table": f'<nav>{NAV}</nav><table class="OUTER"><tr><td><article>{H}{P}</article></td></tr></table><footer>{FOOT}</footer>',
    "advert": f'<nav>{NAV}</nav><article>{H}{P}</article><div class="advert"><p>Buy two lamps and save a lot today!</p></div><footer>{FOOT}</footer>',
    "cookie": f'<div class="cookie"><p>We use cookies to improve this site.</p></div><nav>{NAV}</nav><article>{H}{P}</article><footer>{FOOT}</footer>',
}
WORDS = ["", "home blog", "no-sidebar", "single ad-free", "widget-area", "comments-open", "page-template sidebar-none", "has-header-banner", "footer-fixed nav-open", "newsletter-off"]


@pytest.fixture(scope="module")
def weights():
    return html_extract.train()


def extracted(weights, page):
    found = blocks(page)
    return [b[0] for b, k in zip(found, html_extract.label(weights, [vectors(found)])[0], strict=True) if k]


@pytest.mark.parametrize("name", TEMPLATES)
def test_the_article_is_kept_whatever_words_stand_outside(name, weights):
    for words in WORDS:
        for at in ("html", "body", "both"):
            body = TEMPLATES[name].replace("OUTER", words or "plain")
            page = f'<html class="{words if at != "body" else ""}"><head><title>x</title></head><body class="{words if at != "html" else ""}">{body}</body></html>'
            assert extracted(weights, page) == MAIN, (words, at)


def test_labels_do_not_depend_on_the_batch(weights):
    import random

    rng = random.Random(8)
    pages = [vectors(blocks(html_extract.training_page(rng))) for _ in range(60)]
    together = html_extract.label(weights, pages)
    for page, kept in zip(pages, together, strict=True):
        assert (html_extract.label(weights, [page])[0] == kept).all()
    assert all((a == b).all() for a, b in zip(reversed(together), html_extract.label(weights, pages[::-1]), strict=True))


def test_formulas_are_text_and_fields_are_not():
    assert [b[0] for b in blocks("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be.</p><object><p>shown</p></object><textarea>typed</textarea></article>")] == ["Let x=1 be.", "shown"]


def test_words_of_wrappers_do_not_count_and_others_do():
    bits = lambda page: {b[0][:3]: b[1] for b in blocks(page)}
    page = '<body class="{0}"><div class="{0}"><h1>One</h1><p>{1}</p></div><div class="{2}">two</div></body>'
    long = "Abc " * 20
    assert bits(page.format("a", long, "c")) == bits(page.format("b", long, "c"))
    assert bits(page.format("a", long, "c"))["two"] != bits(page.format("a", long, "d"))["two"]
