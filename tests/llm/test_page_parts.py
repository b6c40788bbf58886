"""Parts of pages that are no content: each kind, with each kind of text, at each place."""

import pytest

from lexloom.llm import html_extract

ONE = "The quick story of the place went on for many years, and nobody knew how it would end for them all."
TWO = "Another sentence stands here, which is long enough to be a paragraph of an article, and says something."
PARTS = (
    '<section class="comments">{}</section>', '<div class="comments">{}</div>', '<div id="comments">{}</div>', '<div class="ad">{}</div>', '<div class="advertisement">{}</div>', '<div class="newsletter">{}</div>', '<div class="sidebar">{}</div>',
    "<aside>{}</aside>", '<div role="navigation">{}</div>', "<nav>{}</nav>", "<footer>{}</footer>", '<div class="cookie-banner">{}</div>', '<div class="related-posts">{}</div>', '<div class="social-share">{}</div>', '<section class="promo">{}</section>', "<form>{}</form>",
)
INSIDE = (
    "<p>No content said the other, and they went on and on about it all.</p>", "<h3>3 comments</h3><p>No content said the other, and they went on and on about it all.</p>", "<h2>Comments</h2><p>A long sentence that goes on like any other, in a text of some length.</p><p>Yet another one of the same kind that is longer than the first, and so on it goes.</p>",
    "<h3>More</h3><ul><li>One of them</li><li>Two is longer than one, and a sentence.</li></ul>", '<h2>Comments</h2><article class="comment"><p>Said the other, and they went on and on about it.</p></article>', "<h2>Comments</h2><article><h4>By me</h4><p>Said the other, and they went on and on about it.</p></article>", "<div>Text in a div, of some length as well.</div>",
)
HEAD, TAIL = f"<h1>Title of it</h1><p>{ONE}</p>", f"<h2>Second part</h2><p>{TWO}</p>"
PLACES = {
    "article": f"<body><article>{HEAD}@{TAIL}</article></body>", "its end": f"<body><article>{HEAD}{TAIL}@</article></body>", "main": f"<body><main>{HEAD}@{TAIL}</main></body>", "div": f'<body><div class="content">{HEAD}@{TAIL}</div></body>',
    "behind": f"<body><article>{HEAD}{TAIL}</article>@</body>", "before": f"<body>@<article>{HEAD}{TAIL}</article></body>",
}


@pytest.fixture(scope="module", params=["sf0.001", "sf0.01"])
def model(spark, request):
    return html_extract.fit(spark.read.parquet(f"/root/testdata/{request.param}/pages.parquet"))


@pytest.mark.parametrize("place", list(PLACES))
def test_only_the_article_stays(model, place):
    want = "\n".join(("Title of it", ONE, "Second part", TWO))
    cases = [(part, inside) for part in PARTS for inside in INSIDE if not ("<form" in part and "<article><h4>" in inside)]  # a form may be wrapped around a page's article
    got = html_extract.main_texts([PLACES[place].replace("@", part.format(inside)) for part, inside in cases], model)
    assert [c for c, t in zip(cases, got) if t != want] == []


@pytest.mark.parametrize("wrap", ['<div class="content-sidebar-wrap">{}</div>', '<form id="aspnetForm">{}</form>', '<div class="has-sidebar">{}</div>', '<body class="sidebar ad">{}</body>', '<div class="post-body">{}</div>'])
def test_wrappers_of_the_whole_page_hide_nothing(model, wrap):
    page = wrap.format(f"<main>{HEAD}{TAIL}</main>")
    assert html_extract.main_texts([page], model) == ["\n".join(("Title of it", ONE, "Second part", TWO))]
