import html
import re
import time

import pytest

from ledgerlark.llm import html_extract as H

LONG = "A sentence of the article that is long enough to be text. " * 3


def test_blocks_references_and_white_space():
    page = f"<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><nav><a href=x>Menu</a></nav><article><h1>Head &amp; more</h1><p><b>One\n  two<br>three<p>{LONG}&copy;&nbsp;x</article><footer>&copy; me</footer>"
    assert H.main_text(page) == f"Head & more\nOne two three\n{LONG}© x".replace("  ", " ")


@pytest.mark.parametrize("part", ["<aside>side</aside>", '<div class="comments"><p>reader says something at length here, really</p></div>', '<div id="cookie-notice">We use cookies</div>', "<form>Name <input name=x> send</form>", '<div class="ad">Buy</div>', "<!-- <p>hidden</p> -->", "<style>p{}</style>", '<div role="navigation">Go</div>', "<header>Site</header>"])
def test_other_parts_go(part):
    assert H.main_text(f"<body>{part}<div><p>{LONG}</p>{'' if part.startswith('<header') else part}<p>Short.</p></div>{part}</body>") == f"{LONG.strip()}\nShort."


def test_page_without_an_article_mark():
    menu = "".join(f"<li><a href=/{k}>Topic {k}</a></li>" for k in range(9))
    page = f"<body><ul>{menu}</ul><div><p>{LONG}<p>Tiny.<p>{LONG}</div><p></p><ul>{menu}</ul><div>x</div></body>"
    assert H.main_text(page) == f"{LONG.strip()}\nTiny.\n{LONG.strip()}"


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><h2><a href=x>Linked head</a></h2><ul><li><a href=y>Item</a></ul><p>See <a href=x>\n the guide\n </a> now.</p></article>", "Linked head\nItem\nSee the guide now."),
        (f'<div style="overflow:hidden" title="The hidden cost" data-class=ad data-x="id=nav"><p>{LONG}</p></div>', LONG.strip()),
        (f"<body><p>{LONG}</p><p><a href=x>A linked paragraph</a></p><p>{LONG}</p></body>", f"{LONG.strip()}\nA linked paragraph\n{LONG.strip()}"),
        ("<body><h1>Title</h1><p>Short text.</p></body>", "Title\nShort text."),
        (f"<body><p>Short.</p>{'<p><a href=x>Link</a></p>' * 5}<p>{LONG}</p></body>", f"Short.\n{LONG.strip()}"),
        (f"<div hidden><p>no</p></div><div class='x ad'>no</div><p>{LONG}</p>", LONG.strip()),
    ],
)
def test_nothing_else_goes(page, want):
    assert H.main_text(page) == want


def test_edges(spark):
    rows = [(1, "u", None, "t"), (2, None, "", "t"), (None, "u", "<p>" + "w " * 50_000, "t"), (3, "v", "plain &lt; text that has no markup at all, but is long enough", "t"), (3, "v", "<p", "t"), (4, "v", "<article><p>a < b && c</article>", "t")]
    out = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    got = sorted((x.page_id or 0, x.text, x.n_chars) for x in out)
    assert got == sorted([(0, "w " * 49_999 + "w", 99_999), (1, "", 0), (2, "", 0), (3, "plain < text that has no markup at all, but is long enough", 58), (3, "", 0), (4, "a < b && c", 10)])
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_on_the_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {x.page_id: x.text for x in H.extract(pages).collect()}
    for page in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", page.html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1)>", inner)]
        assert got[page.page_id] == "\n".join(b for b in blocks if b)


@pytest.mark.parametrize(
    "page, want",
    [
        (f'<article><div class="share-prices"><p>{LONG}</p><p>{LONG}</p></div><p>x</p></article>', f"{LONG.strip()}\n{LONG.strip()}\nx"),
        (f'<body><section id="ad-hoc-analysis"><p>{LONG}</p><p>{LONG}</p></section></body>', f"{LONG.strip()}\n{LONG.strip()}"),
        (f'<article><p>{LONG}</p><div class="share-this">Tell a friend</div><p>x</p></article>', f"{LONG.strip()}\nx"),
        (f'<article><p>{LONG}</p><ul class="related-posts"><li>{LONG}</ul><section class="comment-list"><p>{LONG}</p></section></article>', LONG.strip()),
        (f"<body><div><a href=a>Home</a> <a href=b>News</a></div><h1>Title</h1><p>{LONG}</p><p>End.</p><div>© 2024 Site. All rights reserved.</div><div><a href=c>Imprint</a></div></body>", f"Title\n{LONG.strip()}\nEnd."),
        (f"<main><a href=/in>Login</a><div>Buy now cheap!</div><h1>Title</h1><p>{LONG}</p><div>Buy now cheap!</div></main>", f"Title\n{LONG.strip()}"),
        (f"<main><h1><a href=x>Linked</a></h1><p>{LONG}</p></main><p>{LONG}</p>", LONG.strip()),
        (f"<body><div>{LONG}</div><div>Mid.</div><div>{LONG}</div></body>", f"{LONG.strip()}\nMid.\n{LONG.strip()}"),
        ("<body><p><a href=x>Only a link</a></p></body>", ""),
        ('<p title="a > b">x</p><p title=it\'s>y</p><p class="open>z</p>', "x\ny\nz"),
    ],
)
def test_surge_and_dive(page, want):
    assert H.main_text(page) == want


def test_windows_decide(monkeypatch):
    page = f"<body><div>{LONG}</div><div>Mid.</div><div>{LONG}</div>{'<div>x</div>' * 4}<div>far off</div></body>"
    assert H.main_text(page) == f"{LONG.strip()}\nMid.\n{LONG.strip()}"
    monkeypatch.setattr(H, "WINDOW", 1)
    assert H.main_text(page) == f"{LONG.strip()}\n{LONG.strip()}"


@pytest.mark.parametrize("piece", ["<a ", "<a href=\"", "</x>", "<b>", "<div>", "<li>", "<td><b>", "<!--", "<script>", "<p '", "<ul><b><li></li>", "&", "<"])
def test_a_long_broken_page_takes_no_longer(piece):
    began = time.process_time()
    H.main_text(piece * (1_000_000 // len(piece)))
    H.main_text("<ul>" + "<b>" * 100_000 + piece * 100_000)
    assert time.process_time() - began < 12


def test_comments_as_articles():
    story = "<p>" + "The harbour was quiet, and the boats lay still in the evening light. " * 4 + "</p>"
    comment = "<p>" + "I was there too, and I liked every minute of it, thank you for the story! " * 4 + "</p>"
    own = H.main_text(f"<body><article>{story}</article></body>")
    for mark in ('class="comment"', 'id="comment-7"', 'class="comments-list item"', 'role="complementary"', 'class="related post"', "hidden"):
        assert H.main_text(f"<body><article>{story}</article><section><article {mark}>{comment}</article></section></body>") == own
        assert H.main_text(f"<body><article>{story}<article {mark}>{comment}</article></article></body>") == own
    # names that only contain such a word, or say nothing of the kind, are the article's own
    for mark in ('class="post"', 'class="story share-price"', 'id="main-content"', ""):
        assert H.main_text(f"<body><article {mark}>{story}</article></body>") == own
