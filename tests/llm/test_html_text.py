from __future__ import annotations

import html as entities
import re

import pytest

from gridwarden.llm.html_text import extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>x</p>";</script></head>
<body><header class="site"><h2>The site name and its slogan, quite long for a header</h2></header>
<nav><ul><li><a href="/">Home</a></li><li><a href="/b">Blog</a></li></ul></nav>
<div class="cookie-notice">We use cookies to make this site better for all of its readers.</div>
<div id="wrap"><article><header><h1>Title &amp; more</h1></header>
<p>First paragraph with <a href="#">a link</a> and&nbsp;some   more
text.<p>Short.</p><ul><li>One item<li>Another item</ul>
<div class="ad">Buy now, this is an advert of some length in the middle of the text.</div>
<p><b>Bold start, never closed.<br><p>Last &lt;one&gt; of the paragraphs, with some words in it.</p>
<form><label>Mail</label><input type="text"><button>Send</button></form></article>
<section id="comments"><h3>Comments</h3><p>I have read all of this and I want to say something long.</p></section>
<aside><p>Other stories that may be of interest to you and to everybody else.</p></aside></div>
<footer>&copy; Somebody</footer></body></html>"""


def test_page():
    assert main_text(PAGE).split("\n\n") == [
        "Title & more", "First paragraph with a link and some more text.", "Short.", "One item",
        "Another item", "Bold start, never closed.",
        "Last <one> of the paragraphs, with some words in it.",
    ]


def test_without_article():
    page = PAGE.replace("<article>", "<div class='story'>").replace("</article>", "</div>")
    page = page.replace("<header><h1>", "<h1>").replace("</h1></header>", "</h1>")
    assert main_text(page) == main_text(PAGE)


@pytest.mark.parametrize("page", ["", " ", "<p>", "</p></div>", "<nav>a</nav>", "<script>alert(1)"])
def test_nothing(page):
    assert main_text(page) == ""


WORDS = "Many plain words about one and the same thing stand in this paragraph, as number {} of all."
PARTS = [WORDS.format(i) for i in range(12)]


def ps(*numbers):
    return "".join(f"<p>{PARTS[i]}</p>" for i in numbers)


@pytest.mark.parametrize(
    "name", ["has-sidebar", "nav-fixed", "entry-header", "side-effects", "form-factor", "search-methods", "related-work",
             "sidebar", "related", "comments", "page with-footer"]
)
@pytest.mark.parametrize("inner", ["article", "main", "div"])
@pytest.mark.parametrize("attribute", ["class", "id"])
def test_names_around_the_text(name, inner, attribute):
    page = f"<body><div><p>Home</p></div><div {attribute}='{name}'><{inner}>{ps(*range(12))}</{inner}></div></body>"
    assert main_text(page) == "\n\n".join(PARTS)


@pytest.mark.parametrize("outer", ["article", "main", "div"])
def test_ids_of_headings_and_sections(outer):
    page = (
        f"<body><nav>Home</nav><{outer}><h1>Title</h1>{ps(0, 1, 2)}<section id='related-work'>{ps(3, 4)}</section>"
        f"<h2 id='discussion'>Discussion</h2>{ps(5)}<section id='discussion'><h2>More</h2>{ps(6)}</section>"
        f"<div class='section' id='search'>{ps(7)}</div><div class='share-buttons'>Tell your friends</div></{outer}>"
    )
    want = ["Title", *PARTS[:5], "Discussion", PARTS[5], "More", *PARTS[6:8]]
    assert main_text(page).split("\n\n") == want


@pytest.mark.parametrize(
    "name", ["ad", "ad-slot", "site-footer", "sidebar", "left-sidebar", "sidebar-2", "share-buttons", "related-posts", "comments-area"]
)
def test_names_that_are_left_out(name):
    page = f"<body><article>{ps(*range(6))}<div class='x {name}'>{ps(6)}</div></article><div id='{name}'>{ps(7)}</div>"
    assert main_text(page) == "\n\n".join(PARTS[:6])


def brute(parts):
    """Text of (wrapper, paragraph numbers) that all belong to the page's text."""
    return "\n\n".join(PARTS[i] for _, numbers in parts for i in numbers)


@pytest.mark.parametrize(
    "parts",
    [
        [("section", [0, 1, 2, 3, 4, 5]), ("section", [6, 7, 8])],
        [("blockquote", [0, 1, 2, 3, 4, 5, 6]), ("div", [7, 8])],
        [("div", [0]), ("figure", [1, 2, 3, 4]), ("div", [5])],
        [("article", [0, 1, 2, 3, 4, 5]), ("article", [6, 7, 8, 9, 10])],
        [("article", [0, 1, 2, 3]), ("article", [4, 5, 6, 7]), ("article", [8])],
        [("td", [0, 1, 2, 3]), ("td", [4, 5])],
    ],
)
@pytest.mark.parametrize("outer", ["<div>{}</div>", "<main>{}</main>", "{}"])
def test_parts_of_a_page(parts, outer):
    inside = "".join(f"<{tag}>{ps(*numbers)}</{tag}>" for tag, numbers in parts)
    if parts[0][0] == "td":
        inside = f"<table><tr>{inside}</tr></table>"
    page = f"<body><nav>Home</nav>{outer.format(inside)}<aside>Others</aside><footer>Somebody</footer></body>"
    assert main_text(page) == brute(parts)


def test_a_long_line_does_not_decide():
    long = " ".join(PARTS * 5)
    page = f"<body><div><a href='/'>Home</a></div><div><div><p>{long}</p></div><div>{ps(1, 2, 3, 4)}</div></div></body>"
    assert main_text(page) == "\n\n".join([long, *PARTS[1:5]])


def test_navigation_by_links_only_stays_out():
    links = "".join(f"<li><a href='/{i}'>Go {i}</a></li>" for i in range(10))
    page = f"<body><div><ul>{links}</ul></div><div class='story'>{ps(*range(9))}</div><div><ul>{links}</ul></div></body>"
    assert main_text(page) == "\n\n".join(PARTS[:9])


COMMENT = " ".join(PARTS * 2)


@pytest.mark.parametrize("post", ["<article><h1>Title</h1>{}</article>", "<main><h1>Title</h1>{}</main>", "<h1>Title</h1>{}"])
@pytest.mark.parametrize("numbers", [[0, 1], [0], list(range(9))])
@pytest.mark.parametrize(
    "comments",
    [
        '<div id="comments" class="comments-area">' + f'<article class="comment"><p>{COMMENT}</p></article>' * 6 + "</div>",
        f'<article class="comment"><p>{COMMENT}</p></article>' * 6,
        f"<div class='comments'>{''.join(f'<p>{COMMENT}</p>' for _ in range(6))}</div>",
        f"<section id=comments><p>{COMMENT}</section>",
        f"<ol class='commentlist'><li><article><p>{COMMENT}</p></article></li></ol><div id='respond'><form>Say</form></div>",
        f"<div id='disqus_thread'><div class='comment-body'>{COMMENT}</div></div>",
    ],
)
@pytest.mark.parametrize("inside", [False, True])
def test_reader_comments(post, numbers, comments, inside):
    page = post.format(ps(*numbers) + comments if inside else ps(*numbers)) + ("" if inside else comments)
    want = "\n\n".join(["Title", *(PARTS[i] for i in numbers)])
    assert main_text(f"<body><nav>Home</nav>{page}<footer>Somebody</footer></body>") == want
    unclosed = page.replace("</p>", "").replace("<p>", "\n<p>")
    assert main_text(f"<body>{unclosed}</body>") == want


@pytest.mark.parametrize("outer", ["article", "main", "div"])
@pytest.mark.parametrize("name", ["discussion", "related", "search", "section related"])
def test_classes_of_sections(outer, name):
    page = (
        f"<body><{outer}><h1>Title</h1>{ps(0, 1, 2)}<section class='{name}'><h2>Related work</h2>{ps(3, 4)}</section>"
        f"<h2 class='discussion'>Discussion</h2>{ps(5)}</{outer}></body>"
    )
    assert main_text(page).split("\n\n") == ["Title", *PARTS[:3], "Related work", *PARTS[3:5], "Discussion", PARTS[5]]


def test_sections_of_links_and_notices():
    links = "".join(f"<li><a href='/{i}'>Go to {i}</a></li>" for i in range(10))
    page = (
        f"<body><article>{ps(*range(6))}<section class='related'><h2>Related</h2><ul>{links}</ul></section>"
        f"<section class='notice'>{ps(7)}</section><section class='related-posts'>{ps(8)}</section></article></body>"
    )
    assert main_text(page) == "\n\n".join(PARTS[:6])


def test_form_around_a_page():
    page = f"<body><form><input name='state'><div>{ps(*range(6))}</div><nav>Home</nav></form></body>"
    assert main_text(page) == "\n\n".join(PARTS[:6])


def test_very_long_and_deep():
    page = "<body><article>" + "<div>" * 3000 + "<p>deep words here</p>" + "<p>x y</p>" * 20_000
    assert len(main_text(page).split("\n\n")) == 20_001


def test_pages(spark, sf_dir):
    """The generated pages hold one article of h1 and p elements, nothing else inside it."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    found = extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()
    assert len(found) == len(pages)
    for row in found:
        inside = re.search(r"<article>(.*)</article>", pages[row.page_id].html, re.S)[1]
        blocks = (re.sub(r"<[^>]*>", " ", b) for b in re.split(r"</?(?:p|h1)>", inside))
        blocks = (" ".join(re.split(r"\s+", entities.unescape(b))).strip() for b in blocks)
        assert row.text == "\n\n".join(b for b in blocks if b)
        assert row.n_chars == len(row.text) and row.url == pages[row.page_id].url


def test_nulls_and_no_rows(spark):
    schema = "page_id long, url string, html string, text string"
    rows = [(None, None, None, "t"), (1, "u", "<p>a b</p>", "t"), (1, "u", "<p>a b</p>", "t")]
    got = extract(spark.createDataFrame(rows, schema)).collect()
    assert sorted(tuple(r)[2:] for r in got) == [("", 0), ("a b", 3), ("a b", 3)]
    assert extract(spark.createDataFrame([], schema)).collect() == []
