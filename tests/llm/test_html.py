import numpy as np
import pytest

from chronolake.llm import html_paths
from chronolake.llm.html_paths import main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="menu">
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- no <p>x</p> -->
<div class="ad">Buy now, pay later, always.</div><form><p>Mail</p></form>
<article><h1>A title &amp; more</h1><p><b>First  paragraph,
 with &eacute;t&#233; and&nbsp;space.<br>Second line.<p>Another <i>one</i>, <a href="x">linked</a>.</p>
<aside>Side note.</aside><ul><li>item one<li>item two</ul><script>no()</script><table><tr><td>cell</td><td>two</td></tr></table>
<div class="comments"><p>First reader comment, quite long, with marks.</p></div></article>
<div id="sidebar"><p>Related things to read.</p></div><footer>&copy; 2024</footer></body></html>"""


def test_page():
    assert main_text(PAGE).split("\n\n") == ["A title & more", "First paragraph, with été and space. Second line.", "Another one, linked.", "item one", "item two", "cell", "two"]


def test_without_article():
    page = "<body><div class='nav-bar'><a>Home</a></div><div><p>" + "</p><p>".join(f"Sentence {k}, and some more of it, so that it is long." for k in range(6)) + "</p></div><div><a>x</a> <a>y</a></div></body>"
    assert main_text(page).count("Sentence") == 6 and "Home" not in main_text(page) and "x" not in main_text(page).split("\n\n")


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!--", "<script>", "<article></article>", "<div class='ad'>x</div>", "</p></b>", "<" * 2000, "<b>" * 3000])
def test_broken_pages(page):
    assert isinstance(main_text(page), str)


def test_cut_off_page():
    assert main_text("<html><body><nav>m</nav><article><h1>Head</h1><p>Some text, cut &am") == "Head\n\nSome text, cut &am"


def test_frame(spark):
    rows = [(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (None, None, None, None), (2, "v", "", "t"), (3, "w", "<article><p>" + "long text, " * 50_000 + "</p></article>", "t")]
    got = html_paths.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, len(r.text)) for r in got) == [(0, 0), (1, len(main_text(PAGE))), (1, len(main_text(PAGE))), (2, 0), (3, 549_999)]
    assert html_paths.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def paragraphs(word, n):
    return "".join(f"<p>{word} {k}, and some more of it, so that it is long.</p>" for k in range(n))


def menu(*names):
    return "<ul>" + "".join(f"<li><a>{n}</a></li>" for n in names) + "</ul>"


def test_two_regions_of_content():
    """A part outside the region of most content is text too if its path is one of content; what stands between paragraphs stays."""
    page = f"<body><div><section>{paragraphs('First', 8)}<h2>Heading</h2>{paragraphs('Second', 9)}</section></div>{menu('v', 'w', 'x', 'y', 'z')}<div><div>{paragraphs('Third', 3)}</div></div></body>"
    text = main_text(page)
    assert [text.count(w) for w in ("First", "Second", "Third")] == [8, 9, 3]
    assert "Heading" in text.split("\n\n") and not {*"vwxyz"} & set(text.split("\n\n"))


@pytest.mark.parametrize("name", ["has-sidebar", "article-header", "no-comments", "content cookie-free"])
def test_wrapper_named_like_something_else(name):
    for attribute in ("class", "id"):
        page = f"<body>{menu('Home', 'News', 'Mail', 'Help', 'More')}<div {attribute}='{name}'>{paragraphs('Sentence', 7)}</div></body>"
        assert main_text(page).count("Sentence") == 7 and "Home" not in main_text(page)


def test_names_still_speak_against_a_part():
    page = f"<body><div>{paragraphs('Sentence', 7)}</div><div class='comments'><div>{paragraphs('Reply', 2)}</div></div></body>"
    assert main_text(page).count("Sentence") == 7 and "Reply" not in main_text(page)


@pytest.mark.parametrize("tag", ["div", "article"])
def test_scores_decide(monkeypatch, tag):
    """Boilerplate with neutral names goes by its path's ratio alone; with constant scores it stays."""
    page = (
        f"<body><div><span>Log in</span></div><table><tr><td>EUR 1.08</td><td>USD 1.02</td></tr></table><{tag}><h2>Title</h2>{paragraphs('Sentence', 6)}</{tag}>"
        "<dl><dt>Imprint</dt><dd>Berlin</dd><dt>Phone</dt><dd>12345</dd></dl></body>"
    )
    text = main_text(page)
    assert text.split("\n\n")[0] == "Title" and text.count("Sentence") == 6 and not any(w in text for w in ("Log in", "EUR", "Imprint", "Berlin"))
    monkeypatch.setattr(html_paths, "_ratios", lambda nodes, length: 1.0 + 0 * length)
    constant = main_text(page)
    assert constant != text or tag == "article"  # an article element is evidence enough here
    monkeypatch.setattr(html_paths, "path_scores", lambda nodes: (np.ones(len(nodes)), np.ones(len(nodes)), 0.5))
    assert {"Log in", "Imprint"} <= set(main_text(page).split("\n\n"))


def test_names_are_weak_evidence():
    page = f"<body>{menu('Home', 'News', 'Mail')}<article><div class='article-header'><h1>A title</h1></div>{paragraphs('Sentence', 4)}<div class='share-price'>ACME 12.50</div>{paragraphs('More', 3)}</article></body>"
    text = main_text(page).split("\n\n")
    assert text[0] == "A title" and "ACME 12.50" in text and "Home" not in text


def test_list_of_links_in_an_article():
    page = f"<body><article><h1><a>A title</a></h1>{paragraphs('Sentence', 4)}<ul>{'<li><a>Read on</a></li>' * 4}</ul></article></body>"
    assert "A title" in main_text(page) and "Read on" not in main_text(page)
