"""Main text of pages: small pages by hand, and the articles of the pages table."""

import html
import re
import time

from weftline.llm.html_text import extract_text, main_text
from weftline.llm.queries import op4_html_text

LONG = "A long sentence, with commas, that reads like prose and says enough to count as a paragraph of the text. " * 3


def test_pages(spark, small):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in op4_html_text(spark, small).collect():
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        plain = html.unescape(re.sub(r"<[^>]*>", " ", article))
        assert r.text.split() == plain.split() or r.text.replace(" ", "") == "".join(plain.split())
        assert r.n_chars == len(r.text)


def test_boilerplate_goes():
    page = f"""<!DOCTYPE html><html><head><title>t</title><style>p {{}}</style></head><body><header><h1>Site</h1></header>
    <nav><a href=/>home</a></nav><div class="cookie-notice"><p>{LONG}</p></div>
    <div id=content><h1>Title &amp; more</h1><p>{LONG}<script>var x="<p>no</p>";</script></p><ul><li>one, two<li>three</ul><p>Second
    <b>bo</b>ld&nbsp;x &#233; {LONG}</div>
    <aside><p>{LONG}</p></aside><form><p>{LONG}</p></form><div class="comments"><p>{LONG}</p></div><footer>&copy; me</footer></body></html>"""
    prose = " ".join(LONG.split())
    assert main_text(page) == f"Title & more {prose} one, two three Second bold x é {prose}"


def test_link_lists_lose_and_siblings_stay():
    links = "".join(f"<li><a href=/{i}>A linked headline, with some words, number {i}</a></li>" for i in range(40))
    page = f"<body><div><ul>{links}</ul></div><div><p>{LONG}</p><p>{LONG}</p></div></body>"
    assert main_text(page) == " ".join(" ".join(LONG.split()) for _ in range(2))
    assert main_text(f"<body><div class=x><p>{LONG}</p><p>{LONG}</p></div><p>{LONG}</p></body>").count("A long sentence") == 9


def test_awkward_pages(spark):
    rows = [(1, None), (2, ""), (3, "plain text & no tags <"), (4, "<p>unclosed <b>tags"), (None, "<div>" * 3000 + "deep" + "</div>" * 10), (4, "<p>unclosed <b>tags"), (5, "<!-- open comment"), (6, "<script>never closed")]
    df = spark.createDataFrame([(k, t, "u", "x") for k, t in rows], "page_id bigint, html string, url string, text string")
    found = sorted(map(str, (tuple(r) for r in extract_text(df, keep=("url",)).collect())))
    assert found == sorted(map(str, [(1, "u", "", 0), (2, "u", "", 0), (3, "u", "plain text & no tags <", 22), (4, "u", "unclosed tags", 13), (4, "u", "unclosed tags", 13), (None, "u", "deep", 4), (5, "u", "", 0), (6, "u", "", 0)]))
    assert extract_text(df.limit(0)).count() == 0


PROSE = " ".join(LONG.split())


def test_marks_give_way_where_the_text_disagrees():
    menu = "<nav><a href=/>home</a></nav>"
    for body in (
        f'<form id="aspnetForm">{menu}<div><p>{LONG}</p></div><input value=x><select><option>no</select></form>',
        f'{menu}<div class="content has-sidebar"><div><p>{LONG}</p></div></div>',
        f'{menu}<div class="layout-no-sidebar"><article><p>{LONG}</p></article></div>',
        f'<form><input name=q><button>Go</button></form><main><p>{LONG}</p></main><form><p>{LONG}{LONG}</p></form>',
    ):
        assert main_text(f"<html><body>{body}<footer>me</footer></body></html>") == PROSE, body
    inside = [
        ('<header class="entry-header"><h1>Title</h1></header>', "Title "),
        ('<div class="post-header"><h1>Title</h1></div>', "Title "),
        ('<section class="share-prices"><p>Prices of shares rose.</p></section>', "Prices of shares rose. "),
        ('<p class="related">It is related to this.</p>', "It is related to this. "),
        ('<p class="related"><a href=/x>Other story</a></p>', ""),
        ('<div class="ad"><p>Buy this.</p></div>', ""),
        ('<div class="ad-box"><p>Buy this.</p></div>', ""),
        ('<div class="cookie_notice"><p>We use cookies.</p></div>', ""),
        ('<form><p>Sign up</p><input></form>', ""),
        (f'<section id="comments"><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></section>', ""),
    ]
    for part, text in inside:
        assert main_text(f"<body>{menu}<article>{part}<p>{LONG}</p></article><footer>me</footer></body>") == text + PROSE, part
        assert main_text(f"<body>{menu}<div class=post>{part}<p>{LONG}</p><p>{LONG}</p></div><footer>me</footer></body>") == f"{text}{PROSE} {PROSE}", part
    assert main_text(f'<body><section class="comment"><p>{LONG}</p></section></body>') == PROSE  # nothing else is there


def test_references_and_attributes():
    assert main_text("<p title='a > b' class=x>a &amp;amp; b&<b>amp;</b> &notin; &#x41;<br/>c</p>") == "a &amp; b&amp; ∉ A c"
    assert main_text('<p title="unclosed>one</p><p>two</p>') == "one two"
    assert main_text("<p><![CDATA[a &amp; <b>]]></p>") == "a &amp; <b>"
    assert main_text("<article><table><tr><td>a<td>b<tr><td>c</table><dl><dt>d<dd>e</dl></article>") == "a b c d e"


def test_hostile_pages_take_time_in_proportion():
    pages = [
        lambda n: "<div><p>x" * n,
        lambda n: "<button>" * n + "x",
        lambda n: '<a title="' * n,
        lambda n: "<p title='\">" * n,
        lambda n: "<div>" * n + "</section>" * n,
        lambda n: "<x-a>" * n + "<h1></h1>" * n,
        lambda n: "<p><table><tr><td>" + "<x-a>" * n + "<h1>a</h1>" * n,
        lambda n: "<!--" * n,
        lambda n: "<![CDATA[" * n,
        lambda n: "<script>" * n,
        lambda n: "<p" + " /" * n + ">" * n,
        lambda n: "<" * n,
        lambda n: "<a " * n,
        lambda n: "<li><a href=x>y, " * n,
    ]
    for k, page in enumerate(pages):
        main_text(page(100))
        began = time.perf_counter()
        main_text(page(20_000))
        assert time.perf_counter() - began < 1.5, k


def test_a_teaser_is_not_the_article():
    page = f'<html><body><form id="aspnetForm"><nav><a href=/>home</a></nav><div><p>{LONG}</p><p>{LONG}</p></div></form><article><p>Read also this</p></article></body></html>'
    assert PROSE in main_text(page)
    assert main_text(f"<html><body><form><p>{LONG}</p></form><article><p>{LONG}</p></article></body></html>") == PROSE


def test_what_readers_wrote_goes():
    says = "I liked this a lot, thank you, and I will come back for more of it. "
    for names, item in (("reader-feedback", '<div class="entry"><span class="author">Jo</span><p>{}</p></div>'), ("discussion", "<li><time>9:15</time> <p>{}</p></li>"), ("x1", '<div class="c"><b class="user">ann</b><p>{}</p></div>'), ("discussion", "<p>{}</p>")):
        tag = "ul" if item.startswith("<li") else "section"
        told = f'<{tag} class="{names}">' + "".join(item.format(says + str(i)) for i in range(3)) + f"</{tag}>"
        for page in (f"<body><article><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></article>{told}</body>", f"<body><article><h1>Title</h1><p>{LONG}</p><p>{LONG}</p>{told}</article></body>", f"<body><h1>Title</h1><p>{LONG}</p><p>{LONG}</p>{told}</body>"):
            assert main_text(page) == f"Title {PROSE} {PROSE}", page


def test_a_discussion_with_a_heading_and_lists_of_posts_stay():
    page = f'<article><p>{LONG}</p><div class="discussion"><h2>Discussion</h2><p>{LONG}</p></div></article>'
    assert main_text(page) == f"{PROSE} Discussion {PROSE}"
    posts = "".join(f'<div class="post"><span class="date">May {i}</span><p>{LONG}</p></div>' for i in range(3))
    assert main_text(f"<body><div id=content>{posts}</div></body>").count(PROSE) == 3


def test_menus_and_notices_beside_bare_paragraphs_go():
    links = "".join(f"<a href=/{i}>Item {i}</a> " for i in range(5))
    for menu in (f'<div class="topnav">{links}</div>', f'<div class="x">{links}</div>', f"<ul>{links.replace('<a', '<li><a')}</ul>"):
        page = f'<body>{menu}<div class="cookiebar">We use cookies, as all do. <a href=/ok>OK</a></div><p>{LONG}</p><p>See <a href=/y>this</a>. {LONG}</p></body>'
        assert main_text(page) == f"{PROSE} See this. {PROSE}", page
