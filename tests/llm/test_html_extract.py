import html
import re
import time

import pyarrow.parquet as pq

from trilattice.llm.html_extract import extract, main_text, op2_html_text

BODY = "This is the first paragraph of the article, and it is long enough that the rules see it as text with many of the usual words in it. " * 2


def plain_article(page):
    """The article of the fixture's one template, by its tags alone."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", inner)
    texts = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", p))).split()) for p in parts]
    return "\n\n".join(t for t in texts if t)


def test_every_page_of_the_table():
    t = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pydict()
    wrong = [i for i, h in zip(t["page_id"], t["html"]) if main_text(h) != plain_article(h)]
    assert not wrong, (len(wrong), wrong[:5])


def test_boilerplate_of_many_kinds():
    page = f"""<html><head><title>T</title></head><body class="page has-sidebar"><header><h1>Site</h1></header><div id="cookie-notice">We use cookies.</div>
    <ul class="menu"><li><a href=/>Home</a></ul><main><article class="post"><header><h1>The &amp; title</h1></header><p>{BODY}<p>Short one.
    <div class="adBox">Buy</div><div class=ad>Buy now</div><aside>Also</aside><form>Your mail <input></form><h2>Part two</h2><p>A&nbsp;b&eacute;&#39;<i>c</i><br>d<script>x="</p>"</script></p>
    <ul class="related"><li><a>more</a></ul><ul><li>one thing<li>two things</ul></article><section id="comments"><p>{BODY}</section></main><footer>(c)</footer></body></html>"""
    assert main_text(page).split("\n\n") == ["The & title", BODY.strip(), "Short one.", "Part two", "A bé'c d", "one thing", "two things"]


def test_pages_without_a_marked_article():
    page = f'<div><a href="/a">Home</a> <a>News</a></div><h2>Head</h2><p>{BODY}</p><p>It is so.</p><p>{BODY}</p><div>Copyright notice 2020</div><div><a>x {BODY}</a></div>'
    assert main_text(page).split("\n\n") == ["Head", BODY.strip(), "It is so.", BODY.strip()]


def test_broken_and_empty_pages():
    assert main_text(None) == main_text("") == main_text("<p>") == main_text("<!-- x") == main_text("<nav>a") == ""
    assert main_text(f"<article><p>{BODY}<b>un<closed <p") .startswith(BODY.strip())
    assert main_text("<article>" + "<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert main_text("<article><p>" + "x" * 2_000_000) == "x" * 2_000_000


TEXT = "The first part of this article says what it is about, and it says so in the usual words of the language." * 2
ARTICLE = f"<article><h1>Title</h1><p>{TEXT}</p></article>"


def test_words_of_the_layout_are_no_boilerplate():
    for outer in ('class="content has-sidebar"', 'id="page" class="no-sidebar"', 'class="widget-area"', "class=comments-open", "id=overlay"):
        assert main_text(f"<body><div {outer}>{ARTICLE}</div><footer>x</footer>") == f"Title\n\n{TEXT}", outer
    for own in ('class="ad-free"', 'id="share-2"'):
        assert main_text(f"<article><p {own}>{TEXT}</p><p>{TEXT}</p></article>") == f"{TEXT}\n\n{TEXT}", own
    assert main_text(f'<form id="all"><div>Menu</div>{ARTICLE}</form>') == f"Title\n\n{TEXT}"
    assert main_text(f'<div class="sidebar-layout"><p>{TEXT}</p><p>{TEXT}</p></div><div>(c)</div>') == f"{TEXT}\n\n{TEXT}"


def test_suspects_beside_an_article():
    page = f"""<div class="related"><article><h2>More</h2><p>{BODY}</p></article></div>{ARTICLE}<div id="comments"><article class="comment"><p>{BODY}</p></article></div>
    <div class="cookie-notice"><p>{BODY}</p><p>{BODY}</p></div>"""
    assert main_text(page) == f"Title\n\n{TEXT}"
    assert main_text(f'<p>{BODY}</p><p>{BODY}</p><div id="comments"><article><p>{BODY}</p></article></div>') == f"{BODY.strip()}\n\n{BODY.strip()}"
    assert main_text(f'<article><p>{TEXT}</p><div class="ad"><p>{BODY}</p><p>{BODY}</p></div></article>') == TEXT
    assert main_text(f'<article><p>{TEXT}</p><p hidden>x</p><p style="display:none">y</p></article>') == TEXT


def test_tags_and_comments_as_html_reads_them():
    assert main_text(f'<article><p class=foo">{TEXT}</p><p>Said "so".</p></article>') == f'{TEXT}\n\nSaid "so".'
    assert main_text(f"<article><!--><p>{TEXT}</p><!-- x --><!---><p>End</p></article>") == f"{TEXT}\n\nEnd"
    assert main_text(f"<article><p title='a>b' data-x=\"c>d\" / e = f>{TEXT}</p></ x><!x></></article>") == TEXT


def test_languages_without_known_stop_words():
    han = "天地玄黄宇宙洪荒日月盈昃辰宿列张" * 16
    assert main_text(f"<body><div><a href=/>首页</a></div><p>{han}</p><p>{han}</p><div>版权</div></body>") == f"{han}\n\n{han}"
    other = "Siis poika lähti matkaan metsän halki kohti kaukaista kylää, jossa hänen äitinsä odotti. " * 3
    assert main_text(f"<div><a href=/>Etusivu</a></div><p>{other}</p><p>{other}</p>") == f"{other.strip()}\n\n{other.strip()}"


def test_long_pages_take_linear_time():
    for page in ("<p>short</p>" * 80_000, "<div>" * 200_000, "<div>" * 20_000 + "</b>" * 200_000, "<b>" * 50_000 + "<hr>" * 150_000, '<div class="ad">' * 60_000, "<a b='" * 150_000, "<!-" * 300_000, "<p " * 300_000):
        began = time.process_time()
        main_text(page)
        assert time.process_time() - began < 5, page[:20]


def test_query(spark):
    pages = spark.createDataFrame([(1, None, None, "q"), (None, "u", "<article><p>hi there", "q"), (2, "u", "", "q"), (2, "u", "", "q")], "page_id long, url string, html string, text string")
    got = [tuple(r) for r in extract(pages).collect()]
    assert sorted(got, key=str) == sorted([(1, None, "", 0), (None, "u", "hi there", 8), (2, "u", "", 0), (2, "u", "", 0)], key=str)
    assert extract(pages.where("false")).collect() == []
    assert op2_html_text(spark, "/root/testdata/sf0.001").where("n_chars = 0").count() == 0
