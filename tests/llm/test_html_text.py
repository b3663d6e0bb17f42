import html
import re

import pytest

from geoflume.llm import html_text as H

PAGE = """<html><body><header><h1>Site</h1><a href=/>home</a></header><div id="main-content"><div class="sidebar widget">side bar</div>
<article class="post"><header><h1>Title</h1><span>By X</span></header><p>First <i>para</i> with <a href="x">a link</a> &amp; text
that goes on and on for long enough.</p><div class="share-buttons">share me</div><section><h2>Sub</h2><p>Second para, which is long, too, and says&nbsp;things.</p>
<ul><li>one<li>two</ul></section><form>Mail<input></form><div id="comments"><p>Nice post! A long comment that says a lot of things.</p></div></article>
<aside>related</aside></div><div class="cookie-notice">We use cookies</div><script>var a = "</p><p>no";</script><footer>foot</footer></body></html>"""


def test_leaves_out_what_is_not_the_article():
    assert H.main_text(PAGE).split("\n") == ["Title", "First para with a link & text that goes on and on for long enough.", "Sub", "Second para, which is long, too, and says things.", "one", "two"]


def test_without_article_element():
    page = PAGE.replace("article", "div")
    got = H.main_text(page)
    assert "First para" in got and "Second para" in got and "Nice post" not in got and "cookies" not in got


def test_link_lists_lose_to_prose():
    links = "".join(f'<div><a href="/{i}">A link to another page {i}</a></div>' for i in range(30))
    prose = "".join(f"<p>{'Plain words without any link in them. ' * 5}</p>" for _ in range(4))
    got = H.main_text(f"<body><div>{links}</div><div>{prose}</div></body>")
    assert "Plain words" in got and "another page" not in got


@pytest.mark.parametrize("page, want", [(None, ""), ("", ""), ("<p>", ""), ("only text", "only text"), ("<div>a<p>b<p>c</div>d", "a\nb\nc\nd"), ("<p>x<br>y</p>", "x y"), ("<p>&lt;b&gt; &eacute;&#233; &am</p>", "<b> éé &am")])
def test_odd_pages(page, want):
    assert H.main_text(page) == want


def test_deep_and_long_pages():
    assert H.main_text("<div>" * 5000 + "x" + "</div>" * 5000) == "x"
    assert H.main_text("<article>" + "<p>word word</p>" * 20000 + "</article>").count("\n") == 19999


def test_whole_table(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    out = H.op7_html_text(spark, sf_dir).collect()
    assert len(out) == len(pages)
    for r in out:
        inner = re.search(r"<article>(.*?)(?:</article>|$)", pages[r.page_id], re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner.replace("<br>", " ")))
        want = "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)
        assert r.text == want and r.n_chars == len(want)


def test_columns_and_nulls(spark):
    df = spark.createDataFrame([(None, None, None, "t"), (1, "u", "<p>a</p>", "t"), (1, "u", "<p>a</p>", "t")], "page_id long, url string, html string, text string")
    assert sorted(r.text for r in H.html_text(df).collect()) == ["", "a", "a"]
    assert H.html_text(df.limit(0)).count() == 0


LONG = "Plain words of an article that goes on for quite a while, as they do. " * 4


@pytest.mark.parametrize(
    "page",
    [
        f'<body><p class="notice">Hi<p>{LONG}<p>{LONG}</body>',
        f'<body><ul><li class="share">Hi<li>{LONG}</ul><p>{LONG}</body>',
        f"<body><div><form>Hi</div><div><p>{LONG}</p><p>{LONG}</p></div></body>",
        f"<body><div><nav>Hi</div><article><p>{LONG}</p><p>{LONG}</p></article></body>",
        f'<body><section><div class="ad">Hi</section><article><p>{LONG}</p><p>{LONG}</p></article></body>',
        f'<body><div><span class="ad">Hi <span>you</span> Hi</div><article><p>{LONG}</p><p>{LONG}</p></article></body>',
        f"<html><head><meta charset=x><body><p>{LONG}<p>{LONG}</html>",
    ],
)
def test_unclosed_left_out_elements_end_as_others_do(page):
    got = H.main_text(page)
    assert got.count(LONG.strip()) == 2 and "Hi" not in got


@pytest.mark.parametrize("name", ["content has-sidebar", "no-comments", "layout-nav-top", "sidebar", "search-box main"])
def test_layout_wrappers_keep_the_article(name):
    assert H.main_text(f'<body><nav>menu</nav><div class="{name}"><article><p>{LONG}</p></article></div></body>') == LONG.strip()
    assert H.main_text(f'<body><nav>menu</nav><div id="x" class="{name}"><p>{LONG}</p><p>{LONG}</p></div></body>').count(LONG.strip()) == 2


def test_form_around_the_page():
    assert H.main_text(f'<body><form><header class="x"><article><p>{LONG}</p></article></header></form></body>') == LONG.strip()


def test_what_stands_beside_an_article_is_left_out_however_long():
    page = f'<body><article><p>{LONG}</p></article><footer><p>{"Legal words. " * 90}</p></footer><div id="comments"><article><p>{"Nice post. " * 90}</p></article></div></body>'
    assert H.main_text(page) == LONG.strip()


def test_captions_stay():
    assert H.main_text(f"<article><p>{LONG}</p><figure><img src=x><figcaption>A caption</figcaption></figure></article>").split("\n")[1] == "A caption"


def test_sibling_articles_stay():
    parts = [f"Part {i}. {LONG}".strip() for i in range(3)]
    got = H.main_text("<body><div>" + "".join(f"<article><p>{x}</p></article>" for x in parts) + '</div><article><a href="/x">more</a><a href="/y">more</a></article></body>')
    assert got.split("\n") == parts


LINKS = "".join(f'<li><a href="/{i}">A link to page {i}</a></li>' for i in range(12))
TEASERS = "".join(f'<div><a href="/t{i}">Teaser {i} of another story</a> <span>by X</span></div>' for i in range(6))
PLAIN_PAGES = {
    "links before and after": (f"<body><div><ul>{LINKS}</ul></div><div><h1>Title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div>{TEASERS}</div></body>", ["Title", LONG, "Short.", LONG]),
    "sections": (f"<body><table><tr><td><a href=/>Home</a> <a href=/x>About us</a></td></tr></table><div><h1>T</h1><section><h2>A</h2><p>{LONG}</p><p>{LONG}</p></section><section><h2>B</h2><p>Brief.</p></section></div><div>{TEASERS}</div></body>", ["T", "A", LONG, LONG, "B", "Brief."]),
    "divs for paragraphs": (f"<body><div>{TEASERS}</div><div><div>{LONG}</div><div>{LONG}<a href=x>one link</a></div><ul><li>one<li>two</ul></div></body>", [LONG, LONG.strip() + " one link", "one", "two"]),
    "a short line beside the core": (f"<body><div>Sign up now</div><div><p>{LONG}</p><p>{LONG}</p></div><div>Call us</div></body>", [LONG, LONG]),
}


@pytest.mark.parametrize("name", sorted(PLAIN_PAGES))
def test_density_decides_where_nothing_is_named(name, monkeypatch):
    """No article element, no telling class names: the core comes from the densities, and without them the page comes out wrong."""
    page, want = PLAIN_PAGES[name]
    want = "\n".join(x.strip() for x in want)
    assert H.main_text(page) == want
    weigh = H._weigh

    def flat(nodes):
        weigh(nodes)
        for n in nodes:
            n.density, n.total, n.best, n.link_chars = 0.0, 0.0, n, 0

    monkeypatch.setattr(H, "_weigh", flat)
    assert H.main_text(page) != want


@pytest.mark.parametrize("piece", ["<script ", "<p x ", '<a href="', "<a '\">", '<a ">"', "<!-- ", "<td>", "</p>", "<b", "<p title='>", "<div></section>", "<dt><a>", "<span class=ad><span>x"])
def test_long_broken_pages_take_linear_time(piece):
    import time

    began = time.perf_counter()
    H.main_text(piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - began < 15
    began = time.perf_counter()
    H.main_text(piece * (32_000 // len(piece)))
    assert time.perf_counter() - began < 1


def test_missing_end_tags():
    assert H.main_text(f"<p>{LONG}<svg/><p>{LONG}<svg><path></svg><p>End of it.").split("\n") == [LONG.strip(), LONG.strip(), "End of it."]
    assert H.main_text(f"<p>{LONG}<script>var a = '<p>no</p>'") == LONG.strip()
    assert H.main_text(f'<p class="x>{LONG}<p>{LONG}') == "\n".join([LONG.strip()] * 2)
    assert H.main_text(f"a < b <p>{LONG}</p> 1 <2") == f"a < b\n{LONG.strip()}\n1 <2"


@pytest.mark.parametrize("tag", ["article", "div"])
def test_headings_with_ids_stay(tag):
    heads = '<h2 id="comments">Comments on the law</h2>', '<h2 id="related">Related work</h2>', '<h3 id="share" class="share">Share prices</h3>'
    page = f"<body><{tag}><h1>T</h1>" + "".join(f"{h}<p>{LONG}</p>" for h in heads) + f'<p id="notice">A short one. <label>Its label</label> ends.</p><div id="comments"><p>Nice post</p></div></{tag}></body>'
    got = H.main_text(page)
    assert all(x in got for x in ("Comments on the law", "Related work", "Share prices")) and "Nice post" not in got
    assert ("A short one. Its label ends." in got) == (tag == "article")


def test_notices_beside_the_article_go():
    page = f"<body><p>We use cookies on this site. Accept?</p><div><h1>T</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><p>Copyright 2020 the makers</p></body>"
    assert H.main_text(page) == "\n".join(["T", LONG.strip(), "Short.", LONG.strip()])


def test_prose_between_parts_of_the_article_stays():
    page = f"<body><div><section><p>{LONG}</p><p>{LONG}</p></section><p>Between.</p><section><p>{LONG}</p><p>{LONG}</p></section></div></body>"
    assert "Between." in H.main_text(page).split("\n")


def plain_densities(root):
    """Densities by their formula, each element's counts taken anew from all that is below it."""
    import math

    def below(n):
        yield from (x for k in n.kids if isinstance(k, H.Node) for x in (k, *below(k)))

    def chars(n):
        return sum(len(" ".join(k.split())) if isinstance(k, str) else chars(k) for k in n.kids)

    def link_chars(n):
        return chars(n) if n.tag == "a" else sum(link_chars(k) for k in n.kids if isinstance(k, H.Node))

    body = max(link_chars(root), 1) / max(chars(root), 1)
    out = {}
    for n in (root, *below(root)):
        c, lc = chars(n), link_chars(n)
        t, lt = len(list(below(n))), sum(k.tag == "a" for k in below(n))
        out[id(n)] = 0.0
        if c:
            log = math.log(max(c * max(t, 1) / (max(lc, 1) * max(lt, 1)), 1.0))
            out[id(n)] = c / max(t, 1) * log / math.log(math.log(c * max(lc, 1) / max(c - lc, 1) + body * c + math.e))
    return out


def test_densities_core_and_threshold_of_every_page(spark, sf_dir):
    """The core, what is beside it, and the densities of every page of the table, read off the formulas slowly."""
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        root = H.tree(r.html)
        taken, density = H.content(root), plain_densities(root)
        nodes = H._order(root)
        assert all(abs(n.density - density[id(n)]) < 1e-9 * max(1, density[id(n)]) for n in nodes)
        total = {id(n): sum(density[id(k)] for k in n.kids if isinstance(k, H.Node)) for n in nodes}
        core = max(nodes, key=lambda n: total[id(n)])
        assert root.best.total == pytest.approx(total[id(core)]) and id(root.best) in taken
        path = [core]
        while path[-1].up is not None:
            path.append(path[-1].up)
        least = min(density[id(n)] for n in path)
        for n in path[:-1]:
            beside = [k for k in n.up.kids if isinstance(k, H.Node) and k.chars and 2 * k.link_chars <= k.chars]
            assert all(id(k) in taken for k in beside if density[id(k)] >= least)
