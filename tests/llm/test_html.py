"""Extraction: markup cases, and the suffix array against brute force."""

import random
import time

import numpy as np

from varve.llm.html_extract import MARKED, ExtractConfig, blocks, covered_masks, extract_pages, main_text, prepared, repeated

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p><article>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">Menu</a></ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>no</p> --><div class="ad">Buy</div>
<main><div id="breadcrumbs">a &gt; b</div><article class="post"><h1>Head  &amp;\n line</h1><p>One<br>two &eacute;&#233;&nbsp;x <b>bold</b>ly.<p>Three<aside>side</aside>
<div class="newsletter-signup"><form>mail <input></form></div><ul><li>p<li>q</ul><blockquote>cited</blockquote><pre> a  b </pre><div style="display:none">hid</div><p hidden>hid</p>
<footer>by me</footer></article><section id="comments"><article class="comment"><p>nice</p></article></section></main><aside class="sidebar">more</aside><footer>&copy;</footer></body></html>"""


def alone(page):
    """Text of a page that is alone on its host."""
    found = blocks(page)
    text, needed = prepared(found)
    whole = main_text(found, [np.zeros(len(t.split(" ")), dtype=bool) for _, t in found])
    assert text is None or text == whole
    return whole


def test_article_of_a_page():
    assert alone(PAGE) == "Head & line\n\nOne two éé x boldly.\n\nThree\n\np\n\nq\n\ncited\n\na b"
    assert {t for k, t in blocks(PAGE) if k == MARKED} >= {"Site", "Menu", "We use cookies", "Buy", "side", "nice", "more", "©"}


def test_broken_pages():
    assert blocks(None) == [] and blocks("") == []
    assert alone("<div class=ad>buy<article><p>body</p></article>") == "body"
    assert alone("<article><p><b>A<br><p>B</article><footer>x") == "A\n\nB"
    assert alone("just 1 < 2 text") == "just 1 < 2 text"
    assert alone('<article><p title="a>b">x</p><script>never ends') == "x"
    assert alone("<p>a <b title='>c</p>") == "a c"
    assert alone("one <!-- two <b>three</b>") == "one" and alone("one < two <b") == "one < two <b"


def test_an_article_that_is_a_teaser_does_not_hide_the_text():
    assert alone("<article>teaser</article><div>real text of many words</div>") == "teaser\n\nreal text of many words"
    assert alone("<article>real text of many words</article><div>teaser</div>") == "real text of many words"


def test_time_grows_with_the_length():
    million = 1_000_000
    texts = ["<a" * (million // 2), "<a '" * (million // 4), "<a '>'" * (million // 6), "<a \"'>" * (million // 6), "<" * million, "<!--" * (million // 4), "<![CDATA[" * (million // 9), "<!" * (million // 2), "<nav><article>" * (million // 14), "<p>" * (million // 3), "<div><div hidden>" * (million // 17), "&amp" * (million // 4), "<script>" * (million // 8), "<a" + " " * million + ">", "x" * million]
    for text in texts:
        start = time.process_time()
        blocks(text)
        assert time.process_time() - start < 5, text[:12]


def brute(pages, run, least):
    where = {}
    for page in pages:
        for i in range(len(page) - run + 1):
            where.setdefault(tuple(page[i : i + run]), set()).add(id(page))
    out = []
    for page in pages:
        m = np.zeros(len(page), dtype=bool)
        for i in range(len(page) - run + 1):
            if len(where[tuple(page[i : i + run])]) >= least:
                m[i : i + run] = True
        out.append(m)
    return out


def test_suffix_array_finds_all_repeats():
    for seed in range(30):
        rng = random.Random(seed)
        pages = [[rng.choice("abc") for _ in range(rng.randint(0, 20))] for _ in range(rng.randint(0, 6))]
        for run, least in ((2, 2), (3, 3), (5, 2)):
            assert all((a == b).all() for a, b in zip(covered_masks(pages, repeated(pages, run, least), run), brute(pages, run, least)))


def texts_of(spark, rows, **config):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {}
    for r in extract_pages(pages, ExtractConfig(**config)).collect():
        assert r.n_chars == len(r.text)
        got.setdefault(r.page_id, []).append(r.text)
    return got


def test_host_boilerplate_goes_where_no_article_tells(spark):
    same = "welcome to our shop where all things are cheap today"
    rows = [(k, f"https://Shop.example.com/{k}", f"<body><p>{same}</p><p>page {k} {' '.join(f'own{k}x{j}' for j in range(k + 1))}</p></body>") for k in range(6)]
    rows += [(50, "https://other.example.com/", f"<p>{same}</p>"), (51, None, None), (52, "nourl", ""), (0, rows[0][1], rows[0][2]), (53, "https://shop.example.com/z", f"<article><p>{same}</p></article>")]
    got = texts_of(spark, rows)
    assert got[2] == ["page 2 own2x0 own2x1 own2x2"] and len(got[0]) == 2
    assert got[50] == [same] and got[53] == [same] and got[51] == [""] and got[52] == [""]
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_menus_of_pages_with_articles_go_from_pages_without(spark):
    menu = "".join(f"<div>{w}</div>" for w in ("Home", "News", "About us", "Shop", "Contact", "Imprint"))
    rows = [(k, f"http://h/{k}", f"{menu}<article><p>{' '.join(f'a{k}x{j}' for j in range(9))}</p></article>") for k in range(4)]
    rows += [(9, "http://h/9", f"{menu}<div>the only text here</div>"), (10, None, f"{menu}<div>elsewhere</div>")]
    got = texts_of(spark, rows)
    assert got[9] == ["the only text here"] and got[10][0].startswith("Home\n\nNews")


def test_the_text_does_not_depend_on_the_parts(spark):
    rng = random.Random(3)
    notice = "this notice stands on many pages of the host for all to read"
    rows = []
    for k in range(40):
        own = " ".join(f"w{rng.randrange(5000)}" for _ in range(30))
        rare = "a line that two pages of the host have and no more" if k in (3, 30) else "x"
        rows.append((k, f"http://big/{k}", f"<div>{notice if k % 4 == 0 else 'none'}</div><p>{own}</p><p>{rare}</p>"))
    rows += [(100, "http://big/c", rows[1][2]), (101, "http://big/d", rows[1][2]), (102, "http://big/e", None), (102, "http://big/e", None)]
    want = texts_of(spark, rows)
    assert not any(notice in t for texts in want.values() for t in texts)
    assert all("a line that two pages" in want[k][0] for k in (3, 30)) and want[1][0] == want[100][0] != ""
    assert texts_of(spark, rows, block_chars=600) == want
