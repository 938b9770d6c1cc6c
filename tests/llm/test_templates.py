from __future__ import annotations

import html
import re

from quillwork.llm import templates
from quillwork.llm.templates import extract_group, extract_main_text, pieces_of, skeleton

SHELL = """<!DOCTYPE html><html><head><title>{t}</title><style>p{{}}</style><script>if (a<b) x="</p>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a href="/a">Menu</a></li><li>More</li></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="sidebar">Popular</div>
{main}
<section class="comments"><p>First!</p></section><form><label>Mail</label><input name=q></form><footer>&copy; us {t}</footer></body></html>"""


def test_article_with_everything_around_it():
    pages = [SHELL.format(t=i, main=f"<article><h1>Title {i}</h1><p>One &amp;  two\n{i}<p>Three<br>four <b>bold</b>text"
                          f"<!-- no --><aside>Advert</aside><ul><li>x</li><li>y</li></ul></article>") for i in range(5)]
    assert extract_group(pages) == [f"Title {i}\nOne & two {i}\nThree\nfour boldtext\nx\ny" for i in range(5)]
    tokens = [t for t, _ in skeleton([pieces_of(p) for p in pages])]
    assert tokens.index("+article") < tokens.index("/article") < tokens.index("--footer")


def test_without_an_article_the_slots_that_vary_are_taken():
    pages = [SHELL.format(t=i, main=f"<div class=promo>Buy</div><div><p>Same on all pages</p></div><section><p>Body {i}</p></section>") for i in range(4)]
    assert extract_group(pages) == [f"Body {i}" for i in range(4)]
    assert extract_group(["<div><p>Only page</p></div>"]) == ["Only page"]


def test_copies_of_a_page_keep_their_article():
    page = SHELL.format(t="x", main="<article><p>Copied text</p></article>")
    assert extract_group([page] * 3) == ["Copied text"] * 3


def test_broken_markup():
    assert extract_group(["<article><p>a <b>b<p>c</article><footer>f"]) == ["a b\nc"]
    assert extract_group(["<article><p>2 < 3 &am &#65; &nbsp;x</p><script>var t='</article>'"]) == ["2 < 3 &am A x"]
    assert extract_group(["", "no tags", "<p", "<article>cut <p cla"]) == ["", "no tags", "", "cut"]


def test_rows(spark):
    pages = [(i, f"https://Ex.com:80/{i}", SHELL.format(t=i, main=f"<article><p>Body {i}</p></article>"), "u") for i in range(40)]
    rows = pages + [(100, None, None, "u"), (None, "https://ex.com/x", "<article>Keyless</article>", None), (101, "x", "", None), pages[3]]
    rows.append((102, "https://long.example/", "<article>" + "<p>word word</p>" * 40_000 + "</article>", ""))
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in extract_main_text(df, group_pages=7).collect()), key=str)
    assert len(got) == len(rows)
    texts = {r[0]: r[2] for r in got}
    assert all(texts[i] == f"Body {i}" for i in range(40)) and texts[100] == texts[101] == "" and texts[None] == "Keyless"
    assert texts[102].count("\n") == 39_999 and all(r[3] == len(r[2]) for r in got)
    assert extract_main_text(df.limit(0)).count() == 0


def test_against_a_plain_reading_of_the_given_pages(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in extract_main_text(df).collect()}
    for row in df.collect():
        a, b = row.html.find("<article>"), row.html.find("</article>")
        body = row.html[a : b if b >= 0 else None]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:h1|p|br|article)>", body)]
        assert got[row.page_id] == "\n".join(x for x in blocks if x)


def test_suspicious_wrappers_of_an_article_do_not_hide_it():
    page = (
        '<body class="has-sidebar"><div class="layout with-sidebar"><article><div class="entry-header"><h1>Head</h1></div>'
        '<p>Body</p><div class="share">Tweet</div></article></div>'
        '<ol class="comment-list"><li><article class="comment"><p>First</p></article></li></ol></body>'
    )
    assert extract_group([page] * 2) == ["Head\nBody"] * 2


def test_unclosed_elements_do_not_take_the_rest_of_the_page():
    for name in ("button", "select", "svg", "object", "noscript", "canvas", "audio", "video", "math", "iframe", "template"):
        assert extract_group([f"<div><{name}>x</div><article><p>Body</p><p>More</p></article>"]) == ["Body\nMore"], name
        assert extract_group([f"<article><p>Body</p><{name}><p>More</p></article><footer>f</footer>"]) == ["Body\nMore"], name
    assert extract_group(["<article><p>a</p><button><b>Like</b></button><p>b</p><svg><g><text>s</text></g></svg></article>"]) == ["a\nb"]


def test_formulas_and_fallback_text_of_an_article_stay():
    page = "<noscript>Turn it on</noscript><article><p>If <math><mi>x</mi></math></p><object><p>Chart</p></object><noscript><p>Plain</p></noscript></article>"
    assert " ".join(extract_group([page])[0].split()) == "If x Chart Plain"


def test_an_article_that_mentions_its_comments_stays():
    for kind in ('class="post comments-open"', 'id="post-7-replies"', 'class="entry has-related"'):
        assert extract_group([f"<article {kind}><p>Body</p></article>"]) == ["Body"], kind
    assert extract_group(['<article><p>Body</p></article><article class="comment even"><p>First</p></article>']) == ["Body"]


def test_copies_of_pages_without_an_article_keep_their_text():
    page = "<div class=menu>Menu</div><div><p>Copied text</p></div>"
    assert extract_group([page] * 128) == ["Copied text"] * 128
    same = [f"<title>{i}</title><div><p>Copied text</p></div><div><b>!</b></div>" for i in range(4)]
    assert extract_group(same) == ["Copied text"] * 4


def test_the_text_of_a_page_does_not_depend_on_partitions(spark):
    one = [f"<div>Welcome</div><section><p>Body {i}</p></section>" for i in range(50)]
    rows = [(i, "http://a.org/", one[i % 50]) for i in range(150)] + [(200 + i, "http://b.org/", one[0]) for i in range(2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for n in (1, 3, 64):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            found.append({r.page_id: r.text for r in extract_main_text(df.repartition(n), group_pages=12).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2]
    assert all(found[0][i] == f"Body {i % 50}" for i in range(150))


def test_slots_take_notices_out_of_articles(monkeypatch):
    pages = [f"<article><h1>T {i}</h1><p>Body {i}</p><div>Buy our book</div><section><p>More {i}</p></section></article>" for i in range(20)]
    expected = [f"T {i}\nBody {i}\nMore {i}" for i in range(20)]
    assert extract_group(pages) == expected
    # a text of few pages stays, and an article that is only that
    assert "Buy our book" in extract_group(pages[:5])[0]
    same = [f"<title>{i}</title><i>{i}</i><article><p>All the same</p></article>" for i in range(20)]
    assert extract_group(same) == ["All the same"] * 20
    monkeypatch.setattr(templates, "skeleton", lambda pages: [])
    assert extract_group(pages) != expected
