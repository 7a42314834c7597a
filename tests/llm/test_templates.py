"""Operator 12: planted articles in several templates, and its defined results in odd cases."""

import random
import re
from html import unescape

import pytest

from curio.llm import html, templates

SCHEMA = "page_id long, url string, html string, host string, text string, packed string"
RNG = random.Random(3)


def words(n, rng=RNG):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "eta"]) + str(rng.randrange(50)) for _ in range(n))


def extracted(spark, pages, parts=3):
    """{page_id: text}; the table has clashing extra columns."""
    rows = spark.createDataFrame([(i, u, h, "x", "y", "z") for i, u, h in pages], SCHEMA).repartition(parts)
    got = templates.extract(rows).collect()
    assert all(r["n_chars"] == len(r["text"]) for r in got) and len(got) == len(pages)
    return {r["page_id"]: r["text"] for r in got}


def semantic(title, paragraphs, k):
    """A page whose elements say what they are."""
    return (
        f'<!doctype html><html><head><title>{title} | Site</title><style>p {{}}</style><script>if (a < b) document.write("<p>no</p>")</script></head><body class="has-sidebar">'
        f'<header class="site-header"><a href="/">Daily {k}</a><nav><ul><li><a href="/a">{words(2)}</a><li><a href="/b">{words(1)}</a></ul></nav></header>'
        f'<div class="cookie-notice" id="cc-{k}">We use cookies {words(4)}</div><main><article><header><h1>{title}</h1></header>'
        + "".join(f"<p>{p}" for p in paragraphs)
        + f'<aside>{words(9)}</aside><div class="share-buttons"><a href="#">Share</a></div><section class="comments"><h2>Comments</h2><article class="comment"><p>{words(30)}</p></article></section></article>'
        f'<div class="related"><p>{words(12)}</p></div></main><form action="/s"><input name=q> Search {words(2)}</form><footer><p>&copy; {words(3)}</p></footer></body></html>'
    )


def plain(title, paragraphs, k):
    """A page of nested div elements whose names say nothing, with fixed sentences within the text's container."""
    return (
        f"<html><body><div class=x1><div class=q>{''.join(f'<a href=/{i}>{words(2)}</a> ' for i in range(8))}</div><div class=x2><div class=x3><h2>{title}</h2>"
        + "".join(f"<p>{p}</p>" for p in paragraphs)
        + f"<p>All rights belong to nobody at all, they say.</p></div></div><div class=x4><a href=/l{k}>{words(6)}</a></div></div></body></html>"
    )


def named(title, paragraphs, k):
    """A page of div elements whose names say what they are."""
    return (
        f'<html><body id=top><div id="page{k}" class="hfeed site"><div id="masthead"><p>Blog {words(1)}</p><ul class="mainNav"><li><a href=/a>{words(1)}</a></li></ul></div>'
        f'<div id="content" class="site-content"><div class="adbox">{words(7)}</div><h1 class="entry-title" data-role="navigation" title="class=ad">{title}</h1><div class="entry-content post-{k}">'
        + "<br><br>".join(f"<span class=lead>{p}</span>" for p in paragraphs)
        + f'</div><div hidden>{words(40)}</div><div style="display: none">{words(40)}</div></div><div id="secondary" class="widget-area sidebar2"><p>{words(50)}</p></div>'
        f'<ol class="commentlist"><li>{words(60)}</li></ol><div id="cookieBar">{words(3)}</div><form><label>Mail {words(2)}</label></form><div class="siteFooter">{words(2)}</div></div></body></html>'
    )


@pytest.mark.parametrize("layout", [semantic, plain, named])
def test_article_of_a_template(spark, layout):
    pages, want = [], {}
    for k in range(24):
        title, paragraphs = words(5), [words(RNG.randrange(8, 40)) for _ in range(RNG.randrange(2, 6))]
        pages.append((k, f"https://www.one.example/{k}?p=2", layout(title, paragraphs, k)))
        want[k] = " ".join([title, *paragraphs])
    assert extracted(spark, pages) == want


def test_hosts_of_one_page_and_copies(spark):
    title, paragraphs = words(5), [words(20), words(20)]
    text = " ".join([title, *paragraphs])
    alone = [(1, "http://a.example/", semantic(title, paragraphs, 1)), (2, None, semantic(title, paragraphs, 1)), (3, "no url", semantic(title, paragraphs, 1)), (4, "http://b.example", plain(title, paragraphs, 1))]
    copies = [(10 + i, "http://c.example/x", semantic(title, paragraphs, 1)) for i in range(9)]  # an article on every page of its host is no template
    got = extracted(spark, alone + copies)
    assert {got[i] for i in (1, 2, 3, *range(10, 19))} == {text}
    assert got[4] == f"{text} All rights belong to nobody at all, they say."


def test_odd_pages(spark):
    long = "word " * 60_000
    pages = [
        (1, "http://a.example", None),
        (2, "http://a.example", ""),
        (3, None, "just text &amp; more &lt;b&gt;"),
        (4, "http://u@B.example:80/x", "<article><p>a<b>b</b>c &nbsp; d\n\te</p><p></p><p> </p>f<br>g <script>x</p></script><!-- <p>h</p> -->i"),
        (5, "http://b.example", "<article>&am; &amp &#x41;&notanentity; 1 < 2 <3 </article><p>after"),
        (5, "http://b.example", "<article>same id</article>"),
        (None, "http://b.example", f"<article>{long}</article>"),
        (6, "http://b.example", "<article><p title='>'>q</p><unclosed"),
        (7, "http://b.example", "<div class=ad><p>x</div><article>y</p></div>z<nav>n"),
    ]
    rows = spark.createDataFrame([(i, u, h, "x", "y", "z") for i, u, h in pages], SCHEMA)
    got = [tuple(r) for r in templates.extract(rows).select("page_id", "text", "n_chars").collect()]
    want = {1: [""], 2: [""], 3: ["just text & more <b>"], 4: ["abc d e f g i"], 5: ["&am; & A¬anentity; 1 < 2 <3", "same id"], None: [long.strip()], 6: ["q"], 7: ["y z"]}
    assert sorted(map(repr, got)) == sorted(repr((i, t, len(t))) for i, texts in want.items() for t in texts)
    assert templates.extract(rows.limit(0)).count() == 0


def test_classes_need_order_and_one_slot():
    import pandas as pd

    nests = pd.DataFrame([(1, 0, 2, 5), (2, 0, 1, 3), (2, 0, 2, 3), (3, 2, 0, 4)], columns=["c", "other", "slot", "n"])
    occurs = pd.DataFrame([(0, 5), (1, 5), (2, 6), (3, 4), (4, 9)], columns=["c", "n"])
    kinds = {"nests": nests, "occurs": occurs, "disorder": pd.DataFrame([(4, 1)], columns=["c", "n"])}
    # 2 occurs in two slots of 0; 3 nests only in it, and so is outermost among what is valid; 4 is out of order
    assert templates._valid(kinds, 6) == [0, 1, 3]
    assert templates._in_order([[1, 5], [2, 6], [3, 7]]) == [1, 2, 3, 5, 6, 7] and templates._in_order([[1, 5], [6, 2]]) is None and templates._in_order([[1], []]) is None


def test_templates_joined_equal_templates_given(spark, monkeypatch):
    pages = [(k, f"https://h{k % 2}.example/{k}", plain(words(4), [words(20), words(9)], k)) for k in range(12)]
    want = extracted(spark, pages)
    monkeypatch.setattr(templates, "TEMPLATE_BYTES", 0)
    assert extracted(spark, pages) == want


def test_given_pages_against_a_plain_reading(spark):
    """All pages of the table have one article element, whose text a regular expression finds as well."""
    folder = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}

    def plainly(page):
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        blocks = (" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", inner))
        return " ".join(b for b in blocks if b)

    got = {r["page_id"]: r["text"] for r in templates.op12_html_extraction(spark, folder).collect()}
    assert got == {i: plainly(h) for i, h in pages.items()}


def test_parser_keeps_places():
    page = html.parse("<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table><p>x<div>y</div>")
    assert [(b.place.labels, b.text) for b in page.blocks] == [(">ul>li", "a"), (">ul>li", "b"), (">table>tr>td", "1"), (">table>tr>td", "2"), (">table>tr>td", "3"), (">p", "x"), (">div", "y")]
