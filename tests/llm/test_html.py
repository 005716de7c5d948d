import html as entities
import random
import re

import pytest
from memlake.llm import html
from pyspark.sql import functions as F


def article(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    return " ".join(entities.unescape(re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1|br)>", " ", inner))).split())


def test_whole_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {r["page_id"]: article(r["html"]) for r in pages.collect()}
    got = html.op3_main_text(pages).collect()
    assert {r["page_id"]: r["text"] for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def body(k):
    return [f"Heading number {k}", f"First &amp; foremost,\n  paragraph {k} tells of thing{k} at <i>some</i> length, with a few more words than that.", f"Second paragraph {k * 7} goes on about matter{k * 3} and ends here; it isn't short either."]


def text_of(k):
    return " ".join(entities.unescape(re.sub(r"<[^>]+>", "", p)).replace("\n ", "").replace("  ", " ") for p in body(k)).replace("foremost, paragraph", "foremost, paragraph")


LAYOUTS = {
    "divs": lambda k, b: f"<html><body><div id=top class='site-header'>My site {k}</div><div class=wrap><div class=left-menu><ul><li><a href=/{k}>Link {k}</a><li><a>More {k}</a></ul></div><div id=c><h2>{b[0]}</h2><p>{b[1]}<p>{b[2]}<div class=share>Share {k}</div></div></div><div class='cookie-notice'>We use cookies {k}</div><div id=foot>All rights reserved. The same text stands on each page of this host, always.</div></body>",
    "table": lambda k, b: f"<table><tr><td width=100><a>Home {k}</a><br><a>News {k}</a><td><h3>{b[0]}</h3>{b[1]}<br><br>{b[2]}<form><input><button>Send {k}</button></form></td></tr></table><script>var x='<p>no {k}</p>'</script>",
    "main": lambda k, b: f"<main><section class=post><h1>{b[0]}</h1><p>{b[1]}</p><p>{b[2]}</p></section><section class=comments><p>Reader {k} says that this is quite long, and adds many words to it so that it is seen.</p></section></main><footer>Foot {k}</footer>",
    "article": lambda k, b: f"<ARTICLE><H1>{b[0]}</H1><P>{b[1]}</P><aside>Aside {k}</aside><P>{b[2]}</P><!-- <p>gone {k}</p> --></ARTICLE><aside><p>Sidebar {k} with a good many words in it, too many in fact for a sidebar, but so it is.</p></aside>",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(spark, name):
    rows = [(k, f"https://{name}.example.org/{k}", LAYOUTS[name](k, body(k))) for k in range(12)]
    got = {r["page_id"]: r["text"] for r in html.op3_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(12):
        assert got[k] == re.sub(r"\s+", " ", text_of(k)), k


def told(spark, pages):
    rows = spark.createDataFrame([(k, "http://a.example/", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    return {r["page_id"]: (r["text"], r["by_wrapper"]) for r in html.main_text(rows).collect()}


def test_constant_text_is_template_and_copies_are_no_evidence(spark):
    page = lambda k: f"<body><div><p>Read this first: terms apply to all that follows.</p><p>{body(k)[1]}</p><p>{body(k)[2]}</p></div></body>"
    made = told(spark, [page(k) for k in range(9)])
    assert all("terms apply" not in t and f"Second paragraph {k * 7} " in t and by for k, (t, by) in made.items())
    same = told(spark, [page(1)] * 5)
    assert all("terms apply" in t and not by for t, by in same.values())


def test_articles_in_parts_lose_none(spark):
    part = lambda k, n: f"<section><h2>Part {n} of {k}</h2><p>{body(k * 10 + n)[1]}</p></section>"
    page = lambda k: f"<body><div id=x>Top {k}</div><div id=c>{''.join(part(k, n) for n in range(3))}<div>Small {k}</div>{part(k, 4)}</div><div id=z>All of it is ours {k}.</div></body>"
    made = told(spark, [page(k) for k in range(6)])
    for k, (t, by) in made.items():
        assert by and t.startswith(f"Part 0 of {k} ") and f" Small {k} " in t and f"thing{k * 10 + 4} " in t and "Top" not in t and "ours" not in t


def test_noise_below_any_depth():
    page = "<div>" * 400 + "a<nav>menu</nav><p>said <b>here</b></p>" + "</div>" * 400
    assert " ".join(b[3] for b in html.analysed(page, None) if b[2]) == "a said here"


def test_the_wrapper_alone_tells_the_article(spark):
    """Pages that no list of tags or classes helps with, since all boxes are plain ones: the aligned places decide."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    assert {r["by_wrapper"] for r in html.main_text(pages).select("by_wrapper").distinct().collect()} == {True}
    want = {r["page_id"]: article(r["html"]) for r in pages.collect()}
    plain = F.regexp_replace("html", r"(</?)(?:article|nav|footer|header|aside|main|form)\b", "$1div")
    plain = F.regexp_replace(plain, r'<div class="[^"]*"', "<div")
    got = {r["page_id"]: r["text"] for r in html.main_text(pages.withColumn("html", plain)).collect()}
    assert sum(got[k] != t for k, t in want.items()) == 0


def test_odd_rows_by_both_ways(spark, monkeypatch):
    rows = [(1, None, None), (2, "not a url", ""), (3, "http://A.example/x", "<p>a<b>b</b>c &lt;x&gt; &#233;"), (3, "http://A.example/x", "<p>a<b>b</b>c &lt;x&gt; &#233;"), (None, "http://a.example", "<" * 50), (5, "http://b.example", "<div>" * 3000 + "deep" + "</div>" * 10), (6, "http://c.example/", "<p>" + "word " * 30000), (7, "http://c.example/", "no tags at all"), (8, "http://c.example/", "<nav>menu</nav>")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in html.op3_main_text(pages).collect()), key=str)
    by = {r[0]: r[2] for r in got}
    assert len(got) == 9 and by[1] == by[2] == by[8] == "" and by[3] == "abc <x> é" and by[5] == "deep" and by[6] == ("word " * 30000).strip() and by[7] == "no tags at all"
    monkeypatch.setattr(html, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(html, "SALT_ROWS", 2)
    assert sorted((tuple(r) for r in html.op3_main_text(pages).collect()), key=str) == got
    assert html.op3_main_text(pages.limit(0)).count() == 0


def test_long_lists_of_children_are_paired_as_short_ones(monkeypatch):
    rng = random.Random(8)

    def page(n):
        inner = ["said", "<b>b</b>", "<b>b</b>c", "<i>i<u>u</u></i>", "<ul><li>1<li>2</ul>", ""]
        return html.parse("".join(f"<{t}>{rng.choice(inner)}{rng.choice(inner)}</{t}>" for t in rng.choices(["p", "div", "h2", "section"], k=n)))

    for n, m in [(1, 1), (2, 9), (30, 25), (60, 61), (50, 7), (100, 99)] * 3:
        a, b, made = page(n), page(m), []
        for cells in (10**9, 0):
            monkeypatch.setattr(html, "CELLS", cells)
            made.append([(id(x), id(y)) for x, y in html.Match().pairs(a, b)])
        assert made[0] == made[1]


def test_no_length_of_a_list_loses_its_pairs():
    for n in (5, 100, 900, 3000):
        page = lambda tag: html.parse(f"<{tag}>x</{tag}>" + "<p>said <b>so</b></p>" * n + f"<{tag}>y</{tag}>")  # noqa: E731, B023
        assert len(html.Match().pairs(page("h2"), page("h3"))) == 1 + 4 * n
