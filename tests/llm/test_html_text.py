import re

import pytest
from pyspark.sql import functions as F

from polarity.llm.html_text import best_container, extract, host_of, host_paths, main_text, parse

SHELL = "<!DOCTYPE html><html><head><title>t</title><script>var x='</p>';</script></head><body><nav><a href=/>Home</a></nav>{}<footer>&copy; x</footer></body></html>"


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("   ", ""), ("plain &amp; text", "plain & text"),
    (SHELL.format("<article><h1>A  title</h1><p>One\n two<p><b>Three<br>four</p></article>"), "A title\nOne two\nThree four"),
    (SHELL.format("<div class=ad>Buy</div><article><p>x &lt; y &copy &eacute;&#233;&nbsp;z</p></article>"), "x < y © éé z"),
    (SHELL.format("<article><p>text<form><input><p>no</form><aside>no</aside><p>more</article><section id=comments><p>long comment text that is not the article at all, really</section>"), "text\nmore"),
    (SHELL.format("<div id='content'><p>Body text of the page</p><div class='cookie-notice'>We use cookies</div><ul><li>a<li>b</ul></div>"), "Body text of the page\na\nb"),
    (SHELL.format("<article><!-- <p>no</p> --><p>yes</p><style>p{}</style><table><tr><td>c1<td>c2</table></article>"), "yes\nc1\nc2"),
    ("<article><p>cut off <a href='x", "cut off"), ("<article><p>a < b and c</p>", "a < b and c"),
    ("<body><header>top</header><article><header><h1>T</h1></header><p>x</article>", "T\nx"),
])
def test_extract(page, want):
    assert extract(page) == want


def test_container_paths_are_generalised():
    _, containers = parse('<body><div class="post-17 Main"><p>Some words, here.</p></div></body>')
    assert best_container(containers).path == "body>div.main.post-0"


def test_host_consensus_decides_where_a_page_alone_would_not(spark):
    page = "<body><div class='story'>{}</div><div class='extra'>{}</div></body>"
    rows = [(k, f"http://H.example:80/{k}", page.format("<p>" + "story text " * 20, "<p>extra")) for k in range(5)]
    rows += [(9, "http://h.example/9", page.format("<p>short story", "<p>" + "long extra text " * 9)), (10, "nohost", page.format("<p>short story", "<p>" + "long extra " * 9)),
             (11, None, None), (12, "http://other/", "<main><p>m</main>"), (9, "http://h.example/9", None)]
    df = spark.createDataFrame([(*r, "h", "t") for r in rows], "page_id long, url string, html string, host string, path string")
    assert {r[0]: r[1] for r in host_paths(df).collect()} == {"h.example": "body>div.story", "other": "main"}
    got = main_text(df, carry=["page_id", "host"])
    assert got.columns == ["page_id", "host", "text"]
    texts = {(r["page_id"], r["text"][:11]) for r in got.collect()}
    assert {(9, "short story"), (10, "long extra "), (11, ""), (12, "m"), (9, "")} <= texts and got.count() == len(rows)
    assert main_text(df.filter("page_id < 0")).collect() == []


def test_many_hosts_are_joined_by_shuffle(spark, monkeypatch):
    from polarity.llm import html_text
    monkeypatch.setattr(html_text, "FEW_HOSTS", 1)
    df = spark.createDataFrame([(k, f"http://h{k % 3}/{k}", f"<article><p>t{k}</article>") for k in range(20)], "page_id long, url string, html string")
    assert sorted((r["page_id"], r["text"]) for r in main_text(df).collect()) == [(k, f"t{k}") for k in range(20)]


def test_hosts(spark):
    urls = ["http://A.b/x", "https://u:p@c.d:8/x", "ftp://e", "x", None, "http:///p"]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(host_of(F.col("u")))
    assert [r[0] for r in df.collect()] == ["a.b", "c.d", "e", "", "", ""]


LONG = "A long sentence of the article, of which there are several. " * 8
BODY = f"<h1>The title</h1><p>The lead.</p><div class=body><p>{LONG}</p></div>"
WANT = f"The title\nThe lead.\n{LONG.strip()}"


@pytest.mark.parametrize("page,want", [
    *((SHELL.format(f"<div class='{c}'>{BODY}</div>"), WANT) for c in ("content has-sidebar", "no-sidebar", "page comments-open", "sidebar", "widget")),
    *((SHELL.format(f"<{t} class='post comments-open'>{BODY}</{t}>"), WANT) for t in ("article", "main")),
    (SHELL.format(f"<article><div class='entry-header'><h1>The title</h1></div><div class=header>By me</div><p>{LONG}</p></article>"), f"The title\nBy me\n{LONG.strip()}"),
    *((SHELL.format(f"<article><p {a}>{LONG}</p><p>End</p></article>"), f"{LONG.strip()}\nEnd")
      for a in ("data-state='hidden'", "title='a hidden gem'", "data-class='ad'", "data-role='menu'", "title='x class=ad'", "class=x class=ad")),
    (SHELL.format(f"<article>{BODY}<p hidden>no<p>yes</article>"), WANT + "\nyes"),
    (SHELL.format(f"<main><div>{BODY}</div><div class='related-links'>More of this</div></main>"), WANT),
    (SHELL.format(f"<div class=site-footer>no</div><div class=cookie-notice>{LONG}</div><div class='ad slot'>no</div><article><p>Short</article>"), "Short"),
    (SHELL.format(f"<div class=post><h1>The title</h1><p>The lead.</p><div class=x><p>{LONG}</p></div></div><div class=else><p>other</div>"), WANT),
])
def test_ordinary_layouts_keep_the_article(page, want):
    assert extract(page) == want


@pytest.mark.parametrize("page,want", [
    (SHELL.format(f"<form id=aspnetForm action=x><div class=story>{BODY}</div><input></form>"), WANT),
    (SHELL.format(f"<form><article>{BODY}<form><p>your name</p></form></article></form>"), WANT),
    *((SHELL.format(f"<article>{BODY}<div class='{c}'><p>No part of it</p><a href=x>See more</a></div></article>"), WANT)
      for c in ("related-articles", "newsletter-signup", "share-buttons", "cookie-policy", "share-buttons-top extra", "more-related-reading", "promo-card-x")),
    (SHELL.format(f"<article>{BODY}<div class=user-comments><div class=comment-body><p>{LONG * 3}</p></div></div></article>"), WANT),
    (SHELL.format(f"<main><header><h1>The title</h1></header><p>{LONG}</p></main>"), f"The title\n{LONG.strip()}"),
    (SHELL.format(f"<div class=page><div class='entry-header'><h1>The title</h1></div><p>{LONG}</p></div>"), f"The title\n{LONG.strip()}"),
    (SHELL.format(f"<article><p>{LONG}</p><div class='share-price-report'><p>{LONG}</p></div></article>"), f"{LONG.strip()}\n{LONG.strip()}"),
    (SHELL.format(f"<article>{BODY}<p class=share-price>The price rose.</p></article>"), WANT + "\nThe price rose."),
])
def test_what_is_left_out_is_told_by_held_text_and_links(page, want):
    assert extract(page) == want


def brute_scores(tree, share=0.6):
    """Score of each container of a nested list (containers are lists, blocks strings), outermost first."""
    own = sum(len(x) for x in tree if isinstance(x, str))
    inner = [brute_scores(x, share) for x in tree if isinstance(x, list)]
    return [own + share * sum(s[0] for s in inner), *(v for s in inner for v in s)]


def test_scores_equal_brute_force():
    import random
    r = random.Random(3)

    def tree(depth):
        return [tree(depth - 1) if depth and r.random() < 0.5 else "w" * r.randrange(1, 30) for _ in range(r.randrange(1, 5))]

    def html(t):
        return "".join(f"<p>{x}</p>" if isinstance(x, str) else f"<div>{html(x)}</div>" for x in t)

    for _ in range(50):
        t = tree(5)
        blocks, containers = parse(f"<div>{html(t)}</div>")
        assert [round(c.score, 6) for c in containers] == [round(v, 6) for v in brute_scores(t)]
        assert blocks[containers[0].first:containers[0].end] == re.findall("w+", html(t))


def test_deep_markup_takes_linear_time():
    import time
    for page in ("<div>x" * 40_000, "<b>" * 30_000 + "<p>x</span>" * 5_000, "<ul><li>x" * 20_000, "<form class=ad><div class=more-related-x>y" * 10_000):
        t = time.process_time()
        extract(page)
        assert time.process_time() - t < len(page) / 1e5 + 0.5
