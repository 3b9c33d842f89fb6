"""Sources and sinks (S1-S9, J1, U1) on own fixtures written to a temp folder."""

import json
import os

import pytest
from pyspark.sql import functions as F

from polarity.sources import articles as SA
from polarity.sources import files as SF
from polarity.sources import filters as SL
from polarity.sources import pages as SP
from polarity.sources import posts as SO


def write_json(folder, name, obj):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8") as fh:
        json.dump(obj, fh, indent=1)


@pytest.fixture
def article_landing(tmp_dir):
    land = os.path.join(tmp_dir, "articles")
    arts = [{"title": f"Acme item {i}", "description": f"Body {i}", "url": f"https://news.example.com:8443/a/{i}",
             "publishedAt": "2024-01-2%dT09:30:00Z" % (i % 10)} for i in range(12)]
    arts[1]["description"] = None
    arts[2]["title"] = None
    del arts[3]["publishedAt"]
    arts[4]["url"] = ""
    write_json(land, "acme.json", {"status": "ok", "company": "ACME", "articles": arts})
    write_json(land, "beta.json", {"status": "ok", "company": "BETA", "articles": []})
    write_json(land, "gamma.json", {"status": "error", "message": "rate limited", "company": "GAMMA"})
    return land


def test_article_source(spark, article_landing):
    arts, bad = SA.articles(spark, article_landing, per_company=10, as_of="2024-01-30")
    rows = {r.position: r for r in arts.collect()}
    assert len(rows) == 10 and set(rows) == set(range(1, 11))
    assert [r.company for r in bad.collect()] == ["GAMMA"]
    assert rows[1].text == "Acme item 0. Body 0" and rows[1].domain == "news.example.com:8443"
    assert rows[2].text == "Acme item 1. "            # null description
    assert rows[3].text is None                       # null title
    assert rows[4].date is None                       # missing timestamp in that row
    assert rows[5].domain == ""                       # empty url
    assert str(rows[1].date) == "2024-01-20" and rows[1].source_type == "news"
    urls = SA.url_list(arts, k=3).collect()
    assert [r.position for r in sorted(urls, key=lambda r: r.position)] == [1, 2, 3]
    assert all(r.url for r in SA.url_list(arts, k=20).collect())


def test_article_normaliser_fills_missing(spark):
    df = spark.createDataFrame([("t",)], "title string")
    out = SA.normalise_articles(df, as_of="2024-01-30").first()
    assert out.url == "" and out.domain == "" and out.text == "" and str(out.date) == "2024-01-30"


@pytest.fixture
def post_landing(tmp_dir):
    land = os.path.join(tmp_dir, "posts")
    data = [
        {"id": 10 ** 18 + 1, "text": "ACME ships the new model", "created_at": "2024-01-29T10:00:00Z",
         "author_id": 1, "lang": "en", "public_metrics": {"like_count": 3, "retweet_count": 1, "reply_count": 0}},
        {"id": 2, "text": "RT @someone: ACME again", "created_at": "2024-01-29T11:00:00Z", "author_id": 1,
         "lang": "en", "public_metrics": {"like_count": 0, "retweet_count": 0, "reply_count": 0}},
        {"id": 3, "text": "ACME nouvelle usine", "created_at": "2024-01-28T11:00:00Z", "author_id": 2,
         "lang": "fr", "public_metrics": {"like_count": 0, "retweet_count": 0, "reply_count": 0}},
        {"id": 4, "text": "who is this ACME fan", "created_at": "2024-01-28T12:00:00Z", "author_id": 99,
         "lang": "en", "public_metrics": {"like_count": 5, "retweet_count": 2, "reply_count": 1}},
        {"id": 5, "text": "old ACME news", "created_at": "2024-01-01T12:00:00Z", "author_id": 2,
         "lang": "en", "public_metrics": {"like_count": 5, "retweet_count": 2, "reply_count": 1}},
    ]
    users = [{"id": 1, "username": "first"}, {"id": 1, "username": "second"}, {"id": 2, "username": "two"}]
    write_json(land, "acme.json", {"company": "ACME", "data": data, "includes": {"users": users}})
    write_json(land, "empty.json", {"company": "ZED", "data": [], "includes": {"users": []}})
    return land


def test_post_source(spark, post_landing):
    raw = SO.explode_posts(SO.read_post_responses(spark, post_landing))
    rows = {r.id: r for r in raw.collect()}
    assert len(rows) == 5
    assert rows[10 ** 18 + 1].username == "first"     # author listed twice: first wins
    assert rows[4].username is None                    # author missing
    assert rows[4].like_count == 5
    ids = lambda **kw: sorted(r.id for r in SO.posts(spark, post_landing, **kw).collect())
    assert ids() == ids(days=30, as_of="2024-01-30") == [4, 5, 10 ** 18 + 1]
    assert ids(days=30, as_of="2024-01-30", days_cap=7) == [4, 10 ** 18 + 1]
    assert ids(per_company=1) == [10 ** 18 + 1]
    with pytest.raises(ValueError):
        SO.posts(spark, post_landing, days=7)
    kept = SO.posts(spark, post_landing)
    assert set(kept.columns) == {"id", "content", "date", "source", "company", "published_at"}


def test_no_hidden_cap_and_paged_order(spark, tmp_dir):
    land = os.path.join(tmp_dir, "pages")
    for page in range(3):
        data = [{"id": 1000 * page + k, "text": f"p{page} {k}", "created_at": "2024-01-29T10:00:00Z", "author_id": 1, "lang": "en",
                 "public_metrics": {"like_count": 0, "retweet_count": 0, "reply_count": 0}} for k in range(90)]
        write_json(land, f"page{page}.json", {"company": "ACME", "data": data, "includes": {"users": []}})
    assert SO.posts(spark, land).count() == 270
    assert SO.posts(spark, land, per_company=250).count() == 250
    first = sorted(r.id for r in SO.posts(spark, land, per_company=100).collect())
    assert first == [*range(90), *range(1000, 1010)]


def test_dates_are_utc_in_any_session_zone(spark):
    from polarity.functions.text import date_or
    stamps = ["2024-01-29T23:30:00Z", "2024-01-29T23:30:00", "2024-01-29", "2024-01-29 23:30:00-02:00", "2024-01-30T00:30:00+01:00", "bad", None, "2024-01-29T10:00:00.123Z"]
    want = ["2024-01-29", "2024-01-29", "2024-01-29", "2024-01-30", "2024-01-29", None, None, "2024-01-29"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(stamps)], "i int, s string").select("i", date_or("s").cast("string").alias("d"))
    for zone in ("UTC", "Pacific/Auckland", "America/Los_Angeles"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert [r.d for r in df.orderBy("i").collect()] == want, zone
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_csv_round_trip(spark, tmp_dir):
    df = spark.createDataFrame([(1, 'line one\nline two, with "quotes"'), (2, "plain"), (3, "  lead and trail  "), (4, ""), (5, None), (6, " "), (7, "\t\u00a0x")],
                               "id int, text string")
    path = os.path.join(tmp_dir, "csv")
    SF.write_csv(df, path)
    back = SF.read_text_csv(spark, path, "id int, text string")
    assert sorted(back.collect(), key=lambda r: r.id) == sorted(df.collect(), key=lambda r: r.id)
    flat = os.path.join(tmp_dir, "flat")
    SF.write_csv(df.filter("id > 1"), flat)
    assert SF.read_text_csv(spark, flat, "id int, text string", multi_line=False).exceptAll(df.filter("id > 1")).count() == 0
    other = os.path.join(tmp_dir, "nocsv")
    SF.write_csv(df.select("id"), other)
    with pytest.raises(ValueError):
        SF.read_text_csv(spark, other)
    part = os.path.join(tmp_dir, "parts")
    SF.write_parquet(df.withColumn("company", F.lit("ACME")), part, ["company"])
    assert os.path.isdir(os.path.join(part, "company=ACME"))


PAGES = {
    "article": ("<html><head><title> T1 </title></head><body><nav>menu</nav><article><h1>Head</h1>"
                "<p>First &amp; second</p><script>x()</script></article><footer>f</footer></body></html>",
                "T1", "HeadFirst & second"),
    "class": ("<html><body><div class='x story-body y'>Story <b>bold</b></div></body></html>", "", "Story bold"),
    "priority": ("<html><body><div class='entry-content'>late</div><div id='content-body'>id</div>"
                 "<div class='article-body'>class</div></body></html>", "", "class"),
    "itemprop": ("<html><body><span itemprop='articleBody'>prop text</span></body></html>", "", "prop text"),
    "main": ("<html><body><header>h</header><main>Main  text\n here</main></body></html>", "", "Main text here"),
    "body": ("<html><body><p>Just body</p><!-- hidden --></body></html>", "", "Just body"),
    "nothing": ("plain text without tags", "", ""),
    "nav_inside": ("<article>keep<nav>drop</nav> this</article>", "", "keep this"),
    "entities": ("<title>A &quot;q&quot;</title><article>x &lt; y &amp;&amp; z</article>", 'A "q"', "x < y && z"),
    "broken": ("<html><body><article><p>unclosed <b>tags<div>deep</article>tail", "", "unclosed tagsdeep"),
}


def test_page_extraction(spark):
    rows = [(k, f"https://site.example.com/{k}", v[0]) for k, v in PAGES.items()] + [("null", "http://x", None)]
    df = spark.createDataFrame(rows, "name string, url string, html string")
    parsed = SP.parse_pages(df)
    got = {r.name: r for r in parsed.collect()}
    for k, (_, title, text) in PAGES.items():
        assert got[k].title == title, k
        assert got[k].text == text, k
        assert got[k].error is None and got[k].domain == "site.example.com"
    assert got["null"].error == "missing html" and got["null"].text is None
    good, bad = SP.split_parsed(parsed)
    assert good.count() + bad.count() == df.count() and bad.count() == 1


def test_mentions_and_lookback(spark):
    df = spark.createDataFrame([(1, "Buy $ACME now", "2024-01-29 10:00:00"),
                                (2, "acme and beta", "2024-01-20 10:00:00"),
                                (3, "nothing here", "2024-01-30 23:59:59"),
                                (4, "academy is not acme-like?", "2024-01-31 00:00:00")],
                               "id long, text string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    comp = SL.companies_frame(spark, [("ACME", "acme"), ("BETA", "beta")])
    got = sorted((r.id, r.company) for r in SL.mentions(df, "text", "id", comp).collect())
    assert got == [(1, "ACME"), (2, "ACME"), (2, "BETA"), (4, "ACME")]
    assert [r.id for r in SL.mentions_one(df, "text", "beta").collect()] == [2]
    texts = spark.createDataFrame([(1, "Goldman  Sachs, again"), (2, "goldman and sachs"), (3, "3M up"), (4, "BRK.B. and brk b"), (5, "brkb 13m"), (6, None), (7, "sachs goldman sachs")],
                                  "id long, text string")
    comp = SL.companies_frame(spark, [("GS", "Goldman Sachs"), ("MMM", "3M"), ("BRK", "BRK.B"), ("NONE", "..."), ("NULL", None)])
    assert sorted((r.id, r.company) for r in SL.mentions(texts, "text", "id", comp).collect()) == [(1, "GS"), (3, "MMM"), (4, "BRK"), (7, "GS")]
    assert [r.id for r in SL.mentions_one(texts, "text", "BRK.B").collect()] == [4]
    assert [r.id for r in SL.mentions_one(df, "text", "$ACME").collect()] == [1]
    assert sorted(r.id for r in SL.lookback(df, "ts", "2024-01-30", 7).collect()) == [1, 3]
    assert sorted(r.id for r in SL.lookback(df, "ts", "2024-01-30", 30, cap=7).collect()) == [1, 3]
    plan = SL.lookback(spark.read.parquet("/root/testdata/sf0.001/events.parquet"), "ts", "2024-01-30", 7) \
        ._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan


def test_first_match_lookup(spark):
    from polarity.operators.joins import first_match_lookup
    left = spark.createDataFrame([(1, 10), (2, 11), (3, 12)], "eid int, uid int")
    right = spark.createDataFrame([(10, "b", 2), (10, "a", 1), (11, "c", 1)], "uid int, name string, pos int")
    out = {r.eid: r.name for r in first_match_lookup(left, right, "uid", "uid", order_col="pos").collect()}
    assert out == {1: "a", 2: "c", 3: None}
    out = {r.eid: r.name for r in first_match_lookup(left, right.coalesce(1), "uid", "uid").collect()}
    assert out == {1: "b", 2: "c", 3: None}


def test_a_cluster_session_must_name_a_shared_folder(spark, monkeypatch):
    from polarity import session

    class Context:
        master, getCheckpointDir = "spark://host:7077", staticmethod(lambda: None)

    class Session:
        sparkContext, conf = Context, {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session)


def test_pages_are_parsed_slab_by_slab(spark):
    """The pages of a batch are Python strings a slab at a time."""
    import pyarrow as pa
    from polarity.sources import pages
    html = [f"<article>{i} " + "x" * 5000 + "</article>" for i in range(400)] + [None, ""]
    taken = [len(x) for x in pages._slabs([pa.array(html), pa.array([None, None])])]
    assert sum(taken) == 404 and max(taken[:-1]) <= 60
    rows = spark.createDataFrame([(i, "http://a.b/c", h) for i, h in enumerate(html)], "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: (r.text, r.error) for r in pages.parse_pages(rows).collect()}
    assert got == {i: (None, "missing html") if h is None else (pages.extract(h)[1], None) for i, h in enumerate(html)}


def test_texts_are_searched_slab_by_slab(monkeypatch):
    """The texts of a batch become wide arrays a slab at a time."""
    import numpy as np
    import pyarrow as pa
    from polarity.sources import automaton

    class Shared:
        value = automaton._numbered([("Acme", "acme corp")])[0]

    seen, real = [], automaton.word_bounds
    monkeypatch.setattr(automaton, "word_bounds", lambda points, *more: seen.append(len(points)) or real(points, *more))
    texts = pa.array([f"{i} Acme Corp ".lower() + "word " * 1000 for i in range(400)])
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(400)), texts], names=["c0", "_text"])
    found = [r for b in automaton._search(Shared, ["c0"])([batch]) for r in b.to_pylist()]
    assert found == [{"c0": i, "_found": [0]} for i in range(400)]
    assert max(seen) <= 300_000
