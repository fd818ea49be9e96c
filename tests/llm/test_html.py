import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from playframe.llm import html as H


@pytest.fixture(scope="module")
def model(spark, sf):
    return H.fit(spark.read.parquet(f"{sf}/pages.parquet"))


def gold(source):
    """Text blocks of the article of a sample page, read plainly."""
    import html as entities
    import re

    body = source.split("<article>", 1)[1].split("</article>", 1)[0]
    parts = re.split(r"</?(?:p|h1)>", body)
    lines = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in parts]
    return "\n".join(x for x in lines if x)


def test_sample_pages_give_their_articles(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in H.extract(pages, model).join(pages.select("page_id", "html"), "page_id").collect():
        assert r["text"] == gold(r["html"]), r["page_id"]
        assert r["n_chars"] == len(r["text"])


FRAME = """<html><head><title>t</title><script>if (a<b) x('</p>')</script></head><body>
<div class="site-header"><h1>Site</h1></div><div id="menu"><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></div>
<div class="cookie-consent"><p>We use cookies on this site. Please accept them.</p><button>OK</button></div>
<div class="wrapper"><div class="post-content"><h1>A  title</h1><p>First &amp; long paragraph, with words, and more words. It goes on for a while.
<p>Second paragraph with <a href="/x">a link</a> inside, and<br>a break. It is long enough to be text.</p>
<div class="advert"><p>Buy this now, it is cheap.</p></div>
<blockquote>A quoted part, which belongs to the text, of course.</blockquote></div>
<div class="sidebar"><h3>Popular</h3><p>Some teaser text, that is not part of it.</p><ul><li><a href="/z">Other</a></li></ul></div>
<section id="comments"><h3>2 comments</h3><div class="comment"><p>I read this with joy, thank you. It was good.</p></div></section></div>
<form class="newsletter"><p>Sign up for our letter, it is free.</p><input></form><div class="footer">&copy; 2020 Site</div></body></html>"""


def test_another_frame(spark, model):
    pages = spark.createDataFrame([(1, "u", FRAME)], "page_id long, url string, html string")
    assert H.extract(pages, model).first()["text"].split("\n") == [
        "A title", "First & long paragraph, with words, and more words. It goes on for a while.",
        "Second paragraph with a link inside, and a break. It is long enough to be text.",
        "A quoted part, which belongs to the text, of course."]


def test_decoding_takes_the_best_states():
    rng = np.random.default_rng(1)
    page = H.Page("<div><p>aa</p><div>x<p>bb</p></div></div><p>c</p>")
    n = len(page.tag)
    for _ in range(60):
        odds = rng.normal(size=n) * 2
        score, own = page.scores(odds)
        best = None
        for states in itertools.product("DMK", repeat=n - 1):
            s = ("M", *states)
            pairs = [(s[page.parent[i]], s[i]) for i in range(1, n)]
            if any(p in (("K", "M"), ("D", "K"), ("D", "M")) for p in pairs):
                continue
            total = sum(score[i] if s[i] == "K" else -score[i] if s[i] == "D" else -abs(score[i]) * (1 if own[i] else 0.5) for i in range(1, n))
            total -= 24.0 * sum(p == ("K", "D") for p in pairs)
            if best is None or total > best[0] + 1e-9:
                best = (total, "\n".join(t for k, t, _ in page.runs if s[k] == "K"))
        assert page.decode(odds) == best[1]


ODD = [None, "", "plain text", "<p>", "<<>>", "<p class='a", "<div>a<div>b</div>c</div>", "<script>x", "<!-- a", "<p>a<b>b<p>c</b>d", "a" * 200000,
       "<div>" * 3000 + "deep" + "</div>" * 3000, "</p></div>", "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "<td>x<td>y", "&lt;p&gt; &nbsp; &#x41;&bogus;",
       "<title>t</title><textarea>x</textarea>y", "<p>a</p>\x00<p>b</p>", "<P CLASS=Nav>up</P>", "<p>end <di"]


def test_odd_pages(spark, model):
    pages = spark.createDataFrame([(i, None, t) for i, t in enumerate(ODD)] + [(None, "u", "<p>x"), (3, "u", "<p>")], "page_id long, url string, html string")
    out = H.extract(pages.withColumn("text", F.lit(1)), model).collect()
    assert len(out) == len(ODD) + 2
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    assert out[0]["text"] == out[1]["text"] == ""
    assert H.extract(pages.limit(0), model).count() == 0
    blocks = {i: [t for _, t, _ in H.Page(s).runs] for i, s in enumerate(ODD) if s is not None}
    assert blocks[6] == ["a", "b", "c"] and blocks[7] == [] and blocks[9] == ["ab", "cd"]
    assert blocks[13] == ["a", "b", "c", "d"] and blocks[15] == ["<p> A&bogus;"] and blocks[16] == ["y"] and blocks[19] == ["end"]


def test_without_a_labelled_page(spark):
    pages = spark.createDataFrame([(1, "u", "<nav>n</nav><p>text</p>")], "page_id long, url string, html string")
    assert H.fit(pages) is None
    assert H.extract(pages, None).first()["text"] == "text"
    assert H.fit(pages.limit(0)) is None


def test_few_labelled_pages_in_a_large_table(spark, sf):
    """Labels are looked for before the sample is drawn, and past elements in comments."""
    plain = spark.range(2000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(
        F.lit("<!-- <article> --><div>text "), F.col("id").cast("string"), F.lit("</div>")).alias("html"))
    few = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").limit(6)
    assert H.fit(plain.union(few), H.Extract(train_pages=4, trees=2, depth=2)) is not None
    bare = plain.withColumn("html", F.regexp_replace("html", "<!--.*-->", ""))
    assert H.fit(bare.union(few), H.Extract(train_pages=4, trees=2, depth=2)) is not None


@pytest.mark.parametrize("part", ["<a ", '<a b="', "<object>", "<div><p>", '<a ">"', "<div></b>", "<li><div>", "<table><td><div>", "<!x ", "<", "<a<b", '<a b="x\'>'])
def test_a_long_page_of_open_tags_takes_no_long_time(part):
    import time

    begin = time.process_time()
    page = H.Page(part * (1_000_000 // len(part)))
    page.decode(np.zeros(len(page.tag)))
    assert time.process_time() - begin < 10


def test_marks_of_own_frames_count_in_own_frames_only():
    page = '<body><div data-gold="1"><p>text</p></div></body>'
    assert H.Page(page).labels() is None and H.Page(page, framed=True).labels() is not None


def test_ends_of_tags():
    for source, runs in (('<p a=">">x</p>', ["x"]), ("<p a='>\"'>x", ["x"]), ('<p a="b>x</p>y', ["x", "y"]), ("a<b", ["a"]), ("a <", ["a <"]),
                         ("x<!-- <p> -->y", ["xy"]), ("<p>a<![CDATA[ > <p>]]>b", ["ab"]), ("<!doctype html>x", ["x"]), ("<?x y>z", ["z"]),
                         ("x<p <b>y", ["x", "y"]), ("x<!-- y", ["x"]), ("1 < 2 > 0", ["1 < 2 > 0"])):
        assert [t for _, t, _ in H.Page(source).runs] == runs, source
