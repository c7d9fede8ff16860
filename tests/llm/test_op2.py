"""op2 on small Parquet tables, with rows in any order."""

import html

from pyspark.sql import functions as F

from tempora.llm import html_text


def test_op2_leaves_boilerplate_out(spark, tables):
    keep = [
        ("<article><p>x</p><span class=\"ad\">buy</span><div class=\"newsletter-content\">sub</div><div class=\"comment content\">rant</div></article>", "x"),
        ("<main class='content has-sidebar'><p>a <a class='promo'>b</a>c</p><div class='sidebar-content'>d</div><ol id=commentList><li>e</ol></main>", "a c"),
        ("<div id=main-content class=layout-sidebar><p>a</p><article class=comment-body>b</article><section role=navigation>c</section></div>", "a"),
        ("<article><pre><span class=comment># code</span> runs</pre><p hidden>h<p>t</article>", "# code runs t"),
        ("<article><p>foo<span class=ad><span>q</span>buy</span>bar</p></article>", "foobar"),
        ("<article><div/>in</article>", "in"),
        ("<!--><article>a<!-- <p>b --!>c</article><!-- d", "ac"),
        ("<article>a < b &lt;p&gt; &amp;amp;\u00a0\n c</article>", "a < b <p> &amp; c"),
    ]
    rows = [(k, f"http://h{k}.example/", h) for k, (h, _) in enumerate(keep)] + [(90, None, None), (91, "http://e.example/", "")]
    d = tables("pages", rows + rows[:1], "page_id long, url string, html string")
    got = html_text.op2_html_extraction(spark, d).collect()
    want = [(k, u, keep[k][1] if k < 90 else "") for k, u, _ in rows + rows[:1]]
    assert sorted(((r["page_id"], r["url"], r["text"]) for r in got), key=str) == sorted(want, key=str)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.op2_html_extraction(spark, tables("pages", [], "page_id long, url string, html string")).count() == 0


def test_op2_reads_broken_and_deep_pages(spark, tables):
    rows = [
        ("<article><p>one<img alt=\"" + "a>" * 70_000 + "\">two</p></article>", "onetwo"),
        ("<article><p>hi</p><a href=" + "\"" * 2001 + " x <p>more</p></article>", "hi more"),
        ("<div>" * 20_000 + "deep" + "</span>" * 20_000, "deep"),
        ("<p>t" + "<a " * 50_000, "t"),
        ("<p>t" + "<!" * 50_000, "t"),
        ("<p>t<script>" + "</script " * 50_000, "t"),
        ("<p>" + "<b x=\"" * 20_001 + "y", ""),
        ("<p>" + "&amp; " * 100_000, " ".join(["&"] * 100_000)),
    ]
    d = tables("pages", [(k, f"http://h{k}.example/", h) for k, (h, _) in enumerate(rows)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_text.op2_html_extraction(spark, d).collect()} == {k: t for k, (_, t) in enumerate(rows)}


def test_op2_follows_the_host(spark, tables):
    # most pages of the host show that .story holds the text; on some a list of teasers is longer
    story, teasers = "<div class='story s{k}'><p>{t}</p></div>", "<div class='teasers'><p>{t}</p></div>"
    rows, want = [], {}
    for k in range(40):
        text, other = f"story {k} " * (3 if k % 5 == 0 else 60), "tease " * 50
        rows.append((k, f"https://Host.example:80/{k}", "<body>" + story.format(k=k, t=html.escape(text)) + teasers.format(t=other)))
        want[k] = text.strip()
    rows.append((99, "http://other.example/", "<body>" + story.format(k=0, t="short") + teasers.format(t="tease " * 50)))
    d = tables("pages", rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.op2_html_extraction(spark, d).collect()}
    assert got.pop(99) == ("tease " * 50).strip() and got == want
    again = html_text.extract(spark.read.parquet(f"{d}/pages.parquet").withColumns({"text": F.lit(1), "n_chars": F.lit(2), "_host": F.lit(3)}))
    assert {r["page_id"]: (r["text"], r["n_chars"], r["_host"]) for r in again.collect() if r["page_id"] < 99} == {k: (t, 2, 3) for k, t in want.items()}


def test_op2_takes_names_as_hints_only(spark, tables):
    article = "<article class='post comments-open'><p>main text</p>{}</article>"
    cases = [
        ("", "main text"),
        # names that mislead stay, in the middle and at the end
        ("<p class='social-history'>b</p><p class='share-price'>c</p><div class='notice-of-motion'>d</div><div id='ad-history'>e</div>", "main text b c d e"),
        ("<section class='discussion'><h2>Discussion</h2><p>of results</p></section><p>end</p>", "main text Discussion of results end"),
        ("<section class='discussion'><h2>Discussion</h2><p>of results</p></section>", "main text Discussion of results"),
        # readers' parts and adverts of other names go where they follow the text, or are links
        ("<section class='kommentare'><p>rant</p></section>", "main text"),
        ("<div class='user-feedback'>rant</div>", "main text"),
        ("<div class='discussion'><p>I disagree</p></div>", "main text"),
        ("<div class='outbrain'>Sponsored links</div><ol class='commentaires'><li>a</li></ol>", "main text"),
        ("<div class='taboola'><a href=x>buy this</a></div><p>end</p>", "main text end"),
        ("<div class='share-price'><a href=x>tell others</a></div><p>end</p>", "main text end"),
        ("<div class='comment-body'>rant</div><p>end</p>", "main text end"),
    ]
    rows = [(k, f"http://n{k}.example/", article.format(h)) for k, (h, _) in enumerate(cases)]
    rows.append((99, "http://n99.example/", "<div class='kommentare'><p>all there is</p></div>"))
    d = tables("pages", rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.op2_html_extraction(spark, d).collect()}
    assert got == {k: t for k, (_, t) in enumerate(cases)} | {99: "all there is"}


def test_op2_leaves_the_hosts_own_blocks_out(spark, tables):
    foot = "<div><p>Privacy policy</p><p>Copyright 2020</p></div>"
    page = lambda k: f"<body><div><p>story {k} of this site, told at some length</p><p>{'a passage that two pages share' if k < 2 else f'more {k}'}</p></div>{foot}"
    rows = [(k, "http://site.example/x", page(k)) for k in range(6)]
    rows += [(10 + k, "http://copies.example/y", f"<body><div><p>the same story on every page</p></div><div><p>{k}</p></div>") for k in range(6)]
    rows += [(20 + k, "http://few.example/z", page(k)) for k in range(2)]
    d = tables("pages", rows, "page_id long, url string, html string")
    for bytes_ in (html_text.BROADCAST_BYTES, 0):
        got = {r["page_id"]: r["text"] for r in html_text.extract(spark.read.parquet(f"{d}/pages.parquet"), bytes_).collect()}
        assert {k: got[k] for k in range(6)} == {k: f"story {k} of this site, told at some length " + ("a passage that two pages share" if k < 2 else f"more {k}") for k in range(6)}
        assert {k: got[k] for k in range(10, 16)} == {10 + k: f"the same story on every page {k}" for k in range(6)}
        assert all(got[20 + k].endswith("Privacy policy Copyright 2020") for k in range(2))
