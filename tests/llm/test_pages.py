"""Pages written by hand in layouts that the training pages do not copy, with the main text that a reader would keep."""

import time

from arborlake.llm import html_extract

PAGES = [
    (
        """<!doctype html><html><head><title>River | Daily Post</title></head><body class="home">
        <div id="masthead"><a href="/">Daily Post</a><div class="search-box"><form><input name=q><button>Go</button></form></div></div>
        <ul class="navbar"><li><a href="/n">News</a><li><a href="/s">Sport</a><li><a href="/w">Weather</a></ul>
        <div class="story-body"><h1>The river rises again</h1>
        <p>Water reached the <a href="/b">old bridge</a> on Monday, and the town closed two roads.</p>
        <p>Nobody was hurt. &ldquo;We moved the cars in time,&rdquo; said a shop owner.
        <div class="advert"><p>Buy boots now, half price today only.</p></div>
        <h2>What comes next</h2><p>More rain is due &mdash; the forecast speaks of 40&nbsp;mm.</p>
        <blockquote>It was worse in 1999.</blockquote></div>
        <div class="sidebar"><h3>Most read</h3><ol><li><a href=1>Cat stuck in a tree</a><li><a href=2>Mayor resigns</a></ol></div>
        <div id="footer">&copy; Daily Post. All rights reserved.</div></body></html>""",
        ["The river rises again", "Water reached the old bridge on Monday, and the town closed two roads.", "Nobody was hurt. “We moved the cars in time,” said a shop owner.", "What comes next", "More rain is due — the forecast speaks of 40 mm.", "It was worse in 1999."],
    ),
    (
        """<html><body><header><div class="logo">Cooks</div><nav><a href=/a>Soups</a> <a href=/b>Breads</a></nav></header>
        <div role="alert">We use cookies. <button>Accept</button></div>
        <main id="content"><h1>Lentil soup</h1><p>Serves four. Ready in an hour.</p>
        <table><tr><th>Lentils</th><td>200 g</td></tr><tr><th>Onion</th><td>one</td></tr></table>
        <pre>simmer
           40 minutes</pre><p>Season &amp; serve.</p></main>
        <section class="comments"><h3>Comments</h3><p>Lovely, thank you for this one!</p><p>I added carrots and it was great.</p></section>
        <footer><p>Contact | Imprint</p></footer></body></html>""",
        ["Lentil soup", "Serves four. Ready in an hour.", "Lentils", "200 g", "Onion", "one", "simmer 40 minutes", "Season & serve."],
    ),
    (
        """<body><div class="menu"><a href="#">Start</a></div><article class="post"><h2>Notes on stones</h2>
        <p>Granite is hard.<br>Chalk is not.</p><script>if (a < b) { write("<p>no</p>") }</script>
        <p>Slate splits <em>well</em>, sandstone <strong>less so</strong>.</p><aside class="related">Read also: <a href="x">All about sand</a></aside>
        <p>That is all.</p></article><div class="reader-comment"><p>First!</p></div><form class="newsletter"><label>Mail</label><input></form></body>""",
        ["Notes on stones", "Granite is hard. Chalk is not.", "Slate splits well, sandstone less so.", "That is all."],
    ),
    ("""<div class="nav"><a href=a>A</a> <a href=b>B</a></div><p>Only one paragraph stands here, without any wrapper around it.</p><p>And a second one.</p><div class="footer">(c) 2001 someone</div>""", ["Only one paragraph stands here, without any wrapper around it.", "And a second one."]),
]


def test_hand_written_layouts():
    crf, right, total = html_extract.trained(), 0, 0
    for page, main in PAGES:
        found = [b.text for b in html_extract.blocks(page) if not b.hidden]
        kept = html_extract.extract(page, crf)
        assert set(main) <= set(found), set(main) - set(found)
        right += sum((t in kept) == (t in main) for t in found)
        total += len(found)
        assert [t for t in kept if t in main] == main  # no main block lost, page order kept
    assert right / total >= 0.95, right / total


def test_deep_and_broken_pages_are_read_in_linear_time():
    crf = html_extract.trained()
    for page in ("<div>x" * 40_000, "<b>" * 20_000 + "<hr>x" * 20_000, "</p></b>" * 40_000 + "x", "<ul><li>a" * 20_000, '<a "' * 30_000, "<p class='" * 30_000, "<!--" * 30_000, "<" * 100_000):
        began = time.process_time()
        html_extract.extract(page, crf)
        assert time.process_time() - began < 5, page[:20]
    assert [b.text for b in html_extract.blocks('<div class="x>Hello</div>')] == ["Hello"]
    assert [b.text for b in html_extract.blocks("<p title='it>one</p><p>two</p>")] == ["one", "two"]
    assert len(html_extract.blocks("<p>" + "long text " * 1_000_000)[0].text) == 9_999_999


def test_pages_table(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = [(1, "u", PAGES[0][0], "clash", "c"), (1, "u", PAGES[0][0], "clash", "c"), (None, None, None, None, None), (2, "v", "", "x", "y"), (3, "w", "<p hidden>gone</p><p>seen text stands here.</p>", "", "")]
    out = html_extract.extract_pages(spark.createDataFrame(rows, schema))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted(out.collect(), key=lambda r: (r.page_id is None, r.page_id))
    assert got[0] == got[1] and got[0].text == "\n\n".join(PAGES[0][1]) and got[0].n_chars == len(got[0].text)
    assert [(r.text, r.n_chars) for r in got[2:]] == [("", 0), ("seen text stands here.", 22), ("", 0)]
    assert html_extract.extract_pages(spark.createDataFrame([], schema)).count() == 0
