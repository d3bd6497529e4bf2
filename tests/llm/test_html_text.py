import html as h
import random
import re

from orefield.llm.html_text import common_lines, extract, main_text, text_lines

SF = "/root/testdata/sf0.01"


def test_whole_table_against_article_markup(spark):
    from orefield.llm.queries import op10_page_difference

    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op10_page_difference(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        blocks = [" ".join(h.unescape(re.sub(r"<[^>]+>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1|article|div|ul|li)\b[^>]*>", article)]
        assert r.text == "\n".join(b for b in blocks if b)
        assert (r.url, r.n_chars) == (pages[r.page_id].url, len(r.text))


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignment_is_longest():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        got = sorted(common_lines(a, b))
        assert len(got) == lcs(a, b)
        rest = iter(b)
        assert all(any(a[k] == y for y in rest) for k in got)


def test_template_without_markup_is_found_by_differencing(spark):
    page = "<html><body><div>Site name</div><div>Home News Sport</div><div>{}</div><p>{}</p><div>All rights reserved</div></body></html>"
    rows = [(k, f"http://a.example/x/{k}", page.format(f"Title {k}", f"Story number {k} with its own words.")) for k in range(6)]
    rows += [(9, "http://b.example/x/1", page.format("Alone", "No neighbour here."))]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    assert got[3] == "Title 3\nStory number 3 with its own words."
    assert "Site name" in got[9]


def test_differencing_goes_over_partitions_and_copies(spark):
    page = "<div>Site name</div><div>Home News Sport</div><p>Story {} with its own words {}.</p><div>All rights</div>"
    schema = "page_id long, url string, html string"
    rows = [(k, f"http://a.example/x/{k:03}", page.format(k, "abcdefgh"[k % 8] * 30)) for k in range(60)]
    want = {k: f"Story {k} with its own words {'abcdefgh'[k % 8] * 30}." for k in range(60)}
    near = "<div>Site name</div><p>{}</p><div>Menu {}</div>"
    rows += [(k, f"http://b.example/{k}", near.format(("z" if k < 108 else "w") * 200, k)) for k in range(100, 109)]
    want |= {k: f"{'z' * 200}\nMenu {k}" for k in range(100, 108)}
    rows += [(k, f"http://c.example/{k}", page.format(7, "y" * 30)) for k in range(200, 220)] + [(220, "http://c.example/220", page.format(8, "x" * 30))]
    want |= {k: f"Story 7 with its own words {'y' * 30}." for k in range(200, 220)}
    long = "<div>" + "</div><div>".join(f"Menu entry number {k}" for k in range(20)) + "</div><p>Short {}</p>"
    rows += [(k, f"http://d.example/{k}", long.format(k)) for k in range(300, 330)]
    want |= {k: f"Short {k}" for k in range(300, 330)}
    rows += [(k, f"http://e.example/{k}", long.format(0)) for k in (400, 401)]
    found = []
    for n in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = extract(spark.createDataFrame(rows, schema).repartition(n)).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        found.append({r.page_id: r.text for r in got})
        assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
        assert {k: found[-1][k] for k in want} == want
        assert found[-1][400] == found[-1][401] == "\n".join(t for t, _ in text_lines(long.format(0)))
    assert found[0] == found[1]


def test_copies_keep_their_text():
    lines = text_lines("<div>Top</div><p>The same long story under two addresses.</p>")
    assert main_text(lines, lines) == "Top\nThe same long story under two addresses."


def test_markup_that_is_never_text():
    html = """<!DOCTYPE html><html><head><title>T</title></head><body class="has-sidebar"><header>H</header><nav>N</nav>
    <div class="cookie-notice">C</div><div id="left_sidebar">S</div><main><header><h1>A &amp B&nbsp;&lt;x&gt;</h1></header>
    <p>one <b>two
    three<p>four<br>five<ul><li>six<li>seven</ul><div class="ad-box">ad</div><form>f<input></form><script>if (a<b) "</p>"</script>
    <!-- c --><section class="comments"><p>reader</p></section><aside>x</aside></main><footer>&copy; F</footer></body></html>"""
    assert main_text(text_lines(html), None) == "A & B <x>\none two three\nfour five\nsix\nseven"


def test_page_goes_on_behind_unknown_marked_sections():
    assert text_lines("<p>one</p><![foo]><p>two</p><![ x ]>three<![if !IE]><p>four</p><![endif]><![CDATA[five]]>six") == [("one", 0), ("two", 0), ("three", 0), ("four", 0), ("six", 0)]
    assert text_lines("<svg><![CDATA[</svg><p>a]]></svg><p>one</p>") == [("one", 0)]


def test_head_without_its_end_tag():
    head = "<html><head><meta charset=utf-8><title>the <body> tag</title><script>x</script>"
    for start in (f"{head}<body>", head, f"{head}<noscript><style>y</style><body>", f"{head}</head><body>"):
        assert text_lines(f"{start}<p>one</p><main>two</main>") == [("one", 0), ("two", 1)]
    assert text_lines(f"{head} one<p>two") == [("one", 0), ("two", 0)]


def test_frames(spark):
    rows = [(1, None, None), (1, None, None), (None, "odd", ""), (2, "http://h/a", "  "), (3, "http://h/b", "<p>" + "word " * 50000), (4, "http://h/b", "<p>x</p")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 0, 0, 1, 249999]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_paragraphs_and_headings_of_an_article_stay_whatever_their_names():
    html = "<article><p class='notice'>real para</p><h2 id='social-history'>Social history</h2><section id='share-prices'>prices</section><div class='share'>tweet</div></article>"
    assert [t for t, role in text_lines(html) if role == 1] == ["real para", "Social history", "prices"]


def test_long_pages_and_clashing_columns(spark):
    long = "<article>" + "".join(f"<p>line {k} of it</p>" for k in range(60_000)) + "</article>"
    rows = [(1, "http://a/x", long, "p", 1, "q"), (2, None, None, "p", 1, "q"), (2, None, None, "p", 1, "q"), (None, "http://a/y", "<p>alone", "p", 1, "q")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, key int, text string")
    got = sorted(((r.page_id, r.n_chars) for r in extract(df).collect()), key=str)
    assert got == sorted([(1, sum(len(f"line {k} of it") + 1 for k in range(60_000)) - 1), (2, 0), (2, 0), (None, 5)], key=str)
    assert extract(df.limit(0)).count() == 0


def test_names_that_only_hint_keep_the_articles_text():
    kept = ["<article><div class='social-history'><p>real</p></div></article>", "<main><div class='search results'><p>real</p></div></main>", "<article><section class='notice board'><p>real</p></section></article>", "<article><details class='widget'><p>real</p></details></article>", "<article><ul class='menu-items'><li>real</li></ul></article>"]
    assert [main_text(text_lines(x), None) for x in kept] == ["real"] * len(kept)


def test_names_that_are_sure_go_on_any_element():
    page = "<article><p>text</p>{}</article>"
    gone = ["<p class='advertisement'>Buy now</p>", "<p class='comment'>me too</p>", "<ul><li class='share'>tweet</li></ul>", "<blockquote class='ad'>Buy</blockquote>", "<div style='display:none'>x</div>", "<p style='color:red; DISPLAY : none'>x</p>", "</article><article class='teaser'><p>other</p>", "<div class='notice'>n</div>", "<div class='menu'>m</div>", "<div class='x ad-box'>a</div>", "<p hidden>x</p>"]
    assert [main_text(text_lines(page.format(x)), None) for x in gone] == ["text"] * len(gone)
    assert main_text(text_lines("<body class='login nav'><article><p style='color:none'>text</p></article>"), None) == "text"


def test_differencing_decides_inside_an_article(spark):
    page = "<article><p>Story {0} tells of {0} things, at length and in its own words.</p><div class='social-links'>Follow us</div><div class='search results'>Found {0}</div></article><div>Outside</div>"
    rows = [(k, f"http://a.example/x/{k}", page.format(k)) for k in range(5)] + [(9, "http://a.example/x/9", page.format(4)), (10, "http://b.example/", page.format(7))]
    rows += [(20, "http://c.example/1", "<p>open page</p><div>Outside</div>"), (21, "http://c.example/2", "<article><p>sure</p></article><div>Outside</div>")]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    want = {k: f"Story {k} tells of {k} things, at length and in its own words.\nFound {k}" for k in range(5)}
    assert got == want | {9: want[4], 10: "Story 7 tells of 7 things, at length and in its own words.\nFollow us\nFound 7", 20: "open page", 21: "sure"}


def test_pages_that_markup_decides_are_compared_too(spark):
    page = "<nav>Menu</nav><div>Site name</div><article><p>Story {0} of its own.</p><p>A passage that all have.</p></article><footer>All rights</footer>"
    rows = [(k, f"http://a.example/x/{k}", page.format(k)) for k in range(4)] + [(9, "http://b.example/", page.format(9)), (10, None, None)]
    for n in (1, 3):
        got = {r.page_id: (r.text, r.n_shared) for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(n)).collect()}
        assert got == {k: (f"Story {k} of its own.\nA passage that all have.", 4) for k in range(4)} | {9: ("Story 9 of its own.\nA passage that all have.", 0), 10: ("", 0)}


def test_lines_outside_an_article_stay_if_they_are_the_pages_own(spark):
    page = "<div>Site name</div><article><p>Lead {0} in a few words.</p></article><div><p>Body {1} goes on outside the article, at some length.</p></div><nav>Menu {0}</nav><div>All rights</div>"
    text = "Lead {0} in a few words.\nBody {1} goes on outside the article, at some length."
    rows = [(k, f"http://a.example/x/{k}", page.format(k, k)) for k in range(5)] + [(9, "http://b.example/", page.format(9, 9))]
    rows += [(k, f"http://c.example/{k}", page.format(k, body)) for k, body in ((20, "x"), (21, "x"), (22, "y"))]  # one body at two addresses
    want = {k: text.format(k, k) for k in range(5)} | {9: "Lead 9 in a few words.", 20: text.format(20, "x"), 21: text.format(21, "x"), 22: text.format(22, "y")}
    for n in (1, 3):
        got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(n)).collect()}
        assert got == want
    own, other = (text_lines(page.format(k, k)) for k in (1, 2))
    assert main_text(own, other) == text.format(1, 1) and main_text(own, None) == main_text(own, own) == "Lead 1 in a few words."
