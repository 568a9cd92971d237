"""op5: what the deduced template decides, on hosts made for it, and all articles of the data."""

from __future__ import annotations

import html
import re
import time

from brookcheck.llm import html_text

SCHEMA = "page_id long, url string, html string, text string, tokens string, host string"


def run(spark, rows):
    got = html_text.extract(spark.createDataFrame([(*r, "z", "y", "x") for r in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    return {r.page_id: r.text for r in got}


def words(i, n):
    return " ".join(f"w{i * 31 + k * 7}" for k in range(n))


def test_boilerplate_without_telling_names_goes_with_the_template(spark):
    page = lambda i: f"<html><body><div class=rail><p>Example Corp</p><p>Home Products Jobs</p></div><div class=col><h1>Title {i}</h1><p>{words(i, 30)}</p><p>By the desk</p></div><div class=base><p>Copyright Example Corp</p></div></body></html>"
    rows = [(i, "http://plain.example/" + str(i), page(i)) for i in range(8)]
    got = run(spark, rows)
    assert got == {i: f"Title {i}\n\n{words(i, 30)}" for i in range(8)}
    # Without the template the same pages keep all of it.
    assert html_text.main_text(page(0)) == f"Example Corp\n\nHome Products Jobs\n\nTitle 0\n\n{words(0, 30)}\n\nBy the desk\n\nCopyright Example Corp"


def test_names_inside_an_article_tell_nothing(spark):
    page = lambda i: f"<body><nav>menu</nav><article><h1>T{i}</h1><p class='share price'>{words(i, 9)}</p><p class=notice>{words(i, 7)}</p><div id=related-work><p>{words(i, 8)}</p></div><div class='ad'>buy {i}</div><p>Follow us</p><section class=comments><p>me too {i}</p></section></article></body>"
    got = run(spark, [(i, "https://n.example/x", page(i)) for i in range(5)])
    assert got == {i: f"T{i}\n\n{words(i, 9)}\n\n{words(i, 7)}\n\n{words(i, 8)}" for i in range(5)}


def test_the_template_picks_the_article_but_never_a_teaser(spark):
    page = lambda i: f"<body><article class=teaser><p>read on {i}</p></article><article id=post-{i}><p>{words(i, 40)}</p></article></body>"
    plain = lambda i: f"<body><article><p>{words(i, 40)}</p></article><div><article class=x{i}><p>more {i}</p></article></div></body>"
    got = run(spark, [(i, "http://t.example", page(i)) for i in range(6)] + [(10 + i, "http://u.example", plain(i)) for i in range(6)])
    assert got == {i: words(i, 40) for i in range(6)} | {10 + i: words(i, 40) for i in range(6)}


def test_copies_of_a_page_and_hosts_of_few_pages_teach_no_template(spark):
    same = f"<body><article><p>{words(1, 20)}</p></article><p>x</p></body>"
    got = run(spark, [(i, "http://c.example", same) for i in range(9)] + [(20, "http://c.example", same.replace("<p>x", "<p>y")), (None, "http://c.example", same), (30, None, same)])
    assert set(got.values()) == {words(1, 20)}


def test_all_articles_of_the_data(spark):
    """Each page of the tables has one article without inner menus: its blocks, read by plain patterns."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = {r.page_id: r.html for r in pages.collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(pages).collect()}
    assert len(got) == len(rows)
    for i, source in rows.items():
        body = re.search(r"<article[^>]*>(.*?)</article>", source, re.S)[1]
        body = re.sub(r"<(script|style)\b.*?</\1>|<!--.*?-->", "", body, flags=re.S)
        parts = re.split(r"</?(?:p|h[1-6]|div|ul|ol|li|blockquote|pre|section)\b[^>]*>", re.sub(r"<br\s*/?>", " ", body))
        blocks = [" ".join(html.unescape(re.sub(r"<[a-zA-Z/][^>]*>", "", p)).split()) for p in parts]
        want = "\n\n".join(b for b in blocks if b)
        assert got[i] == (want, len(want))


def test_malformed_pages_take_one_pass():
    """A megabyte each of markup that never ends; no time grows with the square of the page."""
    for piece in ("<script ", '<p title="x ', "<a ", '<a b="x>" ', "<!--", "<!a ", "<", "<style>", "</script", "<script>x</script   ", "<p class ", "<p '\""):
        for tail in ("", ">", '">', "'>"):
            page, began = piece * (1_000_000 // len(piece)) + tail, time.time()
            html_text.main_text(page)
            assert time.time() - began < 10, (piece, tail)
    for page in ("<div>" * 50_000 + "</section>" * 50_000, "<dl>" * 30_000 + "<dt>" * 60_000):
        began = time.time()
        html_text.Page(page)
        assert time.time() - began < 20


def test_no_markup_is_left_of_tags_that_are_not_closed():
    text = lambda page: [b[1] for b in html_text.Page(page).blocks]
    assert text('<p title="bad>quote') == ["quote"]
    assert text("<p title='it>one</p><p>two") == ["one", "two"]
    assert text('<p a="x>y" b=\'">\'>one <b c=">">two</b>') == ["one two"]
    assert text("a < b <1 c") == ["a < b <1 c"]
    assert text("one<p") == ["one<p"]
    assert text("one<!-- never closed <p>two") == ["one"]
    assert text("<p>one<script>if (a > b) '</p>'</SCRIPT >two") == ["onetwo"]
    assert text("<p>one<script>lost") == ["one"]
