import math

from pyspark.sql import functions as F

from vigilog.llm.html_text import extract, main_text, style_tree

PAGES = "page_id long, url string, html string"


def page(body):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body>{body}"


def test_article_without_the_rest():
    html = page(
        '<nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- ad <p>x</p> --><div class="ad">buy</div><script>var t="</p><p>no";</script>'
        "<header>site</header><article><header><h1>Head &amp; line</h1></header><p><b>First\n  one<br>two<p>Second &eacute;&#233;&lt;p&gt; "
        '&amp;amp;</p><ul><li>i<li>j</ul><aside>x</aside><form><p>f</form><div class="x comments"><p>reader</p></div><div id="share">s</div>'
        "<p>Last</article><footer>&copy; me</footer><div class='cookie-notice'>c</div>")
    assert main_text(html) == "Head & line\n\nFirst one two\n\nSecond éé<p> &amp;\n\ni\n\nj\n\nLast"


def test_broken_and_odd_markup():
    assert main_text(None) == main_text("") == main_text("<p></p>") == ""
    assert main_text("a < b and <3 <p title='x>y'>c</P >d") == "a < b and <3\n\nc\n\nd"
    assert main_text("<p>open <b>never <i>closed") == "open never closed"
    assert main_text("<p>x</p><script>unclosed <p>y") == "x"
    assert main_text("<article>" + "<div>" * 3000 + "deep") == "deep"
    assert main_text('<p>cut off <a href="') == "cut off"
    assert main_text("<p>a&nbsp; b&am c&amp</p>") == "a b&am c&"
    assert main_text("<p>İ<script>x</script>b</p>") == "İb"
    long = main_text("<p>" + "word " * 300_000 + "<" * 2000)
    assert len(long) > 1_500_000


def site(n, host="site"):
    """Pages whose frame says nothing by its tags; the story changes."""
    return [(i, f"http://{host}.test/{i}", page(
        '<div class="top"><div>Home</div><div>All stories</div></div>'
        f'<div class="body"><p>Story {i} begins.</p>{"<p>More</p>" * (i % 3)}<p>Ends {i}.</p></div><div class="end">Imprint</div>')) for i in range(n)]


def test_repeated_branches_of_a_site_go(spark):
    rows = extract(spark.createDataFrame(site(8), PAGES)).collect()
    for r in rows:
        assert r.text.startswith(f"Story {r.page_id} begins.") and r.text.endswith(f"Ends {r.page_id}.")
        assert "Home" not in r.text and "Imprint" not in r.text and r.n_chars == len(r.text)
    joined = extract(spark.createDataFrame(site(8), PAGES), small=0).collect()
    assert sorted(map(tuple, joined)) == sorted(map(tuple, rows))
    # Too few pages to tell: nothing is cut.
    assert all("Imprint" in r.text for r in extract(spark.createDataFrame(site(2), PAGES)).collect())


def test_importance_by_hand(spark):
    tree = {r.node: r for r in style_tree(
        spark.createDataFrame(site(9), PAGES).withColumn("host", F.lit("h")).select("host", "html")).collect()}
    end, body = tree["/html/body/div.end"], tree["/html/body/div.body"]
    assert (end.pages, end.styles) == (9, 1) and end.presentation == 0 and abs(end.content) < 1e-9
    # Texts below: 9 + 9 on one page each, "More" 3 times once and 3 times twice.
    spread = math.log(9) - (3 * 2 * math.log(2)) / 9
    assert abs(body.content - (1 - spread / 19 / math.log(9))) < 1e-9
    assert abs(body.importance - 0.9 * body.content) < 1e-9


def test_articles_stay_whole_even_if_copied(spark):
    html = page("<article><p>Same text</p></article>")
    rows = extract(spark.createDataFrame([(i, "http://a.test/", html) for i in range(6)], PAGES)).collect()
    assert {r.text for r in rows} == {"Same text"}


def test_nulls_clashes_and_empty(spark):
    pages = [(1, None, page("<p>x</p>")), (1, None, page("<p>x</p>")), (None, "no host", None), (2, "http://h/", "")]
    docs = spark.createDataFrame(pages, PAGES).withColumn("host", F.lit(3)).withColumn("node", F.lit("x")).withColumn("cut", F.lit(1))
    rows = extract(docs).collect()
    assert sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in rows) == [
        (0, "no host", "", 0), (1, "", "x", 1), (1, "", "x", 1), (2, "http://h/", "", 0)]
    assert extract(spark.createDataFrame([], PAGES)).count() == 0


def test_wrappers_named_by_a_layout_keep_their_article(spark):
    story = "<article><p>Whole story</p></article>"
    for around in ('<div id="content-sidebar-wrap">{}</div>', '<div class="has-sidebar">{}</div>', '<div class="sidebar">{}</div>',
                   '<div class="promo">{}</div>', '<form id="aspnetForm">{}</form>', '<header>{}</header>', '<div class="related"><main>{}</main></div>'):
        assert main_text(page(around.format(story))) == "Whole story", around
        assert main_text(page(f"<main>{around.format(story)}</main>")) == "Whole story", around
    for around in ("<nav>{}</nav>", "<aside>{}</aside>", "<footer>{}</footer>", '<div id="comments">{}</div>', '<div class="promo"><nav>{}</nav></div>'):
        assert main_text(page(around.format(story))) == "", around
    assert main_text(page(
        '<article><div class="article-header"><h1>Title</h1></div><div class="header">By me</div><section id="related-work"><p>Earlier</p></section>'
        '<div class="notice-board">Board</div><div class="sidebar">x</div><form>y</form></article>')) == "Title\n\nBy me\n\nEarlier\n\nBoard"


def test_forms_and_layout_words_are_judged_by_the_style_tree(spark):
    body = '<form><div class="sidebar"><p>Links</p></div><div class="main-widget widget"><p>Story {0} begins.</p><p>Ends {0}.</p></div></form>'
    rows = extract(spark.createDataFrame([(i, f"http://f.test/{i}", page(body.format(i))) for i in range(8)], PAGES)).collect()
    assert {r.page_id: r.text for r in rows} == {i: f"Story {i} begins.\n\nEnds {i}." for i in range(8)}
