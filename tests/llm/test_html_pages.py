"""Main text of pages written by hand that the tree has not seen, and the query."""

import html

import pytest
from pyspark.sql import functions as F

from landmesh.llm import html_text, queries

#: (page, main text): adverts, notices, sidebars, comments, teasers, menus, odd markup.
PAGES = [
    (
        "<html><head><title>No</title><style>p{}</style></head><body class='page with-sidebar'><nav><a href=/>Home</a> <a href=/n>News</a></nav><article><header><h1>Old bridge reopens</h1></header><p>The old bridge over the canal was opened again on Friday, two years after the flood.</p><div class='advert'>Cheap flights to the sun, book before Sunday and save a lot of money.</div><p>Engineers replaced every beam &amp; bolt.</p></article><a href=/x><h3>Ten lovely places</h3><p>From the coast to the hills, these are the places that our readers loved.</p></a><footer>&copy; The Paper</footer></body></html>",
        "Old bridge reopens The old bridge over the canal was opened again on Friday, two years after the flood. Engineers replaced every beam & bolt.",
    ),
    (
        "<body><div id='main-menu'><ul><li><a href=/>Start</a><li><a href=/b>Blog</a></ul></div><div class='post-content'><h1>Bread</h1><p>Mix flour, water and salt, and let the dough rest for a whole night in a cool place.<p>Bake it hot.</div><section class='comments'><h3>Comments</h3><div><b>Anna</b><p>I tried this last week and my family ate all of it in one evening.</p></div><div><b>Ben</b><p>Mine was flat.</p></div></section></body>",
        "Bread Mix flour, water and salt, and let the dough rest for a whole night in a cool place. Bake it hot.",
    ),
    (
        "<body><div class=sidebar><h4>Popular this week</h4><p>The ten best books of the year, chosen by the people who sell them every day.</p></div><main><h2>The last lamp</h2><p>Every evening he lit the lamp at the end of the pier, and every morning he put it out again.</p><p>Nobody knew why.</p></main><div class='cookie-bar'><p>We use cookies to show you what you like. You may change this at any time in your settings.</p><button>OK</button></div></body>",
        "The last lamp Every evening he lit the lamp at the end of the pier, and every morning he put it out again. Nobody knew why.",
    ),
    (
        "<body><p><a href=/login>Log in</a> | <a href=/help>Help</a></p><h1>Counting birds</h1><p>Thousands of people sat in their gardens on Sunday and counted the birds that came to feed.</p><p>The sparrow won, as it does in <a href=/s>most years</a>, ahead of the tit and the blackbird.</p><ul><li>Sparrow: 31,000</li><li>Great tit: 18,000</li></ul><form action=/s><label>Search</label><input name=q></form><h3>4 Comments</h3><div><span>Carl</span><p>We had a woodpecker, and it stayed for the whole hour of the count.</p></div></body>",
        "Counting birds Thousands of people sat in their gardens on Sunday and counted the birds that came to feed. The sparrow won, as it does in most years, ahead of the tit and the blackbird. Sparrow: 31,000 Great tit: 18,000",
    ),
    (
        "<body><header class=masthead><a href=/>The Daily</a><p>News since 1880</p></header><div role='alert'>Heavy snow is expected tonight, do not travel if you can avoid it.</div><article><h1>Rates stay</h1><p>The bank left its rate where it was, to the surprise of most of those who watch it for a living.</p><blockquote>We will wait and see.</blockquote><aside><p>Read more about what rates do to the price of houses in our long report.</p></aside><p>The next meeting is in May.</p></article><div class='related-articles'><h3>More</h3><p>How a small town lost its only bank, and what it did about that.</p></div><div id='disqus_thread'><p>Dora: they never get it right, and we pay.</p></div><footer><p>All rights reserved by the owners of this paper and its site.</p></footer></body>",
        "Rates stay The bank left its rate where it was, to the surprise of most of those who watch it for a living. We will wait and see. The next meeting is in May.",
    ),
    (
        "<body><ol class=breadcrumbs><li>Home<li>Tech</ol><div class='story'><h1>A tiny engine</h1><div>It weighs less than a coin and runs for a month on a drop of oil, its makers say.</div><div>They hope to sell it to makers of watches.</div><div class='share-buttons'><a href=/t>Tweet</a> Share this story with a friend</div></div><div class='newsletter'><p>Get our best stories every Friday, free and without any advert in it.</p></div></body>",
        "A tiny engine It weighs less than a coin and runs for a month on a drop of oil, its makers say. They hope to sell it to makers of watches.",
    ),
    (
        "<body><nav><ul><li><a href=/1>Un</a></li><li><a href=/2>Deux</a></li></ul></nav><!-- ad --><div class=\"ad\">Achetez nos chaussures avant la fin du mois.</div><article><h1>La pluie</h1><p>Il a plu toute la nuit, et le matin la rivière était montée jusqu'aux portes du moulin.<br>Personne ne dormait.</p><p>Puis le soleil est revenu.</p></article><footer>&copy; exemple.fr &middot; mentions légales</footer></body>",
        "La pluie Il a plu toute la nuit, et le matin la rivière était montée jusqu'aux portes du moulin. Personne ne dormait. Puis le soleil est revenu.",
    ),
    ("<body><nav><a href=/>x</a></nav><div class=ad>Buy now.</div></body>", ""),
    ("", ""),
    (None, ""),
]


@pytest.fixture(scope="module")
def model(spark):
    return html_text.train(spark)


def test_pages_by_hand(spark, model):
    rows = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(PAGES)], "page_id int, html string")
    got = {r.page_id: r.text for r in html_text.extract(rows, model).collect()}
    hit = found = wanted = right = 0
    for i, (_, want) in enumerate(PAGES):
        a, b = got[i].split(), want.split()
        left = list(b)
        for w in a:
            if w in left:
                left.remove(w)
                hit += 1
        found, wanted, right = found + len(a), wanted + len(b), right + (got[i] == want)
    assert hit / found > 0.97 and hit / wanted > 0.97  # precision and recall by words
    assert right >= len(PAGES) - 1


def test_links_around_blocks_and_their_ends():
    of = lambda page: [(t, f[1]) for t, f in html_text.blocks(page)]
    assert of("<a href=x><h3>a b</h3><p>c</p></a><p>d</p>") == [("a b", 1.0), ("c", 1.0), ("d", 0.0)]
    assert of("<div><a href=x>a<p>b</p></div><p>c</p>") == [("a", 1.0), ("b", 1.0), ("c", 0.0)]  # a link without its end goes no farther than what it is in
    assert of("<p>x <a>y</a> z</p>") == [("x y z", pytest.approx(1 / 3))]


def test_names_of_furniture():
    yes = ['class="advert"', "class=ad", "id='cookieBanner'", 'class="post related-posts"', 'role="navigation"', 'class="CommentList"', 'class="site_footer nav"']
    no = ['class="content"', 'class="has-sidebar"', 'class="address"', 'class="shadow gradient"', "href=/ads/1", 'class="no-ads"', "", 'class="page-wrapper with-comments"']
    assert all(html_text._furniture(a) for a in yes)
    assert [a for a in no if html_text._furniture(a)] == []
    assert html_text._furniture('class="entry-header"') and not html_text._furniture('class="entry-header"', True)


def test_query_over_pages(spark, tmp_path):
    """Menus, adverts and footers go; null, empty and repeated rows stay, clashing columns don't matter."""
    spark.createDataFrame([(i, f"http://x/{i}", p, "clash", 1) for i, (p, _) in enumerate(PAGES)] + [(0, None, PAGES[0][0], "c", 1), (None, "u", PAGES[6][0], "c", 2)], "page_id long, url string, html string, text string, n_chars int").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.QUERIES["op7_html"](spark, str(tmp_path)).collect()
    assert len(got) == len(PAGES) + 2
    assert all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id is None] == [PAGES[6][1]]
    assert [r.text for r in got if r.page_id in (7, 8, 9)] == [""] * 3
    given = queries.QUERIES["op7_html"](spark, "/root/testdata/sf0.001").join(spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", F.col("html")), "page_id").collect()
    for r in given:  # the article, without its tags
        article = r.html.partition("<article>")[2].partition("</article>")[0]
        words = html.unescape(__import__("re").sub(r"<[^>]*>", " ", article)).split()
        assert r.text.split() == words
