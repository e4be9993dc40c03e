import html
import re

import numpy as np

from quern.llm import html_text, queries

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header id=top>Site <a href=/>Home</a></header>
<nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav><div class="cookie-notice"><p>We use cookies on this site, and here are many words about them, so many that it looks like text.</p></div>
<main><article><header><h1>Big &amp; bold</h1></header><p>First <b>para</b>graph&nbsp;here.<br>Next line.<p>Second   one &lt;tag&gt; &#233;&eacute;.
<script>var x = "</p>";</script><div class="ad-slot">Buy now</div><p>Be.</p><form><input><label>Mail</label></form><blockquote>Quoted.</blockquote></article>
<section id="comments"><h2>Comments</h2><p>I liked this a great deal, and I say so in more than a few words here.</p></section></main>
<aside>Related things</aside><footer>&copy; Site</footer></body></html>"""


def text(page):
    return html_text.main_text(page, html_text.train())


def test_article():
    assert text(PAGE) == "Big & bold\nFirst paragraph here. Next line.\nSecond one <tag> éé.\nBe.\nQuoted."


def test_page_without_article():
    long = "This is a paragraph of quite a few words that has no links in it and so looks like the text of a page"
    page = f"<div class=menu><a href=/>Home</a></div><div><h1>Title of it</h1><p>{long}.</p><p>{long} too.</p></div><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul><div class=footer>{long}</div>"
    assert text(page) == f"Title of it\n{long}.\n{long} too."


def test_named_containers():
    body = "<h1>T</h1><p>Short.</p><div class=inlineAdvert>Buy</div><p>Also.</p>"
    page = f'<div id="page"><div class="site-nav"><a href=/>Home</a></div><div class="entry-content">{body}</div><ol class="commentlist"><li>Nice words</ol><div>Loose words here</div></div>'
    assert text(page) == "T\nShort.\nAlso."
    assert text(f"<div id=content>{body}<article>Inner.</article></div>") == "Inner."


LONG = "These are the words of a paragraph that has no links in it, and there are quite a few of them so that it is plainly text"


def test_states_and_slugs_are_no_marks():
    body = f"<h1>Title</h1><p>{LONG}.</p><p>Short.</p>"
    told = f"Title\n{LONG}.\nShort."
    for page in (
        f"<article class='post comments-open'>{body}</article>",
        f"<div class='layout has-sidebar'><article>{body}</article><div class=sidebar>{LONG}</div></div>",
        f"<div class=no-sidebar><article>{body}</article></div>",
        f"<article data-id='menu'>{body}</article>",
        f"<article><div title='The hidden cost'>{body}</div></article>",
        f"<form id=aspnetForm><div id=content>{body}</div></form>",
        f"<div class=comments><article>{body}</article></div>",
    ):
        assert text(page) == told, page
    parts = f"<section id='social-impact'><p>{LONG} 1.</p></section><h2 id='related-work'>Work</h2><p id='notice-1'>One line.</p><div class='recipe-menu'><ul><li>Soup of the day<li>Bread and salt</ul></div>"
    assert text(f"<article>{body}{parts}</article>") == f"{told}\n{LONG} 1.\nWork\nOne line.\nSoup of the day\nBread and salt"
    assert text(f"<article>{body}<div class=ad-slot>{LONG}</div><div class='cookie-notice'>{LONG}</div><span hidden>no</span><p>End.</p></article>") == f"{told}\nEnd."


def test_text_decides_where_marks_do_not():
    links = "".join(f"<li><a href=/{i}>Go to place {i}</a></li>" for i in range(6))
    assert text(f"<article><h1>T of it</h1><p>{LONG}.</p><h3>More</h3><ul>{links}</ul></article>") == f"T of it\n{LONG}."
    assert text(f"<article><p>{LONG}.</p><p><a href=/x>A link alone</a></p><p>{LONG}!</p></article>") == f"{LONG}.\nA link alone\n{LONG}!"
    assert text(f"<article>A teaser of a few words.</article><div><p>{LONG}.</p><p>{LONG} 2.</p><p>{LONG} 3.</p></div>") == f"{LONG}.\n{LONG} 2.\n{LONG} 3."


def test_common_layouts():
    blog = f"""<body class="post-template has-sidebar"><div id="page"><header id="masthead" class="site-header"><h1><a href=/>My blog</a></h1><nav><ul><li><a href=/a>About</a></ul></nav></header>
    <div id="content" class="site-content"><main id="main"><article id="post-1" class="post comments-open"><header class="entry-header"><h1 class="entry-title">The title</h1></header><div class="entry-content">
    <p>{LONG}.</p><ul><li>One thing</li><li>Another thing</li></ul><p>{LONG}!</p><div class="share-buttons"><a href=1>Tweet</a></div></div><footer class="entry-footer">Filed under <a href=/x>X</a></footer></article>
    <div id="comments" class="comments-area"><h2 class="comments-title">2 thoughts</h2><ol class="comment-list"><li class="comment"><p>{LONG} {LONG} {LONG}.</p></ol></div></main></div>
    <aside><h2>Recent</h2><ul><li><a href=1>Post one</a></ul></aside></div></body>"""
    assert text(blog) == f"The title\n{LONG}.\nOne thing\nAnother thing\n{LONG}!"
    wiki = f"""<div id="content"><h1 id="firstHeading">Cats</h1><div id="bodyContent"><p>{LONG}, <a href=a>and links</a> <a href=b>in it</a>.</p><h2>History</h2><p>{LONG}.</p><table><tr><td>Kingdom<td><a href=k>Animalia</a></table>
    <h2>References</h2><ol><li><a href=1>^</a> Smith, J. (2001). Cats.<li><a href=1>^</a> Doe, J. (2002). Dogs.</ol></div></div><div id="mw-navigation"><h2>Navigation menu</h2><ul><li><a href=1>Main page</a><li><a href=2>Contents</a></ul></div>"""
    assert text(wiki) == f"Cats\n{LONG}, and links in it.\nHistory\n{LONG}.\nKingdom\nAnimalia\nReferences\n^ Smith, J. (2001). Cats.\n^ Doe, J. (2002). Dogs."
    assert text("<nav><a href=/>Home</a></nav><article><h1>Hi</h1><p>Ok.</p></article><div class='newsletter-signup'><p>Sign up and get all the news.</p></div><footer>All rights reserved.</footer>") == "Hi\nOk."


def test_hand_labelled_pages_without_article():
    """Blocks marked + are the main text."""
    menu, foot = "<div><a href=/>Home</a> <a href=/b>Books</a> <a href=/c>Contact us</a></div>", "<div>All rights reserved by the owner.</div>"
    pages = [
        [menu, "<table><tr><td>", "+Of cats", f"+{LONG}.", "+Yes.", f"+{LONG}?", "</td></tr></table>", foot],
        [menu, "<div><div>", "+h:The news of the day", f"+{LONG}.", f"+{LONG}!", "</div></div>", f"<div><div>{'Short note here. ' * 3}</div></div>", foot],
        [menu, "<div id=wrap><div>", f"+{LONG}.", "</div><div>", f"+{LONG}!", "</div><div>", f"+{LONG}?", "</div></div>", foot],
        ["<ul><li><a href=/>A</a><li><a href=/>B</a></ul>", f"+{LONG}.", "+And then.", f"+{LONG}!", foot.replace("div", "footer")],
        [menu, "<section>", "+h:Heading", f"+{LONG}.", f"+{LONG} 7.", "</section><section class=comments>", f"<p>{LONG} I say.</p>", f"<p>{LONG} me too.</p>", "</section>"],
    ]
    for parts in pages:
        page = "".join(f"<h1>{x[3:]}</h1>" if x.startswith("+h:") else f"<p>{x[1:]}</p>" if x.startswith("+") else x for x in parts)
        assert text(page) == "\n".join(x.removeprefix("+").removeprefix("h:") for x in parts if x.startswith("+")), page


def test_text_features_decide(spark, sf):
    """Without words and links, or with the marks alone, most decisions on the given pages would be others."""
    tree, changed, total, without_marks = html_text.train(), 0, 0, 0
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        x = html_text.features(html_text.parse(r["html"]))
        kept = tree.predict(x) > 0.5
        bare, unmarked = x.copy(), x.copy()
        bare[:, :8], unmarked[:, 9] = 0, 0
        changed += int((kept != (tree.predict(bare) > 0.5)).sum())
        without_marks += int((kept != (tree.predict(unmarked) > 0.5)).sum())
        total += len(x)
    assert changed > 0.4 * total and without_marks < 0.02 * total


def test_words_links_and_neighbours_decide_in_mixed_articles():
    """The share of the section stays as it is; own columns (0, 1) or those of neighbours (2 to 5) are zeroed."""
    links = "".join(f"<li><a href=/{i}>Go to place {i}</a></li>" for i in range(6))
    for page in (
        f"<article><h1>T of it</h1><p>{LONG}.</p><h3>More</h3><ul>{links}</ul><p>{LONG}!</p></article>",
        f"<article><p>{LONG}.</p><figure><figcaption>The sea. <a href=/p>Photo by A</a></figcaption></figure><p>{LONG}!</p><ul>{links}</ul></article>",
    ):
        x = html_text.features(html_text.parse(page))
        kept = html_text.train().predict(x) > 0.5
        assert 0 < kept.sum() < len(x)
        for columns in ([0, 1], [2, 3, 4, 5], range(6)):
            bare = x.copy()
            bare[:, columns] = 0
            assert (kept != (html_text.train().predict(bare) > 0.5)).sum() >= 5, (page, columns)


def test_odd_pages():
    tree = html_text.train()
    for page in (None, "", "<", "<p", "<!-- x", "<script>x", "</div></p>", "<article>", "<p>" * 3000, "<div>" * 3000 + "x", '<a href="' * 500):
        assert isinstance(html_text.main_text(page, tree), str)
    assert text("<article>cut of") == "cut of"
    assert text("<article>a &am") == "a &am"
    assert text('<article><p title="a>b">c</p><p title=\'d>e</p>f</article>').startswith("c")
    assert text("<article>a < b &amp;lt; c</article>") == "a < b &lt; c"
    assert len(text("<article><p>" + "word " * 300_000 + "</p></article>")) == 5 * 300_000 - 1


def test_tree_learns_its_table():
    rows = html_text.labelled_table()
    assert np.array_equal(html_text.train().predict(rows[:, :-1]) > 0.5, rows[:, -1] > 0.5)
    assert html_text.grow(rows[:5, :-1], np.ones(5)).share == 1.0


def test_pages_frame(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "own", 3), (1, "u", PAGE, "own", 3), (None, None, None, None, None), (2, "v", "", "x", 4)], "page_id long, url string, html string, text string, n_chars long")
    rows = html_text.extract(pages).collect()
    assert sorted((str(r["page_id"]), r["n_chars"]) for r in rows) == [("1", len(text(PAGE))), ("1", len(text(PAGE))), ("2", 0), ("None", 0)]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_query(spark, sf):
    """These pages hold one article each, of a heading and paragraphs."""
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.op2_html_main_text(spark, sf).collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r["page_id"]], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("</?b>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])
