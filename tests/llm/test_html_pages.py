"""op5 on pages written by hand (none comes from the module's layouts), and on markup that a slow parser would choke on."""

import time

import pytest

from revlens.llm import html

#: name -> (page, main text)
PAGES = {
"inline":("<article><p>Formula <math><mi>x</mi>=2</math> holds. Click <button>Go</button> now, or hear <audio controls>the recording</audio> and see <video src=a>the film</video>. This is a long paragraph that carries the text of the article.</p></article>",
 "Formula x=2 holds. Click Go now, or hear the recording and see the film. This is a long paragraph that carries the text of the article."),
"blog":("""<!doctype html><html><head><title>T</title></head><body><header class="masthead"><a href="/">My blog</a><nav><ul><li><a href="/a">About</a></li><li><a href="/c">Contact</a></li></ul></nav></header>
<main><article class="post"><h1>On rivers</h1><p class="byline">By A. Writer</p><p>Rivers run down hills, and they carry stones with them for many miles.</p><blockquote>Water is patient, as the saying goes.</blockquote><ul><li>Stones</li><li>Sand</li></ul><p>In the end they reach the sea.</p></article>
<section id="comments"><h2>Comments</h2><div class="comment"><p>Great post, thanks a lot for writing it!</p></div></section></main>
<aside class="sidebar"><h3>Popular</h3><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul></aside><footer><p>&copy; 2020 My blog. All rights reserved.</p></footer></body></html>""",
 "On rivers Rivers run down hills, and they carry stones with them for many miles. Water is patient, as the saying goes. Stones Sand In the end they reach the sea."),
"divs":("""<body><div id="wrapper"><div id="header"><div class="logo">Site</div></div><div id="nav"><a href="/">Home</a> | <a href="/n">News</a></div>
<div id="content"><h2>Harbour reopens</h2><div class="text">The harbour reopened on Monday after a long winter, and ships came in again.</div><div class="advert">Buy boots now, half price!</div><div class="text">Its master said that the ice had been thick, but that the quay was sound.</div></div>
<div id="sidebar"><p>Weather: rain all day.</p></div><div id="footer">Contact us. Privacy.</div></div></body>""",
 "Harbour reopens The harbour reopened on Monday after a long winter, and ships came in again. Its master said that the ice had been thick, but that the quay was sound."),
"table":("""<body><nav><a href=/>Home</a></nav><article><h1>Prices</h1><p>The table gives prices of the last three years, in pounds.</p><table><tr><th>Year<th>Price<tr><td>2018<td>12<tr><td>2019<td>14</table><p>They rose in each of them.</p></article><form action=/s><input name=q><label>Search</label><button>Go</button></form></body>""",
 "Prices The table gives prices of the last three years, in pounds. Year Price 2018 12 2019 14 They rose in each of them."),
"form_in":("""<body><main><h1>Walking</h1><p>Walking is good for you, and costs nothing at all in most places.</p><form class="newsletter"><p>Get our letter every week in your inbox.</p><input type=email><button>Subscribe</button></form><p>Start with a mile a day, then add another when that is easy.</p></main><div class="cookie-banner">We use cookies. <button>Accept</button></div></body>""",
 "Walking Walking is good for you, and costs nothing at all in most places. Start with a mile a day, then add another when that is easy."),
"bare":("""<html><body><h1>A note</h1><p>Nothing but some paragraphs, as old pages had them, one after another.<p>The second one isn't closed either, and that is fine.<hr><p>Third.</body></html>""",
 "A note Nothing but some paragraphs, as old pages had them, one after another. The second one isn't closed either, and that is fine. Third."),
"code":("""<body><article><h1>Sorting</h1><p>Call the function like this, with a list of numbers as its argument:</p><pre><code>sort([3, 1,
 2])</code></pre><figure><img src=a><figcaption>Fig. 1: a sorted list.</figcaption></figure><dl><dt>Stable</dt><dd>Equal items keep their order.</dd></dl></article></body>""",
 "Sorting Call the function like this, with a list of numbers as its argument: sort([3, 1, 2]) Fig. 1: a sorted list. Stable Equal items keep their order."),
"unmarked_comments":("""<body><div><h1>Bees</h1><p>Bees visit flowers, gather nectar, and make honey from it over the summer months.</p><p>A hive holds up to sixty thousand of them, of which most are workers.</p></div><div><h3>Comments</h3><ul><li>Nice!</li><li>I like bees too.</li></ul></div></body>""",
 "Bees Bees visit flowers, gather nectar, and make honey from it over the summer months. A hive holds up to sixty thousand of them, of which most are workers."),
"links":("""<body><nav class="breadcrumb"><a href=/>Home</a> &gt; <a href=/x>X</a></nav><article><h1>Sources</h1><p>See <a href=a>the first book</a>, <a href=b>the second book</a> and <a href=c>a letter of the author</a>, which say it best.</p><p>All of them were printed before the war, and are hard to find now.</p><div class="share"><a href=f>Share</a> <a href=t>Post</a></div></article><div class="related"><h3>More</h3><a href=1>Another story</a></div></body>""",
 "Sources See the first book, the second book and a letter of the author, which say it best. All of them were printed before the war, and are hard to find now."),
"entities":("<article><p>Caf&eacute; &#8212; &lt;b&gt; &amp;amp; &nbsp; x &#x41; &copy; stays, and so does the rest of this sentence.</p></article>","Café — <b> &amp; x A © stays, and so does the rest of this sentence."),
"wiki":("""<html><body><div id="mw-navigation"><ul><li><a href=a>Main page</a></li><li><a href=b>Random</a></li></ul></div><div id="bodyContent"><h1 id="firstHeading">Quartz</h1><p><b>Quartz</b> is a hard mineral, made of <a href=s>silicon</a> and <a href=o>oxygen</a>.</p><div class="toc"><ul><li><a href="#1">Uses</a></li><li><a href="#2">History</a></li></ul></div><h2>Uses</h2><p>It is used in clocks, in glass, and as a gem stone in its coloured kinds.</p></div><div id="footer">Text is under a free licence.</div></body></html>""",
 "Quartz Quartz is a hard mineral, made of silicon and oxygen. Uses It is used in clocks, in glass, and as a gem stone in its coloured kinds."),
"news":("""<html><body><div class="cookie-notice">This site uses cookies, as all do. <a href=x>More</a></div><div class="container"><article itemscope><header><h1>Bridge closed</h1></header><section><p>The old bridge was closed on Friday, after cracks were found in two of its piers.</p><div class="ad-slot">Advertisement: fly to the sun!</div><p>Engineers will look at it next week, the town said.</p></section></article><aside class="related-posts"><h4>Related</h4><ul><li><a href=1>Bridge built</a></li></ul></aside></div></body></html>""",
 "Bridge closed The old bridge was closed on Friday, after cracks were found in two of its piers. Engineers will look at it next week, the town said."),
"recipe":("""<body><header><p>Kitchen notes</p></header><main><h1>Plain bread</h1><ol><li>Mix flour, water, salt and yeast.</li><li>Wait an hour.</li><li>Bake it hot.</li></ol><p>Let it cool before you cut it, however hard that is.</p></main><footer><a href=p>Privacy</a> <a href=i>Imprint</a></footer></body>""",
 "Plain bread Mix flour, water, salt and yeast. Wait an hour. Bake it hot. Let it cool before you cut it, however hard that is."),
"forum_signup":("""<body><nav><a href=/>Start</a></nav><div class="post-content"><p>A short text with one idea: measure before you cut, and then measure once more.</p><p>That is all there is to it.</p></div><form id="login"><label>Name</label><input><label>Word</label><input></form><script>var a="<p>no</p>";</script><div class="disclaimer">All opinions are mine.</div></body>""",
 "A short text with one idea: measure before you cut, and then measure once more. That is all there is to it."),
}


@pytest.mark.parametrize("name", PAGES)
def test_hand_written_pages(name):
    page, text = PAGES[name]
    assert html.main_text(page) == text


def test_stray_end_tags_take_linear_time():
    n = 20_000
    began = time.perf_counter()
    for page in ("<div>" * n + "x" + "</span>" * n + "</b>" * n, "<b>" + "<div>" * n + "<li>a" * n + "</b>" * n, "<li>" + "<div>" * n + "<td>a" * n, "<p>" + "<i>" * n + "</u>" * n):
        html.parse(page)
    assert time.perf_counter() - began < 5


def test_inline_elements_end_within_their_block():
    page = html.parse("<p><b>one<div>two</b>three</div>four</b> five</p>")
    assert " ".join("".join(t for _, t, _ in page.texts).split()) == "one twothree four five"


def test_pages_of_every_sort(spark):
    """Null and empty pages, a very long one, repeated rows and a clashing column."""
    long = "<article><h1>Long</h1>" + "".join(f"<p>Paragraph {k} says a thing, and then it ends.</p>" for k in range(30_000)) + "</article>"
    rows = [(1, "u", long), (2, None, None), (3, "v", ""), (None, "w", "<article><p>Named by nobody, it is read all the same.</p></article>"), (1, "u", long), (4, "x", "</div></div></p>")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = html.extract(df).collect()
    assert sorted((str(r["page_id"]), len(r["text"])) for r in got) == sorted([("1", len(html.main_text(long)))] * 2 + [("2", 0), ("3", 0), ("None", len("Named by nobody, it is read all the same.")), ("4", 0)])
    assert html.main_text(long).startswith("Long Paragraph 0 says") and html.main_text(long).endswith("Paragraph 29999 says a thing, and then it ends.")
