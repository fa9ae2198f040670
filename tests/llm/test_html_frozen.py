"""op5 on pages written after the model was frozen; what comes out of them has led to no change. And on pages of little text, which used to come out empty."""

import pytest

from revlens.llm import html

SHORT = (
    "The valley lies between two ranges of hills, and a river runs through it. In spring the meadows are under water for weeks. "
    "Farmers keep sheep there, since nothing else would grow. Today some two hundred people live in the village."
)
#: name -> (page, main text)
FROZEN = {
    "museum": (
        '<!doctype html><html><head><title>Clocks</title><style>p{}</style></head><body><div class="topnav"><a href="/">Home</a> <a href="/visit">Visit</a></div><div class="exhibit"><h1>The clock room</h1>'
        "<p>Forty clocks stand in this room, and each of them still tells the time.</p><p>The oldest was built in 1702 by a smith who had never seen one before.</p></div>"
        '<div class="footer"><p>Open daily. Copyright of the museum.</p></div></body></html>',
        "The clock room Forty clocks stand in this room, and each of them still tells the time. The oldest was built in 1702 by a smith who had never seen one before.",
    ),
    "faq": (
        "<body><header><h2>Help desk</h2></header><main><h1>Lost keys</h1><dl><dt>What do I do first?</dt><dd>Look in your coat, then ask at the door.</dd><dt>And then?</dt><dd>Ring the office, which keeps spare ones.</dd></dl></main>"
        '<aside class="related"><ul><li><a href=1>Lost bags</a></li><li><a href=2>Lost cats</a></li></ul></aside></body>',
        "Lost keys What do I do first? Look in your coat, then ask at the door. And then? Ring the office, which keeps spare ones.",
    ),
    "diary": (
        '<html><body><article><h2>Tuesday</h2><p>Rain again, so we stayed in and mended the nets until it grew dark.</p><div class="share-buttons"><a href=a>Tweet</a> <a href=b>Mail</a></div>'
        '<p>In the evening the wind turned, and by ten the stars were out.</p></article><section class="comments"><h3>2 Comments</h3><div class="comment"><p>Lovely, as ever.</p></div></section></body></html>',
        "Tuesday Rain again, so we stayed in and mended the nets until it grew dark. In the evening the wind turned, and by ten the stars were out.",
    ),
    "manual": (
        '<body><nav class="toc"><ol><li><a href=#a>Setup</a></li><li><a href=#b>Use</a></li></ol></nav><div class="page-content"><h1>Pump</h1><h2>Setup</h2><p>Put the pump on level ground, close to the well.</p>'
        "<pre>turn 3\nwait 10</pre><h2>Use</h2><p>Never run it dry, since that ruins the seal within minutes.</p></div></body>",
        "Pump Setup Put the pump on level ground, close to the well. turn 3 wait 10 Use Never run it dry, since that ruins the seal within minutes.",
    ),
}
#: Pages with one short text and no mark that tells what it is.
LITTLE = [
    f'<body><div class="inhalt"><p>{SHORT}</p></div></body>',
    f'<body><div class="kopfzeile">Mein Blatt</div><div class="inhalt"><p>{SHORT}</p></div><div class="fusszeile">Impressum</div></body>',
    f"<body><div>{SHORT}</div></body>",
    f'<body><nav><a href=/>Home</a></nav><div id="x1"><span>{SHORT}</span></div><footer>Copyright 2020, all rights reserved.</footer></body>',
    f'<body><div class="cookie-notice">This site uses cookies, as all do.</div><center><font>{SHORT}</font></center></body>',
]
EMPTY = [
    "<body><nav><a href=/>Home</a> <a href=/b>News</a></nav><footer>Copyright 2020, all rights reserved.</footer></body>",
    '<body><div class="cookie-notice">This site uses cookies, as all do, and so it goes.</div></body>',
    "<body><form>Your name, please: <input name=q><button>Send it</button></form></body>",
]


@pytest.mark.parametrize("name", FROZEN)
def test_pages_that_nothing_was_fitted_to(name):
    page, text = FROZEN[name]
    assert html.main_text(page) == text


def test_little_text_is_not_lost():
    assert [html.main_text(page) for page in LITTLE] == [SHORT] * len(LITTLE)
    assert [html.main_text(page) for page in EMPTY] == [""] * len(EMPTY)
